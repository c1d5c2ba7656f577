"""Quality rules: an isolation forest on rule statistics.

Each document's rule statistics come from its whole text.  A forest of random
splits is grown on a bounded sample of them (many trees on small subsamples,
so that clusters of bad documents do not hide each other); every document is scored by its mean path length, and the
threshold is calibrated on all labelled rows.

Base rules come first: a document of fewer than 20 words, or with over 30 % of
its words in repeated windows of 8 words, fails them and is not kept.  Null
texts have no words and so fail.  Rows of null ids are scored and never
calibrate; repeated rows are scored alike.  Without labelled rows of both
kinds the threshold is the score above which ``spare`` of all documents lie.
Long texts are read whole; a value equal to a split goes to its right, and a
score at the threshold is anomalous.  Empty tables give an empty result.  Other
columns of both tables are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import by_batch, materialise, text_of, texts
from .textbytes import NON_SPACE, Words, blocks

WINDOW = 8

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(SYMBOLS)] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_MARK = np.zeros(256, np.int64)
_MARK[[i for i in range(33, 127) if not chr(i).isalnum()]] = 1
_LEAD = np.ones(256, np.int64)
_LEAD[0x80:0xC0] = 0

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_marks", "n_distinct")


def repeated_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more, the first included.

    Windows are named exactly: names of runs of 1, 2, 4 and so on words are
    numbers given to distinct pairs of shorter names.
    """
    n = len(ids) - width + 1
    if n < 2:
        return 0
    names = ids
    run = 1
    while run < width:
        names = names[:-run] * (len(ids) + 1) + names[run:]
        names = np.unique(names, return_inverse=True)[1]
        run *= 2
    twice = np.bincount(names)[names] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines that hold a word and equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def rule_counts(found: list[str]) -> np.ndarray:
    """One row per text: :data:`COUNTS` and :data:`MORE`."""
    raw = [t.encode("utf-8", "surrogatepass") for t in found]
    out = np.zeros((len(raw), len(COUNTS) + len(MORE)), np.int64)
    for a, b in blocks(raw):
        w = Words(raw[a:b], NON_SPACE)
        first = w.text_start[:-1]
        sums = {
            k: np.add.reduceat(t[w.buffer], first)
            for k, t in (("symbols", _SYMBOL), ("upper", _UPPER), ("marks", _MARK))
        }
        inside = NON_SPACE[w.buffer] * _LEAD[w.buffer]
        out[a:b, 0] = np.diff(w.bounds)
        out[a:b, 1] = np.add.reduceat(inside, first)
        out[a:b, 2] = sums["symbols"]
        out[a:b, 5] = sums["upper"]
        out[a:b, 6] = sums["marks"]
        for i in range(a, b):
            names: dict[bytes, int] = {}
            words = raw[i].split()
            ids = np.fromiter(
                (names.setdefault(x, len(names)) for x in words), np.int64, len(words)
            )
            out[i, 3] = duplicate_lines(raw[i])
            out[i, 4] = repeated_words(ids)
            out[i, 7] = len(names)
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rule counts of every document."""
    names = [*COUNTS, *MORE]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = rule_counts(texts(batch))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(len(names)))],
            ["doc_id", *names],
        )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return by_batch(rows, step, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def measures() -> dict[str, Column]:
    """What the forest looks at: rates that do not depend on a document's length.

    Repeated lines stay out: a line repeated by chance is rare, and a forest
    isolates what is rare, however clean.
    """
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {
        "word_length": F.col("word_chars") / n,
        "symbol_rate": F.col("n_symbols") / n,
        "repeat_rate": F.col("n_repeat_words") / n,
        "upper_rate": F.col("n_upper") / chars,
        "mark_rate": F.col("n_marks") / chars,
        # distinct words against what prose of that length would have (Heaps' law, exponent 0.9)
        "variety": F.col("n_distinct") / F.pow(n, F.lit(0.9)),
    }


@dataclass
class Forest:
    """Trees as flat arrays, (tree, node): feature (-1: leaf), split value, path length at a leaf."""

    feature: np.ndarray
    value: np.ndarray
    length: np.ndarray
    expected: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of each row in 0..1: 2 to the power of minus mean path over expected path."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, value, length in zip(self.feature, self.value, self.length, strict=True):
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= value[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += length[node]
        return 2.0 ** (-total / len(self.feature) / self.expected)


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    if n < 2:
        return 0.0
    return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(sample: np.ndarray, trees: int = 300, rows: int = 32, seed: int = 7) -> Forest:
    """Grow trees on subsamples; each split takes a random feature and a random value in its range."""
    rng = np.random.default_rng(seed)
    rows = min(rows, len(sample))
    depth = max(1, math.ceil(math.log2(max(2, rows))))
    size = 2 ** (depth + 1) - 1
    feature = np.full((trees, size), -1, np.int64)
    value, length = np.zeros((trees, size)), np.zeros((trees, size))
    for t in range(trees):
        todo = [(0, 0, sample[rng.choice(len(sample), rows, replace=False)])]
        while todo:
            node, level, held = todo.pop()
            low, high = held.min(axis=0), held.max(axis=0)
            varied = np.flatnonzero(high > low)
            if level == depth or len(held) < 2 or not len(varied):
                length[t, node] = level + expected_path(len(held))
                continue
            f = int(rng.choice(varied))
            v = rng.uniform(low[f], high[f])
            feature[t, node], value[t, node] = f, v
            right = held[:, f] >= v
            todo.append((2 * node + 1, level + 1, held[~right]))
            todo.append((2 * node + 2, level + 1, held[right]))
    return Forest(feature, value, length, max(expected_path(rows), 1e-9))


def threshold(bins: list[tuple[int, int, int]], spare: float) -> float:
    """The score bin from which documents are anomalous.

    ``bins`` are (bin, good rows, bad rows).  Chosen is the cut that separates
    best (rate of bad found minus rate of good lost) of those that lose at most
    ``spare`` of the good rows.
    """
    good, bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
    best, cut = 0.0, BINS + 1
    lost = found = 0
    for k, g, b in sorted(bins, reverse=True):
        lost, found = lost + g, found + b
        if good and bad and lost <= spare * good and found / bad - lost / good > best:
            best, cut = found / bad - lost / good, k
    return float(cut)


BINS = 2000


def verdicts(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    label_col: str = "quality",
    trees: int = 300,
    rows_per_tree: int = 32,
    spare: float = 0.01,
    seed: int = 7,
) -> DataFrame:
    """(doc_id, counts, base_failed, anomaly, kept) per document.

    The forest is grown on at most ``trees * rows_per_tree`` rows, the first by
    a hash of their statistics and id among those that pass the base rules.
    """
    stats = statistics(docs, id_col, text_col)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = materialise(stats.withColumns(measures()).withColumn("base_failed", failed), "rules")
    features = list(measures())
    mark = F.xxhash64("doc_id", "word_chars", "n_words", "n_distinct")
    taken = (
        stats.where(~F.col("base_failed"))
        .select(mark.alias("mark"), *features)
        .orderBy("mark")
        .limit(trees * rows_per_tree)
        .toArrow()
    )
    sample = np.column_stack([taken.column(f).to_numpy() for f in features])
    if not len(sample):
        sample = np.zeros((1, len(features)))
    forest = grow(sample, trees, rows_per_tree, seed)
    names = [*COUNTS]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.column_stack([batch.column(f).to_numpy() for f in features])
        held = [batch.column(c) for c in ("doc_id", *names, "base_failed")]
        scores = pa.array(forest.scores(x))
        return pa.RecordBatch.from_arrays(
            [*held, scores], ["doc_id", *names, "base_failed", "anomaly"]
        )

    schema = (
        "doc_id long, "
        + ", ".join(f"{n} long" for n in names)
        + ", base_failed boolean, anomaly double"
    )
    scored = materialise(by_batch(stats, step, schema), "anomaly")
    level = F.floor(F.col("anomaly") * BINS).cast("int")
    known = labels.select(
        F.col(label_id).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")
    ).where("label IN (0, 1)")
    bins = (
        scored.where(~F.col("base_failed"))
        .select("doc_id", level.alias("bin"))
        .join(known, "doc_id")
        .groupBy("bin")
        .agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad"))
        .collect()
    )
    rows = [tuple(r) for r in bins]
    if sum(r[1] for r in rows) and sum(r[2] for r in rows):
        cut = threshold(rows, spare)
    else:
        every = scored.where(~F.col("base_failed")).select(level.alias("bin"))
        top = every.agg(F.percentile_approx("bin", 1 - spare, 10000)).first()[0]
        cut = (top or 0) + 1
    return scored.withColumn("kept", ~F.col("base_failed") & (level < F.lit(int(cut))))
