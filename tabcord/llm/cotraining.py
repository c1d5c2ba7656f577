"""Quality classifier by co-training on two views of a document.

The text view looks at which of a few hundred telling words occur in the whole
text and at rates of its characters and words; the metadata view looks at the
other columns (categories and numbers), never at the text.  Each view has a
logistic regression.  Over rounds, each labels the documents of an unlabelled
pool of which it is most confident for the *other* view's training set.  Both
are then calibrated on labelled documents that neither was trained on, and the
calibrated views are combined by a second small regression to score every
document.

A label is good (1) if quality is 1 and the document is not toxic; rows
without both labels are unlabelled.  Models are fitted on bounded samples,
which are parameters: ``per_class`` labelled documents of each class and
``pool`` unlabelled ones, each the first by a hash of the id.  Telling words
are counted by Spark over the labelled sample.  Everything else covers all
rows.

Texts without a word (null, empty) are rejected with score 0.  A null category
is a category of its own; a null number falls in a bin of its own.  Rows of
null ids are scored and never train.  Repeated rows are scored alike.  If no
label of either class exists, all documents with words are accepted with score
1.  Long texts are read whole, a few MB at a time.  Of equally sure documents of
the pool the first by a hash of the id is taken, and a label that a document has
twice counts as the worse.  Every category value of the sample has a column of its
own; unseen values share one.  Empty tables give an empty result.  Columns of
documents with clashing names stay apart in ``row``; other columns of labels are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import by_batch, materialise, text_of, texts, whole_row, with_row
from .linear import fit, margins, sigmoid
from .textbytes import ALNUM, Words, blocks

RATES = ("symbols", "upper", "marks", "repeats", "stutter", "word_length", "log_words")

#: Besides whole words, beginnings of words of so many bytes: stems that inflect.
STEMS = (4, 5, 6)

_CLASS = {
    "symbols": b"#*$%&|<>",
    "upper": bytes(range(65, 91)),
    "marks": bytes(i for i in range(33, 127) if not chr(i).isalnum()),
}
_IS = {k: np.isin(np.arange(256), list(v)).astype(np.int64) for k, v in _CLASS.items()}


def view_of_text(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rates per text, text and code of each distinct word or stem), in order of text."""
    raw = [t.encode("utf-8", "replace") for t in found]
    rates = np.zeros((len(raw), len(RATES)))
    owners, codes = [], []
    for a, b in blocks(raw):
        w = Words(raw[a:b], ALNUM, fold=True)
        sums = {k: np.add.reduceat(t[w.buffer], w.text_start[:-1]) for k, t in _IS.items()}
        n = np.diff(w.bounds)
        distinct = np.zeros(b - a, np.int64)
        for k, (text, code) in enumerate(
            [(w.text, w.code), *(w.beginnings(size) for size in STEMS)]
        ):
            order = np.lexsort((code, text))
            text, code = text[order], code[order]
            new = np.ones(len(code), bool)
            new[1:] = (text[1:] != text[:-1]) | (code[1:] != code[:-1])
            owners.append(text[new] + a)
            codes.append(code[new])
            if k == 0:
                distinct = np.bincount(text[new], minlength=b - a)
        same = (w.code[1:] == w.code[:-1]) & (w.text[1:] == w.text[:-1])
        stutter = np.bincount(w.text[1:][same], minlength=b - a)
        size = np.add.reduceat(ALNUM[w.buffer].astype(np.int64), w.text_start[:-1])
        few, small = np.maximum(n, 1), np.maximum(size, 1)
        rates[a:b] = np.column_stack(
            [
                sums["symbols"] / few,
                sums["upper"] / (small + 20),
                sums["marks"] / (few + 4),
                1 - distinct / few,
                stutter / few,
                (size + 100) / (few + 20),  # drawn towards 5 where words are few
                np.log(few),
            ]
        )
        rates[a:b][n == 0] = np.nan
    join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
    owner, code = join(owners, np.int64), join(codes, np.uint64)
    order = np.argsort(owner, kind="stable")
    return rates, owner[order], code[order]


def binned(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin numbers; missing values have the last bin."""
    at = np.searchsorted(edges, values, "right")
    return np.where(np.isnan(values), len(edges) + 1, at)


def edges_of(values: np.ndarray, bins: int) -> np.ndarray:
    known = values[~np.isnan(values)]
    if not len(known):
        return np.empty(0)
    return np.unique(np.quantile(known, np.linspace(0, 1, bins + 1)[1:-1]))


@dataclass
class Model:
    """Both views, their calibration and how they combine."""

    words: np.ndarray  # sorted codes of the telling words
    edges: list[np.ndarray]
    text: np.ndarray = field(default_factory=lambda: np.zeros(1))
    categories: list[dict[str, int]] = field(default_factory=list)
    number_edges: list[np.ndarray] = field(default_factory=list)
    meta: np.ndarray = field(default_factory=lambda: np.zeros(1))
    calibration: dict[str, np.ndarray] = field(default_factory=dict)
    combine: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, 40.0]))
    cut: float = 0.0

    def text_columns(self) -> int:
        return len(self.words) + sum(len(e) + 2 for e in self.edges)

    def text_entries(self, rates, owners, codes) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of the text view's ones."""
        rows, cols = [], []
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, codes), len(self.words) - 1)
            hit = self.words[at] == codes
            rows.append(owners[hit])
            cols.append(at[hit])
        first = len(self.words)
        for k, e in enumerate(self.edges):
            rows.append(np.arange(len(rates)))
            cols.append(first + binned(rates[:, k], e))
            first += len(e) + 2
        return np.concatenate(rows), np.concatenate(cols)

    def text_margin(self, rates, owners, codes) -> np.ndarray:
        rows, cols = self.text_entries(rates, owners, codes)
        return np.bincount(rows, self.text[cols], len(rates)) + self.text[-1]

    def meta_columns(self) -> int:
        return sum(len(c) + 1 for c in self.categories) + sum(len(e) + 2 for e in self.number_edges)

    def meta_entries(self, cats: list[list[str | None]], nums: list[np.ndarray]) -> np.ndarray:
        """The metadata columns that are 1, one per field, by row."""
        n = len(cats[0]) if cats else len(nums[0]) if nums else 0
        out, first = [], 0
        for known, values in zip(self.categories, cats, strict=True):
            at = np.fromiter((known.get(str(v), len(known)) for v in values), np.int64, n)
            out.append(first + at)
            first += len(known) + 1
        for e, values in zip(self.number_edges, nums, strict=True):
            out.append(first + binned(values, e))
            first += len(e) + 2
        return np.column_stack(out) if out else np.zeros((n, 0), np.int64)

    def meta_matrix(self, cats: list[list[str | None]], nums: list[np.ndarray]) -> np.ndarray:
        """The metadata view of a bounded sample; values of a category are columns each."""
        entries = self.meta_entries(cats, nums)
        out = np.zeros((len(entries), self.meta_columns()), np.float32)
        np.put_along_axis(out, entries, 1, axis=1)
        return out

    def meta_margins(self, cats: list[list[str | None]], nums: list[np.ndarray]) -> np.ndarray:
        """Margins of the metadata view, without its matrix."""
        return self.meta[self.meta_entries(cats, nums)].sum(axis=1) + self.meta[-1]

    def probabilities(self, text: np.ndarray, meta: np.ndarray):
        """(text view, metadata view, both) from margins, calibrated."""
        a, b = (
            margins(m[:, None], self.calibration[k])
            for k, m in (("text", text), ("meta", meta))
        )
        return sigmoid(a), sigmoid(b), sigmoid(margins(np.column_stack([a, b]), self.combine))


def confident(p: np.ndarray, free: np.ndarray, share: float, sure: float) -> dict[int, int]:
    """The surest documents of a pool: row -> label, at most ``share`` of the pool per class."""
    most = max(1, int(share * len(p)))
    out = {}
    for label, q in ((1, p), (0, 1 - p)):
        rows = np.flatnonzero(free & (q >= sure))
        for r in rows[np.argsort(-q[rows], kind="stable")][:most].tolist():
            out[r] = label
    return out


def cotrain(x_text, x_meta, y, fold, rounds: int, share: float, sure: float):
    """Weights of both views.  ``y`` is -1 for the pool; ``fold`` marks rows held for calibration."""
    base = (y >= 0) & ~fold
    labels = {"text": np.where(base, y, -1), "meta": np.where(base, y, -1)}
    views = {"text": x_text, "meta": x_meta}
    weights = {}
    for k in range(rounds + 1):
        for name, x in views.items():
            known = labels[name] >= 0
            target = labels[name][known]
            # classes weigh the same
            n1 = max(1, int(target.sum()))
            n0 = max(1, len(target) - n1)
            each = np.where(target == 1, 0.5 / n1, 0.5 / n0)
            weights[name] = fit(x[known], 2.0 * target - 1, each, "logistic", 1e-4)
        if k == rounds:
            return weights
        for name, other in (("text", "meta"), ("meta", "text")):
            p = sigmoid(margins(views[name], weights[name]))
            free = (y < 0) & (labels[other] < 0)
            for r, label in confident(p, free, share, sure).items():
                labels[other][r] = label


def best_cut(p: np.ndarray, y: np.ndarray, spare: float) -> float:
    """Scores below the cut are rejected: the best separation that loses at most ``spare`` of the good."""
    order = np.argsort(p, kind="stable")
    good = np.cumsum(y[order] == 1) / max(1, (y == 1).sum())
    bad = np.cumsum(y[order] == 0) / max(1, (y == 0).sum())
    gain = np.where(good <= spare, bad - good, -1.0)
    k = int(np.argmax(gain))
    if gain[k] <= 0:
        return 0.0
    ranked = p[order]
    after = ranked[k + 1] if k + 1 < len(ranked) else 1.0
    return float((ranked[k] + after) / 2)


VIEW = "id long, good int, rates array<double>, codes array<long>, cats array<string>, nums array<double>"


def sample_views(rows: DataFrame) -> DataFrame:
    """Both views of sampled rows (id, good, text, cats, nums)."""

    def step(batch: pa.RecordBatch) -> pa.Table:
        found, parts = texts(batch), []
        for a, b in blocks(found, PART):
            rates, owners, codes = view_of_text(found[a:b])
            cuts = np.searchsorted(owners, np.arange(b - a + 1)).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(cuts), pa.array(codes.view(np.int64)))
            own = [batch.column(c).slice(a, b - a) for c in ("id", "good", "cats", "nums")]
            numbers = pa.array(list(rates), pa.list_(pa.float64()))
            columns = [*own[:2], numbers, words, *own[2:]]
            names = ["id", "good", "rates", "codes", "cats", "nums"]
            parts.append(pa.RecordBatch.from_arrays(columns, names))
        return pa.Table.from_batches(parts)

    return by_batch(rows, step, VIEW)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    categories: tuple[str, ...] = ("lang", "source"),
    numbers: tuple[str, ...] = ("n_chars",),
    quality_col: str = "quality",
    toxic_col: str = "toxic",
    per_class: int = 3000,
    pool: int = 3000,
    n_words: int = 400,
    rounds: int = 3,
    share: float = 0.1,
    sure: float = 0.95,
    spare: float = 0.005,
) -> Model | None:
    """Fit the two views; None if a class has no label."""
    known = labels.select(
        F.col("doc_id").cast("long").alias("id"),
        ((F.col(quality_col) == 1) & (F.col(toxic_col) == 0)).cast("int").alias("good"),
    ).where("id IS NOT NULL AND good IS NOT NULL")
    known = known.groupBy("id").agg(F.min("good").alias("good"))
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    mark = F.xxhash64("id")
    usable = known.join(ids, "id", "left_semi")
    chosen = ids.join(known, "id", "left_anti").withColumn("good", F.lit(-1))
    chosen = chosen.orderBy(mark, "id").limit(pool)
    for label in (0, 1):
        part = usable.where(F.col("good") == label).orderBy(mark, "id").limit(per_class)
        chosen = chosen.unionAll(part)
    chosen = materialise(chosen, "sample")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        text_of(text_col).alias("text"),
        F.array(*(F.col(c).cast("string") for c in categories)).cast("array<string>").alias("cats"),
        F.array(*(F.col(c).cast("double") for c in numbers)).cast("array<double>").alias("nums"),
    )
    # one row of each id, so the sample has at most pool + 2 * per_class rows
    one = F.min(F.struct(F.xxhash64("text").alias("mark"), "text", "cats", "nums", "good"))
    rows = rows.join(F.broadcast(chosen), "id").groupBy("id").agg(one.alias("one"))
    rows = rows.select("id", *(f"one.{c}" for c in ("good", "text", "cats", "nums")))
    views = materialise(sample_views(rows), "views")
    model = Model(telling_words(views, n_words), [])
    hits = views.select(
        "id",
        "good",
        "rates",
        F.filter("codes", lambda c: c.isin(model.words.view(np.int64).tolist())).alias("codes"),
        "cats",
        "nums",
    )
    held = hits.orderBy("id").toArrow()
    y = held.column("good").to_numpy()
    if not ((y == 1).any() and (y == 0).any()):
        return None
    rates = np.array(held.column("rates").to_pylist(), float)
    model.edges = [edges_of(rates[:, k], 12) for k in range(len(RATES))]
    lists = held.column("codes").to_pylist()
    owners = np.repeat(np.arange(len(lists)), [len(c) for c in lists])
    codes = np.array([c for x in lists for c in x], np.int64).view(np.uint64)
    x_text = np.zeros((len(y), model.text_columns()))
    x_text[model.text_entries(rates, owners, codes)] = 1
    cats = list(map(list, zip(*held.column("cats").to_pylist(), strict=True)))
    nums = list(np.array(held.column("nums").to_pylist(), float).T) if numbers else []
    model.categories = [
        {v: i for i, v in enumerate(sorted({str(x) for x in c}))} for c in cats
    ]
    model.number_edges = [edges_of(v, 10) for v in nums]
    x_meta = model.meta_matrix(cats, nums) if cats or nums else np.zeros((len(y), 0))
    ids_ = held.column("id").to_numpy()
    fold = (y >= 0) & (_spread(ids_) % 4 == 0)
    for label in (0, 1):
        if not (fold & (y == label)).any() or not (~fold & (y == label)).any():
            fold = y >= 0  # too few labels to hold some out
            break
    base = ~fold if (~fold & (y >= 0)).any() else np.zeros(len(y), bool)
    weights = cotrain(x_text, x_meta, y, fold & base.any(), rounds, share, sure)
    model.text, model.meta = weights["text"], weights["meta"]
    sign, target = 2.0 * y[fold] - 1, y[fold]
    each = np.where(target == 1, 0.5 / max(1, (target == 1).sum()), 0.5 / max(1, (target == 0).sum()))
    raw = {"text": margins(x_text, model.text)[fold], "meta": margins(x_meta, model.meta)[fold]}
    for name, m in raw.items():
        model.calibration[name] = fit(m[:, None], sign, each, "logistic", 1e-3, 400)
    both = np.column_stack([margins(raw[n][:, None], model.calibration[n]) for n in raw])
    model.combine = fit(both, sign, each, "logistic", 1e-3, 400)
    model.cut = best_cut(sigmoid(margins(both, model.combine)), target, spare)
    return model


def _spread(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)


def telling_words(views: DataFrame, n_words: int, least: int = 4) -> np.ndarray:
    """Codes of the words whose presence tells most about the label (chi square), sorted."""
    labelled = views.where("good >= 0")
    good, bad = labelled.agg(
        F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum(1 - F.col("good")), F.lit(0))
    ).first()
    n = float(good + bad)
    if not n:
        return np.empty(0, np.uint64)
    counts = (
        labelled.select("good", F.explode("codes").alias("code"))
        .groupBy("code")
        .agg(F.sum("good").cast("double").alias("g"), F.count(F.lit(1)).cast("double").alias("a"))
        .where(F.col("a") >= least)
    )
    g, a = F.col("g"), F.col("a")
    expected = a * F.lit(good / n)
    spread_ = F.greatest(expected * F.lit(bad / n) * (1 - a / n), F.lit(1e-9))
    top = (
        counts.withColumn("tells", (g - expected) * (g - expected) / spread_)
        .orderBy(F.desc("tells"), "code")
        .limit(n_words)
    )
    codes = np.array([r.code for r in top.select("code").collect()], np.int64).view(np.uint64)
    return np.sort(codes)


#: Characters of text whose view is held at a time.
PART = 1 << 21

RESULT = "p_text double, p_meta double, score double, accepted boolean"


def score_rows(
    docs: DataFrame,
    model: Model | None,
    id_col: str = "doc_id",
    text_col: str = "text",
    categories: tuple[str, ...] = ("lang", "source"),
    numbers: tuple[str, ...] = ("n_chars",),
) -> DataFrame:
    """(row, p_text, p_meta, score, accepted): every row with its scores, the row as one struct."""
    cats = [f"c{i}" for i in range(len(categories))]
    nums = [f"n{i}" for i in range(len(numbers))]
    rows = whole_row(
        docs,
        text=text_of(text_col),
        **{n: F.col(c).cast("string") for n, c in zip(cats, categories, strict=True)},
        **{n: F.col(c).cast("double") for n, c in zip(nums, numbers, strict=True)},
    )

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = texts(batch)
        text, wordless = np.zeros(len(found)), np.zeros(len(found), bool)
        for a, b in blocks(found, PART):
            rates, owners, codes = view_of_text(found[a:b])
            wordless[a:b] = np.isnan(rates[:, 0])
            if model is not None:
                text[a:b] = model.text_margin(rates, owners, codes)
        if model is None:
            p = q = both = np.ones(batch.num_rows)
        else:
            numbers_ = [
                np.array([np.nan if v is None else v for v in batch.column(n).to_pylist()], float)
                for n in nums
            ]
            if cats or nums:
                meta = model.meta_margins([batch.column(c).to_pylist() for c in cats], numbers_)
            else:
                meta = np.full(batch.num_rows, model.meta[-1])
            p, q, both = model.probabilities(text, meta)
        both = np.where(wordless, 0.0, both)
        accepted = ~wordless & (both >= (model.cut if model else 0.0))
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(p), pa.array(q), pa.array(both), pa.array(accepted)],
            ["row", "p_text", "p_meta", "score", "accepted"],
        )

    return by_batch(rows, step, with_row(docs, RESULT))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, p_text, p_meta, score, accepted) of every document."""
    model = train(docs, labels, id_col=id_col, **options)
    named = {
        k: options[k] for k in ("text_col", "categories", "numbers") if k in options
    }
    columns = [
        id_col,
        named.get("text_col", "text"),
        *named.get("categories", ("lang", "source")),
        *named.get("numbers", ("n_chars",)),
    ]
    scored = score_rows(docs.select(*dict.fromkeys(columns)), model, id_col, **named)
    doc_id = F.col("row")[id_col].cast("long").alias("doc_id")
    return scored.select(doc_id, "p_text", "p_meta", "score", "accepted")


def keep_accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    model = train(docs, labels, **options)
    named = {
        k: options[k] for k in ("text_col", "categories", "numbers") if k in options
    }
    return score_rows(docs, model, **named).where("accepted").select("row.*")
