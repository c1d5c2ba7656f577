"""Benchmark decontamination by spaced seeds.

Fixed masks choose which words of a window count and which are ignored, so a
substituted word spoils only the windows that look at it.  Every window of
every benchmark item is hashed under every mask; a bit table of fixed size
over these hashes lets the tasks that read the documents keep only windows
that may match.  Those are joined with the benchmark hashes, and each
(document, item, alignment) that results is verified word by word: a segment
along the alignment must hold ``min_match`` equal words (or the whole of a
shorter item, save one in five) and be equal in at least ``identity`` of its
words.  The best-scoring segment, where a match scores 1 and a substitution
-3, is reported if it does, else the one with the most equal words.

The masks leave no copy out: whatever up to one word in five of a passage is
substituted, as ``min_match`` 13 and ``identity`` 0.8 allow, a window under one
of them is spared.  Items of fewer than 16 words have further masks for their
length, so what is found of an item does not depend on the other items.

Words are lower-cased runs of letters and digits; in scripts written without
spaces every character is a word.  Items of fewer than five words are found
where they are copied whole; ``min_words`` leaves out shorter ones.  Null or
empty texts match nothing.  Null ids and repeated rows are kept apart by their
text: rows with equal id and text get equal results, and items of equal words
are verified once and reported each.  Empty tables give no match.  Long texts
are read whole, a few MB at a time.  Of equally good segments the first is
reported.  Other columns of both tables are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import by_batch, materialise, text_of, texts
from .textbytes import ALNUM, Words, blocks, mix

#: Positions that count are 1.
MASKS = (
    "11101001111",
    "110110100111",
    "10110110001011",
    "111011101",
    "10100000110111",
    "10110000101101",
    "11000100001111",
)
#: Further masks of items by their number of words.
SHORT_MASKS = {
    5: ("1111", "10111", "11011", "11101"),
    6: ("1111", "11011"),
    7: ("1111", "11011"),
    8: ("110111", "11011001"),
    9: ("110111",),
    10: ("110111", "11001011", "101010011"),
    11: ("1111011", "111111", "1101000111"),
    12: ("1111101", "11110011"),
    13: ("1101111",),
    15: ("111101001",),
}
#: Address bits of the prefilter: 4 MB for small benchmarks, 64 MB at most.
LEAST_BITS, MOST_BITS = 25, 29

_ODD = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(
    2
) + np.uint64(1)


def offsets_of(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def seeds(words: Words, offsets: list[int], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every window that lies within one text."""
    span = offsets[-1] + 1
    n = len(words.code) - span + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    total = np.full(n, salt, np.uint64)
    for k, o in enumerate(offsets):
        total += words.code[o : o + n] * _ODD[k % 64] ^ np.uint64(k >> 6)
    first = np.flatnonzero(words.text[:n] == words.text[span - 1 :])
    return first, mix(total[first])


_MARK = re.compile(r"[^\x00-\x7f\w]")
#: Letters of Thai, Lao, Myanmar, Khmer, Kana and Han.
_UNSPACED = re.compile(
    "([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff"
    "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])"
)


def lowered(found: list[str]) -> list[bytes]:
    """Lower-cased texts in which marks beyond ASCII are spaces and unspaced letters stand alone."""
    out = []
    for text in found:
        if not text.isascii():
            text = _UNSPACED.sub(r" \1 ", _MARK.sub(" ", text))
        out.append(text.lower().encode("utf-8", "replace"))
    return out


def masks_of(n: int) -> tuple[str, ...]:
    """The masks of an item of ``n`` words; one below five words is matched whole."""
    return MASKS + SHORT_MASKS.get(n, ()) if n > 4 else ("1" * n,)


def item_masks(lengths: list[int]) -> list[str]:
    """The fixed masks, and the further ones of these item lengths."""
    return list(dict.fromkeys([*MASKS, *(m for n in sorted(lengths) for m in masks_of(n))]))


def _code_array(words: Words, a: int, b: int) -> list[int]:
    return words.code[a:b].view(np.int64)


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_key, item_id, codes): hashed words of every item; equal words have equal keys."""

    def step(batch: pa.RecordBatch) -> pa.Table:
        found = lowered(texts(batch))
        out = []
        for a, b in blocks(found):
            w = Words(found[a:b], ALNUM)
            out += [_code_array(w, w.bounds[i], w.bounds[i + 1]) for i in range(b - a)]
        codes = pa.array(out, pa.list_(pa.int64()))
        return pa.Table.from_arrays([batch.column("item_id"), codes], ["item_id", "codes"])

    rows = (
        items.select(F.col(id_col).cast("string").alias("item_id"), text_of(text_col).alias("text"))
        .distinct()
    )
    found = by_batch(rows, step, "item_id string, codes array<long>").distinct()
    return found.select(F.xxhash64("codes").alias("item_key"), "item_id", "codes")


def item_seeds(words: DataFrame, masks: list[str]) -> DataFrame:
    """(item_key, key, at): every window of every item, hashed under the masks of its length."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, keys, places = [], [], []
        for item, codes in zip(
            batch.column("item_key").to_pylist(), batch.column("codes"), strict=True
        ):
            w = _FakeWords(np.asarray(codes.values, np.int64).view(np.uint64))
            for mask in masks_of(len(w.code)):
                at, key = seeds(w, offsets_of(mask), masks.index(mask))
                ids += [item] * len(at)
                keys.append(key.view(np.int64))
                places.append(at)
        if not ids:
            return None
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(np.concatenate(keys)),
                pa.array(np.concatenate(places)),
            ],
            ["item_key", "key", "at"],
        )

    return by_batch(words, step, "item_key long, key long, at long")


class _FakeWords:
    """Words of a single text, given by their codes."""

    def __init__(self, code: np.ndarray):
        self.code, self.text = code, np.zeros(len(code), np.int64)


def address_bits(n: int) -> int:
    """Address bits at which ``n`` hashes mark at most a quarter of the table, within bounds."""
    return min(MOST_BITS, max(LEAST_BITS, (8 * max(n, 1) - 1).bit_length()))


def bit_table(found: DataFrame) -> np.ndarray:
    """A table of bits, sized by the number of benchmark hashes, with two marks for each.

    The marks are gathered as distinct table addresses: at most one per bit,
    merged by Spark into words of 32 bits before they reach the driver.
    """
    bits = address_bits(found.count())
    two = F.array(
        F.shiftrightunsigned("key", 64 - bits),
        F.shiftrightunsigned(F.shiftleft("key", bits), 64 - bits),
    )
    marks = (
        found.select(F.explode(two).alias("address"))
        .select(
            F.shiftright("address", 5).cast("int").alias("word"),
            F.expr("shiftleft(1L, CAST(address % 32 AS INT))").alias("bit"),
        )
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
    )
    table = np.zeros(1 << (bits - 5), np.uint32)
    held = marks.toArrow()
    table[held.column("word").to_numpy()] = held.column("bits").to_numpy().astype(np.uint32)
    return table


def marked(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether both marks of each hash are set."""
    bits = len(table).bit_length() + 4

    def held(codes: np.ndarray) -> np.ndarray:
        address = (codes >> np.uint64(64 - bits)).astype(np.int64)
        return (table[address >> 5] >> (address & 31).astype(np.uint32)) & np.uint32(1) != 0

    found = held(keys)
    found[found] = held(keys[found] << np.uint64(bits))
    return found


REGIONS = (
    "doc_id long, text_key long, region long, codes array<long>, keys array<long>, ats array<long>"
)


def document_regions(
    docs: DataFrame, masks: list[str], marks: np.ndarray, reach: int, id_col: str, text_col: str
) -> DataFrame:
    """Word codes around windows that may match, one row per stretch of such windows.

    ``reach`` words are kept on either side of a window, as many as the longest
    item has, so an alignment can be verified without the document.
    """
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def step(batch: pa.RecordBatch) -> pa.Table | None:
        table = shared.value
        found = lowered(texts(batch))
        rows: list[int] = []
        regions: list[int] = []
        codes: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        ats: list[np.ndarray] = []
        for a, b in blocks(found):
            w = Words(found[a:b], ALNUM)
            at, key = [], []
            for salt, mask in enumerate(masks):
                first, code = seeds(w, offsets_of(mask), salt)
                hit = marked(table, code)
                at.append(first[hit])
                key.append(code[hit])
            place, code = np.concatenate(at), np.concatenate(key)
            if not len(place):
                continue
            order = np.argsort(place, kind="stable")
            place, code = place[order], code[order]
            owner = w.text[place]
            cut = np.flatnonzero((np.diff(place) > reach) | (np.diff(owner) != 0)) + 1
            for x, y in zip([0, *cut.tolist()], [*cut.tolist(), len(place)], strict=True):
                text = owner[x]
                low, high = w.bounds[text], w.bounds[text + 1]
                start = max(low, place[x] - reach)
                stop = min(high, place[y - 1] + 2 * reach)
                rows.append(a + int(text))
                regions.append(int(start - low))
                codes.append(w.code[start:stop].view(np.int64))
                keys.append(code[x:y].view(np.int64))
                ats.append(place[x:y] - start)
        if not rows:
            return None
        longs = pa.list_(pa.int64())
        return pa.Table.from_arrays(
            [
                batch.column("doc_id").take(pa.array(rows)),
                batch.column("text_key").take(pa.array(rows)),
                pa.array(regions, pa.int64()),
                pa.array(codes, longs),
                pa.array(keys, longs),
                pa.array(ats, longs),
            ],
            ["doc_id", "text_key", "region", "codes", "keys", "ats"],
        )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return by_batch(rows.withColumn("text_key", F.xxhash64("text")), step, REGIONS)


def best_segment(equal: np.ndarray, penalty: int = 3) -> tuple[int, int, int]:
    """(matches, first, last + 1) of the best-scoring stretch of an alignment."""
    score = np.cumsum(np.where(equal, 1, -penalty))
    floor = np.minimum.accumulate(np.concatenate([[0], score[:-1]]))
    end = int(np.argmax(score - floor))
    before = np.concatenate([[0], score])[: end + 1]
    start = int(np.flatnonzero(before == floor[end])[-1])
    return int(equal[start : end + 1].sum()), start, end + 1


def copied_segment(
    equal: np.ndarray, need: int, identity: float
) -> tuple[int, int, int] | None:
    """(matches, first, last + 1) of a segment with ``need`` matches and ``identity``, if there is one."""
    found, a, b = best_segment(equal)
    if found >= need and found >= identity * (b - a):
        return found, a, b
    count = np.concatenate([[0], np.cumsum(equal)])
    if count[-1] < need:
        return None
    # a segment a..b has the identity if spare[a] <= spare[b]; all first words are tried for each b
    spare = count - identity * np.arange(len(count))
    least = np.minimum.accumulate(spare)
    first = np.searchsorted(-least, -spare - 1e-9)
    held = count - count[first]
    b = int(np.argmax(held))
    if held[b] < need:
        return None
    inside = np.flatnonzero(equal[first[b] : b]) + first[b]
    return int(held[b]), int(inside[0]), int(inside[-1]) + 1


def verify(pairs: DataFrame, min_match: int, identity: float) -> DataFrame:
    """Keep alignments (doc_id, text_key, region, codes, item_key, item_codes, shift) that overlap."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keep, starts, ends, matches = [], [], [], []
        columns = [batch.column(n) for n in ("codes", "item_codes", "shift", "region")]
        for i, (codes, item, shift, region) in enumerate(zip(*columns, strict=True)):
            shift = shift.as_py()
            d = np.asarray(codes.values)[max(0, shift) :]
            t = np.asarray(item.values)[max(0, -shift) :]
            n = min(len(d), len(t))
            if not n:
                continue
            whole = len(item.values)
            need = min(min_match, -(-whole * 4 // 5))
            segment = copied_segment(d[:n] == t[:n], need, identity)
            if segment:
                found, a, b = segment
                keep.append(i)
                starts.append(region.as_py() + max(0, shift) + a)
                ends.append(region.as_py() + max(0, shift) + b)
                matches.append(found)
        if not keep:
            return None
        return pa.RecordBatch.from_arrays(
            [
                *(batch.column(c).take(pa.array(keep)) for c in ("doc_id", "text_key", "item_key")),
                pa.array(starts, pa.int64()),
                pa.array(ends, pa.int64()),
                pa.array(matches, pa.int64()),
            ],
            ["doc_id", "text_key", "item_key", "first_word", "end_word", "n_equal"],
        )

    return by_batch(
        pairs,
        step,
        "doc_id long, text_key long, item_key long, first_word long, end_word long, n_equal long",
    )


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = 13,
    identity: float = 0.8,
    min_words: int = 1,
) -> DataFrame:
    """Verified overlaps: (doc_id, text_key, item_id, first_word, end_word, n_equal)."""
    words = materialise(
        item_words(benchmark, item_col, item_text_col).where(F.size("codes") >= min_words),
        "benchmark",
    )
    kinds = materialise(words.select("item_key", "codes").distinct(), "kinds")
    # distinct lengths with masks of their own, and the longest length: a few numbers
    lengths = kinds.select(F.size("codes").alias("n"))
    short = [r.n for r in lengths.where(F.col("n") <= max(SHORT_MASKS)).distinct().collect()]
    reach = lengths.agg(F.max("n")).first()[0] or 1
    masks = item_masks([n for n in short if n])
    hashed = materialise(item_seeds(kinds, masks), "seeds")
    regions = materialise(
        document_regions(docs, masks, bit_table(hashed), reach, id_col, text_col), "regions"
    )
    hits = regions.select(
        "doc_id", "text_key", "region", F.explode(F.arrays_zip("keys", "ats")).alias("hit")
    ).select("doc_id", "text_key", "region", F.col("hit.keys").alias("key"), F.col("hit.ats").alias("place"))
    aligned = (
        hits.join(hashed, "key")
        .select("doc_id", "text_key", "region", "item_key", (F.col("place") - F.col("at")).alias("shift"))
        .distinct()
    )
    place = ["doc_id", "text_key", "region"]
    same = F.lit(True)
    for c in place:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"r.{c}"))
    pairs = (
        aligned.alias("a")
        .join(regions.select(*place, "codes").distinct().alias("r"), same)
        .select(*(F.col(f"a.{c}") for c in place), "codes", "item_key", "shift")
        .join(kinds.withColumnRenamed("codes", "item_codes"), "item_key")
    )
    found = verify(pairs, min_match, identity).distinct()
    return found.join(words.select("item_key", "item_id").distinct(), "item_key").drop("item_key")


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, text_key, n_items, item_ids, first_word, end_word): documents that hold items."""
    return (
        overlaps(docs, benchmark, **options)
        .groupBy("doc_id", "text_key")
        .agg(
            F.count_distinct("item_id").alias("n_items"),
            F.array_sort(F.collect_set("item_id")).alias("item_ids"),
            F.min("first_word").alias("first_word"),
            F.max("end_word").alias("end_word"),
        )
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", **options):
    """The documents without benchmark passages, with all their columns."""
    bad = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    bad = materialise(bad.select("doc_id", "text_key"), "contaminated")
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col(id_col).cast("long").alias("own_id"),
        F.xxhash64(text_of(text_col)).alias("own_key"),
    )
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("text_key"))
    return rows.join(bad, same, "left_anti").select("row.*")
