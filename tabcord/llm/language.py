"""Language of a text: family first, then one-versus-one support vector machines.

Features are the square roots of byte trigram counts of the lower-cased
letters of the whole text, hashed to :data:`SIZE` columns and scaled to unit
length.  A linear model per language family picks the family; within it, a
linear support vector machine for every pair of languages votes, and the
language with most votes (then the larger summed margin, then the smaller
code) wins.

Models are fitted on a bounded sample of the labelled rows: at most
``per_language`` documents of a language and ``most`` in all, the first by a
hash of the id.  Null or empty texts and texts without a letter are "und" with
score 0 and never train; a null language never trains.  If nothing can be
learned, every text is "und".  Repeated rows get equal results; an empty table
gives an empty result.  Long texts are read whole, a few MB at a time.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import by_batch, materialise, text_of, texts
from .linear import fit, margins, sigmoid
from .textbytes import blocks

SIZE = 2048

#: Languages by family; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "fo", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu", "se"),
    "turkic": ("tr", "az", "kk", "ky", "uz", "tk", "tt"),
    "indic": ("hi", "ur", "bn", "pa", "mr", "gu", "ne", "si"),
    "celtic": ("ga", "gd", "cy", "br"),
    "baltic": ("lt", "lv"),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

#: A letter as training sees it; fractions, circled digits and numerals are none.
_LETTER = regex.compile(r"\p{L}")
_KEEP = np.zeros(256, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def family_of(code: str) -> str:
    return _FAMILY_OF.get(code.lower().split("-")[0], code)


def features(found: list[str]) -> np.ndarray:
    """Unit-length trigram vectors; a text without trigrams is all zero."""
    raw = [b" " + t.lower().encode("utf-8", "replace") + b" " for t in found]
    out = np.zeros((len(raw), SIZE), np.float32)
    for a, b in blocks(raw):
        data = np.frombuffer(b"".join(raw[a:b]), np.uint8)
        sizes = np.fromiter(map(len, raw[a:b]), np.int64, b - a)
        kept = _KEEP[data].astype(np.uint32)
        owner = np.repeat(np.arange(b - a), sizes)
        code = kept[:-2] * np.uint32(0x9E3779B1) + kept[1:-1] * np.uint32(0x85EBCA77)
        code = (code + kept[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        code >>= np.uint32(32 - 11)
        # a trigram has a letter in the middle, and so never spans two texts
        inside = kept[1:-1] > 0
        cell = owner[1:-1][inside] * SIZE + code[inside].astype(np.int64)
        counts = np.bincount(cell, minlength=(b - a) * SIZE).reshape(-1, SIZE)
        out[a:b] = np.sqrt(counts)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-9)


@dataclass
class Model:
    """Weights per family, and per pair of languages within a family."""

    families: list[str]
    family: np.ndarray  # (family, SIZE + 1)
    languages: dict[str, list[str]]
    pairs: dict[str, list[tuple[int, int, np.ndarray]]]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score in 0..1) per row."""
        names = np.full(len(x), "und", object)
        if not self.families:
            return names, np.zeros(len(x))
        raw = np.column_stack([margins(x, w) for w in self.family])
        best = np.argmax(raw, axis=1)
        if raw.shape[1] > 1:
            ordered = np.sort(raw, axis=1)
            score = sigmoid(2.0 * (ordered[:, -1] - ordered[:, -2]))
        else:
            score = np.ones(len(x))
        for k, family in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            codes = self.languages[family]
            if not len(rows):
                continue
            votes = np.zeros((len(rows), len(codes)))
            total = np.zeros((len(rows), len(codes)))
            least = np.full((len(rows), len(codes)), np.inf)
            for i, j, w in self.pairs[family]:
                m = margins(x[rows], w)
                votes[:, i] += m > 0
                votes[:, j] += m <= 0
                total[:, i] += m
                total[:, j] -= m
                least[:, i] = np.minimum(least[:, i], m)
                least[:, j] = np.minimum(least[:, j], -m)
            rank = votes + sigmoid(total) * 0.5
            won = np.argmax(rank, axis=1)
            names[rows] = np.array(codes, object)[won]
            if len(codes) > 1:
                score[rows] *= sigmoid(2.0 * least[np.arange(len(rows)), won])
        return names, score


def learn(x: np.ndarray, codes: list[str]) -> Model:
    """Fit the hierarchy; rows of one class weigh together as much as those of another."""
    family = np.array([family_of(c) for c in codes], object)
    lang = np.array(codes, object)
    families = sorted(set(family.tolist()))

    def machine(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        sign = np.where(first, 1.0, -1.0)
        n1, n0 = max(1, int(first.sum())), max(1, int((~first).sum()))
        weight = np.where(first, 0.5 / n1, 0.5 / n0)
        return fit(x[rows], sign, weight, "hinge", 1e-4, 200)

    every = np.arange(len(codes))
    by_family = [machine(every, family == f) for f in families]
    languages, pairs = {}, {}
    for f in families:
        own = sorted(set(lang[family == f].tolist()))
        languages[f], pairs[f] = own, []
        for i, j in itertools.combinations(range(len(own)), 2):
            rows = np.flatnonzero((lang == own[i]) | (lang == own[j]))
            pairs[f].append((i, j, machine(rows, lang[rows] == own[i])))
    return Model(families, np.array(by_family), languages, pairs)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text, modulo 3, is 1."""
    key = F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")
    return F.crc32(key) % 3 == 1


#: Languages whose sizes are sent to every task; more are found by a join of both tables.
SENT = 10_000


def likely_first(rows: DataFrame, mark: Column, most: int) -> DataFrame:
    """Rows whose hash is so small that they may be among the ``most`` first of their language.

    A hash is even, so a language of n rows needs only the share 8 * most / n of
    the range of hashes: what is ranked by language stays a few times ``most``,
    however many tasks read a language that most documents have.
    """
    sizes = materialise(
        rows.groupBy(F.col("lang").alias("of")).agg(F.count(F.lit(1)).alias("n")), "languages"
    )
    if sizes.count() <= SENT:
        sizes = F.broadcast(sizes)
    place = mark.cast("double") / F.lit(2.0**64) + 0.5
    return (
        rows.join(sizes, F.col("lang") == F.col("of"))
        .where(place * F.col("n") <= 8.0 * most)
        .select("doc_id", "lang")
    )


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 400,
    most: int = 4000,
) -> Model:
    """Fit on a bounded sample of the rows that are not held out."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(lang_col).cast("string").alias("lang"),
        text_of(text_col).alias("text"),
    ).where(~held_out(F.col(id_col)) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    mark = F.xxhash64("doc_id", "lang")
    order = Window.partitionBy("lang").orderBy(mark, "doc_id")
    usable = rows.where(F.length("text") > 0).select("doc_id", "lang")
    ids = (
        likely_first(usable, mark, per_language)
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= per_language)
        .orderBy("place", "lang")
        .limit(most)
        .select("doc_id", "lang")
        .distinct()
    )
    ids = materialise(ids, "sample")

    def step(batch: pa.RecordBatch) -> pa.Table:
        x = features(texts(batch))
        packed = pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())
        return pa.Table.from_arrays(
            [batch.column("doc_id"), batch.column("lang"), packed], ["doc_id", "lang", "x"]
        )

    # one row of each id and language, so the sample has at most ``most`` rows
    sample = rows.where(F.col("text").rlike(r"\p{L}")).join(F.broadcast(ids), ["doc_id", "lang"])
    one = F.min(F.struct(F.xxhash64("text").alias("mark"), "text"))
    sample = sample.groupBy("doc_id", "lang").agg(one.alias("one")).select("doc_id", "lang", "one.text")
    held = by_batch(sample, step, "doc_id long, lang string, x binary")
    held = held.orderBy("doc_id", "lang").toArrow()
    codes = held.column("lang").to_pylist()
    if not codes:
        return Model([], np.zeros((0, SIZE + 1)), {}, {})
    x = np.frombuffer(b"".join(held.column("x").to_pylist()), np.float32).reshape(-1, SIZE)
    return learn(x, codes)


def identify(
    docs: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, from its text alone."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = texts(batch)
        names, scores = [], []
        for a in range(0, len(found), 512):
            part = found[a : a + 512]
            lettered = np.array([bool(_LETTER.search(t)) for t in part])
            lang, score = model.predict(features(part))
            lang[~lettered], score[~lettered] = "und", 0.0
            names += lang.tolist()
            scores += score.tolist()
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(names), pa.array(scores)],
            ["doc_id", "held_out", "lang_pred", "score"],
        )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        held_out(F.col(id_col)).alias("held_out"),
        text_of(text_col).alias("text"),
    )
    return by_batch(rows, step, "doc_id long, held_out boolean, lang_pred string, score double")
