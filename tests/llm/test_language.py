import zlib

import numpy as np
import pytest

from tabcord.llm import language
from tabcord.llm.linear import fit, margins

from .conftest import ODD


def test_held_out_rows_are_predicted(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    model = language.train(docs, per_language=60)
    assert model.families == ["germanic", "romance"]
    assert model.languages["germanic"] == ["de", "en"] and len(model.pairs["romance"]) == 1
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    want = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    held = [i for i, r in got.items() if r.held_out]
    right = np.mean([got[i].lang_pred == want[i] for i in held])
    assert len(held) > 250 and right > 0.95


def test_odd_table(odd, none, docs):
    model = language.train(docs, per_language=20)
    rows = language.identify(odd, model).collect()
    assert len(rows) == len(ODD)
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id in (1, 2, 3)} == {("und", 0.0)}
    assert language.identify(none, model).count() == 0
    nothing = language.train(none)
    assert {r.lang_pred for r in language.identify(odd, nothing).collect()} == {"und"}
    assert language.train(odd).predict(language.features(["hello there"]))[0][0] in ("en", "fr", "de")


def test_sample_is_bounded_and_leaves_out_held_rows(docs, spark):
    poisoned = docs.selectExpr(
        "doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 'zz' ELSE lang END AS lang"
    )
    model = language.train(poisoned, per_language=5, most=12)
    assert "zz" not in {c for v in model.languages.values() for c in v}


def test_a_repeated_id_gives_one_row_of_the_sample(docs, monkeypatch):
    sizes = []
    real = language.learn
    monkeypatch.setattr(language, "learn", lambda x, codes: sizes.append(len(codes)) or real(x, codes))
    language.train(docs, per_language=10)
    language.train(docs.unionAll(docs).unionAll(docs), per_language=10)
    language.train(docs.withColumn("doc_id", docs.doc_id - docs.doc_id), per_language=10)
    assert sizes[0] and sizes[2] <= docs.select("lang").distinct().count()
    assert sizes[1] <= sizes[0]


def test_unknown_codes_are_families():
    assert language.family_of("de") == "germanic" and language.family_of("pt-BR") == "romance"
    assert language.family_of("xx") == "xx"


@pytest.mark.parametrize("loss", ["logistic", "hinge"])
def test_linear_fit_separates(loss):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    sign = np.where(x @ np.array([1, -2, 0.5, 0, 1]) + 0.3 > 0, 1.0, -1.0)
    w = fit(x, sign, None, loss, 1e-4, 300)
    assert np.mean(np.sign(margins(x, w)) == sign) > 0.97


def test_only_letters_make_a_language(spark, docs):
    from tabcord.llm import language

    model = language.train(docs)
    rows = spark.createDataFrame([(1, "½ ² ¾ ① Ⅷ 42 _"), (2, "ª"), (3, "字")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(rows, model).collect()}
    assert got[1] == ("und", 0.0) and "und" not in (got[2][0], got[3][0])


def plain_prediction(model, text):
    """The hierarchy for one text: trigrams counted one by one, a dot product per machine."""
    raw = b" " + text.lower().encode("utf-8", "replace") + b" "
    kept = [c if 97 <= c <= 122 or c >= 128 else 0 for c in raw]
    counts = np.zeros(language.SIZE)
    for a, b, c in zip(kept, kept[1:], kept[2:]):
        if b:
            code = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) & 0xFFFFFFFF
            counts[((code * 0x27D4EB2F) & 0xFFFFFFFF) >> 21] += 1
    x = np.sqrt(counts)
    x = x / max(np.linalg.norm(x), 1e-9)
    by_family = [float(x @ w[:-1] + w[-1]) for w in model.family]
    family = model.families[int(np.argmax(by_family))]
    codes = model.languages[family]
    votes, total = [0] * len(codes), [0.0] * len(codes)
    for i, j, w in model.pairs[family]:
        m = float(x @ w[:-1] + w[-1])
        votes[i if m > 0 else j] += 1
        total[i], total[j] = total[i] + m, total[j] - m
    return max(range(len(codes)), key=lambda k: (votes[k], total[k], -k)), codes


def test_predictions_equal_plain_ones_over_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.train(docs, per_language=40)
    texts = {r.doc_id: r.text for r in docs.where("n_chars < 20000").collect()}
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    for i, text in texts.items():
        if not any(c.isalpha() for c in text or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        k, codes = plain_prediction(model, text)
        assert got[i].lang_pred == codes[k]


def test_the_first_of_a_language_are_among_the_likely_ones(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = spark.range(60_000).selectExpr(
        "id AS doc_id", "CASE WHEN id % 50 > 0 THEN 'en' WHEN id % 100 > 0 THEN 'fr' ELSE 'x' || id END AS lang"
    )
    mark = F.xxhash64("doc_id", "lang")
    order = Window.partitionBy("lang").orderBy(mark, "doc_id")
    first = lambda df: df.withColumn("p", F.row_number().over(order)).where("p <= 30")
    some = language.likely_first(rows, mark, 30)
    assert first(some).exceptAll(first(rows)).count() == first(rows).exceptAll(first(some)).count() == 0
    assert some.where("lang = 'en'").count() < 400
