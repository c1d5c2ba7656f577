"""Very long texts, and tables whose other columns have clashing names."""

import pytest
from pyspark.sql import functions as F

from tabcord.llm import (
    bpe,
    chat,
    cotraining,
    decontaminate,
    forest,
    language,
    lexical,
    pseudonyms,
    sharding,
    simhash,
    token_files,
)

from .conftest import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PHRASE = "the quick brown fox jumps over the lazy dog near the river bank"


@pytest.fixture(scope="module")
def long(spark):
    rows = [
        (1, "word " * 300_000 + PHRASE, "en", "a", 1_500_000),
        (2, "x" * 1_500_000, "en", "a", 1_500_000),
        (3, " ".join(f"w{i}" for i in range(200_000)), "fr", "b", 1_300_000),
        (4, "ab\n" * 400_000, "fr", "b", 1_200_000),
        (5, PHRASE, "en", "a", len(PHRASE)),
        (6, "un petit texte en langue étrangère", "fr", "b", 34),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_every_operator_reads_long_texts_whole(spark, long, frame):
    items = frame("item_id long, text string", (1, PHRASE))
    assert ids(decontaminate.contaminated(long, items)) == [1, 5]
    found = {r.doc_id: r.score for r in lexical.search(long, items).collect()}
    assert set(found) == {1, 5} and found[5] > found[1]
    counts = {r.doc_id: r for r in forest.statistics(long).collect()}
    assert counts[1].n_words == 300_000 + 13 and counts[4].n_dup_lines == 399_999
    assert counts[2].word_chars == 1_500_000 and counts[3].n_repeat_words == 0
    got = {r.doc_id: r for r in simhash.near_duplicates(long).collect()}
    assert len({r.component_id for r in got.values()}) == 6
    assert ids(simhash.keep_first(long)) == [1, 2, 3, 4, 5, 6]
    model = language.train(long)
    assert ids(language.identify(long, model)) == [1, 2, 3, 4, 5, 6]
    moved = pseudonyms.replace_text(long, b"a key for the tests only")
    assert moved.exceptAll(long).count() == 0
    shards = sharding.assign(long, sharding.layout(24)).collect()
    assert {r.doc_id: r.size for r in shards}[2] == 1_500_008


def test_tokenizers_read_long_texts_whole(spark, long, tmp_path):
    trip = {r.doc_id: r for r in bpe.round_trip(long, vocabulary("byte_bpe_50k.json")).collect()}
    import hashlib

    for r in long.collect():
        assert trip[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    token_files.write_tokens(long, f"{tmp_path}/t", vocabulary("word_bpe_49k.json"))
    held = {r.doc_id: r.n_tokens for r in token_files.digests(spark, f"{tmp_path}/t").collect()}
    assert held[1] > 300_000 and held[5] < 30


def test_long_turns(frame):
    rows = [(1, 0, "user", "<|" * 500_000), (1, 1, "assistant", "y" * 1_000_000)]
    r = chat.digests(chat.format_chats(frame("conv_id long, turn long, role string, text string", *rows))).first()
    assert (r.loss_chars, r.n_turns) == (1_000_000, 2) and r.formatted_chars > 2_500_000


def test_labels_with_clashing_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clash = ("text", "id", "good", "row", "score", "lang", "n_words", "kept", "label")
    wide = labels.withColumns({c: F.lit(f"own {c}") for c in clash})
    key = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
    assert key(cotraining.classify(docs, wide)) == key(cotraining.classify(docs, labels))
    assert key(forest.verdicts(docs, wide)) == key(forest.verdicts(docs, labels))
