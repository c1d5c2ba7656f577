import glob
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from tabcord.llm import token_files

from .conftest import ODD, vocabulary
from .test_bpe import TRICKY

PATH = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(vocabulary(PATH))


def test_words_encode_as_whole_texts(library, docs):
    texts = [
        *TRICKY,
        "<|startoftext|> a<|endoftext|>b",
        "ÀÉÎ ÿ ß İstanbul ΣΑΣ ﬁ ½ x² it's IT'S l'été rock'n'roll",
        "a\x1cb \x85 c d",
        "don't!!! '' 's ''s a'b`~^_{|} word's.",
        *[r.text for r in docs.limit(60).collect()],
    ]
    encoder = token_files.WordEncoder(vocabulary(PATH), remember=400)
    got = []
    for a, b in token_files.slabs(texts, 20_000):
        ids, n = encoder.encode(texts[a:b])
        ends = np.cumsum(n)
        got += [ids[x:y].tolist() for x, y in zip(ends - n, ends, strict=True)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert got == want


def test_new_pieces_share_calls_of_the_merge_model(library):
    encoder = token_files.WordEncoder(vocabulary(PATH))
    calls, merges = [], encoder.merges

    class Counted:
        def encode_batch_fast(self, found, **options):
            calls.append(len(found))
            return merges.encode_batch_fast(found, **options)

    words = [f"{a}{b}{c}ö" for a in "abcdefgh" for b in "stuvwxyz" for c in ("", "q", "é", "zz")]
    text = " ".join(words) + " Ä!! 42 it's"
    want = library.encode(text, add_special_tokens=False).ids
    for call, ending in ((10_000, encoder.ending), (100, encoder.ending), (100, None)):
        encoder.forget()
        encoder.merges, encoder.CALL, encoder.ending = Counted(), call, ending
        assert encoder.encode([text, "", text])[0].tolist() == want * 2
    assert encoder.plain and len(calls) == 1 + 3


def test_a_worker_keeps_its_encoder(library, tmp_path):
    own = tmp_path / "vocabulary.json"
    with open(vocabulary(PATH), "rb") as f:
        own.write_bytes(f.read())
    first = token_files.kept_encoder(str(own))
    first.encode(["words that stay known"])
    again = token_files.kept_encoder(str(own))
    assert again is first and b"known" in again.words
    own.write_bytes(own.read_bytes() + b"\n")
    assert token_files.kept_encoder(str(own)) is not first


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files_hold_all_ids_in_order(spark, docs, library, tmp_path, encoding):
    target = str(tmp_path / "tokens")
    token_files.write_tokens(
        docs, target, vocabulary(PATH), encoding=encoding, page_rows=20, row_group_bytes=200_000
    )
    got = token_files.digests(spark, target).orderBy("doc_id").collect()
    start = 0
    rows = docs.orderBy("doc_id").collect()
    assert len(got) == len(rows)
    for g, r in zip(got, rows, strict=True):
        ids = library.encode(r.text, add_special_tokens=False).ids + [1]
        assert (g.doc_id, g.start, g.n_tokens) == (r.doc_id, start, len(ids))
        assert g.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    last = None
    for name in sorted(glob.glob(f"{target}/part-*.parquet")):
        held = pq.ParquetFile(name)
        ids = held.read(["doc_id"]).column(0).to_pylist()
        assert ids == sorted(ids) and (last is None or not ids or ids[0] > last)
        last = ids[-1] if ids else last
        for g in range(held.metadata.num_row_groups):
            column = held.metadata.row_group(g).column(2)
            assert column.has_offset_index and column.has_column_index
            kinds = set(column.encodings)
            if encoding == "delta":
                assert "DELTA_BINARY_PACKED" in kinds
            else:
                assert kinds & {"RLE_DICTIONARY", "PLAIN_DICTIONARY"}


def test_metadata_is_read_without_tokens(spark, docs, tmp_path):
    target = str(tmp_path / "tokens")
    token_files.write_tokens(docs, target, vocabulary(PATH))
    some = token_files.read_tokens(spark, target).where("doc_id < 5").select("doc_id", "n_tokens")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1] and "PushedFilters: [IsNotNull(doc_id)" in plan
    assert some.count() == 5


def test_odd_table(spark, odd, none, library, tmp_path):
    target = str(tmp_path / "odd")
    token_files.write_tokens(odd, target, vocabulary(PATH))
    got = token_files.digests(spark, target).orderBy("start").collect()
    assert len(got) == len(ODD)
    assert got[0].doc_id is None and got[0].start == 0
    assert [r.doc_id for r in got[1:]] == sorted(r[0] for r in ODD if r[0] is not None)
    assert all(r.n_tokens == 1 for r in got if r.doc_id in (1, 2, 3))
    for a, b in zip(got, got[1:]):
        assert b.start == a.start + a.n_tokens
    empty = str(tmp_path / "none")
    token_files.write_tokens(none, empty, vocabulary(PATH))
    assert token_files.digests(spark, empty).count() == 0
    with pytest.raises(ValueError):
        token_files.write_tokens(odd, empty, vocabulary(PATH), encoding="plain")
