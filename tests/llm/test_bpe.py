import hashlib

import numpy as np
import pytest

from tabcord.llm import bpe

from .conftest import ODD, vocabulary

TRICKY = [
    "",
    " ",
    "  a",
    "a  b\n\n c \n",
    "it's we'll they've 'S x's",
    "<|endoftext|> hi<|endoftext|>there <|endoftext|>",
    "日本語 テキスト 123 ４５",
    "aaaaaaaaaaaaaaaa aaa aaaa\taaaaa",
    "é è é   x y　z",
    "\n lead",
    "trail  ",
    "emoji 👩‍👩‍👧 !!! ...??",
    "x" * 5000,
]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


def packed(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_texts_encode_and_decode_as_in_the_library(library, docs):
    texts = TRICKY + [r.text for r in docs.limit(60).collect()]
    vocab = bpe.Vocabulary(vocabulary("byte_bpe_50k.json"))
    encoder = bpe.Encoder(vocab, remember=500)
    got = []
    for _, ids, n in bpe.slabs(texts, encoder, limit=20_000):
        ends = np.cumsum(n)
        got += [ids[a:b].tolist() for a, b in zip(ends - n, ends, strict=True)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert got == want
    assert [bpe.decode(i, vocab) for i in got] == [
        library.decode(i, skip_special_tokens=False) for i in want
    ]


def test_pieces_merge_as_one_by_one():
    vocab = bpe.Vocabulary(vocabulary("byte_bpe_50k.json"))
    pieces = [b"abababab", b"aaaa", b"aaaaa", b"the", b"", b" the", b"mississippi", b"a"]
    rank = dict(zip(vocab.code.tolist(), vocab.rank.tolist(), strict=True))

    def one(piece):
        ids = vocab.first[list(piece)].tolist()
        while True:
            pairs = [rank.get(a * vocab.size + b, 10**9) for a, b in zip(ids, ids[1:])]
            if not pairs or min(pairs) == 10**9:
                return ids
            k = pairs.index(min(pairs))
            ids[k : k + 2] = [int(vocab.made[pairs[k]])]

    ids, counts = bpe.encode_pieces(pieces, vocab)
    ends = np.cumsum(counts)
    assert [ids[a:b].tolist() for a, b in zip(ends - counts, ends)] == [one(p) for p in pieces]


def test_odd_table_round_trip(odd, none, library):
    got = bpe.round_trip(odd, vocabulary("byte_bpe_50k.json")).collect()
    want = []
    for row in ODD:
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        want.append(
            (row[0], len(ids), packed(ids), hashlib.sha256((row[1] or "").encode()).hexdigest())
        )
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.round_trip(none, vocabulary("byte_bpe_50k.json")).count() == 0
    ids = bpe.encode_table(odd, vocabulary("byte_bpe_50k.json")).where("doc_id = 1").first().ids
    assert ids == []
