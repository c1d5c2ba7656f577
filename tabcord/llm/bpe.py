"""Byte-level BPE by a pair occurrence index, and decoding.

Texts are cut into pieces by the vocabulary's own rule; a piece is encoded
once per slab of rows.  All pieces of a slab lie in one symbol array with links
to the next and previous symbol.  An index maps every mergeable pair to all
its positions in the slab.  The active ranks are taken in ascending order; a
rank is applied to all its positions at once, and only the lists of the pairs
that this creates are updated.

The vocabulary file is a parameter; its rows are never copied into the
repository.  Null texts count as empty, and empty texts have no ids.  Rows of
null ids and repeated rows are encoded like others; an empty table gives an
empty result.  Special tokens that occur in a text get their own id, as the
file's added tokens say.  Long texts are encoded whole, in slabs of bounded size
with their neighbours; of equal pairs that overlap the first is merged.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import text_of, texts
from .textbytes import Numbers, spread

#: Fixed value: the public pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merges of a tokenizer file as arrays: pair code, rank and new symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        chars = byte_symbols()
        self.first = np.array([vocab[c] for c in chars], np.int64)
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        code = left * self.size + right
        order = np.argsort(code, kind="stable")
        self.code, self.rank = code[order], order
        self.left, self.right, self.made = left, right, made
        byte_of = {c: b for b, c in enumerate(chars)}
        self.bytes_of = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it does not merge."""
        code = left * self.size + right
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.rank[at], -1)


class PairIndex:
    """Positions of every mergeable pair, by rank."""

    def __init__(self):
        self.at: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []

    def add(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        held = ranks >= 0
        ranks, positions = ranks[held], positions[held]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cuts.tolist()]
        for rank, a, b in zip(
            ranks[starts].tolist(), starts, [*starts[1:], len(ranks)], strict=True
        ):
            if rank not in self.at:
                self.at[rank] = []
                heapq.heappush(self.active, rank)
            self.at[rank].append(positions[a:b])

    def pop(self) -> tuple[int, np.ndarray]:
        rank = heapq.heappop(self.active)
        lists = self.at.pop(rank)
        return rank, lists[0] if len(lists) == 1 else np.concatenate(lists)


def _without_overlaps(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of ascending positions, the ones left when merges go from left to right."""
    kept, blocked = [], -1
    for p in at.tolist():
        if p != blocked:
            kept.append(p)
            blocked = int(after[p])
    return np.array(kept, np.int64)


def encode_pieces(pieces: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces in one array, and the number of ids of each piece."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    symbol = vocab.first[np.frombuffer(b"".join(pieces), np.uint8)]
    n = len(symbol)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    ends = np.cumsum(sizes)
    ends = ends[sizes > 0]
    after[ends - 1] = -1
    if n:
        before[np.concatenate([[0], ends[:-1]])] = -1
    index = PairIndex()
    head = np.flatnonzero(after >= 0)
    index.add(vocab.ranks(symbol[head], symbol[after[head]]), head)
    while index.active:
        rank, at = index.pop()
        a, b = vocab.left[rank], vocab.right[rank]
        at = at[(symbol[at] == a) & (after[at] >= 0)]
        at = at[symbol[after[at]] == b]
        if a == b:
            at = _without_overlaps(np.unique(at), after)
        if not len(at):
            continue
        gone = after[at]
        behind = after[gone]
        symbol[at], symbol[gone] = vocab.made[rank], -1
        after[at], after[gone] = behind, -1
        linked = behind >= 0
        before[behind[linked]] = at[linked]
        ahead = before[at]
        left = np.concatenate([ahead[ahead >= 0], at[linked]])
        if len(left):
            left = np.unique(left) if len(left) > 1 else left
            index.add(vocab.ranks(symbol[left], symbol[after[left]]), left)
    alive = symbol >= 0
    counts = np.zeros(len(pieces), np.int64)
    if n:
        counts[sizes > 0] = np.add.reduceat(alive.astype(np.int64), ends - sizes[sizes > 0])
    return symbol[alive], counts


class Encoder:
    """Encodes slabs of texts; remembers chunks of text, up to a bound."""

    def __init__(self, vocab: Vocabulary, remember: int = 400_000):
        self.vocab, self.remember = vocab, remember
        self.piece = regex.compile(PATTERN)
        self.special = (
            regex.compile("(" + "|".join(map(regex.escape, vocab.added)) + ")")
            if vocab.added
            else None
        )
        #: White space of several characters can span a cut before a space; such texts are cut by the pattern.
        self.uneven = regex.compile(r" \s|\s ")
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.ids = np.empty(0, np.int64)
        self.starts = np.empty(0, np.int64)
        self.counts = np.empty(0, np.int64)

    def chunks(self, text: str) -> list[str]:
        """Cut a text where the pattern surely cuts too: before a lone space."""
        if self.special is not None and "<" in text and self.special.search(text):
            out = []
            for part in self.special.split(text):
                out += [part] if part in self.vocab.added else self.plain_chunks(part)
            return out
        return self.plain_chunks(text)

    def plain_chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if self.uneven.search(text):
            return self.piece.findall(text)
        first, *rest = text.split(" ")
        out = [" " + r for r in rest]
        return [first, *out] if first else out

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks that are new, all of them in one pair index."""
        pieces: dict[bytes, int] = {}
        cut: list[list[int]] = []
        for c in chunks:
            if c in self.vocab.added:
                cut.append([-1 - self.vocab.added[c]])
                continue
            cut.append(
                [
                    pieces.setdefault(p.encode("utf-8", "replace"), len(pieces))
                    for p in self.piece.findall(c)
                ]
            )
        ids, counts = encode_pieces(list(pieces), self.vocab)
        starts = np.cumsum(counts) - counts
        flat = np.fromiter(itertools.chain.from_iterable(cut), np.int64)
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        special = flat < 0
        ids = np.concatenate([ids, -1 - flat[special]])
        at, n = np.empty(len(flat), np.int64), np.ones(len(flat), np.int64)
        at[~special], n[~special] = starts[flat[~special]], counts[flat[~special]]
        at[special] = np.arange(int(special.sum())) + int(counts.sum())
        own = ids[spread(at, n)]
        owner = np.repeat(np.arange(len(cut)), sizes)
        total = np.bincount(owner, weights=n, minlength=len(cut)).astype(np.int64)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(total) - total])
        self.counts = np.concatenate([self.counts, total])
        self.ids = np.concatenate([self.ids, own])

    def encode(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each text."""
        if len(self.known) > self.remember:
            self.forget()
        lists = [self.chunks(t) for t in found]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        at = np.fromiter(
            map(self.known.__getitem__, itertools.chain.from_iterable(lists)),
            np.int64,
            int(sizes.sum()),
        )
        if self.known.new:
            self.learn(self.known.new)
            self.known.new = []
        counts = self.counts[at]
        ids = self.ids[spread(self.starts[at], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(sizes)]
        return ids, np.diff(ends, prepend=0)


def decode(ids: list[int], vocab: Vocabulary) -> str:
    """The text of ids; bytes that are no UTF-8 become replacement characters."""
    return b"".join(map(vocab.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def encode_table(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, ids): token ids of every whole text."""

    def run(batches):
        vocab = Vocabulary(path)
        encoder = Encoder(vocab)
        for batch in batches:
            for first, ids, n in slabs(texts(batch), encoder):
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(n)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))),
                    ],
                    ["doc_id", "ids"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def slabs(found: list[str], encoder: Encoder, limit: int = 1 << 22):
    """Encode texts in slabs of about ``limit`` characters: (first row, ids, counts)."""
    first, held = 0, 0
    for i in range(len(found) + 1):
        if i == len(found) or (held and held + len(found[i]) > limit):
            if i > first:
                yield first, *encoder.encode(found[first:i])
            first, held = i, 0
        if i < len(found):
            held += len(found[i])


def round_trip(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids again."""

    def run(batches):
        vocab = Vocabulary(path)
        encoder = Encoder(vocab)
        for batch in batches:
            for first, ids, n in slabs(texts(batch), encoder):
                ends = np.cumsum(n)
                id_hash, text_hash = [], []
                packed = ids.astype("<u4")
                for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
                    id_hash.append(hashlib.sha256(packed[a:b].tobytes()).hexdigest())
                    back = decode(ids[a:b].tolist(), vocab).encode("utf-8")
                    text_hash.append(hashlib.sha256(back).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(n)),
                        pa.array(n),
                        pa.array(id_hash),
                        pa.array(text_hash),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
