"""Token ids as Parquet list columns in document order.

Documents are range-partitioned and sorted by id, tokenized, and written as
one Parquet file per range: the ids as a list column beside small metadata
columns.  Ids are dictionary encoded, or delta encoded with
``encoding="delta"``; row groups and pages have set sizes and pages an index,
so a reader can fetch a few documents, or only the metadata, without the rest.

The tokenizers library does the encoding.  Its pre-tokenizer never joins text
across ASCII white space, so a text is encoded word by word and a worker
remembers words from task to task, up to a bound.  For vocabularies of the plain form (NFC,
lower case, runs of letters apart from the rest) words of ordinary Latin
letters with trailing punctuation go straight to the library's merge model,
which knows the same piece, thousands of pieces a call; every other word passes
the whole library.

Null and empty texts have only the end id.  Rows of null ids come first; ties
in id are ordered by text.  Repeated rows are written repeatedly.  Long texts
are encoded whole, a slab at a time.  An empty table gives an empty file set and
result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import json
import operator
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .frames import text_of, texts
from .textbytes import Numbers, spread

_ID = operator.attrgetter("id")

SCHEMA = "doc_id long, n_tokens long, ids array<int>"

#: Letters whose lower case and composed form are one character each, in any context.
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Marks that make one piece where they follow letters; an apostrophe can begin another.
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
#: The two normalizer and pre-tokenizer rules for which the short way holds.
_PLAIN_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all lists in one array, and the length of each list."""
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = itertools.chain.from_iterable(lists)
    return np.fromiter(flat, np.int32, int(counts.sum())), counts


class WordEncoder:
    """Ids of texts, one library call per new word."""

    #: Pieces that one call of the merge model gets.
    CALL = 10_000

    def __init__(self, path: str, remember: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark spreads the work
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = self.tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        self.remember = remember

        def spec(part) -> dict:
            return json.loads(part.__getstate__()) if part is not None else {}

        steps = spec(tokenizer.normalizer).get("normalizers", [])
        cuts = spec(tokenizer.pre_tokenizer).get("pretokenizers", [{}])
        tokens = tokenizer.get_added_tokens_decoder().values()
        added = any(not t.content.startswith("<") for t in tokens)
        self.plain = (
            [s["type"] for s in steps] == _PLAIN_NORMALIZERS
            and cuts[0].get("pattern") == {"Regex": _PLAIN_PATTERN}
            and not added
        )
        #: The vocabulary's character for each byte; a space parts the pieces of a call.
        self.symbols = dict(enumerate(byte_symbols()))
        self.spaced = self.symbols | {32: " "}
        self.merges = Tokenizer(tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        #: Which ids end a piece, if the vocabulary marks them.
        suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
        self.ending = None
        if suffix:
            vocab = tokenizer.get_vocab(with_added_tokens=False)
            self.ending = np.zeros(max(vocab.values()) + 1, bool)
            self.ending[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        #: Words by number, and their ids.
        self.words = Numbers()
        self.ids = np.empty(0, np.int32)
        self.starts = np.empty(0, np.int64)
        self.counts = np.empty(0, np.int64)
        #: Pieces by number, bytes for the merge model and texts for the whole library; their ids.
        self.pieces = Numbers()
        self.piece_ids = np.empty(0, np.int32)
        self.piece_starts = np.empty(0, np.int64)
        self.piece_counts = np.empty(0, np.int64)

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain pieces in one array, and the number of ids of each."""
        if self.ending is not None:
            line = b" ".join(pieces).decode("latin-1").translate(self.spaced)
            (found,) = self.merges.encode_batch_fast([line], add_special_tokens=False)
            ids = np.array(found.ids, np.int32)
            ends = np.flatnonzero(self.ending[ids])
            if len(ends) == len(pieces) and ends[-1] == len(ids) - 1:
                return ids, np.diff(ends, prepend=-1)
        # a vocabulary that does not mark or not know some ends
        model, symbols = self.tokenizer.model, self.symbols
        lists = [
            list(map(_ID, model.tokenize(p.decode("latin-1").translate(symbols)))) for p in pieces
        ]
        return _flat(lists)

    def learn(self, words: list[bytes]) -> None:
        """Cut new words into pieces and have the library encode those that are new."""
        pieces = self.pieces
        head, tail = [], []
        for w in words:
            core = w.rstrip(_MARKS)
            if core.isalpha():
                piece = core.lower()
            else:
                text = core.decode("utf-8", "replace")
                piece = text.lower().encode() if _LATIN.fullmatch(text) else None
            if piece is None or not self.plain:
                head.append(pieces[w.decode("utf-8", "replace")])
                tail.append(-1)
            else:
                head.append(pieces[piece])
                tail.append(pieces[w[len(core) :]] if len(core) < len(w) else -1)
        new, pieces.new = pieces.new, []
        plain = [i for i, p in enumerate(new) if isinstance(p, bytes)]
        other = [i for i, p in enumerate(new) if isinstance(p, str)]
        batch = self.tokenizer.encode_batch([new[i] for i in other], add_special_tokens=False)
        parts = [_flat([e.ids for e in batch])]
        for i in range(0, len(plain), self.CALL):
            parts.append(self.merged([new[k] for k in plain[i : i + self.CALL]]))
        counts = np.concatenate([n for _, n in parts])
        own = np.empty((2, len(new)), np.int64)
        own[:, [*other, *plain]] = len(self.piece_ids) + np.cumsum(counts) - counts, counts
        self.piece_ids = np.concatenate([self.piece_ids, *(ids for ids, _ in parts)])
        self.piece_starts = np.concatenate([self.piece_starts, own[0]])
        self.piece_counts = np.concatenate([self.piece_counts, own[1]])

        piece = np.array([head, tail], np.int32).T.ravel()
        piece = piece[piece >= 0]
        both = 1 + (np.array(tail, np.int32) >= 0)
        sizes = self.piece_counts[piece]
        counts = np.add.reduceat(sizes, np.cumsum(both) - both)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        ids = self.piece_ids[spread(self.piece_starts[piece], sizes)]
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each text."""
        if len(self.words) > self.remember:
            self.forget()
        lists = [t.encode("utf-8", "replace").split() for t in found]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        at = np.fromiter(
            map(self.words.__getitem__, itertools.chain.from_iterable(lists)),
            np.int32,
            int(sizes.sum()),
        )
        if self.words.new:
            self.learn(self.words.new)
            self.words.new = []
        counts = self.counts[at]
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(sizes)]
        return self.ids[spread(self.starts[at], counts)], np.diff(ends, prepend=0)


def kept_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, with the words it knows from the tasks before.

    What travels by value is made anew in every task, so the library's module holds it.
    """
    import tokenizers

    held = tokenizers.__dict__.setdefault("_word_encoders", {})
    state = os.stat(path)
    key = (path, state.st_mtime_ns, state.st_size)
    if key not in held:
        held.clear()
        held[key] = WordEncoder(path)
    return held[key]


def slabs(found: list[str], limit: int = 1 << 21):
    """Ranges of rows of about ``limit`` characters."""
    first, held = 0, 0
    for i, text in enumerate(found):
        if held and held + len(text) > limit:
            yield first, i
            first, held = i, 0
        held += len(text)
    if first < len(found):
        yield first, len(found)


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, ids) of (doc_id, text), row by row in the given order."""

    def run(batches):
        encoder = kept_encoder(path)
        for batch in batches:
            found = texts(batch)
            for a, b in slabs(found):
                ids, n = encoder.encode(found[a:b])
                ends = np.cumsum(n)
                full = np.insert(ids, ends, end_id).astype(np.int32)
                offsets = np.concatenate([[0], ends + np.arange(1, b - a + 1)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(n + 1),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(full)),
                    ],
                    ["doc_id", "n_tokens", "ids"],
                )

    return docs.mapInArrow(run, SCHEMA)


def write_tokens(
    docs: DataFrame,
    target: str,
    tokenizer: str,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    encoding: str = "dictionary",
    row_group_bytes: int = 16 << 20,
    page_rows: int = 500,
    compression: str = "zstd",
) -> None:
    """Write token files below ``target``, in ascending id order from file to file and row to row."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is 'dictionary' or 'delta'")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    writer = (
        tokenize(ordered.select("doc_id", "text"), tokenizer, end_id)
        .write.mode("overwrite")
        .option("compression", compression)
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
    )
    if encoding == "delta":
        writer = writer.option("parquet.enable.dictionary", "false").option(
            "parquet.writer.version", "PARQUET_2_0"
        )
    writer.parquet(target)


def read_tokens(spark: SparkSession, target: str) -> DataFrame:
    """The stored documents; select columns and filter by id to read only what is needed."""
    return spark.read.schema(SCHEMA).parquet(target)


def file_order() -> list[Column]:
    """The order of files that one sorted write made: by the numbers in their names.

    Names sort by text only up to 99,999 parts.
    """
    part, piece = (
        F.regexp_extract("file", r"^part-(\d+).*?(?:-c(\d+))?\.", i).try_cast("long")
        for i in (1, 2)
    )
    return [part.asc_nulls_first(), piece.asc_nulls_first(), F.col("file")]


def digests(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read from token files."""

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            flat = ids.flatten().to_numpy().astype("<u4", copy=False)
            n = np.diff(ids.offsets.to_numpy())
            ends = np.cumsum(n)
            crc = [
                zlib.crc32(flat[a:b].tobytes())
                for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("file"),
                    batch.column("row"),
                    pa.array(n.astype(np.int64)),
                    pa.array(crc, pa.int64()),
                ],
                ["doc_id", "file", "row", "n_tokens", "ids_crc32"],
            )

    # numbers in file names ascend with the id range, rows with the id
    rows = read_tokens(spark, target).select(
        "doc_id",
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        "ids",
    )
    found = rows.mapInArrow(
        run, "doc_id long, file string, row long, n_tokens long, ids_crc32 long"
    )
    in_file = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    lengths = read_tokens(spark, target).groupBy(F.col("_metadata.file_name").alias("file"))
    files = lengths.agg(F.sum("n_tokens").alias("held"))  # one row per file
    before = Window.orderBy(*file_order()).rowsBetween(Window.unboundedPreceding, -1)
    firsts = files.select("file", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("first"))
    return (
        found.withColumn("inside", F.coalesce(F.sum("n_tokens").over(in_file), F.lit(0)))
        .join(firsts, "file")
        .select(
            "doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
        )
    )
