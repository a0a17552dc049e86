"""Token ids of documents in shard files in the order of their ids, each file a wavelet matrix (`wavelet`), and what is read back from the files.

Texts are encoded where they lie: a batch is cut into pieces that the tokenizer itself would part (runs of letters, of other signs, single digits, over ASCII and Latin letters
of two bytes), each distinct piece is encoded once by the tokenizer and kept for later batches, and chunks that hold anything else go to it whole. That gives the ids of the whole
text, as the tokenizer parts at white space and these classes before it merges; tests hold it against whole texts. Pieces are told apart by 64-bit hashes and looked up by whole
arrays. New ones are in small letters and parted by then, so they go to the tokenizer's model without its normalizer and its pattern. Encoded documents are written, ranged by id and sorted; each task
writes files of some SHARD ids, under names of its own, so that a repeated task leaves no half file in use: only files named by the returned rows count.
Starts are sums of shard sizes, by part and within parts.

Null texts are empty and have the end id only. Null ids come first. Rows that share an id go by a hash of their ids, then by these; equal rows stand side by side.
A document is never split, so a file may grow by one document beyond SHARD. Other columns are ignored; an empty table gives no file and no row.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm import textops as T
from cairn.llm.common import staged, table
from cairn.llm.wavelet import Wavelet, build
from cairn.sources.staging import fresh_path

VOCABULARY, END, SHARD = "word_bpe_49k.json", 2, 1 << 22
#: pieces that a worker keeps at most in each of two generations, and the longest that it keeps
KEPT, KEPT_BYTES = 1 << 18, 64
#: bytes of text that are cut into pieces at once
BLOCK = 4 << 20
ENCODED = "doc_id long, n_tokens long, ids binary"
FILES = "part int, no int, path string, n_docs long, n_tokens long, n_bytes long"

_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_CLASS = np.full(256, _ODD, dtype=np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[[0x20, 9, 10, 13]] = _SPACE
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[[0x27, 0x7C]] = _ODD  # contractions, and the bars of special tokens


class Pieces:
    """Token ids of pieces by the hashes of these: an open-addressing table that grows, asked and filled by whole arrays."""

    def __init__(self):
        self._held, self._slots = np.zeros(1 << 10, np.uint64), np.full(1 << 10, -1, np.int32)
        self._keys, self._begin, self._size, self._ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self._rows = self._used = 0

    def __len__(self) -> int:
        return self._rows

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(self._slots).bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        at = self._home(keys)
        row = self._slots[at]
        wrong = np.flatnonzero((row >= 0) & (self._held[at] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self._slots) - 1)
            row[wrong] = self._slots[at[wrong]]
            wrong = wrong[(row[wrong] >= 0) & (self._held[at[wrong]] != keys[wrong])]
        return row

    def _place(self, left: np.ndarray) -> None:
        at = self._home(self._keys[left])
        while len(left):
            free = self._slots[at] < 0
            self._slots[at[free]] = left[free]  # of rows that want one slot the last stays
            placed = self._slots[at] == left
            self._held[at[placed]] = self._keys[left[placed]]
            left, at = left[~placed], (at[~placed] + 1) & (len(self._slots) - 1)

    def add(self, keys: np.ndarray, size: np.ndarray, ids: np.ndarray, kept: int) -> None:
        """Distinct keys that are not held, with the ids of each laid end to end; the rows beyond the first `kept` can be read until the next call only, and are not found."""
        old, n, used = self._rows, self._rows + len(keys), self._used + len(ids)
        if n > len(self._begin):
            self._keys, self._begin, self._size = (np.concatenate((x[:old], np.zeros(n - old + n // 4, x.dtype))) for x in (self._keys, self._begin, self._size))
        if used > len(self._ids):
            self._ids = np.concatenate((self._ids[: self._used], np.zeros(len(ids) + used // 4, np.uint32)))
        ends = self._used + np.cumsum(size)
        self._keys[old:n], self._begin[old:n], self._size[old:n], self._ids[self._used : used] = keys, ends - size, size, ids
        self._rows, self._used = old + kept, int(ends[kept - 1]) if kept else self._used
        if 2 * self._rows > len(self._slots):
            room = 1 << (3 * self._rows).bit_length()
            self._held, self._slots, old = np.zeros(room, np.uint64), np.full(room, -1, np.int32), 0
        self._place(np.arange(old, self._rows, dtype=np.int32))

    def ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each row has, and these laid end to end."""
        size = self._size[rows].astype(np.int64)
        return size, self._ids[_runs(self._begin[rows], size)]


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places from each begin on, as many as size says."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Token ids of whole texts under a tokenizer that parts at white space, letters, digits and signs, writes bytes as letters, and marks the end of each part."""

    def __init__(self, vocabulary: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_buffer(vocabulary)
        self._parted = Tokenizer(self._tokenizer.model)
        self._parted.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self._tokenizer.get_vocab()
        self.size = max(vocab.values()) + 1
        self._ends = np.zeros(self.size, dtype=bool)
        self._ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._young, self._old = Pieces(), Pieces()

    def _each(self, body: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece body[a:b] has, and these laid end to end."""
        pieces = [body[x:y].tobytes().decode() for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        ids = [e.ids for e in self._tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(chain.from_iterable(ids), np.uint32)

    def _plain(self, body: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pieces that are one part each, with a byte after each in body: encoded in one go and parted at the marked ends."""
        if not len(a):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        text = body[_runs(a, b - a + 1)]
        text[np.cumsum(b - a + 1) - 1] = 0x20
        ids = np.array(self._parted.encode_batch_fast([text.tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self._ends[ids]) + 1
        if len(ends) != len(a) or ends[-1] != len(ids):
            return self._each(body, a, b)
        return np.diff(ends, prepend=0), ids

    def _pieces(self, key: np.ndarray, body: np.ndarray, a: np.ndarray, b: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece body[a:b] has, and these laid end to end; key: the pieces' hashes; whole: those that are not one part."""
        young, old = self._young or Pieces(), self._old or Pieces()
        row = young.find(key)
        lost = np.flatnonzero(row < 0)
        if not len(lost):
            return young.ids(row)
        new, first, which = np.unique(key[lost], return_index=True, return_inverse=True)
        at = lost[first]
        known, lasting, odd = old.find(new), b[at] - a[at] <= KEPT_BYTES, whole[at]
        groups = [np.flatnonzero(known >= 0)]
        parts = [old.ids(known[groups[0]])]
        for kept in (lasting, ~lasting):
            for kind, encode in ((~odd, self._plain), (odd, self._each)):
                groups.append(k := np.flatnonzero((known < 0) & kept & kind))
                parts.append(encode(body, a[at[k]], b[at[k]]))
        order = np.concatenate(groups)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        row[lost] = len(young) + rank[which]
        young.add(new[order], np.concatenate([size for size, _ in parts]), np.concatenate([ids for _, ids in parts]), int(np.count_nonzero(lasting)))
        self._young, self._old = (Pieces(), young) if len(young) > KEPT else (young, old)
        return young.ids(row)

    def block(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end with a line feed after each, and how many each text has."""
        n = len(starts) - 1
        lead = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7))
        kind = _CLASS[raw]
        kind[lead] = kind[lead + 1] = _LETTER
        low = T.LOWER[raw]
        capital = lead[raw[lead + 1] <= 0x9E] + 1
        low[capital] += 0x20
        inside = kind != _SPACE
        s, e = T.spans(inside)
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        first = np.zeros(len(raw), dtype=bool)
        first[1:] = inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
        odd = np.flatnonzero(kind == _ODD)
        said, strange = low, np.zeros(0, np.int64)
        if len(odd):  # chunks that hold such a byte are one piece, as they stand
            strange = np.unique(np.searchsorted(s, odd, side="right") - 1)
            size = e[strange] - s[strange]
            at = np.repeat(s[strange] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            first[at] = False
            said[at] = raw[at]
        first[s] = True
        a = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        b = np.flatnonzero(last) + 1
        key = T.hash_spans(said, a, b)
        whole = np.zeros(len(a), dtype=bool)
        if len(strange):
            whole[np.searchsorted(a, s[strange])] = True
        long, out = self._pieces(key, said, a, b, whole)
        return out, np.bincount(T.owner(starts, a), weights=long, minlength=n).astype(np.int64)


@lru_cache(maxsize=2)
def encoder(vocabulary: bytes) -> Encoder:
    """One for each worker process, with the pieces it has met."""
    return Encoder(vocabulary)


def encode(docs: DataFrame, vocabulary: str | None = None, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids of each whole text and the end id, as little-endian integers of 16 bits if the vocabulary has no more, else of 32. vocabulary is a path that the driver reads."""
    with open(vocabulary or public_tokenizers.path(VOCABULARY), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared.value)
        for b in batches:
            kind = "<u2" if max(e.size, end + 1) <= 1 << 16 else "<u4"
            for lo, hi, raw, starts in T.blocks(b.column("text"), BLOCK):
                ids, n = e.block(raw, starts)
                cut = np.concatenate(([0], np.cumsum(n)))
                stop, ids = np.array([end], kind).tobytes(), ids.astype(kind)
                body = [ids[x:y].tobytes() + stop for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(n + 1), pa.array(body, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ENCODED)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it, for a path with or without a scheme."""
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def write_shards(encoded: DataFrame, folder: str, shard: int = SHARD) -> DataFrame:
    """(part, no, path, n_docs, n_tokens, n_bytes) of the files written to a folder that all executors share, in order. The files are written when it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        size = 0

        def written() -> pa.RecordBatch:
            null = np.array([d is None for d in docs])
            lengths = np.array([len(i) for i in ids])
            data = build(np.concatenate(ids), lengths, np.array([d or 0 for d in docs], np.int64), null)
            path = f"{folder}/{part:06d}-{no:06d}-{uuid.uuid4().hex}.wm"
            store, within = _store(path)
            store.create_dir(os.path.dirname(within), recursive=True)
            with store.open_output_stream(within) as f:
                f.write(data)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((part, pa.int32()), (no, pa.int32()), (path, pa.string()), (len(docs), pa.int64()), (int(lengths.sum()), pa.int64()), (len(data), pa.int64()))], names=["part", "no", "path", "n_docs", "n_tokens", "n_bytes"])

        for b in batches:
            for d, n, i in zip(b.column("doc_id").to_pylist(), b.column("n_tokens").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if size >= shard:
                    yield written()
                    ids, docs, size, no = [], [], 0, no + 1
                ids.append(np.frombuffer(i, "<u2" if len(i) == 2 * n else "<u4"))
                docs.append(d)
                size += n
        if docs:
            yield written()

    order = ["doc_id", "tie", "ids"]
    rows = encoded.select("doc_id", F.xxhash64("ids").alias("tie"), "n_tokens", "ids")
    return rows.repartitionByRange("doc_id", "tie").sortWithinPartitions(*order).select("doc_id", "n_tokens", "ids").mapInArrow(run, FILES)


def placed(files: DataFrame) -> DataFrame:
    """files with `start`: ids in all files before. Sums run over parts (one row each), then within each part."""
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    before = parts.select(F.col("part").alias("p"), (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("before"))
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("no")) - F.col("n_tokens")
    return files.join(before, F.col("part") == F.col("p")).select(*files.columns, (F.col("before") + own).alias("start"))


def _each(files: DataFrame, run, schema: str) -> DataFrame:
    """run over files, dealt out one by one."""
    n = max(1, files.count())
    return files.repartition(n, "path").mapInArrow(run, schema)


def _opened(path: str) -> tuple[pa.NativeFile, Wavelet]:
    store, within = _store(path)
    f = store.open_input_file(within)
    return f, Wavelet(lambda at, n: f.read_at(n, at), f.size())


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from the whole files named in files (with `start`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                f, w = _opened(path)
                with f:
                    body = memoryview(w.ids().astype("<u4").tobytes())
                at = w.starts * 4
                crc = [zlib.crc32(body[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(w.docs, pa.int64(), mask=w.null), pa.array(start + w.starts[:-1]), pa.array(w.lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _each(files, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def find_token(files: DataFrame, token: int) -> DataFrame:
    """(doc_id, place, at): documents that hold a token, its place within the document and among all ids; reads the blocks of its planes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                f, w = _opened(path)
                with f:
                    at = w.occurrences(token)
                doc = w.document(at)
                yield pa.RecordBatch.from_arrays([pa.array(w.docs[doc], pa.int64(), mask=w.null[doc]), pa.array(at - w.starts[doc]), pa.array(start + at)], names=["doc_id", "place", "at"])

    return _each(files, run, "doc_id long, place long, at long")


def count_tokens(files: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): occurrences of each asked token in all files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                f, w = _opened(path)
                with f:
                    yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([w.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    return _each(files, run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def shards(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = END, shard: int = SHARD) -> DataFrame:
    """Encodes docs, writes the files to folder and returns their rows with `start`."""
    spark = docs.sparkSession
    encoded = staged(spark, encode(docs, vocabulary, end), "encoded")
    return placed(staged(spark, write_shards(encoded, folder, shard), "files"))


def op11_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = shards(table(spark, sf_dir, "documents"), fresh_path(spark, "shards"))
    return read_documents(files)


QUERIES = {"op11_token_shards": op11_token_shards}
