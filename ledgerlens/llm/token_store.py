"""Token ids in a binary file format of patched frame-of-reference blocks.

File: header, byte offset of every block, document index, blocks. A block holds ``BLOCK`` ids
(the last is padded with its minimum): the block minimum is subtracted, the rest is packed at
the bit width of a percentile of the block, and larger values go to an exception list (position
and value). The block index gives random access to any id without reading earlier blocks.

Documents are written in ascending ``doc_id`` order (null first, equal ids in the order of
their text's hash), each followed by the end id. Null text is the empty text: the end id alone.
Repeated rows are written each. Other columns are ignored. An empty table writes no file.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pieces import PieceCache, per_text
from .storage import commit_file, new_folder
from .text import CHUNK, ragged, string_chunks
from .worker import worker_state

# Fixed values of the format.
MAGIC = b"LLPF0001"
BLOCK = 1024
HEADER = struct.Struct("<8sIIQQQ")  # magic, block size, end id, ids, documents, blocks
CUT = "<| |>"  # parts pieces for the library; holds a space, so no piece contains it
PERCENTILE = 0.9
FILE_IDS = 2_000_000  # ids after which a task starts another file
CACHE = 900_000  # pieces remembered by one worker; only speed depends on it


class WordEncoder:
    """The tokenizers library, asked once for each space-separated piece of text.

    The vocabularies this is for drop white space and case before merging (normaliser,
    pre-tokeniser and special tokens never span a space), so the ids of a text are those of its
    pieces in turn. New pieces go to the library together, kept apart by a special token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        for p in ["a b", "é 1'll", "á b", "A b\nÉ"]:
            if self._ids(p) != [t for x in self._plain(p).split(" ") for t in self._ids(x)]:
                raise ValueError("this vocabulary keeps white space or case; its texts cannot be cut at spaces")
        self.tokenizer.add_special_tokens([CUT])
        self.cut = self.tokenizer.token_to_id(CUT)
        self.cache = PieceCache(self._learn, CACHE)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _plain(text: str) -> str:
        """Fold what the normaliser folds, so that fewer pieces differ; left alone where Python's
        folding is another (sigma) or would touch a special token."""
        return text if "Σ" in text or "<|" in text else text.lower().replace("\n", " ")

    def _learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes = [], []
        for i in range(0, len(new), 500):
            ids = np.array(self._ids(CUT.join(new[i : i + 500]) + CUT), np.uint32)
            ends = np.flatnonzero(ids == self.cut)
            flat.append(np.delete(ids, ends))
            sizes.append(np.diff(np.concatenate([[-1], ends])) - 1)
        return np.concatenate(flat), np.concatenate(sizes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each."""
        flat: list[str] = []
        count = []
        for t in texts:
            p = self._plain(t).split(" ")
            flat += p
            count.append(len(p))
        ids, n = self.cache.ids(flat)
        return ids, per_text(n, count)


def word_encoder(path: str) -> WordEncoder:
    return worker_state(("word bpe", path), lambda: WordEncoder(path))


# --- blocks -------------------------------------------------------------------------------


def _pack(rest: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) values under 2**width as little-endian bit strings, one row a block."""
    lanes = np.ascontiguousarray(rest.reshape(-1, 64).T.astype(np.uint64))
    out = np.zeros((width, lanes.shape[1]), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[word] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).astype("<u8").view(np.uint8).reshape(len(rest), -1)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    """Inverse of ``_pack``."""
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u8").reshape(-1, width).T)
    out = np.empty((64, words.shape[1]), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        v = words[word] >> np.uint64(shift)
        if shift + width > 64:
            v |= words[word + 1] << np.uint64(64 - shift)
        out[i] = v & mask
    return out.T.reshape(len(packed), BLOCK)


def encode_file(ids: np.ndarray, doc_ids: list[int | None], counts: np.ndarray, end_id: int) -> bytes:
    """One file: ``ids`` of all documents end to end, ``counts`` of them for each document."""
    blocks = -(-len(ids) // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.int64)
    grid[: len(ids)] = ids
    if blocks:
        grid[len(ids) :] = grid[(blocks - 1) * BLOCK : len(ids)].min()
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1) if blocks else np.zeros(0, np.int64)
    rest = grid - low[:, None]
    typical = np.partition(rest, int(PERCENTILE * (BLOCK - 1)), axis=1)[:, int(PERCENTILE * (BLOCK - 1))] if blocks else low
    width = np.ceil(np.log2(typical + 1.0)).astype(np.int64)
    over = rest >= (np.int64(1) << width)[:, None]
    row, col = np.nonzero(over)
    value = rest[row, col]
    packed: list[bytes] = [b""] * blocks
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        if w:
            bits = _pack(np.where(over[at], 0, rest[at]), w)
            for k, i in enumerate(at.tolist()):
                packed[i] = bits[k].tobytes()
    first = np.searchsorted(row, np.arange(blocks + 1))
    body = []
    for i in range(blocks):
        a, b = first[i], first[i + 1]
        body.append(struct.pack("<IHH", int(low[i]), int(width[i]), int(b - a)) + packed[i] + col[a:b].astype("<u2").tobytes() + value[a:b].astype("<u4").tobytes())
    index = np.concatenate([[0], np.cumsum([len(x) for x in body])]).astype("<u8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    head = HEADER.pack(MAGIC, BLOCK, end_id, len(ids), len(doc_ids), blocks)
    return b"".join([head, index.tobytes(), names.tobytes(), known.tobytes(), np.asarray(counts).astype("<u8").tobytes(), *body])


class TokenFile:
    """A file read back; blocks are decoded when asked for."""

    def __init__(self, content: bytes):
        magic, block, self.end_id, self.n_ids, docs, self.blocks = HEADER.unpack_from(content)
        if magic != MAGIC or block != BLOCK:
            raise ValueError("not a token file")
        at = HEADER.size
        take = lambda kind, n: np.frombuffer(content, kind, n, at)
        self.index = take("<u8", self.blocks + 1).astype(np.int64)
        at += 8 * (self.blocks + 1)
        names = take("<i8", docs)
        at += 8 * docs
        known = take(np.uint8, docs)
        at += docs
        self.counts = take("<u8", docs).astype(np.int64)
        at += 8 * docs
        self.doc_ids = [int(x) if k else None for x, k in zip(names, known, strict=True)]
        self.content, self.body = np.frombuffer(content, np.uint8), at

    def read(self, first: int, end: int) -> np.ndarray:
        """The ids from position ``first`` up to ``end``."""
        if end <= first:
            return np.zeros(0, np.uint32)
        b0, b1 = first // BLOCK, -(-end // BLOCK)
        at = self.body + self.index[b0:b1]
        heads = self.content[ragged(at, np.full(len(at), 8))].reshape(-1, 8)
        low = np.ascontiguousarray(heads[:, :4]).view("<u4").ravel()
        width = np.ascontiguousarray(heads[:, 4:6]).view("<u2").ravel().astype(np.int64)
        extra = np.ascontiguousarray(heads[:, 6:]).view("<u2").ravel().astype(np.int64)
        out = np.zeros((len(at), BLOCK), np.uint32)
        for w in np.unique(width).tolist():
            if w:
                own = np.flatnonzero(width == w)
                size = BLOCK * w // 8
                out[own] = _unpack(self.content[ragged(at[own] + 8, np.full(len(own), size))].reshape(len(own), size), w)
        tail = at + 8 + BLOCK * width // 8
        col = self.content[ragged(tail, 2 * extra)].view("<u2")
        val = self.content[ragged(tail + 2 * extra, 4 * extra)].view("<u4")
        out[np.repeat(np.arange(len(at)), extra), col] = val
        out += low[:, None]
        return out.ravel()[first - b0 * BLOCK : end - b0 * BLOCK]


# --- Spark --------------------------------------------------------------------------------

_MANIFEST = "file string, part int, seq int, n_docs bigint, n_ids bigint, n_bytes bigint"


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 2, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode ``docs`` and write token files to ``folder``; returns the committed manifest.

    Range partitions of (doc_id, text hash) are written by one task each, file by file, so a
    task holds the ids of one file only. The text hash lets many rows of one doc_id spread.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = word_encoder(path), TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        counts: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal names, counts, parts, held, seq
            content = encode_file(np.concatenate(parts), names, np.concatenate(counts), end_id)
            name = f"part-{part:06d}-{seq:06d}.tok"
            commit_file(folder, name, content)
            row = [[name], [part], [seq], [len(names)], [held], [len(content)]]
            names, counts, parts, held, seq = [], [], [], 0, seq + 1
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["file", "part", "seq", "n_docs", "n_ids", "n_bytes"])

        for b in batches:
            for lo, hi, data, off in string_chunks(b.column(1), min(CHUNK, file_ids)):
                raw = data.tobytes()
                ids, n = enc.encode([raw[x:y].decode() for x, y in zip(off[:-1], off[1:], strict=True)])
                parts.append(np.insert(ids, np.cumsum(n), end_id))
                counts.append(n + 1)
                names += b.column(0).slice(lo, hi - lo).to_pylist()
                held += len(parts[-1])
                if held >= file_ids:
                    yield flush()
        if names:
            yield flush()

    rows = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
        .repartitionByRange("doc_id", "h")
        .sortWithinPartitions("doc_id", "h")
    )
    manifest = rows.select("doc_id", "text").mapInArrow(run, _MANIFEST)
    manifest.write.parquet(f"{folder}/_manifest")
    return docs.sparkSession.read.schema(_MANIFEST).parquet(f"{folder}/_manifest")


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Every document of the committed files: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest")
    # one row a file of millions of ids
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    base = manifest.select(F.col("file").alias("base_file"), F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                f = TokenFile(content.as_py())
                ends = np.cumsum(f.counts)
                for d in range(0, len(f.counts), 2048):
                    n, e = f.counts[d : d + 2048], ends[d : d + 2048]
                    first = int(e[0] - n[0])
                    ids = f.read(first, int(e[-1])).astype("<u4")
                    at = np.concatenate([[0], e - first])
                    crc = [zlib.crc32(ids[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
                    cols = [pa.array([name] * len(n)), pa.array(f.doc_ids[d : d + 2048], pa.int64()), pa.array(e - n), pa.array(n), pa.array(crc, pa.int64())]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(cols, ["file", "doc_id", "at", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    rows = named.mapInArrow(run, "file string, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)
    out = rows.join(base, rows["file"] == base["base_file"])
    return out.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def round_trip(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """Write ``docs`` to new files in the shared folder and read all of them back."""
    folder = new_folder(spark, "tokens")
    manifest = write_tokens(docs, path, folder)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return read_tokens(spark, folder)
