"""Byte-level BPE encoding and decoding by speculation and verification.

Greedy longest match proposes tokens for each word. A token sequence is the BPE result of its
bytes exactly when every token, and every adjacent pair of tokens, is the BPE result of its
own bytes; so one table look-up per adjacent pair, done for all words at once, proves most
proposals right. Only words with a failing pair are merged exactly, in rank order.

Defined results: a null text is the empty text (no ids); repeated rows are encoded each;
columns besides ``doc_id`` and ``text`` are not looked at, whatever they are called; an empty
table gives an empty result. Texts are cut only where the tokenizer cuts as well, so very long
texts need memory in proportion to their own length.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import PieceCache, per_text
from .text import ragged, string_chunks
from .worker import worker_state

# The pre-tokenisation pattern of byte-level BPE vocabularies.
_SPACE = r"\p{White_Space}"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|{_SPACE}+(?!\P{{White_Space}})|{_SPACE}+"

CACHE = 350_000  # pieces remembered by one worker; only speed depends on it
PAIRS = 250_000  # compatible and other pairs remembered
SHORT = 24  # bytes up to which a plain scan merges faster than a heap


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files, inverted."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


NEVER = (1 << 60, -1)  # rank of a pair that does not merge


class Bpe:
    """A byte-level BPE vocabulary with its merge ranks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        as_bytes = lambda t: bytes(letters[c] for c in t)
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for b, i in [*self.ids.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.token[i] = b
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {}
        for rank, (a, b) in enumerate(pairs):
            x, y = as_bytes(a), as_bytes(b)
            self.merges[self.ids[x], self.ids[y]] = (rank, self.ids[x + y])
        self.reach: dict[bytes, int] = {}  # first two bytes -> longest token that starts so
        for b in self.ids:
            self.reach[b[:2]] = max(self.reach.get(b[:2], 1), len(b))
        self.size = size
        self.fits: dict[int, bool] = {}  # left * size + right -> compatible
        self.stands: dict[int, bool] = {}  # token -> its bytes encode to itself
        # decoding table: bytes of all tokens, end to end
        self.token_len = np.array([len(t) for t in self.token], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(self.token), np.uint8)

    def greedy(self, word: bytes) -> list[int]:
        out, i, n, ids, reach = [], 0, len(word), self.ids, self.reach
        while i < n:
            for j in range(min(n, i + reach.get(word[i : i + 2], 1)), i, -1):
                if (t := ids.get(word[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
        return out

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: lowest rank first, leftmost among equals."""
        ids = [self.ids[word[i : i + 1]] for i in range(len(word))]
        n, merges = len(ids), self.merges
        if n <= SHORT:
            found = [merges.get(p, NEVER) for p in zip(ids, ids[1:], strict=False)]
            while found and (best := min(found)) is not NEVER:
                i = found.index(best)
                ids[i : i + 2] = [best[1]]
                del found[i]
                if i:
                    found[i - 1] = merges.get((ids[i - 1], ids[i]), NEVER)
                if i < len(found):
                    found[i] = merges.get((ids[i], ids[i + 1]), NEVER)
            return ids
        right, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(*merges[p], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in merges]
        heapq.heapify(heap)
        while heap:
            _, new, i, pair = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], alive[j], right[i] = new, False, right[j]
            if right[i] < n:
                left[right[i]] = i
                if (p := (new, ids[right[i]])) in merges:
                    heapq.heappush(heap, (*merges[p], i, p))
            if left[i] >= 0 and (p := (ids[left[i]], new)) in merges:
                heapq.heappush(heap, (*merges[p], left[i], p))
        return [t for t, a in zip(ids, alive, strict=True) if a]

    def _fitting(self, keys: np.ndarray) -> np.ndarray:
        """Whether each pair (left * size + right) is the encoding of its own bytes."""
        found, where = np.unique(keys, return_inverse=True)
        ok = np.empty(len(found), bool)
        for k, key in enumerate(found.tolist()):
            if (v := self.fits.get(key)) is None:
                if len(self.fits) > PAIRS:
                    self.fits.clear()
                a, b = divmod(key, self.size)
                v = self.fits[key] = self.merged(self.token[a] + self.token[b]) == [a, b]
            ok[k] = v
        return ok[where]

    def _standing(self, token: int) -> bool:
        if (v := self.stands.get(token)) is None:
            v = self.stands[token] = self.merged(self.token[token]) == [token]
        return v

    def encode_words(self, found: list[bytes]) -> tuple[list[list[int]], int]:
        """Ids of each word, and how many words needed exact merging."""
        out = [self.greedy(w) for w in found]
        n = np.array([len(x) for x in out], np.int64)
        flat = np.fromiter(chain.from_iterable(out), np.int64, int(n.sum()))
        bad = np.zeros(len(out), bool)
        own = np.repeat(np.arange(len(out)), n)
        if len(flat) > 1:
            pair = np.flatnonzero(own[1:] == own[:-1])
            ok = self._fitting(flat[pair] * self.size + flat[pair + 1])
            bad[own[pair[~ok]]] = True
        single = np.unique(flat)
        odd = np.array([t for t in single.tolist() if not self._standing(t)], np.int64)
        bad[own[np.isin(flat, odd)]] = True
        for i in np.flatnonzero(bad).tolist():
            out[i] = self.merged(found[i])
        return out, int(bad.sum())

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """UTF-8 bytes of an id sequence."""
        return self.token_bytes[ragged(self.token_at[ids], self.token_len[ids])]


_PIECE = regex.compile(rf"{_SPACE}*\P{{White_Space}}+|{_SPACE}+")
# white space before a space or line end, or at the end: pieces are found one by one instead
_ODD_SPACE = regex.compile(rf"{_SPACE}[ \n]|{_SPACE}\Z")
_SIGNS = re.compile(r"[\W_][,.][ \n]")  # stops that may make one token with what is before them
_MARK = "\x01"


def pieces(text: str) -> list[str]:
    """Cut a text where pre-tokens end: before every run of white space, and (where that is
    sure) before a comma or stop at the end of a word."""
    if _ODD_SPACE.search(text):
        return _PIECE.findall(text)
    mark = _MARK if _MARK not in text and not _SIGNS.search(text) else None
    if mark:
        for stop in (", ", ". ", ",\n", ".\n"):
            text = text.replace(stop, f" {_MARK}{stop}")
    out = []
    for k, line in enumerate(text.split("\n")):
        first, *rest = line.split(" ")
        if first or k:
            out.append("\n" + first if k else first)
        out += [x[1:] if x[:1] == mark else " " + x for x in rest]
    return out


class Encoder:
    """Encodes texts piece by piece; remembers pieces it has met."""

    def __init__(self, path: str):
        self.bpe = Bpe(path)
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.bpe.special)) + ")") if self.bpe.special else None
        self.cache = PieceCache(self._learn, CACHE)

    def _learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special = self.bpe.special
        parts = [[] if p in special else [w.encode() for w in self.words.findall(p)] for p in new]
        known = list(dict.fromkeys(w for ws in parts for w in ws))
        got = dict(zip(known, self.bpe.encode_words(known)[0], strict=True))
        ids = [[special[p]] if p in special else [t for w in ws for t in got[w]] for p, ws in zip(new, parts, strict=True)]
        n = np.array([len(x) for x in ids], np.int64)
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum())), n

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each text."""
        flat: list[str] = []
        count = []
        for t in texts:
            before = len(flat)
            if self.cut and self.cut.search(t):
                for x in self.cut.split(t):
                    flat += [x] if x in self.bpe.special else pieces(x)
            else:
                flat += pieces(t)
            count.append(len(flat) - before)
        ids, n = self.cache.ids(flat)
        return ids, per_text(n, count)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, loaded once."""
    return worker_state(("byte bpe", path), lambda: Encoder(path))


def encode_documents(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` (array of int) and ``decoded`` (from the ids) of each row.

    The general form: one narrow pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for lo, hi, data, off in string_chunks(b.column("__text")):
                raw = data.tobytes()
                ids, n = enc.encode([raw[x:y].decode() for x, y in zip(off[:-1], off[1:], strict=True)])
                ends = np.concatenate([[0], np.cumsum(n)])
                text = [enc.bpe.decode(ids[x:y]).tobytes().decode() for x, y in zip(ends[:-1], ends[1:], strict=True)]
                cols = [b.column(f"__{c}").slice(lo, hi - lo) for c in keep]
                arr = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*cols, arr, pa.array(text)], [*keep, "ids", "decoded"])

    picked = docs.select(*[F.col(c).alias(f"__{c}") for c in keep], F.col("text").alias("__text"))
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return picked.mapInArrow(run, f"{kept}, ids array<int>, decoded string")


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for lo, hi, data, off in string_chunks(b.column(1)):
                raw = data.tobytes()
                ids, n = enc.encode([raw[x:y].decode() for x, y in zip(off[:-1], off[1:], strict=True)])
                ends = np.concatenate([[0], np.cumsum(n)])
                spans = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
                little = ids.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo),
                        pa.array(n, pa.int64()),
                        pa.array([hashlib.sha256(little[x:y]).hexdigest() for x, y in spans]),
                        pa.array([hashlib.sha256(enc.bpe.decode(ids[x:y])).hexdigest() for x, y in spans]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
