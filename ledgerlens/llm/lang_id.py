"""Language identification with hyperdimensional profiles.

Every letter (and the word boundary) has a fixed random vector of ``DIM`` signs. A letter
trigram is bound into one vector by multiplying the vectors of its letters, each permuted by
its place; a text is the bundle (sum) of its trigram vectors; a language's prototype is the
bundle of all its training texts. A text gets the language whose prototype has the largest
cosine with it. Sign vectors are kept as bits: multiplying is XOR, permuting rotates the words.

Trigrams run within words, with one boundary on either side, over lower-cased letters; other
characters only separate words. Defined results: null text or text without a letter is ``und``
with score 0, as is everything when nothing could be learned; ties go to the first language in
alphabetical order; the score is the cosine, not under 0. A null ``doc_id`` is neither held out
nor learned from. Repeated rows each count and each get a result. A prediction looks at nothing
but the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import U64, mix, string_chunks
from .worker import worker_state

DIM = 1024
WORDS = DIM // 64
CHUNK = 1 << 19  # bytes of text handled together
PART = 64  # dimensions in one row of a partial prototype
SLICE = 4096  # distinct trigrams whose vectors are held at a time
TEXTS = 1024  # texts scored together
CELLS = 1 << 21  # counts of (text or language, trigram) held at a time
UNKNOWN = "und"
_TOP = 0x110000


class _Letters:
    """Letter test and work space by code point, built once per worker."""

    def __init__(self):
        self.is_letter = np.fromiter((chr(c).isalpha() for c in range(_TOP)), bool, _TOP)
        self.seen = np.zeros(_TOP, bool)
        self.rank = np.zeros(_TOP, np.int32)


def _letter_bits(code_points: np.ndarray) -> np.ndarray:
    """The random sign vector of each letter, as 64-bit words (0 stands for the boundary)."""
    return mix(code_points.astype(U64)[:, None] * U64(WORDS) + np.arange(1, WORDS + 1, dtype=U64)[None, :])


def _signs(bits: np.ndarray) -> np.ndarray:
    out = np.unpackbits(bits.view(np.uint8), axis=1).astype(np.float32)
    out *= -2
    out += 1
    return out


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams of a group of texts, as three letters each; and, for every trigram in the
    texts, its number among them and the text it is in (texts in order)."""
    table = worker_state("letters", _Letters)
    low = [t.lower() for t in texts]
    lens = np.array([len(t) for t in low], np.int64) + 1
    points = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = table.is_letter[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one boundary after each word
    if len(keep) and not letter[0]:
        keep[0] = True
    at = np.flatnonzero(keep)
    code = np.where(letter[at], points[at], 0).astype(np.int64)
    code = np.concatenate([[0], code])
    own = np.searchsorted(np.cumsum(lens), at, side="right")
    mid = np.flatnonzero(code[1:-1]) + 1
    if not len(mid):
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    table.seen[code] = True
    letters = np.flatnonzero(table.seen)
    table.seen[letters] = False
    table.rank[letters] = np.arange(len(letters))
    rank, k = table.rank[code].astype(np.int64), len(letters)
    key = (rank[mid - 1] * k + rank[mid]) * k + rank[mid + 1]
    if k**3 <= 2 * CHUNK:
        found = np.flatnonzero(np.bincount(key, minlength=k**3))
        place = np.zeros(k**3, np.int64)
        place[found] = np.arange(len(found))
        which = place[key]
    else:
        found, which = np.unique(key, return_inverse=True)
    spelled = np.stack([letters[found // (k * k)], letters[found // k % k], letters[found % k]], axis=1)
    return spelled, which, own[mid - 1]


def bound(spelled: np.ndarray) -> np.ndarray:
    """Sign vectors of trigrams: permuted letter vectors, multiplied."""
    letters, at = np.unique(spelled, return_inverse=True)
    bits, at = _letter_bits(letters), at.reshape(spelled.shape)
    return _signs(np.roll(bits[at[:, 0]], 2, axis=1) ^ np.roll(bits[at[:, 1]], 1, axis=1) ^ bits[at[:, 2]])


def bundles(spelled: np.ndarray, which: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sum of the trigrams' vectors for each of ``n`` groups.

    The vectors of ``SLICE`` trigrams are made at a time, and are added to so many groups at once
    that their counts fit ``CELLS``: memory depends neither on how many trigrams nor on how many
    groups there are, but for the sums. Sums of whole numbers under 2**53 are exact in any order.
    """
    out = np.zeros((n, DIM))
    key, count = np.unique(group * len(spelled) + which, return_counts=True) if len(spelled) else (which, which)
    group, which = np.divmod(key, max(1, len(spelled)))
    kind = np.float32 if count.sum() < 1 << 24 else np.float64  # holds every sum exactly
    by = np.argsort(which // SLICE, kind="stable")  # slice by slice, groups in order
    edges = np.searchsorted(which[by] // SLICE, np.arange(-(-len(spelled) // SLICE) + 1))
    for i, lo in enumerate(range(0, len(spelled), SLICE)):
        mine = by[edges[i] : edges[i + 1]]
        vectors = bound(spelled[lo : lo + SLICE]).astype(kind, copy=False)
        have, row = np.unique(group[mine], return_inverse=True)
        step = max(1, CELLS // len(vectors))
        cuts = np.searchsorted(row, np.arange(0, len(have) + step, step))
        for j, first in enumerate(range(0, len(have), step)):
            some = mine[cuts[j] : cuts[j + 1]]
            counts = np.zeros((min(step, len(have) - first), len(vectors)), kind)
            counts[row[cuts[j] : cuts[j + 1]] - first, which[some] - lo] = count[some]
            out[have[first : first + step]] += counts @ vectors
    return out


@dataclass(frozen=True)
class Model:
    """Prototypes, one row of ``DIM`` numbers for each language (sorted by name)."""

    languages: tuple[str, ...]
    prototypes: np.ndarray

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        spelled, which, own = trigrams(texts)
        n = len(texts)
        best, score = [UNKNOWN] * n, np.zeros(n)
        if not len(spelled) or not self.languages:
            return best, score
        unit = self.prototypes / np.maximum(np.linalg.norm(self.prototypes, axis=1, keepdims=True), 1e-12)
        starts = np.searchsorted(own, np.arange(0, n + TEXTS, TEXTS))
        for i, lo in enumerate(range(0, n, TEXTS)):
            part = slice(starts[i], starts[i + 1])
            bundle = bundles(spelled, which[part], own[part] - lo, min(n - lo, TEXTS))
            norm = np.linalg.norm(bundle, axis=1)
            cosine = bundle @ unit.T / np.maximum(norm, 1e-12)[:, None]
            top = cosine.argmax(axis=1)
            for j in np.unique(own[part] - lo).tolist():
                best[lo + j] = self.languages[top[j]]
                score[lo + j] = min(1.0, max(0.0, float(cosine[j, top[j]])))
        return best, score


def held_out(doc_id: Column) -> Column:
    """One fifth of the documents, by the CRC-32 of the id's text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame) -> Model:
    """Bundle the texts of every document that is not held out and has a language.

    Each task returns one partial sum per language; the driver receives one vector a language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            names = pc.dictionary_encode(b.column(1))
            labels, code = names.dictionary.to_pylist(), np.asarray(names.indices)
            for lo, hi, data, off in string_chunks(b.column(0), CHUNK):
                raw = data.tobytes()
                spelled, which, own = trigrams([raw[x:y].decode() for x, y in zip(off[:-1], off[1:], strict=True)])
                if not len(spelled):
                    continue
                total = bundles(spelled, which, code[lo:hi][own].astype(np.int64), len(labels))
                for name, v in zip(labels, total, strict=True):
                    sums[name] = sums.get(name, 0.0) + v
        for name, v in sums.items():
            whole = np.rint(v).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * (DIM // PART)),
                    pa.array(np.arange(DIM // PART, dtype=np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, DIM + 1, PART, dtype=np.int32)), pa.array(whole)),
                ],
                ["lang", "part", "v"],
            )

    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    learned = docs.where((crc != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    partial = learned.select("text", "lang").mapInArrow(run, "lang string, part int, v array<bigint>")
    sums = partial.groupBy("lang", "part").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(PART)]).alias("v"))
    vectors: dict[str, np.ndarray] = {}
    for row in sums.collect():  # DIM / PART rows for each language
        vectors.setdefault(row.lang, np.zeros(DIM))[row.part * PART : (row.part + 1) * PART] = row.v
    languages = tuple(sorted(vectors))
    return Model(languages, np.array([vectors[x] for x in languages]).reshape(len(languages), DIM))


def identify(docs: DataFrame, model: Model, letters: bool = False) -> DataFrame:
    """All rows of ``docs`` with ``lang_pred`` and ``score`` as two more columns at the end; with
    ``letters`` also ``has_letter``, which looks at the text alone, whatever was learned.

    The columns of ``docs`` go through untouched, also when two have the same name or one is
    called like a result.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in string_chunks(b.column(at), CHUNK):
                raw = data.tobytes()
                texts = [raw[x:y].decode() for x, y in zip(off[:-1], off[1:], strict=True)]
                best, score = model.score(texts)
                found = [*(c.slice(lo, hi - lo) for c in b.columns), pa.array(best), pa.array(score)]
                if letters:
                    found.append(pa.array([any(map(str.isalpha, t)) for t in texts], pa.bool_()))
                yield pa.RecordBatch.from_arrays(found, [*names, "pred", "score", "letter"][: len(found)])

    plain = docs.toDF(*names)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    more = ["lang_pred", "score"] + ["has_letter"] * letters
    return plain.mapInArrow(run, f"{kinds}, pred string, score double" + ", letter boolean" * letters).toDF(*docs.columns, *more)


def predict(docs: DataFrame) -> DataFrame:
    """Train on ``docs`` and predict every row: doc_id, held_out, lang_pred, score."""
    model = train(docs)
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )
