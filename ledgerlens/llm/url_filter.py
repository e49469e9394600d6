"""URL filters: rules first, then a classifier over segmented host and path words.

The labels of a host but the last (the top-level domain) and its path are cut into pieces of letters;
each piece is split into words by unigram Viterbi: the
split with the largest product of word probabilities, where unknown words have ``SHARE``, less a
factor of ten per letter; a word has ``LONGEST`` letters at most. Every counted word is a word of the
model: those with a share of ``SHARE`` or more are few enough (a million) for every task to hold; the
rarer ones stay in a table, which is joined with the parts of the names to be split, so that each url
brings those that can occur in it. Word counts come from the hosts and paths of the whole table (a piece
counts once a host), in two rounds: that a piece occurs does
not make it a word, so the second round counts the words that the pieces consist of. There a piece
that is made of other words, of ``MEAN`` letters or more on average, is counted as these and is no
word itself; seed words always are words. A multinomial naive Bayes model then
scores the words of host and path, as one set of words; it is trained on a bounded sample of hosts,
each with one path, that the same words label (see ``SEEDS``): with a strong seed or two seeds among
them it is blocked, the others of the sample are allowed. Labels that most hosts have, such as ``www`` or the ``co`` of
``co.uk``, occur in both classes alike and weigh little. A url is blocked where the log odds are over zero.

Rules go before the model. A rule is a host and a path; it fits its host and all subdomains if
the url's path starts with the rule's path; of the rules that fit the longest wins.

Defined results: a null url, and one without ``://``, has an empty host and path, no rule, and is
allowed (no words, so the prior decides: see ``Model.block``); hosts are lower-cased in A-Z only;
repeated rows each get a result; other columns are ignored; on an empty table nothing is trained and
nothing returned.
"""

from __future__ import annotations

import math
import re
from collections import ChainMap, Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut

# The rules (host, path, verdict) and the seed words of the labelled sample.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
SEEDS = frozenset(
    "adult ads bet bets bingo casino dating gamble gambling jackpot loan loans lottery pharma pill pills poker porn "
    "replica sex slots spam tracker viagra warez xxx".split()
)
STRONG = frozenset("adult ads bets casino gambling pills poker porn spam viagra warez xxx".split())

SHARE = 1e-6  # share of an unknown word; least share in all word counts of a word that tasks hold
SAMPLE = 20_000  # hosts that the classifier is trained on, by hash of the host
SMOOTHING = 0.1  # added to every word count of a class
LONGEST = 24  # letters of the longest word a split may use
MEAN = 3  # least mean length of the words that replace a piece: shorter ones (codes, letters) fit by chance

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PIECE = r"[a-z]+|[^\x00-\x7f]+"
_PIECES = re.compile(_PIECE)
_LOWERED = str.maketrans(_UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule as ``host + path``, its verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # longer ones go outside
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


@dataclass(frozen=True)
class Words:
    """Unigram word model: log probabilities, and the split of a name that they like best."""

    log_p: Mapping[str, float]
    total: float = 1.0
    known: dict[str, tuple[str, ...]] = field(default_factory=dict, compare=False)

    @staticmethod
    def of(counts: dict[str, int], rest: int = 0) -> Words:
        """``rest``: the counts of all words that are not in ``counts``."""
        total = float(sum(counts.values()) + rest or 1)
        return Words({w: math.log(c / total) for w, c in counts.items()}, total)

    def plus(self, rare: list[dict] | None) -> Words:
        """With further words, as (word, count) of the table of rare ones."""
        if not rare:
            return self
        return Words(ChainMap({r["word"]: math.log(r["count"] / self.total) for r in rare}, self.log_p), self.total)

    def word(self, w: str) -> float:
        got = self.log_p.get(w)
        return got if got is not None else math.log(SHARE) - len(w) * math.log(10)

    def split(self, name: str) -> tuple[str, ...]:
        """Viterbi over the letters of ``name``."""
        if (got := self.known.get(name)) is not None:
            return got
        best, back = [0.0], [0]
        for j in range(1, len(name) + 1):
            score, i = max((best[i] + self.word(name[i:j]), -i) for i in range(max(0, j - LONGEST), j))
            best.append(score)
            back.append(-i)
        out, j = [], len(name)
        while j:
            out.append(name[back[j] : j])
            j = back[j]
        if len(self.known) > 100_000:
            self.known.clear()
        got = self.known[name] = tuple(reversed(out))
        return got

    def parts(self, name: str) -> tuple[str, ...]:
        """The words ``name`` is made of, where its own occurrences are no evidence that it is a word."""
        if name in SEEDS:
            return (name,)
        best: list[tuple[float, int] | None] = [(0.0, 0)]
        for j in range(1, len(name) + 1):
            found = [
                (best[i][0] + self.log_p[name[i:j]], -i)
                for i in range(max(0, j - LONGEST), j)
                if best[i] and j - i < len(name) and name[i:j] in self.log_p
            ]
            best.append(max(found, default=None))
        out, j = [], len(name)
        while j and best[-1]:
            i = -best[j][1]
            out.append(name[i:j])
            j = i
        if out and len(name) >= MEAN * len(out):
            return tuple(w for part in reversed(out) for w in self.parts(part))
        split = (name,) if name in self.log_p else self.split(name)
        return split if split == (name,) else tuple(w for part in split for w in self.parts(part))

    def url_words(self, host: str, path: str) -> list[str]:
        """Words of the host's labels without the last (a host of one label keeps it), and of the path."""
        named = host.split(".")[:-1] or [host]
        pieces = [*(p for label in named for p in _PIECES.findall(label)), *_PIECES.findall(path.translate(_LOWERED))]
        return [w for p in pieces for w in self.split(p)]


@dataclass(frozen=True)
class Model:
    words: Words
    odds: dict[str, float]  # log P(word | block) - log P(word | allow)
    unknown: float
    prior: float
    rare: DataFrame | None = None  # (word, count) of the words that ``words`` does not hold

    def score(self, host: str, path: str, rare: list[dict] | None = None) -> float:
        """Log odds of block. ``rare``: the rare words that may occur."""
        return self.prior + sum(self.odds.get(w, self.unknown) for w in self.words.plus(rare).url_words(host, path))

    def block(self, host: str, path: str) -> bool:
        return bool(host) and self.score(host, path) > 0


def _labelled_block(words: list[str]) -> bool:
    return any(w in STRONG for w in words) or sum(w in SEEDS for w in words) > 1


def _model(counts: DataFrame, share: float = SHARE) -> tuple[Words, DataFrame | None]:
    """The words with a share of ``share`` or more in all of ``counts`` (at most 1 / ``share``, whatever
    the size of the table), and a table of the others, if there are any."""
    tenth = F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY count)").alias("tenth")
    whole = counts.agg(F.sum("count").alias("total"), tenth).first()
    total, least = whole.total or 0, (whole.total or 0) * share
    seen = Counter({r.word: r["count"] for r in counts.where((F.col("count") >= least) & (F.length("word") <= LONGEST)).collect()})
    rest = total - sum(seen.values())
    # seed words are words whatever the hosts: they count as often as the most frequent tenth
    for w in sorted(SEEDS):
        seen[w] = max(seen[w], int(whole.tenth or 1))
    rare = (F.col("count") < least) & (F.length("word") <= LONGEST) & ~F.col("word").isin(*sorted(SEEDS))
    return Words.of(dict(seen), rest), counts.where(rare) if least > 1 else None


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, word): the parts of up to ``LONGEST`` letters of each (key, name)."""
    keys, words = [], []

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.string())], ["key", "word"])

    for b in batches:
        for key, name in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for lo in range(0, len(name), 2_000):  # a long name goes in pieces
                ends = [(i, min(i + LONGEST, len(name))) for i in range(lo, min(lo + 2_000, len(name)))]
                words += {name[i:j] for i, end in ends for j in range(i + 1, end + 1)}
                keys += [key] * (len(words) - len(keys))
                if len(keys) > 20_000:
                    yield rows()
                    keys, words = [], []
    if keys:
        yield rows()


def _with_rare(rows: DataFrame, names: Column, rare: DataFrame | None) -> DataFrame:
    """``rows`` and, as ``rare``, the rare words that are parts of their ``names``, with their counts.
    Names and rows meet by 64-bit hash: where two are equal, either brings the other's words along,
    which are no part of its names or are its own as well."""
    if rare is None:
        return rows.withColumn("rare", F.lit(None).cast("array<struct<word:string,count:bigint>>"))
    keyed = rows.withColumn("names", F.array_distinct(names)).withColumn("of", F.xxhash64("names"))
    given = keyed.select("of", F.explode("names").alias("name")).withColumn("key", F.xxhash64("name"))
    parts = given.select("key", "name").distinct().mapInArrow(_parts, "key bigint, word string")
    found = parts.join(rare, "word").groupBy("key").agg(F.collect_set(F.struct("word", "count")).alias("found"))
    each = given.select("of", "key").distinct().join(found, "key").groupBy("of")
    each = each.agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("rare"))
    return keyed.join(each, "of", "left").drop("names", "of")


def _names() -> Column:
    """The pieces of (host, path), as ``Words.url_words`` takes them."""
    whole = F.concat_ws("/", F.regexp_replace("host", r"\.[^.]*$", ""), F.translate("path", _UPPER, _LOWER))
    return F.regexp_extract_all(whole, F.lit(f"({_PIECE})"))


def _recounted(counts: DataFrame, words: Words, rare: DataFrame | None) -> DataFrame:
    """(word, count) of the words that all pieces are made of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            made = [(w, n) for name, n, more in rows for w in words.plus(more).parts(name)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], ["word", "n"])

    given = _with_rare(counts, F.array("word"), rare).select("word", "count", "rare")
    return given.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("count"))


def train(urls: DataFrame, share: float = SHARE) -> Model:
    """Fit both models on (host, path) rows.

    The driver receives the words with a share of ``share`` and ``SAMPLE`` hosts, no more.
    """
    spark = urls.sparkSession
    given = urls.where("host <> ''")
    hosts = given.groupBy("host").agg(F.min("path").alias("path"))
    pieces = given.select("host", F.explode(F.array_distinct(_names())).alias("word"))
    counts = cut(spark, pieces.distinct().groupBy("word").count(), "pieces")
    words, rare = _model(cut(spark, _recounted(counts, *_model(counts, share)), "words"), share)
    first = hosts.orderBy(F.xxhash64("host"), "host").limit(SAMPLE)
    sample = _with_rare(first, _names(), rare).orderBy(F.xxhash64("host"), "host").collect()
    tokens = {True: Counter(), False: Counter()}
    size = Counter()
    for r in sample:
        found = words.plus(r.rare).url_words(r.host, r.path)
        label = _labelled_block(found)
        size[label] += 1
        tokens[label].update(found)
    # the seeds are the labelling rule itself: one example each, which leaves the prior as it is
    for w in sorted(STRONG):
        tokens[True][w] += 1
    vocabulary = len(set(tokens[True]) | set(tokens[False])) + 1
    n = {c: sum(tokens[c].values()) + SMOOTHING * vocabulary for c in (True, False)}
    log_p = {c: {w: math.log((tokens[c][w] + SMOOTHING) / n[c]) for w in {*tokens[True], *tokens[False]}} for c in (True, False)}
    odds = {w: log_p[True][w] - log_p[False][w] for w in log_p[True]}
    return Model(words, odds, 0.0, math.log((size[True] + 1) / (size[False] + 1)), rare)


def judge(pages: DataFrame, model: Model | None = None, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (log odds of block) of every row."""
    kind = pages.schema["page_id"].dataType.simpleString()
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    fitted = model or train(parsed)
    local = replace(fitted, rare=None)  # what the tasks hold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = list(zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True))
            score = [local.score(*url) if url[0] else 0.0 for url in urls]
            block = ["block" if url[0] and s > 0 else "allow" for url, s in zip(urls, score, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(block, pa.string()), pa.array(score, pa.float64())], ["page_id", "host", "path", "guess", "score"]
            )

    given = _with_rare(parsed, _names(), fitted.rare).select("page_id", "host", "path", "rare")
    scored = given.mapInArrow(run, f"page_id {kind}, host string, path string, guess string, score double")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "guess").alias("verdict"), "score")
