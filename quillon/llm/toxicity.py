"""Weak supervision for toxicity.

Voters are lexicons and patterns. A general list of insults is fixed; words and word beginnings that mark toxic texts are
induced from training labels. A voter that finds one of its terms votes toxic, else abstains; two patterns vote toxic on
repeated or dense hits, one votes clean where nothing is found. A generative model over the counts of vote patterns of
all documents estimates every voter's accuracy by expectation-maximisation and the correlations of voters within a
class, by which their weights are discounted in the final posterior. A linear classifier is then trained on posterior labels of a bounded sample.
It sees whether a text has a word of the fixed list and, in HASHES numbers, how many of its distinct words have each word
and each beginning of 3, 4 or 5 letters, but not the votes: so it also finds texts of which no voter is sure, and leaves
texts alone that one voter alone has caught. It scores every document.

Labels serve to induce the lexicons only, from at most SAMPLE labelled training rows, chosen by a hash of their id; the
language, source, id and label of a document are never inputs of its score. Labels that differ for one id count as toxic.

Edge cases: null and empty texts have no hits and get the lowest score; without labels only the fixed list votes; repeated
rows score alike; an empty table gives an empty result; texts are read whole; other columns are carried along.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import stage
from quillon.llm.words import folded_lower

#: A fixed general list.
INSULTS = (
    "idiot", "idiots", "moron", "morons", "stupid", "pathetic", "worthless", "trash", "scum", "loser", "losers", "clown", "clowns",
    "disgusting", "imbecile", "dumb", "dumbass", "bastard", "bitch", "asshole", "fuck", "fucking", "shit", "retard", "vermin", "filth",
)
#: Most labelled rows used, most terms of a lexicon, least texts and least precision of a term.
SAMPLE, TERMS, SUPPORT, PRECISION = 20_000, 2_000, 6, 0.95
#: Most different texts that the classifier is trained on, half of them likely toxic if there are as many; its hashed inputs, and its ridge.
FIT_ROWS, HASHES, RIDGE = 6_000, 1 << 15, 1e-3
PREFIXES = (3, 4, 5)
KINDS = ("fixed", "word", "start3", "start4", "start5", "often")
#: Beginnings that count only if a text repeats them: their lengths, and one in so many words must have it, two at least.
OFTEN, ONE_IN = (4, 5), 100
VOTERS = (*KINDS, "repeated", "dense", "nothing")
CUT = 0.3
#: What the label model believes before it sees votes, as so many texts of either class: how often a toxic and a clean text get each vote.
BELIEF, EXPECTED = 10.0, {1: (0.5, 0.01), -1: (0.05, 0.9)}
COUNTS = T.StructType([T.StructField("n_words", T.LongType()), *(T.StructField(k, T.LongType()) for k in KINDS)])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32(doc_id as text) mod 4 is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _terms(batches):
    """Texts by term and label: counts of 200 texts at once, one row a term."""
    for batch in (b.slice(a, 200) for b in batches for a in range(0, b.num_rows, 200)):
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            listed = folded_lower(text)
            often = Counter(w.decode("utf-8", "replace")[:n] for w in listed for n in OFTEN if len(w) >= n)
            found[toxic].update(f"*{s}" for s, c in often.items() if c >= 2 and c * ONE_IN >= len(listed))
            words = set(listed)
            starts = {w.decode("utf-8", "replace")[:n] for w in words for n in PREFIXES if len(w) >= n}
            found[toxic].update((f" {s}" for s in starts))
            found[toxic].update((f" {w.decode('utf-8', 'replace')} " for w in words))
        terms = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "toxic": pa.array([found[1][x] for x in terms], pa.int64()), "clean": pa.array([found[0][x] for x in terms], pa.int64())})


def lexicon(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, list[str]]:
    """Terms by kind: ' word ' and ' start' strings. Equal texts count once."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic"))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)))
    n = rows.count()
    if n > sample:  # the share of hash slots whose rows come to the bound, less what chance may add
        rows = rows.where(F.col("slot") < int((1 << 20) * max(0.0, sample - 4 * sample**0.5) / n))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")  # at most `sample` rows
    once = picked.groupBy(F.xxhash64("text").alias("hash")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    counted = once.select("text", "toxic").mapInArrow(_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    good = counted.where((F.col("toxic") >= SUPPORT) & (F.col("toxic") + 0.5 >= PRECISION * (F.col("toxic") + F.col("clean") + 1)))
    kind = F.when(F.col("term").startswith("*"), "often").when(F.col("term").endswith(" "), "word").otherwise(F.concat(F.lit("start"), F.length("term") - 1))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("toxic"), "term"))
    top = good.withColumn("kind", kind).withColumn("rank", rank).where(F.col("rank") <= TERMS).orderBy("kind", "rank").collect()  # a lexicon's size is bounded
    out: dict[str, list[str]] = {k: [] for k in KINDS}
    out["fixed"] = [f" {w} " for w in INSULTS]
    for row in top:
        if row.kind in out:
            out[row.kind].append(row.term)
    return out


def _automaton(terms: dict[str, list[str]]):
    found: dict[str, int] = {}
    for k, kind in enumerate(KINDS):
        for term in terms[kind]:
            seek = f" {term[1:]}" if kind == "often" else term
            found[seek] = found.get(seek, 0) | 1 << k
    auto = ahocorasick.Automaton()
    for term, kinds in found.items():
        auto.add_word(term, (term, kinds))
    auto.make_automaton()
    return auto


def counter(terms: dict[str, list[str]]):
    """A column function: text to the number of words and of each kind's hits."""
    built: list = []

    def count(texts: pa.Array) -> pa.Array:
        if not built:
            built.append(_automaton(terms))
        rows = np.zeros((len(texts), 1 + len(KINDS)), np.int64)
        for i, text in enumerate(texts):
            words = folded_lower(text.as_py())
            rows[i, 0] = len(words)
            repeated: Counter = Counter()
            for _, (term, kinds) in built[0].iter(f" {b' '.join(words).decode('utf-8', 'replace')} "):
                for k in range(len(KINDS) - 1):
                    rows[i, k + 1] += kinds >> k & 1
                if kinds >> len(KINDS) - 1:
                    repeated[term] += 1
            rows[i, -1] = sum(c for c in repeated.values() if c >= 2 and c * ONE_IN >= len(words))
        return pa.StructArray.from_arrays([pa.array(c) for c in rows.T], names=["n_words", *KINDS])

    return F.arrow_udf(count, COUNTS)


def votes(f: str = "f") -> list[Column]:
    """1 toxic, 0 abstain, -1 clean; in the order of VOTERS."""
    c = lambda k: F.col(f"{f}.{k}")
    hits = F.greatest(*(c(k) for k in KINDS))
    yes = lambda x: F.when(x, 1).otherwise(0)
    return [*(yes(c(k) > 0) for k in KINDS), yes(hits >= 2), yes((hits > 0) & (hits * 200 >= c("n_words"))), F.when(hits == 0, -1).otherwise(0)]


def pattern(f: str = "f") -> Column:
    return F.concat_ws(",", *(v.cast("string") for v in votes(f)))


def label_model(patterns: list[tuple[list[int], float]], rounds: int = 30) -> tuple[list[float], list[dict[int, float]]]:
    """Posterior of toxic for each vote pattern, and the log weights of each voter's votes, from patterns and their counts."""
    v, n = np.array([p for p, _ in patterns]), np.array([c for _, c in patterns], float)
    q = np.where((v > 0).any(1), 0.9, 0.05)
    m, weights = v.shape[1], []
    for last in [False] * rounds + [True]:
        toxic, clean = (n * q).sum(), (n * (1 - q)).sum()
        weights = []
        for k in range(m):
            w = {}
            for vote, bound in ((1, max), (-1, min)):
                hit = v[:, k] == vote
                w[vote] = bound(0.0, float(np.log(((n * q * hit).sum() + BELIEF * EXPECTED[vote][0]) / (toxic + BELIEF)) - np.log(((n * (1 - q) * hit).sum() + BELIEF * EXPECTED[vote][1]) / (clean + BELIEF))))
            weights.append(w)
        share = {x: _discount(v == x, n, q) if last else np.ones(m) for x in (1, -1)}  # accuracies first, then what correlated voters say together
        score = np.log((toxic + BELIEF / 20) / (clean + BELIEF)) + sum(share[x][k] * weights[k][x] * (v[:, k] == x) for k in range(m) for x in (1, -1))
        q = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return q.tolist(), weights


def _discount(hit: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
    """1 / (1 + sum of a voter's positive correlations with voters of the same vote), the mean over both classes."""
    total, m = np.zeros(hit.shape[1]), hit.shape[1]
    for w in (n * q, n * (1 - q)):
        p = w / max(w.sum(), 1e-9)
        d = hit - p @ hit
        var = p @ (d * d)
        for a, b in itertools.combinations(np.flatnonzero(var > 1e-6), 2):
            total[[a, b]] += max(0.0, float(p @ (d[:, a] * d[:, b]) / np.sqrt(var[a] * var[b]))) / 2
    return 1 / (1 + total)


class Inputs(dict):
    """The hashed inputs of words, as 16-bit numbers, of which a bounded number are kept: the word itself and its beginnings."""

    def __init__(self, keep: int = 50_000) -> None:
        super().__init__()
        self.keep = keep

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        parts = {f" {text} ", *(f" {text[:n]}" for n in PREFIXES if len(text) >= n)}
        found = struct.pack(f"<{len(parts)}H", *(zlib.crc32(x.encode()) % HASHES for x in parts))
        if len(self) < self.keep:
            self[word] = found
        return found

    def of(self, text: str | None, wanted: np.ndarray | None = None) -> tuple[bool, np.ndarray, np.ndarray]:
        """Whether a text has a word of the fixed list, its inputs (only wanted ones, if given) and their values: up to some 100 words, the share of them counts, beyond that too."""
        words = set(folded_lower(text))
        ids = np.frombuffer(b"".join(map(self.__getitem__, words)), "<u2")
        if wanted is not None:
            ids = ids[wanted[ids]]
        ids, count = np.unique(ids, return_counts=True)
        return not FIXED.isdisjoint(words), ids, np.log1p(100 * count / max(LEAST_WORDS, len(words)))


FIXED = frozenset(w.encode() for w in INSULTS)
#: Texts of fewer distinct words count as if they had so many.
LEAST_WORDS = 50
#: Inputs that a step of the fit takes at once.
LOT = 1 << 20
_INPUTS: list[Inputs] = []


def _inputs() -> Inputs:
    """One for each Python process."""
    if not _INPUTS:
        _INPUTS.append(Inputs())
    return _INPUTS[0]


def least(f, x: np.ndarray, steps: int = 80, kept: int = 8) -> np.ndarray:
    """Where a convex function is least, by the limited-memory BFGS method; f gives value and gradient."""
    moves, value, slope = [], *f(x)
    for _ in range(steps):
        way, sizes = slope.copy(), []
        for s, y in reversed(moves):
            sizes.append(s @ way / (y @ s))
            way -= sizes[-1] * y
        way *= moves[-1][0] @ moves[-1][1] / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1.0, np.abs(slope).sum())
        for (s, y), size in zip(moves, reversed(sizes), strict=True):
            way += (size - y @ way / (y @ s)) * s
        length = 1.0
        while length > 1e-8 and not (new := f(x - length * way))[0] <= value - 1e-4 * length * (slope @ way):
            length /= 2
        if length <= 1e-8:
            break
        if (new[1] - slope) @ (-length * way) > 1e-14:
            moves = [*moves, (-length * way, new[1] - slope)][-kept:]
        gain = value - new[0]
        x, value, slope = x - length * way, *new
        if gain < 1e-7:
            break
    return x


def fit_linear(row: np.ndarray, at: np.ndarray, value: np.ndarray, fixed: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """HASHES weights, that of the fixed list and the intercept of a logistic model for soft labels y, from inputs (row, at, value)."""
    n, weight = len(y), weight / max(weight.sum(), 1e-9)
    pull = np.concatenate([np.full(HASHES, ridge), [ridge / 100, 0.0]])
    lots = [slice(a, a + LOT) for a in range(0, len(row), LOT)]  # so that what a step needs besides is small

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        z = fixed * p[-2] + p[-1]
        for k in lots:
            z += np.bincount(row[k], value[k] * p[at[k]], n)
        e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        slope = np.append(np.zeros(HASHES), [e @ fixed, e.sum()])
        for k in lots:
            slope[:HASHES] += np.bincount(at[k], value[k] * e[row[k]], HASHES)
        return float(weight @ (np.logaddexp(0, z) - y * z) + pull @ (p * p) / 2), slope + pull * p

    return least(loss, np.concatenate([np.zeros(HASHES + 1), [-2.0]]))


@dataclass
class Model:
    """The classifier: HASHES weights, that of the fixed list and the intercept."""

    weights: np.ndarray

    def score(self, text: Column) -> Column:
        weights = self.weights.astype(np.float32)

        def run(texts: pa.Array) -> pa.Array:
            wanted, out = weights[:HASHES] != 0, np.zeros(len(texts))
            for i, t in enumerate(texts):
                fixed, at, value = _inputs().of(t.as_py(), wanted)
                out[i] = value @ weights[at].astype(float) + fixed * float(weights[-2]) + float(weights[-1])
            return pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))

        return F.arrow_udf(run, "double")(text)


def _described(batches):
    """hash, fixed, at, value of texts: the classifier's inputs."""
    for batch in (b.slice(a, 200) for b in batches for a in range(0, b.num_rows, 200)):
        got = [_inputs().of(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_pydict({"hash": batch.column("hash"), "fixed": pa.array([x[0] for x in got]), "at": pa.array([x[1].astype("<u2").tobytes() for x in got], pa.binary()), "value": pa.array([x[2].astype("<f2").tobytes() for x in got], pa.binary())})


def fit(docs: DataFrame, counted: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The model from the counts (hash of the text, f) of all documents."""
    patterns = counted.groupBy(pattern().alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    found = [([int(x) for x in r.pattern.split(",")], float(r.n)) for r in patterns.orderBy("pattern").collect()]  # at most 2 ** 9 patterns
    if not found:
        return Model(np.concatenate([np.zeros(HASHES + 1), [-4.0]]))
    posterior, _ = label_model(found)
    of = {",".join(map(str, p)): q for (p, _), q in zip(found, posterior, strict=True)}
    likely = sorted(p for p, q in of.items() if q >= 0.5)

    # Equal texts count once; a hash of theirs picks which are seen: half of fit_rows of likely toxic ones at most, others fill up.
    texts = counted.groupBy("hash").agg(F.first(pattern()).alias("pattern")).withColumn("toxic", F.col("pattern").isin(likely) if likely else F.lit(False))
    texts = stage(texts, "texts")
    size = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    some = min(size.get(True, 0), fit_rows // 2)
    most = {True: some, False: min(size.get(False, 0), fit_rows - some)}
    chosen = [r for side in sorted(size) for r in texts.where(F.col("toxic") == side).orderBy(F.xxhash64("hash"), "hash").limit(most[side]).collect()]
    label = {r.hash: of[r.pattern] for r in chosen}
    share = {r.hash: size[r.toxic] / most[r.toxic] for r in chosen}
    picked = docs.sparkSession.createDataFrame([(h,) for h in label], "hash long")
    rows = docs.select(F.xxhash64("text").alias("hash"), "text").join(F.broadcast(picked), "hash").groupBy("hash").agg(F.first("text").alias("text"))
    rows = sorted(rows.mapInArrow(_described, "hash long, fixed boolean, at binary, value binary").collect(), key=lambda r: r.hash)  # at most fit_rows, of HASHES inputs at most
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r.at) // 2 for r in rows])
    at, value = np.frombuffer(b"".join(r.at for r in rows), "<u2"), np.frombuffer(b"".join(r.value for r in rows), "<f2")
    sides = [np.array([of(r) for r in rows], float) for of in (lambda r: r.fixed, lambda r: label[r.hash], lambda r: share[r.hash])]
    del rows
    often = np.bincount(at, minlength=HASHES)[at] >= 5  # inputs of fewer texts say nothing about others
    return Model(fit_linear(row[often], at[often], value[often].astype(np.float32), *sides))


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of these documents: one pass of the voters over all of them, one over the texts that it is fitted on."""
    count = counter(lexicon(docs, labels))
    return fit(docs, stage(docs.select(F.xxhash64("text").alias("hash"), count(F.col("text")).alias("f")), "toxicity"))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = docs.select("doc_id", trained(docs, labels).score(F.col("text")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their columns; the texts are not shuffled."""
    scored = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), trained(docs, labels).score(F.col("text")).alias("score"))
    return scored.where(F.col("score") < CUT).select("row.*")
