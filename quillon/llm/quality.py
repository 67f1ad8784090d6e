"""Weak supervision for document quality, all in Spark expressions.

Rules vote good (1), bad (-1) or abstain (0). Votes are counted by pattern over all documents, at most 3 ** rules
patterns; expectation-maximisation runs on those counts inside one row, with accuracies of each rule's votes and a prior, and every
pattern gets a posterior probability of good quality. Documents meet their pattern's posterior again by an equi-join
with that table, whose size is bounded by the number of patterns.

Edge cases: null and empty texts have no words, all counts 0, and fail the base rules; repeated rows are judged alike; an
empty table gives an empty result; texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import SPACES, stage, word_array

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Each rule: name, condition for a bad vote, condition for a good vote; integers only.
RULES = (
    ("length", "n_words < 30", "n_words >= 60"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 12 * n_words", "word_chars >= 3 * n_words and word_chars <= 9 * n_words"),
    ("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    ("lines", "100 * n_dup_lines > 20 * n_lines", "n_dup_lines = 0"),
    ("repeats", "100 * n_repeat_words > 15 * n_words", "n_repeat_words = 0"),
    ("capitals", "100 * n_upper > 40 * word_chars", "100 * n_upper <= 15 * word_chars"),
    ("symbol_share", "100 * n_symbols > 4 * word_chars", "100 * n_symbols <= word_chars"),
    ("variety", "100 * n_distinct < 40 * n_words", "100 * n_distinct >= 50 * n_words"),
    ("marks", "100 * n_marks > 40 * n_words", "100 * n_marks <= 2 * n_words"),
)
ROUNDS = 15
#: The first guess of the posterior for texts without a bad vote, and 1 minus that for the others.
FIRST = 0.9
KEEP_AT = 0.5


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the counts that the rules use, from one pass over the whole texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    less = lambda pattern: (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))).cast("long")
    without = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    got = docs.select("doc_id", word_array(t).alias("words"), lines.alias("lines"), without(SYMBOLS).alias("n_symbols"), less("[A-Z]").alias("n_upper"), without("!").alias("n_marks"))
    n = F.size("words")
    got = got.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        "n_upper",
        "n_marks",
        F.when(n >= WINDOW, F.expr(f"transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW})))")).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    # Texts in which all windows differ, nearly all, end here; the others sort (hash, place) and keep places whose neighbour has an equal hash.
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.when(again, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.expr("cast(array() as array<struct<h:bigint,i:int>>)"))
    got = got.withColumn("placed", placed).drop("windows")
    same = "filter(placed, (x, k) -> (k > 0 and x.h = get(placed, k - 1).h) or (k + 1 < size(placed) and x.h = get(placed, k + 1).h))"
    got = got.withColumn("places", F.expr(f"case when size(placed) > 0 then array_sort(transform({same}, x -> x.i)) else cast(array() as array<int>) end")).drop("placed")
    cover = f"case when size(places) > 0 then aggregate(places, struct(0L as n, -{WINDOW} as last), (a, p) -> struct(a.n + least({WINDOW}, p - a.last) as n, p as last)).n else 0L end"
    return got.withColumn("n_repeat_words", F.expr(cover)).drop("places")


def base_failed() -> str:
    return "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def vote(bad: str, good: str) -> str:
    return f"case when {bad} then -1 when {good} then 1 else 0 end"


def pattern_code() -> str:
    """All votes as one number in base 3."""
    return " + ".join(f"{3**k} * (1 + {vote(bad, good)})" for k, (_, bad, good) in enumerate(RULES))


def posteriors(patterns: DataFrame) -> DataFrame:
    """(pattern, posterior) from (pattern, n): EM for a prior and, for each rule, how much likelier each vote is in good texts.

    A rule's bad and good votes have accuracies of their own: a rule that is alone in seeing one kind of junk is not
    outvoted by rules that cannot see it. A bad vote never speaks for quality and a good vote never against it; abstaining
    says nothing. Patterns gather in one row, of at most 3 ** len(RULES) entries; every step is an expression over that row.
    """
    m, log_odds = len(RULES), lambda p: f"ln({p} / (1 - {p}))"
    one = patterns.agg(F.array_sort(F.collect_list(F.struct("pattern", F.col("n").cast("double").alias("n")))).alias("pats"))
    votes = f"transform(sequence(0, {m - 1}), k -> cast((x.pattern div cast(power(3, k) as bigint)) % 3 - 1 as int))"
    one = one.select(F.expr(f"transform(pats, x -> struct(x.pattern as pattern, x.n as n, {votes} as v))").alias("pats"))
    one = one.select("pats", F.expr(f"transform(pats, x -> case when array_contains(x.v, -1) then {1 - FIRST}D else {FIRST}D end)").alias("q"))
    sums = lambda what: f"aggregate(zip_with(pats, q, (x, p) -> {what}), 0D, (t, y) -> t + y)"
    weigh = lambda vote: f"transform(sequence(0, {m - 1}), k -> ln((({sums(f'case when x.v[k] = {vote} then x.n * p else 0D end')} + 1) / (s.good + 3)) / (({sums(f'case when x.v[k] = {vote} then x.n * (1 - p) else 0D end')} + 1) / (s.bad + 3))))"
    for _ in range(ROUNDS):
        one = one.select("pats", "q", F.expr(f"struct({sums('x.n * p')} as good, {sums('x.n * (1 - p)')} as bad)").alias("s"))
        one = one.select("pats", F.expr("(s.good + 1) / (s.good + s.bad + 2)").alias("prior"), F.expr(f"transform({weigh(-1)}, r -> least(r, 0D))").alias("against"), F.expr(f"transform({weigh(1)}, r -> greatest(r, 0D))").alias("speaks"))
        said = f"aggregate(sequence(0, {m - 1}), 0D, (t, k) -> t + case when x.v[k] < 0 then against[k] when x.v[k] > 0 then speaks[k] else 0D end)"
        one = one.select("pats", F.expr(f"transform(pats, x -> 1 / (1 + exp(-({log_odds('prior')} + {said}))))").alias("q"))
    return one.select(F.explode(F.arrays_zip("pats", "q")).alias("x")).select("x.pats.pattern", F.col("x.q").alias("posterior"))


def judge(docs: DataFrame, text: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """One row per document: doc_id, counts, base_failed, pattern, posterior, kept."""
    got = counts(docs, text).withColumn("base_failed", F.expr(base_failed())).withColumn("pattern", F.expr(pattern_code()).cast("long"))
    got = stage(got, "quality")
    table = stage(posteriors(got.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))), "posteriors")
    joined = got.join(F.broadcast(table), "pattern")  # at most 3 ** len(RULES) rows
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_at))
