"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Some rules have a fixed limit. For the others the limit is chosen from labelled
documents, so that in every stratum the share of good documents that the rules
reject stays under a given risk, with a given confidence.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.session import written

WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20

RISK = 0.05  # share of a stratum's good documents that may be rejected
CONFIDENCE = 0.95  # that this holds in all strata at once
GOOD_COST = 10.0  # bad documents that are worth one good one

LANGUAGES = ("en", "de", "fr", "es")
LONG = 200  # words from which a document counts as long

SHARES = (0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02, 0.01)
# Rule → candidate limits from loose to strict; a document is rejected above.
RULES = {
    "symbols": SHARES,
    "exclaims": SHARES,
    "dup_lines": SHARES,
    "repeats": tuple(s for s in SHARES if s <= 0.2),
    "word_length": (30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0, 7.5, 7.0, 6.5, 6.0),
}

_BLANK = r"[\\x20\\x09-\\x0D]"
_SYMBOLS = "#*$%&|<>"  # fixed by the contract


def _occurrences(text: str, characters: str) -> str:
    """SQL: how often ASCII characters occur in a text."""
    return " + ".join(f"(octet_length({text}) - octet_length(replace({text}, '{c}', '')))" for c in characters)


def text_statistics(text_col: str = "text") -> Column:
    """Struct of n_words, word_chars, n_symbols, n_exclaims, n_lines, n_dup_lines, n_repeat_words.

    Words are what white space (0x20, 0x09-0x0D) leaves. ``n_repeat_words``
    counts the words that lie in a window of five words found twice or more in
    the text. Windows are compared by 64-bit hashes of their words; only texts
    with equal hashes are sorted to find where they lie. All work happens within
    the row, so a long text is never spread over a shuffle. Null is an empty text.
    """
    words = f"filter(split(s.t, '{_BLANK}+'), w -> w <> '')"
    lines = f"filter(split(s.t, '\\n'), l -> l rlike '{_BLANK.replace('[', '[^')}')"
    five = ", ".join(f"s.h[i + {k}]" for k in range(WINDOW))
    windows = (
        f"CASE WHEN size(s.h) >= {WINDOW} THEN transform(sequence(0, size(s.h) - {WINDOW}), i -> xxhash64({five})) "
        "ELSE array(CAST(0 AS BIGINT)) END"
    )
    placed = "sort_array(transform(s.v, (x, i) -> struct(x AS h, i AS p)))"
    twice = (
        "filter(q.o, (e, i) -> (i > 0 AND q.o[greatest(i - 1, 0)].h = e.h) "
        "OR (i < size(q.o) - 1 AND q.o[least(i + 1, size(q.o) - 1)].h = e.h))"
    )
    covered = (
        f"aggregate(transform(r.p, (x, i) -> CASE WHEN i = size(r.p) - 1 THEN {WINDOW} "
        f"ELSE least({WINDOW}, r.p[least(i + 1, size(r.p) - 1)] - x) END), 0, (a, x) -> a + x)"
    )
    repeated = (
        "CASE WHEN size(array_distinct(s.v)) = size(s.v) THEN 0 ELSE transform(transform(array(struct("
        f"{placed} AS o)), q -> struct(sort_array(transform({twice}, e -> e.p)) AS p)), r -> {covered})[0] END"
    )
    # every step binds what the next one reads several times, so nothing is computed twice
    steps = [
        f"s -> struct(s.t AS t, {words} AS w, {lines} AS l)",
        "s -> struct(s.t AS t, s.w AS w, s.l AS l, transform(s.w, x -> xxhash64(x)) AS h)",
        f"s -> struct(s.t AS t, s.w AS w, s.l AS l, {windows} AS v)",
        "s -> struct("
        "CAST(size(s.w) AS BIGINT) AS n_words, "
        "CAST(char_length(array_join(s.w, '')) AS BIGINT) AS word_chars, "
        f"CAST({_occurrences('s.t', _SYMBOLS)} AS BIGINT) AS n_symbols, "
        f"CAST({_occurrences('s.t', '!')} AS BIGINT) AS n_exclaims, "
        "CAST(size(s.l) AS BIGINT) AS n_lines, "
        "CAST(size(s.l) - size(array_distinct(s.l)) AS BIGINT) AS n_dup_lines, "
        f"CAST({repeated} AS BIGINT) AS n_repeat_words)",
    ]
    bound = f"array(struct(coalesce(`{text_col}`, '') AS t))"
    for step in steps:
        bound = f"transform({bound}, {step})"
    return F.expr(f"{bound}[0]")


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, stratum, the statistics, one score in each rule of ``RULES``, base_failed."""
    counted = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), text_statistics(text_col).alias("s")).select("doc_id", "lang", "s.*")
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    known = F.when(F.col("lang").isin(*LANGUAGES), F.col("lang")).otherwise("other")
    return counted.select(
        "doc_id",
        F.concat(known, F.when(F.col("n_words") >= LONG, "-long").otherwise("-short")).alias("stratum"),
        *("n_words word_chars n_symbols n_dup_lines n_repeat_words".split()),
        (F.col("n_symbols") / chars).alias("symbols"),
        (F.col("n_exclaims") / chars).alias("exclaims"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_lines"),
        (F.col("n_repeat_words") / words).alias("repeats"),
        (F.col("word_chars") / words).alias("word_length"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))).alias("base_failed"),
    )


def _ln_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z >= 1: Stirling's series at z + 8, stepped down."""
    s = z + 8
    series = (s - 0.5) * F.log(s) - s + 0.5 * math.log(2 * math.pi) + 1 / (12 * s) - 1 / (360 * s**3) + 1 / (1260 * s**5)
    for step in range(8):
        series = series - F.log(z + step)
    return series


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p), exact up to rounding; 1 where k is at or above the mean.

    The terms are summed from k downwards. Below the mean they shrink, and
    10·sqrt(n) of them carry all of the sum that a double can hold.
    """
    k, n = k.cast("double"), n.cast("double")
    last = _ln_gamma(n + 1) - _ln_gamma(k + 1) - _ln_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    steps = F.least(k, 50 + 10 * F.sqrt(n)).cast("int")
    terms = F.aggregate(
        F.sequence(F.lit(0), steps),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda a, i: F.struct(
            (a["term"] * (k - i) / (n - k + i + 1) * ((1 - p) / p)).alias("term"),
            (a["total"] + a["term"]).alias("total"),
        ),
        lambda a: a["total"],
    )
    return F.when(k >= n * p, 1.0).otherwise(F.exp(last) * terms)


def thresholds(scored: DataFrame, labels: DataFrame, *, risk: float = RISK, confidence: float = CONFIDENCE, good_cost: float = GOOD_COST, rules: dict = RULES, n_strata: int = 2 * (len(LANGUAGES) + 1)) -> DataFrame:
    """stratum and one limit for each rule (null: the rule rejects nothing there).

    Labelled documents (quality 1 or 0) that pass the fixed rules are the
    holdout; nothing else is fitted to them. In each stratum, each rule may
    reject ``risk / rules`` of the good ones. A limit is certified when the
    exact binomial probability of as few rejected good documents as were seen,
    at that rate, is at most (1 - confidence) / (strata · rules): Bonferroni's
    correction over strata and rules. Along a rule's limits, from loose to
    strict, testing stops at the first that fails, which needs no further
    correction. Together the rules then reject at most ``risk`` of the good
    documents, in all strata at once, with the given confidence. Among certified
    limits the one with the most bad less ``good_cost`` times good documents
    rejected is taken, the loosest of equals, and none if that is not above 0.
    Few labels certify nothing, so nothing is rejected. A document labelled
    twice counts as bad if any label says so; other labels are not used.
    """
    level = (1 - confidence) / (n_strata * len(rules))
    own = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    holdout = scored.filter(~F.col("base_failed")).join(own, "doc_id")
    # from which of its rule's limits on a score is rejected; one row per rule and document, counted at once
    first = F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), _first_exceeded(F.col(r), limits).alias("first")) for r, limits in rules.items()]))
    counts = holdout.select("stratum", "quality", first).groupBy("stratum", "rule", "first").agg(
        F.sum("quality").cast("bigint").alias("good"), F.sum(1 - F.col("quality")).cast("bigint").alias("bad")
    )
    listed = counts.groupBy("stratum", "rule").agg(F.collect_list(F.struct("first", "good", "bad")).alias("c"), F.sum("good").alias("n"))
    limits = F.create_map(*[x for r, limits in rules.items() for x in (F.lit(r), F.array(*map(F.lit, limits)))])
    tried = listed.select("stratum", "rule", "n", "c", F.posexplode(F.element_at(limits, F.col("rule"))).alias("at", "cutoff")).select(
        "stratum", "rule", "n", "at", "cutoff",
        F.expr("aggregate(filter(c, x -> x.first <= at), 0L, (a, x) -> a + x.good)").alias("good"),
        F.expr("aggregate(filter(c, x -> x.first <= at), 0L, (a, x) -> a + x.bad)").alias("bad"),
    )
    tested = tried.withColumn("certified", (F.col("n") > 0) & (binomial_tail(F.col("good"), F.col("n"), risk / len(rules)) <= level))
    stopped = F.coalesce(F.expr("min(at) FILTER (WHERE NOT certified)"), F.lit(1 << 30))
    first_failed = tested.groupBy("stratum", "rule").agg(stopped.alias("stop"))
    value = F.col("bad") - good_cost * F.col("good")
    chosen = (
        tested.join(first_failed, ["stratum", "rule"]).filter(F.col("at") < F.col("stop")).filter(value > 0)
        .groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct(value, -F.col("at"))).alias("cutoff"))
    )
    return chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"{r}_limit") for r in rules])


def _first_exceeded(score: Column, limits: tuple) -> Column:
    """How many limits, from the loosest on, a score does not exceed."""
    total = F.lit(0)
    for limit in limits:
        total = total + (score <= limit).cast("int")
    return total


def quality_verdicts(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, stratum, statistics, scores, base_failed, the limits, kept.

    A document is kept if it passes the fixed rules and no score is above its
    stratum's limit. A null text counts as empty and fails; a null or unknown
    language is the stratum "other"; ids are only used to find labels, and a
    null id has none. Empty documents or labels give an empty result or no
    limits. Other columns are not looked at.

    The statistics are computed once and written. The limits have at most two
    rows per language of ``LANGUAGES`` and one more, so they are broadcast.
    """
    scored = written(features(docs, id_col=id_col, text_col=text_col, lang_col=lang_col), "quality-features")
    limits = written(thresholds(scored, labels), "quality-limits")
    judged = scored.join(F.broadcast(limits), "stratum", "left")
    within = F.lit(True)
    for rule in RULES:
        within = within & F.coalesce(F.col(rule) <= F.col(f"{rule}_limit"), F.lit(True))
    return judged.withColumn("kept", ~F.col("base_failed") & within)
