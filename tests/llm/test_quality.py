import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import cases
from siftmill.llm import quality


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {p for i, w in enumerate(windows) if seen[w] > 1 for p in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), text.count("!"), len(lines), len(lines) - len(set(lines)), len(covered))


def test_statistics_against_brute_force(spark):
    texts = [r[1] for r in cases.rows()]
    texts += ["a b c d e a b c d e", "a b c d e f a b c d e", "a " * 40, "a b c d", "q w e r t y q w e r t z q w e r t", "\n\n x \n x \n", "<a|b>&c#$%*! !"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    found = frame.select("i", quality.text_statistics().alias("s")).select("i", "s.*").collect()
    assert len(found) == len(texts)
    for row in found:
        assert tuple(row)[1:] == slow(texts[row["i"]]), texts[row["i"]]


@pytest.mark.parametrize("k,n,p", [(0, 1, 0.01), (0, 800, 0.01), (3, 1000, 0.01), (9, 1000, 0.01), (480, 100_000, 0.005), (10, 20, 0.6), (0, 10, 0.5)])
def test_binomial_tail(spark, k, n, p):
    exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
    found = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
    assert math.isclose(found, exact, rel_tol=1e-8)


def limits_by_hand(scored, labels, risk, confidence):
    """The same choice in plain Python, with exact sums."""
    level = (1 - confidence) / (2 * (len(quality.LANGUAGES) + 1) * len(quality.RULES))
    p = risk / len(quality.RULES)
    chosen = {}
    for stratum in {r["stratum"] for r in scored}:
        own = [(r, labels[r["doc_id"]]) for r in scored if r["stratum"] == stratum and r["doc_id"] in labels and not r["base_failed"]]
        n = sum(q for _, q in own)
        for rule, limits in quality.RULES.items():
            best = (0, None)
            for limit in limits:
                good = sum(q for r, q in own if r[rule] > limit)
                bad = sum(1 - q for r, q in own if r[rule] > limit)
                tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(good + 1)) if good < n * p else 1
                if not n or tail > level:
                    break
                if bad - quality.GOOD_COST * good > best[0]:
                    best = (bad - quality.GOOD_COST * good, limit)
            chosen[stratum, rule] = best[1]
    return chosen


def test_thresholds_and_verdicts(spark):
    base = "alpha beta gamma delta {} epsilon zeta eta theta iota kappa lambda mu"
    rows = []
    for i in range(1500):
        words = base.format(f"n{i}")
        if i % 5 == 0:
            words = words.replace("a ", "a## ") if i % 10 else words.replace(" ", "!!! ")
        rows.append((i, words, "en" if i % 3 else "de", "s", 0))
    docs = cases.documents(spark, rows)
    # a few good ones look bad as well
    labels = {i: int(i % 5 != 0 or i % 500 == 0) for i in range(1500)}
    frame = spark.createDataFrame([(i, q, 0) for i, q in labels.items()] + [(9999, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    scored = quality.features(docs)
    found = {r["stratum"]: r for r in quality.thresholds(scored, frame, risk=0.2, confidence=0.9).collect()}
    expected = limits_by_hand(scored.collect(), labels, 0.2, 0.9)
    assert any(v is not None for v in expected.values())
    for (stratum, rule), limit in expected.items():
        assert (found[stratum][f"{rule}_limit"] if stratum in found else None) == limit, (stratum, rule)


def test_few_labels_reject_nothing(spark):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0)], "doc_id bigint, quality int, toxic int")
    own = [*quality.RULES, "stratum", "kept", "base_failed", "n_words", "s"]
    found = quality.quality_verdicts(cases.clashing(cases.documents(spark), own), labels).collect()
    assert len(found) == len(cases.rows())
    assert all(r["kept"] == (not r["base_failed"]) for r in found)


def test_only_functions_of_the_engine(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    found = quality.quality_verdicts(docs, labels)
    plans = [found, quality.features(docs), quality.thresholds(quality.features(docs), labels)]
    assert not any(re.search("Python|Pandas|Arrow", p._jdf.queryExecution().executedPlan().toString()) for p in plans)
    assert quality.quality_verdicts(cases.empty(spark), labels).collect() == []
