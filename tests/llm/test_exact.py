from collections import defaultdict

from pyspark.sql import functions as F

import cases
from siftmill.llm import exact


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[lower(text)].append(i)
    keep = {text: max((i for i in ids if i is not None), default=None) for text, ids in groups.items()}
    return sorted(((i, keep[lower(t)], len(groups[lower(t)]), i == keep[lower(t)]) for i, t, *_ in rows), key=repr)


OWN = ("id", "digest", "salt", "keep_id", "group_size", "kept", "texts")


def test_against_brute_force(spark):
    docs = cases.clashing(cases.documents(spark), OWN)
    found = exact.exact_duplicates(docs)
    assert cases.as_set(found, "doc_id", "keep_id", "group_size", "kept") == brute(cases.rows())


def test_texts_that_share_a_digest_stay_apart(spark):
    """With a digest of one of three values nearly all texts clash."""
    found = exact.exact_duplicates(cases.documents(spark), digest=lambda text: (F.length(text) % 3).cast("string"), salts=2)
    assert cases.as_set(found, "doc_id", "keep_id", "group_size", "kept") == brute(cases.rows())


def test_hot_text(spark):
    rows = [(i, "Same" if i % 3 else f"text {i}", "en", "s", 0) for i in range(3000)]
    found = exact.exact_duplicates(cases.documents(spark, rows))
    assert cases.as_set(found, "doc_id", "keep_id", "group_size", "kept") == brute(rows)


def test_local_and_salted_steps_hold_the_text_in_their_keys(spark):
    plan = exact.duplicate_groups(cases.documents(spark), text=F.col("text"))._jdf.queryExecution().sparkPlan().toString()
    keys = [line for line in plan.splitlines() if "Aggregate" in line]
    assert len(keys) == 4 and all("text#" in line.split("functions")[0] for line in keys)


def test_empty_table(spark):
    assert exact.exact_duplicates(cases.empty(spark)).collect() == []
