import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import cases
from siftmill.llm import merkle, queries


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row):
    i, text, lang, source, n = row
    return h("".join(map(field, (i, source, lang, n, text))))


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([h("".join(found[-1][k : k + 3])) for k in range(0, len(found[-1]), 3)])
    return found


def siblings(tree, at):
    for level in tree[:-1]:
        run = at // 3 * 3
        yield level[run:at], level[at + 1 : run + 3]
        at //= 3


def tampered(row):
    i, text, *rest = row
    if i is not None and text is not None and zlib.crc32(str(i).encode()) % 2 == 0:
        text = text.replace("\n", "")
    return (i, text, *rest)


def brute(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified by walking whole trees."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[3]].append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in order}
    trees = {s: levels([leaf(r) for r in ordered[s]]) for s in order}
    top = levels([trees[s][-1][0] for s in order]) if order else None
    found = []
    for number, source in enumerate(order):
        for at, row in enumerate(ordered[source]):
            steps = [*siblings(trees[source], at), *siblings(top, number)]
            node = leaf(tampered(row))
            for left, right in steps:
                node = h("".join([*left, node, *right]))
            proof = h("".join("".join([*left, *right]) for left, right in steps))
            root = top[-1][0]
            found.append((row[0], leaf(row), trees[source][-1][0], root, proof, node, node == root))
    return sorted(found, key=repr)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
OWN = ("tree", "node", "changed", "idx", "n", "block", "members", "steps", "path", "leaf", "root", "subroot", "member", "_at", "_part", "_read", "a0")


def found(docs):
    breaks = F.translate("text", "\n", "")
    result = merkle.manifest(docs, tampered=F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, breaks).otherwise(F.col("text")))
    return cases.as_set(result.withColumn("proof_sha256", F.sha2(merkle.proof_text(F.col("path")), 256)), *COLUMNS)


def test_cases_against_whole_trees(spark):
    assert found(cases.clashing(cases.documents(spark), OWN)) == brute(cases.rows())


@pytest.mark.parametrize("sizes", [[1], [3, 4, 9, 2, 1], [27, 28, 1, 81, 82], [760, 3]])
def test_trees_of_all_heights(spark, sizes):
    rows = [(100 * i + k, f"text {k}\nend {i}", "en", None if k == 0 else f"s{k}", i) for k, size in enumerate(sizes) for i in range(size)]
    random.Random(1).shuffle(rows)
    assert found(cases.documents(spark, rows)) == brute(rows)


def test_many_sources(spark):
    """The tree of sources has several stored levels of its own; bytes, not letters, order it."""
    names = ["", "-", "=", "A", "a", "é", "日本", "\U0001f600", "￮", *[f"n{i}" for i in range(100)]]
    rows = [(i, f"a\n{i}", None, name, i) for i, name in enumerate(names)] + [(1000, None, "en", None, None)]
    assert found(cases.documents(spark, rows)) == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "same\n", "en", "hot", 1)] * 40 + [(7, "same\n", "en", "hot", 1)] * 40 + [(7, "other", "en", "hot", 1)] * 5
    # equal rows get the proofs of their places, whichever of them gets which
    assert found(cases.documents(spark, rows)) == brute(rows)


def test_only_tampered_texts_fail(spark):
    rows = [(i, "one line" if i % 3 else "two\nlines", "en", "s", 1) for i in range(200)]
    failed = {i for i, *_, verified in found(cases.documents(spark, rows)) if not verified}
    assert failed == {i for i in range(200) if i % 3 == 0 and zlib.crc32(str(i).encode()) % 2 == 0}


def test_stored_levels_only(spark):
    """Of the levels 0 to 6 of 700 leaves, those at 0 and 3 are stored, and 6 is the root."""
    docs = cases.documents(spark, [(i, str(i), "en", "s", 1) for i in range(700)])
    forest = merkle.Forest(merkle.numbered(merkle.leaves(docs), ["doc_id"], "t"), "t", ["doc_id", "changed"])
    assert [kept.select(F.sum(F.size("members"))).first()[0] for kept in forest.stored] == [700, 26]
    assert forest.roots.count() == 1


def test_numbers_spread_a_hot_tree(spark):
    nodes = spark.range(40_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("tree"), F.col("id").alias("doc_id"), F.lit("x").alias("node"))
    rows = merkle.numbered(nodes, ["doc_id"], "t")
    wrong = rows.withColumn("by_window", F.expr("row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1"))
    assert wrong.filter("idx <> by_window").isEmpty()
    assert rows.filter("tree = 'hot'").select(F.spark_partition_id()).distinct().count() >= 1


def test_empty_table(spark):
    assert found(cases.empty(spark)) == []


def test_query_on_a_table(spark, tmp_path):
    rows = [(i, f"line\n{i}", "en", f"s{i % 4}", i) for i in range(100)]
    cases.documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    assert cases.as_set(queries.op11_merkle(spark, str(tmp_path)), *COLUMNS) == brute(rows)
