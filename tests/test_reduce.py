import random
import re

import pytest
from pyspark.sql import functions as F

import golden as g
from siftmill.operators import filters, reduce as r
from siftmill.plans.pipeline import Chain
from siftmill.schemas import HIERARCHY, OBS9, ORD, SITE6, SITE7, WEIGHT


@pytest.fixture(scope="module")
def rows(spark):
    return g.depot(spark).cache()


@pytest.fixture(scope="module")
def bases(spark):
    return g.hierarchy(spark).cache()


def test_dedup(rows):
    assert g.orders(r.dedup(rows)) == [0, 1, 3, 5, 6, 9, 10, 11, 16]


def test_compact_keeps_multiplicity(rows):
    compacted = r.compact(rows)
    assert {row[ORD]: row[WEIGHT] for row in compacted.collect()}[11] == 5
    assert g.values(r.expand(compacted, copies_per_row=3)) == g.values(rows)


def test_compact_is_mergeable(rows):
    even = F.col(ORD) % 2 == 0
    parts = r.compact(rows.where(even)).unionByName(r.compact(rows.where(~even)))
    assert g.values(r.compact(parts), [*OBS9, ORD, WEIGHT]) == g.values(r.compact(rows), [*OBS9, ORD, WEIGHT])


def test_min_threshold(rows):
    # next to the most frequent type of its site: a Truck is one to three in the fleet, a Bike one to five
    assert g.orders(r.drop_min_threshold(rows)) == list(range(16))
    assert g.orders(r.drop_min_threshold(rows, 0.15)) == list(range(17))
    assert g.orders(r.drop_min_threshold(rows, 0.2)) == list(range(16))
    assert g.orders(r.drop_min_threshold(rows, 0.4)) == [i for i in range(16) if i != 6]


def test_min_threshold_of_five_to_one(spark):
    rows = g.one_site(spark, *[(None, "int")] * 5, (None, "str"))
    assert g.orders(r.drop_min_threshold(rows, 0.3)) == [0, 1, 2, 3, 4]
    # a dedup before takes the counts away
    assert len(g.orders(r.drop_min_threshold(r.dedup(rows), 0.3))) == 2


def test_drop_test(rows):
    assert g.orders(filters.drop_test_functions(rows, "test_")) == list(range(11))
    assert g.orders(filters.drop_test_functions(rows, "u.*d$")) == [*range(9), *range(11, 17)]
    # only matches at the start count
    assert g.orders(filters.drop_test_functions(rows, "load")) == list(range(5, 17))


@pytest.mark.parametrize("pattern", ["(?P<n>a)", "(?a)x", "(", "(?x)a b", r"\0", "(a)?(?(1)b|c)", r"\U0001F600"])
def test_patterns_java_reads_differently(rows, pattern):
    with pytest.raises(Exception):
        filters.drop_test_functions(rows, pattern)


@pytest.mark.parametrize(
    "pattern",
    [r"test\Z", "test$", "[a-z&&b]x", "[[]x", "[^&&]", "te.t", r"t{,2}e", r"\w+\Z", "[]a]x", "(?i)TEST", r"[\]\[]x", r"a\[&&b]"],
)
def test_patterns_mean_what_they_mean_in_python(spark, pattern):
    texts = ["test", "test\n", "ax", "&x", "bx", "[x", "]x", "te\rt", "tte", "tt", "é", "zx", "test\r", "test\u2028", "a[&&b]"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    found = {r.t for r in frame.where(filters.starts_with_match(F.col("t"), pattern)).collect()}
    assert found == {t for t in texts if re.match(pattern, t)}


def test_pattern_is_needed(rows):
    with pytest.raises(ValueError):
        filters.drop_test_functions(rows, None)


def test_drop_mult_var(rows):
    assert g.orders(r.drop_mult_var(rows)) == [3, 4]


def test_drop_mult_var_three(spark):
    four = g.one_site(spark, (None, "int"), (None, "str"), (None, "bool"), (None, "float"))
    two = g.one_site(spark, (None, "int"), (None, "int"), (None, "str"), start=4).withColumn("VarName", F.lit("y"))
    assert g.orders(r.drop_mult_var(four.unionByName(two), 3)) == [4, 5, 6]


def test_drop_mult_var_modules(spark):
    rows = g.one_site(spark, (None, "int"), ("codec", "Png"))
    assert g.orders(r.drop_mult_var(rows)) == [0, 1]
    assert g.orders(r.drop_mult_var(rows, count_across_modules=True)) == []


def test_keep_only_first(rows, spark):
    first = r.keep_only_first(rows)
    assert g.orders(first) == [0, 3, 5, 9, 11]
    assert g.values(first) == g.expected(spark, [0, 3, 5, 9, 11])


@pytest.mark.parametrize("chunk_rows", [2, 100])
def test_union(rows, chunk_rows):
    united = {row["VarName"]: row for row in r.union(rows, chunk_rows=chunk_rows).collect()}
    assert {k: v["Type"] for k, v in united.items()} == {
        name: " | ".join(types) for *_, name, types in g.DEPOT
    }
    assert united["vehicle"]["TypeModule"] == ",".join([g.MODULE] * 3)


def test_union_distinct(rows):
    united = {row["VarName"]: row["Type"] for row in r.union(rows, distinct=True).collect()}
    assert united["vehicle"] == "Truck | Van"
    assert united["spare"] == "Bike"


def test_union_of_builtins(spark):
    rows = g.one_site(spark, (None, "int"), (None, "str"), ("codec", "Png"))
    row = r.union(rows).collect()[0]
    assert (row["TypeModule"], row["Type"]) == (",,codec", "int | str | Png")
    only = r.union(g.one_site(spark, (None, "int"), (None, "str"))).collect()[0]
    assert only["TypeModule"] == ","


def test_union_leaves_single_rows(spark):
    row = r.union(g.one_site(spark, (None, "int"))).collect()[0]
    assert (row["TypeModule"], row["Type"]) == (None, "int")


def test_union_across_files(spark):
    rows = g.one_site(spark, (None, "int"), file="a.py").unionByName(
        g.one_site(spark, (None, "str"), file="b.py", start=1)
    )
    assert sorted((x["Filename"], x["Type"]) for x in r.union(rows).collect()) == [
        ("a.py", "int | str"),
        ("b.py", "int | str"),
    ]
    assert sorted(x["Type"] for x in r.union(rows, include_file=True).collect()) == ["int", "str"]


def test_union_refuses_multiplicities(rows):
    with pytest.raises(ValueError):
        r.union(r.compact(rows))


def types_of(df):
    return {(row["VarName"], row["Type"]) for row in df.collect()}


def test_subtypes_strict(rows, bases):
    assert types_of(r.unify_subtypes(rows, bases, True)) == {
        # nobody saw a Vehicle as such, but there was a Truck
        ("vehicle", "Truck"),
        ("vehicle", "Van"),
        ("spare", "Bike"),
        ("fleet", "Truck"),
        ("queue", "Van"),
        ("queue", "Tanker"),
        ("dummy", "Van"),
        ("dummy", "Bike"),
    }


def test_subtypes_relaxed(rows, bases):
    assert types_of(r.unify_subtypes(rows, bases)) == {
        ("vehicle", "Vehicle"),
        ("spare", "Bike"),
        ("fleet", "Truck"),
        ("queue", "Vehicle"),
        ("dummy", "Vehicle"),
    }


@pytest.mark.parametrize(
    ("seen", "strict", "relaxed"),
    [
        ([(None, "int"), (None, "str")], {(None, "int"), (None, "str")}, None),
        ([(None, "int"), ("units", "Metres")], {(None, "int")}, None),
        (
            [("codec", "Png"), ("codec", "Jpeg")],
            {("codec", "Png"), ("codec", "Jpeg")},
            {("codec", "Raster")},
        ),
        ([("views", "Panel"), (None, "int")], {("views", "Panel"), (None, "int")}, None),
    ],
)
def test_subtypes_cases(spark, bases, seen, strict, relaxed):
    rows = g.one_site(spark, *seen)
    found = r.unify_subtypes(rows, bases, True).collect()
    assert {(x["TypeModule"], x["Type"]) for x in found} == strict
    found = r.unify_subtypes(rows, bases).collect()
    assert {(x["TypeModule"], x["Type"]) for x in found} == (relaxed or strict)


def test_unknown_type(spark, bases):
    rows = g.one_site(spark, ("nowhere", "Thing"), (None, "int"))
    with pytest.raises(Exception, match="not in the hierarchy"):
        r.unify_subtypes(rows, bases).collect()
    assert len(r.unify_subtypes(rows, bases, on_unknown="keep").collect()) == 2


def test_chain_of_five(rows, bases, spark):
    chain = (
        Chain()
        .append("drop_test", test_name_pat="test_")
        .append("dedup")
        .append("unify_subty", only_unify_if_base_was_traced=True)
        .append("dedup")
        .append("drop_mult_var")
    )
    for compacted in (True, False):
        assert g.values(chain(rows, bases, compacted=compacted)) == g.expected(spark, [3, 6])


def test_conflicts(rows):
    deduplicated = r.dedup(rows)
    assert r.conflicts(deduplicated, SITE7).count() == 4
    with pytest.raises(Exception, match="more than one hint"):
        r.require_unique(deduplicated, SITE7).collect()
    assert r.require_unique(r.keep_only_first(rows), SITE7).count() == 5


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_results_do_not_depend_on_partitions(rows, bases, partitions):
    spread = rows.repartition(partitions)
    for operator in (
        r.dedup,
        r.drop_min_threshold,
        r.drop_mult_var,
        r.keep_only_first,
        r.union,
        lambda df: r.unify_subtypes(df, bases),
    ):
        assert g.values(operator(spread), [*OBS9, ORD]) == g.values(operator(rows), [*OBS9, ORD])


def test_dedup_is_idempotent(rows):
    once = r.dedup(rows)
    assert g.values(r.dedup(once), [*OBS9, ORD]) == g.values(once, [*OBS9, ORD])


@pytest.mark.parametrize("salts", [1, 3, 64])
def test_common_bases_of_wide_sites(spark, salts):
    """Sites with up to 200 types against the definition, list by list."""
    dice = random.Random(salts)
    names = [f"T{i}" for i in range(300)]
    lists = {}
    for i, name in enumerate(names):
        above = dice.sample(names[max(0, i - 12) : i], k=min(i, dice.randint(0, 3)))
        seen = []
        for parent in above:
            seen += [b for b in lists[parent][1:-1] + [] if b not in seen]
            seen = [parent] + [b for b in seen if b != parent] if parent not in seen else seen
        lists[name] = [name, *seen, "object"]
    table = [("m", n, [("abc" if b == "T3" else "m", b) for b in bases]) for n, bases in lists.items()]
    hierarchy = spark.createDataFrame(table, HIERARCHY)
    rows, wanted = [], {}
    for site, size in enumerate([1, 2, 2, 3, 5, 40, 200]):
        start = dice.choice([0, 50, 200])
        own = dice.sample(names[start : start + max(size, 30)] if size < 100 else names, k=size)
        first = {t: len(rows) + k for k, t in enumerate(own)}
        rows += [("a.py", None, None, "f", 1, 2, f"v{site}", "m", t, at) for t, at in first.items()]
        kept = {t: [(("abc" if b == "T3" else "m"), b) for b in lists[t][:-1] if b != "T3"] for t in own}
        shortest = kept[min(own, key=lambda t: (len(kept[t]), first[t]))]
        base = next((b for b in shortest if all(b in k for k in kept.values())), None)
        if base:
            wanted[f"v{site}"] = (base, size)
    found = r.common_bases(spark.createDataFrame(rows, g.ORDERED), hierarchy, SITE6, salts=salts)
    assert {x.VarName: (tuple(x.base), x.n_types) for x in found.collect()} == wanted
    assert len(wanted) >= 2


def test_written_steps_change_nothing(rows, bases):
    chain = (
        Chain()
        .append("drop_test", test_name_pat="test_")
        .append("drop_min_threshold", min_threshold=0.3)
        .append("dedup")
        .append("unify_subty", only_unify_if_base_was_traced=True)
        .append("drop_mult_var")
        .append("union")
    )
    assert g.values(chain(rows, bases, written_steps=True)) == g.values(chain(rows, bases))


@pytest.mark.parametrize("distinct", [False, True])
def test_members_written_out_are_the_union(rows, distinct):
    united, too_large = r.union_members(rows, distinct)
    assert too_large.isEmpty()
    assert g.values(r.member_text(united), [*OBS9, ORD]) == g.values(r.union(rows, distinct), [*OBS9, ORD])


def test_sites_with_too_many_members(rows):
    united, too_large = r.union_members(rows, most=3)
    assert {(x.VarName, x.n_members, x.error) for x in too_large.collect()} == {("fleet", 4, "more members than 3"), ("dummy", 6, "more members than 3")}
    text = {x.VarName: x.Type for x in r.member_text(united).collect()}
    assert text == {"vehicle": "Truck | Van | Truck", "spare": "Bike | Bike", "queue": "Van | Tanker"}
    with pytest.raises(ValueError):
        r.union_members(r.compact(rows))
