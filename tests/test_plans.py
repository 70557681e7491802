"""What the plans must look like."""

import re

import pytest
from pyspark.sql import functions as F

import golden as g
from siftmill.catalog import all_queries
from siftmill.catalog.reducing import CONFIGURATION, FLAGSHIP_CHAIN
from siftmill.catalog.views import observed
from siftmill.operators import ordered, reduce as r
from siftmill.plans.pipeline import Configuration

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def test_dedup_combines_before_its_one_shuffle(spark):
    text = plan(r.dedup(observed(spark, SF)))
    assert text.count("Exchange hashpartitioning") == 1
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text


def test_scan_reads_what_is_needed(spark):
    text = plan(r.dedup(observed(spark, SF)))
    schema = re.search(r"ReadSchema: (\S+)", text).group(1)
    assert schema == "struct<event_id:bigint,user_id:bigint,event_type:string>"


def test_flagship_shuffles_only_compacted_rows(spark):
    chain = Configuration.from_toml(CONFIGURATION).chain(FLAGSHIP_CHAIN)
    text = plan(chain(observed(spark, SF)))
    # every exchange lies above a partial aggregate or reads the result of one
    for part in text.split("Exchange hashpartitioning")[1:]:
        below = part.split("\n")[1]
        assert "Aggregate" in below or "Project" in below or "Filter" in below
    assert "Python" not in text and "Window" not in text


def test_plain_prefix_reaches_the_scan(spark, tmp_path):
    g.depot(spark).write.parquet(f"{tmp_path}/x")
    from siftmill.operators.filters import is_inside

    text = plan(spark.read.parquet(f"{tmp_path}/x").where(is_inside(F.col("Filename"), "shop")))
    assert "StringStartsWith(Filename,shop/)" in text


def test_rows_move_once_for_numbers(spark):
    df = observed(spark, SF).select("VarName", "_ord")
    text = plan(ordered.occurrence_number(df, ["VarName"]))
    # one exchange for the rows, the others for one row per key and chunk
    raw = [p for p in text.split("Exchange hashpartitioning")[1:] if "Aggregate" not in p.split("FileScan")[0].split("Exchange")[0]]
    assert len(raw) <= 2


def test_hot_key_is_split(spark):
    """A key with most of the rows: its rows go to several tasks of the join."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "32",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        rows = spark.range(0, 200_000, 1, 16)
        hot = F.when(F.col("id") % 10 < 6, 0).otherwise(F.col("id") % 5000)
        rows = rows.select(
            F.col("id").alias("_ord"), F.when(hot > 0, hot.cast("string")).alias("k"), (F.col("id") % 3).cast("string").alias("t"),
            F.md5(F.col("id").cast("string")).alias("payload"),
        )
        found = r.drop_min_threshold(rows, 0.25, sites=["k"], types=["t"])
        text = final_plan(found)
        assert "SortMergeJoin(skew=true)" in text
        assert found.count() == 200_000
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_no_python_in_built_in_queries(spark):
    with_python = {"normalize_type", "split_top_level", "normalize_type_errors"}
    for name, (query, _) in all_queries().items():
        if name.startswith(("unify_", "filter_", "chain_", "metrics_", "events_", "assign_")) and name not in with_python:
            text = plan(query(spark, SF))
            assert "Python" not in text and "ArrowEval" not in text, name
            assert "CartesianProduct" not in text and "NestedLoop" not in text, name


@pytest.mark.parametrize("name", sorted(n for n in all_queries() if n.startswith("unify_")))
def test_no_windows_over_rows(spark, name):
    assert "Window" not in plan(all_queries()[name][0](spark, SF))


def test_hints_shuffle_facts_once(spark, tmp_path):
    from siftmill.operators.hints import source_hints
    from siftmill.schemas import SOURCES
    from siftmill.sources.python_code import source_facts

    sources = spark.createDataFrame([("p", "a.py", "x: int = 1\n")], SOURCES)
    source_facts(sources).write.parquet(f"{tmp_path}/facts")
    text = plan(source_hints(spark.read.parquet(f"{tmp_path}/facts")))
    exchanges = set(re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text))
    assert all(re.fullmatch(r"project#\d+, path#\d+, 8", e) for e in exchanges)
    assert text.count("REPARTITION_BY_NUM") <= 2


def test_hints_are_placed_without_broadcasts(spark, tmp_path):
    """An exploded table is larger than its files: no side of the placement goes through the driver."""
    from siftmill.operators.placement import SITES, assign_hints
    from siftmill.schemas import OBS9

    kinds = ["string"] * 4 + ["long"] * 2 + ["string"] * 3
    path = F.concat(F.col("id").cast("string"), F.lit(".py"))
    spark.range(1000).write.parquet(f"{tmp_path}/ids")
    ids = spark.read.parquet(f"{tmp_path}/ids").select("id", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("line"))
    values = {"Filename": path, "LineNo": F.col("line"), "Category": F.lit(2), "VarName": F.lit("x")}
    rows = ids.select(*[values.get(c, F.lit(None)).cast(k).alias(c) for c, k in zip(OBS9, kinds)])
    text = plan(assign_hints(spark.createDataFrame([], SITES), rows))
    assert "Broadcast" not in text and text.count("SortMergeJoin") == 2


def test_tasks_are_dealt_few_compressed_bytes(spark):
    """24 MB of a shuffle are not read by one task, also where Spark need not keep all cores busy."""
    settings = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        rows = spark.range(0, 600_000, 1, 4).select(F.md5(F.col("id").cast("string")).alias("k"), F.md5(F.hash("id").cast("string")).alias("v"))
        assert rows.groupBy("k").agg(F.max("v").alias("v")).rdd.getNumPartitions() > 2
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_batches_for_python_are_bounded_in_bytes(spark):
    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.col("id").cast("string"), 2500).alias("text"))
    found = [row.n for row in rows.mapInArrow(sizes, "n bigint").collect()]
    assert len(found) > 1 and max(found) < 6 << 20


@pytest.fixture()
def without_broadcasts(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {name: spark.conf.get(name, None) for name in names}
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def exchanges_and_scans(text: str) -> tuple[int, int]:
    return len(re.findall(r"(?<!Reused)Exchange (?:hash|range|Round|Single)", text)), len(re.findall(r"Scan parquet|LocalTableScan|Scan ExistingRDD", text))


def test_strict_chain_scans_its_rows_once(spark, without_broadcasts, monkeypatch):
    """All jobs of the chain together: the observations are read once, and the result's plan is short."""
    from siftmill import session
    from siftmill.plans import pipeline

    plans = []

    def noted(df, purpose):
        plans.append(plan(df))
        return session.written(df, purpose)

    monkeypatch.setattr(pipeline, "written", noted)
    last = plan(all_queries()["chain_strict"][0](spark, SF))
    exchanges, scans = exchanges_and_scans(last)
    assert exchanges <= 10 and scans <= 3
    assert sum("events.parquet" in p for p in [*plans, last]) == 1
    assert sum(exchanges_and_scans(p)[0] for p in [*plans, last]) <= 24


def test_python_sees_different_names_only(spark):
    """Every Python node of the normaliser lies above an aggregate of the names, none above the base table."""
    for name in ("normalize_type", "split_top_level"):
        text = plan(all_queries()[name][0](spark, SF))
        lines = text.splitlines()
        python = [i for i, line in enumerate(lines) if "Python" in line or "ArrowEval" in line]
        assert python, name
        for i in python:
            indent = len(lines[i]) - len(lines[i].lstrip(" :+-*()0123456789"))
            below = lines[i + 1 :]
            assert "Aggregate" in "".join(below[:4]), (name, indent, text)
