from urllib.parse import quote

import pytest
from pyspark.sql import functions as F, types as T

import golden as g
from siftmill.functions.hashing import content_hash
from siftmill.operators import changes, filters, timings
from siftmill.schemas import OBSERVATIONS, OBS9, ORD, SITE7, conform
from siftmill.sources import files, sinks


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("obs data")
    rows = g.depot(spark)
    rows.where(f"{ORD} < 6").drop(ORD).coalesce(1).write.parquet(f"{root}/b first")
    rows.where(f"{ORD} >= 6").drop(ORD).coalesce(1).write.parquet(f"{root}/sub/c")
    rows.select(F.col("LineNo").cast("string").alias("x")).coalesce(1).write.parquet(f"{root}/other")
    (root / "broken.parquet").write_bytes(b"no parquet")
    return str(root)


def test_scan_in_path_order(spark, folder):
    paths = [f"{folder}/b first", f"{folder}/sub/c"]
    rows = files.scan_parquet(spark, paths).orderBy(ORD).drop(ORD).collect()
    assert [tuple(r) for r in rows] == [tuple(r)[:-1] for r in g.depot(spark).orderBy(ORD).collect()]


def test_scan_is_recursive_on_request(spark, folder):
    assert files.scan_parquet(spark, f"{folder}/sub").count() == 11
    assert files.scan_parquet(spark, f"{folder}/sub/c", recursive=False).count() == 11


def test_checked_scan(spark, folder):
    rows, rejected = files.scan_checked(spark, folder)
    assert rows.count() == 17
    assert sorted(r.reason.split(":")[0] for r in rejected.collect()) == ["schema differs", "unreadable"]


def test_checked_scan_of_another_store(spark, folder):
    """A scheme that only Spark knows: footers come through its reader."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("fs.viewfs.mounttable.depot.link./in", f"file:{quote(folder)}")
    hadoop.set("fs.viewfs.impl.disable.cache", "true")
    checked = {r.file: r.reason for r in files.check_parquet_files(spark, "viewfs://depot/in").collect()}
    assert all(name.startswith("viewfs://") for name in checked)
    assert sorted(str(reason).split(":")[0] for reason in checked.values()) == ["None", "None", "schema differs", "unreadable"]


def test_a_store_that_cannot_be_reached_is_an_error(spark):
    with pytest.raises(Exception, match="nosuchstore"):
        files.scan_checked(spark, "nosuchstore://depot/in")


def test_scans_can_be_united(spark, folder):
    one = files.scan_parquet(spark, f"{folder}/b first")
    several = files.scan_parquet(spark, [f"{folder}/b first", f"{folder}/sub/c"])
    assert one.schema == several.schema
    united = one.unionByName(files.scan_parquet(spark, f"{folder}/sub/c"))
    assert g.values(united, [*OBS9, ORD]) == g.values(several, [*OBS9, ORD])


def test_nothing_to_scan(spark, folder):
    rows, rejected = files.scan_checked(spark, f"{folder}/other")
    assert rows.count() == 0 and rows.columns == [*OBS9, ORD]
    assert rejected.count() == 1


def test_text_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n{oops\n{"a": 2}\n')
    schema = T.StructType([T.StructField("a", T.LongType())])
    rows, bad = files.scan_text_rows(spark, str(tmp_path), "json", schema)
    assert [r.a for r in rows.orderBy(ORD).collect()] == [1, 2]
    assert [r.record for r in bad.collect()] == ["{oops"]
    (tmp_path / "b.csv").write_text("a\n5\nx\n")
    rows, bad = files.scan_text_rows(spark, str(tmp_path), "csv", schema, header="true")
    assert [r.a for r in rows.collect()] == [5] and bad.count() == 1


def test_sources(spark, tmp_path):
    root = tmp_path / "my tree+1"
    (root / "sub").mkdir(parents=True)
    (root / "a.py").write_text("x = 1\ny = 2\n")
    (root / "sub" / "b ä.py").write_text("z = 1\n")
    (root / "c.txt").write_text("no")
    found = files.scan_sources(spark, str(root), project="p")
    assert sorted(tuple(r) for r in found.collect()) == [("p", "a.py", "x = 1\ny = 2\n"), ("p", "sub/b ä.py", "z = 1\n")]
    assert files.scan_sources(spark, str(root), recursive=False).count() == 1
    one = files.scan_sources(spark, str(root), files=["sub/b ä.py"]).first()
    assert (one.project, one.path) == (None, "sub/b ä.py")
    with pytest.raises(Exception, match="is not under"):
        files.scan_sources(spark, str(root / "sub"), folder=str(root), recursive=False).collect()


def test_timing_percentiles_are_exact(spark):
    rows = [(f"r{i}", "full", 1.0, float(i), float(i)) for i in (1, 2, 4, 8)] + [("n", "full", 0.0, 1.0, None)]
    pairs = spark.createDataFrame(rows, "run string, series string, bare double, time double, ratio double")
    row = timings.timing_percentiles(pairs).first()
    assert [round(row[f"p{p}_ratio"], 9) for p in timings.PERCENTILES] == [1.15, 1.75, 3.0, 5.0, 7.4]


@pytest.mark.parametrize("kind", ["spread", "ties", "constant", "skewed"])
def test_percentiles_by_rank(spark, kind):
    """The same as sorting everything, while only the ratios near a rank are walked."""
    ids = spark.range(60_000)
    ratio = {"spread": F.rand(3), "ties": (F.rand(4) * 7).cast("int").cast("double"), "constant": F.lit(2.5), "skewed": F.exp(F.randn(5) * 4)}[kind]
    series = F.element_at(F.array(F.lit("no_op"), F.lit("full"), F.lit("optimised")), (F.least(F.col("id") % 10, F.lit(2)) + 1).cast("int"))
    pairs = ids.select(series.alias("series"), F.when(F.col("id") % 100 > 0, ratio).alias("ratio")).cache()
    whole = pairs.groupBy("series").agg(*[F.percentile("ratio", F.lit(p / 100)).alias(f"p{p}_ratio") for p in timings.PERCENTILES])

    def rounded(frame):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in row) for row in frame.collect())

    assert rounded(timings.timing_percentiles(pairs, whole_below=1000, slack=0.005)) == rounded(whole)
    assert rounded(timings.timing_percentiles(pairs)) == rounded(whole)


def test_timings(spark, tmp_path):
    data = [("a", [0.5, 0.75, 8.0, 2.0]), ("b", [4.0, 5.0, 40.0, 12.0]), ("short", [1.0]), ("zero", [0.0, 1.0, 1.0, 1.0])]
    spark.createDataFrame(data, "run string, times array<double>").coalesce(1).write.parquet(f"{tmp_path}/t")
    spark.createDataFrame([("c", [1.0, 1.25, 6.0, 3.0])], "run string, times array<double>").coalesce(1).write.parquet(f"{tmp_path}/t/sub")
    assert files.scan_timings(spark, f"{tmp_path}/t").count() == 3
    found = files.scan_timings(spark, f"{tmp_path}/t", recursive=True)
    assert found.count() == 4
    pairs = timings.timing_pairs(found)
    assert pairs.count() == 12
    assert pairs.where("run = 'a' AND series = 'no_op'").first().ratio == 1.5
    summary = {r.series: r for r in timings.timing_summary(pairs).collect()}
    assert set(summary) == {"no_op", "full", "optimised"}
    # ratios of full: 16, 10, 6 and none for the run without time
    assert (summary["full"].n_runs, summary["full"].p50_ratio, summary["full"].p95_ratio, summary["full"].mean_time) == (4, 10.0, 16.0, 13.75)


def test_runs_are_idempotent_and_kept_apart(spark, tmp_path):
    rows = g.depot(spark).drop(ORD).select(
        "*", F.lit("p").alias("project"), F.lit(None).cast("string").alias("test_case"), F.lit("f").alias("func_name")
    )
    for part in (rows, rows, rows.where("LineNo < 5")):
        sinks.write_observations(part, str(tmp_path))
    assert sinks.read_observation_runs(spark, str(tmp_path)).count() == 17 + 7
    assert len(list(tmp_path.glob("project=p/*/func_name=f/content_hash=*"))) == 2


def test_content_hash(spark):
    rows = g.depot(spark)

    def value(df, digest):
        return content_hash(df, OBS9, digest=digest).first().content_hash

    for digest in ("xxhash64", "md5"):
        whole = value(rows, digest)
        assert value(rows.repartition(5), digest) == whole
        assert value(rows.where("_ord > 0"), digest) != whole
        moved = rows.withColumn("ClassModule", F.col("Class")).withColumn("Class", F.lit(None).cast("string"))
        assert value(moved, digest) != whole


def test_conform(spark):
    rows = g.depot(spark)
    assert conform(rows.withColumn("LineNo", F.col("LineNo").cast("string")), OBSERVATIONS).schema["LineNo"].dataType == T.LongType()
    with pytest.raises(Exception, match="LineNo is negative"):
        conform(rows.withColumn("LineNo", F.lit(-1)), OBSERVATIONS).collect()


def test_changed_snapshots(spark):
    data = [(0, "x", 1, 0), (1, "y", 1, 0), (2, "x", 1, 1), (3, "x", 1, 2), (4, "y", 1, 2), (5, "x", 2, 3), (6, "x", None, 4), (7, "x", None, 5)]
    df = spark.createDataFrame(data, "_ord long, name string, value long, snap long").withColumn("scope", F.lit("s"))
    found = changes.changed_values(df, ["scope"], "name", "value", snapshot="snap")
    assert g.orders(found) == [0, 1, 4, 5, 6]
    assert g.orders(changes.changed_values(df, ["scope"], "name", "value")) == [0, 1, 5, 6]


def test_lines(spark):
    df = spark.createDataFrame([(i, "c", 10 + i) for i in range(4)], "_ord long, call string, LineNo long")
    rows = changes.attributed_lines(df, ["call"], chunk_rows=1).orderBy(ORD).collect()
    assert [r.AttributedLine for r in rows] == [10, 10, 11, 12]


def test_flatten_updates(spark):
    schema = "Filename string, ClassModule string, Class string, FunctionName string, LineNo long, Category long, names2types map<string,struct<module:string,type:string>>"
    batches = [("a.py", "m", "C", "f", 7, c, {"x": (None, "int"), "y": ("m", "T")}) for c in range(1, 6)] + [("a.py", "m", "C", "f", 7, 4, {})]
    rows = changes.flatten_updates(spark.createDataFrame(batches, schema)).where("VarName = 'x'").orderBy("Category").collect()
    assert [tuple(r[c] for c in SITE7[1:5]) for r in rows] == [
        ("m", "C", "f", 7), ("m", "C", "f", 7), ("m", "C", "f", 0), ("m", "C", None, 0), (None, None, None, 0),
    ]


def test_pytest_signs(spark):
    data = [
        ("ini", "pytest.ini", ""), ("deep", "sub/pytest.ini", ""), ("section", "pyproject.toml", "[tool.pytest.ini_options]\n"),
        ("dev", "pyproject.toml", '[tool.poetry.dev-dependencies]\nblack = {version = "1", extras = ["d"]}\npytest = "7"\n'),
        ("main", "pyproject.toml", '[tool.poetry.dev-dependencies]\nmypy = "1"\n[tool.poetry.dependencies]\npytest = "7"\n'),
        ("req", "requirements-dev.txt", "a\npytest==7\n"), ("indent", "requirements.txt", "a\n pytest\n"),
        ("table", "pyproject.toml", '[tool.poetry.dev-dependencies.pytest]\nversion = "7"\n'),
        ("inline", "pyproject.toml", '[tool.poetry]\ndev-dependencies = {pytest = "7"}\n'),
        ("dotted", "pyproject.toml", "[tool]\npytest.ini_options.addopts = '-q'\n"),
        ("text", "pyproject.toml", 'about = """\n[tool.pytest]\n"""\n'), ("broken", "pyproject.toml", "[tool.pytest\n"),
        ("odd", "pyproject.toml", "tool = 1\n"), ("nothing", "pyproject.toml", None),
    ]
    found = filters.projects_using_pytest(spark.createDataFrame(data, "project string, path string, content string"))
    assert {r.project for r in found.collect() if r.uses_pytest} == {
        "ini", "section", "dev", "req", "table", "inline", "dotted",
    }
