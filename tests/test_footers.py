import random
import shutil
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F, types as T

import golden as g
from siftmill.schemas import OBSERVATIONS, ORD
from siftmill.session import CHECKPOINT_SETTING, folder_exists, scratch, written
from siftmill.sources import files, footers


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("foot notes")
    rows = g.depot(spark).drop(ORD)
    rows.coalesce(1).write.parquet(f"{root}/a b+c%d")
    rows.coalesce(1).write.parquet(f"{root}/sub/day=1")
    rows.select(F.col("LineNo").cast("string").alias("x")).coalesce(1).write.parquet(f"{root}/other")
    (root / "broken.parquet").write_bytes(b"no parquet")
    (root / "empty.parquet").write_bytes(b"")
    cut = next((root / "sub" / "day=1").glob("*.parquet")).read_bytes()
    (root / "cut.parquet").write_bytes(cut[: len(cut) // 2])
    (root / "_hidden").mkdir()
    (root / "_hidden" / "x.parquet").write_bytes(b"not looked at")
    (root / "notes.txt").write_text("not looked at")
    return str(root)


def verdicts(frame):
    return [(r.file.rsplit("/", 1)[-1].split("-")[0], r.rows, r.reason) for r in frame.collect()]


WANTED = [
    ("broken.parquet", None, "unreadable: ArrowInvalid"),
    ("cut.parquet", None, "unreadable: ArrowInvalid"),
    ("empty.parquet", None, "unreadable: ArrowInvalid"),
    ("part", 17, "schema differs"),
    ("part", 17, None),
    ("part", 17, None),
]


def test_verdicts(spark, folder):
    found = footers.footers(spark, folder, OBSERVATIONS)
    assert sorted(verdicts(found), key=repr) == sorted(WANTED, key=repr)
    sizes = {r.file: r.bytes for r in found.collect()}
    assert len(sizes) == 6 and min(sizes.values()) == 0


def test_no_limit_on_the_size_of_a_file(spark, folder):
    """Whole files may not be read at all here; footers are."""
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1")
    try:
        checked = files.check_parquet_files(spark, folder).collect()
        assert len(checked) == 6 and sum(r.reason is None for r in checked) == 2
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_only_the_end_of_a_file_is_read(spark, tmp_path):
    """The first half of a large file is overwritten: its footer still says what it holds."""
    noise = spark.range(200_000).select(F.col("id").alias("a"), F.rand(1).alias("b"))
    noise.coalesce(1).write.parquet(str(tmp_path / "big"))
    path = next((tmp_path / "big").glob("*.parquet"))
    data = bytearray(path.read_bytes())
    data[4 : len(data) // 2] = bytes(len(data) // 2 - 4)
    path.write_bytes(data)
    for crc in (tmp_path / "big").glob(".*.crc"):
        crc.unlink()
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType())])
    assert [(r.rows, r.reason) for r in footers.footers(spark, str(tmp_path / "big"), schema).collect()] == [(200_000, None)]


def test_refused_files_are_never_opened(spark, folder):
    rows, refused = files.scan_checked(spark, folder)
    assert spark.conf.get("spark.sql.files.ignoreCorruptFiles") == "false"
    assert rows.count() == 34 and refused.count() == 4
    folders = {r.file.rsplit("/", 2)[1] for r in rows.select(f"{ORD}.file").distinct().collect()}
    assert folders == {"a%20b+c%25d", "day=1"}


def test_names_of_accepted_files_stay_off_the_driver(spark, folder, tmp_path):
    """Where all files fit, the plan holds no name of a file at all."""
    target = tmp_path / "good"
    for part in range(5):
        g.depot(spark).drop(ORD).coalesce(1).write.mode("append").parquet(str(target))
    rows, refused = files.scan_checked(spark, str(target))
    text = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "part-" not in text and rows.count() == 85 and refused.count() == 0


def test_glob_and_folders(spark, folder):
    assert len(footers.footers(spark, folder, OBSERVATIONS, recursive=False).collect()) == 3
    assert len(footers.footers(spark, folder, OBSERVATIONS, glob="{broken,cut}.par*").collect()) == 2
    one = f"{folder}/cut.parquet"
    assert [r.file.rsplit("/", 1)[-1] for r in footers.footers(spark, one, OBSERVATIONS).collect()] == ["cut.parquet"]


def test_mount_tables_are_followed(spark, folder):
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("fs.viewfs.mounttable.notes.link./in", f"file:{quote(folder)}")
    hadoop.set("fs.viewfs.impl.disable.cache", "true")
    found = footers.footers(spark, "viewfs://notes/in", OBSERVATIONS)
    assert all(r.file.startswith("viewfs://notes/in/") for r in found.collect())
    assert sorted(verdicts(found), key=repr) == sorted(WANTED, key=repr)
    rows, refused = files.scan_checked(spark, "viewfs://notes/in")
    assert rows.count() == 34 and refused.count() == 4


def test_system_errors_fail(spark, folder, tmp_path):
    with pytest.raises(Exception, match="does not exist"):
        footers.footers(spark, f"{folder}/nowhere", OBSERVATIONS).collect()
    gone = tmp_path / "gone"
    g.depot(spark).drop(ORD).coalesce(1).write.parquet(str(gone))
    reader = footers.FooterReader({"root": f"file://{gone}", "shown": str(gone), "wanted": "[]"})
    planned = reader.partitions()
    shutil.rmtree(gone)
    with pytest.raises(OSError):
        list(reader.read(planned[0]))


def test_addresses_arrow_does_not_know(spark):
    assert footers._ARROW_SCHEMES.get("nosuchstore") is None
    with pytest.raises(Exception, match="nosuchstore"):
        footers.arrow_address(spark, "nosuchstore://depot/in")


def test_tasks_are_planned_by_size():
    dice = random.Random(1)
    listed = [(f"f{i:05}", dice.choice([100, 10_000_000, 5_000_000_000])) for i in range(3000)]
    tasks = footers.plan_tasks(listed)
    assert [f for task in tasks for f in task.files] == listed
    costs = [sum(footers.OPEN_COST + size // footers.FOOTER_SHARE for _, size in task.files) for task in tasks]
    assert max(costs) <= footers.TASK_COST and min(costs[:-1]) > footers.TASK_COST * 0.6
    assert footers.plan_tasks([("huge", 1 << 50)])[0].files == [("huge", 1 << 50)]
    assert footers.plan_tasks([]) == []


def test_scratch_folders_are_removed(spark):
    with scratch(spark) as folder:
        table = written(spark.range(5), "t")
        assert table.count() == 5 and folder_exists(spark, folder)
        assert all(folder in f for f in table.inputFiles())
    assert not folder_exists(spark, folder)
    assert written(spark.range(5), "t").count() == 5
    assert spark.conf.get(CHECKPOINT_SETTING)
