import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F, types as T

import golden as g
from siftmill.operators import changes, reduce as r
from siftmill.schemas import OBS9, ORD, WEIGHT
from siftmill.session import shared_folder
from siftmill.streaming import batches, replay, stream as s

SCHEMA = T.StructType(
    [
        T.StructField(ORD, T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("scope", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Three files; within a file and between neighbours rows are out of order."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=i), "s" + str(i % 2), "v" + str(i % 3), "abc"[i // 7 % 3]) for i in range(60)]
    order = sorted(range(60), key=lambda i: (i + (i * 7) % 11) // 20)
    folder = str(tmp_path_factory.mktemp("stream") / "in")
    for part in range(3):
        chosen = [rows[i] for i in order[part * 20 : part * 20 + 20]]
        spark.createDataFrame(chosen, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_late_events_are_replayed_in_order(spark, events):
    stream = s.read_stream(spark, events, SCHEMA, files_per_batch=1)
    found = s.run_to_end(replay.changed_values_stream(stream, ["scope", "name"], "value", ORD, "ts", "20 seconds"))
    batch = changes.changed_values(spark.read.schema(SCHEMA).parquet(events), ["scope"], "name", "value")
    # the last 20 seconds still wait for the watermark
    assert g.orders(found) == [i for i in g.orders(batch) if i <= 59 - 20]


def test_rows_that_wait_are_stored_by_one_call():
    """No frame is built for a key, neither of its rows nor of the results it doesn't have yet."""
    from unittest.mock import MagicMock

    from pyspark.sql import Row, types as T

    fields = T.StructType().add("x_ord", T.LongType()).add("xvalue", T.DoubleType()).add("x__time_ms", T.LongType())
    processor = replay._Changes(["xk"], fields, "x_ord", 10, value="xvalue")
    processor.handle, processor.waiting = MagicMock(), MagicMock()
    rows = [Row(xk="a", x_ord=2, xvalue=float("nan"), x__time_ms=20), Row(xk="a", x_ord=1, xvalue=None, x__time_ms=10)]
    assert list(processor.handleInputRows(("a",), iter(rows), None)) == []
    processor.waiting.appendList.assert_called_once_with([(2, None, 20), (1, None, 10)])
    processor.handle.registerTimer.assert_called_once_with(10)


class Entries(dict):
    """A map state; ``most`` is the length of its largest entry."""

    most = 0

    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self.most = max(self.most, len(value[0]))
        self[key] = value

    def removeKey(self, key):
        self.pop(key, None)


@pytest.mark.parametrize("fan", [2, 5])
def test_waiting_rows_of_a_key_are_sorted_runs(monkeypatch, fan):
    """Rows are taken in order whatever they were cut into; what lies in memory or in an entry doesn't grow with them."""
    monkeypatch.setattr(replay, "BLOCK_BYTES", 300)
    monkeypatch.setattr(replay, "FAN", fan)
    entries, dice = Entries(), random.Random(fan)
    handle = type("Handle", (), {"getMapState": lambda self, *_: entries})()
    opened, most = set(), 0
    drain = replay._Waiting._drain

    def counted(self, run, until):
        nonlocal most
        for row in drain(self, run, until):
            opened.add(id(run))
            most = max(most, len(opened))
            yield row
        opened.discard(id(run))

    monkeypatch.setattr(replay._Waiting, "_drain", counted)
    waiting, wanted, taken = replay._Waiting(handle, 0), [], []
    for part in range(60):
        # late rows, copies and rows of one time that come in another order
        times = [part * 10 + dice.randint(0, 200) for _ in range(dice.choice([1, 3, 40]))]
        rows = [(dice.randint(0, 5), f"{part} {n}", ms) for n, ms in enumerate(times)]
        waiting.appendList(rows)
        wanted += rows
        if part % 7 == 6:
            before = len(taken)
            taken += waiting.take(part * 10)
            wanted, due = [r for r in wanted if r[-1] > part * 10], [r for r in wanted if r[-1] <= part * 10]
            assert taken[before:] == sorted(due, key=lambda row: (row[-1], row[0]))
            assert waiting.earliest == min(row[-1] for row in wanted)
    assert list(waiting.take(10**6)) == sorted(wanted, key=lambda row: (row[-1], row[0]))
    assert waiting.earliest is None and not entries
    assert entries.most < 1500 and most <= fan * 5


def test_rows_of_a_key_are_not_gathered(monkeypatch):
    """A long key goes to the state slice by slice, and its results come out while its rows are read."""
    from unittest.mock import MagicMock

    from pyspark.sql import Row

    monkeypatch.setattr(replay, "RUN_BYTES", 5000)
    fields = T.StructType().add("x_ord", T.LongType()).add("xvalue", T.StringType()).add("x__time_ms", T.LongType())
    processor = replay._Changes(["xk"], fields, "x_ord", 10, value="xvalue")
    processor.handle, processor.waiting, processor.memory, processor.latest = (MagicMock() for _ in range(4))
    rows = [Row(xk="a", x_ord=i, xvalue=f"value {i}", x__time_ms=i + 3) for i in range(2000)]
    assert list(processor.handleInputRows(("a",), iter(rows), None)) == []
    stored = [call.args[0] for call in processor.waiting.appendList.call_args_list]
    assert len(stored) > 5 and max(map(len, stored)) < 400
    assert [row for part in stored for row in part] == [tuple(row)[1:] for row in rows]
    processor.handle.registerTimer.assert_called_once_with(3)

    read = []
    processor.memory.get.return_value = None
    processor.waiting.take = lambda until: (read.append(row) or row for part in stored for row in part)
    found = processor.handleExpiredTimer(("a",), MagicMock(), None)
    assert next(found) == Row("xk", "x_ord", "xvalue")("a", 0, "value 0") and len(read) == 1


def test_results_leave_a_task_in_parts(monkeypatch):
    import io

    import pyarrow as pa
    from pyspark import cloudpickle
    from pyspark.sql import Row
    from pyspark.sql.pandas import serializers

    kind = serializers.TransformWithStateInPySparkRowSerializer
    monkeypatch.setattr(kind, "dump_stream", kind.dump_stream)
    processor = replay._Changes(["xk"], T.StructType(), "x_ord", 10, value="xvalue")
    cloudpickle.loads(cloudpickle.dumps(processor))  # as a worker does
    shown, given = Row("a", "b"), pa.struct([("a", pa.int64()), ("b", pa.string())])
    results = [[], [shown(i, str(i)) for i in range(2500)], [shown(None, None)]]
    stream = io.BytesIO()
    kind(10).dump_stream(iter([[(iter(rows), given)] for rows in results]), stream)
    stream.seek(4)  # after the mark of the start
    batches_found = list(pa.ipc.open_stream(stream))
    assert [batch.num_rows for batch in batches_found] == [1000, 1000, 500, 1]
    found = [tuple(row["_0"].values()) for batch in batches_found for row in batch.to_pylist()]
    assert found == [tuple(row) for rows in results for row in rows]
    monkeypatch.setattr(replay, "RUN_BYTES", 100)
    assert [len(part) for part in replay._parts(shown(1, "x" * n) for n in (30, 30, 40, 1, 500))] == [3, 2]


def test_a_hot_loop_in_many_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(replay, "BLOCK_BYTES", 500)
    monkeypatch.setattr(replay, "RUN_BYTES", 2000)
    monkeypatch.setattr(replay, "FAN", 3)
    start = dt.datetime(2024, 1, 1)
    kinds = T.StructType([*LOOP.fields, T.StructField("ts", T.TimestampNTZType())])
    rows = [(*row, start + dt.timedelta(seconds=row[0])) for row in loop_rows(5, 1500)]
    order = sorted(range(1500), key=lambda i: (i + (i * 7) % 101) // 500)  # late by 100 rows
    for a in range(0, 1500, 500):
        chosen = [rows[i] for i in order[a : a + 500]]
        spark.createDataFrame(chosen, kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = s.read_stream(spark, f"{tmp_path}/in", kinds, files_per_batch=1)
    found = s.run_to_end(
        replay.until_stable_loops_stream(stream, ["loop"], "is_head", ["what"], ORD, "ts", until_stable=3, delay="200 seconds")
    )
    numbered = changes.numbered_iterations(spark.createDataFrame(rows, kinds), ["loop"], "is_head")
    numbered = numbered.withColumn("iteration", F.when(F.col("iteration") >= 0, F.col("iteration")))
    wanted = changes.until_stable_loops(numbered, ["loop"], ["what"], is_head="is_head", until_stable=3)
    wanted = wanted.where(F.col(ORD) <= 1499 - 200)  # the others still wait for the watermark
    columns = [ORD, "loop", "what", "iteration"]
    assert g.values(found, columns) == g.values(wanted, columns)
    assert found.count() > 20


def test_batches_of_one_file(spark, events):
    stream = s.read_stream(spark, events, SCHEMA, files_per_batch=1)
    found = s.run_to_end(s.dedup_stream(stream, ["scope", "name"]))
    assert found.count() == 6


def test_summary_equals_compaction(spark, tmp_path):
    rows = g.depot(spark)
    for part in range(3):
        rows.where(F.col(ORD) % 3 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = s.read_stream(spark, f"{tmp_path}/in", rows.schema, files_per_batch=1)
    folder, state = shared_folder(spark, "summary"), shared_folder(spark, "state")
    s.compact_into(stream, folder, state)
    s.compact_into(stream, folder, state)
    merged = s.summary(spark, folder)
    assert g.values(merged, [*OBS9, ORD, WEIGHT]) == g.values(r.compact(rows), [*OBS9, ORD, WEIGHT])
    assert g.orders(r.keep_only_first(merged)) == [0, 3, 5, 9, 11]


def test_batches_carry_the_last_row_of_a_key(spark, tmp_path):
    rows = [(i, None, "s" + str(i % 2), "v" + str(i % 3), "abc"[i // 7 % 3]) for i in range(60)]
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path))
    whole = spark.createDataFrame(rows, SCHEMA)
    stream = s.read_stream(spark, str(tmp_path), SCHEMA, files_per_batch=1).drop("ts")
    found = batches.changed_values_by_batch(stream, ["scope", "name"], "value")
    assert g.orders(found) == g.orders(changes.changed_values(whole, ["scope"], "name", "value"))
    numbered = stream.withColumn("LineNo", F.col(ORD) * 2)
    lines = batches.attributed_lines_by_batch(numbered, ["scope"])
    wanted = changes.attributed_lines(whole.withColumn("LineNo", F.col(ORD) * 2), ["scope"])
    columns = [ORD, "AttributedLine"]
    assert g.values(lines, columns) == g.values(wanted, columns)


def test_a_batch_out_of_order_fails(spark, tmp_path):
    for part, orders in enumerate([(0, 5), (3, 6)]):
        rows = [(i, None, "s", "v", "abc"[i % 3]) for i in orders]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = s.read_stream(spark, f"{tmp_path}/in", SCHEMA, files_per_batch=1).drop("ts")
    with pytest.raises(Exception, match="out of order"):
        batches.changed_values_by_batch(stream, ["scope", "name"], "value")


LOOP = T.StructType([T.StructField(ORD, T.LongType()), T.StructField("loop", T.StringType()), T.StructField("what", T.StringType()), T.StructField("is_head", T.BooleanType())])


def loop_rows(seed, count=400):
    """Rows of several loops; one has a third of all, some show something new late, one has no head at first."""
    dice = random.Random(seed)
    rows = []
    for i in range(count):
        loop = dice.choice(["hot", None, "b", "c", "d", "hot"])
        what = dice.choice("xyz") if dice.random() < 0.9 or loop == "b" else f"rare{dice.randint(0, 5)}"
        rows.append((i, loop, what, dice.random() < 0.4 and not (loop == "d" and i < count // 2)))
    return rows


@pytest.mark.parametrize(("seed", "cuts"), [(2, [0, 100, 101, 250, 400]), (3, [0, 37, 74, 111, 300, 301, 400])])
def test_stable_loops_by_batch(spark, tmp_path, seed, cuts):
    rows = loop_rows(seed)
    for a, b in zip(cuts, cuts[1:]):
        spark.createDataFrame(rows[a:b], LOOP).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = s.read_stream(spark, f"{tmp_path}/in", LOOP, files_per_batch=1)
    found = batches.until_stable_loops_by_batch(stream, ["loop"], "is_head", ["what"], until_stable=3, buckets=5, chunk_rows=40)
    numbered = changes.numbered_iterations(spark.createDataFrame(rows, LOOP), ["loop"], "is_head")
    numbered = numbered.withColumn("iteration", F.when(F.col("iteration") >= 0, F.col("iteration")))
    wanted = changes.until_stable_loops(numbered, ["loop"], ["what"], is_head="is_head", until_stable=3)
    columns = [ORD, "loop", "what", "iteration"]
    assert g.values(found, columns) == g.values(wanted, columns)
    assert len(rows) > found.count() > 20


def test_a_batch_of_loops_touches_its_own_buckets_and_runs_again(spark, tmp_path):
    rows = loop_rows(4)
    for a, b in zip([0, 200], [200, 400]):
        spark.createDataFrame(rows[a:b], LOOP).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = s.read_stream(spark, f"{tmp_path}/in", LOOP, files_per_batch=1)
    folder, state = str(tmp_path / "out"), str(tmp_path / "state")
    options = {"until_stable": 3, "folder": folder, "checkpoint": state, "buckets": 7}
    found = batches.until_stable_loops_by_batch(stream, ["loop"], "is_head", ["what"], **options)
    before = g.values(found, [ORD, "iteration"])
    written = sorted(p.name for p in (tmp_path / "state" / "seen" / "batch=1").iterdir() if p.name.startswith("bucket"))
    assert len(written) < 7  # only what is new in the second batch
    # the last batch runs again, as after a crash before its end was noted
    (tmp_path / "state" / "offsets" / "commits" / "1").unlink()
    for noted in (tmp_path / "state" / "offsets" / "commits").glob(".1.crc"):
        noted.unlink()
    again = batches.until_stable_loops_by_batch(stream, ["loop"], "is_head", ["what"], **options)
    assert g.values(again, [ORD, "iteration"]) == before


def test_late_rows_of_a_loop_fail(spark, tmp_path):
    for orders in ((0, 5), (3, 6)):
        rows = [(i, "a", "x", True) for i in orders]
        spark.createDataFrame(rows, LOOP).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = s.read_stream(spark, f"{tmp_path}/in", LOOP, files_per_batch=1)
    with pytest.raises(Exception, match="out of order"):
        batches.until_stable_loops_by_batch(stream, ["loop"], "is_head", ["what"])


def folded_stream(spark, tmp_path, parts=7):
    rows = g.depot(spark)
    for part in range(parts):
        rows.where(F.col(ORD) % parts == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return rows, s.read_stream(spark, f"{tmp_path}/in", rows.schema, files_per_batch=1)


def test_folded_summary(spark, tmp_path):
    rows, stream = folded_stream(spark, tmp_path)
    folder, state = str(tmp_path / "summary"), str(tmp_path / "state")
    s.fold_into(stream, folder, state, every=2)
    columns = [*OBS9, ORD, WEIGHT]
    wanted = g.values(r.compact(rows), columns)
    assert g.values(s.folded_summary(spark, folder), columns) == wanted
    # of the parts, only those since the generation before the last are left
    assert s.generations(spark, folder) == [3, 5]
    assert sorted(p.name for p in (tmp_path / "summary" / "parts").iterdir() if "=" in p.name) == ["batch=4", "batch=5", "batch=6"]
    assert sorted(p.name for p in (tmp_path / "summary" / "base").iterdir()) == ["generation=3", "generation=5"]
    s.fold_into(stream, folder, state, every=2)  # nothing new
    assert g.values(s.folded_summary(spark, folder), columns) == wanted


@pytest.mark.parametrize("named", [False, True])
def test_a_fold_that_runs_again(spark, tmp_path, named):
    """The batch that folds is repeated, its base complete or not named yet."""
    rows, stream = folded_stream(spark, tmp_path, parts=6)
    folder, state = str(tmp_path / "summary"), str(tmp_path / "state")
    s.fold_into(stream, folder, state, every=2)
    columns = [*OBS9, ORD, WEIGHT]
    wanted = g.values(r.compact(rows), columns)
    commits = tmp_path / "state" / "commits"
    for noted in [commits / "5", *commits.glob(".5.crc")]:
        noted.unlink()
    if not named:
        shutil.rmtree(tmp_path / "summary" / "manifest" / "named=5")
        for part in (tmp_path / "summary" / "base" / "generation=5").glob("*.parquet"):
            part.unlink()  # a base cut short
        assert g.values(s.folded_summary(spark, folder), columns) == wanted  # the generation before and its parts
    s.fold_into(stream, folder, state, every=2)
    assert g.values(s.folded_summary(spark, folder), columns) == wanted
    assert s.generations(spark, folder) == [3, 5]
