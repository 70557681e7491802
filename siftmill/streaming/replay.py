"""Stateful twins of the change operators, for events that may arrive late.

Rows of a key wait until the watermark has passed them and are then taken in
order. What a key remembers is one small row, and for loops the observations
it has shown. A key that has been idle long enough is forgotten.

However many rows of a key wait or are given out, few lie in memory: waiting
rows are sorted runs in the state store, merged as they are taken, and results
leave a task in small parts.
"""

from __future__ import annotations

import heapq
import itertools
import operator
import pickle
import sys
from collections.abc import Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from siftmill.operators.changes import ITERATIONS_UNTIL_STABLE

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_TIME = "__time_ms"

# Pickled bytes of a block of waiting rows, and of the rows sorted at once.
BLOCK_BYTES = 1 << 16
RUN_BYTES = 1 << 21

# So many runs of one size are merged into one.
FAN = 32

# Rows measured at once, and rows given out at once.
MEASURED_ROWS = 64
GIVEN_ROWS = 1000

# The driver starts a processor in a process of its own, which shipped files do
# not reach, so the processors travel as code and not by name.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _give_out_in_parts() -> None:
    """Let this worker give out results in parts: Spark's own way holds all rows of a task's timers at once."""
    from pyspark.sql.pandas import serializers

    def dump_stream(self, iterator, stream):
        import pyarrow as pa

        def batches():
            for packed in iterator:
                rows, kind = packed[0]
                for part in _parts(rows):
                    yield pa.RecordBatch.from_pylist(part, schema=pa.schema(list(kind))), kind

        return serializers.ArrowStreamUDFSerializer.dump_stream(self, batches(), stream)

    serializers.TransformWithStateInPySparkRowSerializer.dump_stream = dump_stream


def _parts(rows: Iterator[Row]) -> Iterator[list[dict]]:
    part, size = [], 0
    for row in rows:
        part.append(row.asDict(True))
        size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if len(part) == GIVEN_ROWS or size >= RUN_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


class _Waiting:
    """Rows of a key that wait: sorted runs, cut into blocks of the state store.

    The state's entry 0 tells of the runs, oldest first, and holds the newest
    rows while they are few. Other entries are blocks. A run is its level, the
    numbers of its first block and the one after its last, its earliest time and
    its rows a block. Runs of one level are merged once there are many, so a
    merge has few of them open, each with one block.
    """

    def __init__(self, handle, place: int) -> None:
        number = T.StructType([T.StructField("number", T.LongType())])
        self.entries = handle.getMapState("waiting", number, T.StructType([T.StructField("rows", T.BinaryType())]))
        self.order = operator.itemgetter(-1, place)  # time, then the order column

    def appendList(self, rows: Sequence[tuple]) -> None:
        unused, runs, newest = self._load(0) or (1, [], [])
        newest = [*newest, *rows]
        size = len(pickle.dumps(newest))
        if size > BLOCK_BYTES:
            newest.sort(key=self.order)
            block_rows = max(1, len(newest) * BLOCK_BYTES // size)
            unused = self._add(runs, unused, 0, iter(newest), block_rows)
            newest = []
            while len(runs) >= FAN and runs[-FAN][0] == runs[-1][0]:
                merged = runs[-FAN:]
                del runs[-FAN:]
                rows = heapq.merge(*[self._drain(run, None) for run in merged], key=self.order)
                unused = self._add(runs, unused, merged[0][0] + 1, rows, min(run[4] for run in merged))
        self._store(0, (unused, runs, newest))

    def take(self, until: int) -> Iterator[tuple]:
        """Rows up to a time, in order; they have left the state once all were taken."""
        self.earliest, head = None, self._load(0)
        if head is None:
            return
        unused, runs, newest = head
        ready = sorted((row for row in newest if row[-1] <= until), key=self.order)
        yield from heapq.merge(*[self._drain(run, until) for run in runs if run[3] <= until], ready, key=self.order)
        runs = [run for run in runs if run[1] < run[2]]
        newest = [row for row in newest if row[-1] > until]
        if runs or newest:
            self._store(0, (unused, runs, newest))
            self.earliest = min([run[3] for run in runs] + [row[-1] for row in newest])
        else:
            self.entries.removeKey((0,))

    def _load(self, number: int):
        found = self.entries.getValue((number,))
        return None if found is None else pickle.loads(found[0])

    def _store(self, number: int, value) -> None:
        self.entries.updateValue((number,), (pickle.dumps(value),))

    def _add(self, runs: list, first: int, level: int, rows: Iterator[tuple], block_rows: int) -> int:
        """Store sorted rows as a run; gives the number after its last block."""
        number, earliest = first, None
        while block := list(itertools.islice(rows, block_rows)):
            earliest = block[0][-1] if earliest is None else earliest
            self._store(number, block)
            number += 1
        runs.append([level, first, number, earliest, block_rows])
        return number

    def _drain(self, run: list, until: int | None) -> Iterator[tuple]:
        """Rows of a run up to a time, in order; they leave the state and the run."""
        while run[1] < run[2]:
            block = self._load(run[1])
            ready = block if until is None else [row for row in block if row[-1] <= until]
            yield from ready
            if len(ready) < len(block):
                run[3] = block[len(ready)][-1]
                self._store(run[1], block[len(ready):])
                return
            self.entries.removeKey((run[1],))
            run[1] += 1


class _Replay(StatefulProcessor):
    """Buffers rows until the watermark passes them, then steps through them in order."""

    memory_schema: T.StructType
    keeps_seen = False

    def __init__(self, keys: Sequence[str], fields: T.StructType, order: str, idle_ms: int) -> None:
        self.keys, self.fields, self.order, self.idle_ms = list(keys), fields, order, idle_ms

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        _give_out_in_parts()

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = _Waiting(handle, self.fields.fieldNames().index(self.order))
        self.memory = handle.getValueState("memory", self.memory_schema)
        self.latest = handle.getValueState("latest", T.StructType([T.StructField("ms", T.LongType())]))
        if self.keeps_seen:
            one = T.StructType([T.StructField("one", T.IntegerType())])
            self.seen = handle.getMapState("seen", T.StructType([T.StructField("text", T.StringType())]), one)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = self._plain(rows)
        values, size, earliest = [], 0, None
        while part := list(itertools.islice(rows, MEASURED_ROWS)):
            values += part
            size += len(pickle.dumps(part))
            first = min(row[-1] for row in part)
            earliest = first if earliest is None else min(earliest, first)
            if size >= RUN_BYTES:
                self.waiting.appendList(values)
                values, size = [], 0
        if values:
            self.waiting.appendList(values)
        if earliest is not None:
            self.handle.registerTimer(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        names = self.fields.fieldNames()
        shown = Row(*self.keys, *names[:-1], *self.extra)
        memory, last = None, None
        for row in self.waiting.take(watermark):
            if last is None:
                memory = self.memory.get()
            last = row[-1]
            memory, result = self.step(memory, dict(zip(names, row)))
            if result is not None:
                yield shown(*key, *row[:-1], *result)
        later = self.waiting.earliest
        if later is not None:
            self.handle.registerTimer(later)
        if last is not None:
            self.memory.update(memory)
            self.latest.update((last,))
            self.handle.registerTimer(last + self.idle_ms)
        elif later is None and self.latest.exists() and self.latest.get()[0] + self.idle_ms <= watermark:
            self._forget()

    def step(self, memory, row: dict):
        raise NotImplementedError

    extra: list[str] = []

    def _plain(self, rows: Iterator[Row]) -> Iterator[tuple]:
        names = self.fields.fieldNames()
        for row in rows:
            found = dict(zip(row.__fields__, row))
            # not-a-number counts as null
            yield tuple([None if isinstance(v, float) and v != v else v for v in [found[name] for name in names]])

    def _forget(self) -> None:
        self.memory.clear()
        self.latest.clear()
        if self.keeps_seen:
            self.seen.clear()

    def close(self) -> None:
        pass


class _Changes(_Replay):
    memory_schema = T.StructType([T.StructField("value", T.StringType())])

    def __init__(self, *args, value: str) -> None:
        super().__init__(*args)
        self.value = value

    def step(self, memory, row):
        now = row[self.value]
        text = None if now is None else str(now)
        return (text,), (() if memory is None or memory[0] != text else None)


class _Lines(_Replay):
    memory_schema = T.StructType([T.StructField("line", T.LongType())])

    def __init__(self, *args, line: str, out: str) -> None:
        super().__init__(*args)
        self.line, self.extra = line, [out]

    def step(self, memory, row):
        now = row[self.line]
        return (now,), ((now if memory is None else memory[0]),)


class _StableLoops(_Replay):
    memory_schema = T.StructType([T.StructField("iteration", T.LongType()), T.StructField("news", T.LongType())])
    keeps_seen = True

    def __init__(self, *args, is_head: str, observation: Sequence[str], out: str, until_stable: int) -> None:
        super().__init__(*args)
        self.is_head, self.observation, self.extra = is_head, list(observation), [out]
        self.until_stable = until_stable

    def step(self, memory, row):
        iteration, news = memory or (-1, -1)
        if row[self.is_head]:
            iteration += 1
        if iteration < 0:
            return (iteration, news), (None,)
        quiet = iteration - 1 - news
        if quiet >= self.until_stable:
            # once stable, a loop stays so; the event at its head that finds that out still passes
            passes = row[self.is_head] and quiet == self.until_stable
            return (iteration, news), ((iteration,) if passes else None)
        shown = (repr([row[name] for name in self.observation]),)
        if not self.seen.containsKey(shown):
            self.seen.updateValue(shown, (1,))
            news = iteration
        return (iteration, news), (iteration,)


def _inner(name: str) -> str:
    """Name of a column inside the processor, where a leading underscore is not kept."""
    return f"x{name}"


def _run(stream, keys, columns, order, event_time, delay, idle_ms, processor, extra=()) -> DataFrame:
    stream.sparkSession.conf.set(STATE_STORE, ROCKSDB)
    marked = stream.withWatermark(event_time, delay)
    rows = marked.select(
        *[F.col(c).alias(_inner(c)) for c in [*keys, *columns]],
        event_time,
        F.unix_millis(event_time).alias(_inner(_TIME)),
    )
    types = {f.name: f.dataType for f in rows.schema.fields}
    key_names = [_inner(k) for k in keys]
    fields = T.StructType([T.StructField(n, types[n], True) for n in map(_inner, [*columns, _TIME])])
    output = T.StructType([*[T.StructField(k, types[k], True) for k in key_names], *fields.fields[:-1]])
    for name in extra:
        output = output.add(_inner(name), T.LongType(), True)
    replayed = rows.groupBy(*key_names).transformWithState(
        statefulProcessor=processor(key_names, fields, _inner(order), idle_ms),
        outputStructType=output,
        outputMode="Append",
        timeMode="EventTime",
    )
    return replayed.select(*[F.col(_inner(c)).alias(c) for c in [*keys, *columns, *extra]])


_WEEK_MS = 7 * 24 * 3600 * 1000


def changed_values_stream(
    stream: DataFrame,
    keys: Sequence[str],
    value: str,
    order: str,
    event_time: str,
    delay: str = "1 hour",
    idle_ms: int = _WEEK_MS,
) -> DataFrame:
    """Rows in which a key (scope and name) is new or has another value than before."""
    return _run(
        stream, keys, [order, value], order, event_time, delay, idle_ms, lambda *a: _Changes(*a, value=_inner(value))
    )


def attributed_lines_stream(
    stream: DataFrame,
    call: Sequence[str],
    line: str,
    order: str,
    event_time: str,
    out: str = "AttributedLine",
    delay: str = "1 hour",
    idle_ms: int = _WEEK_MS,
) -> DataFrame:
    """Every row with the line of the call's row before."""

    def processor(*args):
        return _Lines(*args, line=_inner(line), out=_inner(out))

    return _run(stream, call, [order, line], order, event_time, delay, idle_ms, processor, [out])


def until_stable_loops_stream(
    stream: DataFrame,
    loop: Sequence[str],
    is_head: str,
    observation: Sequence[str],
    order: str,
    event_time: str,
    out: str = "iteration",
    until_stable: int = ITERATIONS_UNTIL_STABLE,
    delay: str = "1 hour",
    idle_ms: int = _WEEK_MS,
) -> DataFrame:
    """Rows of a loop until it has become stable, with their iteration."""

    def processor(*args):
        return _StableLoops(
            *args,
            is_head=_inner(is_head),
            observation=[_inner(name) for name in observation],
            out=_inner(out),
            until_stable=until_stable,
        )

    return _run(stream, loop, [order, is_head, *observation], order, event_time, delay, idle_ms, processor, [out])
