"""Footers of Parquet files as a Spark data source: one row per file, with what is wrong with it.

Only the end of each file is read, by ranges, so neither the size of the files
nor a limit on what one row may hold matters. Tasks are planned by the size of
the files: a footer grows with the number of row groups.
"""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Iterator, Sequence
from urllib.parse import quote

from pyspark.errors import PySparkTypeError
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "siftmill_footers"

OPEN_COST = 1 << 16  # what opening a file costs, in bytes of footer
FOOTER_SHARE = 1 << 10  # a footer has about one byte for so many of its file
TASK_COST = 1 << 24

# The schemes of Hadoop's connectors and what Arrow calls them.
_ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "abfs": "abfs", "abfss": "abfss", "file": "file"}

Wanted = Sequence[tuple[str, str]]


class FooterFiles(InputPartition):
    """Files of one task: their paths below the root, and their sizes."""

    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(files)
        self.files = files


def plan_tasks(files: list[tuple[str, int]], task_cost: int = TASK_COST) -> list[FooterFiles]:
    """Files in path order, cut where a task would have too much to read."""
    tasks: list[FooterFiles] = []
    current: list[tuple[str, int]] = []
    cost = 0
    for path, size in sorted(files):
        own = OPEN_COST + size // FOOTER_SHARE
        if current and cost + own > task_cost:
            tasks.append(FooterFiles(current))
            current, cost = [], 0
        current.append((path, size))
        cost += own
    return [*tasks, FooterFiles(current)] if current else tasks


def _glob_matcher(glob: str):
    """Whether a file name fits a pattern as Hadoop reads it: also with ``{a,b}``."""
    patterns = [""]
    for part in re.split(r"(\{[^{}]*\})", glob):
        choices = part[1:-1].split(",") if part.startswith("{") else [part]
        patterns = [before + choice for before in patterns for choice in choices]
    compiled = [re.compile(fnmatch.translate(p.replace("[^", "[!"))) for p in patterns]
    return lambda name: any(p.match(name) for p in compiled)


class FooterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["root"]  # an address Arrow can open
        self.shown = options["shown"]  # the address that the caller and Spark's scans use
        self.wanted = [tuple(column) for column in json.loads(options["wanted"])]
        self.glob = options.get("glob", "*")
        self.recursive = options.get("recursive", "true") == "true"
        self.task_cost = int(options.get("taskcost", TASK_COST))

    def _files(self) -> tuple[list[tuple[str, int]], str]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.root)
        fits = _glob_matcher(self.glob)
        info = store.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"nothing at {self.shown}")
        if info.type == fs.FileType.File:
            return [("", info.size)], base
        found = []
        for info in store.get_file_info(fs.FileSelector(base, recursive=self.recursive)):
            below = info.path[len(base) :].strip("/")
            # what Spark's scans skip: names that begin with a mark, folders of that kind included
            hidden = any(part.startswith(("_", ".")) and "=" not in part for part in below.split("/"))
            if info.type == fs.FileType.File and not hidden and fits(info.base_name):
                found.append((below, info.size))
        return found, base

    def partitions(self) -> Sequence[InputPartition]:
        return plan_tasks(self._files()[0], self.task_cost)

    def read(self, partition: FooterFiles) -> Iterator[tuple]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.root)
        for below, size in partition.files:
            path = f"{base.rstrip('/')}/{below}" if below else base
            shown = f"{self.shown.rstrip('/')}/{below}" if below else self.shown
            rows, reason = footer_verdict(store, path, self.wanted)
            yield shown, size, rows, reason


def footer_verdict(store, path: str, wanted: Wanted) -> tuple[int | None, str | None]:
    """Rows of a file and what is wrong with its format, if anything.

    That a file cannot be reached is an error, not a reason.
    """
    import pyarrow as pa
    from pyarrow import parquet
    from pyspark.sql.pandas.types import from_arrow_schema

    try:
        with store.open_input_file(path) as file:
            footer = parquet.read_metadata(file)
        found = from_arrow_schema(footer.schema.to_arrow_schema(), prefer_timestamp_ntz=True)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, PySparkTypeError) as problem:
        return None, f"unreadable: {type(problem).__name__}"
    except OSError as problem:
        # Arrow reports a broken footer this way, too; system errors carry a number
        if problem.errno is not None:
            raise
        return None, f"unreadable: {type(problem).__name__}"
    columns = [(f.name, f.dataType.simpleString()) for f in found.fields]
    return footer.num_rows, None if columns == list(wanted) else "schema differs"


class FooterSource(DataSource):
    """``spark.read.format("siftmill_footers")``; use ``footers`` to fill in its options."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, bytes bigint, rows bigint, reason string"

    def reader(self, schema: T.StructType) -> FooterReader:
        return FooterReader({key.lower(): value for key, value in self.options.items()})


def arrow_address(spark: SparkSession, path: str) -> tuple[str, str | None]:
    """The address with its scheme, and the one that Arrow opens it by, or None if Arrow can't.

    Mount tables are followed to the store behind them.
    """
    import pyarrow as pa
    from pyarrow import fs

    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(context._jsc.hadoopConfiguration())
    shown = store.makeQualified(place).toString()
    scheme, _, rest = store.resolvePath(place).toString().partition(":")
    if scheme not in _ARROW_SCHEMES:
        return shown, None
    slashes = "//" + rest.lstrip("/") if scheme != "file" else "///" + rest.lstrip("/")
    address = f"{_ARROW_SCHEMES[scheme]}:{quote(slashes, safe='/:@')}"
    try:
        fs.FileSystem.from_uri(address)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return shown, None
    return shown, address


def footers(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.parquet", recursive: bool = True, task_cost: int = TASK_COST) -> DataFrame | None:
    """Table (file, bytes, rows, reason) of the Parquet files under ``path``; reason is null where a file has the schema.

    None where Arrow can't open the address, so its files cannot be read by ranges.
    """
    shown, address = arrow_address(spark, path)
    if address is None:
        return None
    spark.dataSource.register(FooterSource)
    wanted = json.dumps([(f.name, f.dataType.simpleString()) for f in schema.fields])
    options = {"root": address, "shown": shown, "wanted": wanted, "glob": glob, "recursive": str(recursive).lower(), "taskCost": str(task_cost)}
    return spark.read.format(NAME).options(**options).load()
