"""Reports as files in folders, {ticker}/{period}/..., as a data source: read with folders pruned, written with commit and abort."""

from __future__ import annotations

import itertools
import json
import re
import sys
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .stores import open_store

#: What a file is, by its place.
FILES = "ticker string, period string, kind string, report string, filename string, path string, size long, content binary"
#: What is written: a report, its original, text, tables and images, and its metadata as JSON.
REPORTS = (
    "ticker string, period string, report string, pdf binary, text string, tables array<struct<name:string,csv:string>>, "
    "images array<struct<name:string,content:binary>>, metadata string"
)
_KINDS = {"text": "text", "tables": "table", "images": "image", "metadata": "metadata"}
_STAGING = "_staging"
#: Places in a batch of their list.
_BATCH = 10_000
#: Reports of a batch that stand as Python values at a time; bytes of contents in a batch, but for its last file's.
_ROWS, _HELD = 256, 1 << 22


def _files(store: pafs.FileSystem, at: str) -> Iterator[pafs.FileInfo]:
    """The files under a folder; the names of one folder are held at a time, and those of the folders above it."""
    found = store.get_file_info(pafs.FileSelector(at, allow_not_found=True))
    for f in sorted(found, key=lambda f: f.base_name):
        if f.type == pafs.FileType.Directory:
            yield from _files(store, f.path)
        elif f.type == pafs.FileType.File:
            yield f


def _folders(store: pafs.FileSystem, at: str) -> list[str]:
    found = store.get_file_info(pafs.FileSelector(at, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == pafs.FileType.Directory and f.base_name[0] not in "._")


@dataclass
class Folder(InputPartition):
    ticker: str
    period: str


class ReportReader(DataSourceReader):
    """A partition for each ticker and period. Filters on either are kept to while the folders are listed, so the folders of others
    are neither listed nor read."""

    def __init__(self, root: str, columns: list[str]):
        self.root, self.columns = root, columns
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute in (("ticker",), ("period",)):
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def _passes(self, name: str, value: str) -> bool:
        return name not in self.wanted or value in self.wanted[name]

    def partitions(self) -> list[Folder]:
        store, at = open_store(self.root)
        out = []
        for ticker in _folders(store, at):
            if self._passes("ticker", ticker.upper()):
                out += [Folder(ticker, p) for p in _folders(store, f"{at}/{ticker}") if self._passes("period", p)]
        return out

    def read(self, partition: Folder) -> Iterator[tuple]:
        if partition is None:  # there is no folder
            return
        store, at = open_store(self.root)
        base = f"{at}/{partition.ticker}/{partition.period}"
        for f in _files(store, base):
            inside = f.path[len(base) + 1 :]
            kind = _KINDS.get(inside.split("/")[0], "pdf") if "/" in inside else "pdf"
            report = re.sub(r"(-t\d+|-p\d+-[^/]*)?\.[^./]+$", "", f.base_name)
            with store.open_input_stream(f.path) as stream:
                yield partition.ticker.upper(), partition.period, kind, report, f.base_name, f.path, f.size, stream.read()


@dataclass
class Written(WriterCommitMessage):
    attempt: str  # the folder of a task's files, which the list of their places stands beside


class ReportWriter(DataSourceWriter):
    """Each task writes its reports' files aside, and beside them the list of their places, of which the driver gets the name only. Once
    all have, the files are moved to their places, whose names they replace; of files with one place, the last task's stays. If a task
    fails for good, what was written aside goes, and no place has changed.

    The commit notes which tasks' files count and moves them one by one, unless the option job names the write: then `finish` moves them,
    in tasks."""

    def __init__(self, root: str, job: str | None = None):
        self.root, self.job, self.later = root, job or uuid.uuid4().hex, job is not None

    def write(self, iterator: Iterator) -> Written:
        store, at = open_store(self.root)
        attempt, made = uuid.uuid4().hex, set()
        aside = f"{_aside(at, self.job)}/{attempt}"
        store.create_dir(aside, recursive=True)
        with store.open_output_stream(f"{aside}.places", buffer_size=1 << 16) as places:

            def put(place: str, content: bytes) -> None:
                path = f"{aside}/{place}"
                _make_folder(store, path, made)
                with store.open_output_stream(path) as stream:
                    stream.write(content)
                places.write(json.dumps(place).encode() + b"\n")

            for row in iterator:
                for part in (row["ticker"], row["period"], row["report"]):
                    if not part or "/" in part or part[0] in "._":
                        raise ValueError(f"not a name of a folder or file: {part!r}")
                base, name = f"{row['ticker']}/{row['period']}", row["report"]
                if row["pdf"] is not None:
                    put(f"{base}/{name}.pdf", bytes(row["pdf"]))
                if (row["text"] or "").strip():  # as a text without content gives no file
                    put(f"{base}/text/{name}.txt", row["text"].encode("utf-8", "surrogatepass"))
                for i, t in enumerate(row["tables"] or []):
                    put(f"{base}/tables/{name}-t{i + 1}.csv", (t["csv"] or "").encode())
                for i, x in enumerate(row["images"] or []):
                    put(f"{base}/images/{name}-p{i + 1}-{(x['name'] or 'image').replace('/', '_')}.png", bytes(x["content"] or b""))
                put(f"{base}/metadata/{name}.json", json.dumps(json.loads(row["metadata"] or "{}"), sort_keys=True).encode())
        return Written(attempt)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = open_store(self.root)
        attempts = [m.attempt for m in messages if m]
        store.create_dir(_aside(at, self.job), recursive=True)
        with store.open_output_stream(f"{_aside(at, self.job)}/committed") as stream:
            stream.write(json.dumps(attempts).encode())
        if not self.later:
            made: set[str] = set()
            for attempt in attempts:
                for place in _places(store, at, self.job, attempt):
                    _move(store, f"{_aside(at, self.job)}/{attempt}/{place}", f"{at}/{place}", made)
            _sweep(store, at, self.job)

    def abort(self, messages: list[Written | None]) -> None:
        _sweep(*open_store(self.root), self.job)


def _aside(at: str, job: str) -> str:
    return f"{at}/{_STAGING}/{job}"


def _make_folder(store: pafs.FileSystem, path: str, made: set[str]) -> None:
    folder = path.rsplit("/", 1)[0]
    if folder not in made:
        store.create_dir(folder, recursive=True)
        made.add(folder)


def _places(store: pafs.FileSystem, at: str, job: str, attempt: str) -> Iterator[str]:
    with store.open_input_stream(f"{_aside(at, job)}/{attempt}.places", buffer_size=1 << 16) as stream:
        rest = b""
        while more := stream.read(1 << 16):
            *lines, rest = (rest + more).split(b"\n")
            yield from map(json.loads, lines)


def _move(store: pafs.FileSystem, source: str, place: str, made: set[str]) -> None:
    _make_folder(store, place, made)
    try:
        store.move(source, place)
    except FileNotFoundError:  # moved already: by an earlier run of this task, or for the same place's first line
        if store.get_file_info(place).type != pafs.FileType.File:
            raise


def _sweep(store: pafs.FileSystem, at: str, job: str) -> None:
    if store.get_file_info(_aside(at, job)).type == pafs.FileType.Directory:
        store.delete_dir(_aside(at, job))
    left = f"{at}/{_STAGING}"
    if store.get_file_info(left).type == pafs.FileType.Directory and not store.get_file_info(pafs.FileSelector(left)):
        store.delete_dir(left)


def put_aside(reports: DataFrame, root: str, job: str) -> None:
    """Writes reports aside and notes which tasks' files count, for `finish`, as a write with the option job does, but without the Python
    processes that the write of a data source keeps beside the driver. Of each task the driver gets the name of its folder."""
    writer = ReportWriter(root, job)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for i in range(0, batch.num_rows, _ROWS) for row in batch.slice(i, _ROWS).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([writer.write(rows).attempt], pa.string())], names=["attempt"])

    try:
        writer.commit([Written(r.attempt) for r in reports.mapInArrow(put, "attempt string").collect()])
    except BaseException:
        writer.abort([])
        raise


def finish(spark: SparkSession, root: str, job: str) -> None:
    """Moves the files of a committed write to their places, in tasks. A run that dies leaves what isn't moved yet aside, and another run
    with the same job moves the rest."""
    store, at = open_store(root)
    with store.open_input_stream(f"{_aside(at, job)}/committed") as stream:
        attempts = json.loads(stream.read())

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = open_store(root)
        for n in (n for batch in batches for n in batch.column(0).to_pylist()):
            for places in _chunks(_places(store, at, job, attempts[n])):
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.string()), pa.array([n] * len(places), pa.int64())], names=["place", "n"])

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = open_store(root)
        made: set[str] = set()
        for batch in batches:
            for place, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _move(store, f"{_aside(at, job)}/{attempts[n]}/{place}", f"{at}/{place}", made)
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], names=["none"])

    every = spark.range(len(attempts)).select(F.col("id").alias("n")).mapInArrow(listed, "place string, n long")
    last = every.groupBy("place").agg(F.max("n").alias("n"))
    last.mapInArrow(moved, "none long").write.format("noop").mode("overwrite").save()
    _sweep(store, at, job)


def in_folders(spark: SparkSession, root: str, tickers: Iterable[str], periods: Iterable[str]) -> DataFrame:
    """What the data source gives for In filters on ticker and period, a task for each folder too, but without the Python processes that
    its planning keeps beside the driver."""
    reader = ReportReader(root, [])
    reader.wanted = {"ticker": set(tickers), "period": set(periods)}
    folders, schema = reader.partitions(), ["ticker", "period", "kind", "report", "filename", "path", "size", "content"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def full() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True)) or [()] * len(schema)
            kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema)

        for n in (n for batch in batches for n in batch.column(0).to_pylist()):
            for row in reader.read(folders[n]):
                held.append(row)
                size += len(row[-1])
                if size >= _HELD or len(held) == _BATCH:
                    yield full()
                    size = 0
        yield full()

    return spark.range(0, len(folders), 1, max(1, len(folders))).mapInArrow(read, FILES)


def _chunks(values: Iterator[str]) -> Iterator[list[str]]:
    while chunk := list(itertools.islice(values, _BATCH)):
        yield chunk


class ReportTree(DataSource):
    """format("report_tree"): option path is the folder above the tickers'. Reading gives a row a file (FILES), writing takes a row a
    report (REPORTS); the option job leaves the moves to `finish`."""

    @classmethod
    def name(cls) -> str:
        return "report_tree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> ReportReader:
        return ReportReader(self.options["path"], schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"], self.options.get("job"))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets it push filters into sources of this kind."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ReportTree)


# The classes of this module go to the workers by value, so that a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
