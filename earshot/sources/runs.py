"""Run folders as a Spark data source, with adapters of the user's own.

Bodies lie at ``<path>/source=<source>/brand=<brand>/run=<local_seq>-<run_id>/<any file>``, as
``write_runs`` lays them out. Filters on source, brand, run id and sequence number are pushed down to the
folder names, so what they exclude is neither listed below that level nor opened. The driver lists names of
runs only; their files are listed and read by the tasks, at most ``RUNS_PER_TASK`` runs each. An adapter names its source and turns a body into items; sources
without one are read like every other payload, by the lists that providers use.

    install(spark, [Forum()])
    items = spark.read.format("listening_runs").load(path).filter("source = 'forum'")
    mentions = normalise.parse(as_items(items), "forum", terms)      # after normalise.register("forum", ...)
"""

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any, Protocol
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

FORMAT = "listening_runs"
SCHEMA = "local_seq long, run_id string, brand string, source string, no_list boolean, index int, item string"
RUNS_PER_TASK = 2_000
#: As many tasks are made of fewer runs.
_MIN_TASKS = 64

# Keys that lead from a body to its item list, in the order they are tried (as in ``payloads``).
_PATHS = (
    (), ("items",), ("data",), ("results",), ("reviews",), ("data", "results"), ("results", "results"),
    ("items", "results"), ("providerResponse", "output"), ("providerResponse", "items"),
    ("providerResponse", "data"), ("providerResponse", "results"),
)


class Adapter(Protocol):
    """X01. One source: its name, and the items of a run body (None where there is no list of them)."""

    source: str

    def items(self, body: str) -> Iterable[Any] | None: ...


def listed_items(body: str) -> list[Any] | None:
    """The first list under ``output``, or the body, at one of the known paths."""
    try:
        whole = json.loads(body)
    except ValueError:
        return None
    root = whole.get("output") if isinstance(whole, dict) and whole.get("output") is not None else whole
    for path in _PATHS:
        at = root
        for key in path:
            at = at.get(key) if isinstance(at, dict) else None
        if isinstance(at, list):
            return at
    return None


@dataclass
class _Runs(InputPartition):
    folder: str  # of the brand
    brand: str
    source: str
    runs: list[str]  # names of folders below it


def _file_system(path: str):
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


class _Reader(DataSourceReader):
    _PUSHED = ("source", "brand", "run_id", "local_seq")

    def __init__(self, path: str, adapters: dict[str, Adapter]):
        self.path, self.adapters = path, adapters
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name not in self._PUSHED:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[name] = self.wanted.get(name, values) & values

    def _passes(self, name: str, value) -> bool:
        return name not in self.wanted or value in self.wanted[name]

    def _folders(self, files, at: str, key: str) -> list[str]:
        from pyarrow import fs

        found = files.get_file_info(fs.FileSelector(at))
        return sorted(i.base_name for i in found if i.type == fs.FileType.Directory and i.base_name.startswith(f"{key}="))

    @staticmethod
    def _run(name: str) -> tuple[int, str]:
        seq, _, run_id = _value(name).partition("-")
        return int(seq), run_id

    def partitions(self) -> Sequence[InputPartition]:
        files, root = _file_system(self.path)
        found = []
        for source_name in self._folders(files, root, "source"):
            source = _value(source_name)
            if not self._passes("source", source):
                continue
            for brand_name in self._folders(files, f"{root}/{source_name}", "brand"):
                brand = _value(brand_name)
                if not self._passes("brand", brand):
                    continue
                at = f"{root}/{source_name}/{brand_name}"
                runs = self._folders(files, at, "run")
                if "local_seq" in self.wanted or "run_id" in self.wanted:
                    known = ((name, *self._run(name)) for name in runs)
                    runs = [n for n, seq, run_id in known if self._passes("local_seq", seq) and self._passes("run_id", run_id)]
                found.append((at, brand, source, runs))
        total = sum(len(runs) for *_, runs in found)
        each = min(RUNS_PER_TASK, -(-total // _MIN_TASKS)) or 1
        out = [_Runs(at, brand, source, runs[i : i + each]) for at, brand, source, runs in found for i in range(0, len(runs), each)]
        return out or [_Runs(root, "", "", [])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        files, _ = _file_system(self.path)
        brand, source = partition.brand, partition.source
        adapter = self.adapters.get(source)
        for name in partition.runs:
            seq, run_id = self._run(name)
            for info in files.get_file_info(fs.FileSelector(f"{partition.folder}/{name}")):
                if info.type != fs.FileType.File or info.base_name.startswith(("_", ".")):
                    continue
                with files.open_input_stream(info.path) as stream:
                    body = stream.read().decode("utf-8", "replace")
                items = listed_items(body) if adapter is None else adapter.items(body)
                if items is None:
                    yield (seq, run_id, brand, source, True, None, None)
                    continue
                for index, item in enumerate(items):
                    yield (seq, run_id, brand, source, False, index, json.dumps(item, ensure_ascii=False))


def _value(name: str) -> str:
    return unquote(name.partition("=")[2])


class RunFolders(DataSource):
    """The data source; ``install`` makes a class of its own with the adapters given."""

    adapters: dict[str, Adapter] = {}

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], dict(self.adapters))


def install(spark: SparkSession, adapters: Sequence[Adapter] = (), name: str = FORMAT) -> None:
    """X01. Make ``spark.read.format(name)`` read run folders, with these adapters for their sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    known = {adapter.source: adapter for adapter in adapters}
    made = type("RunFoldersWithAdapters", (RunFolders,), {"adapters": known, "name": classmethod(lambda cls: name)})
    spark.dataSource.register(made)


def as_items(read: DataFrame) -> DataFrame:
    """The rows of the data source as ``payloads.payload_items`` gives them."""
    return read.withColumn("item", F.try_parse_json("item"))


def write_runs(runs: DataFrame, path: str) -> None:
    """Run bodies (local_seq, run_id, brand, source, body) laid out for the data source, one folder a run."""
    run = F.concat(F.col("local_seq").cast("string"), F.lit("-"), F.col("run_id"))
    flat = runs.select("source", "brand", run.alias("run"), F.regexp_replace("body", r"[\r\n]", " ").alias("value"))
    files, root = _file_system(path)
    if files.get_file_info(root).type.name != "NotFound":
        raise ValueError(f"{path} exists")
    files.create_dir(root, recursive=True)

    def write(rows: Iterator) -> None:
        # Straight to the run's folder: a task that is run again overwrites its own files, and nothing is renamed.
        from pyspark import TaskContext

        files, _ = _file_system(path)
        part = TaskContext.get().partitionId()
        for i, row in enumerate(rows):
            folder = "/".join([root, *(f"{key}={_written(row[key])}" for key in ("source", "brand", "run"))])
            files.create_dir(folder, recursive=True)
            with files.open_output_stream(f"{folder}/part-{part:05d}-{i}.json") as out:
                out.write(((row["value"] or "") + "\n").encode())

    flat.foreachPartition(write)


def _written(name: str | None) -> str:
    return quote(name, safe="") if name else "__HIVE_DEFAULT_PARTITION__"


__all__ = ["Adapter", "FORMAT", "RunFolders", "as_items", "install", "listed_items", "write_runs"]
