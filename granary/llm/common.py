"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The words of every contract here: runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

_libc = ctypes.CDLL(None)
_written: dict[str, SparkSession] = {}
_thread = threading.local()


def ship(spark: SparkSession) -> None:
    """Once for each session, give executors that don't have it installed this package, from the driver's own file server."""
    sc = spark.sparkContext
    if getattr(sc, "_granary_shipped", False):
        return
    sc._granary_shipped = True
    root = Path(__file__).resolve().parent.parent
    packed = Path(tempfile.mkdtemp(prefix="granary-")) / "granary.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(packed))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir; only in local mode, where none may be set, a new local one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="granary-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    """A path of its own in the shared folder, deleted when the driver's Python ends, if not before."""
    path = f"{shared_dir(spark)}/granary-{kind}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(lambda: _delete(list(_written)))
    _written[path] = spark
    _mine().append(path)
    return path


def _mine() -> list[str]:
    """The paths that this thread has made, so that work in other threads is left alone."""
    if not hasattr(_thread, "paths"):
        _thread.paths = []
    return _thread.paths


def _delete(paths: list[str]) -> None:
    for path in paths:
        try:
            sc = _written[path].sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone; the folder then goes with the cluster's shared folder
            continue
        _written.pop(path, None)


def materialize(df: DataFrame, kind: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost executor takes nothing along."""
    path = new_path(df.sparkSession, kind)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._granary_path = path
    return out


def bucketed(df: DataFrame, kind: str, buckets: int, by: str) -> DataFrame:
    """Like materialize(), in buckets of a column: what groups or joins by it later moves only the other side.

    The table has a name in the session's catalog only until it is read; its files are in the shared folder.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, kind)
    name = f"granary_{kind}_{uuid.uuid4().hex}"
    df.repartition(buckets, by).write.format("parquet").bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"drop table {name}")  # an external table's files stay
    out._granary_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what materialize() or finished() wrote; nothing that was planned on it may run any more."""
    _delete([path for path in _written if path == getattr(df, "_granary_path", "")])


def finished(make: Callable[[], DataFrame], kind: str) -> DataFrame:
    """The table that make() plans, written; what this thread wrote on its way there is deleted."""
    first = len(_mine())
    out = materialize(make(), kind)
    made = _mine()[first:]
    _delete([path for path in made if path in _written and path != out._granary_path])
    _mine()[first:] = [out._granary_path]
    return out


def small_or_plain(small: DataFrame, max_rows: int) -> DataFrame:
    """The side of a join, marked for broadcast only if it has been counted and has at most max_rows rows; beyond that Spark joins by shuffle."""
    return F.broadcast(small) if small.limit(max_rows + 1).count() <= max_rows else small


def quoted(name: str) -> Column:
    """A column by its exact name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(name: str, columns: Iterable[str]) -> str:
    """The name, with underscores after it until none of the columns has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def carried(columns: Iterable[str], own: Iterable[str]) -> list[str]:
    """The columns that an operator carries along: all but those that have the name of one of its own, which take their place."""
    names = {c.lower() for c in own}
    return [c for c in columns if c.lower() not in names]


def map_carrying(docs: DataFrame, read: Column, carry: list[str], run: Callable, own: str) -> DataFrame:
    """The carried columns and an operator's own (in Spark's DDL), from batches of what it reads and, after it, the carried columns.

    run gives the carried columns of each batch, under the names they have there, and its own after them.
    """
    names = [f"_carry{k}" for k in range(len(carry))]
    picked = docs.select(read.alias("_read"), *(quoted(c).alias(x) for c, x in zip(carry, names, strict=True)))
    fields = StructType.fromDDL(own).fields
    found = picked.mapInArrow(run, StructType([*picked.schema.fields[1:], *fields]))
    return found.select(*(F.col(x).alias(c) for c, x in zip(carry, names, strict=True)), *(f.name for f in fields))


def set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """docs with all but the used columns under names that no operator has, and what to select to have the old names and order back."""
    names = {c: c if c in used else f"_aside{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*(quoted(c).alias(x) for c, x in names.items())), [quoted(x).alias(c) for c, x in names.items()]


def give_back() -> None:
    """Returns what a worker has freed to the system: workers are used again, by other stages too."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def parts(batches: Iterator, rows: int) -> Iterator:
    """Arrow batches of at most so many rows, so that a worker holds few of them as Python objects at once."""
    for batch in batches:
        for lo in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(lo, rows)
    give_back()
