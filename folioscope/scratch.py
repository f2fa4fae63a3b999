"""Tables that later steps start from: scratch tables of one plan, and stored tables that many queries read."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of input for each bucket of a stored table.
BUCKET_BYTES = 64 << 20

_made: list[tuple[SparkSession, str]] = []
#: of each thread: the tables made in the innermost `only`
_inside = threading.local()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one where that is unset (single machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='folioscope-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _written(spark: SparkSession, write: Callable[[], None]) -> None:
    """Run a write; Spark deletes the shuffle files of that execution when it ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        write()
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the scratch folder and read it back: later steps start from files, not from df's lineage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/folioscope/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    _made.append((spark, path))
    _written(spark, lambda: df.write.option("compression", "zstd").parquet(path))
    out = spark.read.schema(schema).parquet(path)
    out._folioscope_path = path
    if getattr(_inside, "tables", None) is not None:
        _inside.tables.append(out)
    return out


def only(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``table`` of the frame that make returns; the tables that make stored for it are deleted.

    Nothing else may read those any more.  Tables made before, and ``stored`` ones, stay.
    """
    outer, _inside.tables = getattr(_inside, "tables", None), []
    try:
        out = table(make(), name)
        drop(*_inside.tables[:-1])
    finally:
        _inside.tables = outer
    if outer is not None:
        outer.append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files of frames that ``table`` returned; nothing may read them any more."""
    for df in tables:
        fs, where = _fs(df.sparkSession, df._folioscope_path)
        fs.delete(where, True)


def checked(df: DataFrame) -> DataFrame:
    """df, a frame that ``table`` returned, with a broadcast hint if its rows fit Spark's own broadcast limit in memory.

    What counts is the size of the rows, not of their compressed files: eight bytes a field and the bytes of texts.
    Beyond ``spark.sql.autoBroadcastJoinThreshold`` a join with it shuffles.
    """
    spark = df.sparkSession
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    fs, where = _fs(spark, df._folioscope_path)
    if fs.getContentSummary(where).getLength() > limit:
        return df
    texts = [c for c, kind in df.dtypes if kind in ("string", "binary")]
    sizes = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in texts]
    rows, *held = df.agg(F.count("*"), *sizes).first()
    return F.broadcast(df) if rows * 8 * (1 + len(df.columns)) + sum(held) <= limit else df


def _files(spark: SparkSession, inputs: list[str]) -> list:
    found = []
    for path in inputs:
        fs, where = _fs(spark, path)
        for f in sorted(fs.globStatus(where) or [], key=str):
            found.extend([f] if f.isFile() else fs.listStatus(f.getPath()))
    return found


def buckets(spark: SparkSession, inputs: list[str]) -> int:
    """The number of buckets that a table stored from `inputs` has: rows dealt into as many by its key are not dealt again."""
    return max(spark.sparkContext.defaultParallelism, -(-sum(f.getLen() for f in _files(spark, inputs)) // BUCKET_BYTES))


def stored(spark: SparkSession, name: str, inputs: list[str], make: Callable[[], DataFrame], by: str, order: str) -> DataFrame:
    """A table made from `inputs` (paths) once in a session, bucketed by the column `by` and sorted by `order` within.

    Plans that group, order or join by `by` read it without an exchange.  It is made anew when a file of its inputs
    has another length or time, and deleted with the session's scratch tables.
    """
    state = [name, *(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in _files(spark, inputs))]
    key = "folioscope_" + hashlib.sha256("\n".join(state).encode()).hexdigest()[:24]
    known = spark.__dict__.setdefault("_folioscope_stored", set())
    if key not in known or not spark.catalog.tableExists(key):
        path = f"{scratch_dir(spark)}/folioscope/{name}-{uuid.uuid4().hex}"
        n = buckets(spark, inputs)
        rows = make().repartition(n, by)
        _made.append((spark, path))
        writer = rows.write.bucketBy(n, by).sortBy(by, order).option("path", path).option("compression", "zstd")
        _written(spark, lambda: writer.mode("overwrite").saveAsTable(key))
        known.add(key)
    return spark.table(key)


@atexit.register
def clear() -> None:
    """Delete the tables of this process; also runs when it ends."""
    while _made:
        spark, path = _made.pop()
        try:
            fs, where = _fs(spark, path)
            fs.delete(where, True)
        except Exception:  # noqa: BLE001  the session may have ended
            pass
