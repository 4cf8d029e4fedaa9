"""Helpers that the training-data operators share: scratch tables, code shipping, batches."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python step holds at a time.
BATCH_BYTES = 12 << 20
#: Rows of an Arrow batch: Spark builds each outside its heap, and a row may be a long text.
ARROW_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one is made only where none is named and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
    return own


_written: dict[str, SparkSession] = {}


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file systems, so any shared store works."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.pop(path, None)


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_written.items()):
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            return


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries begun within drop their shuffle files when they end: what they made is in a table by then."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was) if was else spark.conf.unset(key)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back. Lost executors cost no rework."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a scratch table that no later plan reads."""
    drop_path(df.sparkSession, df.scratch)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, and keep Arrow batches of texts small."""
    context = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    if getattr(context, "_millrace_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(top, f)
                    z.write(full, os.path.join("millrace", os.path.relpath(full, root)))
    path = os.path.join(tempfile.mkdtemp(prefix="millrace-code-"), "millrace_code.zip")
    with open(path, "wb") as out:
        out.write(held.getvalue())
    context.addPyFile(path)
    context._millrace_shipped = True


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that tell rows of different ids or texts apart, the same whenever a table is read."""
    named = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in (doc_id, text)]
    return F.unhex(F.md5(F.concat(named[0], F.lit("\0"), named[1]).cast("binary")))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def sampled(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most `n` rows, those of least hashed `key` (then key).

    Rows are first filtered by a bound on the hash that about 4 n of all rows meet, so that the tasks
    together send some multiples of n rows, however many tasks there are.
    """
    share = min(1.0, 4.0 * n / max(df.count(), 1))
    hashed = F.xxhash64(key)
    few = df if share == 1.0 else df.where(F.pmod(hashed, F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    return few.orderBy(F.pmod(hashed, F.lit(1 << 40)), key).limit(n)


def document_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: others, whatever they are called, play no part."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `limit` bytes of text, or one longer row."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        lengths = pa.compute.binary_length(batch.column(column).cast(pa.large_string())).fill_null(0).to_numpy(zero_copy_only=False)
        ends = lengths.cumsum()
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(ends.searchsorted(base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
