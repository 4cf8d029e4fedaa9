"""Results kept as Parquet with a sidecar of owner, rows, columns and each file's size, rows and hash.

Hashes are sums over rows, made in the executors; the driver sees one line a file. Sizes are held against the sidecar
on every load, rows and hashes on demand.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.outcomes import WarehouseError
from millrace.sources.files import files, joined

META = "_result_metadata.json"  # hidden from Parquet readers by its first character


def _hashes(df: DataFrame) -> dict[str, dict]:
    """Rows and the sum of row hashes of each file that `df` reads."""
    row = F.xxhash64(*[F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in df.schema])
    seen = df.select(F.col("_metadata.file_name").alias("key"), row.cast("decimal(20,0)").alias("h"))
    return {r.key: {"rows": r.rows, "checksum": str(r.h)} for r in seen.groupBy("key").agg(F.count("*").alias("rows"), F.sum("h").alias("h")).collect()}


def materialise(df: DataFrame, path: str, **owner: str) -> dict:
    """Write the result and its sidecar; returns the sidecar. `owner` says who may fetch it."""
    store = files(path)
    df.write.mode("overwrite").parquet(path)
    sizes = {k: n for k, n in store.sizes(path).items() if k.endswith(".parquet")}
    found = _hashes(df.sparkSession.read.schema(df.schema).parquet(path)) if sizes else {}
    artifacts = [{"key": k, "size_bytes": n, **found.get(k, {"rows": 0, "checksum": "None"})} for k, n in sorted(sizes.items())]
    meta = {"rows": sum(a["rows"] for a in artifacts), "columns": df.columns, "schema": df.schema.jsonValue(), "artifacts": artifacts, "owner": owner}
    if not store.put_new(joined(path, META), json.dumps(meta)):
        raise WarehouseError("EXECUTION_RESULT_METADATA_EXISTS", f"another writer has {path}")
    return meta


def metadata(path: str) -> dict:
    held = files(path).read(joined(path, META))
    if held is None:
        raise WarehouseError("EXECUTION_RESULT_METADATA_MISSING", f"no result at {path}")
    return json.loads(held)


def load(spark: SparkSession, path: str, hashes: bool = False) -> DataFrame:
    """The result, once its files' sizes (and with `hashes` their rows) have been held against the sidecar."""
    meta = metadata(path)
    schema, sizes = T.StructType.fromJson(meta["schema"]), files(path).sizes(path)
    for a in meta["artifacts"]:
        if a["key"] not in sizes:
            raise WarehouseError("EXECUTION_RESULT_ARTIFACT_MISSING", a["key"])
        if sizes[a["key"]] != a["size_bytes"]:
            raise WarehouseError("EXECUTION_RESULT_SIZE_BYTES_MISMATCH", a["key"])
    df = spark.read.schema(schema).parquet(*[joined(path, a["key"]) for a in meta["artifacts"]]) if meta["artifacts"] else spark.createDataFrame([], schema)
    if hashes and meta["artifacts"]:
        try:
            found = _hashes(df)
        except Exception as error:
            raise WarehouseError("EXECUTION_RESULT_CHECKSUM_MISMATCH", f"{path}: {str(error).splitlines()[0]}") from None
        for a in meta["artifacts"]:
            if found.get(a["key"], {"rows": 0, "checksum": "None"}) != {k: a[k] for k in ("rows", "checksum")}:
                raise WarehouseError("EXECUTION_RESULT_CHECKSUM_MISMATCH", a["key"])
    return df


def batches(spark: SparkSession, path: str, rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """The result as Arrow batches, a file at a time: the driver never holds more than one file's rows."""
    meta = metadata(path)
    load(spark, path)
    schema = T.StructType.fromJson(meta["schema"])
    for a in meta["artifacts"]:
        if a["rows"]:
            yield from spark.read.schema(schema).parquet(joined(path, a["key"])).toArrow().to_batches(max_chunksize=rows)
