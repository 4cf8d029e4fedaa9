"""Partition specifications and the exchanges they stand for. No row is lost or doubled by any of them."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.outcomes import ValidationError


@dataclass(frozen=True)
class Spec:
    kind: str
    keys: tuple[str, ...] = ()
    bounds: tuple = ()


def _bad(message: str) -> ValidationError:
    return ValidationError("VALIDATION_UNSUPPORTED_OPERATOR", message)


def parse(text: str) -> Spec:
    """`single`, `broadcast`, `round_robin`, {"Hash": {"keys": [...]}} or {"Range": {"column": c, "bounds": [...]}}."""
    # The names of partitionings and of their keys
    plain = text.strip().strip('"').lower()
    if plain in ("", "single", "singlepartition", "single_partition"):
        return Spec("single")
    if plain == "broadcast":
        return Spec("broadcast")
    if plain in ("roundrobin", "round_robin", "round_robin_batch", "roundrobinbatch"):
        return Spec("round_robin")
    try:
        held = json.loads(text)
    except ValueError:
        raise _bad(f"unknown partitioning {text!r}") from None
    if isinstance(held, dict) and "Hash" in held:
        keys = held["Hash"].get("keys") or held["Hash"].get("key_columns")
        if not keys:
            raise _bad("hash partitioning needs keys")
        return Spec("hash", tuple(keys))
    if isinstance(held, dict) and "Range" in held:
        body = held["Range"]
        column = next((str(body[k]).strip() for k in ("column", "partition_key_column", "key_column") if body.get(k)), "")
        if not column or not isinstance(body.get("bounds"), list):
            raise _bad("range partitioning needs a column and bounds")
        return Spec("range", (column,), tuple(body["bounds"]))
    raise _bad(f"unknown partitioning {text!r}")


def apply(df: DataFrame, spec: Spec | str, n: int = 4) -> DataFrame:
    """The rows dealt to partitions. Range bounds name partitions exactly; without them Spark samples its own."""
    spec = parse(spec) if isinstance(spec, str) else spec
    if spec.kind == "hash":
        return df.repartition(n, *spec.keys)
    if spec.kind == "round_robin":
        return df.repartition(n)
    if spec.kind in ("single", "broadcast"):  # both route every row to one partition; what makes the rows keeps its own
        return df.repartition(1)
    if not spec.bounds:
        return df.repartitionByRange(n, *[F.col(k).asc_nulls_last() for k in spec.keys])
    return df.withColumn("__at", range_number(spec)).repartitionById(len(spec.bounds) + 1, "__at").drop("__at")


def range_number(spec: Spec):  # noqa: ANN201
    """The number of bounds at or below the key: 0 to their count. NULLs are last."""
    key = F.col(spec.keys[0])
    out = sum((F.when(key >= F.lit(b), 1).otherwise(0) for b in sorted(spec.bounds)), F.lit(0))
    return F.when(key.isNull(), len(spec.bounds)).otherwise(out)
