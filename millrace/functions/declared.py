"""Declared column types, and the literals that may be inserted into them.

TIMESTAMP and DATETIME stay apart: both are held without a zone, a TIMESTAMP literal with an offset is
brought to UTC, a DATETIME literal must not have one. DECIMAL literals must fit exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, date, datetime
from decimal import Decimal, InvalidOperation

from pyspark.sql import types as T

from millrace.outcomes import ValidationError

# Declared names by family
_NAMES = {
    "BIGINT": T.LongType(), "INT8": T.LongType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(),
    "SMALLINT": T.ShortType(), "INT2": T.ShortType(), "TINYINT": T.ByteType(),
    "FLOAT": T.FloatType(), "REAL": T.FloatType(), "DOUBLE": T.DoubleType(),
    "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(), "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampNTZType(), "DATETIME": T.TimestampNTZType(), "BINARY": T.BinaryType(),
    "CHAR": T.StringType(), "VARCHAR": T.StringType(), "TEXT": T.StringType(), "STRING": T.StringType(),
    "UUID": T.StringType(), "JSON": T.StringType(),
}
_DECLARED = re.compile(r"\s*([A-Za-z]\w*)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*")
_WIDTH = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


@dataclass(frozen=True)
class Column:
    name: str
    declared: str
    nullable: bool = True

    def field(self) -> T.StructField:
        return T.StructField(self.name, spark_type(self.declared), self.nullable, {"logical": family(self.declared).lower()})


def family(declared: str) -> str:
    m = _DECLARED.match(declared)
    return m[1].upper() if m else declared


def spark_type(declared: str) -> T.DataType:
    """The Spark type of a declared one; anything else breaks the contract."""
    m = _DECLARED.fullmatch(declared)
    name = m[1].upper() if m else ""
    if name in ("DECIMAL", "NUMERIC"):
        if not m[2]:
            raise ValidationError("INVALID_DATATYPE_CONTRACT", f"{declared}: precision and scale are required")
        p, s = int(m[2]), int(m[3] or 0)
        if not 1 <= p <= 38 or s > p:
            raise ValidationError("INVALID_DATATYPE_CONTRACT", f"{declared}: precision or scale out of range")
        return T.DecimalType(p, s)
    if name not in _NAMES or (m[2] and name not in ("CHAR", "VARCHAR", "TIMESTAMP", "DATETIME", "TEXT", "STRING", "BINARY")):
        raise ValidationError("INVALID_DATATYPE_CONTRACT", f"unsupported type {declared}")
    return _NAMES[name]


def _temporal(text: str, column: str) -> datetime:
    for form in ("%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d"):
        try:
            return datetime.strptime(text, form)
        except ValueError:
            continue
    try:
        return datetime.fromisoformat(text)
    except ValueError:
        raise ValidationError("VALIDATION_TEMPORAL_LITERAL_INVALID", f"{column}: {text!r} is no temporal literal") from None


def exact_decimal(text: str, precision: int, scale: int, column: str = "value") -> Decimal:
    """The literal with `scale` digits after the point, or an error if that would change it."""
    text = str(text).strip()
    if not re.fullmatch(r"[+-]?\d+(\.\d+)?", text):
        raise ValidationError("VALIDATION_DECIMAL_COERCION_FAILED", f"{column}: {text!r} is no plain decimal")
    try:
        value = Decimal(text)
        fixed = value.quantize(Decimal(1).scaleb(-scale)) if scale else value.quantize(Decimal(1))
    except InvalidOperation:
        raise ValidationError("VALIDATION_DECIMAL_COERCION_FAILED", f"{column}: {text} exceeds ({precision},{scale})") from None
    if fixed != value or len(fixed.as_tuple().digits) > max(precision, scale + 1) or abs(fixed) >= Decimal(10) ** (precision - scale):
        raise ValidationError("VALIDATION_DECIMAL_COERCION_FAILED", f"{column}: {text} does not fit ({precision},{scale})")
    return fixed


def literal(value: object, column: Column) -> object:
    """A parsed SQL literal (None, bool, int, Decimal or str) as the column's Python value."""
    if value is None:
        return None
    kind, name = spark_type(column.declared), family(column.declared)
    bad = ValidationError("VALIDATION_INSERT_TYPE_MISMATCH", f"{column.name}: {value!r} is no {column.declared}")
    if isinstance(kind, T.DecimalType):
        if isinstance(value, bool):
            raise bad
        return exact_decimal(str(value), kind.precision, kind.scale, column.name)
    if isinstance(kind, T.TimestampNTZType):
        if isinstance(value, bool) or not isinstance(value, (str, int)):
            raise bad
        if isinstance(value, int):  # milliseconds since the epoch
            return datetime.fromtimestamp(value / 1000, UTC).replace(tzinfo=None)
        found = _temporal(value.strip(), column.name)
        if found.tzinfo:
            if name == "DATETIME":
                raise ValidationError("VALIDATION_DATETIME_TIMEZONE_NOT_ALLOWED", f"{column.name}: a DATETIME has no zone: {value!r}")
            found = found.astimezone(UTC).replace(tzinfo=None)
        return found
    if isinstance(kind, T.DateType):
        if not isinstance(value, str):
            raise bad
        try:
            return date.fromisoformat(value.strip())
        except ValueError:
            raise ValidationError("VALIDATION_TEMPORAL_LITERAL_INVALID", f"{column.name}: {value!r} is no date") from None
    if isinstance(kind, T.BooleanType):
        if isinstance(value, str) and value.lower() in ("true", "false"):
            return value.lower() == "true"
        if not isinstance(value, bool):
            raise bad
        return value
    if type(kind) in _WIDTH:
        if isinstance(value, bool):
            raise bad
        try:
            number = int(str(value))
        except ValueError:
            raise bad from None
        if not -(1 << _WIDTH[type(kind)] - 1) <= number < 1 << _WIDTH[type(kind)] - 1:
            raise bad
        return number
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        if isinstance(value, bool):
            raise bad
        try:
            return float(value)
        except (TypeError, ValueError):
            raise bad from None
    if isinstance(kind, T.BinaryType):
        return value.encode() if isinstance(value, str) else bytes(str(value), "ascii")
    return ("true" if value else "false") if isinstance(value, bool) else str(value)
