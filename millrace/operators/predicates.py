"""The predicate tree: comparisons, BETWEEN, IN, NULL tests, joined by AND. It becomes a Column, SQL or JSON."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.outcomes import ValidationError

OPS = ("=", "!=", "<", "<=", ">", ">=")


def _sql(value: object) -> str:
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, Decimal):
        return f"{value:f}"
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def _bad(message: str) -> ValidationError:
    return ValidationError("VALIDATION_UNSUPPORTED_PREDICATE", message)


def _tagged(value: object) -> object:
    for kind, name in ((Decimal, "decimal"), (datetime, "timestamp"), (date, "date")):
        if isinstance(value, kind):
            return {name: str(value)}
    return value


def _untagged(value: object) -> object:
    if not isinstance(value, dict):
        return value
    name, text = next(iter(value.items()))
    return {"decimal": Decimal, "timestamp": datetime.fromisoformat, "date": date.fromisoformat}[name](text)


class Predicate:
    def column_expression(self) -> Column:
        raise NotImplementedError

    def sql(self) -> str:
        raise NotImplementedError

    def columns(self) -> set[str]:
        return {self.column}

    def __and__(self, other: Predicate) -> And:
        return And(tuple(x for p in (self, other) for x in (p.parts if isinstance(p, And) else (p,))))

    def to_json(self) -> dict:
        """Plain JSON; literals that JSON lacks are tagged."""
        return {"kind": type(self).__name__, **{k: [_tagged(x) for x in v] if isinstance(v, tuple) else _tagged(v) for k, v in asdict(self).items()}}


@dataclass(frozen=True)
class Compare(Predicate):
    column: str
    op: str
    value: object

    def __post_init__(self):
        if self.op not in OPS or self.value is None:
            raise _bad(f"{self.column} {self.op} {self.value!r}")

    def column_expression(self) -> Column:
        c = F.col(self.column)
        return {"=": c == self.value, "!=": c != self.value, "<": c < self.value, "<=": c <= self.value, ">": c > self.value, ">=": c >= self.value}[self.op]

    def sql(self) -> str:
        return f"{self.column} {self.op} {_sql(self.value)}"


@dataclass(frozen=True)
class Between(Predicate):
    column: str
    low: object
    high: object
    negated: bool = False

    def column_expression(self) -> Column:
        inside = F.col(self.column).between(self.low, self.high)
        return ~inside if self.negated else inside

    def sql(self) -> str:
        return f"{self.column} {'NOT ' * self.negated}BETWEEN {_sql(self.low)} AND {_sql(self.high)}"


@dataclass(frozen=True)
class In(Predicate):
    column: str
    values: tuple

    def __post_init__(self):
        if not self.values or len({type(v) for v in self.values}) > 1 or type(self.values[0]) not in (int, str, bool, Decimal, date, datetime):
            raise _bad(f"{self.column} IN needs literals of one kind")

    def column_expression(self) -> Column:
        return F.col(self.column).isin(*self.values)

    def sql(self) -> str:
        return f"{self.column} IN ({', '.join(map(_sql, self.values))})"


@dataclass(frozen=True)
class IsNull(Predicate):
    column: str

    def column_expression(self) -> Column:
        return F.col(self.column).isNull()

    def sql(self) -> str:
        return f"{self.column} IS NULL"


@dataclass(frozen=True)
class IsNotNull(Predicate):
    column: str

    def column_expression(self) -> Column:
        return F.col(self.column).isNotNull()

    def sql(self) -> str:
        return f"{self.column} IS NOT NULL"


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...]

    def column_expression(self) -> Column:
        out = self.parts[0].column_expression()
        for p in self.parts[1:]:
            out = out & p.column_expression()
        return out

    def sql(self) -> str:
        return " AND ".join(p.sql() for p in self.parts)

    def columns(self) -> set[str]:
        return set().union(*(p.columns() for p in self.parts))

    def to_json(self) -> dict:
        return {"kind": "And", "parts": [p.to_json() for p in self.parts]}


def from_json(held: dict) -> Predicate:
    held = dict(held)
    kind = held.pop("kind")
    if kind == "And":
        return And(tuple(map(from_json, held["parts"])))
    held = {k: tuple(map(_untagged, v)) if isinstance(v, (list, tuple)) else _untagged(v) for k, v in held.items()}
    return {"Compare": Compare, "Between": Between, "In": In, "IsNull": IsNull, "IsNotNull": IsNotNull}[kind](**held)


def typed(p: Predicate, schema: T.StructType) -> Predicate:
    """Check literals against the schema; temporal text becomes a date or timestamp."""
    if isinstance(p, And):
        return And(tuple(typed(x, schema) for x in p.parts))
    by_name = {f.name.lower(): f.dataType for f in schema}
    kind = by_name.get(p.column.split(".")[-1].lower())
    if kind is None:
        raise _bad(f"no column {p.column}")

    def fit(v: object) -> object:
        if isinstance(kind, T.DateType) and isinstance(v, str):
            return date.fromisoformat(v.strip()[:10])
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) and isinstance(v, str):
            return datetime.fromisoformat(v.strip())
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) and type(v) is date:
            return datetime(v.year, v.month, v.day)
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            fine = isinstance(v, (date, datetime))
        elif isinstance(kind, T.BooleanType):
            fine = isinstance(v, bool)
        elif isinstance(kind, T.StringType):
            fine = isinstance(v, str)
        elif isinstance(kind, T.NumericType):
            fine = isinstance(v, (int, float, Decimal)) and not isinstance(v, bool)
        else:
            fine = True
        if not fine:
            raise _bad(f"{p.column}: {v!r} does not fit {kind.simpleString()}")
        return v

    try:
        if isinstance(p, Compare):
            return Compare(p.column, p.op, fit(p.value))
        if isinstance(p, Between):
            return Between(p.column, fit(p.low), fit(p.high), p.negated)
        if isinstance(p, In):
            return In(p.column, tuple(map(fit, p.values)))
    except ValueError as error:
        raise _bad(f"{p.column}: {error}") from None
    return p
