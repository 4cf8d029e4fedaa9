"""Databases, schemas and tables, kept as JSON beside the tables; names are resolved here, not by Spark."""

from __future__ import annotations

import re
from dataclasses import asdict

from pyspark.sql import types as T

from millrace.functions.declared import Column
from millrace.outcomes import Outcome, ValidationError
from millrace.sources.files import joined
from millrace.sources.ledger import Ledger

_PART = re.compile(r"[A-Za-z0-9_-]+")
DEFAULTS = ("default", "public")


def parts(name: str) -> list[str]:
    """A dotted name's parts, unquoted and in lower case."""
    found = [p.strip() for p in re.findall(r'`[^`]*`|"[^"]*"|[^.]+', name.strip())]
    return [(p[1:-1] if p[:1] in "`\"" else p).lower() for p in found]


def qualified(name: str) -> tuple[str, str, str]:
    """database, schema, table; one- and two-part names get the defaults."""
    found = parts(name)
    if not 1 <= len(found) <= 3 or not all(map(_PART.fullmatch, found)):
        raise ValidationError("INVALID_TABLE_NAME", f"{name!r} is no table name")
    return (*DEFAULTS[: 3 - len(found)], *found)


class Catalog:
    """Every read sees the newest state and every change is made to it, whichever engine made it."""

    def __init__(self, root: str):
        self.root, self.ledger = root, Ledger(joined(root, "_catalog"), {"databases": {}})

    @property
    def held(self) -> dict:
        return self.ledger.read()

    def _name(self, text: str, what: str) -> str:
        found = parts(text)
        if len(found) != 1 or not _PART.fullmatch(found[0]):
            raise ValidationError(f"INVALID_{what}_NAME", f"{text!r} is no {what.lower()} name")
        return found[0]

    def _present(self, what: str, name: str, skip: bool) -> Outcome:
        if skip:
            return Outcome("SUCCESS", f"{what}_ALREADY_EXISTS_SKIPPED", f"{what.lower()} {name} already exists")
        raise ValidationError(f"{what}_ALREADY_EXISTS", f"{what.lower()} {name} already exists")

    def create_database(self, name: str, skip: bool = False) -> Outcome:
        name = self._name(name, "DATABASE")

        def change(state: dict) -> Outcome:
            if name in state["databases"]:
                return self._present("DATABASE", name, skip)
            state["databases"][name] = {"schemas": {}}
            return Outcome("SUCCESS", "DATABASE_CREATED", f"database {name} created")

        return self.ledger.update(change)

    @staticmethod
    def _schemas(state: dict, database: str) -> dict:
        if database not in state["databases"]:
            raise ValidationError("DATABASE_NOT_FOUND", f"database {database} not found")
        return state["databases"][database]["schemas"]

    @classmethod
    def _tables(cls, state: dict, database: str, schema: str) -> dict:
        schemas = cls._schemas(state, database)
        if schema not in schemas:
            raise ValidationError("SCHEMA_NOT_FOUND", f"schema {database}.{schema} not found")
        return schemas[schema]["tables"]

    def _two(self, name: str) -> tuple[str, str]:
        found = parts(name)
        if len(found) != 2:
            raise ValidationError("INVALID_SCHEMA_NAMESPACE", f"{name!r}: database.schema is required")
        return found[0], self._name(found[1], "SCHEMA")

    def _three(self, name: str) -> tuple[str, str, str]:
        if len(parts(name)) != 3:
            raise ValidationError("INVALID_TABLE_NAMESPACE", f"{name!r}: database.schema.table is required")
        return qualified(name)

    def create_schema(self, name: str, skip: bool = False) -> Outcome:
        database, schema = self._two(name)

        def change(state: dict) -> Outcome:
            schemas = self._schemas(state, database)
            if schema in schemas:
                return self._present("SCHEMA", f"{database}.{schema}", skip)
            schemas[schema] = {"tables": {}}
            return Outcome("SUCCESS", "SCHEMA_CREATED", f"schema {database}.{schema} created")

        return self.ledger.update(change)

    def create_table(self, name: str, columns: list[Column], skip: bool = False) -> Outcome:
        if not columns or len({c.name.lower() for c in columns}) < len(columns):
            raise ValidationError("INVALID_CONSTRAINT_CONTRACT", "columns must be named, each once")
        for c in columns:
            c.field()
        database, schema, table = self._three(name)

        def change(state: dict) -> Outcome:
            tables = self._tables(state, database, schema)
            if table in tables:
                return self._present("TABLE", f"{database}.{schema}.{table}", skip)
            tables[table] = {"columns": [asdict(c) for c in columns], "engine": "parquet-log"}
            return Outcome("SUCCESS", "TABLE_CREATED", f"table {database}.{schema}.{table} created")

        return self.ledger.update(change)

    def drop_table(self, name: str, skip: bool = False) -> Outcome:
        database, schema, table = self._three(name)
        known = f"{database}.{schema}.{table}"

        def change(state: dict) -> Outcome:
            try:
                del self._tables(state, database, schema)[table]
            except (KeyError, ValidationError):
                if skip:
                    return Outcome("SUCCESS", "TABLE_NOT_FOUND_SKIPPED", f"no table {known}")
                raise ValidationError("VALIDATION_TABLE_NOT_FOUND", f"table not found: {known}") from None
            return Outcome("SUCCESS", "TABLE_DROPPED", f"table {known} dropped")

        return self.ledger.update(change)

    def drop_schema(self, name: str, skip: bool = False) -> Outcome:
        database, schema = self._two(name)

        def change(state: dict) -> Outcome:
            try:
                tables = self._tables(state, database, schema)
            except ValidationError:
                if skip:
                    return Outcome("SUCCESS", "SCHEMA_NOT_FOUND_SKIPPED", f"no schema {database}.{schema}")
                raise
            if tables:
                raise ValidationError("SCHEMA_NOT_EMPTY", f"schema {database}.{schema} has tables {sorted(tables)}")
            del self._schemas(state, database)[schema]
            return Outcome("SUCCESS", "SCHEMA_DROPPED", f"schema {database}.{schema} dropped")

        return self.ledger.update(change)

    def tables(self) -> list[str]:
        """All tables' full names."""
        return [f"{d}.{s}.{t}" for d, held in sorted(self.held["databases"].items()) for s, more in sorted(held["schemas"].items()) for t in sorted(more["tables"])]

    def columns(self, name: str) -> list[Column]:
        database, schema, table = qualified(name)
        try:
            return [Column(**c) for c in self._tables(self.held, database, schema)[table]["columns"]]
        except (KeyError, ValidationError):
            raise ValidationError("VALIDATION_TABLE_NOT_FOUND", f"table not found: {database}.{schema}.{table}") from None

    def schema(self, name: str) -> T.StructType:
        return T.StructType([c.field() for c in self.columns(name)])

    def location(self, name: str) -> str:
        database, schema, table = qualified(name)
        return joined(self.root, "databases", database, "schemas", schema, "tables", table)
