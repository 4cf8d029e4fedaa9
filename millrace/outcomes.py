"""What a statement comes to: a category, a stable code and a message."""

from __future__ import annotations

from dataclasses import dataclass

CATEGORIES = ("SUCCESS", "VALIDATION", "CONSTRAINT", "EXECUTION", "INFRA")


class WarehouseError(Exception):
    """A failed statement; `code` is stable, the message is for people."""

    category = "EXECUTION"

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code, self.message = code, message


class ValidationError(WarehouseError):
    category = "VALIDATION"


class ConstraintError(WarehouseError):
    category = "CONSTRAINT"


class InfraError(WarehouseError):
    category = "INFRA"


@dataclass(frozen=True)
class Outcome:
    category: str
    code: str
    message: str
    rows: object = None

    @property
    def ok(self) -> bool:
        return self.category == "SUCCESS"

    @property
    def status(self) -> str:
        return "OK" if self.ok else "ERROR"

    @property
    def error_code(self) -> str:
        """0, or the code with its category before it."""
        if self.ok:
            return "0"
        if self.category not in CATEGORIES:
            return "INFRA_UNKNOWN_CATEGORY"
        return self.code if self.code.startswith(self.category) else f"{self.category}_{self.code}"

    def envelope(self) -> str:
        return f"RESULT|{self.category}|{self.code}|{self.message}"

    @classmethod
    def of_envelope(cls, text: str) -> Outcome:
        parts = text.split("|", 3)
        if parts[0] != "RESULT":
            return cls("INFRA", "GENERIC", text)
        return cls(*(parts[1:] + ["INFRA", "UNKNOWN", "unknown error"][len(parts) - 1 :]))

    @classmethod
    def of_error(cls, error: WarehouseError) -> Outcome:
        return cls(error.category, error.code, error.message)
