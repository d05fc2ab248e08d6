"""Errors of the engine, with a severity and hints for the shell."""

from __future__ import annotations


class EngineError(Exception):
    severity = "error"

    def __init__(self, message: str, *hints: str) -> None:
        super().__init__(message)
        self.hints = list(hints)


class ParseError(EngineError):
    pass


class TypeMismatch(EngineError):
    pass


class CatalogError(EngineError):
    pass


class ConstraintViolation(EngineError):
    pass


class UniqueViolation(ConstraintViolation):
    def __init__(self, name: str) -> None:
        super().__init__(f"Unique constraint '{name}' violated.", "Change the key, or remove the row that has it.")


class ForeignKeyViolation(ConstraintViolation):
    def __init__(self, name: str) -> None:
        super().__init__(f"Foreign key constraint '{name}' violated.", "Insert the referenced row first.")


class RangeViolation(ConstraintViolation):
    pass


class TransactionConflict(EngineError):
    """The tables that a transaction writes have changed since its snapshot; running it again may succeed."""


class SequenceExhausted(EngineError):
    pass
