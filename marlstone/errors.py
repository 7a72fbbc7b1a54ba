"""The errors that users can tell apart, each standing for some of Spark's error classes."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException


class EngineError(Exception):
    """Any error of the engine."""


class ParseError(EngineError):
    """The text isn't a statement that the engine takes."""


class UnsupportedError(ParseError):
    """A statement of a kind that the engine leaves out."""


class UnknownColumn(EngineError):
    pass


class AmbiguousColumn(EngineError):
    pass


class UnknownTable(EngineError):
    pass


class TypeMismatch(EngineError):
    pass


class InvalidCast(EngineError):
    pass


class NumericOverflow(EngineError):
    """A sum or cast beyond its type's range."""


class DivisionByZero(EngineError):
    pass


class OrdinalOutOfRange(EngineError):
    pass


class SubqueryCardinality(EngineError):
    """A scalar subquery gave more than one row."""


class SchemaMismatch(EngineError):
    """The files of a table have different schemas."""


class CatalogError(EngineError):
    pass


#: Beginnings of Spark's error conditions.
CONDITIONS: list[tuple[str, type[EngineError]]] = [
    ("UNRESOLVED_COLUMN", UnknownColumn), ("FIELD_NOT_FOUND", UnknownColumn), ("UNRESOLVED_STAR", UnknownColumn), ("CANNOT_RESOLVE_STAR", UnknownColumn),
    ("AMBIGUOUS_", AmbiguousColumn), ("TABLE_OR_VIEW_NOT_FOUND", UnknownTable), ("PATH_NOT_FOUND", UnknownTable), ("UNABLE_TO_INFER_SCHEMA", UnknownTable),
    ("CAST_", InvalidCast), ("DATATYPE_MISMATCH", TypeMismatch), ("NUMERIC_VALUE_OUT_OF_RANGE", InvalidCast), ("INVALID_TYPED_LITERAL", InvalidCast), ("INCOMPATIBLE_COLUMN_TYPE", TypeMismatch),
    ("ORDER_BY_POS_OUT_OF_RANGE", OrdinalOutOfRange), ("GROUP_BY_POS_OUT_OF_RANGE", OrdinalOutOfRange), ("SCALAR_SUBQUERY_TOO_MANY_ROWS", SubqueryCardinality),
    ("ARITHMETIC_OVERFLOW", NumericOverflow), ("BINARY_ARITHMETIC_OVERFLOW", NumericOverflow), ("DIVIDE_BY_ZERO", DivisionByZero), ("REMAINDER_BY_ZERO", DivisionByZero), ("PARSE_SYNTAX_ERROR", ParseError),
]


def translate(e: Exception) -> Exception:
    """The engine's error for one of Spark's, or the same error."""
    condition = e.getCondition() if isinstance(e, PySparkException) else None
    if condition is None and isinstance(e, Py4JJavaError) and (m := re.search(r"\[([A-Z][A-Z_]+(?:\.[A-Z_]+)*)\]", str(e.java_exception))):
        condition = m[1]
    for start, kind in CONDITIONS:
        if condition and condition.startswith(start):
            return kind(str(e))
    return e
