"""Scalar functions, sort keys and aggregates whose rules differ from Spark's own; all are built-in
expressions, so that they stay within generated code."""

from .aggregates import avg, count, count_distinct, count_if, maximum, minimum, total
from .scalars import (
    absolute, add, concat, date_number, decimal_product, divide_exact, ceil, floor, int_div, length, list_at, list_length, multiply, round_half_up, subtract, substring, trim_unicode, year_of,
)
from .sorting import sort_key

__all__ = [
    "absolute", "add", "avg", "ceil", "concat", "count", "count_distinct", "count_if", "date_number", "decimal_product", "divide_exact", "floor", "int_div", "length", "list_at", "list_length",
    "maximum", "minimum", "multiply", "round_half_up", "sort_key", "substring", "subtract", "total", "trim_unicode", "year_of",
]
