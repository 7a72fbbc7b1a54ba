"""From SQL text to plans: tokens, statements, and reports on plans."""

from .explain import PlanReport, report
from .rewrite import rewrite
from .statements import Copy, Explain, Select, parse_statement, split_statements

__all__ = ["Copy", "Explain", "PlanReport", "Select", "parse_statement", "report", "rewrite", "split_statements"]
