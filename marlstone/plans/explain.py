"""What a plan does, read from its text."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class PlanReport:
    """Operators by name, columns read and filters pushed per scan, and rewrites that took place."""

    operators: dict[str, int]
    read: list[str]
    pushed: list[str]
    rewrites: list[str]
    text: str


#: What a physical operator tells of the rewrite that made it.
TELLS = {
    "LeftSemi": "subquery to semi-join", "LeftAnti": "subquery to anti-join", "ExistenceJoin": "subquery to existence join", "BroadcastHashJoin": "join with a small side sent to all",
    "TakeOrderedAndProject": "sort and limit to top-n", "partial_": "aggregation in two steps", "Subquery": "scalar subquery run once",
}


def report(df: DataFrame) -> PlanReport:
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    names = re.findall(r"^[\s:+\-*|]*\*?\s*(?:\(\d+\) )?([A-Z]\w+)", plan.split("\n\n")[0], re.M)
    return PlanReport(dict(Counter(names)), re.findall(r"ReadSchema: (.*)", plan), re.findall(r"PushedFilters: (.*)", plan), [v for k, v in TELLS.items() if k in plan], plan)
