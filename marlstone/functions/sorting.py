"""Sort keys: nulls last, ascending or descending, unless asked otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def sort_key(key: str | Column, descending: bool = False, nulls_first: bool = False) -> Column:
    """A column's sort key; a text may say it all: "name desc nulls first"."""
    if isinstance(key, str):
        m = re.fullmatch(r"\s*(.+?)(?:\s+(asc|desc))?(?:\s+nulls\s+(first|last))?\s*", key, re.I | re.S)
        key, descending, nulls_first = F.expr(m[1]), descending or (m[2] or "").lower() == "desc", nulls_first or (m[3] or "").lower() == "first"
    if descending:
        return key.desc_nulls_first() if nulls_first else key.desc_nulls_last()
    return key.asc_nulls_first() if nulls_first else key.asc_nulls_last()
