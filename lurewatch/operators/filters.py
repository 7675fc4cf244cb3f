"""Mailbox search terms as a Column predicate, so the date bound reaches the parquet scan."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days per unit.
UNIT_DAYS = {"d": 1, "m": 30, "y": 365}


def mailbox_query(query: str, as_of: Column) -> Column:
    """`newer_than:N[d|m|y]`, `is:unread` and `from:text`; any other term is dropped rather than guessed at."""
    out = F.lit(True)
    newer = re.search(r"newer_than:(\d+)([dmy])", query)
    if newer:
        days = int(newer.group(1)) * UNIT_DAYS[newer.group(2)]
        out = out & (F.col("sent_at") >= F.date_sub(F.to_date(as_of), days).cast("timestamp"))
    if "is:unread" in query:
        out = out & F.col("unread")
    sender = re.search(r"from:(\S+)", query)
    if sender:
        out = out & F.lower("sender").contains(sender.group(1).lower())
    return out
