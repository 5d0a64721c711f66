"""Where intermediate tables live (see :mod:`threadloom.scratch`), and bounded picks by a hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.scratch import drop, table


def pick(rows: DataFrame, turn: Column, most: int, *ties: str) -> DataFrame:
    """``rows``, or the ``most`` first of them by the hash ``turn`` if there are more.

    A bound on the hash comes first, so that no task ranks more than about the rows that are used."""
    n = rows.count()
    if n <= most:
        return rows
    share = min(1.0, 1.2 * most / n + 100 / n)
    bound = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
    return rows.filter(turn <= F.lit(bound)).orderBy(turn, *ties).limit(most)


__all__ = ["drop", "pick", "table"]
