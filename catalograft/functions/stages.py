"""Keep costly array columns from being evaluated more than once.

Catalyst copies a column's definition into every filter it pushes below a
projection, and derives such filters by itself for `explode`. For a column that
parses a whole page this multiplies the work at each stage. A generator's output
is never rewritten that way, so these helpers compute a column exactly once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def built_once(build: Callable) -> Callable:
    """Reuse the expressions a function builds for equal arguments.

    Every part of an expression is a call to the JVM, so the large page
    expressions take longer to build than to plan. They do not depend on a
    DataFrame, only on column names, and stay valid for one application.
    """
    built: dict = {}

    @wraps(build)
    def reuse(*args):
        session = SparkSession.getActiveSession()
        if session is None:
            return build(*args)
        key = (session.sparkContext.applicationId, args)
        if key not in built:
            built[key] = build(*args)
        return built[key]

    return reuse


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` evaluated once instead of at every place it occurs."""
    return F.transform(F.array(value), use)[0]


def pinned(df: DataFrame, keep: list[str], **computed: Column) -> DataFrame:
    """Columns `keep` plus `computed`; filters on the latter stay above this step."""
    row = F.struct(*(c.alias(name) for name, c in computed.items()))
    return df.select(*keep, F.inline_outer(F.array(row)))


def exploded(df: DataFrame, keep: list[str], items: Column, name: str) -> DataFrame:
    """One row per array element with its position as `pos`; empty arrays give none."""
    return df.select(*keep, F.posexplode_outer(items).alias("pos", name)).where(
        F.col("pos").isNotNull()
    )
