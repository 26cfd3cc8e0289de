"""Small column helpers used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.window import WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Order of events inside a session: time, then the raw hit number as the
# tie-break so that ordered aggregates are deterministic.
EVENT_ORDER = ("trace_time", "event_seq_num")


def epoch_millis(df: DataFrame, column: str) -> Column:
    """Epoch milliseconds (floored) of a timestamp column, time-zone independent
    for ``TIMESTAMP_NTZ`` and absolute for ``TIMESTAMP``."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return F.expr(
            f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{column}`)"
        )
    return F.unix_millis(F.col(column))


def first_by_order(value: str | Column, *order: str) -> Column:
    """Value of the first row by ``order`` (NULL values are kept, unlike
    ``first(ignorenulls)``); partial-aggregatable (``min_by``)."""
    order = order or EVENT_ORDER
    v = F.col(value) if isinstance(value, str) else value
    return F.min_by(v, F.struct(*[F.col(c) for c in order]))


def majority_value(value: str, over: WindowSpec | None = None, where: Column | None = None) -> Column:
    """Most frequent value with NULL counted as a value; ties go to the
    smallest value, NULL first. ``mode`` keeps a value→count map per group and
    merges map-side, so a hot group is pre-aggregated. With ``over`` it is
    evaluated as a window aggregate; only rows satisfying ``where`` count."""
    # As text, NULL the empty one and any other behind a letter: ``mode`` finds
    # a struct that was spilled and one that was not different, though equal.
    held = F.coalesce(F.concat(F.lit("v"), F.col(value).cast("string")), F.lit(""))
    agg = F.mode(held if where is None else F.when(where, held), deterministic=True)
    return F.substr(F.nullif(agg if over is None else agg.over(over), F.lit("")), F.lit(2))
