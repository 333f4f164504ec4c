"""Rows of a key in order, cut into stored range slices.

Order-dependent rules (folds, sessions, running counts) need the rows of a key in
order, but a key may hold a third of all rows.  `numbered` range-partitions and
sorts the rows once and stores them with a running number; a rule is then worked out
per key and slice, and what slices hand on - a row or two each - is combined per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import stored


def numbered(df: DataFrame, by: list[str]) -> DataFrame:
    """The columns of `df`, stored in the order of `by` with _n (rising) and _slice; rows of one slice stand together."""
    order = [F.col(c).asc_nulls_last() for c in by]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id())
    return stored(placed, "slices").withColumn("_slice", F.shiftright("_n", 33))
