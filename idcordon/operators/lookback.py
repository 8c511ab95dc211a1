"""The last value before each row, also where one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idcordon.functions.sql import name


def last_before(
    df: DataFrame, keys: list[str], order: list[str], segment: str, values: dict[str, str]
) -> DataFrame:
    """Add, for each of ``values``, its last non-null value among earlier rows of the same keys.

    A plain window would sort all rows of a key in one task. Here ``segment`` (an SQL
    expression that does not decrease in ``order``) cuts each key into stretches: rows
    look back inside their stretch, and one row per stretch tells what came before it.
    Null keys are keys like any other.
    """
    cut = df.select(
        "*",
        *[F.expr(value).alias(f"_value_{out}") for out, value in values.items()],
        F.expr(segment).alias("_segment"),
    )
    stretch = [*keys, "_segment"]
    inside = Window.partitionBy(*stretch).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    place = f"struct({', '.join(name(o) for o in order)})"
    ends = cut.groupBy(*stretch).agg(
        *[
            F.expr(
                f"max_by(_value_{out}, {place}) FILTER (WHERE _value_{out} IS NOT NULL)"
            ).alias(f"_end_{out}")
            for out in values
        ]
    )
    carried = ends.select(
        *stretch,
        *[F.last(f"_end_{out}", ignorenulls=True).over(across).alias(f"_carried_{out}") for out in values],
    )
    looked = cut.select(
        *df.columns,
        "_segment",
        *[F.last(f"_value_{out}", ignorenulls=True).over(inside).alias(f"_inside_{out}") for out in values],
    )
    ends = carried.toDF(*[f"_of_{c}" for c in stretch], *carried.columns[len(stretch) :])
    same = F.expr(" AND ".join(f"{name(c)} <=> {name(f'_of_{c}')}" for c in stretch))
    return looked.join(ends, same, "left").select(
        *[F.col(name(c)) for c in df.columns],
        *[F.coalesce(f"_inside_{out}", f"_carried_{out}").alias(out) for out in values],
    )
