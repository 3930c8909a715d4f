"""Ordered windows that survive a key holding a third of all rows.

``Window.partitionBy(key)`` puts a whole key into one task. Here every key is cut into slices by plain expressions of
its order columns; each slice has its own window, and a carry per slice, from slice totals, joins the pieces:

* by one order column, a slice is a coarse form of it: the minute, the number divided by a span, the first letters;
* by several, a slice is the first column's value with a coarse form of the second, so that a key whose rows
  all have one first value is cut as well. Carries are then summed in two steps, within a first value and over them.

Totals are combined before they are shuffled, from the key, order and amount columns alone. There is one path
whatever the sizes, nothing is counted beforehand, and no job starts while a plan is built. Results equal an ordinary
window's, row for row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

#: Width of a slice in units of a numeric order column; microseconds take ``MINUTE_US``.
SPAN = 100_000
MINUTE_US = 60_000_000


def coarse(df: DataFrame, name: str, span: int) -> Column:
    """A coarse value of an order column that never falls where the column rises; null stays null."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_trunc("minute", name)
    if isinstance(kind, T.DateType):
        return F.trunc(name, "month")
    if isinstance(kind, T.NumericType):
        return F.floor(F.col(name) / span)
    if isinstance(kind, T.StringType):
        return F.substring(name, 1, 4)
    return F.lit(0)


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    right = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(right, same).drop(*[f"_r_{k}" for k in keys])


def _slices(df: DataFrame, order: Sequence[str], span: int | None) -> dict[str, Column]:
    """Columns that cut a key: ``_s1`` alone, or the first order column's value and ``_s1``.

    A first column that is a time, or that comes with a ``span``, is cut by itself.
    """
    timely = isinstance(df.schema[order[0]].dataType, (T.TimestampType, T.TimestampNTZType))
    if span is None and len(order) > 1 and not timely:
        return {"_s0": F.col(order[0]), "_s1": coarse(df, order[1], SPAN)}
    return {"_s1": coarse(df, order[0], span or SPAN)}


def _before(totals: DataFrame, keys: Sequence[str], slices: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Slice totals replaced by the sums of all slices before within the key."""
    inner = [*keys, *slices[:-1]]
    earlier = W.partitionBy(*inner).orderBy(slices[-1]).rowsBetween(W.unboundedPreceding, -1)
    within = totals.select(*inner, slices[-1], *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in names])
    if len(slices) == 1:
        return within
    whole = totals.groupBy(*inner).agg(*[F.sum(n).alias(f"_w{n}") for n in names])
    over = with_running(whole, keys, [slices[0]], {f"_o{n}": F.col(f"_w{n}") for n in names}).select(
        *inner, *[(F.col(f"_o{n}") - F.col(f"_w{n}")).alias(f"_o{n}") for n in names]
    )
    both = _joined(within, over, inner)
    return both.withColumns({n: F.col(n) + F.col(f"_o{n}") for n in names}).select(*within.columns)


def with_running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], amounts: dict[str, Column], span: int | None = None
) -> DataFrame:
    """Running sums per key, the current row included.

    ``order`` names ascending columns that order each key totally; ``amounts``
    maps output names to the value each row adds (never null).
    """
    slices = _slices(df, order, span)
    by_slice = [*keys, *slices]
    cut = df.withColumns(slices)
    names = [f"_c_{n}" for n in amounts]
    totals = cut.groupBy(*by_slice).agg(*[F.sum(a).alias(n) for n, a in zip(names, amounts.values(), strict=True)])
    carry = _before(totals, keys, list(slices), names)
    w = W.partitionBy(*by_slice).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = cut.withColumns({n: F.sum(a).over(w) for n, a in amounts.items()})
    pieced = _joined(local, carry, by_slice).withColumns({n: F.col(n) + F.col(f"_c_{n}") for n in amounts})
    return pieced.select(*[c for c in df.columns if c not in amounts], *amounts)


def with_ordinal(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "seq", span: int | None = None
) -> DataFrame:
    """1-based position of each row within its key."""
    return with_running(df, keys, order, {out: F.lit(1).cast("long")}, span)


def _last_before(last: DataFrame, keys: Sequence[str], slices: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Each slice's last values replaced by those of the slice before within the key; null at the first."""
    inner = [*keys, *slices[:-1]]
    back = W.partitionBy(*inner).orderBy(slices[-1])
    within = last.select(*inner, slices[-1], *[F.lag(n).over(back).alias(n) for n in names], F.row_number().over(back).alias("_at"))
    if len(slices) == 1:
        return within.drop("_at")
    whole = last.groupBy(*inner).agg(*[F.max_by(n, slices[-1]).alias(n) for n in names])
    over = with_previous(whole, keys, [slices[0]], {f"_o{n}": n for n in names}).drop(*names)
    both = _joined(within, over, inner)
    return both.withColumns({n: F.when(F.col("_at") == 1, F.col(f"_o{n}")).otherwise(F.col(n)) for n in names}).select(*last.columns)


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str], span: int | None = None
) -> DataFrame:
    """Values of the row just before within the key; null on the first row."""
    slices = _slices(df, order, span)
    by_slice = [*keys, *slices]
    cut = df.withColumns(slices)
    last = cut.groupBy(*by_slice).agg(
        *[F.max_by(F.struct(c), F.struct(*order)).alias(f"_c_{n}") for n, c in columns.items()]
    )
    carry = _last_before(last, keys, list(slices), [f"_c_{n}" for n in columns])
    local = W.partitionBy(*by_slice).orderBy(*order)
    pieced = _joined(
        cut.withColumns({n: F.lag(c).over(local) for n, c in columns.items()}).withColumn(
            "_at", F.row_number().over(local)
        ),
        carry,
        by_slice,
    ).withColumns(
        {
            n: F.when(F.col("_at") == 1, F.col(f"_c_{n}")[c]).otherwise(F.col(n))
            for n, c in columns.items()
        }
    )
    return pieced.select(*[c for c in df.columns if c not in columns], *columns)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows of each key; Spark cuts each map task to ``k`` per key before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, rank).filter(F.col(out) <= k)
