"""Ordered scans that survive one hot key.

A plain ``Window.partitionBy(key)`` sorts all rows of a key in one task.  Here
each key is cut into chunks along its own order (a day, a block of positions):

1. every (key, chunk) is summarised with a partial aggregate,
2. the summaries, one row per chunk, are scanned to get what each chunk
   receives from the chunks before it,
3. rows are scanned inside their own chunk and start from that carry.

The largest group any task sees is one chunk.  ``chunk`` must not decrease
along ``order`` (a chunk that begins before the one ahead of it ends is an
error), and ``order`` must be unique within a key.  Null keys are a key of
their own, and a null chunk comes first, as null orders do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CHUNK = "__chunk"


def _order_key(order: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def _carry(df, keys, chunk, order, summary, carried):
    """Attach to every row the values its chunk receives from its neighbours."""
    rows = df.withColumn(_CHUNK, chunk)
    ends = [F.min(order[0]).alias("__low"), F.max(order[0]).alias("__high")]
    chunks = rows.groupBy(*keys, _CHUNK).agg(*summary, *ends)
    by_chunk = Window.partitionBy(*keys).orderBy(_CHUNK)
    late = F.lag("__high").over(by_chunk) > F.col("__low")
    received = chunks.select(*keys, _CHUNK, *carried(by_chunk), late.alias("__late"))
    message = F.lit(f"the chunks decrease along {order[0]}")
    received = received.where(F.when(F.col("__late"), F.raise_error(message).cast("boolean")).otherwise(True)).drop("__late")
    return _joined(rows, received, [*keys, _CHUNK])


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which null meets null."""
    right = right.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys])
    return left.join(right, same).drop(*[f"__of_{k}" for k in keys])


def _local(keys, order) -> Window:
    return Window.partitionBy(*keys, _CHUNK).orderBy(*order)


def shifted(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
            columns: dict[str, str], forward: bool = False) -> DataFrame:
    """Value of the previous (or next) row of the key: chunked lag and lead.

    ``columns`` maps source column to result column.
    """
    pick = F.min_by if forward else F.max_by
    names = list(columns)
    edge = F.struct(*names)
    out = _carry(
        df, keys, chunk, order,
        [pick(edge, _order_key(order)).alias("__edge")],
        lambda w: [(F.lead if forward else F.lag)("__edge").over(w).alias("__edge")],
    )
    w = _local(keys, order)
    step = (F.lead if forward else F.lag)(edge, 1).over(w)
    out = out.withColumn("__near", F.coalesce(step, F.col("__edge")))
    for source, target in columns.items():
        out = out.withColumn(target, F.col("__near")[source])
    return out.drop("__near", "__edge", _CHUNK)


def fill_forward(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
                 columns: dict[str, str]) -> DataFrame:
    """Last non-null value so far, e.g. the section header a line stands under."""
    key = _order_key(order)
    summary = [F.max_by(c, F.when(F.col(c).isNotNull(), key)).alias(f"__in_{t}") for c, t in columns.items()]

    def carried(w):
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        return [F.last(f"__in_{t}", ignorenulls=True).over(before).alias(f"__in_{t}") for t in columns.values()]

    out = _carry(df, keys, chunk, order, summary, carried)
    w = _local(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    for c, t in columns.items():
        out = out.withColumn(t, F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"__in_{t}")))
    return out.drop(_CHUNK, *[f"__in_{t}" for t in columns.values()])


def running_sum(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
                columns: dict[str, str], inclusive: bool = True) -> DataFrame:
    """Sum of the rows so far, with or without the current one."""
    summary = [F.sum(c).alias(f"__in_{t}") for c, t in columns.items()]

    def carried(w):
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(F.sum(f"__in_{t}").over(before), F.lit(0)).alias(f"__in_{t}") for t in columns.values()]

    out = _carry(df, keys, chunk, order, summary, carried)
    w = _local(keys, order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    for c, t in columns.items():
        out = out.withColumn(t, F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(f"__in_{t}"))
    return out.drop(_CHUNK, *[f"__in_{t}" for t in columns.values()])


def _place(marks: Column, count: int, value: Column, reached) -> Column:
    """How many of the sorted marks the value has ``reached``: a search by halves, so many chunks cost a row little."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(count.bit_length()))])
    found = lambda v: F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= count) & reached(F.get(marks, at + step - 1), v), at + step).otherwise(at))
    return F.transform(F.array(value), found)[0]  # the value is computed once, not at each step


def _sorted(value: float) -> tuple[bool, float]:
    """Sorts as Spark does: NaN is the greatest number."""
    return value != value, value


def value_chunks(df: DataFrame, column: str, pieces: int | None = None) -> Column:
    """Chunk number of a value by approximate quantile bounds.

    The bounds are at most ``pieces`` numbers read once; the scan on top of
    them is exact whatever they are, they only balance the chunks.  Without
    ``pieces`` a chunk holds about 100,000 rows, in 64 to 10,000 chunks.
    """
    if pieces is None:
        pieces = max(64, min(10_000, df.count() // 100_000))
    points = [i / pieces for i in range(1, pieces)]
    bounds = df.agg(F.percentile_approx(column, points, 10 * pieces).alias("b")).first()["b"] or []
    marks = sorted(set(bounds), key=_sorted)
    if not marks:
        return F.lit(0)
    return _place(F.array(*[F.lit(float(b)) for b in marks]), len(marks), F.col(column), lambda b, v: b <= v)


#: Rows that a chunk holds, about, where the caller sets no other number of pieces.
CHUNK_ROWS = 100_000


def _as_number(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    if kind == "date":
        return F.unix_date(column).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    return F.col(column).cast("double")


def order_chunks(df: DataFrame, order: list[str], pieces: int | None = None) -> Column:
    """Chunk number along ``order`` by quantiles of the rows, so that a chunk holds about as many rows as any other.

    A value of the first column that fills chunks of its own (very many rows of
    one moment) is cut again by quantiles of the second column.  The first two
    columns must be dates, times or numbers.  What reaches the driver is at
    most two bounds per piece; the scan on top is exact whatever they are.
    """
    first = _as_number(df, order[0])
    if pieces is None:
        pieces = max(8, min(10_000, df.count() // CHUNK_ROWS))
    points = [i / pieces for i in range(1, pieces)]
    bounds = df.agg(F.percentile_approx(first, points, 10 * pieces).alias("b")).first()["b"] or []
    marks = sorted(set(bounds))
    heavy = sorted(b for b in marks if bounds.count(b) > 1)
    cuts: list[tuple[float, float]] = [(b, float("-inf")) for b in marks]
    if heavy and len(order) > 1:
        second = _as_number(df, order[1])
        most = max(bounds.count(b) for b in heavy) + 1
        inner = [i / most for i in range(1, most)]
        found = df.where(first.isin(heavy)).groupBy(first.alias("v")).agg(F.percentile_approx(second, inner, 10 * most).alias("b")).collect()
        cuts += [(r["v"], x) for r in found for x in sorted(set(r["b"] or []))]
    if not cuts:
        return F.lit(0)
    if len(cuts) == len(marks):  # no moment is cut again
        return _place(F.array(*[F.lit(float(b)) for b in sorted(marks, key=_sorted)]), len(marks), first, lambda c, at: c <= at)
    cuts = sorted(cuts, key=lambda c: (_sorted(c[0]), _sorted(c[1])))
    spread = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in cuts])
    at = F.struct(first.alias("a"), _as_number(df, order[1]).alias("b"))
    return _place(spread, len(cuts), at, lambda c, at: (c["a"] < at["a"]) | ((c["a"] == at["a"]) & (c["b"] <= at["b"])))
