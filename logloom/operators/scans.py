"""Ordered scans that survive one key holding a large share of all rows.

A plain window sends every row of a key to one task. Here the order axis of each key is cut into
chunks of bounded size; windows run inside (key, chunk), one small row per chunk is carried across
chunks, and the carried value is joined back. The result equals the plain window. The windowed rows
are written once, as both the chunk rows and the join read them: the input is computed once, however
deep scans are nested.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from logloom.session import cut_lineage

Stage = dict[str, Callable[[WindowSpec], Column]]

# Rows of one chunk of a log file: ``seq`` grows by at least one per line.
LINE_SPAN = 1 << 20
# Microseconds of one chunk on a time axis.
HOUR = 3_600_000_000


def chunk_of(order: Column, span: int) -> Column:
    return F.floor(order / F.lit(span)).cast("bigint")


def _ordered(columns: list[str], descending: bool) -> list[Column]:
    return [F.desc(c) if descending else F.asc(c) for c in columns]


def chunk_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    local: list[Stage],
    summary: dict[str, Column],
    carry: list[Stage],
    descending: bool = False,
    scratch: Sequence[str] = (),
) -> DataFrame:
    """Add the ``local`` columns (per chunk) and the last ``carry`` stage (per chunk, from before).

    ``scratch`` names columns that only the ``local`` stages read; they are not written.
    """
    parts = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*_ordered(order, descending))
    for stage in local:
        parts = parts.withColumns({name: make(inside) for name, make in stage.items()})
    parts = cut_lineage(parts.drop(*scratch))
    table = parts.groupBy(*keys, "_chunk").agg(*[c.alias(n) for n, c in summary.items()])
    across = Window.partitionBy(*keys).orderBy(*_ordered(["_chunk"], descending))
    for stage in carry:
        table = table.withColumns({name: make(across) for name, make in stage.items()})
    carried = table.select(*keys, "_chunk", *carry[-1])
    return parts.join(carried, [*keys, "_chunk"]).drop("_chunk")


def _upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def running_sum(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, sums: dict[str, Column], inclusive: bool = True
) -> DataFrame:
    """Add one running total per entry of ``sums``; exclusive totals leave the row itself out."""
    frame = _upto if inclusive else _before
    value = df.withColumns({f"_v_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()})
    zero = F.lit(0)
    out = chunk_scan(
        value, keys, order, chunk,
        local=[{f"_l_{n}": (lambda w, n=n: F.coalesce(F.sum(f"_v_{n}").over(frame(w)), zero)) for n in sums}],
        summary={f"_t_{n}": F.sum(f"_v_{n}") for n in sums},
        carry=[{f"_c_{n}": (lambda w, n=n: F.coalesce(F.sum(f"_t_{n}").over(_before(w)), zero)) for n in sums}],
    )
    out = out.withColumns({n: F.col(f"_l_{n}") + F.col(f"_c_{n}") for n in sums})
    return out.drop(*[f"_{p}_{n}" for p in "vlc" for n in sums])


def running_extreme(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, name: str, value: Column,
    kind: str = "max", inclusive: bool = True, descending: bool = False,
) -> DataFrame:
    """Add the running maximum or minimum of ``value`` (NULL while no value was seen)."""
    frame = _upto if inclusive else _before
    fn = F.max if kind == "max" else F.min
    pick = F.greatest if kind == "max" else F.least  # both skip NULLs
    out = chunk_scan(
        df.withColumn("_v", value), keys, order, chunk,
        local=[{"_l": lambda w: fn("_v").over(frame(w))}],
        summary={"_t": fn("_v")},
        carry=[{"_c": lambda w: fn("_t").over(_before(w))}],
        descending=descending,
    )
    return out.withColumn(name, pick("_l", "_c")).drop("_v", "_l", "_c")


def number_runs(
    df: DataFrame, keys: list[str], order: str, chunk: Column, label: Column, single: Column | None = None
) -> DataFrame:
    """Add ``run_no``: consecutive rows with one label share a number, counted from 1 per key.

    Rows where ``single`` holds always start a run of their own.
    """
    alone = F.lit(False) if single is None else single
    rows = df.withColumns({"_label": label, "_alone": alone})
    new = (F.col("_label") != F.col("_prev")) | F.col("_alone")
    out = chunk_scan(
        rows, keys, [order], chunk,
        local=[
            {"_prev": lambda w: F.lag("_label").over(w)},
            {"_local": lambda w: F.sum(F.when(F.col("_prev").isNull(), 0).when(new, 1).otherwise(0)).over(_upto(w))},
        ],
        summary={
            "_head": F.min_by(F.struct("_label", "_alone"), order),
            "_tail": F.max_by("_label", order),
            "_n": F.max("_local"),
        },
        carry=[
            {"_before": lambda w: F.lag("_tail").over(w)},
            {
                "_edge": lambda w: F.when(
                    F.col("_before").isNull() | (F.col("_head._label") != F.col("_before")) | F.col("_head._alone"), 1
                ).otherwise(0)
            },
            {"_base": lambda w: F.sum("_edge").over(_upto(w)) + F.coalesce(F.sum("_n").over(_before(w)), F.lit(0))},
        ],
    )
    return out.withColumn("run_no", F.col("_base") + F.col("_local")).drop("_label", "_alone", "_prev", "_local", "_base")
