"""Panels on a regular time step, and windows that split long series.

A window partitioned by the series key alone puts a whole series into one task.
Here every ordered computation runs over *spans*: a span is a fixed stretch of
steps of one series, plus the rows before and after it that the frames reach.
The largest group any task sorts is therefore span length + reach, however long
or dominant one series is.

Preconditions: series keys are not null and (keys, ts) is unique and lies on the
step; ``clean.dedup_first`` and :func:`regularize` establish both.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronolith.functions.columns import floor_div, step_of, ts_of_step

SPAN = 4096
HOUR, DAY = 3600, 86400


@dataclass(frozen=True)
class Grid:
    """Names of the series keys and the timestamp, and the step in seconds."""

    by: tuple[str, ...] = ("series_id",)
    ts: str = "ts"
    step: int = HOUR

    def step_index(self) -> Column:
        """Step of a row; a NULL series key ends the query, since joins by series would lose its rows."""
        step = step_of(F.col(self.ts), self.step)
        for key in self.by:
            step = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"NULL in series key {key}")).cast("long")).otherwise(step)
        return step


def span_length(back: int, ahead: int) -> int:
    """Long enough that the copied margin stays within an eighth of a span."""
    return max(SPAN, 8 * (back + ahead))


# --- position within a series ----------------------------------------------

def with_position(df: DataFrame, grid: Grid, name: str = "pos") -> DataFrame:
    """0-based ordinal of each row inside its series, without sorting a whole series.

    Rows are numbered inside time chunks; each chunk starts after the rows of
    the chunks before it.  The table of chunk counts has one row per series and
    chunk, so its window is bounded by the calendar, not by the data.
    """
    by = list(grid.by)
    chunked = (df.withColumn("_chunk", floor_div(grid.step_index(), SPAN))
               .repartition(*by, "_chunk"))
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (chunked.groupBy(*by, "_chunk").agg(F.count("*").alias("_n"))
               .select(*by, "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")))
    inside = Window.partitionBy(*by, "_chunk").orderBy(grid.ts)
    return (chunked.withColumn("_rn", F.row_number().over(inside))
            .join(offsets, [*by, "_chunk"], "left")
            .withColumn(name, F.col("_offset") + F.col("_rn") - 1)
            .drop("_chunk", "_rn", "_offset"))


# --- windows over spans ------------------------------------------------------

class SpanFrame:
    """Frames inside one span; offsets count steps (time mode) or rows (row mode)."""

    def __init__(self, by: list[str]):
        self._ordered = Window.partitionBy(*by, "_span").orderBy("_step")
        self._reversed = Window.partitionBy(*by, "_span").orderBy(F.desc("_step"))

    def frame(self, start: int, end: int):
        return self._ordered.rangeBetween(start, end)

    def at(self, c: str | Column, offset: int) -> Column:
        """Value exactly ``offset`` steps away (negative = earlier), NULL if absent."""
        return F.first(c).over(self.frame(offset, offset))

    def full(self, agg: Callable[[Column], Column], c: str, start: int, end: int) -> Column:
        """Aggregate over a frame, NULL until the frame holds every value."""
        value = F.col(c)
        frame = self.frame(start, end)
        return F.when(F.count(value).over(frame) == end - start + 1, agg(value).over(frame))

    def running(self, agg: Callable[[Column], Column], c: str | Column) -> Column:
        """Aggregate from the first row of the span (margin included) to this row."""
        value = F.col(c) if isinstance(c, str) else c
        return agg(value).over(self._ordered.rowsBetween(Window.unboundedPreceding, 0))

    def up_to(self, c: str, offset: int) -> Column:
        """Value of ``c`` on the last row at most ``offset`` steps away."""
        return F.last(c).over(self.frame(Window.unboundedPreceding, offset))

    def running_back(self, agg: Callable[[Column], Column], c: str | Column) -> Column:
        """Aggregate from this row to the last row of the span.

        A reversed order keeps this incremental; a frame that ends at unbounded
        following is re-evaluated from scratch for every row.
        """
        value = F.col(c) if isinstance(c, str) else c
        return agg(value).over(self._reversed.rowsBetween(Window.unboundedPreceding, 0))


def spread_spans(df: DataFrame, grid: Grid, back: int, ahead: int, mode: str = "time",
                 span: int | None = None, position: str | None = None) -> DataFrame:
    """Add _step, and one copy of each row per span that reaches it (_span).

    The result is partitioned by (keys, _span) explicitly: rows that arrive
    partitioned by the keys alone would satisfy a window over (keys, _span) too,
    and leave a dominant series in one task.
    """
    keys = [*grid.by, "_span"]
    length = span or span_length(back, ahead)
    if position is not None:
        stepped = df.withColumn("_step", F.col(position))
    elif mode == "row":
        stepped = with_position(df, grid, "_step")
    else:
        stepped = df.withColumn("_step", grid.step_index())
    step = F.col("_step")
    stepped = stepped.withColumn("_home", floor_div(step, length))
    if back == 0 and ahead == 0:
        return stepped.withColumn("_span", F.col("_home")).repartition(*keys)
    # A row at step s is read by rows from s - ahead to s + back.
    return stepped.withColumn("_span", F.explode(
        F.sequence(floor_div(step - ahead, length), floor_div(step + back, length)))).repartition(*keys)


def over_spans(df: DataFrame, grid: Grid, *stages: Callable[[SpanFrame], dict[str, Column]],
               back: int = 0, ahead: int = 0, mode: str = "time",
               span: int | None = None, position: str | None = None,
               keep_step: str | None = None) -> DataFrame:
    """Add windowed columns that reach ``back`` steps back and ``ahead`` steps on.

    mode "time": an offset means that many steps on the clock, so gaps do not
    shift anything.  mode "row": an offset means that many rows.  All columns
    share one shuffle and one sort; a later stage may use columns of an earlier one.
    """
    out = spread_spans(df, grid, back, ahead, mode, span, position)
    for stage in stages:
        out = out.withColumns(stage(SpanFrame(list(grid.by))))
    out = out.where(F.col("_span") == F.col("_home")).drop("_span", "_home")
    return out.withColumnRenamed("_step", keep_step) if keep_step else out.drop("_step")


def span_arrays(df: DataFrame, grid: Grid, value: str, back: int, ahead: int = 0,
                mode: str = "row", span: int | None = None,
                position: str | None = None) -> DataFrame:
    """One row per series and span: start position, margin included, and values in order.

    The array holds at most span + back + ahead values.  ``own`` is the index of
    the first value that belongs to the span itself, ``first`` the position of
    element 0, ``n_own`` how many values belong to the span.
    """
    length = span or span_length(back, ahead)
    spread = spread_spans(df, grid, back, ahead, mode, length, position)
    grouped = (spread.groupBy(*grid.by, "_span")
               .agg(F.sort_array(F.collect_list(F.struct("_step", F.col(value).alias("v")))).alias("_rows"),
                    F.count_if(F.col("_span") == F.col("_home")).alias("n_own"))
               .where("n_own > 0"))
    first = F.col("_rows")[0]["_step"]
    return grouped.select(
        *grid.by, "_span", first.alias("first"),
        F.greatest(F.col("_span") * length - first, F.lit(0)).cast("int").alias("own"),
        F.col("n_own").cast("int").alias("n_own"),
        F.transform("_rows", lambda r: r["v"]).alias("values"))


# --- regular spine -----------------------------------------------------------

def spine(df: DataFrame, grid: Grid) -> DataFrame:
    """Every step from the first to the last row of each series.

    Steps are generated span by span, so no array is longer than one span.  The
    short span list is dealt out to a fixed number of tasks first: by its size
    alone it would be merged into one, which would then expand everything.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = (df.withColumn("_step", grid.step_index()).groupBy(*grid.by)
              .agg(F.min("_step").alias("_lo"), F.max("_step").alias("_hi")))
    lo, hi, s = F.col("_lo"), F.col("_hi"), F.col("_s")
    spans = bounds.select(*grid.by, "_lo", "_hi",
                          F.explode(F.sequence(floor_div(lo, SPAN), floor_div(hi, SPAN))).alias("_s"))
    spans = spans.repartition(tasks, *grid.by, "_s")
    steps = F.sequence(F.greatest(lo, s * SPAN), F.least(hi, s * SPAN + (SPAN - 1)))
    return (spans.select(*grid.by, F.explode(steps).alias("_step"))
            .select(*grid.by, ts_of_step(F.col("_step"), grid.step).alias(grid.ts)))


def regularize(df: DataFrame, grid: Grid) -> DataFrame:
    """Full spine per series; steps without a row come out as all-null rows."""
    keys = [*grid.by, grid.ts]
    return spine(df, grid).join(df, keys, "left").select(*df.columns)


# --- carrying a value across spans ------------------------------------------

def with_carry(spans: DataFrame, grid: Grid, make: Callable[[object, object], dict[str, Column]]) -> DataFrame:
    """Add columns over the earlier and the later span rows of each series.

    ``spans`` has one row per (series, _span); both frames run away from the
    row, so ``last`` means nearest in either.
    """
    before = (Window.partitionBy(*grid.by).orderBy("_span")
              .rowsBetween(Window.unboundedPreceding, -1))
    after = (Window.partitionBy(*grid.by).orderBy(F.desc("_span"))
             .rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumns(make(before, after))
