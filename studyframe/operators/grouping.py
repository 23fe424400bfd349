"""Group-wise building blocks that keep working when one group is huge.

A group larger than ``hot_limit`` rows is never sorted or buffered in one task:
it is cut into chunks of its order column, the chunks are processed side by
side, and per-chunk totals carry the running state from one to the next. The
result is the same as that of one plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyframe.session import cut_lineage

HOT_ROWS_CONF = "spark.studyframe.hotGroupRows"
HOT_ROWS_DEFAULT = 2_000_000
CHUNK_SIDE = 32  # a hot group is cut into up to CHUNK_SIDE**2 chunks
SKETCH_ACCURACY = 10_000


def hot_limit(df: DataFrame) -> int:
    """Rows one task may sort or buffer for one group (a session setting)."""
    return int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows in the largest group; a count with map-side combine, one number back."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(F.max("_n")).first()[0] or 0


def has_hot_group(df: DataFrame, keys: list[str], group_rows: int | None = None) -> bool:
    """Whether some group exceeds the limit; ``group_rows`` is a bound the caller knows."""
    rows = largest_group(df, keys) if group_rows is None else group_rows
    return rows > hot_limit(df)


def hot_groups(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Keys and sizes of the groups beyond ``limit``: at most (all rows / limit) rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner",
            extra: Column | None = None) -> DataFrame:
    """Equi-join in which null keys match, as they do in ``groupBy``."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = F.lit(True) if extra is None else extra
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__{k}" for k in keys])


def attach_group(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Add per-group scalars to every row.

    Aggregate first (partial aggregation absorbs a hot key) and join the one row
    per group back, instead of a window that would pull a group into one task.
    """
    stats = df.groupBy(*keys).agg(*[c.alias(name) for name, c in aggs.items()])
    return join_on(df, stats, keys, "left")


def attach_few(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """``attach_group`` for groups of many rows each.

    The row per group is written once. Where a task's share of these rows is within the hot limit,
    they are hashed and the rows of ``df`` stream past them, instead of a sort of all of them.
    """
    stats = cut_lineage(df.groupBy(*keys).agg(*[c.alias(name) for name, c in aggs.items()]))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = stats.count() <= hot_limit(df) * tasks // 4
    return join_on(df, stats.hint("shuffle_hash") if hashed else stats, keys, "left")


def first_place(whole: str, tie: str) -> Column:
    """One number in the order of ``whole`` (at least 0), then ``tie`` (any long), nulls first.

    ``min_by`` on it has a buffer of fixed width, so it is aggregated by hash; a struct would have all rows sorted.
    """
    coarse = F.coalesce(F.col(whole).cast("decimal(17,0)"), F.lit(-1).cast("decimal(17,0)"))
    fine = F.coalesce(F.col(tie).cast("decimal(20,0)"), F.lit(str(-2 ** 63 - 1)).cast("decimal(20,0)"))
    return (coarse * F.lit(str(2 ** 64 + 1)).cast("decimal(20,0)")).cast("decimal(38,0)") + fine


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each group. Spark pre-limits each map partition to one row per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def _with_chunks(df: DataFrame, keys: list[str], order: str, limit: int) -> DataFrame:
    """Add ``_chunk``: 0 in ordinary groups, else a step function of the order column."""
    hot = hot_groups(df, keys, limit)
    pieces = CHUNK_SIDE ** 2
    probes = [i / pieces for i in range(1, pieces)]
    # one row per hot group, so the broadcast is bounded by (all rows / limit)
    edges = (join_on(df.select(*keys, order), F.broadcast(hot), keys)
             .groupBy(*keys)
             .agg(F.percentile_approx(F.col(order).cast("double"), probes,
                                      SKETCH_ACCURACY).alias("_edges"))
             .withColumn("_coarse", F.transform(
                 F.sequence(F.lit(1), F.lit(CHUNK_SIDE - 1)),
                 lambda i: F.get(F.col("_edges"), i * CHUNK_SIDE - 1))))
    value = F.col(order).cast("double")

    def reached(edge: Column) -> Column:
        return value.isNull() | (edge <= value)

    # edges at or below the value: whole blocks first, then inside one block
    blocks = F.size(F.filter("_coarse", reached))
    block = F.slice("_edges", F.col("_blocks") * CHUNK_SIDE + 1, CHUNK_SIDE - 1)
    inside = F.size(F.filter(block, reached))
    return (join_on(df, F.broadcast(edges), keys, "left")
            .withColumn("_blocks", blocks)
            .withColumn("_chunk", F.when(F.col("_edges").isNull(), 0).otherwise(
                F.col("_blocks") * CHUNK_SIDE + inside))
            .drop("_edges", "_coarse", "_blocks"))


def _ascending(order: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order]


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str],
                 group_rows: int | None = None) -> DataFrame:
    """Running sums ``{output: input column}`` within ``keys`` along ``order``.

    ``order`` ascends with nulls last; its first column must be numeric and the
    order must be total. With a hot group the sums restart at chunk boundaries and
    the totals of the earlier chunks (at most CHUNK_SIDE**2 per group) are added.
    """
    if not has_hot_group(df, keys, group_rows):
        w = (Window.partitionBy(*keys).orderBy(*_ascending(order))
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return df.withColumns({out: F.sum(c).over(w) for out, c in sums.items()})
    chunked = _with_chunks(df, keys, order[0], hot_limit(df))
    before = (Window.partitionBy(*keys).orderBy("_chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    carried = {f"_before_{i}": F.sum(f"_total_{i}").over(before)
               for i in range(len(sums))}
    offsets = (chunked.groupBy(*keys, "_chunk")
               .agg(*[F.sum(c).alias(f"_total_{i}") for i, c in enumerate(sums.values())])
               .withColumns(carried).filter("_chunk > 0")
               .select(*keys, "_chunk", *carried))
    within = (Window.partitionBy(*keys, "_chunk").orderBy(*_ascending(order))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = join_on(chunked, offsets, [*keys, "_chunk"], "left")
    return joined.withColumns({
        out: F.coalesce(F.sum(c).over(within) + F.coalesce(F.col(f"_before_{i}"), F.lit(0)),
                        F.col(f"_before_{i}"))  # no value yet in this chunk
        for i, (out, c) in enumerate(sums.items())
    }).drop("_chunk", *carried)


def ordinal(df: DataFrame, keys: list[str], order: list[str], name: str,
            group_rows: int | None = None) -> DataFrame:
    """Row number within a group, starting at 1 (as running sum of ones)."""
    if not has_hot_group(df, keys, group_rows):
        w = Window.partitionBy(*keys).orderBy(*_ascending(order))
        return df.withColumn(name, F.row_number().over(w).cast("long"))
    ones = df.withColumn("_one", F.lit(1))
    return running_sums(ones, keys, order, {name: "_one"}, group_rows).drop("_one")


def running_max(df: DataFrame, keys: list[str], by: str, value: Column, out: str,
                group_rows: int | None = None) -> DataFrame:
    """Greatest non-null ``value`` (a column, or struct) of the rows whose number ``by`` is at most that of the row.

    A hot group is cut into chunks along ``by``; rows of equal ``by`` share one, and each takes
    over the greatest value of the chunks before it.
    """
    held = df.withColumn("_held", value)
    if not has_hot_group(df, keys, group_rows):
        w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(by))
        return held.withColumn(out, F.max("_held").over(w)).drop("_held")
    chunked = _with_chunks(held, keys, by, hot_limit(df))
    before = (Window.partitionBy(*keys).orderBy("_chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    carried = (chunked.groupBy(*keys, "_chunk").agg(F.max("_held").alias("_end"))
               .select(*keys, "_chunk", F.max("_end").over(before).alias("_start")))
    within = Window.partitionBy(*keys, "_chunk").orderBy(F.asc_nulls_last(by))
    return (join_on(chunked, carried, [*keys, "_chunk"], "left")
            .withColumn(out, F.array_max(F.array(F.max("_held").over(within), F.col("_start"))))
            .drop("_held", "_chunk", "_start"))
