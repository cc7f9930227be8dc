"""Top-N, last-N and exact medians that do not pull a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.sinks.scratch import staged

SALTS = 64
#: Bits of monotonically_increasing_id that count the rows of a partition.
ROW_BITS = 33


def site_keys(df: DataFrame) -> list[str]:
    """Grouping keys of a report frame: the report date, if tagged, and the host."""
    return [name for name in ("as_of", "host") if name in df.columns]


def top_n(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str = "rank",
) -> DataFrame:
    """The first ``n`` rows of each group, numbered from 1.

    ``row_number() <= n`` is planned with a limit on both sides of the shuffle
    (WindowGroupLimit), so at most ``n`` rows of a group leave each task. Spark
    only does so up to a threshold; beyond it the same is said explicitly with a
    first ranking over salted sub-groups.
    """
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if n > threshold:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(SALTS))
        salted = df.withColumn("__salt", salt)
        first = W.partitionBy(*keys, "__salt").orderBy(*order)
        df = (
            salted.withColumn("__first", F.row_number().over(first))
            .where(F.col("__first") <= n)
            .drop("__first", "__salt")
        )
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def last_rows(df: DataFrame, keys: Sequence[str], n: int, by: str = "date") -> DataFrame:
    """The last ``n`` stored rows of each group, whatever days are missing."""
    return top_n(df, keys, [F.desc(by)], n, rank="__age").drop("__age")


def numbered(df: DataFrame, name: str = "place") -> DataFrame:
    """The rows with their number, from 1, in the order in which they come.

    No task sees more than its own partition: rows are written once with their place
    in their partition, the partitions are counted, and the sums of the counts before
    are added. The counts are as many as there are partitions.
    """
    rows = staged(df.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__id", ROW_BITS)
    counts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).orderBy("__part").collect()
    before, offsets = 0, []
    for row in counts:
        offsets.append((row["__part"], before))
        before += row.n
    table = df.sparkSession.createDataFrame(offsets, "__part long, __before long")
    in_part = F.col("__id").bitwiseAND((1 << ROW_BITS) - 1)
    return (
        rows.withColumn("__part", part)
        .join(table, "__part")
        .withColumn(name, F.col("__before") + in_part + 1)
        .drop("__part", "__before", "__id")
    )


def numbered_in_order(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """The rows numbered from 1 in ``order``, by a range-partitioned sort."""
    return numbered(df.orderBy(*order), name)


def exact_median(
    df: DataFrame, value: str, keys: Sequence[str] = (), resolution: float = 0.01
) -> DataFrame:
    """Exact median per group (mean of the middle two), one row per group.

    ``percentile`` would keep every distinct value of a group in one task. Here
    values are counted per cell of width ``resolution`` and then, only inside the
    cells that hold a middle rank, per value. Both counts are combined before the
    shuffle; the windows run over cells, and over values of at most two cells.
    """
    keys = list(keys)
    cell = F.floor(F.col(value) / F.lit(resolution))
    cells = df.groupBy(*keys, cell.alias("__cell")).agg(F.count("*").alias("__n"))
    running = W.partitionBy(*keys).orderBy("__cell")
    cells = (
        cells.withColumn("__upto", F.sum("__n").over(running))
        .withColumn("__total", F.sum("__n").over(W.partitionBy(*keys)))
        .withColumn("__low", F.floor((F.col("__total") + 1) / 2))
        .withColumn("__high", F.floor(F.col("__total") / 2) + 1)
        .withColumn("__before", F.col("__upto") - F.col("__n"))
        .where((F.col("__before") < F.col("__high")) & (F.col("__upto") >= F.col("__low")))
        .select(*keys, "__cell", "__before", "__low", "__high")
    )
    values = (
        df.withColumn("__cell", cell)
        .join(cells.select(*keys, "__cell"), [*keys, "__cell"], "left_semi")
        .groupBy(*keys, "__cell", value)
        .agg(F.count("*").alias("__n"))
    )
    within = W.partitionBy(*keys, "__cell").orderBy(value)
    ranked = (
        values.withColumn("__in_cell", F.sum("__n").over(within))
        .join(cells, [*keys, "__cell"])
        .withColumn("__upto", F.col("__before") + F.col("__in_cell"))
    )

    def at(rank: str) -> Column:
        return F.min(F.when(F.col("__upto") >= F.col(rank), F.col(value)))

    return ranked.groupBy(*keys).agg(((at("__low") + at("__high")) / 2).alias("median"))
