"""Groups of any size as blocks of bounded size, and pairs of such blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_pairs(rows: DataFrame, group: list[str], size: Column, block: int, spread: list[str], payload: list[str]) -> DataFrame:
    """One row for each group and pair of its blocks: ``group, lo, hi, left, right``.

    A group of ``size`` rows (the same in each of its rows) falls into blocks of
    about ``block`` rows by a hash of the columns ``spread``. Every two rows of a
    group meet in exactly one pair of blocks; where lo = hi, right is null and the
    pairs are those within left. A group of a third of all rows so becomes many
    equal rows, and no task holds more than two blocks of it at a time.
    """
    n = F.greatest(F.lit(1), F.ceil(size / F.lit(block))).cast("int")
    packed = (
        rows.withColumn("_n", n)
        .withColumn("_b", F.pmod(F.xxhash64(*spread), F.col("_n")).cast("int"))
        .groupBy(*group, "_n", "_b")
        .agg(F.collect_list(F.struct(*payload)).alias("_rows"))
    )
    each = packed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    lo, hi = F.least("_b", "_o"), F.greatest("_b", "_o")
    return (
        each.withColumns({"lo": lo, "hi": hi})
        .groupBy(*group, "lo", "hi")
        .agg(
            F.any_value(F.when(F.col("_b") == F.col("lo"), F.col("_rows")), True).alias("left"),
            F.any_value(F.when((F.col("_b") == F.col("hi")) & (F.col("lo") < F.col("hi")), F.col("_rows")), True).alias("right"),
        )
        .where("left is not null and (lo = hi or right is not null)")
    )
