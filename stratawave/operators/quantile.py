"""Exact medians of groups of any size, by histograms that are refined around the middle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch_folder, stored

#: Buckets a range is parted into, and values of a range that are sorted in one list.
BUCKETS, SORTED = 1024, 4096


def median_by(rows: DataFrame, keys: Sequence[str], value: str, buckets: int = BUCKETS, limit: int = SORTED) -> DataFrame:
    """keys, median: the middle value, or the mean of the two; null and NaN values do not count, groups without others have null.

    The two middle ranks are looked for in a range each. A range with more than limit values is parted into
    buckets, whose counts tell the one that holds the rank, and that
    becomes the range; so no aggregate holds more than the histogram or limit values. Rows are
    derived once, however often the ranges are refined.
    """
    keys, folder = list(keys), scratch_folder(rows.sparkSession)
    v = F.col(value).cast("double")
    rows = stored(rows.select(*keys, F.when(~F.isnan(v), v).alias("v")), "values", folder)
    valid = rows.where("v is not null")
    whole = stored(rows.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "ranges-0", folder)
    ranks = F.explode(F.array(F.struct(F.lit(0).alias("half"), F.floor((F.col("n") - 1) / 2).alias("rank")), F.struct(F.lit(1).alias("half"), F.floor(F.col("n") / 2).alias("rank"))))
    ranges, turn = whole.where("n > 0").withColumn("r", ranks).select(*keys, "r.half", "r.rank", "n", "lo", "hi"), 0
    while True:
        wide = F.col("hi") > F.col("lo")
        big = ranges.where(wide & (F.col("n") > limit))
        if not big.limit(1).count():
            break
        turn += 1
        # Halved ends keep the width finite; the last bucket takes the upper end.
        place = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        inside = valid.join(big.drop("n"), keys).where("v between lo and hi").withColumn("bucket", F.least(F.floor(place * buckets), F.lit(buckets - 1)))
        counts = inside.groupBy(*keys, "half", "rank", "bucket").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "half").orderBy("bucket"))
        found = counts.withColumn("before", upto - F.col("n")).where("rank >= before and rank < before + n")
        found = found.select(*keys, "half", (F.col("rank") - F.col("before")).alias("rank"), "n", "lo", "hi")
        ranges = stored(ranges.where(~(wide & (F.col("n") > limit))).unionByName(found), f"ranges-{turn}", folder)
    one = ranges.where("hi = lo").select(*keys, F.col("lo").alias("v"))
    few = valid.join(ranges.where("hi > lo").drop("n"), keys).where("v between lo and hi").groupBy(*keys, "half", "rank").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    few = few.select(*keys, F.get("vs", F.col("rank").cast("int")).alias("v"))
    middle = one.unionByName(few).groupBy(*keys).agg(F.sum(F.col("v") * 0.5).alias("median"))
    return whole.select(*keys).join(middle, keys, "left")
