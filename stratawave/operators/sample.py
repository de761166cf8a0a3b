"""Stable splits, balanced and stratified samples, allocations and perturbations; hashes, never random numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import is_finite
from ..sources.scratch import stored


def hash32(*parts: Column) -> Column:
    """The first 32 bits of the MD5 of the parts joined by colons, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def assign_split(rows: DataFrame, seed: int = 0, dev: float = 0.1, test: float = 0.1) -> DataFrame:
    """Adds split: dev, test or train by the hash of tile and pid."""
    u = hash32(F.lit(seed), F.col("tile"), F.col("pid")) / F.lit(float(1 << 32))
    return rows.withColumn("split", F.when(u < dev, "dev").when(u < dev + test, "test").otherwise("train"))


def balanced(examples: DataFrame, per_class: int, seed: int = 0) -> DataFrame:
    """per_class examples of each task and bucket, those of smallest hash."""
    w = Window.partitionBy("task_name", "bucket_label").orderBy(hash32(F.lit(seed), F.col("id")), "id")
    return examples.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_class).drop("_n")


def shortfall(examples: DataFrame, per_class: int) -> DataFrame:
    """task_name, bucket_label, n, missing of the buckets seen that have too few."""
    return examples.groupBy("task_name", "bucket_label").agg(F.count("*").alias("n")).where(F.col("n") < per_class).withColumn("missing", F.lit(per_class) - F.col("n"))


def head_per_tile(rows: DataFrame, n: int, order: str = "pid") -> DataFrame:
    """The first n rows of every tile."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("tile").orderBy(order))).where(F.col("_n") <= n).drop("_n")


def fewest(rows: DataFrame, keys: list[str], wanted: str, order: Column, tie: str) -> DataFrame:
    """Of every class (keys) the rows of smallest order (32 bits) and tie, as many as its column wanted says, without that column.

    A histogram of orders per class tells below which of 4096 bounds enough rows
    lie; what is above is dropped before anything is ranked, so a class is ordered only as far as it is wanted.
    """
    rows = rows.withColumn("_o", order).withColumn("_b", F.shiftright("_o", 20))
    counts = rows.groupBy(*keys, "_b").agg(F.count("*").alias("n"), F.first(wanted).alias("_w"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounds = counts.withColumn("_before", before).where(F.col("_before") < F.col("_w")).groupBy(*keys).agg(F.max("_b").alias("_last"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_o", tie))
    return rows.join(bounds, keys).where("_b <= _last").withColumn("_n", rank).where(F.col("_n") <= F.col(wanted)).drop("_n", "_o", "_b", "_last", wanted)


def stratified(examples: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """Exactly target rows per task and bucket; short buckets raise. targets: task_name, bucket_label, target."""
    have = examples.groupBy("task_name", "bucket_label").agg(F.count("*").alias("n"))
    short = targets.join(have, ["task_name", "bucket_label"], "left").where(F.coalesce("n", F.lit(0)) < F.col("target")).limit(1).collect()
    if short:
        raise ValueError(f"too few examples: {short[0]}")
    keys = ["task_name", "bucket_label"]
    return fewest(examples.join(targets.select(*keys, "target"), keys), keys, "target", hash32(F.lit(seed), F.col("id")), "id")


def even_targets(buckets: DataFrame, per_task: int) -> DataFrame:
    """per_task split evenly over a task's buckets; the first buckets by name take the remainder."""
    w = Window.partitionBy("task_name")
    k, i = F.count("*").over(w), F.row_number().over(w.orderBy("bucket_label")) - 1
    return buckets.select("task_name", "bucket_label").distinct().select("task_name", "bucket_label", (F.floor(F.lit(per_task) / k) + (i < F.lit(per_task) % k).cast("int")).alias("target"))


def largest_remainder(counts: DataFrame, total: int, strict: bool = True) -> DataFrame:
    """tile, n, quota: total shared in proportion to n, whole numbers, largest fractions first, ties by tile. A total below 1 raises, and unless strict is off one above the sum of n."""
    if total <= 0:
        raise ValueError(f"a total of {total}")
    raw = F.col("n") * F.lit(float(total)) / F.col("_all")
    c = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).withColumns({"_floor": F.floor(raw), "_part": F.round(raw - F.floor(raw), 9)})
    c = c.crossJoin(F.broadcast(c.agg((F.lit(total) - F.sum("_floor")).alias("_left"))))
    rank = F.row_number().over(Window.orderBy(F.desc("_part"), "tile"))
    enough = F.col("_floor") if not strict else F.when(F.col("_all") < total, F.raise_error(F.concat(F.lit(f"{total} wanted of "), F.col("_all").cast("string"))).cast("long")).otherwise(F.col("_floor"))
    return c.select("tile", "n", (enough + (rank <= F.col("_left")).cast("long")).alias("quota"))


def take_quota(rows: DataFrame, quotas: DataFrame, seed: int = 0) -> DataFrame:
    """quota pids of every tile, those of smallest hash."""
    return fewest(rows.join(quotas.select("tile", "quota"), "tile"), ["tile"], "quota", hash32(F.lit(seed), F.col("tile"), F.col("pid")), "pid")


def complete_bundles(examples: DataFrame, n_tasks: int = 6) -> DataFrame:
    """tile, pid, n, n_tasks, complete: whether a series has each of the tasks exactly once."""
    g = examples.groupBy("tile", "pid").agg(F.count("*").alias("n"), F.countDistinct("task_name").alias("n_tasks"))
    return g.withColumn("complete", (F.col("n") == n_tasks) & (F.col("n_tasks") == n_tasks))


def bucket_compare(full: DataFrame, subset: DataFrame) -> DataFrame:
    """task_name, bucket_label, full_n, subset_n and their fractions within the task."""
    count = lambda df, name: df.groupBy("task_name", "bucket_label").agg(F.count("*").alias(name))
    both = count(full, "full_n").join(count(subset, "subset_n"), ["task_name", "bucket_label"], "full").na.fill(0, ["full_n", "subset_n"])
    w = Window.partitionBy("task_name")
    part = lambda c: F.try_divide(F.col(c), F.sum(c).over(w))
    return both.withColumns({"full_fraction": part("full_n"), "subset_fraction": part("subset_n")})


def drop_random(points: DataFrame, rate: float | Column, seed: int | Column = 0, keep: int = 6, by: tuple[str, ...] = ("pid",)) -> DataFrame:
    """round(rate n) of a series' n observed values become null, those of smallest hash; at least keep stay. by: what tells series apart."""
    seen = is_finite(F.col("y"))
    own = Window.partitionBy(*by)
    n = F.count_if(seen).over(own)
    rank = F.row_number().over(Window.partitionBy(*by, seen).orderBy(hash32(_lit(seed), F.col("pid"), F.col("epoch")), "epoch"))
    p = points.withColumns({"_n": n, "_rank": rank})
    drop = F.greatest(F.lit(0), F.least(F.bround(F.col("_n") * _lit(rate), 0), F.col("_n") - keep))
    return p.withColumn("y", F.when(seen & (F.col("_rank") > drop), F.col("y"))).drop("_n", "_rank")


def drop_stride(points: DataFrame, stride: int | Column, offset: int | Column = 0, keep: int = 6, by: tuple[str, ...] = ("pid",)) -> DataFrame:
    """Only every stride-th observed value stays, from offset mod stride; if fewer than keep would, keep evenly spread ones do."""
    seen = is_finite(F.col("y"))
    own = Window.partitionBy(*by)
    place = F.row_number().over(Window.partitionBy(*by, seen).orderBy("epoch")) - 1
    p = points.withColumns({"_n": F.count_if(seen).over(own), "_i": place})
    regular = F.pmod(F.col("_i") - F.pmod(_lit(offset), _lit(stride)), _lit(stride)) == 0
    p = p.withColumn("_kept", F.count_if(seen & regular).over(own))
    spots = F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda k: F.bround(k * (F.col("_n") - 1) / F.lit(max(keep - 1, 1)), 0).cast("int"))
    stay = F.when(F.col("_kept") >= F.least(F.lit(keep), F.col("_n")), regular).otherwise(F.array_contains(spots, F.col("_i")))
    return p.withColumn("y", F.when(seen & stay, F.col("y"))).drop("_n", "_i", "_kept")


def drop_block(points: DataFrame, days: int | Column, seed: int | Column = 0, keep: int = 6, by: tuple[str, ...] = ("pid",)) -> DataFrame:
    """Values within days/2 of one observed date, chosen by hash, become null; unless fewer than keep would stay."""
    seen = is_finite(F.col("y"))
    own = Window.partitionBy(*by)
    centre = F.min_by(F.col("d"), F.when(seen, F.struct(hash32(_lit(seed), F.col("pid"), F.col("epoch")), F.col("epoch")))).over(own)
    p = points.withColumn("_c", centre)
    inside = F.abs(F.datediff("d", "_c")) * 2 <= _lit(days)
    p = p.withColumn("_in", F.coalesce(inside, F.lit(False)))
    p = p.withColumn("_left", F.count_if(seen & ~F.col("_in")).over(own))
    return p.withColumn("y", F.when(~(F.col("_in") & (F.col("_left") >= keep)), F.col("y"))).drop("_c", "_in", "_left")


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


#: Perturbation families and their severities, each repeated for three seeds; with the clean condition, 28.
FAMILIES = {"missing": (0.1, 0.3, 0.5), "stride": (2, 3, 4), "block": (60, 120, 180)}


def condition_grid(spark) -> DataFrame:
    """condition_id, family, severity, seed_idx."""
    rows = [("clean", "clean", 0.0, 0)] + [(f"{f}_{s}_{k}", f, float(s), k) for f, own in FAMILIES.items() for s in own for k in range(3)]
    return spark.createDataFrame(rows, "condition_id string, family string, severity double, seed_idx int")


def perturb(points: DataFrame, family: str, severity: float | Column, seed_idx: int | Column, by: tuple[str, ...] = ("pid",)) -> DataFrame:
    whole = severity.cast("int") if isinstance(severity, Column) else int(severity)
    if family == "missing":
        return drop_random(points, severity, seed_idx, by=by)
    if family == "stride":
        return drop_stride(points, whole, seed_idx, by=by)
    if family == "block":
        return drop_block(points, whole, seed_idx, by=by)
    return points


def all_conditions(points: DataFrame) -> DataFrame:
    """points under each of the 28 conditions, with condition_id.

    The points are dealt by series once; each task repeats its own under the
    grid (28 fixed rows), and the windows by condition and series need no further
    exchange.
    """
    grid, dealt, out = condition_grid(points.sparkSession), points.repartition("pid"), None
    for family in ("clean", *FAMILIES):
        own = dealt.crossJoin(F.broadcast(grid.where(F.col("family") == family)))
        own = perturb(own, family, F.col("severity"), F.col("seed_idx"), ("condition_id", "pid")).drop("family", "severity", "seed_idx")
        out = own if out is None else out.unionByName(own)
    return out


def condition_summary(points: DataFrame) -> DataFrame:
    """condition_id, n, mean observed and total values and missing rate over series."""
    per = points.groupBy("condition_id", "pid").agg(F.count_if(is_finite(F.col("y"))).alias("observed"), F.count("*").alias("total"))
    return per.groupBy("condition_id").agg(F.count("*").alias("n"), F.avg("observed").alias("mean_observed"), F.avg("total").alias("mean_total"), F.avg(1 - F.col("observed") / F.col("total")).alias("mean_missing"))


def shuffled_head(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a hash of seed and id (ties by id): a shuffled sample that repeats; place tells the order."""
    order = hash32(F.lit(seed), F.col("id"))
    top = rows.orderBy(order, "id").limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(order, "id")).cast("long") - 1)  # n rows


def shuffled(rows: DataFrame, seed: int = 0) -> DataFrame:
    """All rows with place, their rank (from 0) in the order of a hash of seed and id (ties by id).

    Ranges of the order are dealt out and written once; a row's place is how many the
    ranges before its own hold, and its rank there, so no task orders them all.
    """
    order = [hash32(F.lit(seed), F.col("id")).alias("_h"), F.col("id")]
    dealt = rows.select("*", order[0]).repartitionByRange("_h", "id").withColumn("_part", F.spark_partition_id())
    dealt = stored(dealt, "shuffled")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_start"))  # a row per range
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_h", "id"))
    return dealt.join(F.broadcast(starts), "_part").withColumn("place", F.col("_start") + rank - 1).drop("_h", "_part", "_start")


def by_id_list(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of a frozen id list, with place, in whose order a writer sorts them; a repeated id in the list or an id that no row has raises when the result runs.

    ids: id, place. Rows that repeat an id: the last by _seq if there is such a column, else any one.
    """
    listed = ids.groupBy("id").agg(F.min("place").alias("place"), F.count("*").alias("_times"))
    struct = F.struct(*[c for c in rows.columns if c != "id"], F.lit(True).alias("_there"))
    own = rows.groupBy("id").agg(F.max_by(struct, F.col("_seq") if "_seq" in rows.columns else F.lit(0)).alias("_row"))
    fault = F.when(F.col("_times") > 1, F.concat(F.lit("id listed more than once: "), F.col("id"))).when(F.col("_row").isNull(), F.concat(F.lit("no row for listed id: "), F.col("id")))
    checked = listed.join(own, "id", "left").withColumn("place", F.when(fault.isNotNull(), F.raise_error(fault).cast("long")).otherwise(F.col("place")))
    return checked.select("id", "place", *[F.col(f"_row.{c}").alias(c) for c in rows.columns if c not in ("id", "_seq")])
