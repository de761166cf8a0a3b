"""Neighbours in a plane: k nearest, agreement flags, distance graphs and their components, within tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch_folder, stored
from .quantile import median_by

KEYS = ("task_name", "tile")
#: Levels of the quadtree; points that share a cell of the last one are not parted further.
DEPTH = 29
#: Levels counted in one pass over the points that are still crowded.
PASS = 7


def dealt(df: DataFrame) -> DataFrame:
    """df, joined by an exchange: a table that grows with the input is not collected on the driver, however small its file looks."""
    return df.hint("shuffle_merge")


def node_of(level: Column, ix: Column, iy: Column) -> Column:
    """A cell as one number: its level and its column and row there."""
    return F.shiftleft(level.cast("long"), 2 * DEPTH) + F.shiftleft(ix.cast("long"), DEPTH) + iy.cast("long")


def cell_at(level: Column, c: Column) -> Column:
    """A column or row of the last level, at another one."""
    return F.call_function("shiftright", c, DEPTH - level)


def span_of(x0: Column, x1: Column, x: Column) -> tuple[Column, Column]:
    """Least and greatest distance of a place from a stretch, on one axis."""
    return F.greatest(x0 - x, x - x1, F.lit(0.0)), F.greatest(F.abs(x - x0), F.abs(x - x1))


def reach(box: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Least and greatest squared distance of a place from a node's points, by their box."""
    (near_x, far_x), (near_y, far_y) = span_of(box["x0"], box["x1"], x), span_of(box["y0"], box["y1"], y)
    return near_x * near_x + near_y * near_y, far_x * far_x + far_y * far_y


def quadtree(refs: DataFrame, capacity: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (KEYS, node, level, ix, iy, n, box of their points, leaf) and points with their leaf; a leaf holds capacity points at most.

    refs: KEYS, id, x, y, ix, iy (cells of the last level) and others. Counts of PASS levels
    are taken at once; only points of cells that are too full at the last of them are counted
    deeper, so a crowd costs a few more passes over itself.
    """
    todo, nodes, placed = refs, None, None
    for top in range(0, DEPTH + 1, PASS):
        levels = list(range(top, min(top + PASS, DEPTH + 1)))
        level = F.col("level")
        cells = todo.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumns({"cx": cell_at(level, F.col("ix")), "cy": cell_at(level, F.col("iy"))}).withColumn("node", node_of(level, F.col("cx"), F.col("cy")))
        counts = cells.groupBy(*KEYS, "node", "level", F.col("cx").alias("ix"), F.col("cy").alias("iy")).agg(F.count("*").alias("n"), F.struct(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).alias("box"))
        counts = stored(counts.withColumn("leaf", (F.col("n") <= capacity) | (level == DEPTH)), f"counts-{top}", folder)
        full = counts.where(~F.col("leaf")).select(*KEYS, F.col("node").alias("parent"))
        parent = node_of(level - 1, F.shiftright("ix", 1), F.shiftright("iy", 1))
        under = counts.where(level > top).withColumn("parent", parent).join(full, [*KEYS, "parent"], "left_semi").select(counts.columns)
        own = counts.where(level == top).unionByName(under)
        nodes = own if nodes is None else nodes.unionByName(own)
        found = cells.drop("level", "cx", "cy").join(own.where("leaf").select(*KEYS, "node", F.col("level").alias("leaf_level"), F.col("n").alias("leaf_n")), [*KEYS, "node"]).withColumnRenamed("node", "leaf")
        placed = found if placed is None else placed.unionByName(found)
        crowded = own.where(~F.col("leaf") & (level == levels[-1])).select(*KEYS, F.col("node").alias("last"))
        if not crowded.limit(1).count():
            break
        last = F.lit(levels[-1])
        todo = stored(todo.withColumn("last", node_of(last, cell_at(last, F.col("ix")), cell_at(last, F.col("iy")))).join(crowded, [*KEYS, "last"], "left_semi").drop("last"), f"crowd-{top}", folder)
    return stored(nodes, "nodes", folder), stored(placed, "placed", folder)


def knn(points: DataFrame, k: int = 8, cell_points: int = 64) -> DataFrame:
    """task_name, tile, id, other, d2, rank: the k nearest other points of each point in its tile, ties by id; tiles of k or fewer points have none.

    points: task_name, tile, id, x, y; those without a finite place are left out. The search
    is by place: of points in one place only the k + 1 smallest ids can be anybody's
    neighbours, and the places are parted by a quadtree whose leaves hold about cell_points
    of them, however they crowd. A place first meets its own leaf. Of the nodes around (two cells of its
    leaf's size each way, where every nearer point must be), those whose box lies farther
    than the k + 1 found fall out, full ones give way to their children until
    only leaves are left, and these are searched.
    """
    folder = scratch_folder(points.sparkSession)
    need, capacity = k + 1, max(cell_points, 4 * (k + 1))
    finite = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf"))
    points = stored(points.where(finite("x") & finite("y")).select(*KEYS, "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "points", folder)
    box = points.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-300)).alias("span")).where(F.col("n") > k)
    cell = lambda c: F.least(F.floor((F.col(c) - F.col(f"{c}0")) / F.col("span") * 2.0**DEPTH), F.lit(2**DEPTH - 1)).cast("long").alias(f"i{c}")
    nth = F.row_number().over(Window.partitionBy(*KEYS, "x", "y").orderBy("id"))
    refs = points.join(box.drop("n"), list(KEYS)).select(*KEYS, "id", "x", "y", cell("x"), cell("y")).withColumn("nth", nth).where(F.col("nth") <= need)
    nodes, refs = quadtree(stored(refs, "refs", folder), capacity, folder)

    # Where a leaf has too few points for a bound, its parent has enough; both have all nearer points within two cells.
    few = (F.col("leaf_n") < need).cast("int")
    level = F.col("leaf_level") - few
    home = refs.select(*KEYS, "leaf", level.alias("level"), cell_at(level, F.col("ix")).alias("hx"), cell_at(level, F.col("iy")).alias("hy")).distinct()
    home = home.withColumn("home", node_of(F.col("level"), F.col("hx"), F.col("hy")))
    around = home.select(*KEYS, "home", "level", "hx", "hy").distinct().withColumn("up", F.explode(F.sequence(F.lit(0), F.col("level"))))
    steps = lambda c: F.explode(F.sequence(F.call_function("shiftright", F.greatest(F.col(c) - 2, F.lit(0)), F.col("up")), F.call_function("shiftright", F.col(c) + 2, F.col("up"))))
    around = around.withColumn("cx", steps("hx")).withColumn("cy", steps("hy"))
    around = around.select(*KEYS, "home", "up", node_of(F.col("level") - F.col("up"), F.col("cx"), F.col("cy")).alias("node"))
    around = around.join(dealt(nodes), [*KEYS, "node"]).where("up = 0 or leaf").groupBy(*KEYS, "home").agg(F.collect_list(F.struct("node", "n", "box", "leaf")).alias("around"))

    # Own leaf first: exchanges by leaf serve the join, the ranking and the lists. Numbers come before
    # the KEYS, as a sort looks at its first column in whole and at the rest only where that is equal.
    places = refs.where("nth = 1").select(*KEYS, "leaf", "id", "x", "y")
    other = refs.select(*KEYS, "leaf", F.col("id").alias("other"), F.col("x").alias("bx"), F.col("y").alias("by"))
    d2 = ((F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by")) ** 2).alias("d2")
    order = Window.partitionBy("id", "leaf", *KEYS).orderBy("d2", "other")
    mine = places.join(dealt(other), ["leaf", *KEYS]).select(*KEYS, "leaf", "id", "x", "y", "other", d2).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= need)
    mine = mine.groupBy("id", "leaf", *KEYS, "x", "y").agg(F.collect_list(F.struct("d2", "other")).alias("mine"))
    there = mine.join(dealt(home.select(*KEYS, "leaf", "home").join(dealt(around), ["home", *KEYS])), ["leaf", *KEYS])
    x, y = F.col("x"), F.col("y")
    bound = lambda c: F.array_min(F.transform(F.filter(c, lambda r: r["n"] >= need), lambda r: reach(r["box"], x, y)[1]))
    own = F.when(F.size("mine") == need, F.array_max(F.transform("mine", lambda m: m["d2"])))
    # A leaf with too few points is met again below its parent, so what it gave is left out here.
    there = there.withColumn("r2", F.least(own, bound("around"))).withColumn("mine", F.filter("mine", lambda m: F.col("leaf") == F.col("home"))).withColumn("around", F.filter("around", lambda r: (r["node"] != F.col("leaf")) & (reach(r["box"], x, y)[0] <= F.col("r2"))))
    there = stored(there.select(*KEYS, "id", "x", "y", "r2", "mine", "around"), "there", folder)

    met = there.select(*KEYS, "id", "x", "y", "r2", F.inline("around"))
    ahead = met.where("leaf").select(*KEYS, "id", "x", "y", "r2", F.col("node").alias("leaf"))
    todo, turn = met.where("not leaf").select(*KEYS, "id", "x", "y", "r2", "node"), 0
    # What stands for a node: its leaves and nodes three levels below, or leaves before that.
    above = nodes.withColumn("up", F.explode(F.array(*map(F.lit, (1, 2, 3))))).where("level >= up and (up = 3 or leaf)")
    above = above.withColumns({c: F.call_function("shiftright", F.col(c), F.col("up")) for c in ("ix", "iy")})
    children = above.select(*KEYS, node_of(F.col("level") - F.col("up"), F.col("ix"), F.col("iy")).alias("node"), F.col("node").alias("child"), "n", "box", "leaf")
    while True:
        todo = stored(todo, f"todo-{turn}", folder)
        if not todo.limit(1).count():
            break
        near, far = reach(F.col("box"), x, y)
        met = todo.join(dealt(children), ["node", *KEYS]).withColumn("near", near)
        met = met.withColumn("r2", F.least("r2", F.min(F.when(F.col("n") >= need, far)).over(Window.partitionBy("id", *KEYS)))).where("near <= r2")
        met = stored(met.select(*KEYS, "id", "x", "y", "r2", F.col("child").alias("node"), "leaf"), f"met-{turn}", folder)
        ahead = ahead.unionByName(met.where("leaf").select(*KEYS, "id", "x", "y", "r2", F.col("node").alias("leaf")))
        todo, turn = met.where("not leaf").drop("leaf"), turn + 1

    more = ahead.join(dealt(other), ["leaf", *KEYS]).select(*KEYS, "id", "r2", "other", d2).where("d2 <= r2").drop("r2")
    every = there.select(*KEYS, "id", F.inline("mine")).unionByName(more, allowMissingColumns=False)
    best = every.withColumn("rank", F.row_number().over(Window.partitionBy("id", *KEYS).orderBy("d2", "other"))).where(F.col("rank") <= need)
    lists = best.groupBy(F.col("id").alias("place"), *KEYS).agg(F.array_sort(F.collect_list(F.struct("d2", "other"))).alias("near"))
    located = there.select(*KEYS, F.col("id").alias("place"), "x", "y").join(dealt(lists), ["place", *KEYS]).select(*KEYS, "x", "y", "near")
    others = F.slice(F.filter("near", lambda n: n["other"] != F.col("id")), 1, k)
    ranked = F.transform(others, lambda n, i: F.struct(n["other"].alias("other"), n["d2"].alias("d2"), (i + 1).alias("rank")))
    return points.join(dealt(located), ["x", "y", *KEYS]).select(*KEYS, "id", F.inline(ranked))


def agreement(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Per point: shares of neighbours with its gold and predicted label, their gap, and the four flags.

    With the neighbours' most frequent gold and predicted labels (ties by name):
    anomaly: gold is the former and the prediction is not; oversmooth: the
    prediction is it and gold is not; pred_majority_disagree: the prediction is
    not the latter. inconsistency: the share of neighbours predicted otherwise.
    """
    n = points.select("task_name", "tile", F.col("id").alias("other"), F.col("gold").alias("g2"), F.col("pred").alias("p2"))
    e = points.join(edges, ["task_name", "tile", "id"]).join(n, ["task_name", "tile", "other"])
    keys = ["task_name", "tile", "id", "gold", "pred"]
    most = lambda c: F.array_min(F.transform(F.array_distinct(c), lambda x: F.struct((-F.size(F.filter(c, lambda y: y == x))).alias("n"), x.alias("label"))))["label"]
    g = e.groupBy(*keys).agg(
        F.avg((F.col("g2") == F.col("gold")).cast("int")).alias("gold_agreement"), F.avg((F.col("p2") == F.col("pred")).cast("int")).alias("pred_agreement"),
        F.collect_list("g2").alias("golds"), F.collect_list("p2").alias("preds"),  # k labels each
    )
    g = g.withColumns({"mg": most(F.col("golds")), "mp": most(F.col("preds"))})
    flag = lambda c: c.cast("int")
    return g.select(
        *keys, "gold_agreement", "pred_agreement", (F.col("pred_agreement") - F.col("gold_agreement")).alias("gap"), (1 - F.col("pred_agreement")).alias("inconsistency"),
        flag((F.col("gold") == F.col("mg")) & (F.col("pred") != F.col("mg"))).alias("anomaly"), flag((F.col("gold") != F.col("mg")) & (F.col("pred") == F.col("mg"))).alias("oversmooth"),
        flag(F.col("pred") != F.col("mp")).alias("pred_majority_disagree"),
    )


def spatial_summary(flags: DataFrame) -> DataFrame:
    """task_name, n_tiles, n_points, mean and sample deviation over tiles of agreement and the mean rates of the flags."""
    t = flags.groupBy("task_name", "tile").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("gold_agreement", "pred_agreement", "gap", "anomaly", "oversmooth", "pred_majority_disagree")])
    return t.groupBy("task_name").agg(F.count("*").alias("n_tiles"), F.sum("n").alias("n_points"), F.avg("gold_agreement").alias("gold_mean"), F.stddev_samp("gold_agreement").alias("gold_std"), F.avg("pred_agreement").alias("pred_mean"), F.stddev_samp("pred_agreement").alias("pred_std"), F.avg("anomaly").alias("anomaly_rate"), F.avg("oversmooth").alias("oversmooth_rate"), F.avg("pred_majority_disagree").alias("disagree_rate"))


def hotspots(before: DataFrame, after: DataFrame) -> DataFrame:
    """task_name, tile, status, n: points wrong before and right after (fixed), the reverse (introduced), wrong in both (persistent)."""
    wrong = lambda df, name: df.select("task_name", "tile", "id", (F.col("gold") != F.col("pred")).alias(name))
    j = wrong(before, "a").join(wrong(after, "b"), ["task_name", "tile", "id"])
    status = F.when(F.col("a") & ~F.col("b"), "fixed").when(~F.col("a") & F.col("b"), "introduced").when(F.col("a") & F.col("b"), "persistent").otherwise("correct")
    return j.groupBy("task_name", "tile", status.alias("status")).agg(F.count("*").alias("n"))


def kth_distance(points: DataFrame, k: int = 4) -> DataFrame:
    """task_name, tile, threshold: the median distance to the k-th nearest neighbour."""
    e = knn(points, k).where(F.col("rank") == k)
    return median_by(e, KEYS, "d2").select(*KEYS, F.sqrt("median").alias("threshold"))


def close_pairs(points: DataFrame, thresholds: DataFrame) -> DataFrame:
    """task_name, tile, a, b (a < b): pairs of a tile no farther apart than its threshold, found over grid cells of that width."""
    keys = ["task_name", "tile"]
    p = points.join(thresholds, keys).withColumns({"w": F.greatest("threshold", F.lit(1e-12)), "t2": F.col("threshold") ** 2})
    p = p.withColumns({"cx": F.floor(F.col("x") / F.col("w")), "cy": F.floor(F.col("y") / F.col("w"))})
    around = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = p.select(*keys, F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "t2", "cx", "cy", F.explode(around).alias("o"))
    left = left.withColumns({"cx": F.col("cx") + F.col("o.i"), "cy": F.col("cy") + F.col("o.j")}).drop("o")
    right = p.select(*keys, F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "cx", "cy")
    return left.join(right, [*keys, "cx", "cy"]).where("a < b and (ax - bx) * (ax - bx) + (ay - by) * (ay - by) <= t2").select(*keys, "a", "b")


#: Parts each way into which a cell is cut when boxes do not tell whether it is linked with another, and how often at most.
PARTS, TURNS = 4, 24


def close_components(points: DataFrame, thresholds: DataFrame, shared: str | None = None) -> DataFrame:
    """task_name, tile, id, component (smallest id reachable) of the graph that links points of a tile no farther apart than its threshold.

    No pair of points is listed. Cells of side threshold / sqrt 2 hold points of one component
    each, so only cells are linked, with the 12 around them on one side that can be near
    enough. Boxes of their points tell most links; cells they leave open are
    cut into parts, whose boxes tell more, until parts are single places. A
    tile without threshold has no row; at threshold 0 only points of one place are linked.
    """
    folder = scratch_folder(points.sparkSession, shared)
    keys = list(KEYS)
    box = points.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    # A little less than the side that makes the diagonal the threshold, so that rounding parts no clique.
    side = F.when(F.col("threshold") > 0, F.col("threshold") / 2**0.5 * (1 - 1e-9))
    p = points.select(*keys, "id", "x", "y").join(thresholds.select(*keys, "threshold"), keys).join(box, keys).withColumn("side", side)
    cell = lambda c, z: F.when(F.col("side").isNull(), F.col(c)).otherwise(F.floor((F.col(c) - F.col(z)) / F.col("side")).cast("double"))
    p = stored(p.select(*keys, "id", "x", "y", "threshold", "side", "x0", "y0", cell("x", "x0").alias("cx"), cell("y", "y0").alias("cy")), "cells", folder)
    bounds = [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")]
    cells = stored(p.groupBy(*keys, "cx", "cy", "side", (F.col("threshold") ** 2).alias("t2")).agg(F.min("id").alias("cell"), F.struct(*bounds).alias("box")), "boxes", folder)

    ahead = [(i, j) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)]
    other = cells.select(*keys, F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("cell").alias("b"), F.col("box").alias("b_box"))
    steps = F.explode(F.array(*[F.struct(F.lit(float(i)).alias("i"), F.lit(float(j)).alias("j")) for i, j in ahead]))
    pairs = cells.where("side is not null").withColumn("o", steps).withColumns({"ox": F.col("cx") + F.col("o.i"), "oy": F.col("cy") + F.col("o.j")}).join(dealt(other), [*keys, "ox", "oy"])
    pairs = pairs.select(*keys, "t2", F.col("cell").alias("a"), "b", F.col("box").alias("a_box"), "b_box")

    def apart(c0: str, c1: str) -> tuple[Column, Column]:
        a, b = F.col("a_box"), F.col("b_box")
        return F.greatest(a[c0] - b[c1], b[c0] - a[c1], F.lit(0.0)), F.greatest(F.abs(a[c1] - b[c0]), F.abs(b[c1] - a[c0]))

    (near_x, far_x), (near_y, far_y) = apart("x0", "x1"), apart("y0", "y1")
    near, far = near_x * near_x + near_y * near_y, far_x * far_x + far_y * far_y
    told = stored(pairs.withColumns({"near": near, "far": far}).where("near <= t2"), "told-0", folder)
    links = told.where("far <= t2").select(*keys, "a", "b")
    todo = told.where("far > t2").select(*keys, "t2", "a", "b", F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"), F.lit(0.0).alias("bx"), F.lit(0.0).alias("by"))
    members = stored(p.join(dealt(cells.select(*keys, "cx", "cy", "cell")), [*keys, "cx", "cy"]).drop("threshold"), "members", folder)
    for turn in range(1, TURNS + 1):
        todo = stored(todo, f"open-{turn}", folder)
        if not todo.limit(1).count():
            break
        # Parts of the open cells: finer columns and rows, in the last turn the places themselves.
        fine = lambda c, n: F.col(c) if n == TURNS else F.floor((F.col(c) - F.col(f"{c}0")) / F.col("side") * float(PARTS**n)).cast("double")
        coarse = lambda c, n: fine(c, n) if n else F.lit(0.0)
        open_cells = todo.select(*keys, F.col("a").alias("cell")).union(todo.select(*keys, F.col("b").alias("cell"))).distinct()
        parts = members.join(dealt(open_cells), [*keys, "cell"], "left_semi").groupBy(*keys, "cell", coarse("x", turn - 1).alias("px"), coarse("y", turn - 1).alias("py"), fine("x", turn).alias("sx"), fine("y", turn).alias("sy"))
        parts = stored(parts.agg(F.struct(*bounds).alias("box")), f"parts-{turn}", folder)
        side_of = lambda s: parts.select(*keys, F.col("cell").alias(s), F.col("px").alias(f"{s}x"), F.col("py").alias(f"{s}y"), F.col("sx").alias(f"{s}sx"), F.col("sy").alias(f"{s}sy"), F.col("box").alias(f"{s}_box"))
        met = todo.join(dealt(side_of("a")), [*keys, "a", "ax", "ay"]).join(dealt(side_of("b")), [*keys, "b", "bx", "by"]).withColumns({"near": near, "far": far}).where("near <= t2")
        met = stored(met.withColumn("linked", F.min("far").over(Window.partitionBy(*keys, "a", "b")) <= F.col("t2")), f"told-{turn}", folder)
        links = links.unionByName(met.where("linked").select(*keys, "a", "b").distinct())
        todo = met.where("not linked").select(*keys, "t2", "a", "b", *[F.col(f"{s}s{c}").alias(f"{s}{c}") for s in "ab" for c in "xy"])

    labels = connected(cells.select(*keys, F.col("cell").alias("id")), links, shared)
    return members.select(*keys, "id", "cell").join(dealt(labels.withColumnRenamed("id", "cell")), [*keys, "cell"]).select(*keys, "id", "component")


def connected(points: DataFrame, pairs: DataFrame, shared: str | None = None) -> DataFrame:
    """task_name, tile, id, component (smallest id reachable): ends of pairs are drawn together until no pair is left, then each gets what they ended in.

    In a round every end goes where its neighbour of smallest hash (or itself) goes; what
    meets becomes one end, and pairs between the same ends become one. So a
    round leaves a part of the ends and pairs of the one before, and another hash in each
    keeps chains of rising ids from standing still.

    shared: a folder all executors share for the states between rounds; by default spark.checkpoint.dir.
    """
    folder = scratch_folder(points.sparkSession, shared)
    keys = list(KEYS)
    left = stored(pairs.select(*keys, "a", "b").union(pairs.select(*keys, "b", "a")).where("a <> b").distinct(), "pairs", folder)
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        turn = len(rounds) + 1
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("hash"), F.col(c).alias("id"))  # noqa: B023, E731
        near = left.groupBy(*keys, F.col("a").alias("id")).agg(F.min(order("b")).alias("near")).select(*keys, "id", F.least("near", order("id"))["id"].alias("to"))
        moved = near.join(dealt(near.select(*keys, F.col("id").alias("to"), F.col("to").alias("far"))), [*keys, "to"]).select(*keys, "id", F.col("far").alias("to"))
        moved = moved.join(dealt(smallest(rounds[-1])), [*keys, "id"]) if rounds else moved.withColumn("least", F.col("id"))
        rounds.append(stored(moved.select(*keys, "id", "to", "least"), f"moved-{turn}", folder))
        end = lambda c: dealt(rounds[-1].select(*keys, F.col("id").alias(c), F.col("to").alias(f"{c}_to")))
        left = left.join(end("a"), [*keys, "a"]).join(end("b"), [*keys, "b"]).where("a_to <> b_to").select(*keys, F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct()
        left = stored(left, f"pairs-{turn}", folder)
    labels = None
    for moved in reversed(rounds):
        ends = smallest(moved).withColumnRenamed("least", "component")
        if labels is not None:
            ends = ends.join(dealt(labels.withColumnRenamed("component", "later")), [*keys, "id"], "left").select(*keys, "id", F.coalesce("later", "component").alias("component"))
        labels = moved.join(dealt(ends.withColumnRenamed("id", "to")), [*keys, "to"]).select(*keys, "id", "component")
    if labels is None:
        return points.select(*keys, "id", F.col("id").alias("component"))
    return stored(points.select(*keys, "id").join(dealt(labels), [*keys, "id"], "left").select(*keys, "id", F.coalesce("component", "id").alias("component")), "labels", folder)


def smallest(moved: DataFrame) -> DataFrame:
    """Of each end that others went to, the smallest id that is in it."""
    return moved.groupBy(*KEYS, F.col("to").alias("id")).agg(F.min("least").alias("least"))


def component_profile(labels: DataFrame) -> DataFrame:
    """task_name, tile, n_points, n_components, n_isolated, max_size, mean_size."""
    sizes = labels.groupBy("task_name", "tile", "component").agg(F.count("*").alias("size"))
    return sizes.groupBy("task_name", "tile").agg(F.sum("size").alias("n_points"), F.count("*").alias("n_components"), F.count_if(F.col("size") == 1).alias("n_isolated"), F.max("size").alias("max_size"), F.avg("size").alias("mean_size"))


def component_ranks(labels: DataFrame) -> DataFrame:
    """task_name, tile, rank, component, size: components by falling size, ties by smallest id."""
    sizes = labels.groupBy("task_name", "tile", "component").agg(F.count("*").alias("size"))
    return sizes.withColumn("rank", F.row_number().over(Window.partitionBy("task_name", "tile").orderBy(F.desc("size"), "component")))


def error_points(points: DataFrame, edges: DataFrame) -> DataFrame:
    """task_name, tile, cluster_type, id, x, y: the error points of the tasks B1, C1 and C2.

    <task>_anomaly: gold is the most frequent gold label of the neighbours
    (ties by name) and the prediction is not; B1_false_seasonal and
    <task>_false_step: predicted so, but not gold. A point without neighbours
    is no anomaly.
    """
    keys = ["id", "task_name", "tile"]
    n = points.select("task_name", "tile", F.col("id").alias("other"), F.col("gold").alias("g2"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "g2")
    counts = edges.join(dealt(n), ["other", "task_name", "tile"]).groupBy(*keys, "g2").agg(F.count("*").alias("n"))
    top = counts.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*keys, F.col("g2").alias("majority"))
    seasonal = F.col("task_name") == "B1_seasonality_present"
    label = F.when(seasonal, "seasonal").otherwise("step")
    anomaly = F.col("majority").isNotNull() & F.col("gold").eqNullSafe(F.col("majority")) & ~F.col("pred").eqNullSafe(F.col("majority"))
    false = ~F.col("gold").eqNullSafe(label) & F.col("pred").eqNullSafe(label)
    kinds = F.array(
        F.struct(F.concat("task_name", F.lit("_anomaly")).alias("cluster_type"), anomaly.alias("hit")),
        F.struct(F.when(seasonal, "B1_false_seasonal").otherwise(F.concat("task_name", F.lit("_false_step"))).alias("cluster_type"), false.alias("hit")),
    )
    return points.join(dealt(top), keys, "left").select(*keys, "x", "y", F.inline(kinds)).where("hit").select("task_name", "tile", "cluster_type", "id", "x", "y")


def error_thresholds(points: DataFrame, edges: DataFrame, k: int = 8) -> DataFrame:
    """task_name, tile, threshold: the median distance to the k-th neighbour over all points, to the farthest one in tiles of k or fewer points, 0 for a single point."""
    keys = ["task_name", "tile"]
    small = points.join(points.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") <= k), keys).select(*keys, "id", "x", "y")
    other = small.select(*keys, F.col("id").alias("other"), F.col("x").alias("bx"), F.col("y").alias("by"))
    d2 = F.when(F.col("id") != F.col("other"), (F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by")) ** 2)
    far = small.join(other, keys).groupBy(*keys, "id").agg(F.max(d2).alias("d2"))  # at most k * k pairs a tile
    every = edges.where(F.col("rank") == k).select(*keys, "d2").unionByName(far.select(*keys, "d2"))
    return median_by(every, KEYS, "d2").select(*keys, F.coalesce(F.sqrt("median"), F.lit(0.0)).alias("threshold"))


def error_components(points: DataFrame, k: int = 8, neighbours: int = 8) -> tuple[DataFrame, DataFrame]:
    """Profile and ranked components of the error points of each task, tile and kind of error, linked up to the whole threshold.

    points: task_name (B1, C1, C2; others are left out), tile, id, x, y, gold,
    pred. The threshold comes from all points of the task in the tile; at
    threshold 0 every point stands alone. Kinds without errors have a profile
    of zeros and null means.
    """
    folder = scratch_folder(points.sparkSession)
    points = points.where(F.col("task_name").isin("B1_seasonality_present", "C1_step_time", "C2_step_mag"))
    points = stored(points.select(*KEYS, "id", "x", "y", "gold", "pred"), "points", folder)
    edges = stored(knn(points, neighbours), "edges", folder)
    limits = stored(error_thresholds(points, edges if k == neighbours else stored(knn(points, k), "neighbours", folder), k), "limits", folder)
    one = stored(error_points(points, edges).select(F.col("cluster_type").alias("task_name"), "tile", "id", "x", "y"), "errors", folder)
    second = F.when(F.col("task_name") == "B1_seasonality_present", "B1_false_seasonal").otherwise(F.concat("task_name", F.lit("_false_step")))
    kinds = limits.select("task_name", "tile", "threshold", F.explode(F.array(F.concat("task_name", F.lit("_anomaly")), second)).alias("cluster_type"))
    own = kinds.where("threshold > 0").select(F.col("cluster_type").alias("task_name"), "tile", "threshold")
    alone = one.join(own, ["task_name", "tile"], "left_anti").select("task_name", "tile", "id", F.col("id").alias("component"))
    labels = close_components(one, own).unionByName(alone)
    profile = component_profile(labels).withColumnRenamed("task_name", "cluster_type")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    profile = kinds.join(profile, ["cluster_type", "tile"], "left").select("task_name", "tile", "cluster_type", "threshold", *map(none, ("n_points", "n_components", "n_isolated", "max_size")), (F.col("n_isolated") / F.col("n_points")).alias("isolated_share"), "mean_size")
    ranks = component_ranks(labels).withColumnRenamed("task_name", "cluster_type").join(kinds, ["cluster_type", "tile"]).select("task_name", "tile", "cluster_type", "rank", "size")
    return profile, ranks
