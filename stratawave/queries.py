"""The registered queries over the test tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays, coerce
from .operators import asof, gate, kernels, label, merge, predict, sample, score, slices, spatial, text
from .plans import hybrid
from .sources import testbed
from .sources.scratch import stored
from .streaming import events as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: str | Column) -> Column:
    """Rounded to six places, never minus zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


# ---- shared inputs and their SQL

PTS = """pts1 as (select n.n_regionkey::varchar as tile, l.l_suppkey as pid, date_trunc('month', l.l_shipdate)::date as d, sum(round(l.l_extendedprice * 100)::bigint)::bigint as cents, count(l.l_extendedprice) as n
  from lineitem l join supplier s on l.l_suppkey = s.s_suppkey join nation n on s.s_nationkey = n.n_nationkey group by 1, 2, 3),
pts0 as (select tile, pid, d, ((2 * cents + 100 * n) // nullif(200 * n, 0)) / 1000 as y from pts1),
pts as materialized (select *, count(*) over (partition by pid order by d rows between unbounded preceding and current row) - 1 as epoch, count(*) over (partition by pid) as total from pts0)"""
GAP = PTS + """,
gap as materialized (select tile, pid, d, epoch, total, case when (pid * 7 + epoch * 3) % 11 <> 0 then y end as y from pts)"""
STATICS = """statics as (select distinct pid, 12 + (pid % 10) * 0.8::double as static_rmse, 0.5 + (pid % 10) * 0.2::double as meta_rmse from pts)"""


CONDITIONS = """con as (select 'clean' as condition_id, 'clean' as family, 0.0::double as severity, 0 as k union all
 select f || '_' || t || '_' || k, f, t::double, k from (values ('missing', '0.1'), ('missing', '0.3'), ('missing', '0.5'), ('stride', '2'), ('stride', '3'), ('stride', '4'), ('block', '60'), ('block', '120'), ('block', '180')) v(f, t), range(3) r(k))"""


def fits_sql(source: str) -> str:
    return f"""f0 as (select tile, pid, y, date_diff('day', min(d) over (partition by pid), d) / 365.25::double as t from {source}),
f1 as (select *, sin(2 * pi() * t) as s, cos(2 * pi() * t) as c from f0 where y is not null),
f2 as (select tile, pid, count(*) as n, regr_slope(y, t) as slope, regr_intercept(y, t) as intercept, covar_samp(s, y) as sy, covar_samp(c, y) as cy, var_samp(s) as ss, var_samp(c) as cc, covar_samp(s, c) as sc from f1 group by 1, 2),
fits as (select tile, pid, n, slope, intercept, sqrt(power((sy * cc - cy * sc) / (ss * cc - sc * sc), 2) + power((cy * ss - sy * sc) / (ss * cc - sc * sc), 2)) as amplitude from f2)"""


def jumps_sql(source: str) -> str:
    return f"""j0 as (select tile, pid, epoch, d, y - lag(y) over (partition by pid order by epoch) as jump from {source}),
j1 as (select *, row_number() over (partition by pid order by abs(jump) desc, epoch) as k from j0 where jump is not null),
jumps as (select tile, pid, jump, d as step_date, abs(jump) >= greatest(0.5, 3 * static_rmse) as is_step from j1 join statics using (pid) where k = 1)"""


LABELS = f"""{fits_sql('pts')}, {STATICS}, {jumps_sql('pts')},
labelled as materialized (select f.tile, f.pid, slope, amplitude, jump, step_date, coalesce(is_step, false) as is_step,
  case when slope >= 0.2 then 'uplifting' when slope <= -0.2 then 'subsiding' else 'stable' end as trend,
  case when amplitude >= 0.5 then 'seasonal' else 'nonseasonal' end as season, case when coalesce(is_step, false) then 'step' else 'no_step' end as step
  from fits f left join jumps j using (pid) where n >= 3)"""
GOLD = f"""{PTS}, {LABELS},
g0 as (select *, round(slope, 1) + 0.0 as s1, round(amplitude, 1) + 0.0 as a1, round(jump, 1) + 0.0 as j1 from labelled),
g1 as (select tile, pid, 'A1_trend_dir' as task_name, trend as bucket_label, trend as answer, null::double as answer_numeric, 'class_exact' as metric, null::double as tolerance, step_date from g0
 union all select tile, pid, 'A2_trend_v', trend, s1::varchar, s1, 'num_within_tol', 0.2, step_date from g0
 union all select tile, pid, 'B1_seasonality_present', season, season, null, 'class_exact', null, step_date from g0
 union all select tile, pid, 'B2_seasonality_amp', season, case when season = 'seasonal' then a1::varchar else 'none' end, case when season = 'seasonal' then a1 end, 'num_or_none_within_tol', 0.5, step_date from g0
 union all select tile, pid, 'C1_step_time', step, case when is_step then strftime(step_date, '%Y%m%d') else 'none' end, null, 'time_or_none_within_k', 1, step_date from g0
 union all select tile, pid, 'C2_step_mag', step, case when is_step then j1::varchar else 'none' end, case when is_step then j1 end, 'num_or_none_within_tol', 0.5, step_date from g0),
gold as materialized (select *, tile || '_' || pid || '_' || task_name as id from g1)"""
WRONG = """case when task_name = 'A1_trend_dir' then case when pid % 7 = 3 then 'stable' else upper(answer) end
    when task_name = 'B1_seasonality_present' then case when pid % 7 = 3 then 'nonseasonal' else answer end
    when task_name = 'C1_step_time' then case when pid % 7 = 3 then '19980415' when pid % 7 = 4 then 'not a date' when pid % 7 = 5 then 'none' else answer end
    else case when answer_numeric is null then case when pid % 7 = 3 then '4.5' else answer end when pid % 7 = 3 then round(answer_numeric + 0.2, 1)::varchar when pid % 7 = 4 then round(answer_numeric + 0.6, 1)::varchar when pid % 7 = 5 then 'none' else answer end end"""
PRED = f"""pred as materialized (select id, tile, pid, task_name, case when pid % 5 = 0 then null else {WRONG} end as answer_parsed, case when pid % 5 = 0 then 'no_json_object_found' end as parse_error from gold where pid % 11 <> 0)"""
NUMBER = "regexp_full_match(trim({0}), '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?')"
SCORED = f"""gp as (select g.*, p.answer_parsed, case when p.id is null then 'missing_pred' else p.parse_error end as parse_error, p.id is not null as there from gold g left join pred p using (id)),
near as (select gp.id, min_by(x.epoch, abs(date_diff('day', x.d, try_strptime(gp.answer, '%Y%m%d')::date)) * 10000 + x.epoch) as gi,
   min_by(x.epoch, abs(date_diff('day', x.d, try_strptime(gp.answer_parsed, '%Y%m%d')::date)) * 10000 + x.epoch) as pi
   from gp join pts x using (pid) where task_name = 'C1_step_time' and regexp_full_match(answer, '[0-9]{{8}}') and regexp_full_match(answer_parsed, '[0-9]{{8}}') group by 1),
scored as materialized (select gp.*, case
   when parse_error is not null and answer_parsed is null then false
   when metric = 'class_exact' then lower(trim(coalesce(answer_parsed, 'none'))) = lower(trim(answer))
   when metric = 'num_or_none_within_tol' and answer_numeric is null then answer_parsed is null or lower(trim(answer_parsed)) = 'none'
   when metric in ('num_within_tol', 'num_or_none_within_tol') then coalesce(abs(try_cast(answer_parsed as decimal(38,18)) - answer_numeric::varchar::decimal(38,18)) <= tolerance::varchar::decimal(38,18), false)
   when answer = 'none' then answer_parsed is null or lower(trim(answer_parsed)) = 'none'
   else coalesce(abs(near.pi - near.gi) <= 1, false) end::int as ok
   from gp left join near using (id))"""


def points(s, d):
    return testbed.series_points(s, d)


def gold_rows(s: SparkSession, d: str) -> DataFrame:
    """Question rows with their series' date grid. Points and rows are stored, as labels, grids, gold and predictions all use them."""
    return gold_of(stored(points(s, d), "points"))


def gold_of(p: DataFrame) -> DataFrame:
    """gold_rows of points that are stored already."""
    grid = p.groupBy("pid").agg(F.transform(F.array_sort(F.collect_list("d")), lambda x: coerce.yyyymmdd(x)).alias("t_iso"))
    st = testbed.statics(p).select("pid", F.col("static_rmse").alias("rmse"))
    return stored(label.question_rows(label.labels(p, st)).join(grid, "pid"), "gold")


def predictions(gold: DataFrame) -> DataFrame:
    """A model's answers: gold spoilt by rules on pid."""
    a, n, k, t = F.col("answer"), F.col("answer_numeric"), F.col("pid") % 7, F.col("task_name")
    shifted = lambda x: F.round(n + x, 1).cast("string")
    number = F.when(n.isNull(), F.when(k == 3, "4.5").otherwise(a)).when(k == 3, shifted(0.2)).when(k == 4, shifted(0.6)).when(k == 5, "none").otherwise(a)
    wrong = F.when(t == "A1_trend_dir", F.when(k == 3, "stable").otherwise(F.upper(a))).when(t == "B1_seasonality_present", F.when(k == 3, "nonseasonal").otherwise(a)).when(t == "C1_step_time", F.when(k == 3, "19980415").when(k == 4, "not a date").when(k == 5, "none").otherwise(a)).otherwise(number)
    null = F.col("pid") % 5 == 0
    return gold.where("pid % 11 <> 0").select("id", "tile", "pid", "task_name", F.when(~null, wrong).alias("answer_parsed"), F.when(null, "no_json_object_found").alias("parse_error"))


def scored_rows(s, d, mode="intersection"):
    g = gold_rows(s, d)
    return score.score(g, predictions(g), mode)


# ---- series and labels


@query(f"with {PTS} select tile, pid, count(*) filter (epoch < floor(total * 0.8) and y is not null) as n_observed, count(*) filter (epoch < floor(total * 0.8) and y is not null) >= 30 as eligible from pts group by tile, pid")
def series_eligibility(s, d):
    return label.eligibility(points(s, d))


@query(f"with {PTS}, {fits_sql('(select * from pts where epoch < floor(total * 0.8))')} select tile, pid, round(slope, 6) + 0.0 as slope, round(intercept, 6) + 0.0 as intercept from fits")
def ols_slope(s, d):
    return label.fits(label.train_window(points(s, d))).select("tile", "pid", r6("slope").alias("slope"), r6("intercept").alias("intercept"))


@query(f"with {PTS}, {fits_sql('(select * from pts where epoch < floor(total * 0.8))')}, t as (select tile, slope, case when slope >= 0.2 then 'uplifting' when slope <= -0.2 then 'subsiding' else 'stable' end as trend from fits) select tile, trend, count(*) as n, round(avg(slope), 6) + 0.0 as mean_slope from t group by 1, 2")
def trend_label_counts(s, d):
    f = label.fits(label.train_window(points(s, d))).withColumn("trend", label.trend_label(F.col("slope")))
    return f.groupBy("tile", "trend").agg(F.count("*").alias("n"), r6(F.avg("slope")).alias("mean_slope"))


@query(f"with {GAP}, {fits_sql('gap')} select tile, pid, n, round(amplitude, 6) as amplitude, case when amplitude >= 0.5 then 'seasonal' else 'nonseasonal' end as season from fits")
def harmonic_amp(s, d):
    return label.fits(testbed.gappy_points(s, d)).select("tile", "pid", "n", r6("amplitude").alias("amplitude"), label.season_label(F.col("amplitude")).alias("season"))


@query(f"with {GAP}, {STATICS}, {jumps_sql('gap')} select tile, pid, round(jump, 6) as jump, strftime(step_date, '%Y%m%d') as step_date, is_step from jumps")
def max_jump_step(s, d):
    p = testbed.gappy_points(s, d)
    j = label.max_jump(p, testbed.statics(p).select("pid", F.col("static_rmse").alias("rmse")))
    return j.select("tile", "pid", r6("jump").alias("jump"), coerce.yyyymmdd(F.col("step_date")).alias("step_date"), "is_step")


@query(f"with {GAP} select tile, pid, epoch, y, (y is not null)::int as mask from gap where epoch >= total - 24")
def slice_last_n(s, d):
    return label.edge_slice(testbed.gappy_points(s, d), 24).select("tile", "pid", "epoch", "y", "mask")


@query(f"""with {GAP}, {STATICS}, {jumps_sql('gap')}, a as (select gap.*, max(case when gap.d = j.step_date then epoch end) over (partition by gap.pid) as r from gap left join jumps j on j.pid = gap.pid and j.is_step),
 b as (select *, coalesce(greatest(0, least(r - 12, total - 24)), greatest(0, total - 24)) as start from a) select tile, pid, epoch, y, (y is not null)::int as mask from b where epoch >= start and epoch < start + 24""")
def slice_around_step(s, d):
    p = testbed.gappy_points(s, d)
    j = label.max_jump(p, testbed.statics(p).select("pid", F.col("static_rmse").alias("rmse"))).where("is_step")
    return label.slice_around(p, j.select("pid", "step_date"), 24).select("tile", "pid", "epoch", "y", "mask")


@query(f"with {PTS} select tile, pid, epoch, y from pts where epoch <= 23")
def slice_first_n(s, d):
    return label.edge_slice(points(s, d), 24, last=False).select("tile", "pid", "epoch", "y")


@query(f"with {GOLD} select id, tile, pid, task_name, bucket_label, answer, answer_numeric, metric, tolerance from gold")
def explode_tasks(s, d):
    return gold_rows(s, d).select("id", "tile", "pid", "task_name", "bucket_label", "answer", "answer_numeric", "metric", "tolerance")


@query(f"with {GOLD} select task_name, bucket_label, count(*) as n from gold group by 1, 2")
def task_bucket_counts(s, d):
    return gold_rows(s, d).groupBy("task_name", "bucket_label").agg(F.count("*").alias("n"))


@query(f"with {PTS}, {STATICS} select tile, pid, count(*) as n, sum(y is not null) as mask_sum, round(sum(y), 3) as y_sum, min(d)::varchar as first_day, max(d)::varchar as last_day from pts group by 1, 2")
def series_arrays(s, d):
    x = label.series_arrays(points(s, d))
    total = F.aggregate("series.d_mm", F.lit(0.0), lambda a, v: a + v)
    ones = F.aggregate("series.mask", F.lit(0), lambda a, v: a + v)
    return x.select("tile", "pid", F.size("series.d_mm").cast("long").alias("n"), ones.cast("long").alias("mask_sum"), F.round(total, 3).alias("y_sum"), F.array_min("series.t_iso").alias("first_day"), F.array_max("series.t_iso").alias("last_day"))


# ---- splits, samples, perturbations


def h32(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::bigint"


@query(f"with {PTS}, p as (select distinct tile, pid from pts), u as (select *, {h32('7', 'tile', 'pid')} / 4294967296.0::double as u from p) select tile, pid, case when u < 0.1 then 'dev' when u < 0.2 then 'test' else 'train' end as split from u")
def hash_split(s, d):
    return sample.assign_split(points(s, d).select("tile", "pid").distinct(), seed=7)


@query(f"with {GOLD}, k as (select *, row_number() over (partition by task_name, bucket_label order by {h32('3', 'id')}, id) as k from gold) select id, task_name, bucket_label from k where k <= 10")
def balanced_sample(s, d):
    return sample.balanced(gold_rows(s, d), 10, seed=3).select("id", "task_name", "bucket_label")


@query(f"with {GOLD} select task_name, bucket_label, count(*) as n, 40 - count(*) as missing from gold group by 1, 2 having count(*) < 40")
def shortfall(s, d):
    return sample.shortfall(gold_rows(s, d), 40)


@query(f"with {PTS}, p as (select tile, pid, row_number() over (partition by tile order by pid) as k from (select distinct tile, pid from pts)) select tile, pid from p where k <= 5")
def tile_head_cap(s, d):
    return sample.head_per_tile(points(s, d).select("tile", "pid").distinct(), 5)


@query(f"""with {GOLD}, b as (select distinct task_name, bucket_label from gold), t as (select *, 4 // count(*) over (partition by task_name) + (row_number() over (partition by task_name order by bucket_label) - 1 < 4 % count(*) over (partition by task_name))::int as target from b),
 k as (select g.*, target, row_number() over (partition by task_name, bucket_label order by {h32('5', 'id')}, id) as k from gold g join t using (task_name, bucket_label)) select id, task_name, bucket_label from k where k <= target""")
def stratified_sample(s, d):
    g = gold_rows(s, d)
    return sample.stratified(g, sample.even_targets(g, 4), seed=5).select("id", "task_name", "bucket_label")


@query(f"""with {PTS}, c as (select tile, count(distinct pid) as n from pts group by 1), r as (select *, n * 17.0::double / sum(n) over () as raw from c), f as (select *, floor(raw) as fl, round(raw - floor(raw), 9) as part from r)
 select tile, n, (fl + (row_number() over (order by part desc, tile) <= 17 - sum(fl) over ())::int)::bigint as quota from f""")
def largest_remainder(s, d):
    return sample.largest_remainder(points(s, d).groupBy("tile").agg(F.countDistinct("pid").alias("n")), 17, strict=False)


@query(f"""with {PTS}, c as (select tile, count(distinct pid) as n from pts group by 1), r as (select *, n * 17.0::double / sum(n) over () as raw from c), f as (select *, floor(raw) as fl, round(raw - floor(raw), 9) as part from r),
 q as (select tile, fl + (row_number() over (order by part desc, tile) <= 17 - sum(fl) over ())::int as quota from f), k as (select tile, pid, quota, row_number() over (partition by tile order by {h32('1', 'tile', 'pid')}, pid) as k from (select distinct tile, pid from pts) join q using (tile)) select tile, pid from k where k <= quota""")
def quota_sample(s, d):
    p = points(s, d).select("tile", "pid").distinct()
    return sample.take_quota(p, sample.largest_remainder(p.groupBy("tile").agg(F.count("*").alias("n")), 17, strict=False), seed=1)


@query(f"with {GOLD} select tile, pid, count(*) as n, count(distinct task_name) as n_tasks, count(*) = 6 and count(distinct task_name) = 6 as complete from gold where not (pid % 9 = 0 and task_name = 'C2_step_mag') group by 1, 2")
def complete_bundles(s, d):
    return sample.complete_bundles(gold_rows(s, d).where("not (pid % 9 = 0 and task_name = 'C2_step_mag')"))


@query(f"""with {GOLD}, f as (select task_name, bucket_label, count(*) as full_n from gold group by 1, 2), s as (select task_name, bucket_label, count(*) as subset_n from gold where pid % 3 = 0 group by 1, 2),
 b as (select task_name, bucket_label, coalesce(full_n, 0) as full_n, coalesce(subset_n, 0) as subset_n from f full join s using (task_name, bucket_label))
 select *, round(full_n / sum(full_n) over (partition by task_name), 6) as full_fraction, round(subset_n / sum(subset_n) over (partition by task_name), 6) as subset_fraction from b""")
def bucket_compare(s, d):
    g = gold_rows(s, d)
    b = sample.bucket_compare(g, g.where("pid % 3 = 0"))
    return b.select("task_name", "bucket_label", "full_n", "subset_n", r6("full_fraction").alias("full_fraction"), r6("subset_fraction").alias("subset_fraction"))


@query(f"""with {GAP}, k as (select *, count(y) over (partition by pid) as n, case when y is not null then row_number() over (partition by pid, y is not null order by {h32('2', 'pid', 'epoch')}, epoch) end as r from gap)
 select pid, epoch, case when r > greatest(0, least(round_even(n * 0.3, 0), n - 6)) then y end as y from k""")
def perturb_missing(s, d):
    return sample.drop_random(testbed.gappy_points(s, d), 0.3, seed=2).select("pid", "epoch", "y")


@query(f"""with {GAP}, k as (select *, case when y is not null then row_number() over (partition by pid, y is not null order by epoch) - 1 end as i from gap) select pid, epoch, case when (i - 1 + 3) % 3 = 0 then y end as y from k""")
def perturb_stride(s, d):
    return sample.drop_stride(testbed.gappy_points(s, d), 3, offset=1).select("pid", "epoch", "y")


@query(f"""with {GAP}, c as (select pid, arg_min(d, {h32('1', 'pid', 'epoch')} * 1000 + epoch) as c from gap where y is not null group by 1) select gap.pid, epoch, case when abs(date_diff('day', c, d)) * 2 > 360 then y end as y from gap join c using (pid)""")
def perturb_block(s, d):
    return sample.drop_block(testbed.gappy_points(s, d), 360, seed=1).select("pid", "epoch", "y")


@query(f"""with {GAP}, {{CONDITIONS}}, n as (select pid, count(y) as n, count(*) as total from gap group by 1),
 mid as (select pid, k, arg_min(d, {h32('k', 'pid', 'epoch')} * 1000 + epoch) as c from gap, range(3) r(k) where y is not null group by 1, 2),
 bl as (select condition_id, gap.pid, count(y) filter (abs(date_diff('day', c, d)) * 2 > severity) as stays from con join mid using (k) join gap using (pid) where family = 'block' group by 1, 2),
 per as (select condition_id, pid, total, n, case family when 'clean' then n when 'missing' then n - greatest(0, least(round_even(n * severity, 0), n - 6)) when 'block' then case when stays >= 6 then stays else n end
   else case when greatest(0, (n - 1 - k % severity::int) // severity::int + 1) >= least(6, n) then greatest(0, (n - 1 - k % severity::int) // severity::int + 1) else len(list_distinct(list_transform(range(6), lambda i: round_even(i * (n - 1) / 5.0::double, 0)))) end end as observed
   from con cross join n left join bl using (condition_id, pid))
 select condition_id, count(*) as n, round(avg(observed), 6) as mean_observed, round(avg(total), 6) as mean_total, round(avg(1 - observed / total), 6) as mean_missing from per group by 1""".replace("{CONDITIONS}", CONDITIONS))
def condition_summary(s, d):
    c = sample.condition_summary(sample.all_conditions(testbed.gappy_points(s, d)))
    return c.select("condition_id", "n", *[r6(x).alias(x) for x in ("mean_observed", "mean_total", "mean_missing")])


# ---- predictors

OBS = """o as (select pid, d, y, row_number() over (partition by pid order by d) - 1 as i, date_diff('day', min(d) over (partition by pid), d) as t from gap where y is not null)"""
SIN = """s0 as (select pid, y, sin(2 * pi() / 365.25 * t) as s, cos(2 * pi() / 365.25 * t) as c from o),
s1 as (select pid, covar_samp(s, y) as sy, covar_samp(c, y) as cy, var_samp(s) as ss, var_samp(c) as cc, covar_samp(s, c) as sc from s0 group by 1),
sinamp as (select pid, sqrt(power((sy * cc - cy * sc) / (ss * cc - sc * sc), 2) + power((cy * ss - sy * sc) / (ss * cc - sc * sc), 2)) as amp from s1)"""
NOISE = """n0 as (select pid, y - lag(y) over (partition by pid order by i) as dy from o), n1 as (select pid, median(dy) as m from n0 where dy is not null group by 1),
noise as (select pid, greatest(median(abs(dy - m)) / 0.67449, 1e-6) as noise from n0 join n1 using (pid) where dy is not null group by 1)"""


@query(f"with {GAP}, {STATICS}, {OBS}, {SIN} select pid, round(amp, 6) as amp, case when amp >= 1.0 and amp / meta_rmse >= 1.5 then 'seasonal' else 'nonseasonal' end as answer from sinamp join statics using (pid)")
def b1_predict_sin(s, d):
    p = testbed.gappy_points(s, d)
    return predict.b1(p, testbed.statics(p)).select("pid", r6("amp").alias("amp"), "answer")


@query(f"""with {GAP}, {OBS}, {NOISE}, a as (select pid, (quantile_cont(y, 0.975) - quantile_cont(y, 0.025)) / 2 as amp from o group by 1)
 select pid, round(amp, 8) as amp, round(noise, 6) as noise, case when amp >= 1.0 and amp / noise >= 1.5 then 'seasonal' else 'nonseasonal' end as answer from a join noise using (pid)""")
def b1_predict_p95_mad(s, d):
    p = testbed.gappy_points(s, d)
    return predict.b1(p, testbed.statics(p), mode="p95", noise="mad").select("pid", F.round("amp", 8).alias("amp"), r6("noise").alias("noise"), "answer")


def _b2_sql(amp: str, noise: str) -> str:
    return f"""with {GAP}, {STATICS}, {OBS}, {SIN}, m as (select pid, median(y) as m from o group by 1), ch as (select pid, max(abs(dy)) as ch from (select pid, y - lag(y) over (partition by pid order by i) as dy from o) group by 1),
 a as (select o.pid, {amp} as amp from o join m using (pid) join sinamp using (pid) group by o.pid), ids as (select distinct pid from pts union all select -1)
 select ids.pid, round(amp, 6) as amp, case when amp >= 1.0 and amp / {noise} >= 2.0 then round_even(amp / 0.5, 0) * 0.5 end as answer_numeric, case when ids.pid = -1 then 'missing_dataset_row' end as parse_error from ids left join a using (pid) left join statics using (pid) left join ch using (pid)"""


def _b2(s, d, **k):
    p = testbed.gappy_points(s, d)
    ids = p.select("pid").distinct().union(s.range(1).selectExpr("-1L"))
    return predict.b2(p, testbed.statics(p), ids, step=0.5, **k).select("pid", r6("amp").alias("amp"), "answer_numeric", "parse_error")


@query(_b2_sql("max(sinamp.amp)", "meta_rmse"))
def b2_predict_sin(s, d):
    return _b2(s, d)


@query(_b2_sql("max(abs(y - m))", "ch"))
def b2_predict_peak(s, d):
    return _b2(s, d, mode="peak", noise="max")


@query(_b2_sql("(max(y) - min(y)) / 2", "meta_rmse"))
def b2_predict_p2p(s, d):
    return _b2(s, d, mode="p2p")


@query(_b2_sql("(quantile_cont(y, 0.95) - quantile_cont(y, 0.05)) / 2", "meta_rmse"))
def b2_predict_p95(s, d):
    return _b2(s, d, mode="p95")


def _scan_sql(compare: str) -> str:
    return f"""b0 as (select pid, i, d, y, count(*) over (partition by pid) as n, date_diff('day', lag(d) over (partition by pid order by i), d) as gap, abs(y - lag(y) over (partition by pid order by i)) as edge from o),
b1 as (select b.pid, b.i, b.d, b.gap, b.edge, median(x.y) filter (x.i < b.i) as pre, median(x.y) filter (x.i >= b.i) as post from b0 b join o x using (pid) where b.i >= 2 and b.i <= b.n - 5 and b.gap <= 120 group by 1, 2, 3, 4, 5),
scan as (select b.*, avg((abs(x.y - post) {compare} abs(x.y - pre))::int) as persist from b1 b join o x on x.pid = b.pid and x.i >= b.i group by all)"""


@query(f"""with {GAP}, {STATICS}, {OBS}, {_scan_sql('<=')}, q as (select pid, i, d, abs(post - pre) as mag, abs(post - pre) / meta_rmse as snr, persist, edge, gap from scan join statics using (pid)),
 k as (select *, row_number() over (partition by pid order by persist desc, snr desc, mag desc, edge desc, gap, i) as k from q where mag >= 2.0 and snr >= 1.5 and persist >= 0.7 and edge >= 0)
 select p.pid, strftime(d, '%Y%m%d') as step_date, round(mag, 6) as mag, round(snr, 6) as snr, round(persist, 6) as persist from (select distinct pid from pts) p left join k on k.pid = p.pid and k = 1""")
def c1_best_split(s, d):
    p = testbed.gappy_points(s, d)
    c = predict.c1(p, testbed.statics(p), p.select("pid").distinct())
    return c.select("pid", coerce.yyyymmdd(F.col("step_date")).alias("step_date"), r6("mag").alias("mag"), r6("snr").alias("snr"), r6("persist").alias("persist"))


@query(f"""with {GAP}, {OBS}, {NOISE}, {_scan_sql('<')}, q as (select pid, i, abs(post - pre) as abs_mag, abs(post - pre) / noise as snr, persist, edge, abs(post - pre) / noise * persist as score from scan join noise using (pid)),
 k as (select *, row_number() over (partition by pid order by score desc, abs_mag desc, i) as k from q)
 select pid, round(abs_mag, 6) as abs_mag, round(snr, 6) as snr, round(persist, 6) as persist, round(score, 6) as score, abs_mag <= 6 and snr <= 1.2 and persist <= 0.9 and edge <= 20 and score <= 0.85 as use_alt from k where k = 1""")
def c1_none_guard(s, d):
    g = predict.none_guard(testbed.gappy_points(s, d), mag=6, persist=0.9, edge=20)
    return g.select("pid", r6("abs_mag").alias("abs_mag"), r6("snr").alias("snr"), r6("persist").alias("persist"), r6("score").alias("score"), "use_alt")


CAND = """c0 as (select pid, d, y, epoch, row_number() over (partition by pid order by epoch) as i from gap where y is not null),
c1 as (select *, lag(d) over (partition by pid order by epoch) as left_date, y - lag(y) over (partition by pid order by epoch) as delta from c0),
cand as (select *, row_number() over (partition by pid order by abs(delta) desc, epoch) as rank from c1 where delta is not null)"""


@query(f"""with {GAP}, {CAND}, e as (select c.pid, c.rank, c.left_date, c.d, c.delta, abs(median(x.y) filter (x.i >= c.i) - median(x.y) filter (x.i < c.i)) as est from cand c join c0 x on x.pid = c.pid and x.i between c.i - 3 and c.i + 2 where c.rank <= 5 group by 1, 2, 3, 4, 5)
 select pid, rank, strftime(left_date, '%Y%m%d') as left_day, strftime(d, '%Y%m%d') as right_day, round(delta, 6) as delta, round(est, 6) as est from e""")
def step_candidates_topk(s, d):
    c = predict.step_candidates(testbed.gappy_points(s, d))
    return c.select("pid", "rank", coerce.yyyymmdd(F.col("left_date")).alias("left_day"), coerce.yyyymmdd(F.col("right_date")).alias("right_day"), r6("delta").alias("delta"), r6("est").alias("est"))


@query(f"""with {GAP}, {STATICS}, {CAND}, b as (select c.pid, c.d, abs(c.delta) as size, median(x.y) filter (x.d < c.d) as pre, median(x.y) filter (x.d >= c.d) as post, count(*) filter (x.d < c.d) as n_pre, count(*) filter (x.d >= c.d) as n_post from cand c join c0 x using (pid) where c.rank = 1 group by 1, 2, 3),
 w as (select b.*, avg((abs(x.y - post) <= abs(x.y - pre))::int) as persist from b join c0 x on x.pid = b.pid and x.d >= b.d group by all)
 select pid, case when size >= 2.0 and size / meta_rmse >= 1.5 and n_pre >= 2 and n_post >= 3 and (persist >= 0.5 or (persist >= 0.4 and abs(post - pre) >= 1.5)) then round(size, 6) end as answer from w join statics using (pid)""")
def c2_select(s, d):
    p = testbed.gappy_points(s, d)
    st = testbed.statics(p).select("pid", "meta_rmse")
    whole = p.where("y is not null").groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("d", "y"))).alias("window"))
    c = predict.step_candidates(p).join(whole, "pid").withColumn("anchors", F.col("window")).join(st, "pid")
    return predict.c2_select(c, F.col("meta_rmse"), predict.C2Rules(persist=0.5)).select("pid", r6("answer").alias("answer"))


# ---- baseline and detectors


@query()
def baseline_fit_stats(s, d):
    p = testbed.gappy_points(s, d)
    b = kernels.baseline_stats(p, testbed.statics(p))
    return b.select("pid", "ok", *[r6(F.col(f"fit.{c}")).alias(c) for c in ("slope", "slope_se", "slope_snr", "amp", "sea_snr", "sea_improve")])


@query(f"""with {GAP}, {fits_sql('gap')}, r as (select f1.pid, n, slope, sqrt(sum(power(y - slope * t - intercept, 2)) / (n - 2)) / sqrt(regr_sxx(y, t)) as slope_se from f1 join fits using (pid) group by f1.pid, n, slope)
 select pid, round(slope, 6) + 0.0 as slope, round(slope_se, 6) as slope_se, round(abs(slope) / slope_se, 4) as slope_snr from r""")
def baseline_linear(s, d):
    p = testbed.gappy_points(s, d)
    b = kernels.baseline_stats(p, testbed.statics(p))
    return b.select("pid", r6(F.col("fit.slope")).alias("slope"), r6(F.col("fit.slope_se")).alias("slope_se"), F.round("fit.slope_snr", 4).alias("slope_snr"))


@query()
def baseline_answers(s, d):
    p = testbed.gappy_points(s, d)
    return kernels.baseline_answers(kernels.baseline_stats(p, testbed.statics(p)))


@query()
def residual_steps(s, d):
    p = testbed.gappy_points(s, d)
    b = kernels.baseline_stats(p, testbed.statics(p))
    c = b.select("pid", F.posexplode("candidates").alias("place", "c"))
    return c.select("pid", "place", "c.j", "c.present", "c.reason", *[r6(F.col(f"c.{x}")).alias(x) for x in ("mag", "snr", "improve", "delta_bic", "score")])


@query()
def legacy_steps(s, d):
    p = testbed.gappy_points(s, d)
    b = kernels.baseline_stats(p, testbed.statics(p), "one_stage")
    return b.select("pid", F.col("best.j").alias("j"), F.col("best.present").alias("present"), r6(F.col("best.mag")).alias("mag"), r6(F.col("best.snr")).alias("snr"))


# ---- merging and gates

MAIN = f"{GOLD}, {PRED}"
ALT = """alt as materialized (select id, tile, pid, task_name, 'none' as answer_parsed, null::varchar as parse_error, pid % 2 = 0 as use_alt from gold where pid % 3 = 0 and task_name in ('B2_seasonality_amp', 'C1_step_time', 'A1_trend_dir'))"""


def _alt(g):
    return g.where("pid % 3 = 0").where(F.col("task_name").isin("B2_seasonality_amp", "C1_step_time", "A1_trend_dir")).select("id", "tile", "pid", "task_name", F.lit("none").alias("answer_parsed"), F.lit(None).cast("string").alias("parse_error"), (F.col("pid") % 2 == 0).alias("use_alt"), F.lit(0).alias("_seq"))


@query(f"with {MAIN}, two as (select *, 1 as q from pred union all select id, tile, pid, task_name, 'later', parse_error, 2 from pred where pid % 4 = 0), k as (select *, row_number() over (partition by id order by q desc) as k from two) select id, answer_parsed, parse_error from k where k = 1")
def last_wins_dedup(s, d):
    p = predictions(gold_rows(s, d)).withColumn("_seq", F.lit(1))
    later = p.where("pid % 4 = 0").withColumns({"answer_parsed": F.lit("later"), "_seq": F.lit(2)})
    return score.last_wins(p.unionByName(later), "id").select("id", "answer_parsed", "parse_error")


@query(f"""with {MAIN}, {ALT} select coalesce(m.id, a.id) as id, case when u or m.id is null then a.task_name else m.task_name end as task_name, case when u or m.id is null then a.answer_parsed else m.answer_parsed end as answer_parsed,
 case when u or m.id is null then a.parse_error else m.parse_error end as parse_error, case when u then 'alt' else 'main' end as src from pred m full join (select *, task_name in ('B2_seasonality_amp', 'C1_step_time') as u from alt) a on m.id = a.id""")
def merge_taskwise(s, d):
    g = gold_rows(s, d)
    return merge.merge_tasks(predictions(g).withColumn("_seq", F.lit(0)), _alt(g), ["B2_seasonality_amp", "C1_step_time"])


@query(f"""with {MAIN}, {ALT} select m.id, m.task_name, case when u then a.answer_parsed else m.answer_parsed end as answer_parsed, case when u then a.parse_error else m.parse_error end as parse_error, coalesce(u, false) as merged_from_alt
 from pred m left join (select *, use_alt and task_name = 'C1_step_time' as u from alt) a on m.id = a.id""")
def merge_conditional(s, d):
    g = gold_rows(s, d)
    return merge.merge_flagged(predictions(g), _alt(g), ["C1_step_time"]).select("id", "task_name", "answer_parsed", "parse_error", "merged_from_alt")


@query(f"""with {MAIN}, k as (select pid, max(case when task_name = 'B1_seasonality_present' then lower(trim(answer_parsed)) end) as b1, max(case when task_name = 'C1_step_time' then lower(trim(answer_parsed)) end) as c1 from pred group by 1),
 g as (select pred.*, case when task_name = 'B2_seasonality_amp' and b1 in ('nonseasonal', 'none', 'no', 'false', '0') then 'B1->B2' when task_name = 'C2_step_mag' and c1 in ('none', 'no_step', 'nostep', 'no', 'false', '0') then 'C1->C2' end as gate_applied from pred left join k using (pid))
 select id, task_name, case when gate_applied is not null then 'none' else answer_parsed end as answer_parsed, gate_applied from g""")
def consistency_gate(s, d):
    return merge.consistency_gate(predictions(gold_rows(s, d)).withColumn("_seq", F.lit(0))).select("id", "task_name", "answer_parsed", "gate_applied")


GATE_ALL = gate.GateConfig(veto_on_base_none=True, conflict_days=200, override_c1=True, override_c2=True, impute_c1=True, impute_c2=True, c1_guard=True, c2_guard=True, guard_days=400, format_fix=True, step_improve=0.02, format_days=40)
EVID = """e0 as materialized (select g.id, g.pid, g.task_name, p.answer_parsed as llm_pred, case when g.pid % 4 = 0 then 'none' else g.answer end as base_pred, 1.0 + (g.pid % 13) * 0.5 as mag, 0.5 + (g.pid % 9) * 0.4 as snr, (g.pid % 6) * 0.01 as improve, 2.0 - g.pid % 8 as bic, (g.pid % 11) * 0.1 as persist, g.pid % 3 <> 0 as flag, strftime(g.step_date, '%Y%m%d') as date, g.pid % 10 = 9 as no_best
 from gold g join pred p using (id)),
e1 as (select *, task_name = 'C1_step_time' as c1, task_name = 'C2_step_mag' as c2, llm_pred is null or lower(trim(llm_pred)) in ('none', '', 'nan', 'null') as ln, base_pred = 'none' as bn, not no_best as has,
  try_strptime(llm_pred, '%Y%m%d')::date as ld, try_strptime(base_pred, '%Y%m%d')::date as bd, try_strptime(date, '%Y%m%d')::date as sd, round(try_cast(llm_pred as double), 1) as la, try_cast(base_pred as double) as ba from e0),
e2 as (select *, has and mag >= 2 and snr >= 1.5 and improve >= 0.02 and bic <= 0 and persist >= 0.7 and flag as strong, has and snr >= 1.5 and improve >= 0.02 and bic <= 0 and mag >= 2 as guarded,
  (mag < 1.4)::int + (snr < 1.05)::int + (improve < 0.014)::int + (persist < 0.5 and not flag)::int >= case when mag < 1.4 then 2 else 3 end as weak from e1),
e3 as materialized (select *, case when not (c1 or c2) then 'pass_through' when ln and bn and strong and c1 and sd is not null then 'impute_best' when ln and bn and strong and c2 then 'impute_best'
  when c1 and not ln and not bn and coalesce(abs(date_diff('day', ld, bd)) > 200, false) then 'conflict_force_none' when not ln and bn and c2 and guarded then 'keep_llm'
  when not ln and bn and c1 and guarded and coalesce(abs(date_diff('day', ld, sd)) <= 400, false) then 'keep_llm' when not ln and bn then 'force_none' when not ln and has and weak then 'force_none'
  when ln and not bn and strong then 'override'
  when not ln and not bn and c2 and coalesce(abs(try_cast(llm_pred as double) - ba) <= 0.5, false) and trim(llm_pred) <> la::varchar then 'format_fix' else 'keep_llm' end as action from e2)"""


def evidence(s, d):
    """Step questions with a model's and a baseline's answer and made-up evidence of the baseline's best step."""
    g = gold_rows(s, d)
    st = label.max_jump(points(s, d), testbed.statics(points(s, d)).select("pid", F.col("static_rmse").alias("rmse"))).select("pid", F.date_format("step_date", "yyyyMMdd").alias("date"))
    k = F.col("pid")
    text = lambda c: c.cast("string")
    best = F.create_map(F.lit("mag_abs_mm"), text(1.0 + (k % 13) * 0.5), F.lit("snr"), text(0.5 + (k % 9) * 0.4), F.lit("improve"), text((k % 6) * 0.01), F.lit("bic_delta"), text(2.0 - k % 8), F.lit("persist_frac"), text(F.round((k % 11) * 0.1, 1)), F.lit("persist_flag"), text(k % 3 != 0), F.lit("step_date"), F.col("date"))
    rows = g.join(predictions(g).select("id", F.col("answer_parsed").alias("llm_pred")), "id").join(st, "pid")
    cand = "array<struct<raw_adj_delta_mm:double,snr:double,improve_frac:double,persist_frac:double,delta_bic:double>>"
    return rows.select("id", "pid", "task_name", "llm_pred", F.when(k % 4 == 0, "none").otherwise(F.col("answer")).alias("base_pred"), F.when(k % 10 != 9, gate.best_step(best)).alias("best"), F.array().cast(cand).alias("candidates"))


@query(f"""with {MAIN}, {EVID} select id, task_name, action, case when action in ('pass_through', 'keep_llm') then llm_pred when action = 'impute_best' then case when c1 then date else (round_even(mag, 1))::varchar end when action = 'override' then base_pred when action = 'format_fix' then la::varchar end as final from e3""")
def decision_gate(s, d):
    return gate.decide(evidence(s, d), GATE_ALL).select("id", "task_name", "action", "final")


@query(f"""with {MAIN}, {EVID}, f as (select *, case when action in ('pass_through', 'keep_llm') then llm_pred when action = 'impute_best' then case when c1 then date else (round_even(mag, 1))::varchar end when action = 'override' then base_pred when action = 'format_fix' then la::varchar end as final from e3)
 select action, task_name, count(*) as n, count(*) filter (coalesce(final, 'none') <> coalesce(llm_pred, 'none')) as changed from f group by 1, 2""")
def gate_counters(s, d):
    return gate.counters(gate.decide(evidence(s, d), GATE_ALL))


@query(f"""with {MAIN}, {EVID}, f as (select *, case when not (c1 or c2) then 'pass_through' when not ln and has and weak then 'force_none' else 'keep_llm' end as step_action from e2)
 select step_action as action, task_name, count(*) as n, count(*) filter (step_action = 'force_none' and coalesce(llm_pred, 'none') <> 'none') as changed from f group by 1, 2""")
def gate_with_defaults(s, d):
    return gate.counters(gate.decide(evidence(s, d)))


@query(f"""with {MAIN}, {EVID}, cd as (select pid, (pid % 5) * 1.5::double + j - 4 as a, 2 + ((pid + j) % 4) * 0.5::double as snr, 0.03::double + ((pid + j) % 3) * 0.01::double as improve, 0.7::double + ((pid + 2 * j) % 4) * 0.1::double as persist, -4.0 * ((pid + j) % 3) as bic from (select distinct pid from gold), range(4) t(j)),
 jp as (select pid, max(abs(a)) filter (abs(a) >= 2.5 and snr >= 2.5 and improve >= 0.04::double and persist >= 0.8::double and bic <= -5) as jump from cd group by 1)
 select id, task_name, action, case when action in ('pass_through', 'keep_llm') then llm_pred when action = 'impute_best' then case when c1 then date else (round_even(coalesce(jump, mag), 1))::varchar end
  when action = 'override' then case when c2 then coalesce((round_even(jump, 1))::varchar, base_pred) else base_pred end when action = 'format_fix' then la::varchar end as final from e3 join jp using (pid)""")
def gate_with_candidates(s, d):
    k, j = F.col("pid"), lambda i: F.lit(i)
    one = lambda i: F.struct(((k % 5) * 1.5 + j(i) - 4).alias("raw_adj_delta_mm"), (2 + ((k + i) % 4) * 0.5).alias("snr"), (0.03 + ((k + i) % 3) * 0.01).alias("improve_frac"), (0.7 + ((k + 2 * i) % 4) * 0.1).alias("persist_frac"), (-4.0 * ((k + i) % 3)).alias("delta_bic"))
    rows = evidence(s, d).withColumn("candidates", F.array(*[one(i) for i in range(4)]))
    return gate.decide(rows, GATE_ALL).select("id", "task_name", "action", "final")


# ---- scoring

SC = f"with {GOLD}, {PRED}, {SCORED}"


@query(f"{SC} select id, task_name, bucket_label, answer, answer_parsed, ok from scored where there")
def score_intersection(s, d):
    return scored_rows(s, d).select("id", "task_name", "bucket_label", "answer", "answer_parsed", "ok")


@query(f"{SC} select id, task_name, parse_error, ok from scored")
def score_all(s, d):
    return scored_rows(s, d, "all").select("id", "task_name", "parse_error", "ok")


@query(f"{SC} select task_name, count(*) as n, round(avg(ok), 6) as acc, round(avg((parse_error is not null)::int), 6) as format_fail from scored where there group by 1")
def score_by_task(s, d):
    return score.by_task(scored_rows(s, d)).select("task_name", "n", r6("acc").alias("acc"), r6("format_fail").alias("format_fail"))


@query(f"{SC} select task_name, bucket_label, count(*) as n, round(avg(ok), 6) as acc from scored where there group by 1, 2")
def score_by_bucket(s, d):
    return score.by_bucket(scored_rows(s, d)).select("task_name", "bucket_label", "n", r6("acc").alias("acc"))


@query(f"""{SC}, t as (select task_name, avg(ok) as a from scored group by 1) select (select count(distinct id) from gold) as n_gold, (select count(distinct id) from pred) as n_pred, count(*) as n_scored, (select count(*) from t) as n_tasks,
 round(avg(ok), 6) as micro_acc, (select round(avg(a), 6) from t) as macro_acc, round((select count(*) from gold join pred using (id)) / (select count(distinct id) from gold), 6) as coverage from scored""")
def score_summary(s, d):
    g = gold_rows(s, d)
    p = predictions(g)
    x = score.summary(score.score(g, p, "all"), g, p)
    return x.select("n_gold", "n_pred", "n_scored", "n_tasks", r6("micro_acc").alias("micro_acc"), r6("macro_acc_over_tasks").alias("macro_acc"), r6("coverage_pred_over_gold").alias("coverage"))


@query(f"""with {PTS}, q as (select pid, min(d) + (pid * 37 % 2600)::int as day from pts group by pid), n as (select pid, min_by(epoch, abs(date_diff('day', d, day)) * 10000 + epoch) as pred_index, bool_or(d = day) as pred_exact, day > max(d) as pred_outside from q join pts using (pid) group by pid, day)
 select pid, pred_index, abs(pred_index - 3) as index_error, pred_exact, pred_outside from n""")
def acquisition_index(s, d):
    p = points(s, d)
    g = p.groupBy("pid").agg(F.transform(F.array_sort(F.collect_list("d")), lambda x: coerce.yyyymmdd(x)).alias("grid"), F.min("d").alias("first"))
    day = coerce.yyyymmdd(F.date_add("first", (F.col("pid") * 37 % 2600).cast("int")))
    x = g.select("pid", score.acquisition_index(F.get("grid", F.lit(3)), day, F.col("grid")).alias("i"))
    return x.select("pid", F.col("i.pred_index").cast("long").alias("pred_index"), F.col("i.index_error").cast("long").alias("index_error"), "i.pred_exact", "i.pred_outside")


@query(f"""with {PTS}, l as (select distinct l_suppkey as pid, l_shipdate::date as day from lineitem)
 select pid, strftime(day, '%Y%m%d') as day, strftime(min_by(d, abs(date_diff('day', d, day)) * 10000 + epoch), '%Y%m%d') as d, min_by(epoch, abs(date_diff('day', d, day)) * 10000 + epoch) as epoch, min(abs(date_diff('day', d, day))) as gap from l join pts using (pid) group by pid, day""")
def nearest_epochs(s, d):
    days = testbed.table(s, d, "lineitem").select(F.col("l_suppkey").alias("pid"), F.col("l_shipdate").cast("date").alias("day"))
    days = days.repartition(asof.tasks_for(s, days.count()), "pid", "day").distinct()
    x = asof.nearest_dates(days, points(s, d), ["pid"], "day", "d", ["epoch"])
    return x.select("pid", coerce.yyyymmdd(F.col("day")).alias("day"), coerce.yyyymmdd(F.col("d")).alias("d"), F.col("epoch").cast("long").alias("epoch"), F.col("gap").cast("long").alias("gap"))


@query(f"""with {PTS}, g as (select pid, min(d) as first, count(*) as n from pts group by pid), c as (select pid, median(gap) as cadence from (select pid, date_diff('day', lag(d) over (partition by pid order by d), d) as gap from pts) where gap is not null group by 1)
 select pid, round(cadence, 6) as cadence, (pid * 7 % 60 <= greatest(1, cadence))::int as ok from g join c using (pid)""")
def legacy_day_policy(s, d):
    p = points(s, d)
    g = p.groupBy("pid").agg(F.array_sort(F.collect_list("d")).alias("days"), F.min("d").alias("first"))
    rows = g.select("pid", arrays.median_cadence_days(F.col("days")).alias("cadence"), F.lit("time_or_none_within_k").alias("metric"), F.lit(1.0).alias("tolerance"), coerce.yyyymmdd(F.col("first")).alias("answer"), F.lit(None).cast("double").alias("answer_numeric"), coerce.yyyymmdd(F.date_add("first", (F.col("pid") * 7 % 60).cast("int"))).alias("answer_parsed"), F.lit(None).cast("string").alias("parse_error"), F.transform("days", lambda x: coerce.yyyymmdd(x)).alias("t_iso"))
    return score.scored(rows, "legacy_days").select("pid", r6("cadence").alias("cadence"), "ok")


# ---- slices, tiles, systems

NUM = "case when " + NUMBER.format("answer_parsed") + " then try_cast(answer_parsed as double) end"
BUCKET = f"""case when task_name = 'A1_trend_dir' then case when lower(trim(answer_parsed)) in ('subsiding', 'uplifting', 'stable') then lower(trim(answer_parsed)) else 'unknown' end
 when task_name = 'A2_trend_v' then case when {NUM} is null then 'unknown' when {NUM} >= 1 then 'uplifting' when {NUM} <= -1 then 'subsiding' else 'stable' end
 when task_name = 'B1_seasonality_present' then case when lower(trim(answer_parsed)) in ('seasonal', 'nonseasonal') then lower(trim(answer_parsed)) else 'unknown' end
 when task_name = 'B2_seasonality_amp' then case when answer_parsed is null or lower(trim(answer_parsed)) = 'none' then 'nonseasonal' when {NUM} is not null then 'seasonal' else 'unknown' end
 when task_name = 'C1_step_time' then case when answer_parsed is null or lower(trim(answer_parsed)) in ('none', 'no_step', 'nostep', '') then 'no_step' else 'step' end
 else case when answer_parsed is null or lower(trim(answer_parsed)) in ('none', 'no_step', 'nostep', '') then 'no_step' when {NUM} is not null then 'step' else 'unknown' end end"""
SL = f"{SC}, sl as (select *, {BUCKET} as pred_bucket, try_cast(answer as double) as g, {NUM} as p from scored where there)"


def sliced(s, d):
    return scored_rows(s, d).withColumn("pred_bucket", slices.predicted_bucket(F.col("task_name"), F.col("answer_parsed")))


@query(f"{SL} select id, pred_bucket from sl")
def pred_bucket(s, d):
    return sliced(s, d).select("id", "pred_bucket")


@query(f"""with {GAP}, m as (select pid, count(y) as observed, round(1 - count(y) / count(*), 6) as missing, 0.3 + (pid % 10) * 0.2 as rmse, pid % 16 as cadence from gap group by 1)
 select pid, case when rmse < 0.5 then '[0,0.5)' when rmse < 1 then '[0.5,1.0)' when rmse < 2 then '[1.0,2.0)' else '[2.0,+inf)' end as rmse_bin, case when missing < 0.1 then '[0.00,0.10)' when missing < 0.25 then '[0.10,0.25)' when missing < 0.4 then '[0.25,0.40)' else '[0.40,1.00]' end as missing_bin,
 case when observed < 40 then '[0,40)' when observed < 52 then '[40,52)' when observed < 60 then '[52,60)' else '[60,64]' end as observed_bin, case when cadence = 15 then 'unknown' when cadence < 7 then '[0,7)' when cadence < 10 then '[7,10)' when cadence < 14 then '[10,14)' else '[14,+inf)' end as cadence_bin from m""")
def bins(s, d):
    g = testbed.gappy_points(s, d).groupBy("pid").agg(F.count("y").alias("observed"), F.round(1 - F.count("y") / F.count("*"), 6).alias("missing"))
    cadence = F.when(F.col("pid") % 16 != 15, F.col("pid") % 16)
    return g.select("pid", slices.bin_of(0.3 + (F.col("pid") % 10) * 0.2, "rmse").alias("rmse_bin"), slices.bin_of(F.col("missing"), "missing").alias("missing_bin"), slices.bin_of(F.col("observed"), "observed").alias("observed_bin"), slices.bin_of(cadence, "cadence").alias("cadence_bin"))


@query(f"""{SL}, e as (select 'all' as slice, 'all' as value, * from sl union all select 'tile', tile, * from sl union all select 'bucket_label', bucket_label, * from sl), t as (select slice, value, avg(a) as macro_acc, count(*) as n_tasks from (select slice, value, task_name, avg(ok) as a from e group by 1, 2, 3) group by 1, 2)
 select slice, value, count(*) as n, count(distinct pid) as n_pid, round(avg(ok), 6) as micro_acc, round(any_value(macro_acc), 6) as macro_acc, any_value(n_tasks) as n_tasks from e join t using (slice, value) group by 1, 2""")
def slice_report(s, d):
    m = slices.micro_macro(scored_rows(s, d), ["tile", "bucket_label"])
    return m.select("slice", "value", "n", "n_pid", r6("micro_acc").alias("micro_acc"), r6("macro_acc").alias("macro_acc"), "n_tasks")


@query(f"{SL} select tile, task_name, count(*) as n, count(distinct pid) as n_pid, round(avg(ok), 6) as acc from sl group by 1, 2")
def task_accuracy(s, d):
    return slices.task_accuracy(scored_rows(s, d), "tile").select("tile", "task_name", "n", "n_pid", r6("acc").alias("acc"))


@query(f"{SL}, n as (select tile, bucket_label, count(*) as n from sl where task_name = 'A1_trend_dir' group by 1, 2), k as (select *, row_number() over (partition by tile order by n desc, bucket_label) as k from n) select tile, bucket_label || '_dominated' as regime from k where k = 1")
def tile_regime(s, d):
    return slices.regimes(scored_rows(s, d))


def _share(task: str, column: str, value: str) -> str:
    return f"round(avg(case when task_name = '{task}' then ({column} = '{value}')::int end), 6)"


TILE_SUMMARY = f"""select tile, count(*) as n_examples, count(distinct pid) as n_pid, {', '.join(f"{_share('A1_trend_dir', c, v)} as a1_{n}_{v}" for v in ('subsiding', 'stable', 'uplifting') for c, n in (('bucket_label', 'gold'), ('pred_bucket', 'pred')))},
 round(avg(case when task_name = 'A2_trend_v' then g end), 6) + 0.0 as a2_gold_mean, round(avg(case when task_name = 'A2_trend_v' and g is not null then p end), 6) + 0.0 as a2_pred_mean, round(avg(case when task_name = 'A2_trend_v' then abs(p - g) end), 6) as a2_mae,
 {_share('B1_seasonality_present', 'bucket_label', 'seasonal')} as b1_gold_seasonal, {_share('B1_seasonality_present', 'pred_bucket', 'seasonal')} as b1_pred_seasonal,
 round(avg(case when task_name = 'B2_seasonality_amp' and bucket_label = 'seasonal' then g end), 6) as b2_gold_mean, round(avg(case when task_name = 'B2_seasonality_amp' and bucket_label = 'seasonal' and g is not null then p end), 6) as b2_pred_mean, round(avg(case when task_name = 'B2_seasonality_amp' and bucket_label = 'seasonal' then abs(p - g) end), 6) as b2_mae,
 {_share('C1_step_time', 'bucket_label', 'step')} as c1_gold_step, {_share('C1_step_time', 'pred_bucket', 'step')} as c1_pred_step, {_share('C2_step_mag', 'bucket_label', 'step')} as c2_gold_step, {_share('C2_step_mag', 'pred_bucket', 'step')} as c2_pred_step,
 round(avg(case when task_name = 'C2_step_mag' and bucket_label = 'step' then g end), 6) + 0.0 as c2_gold_mean, round(avg(case when task_name = 'C2_step_mag' and bucket_label = 'step' and g is not null then p end), 6) + 0.0 as c2_pred_mean, round(avg(case when task_name = 'C2_step_mag' and bucket_label = 'step' then abs(p - g) end), 6) as c2_mae from sl group by 1"""


@query(f"{SL} {TILE_SUMMARY}")
def tile_summary(s, d):
    t = slices.tile_summary(sliced(s, d))
    return t.select("tile", "n_examples", "n_pid", *[r6(c).alias(c) for c in t.columns[3:]])


@query(f"""{SL}, ts as ({TILE_SUMMARY}), m as (select median(b1_gold_seasonal) as mb, median(c1_gold_step) as mc from ts) select tile, case when a1_gold_stable >= a1_gold_subsiding and a1_gold_stable >= a1_gold_uplifting then 'stable' when a1_gold_subsiding >= a1_gold_uplifting then 'subsiding' else 'uplifting' end as trend_regime,
 case when b1_gold_seasonal >= mb then 'high' else 'low' end as season_regime, case when c1_gold_step >= mc then 'high' else 'low' end as step_regime from ts, m""")
def regime_split(s, d):
    t = slices.tile_summary(sliced(s, d))
    return slices.tile_regimes(t.select("tile", *[r6(c).alias(c) for c in t.columns[3:]]))


TWO = f"""{SC}, sys as (select 'model' as system, tile, pid, id, task_name, ok from scored union all select 'rules', tile, pid, id, task_name, (pid % 3 <> 0)::int from scored union all select 'none', tile, pid, id, task_name, (answer = 'none')::int from scored)"""


def systems(s, d):
    r = scored_rows(s, d, "all").select("tile", "pid", "id", "task_name", "answer", "ok")
    own = lambda name, ok: F.struct(F.lit(name).alias("system"), ok.cast("int").alias("ok"))
    three = F.array(own("model", F.col("ok")), own("rules", F.col("pid") % 3 != 0), own("none", F.col("answer") == "none"))
    return r.select("tile", "pid", "id", "task_name", F.inline(three))


PERF = """perf as (select system, tile, avg(ok) as micro, (select 1) as one from sys group by 1, 2), mac as (select system, tile, avg(a) as macro from (select system, tile, task_name, avg(ok) as a from sys group by 1, 2, 3) group by 1, 2)"""


@query(f"""{TWO}, {PERF}, t as (select system, tile, task_name, avg(ok) as a from sys group by 1, 2, 3) select a.tile, round(a.micro - b.micro, 6) + 0.0 as gain_micro, round(ma.macro - mb.macro, 6) + 0.0 as gain_macro, round(ta.a - tb.a, 6) + 0.0 as gain_a1
 from perf a join perf b on a.tile = b.tile and a.system = 'model' and b.system = 'rules' join mac ma on ma.tile = a.tile and ma.system = 'model' join mac mb on mb.tile = a.tile and mb.system = 'rules' join t ta on ta.tile = a.tile and ta.system = 'model' and ta.task_name = 'A1_trend_dir' join t tb on tb.tile = a.tile and tb.system = 'rules' and tb.task_name = 'A1_trend_dir'""")
def tile_gain(s, d):
    r = systems(s, d)
    g = slices.tile_gain(r.where("system = 'model'"), r.where("system = 'rules'"))
    return g.select("tile", r6("gain_micro").alias("gain_micro"), r6("gain_macro").alias("gain_macro"), r6("gain_A1_trend_dir").alias("gain_a1"))


@query(f"{TWO}, m as (select system, avg(a) as macro from (select system, task_name, avg(ok) as a from sys group by 1, 2) group by 1), t as (select system, avg(ok) as micro, any_value(macro) as macro from sys join m using (system) group by 1) select t.system, round(t.micro, 6) as micro, round(t.macro, 6) as macro, round(t.micro - r.micro, 6) + 0.0 as delta_micro, round(t.macro - r.macro, 6) + 0.0 as delta_macro from t, t r where r.system = 'rules'")
def system_delta(s, d):
    x = slices.system_deltas(systems(s, d), "rules")
    return x.select("system", *[r6(c).alias(c) for c in x.columns[1:]])


@query(f"{TWO}, t as (select task_name, avg(ok) filter (system = 'model') as m, avg(ok) filter (system = 'rules') as r, avg(ok) filter (system = 'none') as n from sys group by 1) select task_name, round(m, 6) as model, round(r, 6) as rules, round(n, 6) as none, round(m - r, 6) + 0.0 as delta_model, round(n - r, 6) + 0.0 as delta_none from t")
def task_system_pivot(s, d):
    x = slices.task_by_system(systems(s, d), ["model", "rules", "none"], "rules")
    return x.select("task_name", *[r6(c).alias(c) for c in x.columns[1:]])


@query(f"{TWO}, j as (select a.task_name, a.ok as x, b.ok as y from sys a join sys b on a.id = b.id and a.system = 'model' and b.system = 'rules') select task_name, sum(x * y) as both, sum(x * (1 - y)) as only_a, sum((1 - x) * y) as only_b, sum((1 - x) * (1 - y)) as neither, sum(x - y) as net_gain from j group by 1")
def paired_overlap(s, d):
    r = systems(s, d)
    return slices.paired_overlap(r.where("system = 'model'"), r.where("system = 'rules'"))


PREV = f"""{SL}, lab as (select * from (values ('A1_trend_dir', 'subsiding'), ('A1_trend_dir', 'stable'), ('A1_trend_dir', 'uplifting'), ('B1_seasonality_present', 'seasonal'), ('C1_step_time', 'step')) v(task_name, label)),
 prev as (select tile, task_name, label, count(*) as n, avg((bucket_label = label)::int) as gs, avg((pred_bucket = label)::int) as ps from sl join lab using (task_name) group by 1, 2, 3)"""


@query(f"{PREV} select tile, task_name, label, n, round(gs, 6) as gold_share, round(ps, 6) as pred_share, round(abs(ps - gs), 6) as abs_error from prev")
def prevalence_error(s, d):
    p = slices.prevalence(sliced(s, d))
    return p.select("tile", "task_name", "label", "n", r6("gold_share").alias("gold_share"), r6("pred_share").alias("pred_share"), r6("abs_error").alias("abs_error"))


@query(f"""{PREV}, pr as (select tile, task_name, label, n, round(gs, 9) as gs, round(ps, 9) as ps, abs(ps - gs) as e from prev), k as (select *, rank() over (partition by task_name, label order by gs) + (count(*) over (partition by task_name, label, gs) - 1) / 2.0 as rg, rank() over (partition by task_name, label order by ps) + (count(*) over (partition by task_name, label, ps) - 1) / 2.0 as rp from pr)
 select task_name, label, round(avg(e), 6) as mean_abs_error, round(sum(e * n) / sum(n), 6) as weighted_abs_error, case when min(gs) < max(gs) and min(ps) < max(ps) then round(corr(gs, ps), 6) + 0.0 end as pearson, case when min(gs) < max(gs) and min(ps) < max(ps) then round(corr(rg, rp), 6) + 0.0 end as spearman from k group by 1, 2""")
def prevalence_corr(s, d):
    p = slices.prevalence(sliced(s, d)).withColumns({"gold_share": F.round("gold_share", 9), "pred_share": F.round("pred_share", 9)})
    x = slices.prevalence_summary(p)
    return x.select("task_name", "label", *[r6(c).alias(c) for c in x.columns[2:]])


# ---- space

CLOUD = """cloud as (select (vec_id % 5)::varchar as tile, vec_id as id, embedding[1]::double as x, embedding[2]::double as y, label % 3 as g, case when vec_id % 7 = 0 then (label % 3 + 1) % 3 else label % 3 end as p from embeddings),
 nn as (select a.tile, a.id, b.id as other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) as d2, row_number() over (partition by a.tile, a.id order by (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) as rank, a.g, a.p, b.g as g2, case b.p when 0 then 'stable' when 1 then 'subsiding' else 'uplifting' end as p2, case a.p when 0 then 'stable' when 1 then 'subsiding' else 'uplifting' end as pn from cloud a join cloud b on a.tile = b.tile and a.id <> b.id),
 nb as (select * from nn where rank <= 8), md as (select tile, id, p2, row_number() over (partition by tile, id order by count(*) desc, p2) as k from nb group by 1, 2, 3),
 mg as (select tile, id, g2, row_number() over (partition by tile, id order by count(*) desc, g2) as k from nb group by 1, 2, 3),
 fl as (select nb.tile, nb.id, avg((nb.g2 = g)::int) as ga, avg((nb.p2 = pn)::int) as pa, any_value(pn) as pn, any_value(md.p2) as maj, any_value(nb.g = mg.g2 and nb.p <> mg.g2) as an, any_value(nb.g <> mg.g2 and nb.p = mg.g2) as os from nb join md on md.tile = nb.tile and md.id = nb.id and md.k = 1 join mg on mg.tile = nb.tile and mg.id = nb.id and mg.k = 1 group by 1, 2)"""


@query(f"with {CLOUD} select tile, id, other, rank, round(d2, 9) as d2 from nb")
def knn_neighbours(s, d):
    return spatial.knn(testbed.point_cloud(s, d), 8).select("tile", "id", "other", "rank", F.round("d2", 9).alias("d2"))


@query(f"with {CLOUD} select tile, id, round(ga, 6) as gold_agreement, round(pa, 6) as pred_agreement, round(pa - ga, 6) + 0.0 as gap, round(1 - pa, 6) as inconsistency, an::int as anomaly, os::int as oversmooth, (pn <> maj)::int as pred_majority_disagree from fl")
def spatial_flags(s, d):
    c = testbed.point_cloud(s, d)
    f = spatial.agreement(c, spatial.knn(c, 8))
    return f.select("tile", "id", r6("gold_agreement").alias("gold_agreement"), r6("pred_agreement").alias("pred_agreement"), r6("gap").alias("gap"), r6("inconsistency").alias("inconsistency"), "anomaly", "oversmooth", "pred_majority_disagree")


@query(f"with {CLOUD}, t as (select tile, count(*) as n, avg(ga) as ga, avg(pa) as pa, avg(an::int) as an, avg(os::int) as os, avg((pn <> maj)::int) as dg from fl group by 1) select count(*) as n_tiles, sum(n) as n_points, round(avg(ga), 6) as gold_mean, round(stddev_samp(ga), 6) as gold_std, round(avg(pa), 6) as pred_mean, round(stddev_samp(pa), 6) as pred_std, round(avg(an), 6) as anomaly_rate, round(avg(os), 6) as oversmooth_rate, round(avg(dg), 6) as disagree_rate from t")
def spatial_summary(s, d):
    c = testbed.point_cloud(s, d)
    x = spatial.spatial_summary(spatial.agreement(c, spatial.knn(c, 8))).drop("task_name")
    return x.select("n_tiles", "n_points", *[r6(n).alias(n) for n in x.columns[2:]])


@query(f"with {CLOUD}, a as (select tile, id, (id * 3) % 5 = 0 as x, g <> p as y from cloud) select tile, case when x and not y then 'fixed' when not x and y then 'introduced' when x and y then 'persistent' else 'correct' end as status, count(*) as n from a group by 1, 2")
def hotspot_status(s, d):
    c = testbed.point_cloud(s, d)
    before = c.withColumn("pred", F.when((F.col("id") * 3) % 5 == 0, "wrong").otherwise(F.col("gold")))
    return spatial.hotspots(before, c).select("tile", "status", "n")


@query(f"with {CLOUD} select tile, round(sqrt(median(d2)), 9) as threshold from nn where rank = 4 group by 1")
def kth_distance(s, d):
    return spatial.kth_distance(testbed.point_cloud(s, d), 4).select("tile", F.round("threshold", 9).alias("threshold"))


@query(f"""with recursive {CLOUD}, th as (select tile, median(d2) as t2 from nn where rank = 4 group by 1), e as (select nn.tile, id as a, other as b from nn join th using (tile) where d2 <= t2 * 0.25), r(tile, a, b) as (select tile, id, id from cloud union select r.tile, r.a, e.b from r join e on e.tile = r.tile and e.a = r.b),
 c as (select tile, a, min(b) as comp from r group by 1, 2), z as (select tile, comp, count(*) as size from c group by 1, 2) select tile, sum(size) as n_points, count(*) as n_components, count(*) filter (size = 1) as n_isolated, max(size) as max_size, round(avg(size), 6) as mean_size from z group by 1""")
def error_components(s, d):
    c = testbed.point_cloud(s, d)
    t = spatial.kth_distance(c, 4).withColumn("threshold", F.col("threshold") * 0.5)
    x = spatial.component_profile(spatial.close_components(c, t))
    return x.select("tile", "n_points", "n_components", "n_isolated", "max_size", r6("mean_size").alias("mean_size"))


@query()
def error_cluster_profile(s, d):
    x = spatial.error_components(testbed.error_cloud(s, d))[0]
    return x.select("task_name", "tile", "cluster_type", F.round("threshold", 9).alias("threshold"), "n_points", "n_components", "n_isolated", "max_size", r6("isolated_share").alias("isolated_share"), r6("mean_size").alias("mean_size"))


@query()
def error_cluster_ranks(s, d):
    return spatial.error_components(testbed.error_cloud(s, d))[1]


# ---- robustness and bootstrap

ROB = f"""{TWO}, {CONDITIONS},
 cr as (select system, family, severity, k, task_name, case when family = 'clean' then ok else ok * ((pid + k) % greatest(2, 8 - (severity * 10)::int % 7) <> 0)::int end as ok from sys, con where system <> 'none'), cm as (select system, family, severity, k, avg(ok) as micro from cr group by 1, 2, 3, 4),
 rb as (select system, family, severity, count(*) as n, avg(micro) as mm, stddev_samp(micro) as sd from cm group by 1, 2, 3), cl as (select system, mm as c from rb where family = 'clean')"""


def condition_scores(s, d):
    con = sample.condition_grid(s).withColumnRenamed("seed_idx", "k")
    r = systems(s, d).where("system <> 'none'").join(F.broadcast(con))  # 28 fixed conditions
    spoilt = ((F.col("pid") + F.col("k")) % F.greatest(F.lit(2), 8 - F.round(F.col("severity") * 10, 0).cast("int") % 7) != 0).cast("int")
    r = r.withColumn("ok", F.when(F.col("family") == "clean", F.col("ok")).otherwise(F.col("ok") * spoilt))
    macro = r.groupBy("system", "family", "severity", "k", "task_name").agg(F.avg("ok").alias("a")).groupBy("system", "family", "severity", "k").agg(F.avg("a").alias("macro"))
    return r.groupBy("system", "family", "severity", "k").agg(F.avg("ok").alias("micro")).join(macro, ["system", "family", "severity", "k"])


@query(f"{ROB} select system, family, severity, n, round(mm, 6) as micro_mean, round(sd, 6) as micro_std, round(mm - c, 6) + 0.0 as micro_delta from rb join cl using (system)")
def robust_agg(s, d):
    r = slices.robustness(condition_scores(s, d))
    return r.select("system", "family", "severity", "n", r6("micro_mean").alias("micro_mean"), r6("micro_std").alias("micro_std"), r6("micro_delta").alias("micro_delta"))


@query(f"{ROB}, x as (select system, family, severity, mm from rb where family <> 'clean' union all select f.system, f.family, 0.0, c from (select distinct system, family from rb where family <> 'clean') f join cl using (system)) select system, family, round(regr_slope(mm, severity), 6) + 0.0 as slope from x group by 1, 2")
def robust_slope(s, d):
    return slices.robustness_slopes(slices.robustness(condition_scores(s, d))).select("system", "family", r6("slope").alias("slope"))


@query(f"{ROB} select system, family, severity, round(mm - c, 6) + 0.0 as micro_delta from rb join cl using (system) where family <> 'clean' qualify severity = max(severity) over (partition by system, family)")
def extreme_drop(s, d):
    return slices.extreme_rows(slices.robustness(condition_scores(s, d))).select("system", "family", "severity", r6("micro_delta").alias("micro_delta"))


def _binomial_sql(draws: str, name: str) -> str:
    """CTEs that end in name: rows of draws (size, p, u, others) with k, the smallest count whose binomial distribution function is above u."""
    own = "partition by size, p"
    return f"""{name}1 as (select distinct size, p, case when p >= 1 then size else greatest(0, floor(size * p - 10 * sqrt(size * p * (1 - p)) - 10)::bigint) end as lo,
   case when p <= 0 then 0 else least(size, ceil(size * p + 10 * sqrt(size * p * (1 - p)) + 10)::bigint) end as hi from {draws}),
 {name}2 as (select size, p, lo, unnest(range(lo, hi + 1)) as k from {name}1),
 {name}3 as (select *, sum(case when k = lo then 0.0::double else ln((size - k + 1) / k * (p / (1 - p))) end) over ({own} order by k) as l from {name}2),
 {name}4 as (select *, exp(l - max(l) over ({own})) as w from {name}3),
 {name}5 as (select *, sum(w) over ({own} order by k) / sum(w) over ({own}) as c from {name}4),
 {name}6 as (select *, lag(c, 1, 0.0::double) over ({own} order by k) as below from {name}5),
 {name} as materialized (select d.* exclude (size, p, u), t.k from {draws} d join {name}6 t on t.size = d.size and t.p = d.p and d.u >= t.below and d.u < t.c)"""


def _bootstrap_sql(n_boot: int) -> str:
    low, high = int(0.025 * (n_boot - 1)), int(0.975 * (n_boot - 1))
    return f"""{TWO}, pa as (select a.task_name, a.ok - b.ok as x from sys a join sys b on a.id = b.id and a.system = 'model' and b.system = 'rules'),
 ct as materialized (select task_name, count(*) as n, count(*) filter (x = -1) as lost, count(*) filter (x = 1) as won from pa group by 1),
 d1 as materialized (select c.*, q.r, n as size, lost / n as p, {h32("'lost'", 'q.r', 'task_name')} / 4294967296.0::double as u from ct c, range({n_boot}) q(r)), {_binomial_sql('d1', 'minus_')},
 d2 as materialized (select * exclude (k), k as minus, n - k as size, coalesce(won / nullif(n - lost, 0), 0.0::double) as p, {h32("'won'", 'r', 'task_name')} / 4294967296.0::double as u from minus_), {_binomial_sql('d2', 'plus_')},
 ea as (select r, sum(k - minus) / sum(n) as micro, avg((k - minus) / n) as macro from plus_ group by 1), lo as (select r, 'micro' as metric, micro as v from ea union all select r, 'macro', macro from ea),
 pl as (select *, row_number() over (partition by metric order by v, r) - 1 as i from lo)
 select metric, round(avg(v), 6) + 0.0 as mean, round(max(case when i = {low} then v end), 6) + 0.0 as low, round(max(case when i = {high} then v end), 6) + 0.0 as high from pl group by 1"""


@query(_bootstrap_sql(60))
def bootstrap_ci(s, d):
    return _bootstrap_ci(s, d, 60)  # the same with few replicates


@query(_bootstrap_sql(2000))
def bootstrap_ci_full(s, d):
    return _bootstrap_ci(s, d, 2000)


def _bootstrap_ci(s, d, n_boot):
    r = systems(s, d)
    a, b = (r.where(F.col("system") == x) for x in ("model", "rules"))
    paired = a.select("task_name", "id", F.col("ok").alias("a")).join(b.select("id", F.col("ok").alias("b")), "id")
    x = slices.bootstrap(paired, n_boot)
    return x.select("metric", r6("mean").alias("mean"), r6("low").alias("low"), r6("high").alias("high"))


@query()
def regime_bootstrap(s, d):
    r = systems(s, d)
    g = slices.tile_gain(r.where("system = 'model'"), r.where("system = 'rules'"))
    t = slices.tile_summary(sliced(s, d))
    x = slices.bootstrap_mean(g.join(slices.tile_regimes(t), "tile", "left").select("tile", "season_regime", "gain_micro"), "season_regime", "gain_micro", 5000)
    return x.select("season_regime", "n", r6("mean").alias("mean"), r6("low").alias("low"), r6("high").alias("high"))


@query("with v as (select c_custkey % 5 as m, case c_custkey % 4 when 0 then 'hybrid' when 1 then 'rules' when 2 then 'base' else 'other' end as variant from customer), d as (select distinct 'm' || m as model, variant from v where not (m = 2 and variant = 'hybrid')) select model, arg_min(variant, case variant when 'hybrid' then 1 when 'rules' then 2 else 3 end) as variant from d where variant <> 'other' group by 1")
def first_variant(s, d):
    return slices.first_variant(_variants(s, d), ["hybrid", "rules", "base"])


@query("with v as (select c_custkey % 5 as m, case c_custkey % 4 when 0 then 'hybrid' when 1 then 'rules' when 2 then 'base' else 'other' end as variant from customer), d as (select distinct 'm' || m as model, variant from v where not (m = 2 and variant = 'hybrid')) select model from d group by 1 having bool_or(variant = 'base') and bool_or(variant = 'hybrid')")
def ablation_models(s, d):
    return slices.with_ablations(_variants(s, d), ["base"], ["hybrid"])


def _variants(s, d):
    k = F.col("c_custkey")
    v = testbed.table(s, d, "customer").select(F.concat(F.lit("m"), (k % 5).cast("string")).alias("model"), F.when(k % 4 == 0, "hybrid").when(k % 4 == 1, "rules").when(k % 4 == 2, "base").otherwise("other").alias("variant"))
    return v.distinct().where("not (model = 'm2' and variant = 'hybrid')")


# ---- items, models, metadata, prompt lists


def _thirds(s, d):
    r = systems(s, d).select("system", "pid", "task_name", "id", "ok")
    return r.where("system = 'model'"), r.where("system = 'rules' and pid % 4 <> 1"), r.where("system = 'none' and pid % 6 <> 0")


@query(f"""{TWO}, j as (select a.task_name, a.ok as x, b.ok as y, c.ok as z from sys a join sys b on a.id = b.id and a.task_name = b.task_name and b.system = 'rules' and b.pid % 4 <> 1 join sys c on a.id = c.id and a.task_name = c.task_name and c.system = 'none' and c.pid % 6 <> 0 where a.system = 'model')
 select task_name, count(*) as n, round(avg(x), 6) as acc_0, round(avg(y), 6) as acc_1, round(avg(z), 6) as acc_2 from j group by 1""")
def common_items(s, d):
    c = slices.common_ids(*_thirds(s, d))
    return c.groupBy("task_name").agg(F.count("*").alias("n"), *[r6(F.avg(f"ok_{k}")).alias(f"acc_{k}") for k in range(3)])


@query(f"""{TWO}, m as (select 'm' || (pid % 4) as model, system, avg(ok) as a from sys group by 1, 2) select system, count(distinct model) as n_models, round(avg(case when model <> 'm2' or system <> 'none' then a end), 6) as micro from m group by 1""")
def cross_model_average(s, d):
    m = systems(s, d).groupBy(F.concat(F.lit("m"), (F.col("pid") % 4).cast("string")).alias("model"), "system").agg(F.avg("ok").alias("micro"))
    m = m.withColumn("micro", F.when(~((F.col("model") == "m2") & (F.col("system") == "none")), F.col("micro")))
    x = slices.average_models(m, ["system"], ["micro"])
    return x.select("system", "n_models", r6("micro").alias("micro"))


@query(f"""with {GAP}, x as (select tile, pid, count(y) as observed_points, count(*) as total_points from gap group by 1, 2), g as (select pid, date_diff('day', lag(d) over (partition by pid order by d), d) as gap from gap), c as (select pid, median(gap) as cadence from g where gap is not null group by 1)
 select tile || '_' || pid as id, tile as tile_id, pid::varchar as pid, 'A1_trend_dir' as task_name, 'b' || (pid % 3) as bucket_label, 'b' || (pid % 3) as gold_answer, pid * 10 as easting, pid * 20 as northing, round(12 + (pid % 10) * 0.8::double, 6) as rmse_mm, observed_points, total_points, round(1 - observed_points / total_points, 6) as missing_rate, cadence::double as median_cadence_days from x left join c using (pid)""")
def dataset_metadata(s, d):
    p = testbed.gappy_points(s, d)
    one = p.groupBy("tile", "pid").agg(F.array_sort(F.collect_list(F.struct("d", "y"))).alias("p"))
    k = F.col("pid")
    bucket = F.concat(F.lit("b"), (k % 3).cast("string"))
    series = F.struct(F.transform("p", lambda x: coerce.yyyymmdd(x["d"])).alias("t_iso"), F.col("p.y").alias("d_mm"), F.transform("p", lambda x: x["y"].isNotNull().cast("int")).alias("mask"))
    static = F.struct((12 + (k % 10) * 0.8).alias("rmse_mm"))
    ex = one.select(F.concat_ws("_", "tile", k.cast("string")).alias("id"), F.col("tile").alias("tile_id"), k.cast("string").alias("pid"), F.lit("A1_trend_dir").alias("task_name"), bucket.alias("bucket_label"), bucket.alias("answer"), F.struct((k * 10).alias("easting"), (k * 20).alias("northing")).alias("coord"), F.struct(series.alias("series"), static.alias("static")).alias("context"))
    m = slices.dataset_metadata(ex)
    return m.withColumns({"rmse_mm": r6("rmse_mm"), "missing_rate": r6("missing_rate")})


@query(f"with {GOLD} select id, task_name, row_number() over (order by {h32('3', 'id')}, id) - 1 as place from gold qualify place < 50")
def shuffled_sample(s, d):
    return sample.shuffled_head(gold_rows(s, d).select("id", "task_name"), 50, seed=3)


@query(f"with {GOLD} select id, row_number() over (order by {h32('9', 'id')}, id) - 1 as place, task_name, answer from gold where pid % 7 = 2")
def rows_by_id_list(s, d):
    g = gold_rows(s, d).select("id", "pid", "task_name", "answer")
    ids = sample.shuffled(g.where("pid % 7 = 2").select("id"), seed=9)
    return sample.by_id_list(g, ids).drop("pid")


# ---- text


@query(f"with {GAP} select pid, count(*) as total, count(y) as observed, round(min(y), 6) as y_min, round(max(y), 6) as y_max, round(avg(y), 6) as y_mean, round(stddev_pop(y), 6) as y_std from gap group by 1")
def summary_block(s, d):
    x = text.summary_block(testbed.gappy_points(s, d))
    return x.select("pid", "total", "observed", *[r6(c).alias(c) for c in ("y_min", "y_max", "y_mean", "y_std")])


@query(f"with {GAP}, o as (select pid, epoch, row_number() over (partition by pid order by epoch) - 1 as i, count(*) over (partition by pid) as n from gap where y is not null) select distinct pid, epoch from o, range(12) k(k) where i = round_even(k * (n - 1) / 11.0::double, 0)")
def anchors_linspace(s, d):
    return text.anchors(testbed.gappy_points(s, d), 12, "linspace").select("pid", "epoch")


@query(f"""with {GAP}, o as (select pid, epoch, y, row_number() over (partition by pid order by epoch) - 1 as i, count(*) over (partition by pid) as n from gap where y is not null), j as (select *, abs(y - lag(y) over (partition by pid order by epoch)) as j from o), a as (select pid, arg_max(i, j * 1e9 - i) as peak from j where j is not null group by 1)
 select o.pid, epoch from o join a using (pid) where i >= greatest(0, least(peak - 8, n - 16)) and i < greatest(0, least(peak - 8, n - 16)) + 16""")
def anchors_step_window(s, d):
    return text.anchors(testbed.gappy_points(s, d), 16, "step_window").select("pid", "epoch")


@query(f"""with {GAP}, o as (select pid, epoch, row_number() over (partition by pid, month(d) order by epoch) - 1 as k, count(*) over (partition by pid, month(d)) as c from gap where y is not null),
 q as (select pid, epoch, row_number() over (partition by pid order by epoch) - 1 as i, count(*) over (partition by pid) as n from o where k = c // 2) select distinct pid, epoch from q, range(8) t(j) where n <= 8 or i = round_even(j * (n - 1) / 7.0::double, 0)""")
def anchors_month(s, d):
    return text.anchors(testbed.gappy_points(s, d), 8, "month").select("pid", "epoch")


@query()
def render_prompts(s, d):
    p = testbed.gappy_points(s, d)
    out = None
    for t in label.TASKS:
        own = text.prompts(p, testbed.statics(p), t)
        out = own if out is None else out.unionByName(own)
    return out


@query(f"""with {GAP}, {CAND} select pid, rank, strftime(left_date, '%Y%m%d') as left_day, strftime(d, '%Y%m%d') as right_day, round(delta, 3) + 0.0 as delta, 12 + (pid % 10) * 0.8::double as rmse from cand where rank <= 5""")
def c2_parse_text(s, d):
    p = testbed.gappy_points(s, d)
    c = text.candidates_of(text.prompts(p, testbed.statics(p), "C2_step_mag"))
    return c.select("pid", "rank", coerce.yyyymmdd(F.col("left_date")).alias("left_day"), coerce.yyyymmdd(F.col("right_date")).alias("right_day"), (F.round("delta", 3) + F.lit(0.0)).alias("delta"), "rmse")


@query()
def c2_from_text(s, d):
    p = testbed.gappy_points(s, d)
    c = text.candidates_of(text.prompts(p, testbed.statics(p), "C2_step_mag"))
    return predict.c2_select(c, F.col("rmse"), predict.C2Rules(snr=0.5, persist=0.5)).select("pid", "rank", r6("answer").alias("answer"))


REPLY = """case o_orderkey % 6 when 0 then '{{"answer": "stable"}}' when 1 then 'I think {{"answer": 1.5}} is right' when 2 then '{{"result": 1}}' when 3 then '' when 4 then 'none' else '{{"answer": }}' end""".replace("{{", "{").replace("}}", "}")


@query(f"""select o_orderkey, case o_orderkey % 6 when 0 then 'stable' when 1 then '1.5' end as answer, case o_orderkey % 6 when 2 then 'json_missing_answer_key' when 3 then 'empty_response' when 4 then 'no_json_object_found' when 5 then 'json_parse_error' end as parse_error,
 case when o_orderkey % 6 = 0 then 'not_number' when o_orderkey % 6 > 1 then 'answer_null' end as invalid from orders where {REPLY} is not null""")
def parse_answer(s, d):
    k = F.col("o_orderkey") % 6
    reply = F.when(k == 0, '{"answer": "stable"}').when(k == 1, 'I think {"answer": 1.5} is right').when(k == 2, '{"result": 1}').when(k == 3, "").when(k == 4, "none").otherwise('{"answer": }')
    o = testbed.table(s, d, "orders").select("o_orderkey", text.parse_answer(reply).alias("a"))
    return o.select("o_orderkey", "a.answer", "a.parse_error", text.validate_answer(F.lit("A2_trend_v"), F.col("a.answer")).alias("invalid"))


# ---- sets, resuming, streams, chain


@query(f"with {MAIN} select task_name, count(*) as n_left from gold where id not in (select id from pred) group by 1")
def resume_antijoin(s, d):
    g = gold_rows(s, d)
    return g.join(predictions(g).select("id"), "id", "left_anti").groupBy("task_name").agg(F.count("*").alias("n_left"))


@query("select (select count(*) from (select c_custkey from customer where c_custkey % 2 = 0 intersect select c_custkey from customer where c_custkey % 3 = 0)) as both, (select count(*) from (select c_custkey from customer where c_custkey % 2 = 0 union select c_custkey from customer where c_custkey % 3 = 0)) as either, (select count(*) from (select c_custkey from customer where c_custkey % 2 = 0 except select c_custkey from customer where c_custkey % 3 = 0)) as only_a, (select count(*) from (select c_custkey from customer where c_custkey % 2 = 0 union all select c_custkey from customer where c_custkey % 3 = 0)) as bag")
def id_set_ops(s, d):
    c = testbed.table(s, d, "customer").select("c_custkey")
    a, b = c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(a.intersect(b), "both").crossJoin(n(a.union(b).distinct(), "either")).crossJoin(n(a.exceptAll(b), "only_a")).crossJoin(n(a.union(b), "bag"))


@query("select user_id, date_trunc('day', ts)::varchar as day, count(*) as n, round(avg(value), 6) as mean from events group by 1, 2")
def daily_means(s, d):
    m = stream.windowed_means(testbed.table(s, d, "events"))
    return m.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("day"), "n", r6("mean").alias("mean"))


@query("with l as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as new from events), k as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from l) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from k group by user_id, k")
def user_sessions(s, d):
    return stream.sessions(testbed.table(s, d, "events")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query()
def hybrid_chain(s, d):
    p = stored(points(s, d), "points")
    g = gold_of(p)
    model = predictions(g).withColumn("_seq", F.lit(0))
    own = hybrid.hybrid(model.select("id", "task_name", "answer_parsed", "parse_error", "_seq"), p, testbed.statics(p))
    x = hybrid.compare(g, {"model": model, "hybrid": own}, "model")
    return x.select("system", *[r6(c).alias(c) for c in x.columns[1:]])
