"""Queries over a pool of boundary errors: summaries, tails, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from . import fixtures as fx
from .alignment import EDGE_MEANS, div, mean_ms, pool_sql
from .fixture_sql import ERRORS, with_

S = ["system"]


def pool_summary(spark, sf_dir):
    return M.summary(fx.errors(spark, sf_dir), S)


SUMMARY_SQL = with_(ERRORS, select=f"select system, count(*) as n_boundaries, {pool_sql()}, {EDGE_MEANS} from errors group by system")


def edge_views(spark, sf_dir):
    """The same summary by edge."""
    e = fx.errors(spark, sf_dir)
    return e.groupBy("system", "edge").agg(F.count("*").alias("n"), *M.pool_metrics((10, 25, 50)).columns())


EDGE_SQL = with_(ERRORS, select=f"select system, edge, count(*) as n, {pool_sql((10, 25, 50))} from errors group by all")


def tail(spark, sf_dir):
    return M.tail(fx.errors(spark, sf_dir), S)


TAIL_COLUMNS = ", ".join(
    [
        "count(*) as n", f"{mean_ms('abs_us')} as mae", "round(quantile_cont(abs_us, 0.5) / 1000, 9) as median",
        *[f"round(quantile_cont(abs_us, {q / 100}) / 1000, 9) as p{q}" for q in (75, 90, 95, 99)], "round(max(abs_us) / 1000, 9) as max",
        *[f"{div(f'sum((abs_us <= {t * 1000})::bigint)', 'count(*)', '100.0::double')} as ta{t}" for t in (10, 25, 50)],
        *[f"{div(f'sum((abs_us > {t * 1000})::bigint)', 'count(*)', '100.0::double')} as pct_gt{t}" for t in (50, 100, 200)],
    ]
)
TAIL_SQL = with_(ERRORS, select=f"select system, {TAIL_COLUMNS} from errors group by system")


def decomposition(spark, sf_dir):
    return M.decomposition(fx.errors(spark, sf_dir), S)


DECOMPOSITION_SQL = with_(
    ERRORS,
    "b(bucket, lo, hi) as (values ('le10', -1, 10000), ('10_25', 10000, 25000), ('25_50', 25000, 50000), ('50_100', 50000, 100000), ('gt100', 100000, 9000000000000))",
    "n as (select system, count(*) as n from errors group by system)",
    select="""select n.system, bucket, round(100.0::double * count(e.abs_us) / any_value(n), 9) as pct, round(coalesce(sum(e.abs_us), 0)::double / (any_value(n) * 1000), 9) as contrib_ms
from n cross join b left join errors e on e.system = n.system and e.abs_us > lo and e.abs_us <= hi group by n.system, bucket""",
)


def edge_split(spark, sf_dir):
    return M.edge_split(fx.errors(spark, sf_dir), S)


SPLIT_SQL = with_(
    ERRORS,
    select=f"""select system, count(*) filter (not silence_adjacent) as n_interior, count(*) filter (silence_adjacent) as n_edge, {mean_ms('case when not silence_adjacent then abs_us end')} as interior_mae,
{mean_ms('case when silence_adjacent then abs_us end')} as edge_mae, {div('sum(silence_adjacent::bigint)', 'count(*)', '100.0::double')} as pct_edge from errors group by system""",
)


def calibration(spark, sf_dir):
    """Spearman, AUROC, calibration error and how many confidences there are."""
    e = fx.errors(spark, sf_dir)
    return M.spearman(e, S).join(M.auroc(e, S), S).join(M.ece(e, S), S)


CALIBRATION_SQL = with_(
    ERRORS,
    "rk as (select *, (abs_us <= 25000)::bigint as good from errors)",
    "cc as (select system, conf, count(*) as c, sum(good) as p from rk group by all)",
    "cr as (select *, coalesce(sum(c) over (partition by system order by conf rows between unbounded preceding and 1 preceding), 0) + (c + 1) / 2.0::double as rank from cc)",
    "ac as (select system, abs_us, count(*) as c from rk group by all)",
    "ar as (select *, coalesce(sum(c) over (partition by system order by abs_us rows between unbounded preceding and 1 preceding), 0) + (c + 1) / 2.0::double as rank from ac)",
    "sp as (select e.system, corr(cr.rank, -ar.rank) as s from rk e join cr on cr.system = e.system and cr.conf = e.conf join ar on ar.system = e.system and ar.abs_us = e.abs_us group by e.system)",
    "au as (select system, sum(p * rank) as w, sum(p)::double as np, sum(c - p)::double as nn from cr group by system)",
    "bn as (select system, least(9, floor(round(conf * 1000) / 100)) as bin, count(*) as c, sum(good) as g, sum(round(conf * 1e6)::bigint) as m from rk group by all)",
    "ec as (select system, sum(c)::bigint as n_conf, round(sum(abs(g * 1000000 - m))::double / 1e6::double / sum(c), 9) as ece from bn group by system)",
    select="select system, round(s, 6) as spearman, round((w - np * (np + 1) / 2) / (np * nn), 9) as auroc, n_conf, ece from sp join au using (system) join ec using (system)",
)


def pooled_union(spark, sf_dir):
    """Two report levels in one long table: per system, and per edge under the name of the edge."""
    e = fx.errors(spark, sf_dir)
    a = e.groupBy(F.lit("system").alias("level"), F.col("system").alias("name")).agg(F.count("*").alias("n"), M.mean_ms(F.col("abs_us")).alias("mae"))
    b = e.groupBy(F.lit("edge").alias("level"), F.col("edge").alias("name")).agg(F.count("*").alias("n"), M.mean_ms(F.col("abs_us")).alias("mae"))
    return a.unionByName(b)


UNION_SQL = with_(ERRORS, select=f"select 'system' as level, system as name, count(*) as n, {mean_ms('abs_us')} as mae from errors group by system union all select 'edge', edge, count(*), {mean_ms('abs_us')} from errors group by edge")


def best_per_metric(spark, sf_dir):
    """The best system by each metric, ties to the first name."""
    t = M.tail(fx.errors(spark, sf_dir), S)
    long = t.selectExpr("system", "stack(4, 'mae', mae, 1, 'median', median, 1, 'p99', p99, 1, 'ta50', ta50, -1) as (metric, value, sign)")
    return long.groupBy("metric").agg(F.min_by(F.struct("system", "value"), F.struct(F.col("value") * F.col("sign"), F.col("system"))).alias("b")).select("metric", F.col("b.system").alias("system"), F.col("b.value").alias("value"))


BEST_SQL = with_(
    ERRORS, f"t as (select system, {TAIL_COLUMNS} from errors group by system)",
    "l as (select system, 'mae' as metric, mae as value, 1 as sign from t union all select system, 'median', median, 1 from t union all select system, 'p99', p99, 1 from t union all select system, 'ta50', ta50, -1 from t)",
    select="select metric, system, value from (select *, row_number() over (partition by metric order by value * sign, system) as k from l) x where k = 1",
)

QUERIES = {
    "pool_summary": (pool_summary, SUMMARY_SQL), "pool_by_edge": (edge_views, EDGE_SQL), "tail_percentiles": (tail, TAIL_SQL), "mae_decomposition": (decomposition, DECOMPOSITION_SQL),
    "interior_edge_split": (edge_split, SPLIT_SQL), "calibration": (calibration, CALIBRATION_SQL), "pooled_levels": (pooled_union, UNION_SQL), "best_per_metric": (best_per_metric, BEST_SQL),
}
