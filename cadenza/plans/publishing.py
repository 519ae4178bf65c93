"""Queries over what has been published and cached: the state that readers see."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources import ingest as I
from ..sources import results as R
from ..sources.storage import scratch_path
from . import alignment as A
from . import fixtures as fx
from .fixture_sql import ERRORS, GOLD, with_


def republished(spark, sf_dir):
    """Each system's errors by edge, published by system together with their total; then onsets of two systems are published anew, and so is the total, while a third writer fails."""
    e = fx.errors(spark, sf_dir)
    path = scratch_path(spark, "results")
    by_edge = lambda x: x.groupBy("system", "edge").agg(F.count("*").alias("n"), M.mean_ms(F.col("abs_us")).alias("mae_ms"))
    total = lambda x: x.agg(F.count("*").alias("n_all"))
    R.publish(spark, path, {"edges": R.Part(by_edge(e), ("system",)), "total": R.Part(total(e), form="csv", options={"header": "true"})})
    onsets = e.where("edge = 'onset' and system in ('click', 'view')")
    R.publish(spark, path, {"edges": R.Part(by_edge(onsets), ("system",)), "total": R.Part(total(onsets), form="csv", options={"header": "true"})})
    broken = total(e).withColumn("n_all", F.raise_error(F.lit("a writer dies")).cast("bigint"))
    try:
        R.publish(spark, path, {"edges": R.Part(by_edge(e), ("system",)), "total": R.Part(broken, form="csv", options={"header": "true"})})
    except Exception as error:  # noqa: BLE001  what Spark raises differs between writers
        if "a writer dies" not in str(error):
            raise
    now = R.current(spark, path)
    return now.table("edges").crossJoin(now.table("total")).select("system", "edge", "n", "mae_ms", "n_all", F.lit(now.number).alias("state"))


REPUBLISHED_SQL = with_(
    ERRORS,
    select=f"""select system, edge, count(*) as n, {A.mean_ms('abs_us')} as mae_ms, (select count(*) from errors where edge = 'onset' and system in ('click', 'view')) as n_all, 2::int as state
from errors where edge = 'onset' or system not in ('click', 'view') group by system, edge""",
)


def reused(spark, sf_dir):
    """A corpus's ingest found again by its key: how often it was made for two calls alike, one of another subset, and a limited one, and how many rows each gave."""
    folder, made = scratch_path(spark, "cache"), []
    state = R.signature(I.listing(spark, f"{sf_dir}/conversations.parquet").withColumn("modificationTime", F.lit(0)))

    def ingest(subset):
        made.append(subset)
        return fx.gold(spark, sf_dir).where(F.col("corpus") == subset)

    def call(subset, limited=False):
        rows = R.cached(spark, folder, {"subset": subset, "root": sf_dir, "sources": state}, lambda: I.first_items(ingest(subset), 3) if limited else ingest(subset), limited)
        return rows.groupBy("corpus").agg(F.count("*").alias("n"), F.countDistinct("utt_id").alias("n_utts")).withColumn("limited", F.lit(limited))

    out = call("corpus_a").unionByName(call("corpus_a")).unionByName(call("corpus_b")).unionByName(call("corpus_a", True))
    return out.withColumn("n_made", F.lit(len(made)))


REUSED_SQL = with_(
    GOLD, "first3 as (select distinct utt_id from gold where corpus = 'corpus_a' order by utt_id limit 3)",
    select="""select corpus, count(*) as n, count(distinct utt_id) as n_utts, false as limited, 3::int as n_made from gold, range(2) r(k) where corpus = 'corpus_a' or k = 0 group by corpus, k
union all select 'corpus_a', count(*), count(distinct utt_id), true, 3::int from gold where corpus = 'corpus_a' and utt_id in (select utt_id from first3)""",
)

QUERIES = {"published_state": (republished, REPUBLISHED_SQL), "cached_ingest": (reused, REUSED_SQL)}
