"""All registered queries by name, with the SQL that gives the same results."""

from __future__ import annotations

from . import alignment, analysis, cells, gates, ingest, labelling, levels, mixes, noise, pool, publishing, recordings, reports, tiers, words

GROUPS = (alignment, pool, tiers, reports, ingest, noise, gates, labelling, words, cells, mixes, levels, recordings, publishing, analysis)


def flagship(spark, sf_dir):
    return alignment.leaderboard(spark, sf_dir)


def queries():
    return {name: fn for group in GROUPS for name, (fn, _) in group.QUERIES.items()}


def oracle_sql():
    return {name: sql for group in GROUPS for name, (_, sql) in group.QUERIES.items() if sql}
