"""Utterances made inside their turns' rows, and pairs counted in the Arrow job that makes them."""

import pytest
from pyspark.sql import functions as F

from cadenza.operators import metrics as M
from cadenza.operators import scoring as S
from cadenza.operators import tiers as T
from cadenza.operators.align import align_labels
from cadenza.plans import alignment as A
from cadenza.plans import fixtures as fx
from cadenza.plans import gates, reports, words
from cadenza.sources.storage import stage

SMALL = "/root/testdata/sf0.001"
ODD = ["uh", "Uh", " uh ", "", " ", "sil", "SP ", "<SIL>", "İx", "ΑΣ", "ǅa", "Ka", "Été", "m", "Xyz", "9", "\tsil"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[2] or df._jdf.queryExecution().executedPlan().toString()


def same(x, y):
    return sorted(map(str, x.collect())) == sorted(map(str, y.select(*x.columns).collect()))


def test_pairs_shuffle_texts_and_sort_no_words(spark):
    made = plan(fx.pairs(spark, SMALL))
    assert made.count("Exchange") == 1 and "Window" not in made and "Generate" not in made and "Sort [utt_id" not in made


def test_repeated_and_broken_turns_are_packed_as_the_long_table_has_them(spark, tmp_path):
    many = " ".join(f"w{i % 9}" for i in range(95))
    rows = [(1, 0, "user", many), (1, 0, "user", "b\n a   c"), (1, 0, "user", "a"), (2, 0, "assistant", ""), (2, 1, "user", None), (None, 1, "user", "x"), (3, None, "user", "x"), (-41, 7, None, " İ z ")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    made = {r.utt_id: (r.speaker_id, r.corpus, r.gold) for r in fx.pairs(spark, str(tmp_path)).collect()}
    long = S.pack(fx.gold(spark, str(tmp_path)).where("utt_id is not null"), ["utt_id"], also=("speaker_id", "corpus")).collect()
    assert {k: made[k] for k in made} == {r.utt_id: (r.speaker_id, r.corpus, r.tier) for r in long if r.utt_id in made}
    assert {"c1_0_0", "c1_0_1", "c1_0_2", "c-41_7_0"} <= {*made} and {r.utt_id for r in long} - {*made} <= {"c2_0_0"}  # one word may be lost to all systems
    assert [x.label for x in made["c1_0_0"][2]][:4] == ["a", "b", "w0", "a"]


def test_classes_and_folding_in_arrow_are_those_of_columns(spark):
    labels = spark.createDataFrame([(x,) for x in [*ODD, None]], "label string").select("label", A.classify(F.col("label")).alias("cls")).collect()
    assert {r.label: r.cls for r in labels} == {x: A.class_of(x) for x in [*ODD, None]}
    tier = [(i, x, i, i + 1) for i, x in enumerate([*ODD, None])]
    rows = [("u", "s", "c", "sys_a", "clean", tier, [(*x, 0.5) for x in tier]), ("v", "s", "c", "sys_a", "clean", tier[:1], [(0, "sil", 0, 1, 0.5)]), ("w", "s", "c", "sys_a", "clean", tier[8:9], [])]
    pairs = spark.createDataFrame(rows, fx.PAIRS)
    assert same(pairs.mapInArrow(A.word_batches, fx.PAIRS), A.words_only(A.spoken(pairs)))


@pytest.mark.parametrize("by_class", [False, True])
def test_arrow_errors_are_boundary_errors(spark, by_class):
    one = [("v", "s", "c", "sys_a", "clean", [(0, None, 0, 5), (1, "a", 5, 9)], [(0, "a", 4, 9, 0.5), (1, None, 9, 9, None)]), ("w", "s", "c", "sys_b", "noise", [], [])]
    pairs = stage(fx.pairs(spark, SMALL).where("substr(md5(utt_id), 1, 1) < '4'").unionByName(spark.createDataFrame(one, fx.PAIRS)), "pairs")
    made = pairs.mapInArrow(S.error_batches(S.ERROR_COLUMNS, A.class_of, by_class), S.errors_schema(S.ERROR_COLUMNS))
    kept = align_labels(pairs.withColumn("gold", T.pauses_packed("gold", 1_000)))
    expected = S.boundary_errors(kept, A.classify, by_class=by_class, keep=("before", "after"))
    assert same(made, expected) and made.columns == S.boundary_errors(align_labels(pairs), A.classify).columns
    columns = ("utt_id", "gold_idx", "edge", "paused")
    paused = pairs.mapInArrow(S.error_batches(columns, A.class_of, by_class, gap_us=1_000), S.errors_schema(columns))
    assert same(paused, expected.withColumn("paused", F.when(F.col("edge") == "onset", F.col("before")).otherwise(F.col("after"))))


def test_arrow_counts_are_counters_hits_and_sums(spark):
    pairs = stage(fx.pairs(spark, SMALL), "pairs")
    a = align_labels(pairs)
    assert same(pairs.mapInArrow(S.counted_batches, S.COUNTED), S.counters(a))
    made = pairs.mapInArrow(lambda batches: (S.summed(b, 20_000) for b in batches), S.SUMMED)
    assert same(S.segmentation_packed(a), made)
    sums = S.boundary_errors(a, A.classify).groupBy(*S.PAIR).agg(F.sum("abs_us").alias("abs_us"))
    assert same(sums, made.where("n_matched > 0"))
    assert pairs.mapInArrow(lambda batches: (S.summed(b) for b in batches), S.SUMMED).where("n_hits is null and n_gold_bnd is null").count() == pairs.count()


def test_confidence_measures_of_counted_errors(spark):
    rows = [("a", i % 7 / 10, 5_000 * (i * i % 11)) for i in range(60)] + [("a", None, 5), ("b", 0.5, 10), ("b", float("nan"), 10)]
    e = spark.createDataFrame(rows, "system string, conf double, abs_us long")
    counted = e.groupBy("system", "conf", "abs_us").agg(F.count("*").alias("n"))
    for measure in (M.spearman, M.auroc, M.ece):
        assert same(measure(e, ["system"]), measure(counted, ["system"], n="n"))


def test_errors_are_counted_by_type_in_arrow(spark):
    errors, counts = stage(A.boundary_errors(spark, SMALL), "errors"), stage(A.type_counts(spark, SMALL), "counts")
    assert same(M.per_type(errors, A.G), M.type_rates(counts, A.G)) and same(M.per_type(errors, A.G), A.per_type(spark, SMALL))
    assert errors.count() > 10 * counts.count() and errors.count() == counts.agg(F.sum("n")).first()[0]
    one = [("v", "s", "c", "sys_a", "clean", [(0, "a", 0, 5), (1, "a", 5, None), (2, "m", 9, 30_000)], [(0, "a", 4, 9, 0.5), (1, "a", 9, 9, None), (2, "m", 10, 60_000, 0.5)]), ("w", "s", "c", "sys_b", "noise", [], [])]
    pairs = spark.createDataFrame(one, fx.PAIRS)
    made = pairs.mapInArrow(S.type_batches(tuple(A.G), A.class_of), S.type_schema(tuple(A.G)))
    expected = pairs.mapInArrow(S.error_batches(S.ERROR_COLUMNS, A.class_of), S.errors_schema(S.ERROR_COLUMNS))
    assert same(M.per_type(expected, A.G), M.type_rates(made, A.G)) and made.agg(F.sum("n") - F.sum("n_timed")).first()[0] == 1


QUERIES = {
    "word_pause_split": gates.pause_errors,
    "word_boundary_errors": words.word_errors,
    "word_error_rates": A.word_rates,
    "error_view": words.error_view,
    "boundary_errors": A.boundary_errors,
    "type_panel": reports.panel,
    "edit_rates": A.edit_counts,
    "per_type": A.per_type,
}


@pytest.mark.parametrize("name", QUERIES)
def test_one_job_from_turns_to_short_rows(spark, name):
    made = plan(QUERIES[name](spark, SMALL))
    assert made.count("MapInArrow") == 1 and "Generate" not in made and "Window" not in made


@pytest.mark.parametrize("module, query, most", [(words, words.word_table, 2), (words, words.calibration_panel, 1)])
def test_stages_hold_short_rows(spark, monkeypatch, module, query, most):
    held, real = [], module.stage
    monkeypatch.setattr(module, "stage", lambda df, label: held.append(df) or real(df, label))
    query(spark, SMALL)
    assert len(held) == 1 and not any(f.dataType.typeName() == "array" for f in held[0].schema.fields)
    made = held[0].count()
    if query is words.calibration_panel:
        assert made == held[0].select(*A.G, "conf", "abs_us").distinct().count()
    else:
        assert made <= most * fx.pairs(spark, SMALL).count()


def test_what_would_change_is_read_off_one_job(spark, monkeypatch):
    from cadenza.sources import storage

    held, real = [], storage.stage
    monkeypatch.setattr(storage, "stage", lambda df, label: held.append(df) or real(df, label))
    reports.changes(spark, SMALL)
    assert len(held) == 1 and plan(held[0]).count("MapInArrow") == 1 and "Generate" not in plan(held[0])
