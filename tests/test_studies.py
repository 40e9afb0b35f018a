"""Studies and reports at their edges: gaps, ties, foreign names, empty tables, limits."""

import pytest
from pyspark.sql import functions as F

from lattiq.operators import catalog, engine, report, studies


def test_strategies(spark):
    rows = spark.createDataFrame([(k, f"n{k}", ["a", "b", None][k % 3], None if k == 4 else float(k)) for k in range(12)], "id int, noise string, kind string, x double")
    full, mask = studies.prepare_by_strategy(rows, "id", "full")
    assert full.columns == ["id", "kind", "x"]  # a text that is nearly unique is noise, a repeated one is not
    with pytest.raises(ValueError):
        studies.prepare_by_strategy(rows, "id", "half")
    repeated = rows.unionByName(rows).unionByName(rows).drop("noise")
    full, mask = studies.prepare_by_strategy(repeated, "id")
    assert full.columns == ["id", "kind", "x"] and mask.where("m_kind").count() == 12 and mask.where("m_x").count() == 3
    assert {r.kind for r in full.collect()} == {0.0, 0.5, 1.0} and full.agg(F.max("x")).first()[0] == 1.0
    raw, none = studies.prepare_by_strategy(repeated, "id", "none")
    assert none.where("m_kind OR m_x").count() == 0 and raw.agg(F.max("x")).first()[0] == 11.0
    assert raw.where("id = 4").first().x == 6.0  # the median of the eleven others
    assert studies.prepare_by_strategy(rows.where("false"), "id")[0].count() == 0


def test_feature_table_drops_what_it_says(spark):
    rows = spark.createDataFrame(
        [("d", 1.0, "hex", 0.5, False), ("d", None, "hex", 0.5, False), ("d", 1.0, "odd", 0.5, False), ("d", 1.0, "square", 0.5, True), (None, float("nan"), "hex", 1.0, None), (None, 2.0, "square", 1.0, None)],
        "dataset_name string, m double, kind string, mqe double, is_penalized boolean",
    )
    args = (["m"], {"kind": ["hex", "square"]}, ["mqe"])
    got = [tuple(r) for r in studies.feature_table(rows, *args).collect()]
    assert sorted(got) == [("d", 1.0, 1, 0, 0.5), ("unknown", 2.0, 0, 1, 1.0)]
    seen = studies.feature_metadata(rows, *args).first()
    assert (seen.num_samples, seen.dropped_rows, seen.num_features) == (2, 2, 3)
    assert studies.feature_table(rows, *args, keep_penalised=True, keep_unknown=True).count() == 4
    with pytest.raises(ValueError):
        studies.feature_table(rows.drop("mqe"), *args)
    assert studies.feature_metadata(rows.where("false"), *args).first().num_samples == 0


def test_arms_land_on_their_iterations(spark):
    sizes = spark.createDataFrame([("a", 137), ("b", 100_003), ("none", 0)], "dataset string, n int")
    got = studies.arms(sizes, "n").collect()
    assert len(got) == 2 * 19
    for r in got:
        if r.regime == "det":
            assert int(r.n * r.epoch_multiplier) == r.budget
        name = spark.range(1).select(*studies.parse_arm(F.lit(f"arm_{r.arm}"))).first() if r.dataset == "a" else (r.regime, r.budget)
        assert tuple(name) == (r.regime, r.budget)
    names = spark.createDataFrame([("baseline",), ("arm_other-3",), ("arm_det-e",), (None,), ("arm_det-e3x",), ("arm_det-e99999999999",)], "f string")
    assert all(tuple(r) == (None, None) for r in names.select(*studies.parse_arm(F.col("f"))).collect())


def test_arm_report_marks_saturation(spark):
    rows = [("d", f"arm_det-e{b}", v) for b, vs in ((3, (8.0, 12.0)), (10, (5.0, 5.0, 5.0)), (30, (4.99, 4.99)), (100, (0.0, None))) for v in vs] + [("d", "other", 1.0)]
    got = {r.budget: r for r in studies.arm_report(spark.createDataFrame(rows, "ds string, f string, mqe double"), "ds", "f", ["mqe"]).collect()}
    assert [got[b].median for b in (3, 10, 30, 100)] == [10.0, 5.0, 4.99, 0.0] and got[100].n == 1
    assert got[3].gain == 0.5 and not got[3].saturated and got[100].gain is None and got[100].saturated
    assert studies.arm_report(spark.createDataFrame([], "ds string, f string, mqe double"), "ds", "f", ["mqe"]).count() == 0


def test_advice_rules(spark):
    rows = spark.createDataFrame([("a", True, True, 3.0), ("b", False, False, 0.5), ("b", False, False, 0.5), ("c", False, None, None)], "uid string, flag boolean, pen boolean, ratio double")
    gens = spark.createDataFrame([(0, 0.5), (0, 0.6), (1, 0.5), (1, 2.0)], "generation int, ratio double")
    got = {r.rule: (r.figure, r.out_of) for r in studies.advice(rows, gens, "uid", "flag", "pen", "ratio", ["ratio"]).collect()}
    assert got == {"flag_always_penalised": (1, 1), "archive_regression": (1, 2), "duplicates": (1, 1)}
    odd = rows.unionByName(spark.createDataFrame([("b", False, False, 0.7)], rows.schema))
    assert {r.rule: r.figure for r in studies.advice(odd, gens, "uid", "flag", "pen", "ratio", ["ratio"]).collect()}["nondeterministic"] == 1
    assert studies.advice(rows.where("false"), gens.where("false"), "uid", "flag", "pen", "ratio", ["ratio"]).count() == 0


def test_upload_needs_its_run(spark):
    runs, rows = spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(1, 7)], "run_id long, sample_id long")
    assert sorted(map(tuple, catalog.append_to_run(rows, rows.select("sample_id"), runs, 1).collect())) == [(1, 7), (1, 7)]  # no refresh
    with pytest.raises(catalog.NotFoundError):
        catalog.append_to_run(rows, rows.select("sample_id"), runs, 2)


def test_report_of_a_run(spark, tmp_path):
    rows = spark.range(300).select("id", F.when(F.col("id") % 10 != 0, F.col("id") % 20 / 20.0).alias("a"), F.when(F.col("id") == 7, 99.0).otherwise(1.0).alias("b"), F.lit(None).cast("double").alias("gone"))
    engine.run(rows, engine.RunConfig("id", ("a", "b", "gone"), grid=(3, 3, "square"), epochs=2), str(tmp_path), "r")
    view = report.RunView(spark, str(tmp_path), "r", rows)
    lines = report.context_lines(view, None, report.Limits(clusters=2, anomalies=3, features=1, incomplete=2), {"silhouette": 0.25})
    by = {}
    for r in lines.collect():
        by.setdefault(r.section, {})[r.place] = r.line
    assert set(by) == {1, 2, 3, 4, 5, 6, 9}  # without categories there are neither shares nor regions
    assert len(by[3]) == 2 and len(by[5]) == 3 and "silhouette: 0.2500" in by[2].values()
    assert by[5][1].startswith("7:") or any(x.startswith("7:") for x in by[5].values())
    assert by[9][0] == "without any value: gone" and by[9][1] == "rows with missing values: 30 of 300"
    assert [x for x in by[9].values() if "misses" in x] == ["0 misses a", "10 misses a"]
    text = report.as_text(lines)
    assert text.startswith("== dataset ==\nno description") and text.index("== map ==") < text.index("== missing data ==")
    with pytest.raises(LookupError):
        report.RunView(spark, str(tmp_path), "other", rows)
    with pytest.raises(ValueError):
        report.Limits(clusters=0)
