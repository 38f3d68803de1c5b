"""The discovery loop, its artifacts, and the sources."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.operators import discovery as d
from tessella.operators import runs
from tessella.sources import artifacts, predictors, store
from tessella.streaming import progress

TEXT = """--- SIGNAL 1 ---
NAME: one
EXPRESSION: RATIO(SUB(revt, cogs), prcc_f)
HYPOTHESIS: h
EXPECTED_SIGN: Positive
REASONING: r
INTERACTION_TYPE: ratio
--- SIGNAL 2 ---
NAME: two
EXPRESSION: ratio(sub(revt,cogs), prcc_f)
HYPOTHESIS: h
EXPECTED_SIGN: negative
REASONING: r
INTERACTION_TYPE: ratio
--- SIGNAL 3 ---
NAME: three
EXPRESSION: RATIO(ib, at)
HYPOTHESIS: h
EXPECTED_SIGN: positive
REASONING: r
INTERACTION_TYPE: ratio
--- SIGNAL 4 ---
NAME: four
"""


def test_search_loop(spark, tmp_path):
    task = d.Task("profit_value")
    rec = d.Recorder(tmp_path, task.pair)

    def evaluate(proposals, generation):
        return [d.Evaluated(**vars(p), generation=generation, fmb_tstat=float("nan") if generation else 2.5) for p in proposals]

    archive = d.run_search(task, d.QueueProposer([TEXT, TEXT]), evaluate, d.FixedGenerations(2), recorder=rec)
    codes = [x.code for x in archive.diagnostics]
    assert codes == ["accepted", "duplicate_expression", "missing_required_theme"] + ["duplicate_expression"] * 2 + ["missing_required_theme"]
    assert [e.name for e in archive.successful()] == ["one"] and len(archive.considered) == 4
    df = artifacts.read_json(spark, str(tmp_path / "archive.json"), artifacts.ARCHIVE)
    ev = artifacts.exploded(df, "evaluated")
    assert ev.count() == 1 and artifacts.exploded(df, "considered").count() == 4
    told = artifacts.read_lines(spark, str(tmp_path / "validation_diagnostics.jsonl"))
    assert {r.code: r.n for r in runs.rejection_codes(told).collect()} == {"duplicate_expression": 3, "missing_required_theme": 2}
    q = progress.latest(progress.follow(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("latest").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("latest").where("event = 'generation_completed'").select("generation").first()[0] == 1


def test_budget_and_stop():
    b = d.Budget(max_out=10)
    b.record(0, 10)
    assert b.reason() == "output tokens"
    assert not d.run_search(d.Task("profit_value"), d.QueueProposer([TEXT]), lambda p, g: [], d.FixedGenerations(3), d.Budget(max_in=0)).considered


def test_texts():
    notes = d.parse_critiques("--- CRITIQUE one ---\nVERDICT: flag\nSCORE: 2\nRATIONALE: weak\n\n--- CRITIQUE other ---\nVERDICT: accept\n", ["one"])
    assert notes == [{"generation": 0, "target_name": "one", "verdict": "flag", "score": 2, "rationale": "weak"}]
    assert json.loads(d.strict_json({"a": [float("nan"), 1.0], "b": float("inf")})) == {"a": [None, 1.0], "b": None}
    assert len(d.signal_id("s", "n", "RATIO(at, lt)")) == 12 and d.signal_id("s", "n", "RATIO(at,lt)") == d.signal_id("s", "n", "ratio( at , lt )")


def test_lessons():
    book = d.lesson_book({"e1": "supporting", "e2": "opposing_weak", "e3": "realization_failure"}, [{"mechanism_id": "m", "evidence_ids": ["e1", "e2", "e3"], "status": "supported"}])
    assert book[0]["supporting"] == ["e1"] and book[0]["failures"] == ["e3"]
    with pytest.raises(ValueError, match="missing"):
        d.lesson_book({"e1": "supporting", "e2": "supporting"}, [{"mechanism_id": "m", "evidence_ids": ["e1"]}])
    with pytest.raises(ValueError, match="fewer than two"):
        d.lesson_book({"e1": "supporting"}, [{"mechanism_id": "m", "evidence_ids": ["e1"], "status": "supported"}])


def test_survivors(spark):
    inputs = spark.createDataFrame([("a", "x"), ("b", "y")], "signal_id string, expression string")
    ids = inputs.select("signal_id")
    assert runs.survivors(inputs, ids.limit(1), inputs).count() == 1
    with pytest.raises(ValueError, match="repeat"):
        runs.survivors(inputs, ids.union(ids), inputs)
    with pytest.raises(ValueError, match="as it was"):
        runs.survivors(inputs, ids, inputs.withColumn("expression", F.lit("changed")))
    missing, unknown = runs.missing_and_unknown(spark.createDataFrame([("a",), ("z",)], "signal_id string"), inputs, "signal_id")
    assert [r[0] for r in missing.collect()] == ["b"] and [r[0] for r in unknown.collect()] == ["z"]


def test_null_results_are_invalid(spark):
    rows = [("r", 2.5, "positive", None), ("r", -2.5, "positive", None), ("r", float("nan"), "negative", None), ("r", None, "negative", None), ("r", 1.0, "negative", None), ("r", 3.0, "negative", "boom")]
    r = runs.funnel(spark.createDataFrame(rows, "run string, fmb_tstat double, expected_sign string, error string")).where("run IS NOT NULL").first()
    assert (r.evaluated, r.errors, r.invalid, r.wrong_sign, r.weak, r.correct) == (6, 1, 2, 1, 1, 1)


def test_predictors(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("p.csv", "permno, yyyymm ,Acc,BM\n1,196307,,2.0\n1,196307,3.0,9.0\n2,196308,1.0,\n")
    wide = predictors.read_wide(spark, str(tmp_path / "p.zip"), f"file://{tmp_path}/unzipped")
    assert predictors.signal_names(wide) == ["Acc", "BM"]
    got = {(r.name, r.month_idx, r.permno): r.value for r in predictors.to_panels(wide.coalesce(1)).collect()}
    assert got == {("Acc", 1963 * 12 + 7, 1): 3.0, ("BM", 1963 * 12 + 7, 1): 2.0, ("Acc", 1963 * 12 + 8, 2): 1.0}


def test_store(spark, tmp_path):
    store.set_folder(spark, str(tmp_path / "panels"))
    with pytest.raises(FileNotFoundError):
        store.load(spark, "x")
    built = []
    build = lambda n: (built.append(n), spark.range(n).toDF("id"))[1]
    assert store.load_or_build(spark, "x", build, n=3).count() == 3 == store.load_or_build(spark, "x", build, n=5).count() and built == [3]


def test_universe_totals(spark, tmp_path):
    for i, run in enumerate(("r1", "r1", "r2")):
        (tmp_path / f"{run}_{i}.json").write_text(json.dumps({"schema_version": "1", "totals": {"evaluated_tests": 10 + i, "weak_signals": i}, "validation_rejection_codes": {"x": 1}}))
    docs = artifacts.read_json(spark, str(tmp_path / "*.json"), artifacts.UNIVERSE)
    got = {r.run: r.evaluated_tests for r in artifacts.universe_totals(docs, F.regexp_extract("source", r"(r\d)_", 1)).collect()}
    assert got == {"r1": 21, "r2": 12, None: 33}


def test_beta_store(spark, tmp_path):
    from tessella.sources import betas

    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.1), ("b", 1, 0.2)], "signal_id string, month_idx int, beta double")
    built = []
    build = lambda: (built.append(1), df)[1]
    folder = str(tmp_path / "b")
    assert betas.load_or_build(spark, folder, {"x": 1}, build).count() == 3 == betas.load_or_build(spark, folder, {"x": 1}, build).count() and built == [1]
    with pytest.raises(ValueError, match="another specification"):
        betas.load(spark, folder, {"x": 2})
    betas.load_or_build(spark, folder, {"x": 2}, build)
    assert built == [1, 1]


def test_run_spec(tmp_path):
    from tessella.plans import runspec

    (tmp_path / "r.json").write_text('{"name": "base", "pair": "profit_value", "suites": ["spanning", "horse_race"]}')
    spec = runspec.load(tmp_path / "r.json")
    assert spec.ordered_suites == ["horse_race", "spanning"] and len(runspec.for_all_pairs(spec)) == 28
    for bad in ({"name": "../x"}, {"pair": "nope"}, {"seed_prompt": "s"}, {"alpha_factor_model": 2}, {"other": 1}):
        with pytest.raises(ValueError):
            runspec.from_mapping({"name": "n", "pair": "profit_value", **bad})


def test_inverse_percentile(spark):
    from tessella.operators import panel

    sample = spark.createDataFrame([(1, 10.0), (1, 20.0), (1, 20.0), (1, 40.0)], "month_idx int, x double")
    asked = spark.createDataFrame([(1, 5.0), (1, 10.0), (1, 20.0), (1, 30.0), (1, 99.0), (1, None), (2, 1.0)], "month_idx int, x double")
    got = {(r.month_idx, r.x): r.percentile for r in panel.inverse_percentile(sample, asked, "x", method="hazen").collect()}
    assert got == {(1, 5.0): 0.0, (1, 10.0): 12.5, (1, 20.0): 62.5, (1, 30.0): 75.0, (1, 99.0): 100.0, (1, None): None, (2, 1.0): None}
