import json
import os

import pytest
from helpers import one_column, plan_text, values
from pyspark.sql import functions as F

from rollcall import FieldRule, FieldSpec, export_run, run_lists
from rollcall.errors import InputError
from rollcall.labels import DEFAULT_LABELS as L
from rollcall.plans import export, history, journal, run, summary
from rollcall.sources.lists import split_header_row

SPEC = FieldSpec.of(
    [FieldRule("name", "n", required=True), FieldRule("email", "e", required=True), FieldRule("level", "l", dict_id="LV")]
)


@pytest.fixture
def lists(spark):
    primary = spark.createDataFrame(
        [
            (1, "a", "a@x.cn", "Gold"), (2, "b", "A@x.cn ", "gold"), (3, "", "c@x.cn", "gold"),
            (4, "d", "d@x.cn", "none"), (5, "e", "a@x.cn", "silver"),
        ],
        "_row_num long, name string, email string, level string",
    )
    partner = spark.createDataFrame([(1, "a@X.cn"), (2, "c@x.cn"), (3, "p@x.cn")], "_row_num long, email string")
    vendor = spark.createDataFrame([(1, "p@x.cn"), (2, "d@x.cn"), (3, None)], "_row_num long, email string")
    return {"primary": primary, "partner": partner, "vendor": vendor}


@pytest.fixture
def dictionary(spark):
    return spark.createDataFrame(
        [("LV", "1", "Gold", "gold", 1), ("LV", "2", "Silver", "silver", 2)],
        "dict_id string, code string, label string, label_key string, ord long",
    )


@pytest.mark.parametrize("stored", [False, True])
def test_all_stages(lists, dictionary, folder, stored):
    done = run_lists(lists, SPEC, dictionary, work_dir=folder if stored else None)
    assert done.key == "email" and [s.status for s in done.stages] == ["completed"] * 5
    p = done.primary
    assert p.columns == [
        "_row_num", "name", "email", "level", "level_Code", L.rule_status, L.rule_count, L.rule_types,
        L.dedup, L.dup_key, L.occurrences, L.dict_status, L.dict_count,
    ]
    assert one_column(p, L.dedup) == ["原始", "原始", "跳过", "原始", "重复"]
    assert one_column(p, "level_Code") == ["1", "1", "1", "未匹配", "2"]
    assert one_column(p, L.dict_status) == ["通过", "通过", "通过", "不通过", "通过"]
    assert one_column(done.lists["partner"], L.in_primary) == ["是", "否", "否"]
    assert one_column(done.lists["vendor"], L.in_primary) == ["否", "是", "否"]
    assert one_column(done.lists["vendor"], L.in_partner) == ["是", "否", "否"]
    assert values(run.stage_metrics(done), "stage", "success", "fail", "skip") == sorted(
        [
            ("load", 11, 0, 0), ("field_validation", 4, 1, 0), ("internal_dedup", 3, 1, 1), ("dict_encode", 4, 1, 0),
            ("dict_validation", 3, 1, 0), ("cross_dedup", 2, 2, 0),
        ],
        key=repr,
    )
    assert values(summary.run_totals(done)) == [(3 + 4 + 3 + 4 + 2 + 11, 1 + 1 + 1 + 1 + 2, 11, 2, 1)]


def test_chosen_stages_and_reasons(lists, dictionary):
    only = run_lists(lists, SPEC, stages=[run.FIELD_RULES])
    assert [s.status for s in only.stages] == ["completed"] + ["skipped"] * 4
    bare = run_lists(lists, None, None, key="nope")
    messages = {s.stage: s.message for s in bare.stages}
    assert all(s.status == "skipped" for s in bare.stages)
    assert "字段规范" in messages["field_validation"] and "nope" in messages["internal_dedup"]
    assert "字段规范" in messages["dict_encode"] and "nope" in messages["cross_dedup"]
    assert "字典" in {s.stage: s.message for s in run_lists(lists, SPEC).stages}["dict_encode"]
    no_codes = run_lists(lists, SPEC, dictionary, stages=[run.DICT_CHECK])
    assert no_codes.status_of(run.DICT_CHECK) == "skipped"
    assert run_lists(lists, SPEC, dictionary, stages=[run.INTERNAL_DEDUP]).ran(run.INTERNAL_DEDUP)


def test_nothing_valid(lists, dictionary):
    spec = FieldSpec.of([FieldRule("absent", required=True)])
    done = run_lists(lists, spec, dictionary, key="email")
    assert {s.stage: s.status for s in done.stages} == {
        "field_validation": "completed", "internal_dedup": "skipped", "dict_encode": "completed",
        "dict_validation": "skipped", "cross_dedup": "skipped",
    }
    empty = run_lists({"primary": lists["primary"].limit(0)}, spec, dictionary, key="email")
    assert all(s.status == "skipped" for s in empty.stages)


def test_faults(lists, dictionary, monkeypatch):
    with pytest.raises(InputError):
        run_lists({"partner": lists["partner"]}, SPEC)
    with pytest.raises(InputError):
        run_lists(lists, SPEC, stages=["typo"])

    def broken(_):
        raise ValueError("boom")

    monkeypatch.setitem(run._ACTIONS, run.DICT_ENCODE, broken)
    done = run_lists(lists, SPEC, dictionary)
    assert done.failed and done.status_of(run.DICT_ENCODE) == "failed" and done.ran(run.CROSS_DEDUP)


def test_levels_and_report(lists, dictionary):
    facts = run.run_facts(run_lists(lists, SPEC, dictionary))
    assert values(summary.result_level(facts), "problems", "level") == [(2, "warning")]
    assert summary.result_level(facts, status="failed", message="x").first()["level"] == "error"
    clean = run_lists({"primary": lists["primary"].limit(2)}, SPEC, dictionary)
    assert summary.result_level(run.run_facts(clean)).first()["level"] == "success"
    report = json.loads(summary.run_report(clean).first()["report"])
    assert report["status"] == "completed" and report["counts"]["primary_rows"] == 2
    assert report["stages"]["internal_dedup"] == "completed"


def test_summary_table(lists, dictionary):
    table = {r["statistic"]: r["value"] for r in summary.summary_table(run_lists(lists, SPEC, dictionary)).collect()}
    assert table["处理状态"] == "失败" and table["一线 原始记录数"] == "5" and table["  REQUIRED_EMPTY"] == "1"
    assert table["名单内部去重 跳过数"] == "1" and "字段合规检查 跳过数" not in table and table["去重字段"] == "email"
    partner = summary.summary_table(run_lists(lists, SPEC, dictionary), "partner")
    assert "错误类型分布" not in {r["statistic"] for r in partner.collect()}


def test_export(spark, lists, dictionary, folder):
    codes = spark.createDataFrame([(1, "c_name", "c_email", "c_level")], lists["primary"].schema)
    shifted = lists["primary"].withColumn("_row_num", F.col("_row_num") + 1)
    lists["primary"] = split_header_row(codes.unionByName(shifted))
    lists["vendor"] = lists["vendor"].limit(0)
    done = run_lists(lists, SPEC, dictionary, work_dir=folder + "/work")
    written = export_run(done, folder + "/out", timestamp="t", repeats=True)
    assert sorted(written) == ["partner", "primary"] and written["primary"].endswith("批次_t/list=primary")
    base = written["primary"]
    assert spark.read.parquet(base + "/data").count() == 5
    header = {r["name"]: r["code"] for r in spark.read.parquet(base + "/header").collect()}
    assert header["name"] == "c_name" and header["level_Code"] == "系统生成"
    errors = spark.read.parquet(base + "/errors_primary")
    assert errors.columns == ["行号", "字段名", "原始值", "问题类型", "说明"] and errors.count() == 1
    assert spark.read.parquet(base + "/errors_dictionary").count() == 1
    assert spark.read.parquet(base + "/repeats").count() == 1
    assert spark.read.parquet(base + "/summary").count() > 10
    as_csv = export_run(done, folder + "/csv", fmt="csv", timestamp="t")
    assert spark.read.option("header", True).csv(as_csv["partner"] + "/data").count() == 3
    kept = export.original_columns(done.primary).columns
    assert "name" in kept and not any(c.startswith("_") or c.endswith("_Code") for c in kept)


def test_rows_are_written_in_order(spark, folder, monkeypatch):
    monkeypatch.setattr(export, "ROWS_PER_FILE", 999)
    monkeypatch.setattr(export, "FEWEST_ROWS_PER_FILE", 10)
    rows = spark.range(10_000).select((10_000 - F.col("id")).alias("_row_num"))
    export.write_dataset(export.in_row_order(rows, "_row_num", 10_000), folder + "/d", "parquet")
    back = spark.read.parquet(folder + "/d").select("_row_num", F.input_file_name().alias("f"))
    per_file = back.groupBy("f").agg(F.min("_row_num").alias("a"), F.max("_row_num").alias("b"), F.count(F.lit(1)).alias("n"))
    spans = [(r["a"], r["b"], r["n"]) for r in per_file.orderBy("f").collect()]
    assert spans == [(i * 999 + 1, min((i + 1) * 999, 10_000), min(999, 10_000 - i * 999)) for i in range(11)]


def test_shared_folder_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    a, b = export.shared_folder(spark, "x"), export.shared_folder(spark, "x")
    assert a != b and (base is None or a.startswith(base))


def test_history(spark, lists, dictionary, folder):
    path = folder + "/runs"
    first = history.start_run(spark, path, {"primary": "/in/一线.xlsx"})
    second = history.start_run(spark, path, {})
    done = run_lists(lists, SPEC, dictionary)
    history.finish_run(spark, path, first, "completed", summary.run_totals(done), F.lit('{"k": 1}'), "/out/" + "x" * 40)
    log = spark.read.parquet(path)
    latest = history.latest_runs(log)
    one = history.one_run(latest, first).first()
    assert one["status"] == "completed" and one["total_records"] == 11 and one["inputs"]["primary"] == "/in/一线.xlsx"
    assert history.one_run(latest, second).first()["status"] == "running"
    assert history.newest_runs(latest, 1).count() == 1
    shown = {r["run_id"]: r for r in history.runs_for_display(latest).collect()}
    assert shown[first]["file_name"] == "一线.xlsx" and shown[first]["output_dir"].startswith("...") and shown[first]["duration"].endswith("秒")
    assert shown[second]["duration"] == "-" and shown[second]["file_name"] == "-"
    left = history.without_runs(log, latest.filter(F.col("run_id") == first))
    assert {r["run_id"] for r in left.collect()} == {second}
    parsed = {r["run_id"]: r["parsed"]["k"] for r in history.summary_of(latest, "k int").collect()}
    assert parsed == {first: 1, second: None}
    stage_rows = history.stage_log(run.stage_metrics(done), first, {"load": 12})
    assert {r["module"]: r["elapsed_ms"] for r in stage_rows.collect()}["load"] == 12


def test_runs_are_deleted_by_month(spark, folder):
    events = [("a", "2024-01-05", "x"), ("b", "2024-01-06", "x"), ("a", "2024-02-01", "y"), ("c", "2024-03-01", "z"), ("d", None, "x"), (None, "2024-01-07", "w")]
    log = spark.createDataFrame(events, "run_id string, at string, status string").select(
        "run_id", F.col("at").cast("timestamp").alias("event_time"), "status"
    )
    path = folder + "/runs"
    history.append_runs(log, path)
    files = lambda month: sorted(os.listdir(f"{path}/month={month}"))
    before = files("2024-03")
    gone = spark.createDataFrame([("a",), ("a",), ("nobody",), (None,)], "run_id string")
    assert history.delete_runs(spark, path, gone) == ["2024-01", "2024-02"]
    assert values(history.read_runs(spark, path), "run_id", "status") == [("b", "x"), ("c", "z"), ("d", "x"), (None, "w")]
    assert files("2024-03") == before and not os.path.exists(f"{path}/month=2024-02")
    assert history.delete_runs(spark, path, gone) == []
    assert history.delete_runs(spark, path, gone.limit(0)) == []
    assert history.delete_runs(spark, path, spark.createDataFrame([("d",)], "run_id string")) == ["none"]
    assert values(history.latest_runs(history.read_runs(spark, path)), "run_id", "status") == [("b", "x"), ("c", "z"), (None, "w")]


def test_broken_summary_is_empty(spark):
    runs = spark.createDataFrame([("a", "{broken"), ("b", None), ("c", '{"k": 2}')], "run_id string, summary string")
    assert values(history.summary_of(runs, "k int"), "run_id", "parsed.k") == [("a", None), ("b", None), ("c", 2)]


def test_versions(spark, folder):
    prints = spark.createDataFrame([("/d/x.xlsx", "m1")], "path string, md5_hash string")
    history.record_versions(prints, folder + "/v", "r1")
    history.record_versions(prints.withColumn("md5_hash", F.lit("m2")), folder + "/v", "r2")
    got = history.version_history(spark.read.parquet(folder + "/v"), "/d/x.xlsx")
    assert [r["md5_hash"] for r in got.orderBy(F.desc("recorded_at")).collect()] == ["m2", "m1"]


def test_settings(spark):
    log = spark.createDataFrame(
        [("a", "1", "first", 1), ("a", "2", "ignored", 2), ("b", "1", "old", 1), ("b", None, None, 2), ("b", "3", "new", 3),
         ("c", "1", None, 1), ("c", None, None, 2), ("d", "1", None, 1)],
        "key string, value string, description string, updated_at int",
    )
    got = history.current_settings(log)
    assert values(got, "key", "value", "description") == [("a", "2", "first"), ("b", "3", "new"), ("d", "1", None)]
    assert values(history.setting(got, "a")) == [("a", "2")]


def staged(spark, lists, dictionary, folder, **options):
    return journal.run_staged(lists, SPEC, dictionary, journal=folder + "/journal", work_dir=folder + "/work", run_id="r1", **options)


def test_staged_run_counts_while_it_writes(spark, lists, dictionary, folder):
    done, account = staged(spark, lists, dictionary, folder)
    plain = run_lists(lists, SPEC, dictionary)
    assert [s.status for s in done.stages] == ["completed"] * 5
    for key in lists:
        assert values(done.lists[key]) == values(plain.lists[key].select(*done.lists[key].columns))
    assert values(account.facts()) == values(run.run_facts(plain))
    assert "Exchange" not in plan_text(account.facts()) and "Scan parquet" not in plan_text(account.facts())
    log = journal.stage_log(done, journal.read_journal(spark, folder + "/journal"), "r1")
    want = {r["stage"]: (r["success"], r["fail"], r["skip"]) for r in run.stage_metrics(plain).collect()}
    assert {r["stage"]: (r["success"], r["fail"], r["skip"]) for r in log.collect()} == want
    assert all(r["elapsed_ms"] >= 0 for r in log.collect())
    assert values(done.errors["primary"], "row_num") == [(3,)] and values(done.errors["dictionary"], "row_num") == [(4,)]


def test_a_failing_job_fails_its_stage_and_a_second_call_resumes(spark, lists, dictionary, folder):
    # The dictionary breaks when it is read, not when the plan is made.
    broken = dictionary.withColumn("label_key", F.when(F.col("ord") == 2, F.raise_error(F.lit("broken entry"))).otherwise(F.col("label_key")))
    first, _ = staged(spark, lists, broken, folder)
    assert [s.status for s in first.stages] == ["completed", "completed", "failed", "skipped", "completed"]
    assert "level_Code" not in first.primary.columns and L.dedup in first.primary.columns
    rows = journal.latest_attempts(journal.read_journal(spark, folder + "/journal"), "r1")
    state = {r["stage"]: r for r in rows.collect()}
    assert state["dict_encode"]["status"] == "failed" and "broken entry" in state["dict_encode"]["message"]
    second, account = staged(spark, lists, dictionary, folder)
    assert [s.status for s in second.stages] == ["completed"] * 5
    rows = {r["stage"]: r for r in journal.latest_attempts(journal.read_journal(spark, folder + "/journal"), "r1").collect()}
    assert [rows[s]["status"] for s in ("load", *run.STAGES)] == ["resumed"] * 3 + ["completed"] * 3
    assert rows["internal_dedup"]["folder"] == state["internal_dedup"]["folder"]
    plain = run_lists(lists, SPEC, dictionary)
    assert values(second.primary) == values(plain.primary.select(*second.primary.columns))
    assert values(account.facts()) == values(run.run_facts(plain))
    assert values(second.errors["primary"], "row_num") == [(3,)]


def test_export_counts_while_it_writes(spark, lists, dictionary, folder):
    done = run_lists(lists, SPEC, dictionary)
    written = export_run(done, folder + "/out", timestamp="t")
    got = spark.read.parquet(written["primary"] + "/summary")
    assert values(got) == values(summary.summary_table(done).select(*got.columns))


def test_runs_know_whether_their_markers_are_stored(spark, lists, dictionary, folder):
    assert staged(spark, lists, dictionary, folder)[0].stored
    assert run_lists(lists, SPEC, work_dir=folder + "/plain", stages=[run.FIELD_RULES]).stored
    assert not run_lists(lists, SPEC, stages=[run.FIELD_RULES]).stored
