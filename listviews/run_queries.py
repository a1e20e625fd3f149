"""Queries of whole runs, summaries, sinks and the run history."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.functions.text import base_name, duration_text, file_stem, short_path
from rollcall.labels import DEFAULT_LABELS as L
from rollcall.labels import PARTNER, PRIMARY, VENDOR
from rollcall.plans import export, history, journal, run, summary

from .dedup_queries import MARK_SQL, dedup_select
from .dictionary_queries import CODE_SQL, UNMATCHED, entries
from .match_queries import KEY
from .registry import query
from .rule_queries import MARKS, SPEC, marked_cte
from .views import table, view, with_views


def whole_run(spark, sf, stages=run.STAGES, work=True):
    lists = {k: view(spark, sf, f"{k}_list") for k in (PRIMARY, PARTNER, VENDOR)}
    folder = export.shared_folder(spark, "run") if work else None
    return run.run_lists(lists, SPEC, entries(spark, sf), key="email", stages=stages, work_dir=folder)


RUN = (
    with_views("primary_list", "partner_list", "vendor_list", "entries") + ", " + marked_cte()
    + ", d AS (" + dedup_select("marked", taking_part="(status = '通过')") + f"""),
lab AS (SELECT dict_id, lower(trim(label)) AS k, arg_max(code, ord) AS code FROM entries GROUP BY dict_id, lower(trim(label))),
enc AS (SELECT d.*, coalesce(s.code, '未匹配') AS status_code, coalesce(p.code, '未匹配') AS priority_code, coalesce(n.code, '未匹配') AS nation_code
FROM d LEFT JOIN lab s ON s.dict_id = 'status' AND s.k = lower(trim(d.status_label))
LEFT JOIN lab p ON p.dict_id = 'priority' AND p.k = lower(trim(d.priority_label))
LEFT JOIN lab n ON n.dict_id = 'nation' AND n.k = lower(trim(d.nation_label))),
chk AS (SELECT *, {UNMATCHED} AS dict_errors FROM enc),
pk AS (SELECT DISTINCT {KEY} AS k FROM marked WHERE status = '通过' AND {KEY} IS NOT NULL),
facts AS (SELECT (SELECT count(*) FROM primary_list) AS primary_rows, (SELECT count(*) FROM partner_list) AS partner_rows,
 (SELECT count(*) FROM vendor_list) AS vendor_rows, count(*) FILTER (WHERE status = '通过') AS passed, count(*) FILTER (WHERE status = '不通过') AS failed,
 count(*) FILTER (WHERE mark = '原始') AS original, count(*) FILTER (WHERE mark = '重复') AS repeats, count(*) FILTER (WHERE mark = '跳过') AS skipped,
 count(*) FILTER (WHERE mark = '未知') AS unknown, cast(sum(n_errors) AS bigint) AS rule_problems, cast(sum(dict_errors) AS bigint) AS dict_problems,
 count(*) FILTER (WHERE status_code <> '未匹配') + count(*) FILTER (WHERE priority_code <> '未匹配') + count(*) FILTER (WHERE nation_code <> '未匹配') AS matched,
 (SELECT count(*) FROM partner_list WHERE lower(trim(email)) IN (SELECT k FROM pk)) AS partner_hits,
 (SELECT count(*) FROM vendor_list WHERE lower(trim(email)) IN (SELECT k FROM pk)) AS vendor_hits FROM chk)
"""
)
METRICS = """
metrics AS (SELECT 0 AS pos, 'load' AS stage, primary_rows + partner_rows + vendor_rows AS success, cast(0 AS bigint) AS fail, cast(0 AS bigint) AS skip FROM facts
UNION ALL SELECT 1, 'field_validation', passed, failed, 0 FROM facts
UNION ALL SELECT 2, 'internal_dedup', original, repeats, skipped FROM facts
UNION ALL SELECT 3, 'dict_encode', matched, 3 * primary_rows - matched, 0 FROM facts
UNION ALL SELECT 4, 'dict_validation', passed - dict_problems, dict_problems, 0 FROM facts
UNION ALL SELECT 5, 'cross_dedup', partner_rows - partner_hits, partner_hits + vendor_hits, 0 FROM facts)
"""


@query(
    "full_run",
    RUN + f"""SELECT _row_num, name, email, mobile, birthday, amount, units, {CODE_SQL}, remark, id_card, {MARKS}, {MARK_SQL},
CASE WHEN dict_errors = 0 THEN '通过' ELSE '不通过' END AS "字典校验_状态", dict_errors AS "字典校验_错误数" FROM chk""",
)
def full_run(spark, sf):
    """All stages; the marked, encoded, de-duplicated and checked primary list."""
    return whole_run(spark, sf).primary


@query(
    "markers_only_run",
    with_views("primary_list") + ", " + marked_cte()
    + f" SELECT _row_num, name, email, mobile, birthday, amount, units, status_label, priority_label, nation_label, remark, id_card, {MARKS} FROM marked",
)
def markers_only_run(spark, sf):
    return whole_run(spark, sf, stages=[run.FIELD_RULES], work=False).primary


@query(
    "full_run_partner",
    RUN + "SELECT _row_num, kind, email, CASE WHEN lower(trim(email)) IN (SELECT k FROM pk) THEN '是' ELSE '否' END AS \"是否已在一线名单\" FROM partner_list",
)
def full_run_partner(spark, sf):
    return whole_run(spark, sf).lists[PARTNER]


def staged_run(spark, sf, folder, dictionary, **options):
    lists = {k: view(spark, sf, f"{k}_list") for k in (PRIMARY, PARTNER, VENDOR)}
    return journal.run_staged(
        lists, SPEC, dictionary, key="email", journal=f"{folder}/journal", work_dir=f"{folder}/work", run_id="r1", **options
    )


@query("stage_log", RUN + "," + METRICS + "SELECT pos, stage, 'completed' AS status, success, fail, skip FROM metrics")
def stage_log(spark, sf):
    """Every stage executed where it ends; its counts are those observed by its write."""
    folder = export.shared_folder(spark, "staged")
    done, _ = staged_run(spark, sf, folder, entries(spark, sf))
    return journal.stage_log(done, journal.read_journal(spark, f"{folder}/journal"), "r1").drop("message", "elapsed_ms")


@query(
    "run_resume",
    RUN + "," + METRICS + "SELECT pos, stage, CASE WHEN pos <= 2 THEN 'resumed' ELSE 'completed' END AS status, success, fail, skip FROM metrics",
)
def run_resume(spark, sf):
    """The dictionary breaks while stage 3 runs; a second call takes the stages before it from their folders."""
    folder = export.shared_folder(spark, "resumed")
    good = entries(spark, sf)
    broken = good.withColumn("code", F.when(F.col("dict_id") == "status", F.raise_error(F.lit("broken"))).otherwise(F.col("code")))
    staged_run(spark, sf, folder, broken)
    done, _ = staged_run(spark, sf, folder, good)
    return journal.stage_log(done, journal.read_journal(spark, f"{folder}/journal"), "r1").drop("message", "elapsed_ms")


@query(
    "full_run_staged",
    RUN + f"""SELECT _row_num, name, email, mobile, birthday, amount, units, {CODE_SQL}, remark, id_card, {MARKS}, {MARK_SQL},
CASE WHEN dict_errors = 0 THEN '通过' ELSE '不通过' END AS "字典校验_状态", dict_errors AS "字典校验_错误数" FROM chk""",
)
def full_run_staged(spark, sf):
    """The primary list as the last stage wrote it."""
    return staged_run(spark, sf, export.shared_folder(spark, "staged"), entries(spark, sf))[0].primary


@query("stage_metrics", RUN + "," + METRICS + "SELECT * FROM metrics")
def stage_metrics(spark, sf):
    return run.stage_metrics(whole_run(spark, sf))


@query(
    "run_totals",
    RUN + "," + METRICS + """SELECT cast((SELECT sum(success) FROM metrics) AS bigint) AS sum_success, cast((SELECT sum(fail) FROM metrics) AS bigint) AS sum_fail,
primary_rows + partner_rows + vendor_rows AS input_rows, rule_problems + dict_problems AS problems, repeats AS rejected_rows FROM facts""",
)
def run_totals(spark, sf):
    return summary.run_totals(whole_run(spark, sf))


@query(
    "result_level",
    RUN + """SELECT rule_problems + dict_problems AS problems, 'warning' AS level,
concat('成功: 发现 ', cast(rule_problems + dict_problems AS string), ' 条问题，建议修复后再上传 目标系统') AS message FROM facts""",
)
def result_level(spark, sf):
    return summary.result_level(run.run_facts(whole_run(spark, sf)))


_NAMES = {
    "load": "文件加载",
    "field_validation": "字段合规检查",
    "cross_dedup": "跨名单去重",
    "dict_encode": "数据字典上码",
    "dict_validation": "字典值校验",
    "internal_dedup": "名单内部去重",
}
_TITLE = "CASE stage " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMES.items()) + " END"


@query(
    "summary_table",
    RUN + "," + METRICS + f"""SELECT '名单类型' AS statistic, '一线' AS value UNION ALL SELECT '处理状态', '失败'
UNION ALL SELECT '处理耗时(秒)', '90.50' UNION ALL SELECT '开始时间', '2024-01-01T00:00:00' UNION ALL SELECT '结束时间', '2024-01-01T00:01:30.500'
UNION ALL SELECT '一线 原始记录数', cast(primary_rows AS string) FROM facts UNION ALL SELECT '一线 处理后记录数', cast(primary_rows AS string) FROM facts
UNION ALL SELECT concat({_TITLE}, ' 成功数'), cast(success AS string) FROM metrics
UNION ALL SELECT concat({_TITLE}, ' 失败数'), cast(fail AS string) FROM metrics
UNION ALL SELECT concat({_TITLE}, ' 跳过数'), cast(skip AS string) FROM metrics WHERE skip <> 0
UNION ALL SELECT '错误类型分布', '' UNION ALL SELECT concat('  ', problem), cast(count(*) AS string) FROM errs GROUP BY problem
UNION ALL SELECT '去重字段', 'email' UNION ALL SELECT '去重原始数', cast(original AS string) FROM facts
UNION ALL SELECT '去重重复数', cast(repeats AS string) FROM facts UNION ALL SELECT '去重未知数（空值）', cast(unknown AS string) FROM facts""",
)
def summary_table(spark, sf):
    return summary.summary_table(
        whole_run(spark, sf), start="2024-01-01T00:00:00", end="2024-01-01T00:01:30.500"
    ).drop("pos")


_COUNTS = (
    ("primary_rows", "primary_rows"), ("passed_rows", "passed"), ("failed_rows", "failed"), ("rule_problems", "rule_problems"),
    *((c, f"(SELECT count(*) FROM errs WHERE problem = '{c}')") for c in run.PROBLEM_CODES),
    ("original_rows", "original"), ("repeat_rows", "repeats"), ("unknown_rows", "unknown"), ("skipped_rows", "skipped"),
    ("matched_codes", "matched"), ("all_codes", "3 * primary_rows"), ("dict_problems", "dict_problems"),
    ("partner_rows", "partner_rows"), ("partner_in_primary", "partner_hits"), ("partner_in_partner", "0"),
    ("vendor_rows", "vendor_rows"), ("vendor_in_primary", "vendor_hits"),
    ("vendor_in_partner", f"(SELECT count(*) FROM vendor_list WHERE lower(trim(email)) IN (SELECT {KEY} FROM partner_list WHERE {KEY} IS NOT NULL))"),
)
_STAGES_JSON = ",".join(f'"{s}":"completed"' for s in run.STAGES)


@query(
    "run_report",
    RUN + f"""SELECT concat('{{"status":"failed","key":"email","stages":{{{_STAGES_JSON}}},"counts":{{', """
    + ", ',', ".join(f"'\"{name}\":', cast({value} AS string)" for name, value in _COUNTS)
    + ", '}}') AS report FROM facts",
)
def run_report(spark, sf):
    return summary.run_report(whole_run(spark, sf))


@query(
    "export_roundtrip",
    RUN + f"SELECT _row_num, name, email, {CODE_SQL}, {MARKS}, {MARK_SQL} FROM chk",
)
def export_roundtrip(spark, sf):
    """Writes a batch folder and reads the primary data set back."""
    written = export.export_run(
        whole_run(spark, sf), export.shared_folder(spark, "export"), timestamp="20240101_000000"
    )
    data = spark.read.parquet(f"{written[PRIMARY]}/data")
    return data.select(
        L.row_num, "name", "email",
        *[c for n in ("status_label", "priority_label", "nation_label") for c in (n, n + L.code_suffix)],
        L.rule_status, L.rule_count, L.rule_types, L.dedup, L.dup_key, L.occurrences,
    )


@query(
    "export_header_map",
    "SELECT 0 AS pos, 'o_orderkey' AS name, 'key' AS code, count(*) AS n FROM orders UNION ALL "
    "SELECT 1, 'o_orderstatus', '系统生成', count(*) FROM orders UNION ALL SELECT 2, '_row_num', '系统生成', count(*) FROM orders",
)
def export_header_map(spark, sf):
    """Header line of a list whose codes are column metadata, next to the list's row count."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") + 1).alias(L.row_num))
    orders = orders.withMetadata("o_orderkey", {"code": "key"})
    counted = orders.agg(F.count(F.lit(1)).alias("n"))
    heads = export.header_map(orders).groupBy().agg(F.collect_list(F.struct("pos", "name", "code")).alias("h"))
    stacked = counted.select("n", F.lit(None).cast(heads.schema["h"].dataType).alias("h")).unionByName(
        heads.select(F.lit(None).cast("long").alias("n"), "h")
    )
    one = stacked.agg(F.max("n").alias("n"), F.first("h", ignorenulls=True).alias("h"))
    return one.select("n", F.inline("h"))


@query("export_repeats", RUN + f"SELECT _row_num, name, email, {MARK_SQL} FROM chk WHERE mark = '重复'")
def export_repeats(spark, sf):
    """The repeats data set, read back from an export."""
    written = export.export_run(
        whole_run(spark, sf), export.shared_folder(spark, "export"), timestamp="20240101_000000", repeats=True
    )
    rows = spark.read.parquet(f"{written[PRIMARY]}/repeats")
    return rows.select(L.row_num, "name", "email", L.dedup, L.dup_key, L.occurrences)


@query(
    "export_header",
    with_views("vendor_list") + """SELECT pos, name, code, (SELECT count(*) FROM vendor_list) AS n FROM (VALUES
(0, '_row_num', '系统生成'), (1, 'name', 'attr_name'), (2, 'email', '系统生成')) h(pos, name, code)""",
)
def export_header(spark, sf):
    """The header data set next to the written list; both are read back from an export."""
    rows = view(spark, sf, "vendor_list").withMetadata("name", {"code": "attr_name"})
    written = export.export_run(
        run.run_lists({PRIMARY: rows}, stages=[]), export.shared_folder(spark, "export"), timestamp="20240101_000000"
    )
    counted = spark.read.parquet(f"{written[PRIMARY]}/data").agg(F.count(F.lit(1)).alias("n"))
    return spark.read.parquet(f"{written[PRIMARY]}/header").crossJoin(F.broadcast(counted))


LATEST = with_views("run_log") + """, latest AS (SELECT run_id, arg_max(status, event_time) FILTER (WHERE status IS NOT NULL) AS status,
arg_max(total_records, event_time) FILTER (WHERE total_records IS NOT NULL) AS total_records,
arg_max(output_dir, event_time) FILTER (WHERE output_dir IS NOT NULL) AS output_dir,
arg_max(summary, event_time) FILTER (WHERE summary IS NOT NULL) AS summary, max(event_time) AS last_event FROM run_log GROUP BY run_id)
"""


@query("runs_latest_state", LATEST + "SELECT run_id, status, total_records, output_dir, summary FROM latest")
def runs_latest_state(spark, sf):
    return history.latest_runs(view(spark, sf, "run_log"))


@query(
    "runs_top_n",
    with_views("run_log") + """, states AS (SELECT run_id, arg_max(status, event_time) FILTER (WHERE status IS NOT NULL) AS status, max(event_time) AS start_time FROM run_log GROUP BY run_id)
SELECT run_id, status, concat_ws('|', coalesce(run_id, ''), coalesce(status, '')) AS inputs FROM states ORDER BY start_time DESC, run_id LIMIT 50""",
)
def runs_top_n(spark, sf):
    """The latest 50 runs by their current state, not by their log events."""
    log = view(spark, sf, "run_log").select("run_id", "event_time", "status", F.col("event_time").alias("start_time"))
    states = history.latest_runs(log).withColumns({"in_a": F.col("run_id"), "in_b": F.col("status")})
    top = history.run_inputs(history.newest_runs(states, 50), {"primary": "in_a", "dict": "in_b"})
    inputs = F.concat_ws("|", F.coalesce(F.col("inputs")["primary"], F.lit("")), F.coalesce(F.col("inputs")["dict"], F.lit("")))
    return top.select("run_id", "status", inputs.alias("inputs"))


@query(
    "runs_delete",
    with_views("run_log") + "SELECT run_id, status FROM run_log WHERE run_id NOT IN (SELECT run_id FROM run_log WHERE status = 'failed' AND total_records IS NULL AND event_time < timestamp '2024-01-02')",
)
def runs_delete(spark, sf):
    """Writes the log by month, deletes runs from the stored log and reads back what is left."""
    path = export.shared_folder(spark, "runs")
    log = view(spark, sf, "run_log")
    history.append_runs(log, path)
    gone = log.filter("status = 'failed' and total_records is null and event_time < timestamp_ntz '2024-01-02 00:00:00'")
    history.delete_runs(spark, path, gone)
    return history.read_runs(spark, path).select("run_id", "status")


@query(
    "history_summary_json",
    with_views("run_log") + """SELECT run_id, event_time, k, concat('{"run_id":"', run_id, '"', CASE WHEN k IS NULL THEN '' ELSE concat(',"k":', cast(k AS string)) END, '}') AS report
FROM (SELECT run_id, event_time, cast(nullif(regexp_extract(summary, '"k": ([0-9]+)', 1), '') AS int) AS k FROM run_log) x""",
)
def history_summary_json(spark, sf):
    parsed = history.summary_of(view(spark, sf, "run_log"), "k int")
    k = F.col("parsed.k")
    return parsed.select("run_id", "event_time", k.alias("k"), F.to_json(F.struct("run_id", k.alias("k"))).alias("report"))


@query(
    "dict_version_history",
    with_views("version_log") + "SELECT run_id, md5_hash, recorded_at FROM version_log WHERE dict_file = 'dict/src1-en.xlsx' ORDER BY recorded_at DESC LIMIT 10",
)
def dict_version_history(spark, sf):
    return history.version_history(view(spark, sf, "version_log"), "dict/src1-en.xlsx")


@query(
    "settings_upsert",
    with_views("setting_log") + """, alive AS (SELECT key, max(CASE WHEN value IS NULL THEN updated_at END) AS deleted_at FROM setting_log GROUP BY key
HAVING bool_and(true) AND arg_max(coalesce(value, '<deleted>'), updated_at) <> '<deleted>'),
kept AS (SELECT l.* FROM setting_log l JOIN alive a ON l.key = a.key WHERE a.deleted_at IS NULL OR l.updated_at > a.deleted_at),
firsts AS (SELECT key, min(updated_at) AS u FROM kept GROUP BY key)
SELECT k.key, arg_max(k.value, k.updated_at) AS value, max(CASE WHEN k.updated_at = f.u THEN k.description END) AS description, max(k.updated_at) AS updated_at
FROM kept k JOIN firsts f ON k.key = f.key GROUP BY k.key""",
)
def settings_upsert(spark, sf):
    return history.current_settings(view(spark, sf, "setting_log"))


@query(
    "fn_duration_text",
    """SELECT event_id, CASE WHEN value < 60 THEN printf('%.1f秒', value) ELSE printf('%d分%.0f秒', cast(floor(value / 60) AS int), value % 60) END AS duration FROM events""",
)
def fn_duration_text(spark, sf):
    return table(spark, sf, "events").select("event_id", duration_text("value").alias("duration"))


@query(
    "fn_path_label",
    r"""SELECT page_id, base, regexp_replace(base, '^(.+)\.[^.]+$', '\1') AS stem,
CASE WHEN length(url) > 30 THEN concat('...', right(url, 27)) ELSE url END AS short
FROM (SELECT page_id, url, list_extract(string_split(url, '/'), -1) AS base FROM pages) p""",
)
def fn_path_label(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", base_name("url").alias("base"), file_stem("url").alias("stem"), short_path("url").alias("short")
    )
