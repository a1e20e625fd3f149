"""Run summaries: statistics table, totals, status, result level, JSON report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sql_text
from ..labels import PARTNER, PRIMARY, VENDOR
from .run import (
    CROSS_DEDUP,
    DICT_CHECK,
    DICT_ENCODE,
    FIELD_RULES,
    INTERNAL_DEDUP,
    LOAD,
    PROBLEM_CODES,
    ListRun,
    run_facts,
    stage_counts,
)

# Display names of lists, states and stages.
LIST_NAMES = {PRIMARY: "一线", PARTNER: "三方", VENDOR: "HW"}
STATUS_NAMES = {"completed": "已完成", "failed": "失败", "running": "处理中"}
STAGE_NAMES = {
    LOAD: "文件加载",
    FIELD_RULES: "字段合规检查",
    CROSS_DEDUP: "跨名单去重",
    DICT_ENCODE: "数据字典上码",
    DICT_CHECK: "字典值校验",
    INTERNAL_DEDUP: "名单内部去重",
}
SUMMARY_ORDER = (LOAD, FIELD_RULES, CROSS_DEDUP, DICT_ENCODE, DICT_CHECK, INTERNAL_DEDUP)


PROBLEMS = "rule_problems + dict_problems"


def display_status(status: str | None = None) -> str:
    """SQL of a status that is already final, else completed without problems, failed with some."""
    if status in ("completed", "failed"):
        return sql_text(status)
    return f"case when {PROBLEMS} = 0 then 'completed' else 'failed' end"


def result_level(
    facts: DataFrame, status: str = "completed", message: str = "", target: str = "目标系统"
) -> DataFrame:
    """Level (error, warning, success) and text of a run from its facts row."""
    if status == "failed":
        level, text = "'error'", sql_text(f"失败: {message}")
    else:
        some = sql_text(f" 条问题，建议修复后再上传 {target}")
        none = sql_text(f"成功: 处理完成，结果可直接编辑后，上传 {target}")
        level = f"case when {PROBLEMS} > 0 then 'warning' else 'success' end"
        text = (
            f"case when {PROBLEMS} > 0 then concat('成功: 发现 ', cast({PROBLEMS} as string), {some}) "
            f"else {none} end"
        )
    return facts.selectExpr(f"{PROBLEMS} as problems", f"{level} as level", f"{text} as message")


def summary_table(
    run: ListRun,
    list_key: str = PRIMARY,
    status: str | None = None,
    start: str | None = None,
    end: str | None = None,
    dict_version: str | None = None,
    dict_file: str | None = None,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Statistics of one list as (pos, statistic, value) rows, in display order.

    ``start`` and ``end`` are ISO timestamps. Stage rows appear only for stages that counted
    something, the histogram only when there are rule errors.
    """
    facts = run_facts(run) if facts is None else facts
    label = LIST_NAMES[list_key]
    entries: list[tuple[str, str, str]] = []

    def put(title: str, value: str, shown: str = "true") -> None:
        entries.append((sql_text(title), value, shown))

    names = ", ".join(f"'{k}', {sql_text(v)}" for k, v in STATUS_NAMES.items())
    put("名单类型", sql_text(label))
    put("处理状态", f"map({names})[{display_status(status)}]")
    if start and end:
        micros = f"unix_micros(timestamp {sql_text(end)}) - unix_micros(timestamp {sql_text(start)})"
        put("处理耗时(秒)", f"format_number(({micros}) / 1e6D, '0.00')")
    put("开始时间", sql_text(start or ""))
    put("结束时间", sql_text(end or ""))
    put(f"{label} 原始记录数", f"{list_key}_rows")
    put(f"{label} 处理后记录数", f"{list_key}_rows")
    counts = stage_counts(run)
    for stage in (s for s in SUMMARY_ORDER if s in counts):
        success, fail, skip = counts[stage]
        some = f"({success} <> 0 or {fail} <> 0 or {skip} <> 0)"
        put(f"{STAGE_NAMES[stage]} 成功数", success, some)
        put(f"{STAGE_NAMES[stage]} 失败数", fail, some)
        put(f"{STAGE_NAMES[stage]} 跳过数", skip, f"{skip} <> 0")
    if list_key == PRIMARY:
        put("错误类型分布", "''", "rule_problems > 0")
        for code in sorted(PROBLEM_CODES):
            put(f"  {code}", code, f"{code} > 0")
    if dict_version is not None:
        put("字典版本", sql_text(dict_version))
        put("字典文件", sql_text(dict_file or "未知"))
    if run.key:
        put("去重字段", sql_text(run.key))
        if run.ran(INTERNAL_DEDUP):
            put("去重原始数", "original_rows")
            put("去重重复数", "repeat_rows")
            put("去重未知数（空值）", "unknown_rows")
    lines = [
        f"case when {shown} then struct({pos} as pos, {title} as statistic, cast({value} as string) as value) end"
        for pos, (title, value, shown) in enumerate(entries)
    ]
    return facts.selectExpr(f"inline(array_compact(array({', '.join(lines)})))")


def run_totals(run: ListRun, facts: DataFrame | None = None) -> DataFrame:
    """Totals over lists and stages.

    ``sum_success`` and ``sum_fail`` add up all stages (a row counts once per stage), the other
    columns are true row counts.
    """
    facts = run_facts(run) if facts is None else facts
    counts = stage_counts(run).values()
    return facts.selectExpr(
        " + ".join(f"({success})" for success, _, _ in counts) + " as sum_success",
        " + ".join(f"({fail})" for _, fail, _ in counts) + " as sum_fail",
        "primary_rows + partner_rows + vendor_rows as input_rows",
        f"{PROBLEMS} as problems",
        "repeat_rows as rejected_rows",
    )


def run_report(run: ListRun, facts: DataFrame | None = None) -> DataFrame:
    """Stage states and counts of a run as one JSON text."""
    facts = run_facts(run) if facts is None else facts
    states = F.create_map(*[F.lit(x) for s in run.stages for x in (s.stage, s.status)])
    return facts.select(
        F.to_json(
            F.struct(
                F.expr(display_status("failed" if run.failed else None)).alias("status"),
                F.lit(run.key).alias("key"),
                states.alias("stages"),
                F.struct("*").alias("counts"),
            )
        ).alias("report")
    )
