"""Names and marker values that appear in result tables.

Every operator takes a ``Labels`` instance, so a deployment can rename columns or
translate values without touching the operators.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Labels:
    # Generated column names and marker texts of the result tables.
    source: str = "_来源"
    row_num: str = "_row_num"
    rule_status: str = "合规检查_状态"
    rule_count: str = "合规检查_错误数"
    rule_types: str = "合规检查_错误类型"
    code_suffix: str = "_Code"
    dict_status: str = "字典校验_状态"
    dict_count: str = "字典校验_错误数"
    dedup: str = "_内部去重结果"
    dup_key: str = "_重复键值"
    occurrences: str = "_出现次数"
    in_primary: str = "是否已在一线名单"
    in_partner: str = "是否已在三方名单"

    passed: str = "通过"
    failed: str = "不通过"
    original: str = "原始"
    repeat: str = "重复"
    unknown: str = "未知"
    skipped: str = "跳过"
    yes: str = "是"
    no: str = "否"
    unmatched: str = "未匹配"
    absent_value: str = "(字段缺失)"
    blank_value: str = "(空值)"
    generated: str = "系统生成"

    def is_generated(self, column: str) -> bool:
        """True for columns the engine adds (as opposed to columns of the input list)."""
        return (
            column.startswith("_")
            or column.endswith(self.code_suffix)
            or column in (self.in_primary, self.in_partner)
        )


DEFAULT_LABELS = Labels()

PRIMARY, PARTNER, VENDOR = "primary", "partner", "vendor"
LIST_KEYS = (PRIMARY, PARTNER, VENDOR)
