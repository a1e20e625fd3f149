"""Queries of in-list de-duplication."""

from __future__ import annotations

from rollcall.labels import DEFAULT_LABELS as L
from rollcall.operators import dedup

from .registry import query
from .rule_queries import marked_cte, marked_primary
from .views import view, with_views

BASE = with_views("primary_list")
MARK_COLUMNS = ("_row_num", "email", L.dedup, L.dup_key, L.occurrences)


def dedup_select(source: str, key: str = "email", taking_part: str = "true") -> str:
    """Marks by window functions; rows that do not take part form a partition of their own."""
    return f"""SELECT *, CASE WHEN NOT part THEN '跳过' WHEN dk IS NULL THEN '未知'
  WHEN _row_num = min(_row_num) OVER (PARTITION BY part, dk) THEN '原始' ELSE '重复' END AS mark,
  CASE WHEN part THEN dk END AS dup_key,
  cast(CASE WHEN part THEN count(*) OVER (PARTITION BY part, dk) ELSE 0 END AS int) AS occurrences
FROM (SELECT *, {taking_part} AS part, {key} AS dk FROM {source}) x"""


MARK_SQL = 'mark AS "_内部去重结果", dup_key AS "_重复键值", occurrences AS "_出现次数"'
ALL_MARKED = BASE + ", d AS (" + dedup_select("primary_list") + ")"
VALID_MARKED = BASE + ", " + marked_cte() + ", d AS (" + dedup_select("marked", taking_part="(status = '通过')") + ")"


def marked_all(spark, sf, **options):
    return dedup.dedup_mark(view(spark, sf, "primary_list"), "email", **options)


@query("dedup_mark", ALL_MARKED + f" SELECT _row_num, email, {MARK_SQL} FROM d")
def dedup_mark(spark, sf):
    return marked_all(spark, sf).select(*MARK_COLUMNS)


@query("dedup_mark_agg_join", ALL_MARKED + f" SELECT _row_num, email, {MARK_SQL} FROM d")
def dedup_mark_agg_join(spark, sf):
    return marked_all(spark, sf, strategy="join").select(*MARK_COLUMNS)


@query(
    "dedup_mark_normalized",
    BASE + ", d AS (" + dedup_select("primary_list", "nullif(lower(trim(email)), '')") + f") SELECT _row_num, email, {MARK_SQL} FROM d",
)
def dedup_mark_normalized(spark, sf):
    return marked_all(spark, sf, normalize=True).select(*MARK_COLUMNS)


@query("dedup_counts", ALL_MARKED + ' SELECT dup_key AS "_重复键值", mark AS "_内部去重结果", count(*) AS n, max(occurrences) AS "_出现次数" FROM d GROUP BY dup_key, mark')
def dedup_counts(spark, sf):
    from pyspark.sql import functions as F

    marked = marked_all(spark, sf)
    return marked.groupBy(L.dup_key, L.dedup).agg(
        F.count(F.lit(1)).alias("n"), F.max(L.occurrences).alias(L.occurrences)
    )


@query("dedup_mark_valid_only", VALID_MARKED + f" SELECT _row_num, email, {MARK_SQL} FROM d")
def dedup_mark_valid_only(spark, sf):
    return dedup.dedup_mark(marked_primary(spark, sf), "email").select(*MARK_COLUMNS)


@query("dedup_rejected", VALID_MARKED + f" SELECT _row_num, name, email, {MARK_SQL} FROM d WHERE mark = '重复'")
def dedup_rejected(spark, sf):
    marked = dedup.dedup_mark(marked_primary(spark, sf), "email")
    return dedup.repeated_rows(marked).select("_row_num", "name", *MARK_COLUMNS[1:])


@query("dedup_keep_first", ALL_MARKED + " SELECT _row_num, name, email FROM d WHERE mark = '原始'")
def dedup_keep_first(spark, sf):
    return dedup.first_rows(marked_all(spark, sf)).select("_row_num", "name", "email")


@query(
    "dedup_metrics",
    VALID_MARKED + """ SELECT count(*) FILTER (WHERE mark = '原始') AS original_rows, count(*) FILTER (WHERE mark = '重复') AS repeat_rows,
count(*) FILTER (WHERE mark = '未知') AS unknown_rows, count(*) FILTER (WHERE mark = '跳过') AS skipped_rows,
printf('%.1f%%', count(*) FILTER (WHERE mark = '重复') * 100.0 / count(*) FILTER (WHERE mark IN ('原始', '重复'))) AS repeat_rate FROM d""",
)
def dedup_metrics(spark, sf):
    return dedup.dedup_metrics(dedup.dedup_mark(marked_primary(spark, sf), "email"))


@query(
    "duplicate_groups",
    BASE + ", d AS (" + dedup_select("primary_list", "nullif(lower(trim(email)), '')")
    + f") SELECT _row_num, {MARK_SQL} FROM d WHERE occurrences > 1 AND dk IS NOT NULL",
)
def duplicate_groups(spark, sf):
    return dedup.duplicate_groups(view(spark, sf, "primary_list"), "email")


@query("distinct_rows", with_views("partner_list") + " SELECT DISTINCT kind, email FROM partner_list")
def distinct_rows(spark, sf):
    return dedup.distinct_rows(view(spark, sf, "partner_list").drop("_row_num"))
