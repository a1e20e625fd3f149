"""Queries of cross-list matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.functions.text import match_key
from rollcall.labels import DEFAULT_LABELS as L
from rollcall.operators import match
from rollcall.operators.rules import FieldRule, FieldSpec, is_valid, mark_rules

from .registry import query
from .rule_queries import marked_cte, marked_primary
from .views import view, with_views

KEY = "nullif(lower(trim(email)), '')"
BASE = with_views("primary_list", "partner_list", "vendor_list") + ", " + marked_cte() + f""",
pk AS (SELECT DISTINCT {KEY} AS k FROM marked WHERE status = '通过' AND {KEY} IS NOT NULL),
sk AS (SELECT DISTINCT {KEY} AS k FROM partner_list WHERE {KEY} IS NOT NULL),
partner_flagged AS (SELECT p.*, CASE WHEN pk.k IS NULL THEN '否' ELSE '是' END AS in_primary
  FROM partner_list p LEFT JOIN pk ON lower(trim(p.email)) = pk.k),
vendor_flagged AS (SELECT v.*, CASE WHEN pk.k IS NULL THEN '否' ELSE '是' END AS in_primary,
  CASE WHEN sk.k IS NULL THEN '否' ELSE '是' END AS in_partner
  FROM vendor_list v LEFT JOIN pk ON lower(trim(v.email)) = pk.k LEFT JOIN sk ON lower(trim(v.email)) = sk.k)
"""


def partner_flagged(spark, sf):
    return match.flag_partner(view(spark, sf, "partner_list"), marked_primary(spark, sf), "email")


def vendor_flagged(spark, sf):
    return match.flag_vendor(
        view(spark, sf, "vendor_list"), marked_primary(spark, sf), view(spark, sf, "partner_list"), "email"
    )


@query("key_set", BASE + "SELECT k AS match_key FROM pk")
def key_set(spark, sf):
    marked = marked_primary(spark, sf)
    return match.key_set(marked, "email", where=is_valid(marked.columns))


@query("flag_partner_in_primary", BASE + 'SELECT _row_num, kind, email, in_primary AS "是否已在一线名单" FROM partner_flagged')
def flag_partner_in_primary(spark, sf):
    return partner_flagged(spark, sf)


@query(
    "flag_vendor_double",
    BASE + 'SELECT _row_num, name, email, in_primary AS "是否已在一线名单", in_partner AS "是否已在三方名单" FROM vendor_flagged',
)
def flag_vendor_double(spark, sf):
    return vendor_flagged(spark, sf)


@query(
    "flag_vendor_without_partner",
    BASE + 'SELECT _row_num, name, email, in_primary AS "是否已在一线名单" FROM vendor_flagged',
)
def flag_vendor_without_partner(spark, sf):
    return match.flag_vendor(view(spark, sf, "vendor_list"), marked_primary(spark, sf), None, "email")


@query("flag_empty_reference", BASE + "SELECT _row_num, kind, email, '否' AS \"是否已在一线名单\" FROM partner_list")
def flag_empty_reference(spark, sf):
    """No primary row is valid when a required column is absent: the reference set is empty."""
    nothing_valid = mark_rules(
        view(spark, sf, "primary_list"), FieldSpec.of([FieldRule("region_label", required=True)])
    )
    return match.flag_partner(view(spark, sf, "partner_list"), nothing_valid, "email")


@query(
    "match_summary",
    BASE + """SELECT 'partner' AS list, count(*) AS total_rows, count(*) FILTER (WHERE in_primary = '是') AS in_primary,
cast(0 AS bigint) AS in_partner, count(*) FILTER (WHERE in_primary = '否') AS new_rows FROM partner_flagged
UNION ALL SELECT 'vendor', count(*), count(*) FILTER (WHERE in_primary = '是'), count(*) FILTER (WHERE in_partner = '是'),
count(*) FILTER (WHERE in_primary = '否') FROM vendor_flagged""",
)
def match_summary(spark, sf):
    return match.match_summary({"partner": partner_flagged(spark, sf), "vendor": vendor_flagged(spark, sf)})


@query("partner_new_only", BASE + "SELECT _row_num, kind, email FROM partner_flagged WHERE in_primary = '否'")
def partner_new_only(spark, sf):
    return match.new_rows(partner_flagged(spark, sf)).drop(L.in_primary)


@query("partner_overlap", BASE + "SELECT _row_num, kind, email FROM partner_flagged WHERE in_primary = '是'")
def partner_overlap(spark, sf):
    return match.overlap_rows(partner_flagged(spark, sf)).drop(L.in_primary)


@query(
    "membership_count",
    with_views("partner_list", "vendor_list")
    + f"SELECT count(*) AS n FROM partner_list WHERE {KEY} IN (SELECT {KEY} FROM vendor_list WHERE {KEY} IS NOT NULL)",
)
def membership_count(spark, sf):
    partner, vendor = view(spark, sf, "partner_list"), view(spark, sf, "vendor_list")
    counted = partner.groupBy(match_key("email").alias("match_key")).agg(F.count(F.lit(1)).alias("n"))
    hits = counted.join(match.key_set(vendor, "email"), "match_key", "left_semi")
    return hits.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
