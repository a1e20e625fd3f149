"""The three lists, dictionaries, templates and logs as SQL over the given tables.

The text is plain SQL that Spark and DuckDB read alike; ``{table}`` stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from rollcall.sources.lists import spread

VIEWS = {
    # Mandatory list: one row per order, with the defects real lists have.
    "primary_list": """
SELECT o_orderkey + 1 AS _row_num,
  CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN '  '
       WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' THEN NULL
       ELSE concat('Customer ', cust) END AS name,
  CASE WHEN o_orderpriority = '2-HIGH' THEN concat(' Customer', cust, '@Example.COM ')
       WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'F' THEN concat('customer', cust, '@example')
       WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P' THEN NULL
       WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'O' THEN ''
       ELSE concat('customer', cust, '@example.com') END AS email,
  CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN concat('12', lpad(cust, 9, '0'))
       WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN concat('13', lpad(cust, 8, '0'))
       ELSE concat('13', lpad(cust, 9, '0')) END AS mobile,
  CASE WHEN o_orderpriority = '1-URGENT' THEN replace(day, '-', '/')
       WHEN o_orderpriority = '2-HIGH' THEN replace(day, '-', '.')
       WHEN o_orderpriority = '3-MEDIUM' THEN replace(day, '-', '')
       WHEN o_orderpriority = '4-NOT SPECIFIED' THEN concat(substr(day, 1, 8), '31')
       WHEN o_orderstatus = 'F' THEN 'n/a'
       WHEN o_orderstatus = 'O' THEN concat(substr(day, 9, 2), '/', substr(day, 6, 2), '/', substr(day, 1, 4))
       ELSE day END AS birthday,
  CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'P' THEN cast(cast(floor(o_totalprice) AS bigint) AS string)
       ELSE cast(o_totalprice AS string) END AS amount,
  CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN concat(cust, '.0')
       WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P' THEN concat('-', cust)
       ELSE cust END AS units,
  CASE WHEN o_orderstatus = 'F' THEN 'Finished' WHEN o_orderstatus = 'O' THEN ' OPEN' ELSE 'Pending' END AS status_label,
  substr(o_orderpriority, 3) AS priority_label,
  concat('nation_', right(cust, 2)) AS nation_label,
  concat('order ', cast(o_orderkey AS string), ' of ', day, ' with priority ', o_orderpriority,
         ' placed by customer ', cust) AS remark,
  concat(CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'O' THEN '010101' ELSE '110101' END,
         replace(day, '-', ''), '123X') AS id_card
FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, cast(o_custkey AS string) AS cust,
             cast(cast(o_orderdate AS date) AS string) AS day FROM {orders}) o
""",
    "partner_list": """
SELECT event_id + 1 AS _row_num, event_type AS kind,
  CASE WHEN event_type = 'signup' THEN concat('USER', cast(user_id AS string), '@example.com')
       WHEN event_type = 'view' THEN concat('  CUSTOMER', cast(user_id AS string), '@example.com')
       WHEN event_type = 'error' THEN NULL
       ELSE concat('customer', cast(user_id AS string), '@example.com') END AS email
FROM {events}
""",
    "vendor_list": """
SELECT c_custkey + 1 AS _row_num, c_name AS name,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN concat('vendor', cast(c_custkey AS string), '@example.com')
       WHEN c_mktsegment = 'FURNITURE' THEN concat('user', cast(c_custkey AS string), '@example.com')
       WHEN c_mktsegment = 'BUILDING' THEN ' '
       ELSE concat('CUSTOMER', cast(c_custkey AS string), '@EXAMPLE.com') END AS email
FROM {customer}
""",
    # Dictionaries of the primary list.
    "entries": """
SELECT 'nation' AS dict_id, cast(n_nationkey AS string) AS code, n_name AS label, cast(n_nationkey AS bigint) AS ord FROM {nation}
UNION ALL
SELECT 'priority', substr(o_orderpriority, 1, 1), substr(o_orderpriority, 3), cast(substr(o_orderpriority, 1, 1) AS bigint)
FROM (SELECT DISTINCT o_orderpriority FROM {orders}) p
UNION ALL
SELECT 'status', o_orderstatus,
       CASE WHEN o_orderstatus = 'F' THEN 'Finished' WHEN o_orderstatus = 'O' THEN 'Open' ELSE 'In progress' END,
       CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 2 ELSE 3 END
FROM (SELECT DISTINCT o_orderstatus FROM {orders}) s
""",
    # A catalogue of dictionaries with repeated codes and labels, one per brand.
    "catalogue": """
SELECT p_brand AS dict_id,
  CASE WHEN p_type = 'PROMO' AND p_size > 40 THEN ' ' ELSE concat(' ', cast(p_size AS string)) END AS code,
  CASE WHEN p_type = 'SMALL' AND p_size < 10 THEN NULL ELSE concat(upper(substr(p_name, 1, 1)), substr(p_name, 2), ' ') END AS label,
  p_partkey AS ord
FROM {part}
""",
    # Rows that carry codes of the catalogue.
    "coded_list": """
SELECT l_orderkey, l_partkey, concat('Brand#', cast(l_linenumber AS string)) AS dict_id,
  CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN NULL
       WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN ''
       WHEN l_returnflag = 'R' THEN concat('x', cast(cast(l_quantity AS int) AS string))
       ELSE cast(cast(l_quantity AS int) AS string) END AS code
FROM {lineitem}
""",
    # Attribute templates, one per brand.
    "template": """
SELECT p_brand AS spec_id, p_partkey AS ord,
  CASE WHEN p_size = 50 THEN NULL ELSE p_name END AS t_name,
  CASE WHEN p_size > 45 THEN NULL ELSE concat(lower(p_type), '_', cast(p_size AS string)) END AS t_code,
  CASE WHEN p_type = 'STANDARD' THEN '是' WHEN p_type = 'MEDIUM' THEN '√' WHEN p_type = 'ECONOMY' THEN '否'
       WHEN p_type = 'PROMO' THEN ' No' WHEN p_type = 'LARGE' THEN ' TRUE ' END AS t_required,
  CASE WHEN p_size < 10 THEN '20.0' WHEN p_size < 20 THEN 'abc' WHEN p_size < 30 THEN cast(p_size AS string) END AS t_length,
  CASE WHEN p_type = 'PROMO' THEN NULL ELSE concat(' ', p_type) END AS t_type,
  concat(p_name, '; ;', p_type, ' ;') AS t_values
FROM {part}
""",
    "run_log": """
SELECT concat('run-', cast(user_id AS string)) AS run_id, ts AS event_time,
  CASE WHEN event_type = 'signup' THEN 'running' WHEN event_type = 'error' THEN 'failed'
       WHEN event_type = 'purchase' THEN 'completed' END AS status,
  CASE WHEN event_type = 'purchase' THEN cast(floor(value * 100) AS bigint) END AS total_records,
  CASE WHEN event_type = 'view' THEN concat('/data/results/lists/out/', cast(event_id AS string), '/batch') END AS output_dir,
  CASE WHEN event_type = 'click' THEN props END AS summary
FROM {events}
""",
    "version_log": """
SELECT concat('run-', cast(doc_id AS string)) AS run_id, concat('dict/', source, '-', lang, '.xlsx') AS dict_file,
       md5(cast(n_chars AS string)) AS md5_hash, doc_id AS recorded_at
FROM {documents}
""",
    "current_versions": """
SELECT concat('dict/', source, '-', lang, '.xlsx') AS dict_file,
       CASE WHEN lang = 'en' THEN md5(cast(max(n_chars) AS string)) WHEN lang = 'de' THEN NULL
            ELSE md5(cast(min(n_chars) AS string)) END AS md5_hash
FROM {documents} GROUP BY source, lang
UNION ALL
SELECT 'dict/new.xlsx', md5(cast(count(*) AS string)) FROM {documents}
""",
    "setting_log": """
SELECT concat('user.', cast(user_id AS string), '.', event_type) AS key,
       CASE WHEN value < 1 THEN NULL ELSE props END AS value,
       CASE WHEN value < 5 THEN NULL ELSE concat('set by event ', cast(event_id AS string)) END AS description,
       event_id AS updated_at
FROM {events}
""",
}

_TABLE = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The list view as a lazy DataFrame."""
    text = VIEWS[name]
    used = {t: spread(table(spark, sf_dir, t)) for t in sorted(set(_TABLE.findall(text)))}
    return spark.sql(text, **used)


def with_views(*names: str) -> str:
    """``WITH`` clause that defines the views for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({_TABLE.sub(r'\1', VIEWS[n])})" for n in names) + "\n"
