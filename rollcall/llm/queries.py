"""Every operator as a query over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import counts, exact, jaccard, leaks, mixing, phrases, quality, scoring, sharding, spelling, suffixes, urls, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
SHARDS = 8
MIX_SEED = 17
QUALITY_CUT = 0.3

#: Fixed values of the rule query.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def _query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query(
    "op2_poisson_mix",
    f"""
WITH RECURSIVE sizes AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, pow(n, 0.5) / (SELECT sum(pow(n, 0.5)) FROM sizes) * (SELECT sum(n) FROM sizes) / n AS rate FROM sizes),
steps(source, rate, k, term, total) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, term * rate / (k + 1), total + term * rate / (k + 1) FROM steps WHERE k < 60),
drawn AS (
  SELECT doc_id, source, (('0x' || substr(md5('{MIX_SEED}:' || doc_id::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM documents),
copies AS (
  SELECT d.doc_id, d.source, count(*) AS n FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND s.total <= d.u
  GROUP BY d.doc_id, d.source)
SELECT doc_id, source, unnest(range(n))::INTEGER AS mix_copy FROM copies
""",
)
def op2_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    mixed = mixing.poisson_mix(docs, mixing.source_rates(docs), seed=MIX_SEED)
    return mixed.select("doc_id", "source", "mix_copy")


def held_out(part: int):
    """Whether the CRC-32 of the document's id, as text, leaves no rest."""
    return F.crc32(F.col("doc_id").cast("string")) % part == 0


def fitted_quality(docs: DataFrame, labels: DataFrame) -> quality.QualityModel:
    """Learned from the labels of rows that are not held out."""
    return quality.learn_quality(docs, labels.filter(~held_out(5)))


@_query("op1_subword_quality")
def op1_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fitted_quality(docs, _table(spark, sf_dir, "labels"))
    return quality.score_quality(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(5).alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted")
    )


@_query(
    "op3_signature_join",
    r"""
WITH RECURSIVE low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^ 	-
]+') AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[p:p + 4], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS p FROM low WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM low
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(z.n), 0)::BIGINT AS n_shingles, min(r.root) AS component_id
FROM reach r LEFT JOIN sizes z ON z.doc_id = r.doc_id GROUP BY r.doc_id
""",
)
def op3_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


@_query("op4_differencing_shards")
def op4_differencing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    crc = F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32")
    sharded = sharding.shard_documents(docs.select("doc_id", "text", crc), SHARDS, carry=["text_crc32"])
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_query(
    "op5_prefix_decontamination",
    """
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[p:p + least(len(words), 10) - 1], ' ') AS w
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS p FROM item_words WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT l.doc_id, s.n, unnest(range(1, len(l.words) - s.n + 2)) AS p, l.words FROM low l JOIN sizes s ON len(l.words) >= s.n),
hits AS (
  SELECT p.doc_id, p.p, p.n, w.item_id FROM places p JOIN windows w ON p.n = w.n AND array_to_string(p.words[p.p:p.p + p.n - 1], ' ') = w.w),
hit_words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS listed
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT l.doc_id, len(l.words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM low l LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
""",
)
def op5_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = leaks.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


@_query(
    "op6_url_rules",
    """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
hosts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
rules(rhost, rpath, verdict) AS (VALUES """
    + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    + """),
ranked AS (
  SELECT h.page_id, h.host, h.path, r.rhost || r.rpath AS rule, r.verdict,
    row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS nth
  FROM hosts h LEFT JOIN rules r
    ON (h.host = r.rhost OR suffix(h.host, '.' || r.rhost)) AND starts_with(h.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE nth = 1
""",
)
def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES]
    rules = spark.range(1).select(F.inline(F.array(*listed)))
    return urls.judge_urls(_table(spark, sf_dir, "pages"), rules)


@_query("op7_column_suffixes")
def op7_column_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@_query("op8_recurrent_scores")
def op8_recurrent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.score_texts(_table(spark, sf_dir, "documents"), ~held_out(10))
    return scored.withColumn("held_out", held_out(10))


@_query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(_table(spark, sf_dir, "documents"), VOCABULARY)


@_query(
    "op10_exact_groups",
    r"""
WITH norm AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
hashed AS (SELECT doc_id, chars, sha256(t) AS text_sha256 FROM norm),
ranked AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id FROM hashed)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
""",
)
def op10_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    digest = F.sha2(exact.without_spaces(F.col("text")), 256)
    return exact.exact_groups(docs, carry={"text_sha256": digest})


@_query(
    "op11_sorted_spelling",
    """
WITH RECURSIVE table_(list) AS (
  SELECT list_transform(range(256), lambda v: list_reduce(list_prepend(v, range(8)),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-zÀ-ÿ]{7,}')) AS run FROM documents),
counted AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, run, count(*) AS times FROM runs GROUP BY doc_id, run),
bytes AS (
  SELECT id, run, times, hex(encode(id || ':' || run)) AS x FROM counted),
hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2),
      lambda k: ('0x' || substr(x, (2 * k + 1)::BIGINT, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, list[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM bytes, table_),
slipped AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cuts AS (
  SELECT word, n, p, left(word, p - 1) || substr(word, p + 1) AS cut
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.p = b.p AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.cut = w.word
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.cut = w.word),
best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chains(word, reached) AS (
  SELECT word, word FROM formed
  UNION ALL
  SELECT c.word, f.form FROM chains c JOIN formed f ON f.word = c.reached WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.reached AS root FROM chains c JOIN formed f ON f.word = c.reached WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN roots USING (word)
""",
)
def op11_sorted_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.word_counts(_table(spark, sf_dir, "documents")))


@_query("op12_phrase_fingerprints")
def op12_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.edit_fingerprints(_table(spark, sf_dir, "documents"))


@_query("op13_polynomial_whitening")
def op13_polynomial_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return whitened.withColumn("deviation", F.col("deviation").try_cast("bigint"))


@_query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
