import pytest
from helpers import one_column, plan_text, values
from pyspark.sql import functions as F

from rollcall.labels import DEFAULT_LABELS as L
from rollcall.operators import lookup, dedup, keys, match
from rollcall.operators.lookup import hot_keys, lookup_join
from rollcall.operators.rules import is_valid


def keyed(spark, cells, **extra):
    rows = spark.createDataFrame([(i + 1, c) for i, c in enumerate(cells)], "_row_num long, email string")
    for name, value in extra.items():
        rows = rows.withColumn(name, value)
    return rows


@pytest.mark.parametrize("strategy", ["salted", "join"])
def test_marks(spark, strategy):
    marked = dedup.dedup_mark(keyed(spark, ["a", "b", "a", None, "A ", "", "", None, "a"]), "email", strategy=strategy)
    assert one_column(marked, L.dedup) == ["原始", "原始", "重复", "未知", "原始", "原始", "重复", "未知", "重复"]
    assert one_column(marked, L.occurrences) == [3, 1, 3, 2, 1, 2, 2, 2, 3]
    assert one_column(marked, L.dup_key) == ["a", "b", "a", None, "A ", "", "", None, "a"]


def test_normalized_marks(spark):
    marked = dedup.dedup_mark(keyed(spark, ["a", " A　", "", None, "b"]), "email", normalize=True)
    assert one_column(marked, L.dedup) == ["原始", "重复", "未知", "未知", "原始"]


def test_only_valid_rows_take_part(spark):
    rows = keyed(spark, ["a", "a", "a", None]).withColumn(
        L.rule_status, F.when(F.col("_row_num") == 1, "不通过").otherwise("通过")
    )
    marked = dedup.dedup_mark(rows, "email")
    assert one_column(marked, L.dedup) == ["跳过", "原始", "重复", "未知"]
    assert one_column(marked, L.occurrences) == [0, 2, 2, 1]
    assert one_column(marked, L.dup_key) == [None, "a", "a", None]
    both = rows.withColumn(L.dict_status, F.when(F.col("_row_num") == 2, "不通过").otherwise("通过"))
    assert one_column(dedup.dedup_mark(both, "email"), L.dedup) == ["跳过", "跳过", "原始", "未知"]
    assert one_column(dedup.dedup_mark(rows.drop(L.rule_status).withColumn(L.dict_status, F.lit("不通过")), "email"), L.dedup) == ["跳过"] * 4


def skewed(spark, n=30_000):
    """A third of the rows share one key, a third have none."""
    key = F.when(F.col("id") % 3 == 0, "hot@x.cn").when(F.col("id") % 3 == 1, None).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 997).cast("string"))
    )
    return spark.range(n).select((F.col("id") + 1).alias("_row_num"), key.alias("email"))


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    """Forces the shuffled and salted form of the joins."""
    monkeypatch.setattr(lookup, "SMALL_BYTES", -1)
    monkeypatch.setattr(lookup, "TARGET_ROWS", 300)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_properties_under_skew(spark, no_broadcast):
    rows = skewed(spark)
    marked = dedup.dedup_mark(rows, "email")
    assert marked.count() == rows.count()
    per_key = marked.filter("email is not null").groupBy("email").agg(
        F.count_if(F.col(L.dedup) == "原始").alias("firsts"),
        F.count(F.lit(1)).alias("n"),
        F.max(L.occurrences).alias("said"),
        F.min("_row_num").alias("first"),
        F.min(F.when(F.col(L.dedup) == "原始", F.col("_row_num"))).alias("marked"),
    )
    assert per_key.filter("firsts <> 1 or n <> said or first <> marked").count() == 0
    total = marked.filter(F.col(L.dedup) == "原始").agg(F.sum(L.occurrences)).first()[0]
    assert total == rows.filter("email is not null").count()
    again = dedup.dedup_mark(rows.repartition(5), "email")
    assert values(again) == values(marked)


def test_hot_key_is_spread(spark, no_broadcast):
    """After the shuffle no partition holds much more than its share of a skewed list."""
    rows = skewed(spark, 60_000)
    table = match.key_set(rows, "email").withColumn("hit", F.lit(True))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = lookup_join(rows, table, F.lower("email"), "match_key", F.col("_row_num"), small_bytes=0, target=1_000)
        sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 60_000 and max(sizes) < 2 * 60_000 / 8
    assert joined.filter("hit").count() == 40_000


def test_salts_grow_with_the_rows_of_a_key_and_no_key_is_left_out(spark):
    counts = spark.createDataFrame([(f"k{i}", 50 + i) for i in range(200)] + [("hot", 10_000), ("cold", 5)], "k string, n long")
    salts = {r[0]: r[1] for r in hot_keys(counts, "k", "n", target=50).collect()}
    assert salts["hot"] == 200 and "cold" not in salts and len(salts) == 200
    assert {r[1] for r in hot_keys(counts, "k", "n", target=5_000).collect()} == {2}


def test_many_hot_keys_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(lookup, "MOST_HOT", 10)
    counts = spark.createDataFrame([(f"k{i}", 50 + i) for i in range(200)] + [("hot", 10_000)], "k string, n long")
    found = {r[0] for r in hot_keys(counts, "k", "n", target=20).collect()}
    assert "hot" in found and len(found) <= 10


@pytest.mark.parametrize("small", [0, None])
def test_equal_rows_without_numbers_keep_their_count(spark, small):
    rows = spark.createDataFrame([("a", 1)] * 300 + [("b", 1), (None, 1)], "email string, v int")
    table = spark.createDataFrame([("a", True)], "match_key string, hit boolean")
    joined = lookup_join(rows, table, F.col("email"), "match_key", F.monotonically_increasing_id(), small_bytes=small, target=20)
    assert joined.groupBy("email", "hit").count().orderBy("email").collect() == [(None, None, 1), ("a", True, 300), ("b", None, 1)]


def test_lookup_without_any_key(spark):
    rows = keyed(spark, [None, None])
    table = spark.createDataFrame([], "k string, v int")
    assert values(lookup_join(rows, table, F.col("email"), "k", F.col("_row_num"))) == [(1, None, None), (2, None, None)]


def test_groups_and_first_rows(spark):
    rows = keyed(spark, ["a", " A", "b", "", "", None, "c", "C "])
    assert values(dedup.duplicate_groups(rows, "email"), "_row_num", L.dup_key, L.occurrences, L.dedup) == [
        (1, "a", 2, "原始"), (2, "a", 2, "重复"), (7, "c", 2, "原始"), (8, "c", 2, "重复"),
    ]
    marked = dedup.dedup_mark(rows, "email", normalize=True)
    assert values(dedup.first_rows(marked), "_row_num") == [(1,), (3,), (7,)]
    assert values(dedup.repeated_rows(marked), "_row_num") == [(2,), (8,)]


def test_metrics_of_empty_list(spark):
    marked = dedup.dedup_mark(keyed(spark, [None]).filter("false"), "email")
    assert values(dedup.dedup_metrics(marked)) == [(0, 0, 0, 0, "0.0%")]


def test_plans_have_no_single_task_and_no_cross_join(spark, no_broadcast):
    rows = skewed(spark)
    text = plan_text(dedup.dedup_mark(rows, "email").select("_row_num", L.dedup))
    assert "Window" not in text and "Cartesian" not in text and "NestedLoop" not in text and "Python" not in text
    plain = plan_text(dedup.dedup_mark(rows, "email", strategy="join").select("_row_num", L.dedup))
    assert "SinglePartition" not in plain


def test_a_small_group_table_leaves_the_list_unshuffled(spark, folder):
    """Groups are made and measured once; the list itself is then neither shuffled nor sorted."""
    skewed(spark).write.parquet(folder + "/list")
    text = plan_text(dedup.dedup_mark(spark.read.parquet(folder + "/list"), "email"))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text and "Aggregate" not in text


def test_flags(spark):
    primary = keyed(spark, ["a@x.cn", "B@x.cn ", None, ""]).withColumn(
        L.rule_status, F.when(F.col("_row_num") == 1, "不通过").otherwise("通过")
    )
    partner = keyed(spark, ["A@X.CN", "\tb@X.cn", None, "", "b@x.cn", "z"])
    flagged = match.flag_partner(partner, primary, "email")
    assert one_column(flagged, L.in_primary) == ["否", "是", "否", "否", "是", "否"]
    vendor = keyed(spark, ["z", "b@x.cn", "q", None])
    double = match.flag_vendor(vendor, primary, partner, "email")
    assert one_column(double, L.in_primary) == ["否", "是", "否", "否"]
    assert one_column(double, L.in_partner) == ["是", "是", "否", "否"]
    assert values(match.match_summary({"p": flagged, "v": double})) == [("p", 6, 2, 0, 4), ("v", 4, 1, 2, 3)]
    assert match.new_rows(flagged).count() + match.overlap_rows(flagged).count() == 6


def test_flag_with_empty_reference_and_without_row_numbers(spark):
    rows = keyed(spark, ["a", None]).drop("_row_num")
    nothing = keyed(spark, ["a"]).filter("false")
    assert values(match.flag_membership(rows, "email", nothing, "email", "f"), "f") == [("否",), ("否",)]


def test_flags_under_skew(spark, no_broadcast):
    rows = skewed(spark)
    reference = keyed(spark, ["HOT@x.cn", "k1", "none"])
    flagged = match.flag_membership(rows, "email", reference, "email", "f")
    assert flagged.count() == rows.count()
    assert flagged.filter("f = '是'").count() == rows.filter("email in ('hot@x.cn', 'k1')").count()


@pytest.mark.parametrize(
    "columns,configured,engine,interactive",
    [
        (["姓名", "邮箱", "手机号"], ["手机号"], "手机号", "姓名"),
        (["name", "Work E-Mail", "MyEmail"], [], "MyEmail", "MyEmail"),
        (["name", "Mail2"], ["x"], "Mail2", "Mail2"),
        (["name", "Telephone"], [], None, "Telephone"),
        (["姓名", "UID"], [], None, "UID"),
        ([], [], None, None),
    ],
)
def test_key_choice(columns, configured, engine, interactive):
    assert keys.resolve_key(columns, configured) == engine
    assert keys.resolve_key(columns, policy="interactive") == interactive


def test_stored_markers_leave_rows_out_in_the_scan(spark, folder):
    rows = [(i, f" K{i % 7}@x " if i % 5 else None, (L.passed, L.failed, None)[i % 3]) for i in range(60)]
    spark.createDataFrame(rows, f"{L.row_num} long, email string, `{L.rule_status}` string").write.parquet(folder + "/list")
    listed = spark.read.parquet(folder + "/list")
    others = spark.createDataFrame([(i, f"k{i % 9}@X") for i in range(20)] + [(20, None)], f"{L.row_num} long, email string")
    assert values(dedup.dedup_mark(listed, "email", stored=True)) == values(dedup.dedup_mark(listed, "email"))
    assert values(match.flag_partner(others, listed, "email", stored=True)) == values(match.flag_partner(others, listed, "email"))
    for partner in (others.limit(9), None):
        want = match.flag_vendor(others, listed, partner, "email")
        assert values(match.flag_vendor(others, listed, partner, "email", stored=True)) == values(want)
    pushed = f"EqualTo({L.rule_status},{L.passed})"
    assert pushed in plan_text(dedup.key_groups(listed, "email", stored=True)).replace("`", "")
    assert pushed in plan_text(match.key_set(listed, "email", is_valid(listed.columns), stored=True)).replace("`", "")
