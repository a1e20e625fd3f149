import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rollcall.functions import checks, text

DATES = """2024-01-05 2024-1-5 2024/02/29 2023/02/29 2024.12.31 20241231 202411 2024111 2024131 20240231 20241131
31/12/2024 12/31/2024 13/13/2024 1/2/2024 2024-13-01 2024-00-10 2024-04-31 0000-01-01 0001-01-01 1900-02-29 2000-02-29
2024-02-30 24-01-01 2024-1/5 2024/1-5 n/a 2024-01-01x x2024-01-01 2024.1.1 20241 2024-01 29/02/2023 29/02/2024 02/29/2024
99999999 20242 2024012 2100-02-29 2400-02-29 0400-02-29 1/31/2024 31/1/2024 31/4/2024 4/31/2024 2024110 20241301""".split()
FORMATS = ("%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%Y%m%d", "%d/%m/%Y", "%m/%d/%Y")
DECIMALS = "1.0 .5 5. 1e5 nan 12 1.5e3 -1.5 +.5e-3 1_0.5 1__0.5 _1.5 1._5 1.5_ . 1.2.3 1,5 inf 1.5e 1.e5 -.5 1.5e1_0 0x1.8 1.5f".split()


def is_date(value):
    for form in FORMATS:
        try:
            datetime.strptime(value, form)
            return True
        except ValueError:
            pass
    return False


def is_decimal(value):
    try:
        float(value)
        return "." in value
    except ValueError:
        return False


def judged(spark, samples, test):
    frame = spark.createDataFrame([(s,) for s in samples], "v string")
    return {r["v"]: r["ok"] for r in frame.select("v", test(F.col("v")).alias("ok")).collect()}


def test_dates_agree_with_strptime(spark):
    samples = DATES + ["2024-01- 5", "2024-01-05\n", ""]
    assert judged(spark, samples, checks.date_text) == {s: is_date(s) for s in samples}


def test_every_day_of_some_years(spark):
    days = spark.sql(
        "select cast(d as string) as d from "
        "(select explode(sequence(date'1896-01-01', date'1905-01-01', interval 1 day)) as d)"
    )
    swapped = F.concat_ws("/", F.substring("d", 9, 2), F.substring("d", 6, 2), F.substring("d", 1, 4))
    bad = days.filter(
        ~checks.date_text(F.col("d")) | ~checks.date_text(F.regexp_replace("d", "-", "")) | ~checks.date_text(swapped)
    )
    assert bad.count() == 0


def test_decimals_agree_with_float(spark):
    assert judged(spark, DECIMALS, checks.decimal_text) == {s: is_decimal(s) for s in DECIMALS}


@pytest.mark.parametrize(
    "value,ok", [("12", True), ("-3", True), ("１２", True), ("12\n", False), ("1.0", False), ("+1", False), ("a1", False)]
)
def test_integers(spark, value, ok):
    assert judged(spark, [value], checks.integer_text)[value] is ok


def test_pattern_dialect():
    assert checks.search_pattern("^a$") == r"(?U)^a\z"
    assert checks.search_pattern(r"[$]\$") == r"(?U)[$]\$"
    assert checks.search_pattern("(?P<x>a)") == "(?U)(?<x>a)"
    assert checks.is_usable_pattern("a+") and not checks.is_usable_pattern("([")


def test_white_space_set(spark):
    every = [chr(c) for c in range(0x3100) if chr(c).isspace() and c not in (0x1C, 0x1D, 0x1E, 0x1F)]
    assert sorted(every) == sorted(text.WHITE_SPACE)
    frame = spark.createDataFrame([("".join(every) + "a b" + "".join(every),)], "`a.b` string")
    assert frame.select(text.utrim("a.b")).first()[0] == "a b"
    assert frame.select(text.utrim(text.col("a.b"))).first()[0] == "a b"


@pytest.mark.parametrize("value", ["it's", "back\\slash", "a\\'b", "\\d+$", "x`y", "\\\\", "多 字"])
def test_literals_survive_sql(spark, value):
    assert spark.range(1).selectExpr(f"{text.sql_text(value)} as v").first()["v"] == value


@pytest.mark.parametrize(
    "seconds,shown", [(0.0, "0.0秒"), (59.94, "59.9秒"), (60.0, "1分0秒"), (125.4, "2分5秒"), (6.25, "6.2秒"), (None, None)]
)
def test_duration(spark, seconds, shown):
    frame = spark.createDataFrame([(seconds,)], "s double")
    assert frame.select(text.duration_text("s")).first()[0] == shown


def test_percent_matches_python(spark):
    pairs = [(p, w) for w in (1, 3, 7, 16, 40, 160, 2000) for p in range(0, w + 1, max(1, w // 16))] + [(0, 0)]
    frame = spark.createDataFrame(pairs, "p long, w long")
    for r in frame.select("p", "w", text.percent_text("p", "w").alias("t")).collect():
        assert r["t"] == (f"{r['p'] / r['w'] * 100:.1f}%" if r["w"] else "0%")


@pytest.mark.parametrize(
    "path,base,stem,short",
    [
        ("/data/a.b.xlsx", "a.b.xlsx", "a.b", "/data/a.b.xlsx"),
        (".hidden", ".hidden", ".hidden", ".hidden"),
        ("/very/long/folder/name/with/file.csv", "file.csv", "file", "...g/folder/name/with/file.csv"),
        ("", "", "", "-"),
        (None, None, None, "-"),
    ],
)
def test_paths(spark, path, base, stem, short):
    frame = spark.createDataFrame([(path,)], "p string")
    got = frame.select(text.base_name("p"), text.file_stem("p"), text.short_path("p")).first()
    assert tuple(got) == (base, stem, short)
    assert short is None or len(short) <= 30


def test_named_patterns():
    email = checks.NAMED_PATTERNS["email"]
    assert re.search(email, "a.b+c@d-e.org") and not re.search(email, "a@b")
    assert checks.NAMED_PATTERNS["手机"] == checks.NAMED_PATTERNS["phone"]
