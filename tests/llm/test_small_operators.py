"""Quality, mixing, sharding, URL rules, exact groups, token counts: brute force and odd input."""

import hashlib
import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rollcall.llm import counts, exact, mixing, quality, queries, sharding, urls

LONG = "word " * 60_000
ODD = [
    (1, None, "a"),
    (2, "", None),
    (3, "same text here", "a"),
    (4, "same  text\there", "a"),
    (4, "same  text\there", "a"),
    (5, "same text here", "b"),
    (None, "no id", "b"),
    (7, LONG, "b"),
    (8, "näïve ÇA 数据 text", ""),
]
SCHEMA = "doc_id bigint, text string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators also use."""
    clash = {c: F.lit(7) for c in ("score", "slot", "rows", "key", "id", "n", "block", "part", "label", "shard_", "row")}
    return spark.createDataFrame(ODD, SCHEMA).withColumns(clash)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


# quality ------------------------------------------------------------------------------------------


def test_quality_learns_held_out(spark):
    sf = "/root/testdata/sf0.01"
    scores = queries.op1_subword_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = scores.filter("held_out").select("quality", "predicted").collect()
    assert len(rows) > 50
    assert sum(r["quality"] == r["predicted"] for r in rows) / len(rows) > 0.95


def test_quality_odd_input(spark, odd, none):
    model = quality.fit_quality(quality.features_of(["good fine text", "bad*** junk***", None]), [1, 0, 1], epochs=2)
    rows = quality.score_quality(odd, model).collect()
    assert len(rows) == len(ODD) and all(0.0 <= r["score"] <= 1.0 for r in rows)
    assert len({r["score"] for r in rows if not r["text"]}) == 1
    assert quality.score_quality(none, model).collect() == []


@pytest.mark.parametrize("labels", [[], [1, 1, 1]])
def test_quality_without_two_labels_is_the_prior(odd, labels):
    model = quality.fit_quality(quality.features_of(["x"] * len(labels)), labels)
    want = (sum(labels) + 1) / (len(labels) + 2)
    assert all(abs(r["score"] - want) < 1e-6 for r in quality.score_quality(odd, model).collect())


def test_training_sample_takes_lowest_label_and_each_id_once(spark, odd):
    labels = spark.createDataFrame([(4, 1), (4, 0), (3, None), (99, 1), (None, 1)], "doc_id bigint, quality int")
    features, got = quality.unpacked(quality.training_sample(odd, labels).toPandas())
    want = quality.features_of(["same  text\there"])
    assert got == [0] and all((a == b).all() for a, b in zip(features, want))


def test_training_holds_the_sample_packed(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"good word{i} fine" if i % 2 else f"junk*** word{i}") for i in range(60)], "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    sample = quality.training_sample(docs, labels).toPandas().sort_values("id")
    want = quality.fit_quality(*quality.unpacked(sample))
    got = quality.learn_quality(docs, labels)
    assert (got.weights == want.weights).all() and got.bias == want.bias
    # The task that trains never unpacks the sample as a whole.
    monkeypatch.delattr(quality, "unpacked")
    monkeypatch.delattr(quality, "Features")
    batches = [pa.RecordBatch.from_pandas(sample[i : i + 7], preserve_index=False) for i in range(0, len(sample), 7)]
    (row,) = [r for b in quality.train_packed(iter(batches)) for r in b.to_pylist()]
    assert row == {"weights": want.weights.tobytes(), "bias": want.bias}


def test_scoring_takes_little_memory_beside_the_batch():
    texts = pa.array([" ".join(f"w{i * j % 9973}" for j in range(700)) for i in range(500)] + [None, "", LONG])
    model = quality.fit_quality(quality.features_of(["w1 w2 w3", "w4 w5 w6"]), [1, 0])
    weights = np.random.default_rng(1).normal(size=quality.BUCKETS + 1).astype(np.float32)
    tracemalloc.start()
    got = quality.scores_of(texts, weights, model.bias)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45e6  # slices of a megabyte took 80
    alone = [quality.scores_of(texts[i : i + 1], weights, model.bias)[0] for i in (0, 1, 250, 499, 500, 501, 502)]
    assert np.allclose(got[[0, 1, 250, 499, 500, 501, 502]], alone, rtol=1e-9)


# mixing -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("mean", [0.0, 0.3, 1.0, 2.5, 900.0])
def test_poisson_steps(mean):
    steps = mixing.poisson_steps(mean)
    if not mean:
        assert steps == []
        return
    assert steps == sorted(steps) and abs(steps[-1] - 1.0) < 1e-9
    assert math.isclose(steps[0], math.exp(-mean), rel_tol=1e-9, abs_tol=1e-300)


def test_mixing_follows_the_rates(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 > 0, "hot").otherwise("cold").alias("source"))
    rates = mixing.source_rates(docs, weights={"hot": 1, "cold": 1, "absent": 5})
    got = {r["source"]: r["n"] for r in mixing.poisson_mix(docs, rates).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = 20_000  # Shares count among the sources that are there.
    assert all(abs(n - want) < 5 * math.sqrt(2 * want) for n in got.values()) and set(got) == {"hot", "cold"}
    times = Counter(r["n"] for r in mixing.poisson_mix(docs, mixing.source_rates(docs)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect())
    assert times[1] > times[2] > times[3] > 0


def test_mixing_odd_input(odd, none):
    mixed = mixing.poisson_mix(odd, mixing.source_rates(odd, temperature=1.0, epochs=6.0))
    rows = mixed.collect()
    assert {r["source"] for r in rows} <= {"a", "b", "", None} and set(odd.columns) < set(mixed.columns)
    by_copy = Counter((r["doc_id"], r["mix_copy"]) for r in rows)
    assert all(n == (2 if doc == 4 else 1) for (doc, _), n in by_copy.items())
    assert mixing.poisson_mix(none, mixing.source_rates(none)).collect() == []


def test_mixing_replaces_columns_of_its_own_names(odd):
    rates = mixing.source_rates(odd, temperature=1.0, epochs=3.0)
    plain = mixing.poisson_mix(odd, rates)
    named = mixing.poisson_mix(odd.withColumns({"mix_copy": F.lit("x"), "MIX_KEY": F.lit("y")}), rates)
    assert Counter(map(tuple, named.select(plain.columns).collect())) == Counter(map(tuple, plain.collect()))
    kept = mixing.poisson_mix(odd.withColumn("mix_copy", F.lit("x")), rates, copy_column="c", key_column="k")
    assert {r["mix_copy"] for r in kept.collect()} == {"x"}


def test_mixing_without_broadcast_is_the_same(odd, monkeypatch):
    rates = mixing.source_rates(odd, temperature=1.0, epochs=40.0)
    want = Counter(map(tuple, mixing.poisson_mix(odd, rates).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert Counter(map(tuple, mixing.poisson_mix(odd, rates).collect())) == want


# sharding -----------------------------------------------------------------------------------------


def test_difference_places_every_load_once():
    loads, places = sharding.difference([[9, 0, 0], [8, 0, 0], [7, 0, 0], [6, 0, 0], [5, 0, 0], [4, 0, 0]])
    assert sorted(loads) == [13, 13, 13]
    assert all(sorted(p) == [0, 1, 2] for p in places)


def _check_shards(docs, rows, shards):
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert all(0 <= k < shards for k in by_shard)
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs)
    homes = defaultdict(set)
    for r in rows:
        homes[r["text"]].add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())


def test_shards_odd_input(odd, none):
    rows = sharding.shard_documents(odd, 3, carry=["text", "score"]).collect()
    _check_shards(odd.collect(), rows, 3)
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in rows)
    # The long text alone exceeds an even share, so it has a shard to itself.
    assert [r["doc_id"] for r in rows if r["shard"] == next(x["shard"] for x in rows if x["doc_id"] == 7)] == [7]
    assert sharding.shard_documents(none, 3).collect() == []


def test_shards_keep_columns_of_their_own_names(odd, tmp_path):
    named = odd.withColumns({"size": F.lit("s"), "Shard": F.lit("t"), "slot": F.lit("u"), "carried_size": F.lit("v")})
    out = sharding.shard_documents(named, 3, carry=[c for c in named.columns if c != "doc_id"])
    out.write.parquet(str(tmp_path / "out"))
    row = odd.sparkSession.read.parquet(str(tmp_path / "out")).first()
    assert [row[c] for c in ("carried_carried_size", "carried_Shard", "carried_slot", "carried_size")] == ["s", "t", "u", "v"]


def test_shards_are_even_over_many_blocks(spark):
    groups = spark.range(30_000).select(
        F.col("id").alias("h1"), F.lit(0).cast("bigint").alias("h2"), (F.pow("id", F.lit(1.1)).cast("bigint") + 1).alias("size")
    )
    placed = sharding.group_shards(groups, 8, block_groups=500, fan_in=10).join(groups, ["h1", "h2"])
    sums = [r["s"] for r in placed.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sums) == 8 and max(sums) - min(sums) <= 100
    assert placed.count() == 30_000


def test_bytes_of_the_query_are_even(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op4_differencing_shards(spark, sf).collect()
    sums = Counter()
    for r in rows:
        sums[r["shard"]] += r["size"]
    assert len(rows) == 1000 and max(sums.values()) - min(sums.values()) < 20


# urls ---------------------------------------------------------------------------------------------


def _judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [
        (len(h) + len(p), h, p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[1] + best[2], best[3] if best else "allow"


def test_urls_match_brute_force(spark):
    rules = [*queries.RULES, ("b.com", "", "block"), ("a.b.com", "/x", "allow"), ("com", "/x", "block"), ("com", "/x", "allow")]
    hosts = ["com", "b.com", "a.b.com", "z.a.b.com", "ab.com", "EXAMPLE.org", "x.example.org", "org", "", "b.com:80", "u@b.com", "ü.com", "com.", "..com"]
    paths = ["", "/", "/x", "/xy?q=/de/", "/de/", "/fr/1#a", "/es/", "/en/1", "?x", "#y", "/a\nb"]
    given = [f"{s}{h}{p}" for s in ("http://", "x://", "") for h in hosts for p in paths] + [None, "", "://", "a://b://c/d"]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id bigint, url string").withColumns({"host": F.lit("clash"), "rule": F.lit(1)})
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages, table).collect()}
    assert got == {i: _judge(u, rules) for i, u in enumerate(given)}


def test_urls_repeated_rows_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (1, "http://a.org/"), (None, None)], "page_id bigint, url string")
    rules = spark.createDataFrame([("org", None, "block"), (None, "/", "block")], "host string, path string, verdict string")
    assert Counter(r["verdict"] for r in urls.judge_urls(pages, rules).collect()) == {"block": 2, "allow": 1}
    assert {r["verdict"] for r in urls.judge_urls(pages, rules.limit(0), default_verdict="drop").collect()} == {"drop"}
    assert urls.judge_urls(pages.limit(0), rules).collect() == []


def test_urls_sweep_many_nested_rules_without_comparing_them(spark):
    host = F.expr("concat_ws('.', slice(array('z', 'y', 'x', concat('h', id div 4)), 4 - cast(id % 4 as int), 4), 'net')")
    rules = spark.range(100_000).select(host.alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"))
    pages = spark.range(3_000).select(
        F.col("id").alias("page_id"),
        F.expr("concat('http://', element_at(array('w.z.y.x.', 'y.x.', 'q.', ''), cast(id % 4 as int) + 1), 'h', id * 9, '.net/p')").alias("url"),
    )
    judged = urls.judge_urls(pages, rules, rows_a_lane=100)
    assert "NestedLoop" not in judged._jdf.queryExecution().toString() and "Cartesian" not in judged._jdf.queryExecution().toString()
    below = ("z.y.x.", "y.x.", "", "")
    want = {i: f"{below[i % 4]}h{i * 9}.net/" if i * 9 < 25_000 else None for i in range(3_000)}
    assert {r["page_id"]: r["rule"] for r in judged.collect()} == want


def test_urls_split_a_hot_host_and_odd_hosts_into_lanes(spark):
    rules = [("hot.net", "", "block"), ("a.hot.net", "/x", "allow"), ("net", "/x/y", "block"), ("a\x01b", "", "block"), ("a", "/x", "allow")]
    given = [f"http://{h}{p}" for h in ["hot.net"] * 60 + ["a.hot.net", "b.a.hot.net", "net", "y.a", "a\x01b", "c.a\x01b", "a.", "x" * 70_000] for p in ["/x", "/x/y", "/" + "z" * 70_000]]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id bigint, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    judged = urls.judge_urls(pages, table, rows_a_lane=7)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judged.collect()}
    assert got == {i: _judge(u, rules) for i, u in enumerate(given)}


# exact groups -------------------------------------------------------------------------------------


def test_exact_groups_odd_input(odd, none):
    rows = exact.exact_groups(odd, carry={"twice": F.length("text") * 2}).collect()
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows), key=str)
    want = [(1, 1, 2, True), (2, 1, 2, False), (3, 4, 4, False), (4, 4, 4, True), (4, 4, 4, True), (5, 4, 4, False), (7, 7, 1, True), (8, 8, 1, True), (None, None, 1, True)]
    assert got == sorted(want, key=str)
    assert exact.exact_groups(none).collect() == []


def test_exact_groups_need_the_whole_text(spark):
    start = "x" * 100
    docs = spark.createDataFrame([(1, start + "a"), (2, start + "b"), (3, start + " a")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["keep_id"] for r in exact.exact_groups(docs).collect()}
    assert got == {1: 3, 2: 2, 3: 3}


# token counts -------------------------------------------------------------------------------------


def _greedy(word, pieces):
    symbols, total = (*word, counts.END), 0
    while symbols:
        size = next((n for n in range(len(symbols), 0, -1) if symbols[:n] in pieces), 0)
        if not size:
            return 0
        symbols, total = symbols[size:], total + 1
    return total


def test_automaton_matches_greedy():
    words = ["a", "ab", "abc", "bcd", "d", "cde", "dee", "e", "b"]
    pieces = {tuple(w.encode()) for w in words} | {(*w.encode(), counts.END) for w in ("a", "de", "e", "bb")}
    built = counts.Automaton.of(sorted(pieces))
    alphabet, todo = "abcdef", [""]
    for _ in range(6):
        todo = [w + c for w in todo for c in alphabet]
        assert all(built.count(w.encode()) == _greedy(w.encode(), pieces) for w in todo)


def test_token_counts_match_greedy(spark, odd, none):
    pieces = set(counts.read_vocabulary(queries.VOCABULARY))
    texts = {r[0]: r[1] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40).collect()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    for r in counts.token_counts(docs, queries.VOCABULARY).collect():
        words = texts[r["doc_id"]].encode().lower().split()
        sizes = [_greedy(w, pieces) for w in words]
        assert (r["n_words"], r["n_tokens"], r["n_unknown"]) == (len(words), sum(sizes) + sizes.count(0), sizes.count(0))
    got = counts.token_counts(odd, queries.VOCABULARY).collect()
    assert len(got) == len(ODD)
    assert {r["n_words"] for r in got if r["doc_id"] in (1, 2)} == {0}
    assert next(r["n_words"] for r in got if r["doc_id"] == 7) == 60_000
    assert counts.token_counts(none, queries.VOCABULARY).collect() == []


def test_query_digest_is_sha256_of_normalised_text(spark):
    rows = queries.op10_exact_groups(spark, "/root/testdata/sf0.001").limit(5).collect()
    texts = {r[0]: r[1] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    for r in rows:
        assert r["text_sha256"] == hashlib.sha256("".join(texts[r["doc_id"]].split()).encode()).hexdigest()
