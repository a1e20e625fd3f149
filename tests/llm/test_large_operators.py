"""Jaccard join, decontamination, repeated strings, scoring, pipeline: brute force and odd input."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rollcall.llm import components, gru, jaccard, leaks, queries, scoring, suffixes

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau ypsilon".split()


def _texts(seed=5):
    """Random texts, near copies around the threshold, shared passages, short and odd texts."""
    draw = random.Random(seed)
    passage = " ".join(draw.choice(WORDS) for _ in range(60))
    texts = []
    for _ in range(14):
        base = [draw.choice(WORDS) for _ in range(draw.choice([12, 40, 90]))]
        texts.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for _ in range(draw.choice([0, 1, 1, 2])):
                copy[draw.randrange(len(copy))] = "x%d" % draw.randrange(10**6)
            texts.append(" ".join(copy))
    texts += [f"{t} {passage}" for t in texts[:20]] + [f"{passage} {k}" for k in range(3)]
    texts += ["", "  \t\n", "One Two", "one two", "one  two", "one two three four", "é ü ß 数", "É ü ß 数"]
    draw.shuffle(texts)
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(3 * i + 1, t, "en", "a" if i % 3 else None, len(t)) for i, t in enumerate(_texts())]
    rows += [(0, None, None, "b", None), rows[4], (10**9, "w%d " * 30_000 % tuple(range(30_000)), "en", "b", 1)]
    clash = {c: F.lit(7) for c in ("key", "id", "n", "block", "part", "label", "row", "score", "slot", "size", "shard", "mix_copy")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(clash).repartition(3)


def _plain(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def _sets(rows):
    out = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", _lower(t))
        out[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    return out


def _groups(rows):
    sets, group = _sets(rows), {}
    for i in sorted(sets):
        mine = {group[j] for j in group if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
        group[i] = min(mine | {i})
        for j, g in group.items():
            if g in mine:
                group[j] = group[i]
    return {i: (len(sets[i]), group[i]) for i in sets}


def test_jaccard_matches_brute_force(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 6)  # Chunks and pairs of chunks on a small table.
    monkeypatch.setattr(jaccard, "LEAF_DOCS", 2)
    monkeypatch.setattr(jaccard, "ID_BITS", 64)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == _groups(_plain(docs))


def test_scan_counts_frequent_shingles_in_little_memory(monkeypatch):
    class Frame:
        def mapInArrow(self, run, schema):
            return run

    draw = random.Random(1)
    texts = [" ".join(f"w{draw.randrange(6)}" if i % 2 else f"v{i}x{j}" for j in range(300)) for i in range(900)]
    monkeypatch.setattr(jaccard, "COUNTED_SHINGLES", 100_000)
    monkeypatch.setattr(jaccard, "ROW_SHINGLES", 5_000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(900), pa.int64()), pa.array(texts)], names=["id", "text"])
    rows = [r for b in jaccard._scan(Frame(), 5)(iter([batch])) for r in b.to_pylist()]
    times, held, want = Counter(), 0, Counter()
    for _, keys in jaccard.shingle_sets(batch.column("text")):
        times.update(keys.view(np.int64).tolist())
        held += len(keys)
        if held > 100_000:
            want.update({k: n for k, n in times.items() if n >= 4})
            times, held = Counter(), 0
    want.update({k: n for k, n in times.items() if n >= 4})
    assert {r["key"]: r["count"] for r in rows if r["id"] is None} == want and want
    assert [r["id"] for r in rows if r["id"] is not None] == list(range(900))
    tracemalloc.start()
    for _ in jaccard.shingle_sets(batch.column("text")):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6  # slices of a megabyte took 40


def test_packed_sets_come_back():
    hashes = np.sort(np.random.default_rng(1).integers(0, 2**63, 50, dtype=np.uint64))
    assert jaccard.unpacked_set(jaccard.packed_set(hashes)).tolist() == sorted(int(h) % 2**40 for h in hashes)


def test_partners_have_another_label_and_fit_by_size_and_order():
    """Groups of all sizes against every pair of rows; a large group is examined like a small one."""
    draw = np.random.default_rng(3)
    counts = np.array([1, 2, 3, 7, 40, 300, 1_000])
    group = np.repeat(np.arange(len(counts)), counts)
    sizes = draw.integers(1, 300, len(group))
    labels = np.where(draw.random(len(group)) < 0.9, group, draw.integers(0, 60, len(group)))
    order = np.lexsort((sizes, group))
    sizes, labels = sizes[order], labels[order]
    rests = jaccard._rest(sizes, (draw.random(len(group)) * (sizes // 4 + 1)).astype(np.int64)).astype(np.int64)
    after = np.minimum.outer(rests * sizes / 255, rests * sizes / 255) + 1e-6
    n, m = sizes[:, None], sizes[None, :]
    fits = (100 * n >= 75 * m) & (100 * m >= 75 * n) & (175 * after >= 75 * (n + m))
    want = (fits & (group[:, None] == group[None, :]) & (labels[:, None] != labels[None, :])).any(axis=1)
    got = jaccard._partnered(np.cumsum(counts) - counts, labels, sizes, rests, 75)
    assert want.any() and not want.all() and (got >= want).all()
    assert (got & ~want).sum() <= len(want) // 100  # Reach is rounded up from one byte, nothing else is let through.


def test_chunks_of_one_large_label_do_not_meet_each_other(spark):
    """5,000 documents of one component and 100 others share a shingle: rows grow with the group, not with its square."""
    rows = spark.range(5_100).select(F.lit(1).cast("bigint").alias("key"), "id", F.greatest(F.col("id"), F.lit(5_000)).alias("label"))
    blocks = jaccard._chunk_pairs(rows)
    got = [(r["block"], r["side"], r["id"], r["label"]) for r in blocks.collect()]
    assert len(got) < 4 * 5_100
    sides = {}
    for block, side, number, _ in got:
        sides.setdefault(block, ([], []))[side].append(number)
    met = set()
    for left, right in sides.values():
        met |= {(min(a, b), max(a, b)) for a in left for b in right} | {(a, b) for a in left for b in left if a < b}
    labels = [max(i, 5_000) for i in range(5_100)]
    assert {(a, b) for a in range(5_100) for b in range(5_001, 5_100) if a < b and labels[a] != labels[b]} <= met


def test_jaccard_empty(docs):
    assert jaccard.jaccard_components(docs.limit(0)).collect() == []


def test_dual_traversal_finds_all_links():
    draw = np.random.default_rng(3)
    base = [np.unique(draw.integers(0, 2**63, 40, dtype=np.uint64)) for _ in range(10)]
    sets = [np.unique(np.append(draw.choice(b, 36, replace=False), draw.integers(0, 2**63, k % 6, dtype=np.uint64))) for k, b in enumerate(base * 5)]
    want = {(i, j) for i in range(50) for j in range(i + 1, 50) if jaccard.linked(sets[i], sets[j], 75)}
    sizes, labels = np.array([len(s) for s in sets]), np.arange(50)
    bitmaps = [jaccard.signature(s) for s in sets]
    tree = jaccard.SignatureTree(bitmaps, sizes, labels, max(map(len, bitmaps)))
    assert want and want <= set(jaccard.dual_links(tree, None, 75))
    half = [jaccard.SignatureTree(bitmaps[a:b], sizes[a:b], labels[a:b], max(map(len, bitmaps))) for a, b in ((0, 25), (25, 50))]
    assert {(i, j) for i, j in want if i < 25 <= j} <= {(i, j + 25) for i, j in jaccard.dual_links(*half, 75)}


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 199), (200, 199), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {199: 199, 200: 199}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


# decontamination ----------------------------------------------------------------------------------


def _leaks(rows, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t or ""))
    windows = {}
    for item, t in items:
        w = cut(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    out = []
    for i, t in rows:
        w, hit, found = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out)


def test_leaks_match_brute_force(spark, docs):
    draw = random.Random(8)
    texts = [t for _, t in _plain(docs) if t and len(t) < 5000]
    items = [(i, " ".join(draw.choice(texts).split()[2:16]).upper()) for i in range(30)]
    items += [(30, None), (31, ""), (32, "!!"), (33, "pi"), (34, "Rho, Sigma"), (35, items[0][1]), (35, items[0][1]), (None, "tau tau")]
    table = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    got = leaks.contamination(docs, table).collect()
    items = [(i, t) for i, t in items if i is not None]
    known = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items"], r["contaminated"]) for r in leaks.contamination(docs, table.filter("item_id IS NOT NULL")).collect())
    assert known == _leaks(_plain(docs), items)
    assert len(got) == len(known)


def test_leaks_empty_tables(spark, docs):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r["contaminated"] for r in leaks.contamination(docs, items).collect())
    assert leaks.contamination(docs.limit(0), items).collect() == []


# repeated strings ---------------------------------------------------------------------------------


def _repeats(rows):
    least = {}
    for i, t in rows:
        b = t.encode()
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            least[w] = min(i, least.get(w, i))
    out = []
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot,bits", [(suffixes.HOT_PIECES, suffixes.ROW_BITS), (3, 64)])
def test_repeats_match_brute_force(docs, monkeypatch, hot, bits):
    monkeypatch.setattr(suffixes, "HOT_PIECES", hot)
    monkeypatch.setattr(suffixes, "ROW_BITS", bits)  # So few bits that rows share them.
    rows = [(r["doc_id"], r["text"] or "") for r in docs.filter("n_chars IS NULL OR n_chars <> 1").collect()]
    got = suffixes.remove_repeats(docs.filter("n_chars IS NULL OR n_chars <> 1")).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got) == _repeats(rows)


def test_repeats_long_text_null_ids_and_empty(spark, docs):
    same = "s" * 70
    rows = spark.createDataFrame([(None, same), (5, same), (5, same), (5, "t" + same), (6, "é" * 200)], "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["n_removed"]) for r in suffixes.remove_repeats(rows).collect()), key=str)
    assert got == [(5, 0), (5, 0), (5, 0), (6, 0), (None, 70)]
    assert suffixes.remove_repeats(docs.filter("n_chars = 1")).collect()[0]["n_removed"] == 0
    assert suffixes.remove_repeats(docs.limit(0)).collect() == []


def test_pieces_are_shuffled_but_not_stored(docs, monkeypatch):
    stored, settled = [], suffixes.settled
    monkeypatch.setattr(suffixes, "settled", lambda frame: stored.append(frame.columns) or settled(frame))
    assert suffixes.remove_repeats(docs.filter("n_chars IS NULL OR n_chars <> 1")).agg(F.sum("n_removed")).first()[0] > 0
    assert stored and not any("bytes" in columns for columns in stored)


def test_equal_prefixes():
    buffer = np.frombuffer(b"abcdefgh" * 20 + b"z" * 60, dtype=np.uint8)
    starts = np.arange(len(buffer) - 49)
    order, head = suffixes.equal_prefixes(buffer, starts)
    strings = [buffer[s : s + 50].tobytes() for s in starts]
    repeated = Counter(strings)
    assert [strings[i] for i in order] == sorted(s for s in strings if repeated[s] > 1)
    assert len(head) == sum(n > 1 for n in repeated.values())


# scoring ------------------------------------------------------------------------------------------


def test_gradients_are_those_of_small_steps(monkeypatch):
    """Each parameter's gradient against the loss a little to both sides; one window, so nothing is truncated."""
    draw = np.random.default_rng(5)
    model = {k: v.astype(np.float64) for k, v in gru.initial(np.arange(90, 0, -1).astype(float), 20.0, hidden=4).items()}
    model = {k: v + (draw.normal(0.0, 0.2, v.shape) if k != "word_bias" else 0.0) for k, v in model.items()}
    texts = [draw.integers(0, 91, n).astype(np.int32) for n in (7, 3, 12, 1)]
    lanes = gru.Lanes(texts, 2, 2)
    (rows,) = lanes.windows(gru.WINDOW)
    quiet = np.zeros(len(lanes.target), dtype=bool)

    def loss(p):
        return -gru.log_probabilities({k: v.astype(np.float64) for k, v in p.items()}, texts, 2, width=2).sum()

    grads = gru.gradients(model, lanes, quiet, rows, np.zeros((2, 4)), 1)
    assert set(grads) == set(model)
    for name, values in model.items():
        near = np.argsort(-np.abs(grads[name]).ravel())[:6]
        for at in (*near, *draw.integers(0, values.size, 6)):
            moved = []
            for step in (1e-3, -1e-3):
                other = {k: v.copy() for k, v in model.items()}
                other[name].flat[at] += step
                moved.append(loss(other))
            assert math.isclose((moved[0] - moved[1]) / 2e-3, grads[name].flat[at], rel_tol=2e-2, abs_tol=5e-3), name


@pytest.mark.parametrize("size", [1, 40])
def test_outputs_are_those_of_a_shifted_softmax(size, monkeypatch):
    """Moderate parameters need no search for the largest exponent; large ones get it, class by class."""
    draw = np.random.default_rng(size)
    p = {k: v * size if k in ("class_out", "word_out") else v for k, v in gru.initial(draw.integers(1, 90, 100).astype(float), 50.0).items()}
    p["word_out"][0] *= 1_000 * (size - 1)
    states, target = draw.uniform(-1, 1, (500, gru.HIDDEN)).astype(np.float32), draw.integers(0, 101, 500)
    got = gru._outputs(p, states, target, 7)
    assert gru._moderate(p["word_out"], p["word_bias"]).all() == (size == 1)
    monkeypatch.setattr(gru, "_moderate", lambda weights, bias: np.zeros(bias.shape[:-1], dtype=bool))
    want = gru._outputs(p, states, target, 7)
    assert np.isfinite(got[0]).all() and np.allclose(got[0], want[0], rtol=1e-4, atol=1e-4)
    assert np.allclose(got[2], want[2], rtol=1e-3, atol=1e-5) and all(np.allclose(got[1][k], want[1][k], rtol=1e-3, atol=1e-4) for k in want[1])


def test_stretches_read_the_words_before_them(monkeypatch):
    monkeypatch.setattr(gru, "STRETCH", 10)
    monkeypatch.setattr(gru, "WARM_UP", 4)
    text = np.arange(25, dtype=np.int32)
    words, before, quiet = gru._stretches([text, text[:3]], 99)
    assert [list(w) for w in words] == [list(range(10)), list(range(6, 20)), list(range(16, 25)), [0, 1, 2]]
    assert before == [99, 5, 15, 99] and quiet == [0, 4, 4, 0]


def test_model_beats_the_base_on_held_out_texts(spark):
    scored = queries.op8_recurrent_scores(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert sum(r["score"] for r in scored) > 0.97 * sum(r["base_score"] for r in scored)
    assert sum(r["score"] > r["base_score"] for r in scored) > 0.9 * len(scored)


def test_training_raises_probability():
    draw = np.random.default_rng(1)
    counts = np.arange(90, 0, -1).astype(float)
    model = {k: v.astype(np.float64) for k, v in gru.initial(counts, 20.0, hidden=5).items()}
    texts = [draw.integers(0, 91, n).astype(np.int32) for n in (7, 3, 12)]
    total = sum(map(len, texts))
    start = gru.log_probabilities(model, texts, 0).sum() / total
    trained = model
    for _ in range(30):
        trained = gru.train(trained, texts, 0, rate=0.02)
    assert gru.log_probabilities(trained, texts, 0).sum() / total > start + 0.3


def test_model_is_a_distribution_and_carries_state():
    model = gru.initial(np.array([5.0, 3.0, 1.0]), 2.0)
    model = gru.train(model, [np.array([0, 1, 2, 3, 0, 1], dtype=np.int32)] * 4, 0, rate=0.05)
    for before in ([], [2, 2, 1]):
        given = [np.array([*before, w], dtype=np.int32) for w in range(4)]
        alone = gru.log_probabilities(model, [np.array(before, dtype=np.int32)], 0)[0] if before else 0.0
        assert abs(np.exp(gru.log_probabilities(model, given, 0) - alone).sum() - 1.0) < 1e-4
    long = np.array([0, 1, 2, 3] * 50, dtype=np.int32)
    together = gru.log_probabilities(model, [long, long[:3], long], 0, width=2)
    assert np.allclose(together, [gru.log_probabilities(model, [t], 0)[0] for t in (long, long[:3], long)], rtol=1e-4)


@pytest.mark.parametrize("head", [scoring.HEAD_WORDS, 6])
def test_scores_match_brute_force(docs, monkeypatch, head):
    monkeypatch.setattr(scoring, "HEAD_WORDS", head)
    tokens = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", _lower(t)) if w] + [None]
    rows = _plain(docs)
    counts = Counter(w for i, t in rows if i % 2 for w in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    got = scoring.score_texts(docs, F.col("doc_id") % 2 == 1).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, t in rows:
        words, r = tokens(t), by_id[i]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-6, abs_tol=1e-6) and r["score"] < 0


def test_scores_without_training_and_empty(docs):
    few = docs.filter("n_chars < 60")
    assert all(r["score"] == 0 and r["n_known"] == 0 for r in scoring.score_texts(few, F.lit(False)).collect())
    assert scoring.score_texts(docs.limit(0), F.lit(True)).collect() == []


# pipeline -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(4, 1), (7, 1)], "doc_id bigint, quality int").write.parquet(f"{path}/labels.parquet")
    item = _texts()[3]
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_odd_and_empty_input(spark, docs, folder, tmp_path, name, stage):
    path = f"{tmp_path}/out"
    stage(spark, docs, folder).write.parquet(path)
    out = spark.read.parquet(path)
    rows = out.collect()
    if name == "sharding":
        assert len(rows) == docs.count() and {"doc_id", "shard", "slot", "text"} <= set(out.columns)
    else:
        assert out.columns == docs.columns
        assert {(r["doc_id"], r["text"]) for r in rows} <= {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert stage(spark, docs.limit(0), folder).collect() == []


def test_no_task_of_the_near_duplicate_stage_holds_two_python_workers(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "docs"))
    plan = corpus_pipeline.near_duplicate_stage(spark, spark.read.parquet(str(tmp_path / "docs")), "")._jdf.queryExecution().executedPlan().initialPlan()
    most = []

    def python_nodes(node) -> int:
        below = [python_nodes(node.children().apply(i)) for i in range(node.children().size())]
        here = max(below, default=0) + ("MapInArrow" in node.nodeName())
        most.append(here)
        return 0 if "Exchange" in node.nodeName() else here

    python_nodes(plan)
    assert max(most) == 1


def test_filtering_stages_match_brute_force(spark, docs, folder):
    rows = _plain(docs)
    once = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, folder).collect())
    assert once == sorted({g for _, g in _groups(rows).values()})
    dirty = {x[0] for x in _leaks(rows, [(1, _texts()[3])]) if x[-1]}
    clean = sorted(r["doc_id"] for r in corpus_pipeline.decontamination_stage(spark, docs, folder).collect())
    assert dirty and clean == sorted(i for i, _ in rows if i not in dirty)
