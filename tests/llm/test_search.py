"""Operators 8 and 10 and the pipeline against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from test_jaccard import plain_groups
from evgraph.llm import bitsliced, common, packing, quality, queries, simhash, toxicity


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=2):
    """smallest position reachable of each fingerprint"""
    parent = list(range(len(fps)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(k) for k in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n", "one", "Two WORDS", "É è x\x1cy z", "a b c", "The cat sat on the mat. " * 9, "x " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


fingerprints = st.lists(st.tuples(st.sampled_from([0, (1 << 64) - 1, 0x123456789ABCDEF0]), st.sets(st.integers(0, 63), max_size=5)), max_size=40)


@settings(max_examples=80, deadline=None)
@given(fingerprints)
def test_trees(drawn):
    values = sorted({base ^ sum(1 << b for b in flips) for base, flips in drawn})
    tree = simhash.BKTree()
    for x in values:
        assert sorted(tree.values[k] for k in tree.near(x)) == [v for v in tree.values if (v ^ x).bit_count() <= 2] or sorted(tree.values[k] for k in tree.near(x)) == sorted(v for v in tree.values if (v ^ x).bit_count() <= 2)
        tree.add(x)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    roots = plain_components([v & (1 << 64) - 1 for v in signed])
    assert dict(simhash.stars(signed)) == {signed[k]: signed[r] for k, r in enumerate(roots) if r != k}


@pytest.mark.parametrize("tree_most", [1024, 3, 1])
def test_links_and_components(spark, tree_most):
    draw = random.Random(5)
    values = {draw.getrandbits(64) for _ in range(40)}
    for base in list(values)[:6]:
        x = base
        for _ in range(25):
            x ^= sum(1 << b for b in {draw.randrange(64) for _ in range(draw.randrange(4))})
            values.add(x)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    roots = plain_components([v & (1 << 64) - 1 for v in signed])
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r.u: r.v for r in simhash.components(simhash.links(nodes, tree_most)).collect()}
    assert found == {signed[k]: signed[r] for k, r in enumerate(roots) if r != k}


def test_masks_hold_all_neighbours():
    """However often shards are dealt, two fingerprints of 2 bits apart share one; the last ones share 56 bits."""
    draw, masks = random.Random(9), [0]
    for level in range(simhash.LEVELS):
        masks = sorted({f for m in masks for f in simhash._finer(m)})
        assert {m.bit_count() for m in masks} == {(32, 48, 56)[level]}
    for _ in range(200):
        apart, mask = sum(1 << b for b in draw.sample(range(64), 2)), 0
        for _ in range(simhash.LEVELS):
            mask = next(m for m in simhash._finer(mask) if not m & apart)


def copies(spark):
    draw = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    rows, n = [], 0
    for group in range(12):
        text = [draw.choice(words) for _ in range(400)]
        for copy in range(1 if group % 3 else 6):
            other = list(text)
            if copy > 2:
                other[draw.randrange(400)] = "changed"
            rows.append((n, " ".join(other).upper() if copy == 1 else " ".join(other)))
            n += 1
    rows += [(100, None), (101, ""), (102, " \t"), (None, "alone here now"), (7, rows[7][1]), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "3 AS fp", "'x' AS component_id", "'y' AS lang")


def test_near_duplicates(spark):
    docs = copies(spark)
    rows = docs.collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    roots = plain_components(fps)
    smallest = {}
    for r, root in zip(rows, roots):
        if r.doc_id is not None:
            smallest[root] = min(smallest.get(root, r.doc_id), r.doc_id)
    wanted = Counter((r.doc_id, f"{fp:016x}", smallest.get(root)) for r, fp, root in zip(rows, fps, roots))
    found = simhash.near_duplicates(docs)
    assert Counter(map(tuple, found.select("doc_id", simhash.hex_fingerprint(found.fp), "component_id").collect())) == wanted
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*smallest.values(), *[None] * (len(set(roots)) - len(smallest))])


def vectors(spark):
    draw = np.random.default_rng(2)
    x = draw.standard_normal((230, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(k, [float(v) for v in np.float32(x[k])], k % 3, 0) for k in range(230)]
    rows += [(300, None, 1, 0), (301, [float("nan")] * 16, 1, 0), (302, [1.0, None] * 8, 1, 0), (400, [float("inf")] * 16, 1, 0), (303, [], 1, 0), (304, [0.0] * 16, 1, 0), (500, [0.0] * 16, 1, 0), (None, rows[3][1], 0, 0), (5, rows[5][1], 2, 0), (6, rows[9][1], 2, 0), (600, [1.0, 2.0], 0, 0), (601, [3.0, 4.0], 0, 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score int")


def plain_top(rows, every=100, k=10):
    good = [(r.vec_id, [math.floor(1024 * v) for v in r.embedding]) for r in rows if r.vec_id is not None and r.embedding and all(v is not None and math.isfinite(v) for v in r.embedding)]
    found = []
    for q, v in dict((i, v) for i, v in good if i % every == 0).items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:k]
        found += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return Counter(found)


@pytest.mark.parametrize("options", [{}, {"query_block": 2, "segment_rows": 37}, {"k": 3, "segment_rows": 50}, {"k": 500}])
def test_top_k(spark, options):
    table = vectors(spark)
    found = bitsliced.top_k(table, **options)
    assert Counter(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect())) == plain_top(table.collect(), k=options.get("k", 10))
    assert bitsliced.top_k(table.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(1, 6), st.integers(1, 12), st.integers(0, 10_000), st.sampled_from([1, 3, 60, 5000]))
def test_segment(n, dims, k, seed, width):
    draw = np.random.default_rng(seed)
    values, query = draw.integers(-width, width + 1, (n, dims)), draw.integers(-width, width + 1, dims)
    ids = draw.permutation(n).astype(np.int64)
    segment = bitsliced.Segment(ids, values, slices=3)
    near, scores = segment.top(int(ids[0]), query, k)
    plain = sorted((-int(v @ query), int(i)) for i, v in zip(ids, values) if i != ids[0])[:k]
    assert [(-int(s), int(i)) for i, s in zip(near, scores)] == plain
    if segment.slices:
        sums = segment.sums(query)
        coarse = (values - values.min(0)) >> segment.shift
        wanted = sum(abs(q) * (coarse[:, d] if q >= 0 else (1 << segment.slices) - 1 - coarse[:, d]) for d, q in enumerate(query.tolist()))
        bits = np.array([np.unpackbits(s.view(np.uint8), count=n, bitorder="little") for s in sums], np.int64)
        assert ((bits << np.arange(len(sums))[:, None]).sum(0) == wanted).all()


def test_large_components(spark):
    table = spark.createDataFrame([(0, [3e30, 1.0]), (1, [2.0, 2.0]), (2, [-1e25, 5.0]), (100, [0.5, 0.25])], "vec_id long, embedding array<double>")
    rows = bitsliced.top_k(table).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in rows if r.query_id == 0] == [(0, 1, 1), (0, 2, 100), (0, 3, 2)] and min(r.score for r in rows) == -(1 << 63)
    assert [(r.vec_id, r.score) for r in rows if r.query_id == 100] == [(0, (1 << 63) - 1), (1, 512 * 2048 + 256 * 2048), (2, -(1 << 63))]


def test_outliers_stay_apart():
    """Scores of large integers, and few rows that coarse sums let in."""
    draw = np.random.default_rng(4)
    values = draw.integers(-(1 << 26) + 1, 1 << 26, (50, 5))
    for query in ([3, -(1 << 40), 1 << 90, 0, -7], [0] * 5, [1 << 30, 2, 3, -4, 5]):
        exact = [max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * q for a, q in zip(v, query)))) for v in values]
        assert bitsliced.wide_scores(values, query).tolist() == exact
    x = draw.standard_normal((4000, 64))
    x = np.floor(1024 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    segment = bitsliced.Segment(np.arange(4000), x)
    slack = (int(np.abs(x[0]).sum()) * ((1 << segment.shift) - 1) >> segment.shift) + 1
    let_in = segment.front(segment.sums(x[0]), 10, segment.all, slack)
    assert segment.shift and np.bitwise_count(let_in).sum() < 400


def test_pipeline_against_plain_version(spark):
    folder = "/root/testdata/sf0.001"
    docs = common.documents(spark, folder)
    labels = queries.labels(spark, folder)
    rows = docs.toPandas()
    model = quality.fit_documents(docs, labels)
    of = quality.Features().of
    rows = rows[[model.scores(np.array([model.margin(of(t))]))[0] >= 0.5 for t in rows.text]]
    lexicon = toxicity.fit_documents(spark.createDataFrame(rows), labels)
    rows = rows[lexicon.scores(list(rows.text)) < 0.5].sort_values("doc_id")
    rows = rows[[r == k for k, r in enumerate(plain_groups(list(rows.text)))]]
    found = corpus_pipeline.run(spark, folder).toPandas()
    assert set(found.doc_id) == set(rows.doc_id)
    pieces = Counter(found.doc_id)
    lengths = found.groupby("doc_id").length.sum()
    assert all(pieces[d] == len(packing.cut(int(lengths[d]))) for d in pieces)
    spread = found.sort_values(["sequence_id", "offset"])
    assert (spread.groupby("sequence_id").length.cumsum() - spread.length == spread.offset).all() and spread.groupby("sequence_id").length.sum().max() <= 1024
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "packing"]


def test_pipeline_stages_take_odd_rows(spark):
    folder = "/root/testdata/sf0.001"
    odd = spark.createDataFrame([(None, None, None, None, None, 1.0), (1, "", "en", "s", 0, 2.0), (1, "", "en", "s", 0, 2.0), (2, "calm words in a row " * 20_000, None, None, 5, None)], "doc_id long, text string, lang string, source string, n_chars long, _score double")
    odd = odd.selectExpr("*", "1 AS _hits", "2 AS _fingerprint", "3 AS _fp", "4 AS _id", "5 AS unsure", "6 AS _SCORE_HITS")
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, odd, folder)
        assert name == "packing" or found.columns == odd.columns
        found.collect()
        assert stage(spark, odd.limit(0), folder).count() == 0
