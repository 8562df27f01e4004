"""What keeps a run whole at size: relevance is found where it is used, work is dealt by tasks, nothing is sampled."""

from dataclasses import replace

import numpy as np
import pytest

from evgraph.operators import planner, simjoin, vocabulary
from evgraph.plans import corpora, engine, registry


_RUN = {}


@pytest.fixture
def rowless(monkeypatch):
    """The planner without the rows of relevance, queries by events, which outgrow any disk; a run of its own."""

    def never(*_):
        raise AssertionError("relevance by rows")

    monkeypatch.setattr(corpora, "_RUNS", _RUN)
    monkeypatch.setattr(planner, "relevance", never)


ROWLESS = [
    "greedy_select",
    "objective_value",
    "fallback_path",
    "selection_cost",
    "induced_subgraph",
    "parse_verification",
    "reasoning_paths",
    "capped_paths",
    "weighted_vote",
    "path_context",
    "retained_edges",
    "fallback_select",
    "random_select",
    "singleton_density",
]


@pytest.mark.parametrize("name", ROWLESS)
def test_no_rows_of_relevance(rowless, spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_vectors_and_rows_select_the_same(spark, sf_dir):
    asked, rel, costs, reach = corpora.v_asked(spark, sf_dir), corpora.v_relevance(spark, sf_dir), corpora.v_costs(spark, sf_dir), corpora.v_reach(spark, sf_dir)
    found = planner.greedy_select(asked, costs, reach, corpora.BUDGET, queries_a_task=7)
    assert found.exceptAll(planner.greedy_select(rel, costs, reach, corpora.BUDGET)).count() == 0 and found.count() > 0


def test_gains_by_lists_and_matrix(monkeypatch):
    import pandas as pd

    events = pd.DataFrame({"event_idx": [0, 2, 5], "dst": [[0, 1, 5], [2, 5], [5]], "pi": [[0.2, 0.3, 0.4], [0.5, 0.1], [0.9]]})
    rel = np.array([[1.0, 2.0, 3.0], [0.5, 0.0, 1.0]])
    wanted = rel @ np.log1p([[0.2, 0, 0.4], [0, 0.5, 0.1], [0, 0, 0.9]]).T
    assert np.allclose(planner.Reached(events).gains(rel), wanted)
    monkeypatch.setattr(planner.Reached, "DENSE", 0)
    monkeypatch.setattr(planner.Reached, "AT_ONCE", 1)
    assert np.allclose(planner.Reached(events).gains(rel), wanted)


def test_picks_beyond_the_head():
    rng = np.random.default_rng(3)
    rel, cost, pi = rng.random(100), np.full(100, 1.0), rng.random((100, 100))
    chosen = planner.lazy_greedy(rel, cost, pi, 60.0)
    reached, plain = np.zeros(100), []
    for _ in range(60):
        gains = rel + (np.log1p(reached + pi) - np.log1p(reached)) @ rel
        gains[plain] = -1
        plain.append(int(np.round(gains, 9).argmax()))
        reached = reached + pi[plain[-1]]
    assert chosen == plain


def test_vocabulary_of_all_patches(spark, sf_dir, monkeypatch):
    """SQL has all patches of a video, however many there are."""
    learn, samples = vocabulary.visual_vocabulary, []

    def noted(patches, words, iterations=1, sample=100_000):
        samples.append(sample)
        return learn(patches, words, iterations, sample)

    monkeypatch.setattr(vocabulary, "visual_vocabulary", noted)
    registry.QUERIES["visual_vocabulary"](spark, sf_dir)
    rows = spark.createDataFrame([("v", 0, 0, k, [1.0, float(k)]) for k in range(9)], "video_id string, event_idx int, frame_no int, patch_no int, p array<double>")
    whole, cut = (np.ravel([r.centroid for r in learn(rows, 1, 1, most).collect()]) for most in (None, 2))
    total = np.sum([np.array([1, k]) / np.hypot(1, k) for k in range(9)], axis=0)
    assert samples == [None] and np.allclose(whole, total / np.linalg.norm(total)) and not np.allclose(whole, cut)


def test_answers_without_rows_of_relevance(rowless, spark, sf_dir):
    """The engine's own selection, which full_pipeline takes; one round of k-means keeps this short."""
    found = engine.answers_on_vectors(spark, sf_dir, replace(engine.VECTORS, kmeans_iterations=1), "rule")
    assert found.count() == corpora.v_queries(spark, sf_dir).count()


def test_words_of_odd_patches(spark):
    """Batches of patches give what column expressions do, whatever the patches hold."""
    ps = [[1.0, 0.0], [0.0, 2.0], None, [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], [], [0.0, 0.0], [1e200, 1e200]]
    rows = [(v, 0, 0, k, p) for v in ("a", "b", "c", None) for k, p in enumerate(ps)]
    patches = spark.createDataFrame(rows, "video_id string, event_idx int, frame_no int, patch_no int, p array<double>").repartition(2)
    words = spark.createDataFrame([("a", 3, [1.0, 0.0]), ("a", 5, [0.0, 1.0]), ("b", 0, [0.0, 1.0]), ("b", 1, [1.0, 0.0])], "video_id string, word_id int, centroid array<double>")
    plain, found = (sorted(map(tuple, vocabulary.quantize(patches, words, in_row_words=most).collect())) for most in (10, 0))
    assert found == plain and len(found) == 2 * len(ps)


def test_rounds_by_sums_and_tables(spark, sf_dir, monkeypatch):
    """The vocabulary is the same where codebooks may be broadcast; then a round writes no table."""
    written, keep = [], vocabulary.kept
    monkeypatch.setattr(vocabulary, "kept", lambda df, name: (written.append(name), keep(df, name))[1])
    patches = corpora.v_patches(spark, sf_dir)
    by = lambda words: {(r.video_id, r.word_id): r.centroid for r in words.collect()}
    found = by(vocabulary.visual_vocabulary(patches, 100, 4, None))
    assert written == ["patches", "codebook", "spare", "codebook"]
    monkeypatch.setattr(vocabulary, "BROADCAST_VALUES", 0)
    plain = by(vocabulary.visual_vocabulary(patches, 100, 4, None))
    assert found.keys() == plain.keys() and all(np.allclose(found[k], plain[k], atol=1e-9) for k in plain) and len(found) == 1000


def test_reach_moves_within_reach(spark, monkeypatch):
    """Sources of a long video meet no more of its events than they can reach, and get what the dense walk gives."""
    import pandas as pd

    from evgraph.operators import graph

    n, times = 400, graph.rounds()
    rng = np.random.default_rng(5)
    edges = {(k, k + 1): 1.0 for k in range(n - 1) if k % 150 != 149} | {(int(a), int(a) + int(d)): 0.5 for a, d in zip(rng.integers(0, n - 9, 40), rng.integers(2, 9, 40))}
    matrix = np.zeros((n, n))
    for (a, b), w in edges.items():
        matrix[a, b] = w
    sinks = matrix.sum(1) == 0
    matrix[sinks, sinks] = 1.0
    matrix /= matrix.sum(1, keepdims=True)
    src, dst = np.nonzero(matrix)
    rows = pd.DataFrame({"video_id": "v", "src": src.astype(np.int32), "dst": dst.astype(np.int32), "p": matrix[src, dst]})
    wanted = np.eye(n) * 0.15
    for _ in range(times):
        wanted = wanted @ matrix * 0.85 + np.eye(n) * 0.15
    found = np.array([r.pi for r in graph.ppr(spark.createDataFrame(rows), sources=100).orderBy("src").collect()])
    assert np.allclose(found, wanted, atol=1e-12)
    assert graph.within_reach(n, src, dst, np.arange(64), times).sum() < 160


def test_reach_by_lists(spark, sf_dir):
    """The index keeps what a source reaches, not a value for each event of its video."""
    from evgraph.operators import graph

    moves = corpora.v_transitions(spark, sf_dir)
    plain = {(r.video_id, r.src): [(k, x) for k, x in enumerate(r.pi) if x > 0] for r in graph.ppr(moves).collect()}
    lists = {(r.video_id, r.src): list(zip(r.dst, r.pi)) for r in graph.ppr_lists(moves, sources=5).collect()}
    assert lists.keys() == plain.keys()
    for key, own in plain.items():
        assert [k for k, _ in lists[key]] == [k for k, _ in own] and np.allclose([x for _, x in lists[key]], [x for _, x in own], atol=1e-12)
    index = engine.build_index(corpora.clock(spark, sf_dir), corpora.v_frames(spark, sf_dir), corpora.v_patches(spark, sf_dir), engine.VECTORS, corpora.v_codebook(spark, sf_dir))
    assert index.reach.columns == ["video_id", "src", "dst", "pi"]
    asked, costs = corpora.v_asked(spark, sf_dir), corpora.v_costs(spark, sf_dir)
    found, wanted = (planner.greedy_select(asked, costs, reach, corpora.BUDGET) for reach in (index.reach, corpora.v_reach(spark, sf_dir)))
    assert found.exceptAll(wanted).count() == wanted.exceptAll(found).count() == 0 < found.count()


def plan(rows):
    """The plan of rows, before it runs."""
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_run_pools_vectors_once(spark, sf_dir):
    """The objective reads the pooled vectors that the run wrote, instead of pooling all frames again."""
    assert "avg(" not in plan(registry.QUERIES["objective_value"](spark, sf_dir))


def test_run_finds_costs_once(spark, sf_dir):
    """Costs are read from the run's table, not counted again from all vectors."""
    text = plan(registry.QUERIES["selection_cost"](spark, sf_dir))
    assert "Join" in text and "label" not in text


def test_gains_by_blocks(monkeypatch):
    """A long video whose sources reach little is found by small matrices, neither by one of all its events nor by lists."""
    import pandas as pd

    n, width = 1000, 20
    dst = [[*range(k, min(n, k + width)), *([n - 1] if k % 7 == 0 and k < n - width else [])] for k in range(n)]
    dst[5], rng = [], np.random.default_rng(8)
    events = pd.DataFrame({"event_idx": np.arange(n), "dst": dst, "pi": [list(rng.random(len(d))) for d in dst]})
    rel, matrix = rng.random((30, n)), np.zeros((n, n))
    for k, (d, p) in enumerate(zip(events.dst, events.pi)):
        matrix[k, d] = p
    monkeypatch.setattr(planner.Reached, "DENSE", n * n // 4)
    monkeypatch.setattr(planner.Reached, "AT_ONCE", None)
    assert np.allclose(planner.Reached(events).gains(rel), rel @ np.log1p(matrix).T)
    monkeypatch.setattr(planner.Reached, "DENSE", 0)
    monkeypatch.setattr(planner.Reached, "AT_ONCE", 9000)
    assert np.allclose(planner.Reached(events).gains(rel), rel @ np.log1p(matrix).T)


def test_turns_with_one_copy_of_events(spark, sf_dir):
    """A task answers its queries in turns with the copy of the events that it has."""
    asked = corpora.v_asked(spark, sf_dir)

    def run(queries, events, _):
        events.attrs["turn"] = events.attrs.get("turn", 0) + 1
        return queries[["query_id", "video_id"]].assign(turn=events.attrs["turn"], size=len(queries))

    rows = planner._dealt(planner._queries(asked), asked.vectors, run, "turn int, size int", 4).collect()
    assert max(r.turn for r in rows) == planner.TURNS and max(r.size for r in rows) < 12
    assert sorted(r.query_id for r in rows) == sorted(r.query_id for r in asked.queries.collect())


def test_codebook_once(spark, sf_dir):
    """The first patches of all videos are put in order once, though the codebook is read more than once."""
    assert "row_number" not in plan(corpora.v_codebook(spark, sf_dir))


def test_events_once(spark, sf_dir):
    """The times of a path's events come from the table of events, not from all vectors."""
    assert "label" not in plan(corpora.clock(spark, sf_dir))


def test_edges_by_the_runs_vectors(spark, sf_dir, monkeypatch):
    """The candidates whose replies are parsed have cosines of vectors that are there already."""
    vectors, seen = corpora.v_vectors(spark, sf_dir), []
    found = simjoin.global_cosine
    monkeypatch.setattr(simjoin, "global_cosine", lambda pairs, rows: (seen.append(rows), found(pairs, rows))[1])
    corpora.v_semantic(spark, sf_dir, vectors)
    monkeypatch.setattr(corpora, "_RUNS", {})
    monkeypatch.setattr(corpora, "_SHARED", {})
    run = corpora.v_run(spark, sf_dir)
    assert seen[0] is vectors and seen[1] is run.asked.vectors
