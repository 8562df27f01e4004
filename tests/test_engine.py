"""Hand-written cases and invariants of the engine's operators."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evgraph.functions import models
from evgraph.functions import text as T
from evgraph.operators import evaluate, execute, frames, graph, planner, segment, simjoin, vocabulary
from evgraph.params import Params
from evgraph.plans import corpora, engine
from evgraph.sources import datasets, results


def events_of(spark, cuts, duration):
    videos = spark.createDataFrame([("v", float(duration))], "video_id string, duration double")
    rows = spark.createDataFrame([("v", float(c)) for c in cuts], "video_id string, cut_sec double")
    found = segment.cuts_to_events(rows, videos).orderBy("event_idx").collect()
    return [(r.event_idx, r.start_sec, r.end_sec) for r in found]


def test_cuts(spark):
    assert events_of(spark, [3, 3, 1, 0, 10, 11], 10) == [(0, 0, 1), (1, 1, 3), (2, 3, 10)]
    assert events_of(spark, [], 7) == [(0, 0, 7)]
    assert events_of(spark, [1], 0) == []


def test_uniform_windows(spark):
    videos = spark.createDataFrame([("a", 12.0), ("b", 10.0), ("c", 0.0), ("d", 3.0)], "video_id string, duration double")
    found = {v: [(r.start_sec, r.end_sec) for r in segment.uniform_windows(videos).filter(F.col("video_id") == v).orderBy("event_idx").collect()] for v in "abcd"}
    assert found == {"a": [(0, 5), (5, 10), (10, 12)], "b": [(0, 5), (5, 10)], "c": [(0, 1)], "d": [(0, 3)]}


def test_precomputed_and_scores(spark):
    videos = spark.createDataFrame([("a", 9.0)], "video_id string, duration double")
    segments = spark.createDataFrame([("a", [[1.0, 2.0], [3.0, 4.0], [6.0, 8.0]])], "video_id string, segments array<array<double>>")
    assert [r.start_sec for r in segment.segment("precomputed", videos, segments=segments).orderBy("event_idx").collect()] == [0, 3, 6]
    scores = spark.createDataFrame([("a", k, s, 1.0) for k, s in enumerate([0.1, 0.9, 0.8, 0.2, 0.1, 0.6, 0.1])], "video_id string, frame int, score double, fps double")
    assert sorted(r.cut_sec for r in segment.score_cuts(scores).collect()) == [3, 6]
    with pytest.raises(ValueError):
        segment.segment("none", videos)


def test_frames(spark):
    one = spark.range(1)
    assert [one.select(frames.frames_per_event(F.lit(0.0), F.lit(float(d)))).first()[0] for d in (0, 4, 4.1, 100)] == [1, 1, 2, 4]
    videos = spark.createDataFrame([("a", 25.0, 3), ("b", 25.0, 100), ("c", 25.0, 0)], "video_id string, fps double, total_frames long")
    found = frames.uniform_sampling(videos, budget=4 * 144)
    assert sorted(r.frame_id for r in found.filter("video_id = 'a'").collect()) == [0, 1, 2]
    assert sorted(r.frame_id for r in found.filter("video_id = 'b'").collect()) == np.rint(np.linspace(0, 99, 6)[1:-1]).astype(int).tolist()
    assert found.filter("video_id = 'c'").count() == 0
    assert frames.uniform_sampling(videos, budget=1).filter("video_id = 'b'").count() == 1


def test_options(spark):
    row = spark.createDataFrame([(["A. x", "(B) y", "c. z", "D) q", "foo"],)], "o array<string>")
    assert row.select(T.format_options(F.col("o"))).first()[0].split("\n") == ["A. x", "(B) y", "C. c. z", "D) q", "E. foo"]
    assert spark.range(1).select(T.option_letters(F.lit(0)), T.option_letters(F.lit(3))).first()[:] == ("A", "ABC")


@pytest.mark.parametrize("reply, letter", [("The answer is C.", "C"), ("(b)", "B"), ("B. the man", "B"), ("A man walks", "A"), ("The answer is because it", "B"), ("it was E.", None), ("", None), (None, None), ("I think a", "A")])
def test_answers(spark, reply, letter):
    assert spark.createDataFrame([(reply,)], "r string").select(T.extract_answer(F.col("r"))).first()[0] == letter


@pytest.mark.parametrize("reply, keep, told", [("Yes, same man.", True, "same man"), ("Yes\nx", True, "x"), ("No", False, None), ("", False, None), (None, False, None), ("\n  yes\n\n  y ", True, "y")])
def test_verification(spark, reply, keep, told):
    row = execute.parse_verification(spark.createDataFrame([(reply,)], "reply string")).first()
    assert (row.keep, row.statement) == (keep, told)


def test_file_names(spark):
    assert spark.range(1).select(T.base_name(F.lit("/a/b.c/v1.mp4.json")), T.base_name(F.lit("x"))).first()[:] == ("v1.mp4", "x")


def chain(spark, n, extra=()):
    events = spark.createDataFrame([("v", k) for k in range(n)], "video_id string, event_idx int")
    semantic = spark.createDataFrame([("v", *e) for e in extra], "video_id string, src int, dst int, weight double")
    return events, graph.adjacency(events, semantic)


def test_reach_sums_and_closed_form(spark):
    events, edges = chain(spark, 6, [(0, 2, 0.5), (1, 4, 0.9)])
    moves = graph.transition_matrix(events, edges)
    pi = np.stack([r.pi for r in graph.ppr(moves).orderBy("src").collect()])
    assert graph.rounds() == 74
    assert np.allclose(pi.sum(1), 1 - 0.85**75)
    step = np.zeros((6, 6))
    for r in moves.collect():
        step[r.src, r.dst] = r.p
    assert np.abs(pi - 0.15 * np.linalg.inv(np.eye(6) - 0.85 * step)).max() < 1e-5
    dealt = np.stack([r.pi for r in graph.ppr(moves, sources=4).orderBy("src").collect()])
    assert np.allclose(dealt, pi, atol=1e-15)
    joined = np.zeros((6, 6))
    for r in graph.ppr_joined(events, moves, times=4, cut_every=2).collect():
        joined[r.src, r.dst] = r.pi
    short = np.eye(6) * 0.15
    for _ in range(4):
        short = 0.15 * np.eye(6) + 0.85 * short @ step
    assert np.allclose(joined, short)


def test_single_event_reaches_itself(spark):
    events, edges = chain(spark, 1)
    assert edges.count() == 0
    assert abs(graph.ppr(graph.transition_matrix(events, edges)).first().pi[0] - 1) < 1e-5


instances = st.integers(1, 9).flatmap(lambda n: st.tuples(st.lists(st.floats(0, 1), min_size=n, max_size=n), st.lists(st.sampled_from([144.0, 288.0, 432.0]), min_size=n, max_size=n), st.integers(0, 10_000), st.floats(0, 2000)))


def gain_of(rel, pi, chosen, v):
    r = pi[chosen].sum(0) if chosen else np.zeros(len(rel))
    return rel[v] + float(rel @ (np.log1p(r + pi[v]) - np.log1p(r)))


@settings(max_examples=60, deadline=None)
@given(instances)
def test_lazy_greedy_is_plain_greedy(instance):
    rel, cost, seed, budget = np.array(instance[0]), np.array(instance[1]), instance[2], instance[3]
    pi = np.random.default_rng(seed).random((len(rel), len(rel)))
    chosen, spent = [], 0.0
    while spent < budget:
        open_ = [(-round(gain_of(rel, pi, chosen, v) / cost[v], 9), v) for v in range(len(rel)) if v not in chosen and spent + cost[v] <= budget]
        if not open_ or min(open_)[0] >= 0:
            break
        chosen.append(min(open_)[1])
        spent += cost[chosen[-1]]
    assert planner.lazy_greedy(rel, cost, pi, budget) == chosen
    assert cost[chosen].sum() <= budget


def test_paths_are_maximal_and_capped():
    edges = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 0.4), (2, 5, 0.6), (7, 8, 1.0)]
    assert execute.enumerate_paths(edges) == [([0, 1, 2, 5], pytest.approx(2.6 / 3)), ([0, 2, 5], pytest.approx(0.5)), ([7, 8], 1.0)]
    ladder = [(k, k + j, 1.0) for k in range(20) for j in (1, 2) if k + j <= 20]
    found = execute.enumerate_paths(ladder, 1000)
    assert len(found) == 1000 and [p for p, _ in found] == sorted(p for p, _ in found)


def test_vote_ties_go_to_the_best_ranked(spark):
    rows = spark.createDataFrame([(1, 1, 0.5, "B"), (1, 2, 0.5, "A"), (2, 1, 0.9, None)], "query_id long, rank int, score double, answer string")
    assert {r.query_id: r.pred for r in execute.weighted_vote(rows).collect()} == {1: "B", 2: None}


def test_nothing_affordable(spark):
    rel = spark.createDataFrame([(1, "v", 0, 0.5)], "query_id long, video_id string, event_idx int, rel double")
    costs = spark.createDataFrame([("v", 0, 144.0)], "video_id string, event_idx int, cost double")
    none = planner.random_select(rel, costs, 100.0)
    assert none.count() == 0 and planner.fallback_select(rel, costs, none, 100.0).count() == 0
    assert planner.fallback_select(rel, costs, none, 144.0).first().event_idx == 0


def test_index_edges_are_candidates(spark, sf_dir):
    pairs = simjoin.sparse_similarity(*corpora.v_index(spark, sf_dir))
    edges = corpora.v_semantic(spark, sf_dir)
    assert edges.join(pairs, ["video_id", "src", "dst"], "left_anti").count() == 0
    assert edges.filter(f"dst < src + 2 or round(weight, 9) < {corpora.DELTA}").count() == 0


def test_kmeans_needs_no_zero_vectors(spark):
    rows = [("v", 0, 0, k, [float(k % 2), float((k + 1) % 2)]) for k in range(6)] + [("v", 0, 0, 9, [0.0, 0.0])]
    patches = spark.createDataFrame(rows, "video_id string, event_idx int, frame_no int, patch_no int, p array<double>")
    words = vocabulary.visual_vocabulary(patches, 2, 2)
    assert sorted(tuple(r.centroid) for r in words.collect()) == [(0.0, 1.0), (1.0, 0.0)]
    assert vocabulary.quantize(patches, words).filter("patch_no = 9").first().word_id == 0


def test_words_by_matrix_and_in_row(spark, sf_dir):
    patches, words = corpora.v_patches(spark, sf_dir), corpora.v_codebook(spark, sf_dir)
    in_row = vocabulary.quantize(patches, words)
    assert in_row.exceptAll(vocabulary.quantize(patches, words, in_row_words=1)).count() == 0
    assert in_row.exceptAll(vocabulary.quantize(patches, words, in_row_words=1, broadcast_values=1)).count() == 0


def test_chunks_are_contiguous(spark):
    rows = spark.createDataFrame([(str(k), None if k % 3 == 0 else f"p{k % 2}") for k in range(11)], "id string, video_path string")
    found = evaluate.chunk_assign(rows, 3).orderBy("position").collect()
    assert [r.position for r in found] == list(range(11)) and [r.chunk for r in found] == [0] * 4 + [1] * 4 + [2] * 3
    assert [(r.video_path or "", r.id) for r in found] == sorted((r.video_path or "", r.id) for r in found)


def test_results_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}"
    for k, rows in enumerate([[("a", "A", "A", None), ("b", None, "B", "failed")], [("c", "C", "D", None), ("d", "A", "", None)]]):
        results.write_chunk(spark.createDataFrame(rows, "id string, pred string, gt string, error string"), folder, k)
    done = results.scan_chunks(spark, folder)
    assert sorted(r.id for r in done.collect()) == ["a", "b", "c", "d"]
    row = results.merge(spark, folder).first()
    assert (row.correct, row.valid, row.errors) == (1, 3, 1)
    merged = [json.loads(line)["id"] for part in sorted((tmp_path / "merged.json").glob("part-*")) for line in part.read_text().splitlines()]
    assert merged == ["a", "b", "c", "d"]  # in order of the files
    left = results.unfinished(spark.createDataFrame([("a",), ("z",)], "id string"), done)
    assert [r.id for r in left.collect()] == ["z"]


def test_chunk_goes_on_where_it_broke_off(spark, tmp_path):
    folder, samples, seen = f"file://{tmp_path}", spark.createDataFrame([(str(k),) for k in range(20)], "id string"), []

    def answer(rows, fail=False):
        if fail and len(seen) >= 8:
            raise OSError("stopped")
        seen.extend(r.id for r in rows.collect())
        return rows.select("id", F.lit("A").alias("pred"), F.lit("A").alias("gt"))

    with pytest.raises(OSError):
        results.run_chunk(samples, lambda rows: answer(rows, True), folder, 3, parts=5)
    assert results.scan_chunks(spark, folder).count() == 0 and 8 <= len(seen) < 20
    results.run_chunk(samples, answer, folder, 3, parts=5)
    assert sorted(seen, key=int) == [str(k) for k in range(20)]
    assert sorted(int(r.id) for r in results.scan_chunks(spark, folder).collect()) == list(range(20)) and not (tmp_path / "results_chunk3.partial.json").exists()


def test_question_scans(spark, tmp_path):
    root = f"file://{tmp_path}"
    (tmp_path / "VRBench_eval.jsonl").write_text('{"video_id": "v", "mcq": {"qa10": {"question": "q", "options": {"B": "y", "A": "x"}, "answer": " b. y"}, "qa2": {"question": "r", "options": ["x"], "answer": "a"}}}\n\n{"video_id": "w", "mcq": null}\n{"video_id": "u", "video_path": "own/u.mp4", "mcq": {"qa1": {"question": "q", "options": ["x"], "answer": "A"}}}\n')
    for name in ("videos/v001/v.mp4", "own/u.mp4", "videos/a.mkv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    found = datasets.vr_bench(spark, root).orderBy("row", "position").collect()
    assert [(r.id, r.options, r.answer, r.video_path) for r in found] == [("v_qa2", ["x"], "A", f"{tmp_path}/videos/v001/v.mp4"), ("v_qa10", ["A. x", "B. y"], "B", f"{tmp_path}/videos/v001/v.mp4"), ("u_qa1", ["x"], "A", f"{tmp_path}/own/u.mp4")]
    (tmp_path / "videomme").mkdir()
    spark.createDataFrame([("a", "q1", "why", ["x"], "A"), ("b", "q2", "who", ["y"], "B")], "videoID string, question_id string, question string, options array<string>, answer string").toPandas().to_parquet(tmp_path / "videomme/test-00000-of-00001.parquet")
    found = {r.id: r for r in datasets.video_mme(spark, root).collect()}
    assert found["q1"].video_path == f"{tmp_path}/videos/a.mkv" and found["q2"].video_path is None and found["q1"].row < found["q2"].row
    assert {r.error for r in evaluate.error_records(datasets.video_mme(spark, root)).collect()} == {"video not found"}
    (tmp_path / "cuts").mkdir()
    (tmp_path / "cuts/v.json").write_text("[[0, 1.5], [2, 3]]")
    assert datasets.boundaries(spark, f"{root}/cuts").first()[:] == ("v", [[0.0, 1.5], [2.0, 3.0]])
    clips = spark.createDataFrame([("m", "A b!", "u", "q", ["x", "y"], "1", 4)], "movie_name string, yt_clip_title string, yt_clip_link string, question string, choices array<string>, answer_key_position string, row long")
    row = datasets.cine_pile(clips, root="/d").first()
    assert (row.id, row.video_id, row.answer, row.video_path) == ("cinepile_test_4", "A_b_", "B", "/d/yt_videos/m_A_b_.mp4")
    assert datasets.without_failed(datasets.cine_pile(clips), spark.createDataFrame([("u",)], "url string")).count() == 0


@pytest.mark.parametrize("reply, n, letter", [("The answer is E.", 5, "E"), ("The answer is E.", 4, None), ("B\u00a0", 4, "B"), ("\u3000(c)\u2028", 4, "C"), ("option\u00a0:\u2003D", 4, "D"), ("The answer is F", 6, "F"), ("C", 2, None)])
def test_answers_of_any_number_and_space(spark, reply, n, letter):
    row = spark.createDataFrame([(reply, n)], "r string, n int").select(T.extract_answer(F.col("r"), F.col("n")), T.extract_answer(F.col("r"), n)).first()
    assert tuple(row) == (letter, letter)


def test_failed_calls_become_errors(spark, sf_dir, monkeypatch):
    class Fails(models.RuleModel):
        def generate_text(self, prompt):
            if "vector 3?" in prompt and "Begin with" not in prompt:
                raise OSError("no answer")
            return super().generate_text(prompt)

    monkeypatch.setitem(models.MODELS, "fails", Fails)
    params = Params(delta=corpora.DELTA, token_budget=corpora.BUDGET, attempts=2, retry_wait=0.0)
    index = engine.build_index(corpora.clock(spark, sf_dir), corpora.v_frames(spark, sf_dir), corpora.v_patches(spark, sf_dir), params, corpora.v_codebook(spark, sf_dir))
    queries = corpora.v_queries(spark, sf_dir).filter("query_id in (3, 4, 5)").withColumns({"question": F.concat(F.lit("What follows vector "), F.col("query_id").cast("string"), F.lit("?")), "options": F.array(*map(F.lit, "abcde"))})
    found = {r.query_id: r for r in engine.answer(index, queries, params, "fails").collect()}
    assert found.keys() == {3, 4, 5} and found[3].pred is None and found[3].error == "OSError: no answer" and found[3].response == ""
    assert all(found[k].error is None and found[k].pred in "ABCDE" for k in (4, 5))


def test_index_of_videos(spark, tmp_path):
    """Segmentation, sampling, encoding and edges by parameters; videos added to an index, and looked up."""
    videos = spark.createDataFrame([(1, 2.0, 40, 20.0), (2, 2.0, 24, 12.0)], "video_id int, fps double, total_frames long, duration double")
    images = videos.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total_frames") - 1)).alias("frame_id")).withColumn("image", F.concat_ws("-", F.col("video_id").cast("string"), (F.col("frame_id") % 7).cast("string")).cast("binary"))
    params = Params(segmentation="uniform", window=4.0, frame_interval=2.0, max_frames_per_event=2, vocab_size=8, kmeans_iterations=2, delta=0.1, token_budget=600)
    first = engine.index_videos(videos.filter("video_id = 1"), images, params)
    assert [(r.start_sec, r.end_sec) for r in first.events.orderBy("event_idx").collect()] == [(4.0 * k, 4.0 * k + 4) for k in range(5)]
    assert {(r.n_frames, r.cost) for r in first.costs.collect()} == {(2, 288.0)}
    assert all(len(r.images) == 2 and bytes(r.images[0]).startswith(b"1-") for r in first.images.collect())
    folder = f"file://{tmp_path}/index"
    first.write(folder)
    engine.index_videos(videos.join(engine.Index.known(spark, folder), "video_id", "left_anti"), images, params).add(folder)
    first.add(folder)  # known already
    whole = engine.Index.read(spark, folder)
    assert {(r.video_id, r["count"]) for r in whole.events.groupBy("video_id").count().collect()} == {(1, 5), (2, 3)}
    assert whole.of(videos.filter("video_id = 2")).reach.count() == 3
    queries = engine.with_query_vectors(spark.createDataFrame([(7, 2, "what?", ["x", "y"])], "query_id long, video_id int, question string, options array<string>"))
    assert engine.answer(whole, queries, params, "rule").first().num_selected >= 1
    with pytest.raises(ValueError):
        engine.planned_frames(videos, Params(segmentation="none"))


def test_greedy_tasks_and_subsets(spark, sf_dir):
    rel, costs, reach = corpora.v_relevance(spark, sf_dir), corpora.v_costs(spark, sf_dir), corpora.v_reach(spark, sf_dir)
    whole = planner.greedy_select(rel, costs, reach, corpora.BUDGET)
    assert whole.exceptAll(planner.greedy_select(rel, costs, reach, corpora.BUDGET, queries_a_task=3)).count() == 0 and whole.count() > 0


def test_empty_words_are_drawn_anew(spark):
    rows = [("v", 0, 0, k, [1.0, float(k % 3)]) for k in range(9)]
    patches = spark.createDataFrame(rows, "video_id string, event_idx int, frame_no int, patch_no int, p array<double>")
    words = spark.createDataFrame([("v", 0, [1.0, 0.0]), ("v", 1, [-1.0, 0.0]), ("v", 2, [-1.0, -1.0])], "video_id string, word_id int, centroid array<double>")
    kept = {r.word_id: r.centroid for r in vocabulary.kmeans_step(patches, words).collect()}
    anew = {r.word_id: r.centroid for r in vocabulary.kmeans_step(patches, words, vocabulary.drawn(patches, "seed", 2), 1).collect()}
    assert kept[1] == [-1.0, 0.0] and anew[0] == kept[0] and all(anew[k][0] > 0 for k in (1, 2))
    assert vocabulary.sampled(patches, 4, "s").count() == 4


def test_work_folder_on_a_cluster():
    from types import SimpleNamespace

    from evgraph.sources import work

    empty = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: empty)))
    with pytest.raises(RuntimeError):
        work.work_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


def test_retries():
    calls = []

    def fails_twice():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "x"

    assert models.with_retries(fails_twice, wait=0) == "x" and len(calls) == 3
    assert models.StubModel().count_image_tokens((336, 336)) == models.image_tokens("stub", 336) == 144


@pytest.mark.parametrize("change", [{"execution": "cot"}, {"planner": "random"}, {"edge_construction": "pairwise"}, {"uniform_word_weight": True, "use_relevance": False, "lambda_param": 0.5}])
def test_switches(spark, sf_dir, change):
    found = engine.answers_on_vectors(spark, sf_dir, Params(delta=corpora.DELTA, token_budget=corpora.BUDGET, **change))
    rows = found.collect()
    assert len(rows) == corpora.v_queries(spark, sf_dir).count() and all(r.visual_tokens <= corpora.BUDGET for r in rows if r.visual_tokens is not None)
    assert sum(r.pred is not None for r in rows) > 0.9 * len(rows)
