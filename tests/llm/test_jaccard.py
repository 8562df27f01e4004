"""The near-duplicate stage of the pipeline against all pairs."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from evgraph.llm import jaccard, simhash


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def plain_groups(texts):
    sets, parent = [plain_set(t) for t in texts], list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(k) for k in range(len(sets))]


def edited(draw, words, times):
    out = list(words)
    for _ in range(times):
        out[draw.randrange(len(out))] = f"new{draw.randrange(10**9)}"
    return " ".join(out)


def corpus():
    """Copies, pairs around the least similarity, and a group of near copies that is larger than a small bucket."""
    draw = random.Random(4)
    base = [[f"w{draw.randrange(900)}" for _ in range(200)] for _ in range(40)]
    rows = []
    for k, words in enumerate(base):
        rows += [" ".join(words), edited(draw, words, k % 7), edited(draw, words, 5)]
    rows += [edited(draw, base[0], draw.randrange(8)) for _ in range(60)]
    return rows + [" ".join(base[1]).upper(), None, "", " \t", "one", "ONE", "a b c d e", "a b c d e f", "x " * 40_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t) for k, t in enumerate(corpus())]
    rows += [(7, rows[7][1]), (None, "alone here now"), (None, rows[9][1]), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "3 AS _fp", "'x' AS keys", "1 AS _id", "2 AS component_id", "5 AS __ID")


def test_stage_keeps_one_of_each_group(spark, docs):
    rows = docs.collect()
    roots = plain_groups([r.text for r in rows])
    smallest = {}
    for r, root in zip(rows, roots):
        if r.doc_id is not None:
            smallest[root] = min(smallest.get(root, r.doc_id), r.doc_id)
    wanted = Counter([*smallest.values(), *[None] * (len(set(roots)) - len(smallest))])
    kept = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == wanted
    assert sum(Counter(r.doc_id for r in simhash.one_of_each(docs).collect()).values()) > len(list(wanted.elements()))
    assert corpus_pipeline.near_dedup_stage(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("most, first", [(1, 1), (4, 2), (256, 20)])
def test_blocks_lose_no_link(spark, docs, monkeypatch, most, first):
    """Groups don't depend on how large shards are dealt to trees, or on the pairs that are tried first."""
    monkeypatch.setattr(jaccard, "TREE_MOST", most)
    monkeypatch.setattr(jaccard, "FIRST_BANDS", first)
    assert len({r.component_id for r in jaccard.near_duplicates(docs).collect()}) == len(set(plain_groups([r.text for r in docs.collect()])))


def test_nearest():
    draw = random.Random(6)
    values = list({draw.getrandbits(12) for _ in range(300)})
    tree = simhash.BKTree(3)
    for v in values:
        tree.add(v)
    for x in range(0, 4096, 7):
        fits = {k for k in range(len(values)) if (values[k] + x) % 3}
        found = tree.nearest(x, lambda k: k in fits)
        least = min(((values[k] ^ x).bit_count() for k in fits), default=99)
        assert (found is None and least > 3) or (found in fits and (values[found] ^ x).bit_count() == least)


def test_bands_hold_pairs_of_the_least_similarity():
    draw = random.Random(8)
    missed = pairs = 0
    for _ in range(300):
        words = [f"w{draw.randrange(10**6)}" for _ in range(150)]
        a, b = jaccard.shingles(" ".join(words)), jaccard.shingles(edited(draw, words, draw.randrange(1, 5)))
        if jaccard.similar(a, b):
            pairs += 1
            missed += not set(jaccard.bands(a)) & set(jaccard.bands(b)) or (simhash.majority(a) ^ simhash.majority(b)).bit_count() > jaccard.RADIUS
    assert pairs > 100 and not missed


def test_few_links_need_no_rounds(spark, monkeypatch):
    """Links that fill no file are one forest: one more table, however long their chains; rounds give the same."""
    from evgraph.llm import simhash

    written, write = [], simhash.common.write_work
    monkeypatch.setattr(simhash.common, "write_work", lambda df, name: (written.append(name), write(df, name))[1])
    chain = [(k + 1, k) for k in range(300)] + [(1000, 2000), (2000, 1500), (-7, 5000)]
    edges = spark.createDataFrame([(max(e), min(e)) for e in chain], "u long, v long").repartition(7)
    found = {tuple(r) for r in simhash.components(edges).collect()}
    assert len(written) == 2 and found == {(k, 0) for k in range(1, 301)} | {(1500, 1000), (2000, 1000), (5000, -7)}
    monkeypatch.setattr(simhash, "LINKS_A_FILE", 1)
    assert {tuple(r) for r in simhash.components(edges).collect()} == found and len(written) > 4
