"""Operator 7 on junk and on languages without letters."""

import math

import pandas as pd
import pytest

from evgraph.llm import perplexity

SF = "/root/testdata/sf0.01"


def test_junk_and_good_documents(spark):
    found = perplexity.quality_rules(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    found = found.merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    passed = found[~found.base_failed]
    junk, good = passed[passed.quality == 0], passed[passed.quality == 1]
    print(len(junk), (~junk.kept).sum(), len(good), (~good.kept).sum())
    assert len(junk) > 10 and (~junk.kept).mean() > 0.4
    assert good.kept.mean() > 0.95


@pytest.mark.parametrize("shard_rows", [perplexity.SHARD_ROWS, 20])
@pytest.mark.parametrize("more", [[(1, "some words here", "en")], []])
def test_languages_without_letters(spark, more, shard_rows):
    rows = [(2, "", "xx"), (3, None, "yy"), (4, None, None), *more]
    found = {r.doc_id: r for r in perplexity.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), shard_rows=shard_rows).collect()}
    assert found.keys() == {r[0] for r in rows}
    assert all(found[k].log_ppl is None and found[k].base_failed and not found[k].kept for k in (2, 3, 4))
    assert not more or found[1].log_ppl is not None


def plain_quartiles(values):
    """The smallest value (in thousandths) that a quarter, or three quarters, of the values don't exceed."""
    bins = sorted(math.floor(abs(v) * 1000 + 0.5) * (1 if v >= 0 else -1) for v in values)
    return [bins[math.ceil(q * len(bins)) - 1] for q in (0.25, 0.75)]


def test_bands_and_shards(spark):
    """kept from log_ppl by plain quartiles, and the same rows for any number of shards."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = {r.doc_id: r for r in perplexity.quality_rules(docs).collect()}
    many = {r.doc_id: r for r in perplexity.quality_rules(docs, shard_rows=4000).collect()}
    assert one == many
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    passed = {}
    for k, r in one.items():
        if not r.base_failed:
            passed.setdefault(langs[k], []).append(r)
    assert sum(map(len, passed.values())) > 100
    for rows in passed.values():
        q1, q3 = plain_quartiles([r.log_ppl for r in rows])
        for r in rows:
            wide = max(q3 - q1, 1) * math.sqrt((1 + perplexity.SHORT_CHARS / r.word_chars) * (1 + perplexity.FEW_DOCUMENTS / len(rows)))
            assert r.kept == (q1 - perplexity.FENCES[0] * wide <= r.log_ppl * 1000 <= q3 + perplexity.FENCES[1] * wide)
    assert not any(r.kept for r in one.values() if r.base_failed) and any(r.kept for r in one.values())
