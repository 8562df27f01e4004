from pyspark.sql import functions as F

from evgraph.params import Params
from evgraph.plans import corpora, engine
from evgraph.streaming.online import answer_stream


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    base = f"file://{tmp_path}"
    params = Params(delta=corpora.DELTA, token_budget=corpora.BUDGET)
    index = engine.build_index(corpora.clock(spark, sf_dir), corpora.v_frames(spark, sf_dir), corpora.v_patches(spark, sf_dir), params, corpora.v_codebook(spark, sf_dir))
    index.write(f"{base}/index")
    asked = corpora.v_queries(spark, sf_dir).filter("query_id < 40").withColumns({"question": F.lit("which?"), "options": F.array(F.lit("x"), F.lit("y"))})
    asked.coalesce(1).write.json(f"{base}/queries")
    answer_stream(spark, f"{base}/index", f"{base}/queries", f"{base}/out", f"{base}/state", params).awaitTermination()
    found = {r.query_id: r.pred for r in spark.read.parquet(f"{base}/out").collect()}
    assert found == {r.query_id: r.pred for r in engine.answer(engine.Index.read(spark, f"{base}/index"), asked, params).collect()} and found
