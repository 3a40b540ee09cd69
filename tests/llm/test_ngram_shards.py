"""Rows that go to the filter follow batches and shards, not segments."""

from pyspark.sql import functions as F

from palimpsest.llm import ngram_lm as M


def test_shards_hold_many_segments(spark):
    """With far more segments than shards, every n-gram is found where the broadcast filter finds it, and few rows are asked."""
    rows = [(k, " ".join(f"w{(k * j) % 97}" for j in range(200))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    models = [M.Model(segment_tokens=2, broadcast_bytes=b, batch_chars=2_000) for b in (1 << 30, 0)]
    found = [{r.doc_id: (r.n_known, round(r.score, 6)) for r in M.score_documents(docs, F.col("doc_id") % 5 == 0, m).collect()} for m in models]
    assert found[0] == found[1] and len(found[0]) == 40


def test_parts_of_the_filter(spark):
    """Segments are built in groups: one row for each that has n-grams, though far fewer rows are moved."""
    docs = spark.createDataFrame([(" ".join(f"w{k}" for k in range(3_000)),)], "text string").repartition(1)
    model = M.Model(group_tokens=1 << 30)
    made = M.build_filter(docs, 4096, model).collect()
    assert len({r.segment for r in made}) == len(made) > 2_000 and sum(r.grams for r in made) == 6_003
    assert M.Model().batch_tokens <= 500_000
