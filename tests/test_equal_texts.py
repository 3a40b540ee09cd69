from pyspark.sql import functions as F

from palimpsest.plans import joins as J


def test_equal_pairs_of_texts_are_matched_once(spark):
    """Rows of one pair of texts go to all its keys, more than share one copy; a pair without rows gives none."""
    texts = [('{"a": 1}', '{"a": 2}')] * 150 + [('{"b": 1}', '{"b": 1}')] * 3 + [(None, "x"), ("none", "none")]
    pairs = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "key long, src string, dst string")
    seen = []

    def found(rows):
        seen.extend(rows.orderBy("key").collect())
        return rows.where("src != 'none'").select("key", F.explode(F.split(F.concat("src", "dst"), " ")).alias("word"))

    rows = J.by_texts(pairs, found)
    assert [r.key for r in seen] == [0, 150, 153, 154]
    assert sorted((r.key, r.word) for r in rows.collect()) == sorted((k, w) for k, (s, d) in enumerate(texts) if s not in (None, "none") for w in (s + d).split(" "))


def test_event_match_compares_equal_texts_once(spark, tmp_path, monkeypatch):
    props = ['{"k": 1, "z": 2}', '{"k": 2, "z": 2}']
    rows = [(k * 5, k // 2, f"2024-01-01 00:00:{k % 2:02d}", props[k % 2]) for k in range(80)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts string, props string").write.parquet(str(tmp_path / "events.parquet"))
    sizes, sides = [], J._text_sides
    monkeypatch.setattr(J, "_text_sides", lambda pairs: sizes.append(pairs.count()) or sides(pairs))
    found = J.event_match(spark, str(tmp_path)).collect()
    assert sizes == [1]
    assert len({r.key for r in found}) == 40 and len(found) == 40 * len({(r.src_id, r.dst_id) for r in found})
