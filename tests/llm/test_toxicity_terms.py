from palimpsest.llm import toxicity as T


def test_rare_toxic_words_find_their_neighbours(spark):
    """Wording with fewer than five toxic rows, and clean text, have neighbours; nothing shares one constant score."""
    clean = [f"guten morgen nummer{k} aus der stadt{k % 7}" for k in range(60)]
    toxic = [f"dreckiger lump nummer{k}" for k in range(60, 63)] + [f"vile scum number{k}" for k in range(63, 83)]
    rows = list(enumerate(clean + toxic))
    labels = [(k, int(k >= 60)) for k, _ in rows]
    rows += [(900, "du dreckiger lump"), (901, "guten morgen aus der stadt3"), (902, "zzz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = T.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in T.score_documents(docs, model).collect()}
    assert {int(e.split(":")[0]) for e in got[900].evidence} == {60, 61, 62}
    assert all(0 <= int(e.split(":")[0]) < 60 for e in got[901].evidence) and len(got[901].evidence) == 3
    assert got[901].score < 0.5 < got[900].score
    assert got[902].evidence == []
