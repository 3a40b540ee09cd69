from palimpsest.operators import nodes as N


def test_repeated_subtrees_count_documents_exactly(spark):
    rows = [(k // 2, 7, 3, 4, "element") for k in range(6_000)] + [(1, 8, 3, 4, "element")]
    nodes = spark.createDataFrame(rows, "key long, h_full long, height int, pre_size int, type string")
    assert [(r.places, r.documents) for r in N.repeated_subtrees(nodes).collect()] == [(6_000, 3_000)]
