from palimpsest.llm import language


def test_few_texts_share_the_whole_dictionary(spark):
    head = "the same head of every text " * 20
    rows = [(k, head + f" body{k} " * 400 + f"tail{k}", "en") for k in range(5)] + [(9, "kurz", "de"), (10, "ä" * 90_000, "de")]
    made = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert all(f"body{k}".encode() in made["en"] and f"tail{k}".encode() in made["en"] for k in range(5))
    assert b"kurz" in made["de"] and 47_000 < len(made["de"]) <= language.DICTIONARY_BYTES


def test_share():
    assert language.share([10, 10], 100) == 10 and language.share([10, 200, 300], 100) == 45 and language.share([], 5) == 0
