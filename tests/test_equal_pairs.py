from palimpsest.operators import editscript as E


def test_only_the_columns_asked_for_leave_the_tasks_and_equal_texts_give_equal_rows(spark):
    texts = [('{"k": 1}', '{"k": 2}'), ("{}", '{"m": "x"}'), (None, None), ("{}", "{}")]
    rows = [(n, n + 100, *texts[n % 4]) for n in range(40)]
    pairs = spark.createDataFrame(rows, "a long, b long, src string, dst string")
    columns = ("a", "b", "seq", "action", "type", "old_value", "new_value")
    few = E.tree_actions(pairs, "json", collapsed=False, columns=columns)
    assert few.columns == list(columns)
    every = E.tree_actions(pairs, "json", collapsed=False).select(*columns)
    assert sorted(map(str, few.collect())) == sorted(map(str, every.collect()))
    assert {r.a: r.new_value for r in few.where("action = 'update'").collect()} == {n: "2" for n in range(0, 40, 4)}
