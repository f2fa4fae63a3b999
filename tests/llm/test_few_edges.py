import random

from folioscope.llm import _common, near_dedup


def test_few_edges_take_no_rounds(spark, monkeypatch):
    made, table = [], _common.table
    monkeypatch.setattr(_common, "table", lambda df, name: made.append(name) or table(df, name))
    draw = random.Random(5)
    rows = [(i, i - 1) for i in range(1, 40)] + [(draw.randrange(100, 300), draw.randrange(100, 300)) for _ in range(120)] + [(900, 900)]
    edges = spark.createDataFrame(rows, "a long, b long")
    got = {tuple(r) for r in _common.components(edges).collect()}
    # before: a table for each of several rounds over the chain of 40
    assert made == ["edges"]
    assert got == {tuple(r) for r in _common.components(edges, few=0).collect()} and len(made) > 3
    assert {(i, 0) for i in range(40)} <= got and not any(x == 900 for x, _ in got)
    assert _common.components(edges.where("a < 0")).collect() == []


def test_texts_of_few_candidates_are_not_shuffled(spark, monkeypatch):
    made, table = [], near_dedup.table
    monkeypatch.setattr(near_dedup, "table", lambda df, name: made.append((name, df)) or table(df, name))
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[40 * i : 40 * i + 40]) for i in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts + [f"{t} more" for t in texts[:3]])), "doc_id long, text string")
    want = {i: i for i in range(8)} | {8: 0, 9: 1, 10: 2}
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()} == want
    plan = lambda name: next(df for n, df in made if n == name)._jdf.queryExecution().sparkPlan().toString()
    # before: every text went to the task of its hash
    assert "SortMergeJoin" not in plan("sequences") and "SortMergeJoin" not in plan("links")
    made.clear()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()} == want
        assert "SortMergeJoin" in plan("sequences")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
