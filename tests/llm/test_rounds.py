from folioscope.llm import _common, line_dedup, near_dedup


def _counted(monkeypatch, module, name, kinds):
    f = getattr(module, name)

    def count(df, *args):
        kinds.append((args[0] if args else name, df))
        return f(df, *args)

    monkeypatch.setattr(module, name, count)


def test_stars_are_settled(spark, monkeypatch):
    made = []
    _counted(monkeypatch, _common, "table", made)
    stars = spark.createDataFrame([(i, i // 10 * 10) for i in range(40)], "a long, b long")
    got = {r["node"]: r["component"] for r in _common.components(stars).collect()}
    assert got == {i: i // 10 * 10 for i in range(40)}
    # before: two rounds, the second to see that the first had changed nothing
    assert len(made) == 1


def test_two_smaller_neighbours_are_not_settled(spark):
    edges = spark.createDataFrame([(3, 1), (3, 2), (7, 5), (5, 4)], "a long, b long")
    assert {tuple(r) for r in _common.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (7, 4)}


def test_rounds_without_links_change_no_component(spark, monkeypatch):
    calls = []
    _counted(monkeypatch, near_dedup, "components", calls)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[40 * i : 40 * i + 40]) for i in range(8)]
    texts += [f"{t} more" for t in texts[:3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {i: i for i in range(8)} | {8: 0, 9: 1, 10: 2}
    # before: four times, whatever was found
    assert len(calls) == 1


def test_partners_are_aligned_in_one_pass(spark, monkeypatch):
    made = []
    _counted(monkeypatch, line_dedup, "table", made)
    line, other = "one line of six common words", "another line of six common words"
    docs = spark.createDataFrame([(1, line), (2, line), (3, f"{line}\nown\n{other}"), (4, f"{other}\nmine")], "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in line_dedup.remove_common_lines(docs).collect()}
    assert got == {1: line, 2: "", 3: f"own\n{other}", 4: "mine"}
    hits = next(df for name, df in made if name == "hits")
    # before: copies and others were joined and aligned apart
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
