"""The pipeline's stages, each against its own operator's definition on a small fixture."""

from pathlib import Path

import pytest

import corpus_pipeline
from folioscope import scratch
from folioscope.llm import line_dedup
from tests.llm.helpers import corpus
from tests.llm.test_operators import all_earlier, brute_hits, exact_classes


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with tables of the pipeline's inputs."""
    top = tmp_path_factory.mktemp("small")
    rows = corpus(11, 50)
    good = [(i + 1000, "\n".join(" ".join(t.split()[k : k + 9]) for k in range(0, 30, 9)), "en", "s1", 0) for i, (_, t, *_) in enumerate(rows) if t]
    bad = [(i + 2000, "$$$ %%% &&& *** " * (10 + i), "en", "s2", 0) for i in range(40)]
    leak = " ".join(f"leak{i}" for i in range(14))
    good.append((1900, "a line of its own that nobody else has\nand here " + leak + " goes on", "en", "s1", 0))
    items = [(1, leak), (2, "never seen words"), (3, None)]
    docs = spark.createDataFrame(rows + good + bad, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    lab = [(d, 1, 0) for d, *_ in rows + good] + [(d, 0, 0) for d, *_ in bad]
    spark.createDataFrame(lab, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top), items


def test_stages(spark, small, monkeypatch):
    # with every document that shares a line as a partner, line dedup is an alignment with all earlier ones
    monkeypatch.setattr(line_dedup, "RARE", 999)
    sf_dir, items = small
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = corpus_pipeline.table(stage(spark, docs, sf_dir), "stage")
        assert out.columns == columns
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "quality classifier":
            assert not any(2000 <= d for d in got) and sum(d < 1000 for d in got) > 0.9 * sum(d < 1000 for d, _ in rows)
        elif name == "line dedup":
            want = all_earlier(rows)
            assert got == {d: w if w != (t or "") else t for (d, t), w in ((r, want[r[0]]) for r in rows) if w == (t or "") or w.split()}
        elif name == "minhash near-dedup":
            assert got == {d: t for d, t in rows if exact_classes(rows)[d] == d}
        else:
            hits = brute_hits(rows, items, 10)
            assert hits[1900][1] and got == {d: t for d, t in rows if not hits[d][1]} and len(got) < len(rows)
        docs = out
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert [r["position"] for r in mixed] == sorted(r["position"] for r in mixed)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in mixed} <= set(texts)
    by_source, target = {}, {}
    for r in mixed:
        # a reading has the whole text, or its first words
        assert r["taken"] == len(r["text"].split()) and texts[r["doc_id"]].startswith(r["text"]) and r["taken"] <= r["size"]
        assert r["taken"] == r["size"] or r["text"] != texts[r["doc_id"]]
        by_source[r["source"]] = by_source.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(by_source[s] - target[s]) <= 1 for s in target) and max(r["reading"] for r in mixed) > 0


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small[0]).count() > 20
    assert [f for _, f in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


def test_rows_that_share_an_id(spark, tmp_path):
    """Null and repeated ids: each row is judged by its own text."""
    leak = " ".join(f"leak{i}" for i in range(14))
    copied, alone, other, nulls, nearly = (" ".join(f"{name}{i}" for i in range(80)) for name in ("copied", "alone", "other", "nulls", "nearly"))
    rows = [
        (3, copied), (5, copied), (5, alone), (7, alone), (8, other), (8, nulls + " here"), (8, other), (9, None), (9, ""), (9, None),
        (None, nulls), (None, nearly), (None, copied + " more"), (None, leak + " and so on"), (11, leak), (11, "quite clean"),
    ]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.repartition(3)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    one = corpus_pipeline.keep_one_of_each(spark, docs, str(tmp_path))
    want = [
        (3, copied), (5, alone), (8, other), (8, nulls + " here"), (9, None), (9, ""), (None, nearly), (None, leak + " and so on"), (11, leak),
        (11, "quite clean"),
    ]
    # the leak in 11 has 10 of the 13 k-mers of the text with a null id: no near copy
    assert one.columns == docs.columns and pairs(one) == sorted(want, key=str)
    clean = corpus_pipeline.drop_contaminated(spark, one, str(tmp_path))
    want = [x for x in want if "leak0" not in (x[1] or "")]
    assert clean.columns == docs.columns and pairs(clean) == sorted(want, key=str)
    mixed = corpus_pipeline.mixed(spark, clean, str(tmp_path))
    assert mixed.columns[-3:] == ["doc_id", "text", "lang"]
    # one source: every document is read once, as a whole
    assert sorted(pairs(mixed.where("size > 0")), key=str) == sorted((x for x in want if x[1]), key=str)


def test_stages_of_nothing_and_of_odd_columns(spark, tmp_path):
    """Each stage passes an empty table, and a table of nulls with further columns, on."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_no int, taken string"
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    nulls = spark.createDataFrame([(None,) * 7] * 2 + [(1, "some words", None, None, None, 3, "x"), (2, "", "en", "s", 0, None, None)], schema)
    for name, stage in corpus_pipeline.STAGES:
        for docs, n in ((nulls.where("false"), 0), (nulls, 4)):
            out = stage(spark, docs, str(tmp_path))
            if name == "mixing":
                assert out.count() == n // 4
            elif name == "quality classifier":
                # without labels the prior is even, and an even score is accepted
                assert out.columns == docs.columns and out.count() == n
            elif name == "minhash near-dedup":
                # of rows that repeat both id and text, one stays
                assert out.columns == docs.columns and out.count() == max(n - 1, 0)
            else:
                assert out.columns == docs.columns and out.count() == n


def test_what_stages_leave_on_disk(spark, small):
    """A stage leaves the tables that its result is read from; the pipeline those of the mix and what the mix reads."""
    sf_dir, _ = small
    top = Path(scratch.scratch_dir(spark).removeprefix("file://")) / "folioscope"
    tables = lambda: {p.name for p in top.glob("*")}
    names = lambda new: sorted(p.rsplit("-", 1)[0] for p in new)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = [["gone"], ["kept", "keyed"], ["hit"]]
    for (_, stage), want in zip(corpus_pipeline.STAGES[1:4], left, strict=True):
        before = tables()
        out = stage(spark, docs, sf_dir)
        assert names(tables() - before) == sorted(want) and 0 < out.count() <= docs.count()
    before = tables()
    out = corpus_pipeline.run(spark, sf_dir)
    assert names(tables() - before) == ["benchmark_decontamination", "bins", "keyed", "sizes", "sources"] and out.count() > 20


def test_only_deletes_what_was_made_inside(spark):
    outside = scratch.table(spark.range(3), "outside")
    inner = []

    def make(deep):
        inner.append(scratch.only(lambda: make(deep - 1), "deep") if deep else scratch.table(spark.range(5), "inner"))
        return inner[-1].join(outside, "id")

    out = scratch.only(lambda: make(1), "out")
    there = lambda df: Path(df._folioscope_path.removeprefix("file://")).exists()
    assert out.count() == 3 and there(out) and there(outside) and not any(map(there, inner))
