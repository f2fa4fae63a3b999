from pyspark.sql import functions as F

from folioscope.plans import backends, corpus

_DOC = "doc_id long, file string, sha256 string, page_count int, unreadable boolean, encrypted boolean, toc array<struct<level:int,title:string,page:int>>"
_LINE = "doc_id long, line_no int, text string, page int, x double, y double, size double, bold boolean"


def _tables(spark):
    docs = spark.createDataFrame([(d, f"{d}.pdf", f"{d}", 9, False, False, [(1, "Methods", 1)] if d == 3 else None) for d in range(4)], _DOC)
    rows = [(d, i, "Methods" if i == 0 else f"body text of line {i}", i // 4, 72.0, 72.0 + 18 * (i % 4), 16.0 if i == 0 else 10.0, False) for d in range(4) for i in range(12)]
    return docs, spark.createDataFrame(rows, _LINE)


def test_a_teacher_is_asked_once(spark, tmp_path):
    asked = str(tmp_path / "asked")

    def generate(prompts):
        with open(asked, "a") as f:
            f.write("x\n" * len(prompts))
        return ['{"entries": [{"title": "Methods", "level": 1, "printed_page": null}]}'] * len(prompts)

    records, reasons = corpus.distill(*_tables(spark), backends.GeneratingBackend(generate))
    assert sorted(r["doc_id"] for r in records.collect()) == [0, 1, 2]
    assert [tuple(r) for r in reasons.collect()] == [(3, "has-embedded-outline")]
    # before: once for the titles to locate, and once more for the records
    assert len(open(asked).read().split()) == 3


def test_contents_are_found_once(spark):
    docs, lines = _tables(spark)
    records, reasons = corpus.harvest(docs, lines, augment=True)
    assert records.where(F.col("doc_id") == 3).count() == 1
    # before: each step that takes contents pages looked for them in the lines
    for df in (records, reasons):
        assert "bad#" not in df._jdf.queryExecution().optimizedPlan().toString()
