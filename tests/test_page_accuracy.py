import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope import catalog
from folioscope.operators import scoring
from tests.oracle import assert_same


@pytest.mark.parametrize("name", ["greedy_match_score", "paired_compare"])
def test_no_page_on_both_sides_is_null_as_in_sql(spark, tmp_path, name):
    # of three equal titles the second prediction set lacks the first: no matched pair has two pages
    text = "\n".join(["body " * 20, "Same title here.", "Same title here.", "Same title here.", "Other"])
    docs = spark.createDataFrame([(0, text), (1, text + "\nMore"), (2, "a\nb\nc\nd\ne\nf"), (4, text.removesuffix("\nOther"))], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert_same(catalog.QUERIES[name](spark, str(tmp_path)), con, catalog.ORACLES[name])


def test_a_missing_page_is_a_miss_unless_told(spark):
    gold = spark.createDataFrame([(1, 0, "a", 1, 3)], "doc_id long, pos int, title string, level int, printed_page int")
    pred = gold.withColumn("printed_page", F.lit(None).cast("int"))
    assert scoring.score_outlines(gold, pred).first()["page_accuracy"] == 0.0
    assert scoring.score_outlines(gold, pred, missing_is_miss=False).first()["page_accuracy"] is None
