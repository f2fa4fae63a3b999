from pyspark.sql import functions as F

from folioscope.functions import text as T


def test_keys_in_one_pass_equal_the_expressions(spark):
    odd = ["Part IV: The_End", "3.1 Étude -- n° 2", ". . a ", "　Annex b.  x\x1cy\x85", "ΑΣ İ", "a. ", "Chapter 1 2. ", "", None, "²_½́"]
    df = spark.createDataFrame([(t,) for t in odd], "text string")
    c = F.col("text")
    want = {"k_title": T.title_key(c), "k_match": T.match_key(c), "k_bare": T.bare_key(c), "k_merge": T.merge_key(c), "k_plain": T.plain_key(c), "n_words": T.n_words(c)}
    made = T.with_keys(df, "text", *want)
    assert made.select(*want).collect() == df.select(*(v.alias(k) for k, v in want.items())).collect()
    # no expression of Java's patterns is left over the lines
    assert "regexp" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_contents_are_told_by_the_whole_pattern(spark):
    df = spark.createDataFrame([("Intro .... 3",), ("Intro 3",), ("Intro .... iii",), ("Intro .... 12345",), ("Table of Contents",), ("",)], "s string")
    got = df.select(T.is_row(F.col("s")), F.col("s").rlike(T.CONTENTS_ROW), T.is_heading(F.col("s")), F.col("s").rlike(T.CONTENTS_HEADING)).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in got)
