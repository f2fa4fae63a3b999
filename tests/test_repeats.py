"""Titles that a document repeats cost their lines and entries, not the product; lines are made in one pass."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.python_semantics import SequenceMatcher
from folioscope.operators import align, headings, locate, scoring
from folioscope.sources import views as V


def _repeated(spark, n):
    lines = spark.range(n).selectExpr("0L as doc_id", "cast(id as int) as line_no", "'Same title here' as text", "cast(id div 20 as int) as page", "0D as y")
    toc = lines.selectExpr("doc_id", "line_no as pos", "text as title", "1 as level", "page + 1 as page", "page + 1 as printed_page")
    return lines, toc


def _places(df):
    """The places that the fold is sent."""
    return df.where("c is not null").agg(F.sum(F.size("c"))).first()[0]


def test_repeated_titles_share_their_places(spark, monkeypatch):
    lines, toc = _repeated(spark, 400)
    sent, real = [], type(lines).mapInArrow
    monkeypatch.setattr(type(lines), "mapInArrow", lambda df, *a, **k: sent.append(_places(df)) or real(df, *a, **k))
    got = locate.locate_hinted(toc, lines).orderBy("pos").collect()
    assert [r["page"] for r in got] == [i // 20 for i in range(400)] and not any(r["failed"] for r in got)
    assert sent == [20]  # before: 400 places for each of 400 entries


def test_claims_of_a_repeated_title_send_each_line_once(spark, monkeypatch):
    lines, toc = _repeated(spark, 400)
    sent, real = [], type(lines).mapInArrow
    monkeypatch.setattr(type(lines), "mapInArrow", lambda df, *a, **k: sent.append("ls" in df.columns or df.count()) or real(df, *a, **k))
    assert sorted(r["line_no"] for r in align.claims(lines, toc).collect()) == list(range(400))
    assert sent == [800]


@pytest.mark.parametrize("seed", [0, 1])
def test_printed_pages_equal_a_plain_fold_where_titles_repeat(spark, seed):
    rnd = random.Random(seed)
    words = ["first chapter one", "first chapter two", "first chapters one", "second part", "second parts", "", "."]
    gold, rows = ([(d, p, rnd.choice(words)) for d in range(6) for p in range(30)] for _ in range(2))
    g = spark.createDataFrame(gold, "doc_id long, pos int, title string")
    r = spark.createDataFrame([(*x, x[1] * 2) for x in rows], "doc_id long, pos int, title string, printed_page int")
    key = lambda t: T.python_keys(t, ("k_title",))[0]
    want = {}
    for d in range(6):
        left = [(p, key(t)) for x, p, t in rows if x == d]
        for _, pos, t in (x for x in gold if x[0] == d):
            ratio = lambda b: SequenceMatcher(None, key(t), b).ratio()  # noqa: B023, E731
            best = min(((-ratio(b), p, b) for p, b in left if ratio(b) >= align.SIMILAR), default=None)
            want[d, pos] = None if best is None else best[1] * 2
            if best:
                left.remove(best[1:])
    assert {(x["doc_id"], x["pos"]): x["printed_page"] for x in align.align_printed_pages(g, r).collect()} == want


def test_lines_pass_python_once_and_carry_what_operators_would_make(spark, tmp_path):
    texts = ["Contents\n\n1 Intro ..... 3\nA_b  c.\n" + "body words " * 20, "x\nx", "", None, "many words " * 9 + "\n4 Ünder_Scored .. 12\x85", "a " * 7 + "\nb\nc d e f"]
    docs = spark.createDataFrame([(i // 2 if i == 1 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    lines = V.doc_lines(spark, str(tmp_path))
    plain = lines.select("doc_id", "line_no", "text", "size")
    c = F.col("text")
    kind = F.when(T.is_heading(T.strip(c)), T.HEADING).when(T.is_row(T.strip(c)), T.ROW).otherwise(0)
    made = {"k_match": T.match_key(c), "k_bare": T.bare_key(c), "k_merge": T.merge_key(c), "n_words": T.n_words(c), "contents": kind}
    want = plain.select("doc_id", "line_no", "text", *(v.alias(k) for k, v in made.items())).join(headings.body_size(plain), "doc_id")
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "line_no", "text", *made, "body").collect()))
    assert rows(lines) == rows(want) and lines.where("contents > 0").count() == 3
    gold = V.gold(spark, str(tmp_path))
    assert gold.where(F.col("k_title") != T.title_key(F.col("title"))).count() == 0 and gold.where("k_title is null").count() == 0


def test_bootstrap_reads_its_pairs_once(spark):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        asked.add(1)
        return x

    pairs = spark.range(20).select(F.lit("f1").alias("metric"), F.col("id").alias("doc_id"), counted(F.col("id") / 20).alias("delta"))
    scoring.bootstrap(pairs, 50).collect()
    assert asked.value == 20
