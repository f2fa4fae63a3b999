"""Benchmark decontamination with a distributed positional inverted index (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm._common import beside, checked, lower_ascii, table

#: What separates words here: ASCII characters other than letters and digits.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Terms of a phrase, the rarest first, whose whole lists are read.
FEW = 3


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none for null."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP)
    # only the first and the last part can be empty
    last = F.when(F.element_at(parts, -1) == "", F.size(parts) - 1).otherwise(F.size(parts))
    first = F.when(F.get(parts, F.lit(0)) == "", 2).otherwise(1)
    return F.slice(parts, first, F.greatest(last - first + 1, F.lit(0)))


def phrases(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, first, off, term, length): the terms of each window of each item; an item of fewer words is one window."""
    w = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    n = F.size("w")
    w = w.select("item", F.explode(F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))).alias("first"), "w")
    piece = F.slice("w", F.col("first"), F.lit(window))
    w = w.select("item", "first", piece.alias("piece"), F.size(piece).alias("length"))
    return w.select("item", "first", "length", F.posexplode("piece").alias("off", "term"))


def index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of docs, stored: a posting (rid, pos, tid) for each word that is one of `terms` (term, tid).

    It is cut by documents, as they are read: postings of a document stay together in order, and nothing is shuffled
    to build it.  Each row also has a posting that carries its id and n_words; its pos is 0, or null without words.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    rows = rows.select("rid", "doc_id", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("pos", "term"))
    rows = rows.join(checked(terms), "term", "left").where("tid is not null or pos is null or pos = 0")
    head = F.col("pos").isNull() | (F.col("pos") == 0)
    return table(rows.select("rid", F.when(head, F.col("doc_id")).alias("doc_id"), F.when(head, F.col("n_words")).alias("n_words"), "pos", "tid"), "postings")


def find(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Exact matches: (rid, item, first, start, length), a row for each place where a phrase's words follow one another.

    wanted: (item, first, length, off, tid).  The postings of each phrase's rarest term (of equally rare ones the
    earliest) are moved by its offset and give the places where the phrase may start.  They are intersected with the
    moved postings of the second and the third rarest term, whose lists are short too; the long lists of common terms
    are then read in the documents that are left only, where all of them must be there.
    """
    times = postings.where("tid is not null").groupBy("tid").agg(F.count("*").alias("times"))
    ranked = wanted.join(times, "tid", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    by = Window.partitionBy("item", "first").orderBy("times", "off")
    ranked = table(ranked.withColumn("rank", F.row_number().over(by)), "ranked")
    rarest = ranked.where("rank = 1 and times > 0").select("item", "first", "length", F.col("off").alias("shift"), "tid")
    hits = postings.where("tid is not null").select("rid", "pos", "tid")
    may = hits.join(checked(table(rarest, "rarest")), "tid").where("pos >= shift")
    may = table(may.select("rid", "item", "first", "length", (F.col("pos") - F.col("shift")).alias("start")), "places")
    for rank in range(2, FEW + 1):
        term = table(ranked.where(F.col("rank") == rank).select("item", "first", "off", "tid"), "terms")
        listed = hits.join(checked(table(term.select("tid").distinct(), "ids")), "tid", "left_semi")
        need = may.join(checked(term), ["item", "first"]).withColumn("pos", F.col("start") + F.col("off"))
        met = need.join(listed, ["rid", "pos", "tid"], "left_semi").select(may.columns)
        may = table(met.unionByName(may.where(F.col("length") < rank)), "places")
    docs = table(may.select("rid").distinct(), "concerned")
    near = hits.join(checked(docs), "rid", "left_semi")
    rest = table(ranked.where(F.col("rank") > FEW).select("item", "first", "off", "tid"), "others")
    need = may.join(checked(rest), ["item", "first"])
    need = need.select("rid", "item", "first", "start", "tid", (F.col("start") + F.col("off")).alias("pos"))
    there = need.join(near, ["rid", "pos", "tid"]).groupBy("rid", "item", "first", "start").agg(F.count("*").alias("others"))
    key = ["rid", "item", "first", "start"]
    return may.join(there, key, "left").where(F.coalesce("others", F.lit(0)) == F.greatest(F.col("length") - FEW, F.lit(0))).select(*key, "length")


def proximity(postings: DataFrame, wanted: DataFrame, within: int) -> DataFrame:
    """Proximity matches: (rid, item, first, start), where the `within` words from start on hold all terms of a phrase.

    start is a posting of one of the terms.  As in `find`, the rarest term names the documents; the lists of the
    other terms are read there only, and a sliding window over a document's postings counts the distinct terms.
    """
    times = postings.where("tid is not null").groupBy("tid").agg(F.count("*").alias("times"))
    by = Window.partitionBy("item", "first")
    terms = wanted.select("item", "first", "tid").distinct().join(times, "tid", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    terms = terms.withColumns({"rank": F.row_number().over(by.orderBy("times", "tid")), "kinds": F.count("*").over(by)})
    hits = postings.where("tid is not null").select("rid", "pos", "tid")
    rare = hits.join(terms.where("rank = 1 and times > 0"), "tid").select("rid", "item", "first").distinct()
    own = rare.join(terms.select("item", "first", "tid", "kinds"), ["item", "first"]).join(hits, ["rid", "tid"])
    ahead = Window.partitionBy("rid", "item", "first").orderBy("pos").rangeBetween(0, within - 1)
    own = own.withColumn("n", F.size(F.collect_set("tid").over(ahead)))
    return own.where("n = kinds").select("rid", "item", "first", F.col("pos").alias("start"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every row of docs: doc_id, n_words, n_hit, items (distinct ids with an occurring window, sorted as strings).

    A word is hit if any occurrence of a window of any item covers it.  Items with equal windows all count.  A null
    text, of a document or an item, has no words; such an item has no window.  A null item id is left out of `items`
    but its words are hit.  Rows of docs are judged one by one, repeated or not; repeated items change nothing.
    """
    wanted = phrases(items, window, item_col, item_text)
    terms = table(wanted.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "terms")
    # equal windows are looked for once
    whole = wanted.groupBy("item", "first", "length").agg(F.array_sort(F.collect_set(F.struct("off", "term"))).alias("p"))
    whole = table(whole.withColumn("phrase", F.sha2(F.to_json(F.transform("p", lambda x: x["term"])).cast("binary"), 256)), "phrases")
    one = whole.groupBy("phrase").agg(F.min_by("p", F.struct("first")).alias("p"), F.min("length").alias("length"))
    one = one.select(F.col("phrase").alias("item"), F.lit(1).alias("first"), "length", F.explode("p").alias("x"))
    one = one.select("item", "first", "length", F.col("x.off").alias("off"), F.col("x.term").alias("term")).join(terms, "term").drop("term")
    postings = index(docs, terms, id_col, text_col)
    found = table(find(postings, table(one, "wanted")), "found")
    covered = found.select("rid", F.explode(F.expr("sequence(start, start + length - 1)")).alias("p")).distinct()
    n_hit = covered.groupBy("rid").agg(F.count("*").alias("n_hit"))
    names = whole.select("phrase", F.col("item").cast("string").alias("name")).distinct()
    met = found.select("rid", F.col("item").alias("phrase")).distinct().join(checked(table(names, "names")), "phrase")
    met = met.groupBy("rid").agg(F.array_sort(F.collect_set("name")).alias("items"))
    told = table(n_hit.join(met, "rid", "left"), "told")
    base = postings.where("n_words is not null").select("rid", "doc_id", "n_words")
    return base.join(beside(told), "rid", "left").select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def op6_decontaminate(spark, sf_dir):
    """All documents against all benchmark items, windows of 10 words."""
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = {
    "op6_decontaminate": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len(w[i:i+9]) AS n, array_to_string(w[i:i+9], ' ') AS k FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, bw.n, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(cov.n_hit, 0)::BIGINT AS n_hit, coalesce(its.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(its.s, '')) AS items_sha256, coalesce(cov.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
""",
}
