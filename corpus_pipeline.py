"""A training corpus in five stages: quality, line dedup, near-dedup, decontamination, mixing.

Each stage works on all that its predecessor kept, given as a table, and its decisions take effect: all but the last
return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontamination, line_dedup, mixing, near_dedup, quality
from folioscope.llm._common import beside, drop, only, table, text_hash
from folioscope.ship import ship


KEY = "row_key"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs, stored, with a key of each row: 128 bits of its text, 64 of the whole row, and its number.

    Ids are no keys: they may be null or repeated with other texts.  Only the number tells equal rows apart.
    """
    whole = F.xxhash64(*docs.columns)
    key = F.struct(*text_hash(F.col("text")), whole.alias("whole"), F.monotonically_increasing_id().alias("no"))
    return table(docs.withColumn(KEY, key).withColumn("row_no", F.col(f"{KEY}.no")), "keyed")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels, does not reject.

    Rows are judged one by one, by their text alone: repeated rows alike, a null or empty text by the prior.  Without
    labels of both kinds every row gets the same score.  All columns pass through, whatever they are called.
    """
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.fit(docs, labels))


def cut_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that are aligned with an earlier document's; those left without any word go.

    A text that loses nothing, null and empty ones too, stays as it is; n_chars follows a text that is cut.  Rows that
    repeat an id are cut each by itself and are no partners of one another; a null id sorts last.  Other columns pass.
    """
    ship(spark)
    out = line_dedup.remove_common_lines(docs)
    left = (F.col("n_removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]")
    own = [c for c in docs.columns if c not in ("text", "n_chars")]
    row = {c: F.col(f"row.{c}") for c in own}
    row["text"] = F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.col("kept"))
    if "n_chars" in docs.columns:
        changed = F.char_length("kept").cast(dict(docs.dtypes)["n_chars"])
        row["n_chars"] = F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(changed)
    return out.where(left).select(*(row[c].alias(c) for c in docs.columns))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest id (null last), then the least key; of rows
    that repeat both id and text, one."""
    keyed = _keyed(docs)

    def best() -> DataFrame:
        found = near_dedup.near_duplicates(keyed, id_col="row_no").select(F.col("doc_id").alias("row_no"), "class_id")
        rows = keyed.select("row_no", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", KEY).alias("x")).join(beside(found), "row_no")
        best = rows.groupBy("class_id").agg(F.min("x").alias("x"))
        # texts without words are in no group
        best = best.groupBy("x.doc_id", f"x.{KEY}.t1", f"x.{KEY}.t2").agg(F.min(f"x.{KEY}").alias(KEY))
        return best.select(F.col(f"{KEY}.no").alias("row_no"))

    return keyed.join(beside(only(best, "kept")), "row_no", "left_semi").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item.

    Each row is judged by its own text, whatever its id; a null or empty text, or an empty benchmark, drops nothing.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # rows of equal texts are judged alike, so a text's 128 bits are key enough
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "text", F.struct(*text_hash(F.col("text"))).alias("key"))

    def hit() -> DataFrame:
        found = decontamination.decontaminate(keyed.select("key", "text"), items, id_col="key").where("n_hit > 0")
        return found.select("doc_id.t1", "doc_id.t2").distinct()

    return keyed.select("row", "key.t1", "key.t2").join(beside(only(hit, "hit")), ["t1", "t2"], "left_anti").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix as it is read: a row for each reading of a document, range-sorted by position.

    text is what that reading takes, the whole text or, in the last one of a source, its first words; taken counts its
    words, so that sums over rows are the mix's.  Documents of which nothing is taken, and those without words, have no
    row.  Rows count one by one, also where they repeat an id; a null source is a source of its own.
    """
    keyed = _keyed(docs)
    plan = mixing.mix(keyed, row_col=KEY).where("taken > 0")
    plan = plan.select("*", F.posexplode("passes").alias("reading", "at")).drop("passes", "position").withColumnRenamed("at", "position")
    plan = plan.withColumn("taken", F.least("size", F.col("taken") - F.col("reading") * F.col("size"))).withColumn("no", F.col("row.no"))
    texts = keyed.select(F.col("row_no").alias("no"), "text", "lang")
    out = plan.join(beside(texts), "no")
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    part = F.array_join(F.slice(words, F.lit(1), F.col("taken").cast("int")), "")
    text = F.when(F.col("taken") < F.col("size"), part).otherwise(F.col("text"))
    out = out.select("source", "size", "source_size", "target", "taken", "reading", "position", "doc_id", text.alias("text"), "lang")
    return out.orderBy("position", F.asc_nulls_last("doc_id"), "reading")


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", cut_common_lines),
    ("minhash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mixed),
]

#: Classifier, alignment and sketches are beyond SQL; tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage keeps is stored until the next one has read it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        docs = only(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "_").replace("-", "_"))
        if last is not None:
            drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
