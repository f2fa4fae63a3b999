"""Files in and out: PDF scans with guards, JSON lines, feeds, outlines and splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.extract import BLOCKS, PROBE_PAGES
from folioscope.operators.levels import outline_rows

MAX_BYTES = 50 << 20
MAGIC = "%PDF-"

RECORD = (
    "file string, sha256 string, page_count int, context_kind string, context string, "
    "entries array<struct<title:string,level:int,printed_page:int>>, alignment double, silver boolean"
)
PREDICTION = "sha256 string, entries array<struct<title:string,level:int,printed_page:int,page:int>>, parse_error boolean, model string"


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """PDFs below path: path, length, sha256, content, and status `too-large`, `not-a-pdf` or null.

    The size is checked on the listing, so content of files that are too large is not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path)
    small = files.where(F.col("length") <= MAX_BYTES)
    large = files.where(F.col("length") > MAX_BYTES).select("path", "length")
    magic = F.substring(F.col("content"), 1, len(MAGIC)) == F.lit(MAGIC).cast("binary")
    ok = small.select("path", "length", F.sha2("content", 256).alias("sha256"), "content", F.when(~magic, "not-a-pdf").alias("status"))
    return ok.unionByName(large.withColumn("status", F.lit("too-large")), allowMissingColumns=True)


DECODED = f"doc_id string, file string, sha256 string, status string, page_count int, toc array<struct<level:int,title:string,page:int>>, pages array<struct<page:int,blocks:{BLOCKS}>>"


def decode(files: DataFrame, decoder: Callable, optical: Callable | None = None, ocr_mode: str = "auto", ocr_max_pages: int | None = None, replace_existing: bool = True) -> DataFrame:
    """Documents of files by a plug-in decoder: DECODED, one row a file; whatever goes wrong becomes a status.

    decoder(bytes) returns a dict: page_count, encrypted, toc (level, title, page from 1) and pages, an iterable of (page,
    blocks) that may be lazy.  optical(bytes) yields (page, blocks) by OCR; without it documents that need it stop with
    OcrUnavailable.  An encrypted document, or one with an outline that may not be replaced, is not read further.
    """
    if ocr_mode not in ("auto", "force", "never"):
        raise ValueError(f"OCR mode must be auto, force or never, not {ocr_mode!r}")

    def one(content: bytes) -> tuple:
        try:
            d = decoder(content)
        except Exception:  # noqa: BLE001  any failure to open is that document's status
            return "InvalidPdf", None, None, None
        head = (d.get("page_count"), [{"level": a, "title": b, "page": c} for a, b, c in d.get("toc") or []])
        if d.get("encrypted"):
            return "Encrypted", *head, None
        if head[1] and not replace_existing:
            return "ExistingBookmarks", *head, None
        pages = list(d.get("pages") or [])
        texts = (s.get("text") or "" for n, blocks in pages if n < PROBE_PAGES for k in blocks for ln in k.get("lines") or [] for s in ln.get("spans") or [])
        has_text = any(t.strip() for t in texts)
        if ocr_mode == "force" or (ocr_mode == "auto" and not has_text):
            if optical is None:
                return "OcrUnavailable", *head, None
            if ocr_max_pages is not None and (head[0] or 0) > ocr_max_pages:
                return "OcrPageLimit", *head, None
            pages = list(optical(content))
        elif not has_text:
            return "NoTextLayer", *head, None
        return None, *head, [{"page": n, "blocks": blocks} for n, blocks in pages]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(r.sha256, r.path, r.sha256, *one(bytes(r.content))) for r in pdf.itertuples()]
            yield pd.DataFrame(rows, columns=["doc_id", "file", "sha256", "status", "page_count", "toc", "pages"]).astype({"page_count": "Int32"})

    return files.where("status is null").select("path", "sha256", "content").mapInPandas(run, DECODED)


def decoded_pages(decoded: DataFrame) -> DataFrame:
    """(doc_id, page, blocks) of documents that could be read, as `extract.lines_from_blocks` takes them."""
    return decoded.where("status is null").select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.page", "p.blocks")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a fixed schema, blank lines left out; of a path that does not exist, no rows.  A bad line fails."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(prompt, completion) of one split as `write_splits` stores it; a split that was never written is empty."""
    return read_json(spark, path, "prompt string, completion string")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, RECORD)


LINES = "text string, page int, x double, y double, size double, bold boolean, size_ratio double, gap_above double, words int, label int"
LINE_DATASET = f"doc_id string, file string, sha256 string, page_count int, aligned long, unaligned long, masked long, lines array<struct<{LINES}>>"


def read_line_dataset(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, LINE_DATASET)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions; a generation that could not be parsed counts as an empty outline."""
    p = read_json(spark, path, PREDICTION)
    return p.withColumn("entries", F.when(F.coalesce("parse_error", F.lit(False)), F.array().cast(p.schema["entries"].dataType)).otherwise(F.col("entries")))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an Atom feed: id, title, published, pdf_url (a link of that title or type, else made from the id)."""
    schema = "id string, title string, published string, link array<struct<_href:string,_title:string,_type:string>>"
    e = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    pdf = F.filter("link", lambda x: (F.coalesce(x["_title"], F.lit("")) == "pdf") | (F.coalesce(x["_type"], F.lit("")) == "application/pdf"))
    url = F.coalesce(F.get(pdf, F.lit(0))["_href"], F.replace(F.col("id"), F.lit("/abs/"), F.lit("/pdf/")))
    return e.select(F.regexp_extract("id", r"/abs/(.+)$", 1).alias("id"), F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"), "published", url.alias("pdf_url"))


def candidate_urls(number: Column, base: str, legacy: str) -> Column:
    """Where a publication may be found: its five latest revisions, newest first, the plain name, then the legacy one.

    base and legacy are what stands before the number in either place.
    """
    revised = F.transform(F.sequence(F.lit(5), F.lit(1), F.lit(-1)), lambda r: F.concat(F.lit(base), number, F.lit("r"), r.cast("string"), F.lit(".pdf")))
    return F.concat(revised, F.array(F.concat(F.lit(base), number, F.lit(".pdf")), F.concat(F.lit(legacy), number, F.lit(".pdf"))))


def write_outlines(entries: DataFrame, path: str) -> DataFrame:
    """Store outlines as Parquet; returns the number of entries written per document."""
    rows = outline_rows(entries)
    rows.write.mode("overwrite").parquet(path)
    return entries.sparkSession.read.parquet(path).groupBy("doc_id").agg(F.count("*").alias("n"))


def write_splits(rows: DataFrame, path: str) -> None:
    """JSON lines in a folder per split."""
    rows.write.mode("overwrite").partitionBy("split").json(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Records, line datasets or predictions as JSON lines; nulls are written."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_pending(rows: DataFrame, path: str, key: str = "sha256", limit: int | None = None) -> None:
    """Append the rows whose key is not stored yet, at most `limit` of them (by key); a resumed run goes on from there."""
    spark = rows.sparkSession
    pending = rows.join(read_json(spark, path, f"`{key}` {dict(rows.dtypes)[key]}"), key, "left_anti").select(rows.columns)
    if limit is not None:
        pending = pending.orderBy(key).limit(limit)
    pending.write.mode("append").option("ignoreNullFields", "false").json(path)


def append_manifest(rows: DataFrame, path: str, key: str = "file") -> None:
    """Append a row of provenance for each downloaded file that the manifest does not name yet, with the time."""
    append_pending(rows.withColumn("retrieved", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")), path, key)
