"""Hand-built rows with expected results, and folds against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.python_semantics import exact_round, nfkc, quoted
from folioscope import catalog
from folioscope.operators import align, dataset, extract, features, headings, labeler, levels, locate, merge, routing, scoring, toc
from folioscope.plans import outline
from folioscope.sources import files
from folioscope.sources import views as V
from folioscope.streaming import admission

LINE = "doc_id long, line_no int, text string, page int, x double, y double, size double, bold boolean"
ENTRY = "doc_id long, pos int, title string, level int, page int, y double, printed_page int"


def lines(spark, rows):
    """Rows (text, page, y, size, bold, x) of one document or (doc_id, ...) of several, numbered in order."""
    out = []
    for i, r in enumerate(rows):
        r = (1, *r) if isinstance(r[0], str) else r
        d, t, page, y, size, bold, x = (*r, *(10.0, False, 72.0)[len(r) - 4 :])
        out.append((d, i, t, page, float(x), float(y), float(size), bold))
    return spark.createDataFrame(out, LINE)


def entries(spark, rows):
    return spark.createDataFrame([(1, i, *r, *(None,) * (5 - len(r))) for i, r in enumerate(rows)], ENTRY)


def values(spark, expr, data):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "expr,cases",
    [
        (T.section_label, {"4.1 Results": "4.1", "1. Intro": "1.", "12 Years": "12", "2026 Annual Report": "", "A.2.1 Same": "A.2.1", "IV. Discussion": "IV.", "B. Proof": "B.", "A Study of Gravity": "", "3D Reconstruction": "", "Fig. 4 Overview": ""}),
        (T.strip_labels, {"Chapter 2. Foo": "Foo", "Appendix A: Proofs": "Proofs", "Part II Methods": "Methods", "Chapter 4. 4.2 Foo": "Foo", "Appendix A": "Appendix A", "Chapters in history": "Chapters in history", "Part of the problem": "Part of the problem", "1 Introduction": "Introduction", "2026 Annual Report": "2026 Annual Report", "4.1": "4.1", "": ""}),
        (T.title_key, {"  1.1   Background . ": "1.1 background "}),
        (T.match_key, {"A_b, (C)!": "a_b c"}),
        (T.merge_key, {"1.2 A_b, (C)!": "ab c"}),
        (T.bare_key, {"4.1 A_b": "a_b"}),
        (T.model_text, {" 12  Rules, 7": "# rules, #"}),
        (T.label_depth, {"4 Results": 1, "4.1 Setup": 2, "2.2.2 Notation": 3, "A.3 Proofs": 2, "IV. Discussion": 1, "Plain": 0}),
        (T.is_contents_row, {"Contents": True, "TABLE OF CONTENTS": True, "1 Intro ..... 3": True, "Intro 3": False, "Intro  1234": True, "Intro  12345": False}),
        (T.numbering_level, {"1.2.3 x": 3, "1 x": 1, "x": None}),
        (T.is_furniture, {" 12 ": True, "12a": False, "": False}),
        (T.all_caps, {"ABC 1": True, "123": False, "AbC": False}),
        (T.provider, {"local:C:\\x": "local", "none": "none"}),
        (T.model_name, {"local:C:\\x": "C:\\x", "none": ""}),
        (T.safe_filename, {"math/0101": "math_0101.pdf"}),
        (T.teacher_failure, {"Requested tokens exceed context window": "context-too-long", "x": "teacher-error"}),
        (T.friendly_error, {"Encrypted": T.FRIENDLY["Encrypted"], "else": "Processing failed unexpectedly. Please try again."}),
        (nfkc, {"satisﬁable": "satisfiable"}),
        (quoted, {"it's": '"it\'s"'}),
    ],
)
def test_scalars(spark, expr, cases):
    want = {k: v.strip() if expr is T.title_key else v for k, v in cases.items()}
    got = dict(zip(cases, values(spark, expr, list(cases)), strict=True))
    assert {k: v.strip() if expr is T.title_key else v for k, v in got.items()} == want


def test_prefix_match(spark):
    cases = [("", "", False), ("abc", "abc", True), ("abcdefgh", "abcdefghij", True), ("abc", "abcdefghij", False), ("abcdefghij", "abcdefgh", True)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert df.where(T.prefix_match(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_split_of_keeps_the_float_rule(spark):
    shas = {0: "train", 799: "train", 800: "val", 899: "val", 900: "test", 999: "test"}
    got = values(spark, T.split_of, [f"{k:08x}" + "0" * 56 for k in shas])
    assert got == list(shas.values())


def test_rounding(spark):
    df = spark.createDataFrame([(1.005,), (0.15,), (2.5,)], "v double")
    assert [r[0] for r in df.select(exact_round(2)("v")).collect()] == [1.0, 0.15, 2.5]


def test_headings(spark):
    body = [("plain text that goes on and on for the body", 0, 400 + i * 12) for i in range(20)]
    h = lines(spark, [("A long", 0, 199, 20, True), ("title", 0, 222, 20, True), *body, ("Next", 0, 700, 20, True)])
    got = headings.detect_headings(h).orderBy("pos").collect()
    assert [(r["title"], r["y"]) for r in got] == [("A long title", 199.0), ("Next", 700.0)]
    four = lines(spark, [("One", 0, 52, 22), ("Two", 0, 90, 22), ("1 Three", 1, 100, 16), ("2 Four", 1, 124, 16), *[("body text is here", 1, 200 + 12 * i) for i in range(30)]])
    assert headings.detect_headings(four).count() == 4
    assert headings.detect_headings(lines(spark, [("same size", 0, 12 * i) for i in range(20)])).count() == 0
    pdf = lines(spark, [("Chapter 1 Getting Started", 0, 72, 18, True), *body, ("1.1 Installation", 0, 300, 14, True), ("Chapter 2 More", 1, 72, 18, True), ("2.1 Use", 1, 300, 14, True)])
    assert [(r["level"], r["page"]) for r in headings.detect_headings(pdf).orderBy("pos").collect()] == [(1, 0), (2, 0), (1, 1), (2, 1)]


def contents(spark, ghost=False):
    rows = [("A cover", 0, 72), ("Contents", 1, 72, 16, True), ("1 Introduction .......... 3", 1, 100), ("1.1 Background .......... 3", 1, 118, 10, False, 90.0), ("2 Methods .......... 4", 1, 136), ("3 Results .......... 5", 1, 154)]
    rows += [("1 Introduction", 2, 72, 16, True), ("1.1 Background", 2, 300, 14, True), ("2 Methods", 3, 72, 16, True)]
    return lines(spark, rows + ([] if ghost else [("3 Results", 4, 72, 16, True)]) + [("body", 4, 100)])


def test_contents(spark):
    ln = contents(spark)
    pages = toc.contents_pages(ln)
    assert [r["page"] for r in pages.collect()] == [1]
    e = toc.parse_contents(ln).orderBy("pos").collect()
    assert [(r["title"], r["level"], r["printed_page"]) for r in e] == [("1 Introduction", 1, 3), ("1.1 Background", 2, 3), ("2 Methods", 1, 4), ("3 Results", 1, 5)]
    out = outline.build_outline(ln).orderBy("pos").collect()
    assert [(r["page"], r["failed"]) for r in out] == [(2, False), (2, False), (3, False), (4, False)]
    written = levels.outline_rows(outline.build_outline(ln)).orderBy("pos").collect()
    assert [r["page"] for r in written] == [3, 3, 4, 5]
    shown = levels.printed_outline(entries(spark, [("A", 1, 0), ("B", 2)])).orderBy("pos").collect()
    assert [r["printed"] for r in shown] == ["A  (page 1)", "  B  (page ?)"]
    assert outline.build_outline(contents(spark, ghost=True)).where("failed").count() == 1


def test_contents_go_on_and_stop(spark):
    row = lambda p, n: [(f"Part {i} ...... {i}", p, 80 + 18 * i) for i in range(n)]
    ln = lines(spark, [("Contents", 1, 72), *row(1, 4), *row(2, 4), ("body", 3, 72), *row(4, 4)])
    assert sorted(r["page"] for r in toc.contents_pages(ln).collect()) == [1, 2]
    assert toc.contents_pages(lines(spark, [*row(0, 4), ("x", 1, 0)])).count() == 0


def test_indent_tiers_are_anchored(spark):
    rng = random.Random(3)
    for _ in range(5):
        xs = [rng.choice(range(60, 110)) for _ in range(9)]
        df = spark.createDataFrame([(1, float(x)) for x in xs], "doc_id long, x double")
        tiers = []
        for x in sorted(set(xs)):
            if not tiers or x - tiers[-1] >= 5:
                tiers.append(float(x))
        assert toc.indent_tiers(df).first()["tiers"] == tiers


def test_locate(spark):
    offset = lines(spark, [(t, p, 72) for t, p in (("Intro", 3), ("Methods and more", 5), ("The end", 7), ("Intro", 0))])
    e = entries(spark, [("Intro", 1, None, None, 1), ("Methods and", 1, None, None, 3), ("The end", 1, None, None, 5)])
    got = locate.locate_hinted(e, offset).orderBy("pos").collect()
    assert [r["page"] for r in got] == [0, 5, 7]
    miss = entries(spark, [("Nowhere at all", 1, None, None, 2), ("Nor here at all", 1)])
    got = locate.locate_hinted(miss, offset).orderBy("pos").collect()
    assert [(r["page"], r["failed"]) for r in got] == [(1, True), (None, True)]
    snap = entries(spark, [("The end", 1), ("Introduction", 1)])
    ln = lines(spark, [("1 Introduction", 0, 5), ("The end of all things", 1, 9)])
    assert [r["title"] for r in locate.locate_unhinted(snap, ln).orderBy("pos").collect()] == ["1 Introduction"]
    skip = spark.createDataFrame([(1, 0)], "doc_id long, page int")
    ln = lines(spark, [("Results ..... 4", 0, 10), ("Results", 3, 40)])
    assert locate.locate_unhinted(entries(spark, [("Results", 1)]), ln, skip).first()["page"] == 3


def test_sanitize_levels(spark):
    rng = random.Random(1)
    for _ in range(6):
        want, prev, given = [], 0, [rng.randrange(-1, 6) for _ in range(12)]
        for v in given:
            prev = min(max(v, 1), prev + 1)
            want.append(prev)
        e = entries(spark, [("t", v, 0) for v in given])
        assert [r["level"] for r in levels.sanitize_levels(e).orderBy("pos").collect()] == want
    assert levels.has_level_jump(entries(spark, [("a", 1), ("b", 3)])).first()["jump"] is True


def test_merge(spark):
    a = entries(spark, [("1 Intro", 1, 0, 5.0), ("Notes", 1, 1, 1.0), ("Notes", 1, 2, 1.0)])
    b = entries(spark, [("Intro", 1, 0, 6.0), ("Notes", 1, 0, 1.0), ("Notes", 2, 1, 2.0), ("Notes", 3, 9, 2.0), ("Extra", 1)])
    got = [(r["title"], r["page"], r["side"]) for r in merge.merge_outlines(a, b).orderBy("rank").collect()]
    assert got == [("1 Intro", 0, 0), ("Notes", 1, 0), ("Notes", 2, 0), ("Notes", 9, 1), ("Extra", None, 1)]
    assert tuple(merge.agreement(a, b).first()) == (3, 2, 0, 1)


def test_scores(spark):
    g = entries(spark, [("A", 1, 0, 0.0, 1), ("B", 2, 0, 0.0, 2), ("C", 1)])
    p = entries(spark, [("a", 1, 0, 0.0, 1), ("b.", 1, 0, 0.0, 9), ("X", 1)])
    r = scoring.score_outlines(g, p).first()
    assert (r["precision"], r["recall"], r["level_accuracy"], r["page_accuracy"]) == (pytest.approx(2 / 3), pytest.approx(2 / 3), 0.5, 0.5)
    none = scoring.score_outlines(g, entries(spark, [("Q", 1)])).first()
    assert none["f1"] == 0.0 and none["level_accuracy"] is None
    n = entries(spark, [("1.1 Overview", 1), ("4.2 Overview", 1)])
    assert scoring.score_outlines(n, entries(spark, [("Overview", 1)])).first()["recall"] == 0.0
    assert scoring.score_outlines(n, entries(spark, [("Overview", 1)]), ignore_numbers=True).first()["recall"] == 0.5
    both = g.union(g.withColumn("doc_id", F.lit(2).cast("long")))
    m = scoring.macro_average(both, scoring.score_outlines(both, p)).first()
    assert (m["documents"], m["skipped"]) == (1, 1)


SCORE = "doc_id long, precision double, recall double, f1 double, level_accuracy double, page_accuracy double"


def test_compare_and_bootstrap(spark):
    a = spark.createDataFrame([(i, 0.5, 0.5, 0.5, None, 0.1) for i in range(4)], SCORE)
    b = spark.createDataFrame([(i, 0.5 + d, 0.5, 0.5 + 1e-15, 0.3, None) for i, d in enumerate((0.1, 0.2, -0.1, 0.0))], SCORE)
    pairs = scoring.paired(a, b)
    got = {r["metric"]: r for r in scoring.compare(pairs).collect()}
    assert set(got) == {"precision", "recall", "f1"}
    p = got["precision"]
    assert (p["wins"], p["losses"], p["ties"]) == (2, 1, 1) and p["mean"] == pytest.approx(p["candidate"] - p["baseline"])
    assert got["f1"]["ties"] == 4
    ci = {r["metric"]: r for r in scoring.bootstrap(pairs, 500).collect()}
    assert ci["precision"]["ci_low"] <= p["mean"] <= ci["precision"]["ci_high"]
    wide = {r["metric"]: r for r in scoring.bootstrap(pairs, 500, most=1).collect()}
    assert wide["precision"]["ci_low"] <= p["mean"] <= wide["precision"]["ci_high"]
    one = scoring.bootstrap(pairs.where("doc_id = 0"), 100).collect()
    assert all(r["ci_low"] is None for r in one)


def test_threshold(spark):
    df = spark.createDataFrame([(0.2, 0), (0.4, 0), (0.62, 1), (0.9, 2)], "score double, label int")
    assert scoring.tune_threshold(df).first()["threshold"] == pytest.approx(0.45) and scoring.tune_threshold(df).first()["f1"] == 1.0
    # no cut lies beyond 0.995, and without a true positive there is no best one
    high = spark.createDataFrame([(0.997, 0), (0.9995, 1)], "score double, label int")
    assert scoring.tune_threshold(high).first()["f1"] == pytest.approx(2 / 3)
    assert tuple(scoring.tune_threshold(df.where("label = 0")).first()) == (0.5, -1.0)
    assert tuple(scoring.tune_threshold(df.where("false")).first()) == (0.5, -1.0)
    rng = random.Random(6)
    for _ in range(4):
        rows = [(rng.random(), rng.randrange(2)) for _ in range(30)]
        best = (0.5, -1.0)
        for cut in scoring.CUTS:
            tp, n = sum(y for s, y in rows if s >= cut), sum(s >= cut for s, _ in rows)
            f1 = 2 * tp / (n + sum(y for _, y in rows)) if tp else -1.0
            if f1 > best[1] + 1e-12:
                best = (cut, f1)
        assert tuple(scoring.tune_threshold(spark.createDataFrame(rows, "score double, label int")).first()) == pytest.approx(best)


def test_dataset(spark):
    sha = {"a": "0" * 64, "b": f"{850:08x}" + "0" * 56, "c": f"{950:08x}" + "0" * 56}
    rows = [(0, sha["a"], "toc", False), (1, sha["a"], "toc", False), (2, sha["b"], "toc", False), (3, sha["c"], "headings-synthetic", False), (4, sha["c"], "toc", True), (5, sha["a"], "headings-synthetic", True)]
    df = spark.createDataFrame(rows, "ord int, sha256 string, context_kind string, silver boolean")
    assert sorted((r["ord"], r["split"]) for r in dataset.split_records(df).collect()) == [(0, "train"), (2, "val"), (5, "train")]
    assert {r["split"]: r["n"] for r in dataset.split_counts(df).collect()} == {"train": 2, "val": 1, "duplicate": 1, "train-only": 2}
    said = ['```json\n{"entries":[{"title":"A","level":1}]}\n```', "no", '{"entries":[{"title":"A"}]}', '{"entries":[]} x']
    got = values(spark, lambda c: F.size(dataset.parse_generation(c)), said)
    assert got == [1, None, None, 0]


def test_routing(spark):
    df = spark.createDataFrame([(0, 10), (5, 10), (6, 10), (3, 0), (0, 0)], "n int, p int")
    assert [r[0] for r in df.select(routing.is_sparse(F.col("n"), F.col("p"))).collect()] == [True, True, False, False, True]
    docs = spark.createDataFrame([(i, i % 3, 1) for i in range(5)], "doc_id long, n_entries int, page_count int")
    assert sorted(r["doc_id"] for r in routing.route(docs, 0.5).collect()) == [0, 3]
    assert routing.route(docs, 0).count() == 0 and routing.route(docs, 1).count() == 5


def page(spark, *ls, type_=0):
    made = [([x, y, x2, y + 10], [(t, size, flags, font) for t, size, flags, font in spans]) for x, y, x2, spans in ls]
    return spark.createDataFrame([("d", 0, [(type_, made)])], f"doc_id string, page int, blocks {extract.BLOCKS}")


def test_lines_from_blocks(spark):
    s = lambda t, size=10.0, flags=0, font="Sans": [(t, size, flags, font)]
    got = extract.lines_from_blocks(page(spark, (72.0, 50.0, 80.0, s("1")), (90.0, 50.0, 140.0, s("Reading")), (500.0, 50.0, 510.0, s("2")))).collect()
    assert [r["text"] for r in got] == ["1 Reading  2"]
    got = extract.lines_from_blocks(page(spark, (72.0, 50.0, 80.0, [("Propositional", 14.0, 0, "x"), (" ", 30.0, 0, "x"), ("Logic", 14.0, 0, "SansBold")]))).first()
    assert (got["text"], got["size"], got["bold"]) == ("Propositional Logic", 14.0, True)
    assert extract.lines_from_blocks(page(spark, (0.0, 0.0, 1.0, s("x")), type_=1)).count() == 0
    assert extract.lines_from_blocks(page(spark, (0.0, 0.0, 1.0, s(" ")))).count() == 0
    rng = random.Random(4)
    for _ in range(3):
        frags = sorted((rng.randrange(0, 12) / 1.0, float(i)) for i in range(14))
        want, anchor = [], None
        for y, x in frags:
            if anchor is None or y - anchor > 2.0:
                want.append([])
                anchor = y
            want[-1].append(x)
        ls = [(x, y, x + 0.5, s(f"t{int(x)}")) for y, x in frags]
        got = extract.lines_from_blocks(page(spark, *ls)).orderBy("g").collect()
        assert [r["text"].split() for r in got] == [[f"t{int(x)}" for x in sorted(g)] for g in want]


def test_features(spark):
    ln = lines(spark, [("Title", 0, 72, 20, True), ("body text here", 0, 132), ("more body text", 0, 150), ("last words of it", 1, 72)])
    f = features.line_features(ln).orderBy("line_no").collect()
    assert [r["gap_above"] for r in f] == [0.0, 60.0, 18.0, 0.0] and f[0]["size_ratio"] == 2.0
    c = features.feature_columns(features.line_features(ln)).orderBy("line_no").collect()
    assert c[0]["size_to_next"] == 2.0 and c[2]["size_to_next"] == 1.0 and c[0]["below_ems"] == 3.0
    padded = features.feature_columns(features.line_features(lines(spark, [("  a1  ", 0, 72)]))).first()
    assert (padded["digit_share"], padded["n_chars"]) == (0.5, 2.0)
    assert c[0]["bold_share"] == 0.25 and list(c[0].asDict())[2:] == features.FEATURES


def test_align(spark):
    ln = lines(spark, [("Summary", 0, 10), ("Summary", 1, 10), ("2 Methods", 2, 10), ("Other", 5, 10)])
    book = spark.createDataFrame([(1, 0, 1, "Summary", 1), (1, 1, 9, "summary", 1), (1, 2, 0, "Methods", 4), (1, 3, 1, "Other", 1)], "doc_id long, pos int, level int, title string, page int")
    assert sorted((r["line_no"], r["label"]) for r in align.align_labels(ln, book).collect()) == [(0, 1), (1, 4), (2, 1)]
    g = entries(spark, [("Introduction", 1), ("Nothing like it", 1), ("Conclusion", 1)])
    rows = spark.createDataFrame([(1, 0, "Introductions", 3), (1, 1, "Conclusion", 7)], "doc_id long, pos int, title string, printed_page int")
    assert [r["printed_page"] for r in align.align_printed_pages(g, rows).orderBy("pos").collect()] == [3, None, 7]


def test_rate_limit(spark):
    hits = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 2.0), ("a", 62.0), ("b", 2.0)], "key string, ts double")
    got = admission.rate_limit(hits, 2, 60.0).orderBy("key", "ts").collect()
    assert [r["allowed"] for r in got] == [True, True, False, True, True]


def test_rate_limit_stream(spark, tmp_path):
    # a processing-time timeout asks for batches without data for ever; the test must end
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    schema = "key string, ts double"
    src = f"{tmp_path}/in"
    spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 2.0)], schema).coalesce(1).write.parquet(src)
    stream = admission.rate_limit_stream(spark.readStream.schema(schema).parquet(src), 2, 60.0)
    q = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").start()
    q.processAllAvailable()
    spark.createDataFrame([("a", 62.0)], schema).coalesce(1).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    got = [(r["ts"], r["allowed"]) for r in spark.table("limited").orderBy("ts").collect()]
    assert got == [(0.0, True), (1.0, True), (2.0, False), (62.0, True)]


def test_expiry(spark):
    rows = [("done", 0.0), ("done", 3900.0), ("queued", 3000.0), ("queued", -1.0)]
    df = spark.createDataFrame(rows, "status string, created double")
    assert [r[0] for r in df.select(admission.expired(F.col("status"), F.col("created"), F.lit(7200.0))).collect()] == [True, False, False, True]


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "y.pdf").write_bytes(b"hello")
    f = files.pdf_files(spark, str(tmp_path))
    assert sorted((r["path"][-5:], r["status"]) for r in f.collect()) == [("x.pdf", None), ("y.pdf", "not-a-pdf")]

    def decoder(raw):
        raise ValueError("no decoder here")

    assert files.decode(f, decoder).first()["status"] == "InvalidPdf"
    feed = tmp_path / "feed.xml"
    feed.write_text(
        '<feed><entry><id>http://h.org/abs/1.2v1</id><title>A\n b</title><published>2024</published><link href="u.pdf" title="pdf"/></entry>'
        '<entry><id>http://h.org/abs/3.4</id><title>C</title><published>2025</published><link href="z" rel="alternate"/><link href="q"/></entry></feed>'
    )
    got = files.read_feed(spark, str(feed)).orderBy("id").collect()
    assert [(r["id"], r["title"], r["pdf_url"]) for r in got] == [("1.2v1", "A b", "u.pdf"), ("3.4", "C", "http://h.org/pdf/3.4")]
    urls = spark.range(1).select(files.candidate_urls(F.lit("n"), "b/", "old/x")).first()[0]
    assert urls == ["b/nr5.pdf", "b/nr4.pdf", "b/nr3.pdf", "b/nr2.pdf", "b/nr1.pdf", "b/n.pdf", "old/xn.pdf"]
    rows = spark.createDataFrame([("s1", "train"), ("s2", "val")], "sha256 string, split string")
    files.write_splits(rows, f"{tmp_path}/splits")
    assert spark.read.json(f"{tmp_path}/splits/split=val").count() == 1
    for _ in range(2):
        files.append_pending(rows, f"{tmp_path}/silver")
    assert spark.read.json(f"{tmp_path}/silver").count() == 2
    out = files.write_outlines(entries(spark, [("a", 1, 0, 1.0), ("b", 3, 2, 1.0), ("c", 1)]), f"{tmp_path}/outlines")
    assert out.first()["n"] == 2


def test_labeler(spark, tmp_path):
    rows = [(1, i, *[float((i * (k + 3)) % 7) for k in range(len(features.FEATURES))], i % 4 if i % 2 else 0) for i in range(80)]
    schema = "doc_id long, line_no int, " + ", ".join(f"{c} double" for c in features.FEATURES) + ", label int"
    df = spark.createDataFrame(rows, schema)
    model = labeler.Labeler.train(df, df, trees=2, depth=3)
    model.save(spark, f"{tmp_path}/m")
    again = labeler.Labeler.load(spark, f"{tmp_path}/m")
    assert sorted(map(tuple, model.detect(df).collect())) == sorted(map(tuple, again.detect(df).collect()))
    again.feature_names = ["other"]
    again.save(spark, f"{tmp_path}/n")
    with pytest.raises(labeler.LabelerError):
        labeler.Labeler.load(spark, f"{tmp_path}/n")
    with pytest.raises(labeler.LabelerError):
        labeler.Labeler.load(spark, f"{tmp_path}/missing")


def test_bootstrap_is_one_scheme(spark):
    rows = [(m, i, 0.0, 0.0, ((i * 37) % 101) / 101 - 0.3) for m in ("f1", "recall") for i in range(400)]
    df = spark.createDataFrame(rows, "metric string, doc_id long, b double, c double, delta double")
    ends = lambda pairs, **kw: [tuple(r) for r in scoring.bootstrap(pairs, 2000, **kw).orderBy("metric").collect()]
    x = [r[4] for r in rows[:400]]
    mean, half = sum(x) / 400, 1.96 * (sum((v - sum(x) / 400) ** 2 for v in x) / 400 / 400) ** 0.5
    for most in (10_000, 50):
        got = ends(df.repartition(1), most=most)
        assert got == ends(df.repartition(7, "delta"), most=most) and got[0][1:] == got[1][1:]
        assert got[0][1] == pytest.approx(mean - half, abs=0.1 * half) and got[0][2] == pytest.approx(mean + half, abs=0.1 * half)
    # the number of draws is that of the documents in every resample
    same = ends(df.withColumn("delta", F.lit(0.25)), most=50)
    assert [r[1:] for r in same] == [(0.25, 0.25)] * 2


@pytest.mark.parametrize("name", ["bootstrap_ci"])
def test_bootstrap_query_takes_the_default(spark, sf_dir, monkeypatch, name):
    asked = []
    real = scoring.bootstrap
    monkeypatch.setattr(scoring, "bootstrap", lambda pairs, resamples=10_000, **kw: asked.append(resamples) or real(pairs, resamples, **kw))
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0 and asked == [10_000]


def test_printed_pages_of_all_entries(spark, sf_dir):
    out = catalog.QUERIES["printed_page_align"](spark, sf_dir).cache()
    assert out.count() == V.gold(spark, sf_dir).count()
    assert out.where("pos >= 12 and printed_page is not null").count() > 0


def test_labeler_query_detects_on_all_lines(spark, sf_dir, monkeypatch):
    seen = {}

    class Fake:
        def detect(self, rows):
            return rows

    def train(rows, validation, *args, **kw):
        seen.update(fit=rows, tune=validation, args=(args, kw))
        return Fake()

    monkeypatch.setattr(labeler.Labeler, "train", train)
    out = catalog.QUERIES["labeler_detect"](spark, sf_dir)
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").distinct().collect()}
    assert seen["args"] == ((), {}) and out.count() == V.doc_lines(spark, sf_dir).count()
    split = {r["ord"]: r["s"] for r in V.records(spark, sf_dir).select("ord", T.split_of(F.col("sha256")).alias("s")).collect()}
    assert ids(seen["fit"]) == {d for d in ids(out) if split[d] == "train"} and ids(seen["tune"]) == {d for d in ids(out) if split[d] == "val"}
