"""Plans from files to records, routing and jobs, on hand-built documents with a decoder of their own."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import align, context, dataset, entries, features, labeler, scoring
from folioscope.plans import backends, corpus, outline, process
from folioscope.sources import files
from folioscope.streaming import admission, jobs
from tests.test_fixtures import LINE, lines

TOC = "array<struct<level:int,title:string,page:int>>"
DOCS = f"doc_id long, file string, sha256 string, page_count int, unreadable boolean, encrypted boolean, toc {TOC}"


def decoder(raw: bytes) -> dict:
    """Files made of a magic number and JSON."""
    d = json.loads(raw[5:])
    span = lambda t, size: [{"text": t, "size": size, "flags": 0, "font": "Sans"}]
    block = lambda ls: [{"type": 0, "lines": [{"bbox": [72.0, y, 300.0, y + 10], "spans": span(t, size)} for t, y, size in ls]}]
    return d | {"pages": ((k, block(ls)) for k, ls in enumerate(d.get("pages", [])))}


def write(folder, name, **d):
    (folder / name).write_bytes(b"%PDF-" + json.dumps(d).encode())


def test_from_files_to_outlines(spark, tmp_path):
    page = [["Big Title", 50.0, 20.0], ["body text that is long enough", 90.0, 10.0]]
    write(tmp_path, "good.pdf", page_count=1, pages=[page])
    write(tmp_path, "locked.pdf", page_count=1, encrypted=True)
    write(tmp_path, "scan.pdf", page_count=3, pages=[[]])
    write(tmp_path, "marked.pdf", page_count=1, toc=[[1, "Big Title", 1]], pages=[page])
    (tmp_path / "broken.pdf").write_bytes(b"%PDF-{")
    found = files.pdf_files(spark, str(tmp_path))
    state = lambda **kw: {r["file"].rsplit("/", 1)[1]: r["status"] for r in files.decode(found, decoder, **kw).collect()}
    assert state() == {"good.pdf": None, "locked.pdf": "Encrypted", "scan.pdf": "OcrUnavailable", "marked.pdf": None, "broken.pdf": "InvalidPdf"}
    assert state(ocr_mode="never")["scan.pdf"] == "NoTextLayer" and state(replace_existing=False)["marked.pdf"] == "ExistingBookmarks"
    read = lambda raw: [(0, decoder(b"%PDF-" + json.dumps({"pages": [page]}).encode())["pages"].__next__()[1])]
    assert state(optical=read, ocr_max_pages=2)["scan.pdf"] == "OcrPageLimit" and state(optical=read)["scan.pdf"] is None
    with pytest.raises(ValueError):
        files.decode(found, decoder, ocr_mode="maybe")
    from folioscope.operators.extract import lines_from_blocks

    d = files.decode(found, decoder).cache()
    ln = lines_from_blocks(files.decoded_pages(d)).withColumnRenamed("g", "line_no")
    # string ids run through the whole plan
    results, final = process.process(d.select("doc_id", "file", "page_count", "status"), ln, options=process.Options(mode="never"))
    got = {r["file"].rsplit("/", 1)[1]: (r["status"], r["bookmark_count"]) for r in d.select("doc_id", "file").join(results, "doc_id").collect()}
    assert got == {"good.pdf": ("done", 1), "locked.pdf": ("Encrypted", 0), "scan.pdf": ("OcrUnavailable", 0), "marked.pdf": ("done", 1), "broken.pdf": ("InvalidPdf", 0)}
    assert [r["title"] for r in final.collect()] == ["Big Title"] * 2
    assert outline.build_outline(ln).count() == 2


def documents(spark):
    """1: contents pages and an outline; 2: headings and an outline; 3: no outline; 4: encrypted; 5: no lines; 6: another outline."""
    toc = [(1, "Introduction", 3), (2, "Background", 3), (1, "Methods", 4), (1, "Results", 5)]
    a = [("A cover", 0, 72), ("Contents", 1, 72, 16, True), ("1 Introduction .......... 1", 1, 100), ("1.1 Background .......... 1", 1, 118), ("2 Methods .......... 2", 1, 136), ("3 Results .......... 3", 1, 154)]
    a += [("1 Introduction", 2, 72, 16, True), ("1.1 Background", 2, 300, 14, True), ("2 Methods", 3, 72, 16, True), ("3 Results", 4, 72, 16, True), ("It's body text", 4, 100)]
    plain = [("Introduction", 0, 72, 16, True), ("body text", 0, 100), ("Methods", 3, 72, 16, True), ("more body text", 3, 100)]
    rows = [(1, *r) for r in a] + [(d, *r) for d in (2, 3, 6) for r in plain] + [(4, *r) for r in plain]
    books = {1: toc, 2: [(1, "Introduction", 1), (1, "Methods", 4)], 4: toc, 5: toc, 6: [(1, "Quite other", 1), (1, "Things", 2), (1, "Here", 2)]}
    docs = [(d, f"{d}.pdf", f"{d:064x}", 5, False, d == 4, books.get(d)) for d in range(1, 7)] + [(7, "7.pdf", "7", 5, True, False, None), (8, "8.pdf", "8", 2, False, False, toc)]
    ln = [r for r in rows] + [(8, *r) for r in plain]
    return spark.createDataFrame(docs, DOCS), lines(spark, ln)


def test_harvest(spark):
    docs, ln = documents(spark)
    records, reasons = corpus.harvest(docs, ln, augment=True)
    got = {(r["doc_id"], r["context_kind"]): r for r in records.collect()}
    assert set(got) == {(1, "toc"), (1, "headings-synthetic"), (2, "headings"), (6, "headings")}
    one = got[1, "toc"]
    # titles without their numbers still match their rows by similarity, except the shortest
    assert [e["title"] for e in one["entries"]] == ["Introduction", "Background", "Methods", "Results"] and one["alignment"] >= 0.6
    assert one["context"].startswith("Table of contents text:\nContents\n1 Introduction") and one["entries"][0]["printed_page"] == 1
    twin = got[1, "headings-synthetic"]
    assert "Contents" not in twin["context"] and twin["alignment"] is None and all(e["printed_page"] is None for e in twin["entries"])
    assert "text='1 Introduction'" in twin["context"]
    assert {r["doc_id"]: r["reason"] for r in reasons.collect()} == {3: "no-embedded-outline", 4: "encrypted", 5: "no-text-layer", 7: "unreadable", 8: "too-short"}
    built = corpus.build(records, order="doc_id").collect()
    assert {r["split"] for r in built} <= {"train", "val", "test"} and all(json.loads(r["completion"])["entries"] for r in built)


def test_poor_alignment(spark):
    docs, ln = documents(spark)
    other = docs.where("doc_id = 1").withColumn("toc", F.expr(f"cast(array(struct(1, 'Zzz', 1), struct(1, 'Yyy', 2)) as {TOC})"))
    records, reasons = corpus.harvest(other, ln)
    assert records.count() == 0 and reasons.first()["reason"] == "poor-alignment"


def test_line_dataset(spark, tmp_path):
    docs, ln = documents(spark)
    rows, reasons = corpus.line_dataset(docs, ln)
    got = {r["doc_id"]: r for r in rows.collect()}
    # a contents row's key has its page number in it, so the headings themselves are claimed
    assert [x["label"] for x in got[1]["lines"]][6:10] == [1, 2, 1, 1] and got[1]["aligned"] == 4 and sum(x["label"] != 0 for x in got[1]["lines"]) == 4
    assert [(x["text"], x["label"]) for x in got[2]["lines"] if x["label"]] == [("Introduction", 1), ("Methods", 1)]
    assert {r["doc_id"]: r["reason"] for r in reasons.collect()} == {3: "no-embedded-outline", 4: "encrypted", 5: "no-text-layer", 6: "no-alignment", 7: "unreadable"}
    strings = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    files.write_json(strings, f"{tmp_path}/lines")
    back = files.read_line_dataset(spark, f"{tmp_path}/lines")
    flat = corpus.training_lines(back, fixed_test=spark.createDataFrame([(f"{2:064x}",)], "sha256 string"))
    assert {r["split"] for r in flat.where("doc_id = '2'").collect()} == {"test"}
    assert flat.where("doc_id = '1'").count() == 11 and {r["label"] for r in flat.collect()} == {0, 1, 2}
    hashed = corpus.training_lines(back.withColumn("sha256", F.lit("ffffffff")), fixed_test=spark.createDataFrame([], "sha256 string"))
    bucket = int("ffffffff", 16) % 1000
    assert (hashed.count() == 0) == (bucket >= 900)
    # masking: an unaligned bookmark whose page is wrong leaves its line out of training
    wrong = docs.where("doc_id = 2").withColumn("toc", F.expr(f"cast(array(struct(1, 'Introduction', 1), struct(1, 'Methods', 99)) as {TOC})"))
    masked = corpus.line_dataset(wrong, ln, mask=True)[0].first()
    assert [x["label"] for x in masked["lines"]] == [1, 0, align.MASK, 0] and (masked["aligned"], masked["unaligned"], masked["masked"]) == (1, 1, 1)


def test_distill(spark):
    docs, ln = documents(spark)
    said = {3: [("Introduction", 1), ("Methods", 1)]}
    teacher = lambda rows: backends.ReplayBackend(spark.createDataFrame([(d, [(t, lv) for t, lv in es]) for d, es in rows.items()], "doc_id long, entries array<struct<title:string,level:int>>"))
    records, reasons = corpus.distill(docs, ln, teacher(said))
    r = records.collect()
    assert [x["doc_id"] for x in r] == [3] and r[0]["silver"] and r[0]["context_kind"] == "headings"
    assert {x["doc_id"]: x["reason"] for x in reasons.collect()} == {1: "has-embedded-outline", 2: "has-embedded-outline", 4: "encrypted", 5: "has-embedded-outline", 6: "has-embedded-outline", 7: "unreadable", 8: "has-embedded-outline"}
    why = lambda b: corpus.distill(docs.where("doc_id = 3"), ln, b)[1].first()["reason"]
    assert why(teacher({3: [("Introduction", 1), ("Never", 1)]})) == "teacher-unlocatable"
    assert why(teacher({9: []})) == "teacher-empty"

    def fails(prompts):
        raise RuntimeError("Requested tokens exceed context window of 1")

    assert why(backends.GeneratingBackend(fails)) == "context-too-long"
    assert why(backends.GeneratingBackend(lambda prompts: ["no json"] * len(prompts))) == "parse-error"
    ok = backends.GeneratingBackend(lambda prompts: ['{"entries":[{"title":"Methods","level":1}]}' for p in prompts if "Candidate" in p])
    assert corpus.distill(docs.where("doc_id = 3"), ln, ok)[0].first()["entries"][0]["title"] == "Methods"


def test_backends(spark):
    with pytest.raises(backends.UnknownProviderError, match="replay"):
        backends.get_backend("nobody:x")
    with pytest.raises(TypeError):
        backends.get_backend("replay", other=1)
    backends.register("echo", lambda model, n=1: (model, n))
    assert backends.get_backend("echo:c:/m", n=2) == ("c:/m", 2) and backends.get_backend("echo")[0] is None
    spark.conf.set("folioscope.test.n", "x")
    assert backends.int_option(spark, 3, "folioscope.test.n", 1) == 3 and backends.int_option(spark, None, "folioscope.test.none", 1) == 1
    with pytest.raises(ValueError, match="integer"):
        backends.int_option(spark, None, "folioscope.test.n", 1)


def test_process_statuses(spark):
    docs, ln = documents(spark)
    d = docs.select("doc_id", "page_count", F.when(F.col("encrypted"), "Encrypted").alias("status"))
    labelled = entries.entries_from_labels(ln, spark.createDataFrame([(2, 11, 1), (2, 12, 0)], "doc_id long, line_no int, label int"))
    assert [(r["title"], r["page"]) for r in labelled.collect()] == [("Introduction", 0)]
    said = spark.createDataFrame([(2, [("Methods", 1), ("Nowhere", 1)]), (3, [])], "doc_id long, entries array<struct<title:string,level:int>>")
    said = backends.ReplayBackend(said).outlines(d)
    run = lambda **kw: {r["doc_id"]: r for r in process.process(d, ln, labelled, said, process.Options(**kw))[0].collect()}
    got = run(mode="always")
    assert (got[2]["status"], got[2]["bookmark_count"], got[2]["used_labeler"]) == ("done", 2, True)
    # without a labeler the model's empty outline takes the heuristic one's place
    assert got[3]["status"] == "NoOutline" and got[4]["status"] == "Encrypted" and got[5]["status"] == "NoTextLayer"
    got = run(mode="auto")
    assert got[2]["bookmark_count"] == 1 and "ANTHROPIC_API_KEY" in got[2]["warnings"][0]
    assert run(mode="never")[1]["used_toc"] and run(mode="never", labeler=False)[2]["bookmark_count"] == 2
    with pytest.raises(ValueError):
        process.Options(mode="perhaps")


def test_decisions(spark):
    one = spark.range(1)
    said = lambda c: one.select(c.alias("x")).select("x.*").first()
    yes, no = F.lit(True), F.lit(False)
    assert tuple(said(process.ocr_decision("force", yes, yes, F.lit(3)))) == (True, None, "forced OCR: the existing text layer was ignored")
    assert said(process.ocr_decision("auto", no, yes, F.lit(9), 5))["status"] == "OcrPageLimit"
    assert said(process.ocr_decision("auto", no, no, F.lit(1)))["status"] == "OcrUnavailable" and said(process.ocr_decision("never", no, yes, F.lit(1)))["status"] == "NoTextLayer"
    lit = lambda *v: [F.lit(x).cast("string") for x in v]
    assert tuple(said(process.model_choice(*lit("k", "m", "s", "d", "auto")))) == ("m", "auto")
    assert tuple(said(process.model_choice(*lit("k", "", None, "d", "auto")))) == ("d", "auto")
    assert tuple(said(process.model_choice(*lit("", "m", "s", "d", "auto")))) == ("s", "auto")
    assert tuple(said(process.model_choice(*lit(None, "m", "", "d", "always")))) == (None, "never")
    r = {k: F.lit(v) for k, v in {"unreadable": False, "encrypted": False, "has_outline": False, "page_count": 9, "has_text": True, "n_entries": 10, "failures": 3}.items()}
    why = lambda **kw: one.select(dataset.distill_reason(r | {k: F.lit(v) for k, v in kw.items()})).first()[0]
    assert [why(), why(failures=2), why(n_entries=0), why(page_count=3), why(has_text=False), why(has_outline=True)] == ["teacher-unlocatable", None, "teacher-empty", "too-short", "no-text-layer", "has-embedded-outline"]
    for kind, text in T.FRIENDLY.items():
        assert one.select(T.friendly_error(F.lit(kind))).first()[0] == text


def test_context_of_contents_pages(spark):
    docs, ln = documents(spark)
    from folioscope.operators.toc import contents_pages

    got = {r["doc_id"]: r["context"] for r in context.llm_context(ln, contents_pages(ln)).collect()}
    assert got[1].split("\n")[:3] == ["Table of contents text:", "Contents", "1 Introduction .......... 1"]
    assert got[2].split("\n")[1] == "physical_page=0 size=16.0 bold=True text=Introduction"


def test_hybrid_routes_the_sparsest(spark):
    kind = "doc_id long, entries array<struct<title:string,level:int,page:int,printed_page:int>>"
    a = spark.createDataFrame([(1, [("A", 1, 4, None)]), (2, [("B", 1, 0, 3), ("C", 1, 1, None)]), (3, [])], kind)
    b = spark.createDataFrame([(1, [("a", 2, 1, None), ("X", 1, 2, 9)]), (2, [("Y", 1, 0, None)])], kind)
    pages = spark.createDataFrame([(1, 10), (2, 2)], "doc_id long, page_count int")
    out = process.hybrid(a, b, pages, 0.67).orderBy("doc_id", "pos").collect()
    assert [(r["doc_id"], r["title"], r["printed_page"], r["routed"]) for r in out] == [(1, "X", 9, True), (1, "A", None, True), (2, "B", 3, False), (2, "C", None, False)]
    back = entries.to_predictions(a, entries.to_entries(a)).orderBy("doc_id").collect()
    assert [[e["title"] for e in r["entries"]] for r in back] == [["A"], ["B", "C"], []]


def test_claims_against_the_fold(spark):
    """Bookmarks in order over all lines of a document, as against the fold per key."""
    rng = random.Random(12)
    for case in range(3):
        ln = [(rng.choice("abc"), p) for p in range(6) for _ in range(rng.randrange(4))]
        book = [(rng.choice("abcd"), rng.randrange(-1, 8), rng.randrange(0, 7)) for _ in range(14)]
        used, want = set(), []
        for title, at, level in book:
            hint = max(at - 1, 0)
            got = next((i for p in (hint, hint + 1, hint - 1) for i, (t, q) in enumerate(ln) if q == p and t == title and i not in used), None)
            if got is not None:
                used.add(got)
            want.append((got, None if got is None else min(max(level, 1), 4)))
        df = lines(spark, [(t * 3, p, 10 * i) for i, (t, p) in enumerate(ln)]).repartition(2)
        toc = spark.createDataFrame([(1, k, lv, t * 3, at) for k, (t, at, lv) in enumerate(book)], "doc_id long, pos int, level int, title string, page int")
        assert [(r["line_no"], r["label"]) for r in align.claims(df, toc).orderBy("pos").collect()] == want
    blank = spark.createDataFrame([(1, 0, 1, "...", 1)], "doc_id long, pos int, level int, title string, page int")
    assert align.claims(lines(spark, [("x", 0, 1)]), blank).first()["line_no"] is None


def test_printed_pages_against_the_fold(spark):
    from difflib import SequenceMatcher

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdef ") for _ in range(rng.randrange(3, 9)))
    titles = [word() for _ in range(25)]
    rows = [t if rng.random() < 0.3 else (t + rng.choice(" xyz"))[rng.randrange(2) :] for t in titles for _ in range(2)]
    used, want = set(), []
    key = lambda t: " ".join(t.strip().strip(".").lower().split(" "))
    norm = {t: r for t, r in zip(titles, [None] * 25, strict=True)}
    norm = {r["t"]: r["k"] for r in spark.createDataFrame([(t,) for t in {*titles, *rows}], "t string").select("t", T.title_key(F.col("t")).alias("k")).collect()}
    for t in titles:
        best, score = None, 0.85
        for i, r in enumerate(rows):
            ratio = SequenceMatcher(None, norm[t], norm[r]).ratio()
            if i not in used and ratio >= 0.85 and (best is None or ratio > score):
                best, score = i, ratio
        used.add(best)
        want.append(best)
    g = spark.createDataFrame([(1, i, t) for i, t in enumerate(titles)], "doc_id long, pos int, title string")
    r = spark.createDataFrame([(1, i, t, i) for i, t in enumerate(rows)], "doc_id long, pos int, title string, printed_page int")
    got = align.align_printed_pages(g, r).orderBy("pos").collect()
    assert [x["printed_page"] for x in got] == want
    assert align.matched_share(align.align_printed_pages(g, r)).first()["alignment"] == sum(w is not None for w in want) / 25


def test_sequential_bootstrap_and_report(spark):
    rows = [("f1", d, 0.5, 0.5 + x, x) for d, x in enumerate([0.1, -0.2, 0.3, 0.0, 0.25])] + [("recall", 0, 0.1, 0.2, 0.1)]
    pairs = spark.createDataFrame(rows, "metric string, doc_id long, b double, c double, delta double").repartition(3)
    x, rng = [r[4] for r in rows[:5]], random.Random(0)
    means = sorted(sum(rng.choice(x) for _ in x) / 5 for _ in range(200))
    got = {r["metric"]: r for r in scoring.bootstrap_sequential(pairs, 200).collect()}
    assert (got["f1"]["ci_low"], got["f1"]["ci_high"]) == (means[5], means[194]) and got["recall"]["ci_low"] is None
    text = scoring.report(scoring.compare(pairs), scoring.bootstrap_sequential(pairs, 200)).split("\n")
    assert text[0] == "metric           baseline  candidate     delta                95% CI         W/L/T    n" and text[1] == "-" * len(text[0])
    f1 = next(t for t in text if t.startswith("f1"))
    assert f1.split() == ["f1", "0.5000", "0.5900", "+0.0900", f"[{means[5]:+.4f},", f"{means[194]:+.4f}]", "3/1/1", "5"] and len(f1) == len(text[0])
    assert next(t for t in text if t.startswith("page_accuracy")).split() == ["page_accuracy", "--", "0"]


def test_files_resume(spark, tmp_path):
    assert files.read_split(spark, f"{tmp_path}/none").count() == 0
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "sha256 string, n int")
    files.append_pending(rows, f"{tmp_path}/silver", limit=2)
    files.append_pending(rows, f"{tmp_path}/silver", limit=2)
    assert sorted(r["sha256"] for r in spark.read.json(f"{tmp_path}/silver").collect()) == ["a", "b", "c"]
    got = spark.createDataFrame([("x.pdf", "http://h/x")], "file string, url string")
    for _ in range(2):
        files.append_manifest(got, f"{tmp_path}/manifest")
    m = spark.read.json(f"{tmp_path}/manifest").collect()
    assert len(m) == 1 and m[0]["retrieved"]
    files.write_json(spark.createDataFrame([("s", None, True, None)], "sha256 string, entries array<struct<title:string,level:int,printed_page:int,page:int>>, parse_error boolean, model string"), f"{tmp_path}/p")
    assert files.read_predictions(spark, f"{tmp_path}/p").first()["entries"] == []
    (tmp_path / "records.jsonl").write_text('{"file":"f","sha256":"s","page_count":3,"context_kind":"toc","context":"c","entries":[{"title":"t","level":1}],"alignment":null}\n\n')
    r = files.read_records(spark, f"{tmp_path}/records.jsonl").collect()
    assert len(r) == 1 and r[0]["entries"][0]["printed_page"] is None and r[0]["silver"] is None


def test_labeler_is_kept(spark, tmp_path, monkeypatch):
    assert labeler.resolve_labeler(spark) is None
    asked = []
    monkeypatch.setattr(labeler.Labeler, "load", lambda s, p: asked.append(p) or len(asked))
    (tmp_path / "m" / "meta").mkdir(parents=True)
    (tmp_path / "m" / "meta" / "part").write_text("x")
    one = labeler.resolve_labeler(spark, f"{tmp_path}/m")
    assert labeler.resolve_labeler(spark, f"{tmp_path}/m") == one
    (tmp_path / "m" / "meta" / "part").write_text("xy")
    assert labeler.resolve_labeler(spark, f"{tmp_path}/m") != one
    assert labeler.resolve_labeler(spark, f"{tmp_path}/none") == 3


def test_text_scores_are_out_of_fold(spark):
    rows = [(d, i, "chapter one" if (d + i) % 3 == 0 else "some body text", int((d + i) % 3 == 0)) for d in range(6) for i in range(20)]
    rows.append((9, 9, "rare words here", 1))
    df = spark.createDataFrame(rows, "doc_id long, line_no int, text string, label int")
    model, out = labeler.text_scores(df, min_df=2)
    got = {(r["doc_id"], r["line_no"]): r["text_score"] for r in out.collect()}
    assert len(got) == len(rows) and all((got[d, i] > 0.5) == bool(y) for d, i, _, y in rows[:-1])
    f = spark.createDataFrame([(0, 0), (77, 0)], "doc_id long, line_no int")
    assert labeler.with_text(f, labeler.text_score(model, df.drop("label"))).where("doc_id = 77").first()["text_score"] == 0.0


def test_spread_and_positives(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in entries.feature_spread(df, ["a", "b"], 1).collect()] == [("a", 1.0)]
    rows = spark.createDataFrame([("train", 1), ("train", 0), ("val", 0)], "split string, label int")
    assert {r["split"]: (r["lines"], r["headings"], r["share"]) for r in entries.split_positives(rows).collect()} == {"train": (2, 1, 0.5), "val": (1, 0, 0.0)}
    assert len(features.FEATURES) == 24


def test_jobs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("1", "a.b.pdf"), ("2", "x.pdf"), ("3", "y.pdf")], "id string, name string").write.parquet(f"{tmp_path}/in/one")
    stream = spark.readStream.schema("id string, name string").parquet(f"{tmp_path}/in/*")
    status = F.when(F.col("id") == "1", "done").when(F.col("id") == "2", "Encrypted")
    q = jobs.run_jobs(stream, lambda b: b.where("id <> '3'").select("id", status.alias("status"), F.lit(4).alias("bookmark_count")), f"{tmp_path}/log", f"{tmp_path}/ck", availableNow=True)
    q.awaitTermination(120)
    got = {r["id"]: r for r in jobs.jobs(spark, f"{tmp_path}/log").collect()}
    assert (got["1"]["status"], got["1"]["bookmark_count"], got["1"]["download"]) == ("done", 4, "a.b.bookmarked.pdf")
    assert (got["2"]["status"], got["2"]["error"]) == ("failed", T.FRIENDLY["Encrypted"]) and got["3"]["status"] == "failed"
    assert spark.read.json(f"{tmp_path}/log").count() == 9
    now = got["1"]["created_at"]
    assert jobs.sweep(spark, f"{tmp_path}/log", now + 3000).count() == 0 and jobs.sweep(spark, f"{tmp_path}/log", now + 4000).count() == 3


def test_live_keys(spark):
    log = spark.createDataFrame([("a", 0.0, True), ("a", 50.0, False), ("b", 30.0, True)], "key string, ts double, allowed boolean")
    assert [tuple(r) for r in admission.live_keys(log, 70.0, 60.0).collect()] == [("b", 30.0)]


def test_stored_tables_are_bucketed_and_follow_their_files(spark, tmp_path):
    from folioscope.scratch import stored

    made = []

    def make():
        made.append(1)
        return spark.read.parquet(f"{tmp_path}/in").select("doc_id", F.lit(0).alias("line_no"), "x")

    df = spark.createDataFrame([(i, i % 7) for i in range(50)], "doc_id long, x int")
    df.write.parquet(f"{tmp_path}/in")
    one = stored(spark, "t", [f"{tmp_path}/in"], make, "doc_id", "line_no")
    two = stored(spark, "t", [f"{tmp_path}/in"], make, "doc_id", "line_no")
    assert made == [1] and one.count() == two.count() == 50
    plan = one.groupBy("doc_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    df.union(df).write.mode("overwrite").parquet(f"{tmp_path}/in")
    assert stored(spark, "t", [f"{tmp_path}/in"], make, "doc_id", "line_no").count() == 100 and made == [1, 1]


assert LINE
