"""Each operator against brute force, a round trip or held-out accuracy, with nulls, blanks, ties and repeats."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import takewhile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope import scratch
from folioscope.llm import (
    _packs,
    chat,
    decontamination,
    embedding_dedup,
    line_dedup,
    lm_scoring,
    mixing,
    near_dedup,
    quality,
)
from folioscope.llm import _bytes as B
from folioscope.llm._common import components
from folioscope.ship import ship
from tests.llm.helpers import DOC, corpus, frame


@pytest.fixture(autouse=True)
def _ship(spark):
    ship(spark)


# mixing


def test_mix_targets_and_order(spark):
    rows = corpus(7)
    out = {r["doc_id"]: r for r in mixing.mix(frame(spark, rows)).collect()}
    size = {d: len((t or "").split()) for d, t, *_ in rows}
    assert {d: r["size"] for d, r in out.items()} == size
    by = defaultdict(int)
    for d, _, _, s, _ in rows:
        by[s] += out[d]["taken"]
    for d, _, _, s, _ in rows:
        assert abs(by[s] - out[d]["target"]) <= 1
        assert out[d]["taken"] <= 3 * size[d]
        assert out[d]["passes"] == sorted(out[d]["passes"])
    assert sum(by.values()) == pytest.approx(sum(size.values()), abs=len(by))
    again = {r["doc_id"]: r for r in mixing.mix(frame(spark, rows).repartition(7)).collect()}
    assert again == out


def test_progress_inverts_the_schedule(spark):
    for k, knots in enumerate(mixing.CURRICULUM):
        (_, w0), (_, w1) = knots
        for share in (0.0, 0.1, 0.5, 1.0):
            t = spark.range(1).select(mixing.progress(F.lit(share), F.lit(k))).first()[0]
            assert w0 * t + (w1 - w0) * t * t / 2 == pytest.approx(share * (w0 + w1) / 2)


def test_mix_of_nothing_and_repeats(spark):
    assert mixing.mix(spark.createDataFrame([], DOC)).count() == 0
    rows = [(1, "a b", "e", "s", 0), (1, "a b", "e", "s", 0), (None, None, None, None, None)]
    out = mixing.mix(frame(spark, rows)).collect()
    assert sum(r["taken"] for r in out) == 4 and len(out) == 3
    assert len(mixing.training_order(mixing.mix(frame(spark, rows))).collect()) == 2


# chat


def test_chat_round_trip(spark):
    said = ["", None, "\\", "a\\/b", "</turn>\n### user: x", "#", "<\\/turn>", "é\n\n😀", "###", "\\###", "x" * 50_000]
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for t in said for r in ("user", "assistant", "we: ird\\#</turn>", None))]
    rows += [(None, 0, "assistant", "lost"), (2, 0, "user", "same"), (2, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    chats = chat.format_chats(df)
    back = {r["conv_id"]: r["t"] for r in chats.select("conv_id", chat.read_back(F.col("formatted")).alias("t")).collect()}
    assert [(t["role"], t["text"]) for t in back[1]] == [(r or "", t or "") for _, _, r, t in rows if _ == 1 or True][: len(said) * 4]
    assert len(back[2]) == 2 and back[None][0]["text"] == "lost"
    d = {r["conv_id"]: r for r in chat.digest(chats).collect()}
    under = "".join(t or "" for c, _, r, t in rows if c == 1 and r == "assistant")
    assert d[1]["loss_chars"] == len(under) and d[1]["loss_sha256"] == hashlib.sha256(under.encode()).hexdigest()
    assert d[2]["loss_chars"] == 0


def test_chat_events(spark):
    e = [
        (1, 1, "message", "user", "hi", None),
        (1, 2, "message", "assistant", "He", None),
        (1, 3, "delta", None, "llo", None),
        (1, 4, "regenerate", None, "Good ", None),
        (1, 5, "delta", None, "day", None),
        (1, 6, "edit", None, "hi there", 1),
        (1, 7, "delta", None, "!", None),
        (1, 8, "delta", None, "?", 9),
        (1, 9, "noise", None, "?", None),
        (2, 1, "delta", None, "early", None),
    ]
    df = spark.createDataFrame(e, "conv_id long, seq long, kind string, role string, text string, target long").repartition(4)
    got = [tuple(r) for r in chat.reconstruct(df).orderBy("conv_id", "msg").collect()]
    assert got == [(1, 1, "user", "hi there"), (1, 2, "assistant", "Good day!")]


# embeddings


def test_embeddings_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        c = rng.normal(size=24)
        for _ in range(int(rng.integers(1, 6))):
            rows.append((c + rng.normal(size=24) * 0.02 * np.linalg.norm(c) / 5).tolist())
    rows += [rows[0], rows[0], [0.0] * 24, None, [], [float("nan")] + [1.0] * 23, [None] + [1.0] * 23]
    data = [(i, v, None if i % 19 == 5 else i % 2) for i, v in enumerate(rows)]
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df).collect()}
    unit = {i: embedding_dedup.unit(v) for i, v, lab in data if lab is not None}
    links = defaultdict(set)
    for i, _, a in data:
        for j, _, b in data:
            if i != j and a is not None and a == b and unit.get(i) is not None and unit.get(j) is not None and unit[i] @ unit[j] >= 0.98:
                links[i].add(j)
    assert len(got) == len(data)
    assert {i: got[i]["n_links"] for i in got} == {i: len(links[i]) for i in got}
    for i in got:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i]["component_id"] == min(seen) and got[i]["kept"] == (min(seen) == i)
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_embedding_recall_on_planted_pairs(spark):
    """10,000 vectors with pairs just above the threshold and one crowd that holds a third of all."""
    rng = np.random.default_rng(12)
    n, dim = 10_000, 48
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(rng.normal(size=(n, dim)))

    def near(of, cosine):
        other = rng.normal(size=of.shape)
        other = unit(other - (other * of).sum(-1, keepdims=True) * of)
        return cosine * of + np.sqrt(1 - cosine**2) * other

    x[2000:4000] = near(x[:2000], 0.9805)
    x[4000:5000] = near(x[1000:2000], 0.99)
    x[6000:9000] = near(np.repeat(x[5999:6000], 3000, axis=0), 0.992)
    label = np.where(np.arange(n) % 7 == 0, 1, 0)
    label[5999:9000] = 0
    df = spark.createDataFrame([(i, v.tolist(), int(lab)) for i, (v, lab) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int").repartition(6)
    got = embedding_dedup.near_vectors(df).toPandas().set_index("vec_id").sort_index()
    true = np.zeros(n, dtype=int)
    for lab in (0, 1):
        at = np.flatnonzero(label == lab)
        for lo in range(0, len(at), 1000):
            true[at[lo : lo + 1000]] = (x[at[lo : lo + 1000]] @ x[at].T >= 0.98).sum(1) - 1
    crowd = np.arange(n) // 3000 == 2
    crowd[5999:9000], crowd[:5999], crowd[9000:] = True, False, False
    links = got["n_links"].to_numpy()
    assert (links <= true).all()
    recall = links[~crowd].sum() / true[~crowd].sum()
    print(f"recall of {true[~crowd].sum()} links at the threshold {recall:.4f}, in the crowd {links[crowd].sum() / true[crowd].sum():.4f}")
    assert true[~crowd].sum() > 3000 and recall >= 0.97 and links[crowd].sum() >= 0.97 * true[crowd].sum()


def test_embeddings_of_odd_shapes(spark):
    long = [float(i % 7) for i in range(20_000)]
    rows = [(1, [1.0, 2.0], 0, 1), (2, [1.0, 2.0], 0, 2), (3, [1.0, 2.0, 3.0], 0, 3), (4, long, 0, 4), (5, [2 * v for v in long], 0, 5), (6, [5.0], 0, 6), (7, [7.0], 0, 7), (1, [1.0, 2.0], 0, 8), (None, [1.0, 2.0], 0, 9), (8, [1e300, 2e300], 0, 10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep int")
    got = sorted((r["vec_id"] or 99, r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(df).collect())
    assert got == [(1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 6), (8, 3, 1), (99, 3, 1)]


def test_hadamard():
    x = np.random.default_rng(0).normal(size=(3, 16))
    assert np.allclose(embedding_dedup.hadamard(embedding_dedup.hadamard(x)) / 16, x)


# language model


def lm_words(text):
    return [w.translate({i: i + 32 for i in range(65, 91)}) for w in (text or "").split()] + ["<end>"]


def lm_tree(texts, depth, context, entry, discount):
    """The kept states of a suffix tree, straight from its definition: words before -> (beta, shares of symbols, lower ones)."""
    seqs = [lm_words(t) for t in texts]
    c = Counter(w for s in seqs for w in s)
    n, v = sum(c.values()), len(c)
    base = lambda x: (c[x] + 1) / (n + v + 1)
    times, after = Counter(), defaultdict(Counter)
    for s in seqs:
        for i, x in enumerate(s):
            for k in range(1, depth + 1):
                if i >= k:
                    times[tuple(s[i - k : i])] += 1
                    after[tuple(s[i - k : i])][x] += 1
    made = {}

    def p(state, x):
        if not state:
            return base(x)
        beta, shares, lower = made[state]
        return shares[x] if x in shares else beta * p(state[1:], x)

    diverges = set()
    for state in sorted(times, key=len):
        many = {x: m for x, m in after[state].items() if m >= entry}
        if times[state] < context or not many or (len(state) > 1 and state[1:] not in made):
            continue
        beta = 1 - sum(m - discount for m in many.values()) / times[state]
        lower = {x: p(state[1:], x) for x in many}
        shares = {x: (m - discount) / times[state] + beta * lower[x] for x, m in many.items()}
        made[state] = (beta, shares, lower)
        rest, below = max(1 - sum(shares.values()), 1e-12), max(1 - sum(lower.values()), 1e-12)
        gain = times[state] * (sum(q * math.log(q / lower[x]) for x, q in shares.items()) + rest * math.log(rest / below))
        if gain > 0.5 * math.log(max(n, 2)) * (1 + len(many)):
            diverges.add(state)
    kept = {s[i:] for s in diverges for i in range(len(s))}
    return c, n, v, {s: made[s] for s in kept}


def lm_probability(model, before, x):
    c, n, v, kept = model
    state = ()
    while len(state) < len(before) and tuple(before[len(before) - len(state) - 1 :]) in kept:
        state = tuple(before[len(before) - len(state) - 1 :])
    p, chain = (c[x] + 1) / (n + v + 1), [state[i:] for i in range(len(state) - 1, -1, -1)]
    for s in chain:
        beta, shares, _ = kept[s]
        p = shares[x] if x in shares else beta * p
    return p


@pytest.mark.parametrize("heavy", [4e-6, 0.02])
def test_lm_against_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(lm_scoring, "HEAVY", heavy)
    monkeypatch.setattr(lm_scoring, "TOKENS", 200)
    monkeypatch.setattr(lm_scoring, "SCORED", 100)
    rng = random.Random(4)
    after = {w: [f"v{rng.randrange(30)}" for _ in range(2)] for w in [f"v{i}" for i in range(30)]}
    rows = [(0, None), (1, ""), (2, "Odd ODD odd2 \u00c9"), (3, " ".join(["v1 v2"] * 3000))]
    for i in range(4, 400):
        w = ["v0"]
        for _ in range(rng.randrange(30)):
            w.append(rng.choice(after.get(w[-1], ["v0"])) if rng.random() < 0.9 else f"r{rng.randrange(500)}")
        rows.append((i, " ".join(w)))
    # extra columns with the names that the operator uses inside, and an id that is repeated and one that is null
    data = [(i, t, 5, "x") for i, t in rows] + [(4, "v0 v1", 6, "y"), (None, "v0 v1", 7, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, rid int, key string").repartition(3)
    train = [t for i, t, *_ in data if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    tokens = lm_scoring.tokenize(docs)
    tree = lm_scoring.train(tokens.where(~lm_scoring.held_out()))
    model = lm_tree(train, lm_scoring.DEPTH, lm_scoring.CONTEXT, lm_scoring.ENTRY, lm_scoring.DISCOUNT)
    c, n, v, kept = model
    assert (tree.n, tree.v) == (n, v)
    assert [s.count() for s in tree.states] == [sum(len(s) == k for s in kept) for k in range(1, lm_scoring.DEPTH + 1)]
    assert [e.count() for e in tree.entries] == [sum(len(b[1]) for s, b in kept.items() if len(s) == k) for k in range(1, lm_scoring.DEPTH + 1)]
    assert any(len(s) == 2 for s in kept) and (tree.values.count() > 0) == (heavy == 0.02)
    got = sorted(lm_scoring.score(tokens, tree).collect(), key=lambda r: (str(r["doc_id"]), r["n_tokens"]))
    held = base = 0.0
    for r, (i, t, *_) in zip(got, sorted(data, key=lambda x: (str(x[0]), len(lm_words(x[1])))), strict=True):
        w = lm_words(t)
        assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert r["score"] == pytest.approx(sum(math.log10(lm_probability(model, w[:k], x)) for k, x in enumerate(w)))
        if zlib.crc32(str(i).encode()) % 7 == 2:
            held, base = held + r["score"], base + r["base_score"]
    assert held > base
    # the probabilities after any history add up to one
    for history in (["v0"], ["v1", "v2"], ["never"], []):
        unseen = lm_probability(model, history, "unseen")
        assert sum(lm_probability(model, history, x) for x in c) + unseen == pytest.approx(1)


def test_lm_packs_of_a_block(spark, monkeypatch):
    """A block's keys go to a bucket in one pack, however many lengths of context they are of, and its rows in one."""
    monkeypatch.setattr(lm_scoring, "HEAVY", 0.5)
    rng = random.Random(6)
    rows = []
    for i in range(60):
        w = [0, 1]
        while len(w) < 300:
            w.append((w[-1] + w[-2]) % 9 if rng.random() < 0.8 else rng.randrange(9))
        rows.append((i, " ".join(f"v{x}" for x in w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tokens = lm_scoring.tokenize(docs.coalesce(1))
    tree = lm_scoring.train(tokens)
    assert tree.entries[1].count()
    # as many as the values need, not the tokens
    monkeypatch.setattr(_packs, "BUCKET", 100)
    values = tree.v + sum(t.count() for t in [*tree.states, *tree.entries])
    tree = lm_scoring.train(tokens)
    assert tree.buckets == _packs.buckets(3 * values) < _packs.buckets(tree.n)
    packs = tokens.select("rid", "tokens").coalesce(1).mapInArrow(lm_scoring._found(tree), _packs.SCHEMA).groupBy("side", "bucket").count().collect()
    assert sorted((r["side"], r["count"]) for r in packs) == [(1, 1)] * tree.buckets + [(2, 1)]


def test_packs_in_order_do_not_grow_with_buckets():
    """Counts by key, dealt in order, take as many bytes in five hundred buckets as in eight, but for a tenth."""
    rng = np.random.default_rng(5)
    state, symbol = (rng.integers(0, 1 << 64, 2000, dtype=np.uint64)[(2000 * rng.random(300_000) ** 3).astype(int)] for _ in range(2))
    key = lm_scoring.entry(state, symbol)
    assert (lm_scoring.state_of(key, symbol) == state).all()
    at, n = _packs.summed(key, np.ones(len(key), dtype=np.int64))
    size = {}
    for many in (8, 500):
        batch = _packs.in_order(key[at], [symbol[at], n], many)
        got = _packs.columns(batch.column("pack").to_pylist(), (np.uint64, np.uint64, np.int64))
        assert all((g == c).all() for g, c in zip(got, (key[at], symbol[at], n), strict=True))
        assert batch.column("bucket").to_pylist() == sorted(set(_packs.bucket_of(key, many).tolist()))
        size[many] = sum(map(len, _packs.in_order(key[at], [n], many).column("pack").to_pylist()))
    assert size[500] < 1.1 * size[8]


def test_lm_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    tokens = lm_scoring.tokenize(docs)
    tree = lm_scoring.train(tokens.where("false"))
    r = {r["doc_id"]: r for r in lm_scoring.score(tokens, tree).collect()}
    assert r[1]["n_known"] == 0 and r[1]["score"] == r[1]["base_score"] == 0.0 and r[2]["n_tokens"] == 1
    assert lm_scoring.score(tokens.where("false"), lm_scoring.train(tokens)).count() == 0


def test_lm_leaves_what_scoring_reads(spark, sf_dir):
    """Of the tables of the training only the packed values stay; with the tokens and the scores they make the result."""
    top = Path(scratch.scratch_dir(spark).removeprefix("file://")) / "folioscope"
    before = set(top.glob("*"))
    out = lm_scoring.op4_lm(spark, sf_dir)
    left = sorted(p.name.rsplit("-", 1)[0] for p in set(top.glob("*")) - before)
    assert left == ["packed", *["scores"] * lm_scoring.ROUNDS, "tokens"]
    assert out.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_packs():
    """Packs give back what went in, extremes included; ascending numbers take few bytes."""
    rng = np.random.default_rng(3)
    key = rng.integers(0, 1 << 64, 4000, dtype=np.uint64, endpoint=False)
    rid = np.sort(rng.integers(0, 3000, 4000)) + (5 << 33)
    raw = _packs.pack([rid, key])
    got = _packs.unpack(raw, (np.int64, np.uint64))
    assert (got[0] == rid).all() and (got[1] == key).all() and [g.dtype for g in got] == [np.int64, np.uint64]
    # eight bytes of each key, which are random, and less than one of a row's number
    assert len(raw) < 9 * len(key)
    far = np.array([-(1 << 63), -1, 0, 1, (1 << 63) - 1])
    some = np.array([0, 1, (1 << 64) - 1, (1 << 64) - 1, 5], dtype=np.uint64)
    for first, kind in ((far, np.int64), (some, np.uint64)):
        x, y = _packs.unpack(_packs.pack([first, np.arange(5) / 3]), (kind, np.float64))
        assert (x == first).all() and (y == np.arange(5) / 3).all()


# decontamination


def brute_hits(docs, items, window):
    import re

    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) if w]
    out = {}
    for d, t in docs:
        w, hit, met = words(t), set(), set()
        for i, it in items:
            x = words(it)
            for s in range(max(1, len(x) - window + 1)) if x else ():
                p = x[s : s + window]
                for at in range(len(w) - len(p) + 1):
                    if w[at : at + len(p)] == p:
                        hit |= set(range(at, at + len(p)))
                        met.add(str(i))
        out[d] = (len(w), len(hit), sorted(met))
    return out


def test_decontamination(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("ab É4 cd ef gh the The ü".split()) for _ in range(n))
    items = [(i, text(rng.randrange(8, 16))) for i in range(12)] + [(90, None), (91, ""), (92, "--"), (93, "solo"), (94, "solo")]
    docs = [(i, text(60) + ". " + items[i % 12][1] + "! " + text(5)) for i in range(30)] + [(50, None), (51, ""), (52, "x, SOLO;solo"), (53, "...")]
    dd = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    ii = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in decontamination.decontaminate(dd, ii).collect()}
    assert got == brute_hits(docs, items, 10)
    assert decontamination.decontaminate(dd.where("false"), ii).count() == 0
    assert decontamination.decontaminate(dd, ii.where("false")).where("n_hit > 0").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red big old fox ran"), (2, "fox old far away from red"), (3, "red")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(7, "old red fox")], "item_id long, text string")
    wanted = decontamination.phrases(items)
    terms = wanted.select("term").distinct().withColumn("tid", F.xxhash64("term"))
    from folioscope.llm._common import table

    postings = decontamination.index(docs, table(terms, "t"))
    wanted = wanted.join(terms, "term").drop("term")
    assert decontamination.find(postings, table(wanted, "w")).count() == 0
    assert decontamination.proximity(postings, wanted, 4).select("start").collect() == [(0,)]
    assert decontamination.proximity(postings, wanted, 6).count() == 2


# near duplicates


def exact_classes(rows):
    """Classes from all pairs' similarities."""
    seqs = {}
    for d, t in rows:
        data = np.frombuffer((t or "").encode().lower(), np.uint8)
        at = np.array([0, len(data)])
        begin, end, _ = B.words(data, at)
        seqs[d] = near_dedup.labelled_kmers(B.word_hashes(data, begin, end))
    ids = sorted(seqs)
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if len(seqs[a]) and len(seqs[b]) and near_dedup.aligned(seqs[a], seqs[b]) > 0:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in ids}


@pytest.mark.parametrize("block", [3])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(8)
    rows = [(d, t) for d, t, *_ in corpus(5, 30)]
    base = [f"b{rng.randrange(3000)}" for _ in range(150)]
    for k in range(40):
        w = list(base)
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = f"n{rng.randrange(9999)}"
        rows.append((1000 + k, " ".join(w).upper() if k % 2 else "  ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert got == exact_classes(rows)


def test_alignment_is_sensitive_to_order():
    a = np.arange(100, dtype=np.uint64)
    assert near_dedup.aligned(a, a) == 1.0
    assert near_dedup.aligned(a, a[::-1].copy()) == 0.0
    assert near_dedup.aligned(a, np.concatenate([a[50:], a[:50]])) == 0.0
    b = np.concatenate([a[:45], a[50:]])
    assert near_dedup.aligned(a, b) == pytest.approx(0.95)


def test_near_duplicates_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "A b c d e f"), (3, None), (4, ""), (5, "a"), (6, "A")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 99, r["class_id"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(1, 1), (1, 1), (3, 3), (4, 4), (5, 5), (6, 5), (99, 1)]
    assert near_dedup.near_duplicates(df.where("false")).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


# quality


def test_quality_accuracy(spark, sf_dir):
    from folioscope.llm.catalog import QUERIES

    out = QUERIES["op9_quality"](spark, sf_dir)
    assert out.count() == 200
    lab = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = out.join(lab, "doc_id").where("held_out")
    assert held.where("predicted = quality").count() / held.count() > 0.9


def test_quality_score_from_its_definition(spark):
    """Sizes under the model's own dictionaries, by zstandard alone, through the logistic function."""
    import zstandard

    rng = random.Random(3)
    good = [" ".join(rng.choice("the cat sat on a mat and then it ran home again".split()) for _ in range(rng.randrange(5, 400))) for _ in range(80)]
    bad = ["".join(rng.choice("$%&*!#@^ ") for _ in range(rng.randrange(5, 2000))) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(500, None), (501, ""), (502, good[0] * 60), (500, "x")]
    docs = spark.createDataFrame([(d, t, "p", 0.5) for d, t in rows], "doc_id long, text string, lang string, difference double").repartition(3)
    lab = spark.createDataFrame([(i, int(i < 80)) for i in range(160)], "doc_id long, quality int")
    model = quality.fit(docs, lab)
    assert model == quality.fit(docs.repartition(7), lab) and model.slope > 0

    def size(text, dictionary):
        c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(c.compress(text[i : i + quality.PIECE])) for i in range(0, len(text), quality.PIECE))

    got = sorted((r["doc_id"], r["score"], r["predicted"]) for r in quality.score(docs, model).collect())
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        g, b = size(raw, model.good), size(raw, model.bad)
        s = 1 / (1 + math.exp(-(model.slope * (b - g) / max(g, b, 1) + model.bias)))
        want.append((d, s, int(s >= 0.5)))
    assert [x[0] for x in got] == [x[0] for x in sorted(want)] and [x[1] for x in got] == pytest.approx([x[1] for x in sorted(want)])
    assert sum(p == int(d < 80) for d, _, p in got if d < 160) >= 156


def test_quality_of_odd_texts(spark):
    docs = spark.createDataFrame([(i, "plain words in a row " * 9 if i % 2 else "$$$ %%% !!! " * 20) for i in range(60)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (5, None), (999, 0)], "doc_id long, quality int")
    model = quality.fit(docs, lab)
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (3, "plain words in a row", "c"), (4, "$$$ %%% !!!", "d")], "doc_id long, text string, score string")
    got = quality.score(odd, model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert [r["predicted"] for r in got if r["doc_id"] in (3, 4)] == [1, 0]
    assert {r["doc_id"] for r in quality.accepted(odd, model).collect()} >= {3}
    assert quality.score(odd.where("false"), model).count() == 0
    none = quality.fit(docs, lab.where("false"))
    assert quality.score(odd, none).count() == 5


# line dedup


def brute_lines(rows, min_words=5):
    lines, holder, count = {}, {}, defaultdict(set)
    for d, t in sorted(rows):
        k, own = 0, []
        for no, x in enumerate((t or "").split("\n")):
            if x.split():
                own.append((k, no, x, len(x.split())))
                k += 1
                holder.setdefault(x, d)
                count[x].add(d)
        lines[d] = own
    out = {}
    for d, t in rows:
        own = [x for x in lines[d] if len(count[x[2]]) > 1]
        gone = set()
        for f in {holder[x[2]] for x in own} - {d}:
            gone |= set(line_dedup.common_blocks(own, [x for x in lines[f] if len(count[x[2]]) > 1], min_words))
        out[d] = "\n".join(x for no, x in enumerate((t or "").split("\n")) if no not in gone)
    return out


def test_line_dedup_against_brute_force(spark):
    rows = [(d, t) for d, t, *_ in corpus(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["kept"] for r in line_dedup.remove_common_lines(df).collect()}
    want = brute_lines(rows)
    assert got == want and sum(len(t or "") for _, t in rows) > sum(map(len, want.values()))
    assert line_dedup.remove_common_lines(df.where("false")).count() == 0


def test_patience_is_an_alignment():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert line_dedup.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]


def test_line_dedup_repeated_rows(spark):
    x = "one two three four five six"
    df = spark.createDataFrame([(1, x, 1), (2, x, 2), (2, x, 2), (None, x + "\n\nmore", 3), (9, None, 4)], "doc_id long, text string, d int")
    got = sorted((r["doc_id"] or 99, r["kept"]) for r in line_dedup.remove_common_lines(df).collect())
    assert got == [(1, x), (2, ""), (2, ""), (9, ""), (99, "\nmore")]


def all_earlier(rows, min_words=5):
    """Texts after an alignment with every earlier document."""
    ids, own = {}, {}
    for d, t in rows:
        for x in set((t or "").split("\n")):
            ids.setdefault(x, set()).add(d)
    for d, t in rows:
        ink = [(no, x) for no, x in enumerate((t or "").split("\n")) if x.split()]
        own[d] = [(k, no, x, len(x.split())) for k, (no, x) in enumerate(ink) if len(ids[x]) > 1]
    out = {}
    for d, t in rows:
        gone = {no for e in own if e < d for no in line_dedup.common_blocks(own[d], own[e], min_words)}
        out[d] = "\n".join(x for no, x in enumerate((t or "").split("\n")) if no not in gone)
    return out


@pytest.mark.parametrize("rare", [0, 99])
def test_line_dedup_aligns_more_than_first_holders(spark, monkeypatch, rare):
    monkeypatch.setattr(line_dedup, "RARE", rare)
    x, y = "a line of five words", "and one with five more"
    short = [f"s{i}" for i in range(6)]
    # 3 copies 2; the first holder of either line has them the other way round
    rows = [(1, f"{y}\n{x}"), (2, f"{x}\n{y}"), (3, f"{x}\n{y}")]
    # the lines of a block of short ones have their first holders in different documents
    rows += [(10 + i, f"{s}\nown {i}") for i, s in enumerate(short)]
    rows += [(20, "\n".join(["head", *short])), (21, "\n".join(["other", *short, "tail"]))]
    # a copy of the shared lines only, with lines of its own between the blank ones
    rows += [(30, f"\n{x}\n\n{y}\n")]
    rng = random.Random(3)
    if rare:
        pool = [" ".join([f"p{i}"] * (i % 4 + 2)) for i in range(12)]
        rows += [(100 + i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["kept"] for r in line_dedup.remove_common_lines(df).collect()}
    assert got[3] == "" and got[21] == "other\ntail" and got[30] == "\n\n"
    assert got == all_earlier(rows)


def test_rare_lines_pair_documents(spark):
    """3 and 4 share a block of two lines whose first holders are other documents."""
    rows = [(1, "alpha beta gamma\nzz yy"), (2, "delta eps zeta\nqq ww"), (3, "alpha beta gamma\ndelta eps zeta\nown three"), (4, "alpha beta gamma\ndelta eps zeta\nown four")]
    got = {r["doc_id"]: r["kept"] for r in line_dedup.remove_common_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: rows[2][1], 4: "own four"}


def test_line_dedup_is_sound_and_finds_planted_blocks(spark):
    """By the definition alone: what goes is a block of an earlier document; planted copies go, all else stays."""
    rng = random.Random(21)
    own = lambda d, k: f"d{d} line {k} " + " ".join(f"x{rng.randrange(9999)}" for _ in range(rng.randrange(1, 9)))
    docs = {d: [own(d, k) for k in range(rng.randrange(2, 12))] for d in range(60)}
    planted = {}
    for d in range(5, 60):
        e = rng.randrange(d)
        lo = rng.randrange(len(docs[e]))
        block = list(takewhile(lambda x, e=e: x.startswith(f"d{e} "), docs[e][lo : lo + rng.randrange(1, 5)]))
        at = rng.randrange(len(docs[d]) + 1)
        docs[d][at:at] = block
        planted[d] = block
    rows = [(d, "\n".join(ls)) for d, ls in docs.items()]
    df = spark.createDataFrame([(d, t, 1, "q") for d, t in rows], "doc_id long, text string, k int, lines string").repartition(5)
    for r in line_dedup.remove_common_lines(df).collect():
        d, gone = r["doc_id"], r["gone"]
        kept = [x for k, x in enumerate(docs[d]) if k not in gone]
        assert r["kept"] == "\n".join(kept) and set(docs[d]) - set(planted.get(d, [])) <= set(kept)
        earlier = {x for e in range(d) for x in docs[e]}
        assert all(docs[d][k] in earlier for k in gone)
        if d in planted and sum(len(x.split()) for x in planted[d]) >= 5:
            assert not set(planted[d]) & set(kept)


def test_near_duplicates_of_short_texts(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        w = [f"q{i}x{rng.randrange(10**6)}" for _ in range(9 + i % 12)]
        # without its last word a text of 9 words has 4 of 5 k-mers, exactly the threshold
        rows += [(10 * i, " ".join(w)), (10 * i + 1, " ".join(w[:-1])), (10 * i + 2, " ".join(w[1:])), (10 * i + 3, " ".join(w[:4] + w))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert got == exact_classes(rows) and got[1] == 0


def test_short_keys_meet():
    rng = np.random.default_rng(2)
    for _ in range(500):
        n = int(rng.integers(1, near_dedup.SHORT + 1))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.delete(a, rng.integers(0, n, int(n * 0.2))) if rng.random() < 0.5 else np.where(rng.random(n) < 0.1, a + np.uint64(1), a)
        if near_dedup.aligned(a, b) > 0:
            assert set(near_dedup.short_keys(a)) & set(near_dedup.short_keys(b))
    assert not len(near_dedup.short_keys(np.arange(near_dedup.SHORT + 1, dtype=np.uint64)))


def test_packs_come_together_in_order():
    packs = [bytes([i]) * (i % 5) for i in range(40)]
    runs = list(lm_scoring._together(packs, 7))
    assert [p for run in runs for p in run] == packs and all(sum(map(len, run)) >= 7 for run in runs[:-1])
    assert max(sum(map(len, run)) for run in runs) < 7 + 4 and list(lm_scoring._together([])) == []
