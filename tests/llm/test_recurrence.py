import random

import numpy as np
import pytest

from folioscope.llm import _bytes as B
from folioscope.llm import _recurrence, substring_dedup, suffix_dedup
from tests.conftest import ROOT
from tests.llm.helpers import DOC, corpus, frame


def brute(units, window, same_document):
    """What is covered by a window that starts earlier, per id: straight from the definition."""
    first, out = {}, {}
    for d, u in sorted(units):
        covered, mine = bytearray(len(u)), {}
        for i in range(len(u) - window + 1):
            k = tuple(u[i : i + window])
            if k in first:
                covered[i : i + window] = b"\1" * window
            elif same_document:
                first[k] = d
            else:
                mine[k] = d
        first.update(mine)
        out[d] = covered
    return out


def check(spark, rows, window5=13, window8=100):
    from folioscope.ship import ship

    ship(spark)
    docs = frame(spark, rows)
    raw = [(d, (t or "").encode()) for d, t, *_ in rows]
    want = brute([(d, t.split()) for d, t in raw], window5, False)
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeated_phrases(docs, window5, min(6, window5 - 1)).collect()}
    for d, t in raw:
        w = t.split()
        assert bytes(got[d]["kept"]) == b" ".join(x for x, c in zip(w, want[d], strict=True) if not c)
        assert (got[d]["n"], got[d]["n_removed"]) == (len(w), sum(want[d]))
    want = brute(raw, window8, True)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeated_bytes(docs, window8, 40).collect()}
    for d, t in raw:
        assert bytes(got[d]["kept"]) == bytes(x for x, c in zip(t, want[d], strict=True) if not c)
        assert got[d]["n_removed"] == sum(want[d])
        assert len(got[d]["spans"]) == sum(c and (not i or not want[d][i - 1]) for i, c in enumerate(want[d]))


@pytest.mark.parametrize("crowd,piece", [(20_000, 2 << 20), (1, 1 << 10)])
def test_against_brute_force(spark, monkeypatch, crowd, piece):
    monkeypatch.setattr(_recurrence, "CROWD", crowd)
    monkeypatch.setattr(_recurrence, "PIECE", piece)
    check(spark, corpus(3))


def test_periodic_and_tiny_texts(spark):
    rows = [(i, t, "x", "s", 0) for i, t in enumerate(["a" * 500, "a" * 99, "ab" * 300, "", None, "x y " * 90, "x y " * 90, "y x " * 90])]
    check(spark, rows)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], DOC)
    assert substring_dedup.remove_repeated_phrases(empty).count() == 0
    assert suffix_dedup.remove_repeated_bytes(empty).count() == 0
    odd = spark.createDataFrame([(1, "a " * 40, 5, "x"), (2, "a " * 40, 6, "y"), (2, "a " * 40, 6, "y"), (None, "a " * 40, 7, None)], "doc_id long, text string, d long, t1 string")
    got = sorted((r["doc_id"] or 99, r["n_removed"]) for r in substring_dedup.remove_repeated_phrases(odd).collect())
    assert got == [(1, 0), (2, 40), (2, 40), (99, 40)]


def test_words_and_grams_do_not_depend_on_blocks():
    import pyarrow as pa

    rng = random.Random(5)
    texts = [" ".join(str(rng.randrange(50)) for _ in range(rng.randrange(40))) for _ in range(50)] + [None, ""]
    for size in (10, 1000, 1 << 20):
        seen = []
        for _, _, data, at in B.blocks(pa.array(texts), size):
            begin, end, first = B.words(data, at)
            h = B.word_hashes(data, begin, end)
            seen += [h[first[r] : first[r + 1]].tolist() for r in range(len(at) - 1)]
        assert [len(s) for s in seen] == [len((t or "").split()) for t in texts]
        if size == 10:
            base = seen
        assert seen == base


@pytest.mark.parametrize("letters", [1, 2, 26])
def test_corpus_order(letters):
    """Ranks of suffixes from the parse are those of the suffixes themselves."""
    rng = np.random.default_rng(letters)
    common = rng.integers(97, 97 + letters, 300).astype(np.uint8).tobytes()
    texts = [rng.integers(97, 97 + letters, int(rng.integers(1, 90))).astype(np.uint8).tobytes() + common[: int(rng.integers(0, 300))] for _ in range(30)]
    data, number = suffix_dedup.corpus_order(texts, 10_000)
    assert data.tobytes() == b"".join(texts)
    suffixes = [t[i:] for t in texts for i in range(len(t))]
    place = {s: k for k, s in enumerate(sorted(set(suffixes)))}
    assert np.unique(number, return_inverse=True)[1].tolist() == [place[s] for s in suffixes]
    # to a lesser depth, strings of that depth still stand together and in order
    number = suffix_dedup.corpus_order(texts, 50)[1]
    heads = [s[:50] for _, s in sorted(zip(number.tolist(), suffixes, strict=True))]
    assert heads == sorted(heads)


def test_periodic_text_stays_small(tmp_path):
    """20 MB of one letter, and of one short word, pass both first steps within 1 GB."""
    import subprocess
    import sys

    code = """
import resource, sys
import numpy as np, pyarrow as pa
from folioscope.llm import _recurrence as R
kind, text, window, gram = sys.argv[1], sys.argv[2] * int(sys.argv[3]), int(sys.argv[4]), int(sys.argv[5])
b = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([3]), pa.array([text])], ["d", "t1", "t2", "text"])
a = set()
for x in R._survey(kind, window, gram, 2)(iter([b])):
    a |= set(x.column("anchors").flatten().to_pylist())
b = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text]), pa.array([list(a)])], ["d", "t1", "text", "cand"])
rows = sum(x.num_rows for x in R._contexts(kind, window, gram, kind == "byte")(iter([b])))
print(rows, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    for args in (["byte", "a", "20000000", "100", "40"], ["word", "a ", "10000000", "13", "6"], ["word", "buy now ", "2000000", "13", "6"]):
        got = subprocess.run([sys.executable, "-c", code, *args], capture_output=True, text=True, check=True, cwd=str(ROOT))
        rows, mb = map(int, got.stdout.split())
        assert rows < 1000 and mb < 1000
