"""Substring dedup: repeated-phrase automata over words."""

from __future__ import annotations

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import _bytes as B
from folioscope.llm._recurrence import remove_recurring

WINDOW = 13
#: Words of an anchor: windows of WINDOW words are looked for around sequences of so many words that recur.
GRAM = 6


def _automaton(window: int):
    def compare(contexts: list[bytes], doc: np.ndarray, _pos: np.ndarray) -> list[list[tuple[int, int]]]:
        """Confirm which passages recur, compile them into an automaton, and stream the contexts in the order of documents.

        Confirmation looks at hashes of windows only: what has one hash in two documents is compiled.  The stream finds
        the passages themselves; the first document that holds one keeps it.
        """
        number: dict[bytes, int] = {}
        streams = [np.array([number.setdefault(w, len(number)) for w in c.split(b" ")], dtype=np.uint64) for c in contexts]
        size = np.array([len(s) - window + 1 for s in streams])
        h = np.concatenate([B.gram_hashes(B.mix(s), window) for s in streams])
        of = np.repeat(np.arange(len(streams)), size)
        order = np.lexsort((doc[of], h))
        sh, sd = h[order], doc[of][order]
        last = np.append(sh[1:] != sh[:-1], True)
        group = np.append(0, np.cumsum(last[:-1]))
        several = sd[np.append(0, np.flatnonzero(last)[:-1] + 1)] < sd[last]
        out: list[list[tuple[int, int]]] = [[] for _ in contexts]
        # one window of each passage that is confirmed
        place = order[np.append(0, np.flatnonzero(last)[:-1] + 1)[several]]
        if not len(place):
            return out
        start = np.cumsum(size) - size
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for w in place.tolist():
            k = int(of[w])
            at = w - int(start[k])
            automaton.add_word(tuple(streams[k][at : at + window].tolist()), len(automaton))
        automaton.make_automaton()
        hit = np.zeros(len(streams), dtype=bool)
        hit[of[order[several[group]]]] = True
        keeper: dict[int, int] = {}
        for k in np.argsort(doc, kind="stable").tolist():
            if not hit[k]:
                continue
            spans, d = out[k], int(doc[k])
            for end, passage in automaton.iter(tuple(streams[k].tolist())):
                if keeper.setdefault(passage, d) < d:
                    s = end + 1 - window
                    if spans and s <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], end + 1)
                    else:
                        spans.append((s, end + 1))
        return out

    return compare


def remove_repeated_phrases(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word covered by a window (`window` successive words) that also starts in a document with a smaller id.

    Words are runs without ASCII white space, compared byte by byte.  Recurring passages are confirmed where the
    contexts of a recurring anchor meet (see ``_recurrence``); each shard compiles its passages into an Aho-Corasick
    automaton over words and streams its part of all documents through it, in their order, which locates every
    occurrence and tells the first.  A piece of text that several documents have is streamed once, and what is found in
    it holds for each.  Windows are judged on the input.

    Returns doc_id, kept (the words left, joined by one space; binary UTF-8), n, n_removed, spans (of words removed).
    A null, empty or blank text has no words; a text shorter than the window keeps all; a null id sorts last; rows
    that repeat an id count as one document, so a passage that only they share stays.
    """
    return remove_recurring(docs, "word", window, gram, _automaton(window), same_document=False, id_col=id_col, text_col=text_col)


def op5_substring(spark, sf_dir):
    """All documents, windows of 13 words."""
    out = remove_repeated_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("n").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
