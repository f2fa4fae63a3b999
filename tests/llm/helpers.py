"""Small documents with every odd case, and frames that hold them."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1, n=60):
    """Texts with exact and near copies, shared passages, repeats within a text, nulls, blanks and one long text."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 60))
    line = " ".join(words(rng, 9))
    texts = [None, "", "  \n\t ", "one", "Zwölf Boxkämpfer jagen"]
    for i in range(n):
        lines = [" ".join(words(rng, rng.randrange(3, 30))) for _ in range(rng.randrange(1, 8))]
        if i % 4 == 0:
            lines.insert(rng.randrange(len(lines) + 1), passage)
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), line)
        if i % 11 == 0:
            lines.append("buy now " * 40)
        texts.append("\n".join(lines))
    for i in range(12):
        t = texts[5 + i * 3]
        texts.append(t)
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts.append(" ".join(words(rng, 6000)))
    return [(i, t, "en", f"s{i % 5}" if i % 17 else None, len(t or "")) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3)
