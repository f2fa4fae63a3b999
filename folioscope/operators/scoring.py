"""Scores of predicted outlines, and paired comparison of two prediction sets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.scratch import table

METRICS = ("precision", "recall", "f1", "level_accuracy", "page_accuracy")
TIE = 1e-12


def match_entries(gold: DataFrame, pred: DataFrame, ignore_numbers: bool = False) -> DataFrame:
    """Gold entries matched one to one: the k-th of a title with the k-th predicted one of that title."""
    def keyed(df: DataFrame) -> DataFrame:
        name = "k_plain" if ignore_numbers else "k_title"
        df = T.with_keys(df, "title", name).withColumnRenamed(name, "k")
        return df.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "k").orderBy("pos")))

    g, p = keyed(gold), keyed(pred)
    p = p.select("doc_id", "k", "rn", F.col("pos").alias("p_pos"), F.col("level").alias("p_level"), F.col("printed_page").alias("p_printed"))
    return g.join(p, ["doc_id", "k", "rn"], "inner")


def score_outlines(gold: DataFrame, pred: DataFrame, ignore_numbers: bool = False, missing_is_miss: bool = True) -> DataFrame:
    """One row per document of gold that has predictions: METRICS; null where a metric has nothing to measure.

    A gold page that the matched prediction has none for is a miss.  With missing_is_miss false page accuracy is null, not
    0, in a document where all of them are so; SQL's sum over nulls is.
    """
    m = match_entries(gold, pred, ignore_numbers).groupBy("doc_id").agg(
        F.count("*").alias("m"),
        F.count_if(F.col("level") == F.col("p_level")).alias("lv"),
        F.count("printed_page").alias("pg"),
        F.count_if(F.col("printed_page") == F.col("p_printed")).alias("pk"),
        F.count_if(F.col("printed_page").isNotNull() & F.col("p_printed").isNotNull()).alias("pb"),
    )
    n = gold.groupBy("doc_id").agg(F.count("*").alias("ng")).join(pred.groupBy("doc_id").agg(F.count("*").alias("np")), "doc_id")
    s = n.join(m, "doc_id", "left").fillna(0, ["m", "lv", "pg", "pk", "pb"])
    p, r = F.col("m") / F.col("np"), F.col("m") / F.col("ng")
    return s.select(
        "doc_id", p.alias("precision"), r.alias("recall"),
        F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"),
        F.try_divide("lv", "m").alias("level_accuracy"), F.when(F.lit(missing_is_miss) | (F.col("pb") > 0), F.try_divide("pk", "pg")).alias("page_accuracy"),
    )


def macro_average(gold: DataFrame, scores: DataFrame) -> DataFrame:
    """Averages of the metrics over documents (null ones left out), with documents scored and skipped."""
    docs = gold.select("doc_id").distinct().join(scores, "doc_id", "left")
    return docs.agg(
        F.count("f1").alias("documents"), F.count_if(F.col("f1").isNull()).alias("skipped"), *(F.avg(m).alias(m) for m in METRICS)
    )


def paired(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(metric, doc_id, b, c, delta) for the documents and metrics that both have."""
    pairs = ", ".join(f"'{m}', b_{m}, c_{m}" for m in METRICS)
    b = baseline.select("doc_id", *(F.col(m).alias(f"b_{m}") for m in METRICS))
    c = candidate.select("doc_id", *(F.col(m).alias(f"c_{m}") for m in METRICS))
    long = b.join(c, "doc_id").select("doc_id", F.expr(f"stack({len(METRICS)}, {pairs}) as (metric, b, c)"))
    return long.where("b is not null and c is not null").withColumn("delta", F.col("c") - F.col("b"))


def compare(pairs: DataFrame) -> DataFrame:
    """Per metric: documents, mean of either side and of the difference, wins, losses, ties."""
    return pairs.groupBy("metric").agg(
        F.count("*").alias("documents"), F.avg("b").alias("baseline"), F.avg("c").alias("candidate"), F.avg("delta").alias("mean"),
        F.count_if(F.col("delta") > TIE).alias("wins"), F.count_if(F.col("delta") < -TIE).alias("losses"),
        F.count_if(F.abs("delta") <= TIE).alias("ties"),
    )


def bootstrap(pairs: DataFrame, resamples: int = 10_000, confidence: float = 0.95, seed: int = 0, most: int = 10_000) -> DataFrame:
    """(metric, ci_low, ci_high): percentile interval of the mean difference over resamples of the documents.

    Each resample draws as many documents as there are, with replacement.  Documents are dealt by their ids' hash over
    a power of two of blocks, of about `most` at most.  How many draws of a resample fall into a block follows from
    halving: a range of blocks passes a binomial share of its draws to its first half.  Within a block its documents
    are drawn one by one.  That is the multinomial at every size; its generators are seeded by the range or block, so
    the result depends on the documents and `most` only, not on partitions or batches.  Null for fewer than two documents.
    The pairs are stored first, since they are read four times.
    """
    pairs = table(pairs, "pairs")
    n = pairs.groupBy("metric").count().agg(F.max("count")).first()[0] or 0
    levels = max(0, math.ceil(math.log2(max(n, 1) / most)))
    blocks = 1 << levels
    lo = int((1 - confidence) / 2 * resamples)
    hi = min(resamples - 1, int((1 + confidence) / 2 * resamples))
    dealt = pairs.select("metric", "doc_id", "delta", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"))
    sizes: dict = {}
    for r in dealt.groupBy("metric", "block").count().collect():
        sizes.setdefault(r["metric"], [0] * blocks)[r["block"]] = r["count"]

    def sums(key, pdf):
        import numpy as np
        import pandas as pd

        metric, block = key
        size = np.concatenate([[0], np.cumsum(sizes[metric])])
        draws = np.full(resamples, size[-1])
        first, last = 0, blocks
        while last - first > 1:
            mid = (first + last) // 2
            rng = np.random.default_rng([seed, first, last])
            left = rng.binomial(draws, (size[mid] - size[first]) / max(size[last] - size[first], 1))
            first, last, draws = (first, mid, left) if block < mid else (mid, last, draws - left)
        x = pdf.sort_values(["doc_id", "delta"])["delta"].to_numpy()
        rng = np.random.default_rng([seed, block, blocks, len(x)])
        total = [x[rng.integers(0, len(x), k)].sum() for k in draws.tolist()]
        return pd.DataFrame({"metric": metric, "r": np.arange(resamples), "s": total})

    drawn = dealt.groupBy("metric", "block").applyInPandas(sums, "metric string, r int, s double")
    # exact sums, whatever their order
    totals = drawn.groupBy("metric", "r").agg(F.sum(F.col("s").cast("decimal(28,15)")).cast("double").alias("s"))
    ranked = totals.withColumn("k", F.row_number().over(Window.partitionBy("metric").orderBy("s")) - 1).where(F.col("k").isin(lo, hi))
    ends = ranked.groupBy("metric").agg(F.max(F.when(F.col("k") == lo, F.col("s"))).alias("low"), F.max(F.when(F.col("k") == hi, F.col("s"))).alias("high"))
    out = pairs.groupBy("metric").agg(F.count("*").alias("n")).join(ends, "metric", "left")
    return out.select("metric", *(F.when(F.col("n") > 1, F.col(c) / F.col("n")).alias(f"ci_{c}") for c in ("low", "high")))


def bootstrap_sequential(pairs: DataFrame, resamples: int = 10_000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """(metric, ci_low, ci_high) as a sequential draw gives them: for sets of documents that one task can hold.

    Each metric's differences, in the order of ids, are drawn one by one from Python's generator seeded with `seed`, so
    published intervals can be reproduced to the digit.  `bootstrap` is the one to use for large sets.
    """
    lo, hi = int((1.0 - confidence) / 2.0 * resamples), min(int((1.0 - (1.0 - confidence) / 2.0) * resamples), resamples - 1)

    def run(key, pdf):
        import random

        import pandas as pd

        x = pdf.sort_values("doc_id")["delta"].tolist()
        low = high = None
        if len(x) > 1:
            rng = random.Random(seed)
            drawn = ([rng.choice(x) for _ in x] for _ in range(resamples))
            means = sorted(sum(d) / len(x) for d in drawn)
            low, high = means[lo], means[hi]
        return pd.DataFrame({"metric": [key[0]], "ci_low": [low], "ci_high": [high]}).astype({"ci_low": "Float64", "ci_high": "Float64"})

    return pairs.groupBy("metric").applyInPandas(run, "metric string, ci_low double, ci_high double")


def report(compared: DataFrame, intervals: DataFrame) -> str:
    """A table in plain text of `compare` and `bootstrap`: a line for each of METRICS, `--` where there is nothing to say."""
    rows = {r["metric"]: r for r in compared.join(intervals, "metric", "left").collect()}  # one row a metric
    # Titles and widths of the columns; the first is aligned to the left.
    columns = (("metric", 15), ("baseline", 10), ("candidate", 11), ("delta", 10), ("95% CI", 22), ("W/L/T", 14), ("n", 5))

    def line(*cells: str) -> str:
        return "".join(c.ljust(w) if k == 0 else c.rjust(w) for k, (c, (_, w)) in enumerate(zip(cells, columns, strict=True)))

    head = line(*(name for name, _ in columns))
    out = [head, "-" * len(head)]
    for m in METRICS:
        r = rows.get(m)
        if r is None or not r["documents"]:
            out.append(line(m, "--", "", "", "", "", "0"))
            continue
        ci = "--" if r["ci_low"] is None else f"[{r['ci_low']:+.4f}, {r['ci_high']:+.4f}]"
        moved = f"{r['wins']}/{r['losses']}/{r['ties']}"
        out.append(line(m, f"{r['baseline']:.4f}", f"{r['candidate']:.4f}", f"{r['mean']:+.4f}", ci, moved, str(r["documents"])))
    return "\n".join(out)


#: Cuts that are tried: twentieths below 0.95, then steps of 0.005 up to 0.995.
CUTS = tuple(0.05 + 0.05 * k for k in range(18)) + tuple(0.95 + 0.005 * k for k in range(10))


def tune_threshold(scored: DataFrame, cuts: tuple[float, ...] = CUTS) -> DataFrame:
    """(threshold, f1): the cut on `score` with the best F1 for `label` > 0; of equal ones the lowest.

    A cut without a true positive is no candidate; if none is one, (0.5, -1).  Scores are first counted by the last cut
    that they reach, so the cuts never multiply the rows.
    """
    cuts = tuple(sorted(cuts))
    point = F.lit(None).cast("double")
    for t in cuts:
        point = F.when(F.col("score") >= t, t).otherwise(point)
    hits = scored.select(point.alias("t"), (F.col("label") > 0).cast("long").alias("y")).groupBy("t").agg(F.sum("y").alias("tp"), F.count("*").alias("n"))
    # one row for each cut at most, from here on
    down = Window.orderBy(F.desc_nulls_last("t")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.desc_nulls_last("t")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = hits.select("t", F.sum("tp").over(down).alias("tp"), F.sum("n").over(down).alias("n"), F.sum("tp").over(whole).alias("pos"))
    p, r = F.col("tp") / F.col("n"), F.col("tp") / F.col("pos")
    at = at.where("t is not null and tp > 0").withColumn("f1", 2 * p * r / (p + r))
    # a cut that nothing falls on has the counts of the next higher one: the lowest of equal ones follows the last used
    lowest = F.coalesce(F.lag("t").over(Window.orderBy("t")), F.lit(float("-inf")))
    at = at.withColumn("threshold", F.array_min(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > lowest)))
    best = at.agg(F.max(F.struct("f1", -F.col("threshold"))).alias("b"))
    return best.select(F.coalesce(-F.col("b")["col2"], F.lit(0.5)).alias("threshold"), F.coalesce(F.col("b")["f1"], F.lit(-1.0)).alias("f1"))
