"""Quality classifier: sizes under zstandard dictionaries of good and of bad text, as a calibrated score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm._common import table

#: Labelled documents of each class that the fit may use; half make the dictionary, half the calibration.
SAMPLE = 3_000
#: Pieces of the dictionary half, of each class, that the driver trains on.
PIECES = 12_000
#: Bytes of a piece: short enough that a dictionary matters throughout a long text.
PIECE = 512
DICTIONARY = 32 << 10
LEVEL = 3


@dataclass(frozen=True)
class Model:
    """Dictionaries and the logistic calibration of the size difference."""

    good: bytes
    bad: bytes
    slope: float
    bias: float

    def compressors(self):
        out = []
        for raw in (self.good, self.bad):
            if not raw:
                out.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False))
                continue
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out


def pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


def difference(text: bytes, good, bad) -> float:
    """Normalised difference of the compressed sizes of the whole text: positive if the good dictionary suits it better."""
    g = b = 0
    for x in pieces(text):
        g += len(good.compress(x))
        b += len(bad.compress(x))
    return (b - g) / max(g, b, 1)


def _differences(model: Model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = model.compressors()
        for batch in batches:
            d = [difference(t or b"", good, bad) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(d, pa.float64())], [*keep, "difference"])

    return run


def _train(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; of too few to train one, their own bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and bias of a lightly damped logistic fit, by Newton's method."""
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, v = weight * (y - p), weight * p * (1 - p) + 1e-9
        ga, gb = (r * x).sum() - 1e-4 * a, r.sum() - 1e-4 * b
        haa, hab, hbb = (v * x * x).sum() + 1e-4, (v * x).sum(), v.sum() + 1e-4
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 10 / max(abs(da), abs(db), 1e-9))
        a, b = a + step * da, b + step * db
        if max(abs(da), abs(db)) < 1e-8:
            break
    return max(float(a), 0.0), float(b)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_pieces: int = PIECES) -> Model:
    """Fit on at most `sample` labelled documents of each class, the first by a hash of their id.

    Half of them make that class's dictionary, from at most `most_pieces` pieces of PIECE bytes, the first by a hash of
    document and place; the other half, whole, make the calibration.

    `labels` holds the rows to learn from and no others.  Their class shares, over all of them, are the calibration's
    prior.  Null ids or labels, labels other than 0 and 1, and labels without a document teach nothing; without any
    document of a class the score is that class share's.
    """
    lab = labels.select(F.col(id_col).cast("long").alias("d"), F.col(label_col).cast("int").alias("y")).where("d is not null and y in (0, 1)")
    total = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    lab = lab.withColumn("h", F.xxhash64("d")).distinct()
    # at most twice `sample` ids: small enough to send to every executor
    picked = lab.where("y = 0").orderBy("h").limit(sample).union(lab.where("y = 1").orderBy("h").limit(sample))
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = table(rows.join(F.broadcast(picked), "d"), "labelled")
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.octet_length("text") - 1) / PIECE).cast("int"))),
        lambda i: F.substring(F.col("text").cast("binary"), i * PIECE + 1, F.lit(PIECE)),
    )
    half = rows.where("h % 2 = 0").select("y", "h", F.posexplode(cut).alias("k", "piece")).where("octet_length(piece) > 0")
    half = half.withColumn("o", F.xxhash64("h", "k"))
    made = {}
    for y in (0, 1):
        made[y] = _train([bytes(r["piece"]) for r in half.where(F.col("y") == y).orderBy("o", "piece").limit(most_pieces).select("piece").collect()])
    first = Model(made[1], made[0], 1.0, 0.0)
    rest = rows.where("h % 2 <> 0").select("y", "text").mapInArrow(_differences(first, ["y"]), "y int, difference double")
    seen = sorted((r["difference"], r["y"]) for r in rest.collect())  # two numbers for each calibration document
    x, y = np.array([s[0] for s in seen]), np.array([s[1] for s in seen], dtype=float)
    n = sum(total.values())
    if len(set(y.tolist())) < 2:
        share = (total.get(1, 0) + 1) / (n + 2)
        return Model(made[1], made[0], 0.0, float(np.log(share / (1 - share))))
    weight = np.where(y == 1, total[1] / n / (y == 1).mean(), total[0] / n / (y == 0).mean())
    return Model(made[1], made[0], *_logistic(x, y, weight))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of docs with `score` (0 to 1) and `predicted` (1 if score >= 0.5) as doc_id, score, predicted.

    Only a text's bytes decide; all of them do.  A null text scores as an empty one, by the prior alone.  Each row is
    scored by itself, repeated or not.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_differences(model, ["doc_id"]), f"doc_id {dict(docs.dtypes)[id_col]}, difference double")
    p = 1 / (1 + F.exp(-(F.col("difference") * model.slope + model.bias)))
    return out.select("doc_id", p.alias("score")).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are predicted to be good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = model.compressors()
        at = names.index(text_col)
        for batch in batches:
            d = [difference(t or b"", good, bad) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array([x * model.slope + model.bias >= 0 for x in d], pa.bool_()))

    names = docs.columns
    return docs.mapInArrow(run, docs.schema)


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3; a null id counts as the text of nothing."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3


def op9_quality(spark, sf_dir):
    """All documents, learnt from the labels of folds 0 and 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold() != 1)
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (fold() == 1).alias("held_out"), "score", "predicted")
