"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character 1- to 3-grams.

Document frequencies are counted over all learning documents. The weights are learned by follow-the-regularised-leader
with elastic net on a bounded sample (``TRAIN_DOCS``, and ``LEAST_DOCS`` a label where that is more), dealt to ``SHARDS``
tasks whose weights are averaged; one temperature is then fitted to other learning documents (``CALIBRATION_DOCS``, a rare
label in proportion). Both samples are taken by a hash of id and text, so reruns agree up to the order of sums, and a rare
label has examples at every size of the corpus. Prediction reads every text once, whole.

Edge cases: null texts and texts without a letter are ``und`` with score 0; documents with a null label are not
learned from but predicted; null ids are learned from; long texts are read whole; of equal chances the first label by code
point is taken; without a learning document all are ``und``; equal rows each get a row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemesh.llm.tables import Batches, ids
from tastemesh.llm.words import chunks

BITS = 15
GRAMS = 3
TRAIN_DOCS, CALIBRATION_DOCS, SHARDS, EPOCHS = 6000, 3000, 4, 3
LEAST_DOCS = 200  # training documents of a label, if it has them
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.01
UNKNOWN = "und"
_TEMPERATURES = np.geomspace(0.02, 5.0, 60)
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the text's character n-grams and how often each occurs."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    total, key = np.zeros(1 << BITS, np.int64), np.zeros(len(points), np.uint32)
    for n in range(min(GRAMS, len(points))):
        key = (key[: len(points) - n] ^ points[n:]) * _FACTORS[n]
        key ^= key >> np.uint32(15)
        total += np.bincount((key * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    features = np.flatnonzero(total)
    return features, total[features]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit TF-IDF vector, sparse, with a last feature for the bias."""
    features, found = counts(text)
    weights = (1 + np.log(found)) * idf[features]
    norm = np.sqrt(weights @ weights) or 1.0
    return np.append(features, 1 << BITS), np.append(weights / norm, 0.1)


class Ftrl:
    """Follow-the-regularised-leader, one set of per-weight rates for each class."""

    def __init__(self, classes: int):
        self.z, self.n = (np.zeros(((1 << BITS) + 1, classes)) for _ in range(2))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, rate = self.z[at], (BETA + np.sqrt(self.n[at])) / ALPHA + L2
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / rate)

    def learn(self, features: np.ndarray, values: np.ndarray, label: int) -> None:
        own = self.weights(features)
        error = softmax(values @ own)
        error[label] -= 1
        gradient = values[:, None] * error
        squares = self.n[features] + gradient**2
        self.z[features] += gradient - (np.sqrt(squares) - np.sqrt(self.n[features])) / ALPHA * own
        self.n[features] = squares


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id's text divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _texts(batches: Batches) -> Iterator[tuple[pa.RecordBatch, int, str]]:
    for batch in batches:
        for piece in chunks(batch):
            for row, text in enumerate(piece.column("text").to_pylist()):
                yield piece, row, text


def _frequencies(learning: DataFrame) -> tuple[int, np.ndarray]:
    """Number of learning documents, and inverse document frequencies of all features."""

    def count(batches: Batches) -> Batches:
        total, docs = np.zeros((1 << BITS) + 1, np.int64), 0
        for _, _, text in _texts(batches):
            total[counts(text)[0]] += 1
            docs += 1
        total[-1] = docs
        live = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), pa.array(total[live])], ["feature", "docs"])

    rows = learning.select("text").mapInArrow(count, "feature int, docs long").groupBy("feature").agg(F.sum("docs").alias("docs")).collect()
    found = np.zeros((1 << BITS) + 1, np.int64)
    for row in rows:  # 2 ** BITS + 1 at most
        found[row.feature] = row.docs
    return int(found[-1]), np.log((1 + found[-1]) / (1 + found[:-1])) + 1


class Model:
    """Labels, inverse document frequencies, weights by class, and the temperature."""

    def __init__(self, labels: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.labels, self.idf, self.weights, self.temperature = labels, idf, weights, temperature

    def parts(self) -> tuple:
        return self.labels, self.idf, self.weights, self.temperature

    def logits(self, text: str) -> np.ndarray:
        features, values = vector(text, self.idf)
        return values @ self.weights[features]


def train(documents: DataFrame) -> Model | None:
    """A model from the documents that are not held out; None if there is none with a label."""
    spark = documents.sparkSession
    learning = documents.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    found = {r.lang: r["count"] for r in learning.groupBy("lang").count().orderBy("lang").collect()}  # a row a label
    labels = list(found)
    if not labels:
        return None
    docs, idf = _frequencies(learning)
    shared_idf, numbers = spark.sparkContext.broadcast(idf), {x: n for n, x in enumerate(labels)}

    def parts(count: int) -> tuple[float, float]:
        """Up to where a label's documents train, and from there up to where they calibrate."""
        cut = max(TRAIN_DOCS / docs, LEAST_DOCS / count)
        end = cut * (1 + CALIBRATION_DOCS / TRAIN_DOCS)
        return (cut, end) if end <= 1 else (2 / 3, 1.0)  # of few documents a third is left for the temperature

    shares = spark.createDataFrame([(x, *parts(n)) for x, n in found.items()], "lang string, cut double, end double")
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1_000_000_000)) / 1e9
    sample = learning.withColumn("place", place).join(F.broadcast(shares), "lang")  # a row a label
    training = sample.where("place < cut").withColumn("place", F.col("place") / F.col("cut"))  # labels mixed in any order by place

    def fit(batches: Batches) -> Batches:
        examples = [(vector(text, shared_idf.value), numbers[piece.column("lang")[row].as_py()], piece.column("place")[row].as_py())
                    for piece, row, text in _texts(batches)]
        if not examples:
            return
        examples.sort(key=lambda x: x[2])
        model = Ftrl(len(labels))
        for _ in range(EPOCHS):
            for (features, values), label, _ in examples:
                model.learn(features, values, label)
        weights = model.weights()
        feature, label = np.nonzero(weights)
        yield pa.RecordBatch.from_arrays(
            [pa.array(feature.astype(np.int32)), pa.array(label.astype(np.int32)), pa.array(weights[feature, label] * len(examples)),
             pa.array(np.full(len(feature), len(examples)))], ["feature", "label", "weight", "examples"])

    shards = training.repartition(SHARDS, F.floor(F.col("place") * 1_000_000_000))
    learned = shards.select("text", "lang", "place").mapInArrow(fit, "feature int, label int, weight double, examples long")
    total = training.count()
    weights = np.zeros(((1 << BITS) + 1, len(labels)))
    for row in learned.groupBy("feature", "label").agg(F.sum("weight").alias("weight")).collect():
        weights[row.feature, row.label] = row.weight / max(1, total)
    model = Model(labels, idf, weights, 1.0)
    shared = spark.sparkContext.broadcast(model.parts())
    doubt = 1 / (CALIBRATION_DOCS + 2)  # no sample proves more certainty than its size allows

    def losses(batches: Batches) -> Batches:
        loss, model = np.zeros(len(_TEMPERATURES)), Model(*shared.value)
        for piece, row, text in _texts(batches):
            scaled = model.logits(text) / _TEMPERATURES[:, None]
            right = softmax(scaled)[:, numbers[piece.column("lang")[row].as_py()]]
            loss -= (1 - doubt) * np.log(right + 1e-300) + doubt * np.log(1 - right + 1e-300)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(loss), dtype=np.int32)), pa.array(loss)], ["step", "loss"])

    judged = sample.where("place >= cut AND place < end").select("text", "lang").mapInArrow(losses, "step int, loss double")
    best = judged.groupBy("step").agg(F.sum("loss").alias("loss")).orderBy("loss", "step").first()
    model.temperature = float(_TEMPERATURES[best.step]) if best else 1.0
    return model


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score``."""
    shared = documents.sparkSession.sparkContext.broadcast(model and model.parts())

    def work(batches: Batches) -> Batches:
        model = Model(*shared.value) if shared.value else None
        for batch in batches:
            for piece in chunks(batch):
                found, scores = [], []
                for text in piece.column("text").to_pylist():
                    if model is None or text is None or not any(map(str.isalpha, text)):
                        found.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    chances = softmax(model.logits(text) / model.temperature)
                    found.append(model.labels[int(chances.argmax())])
                    scores.append(float(chances.max()))
                yield pa.RecordBatch.from_arrays(
                    [ids(piece), piece.column("held_out"), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"])

    chosen = documents.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return chosen.mapInArrow(work, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(documents: DataFrame) -> DataFrame:
    """Train on the documents that are not held out and predict the language of all."""
    return predict(documents, train(documents))
