"""Language identification: multinomial logistic regression on TF-IDF of character n-grams.

Features are the counts of 1- to 3-grams of letters (lower-cased, words
bounded by one space), hashed to FEATURES columns, as TF-IDF with unit length.
Document frequencies are counted over all learning documents. The weights are
trained with follow-the-regularised-leader (per-coordinate rates, elastic net:
l1 makes them sparse, l2 keeps them small) on a bounded sample of about
PER_LANG learning documents per language; a temperature fitted on sampled
documents that training did not see calibrates the probabilities.

Learning uses only text and lang of documents in the learning folds
(crc32(doc_id as text) mod FOLDS is not 0); a prediction uses only the text.

Defined results: null texts, empty texts and texts without a letter are
``und`` with score 0; a null lang or doc_id is not learned from and a null
doc_id is not held out; with nothing to learn from every document is ``und``;
repeated rows get equal results; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldline.llm.batches import map_batches

FEATURES = 1 << 14
ORDERS = (1, 2, 3)
FOLDS = 5
PER_LANG = 600
CALIBRATION_SHARE = 5  # every fifth sampled document sets the temperature
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.001, 0.001
UNDETERMINED = "und"

_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def counts_of(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(features, counts) of a whole text, or None without a letter."""
    if not text:
        return None
    words = "".join(c if c.isalpha() else " " for c in text.lower()) if not text.isascii() else text.lower().translate(_ASCII)
    words = f" {' '.join(words.split())} "
    if len(words) < 3:
        return None
    codes = np.frombuffer(words.encode("utf-32-le"), dtype=np.uint32)
    hashed = []
    for order in ORDERS:
        h = np.full(max(len(codes) - order + 1, 0), order, dtype=np.uint32)
        for k in range(order):
            h = (h ^ codes[k : len(codes) - order + 1 + k]) * _PRIMES[k]
            h ^= h >> np.uint32(15)
        hashed.append(h & np.uint32(FEATURES - 1))
    totals = np.bincount(np.concatenate(hashed), minlength=FEATURES)
    features = np.flatnonzero(totals)
    return features, totals[features]


_ASCII = {i: " " for i in range(128) if not chr(i).isalpha()}


def tf_idf(counted: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    features, counts = counted
    values = np.log1p(counts) * idf[features]
    size = np.sqrt((values * values).sum())
    return features, values / size if size else values


class Leader:
    """Follow-the-regularised-leader-proximal for each class, with elastic net."""

    def __init__(self, classes: int):
        self.z = np.zeros((FEATURES + 1, classes))
        self.n = np.zeros((FEATURES + 1, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, x: np.ndarray, target: int) -> None:
        w = self.weights(at)
        p = _softmax(x @ w)
        p[target] -= 1
        g = x[:, None] * p[None, :]
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _with_bias(row: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.append(row[0], FEATURES), np.append(row[1], 1.0)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int) -> tuple[np.ndarray, float]:
    """Weights (FEATURES + 1 rows, the last the bias) and temperature. ``rows`` are TF-IDF vectors in a fixed order."""
    held = np.arange(len(rows)) % CALIBRATION_SHARE == 0
    fitted = np.flatnonzero(~held) if len(rows) > CALIBRATION_SHARE else np.arange(len(rows))
    biased = [_with_bias(r) for r in rows]
    leader, order = Leader(classes), np.random.default_rng(1)
    for _ in range(EPOCHS):
        for k in order.permutation(fitted):
            leader.learn(*biased[k], int(labels[k]))
    weights = leader.weights()
    scores = np.array([biased[k][1] @ weights[biased[k][0]] for k in np.flatnonzero(held)]).reshape(-1, classes)
    return weights, temperature(scores, labels[held])


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm.

    The right class counts (n + 1) / (n + 2), as in Platt's targets, so that a sample without an error does not make the
    model certain.
    """
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = np.maximum(_softmax(scores / np.exp(log_t)), 1e-12)
        right, doubt = np.log(p[np.arange(len(labels)), labels]), 1 / (len(labels) + 2)
        wrong = (np.log(p).sum(axis=1) - right) / max(scores.shape[1] - 1, 1)
        return -((1 - doubt) * right + doubt * wrong).mean()

    a, b, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _document_frequencies(learning: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts hold each feature, and how many texts have any: one small row set per task, summed by Spark."""
    schema = "feature int, n long"

    def run(batches):
        totals, texts = np.zeros(FEATURES, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if counted := counts_of(text):
                    totals[counted[0]] += 1
                    texts += 1
        held = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(held, -1).astype(np.int32)), pa.array(np.append(totals[held], texts))], names=["feature", "n"]
        )

    summed = map_batches(learning.select("text"), run, schema).groupBy("feature").agg(F.sum("n").alias("n"))
    df, texts = np.zeros(FEATURES), 0
    for row in summed.collect():  # FEATURES + 1 rows at most
        if row.feature < 0:
            texts = row.n
        else:
            df[row.feature] = row.n
    return df, texts


def _sample(learning: DataFrame, per_lang: int) -> list[tuple]:
    """(lang, features, counts) of about ``per_lang`` learning documents of each language, in order of a hash."""
    sizes = {r.lang: r["size"] for r in learning.groupBy("lang").agg(F.count("*").alias("size")).collect()}  # a row a language, as in the model
    if not sizes:
        return []
    size = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("lang")]
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = learning.filter(draw * size < per_lang).select("lang", F.xxhash64("doc_id", F.lit(4)).alias("turn"), "text")
    schema = "lang string, turn long, features binary, counts binary"

    def run(batches):
        for batch in batches:
            rows = []
            for lang, turn, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if counted := counts_of(text):
                    rows.append((lang, turn, counted[0].astype("<u2").tobytes(), counted[1].astype("<u4").tobytes()))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "turn", "features", "counts"])

    found = map_batches(chosen, run, schema).collect()  # per_lang documents a language, bounded
    found.sort(key=lambda r: (r.turn, r.lang))
    return [(r.lang, np.frombuffer(r.features, "<u2").astype(np.int64), np.frombuffer(r.counts, "<u4").astype(np.int64)) for r in found]


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG) -> dict:
    """The model: languages, idf, weights, temperature; about a megabyte."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    learning = narrow.filter((remainder(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    df, texts = _document_frequencies(learning)
    idf = np.log((1 + texts) / (1 + df)) + 1
    sample = _sample(learning, per_lang)
    languages = sorted({s[0] for s in sample})
    labels = np.array([languages.index(s[0]) for s in sample], dtype=np.int64)
    if not languages:
        return {"languages": [], "idf": idf, "weights": np.zeros((FEATURES + 1, 0)), "temperature": 1.0}
    weights, heat = train([tf_idf(s[1:], idf) for s in sample], labels, len(languages))
    return {"languages": languages, "idf": idf, "weights": weights, "temperature": heat}


def predict_one(text: str | None, model: dict) -> tuple[str, float]:
    counted = counts_of(text) if model["languages"] else None
    if counted is None:
        return UNDETERMINED, 0.0
    at, x = _with_bias(tf_idf(counted, model["idf"]))
    p = _softmax((x @ model["weights"][at]) / model["temperature"])
    best = int(p.argmax())
    return model["languages"][best], float(p[best])


def predict(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )

    def run(batches):
        for batch in batches:
            found = [predict_one(t, sent.value) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=schema.names
            )

    held = F.coalesce(remainder(F.col(doc_id)) == 0, F.lit(False))
    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), F.col(text).alias("text")), run, schema)
