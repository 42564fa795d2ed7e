"""Language-model scores by masked pseudo-likelihood.

A small bidirectional window network predicts every word from SIDE words on
either side, never from itself: position-wise embeddings of the neighbours are
added and a tanh layer follows. A first softmax gives the word's class, a second
one, with weights of its own for every word, the word within its class. The
summed conditional log-probabilities of a document's words are its score.

The vocabulary is that of the corpus: every word is counted over all documents,
into a stored table that grows with them. The OWN most frequent words have
vectors of their own and are predicted one by one, in classes of similar
frequency. Each rarer word belongs to the class of its band (counts from a power
of two to the next): the network predicts the band from both sides, and within
it the word has its own share of the band's counts.

Documents are encoded in chunks: the words of a chunk are numbered, and the
distinct ones, by 64 bits of their hash, are counted, summed over all chunks, and
joined back to the chunks that hold them. All documents train: they are split
over ROUNDS rounds, in each of which every task trains from the same start in
numpy on its share; the parameters are added up in a few tasks and averaged,
weighted by words.

Defined results: null, empty and wordless texts have 0 words, score 0 and a
null mean; repeated rows get equal results; words that tie at the edge of the
vocabulary enter it in order of their hash; with no words at all nothing is
trained; an empty table gives an empty result; other columns are not read.
Numbers may differ in the last digits with the order in which tasks are summed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldline.llm.batches import gathered, map_batches, texts_of
from fieldline.session import discard, materialise

OWN = 2_048
CLASSES = 48
# Bands of rarer words by the bit length of their count; the last one takes all above.
BANDS = 24
SIDE, WIDTH = 2, 16
OFFSETS = [k for k in range(-SIDE, SIDE + 1) if k]
ROUNDS, BATCH, RATE = 2, 4096, 0.3
SCORED = 16_384  # words scored at a time
CHUNK_BYTES = 16 << 20
# Tasks that bring the sums of parameters to the driver; more than ADDERS ** 2 tasks are added up in two steps.
ADDERS = 8

INPUTS = 1 + OWN + BANDS  # 0 is the edge of a text
SHAPES = {"embed": (len(OFFSETS), INPUTS, WIDTH), "hidden": (WIDTH,), "out": (WIDTH, CLASSES + BANDS), "bias": (CLASSES + BANDS,), "own": (OWN, WIDTH), "own_bias": (OWN,)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


class _Numbers(dict):
    """Words numbered in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def numbered(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the word numbers of all texts in turn, and the words of each text; A-Z lower-cased, split at ASCII white space."""
    numbers = _Numbers()
    parts = []
    for text in texts:
        words = text.lower().split() if text else []
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    return list(numbers), np.concatenate(parts) if parts else np.zeros(0, np.uint32), lengths


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64).view(np.int64)


def _packed(numbers: np.ndarray) -> bytes:
    """Byte by byte of all numbers, compressed: the high bytes are mostly nought."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _chunks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per chunk of texts: their ids and lengths, all word numbers, and hash and count of each distinct word."""
    schema = T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(docs.schema[doc_id].dataType)),
            T.StructField("lengths", T.ArrayType(T.LongType())),
            *[T.StructField(n, T.BinaryType()) for n in ("words", "hashes", "counts")],
        ]
    )

    def run(batches):
        first = TaskContext.get().partitionId() << 32
        for nth, batch in enumerate(gathered(batches, CHUNK_BYTES)):
            words, numbers, lengths = numbered(texts_of(batch.column(1)))
            counts = np.bincount(numbers, minlength=len(words)).astype("<u4")
            ids, offsets = batch.column(0), pa.array([0, batch.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([first + nth]),
                    pa.ListArray.from_arrays(offsets, ids),
                    pa.ListArray.from_arrays(offsets, pa.array(lengths)),
                    *[pa.array([x], pa.binary()) for x in (_packed(numbers), hashes_of(words).astype("<i8").tobytes(), counts.tobytes())],
                ],
                names=schema.names,
            )

    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, schema)


def word_counts(chunks: DataFrame) -> DataFrame:
    """(hash, n) of every word of the corpus."""

    def run(batches):
        for batch in batches:
            for hashes, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(hashes, "<i8")), pa.array(np.frombuffer(counts, "<u4").astype(np.int64))], names=["hash", "n"])

    return map_batches(chunks.select("hashes", "counts"), run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def band_of(counts: np.ndarray) -> np.ndarray:
    """The band of a count: its bit length less one."""
    return np.minimum(np.frexp(counts.astype(float))[1] - 1, BANDS - 1)


def vocabulary(counts: DataFrame, own: int = OWN, classes: int = CLASSES) -> dict[str, np.ndarray] | None:
    """From the corpus counts: the ``own`` most frequent words in order, the class and first member of each, and the log sizes of the bands.

    Classes are runs of words by falling frequency with about equal sums of the
    square root of their counts. None without words.
    """
    top = counts.orderBy(F.desc("n"), "hash").limit(own).collect()
    if not top:
        return None
    n = np.array([r.n for r in top], dtype=np.int64)
    weight = np.cumsum(np.sqrt(n))
    wanted = np.minimum((weight - np.sqrt(n) / 2) / weight[-1] * classes, classes - 1).astype(np.int64)
    starts = np.flatnonzero(np.append(True, np.diff(wanted) > 0))
    size = np.zeros(BANDS)
    band = F.least(F.length(F.bin("n")) - 1, F.lit(BANDS - 1))
    for r in counts.groupBy(band.alias("band")).agg(F.sum("n").alias("n")).collect():
        size[r.band] = r.n
    np.subtract.at(size, band_of(n), n.astype(float))
    return {
        "hashes": np.array([r.hash for r in top], dtype=np.int64),
        "class_of": np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(n)))),
        "starts": np.append(starts, len(n)),
        "band_size": np.log(np.maximum(size, 1.0)),
    }


def _own_codes(hashes: np.ndarray, words: dict) -> np.ndarray:
    """The rank of each word in the vocabulary, or -1."""
    order = np.argsort(words["hashes"])
    found = words["hashes"][order]
    at = np.minimum(np.searchsorted(found, hashes), len(found) - 1)
    return np.where(found[at] == hashes, order[at], -1)


def _rare_counts(chunks: DataFrame, counts: DataFrame, words: dict) -> DataFrame:
    """(chunk, rare): for every chunk the counts of its words outside the vocabulary, in order of their numbers."""
    sent = chunks.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes = np.frombuffer(data, "<i8")
                at = np.flatnonzero(_own_codes(hashes, sent.value) < 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), chunk)), pa.array(at.astype(np.int32)), pa.array(hashes[at])], names=["chunk", "number", "hash"])

    rare = map_batches(chunks.select("chunk", "hashes"), run, "chunk long, number int, hash long")
    # A chunk has at most CHUNK_BYTES / 2 words.
    listed = rare.join(counts, "hash").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("number", "n"))).alias("rare"))
    return listed.select("chunk", F.col("rare.n").alias("rare"))


def _encoded(chunks: DataFrame, rare: DataFrame, words: dict) -> DataFrame:
    """Chunks with the code of each distinct word (its rank, or OWN and its band) and its log share of the band."""
    sent = chunks.sparkSession.sparkContext.broadcast(words)
    kept = ["chunk", "doc_ids", "lengths", "words"]
    schema = T.StructType([*[chunks.schema[c] for c in kept], T.StructField("codes", T.BinaryType()), T.StructField("shares", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                codes = _own_codes(np.frombuffer(batch.column(4)[i].as_py(), "<i8"), sent.value)
                shares, at = np.zeros(len(codes)), np.flatnonzero(codes < 0)
                if len(at):
                    n = batch.column(5)[i].values.to_numpy(zero_copy_only=False)
                    band = band_of(n)
                    codes[at], shares[at] = OWN + band, np.log(n) - sent.value["band_size"][band]
                made = [pa.array([x], pa.binary()) for x in (codes.astype("<u2").tobytes(), shares.astype("<f4").tobytes())]
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(i, 1) for k in range(4)], *made], names=schema.names)

    return map_batches(chunks.join(rare, "chunk", "left").select(*kept, "hashes", "rare"), run, schema)


def initial(seed: int = 9) -> np.ndarray:
    draw = np.random.default_rng(seed)
    parts = {k: np.zeros(s) for k, s in SHAPES.items()}
    for name in ("embed", "out", "own"):
        parts[name] = draw.normal(0, 0.1, SHAPES[name])
    return np.concatenate([p.reshape(-1) for p in parts.values()]).astype(np.float32)


def _parts(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the parameters by name."""
    parts, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        parts[name] = flat[at : at + size].reshape(shape)
        at += size
    return parts


def neighbours(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Inputs beside each word, a row per offset; texts are set apart by edges."""
    places = np.arange(len(codes)) + SIDE * (1 + np.repeat(np.arange(len(lengths)), lengths))
    line = np.zeros(len(codes) + SIDE * (len(lengths) + 1), dtype=np.uint16)
    line[places] = codes + 1
    return np.stack([line[places + k] for k in OFFSETS])


def _logits(hidden: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Logits that can be raised to powers: the hidden values are from -1 to 1, so the weights bound them; the largest is taken off only where it must."""
    logits = hidden @ weights + bias
    if np.abs(weights).sum(axis=0).max() + np.abs(bias).max() > 60:
        logits -= logits.max(axis=1, keepdims=True)
    return logits


def _softmax(logits: np.ndarray) -> np.ndarray:
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def _log_softmax_at(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log-probability of one column of each row."""
    chosen = logits[np.arange(len(at)), at]
    return chosen - np.log(np.exp(logits, out=logits).sum(axis=1))


def _hidden(p: dict, near: np.ndarray) -> np.ndarray:
    total = p["embed"][0][near[0]] + p["hidden"]
    for j in range(1, len(OFFSETS)):
        total += p["embed"][j][near[j]]
    return np.tanh(total, out=total)


def _by_class(codes: np.ndarray, words: dict) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(members, places, member of each place) for every class of several words that occurs in ``codes``."""
    own = np.flatnonzero(codes < OWN)
    classes = words["class_of"][codes[own]]
    order = np.argsort(classes, kind="stable")
    own, classes = own[order], classes[order]
    starts = np.flatnonzero(np.append(True, classes[1:] != classes[:-1])) if len(own) else []
    for a, b in zip(starts, [*starts[1:], len(own)]):
        first, end = words["starts"][classes[a]], words["starts"][classes[a] + 1]
        if end - first > 1:
            yield slice(first, end), own[a:b], codes[own[a:b]] - first


def targets(codes: np.ndarray, words: dict) -> np.ndarray:
    """The class of each word; bands are classes behind the others."""
    own = np.minimum(codes, len(words["class_of"]) - 1)
    return np.where(codes < OWN, words["class_of"][own], CLASSES + codes - OWN)


def _log_probabilities(p: dict, near: np.ndarray, codes: np.ndarray, words: dict) -> np.ndarray:
    """Of each word's class, and of the word within it where the network predicts that."""
    hidden = _hidden(p, near)
    out = _log_softmax_at(_logits(hidden, p["out"], p["bias"]), targets(codes, words))
    for members, at, own in _by_class(codes, words):
        out[at] += _log_softmax_at(_logits(hidden[at], p["own"][members].T, p["own_bias"][members]), own)
    return out


def gradient(p: dict, g: dict, near: np.ndarray, codes: np.ndarray, words: dict) -> None:
    """The gradient of the mean negative log-probability, into ``g``."""
    hidden, many = _hidden(p, near), len(codes)
    d = _softmax(_logits(hidden, p["out"], p["bias"]))
    d[np.arange(many), targets(codes, words)] -= 1
    d /= many
    g["out"][:], g["bias"][:] = hidden.T @ d, d.sum(axis=0)
    below = d @ p["out"].T
    g["own"][:], g["own_bias"][:] = 0, 0
    for members, at, own in _by_class(codes, words):
        h = hidden[at]
        d = _softmax(_logits(h, p["own"][members].T, p["own_bias"][members]))
        d[np.arange(len(at)), own] -= 1
        d /= many
        g["own"][members], g["own_bias"][members] = d.T @ h, d.sum(axis=0)
        below[at] += d @ p["own"][members]
    below *= 1 - hidden * hidden
    g["hidden"][:] = below.sum(axis=0)
    g["embed"][:] = 0
    for j in range(len(OFFSETS)):
        # The rows of equal inputs, brought together, are added up.
        order = np.argsort(near[j], kind="stable")
        inputs = near[j][order]
        starts = np.flatnonzero(np.append(True, inputs[1:] != inputs[:-1]))
        g["embed"][j][inputs[starts]] = np.add.reduceat(below[order], starts, axis=0)


def _texts_of_turn(codes: np.ndarray, lengths: np.ndarray, turn: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and lengths of the texts that train in this round: those whose codes have that checksum."""
    ends = np.cumsum(lengths)
    raw = memoryview(codes.astype("<u2").tobytes())
    mine = [zlib.crc32(raw[2 * (b - n) : 2 * b]) % ROUNDS == turn for b, n in zip(ends.tolist(), lengths.tolist())]
    return codes[np.repeat(np.array(mine, dtype=bool), lengths)], lengths[np.array(mine, dtype=bool)]


def _codes(row: dict) -> np.ndarray:
    return np.frombuffer(row["codes"], "<u2").astype(np.int64)[_unpacked(row["words"])]


def train_on(texts: Iterator[tuple[np.ndarray, np.ndarray]], flat: np.ndarray, words: dict) -> np.ndarray | None:
    """Parameters after one pass over (codes, lengths), by Adagrad, times the words seen; in the last place the words seen."""
    flat = flat.copy()
    p, squares, grad = _parts(flat), np.full(SIZE, 1e-6, dtype=np.float32), np.zeros(SIZE, dtype=np.float32)
    g, seen = _parts(grad), 0
    for codes, lengths in texts:
        near = neighbours(codes, lengths)
        for a in range(0, len(codes), BATCH):
            gradient(p, g, near[:, a : a + BATCH], codes[a : a + BATCH], words)
            squares += grad * grad
            flat -= RATE * grad / np.sqrt(squares)
        seen += len(codes)
    return np.append(flat.astype(np.float64) * seen, seen) if seen else None


def _averaged(encoded: DataFrame, turn: int, flat: np.ndarray, words: dict) -> np.ndarray:
    """Parameters after every task has trained on its share of this round: they are added up in a few tasks, the driver averages."""
    sent = encoded.sparkSession.sparkContext.broadcast((flat, words))
    wide = max(ADDERS, isqrt(encoded.rdd.getNumPartitions()))

    def train(batches):
        def texts():
            for batch in batches:
                for row in batch.to_pylist():
                    codes, lengths = _texts_of_turn(_codes(row), np.array(row["lengths"], dtype=np.int64), turn)
                    yield codes, lengths

        total = train_on(texts(), *sent.value)
        if total is not None:
            number = TaskContext.get().partitionId() % wide
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["adder", "total"])

    def add(batches):
        total = None
        for batch in batches:
            for data in batch.column(1).to_pylist():
                part = np.frombuffer(data)
                total = part.copy() if total is None else total + part
        if total is not None:
            number = TaskContext.get().partitionId() % ADDERS
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["adder", "total"])

    schema = "adder int, total binary"
    added = map_batches(map_batches(encoded.select("words", "codes", "lengths"), train, schema).repartition(wide, "adder"), add, schema)
    if wide > ADDERS:
        added = map_batches(added.repartition(ADDERS, "adder"), add, schema)
    found = added.collect()  # ADDERS rows of the model's size
    sent.unpersist()
    total = sum((np.frombuffer(r.total) for r in found), np.zeros(SIZE + 1))
    return (total[:-1] / total[-1]).astype(np.float32) if total[-1] else flat


def fit(encoded: DataFrame, words: dict) -> np.ndarray:
    """The network's parameters, under a megabyte."""
    flat = initial()
    for turn in range(ROUNDS):
        flat = _averaged(encoded, turn, flat, words)
    return flat


def score_texts(codes: np.ndarray, shares: np.ndarray, lengths: np.ndarray, flat: np.ndarray, words: dict) -> np.ndarray:
    """Summed log-probability of each text; ``shares`` are the words' log shares of their bands, 0 for words of the vocabulary."""
    p, near = _parts(flat), neighbours(codes, lengths)
    logs = np.zeros(len(codes) + 1)
    for a in range(0, len(codes), SCORED):
        b = min(a + SCORED, len(codes))
        logs[a + 1 : b + 1] = _log_probabilities(p, near[:, a:b], codes[a:b], words) + shares[a:b]
    sums, ends = np.cumsum(logs), np.cumsum(lengths)
    return sums[ends] - sums[ends - lengths]


def prepared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict | None]:
    """Encoded chunks, stored, and the vocabulary."""
    chunks = materialise(_chunks(docs, doc_id, text), "lm-chunks")
    counts = materialise(word_counts(chunks), "lm-counts")
    words = vocabulary(counts)
    if words is None:
        return chunks, None
    encoded = materialise(_encoded(chunks, _rare_counts(chunks, counts, words), words), "lm-encoded")
    discard(chunks, counts)
    return encoded, words


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, log_prob (sum), mean_log_prob (null without words)."""
    encoded, words = prepared(docs, doc_id, text)
    kind = encoded.schema["doc_ids"].dataType.elementType
    sent = docs.sparkSession.sparkContext.broadcast(None if words is None else (fit(encoded, words), words))
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType())])
    columns = ["doc_ids", "lengths"] if words is None else ["doc_ids", "lengths", "words", "codes", "shares"]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, lengths = batch.column(0)[i].values, batch.column(1)[i].values.to_numpy(zero_copy_only=False)
                total = np.zeros(len(lengths))
                if sent.value:
                    row = {n: batch.column(n)[i].as_py() for n in ("words", "codes", "shares")}
                    shares = np.frombuffer(row["shares"], "<f4").astype(float)[_unpacked(row["words"])]
                    total = score_texts(_codes(row), shares, lengths, *sent.value)
                yield pa.RecordBatch.from_arrays([ids, pa.array(lengths), pa.array(total)], names=schema.names)

    scored = map_batches(encoded.select(*columns), run, schema)
    return scored.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))
