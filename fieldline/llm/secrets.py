"""Secret scans: pattern findings plus a character network over every candidate.

Three patterns give the base findings (assignments, access keys, long hex
strings). Candidates are runs of eight or more characters of the usual secret
alphabets that are not a plain word (a digit, a sign, a capital inside or three
in a row), and values of six or more characters behind a colon or an equals
sign, quoted ones whole. A convolutional network in numpy reads each candidate
with the characters around it, a long one in overlapping windows of which the
highest score counts.

The network is trained on labelled findings: candidates that a base finding
covers are secrets, of the others nothing is known. So that it does not merely
learn the base patterns by heart, it sees the secrets without what gives them
away as well: the text in front hidden, the characters redrawn from other
alphabets. The others serve as negatives only as far as they are reliable: two
networks are trained on half of them each and judge the other half, and what
scores like a secret is left out. The scores are calibrated (Platt) on findings
that were not trained on. The threshold is the highest that keeps RECALL of all
labelled findings of the corpus, hidden and redrawn like that; nothing raises it.

A candidate at or above it that overlaps no base finding is added as kind
``model``; base findings always stay and get a score as well.

Defined results: null and empty texts have no findings; repeated rows get equal
results; of candidates that contain one another the longest counts; equal scores
at the threshold are all added; without labelled findings of both sorts the
network adds nothing; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldline.llm.batches import map_batches
from fieldline.session import materialise

KINDS = ["assign", "access", "hex", "model"]
# The base patterns, fixed; letters of the names match in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")  # the same as runs of HEX that are long enough
NAMES = ("password", "passwd", "secret", "token", "api")
_SIGNS = r"A-Za-z0-9+/_.=\-"
RUN = re.compile(rf"(?<![{_SIGNS}])(?=[{_SIGNS}]{{8}})(?=[A-Za-z.\-]*(?:[0-9+/_=]|[a-z][A-Z]|[A-Z]{{3}}))[{_SIGNS}]+")
VALUE = re.compile(rf"""[:=]\x20{{0,2}}(?:"([^"\n]{{6,}})"|'([^'\n]{{6,}})'|([{_SIGNS}]{{6,}}))""")

BEFORE, INSIDE, AFTER = 24, 48, 8
WIDTH = BEFORE + INSIDE + AFTER
# Windows of long candidates begin so many characters apart.
STRIDE = 24
# Secrets are redrawn at lengths from this up to a window.
LEAST = 10
PER_LABEL = 2_000
RECALL = 0.95
EMBED, FILTERS, KERNEL, HIDDEN = 8, 16, 5, 16
EPOCHS, BATCH, RATE = 14, 64, 0.005
SYMBOLS = 100
# Scores are counted in steps of this size for the threshold.
STEP = 1e-4


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the three patterns, in order of start, then kind."""
    found = []
    small = text.lower()
    if any(n in small for n in NAMES):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in LONG_HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[0], f[2]))


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of every candidate that no other one contains."""
    found = {m.span() for m in RUN.finditer(text)}
    found |= {m.span(m.lastindex) for m in VALUE.finditer(text)}
    out, reached = [], -1
    for start, end in sorted(found, key=lambda f: (f[0], -f[1])):
        if end > reached:
            out.append((start, end))
            reached = end
    return out


def _codes(text: str) -> bytes:
    """A code for each character: 0 pads, other than ASCII is one code."""
    return bytes(0 if c == "\0" else 99 if ord(c) > 126 else max(ord(c) - 31, 1) for c in text)


def contexts(text: str, start: int, end: int) -> bytes:
    """A fixed number of character codes around and in each window of a candidate, one after another."""
    out = []
    for a in range(start, max(start + 1, end - INSIDE + STRIDE), STRIDE):
        b = min(end, a + INSIDE)
        left, right = text[max(0, a - BEFORE) : a].rjust(BEFORE, "\0"), text[b : b + AFTER].ljust(AFTER, "\0")
        out.append(_codes(left + text[a:b].ljust(INSIDE, "\0") + right))
    return b"".join(out)


_FINDINGS = T.StructType(
    [
        T.StructField("base", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.IntegerType())]))),
        T.StructField("candidates", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("contexts", T.BinaryType()), T.StructField("known", T.BooleanType())]))),
    ]
)
_BASE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())]))
_CANDIDATES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("contexts", pa.binary()), ("known", pa.bool_())]))


def scan(text: str | None) -> tuple[list[dict], list[dict]]:
    if not text:
        return [], []
    base = base_findings(text)
    rows = []
    for start, end in candidates(text):
        known = any(a < end and start < b for a, b, _ in base)
        rows.append({"start": start, "end": end, "contexts": contexts(text, start, end), "known": known})
    return [{"start": a, "end": b, "kind": k} for a, b, k in base], rows


def findings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, base findings and candidates with their contexts."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *_FINDINGS.fields])

    def run(batches):
        for batch in batches:
            rows = [scan(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], _BASE), pa.array([r[1] for r in rows], _CANDIDATES)], names=schema.names)

    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, schema)


class Network:
    """Embedding, one convolution with maximum over the places, a hidden layer, one logit."""

    def __init__(self, seed: int = 5):
        draw = np.random.default_rng(seed)
        scale = lambda *shape: draw.normal(0, 1 / np.sqrt(np.prod(shape[:-1])), shape)
        self.p = {
            "embed": draw.normal(0, 0.5, (SYMBOLS, EMBED)),
            "conv": scale(KERNEL * EMBED, FILTERS),
            "conv_b": np.zeros(FILTERS),
            "hidden": scale(3 * FILTERS, HIDDEN),
            "hidden_b": np.zeros(HIDDEN),
            "out": scale(HIDDEN, 1),
            "out_b": np.zeros(1),
        }
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.steps = 0

    # The maximum is taken apart before, in and after the candidate.
    PARTS = ((0, BEFORE - KERNEL + 1), (BEFORE - KERNEL + 1, BEFORE + INSIDE), (BEFORE + INSIDE - KERNEL + 1, WIDTH - KERNEL + 1))

    def forward(self, codes: np.ndarray, keep: bool = False):
        p = self.p
        places = np.arange(WIDTH - KERNEL + 1)[:, None] + np.arange(KERNEL)
        windows = p["embed"][codes[:, places]].reshape(len(codes), len(places), KERNEL * EMBED)
        conv = np.maximum(windows @ p["conv"] + p["conv_b"], 0)
        best = [conv[:, a:b].argmax(axis=1) + a for a, b in self.PARTS]
        pooled = np.concatenate([np.take_along_axis(conv, i[:, None], 1)[:, 0] for i in best], axis=1)
        hidden = np.maximum(pooled @ p["hidden"] + p["hidden_b"], 0)
        logit = (hidden @ p["out"] + p["out_b"])[:, 0]
        return (logit, windows, best, pooled, hidden, places) if keep else logit

    def step(self, codes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        p = self.p
        logit, windows, best, pooled, hidden, places = self.forward(codes, True)
        d_out = ((_logistic(logit) - labels) * weights / weights.sum())[:, None]
        g = {"out": hidden.T @ d_out, "out_b": d_out.sum(0)}
        d_hidden = (d_out @ p["out"].T) * (hidden > 0)
        g |= {"hidden": pooled.T @ d_hidden, "hidden_b": d_hidden.sum(0)}
        d_pooled = (d_hidden @ p["hidden"].T) * (pooled > 0)
        rows, at = np.arange(len(codes))[:, None], np.concatenate(best, axis=1)  # the place of each filter's maximum, part by part
        taken = windows[rows, at] * d_pooled[:, :, None]
        g["conv"] = taken.reshape(len(codes), 3, FILTERS, KERNEL * EMBED).sum(axis=(0, 1)).T
        g["conv_b"] = d_pooled.reshape(len(codes), 3, FILTERS).sum((0, 1))
        back = d_pooled[:, :, None] * np.tile(p["conv"].T, (3, 1))
        symbols, back = codes[rows[:, :, None], places[at]].reshape(-1), back.reshape(-1, EMBED)
        g["embed"] = np.stack([np.bincount(symbols, back[:, e], SYMBOLS) for e in range(EMBED)], axis=1)
        self.steps += 1
        for k, grad in g.items():
            m, v = self.moments[k]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            p[k] -= RATE * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def calibrate(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Platt's slope and offset, by Newton steps on the log loss with softened targets."""
    positive, negative = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, b = 1.0, 0.0
    x = np.stack([logits, np.ones_like(logits)])
    for _ in range(200):
        q = _logistic(a * logits + b)
        grad = x @ (q - target)
        curve = (x * (q * (1 - q))) @ x.T + 1e-3 * np.eye(2)
        step = np.clip(np.linalg.solve(curve, grad), -1, 1)  # steps from a flat stretch would overshoot
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


_INSIDE = slice(BEFORE, BEFORE + INSIDE)
_ALPHABETS = [
    np.frombuffer(_codes(a), dtype=np.uint8)
    for a in (
        "0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789_-",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    )
]


def hidden(codes: np.ndarray) -> np.ndarray:
    """Contexts without the text around the candidate, where the names and quotation marks of the base patterns stand."""
    out = codes.copy()
    out[:, :BEFORE] = 0
    out[:, BEFORE + INSIDE :] = 0
    return out


def redrawn(codes: np.ndarray) -> np.ndarray:
    """Secrets with all that gives them away hidden: the text around, the length, and the characters, drawn anew from one of the alphabets.

    The draw depends on the context alone.
    """
    out = hidden(codes)
    for row in out:
        draw = np.random.default_rng(xxhash.xxh3_64_intdigest(row.astype(np.uint8).tobytes()))
        size = int(draw.integers(LEAST, INSIDE + 1))
        row[_INSIDE] = 0
        row[BEFORE : BEFORE + size] = draw.choice(_ALPHABETS[draw.integers(len(_ALPHABETS))], size)
    return out


def views(codes: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Secrets as they are or with some of what gives them away hidden: the text around, their alphabet and length."""
    out = codes.copy()
    out[draw.random(len(out)) < 0.7, :BEFORE] = 0
    out[draw.random(len(out)) < 0.7, BEFORE + INSIDE :] = 0
    for i in np.flatnonzero(draw.random(len(out)) < 0.75):
        size = int(draw.integers(LEAST, INSIDE + 1))
        out[i, _INSIDE] = 0
        out[i, BEFORE : BEFORE + size] = draw.choice(_ALPHABETS[draw.integers(len(_ALPHABETS))], size)
    return out


def _trained(secrets: np.ndarray, others: np.ndarray, seed: int) -> Network:
    """A network from secrets and negatives, both sorts with the same weight in all."""
    network, draw = Network(seed), np.random.default_rng(seed + 1)
    labels = np.append(np.ones(len(secrets)), np.zeros(len(others)))
    weights = np.where(labels > 0, 0.5 / len(secrets), 0.5 / len(others)) * len(labels)
    for _ in range(EPOCHS):
        codes = np.concatenate([views(secrets, draw), others])
        alone = draw.random(len(others)) < 0.5
        codes[len(secrets) :][alone] = hidden(others[alone])
        turn = draw.permutation(len(codes))
        for a in range(0, len(turn), BATCH):
            at = turn[a : a + BATCH]
            network.step(codes[at], labels[at], weights[at])
    return network


def fit(sample: list[tuple[bytes, bool]]) -> dict | None:
    """Network and calibration from labelled contexts (in a fixed order); every fourth calibrates.

    None unless there are some of either sort to train and to calibrate on.
    """
    codes = np.array([np.frombuffer(c, dtype=np.uint8) for c, _ in sample], dtype=np.int64).reshape(-1, WIDTH)
    known = np.array([k for _, k in sample], dtype=bool)
    secrets, others = codes[known], codes[~known]
    if len(secrets) < 4 or len(others) < 8:
        return None
    held = np.arange(len(secrets)) % 4 == 0
    # What looks like a secret to a network that was not trained on it is no reliable negative. The second
    # judges are trained without what the first ones found.
    reliable = np.ones(len(others), dtype=bool)
    for turn in range(2):
        looks = np.zeros(len(others), dtype=bool)
        for half in (0, 1):
            own = np.arange(len(others)) % 2 == half
            judge = _trained(secrets[~held], others[own & reliable], 5 + 2 * turn + half)
            least = np.quantile(judge.forward(redrawn(secrets[held])), 1 - RECALL)
            looks[~own] = np.maximum(judge.forward(others[~own]), judge.forward(hidden(others[~own]))) >= least
        reliable = ~looks
        if not (reliable[::2].any() and reliable[1::2].any()):
            return None
    negatives = others[reliable]
    if len(negatives) < 4:
        return None
    apart = np.arange(len(negatives)) % 4 == 0
    network = _trained(secrets[~held], negatives[~apart], 9)
    logits = np.concatenate([network.forward(redrawn(secrets[held])), network.forward(negatives[apart])])
    slope, offset = calibrate(logits, np.append(np.ones(held.sum()), np.zeros(apart.sum())))
    return {"network": network.p, "slope": slope, "offset": offset}


def scores_of(codes: np.ndarray, model: dict) -> np.ndarray:
    network = Network()
    network.p = model["network"]
    logits = [network.forward(codes[a : a + 512]) for a in range(0, len(codes), 512)]
    return _logistic(model["slope"] * np.concatenate(logits) + model["offset"]) if logits else np.zeros(0)


def candidate_scores(windows: list[bytes], model: dict, hide: bool = False) -> np.ndarray:
    """The highest score among the windows of each candidate, with and without the text around it; ``redrawn`` if ``hide``."""
    if not windows:
        return np.zeros(0)
    counts = np.array([len(w) // WIDTH for w in windows])
    codes = np.frombuffer(b"".join(windows), dtype=np.uint8).reshape(-1, WIDTH).astype(np.int64)
    scores = scores_of(redrawn(codes), model) if hide else np.maximum(scores_of(codes, model), scores_of(hidden(codes), model))
    return np.maximum.reduceat(scores, np.cumsum(counts) - counts)


def recall_threshold(found: DataFrame, model: dict, recall: float = RECALL) -> float:
    """The highest score (in steps of STEP) that keeps ``recall`` of all known candidates, ``redrawn``."""
    sent = found.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            windows = batch.column(0).to_pylist()
            steps = np.floor(candidate_scores(windows, sent.value, hide=True) / STEP).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(steps)], names=["step"])

    known = found.select(F.explode("candidates").alias("c")).filter("c.known").select("c.contexts")
    counts = map_batches(known, run, "step long").groupBy("step").agg(F.count("*").alias("n")).collect()  # 1 / STEP rows at most
    total, kept = sum(r.n for r in counts), 0
    for r in sorted(counts, key=lambda r: -r.step):
        kept += r.n
        if kept >= recall * total:
            return r.step * STEP
    return 0.0


def labelled_sample(found: DataFrame, per_label: int = PER_LABEL) -> list[tuple[bytes, bool]]:
    """The ``per_label`` distinct contexts of either label that come first by hash; of a long candidate the first window."""
    first = F.substring("c.contexts", 1, WIDTH).alias("context")
    rows = found.select(F.explode("candidates").alias("c")).select(first, "c.known").distinct()
    picked = []
    for known in (True, False):
        picked += [(bytes(r.context), known) for r in rows.filter(F.col("known") == known).orderBy(F.xxhash64("context"), "context").limit(per_label).collect()]
    return sorted(picked, key=lambda p: (xxhash.xxh3_64_intdigest(p[0]), p))


_BASE_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_SPANS = T.ArrayType(T.StructType([*_BASE_SPANS.elementType.fields, T.StructField("score", T.DoubleType())]))


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", per_label: int = PER_LABEL) -> DataFrame:
    """One row per document: doc_id, base (kind, start, end) and spans (all findings, with score), in order of start, then kind.

    The score of a base finding is the highest among the candidates it overlaps,
    null where there is none.
    """
    found = materialise(findings(docs, doc_id, text), "secret-findings")
    model = fit(labelled_sample(found, per_label))
    if model:
        model["threshold"] = recall_threshold(found, model)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([found.schema["doc_id"], T.StructField("base", _BASE_SPANS), T.StructField("spans", _SPANS)])
    place = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]

    def run(batches):
        for batch in batches:
            base, rows = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            pool = [c["contexts"] for own in rows for c in own or ()]
            scores = iter(candidate_scores(pool, sent.value).tolist() if sent.value else [None] * len(pool))
            spans = []
            for own, listed in zip(base, rows):
                scored = [(c, next(scores)) for c in listed or ()]
                added = [(c["start"], KINDS.index("model"), c["end"], x) for c, x in scored if x is not None and not c["known"] and x >= sent.value["threshold"]]
                for b in own or ():
                    over = [x for c, x in scored if x is not None and c["known"] and c["start"] < b["end"] and b["start"] < c["end"]]
                    added.append((b["start"], b["kind"], b["end"], max(over, default=None)))
                spans.append(sorted(added, key=lambda f: f[:3]))
            plain = [[{"kind": KINDS[b["kind"]], "start": b["start"], "end": b["end"]} for b in own or ()] for own in base]
            full = [[{"kind": KINDS[k], "start": a, "end": b, "score": x} for a, k, b, x in own] for own in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(plain, pa.list_(pa.struct(place))), pa.array(full, pa.list_(pa.struct([*place, ("score", pa.float64())])))], names=schema.names
            )

    return map_batches(found, run, schema)
