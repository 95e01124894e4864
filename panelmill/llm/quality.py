"""Quality by random-indexing word vectors and a two-layer network.

1. Every token (a word or a run of signs, as written) has a bucket, and every bucket a sparse random
   index vector. A bucket's word vector is the sum of the index vectors of its neighbours in all
   documents: one pass over the whole corpus, whose sums are as large as the vector table only.
2. A document is pooled: mean and spread of its word vectors, mean change from word to word, length.
3. A two-layer numpy network is fitted on a bounded sample of labelled rows (``rows``), and its
   logits are divided by a temperature chosen on rows that it has not seen.

Edge cases: null and empty texts pool to zeros and get the network's score for that; rows keep their
count; without labels every score is 1; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, only_cache, ship
from .labelled import held_out, training_rows
from .toxicity import keep_rows

BUCKETS, DIMS, NONZERO, WINDOW = 1 << 14, 32, 4, 2
CHUNKS = 64
TRAIN_ROWS = 15_000
HIDDEN, EPOCHS, BATCH, RATE = 32, 30, 256, 0.003
THRESHOLD = 0.3
CACHE_WORDS = 200_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_KNOWN: dict[str, int] = {}


def token_buckets(text: str | None) -> np.ndarray:
    only_cache("quality", _KNOWN)
    tokens = _TOKEN.findall(text or "")
    try:
        return np.array([_KNOWN[t] for t in tokens], dtype=np.int64)
    except KeyError:
        if len(_KNOWN) > CACHE_WORDS:
            _KNOWN.clear()
        for t in tokens:
            if t not in _KNOWN:
                _KNOWN[t] = zlib.crc32(t.encode()) % BUCKETS
        return np.array([_KNOWN[t] for t in tokens], dtype=np.int64)


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the nonzero entries of each bucket's random index vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIMS, (BUCKETS, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))


def _add_contexts(total: np.ndarray, ids: np.ndarray, doc: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    for step in range(1, WINDOW + 1):
        near = doc[step:] == doc[:-step]
        left, right = ids[:-step][near], ids[step:][near]
        for a, b in ((left, right), (right, left)):
            for k in range(NONZERO):
                total += np.bincount(a * DIMS + places[b, k], weights=signs[b, k], minlength=BUCKETS * DIMS)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, DIMS) unit vectors from the neighbours of every token of every document."""
    places, signs = index_vectors()
    texts = docs.select("text")
    spread = max(1, int(texts.rdd.getNumPartitions() ** 0.5))

    def gather(batches):
        total, ids, docs_of, waiting, n = np.zeros(BUCKETS * DIMS), [], [], 0, 0

        def flush():
            if waiting:
                _add_contexts(total, np.concatenate(ids), np.concatenate(docs_of), places, signs)
                ids.clear(), docs_of.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                b = token_buckets(text)
                if len(b):
                    ids.append(b), docs_of.append(np.full(len(b), n))
                    waiting, n = waiting + len(b), n + 1
                if waiting > 500_000:
                    flush()
                    waiting = 0
        flush()
        if n:
            parts = np.split(total.astype(np.float32), CHUNKS)
            salt = TaskContext.get().partitionId() % spread
            yield pa.record_batch([pa.array(range(CHUNKS), pa.int32()), pa.array([salt] * CHUNKS, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["chunk", "salt", "sums"])

    def add(key: Any, part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BUCKETS * DIMS // CHUNKS)
        for s in part["sums"]:
            total += np.frombuffer(s, dtype=np.float32)
        return pd.DataFrame({"chunk": [key[0]], "salt": [0], "sums": [total.astype(np.float32).tobytes()]})

    schema = "chunk int, salt int, sums binary"
    ship(docs.sparkSession)
    sums = texts.mapInArrow(gather, schema)
    if spread > 1:
        sums = sums.groupBy("chunk", "salt").applyInPandas(add, schema)
    found = sums.groupBy("chunk").applyInPandas(add, schema).orderBy("chunk").collect()  # CHUNKS rows
    if not found:
        return np.zeros((BUCKETS, DIMS), dtype=np.float32)
    table = np.concatenate([np.frombuffer(r["sums"], dtype=np.float32) for r in found]).reshape(BUCKETS, DIMS).astype(float)
    table = np.sign(table) * np.sqrt(np.abs(table))
    table -= table.mean(axis=0)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Mean, spread and mean step of a document's word vectors, and its log length."""
    ids = token_buckets(text)
    out = np.zeros(3 * DIMS + 1, dtype=np.float32)
    if len(ids):
        v = vectors[ids]
        out[:DIMS], out[DIMS : 2 * DIMS] = v.mean(axis=0), v.std(axis=0)
        if len(ids) > 1:
            out[2 * DIMS : 3 * DIMS] = np.abs(v[1:] - v[:-1]).mean(axis=0)
        out[-1] = np.log1p(len(ids)) / 10
    return out


class Network:
    """x -> tanh(x A + a) B + b, with standardised inputs and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, check_x: np.ndarray, check_y: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.temperature, m, v, t = 1.0, [np.zeros_like(q) for q in self.p], [np.zeros_like(q) for q in self.p], 0
        x = (x - self.mean) / self.scale
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                part = order[at : at + BATCH]
                h = np.tanh(x[part] @ self.p[0] + self.p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -30, 30))) - y[part]) / len(part)
                back = np.outer(d, self.p[2]) * (1 - h * h)
                grads = [x[part].T @ back + 1e-4 * self.p[0], back.sum(axis=0), h.T @ d + 1e-4 * self.p[2], np.array([d.sum()])]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        if len(check_x):
            z, grid = self.logits(check_x), np.geomspace(0.25, 8, 41)
            loss = [np.logaddexp(0, np.where(check_y > 0, -z, z) / g).mean() for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, Network | None]:
    """Word vectors of all documents, and a network fitted on at most *rows* labelled ones."""
    vectors = word_vectors(docs)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), batch.column(2), pa.array([pool(t, vectors).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "y", "x"])

    found = map_batches(training_rows(docs, labels, "quality", rows), run, "doc_id bigint, y int, x binary").orderBy("doc_id").collect()
    if not found:
        return vectors, None
    x = np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in found]).astype(float)
    y = np.array([r["y"] for r in found], dtype=float)
    check = np.array([zlib.crc32(b"check%d" % r["doc_id"]) % 5 == 0 for r in found])
    if check.all() or not check.any():
        return vectors, Network(x, y, x, y)
    return vectors, Network(x[~check], y[~check], x[check], y[check])


def _scores(model: tuple[np.ndarray, Network | None], texts: list[str | None]) -> np.ndarray:
    vectors, network = model
    if network is None or not texts:
        return np.ones(len(texts))
    return network.score(np.stack([pool(t, vectors) for t in texts]))


def score(docs: DataFrame, model: tuple[np.ndarray, Network | None], threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of *docs*: doc_id, held_out, score, predicted."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), pa.array(_scores(model, batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    out = map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """*docs* without the rows scored below the threshold, all columns kept."""
    model = train(docs, labels)
    return keep_rows(docs, lambda texts: list(_scores(model, texts) >= threshold))
