"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated output.

1. Every token of a text has two slots: one for its letters, one for its shape (case, digits, the signs around it).  Slots
   are hashes into fixed tables, so the vectors of any vocabulary are ``SLOTS`` rows.
2. Random indexing: every slot has a fixed sparse index vector with a few +1 and -1; a slot's word vector is the sum of
   the index vectors of its neighbours over ALL texts.  Tasks sum their own texts, Spark sums the tasks.
3. A document is pooled: mean of its letter vectors, mean of its shape vectors, spread of its letter vectors.
4. A network of two layers is trained in numpy on a bounded sample of labelled rows (``SAMPLE_DOCS``, those with the
   smallest hash of the id); a temperature fitted on rows kept aside from the training makes its output a probability.

A null or empty text is pooled to zeros and scored like any other.  Without labels every score is 0.5.  Of contradictory
labels of one id all are learned.  Repeated rows count and are scored each.  An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import about, held_out, learns, read_only_columns, slices, stage, worker_state

LETTER_SLOTS = 1 << 14
SHAPE_SLOTS = 1 << 10
SLOTS = LETTER_SLOTS + SHAPE_SLOTS
DIM = 24
NONZERO = 2
REACH = 2
SAMPLE_DOCS = 6000
HIDDEN = 32
EPOCHS = 40
LIMIT = 0.7
# Tokens remembered by a worker; beyond that it starts anew, which changes no result.
CACHE = 300_000
# Tokens worked on together; bounds the memory of a task.
BLOCK = 1 << 18


# ---- tokens and slots ----------------------------------------------------------------------------------------------

def slots_of(token: bytes) -> int:
    """The letter slot and, above it, the shape slot of a token."""
    text = token.decode("utf-8", "replace")
    core = "".join(filter(str.isalnum, text))
    case = "N" if not core else "D" if core.isdigit() else "U" if core.isupper() and len(core) > 1 else "T" if core[0].isupper() else "L"
    signs = "".join(c if not c.isalnum() else "" for c in text)[:4]
    letter = zlib.crc32(core.lower().encode()) % LETTER_SLOTS
    return letter | (LETTER_SLOTS + zlib.crc32((case + signs).encode()) % SHAPE_SLOTS) << 20


class Slots(dict):
    def __missing__(self, token: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        found = self[token] = slots_of(token)
        return found


def codes(text: str | None) -> np.ndarray:
    """Letter and shape slots of a text's tokens, (token, 2)."""
    known = worker_state().setdefault("quality_slots", Slots())
    words = text.encode("utf-8", "replace").split() if text else []
    packed = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    return np.column_stack((packed & ((1 << 20) - 1), packed >> 20))


def index_vectors(seed: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of every slot's index vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIM, (SLOTS + 1, NONZERO)), rng.choice([-1.0, 1.0], (SLOTS + 1, NONZERO))


def add_contexts(total: np.ndarray, texts: list[np.ndarray], places: np.ndarray, signs: np.ndarray) -> None:
    """Add the index vectors of the neighbours of every slot; neighbours lie within ``REACH`` tokens of the same text."""
    gap = np.full((REACH, 2), SLOTS, np.int64)  # an empty slot, so that texts do not touch
    seq = np.concatenate([part for t in texts for part in (t, gap)])
    for step in range(1, REACH + 1):
        for mine, other in ((seq[:-step], seq[step:]), (seq[step:], seq[:-step])):
            for a in (0, 1):
                near = other[:, a]
                real = near < SLOTS
                # Letters learn from letters around them, shapes from shapes: the two tables never mix.
                at, near = mine[real, a], near[real]
                inside = at < SLOTS
                at, near = at[inside], near[inside]
                cells = (at[:, None] * DIM + places[near]).reshape(-1)
                total += np.bincount(cells, signs[near].reshape(-1), total.size)


def word_vectors(documents: DataFrame) -> np.ndarray:
    """(``SLOTS``, ``DIM``) unit vectors from all texts.  The driver gets that fixed number of values."""
    names = [f"v{i}" for i in range(DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros(SLOTS * DIM)
        held, count = [], 0
        for batch in slices(batches):
            for text in batch["text"].to_pylist():
                part = codes(text)
                for at in range(0, len(part), BLOCK):
                    held.append(part[at:at + BLOCK])
                    count += len(held[-1])
                    if count >= BLOCK:
                        add_contexts(total, held, places, signs)
                        held, count = [], 0
        if held:
            add_contexts(total, held, places, signs)
        table = total.reshape(SLOTS, DIM).astype(np.int64)
        used = np.flatnonzero(table.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(np.ascontiguousarray(c)) for c in table[used].T)], ["slot", *names])

    parts = read_only_columns(documents, "text").mapInArrow(run, "slot long, " + ", ".join(f"{n} long" for n in names))
    sums = parts.groupBy("slot").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    vectors = np.zeros((SLOTS, DIM), np.float32)
    vectors[sums["slot"].to_numpy(np.int64)] = sums[names].to_numpy(np.float32)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """(text, 3 ``DIM``): mean letter vector, mean shape vector, spread of the letter vectors."""
    out = np.zeros((len(texts), 3 * DIM), np.float32)
    for k, text in enumerate(texts):
        both = codes(text)
        if not len(both):
            continue
        # Sums over blocks, so that a long text never becomes a long array of vectors.
        for at in range(0, len(both), BLOCK):
            letters, shapes = vectors[both[at:at + BLOCK, 0]], vectors[both[at:at + BLOCK, 1]]
            out[k] += np.concatenate((letters.sum(axis=0), shapes.sum(axis=0), np.einsum("ij,ij->j", letters, letters)))
        out[k] /= len(both)
        out[k, 2 * DIM:] = np.sqrt(np.maximum(out[k, 2 * DIM:] - out[k, :DIM] ** 2, 0))
    return out


# ---- the network ---------------------------------------------------------------------------------------------------

@dataclass
class Model:
    vectors: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_logits((features - self.center) / self.scale, self.layers) / self.temperature, -60, 60)))


def _logits(x: np.ndarray, layers: list[np.ndarray]) -> np.ndarray:
    w1, b1, w2, b2 = layers
    return (np.maximum(x @ w1 + b1, 0) @ w2 + b2)[:, 0]


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def train(features: np.ndarray, labels: np.ndarray, vectors: np.ndarray, seed: int = 6) -> Model | None:
    """Two layers by Adam on three quarters of the rows; the temperature of least loss on the others."""
    if not len(labels) or labels.min() == labels.max():
        return None
    center, scale = features.mean(axis=0), features.std(axis=0) + 1e-3
    x, y = (features - center) / scale, labels.astype(np.float32)
    rng = np.random.default_rng(seed)
    aside = np.arange(len(y)) % 4 == 3
    fit_x, fit_y = (x[~aside], y[~aside]) if aside.any() else (x, y)
    layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32),
              rng.normal(0, HIDDEN ** -0.5, (HIDDEN, 1)).astype(np.float32), np.zeros(1, np.float32)]
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(fit_y))
        for at in range(0, len(order), 64):
            pick = order[at:at + 64]
            bx, step = fit_x[pick], step + 1
            hidden = np.maximum(bx @ layers[0] + layers[1], 0)
            d = (1 / (1 + np.exp(-np.clip(hidden @ layers[2] + layers[3], -60, 60))) - fit_y[pick, None]) / len(pick)
            d_hidden = (d @ layers[2].T) * (hidden > 0)
            grads = [bx.T @ d_hidden + 1e-4 * layers[0], d_hidden.sum(axis=0), hidden.T @ d + 1e-4 * layers[2], d.sum(axis=0)]
            for w, g, m, v in zip(layers, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.003 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    kept = _logits(x[aside], layers) if aside.any() else _logits(x, layers)
    truth = y[aside] if aside.any() else y
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    return Model(vectors, center, scale, layers, float(min(grid, key=lambda t: _loss(kept / t, truth))))


def fit(documents: DataFrame, labels: DataFrame, docs: int = SAMPLE_DOCS) -> Model | None:
    """Word vectors from all documents; the network from at most ``docs`` labels outside the held-out part."""
    vectors = word_vectors(documents)
    known = read_only_columns(labels, "doc_id", "quality").where(learns() & F.col("quality").isNotNull())
    sample = stage(about(known, "doc_id", docs).select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label"), "h").orderBy(
        "h", "label").limit(docs), "quality-sample")
    texts = read_only_columns(documents, "doc_id", "text").withColumn("tie", F.xxhash64("text"))
    # At most ``docs`` rows.
    chosen = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("id")).select("h", "tie", "label", "text")
    names = [f"f{i}" for i in range(3 * DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = pooled(batch["text"].to_pylist(), vectors)
            yield pa.RecordBatch.from_arrays([batch["h"], batch["tie"], batch["label"], *(pa.array(np.ascontiguousarray(c)) for c in values.T)],
                                             ["h", "tie", "label", *names])

    rows = chosen.mapInArrow(run, "h long, tie long, label int, " + ", ".join(f"{n} float" for n in names)).orderBy("h", "tie", "label").limit(docs).toPandas()
    return train(rows[names].to_numpy(np.float32).reshape(-1, 3 * DIM), rows["label"].to_numpy(), vectors)


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``documents``."""
    model = fit(documents, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = model.scores(pooled(batch["text"].to_pylist(), model.vectors)) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(values.astype(np.float64))], ["doc_id", "held_out", "score"])

    rows = read_only_columns(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))
