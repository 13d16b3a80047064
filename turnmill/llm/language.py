"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

A text is read as UTF-8 in windows of ``WINDOW`` bytes.  One gated recurrent layer runs forward and one backward over a
window; a softmax over both states labels every position, and a document's probability of a language is the mean over all
of its positions.  All bytes of all windows count; the last window is padded and its padding is masked.

Training takes a bounded sample of labelled rows (``SAMPLE_DOCS``, shared out evenly among the languages, of each the smallest
hashes of the id, with texts of at most ``SAMPLE_BYTES``): whole texts of the sample are read by the driver, at most
``SAMPLE_DOCS * SAMPLE_BYTES`` bytes.  Up to ``SAMPLE_DOCS / LEAST_DOCS`` languages are learned, the most frequent ones, however
rare each is.  Scoring runs in Spark over all rows.

``accepted`` asks a network that has learned noise as one label more whether a text is language at all (see ``Gate``).

Null texts and texts without a letter get ``und`` and score 0, and so does every text if no row has a label.  Equal texts get
equal predictions.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnmill.llm.common import held_out, learns, read_only_columns, slices

WINDOW = 48
HIDDEN = 8
STEPS = 500
BATCH = 256
RATE = 0.02
SAMPLE_DOCS = 1500
LEAST_DOCS = 20
SAMPLE_BYTES = 1 << 16
# The label of made-up noise; no value of ``lang``.  One sampled text in so many is kept from training, to set the limits by.
NOISE = "\x00"
ASIDE = 4
NOISE_CHARS = 2000
LENGTHS = tuple(1 << k for k in range(3, 11))
# Windows scored together; bounds the memory of a task.
BLOCK = 2048
UNKNOWN = "und"


@dataclass
class Model:
    """Weights: ``inputs`` (direction, byte, 3 gates), ``loops`` (direction, hidden, 3 gates), ``out`` and ``bias``."""

    languages: list[str]
    inputs: np.ndarray
    loops: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def _squash(x: np.ndarray, room: np.ndarray) -> None:
    """Softsign in place, x / (1 + |x|): the network's squashing function; the gates use half of it, moved to 0 .. 1."""
    np.abs(x, out=room)
    room += 1
    x /= room


def _run(inputs: np.ndarray, loops: np.ndarray, steps: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of one direction: ``steps`` is (time, batch) bytes, the result (time, batch, hidden).

    Update gate z, reset gate r, candidate c: h' = h + z (c - h), with c from the input and r h.  All steps work in the
    same few arrays; ``keep`` receives what backpropagation needs.
    """
    n, h_size = steps.shape[1], loops.shape[0]
    # z and r are held as 1 + softsign, twice their value; the halves are folded into what follows.
    gate_in, cand_in = np.ascontiguousarray(inputs[:, :2 * h_size]), np.ascontiguousarray(inputs[:, 2 * h_size:])
    gates, cand = np.ascontiguousarray(loops[:, :2 * h_size]), loops[:, 2 * h_size:] * np.float32(0.5)
    h, c, room = (np.zeros((n, h_size), np.float32) for _ in range(3))
    zr, wide, cand_x = np.zeros((n, 2 * h_size), np.float32), np.zeros((n, 2 * h_size), np.float32), np.zeros((n, h_size), np.float32)
    states = np.empty((*steps.shape, h_size), np.float32)
    for t, symbols in enumerate(steps):
        at = symbols.astype(np.intp)
        np.matmul(h, gates, out=zr)
        zr += np.take(gate_in, at, axis=0, out=wide, mode="clip")
        _squash(zr, wide)
        zr += 1
        np.multiply(zr[:, h_size:], h, out=room)
        np.matmul(room, cand, out=c)
        c += np.take(cand_in, at, axis=0, out=cand_x, mode="clip")
        _squash(c, room)
        if keep is not None:
            keep.append((h.copy(), 0.5 * zr[:, :h_size], 0.5 * zr[:, h_size:], c.copy()))
        c -= h
        c *= zr[:, :h_size]
        c *= 0.5
        h += c
        states[t] = h
    return states


def _back(loops: np.ndarray, steps: np.ndarray, kept: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backpropagation through time of one direction: gradients of ``inputs`` and ``loops``."""
    h_size = loops.shape[0]
    gates, cand = loops[:, :2 * h_size], loops[:, 2 * h_size:]
    d_loops, d_h = np.zeros_like(loops), np.zeros_like(d_states[0])
    d_x = np.empty((*steps.shape, 3 * h_size), np.float32)
    for t in range(len(steps) - 1, -1, -1):
        h, z, r, c = kept[t]
        d = d_states[t] + d_h
        d_c = d * z * (1 - np.abs(c)) ** 2
        d_rh = d_c @ cand.T
        d_x[t, :, :h_size] = d * (c - h) * (0.5 * (1 - np.abs(2 * z - 1)) ** 2)
        d_x[t, :, h_size:2 * h_size] = d_rh * h * (0.5 * (1 - np.abs(2 * r - 1)) ** 2)
        d_x[t, :, 2 * h_size:] = d_c
        d_loops[:, :2 * h_size] += h.T @ d_x[t, :, :2 * h_size]
        d_loops[:, 2 * h_size:] += (r * h).T @ d_c
        d_h = d * (1 - z) + d_rh * r + d_x[t, :, :2 * h_size] @ gates.T
    flat, columns = steps.reshape(-1), d_x.reshape(-1, 3 * h_size).T
    return np.stack([np.bincount(flat, col, 256) for col in columns], axis=1).astype(np.float32), d_loops


def windows(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``(windows, lengths)`` of a text: rows of ``WINDOW`` bytes, the last padded with zeros."""
    n = -(-len(data) // WINDOW)
    rows = np.zeros(n * WINDOW, np.uint8)
    rows[:len(data)] = np.frombuffer(data, np.uint8)
    lengths = np.full(n, WINDOW, np.int64)
    if n:
        lengths[-1] = len(data) - (n - 1) * WINDOW
    return rows.reshape(n, WINDOW), lengths


def train(texts: list[str], labels: list[str], steps: int = STEPS, seed: int = 5) -> Model | None:
    """Fit the network; every position of a window is labelled with its document's language.  None without labels."""
    languages = sorted(set(labels))
    if not languages:
        return None
    at = {name: k for k, name in enumerate(languages)}
    pieces = [windows(t.encode("utf-8", "replace")) for t in texts]
    pieces = [(r, n, at[y]) for (r, n), y in zip(pieces, labels, strict=True) if len(r)]
    if not pieces:
        return None
    rows, lengths = np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces])
    owner = np.concatenate([np.full(len(p[0]), p[2]) for p in pieces])
    rng = np.random.default_rng(seed)
    k, h = len(languages), HIDDEN
    model = Model(languages, rng.normal(0, 0.3, (2, 256, 3 * h)).astype(np.float32), rng.normal(0, h ** -0.5, (2, h, 3 * h)).astype(np.float32),
                  rng.normal(0, 0.3, (2 * h, k)).astype(np.float32), np.zeros(k, np.float32))
    weights = [model.inputs, model.loops, model.out, model.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    # Languages are drawn alike, so that a rare one is learned as well; draws depend on the seed alone.
    members = [np.flatnonzero(owner == c) for c in range(k)]
    for step in range(1, steps + 1):
        drawn = rng.integers(0, k, BATCH)
        pick = np.array([members[c][rng.integers(len(members[c]))] for c in drawn])
        # A quarter of the windows are cut short at random: most texts end within a window, and short texts have but one.
        ends = np.where(rng.random(BATCH) < 0.25, rng.integers(3, WINDOW + 1, BATCH), WINDOW).clip(None, lengths[pick])
        inside = np.arange(WINDOW)[:, None] < ends
        ahead, y = np.where(inside, rows[pick].T, 0), owner[pick]
        kept: tuple[list, list] = ([], [])
        states = np.concatenate((_run(model.inputs[0], model.loops[0], ahead, kept[0]),
                                 _run(model.inputs[1], model.loops[1], ahead[::-1], kept[1])[::-1]), axis=2)
        p = _softmax(states @ model.out + model.bias)
        p[:, np.arange(BATCH), y] -= 1
        p *= (inside / (ends * BATCH))[:, :, None].astype(np.float32)
        flat = p.reshape(-1, k)
        d_states = p @ model.out.T
        ahead_back = _back(model.loops[0], ahead, kept[0], d_states[:, :, :h])
        back_back = _back(model.loops[1], ahead[::-1], kept[1], d_states[::-1, :, h:])
        grads = [np.stack(pair) for pair in zip(ahead_back, back_back, strict=True)] + [states.reshape(-1, 2 * h).T @ flat, flat.sum(axis=0)]
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return model


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def position_labels(model: Model, rows: np.ndarray) -> np.ndarray:
    """Probabilities of every position: (window, byte, language)."""
    ahead = np.ascontiguousarray(rows.T)
    states = np.concatenate((_run(model.inputs[0], model.loops[0], ahead), _run(model.inputs[1], model.loops[1], ahead[::-1])[::-1]), axis=2)
    return _softmax(states @ model.out + model.bias).transpose(1, 0, 2)


def _pooled(model: Model, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums over the positions of each window, (window, language), without an array of all positions' states."""
    ahead, h = np.ascontiguousarray(rows.T), HIDDEN
    # The languages stand before the windows, so that the softmax works on long rows: (time, language, window).
    e = np.matmul(model.out[:h].T, _run(model.inputs[0], model.loops[0], ahead).transpose(0, 2, 1))
    e += np.matmul(model.out[h:].T, _run(model.inputs[1], model.loops[1], ahead[::-1])[::-1].transpose(0, 2, 1))
    e += model.bias[:, None]
    np.exp(np.minimum(e, 60, out=e), out=e)
    e /= e.sum(axis=1, keepdims=True)
    short = np.flatnonzero(lengths < WINDOW)
    for w in short:
        e[lengths[w]:, :, w] = 0
    return e.sum(axis=0).T


def probabilities(model: Model, texts: list[bytes]) -> np.ndarray:
    """Mean over all positions of each text, (text, language); texts must not be empty."""
    sums = np.zeros((len(texts), len(model.languages)))
    held, lens, owners, count = [], [], [], 0

    def flush() -> None:
        nonlocal held, lens, owners, count
        if held:
            rows, lengths, owner = np.concatenate(held), np.concatenate(lens), np.concatenate(owners)
            np.add.at(sums, owner, _pooled(model, rows, lengths))
        held, lens, owners, count = [], [], [], 0

    for k, data in enumerate(texts):
        for at in range(0, len(data), BLOCK * WINDOW):
            rows, lengths = windows(data[at:at + BLOCK * WINDOW])
            held.append(rows)
            lens.append(lengths)
            owners.append(np.full(len(rows), k))
            count += len(rows)
            if count >= BLOCK:
                flush()
    flush()
    return sums / np.array([len(t) for t in texts])[:, None]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    at = [k for k, t in enumerate(texts) if model and t and has_letter(t)]
    if at:
        p = probabilities(model, [texts[k].encode("utf-8", "replace") for k in at])
        for k, best, top in zip(at, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
            names[k], scores[k] = model.languages[best], min(1.0, top)
    return names, scores


def sampled(documents: DataFrame, docs: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """At most ``docs`` pairs (text, language) outside the held-out part, about as many of every language.

    Rows whose text is longer than ``SAMPLE_BYTES`` are not in the sample; they are scored like all others.
    """
    known = read_only_columns(documents, "doc_id", "text", "lang").where(
        learns() & F.col("lang").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES))
    # One row per language; the bound on the hash lets every task leave out most rows by itself.
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max(docs // LEAST_DOCS, 1)).collect()
    if not counts:
        return []
    share = max(docs // len(counts), 1)
    bounds = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(2 * share * (1 << 32) // r["n"] + 1, 1 << 32) if r["n"] > 2 * share else 1 << 32)])
    hashed = known.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))).where(F.col("h") < F.try_element_at(bounds, F.col("lang")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text")))
    rows = hashed.withColumn("place", place).where(F.col("place") <= share).select("lang", "text", "h").collect()
    rows.sort(key=lambda r: (r["h"], r["lang"], r["text"]))
    return [(r["text"], r["lang"]) for r in rows if has_letter(r["text"])]


def fit(documents: DataFrame, docs: int = SAMPLE_DOCS) -> Model | None:
    """Train on the sample of ``sampled``."""
    pairs = sampled(documents, docs)
    return train([t for t, _ in pairs], [y for _, y in pairs])


def noise_like(text: str, rng: np.random.Generator) -> str:
    """Noise as long as a text: its own characters in another order, hexadecimal digits, or any printable characters."""
    text = text[:NOISE_CHARS]
    kind, n = int(rng.integers(3)), len(text)
    if kind == 0:
        return "".join(text[k] for k in rng.permutation(n))
    pool = np.array(list("0123456789abcdef") if kind == 1 else [chr(c) for c in range(33, 127)])
    return "".join(rng.choice(pool, n))


@dataclass
class Gate:
    """A network with noise as a label, and the share of noise above which a text of a given length is rejected.

    The evidence is the noise probability pooled over all positions.  Its limit is set by length, on texts kept from training and
    excerpts of them: half way between what 99 in 100 of those reach and certainty, so that short clean texts pass.
    """

    model: Model
    limits: list[float]

    def noise(self, texts: list[bytes]) -> np.ndarray:
        return probabilities(self.model, texts)[:, self.model.languages.index(NOISE)]

    def passes(self, texts: list[str | None]) -> list[bool]:
        stays = [bool(t) and has_letter(t) for t in texts]
        at = [k for k, ok in enumerate(stays) if ok]
        data = [texts[k].encode("utf-8", "replace") for k in at]
        for k, d, share in zip(at, data, self.noise(data) if at else (), strict=True):
            stays[k] = bool(share <= self.limits[np.searchsorted(LENGTHS, len(d), side="right")])
        return stays


def fit_gate(documents: DataFrame, docs: int = SAMPLE_DOCS) -> Gate | None:
    pairs = sampled(documents, docs)
    rng = np.random.default_rng(5)
    aside, taught = [t for t, _ in pairs[::ASIDE]], [p for k, p in enumerate(pairs) if k % ASIDE]
    noise = [noise_like(t, rng) for t, _ in taught]
    model = train([t for t, _ in taught] + noise, [y for _, y in taught] + [NOISE] * len(noise)) if taught else None
    if model is None:
        return None
    gate, limits = Gate(model, [1.0] * (len(LENGTHS) + 1)), []
    for k in range(len(LENGTHS) + 1):
        least, most = (LENGTHS[k - 1] if k else 1), (LENGTHS[k] if k < len(LENGTHS) else NOISE_CHARS * 4)
        cuts = []
        for text in aside:
            words, start = text.split(), int(rng.integers(1 << 30))
            piece = " ".join(words[start % max(len(words), 1):] + words)[:int(rng.integers(least, most))]
            if has_letter(piece):
                cuts.append(piece.encode("utf-8", "replace"))
        limits.append(max(0.5, (1 + float(np.quantile(gate.noise(cuts), 0.99))) / 2) if len(cuts) >= LEAST_DOCS else 1.0)
    return Gate(model, limits)


def identify(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row; trains on the table's own labels if no model is given."""
    model = model or fit(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, scores = predict(model, batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(names), pa.array(scores, pa.float64())],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    rows = read_only_columns(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(documents: DataFrame) -> DataFrame:
    """The documents with all their columns, but for those that hold no letter and those that the network takes for noise.

    If no model can be fitted, all texts with a letter stay.  The verdict is taken on the row itself, in the pass that scores
    it, so there is no join.
    """
    gate = fit_gate(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            stays = gate.passes(texts) if gate else [bool(t) and has_letter(t) for t in texts]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
