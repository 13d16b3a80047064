"""The residual packer on keyed state: what a pack still lacks is appended to a list in the state store, never written anew.

Per key the store holds the pieces of the open pack (a list: reading it is needed only when the pack is full) and three numbers
(tokens in the open pack, packs so far, samples in it).  A batch that does not fill the pack appends its pieces and reads none.  The open
pack is closed by a row that says so, or by a timer when its key has been idle for long enough.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from turnmill.streaming.stream import PACK

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# Tokens of packs that are sent on together.
SENT = 1 << 20


def in_order(frames: Iterator[pd.DataFrame], order: Sequence[str], flush: str | None) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """``(ids, labels, end)`` of all rows, sorted; what is held of a row are its flat tokens, eight bytes each, and its order."""
    tokens: list[tuple[np.ndarray, np.ndarray]] = []
    places = []
    for frame in frames:
        if not len(frame):
            continue
        lens = np.array([len(ids) for ids in frame["input_ids"]], np.int64)
        place = frame[list(order)].copy()
        place["_stop"] = np.cumsum(lens)
        place["_start"], place["_frame"] = place["_stop"] - lens, len(tokens)
        place["_end"] = frame[flush].to_numpy(bool) if flush else False
        places.append(place)
        tokens.append(tuple(np.concatenate([np.asarray(v, np.int32) for v in frame[c]]) for c in ("input_ids", "labels")))
    if places:
        ranked = pd.concat(places).sort_values(list(order), kind="stable")
        for k, start, stop, end in zip(*(ranked[c].to_numpy() for c in ("_frame", "_start", "_stop", "_end")), strict=True):
            ids, labels = tokens[k]
            yield ids[start:stop], labels[start:stop], bool(end)


def as_they_come(frames: Iterator[pd.DataFrame], flush: str | None) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    for frame in frames:
        ends = frame[flush] if flush else [False] * len(frame)
        yield from zip(frame["input_ids"], frame["labels"], ends, strict=True)


class PackProcessor(StatefulProcessor):
    """Cuts a key's tokens every ``limit`` tokens; ``order`` are the columns by which a batch's rows of a key are sorted."""

    def __init__(self, limit: int, keys: Sequence[str], flush: str | None, order: Sequence[str], idle_ms: int | None) -> None:
        self.limit, self.keys, self.flush, self.order, self.idle_ms = limit, list(keys), flush, list(order), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", "ids array<int>, labels array<int>")
        self.open = handle.getValueState("open", "filled int, packs bigint")

    def _row(self, key: tuple, pack: int, pieces: list[tuple[np.ndarray, np.ndarray]]) -> dict:
        lens = [len(i) for i, _ in pieces]
        return {**dict(zip(self.keys, key, strict=True)), "pack": pack, "input_ids": np.concatenate([i for i, _ in pieces]),
                "labels": np.concatenate([x for _, x in pieces]), "cumulative_len": np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)}

    def _stored(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(np.asarray(i, np.int32), np.asarray(x, np.int32)) for i, x in self.pieces.get()]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        filled, packs = (int(v) for v in self.open.get()) if self.open.exists() else (0, 0)
        fresh: list[tuple[np.ndarray, np.ndarray]] = []  # of this batch, in the open pack
        stored = filled > 0  # whether pieces of the open pack lie in the store
        done: list[dict] = []

        def close() -> None:
            nonlocal filled, packs, fresh, stored
            whole = (self._stored() if stored else []) + fresh
            if stored:
                self.pieces.clear()
            done.append(self._row(key, packs, whole))
            filled, packs, fresh, stored = 0, packs + 1, [], False

        for ids, labels, end in in_order(rows, self.order, self.flush) if self.order else as_they_come(rows, self.flush):
            at = 0
            while at < len(ids):
                take = min(self.limit - filled, len(ids) - at)
                fresh.append((np.asarray(ids[at:at + take], np.int32), np.asarray(labels[at:at + take], np.int32)))
                at, filled = at + take, filled + take
                if filled == self.limit:
                    close()
                if len(done) * self.limit >= SENT:
                    yield pd.DataFrame(done)
                    done = []
            if end and filled:
                close()
        if done:
            yield pd.DataFrame(done)
        for ids, labels in fresh:
            self.pieces.appendValue((ids.tolist(), labels.tolist()))
        self.open.update((filled, packs))
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if filled:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        filled, packs = (int(v) for v in self.open.get()) if self.open.exists() else (0, 0)
        if filled:
            row = self._row(key, packs, self._stored())
            self.pieces.clear()
            self.open.update((0, packs + 1))
            yield pd.DataFrame([row])

    def close(self) -> None:
        pass


def pack_state(samples: DataFrame, limit: int, *, keys: Sequence[str] = ("source",), order: Sequence[str] = (), flush: str | None = None,
               idle_ms: int | None = None) -> DataFrame:
    """``(*keys, pack, input_ids, labels, cumulative_len)`` of a stream of samples (keys, input_ids, labels), in packs of ``limit`` tokens.

    With ``order`` a key's rows of one batch are sorted before they are cut, so that the packs are those of one pass in that
    order if batches follow it; the tokens of a batch's rows of one key are then held together, so bound the batch.  ``idle_ms`` closes the
    open pack of a key that got no row for so long, at the next batch; such a query has always something to wait for, so run it
    at intervals or once, not until all is done.  Give a hot source several keys, as ``shard``.
    """
    samples.sparkSession.conf.set(STORE, ROCKS)
    types = dict(samples.dtypes)
    out = ", ".join(f"{k} {types[k]}" for k in keys) + f", {PACK}"
    rows = samples.select(*dict.fromkeys([*keys, "input_ids", "labels", *order, *([flush] if flush else [])]))
    return rows.groupBy(*[F.col(k) for k in keys]).transformWithStateInPandas(
        PackProcessor(limit, keys, flush, order, idle_ms), out, "Append", "None" if idle_ms is None else "ProcessingTime")
