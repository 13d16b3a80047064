"""Streaming forms: line streams, the stateless encoding chain, the residual packer."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnmill.functions.tokens import HashEncoder
from turnmill.operators.encode import drop_empty, drop_unsupervised, encode_conversation
from turnmill.operators.formats import normalise
from turnmill.operators.render import render_conversation


def replay(df: DataFrame, epochs: int) -> DataFrame:
    """Each row once per epoch; adds ``epoch``."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))))


def line_stream(spark: SparkSession, path: str, schema: str, *, max_files: int | None = None) -> DataFrame:
    """JSON lines of a folder as a stream; new files are picked up as they appear."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def encode_stream(records: DataFrame, fmt: str, template: str, encoder=HashEncoder(), *,
                  max_length: int) -> DataFrame:
    """Normalise, render, encode and filter whole-conversation records; works on streams and batches alike."""
    turns = render_conversation(drop_empty(normalise(records, fmt)), template)
    return drop_unsupervised(encode_conversation(turns, encoder, max_length=max_length))


STATE = "ids array<int>, labels array<int>, lens array<int>, packs bigint"
PACK = "pack bigint, input_ids array<int>, labels array<int>, cumulative_len array<int>"


def _packer(limit: int, keys: list[str], flush: str):
    """Cut a source's token stream every ``limit`` tokens; the state is the residual, below ``limit`` tokens."""

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, labels, lens, packs = [], [], [], 0  # ids and labels: pieces of the pack that is being filled
        if state.exists:
            *kept, packs = state.get
            ids, labels = ([np.asarray(v, dtype=np.int32)] if len(v) else [] for v in kept[:2])
            lens, packs = [int(n) for n in kept[2]], int(packs)
        filled = sum(lens)
        for batch in batches:
            done = []

            def close() -> None:
                nonlocal ids, labels, lens, packs, filled
                done.append((packs, np.concatenate(ids), np.concatenate(labels), lens))
                ids, labels, lens, packs, filled = [], [], [], packs + 1, 0

            for row_ids, row_labels, last in zip(batch["input_ids"], batch["labels"], batch[flush]):
                at, size = 0, len(row_ids)
                while at < size:
                    take = min(limit - filled, size - at)
                    ids.append(np.asarray(row_ids[at:at + take], dtype=np.int32))
                    labels.append(np.asarray(row_labels[at:at + take], dtype=np.int32))
                    lens.append(take)
                    at, filled = at + take, filled + take
                    if filled == limit:
                        close()
                if last and filled:
                    close()
            if done:
                names = {name: [value] * len(done) for name, value in zip(keys, group, strict=True)}
                yield pd.DataFrame({
                    **names, "pack": [p for p, *_ in done],
                    "input_ids": [i for _, i, _, _ in done], "labels": [x for _, _, x, _ in done],
                    "cumulative_len": [[0, *accumulate(n)] for *_, n in done]})
        state.update(([int(x) for piece in ids for x in piece], [int(x) for piece in labels for x in piece], lens, packs))

    return run


def pack_stream(samples: DataFrame, limit: int, *, key: str = "source", flush: str = "flush", shards: int = 1) -> DataFrame:
    """Stateful residual packer, keyed by source: emits full packs; a row with ``flush`` also empties the rest.

    With ``shards`` above 1 a source is cut in so many shards by a hash of the sample's ids, each with its own
    residual and packs (column ``shard``), so that a hot source is not one task.  A row with ``flush`` empties its shard.
    """
    keys = [key, "shard"] if shards > 1 else [key]
    rows = samples.select(key, "input_ids", "labels", flush)
    if shards > 1:
        rows = rows.withColumn("shard", F.pmod(F.xxhash64("input_ids"), F.lit(shards)).cast("int"))
    types = dict(rows.dtypes)
    out = ", ".join(f"{k} {types[k]}" for k in keys) + f", {PACK}"
    return rows.groupBy(*keys).applyInPandasWithState(_packer(limit, keys, flush), out, STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there now, to Parquet, and stop."""
    df.writeStream.format("parquet").outputMode(mode).option("path", out).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
