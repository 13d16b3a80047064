"""The packer on keyed state against one pass."""

import random
import time

import numpy as np
import pandas as pd
from conftest import rows
from pyspark.sql import functions as F

from turnmill.session import fresh_path
from turnmill.streaming import epochs, packing
from turnmill.streaming.stream import PACK, run_available

SCHEMA = "source string, at long, input_ids array<int>, labels array<int>, flush boolean"


def one_pass(samples, limit):
    packs, ids, lens, n = [], [], [0], 0
    for row_ids, end in samples:
        at = 0
        while at < len(row_ids):
            take = min(limit - len(ids), len(row_ids) - at)
            ids, at = ids + row_ids[at:at + take], at + take
            lens.append(len(ids))
            if len(ids) == limit:
                packs.append((n, ids, lens))
                ids, lens, n = [], [0], n + 1
        if end and ids:
            packs.append((n, ids, lens))
            ids, lens, n = [], [0], n + 1
    return packs


def test_packs_equal_one_pass_over_restarts(spark):
    rng = random.Random(2)
    src, out, ck = (fresh_path(spark, n) for n in ("s-in", "s-out", "s-ck"))
    every = {s: [] for s in ("a", "b", None)}
    at = 0
    for _ in range(4):
        batch = []
        for _ in range(60):
            s = rng.choice(["a", "a", "b", None])
            ids = [rng.randrange(1000) for _ in range(rng.choice([0, 1, 3, 20, 45]))]
            end = rng.random() < 0.05
            every[s].append((ids, end))
            batch.append((s, at, ids, [-i for i in ids], end))
            at += 1
        rng.shuffle(batch)
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        run_available(packing.pack_state(stream, 16, order=["at"], flush="flush"), out, ck)
    got = spark.read.schema(f"source string, {PACK}").parquet(out)
    want = [(s, n, ids, lens) for s, found in every.items() for n, ids, lens in one_pass(found, 16)]
    assert rows(got, "source", "pack", "input_ids", "cumulative_len") == sorted(want, key=repr)
    assert got.where(F.expr("exists(zip_with(input_ids, labels, (i, x) -> i + x), s -> s <> 0)")).count() == 0


def test_idle_keys_are_closed_by_their_timer(spark):
    src, out, ck = (fresh_path(spark, n) for n in ("t-in", "t-out", "t-ck"))

    def feed(key, ids):
        spark.createDataFrame([(key, 0, ids, ids, False)], SCHEMA).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = packing.pack_state(spark.readStream.schema(SCHEMA).parquet(src), 4, idle_ms=50)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(once=True).start()
        assert query.awaitTermination(60)
        return rows(spark.read.schema(f"source string, {PACK}").parquet(out), "source", "pack", "input_ids")
    feed("a", [1, 2, 3, 4, 5])
    assert run() == [("a", 0, [1, 2, 3, 4])]
    time.sleep(0.2)
    feed("b", [9])
    assert run() == [("a", 0, [1, 2, 3, 4]), ("a", 1, [5])]


def test_a_large_batch_is_sorted_as_flat_tokens_and_sent_in_parts(monkeypatch):
    rng = random.Random(4)
    samples = [(at, [rng.randrange(1000) for _ in range(rng.choice([0, 1, 3, 20, 45]))], rng.random() < 0.05) for at in range(200)]
    mixed = rng.sample(samples, len(samples))
    frames = [pd.DataFrame({"at": [a for a, _, _ in part], "input_ids": [np.array(i, np.int32) for _, i, _ in part],
                            "labels": [-np.array(i, np.int32) for _, i, _ in part], "flush": [e for _, _, e in part]})
              for part in (mixed[:90], mixed[90:90], mixed[90:])]
    flat = list(packing.in_order(iter(frames), ["at"], "flush"))
    assert [(list(i), [-x for x in labels], e) for i, labels, e in flat] == [(i, i, e) for _, i, e in samples]

    class Handle:
        getListState = getValueState = lambda self, *_: self
        exists = lambda self: False
        appendValue = update = lambda self, _: None

    monkeypatch.setattr(packing, "SENT", 64)
    processor = packing.PackProcessor(16, ["source"], "flush", ["at"], None)
    processor.init(Handle())
    sent = list(processor.handleInputRows(("a",), iter(frames), None))
    assert 4 <= max(map(len, sent)) <= 5
    got = [(int(r.pack), list(r.input_ids), list(r.cumulative_len)) for f in sent for r in f.itertuples()]
    assert got == one_pass([(i, e) for _, i, e in samples], 16)


def test_readers_hold_few_bytes(tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_text("".join("x" * n + "\n" for n in (5, 100, 1, 1, 1, 300)))
    monkeypatch.setattr(epochs, "HELD_BYTES", 90)
    reader = epochs.EpochReader({"path": str(tmp_path), "checkpoint": str(tmp_path / "ck")})
    sent = [[len(v) for v in b["value"].to_pylist()] for b in reader.read(epochs.Piece(str(tmp_path / "a.txt"), 0, 0, 10_000))]
    assert sent == [[5, 100], [1, 1, 1, 300]]
