"""File operators by exact round trips: archives, token files, shuffled shards."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from conftest import rows

from turnmill.llm import planes, shards, warc
from turnmill.llm.common import NULL_KEY, range_cuts, range_of
from turnmill.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


# ---- cuts ----------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("target", [1, 7, 50, 10_000])
def test_cuts_follow_the_data_alone(spark, target):
    data = [(random.Random(k).randrange(-500, 500), 1 + k % 9) for k in range(400)] + [(None, 5)]
    df = spark.createDataFrame(data, "k long, w long")
    cuts = range_cuts(df, "k", "w", target)
    assert cuts == range_cuts(df.repartition(5), "k", "w", target) == sorted(set(cuts))
    got = df.select("k", range_of(df["k"], cuts).alias("cell")).collect()
    assert all(r["cell"] == (0 if r["k"] is None else sum(c <= (r["k"], 0) for c in cuts)) for r in got)


@pytest.mark.parametrize("target", [3, 40])
def test_a_hot_key_spans_ranges(spark, target):
    data = [(None if k % 3 == 0 else k, k * 7919 % 1009 - 500, 1 + k % 4) for k in range(900)]
    df = spark.createDataFrame(data, "k long, t long, w long")
    cuts = range_cuts(df, "k", "w", target, "t")
    assert cuts == range_cuts(df.repartition(5), "k", "w", target, "t") == sorted(set(cuts))
    got = df.select("k", "t", "w", range_of(df["k"], cuts, df["t"]).alias("cell")).collect()
    assert all(r["cell"] == sum(c <= (NULL_KEY if r["k"] is None else r["k"], r["t"]) for c in cuts) for r in got)
    held = np.bincount([r["cell"] for r in got], [r["w"] for r in got])
    assert held.max() < 2 * target + 4


# ---- archives ------------------------------------------------------------------------------------------------------

def plain_archive(pages):
    first, out = {}, []
    for p, html in sorted(((p, h) for p, _, h in pages), key=lambda x: (x[0] is None, x[0] or 0)):
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        owner = first.setdefault(digest, p) if len(data) >= 100 and p is not None else (first.get(digest) if len(data) >= 100 else p)
        revisit = owner is not None and owner != p
        out.append((p, len(data), digest, "revisit" if revisit else "response", owner if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard_bytes", "roll_bytes"), [(1 << 20, 1 << 20), (3000, 1), (700, 300)])
def test_archives_come_back_whole(spark, shard_bytes, roll_bytes):
    long = "é<p>x</p>" * 40
    pages = [(k, f"http://h/{k} é\r\nX: y", long if k % 3 == 0 else f"page {k}") for k in range(60)]
    pages += [(100, None, None), (101, "", ""), (102, "u", "z" * 99), (103, "u", "z" * 99), (104, "u", "z" * 100), (105, "u", "z" * 100), (None, "u", "null id")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' AS shard", "1 AS kind")
    folder, manifest = warc.write(df, shard_bytes=shard_bytes, roll_bytes=roll_bytes)
    got = rows(warc.read(folder, manifest), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == plain_archive(pages)
    again = warc.write(df.repartition(3), shard_bytes=shard_bytes, roll_bytes=roll_bytes)[1]
    assert rows(again, "name", "sha256", "records") == rows(manifest, "name", "sha256", "records")


def test_repeated_pages_are_revisits_and_an_empty_table_has_no_files(spark):
    df = spark.createDataFrame([(1, "u", "q" * 200)] * 3 + [(2, "u", "q" * 200)], "page_id long, url string, html string")
    got = rows(warc.read(*warc.write(df)), "page_id", "record_type", "refers_to")
    assert got == sorted([(1, "response", None), (1, "revisit", 1), (1, "revisit", 1), (2, "revisit", 1)], key=repr)
    folder, manifest = warc.write(df.limit(0))
    assert manifest.count() == 0 and warc.read(folder, manifest).count() == 0


def test_pages_without_an_id_spread_over_shards(spark):
    pages = [(None if k % 3 == 0 else k, "u", f"page {k % 500} " + "x" * 150) for k in range(600)] + [(7, "u", f"seven {k} " + "y" * 150) for k in range(200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder, manifest = warc.write(df, shard_bytes=16_000)
    held = manifest.groupBy("shard").agg({"records": "sum"}).collect()
    assert max(r[1] for r in held) * (160 + warc.OVERHEAD) < 2 * 16_000
    got = rows(warc.read(folder, manifest), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    owner = {}
    for p, _, html in pages:
        if p is not None:
            owner[html] = min(p, owner.get(html, p))
    copies = [h for _, _, h in pages]
    want = []
    for p, _, html in pages:
        first = owner.get(html) if copies.count(html) > 1 else None
        revisit = first is not None and first != p
        want.append((p, len(html), hashlib.sha256(html.encode()).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=repr)


def test_damaged_archives_are_refused():
    data = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, 0)
    zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = zipped.compress(data) + zipped.flush()
    assert list(warc.members(io.BytesIO(member * 3))) == [data] * 3
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(member[:-4])))
    with pytest.raises(ValueError):
        warc.parse(data[:-6])


# ---- token files ---------------------------------------------------------------------------------------------------

TEXTS = [None, "", " ", "a", "Hello world, it's  two  spaces", "tab\tand\nnew \n line", "trailing ", "don't DON'T l'été 's", "naïve façade ÀÉ",
         "日本語 テキスト", "emoji 👩‍👩‍👧 x", "a" * 5000, "word " * 4000, "1234 5,6.7!! ...", "<|endoftext|> inside", "x y z  w", "ſ İ ŉ word."]


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def test_unit_cache_gives_the_tokenizers_ids(tokenizer):
    encode = planes.Encoder(tokenizer_path())
    rng = random.Random(4)
    made = ["".join(rng.choice("ab é,.'!\n\t 1Z") for _ in range(rng.randint(0, 60))) for _ in range(600)]
    for text in [t for t in TEXTS if t] + made:
        assert np.frombuffer(encode(text), encode.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("dtype", ["<u2", "<u4"])
def test_planes_round_trip(kind, dtype):
    ids = np.random.default_rng(1).integers(0, 50_257, 1000).astype(dtype)
    for n in (0, 1, 7, 8, 9, 1000):
        assert (planes.from_planes(planes.to_planes(ids[:n], kind), n, ids.dtype.itemsize, kind) == ids[:n]).all()


@pytest.mark.parametrize(("kind", "block", "shard_bytes"), [("byte", 1 << 16, 1 << 20), ("bit", 64, 500), ("byte", 5, 64)])
def test_token_files_come_back_whole(spark, tokenizer, kind, block, shard_bytes):
    df = spark.createDataFrame([(i * 3, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").selectExpr("*", "9 AS shard", "1 AS tie")
    want, start = [], 0
    for i, t in enumerate(TEXTS):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i * 3, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    folder, manifest = planes.write(df, tokenizer_path(), planes=kind, block=block, shard_bytes=shard_bytes)
    assert sorted(map(tuple, planes.read(folder, manifest).collect())) == want
    again = planes.write(df.repartition(4), tokenizer_path(), planes=kind, block=block, shard_bytes=shard_bytes)[1]
    assert rows(again, "name", "sha256") == rows(manifest, "name", "sha256")


def test_token_files_of_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    got = sorted(map(tuple, planes.read(*planes.write(df, tokenizer_path())).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 1, 1, 2] and [r[1] for r in got] == [0, 2, 5, 8]
    assert planes.read(*planes.write(df.limit(0), tokenizer_path())).count() == 0


def test_texts_without_an_id_spread_over_files(spark, tokenizer):
    texts = [(None if k % 3 == 0 else 5 if k % 3 == 1 else k, f"text {k} of many") for k in range(900)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    folder, manifest = planes.write(df, tokenizer_path(), shard_bytes=2_000)
    assert max(r["records"] for r in manifest.collect()) * 30 < 2 * 2_000
    got = planes.read(folder, manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in texts), key=lambda d: (d is not None, d or 0))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got[:-1], got[1:], strict=True))
    crcs = sorted(zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for _, t in texts)
    assert sorted(r["ids_crc32"] for r in got) == crcs


def test_a_reader_decodes_only_the_chunks_it_needs():
    out = io.BytesIO()
    writer = planes.Writer(out, np.dtype("<u2"), "bit", 10)
    ids = np.arange(100, dtype="<u2")
    writer.add(5, ids[:33].tobytes())
    writer.add(6, ids[33:].tobytes())
    writer.close()
    reader = planes.Reader(out, writer.at)
    assert [c[1] for c in reader.index["chunks"]] == [10] * 10
    assert np.concatenate(list(reader.ids(18, 41))).tolist() == list(range(18, 41))
    assert reader.documents()[0] == [5, 6]


# ---- shards --------------------------------------------------------------------------------------------------------

def shuffled(spark, n=500, **options):
    df = spark.createDataFrame([(i, None if i % 50 == 0 else f"text {i % 37} é") for i in range(n)], "doc_id long, text string").selectExpr("*", "1 AS slot")
    return df, shards.shuffle(df, **options)


def test_shards_hold_every_row_once_without_gaps(spark):
    df, out = shuffled(spark, shards=7, bucket_bytes=400)
    got = out.collect()
    assert sorted((r["rec"]["doc_id"], r["rec"]["text"] or "") for r in got) == sorted((r["doc_id"], r["text"] or "") for r in df.collect())
    for s in range(7):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots))) and slots
    order = [r["rec"]["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert order != sorted(order)


def test_shards_do_not_depend_on_partitions_and_grow_by_moving_to_the_new_one(spark):
    df, out = shuffled(spark, shards=7, bucket_bytes=400)
    again = shards.shuffle(df.repartition(5), shards=7, bucket_bytes=400)
    place = lambda d: {r["rec"]["doc_id"]: (r["shard"], r["slot"], r["grown_shard"]) for r in d.collect()}
    first = place(out)
    assert first == place(again)
    grown = place(shards.shuffle(df, shards=8, bucket_bytes=400))
    assert {k: v[2] for k, v in first.items()} == {k: v[0] for k, v in grown.items()}
    moved = [k for k, v in first.items() if v[2] != v[0]]
    assert all(first[k][2] == 7 for k in moved) and 0.05 < len(moved) / len(first) < 0.25


def test_shards_of_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a")] * 4 + [(None, "b"), (None, None)], "doc_id long, text string")
    got = shards.shuffle(df, shards=3).collect()
    assert len(got) == 6 and len({(r["shard"], r["slot"]) for r in got}) == 6
    assert shards.shuffle(df.limit(0), shards=3).count() == 0


def test_fisher_yates_is_uniform_enough():
    seen = {}
    for seed in range(6000):
        order = tuple(shards.fisher_yates(3, np.random.default_rng(seed)))
        seen[order] = seen.get(order, 0) + 1
    assert len(seen) == 6 and min(seen.values()) > 850
    assert shards.fisher_yates(0, np.random.default_rng(0)) == [] and shards.fisher_yates(1, np.random.default_rng(0)) == [0]


def test_rows_without_an_id_spread_over_buckets(spark, monkeypatch):
    df = spark.range(6000).selectExpr("CASE WHEN id % 3 > 0 THEN id END AS doc_id", "repeat(concat('t', id), 20) AS text")
    staged, put = {}, shards.stage
    monkeypatch.setattr(shards, "stage", lambda d, label: staged.setdefault(label, put(d, label)))
    out = shards.shuffle(df, shards=4, bucket_bytes=1 << 13).select("rec.doc_id", "shard", "slot").collect()
    assert len(out) == 6000 and sum(r["doc_id"] is None for r in out) == 2000 and len({(r["shard"], r["slot"]) for r in out}) == 6000
    sizes = sorted(b - a for a, b in zip(*(lambda f: (f[:-1], f[1:]))([r["first"] for r in staged["shard-buckets"].orderBy("bucket").collect()]), strict=True) if b > a)
    # The shard of the null ids holds four times the rows of others, in as many more buckets.
    assert sizes[-1] < 3 * sizes[len(sizes) // 2]
