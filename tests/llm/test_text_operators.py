"""Text operators against plain versions: host rules, fingerprints, decontamination, mixes."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import rows
from pyspark.sql import functions as F

from turnmill.llm import curriculum, decontaminate, host_rules, queries, simhash
from turnmill.llm.components import components

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(decontaminate.UPPER, decontaminate.LOWER)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
HARD = [None, "", " \n\t ", "a", "a\n\na\n", "# \x0b| é é\n é é", "ẞtraße ÉCOLE İstanbul", "x " * 3000, "\x00 nul", "a b c"]


def words8(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice("ab cd ef".split()) for _ in range(n))


def documents(spark, texts, sources=("s",), extra=""):
    data = [(i, t, "en", sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, SCHEMA)
    return df.selectExpr("*", *([extra] if extra else []))


# ---- host rules ----------------------------------------------------------------------------------------------------

def plain_counts(text):
    words = SPACE.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = {k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(i, i + 8)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)]


def test_base_counts_match_plain_version():
    texts = HARD + [words8(n, n) for n in range(1, 60)]
    assert host_rules.base_counts(texts).tolist() == [plain_counts(t) for t in texts]


def test_bad_hosts_lose_their_documents_and_small_hosts_are_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(40))
    texts, sources = [], []
    for host, n, bad in (("bad", 200, 160), ("fine", 400, 4), ("tiny", 1, 1), (None, 30, 0)):
        texts += ["short"] * bad + [good] * (n - bad)
        sources += [host] * n
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(zip(texts, sources, strict=True))], "doc_id long, text string, source string")
    out = host_rules.verdicts(df)
    got = {(sources[r["doc_id"]], r["base_failed"]): r["kept"] for r in out.collect()}
    assert got == {("bad", True): False, ("bad", False): False, ("fine", True): False, ("fine", False): True,
                   ("tiny", True): False, (None, False): True}
    rates = {sources[r["doc_id"]]: r["host_rate"] for r in out.collect()}
    assert rates["tiny"] < 1 and abs(rates["bad"] - 0.8) < 0.05
    assert out.count() == len(texts)


def test_host_rules_take_empty_tables_and_clashing_columns(spark):
    df = documents(spark, HARD, extra="1 AS n_words").withColumnRenamed("n_chars", "kept")
    assert host_rules.verdicts(df).count() == len(HARD)
    assert host_rules.verdicts(df.limit(0)).count() == 0


# ---- fingerprints --------------------------------------------------------------------------------------------------

def plain_fingerprint(text):
    xxhash = pytest.importorskip("xxhash")
    words = SPACE.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(fps, ids):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    best = {}
    for i, doc in enumerate(ids):
        r = find(i)
        best[r] = min(best.get(r, doc), doc)
    return [best[find(i)] for i in range(len(fps))]


def test_classes_match_plain_version(spark):
    base = [" ".join(random.Random(k).choice("lorem ipsum dolor sit amet elit sed do".split()) for _ in range(300)) for k in range(6)]
    texts = HARD + base + [b.replace("lorem", "LOREM", 1) for b in base] + [b + " tail" for b in base] + [f"one {k}" for k in range(8)]
    df = documents(spark, texts, extra="7 AS fp")
    fps = [plain_fingerprint(t) for t in texts]
    want = sorted(zip(range(len(texts)), fps, plain_roots(fps, range(len(texts))), strict=True))
    got = sorted((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.classes(df).collect())
    assert got == want
    assert simhash.classes(df.limit(0)).count() == 0
    kept = {r["doc_id"] for r in simhash.representatives(df.unionByName(df.limit(3))).collect()}
    assert kept == {w[2] for w in want}
    assert simhash.representatives(df.unionByName(df)).count() == len(kept)


def test_representatives_of_null_and_repeated_ids(spark):
    text = [" ".join(f"w{k}x{j}" for j in range(60)) for k in range(9)]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (None, text[2]), (4, text[2]),  # groups of null ids, and one with an id
            (5, text[3]), (9, text[3].upper()), (5, text[4]), (8, text[4].upper()),  # one id, the smallest of two groups
            (7, text[5]), (7, text[6]), (3, text[6].upper()), (6, text[7]), (6, text[7])]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, text_hash int")
    out = simhash.representatives(df)
    assert out.columns == df.columns
    want = [(None, text[0]), (None, text[1]), (4, text[2]), (5, text[3]), (5, text[4]), (7, text[5]), (3, text[6].upper()), (6, text[7])]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("hot", [1, 2, 16, 256])
def test_links_are_complete_whatever_is_refined(spark, hot):
    rng = np.random.default_rng(3)
    centers = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = {int(c) for c in centers}
    for c in centers:
        for _ in range(60):
            flips = rng.choice(64, rng.integers(1, 6), replace=False)
            fps.add(int(c) ^ sum(1 << int(f) for f in flips))
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in sorted(fps)]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    assert {tuple(r) for r in simhash.links(df, hot=hot).collect()} == want


@pytest.mark.parametrize("hot", [1, 256])
def test_variants_are_never_broadcast(spark, monkeypatch, hot):
    # Some 64 rows per fingerprint, that Spark takes for as short as the fingerprints; both sides of their joins are shuffled.
    plans, write = {}, simhash.stage

    def final(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString()

    def seen(df, label):
        plans.setdefault(label, []).append(final(df))
        return write(df, label)

    monkeypatch.setattr(simhash, "stage", seen)
    near = [(k << 20) ^ (1 << b) for k in (5, 250) for b in (0, 1, 2, 40, 41)]
    found = simhash.links(spark.createDataFrame([(f,) for f in near], "fp long"), hot=hot)
    assert found.count() == 20
    assert len(plans["simhash-buckets"]) == (3 if hot == 1 else 1)
    for plan in [*plans["simhash-buckets"], final(found)]:
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(500, 499), (499, 500), (7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 140)}, 499: 499, 500: 499}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- decontamination -----------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(texts, items, size=10):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        for a in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[a:a + size])].add(str(i))
    out = []
    for k, t in enumerate(texts):
        w = WORD.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[tuple(w[a:a + n])]
        out.append((k, len(w), len(hit), sorted(found)))
    return out


def leaks():
    items = [(1, "The quick brown fox jumps over the lazy dog, and then it sleeps all day long."), (2, "short item"), (3, None), (4, "?!"),
             (5, " ".join("of the" for _ in range(9))), (6, "The quick brown fox jumps over the lazy dog, and then it sleeps all day long."),
             (7, "ÉCOLE é É nom"), (8, " ".join(f"u{i}" for i in range(30)))]
    texts = [*HARD, items[0][1].upper(), "xx " + items[0][1][:58] + " yy", "a short, item. b", "of the " * 40, "école é É nom", "ÉCOLE é É nom!",
             " ".join(f"u{i}" for i in range(12)) + " gap " + " ".join(f"u{i}" for i in range(12, 30)), " ".join(f"u{i}" for i in range(9)),
             (items[0][1] + " ") * 3]
    return items, texts


@pytest.mark.parametrize("broadcast_rows", [None, 0])
def test_decontamination_matches_plain_version(spark, broadcast_rows, monkeypatch):
    if broadcast_rows is not None:
        monkeypatch.setattr("turnmill.llm.common.BROADCAST_ROWS", broadcast_rows)
    items, texts = leaks()
    docs = documents(spark, texts, extra="'x' AS term")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], list(r["item_ids"])) for r in decontaminate.decontaminate(docs, bench).collect())
    assert got == plain_hits(texts, items)
    clean = {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()}
    assert clean == {k for k, _, n, _ in got if not n}


def test_decontamination_of_empty_tables(spark):
    items, texts = leaks()
    docs, bench = documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    none = decontaminate.decontaminate(docs, bench.limit(0))
    assert none.count() == len(texts) and none.where("contaminated").count() == 0


def plain_near(texts, items, slop=3, size=10):
    out = []
    for t in texts:
        at = collections.defaultdict(list)
        for pos, w in enumerate(WORD.findall((t or "").translate(LOWER))):
            at[w].append(pos)
        near = set()
        for i, item in items:
            w = WORD.findall((item or "").translate(LOWER))
            for first in range(max(1, len(w) - size + 1)) if w else ():
                places = [[p - k for p in at[w[k]]] for k in range(first, min(first + size, len(w)))]
                if any(all(any(o <= x <= o + slop for x in xs) for xs in places) for o in {x for xs in places for x in xs}):
                    near.add(str(i))
        out.append(len(near))
    return out


def near_texts():
    items, texts = leaks()
    u = [f"u{i}" for i in range(30)]
    swapped = [*u[:4], u[5], u[4], *u[6:12]]
    texts += [" ".join(u[:5] + ["x"] + u[5:12]), " ".join(u[:5] + ["x"] * 3 + u[5:10]), " ".join(u[:5] + ["x"] * 4 + u[5:10]), " ".join(swapped[:10]),
              " ".join(u[:3] + u[4:11]), " ".join(sum(([w, "x"] for w in u[:10]), [])), " ".join(u[9::-1]), "item short", "item x short",
              " ".join(u[:9] + ["u0"]), "the quick x brown x fox jumps over the lazy x dog and then it sleeps"]
    return items, texts


@pytest.mark.parametrize("broadcast_rows", [None, 0])
def test_proximity_matches_plain_version(spark, broadcast_rows, monkeypatch):
    if broadcast_rows is not None:
        monkeypatch.setattr("turnmill.llm.common.BROADCAST_ROWS", broadcast_rows)
    items, texts = near_texts()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["n_near"] for r in decontaminate.decontaminate(documents(spark, texts), bench).collect()}
    want = plain_near(texts, items)
    assert [got[k] for k in range(len(texts))] == want and 0 < sum(map(bool, want)) < len(want)


def test_a_long_item_is_cut_in_bounded_rows(spark):
    words = [f"v{i % 70000}" for i in range(200_000)]
    items = [(1, " ".join(words)), (2, "v5 v6 v7")]
    texts = [" ".join(words[500:600]), " ".join(words[69_990:70_020]), "v1 v3 v5", " ".join(words[199_985:] + ["v1", "v2"])]
    df, bench = documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], list(r["item_ids"])) for r in decontaminate.decontaminate(df, bench).collect()}
    assert got == {0: (100, ["1"]), 1: (30, ["1", "2"]), 2: (0, []), 3: (15, ["1"])}


# ---- mixes ---------------------------------------------------------------------------------------------------------

def test_allocation_is_the_fixed_point_of_resharing(spark):
    sizes = {"a": 10, "b": 400, "c": 35, "d": 90, "e": 5, "f": 0, None: 60}
    df = spark.createDataFrame([(str(k), k, v) for k, v in sizes.items()], "key string, source string, source_size long")
    order = sorted((k for k in sizes if k is not None)) + [None]
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(order)}
    rest, free, want = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[k] for k in free)
        over = {k for k in free if rest * weight[k] / total > 2 * sizes[k]}
        for k in over or free:
            want[k] = 2 * sizes[k] if over else rest * weight[k] / total
        rest -= sum(want[k] for k in over)
        free = free - over if over else set()
    got = {r["source"]: r["target"] for r in curriculum.allocate(df).collect()}
    assert got == pytest.approx(want)


def test_mix_takes_about_the_target_and_sorts_by_position(spark):
    texts = [" ".join("w" for _ in range(5 + k % 40)) for k in range(900)] + [None, "", "solo"]
    df = documents(spark, texts, ("x", "x", "x", "y", None, "z"), extra="1 AS size")
    plan = curriculum.plan(df, keep=("doc_id", "source")).collect()
    assert len(plan) == len(texts)
    by = collections.defaultdict(list)
    for r in plan:
        by[r["rec"]["source"]].append(r)
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and len(r["positions"]) * r["size"] == r["taken"]
        assert all(0 <= p <= 1 for p in r["positions"])
    for found in by.values():
        assert abs(sum(r["taken"] for r in found) - found[0]["target"]) <= 25
        assert sum(r["size"] for r in found) == found[0]["source_size"]
    mixed = curriculum.mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(len(r["positions"]) for r in plan)
    assert curriculum.plan(df.limit(0)).count() == 0
    assert sorted((r["rec"]["doc_id"], r["positions"]) for r in curriculum.plan(df.repartition(7)).collect()) == sorted(
        (r["rec"]["doc_id"], r["positions"]) for r in plan)


def test_query_rows_come_from_the_sorted_mix(spark, tmp_path, monkeypatch):
    texts = [" ".join("w" for _ in range(5 + k % 40)) for k in range(600)] + [None, "", "solo"]
    df = documents(spark, texts + texts[:30], ("x", "x", "x", "y", None, "z"))
    df = df.unionByName(df.limit(20))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(curriculum, "RANGE_WORDS", 2_000)
    staged, put = {}, curriculum.stage

    def spy(df, label):
        out = put(df, label)
        staged.setdefault(label, out)
        return out
    monkeypatch.setattr(curriculum, "stage", spy)
    got = queries.QUERIES["op9_curriculum"](spark, str(tmp_path))
    want = curriculum.plan(df)
    columns = ["rec.doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)), F.get("positions", F.lit(1))]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.select(*columns).collect())))
    files = sorted(f.removeprefix("file://") for f in staged["mix-order"].inputFiles())
    order = [r for f in files for r in pq.read_table(f).to_pylist()]
    positions = [r["position"] for r in order]
    assert len(files) > 3 and positions == sorted(p for r in want.collect() for p in r["positions"])
    # Early and late sources: the first has spent three quarters of its words by half time, the third one quarter.
    for key, part in (("=x", 0.75), ("=y", 0.5), ("=z", 0.25)):
        of = [r for r in order if r["key"] == key]
        assert sum(r["size"] for r in of if r["position"] < 0.5) / sum(r["size"] for r in of) == pytest.approx(part, abs=0.05)
    flat = curriculum.dealt(df, schedules=((1.0, 1.0),)).select("rec.doc_id", "taken", "positions").collect()
    assert sorted((r["doc_id"], r["taken"]) for r in flat) == sorted((r["doc_id"], r["taken"]) for r in got.collect())
    assert sorted(p for r in flat for p in r["positions"]) != positions
    assert curriculum.dealt(df.limit(0)).count() == 0


def test_positions_invert_the_integral(spark):
    shapes = [[2.0, 1.0, 0.0], [1.0, 1.0], [0.0, 1.0, 2.0], [0.0, 3.0, 0.0, 1.0]]
    grid = [k / 50 for k in range(50)]
    df = spark.createDataFrame([(k + 1, u) for k in range(len(shapes)) for u in grid], "which int, u double")
    shaped = df.withColumn("shape", curriculum.shapes(shapes, F.col("which")))
    for r in shaped.select("which", "u", curriculum.time_of(F.col("u"), F.col("shape"), 3).alias("t")).collect():
        at, knots = np.linspace(0, 1, 20001), shapes[r["which"] - 1]
        w = np.interp(at, np.linspace(0, 1, len(knots)), knots)
        area = np.concatenate(([0], np.cumsum((w[1:] + w[:-1]) / 2)))
        assert np.interp(r["t"], at, area / area[-1]) == pytest.approx(r["u"], abs=1e-4)


def test_repeated_rows_stay_separate(spark):
    df = documents(spark, ["one two three four"] * 5 + ["five six"])
    df = df.unionByName(df)
    assert curriculum.plan(df).count() == 12
    assert len(rows(simhash.classes(df))) == 12
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
