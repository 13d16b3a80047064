"""Whitening, periodic runs and the n-gram join against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF

from turnmill.llm import ngram_join, queries, runs, whitening
from turnmill.llm.common import stage

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
HARD = [None, "", " \n\t ", "a", "a a", "A a", "é É é", "x " * 3000, "\x00 nul \x1c odd", "a b c", "a  b\nc", "A B C"]


# ---- whitening -----------------------------------------------------------------------------------------------------

def plain_whitening(vectors, k=4):
    x = np.array([[int(np.floor(256 * float(e))) for e in v] for v in vectors], object)
    fit = np.array(sorted({tuple(r) for r in x}), object)
    n, sums = len(fit), fit.sum(axis=0)
    mean = (sums / n).astype(float)
    centred = fit.astype(float) - mean
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x.astype(float) - mean) @ axes, values, np.trace(v)


def check_whitening(out, ids, vectors):
    n, deviation, projected, values, trace = plain_whitening(vectors)
    got = sorted((tuple(r) for r in out.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()), key=str)
    assert len(got) == len(ids) * len(values)
    by = {}
    for r in got:
        by.setdefault(r[0], {})[r[1]] = r
    signs = None
    for place, i in enumerate(ids):
        for c, value in enumerate(values):
            r = by[i][c + 1]
            assert r[2] == n and r[3] == deviation[place] and r[5] == pytest.approx(value / trace, rel=1e-10) and r[6] < 1e-9
        found = np.array([by[i][c + 1][4] for c in range(len(values))])
        want = projected[place] / np.sqrt(values)
        signs = np.sign(found * want) if signs is None else signs
        assert found * signs == pytest.approx(want, abs=1e-7)


def test_whitening_matches_a_dense_solver(spark):
    rng = np.random.default_rng(4)
    data = rng.standard_normal((300, 12)) * np.linspace(3, 0.2, 12) + 5
    vectors = [[float(np.float32(e)) for e in v] for v in data] + [[float(np.float32(e)) for e in data[0]]] * 40
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, x string")
    check_whitening(whitening.whiten(df), range(len(vectors)), vectors)


def test_whitening_query_on_the_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check_whitening(queries.QUERIES["op11_whitening"](spark, SF), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_whitening_leaves_out_unusable_rows_and_keeps_ties(spark):
    good = [[1.0, 2.0, 0.5], [0.0, 1.0, 4.0], [3.0, 1.0, 0.0], [3.0, 1.0, 0.0], [-1.0, -2.0, 2.5]]
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [1.0, float("inf"), 1.0], [1.0, 2.0]]
    df = spark.createDataFrame([(k % 4 or None, v) for k, v in enumerate(good + bad)], "vec_id long, embedding array<double>")
    out = whitening.whiten(df).collect()
    assert len(out) == 15 and sum(r["vec_id"] is None for r in out) == 6 and all(r["n"] == 4 for r in out)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("embedding is null")).count() == 0


def test_whitening_of_flat_and_huge_vectors(spark):
    flat = spark.createDataFrame([(k, [1.0, 2.0, 3.0]) for k in range(5)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(flat).collect()
    assert len(rows) == 15 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 for r in rows)
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0]) for k in range(5)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(line).collect()
    assert {r["component"] for r in rows if r["whitened"] is not None} == {1} and len(rows) == 15
    huge = spark.createDataFrame([(k, [k * 1e12, 1.0]) for k in range(4)], "vec_id long, embedding array<double>")
    assert all(r["deviation"] is None for r in whitening.whiten(huge).collect())


def test_jacobi_davidson_on_close_and_equal_values():
    rng = np.random.default_rng(1)
    for values in (np.linspace(10, 1, 30), np.r_[5.0, 5.0, 5.0, np.linspace(4.99, 1, 40)], np.r_[1e6, np.ones(20)], np.r_[3.0, 2.0]):
        q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
        a = q * values @ q.T
        found, axes, residuals = whitening.jacobi_davidson(lambda b, a=a: a @ b, len(values))
        k = len(found)
        assert found == pytest.approx(np.sort(values)[::-1][:k], abs=1e-13 * values.max()) and residuals.max() <= 1e-12 * values.max()
        assert axes.T @ axes == pytest.approx(np.eye(k), abs=1e-12)


def test_minres_solves_the_projected_equation():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.standard_normal((20, 20)))
    a = q * np.linspace(1, 9, 20) @ q.T
    bases = [q[:, -1:], q[:, -2:]]
    rhs = rng.standard_normal((20, 2))
    t = whitening.minres(lambda b: a @ b, rhs, np.array([8.9, 4.2]), bases, 60, 1e-13)
    for j, (shift, basis) in enumerate(zip((8.9, 4.2), bases, strict=True)):
        off = np.eye(20) - basis @ basis.T
        assert basis.T @ t[:, j] == pytest.approx(0, abs=1e-9)
        assert off @ (a - shift * np.eye(20)) @ t[:, j] == pytest.approx(off @ rhs[:, j], abs=1e-8)


# ---- runs ----------------------------------------------------------------------------------------------------------

def plain_runs(words, exponent=4, least=6):
    out = set()
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j + q - i
            part = words[i:i + n]
            if j > i and n >= max(least, exponent * q) and not any(
                    all(part[k] == part[k + d] for k in range(n - d)) for d in range(1, q)):
                out.add((i, n, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    k, n = rng.choice([1, 2, 2, 3, 4]), rng.randint(0, 50)
    words = [b"%d" % rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.6:
        period = words[:rng.randint(1, 6)]
        words = words[:rng.randint(0, n)] + [period[i % len(period)] for i in range(rng.randint(0, 40))] + words[:rng.randint(0, 10)]
    return words


def test_lyndon_lengths_match_their_definition():
    rng = random.Random(8)
    for _ in range(600):
        words = some_words(rng)
        kinds = sorted(set(words))
        r = [kinds.index(w) for w in words]
        want = [next((j - i for j in range(i + 1, len(r)) if r[j:] < r[i:]), len(r) - i) for i in range(len(r))]
        assert runs.lyndon_lengths(r) == want


@pytest.mark.parametrize(("exponent", "least"), [(2, 2), (3, 3), (4, 6), (5, 2)])
@pytest.mark.parametrize("cuts", [0, 1, 24])
def test_runs_match_plain_version(exponent, least, cuts, monkeypatch):
    monkeypatch.setattr(runs, "MAX_CUTS", cuts)
    rng = random.Random(exponent)
    for _ in range(400):
        words = some_words(rng)
        assert runs.word_runs(words, exponent, least) == plain_runs(words, exponent, least)


def test_long_texts_take_linear_time():
    for words in ([b"a"] * 200_000, [b"%d" % (i % 7) for i in range(200_000)], [b"%d" % (bin(i).count("1") % 2) for i in range(100_000)]):
        found = runs.word_runs(words)
        assert len(found) <= 1 and all((s, n) == (0, len(words)) for s, n, _ in found)


def plain_digest(doc_id, text):
    words = SPACE.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n and doc_id is not None:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in drop).encode()).hexdigest())


def test_run_query_matches_plain_version(spark, tmp_path):
    rng = random.Random(3)
    texts = HARD[:7] + ["x " * 50, "x\ty " * 9 + "x y z"] + [" ".join(w.decode() for w in some_words(rng)) for _ in range(150)]
    data = [(None if i == 5 else i, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id long, text string, runs int")
    df = df.unionByName(df.limit(3))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_runs"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(plain_digest(i, t)) for i, t, _ in data + data[:3])
    assert runs.digests(df.limit(0)).count() == 0
    full = {r["doc_id"]: r for r in runs.detect(df.where("doc_id = 8")).collect()}[8]
    assert [tuple(r) for r in full["runs"]] == [(0, 20, 2)] and full["collapsed"] == "x y z"


# ---- n-gram join ---------------------------------------------------------------------------------------------------

def shingles(text, size=3):
    words = SPACE.findall((text or "").translate(LOWER))
    return {tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def plain_join(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=repr)


def near_copies(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(out)


def join_rows():
    rng = random.Random(12)
    texts = list(HARD)
    for length in (4, 9, 25, 60, 150, 400):
        base = [f"w{rng.randrange(400)}" for _ in range(length)]
        texts += [near_copies(rng, base, k % 9) for k in range(40)]
    common = "these words stand at the end of very many texts and say nothing at all about any of them".split()
    texts += [" ".join([f"v{rng.randrange(10 ** 5)}" for _ in range(rng.randint(3, 30))] + common) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + rows[:20] + [(None, texts[40]), (None, texts[40]), (None, "alone and without an id"), (5000, texts[60].upper())]


@pytest.mark.parametrize(("block", "group", "frequent"), [(256, 64, 1 << 16), (3, 2, 4)])
def test_join_matches_plain_version(spark, monkeypatch, block, group, frequent):
    monkeypatch.setattr(ngram_join, "GROUP", group)
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "REPORTED", 2)
    monkeypatch.setattr(ngram_join, "LEADERS", (6, 4) if block == 256 else (1,))
    monkeypatch.setattr(ngram_join.candidates, "__defaults__", (ngram_join.PERCENT, block))
    monkeypatch.setattr(ngram_join.Frequent.__init__, "__defaults__", (frequent,))
    monkeypatch.setattr(ngram_join.frequent_shingles, "__defaults__", (frequent,))
    rows = join_rows()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    assert sorted(map(tuple, ngram_join.join(df).collect()), key=repr) == plain_join(rows)


@pytest.mark.parametrize("percent", [60, 80])
def test_join_at_other_limits(spark, percent):
    rows = join_rows()[:200]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.join(df, percent=percent).collect()), key=repr) == plain_join(rows, percent)


def test_join_of_empty_tables_and_without_broadcast(spark, monkeypatch):
    rows = join_rows()[:90]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ngram_join.join(df.limit(0)).count() == 0
    monkeypatch.setattr("turnmill.llm.common.BROADCAST_ROWS", 0)
    assert sorted(map(tuple, ngram_join.join(df).collect()), key=repr) == plain_join(rows)


def test_deeper_prefixes_are_chosen_where_verifying_is_dear(spark, monkeypatch):
    often = [f"c{k}" for k in range(300)]
    rng = random.Random(7)
    crowd = [" ".join(w if rng.random() < 0.9 else f"u{rng.randrange(10 ** 6)}" for w in often) for _ in range(150)]
    pair = [" ".join(f"p{k}" for k in range(300)), " ".join(f"p{k}" for k in range(299))]
    df = stage(spark.createDataFrame(list(enumerate(crowd + pair)), "doc_id long, text string"), "crowd")
    rows = stage(ngram_join.sets(df), "rows").where("often IS NULL")
    classes = stage(rows.selectExpr("doc_id AS row", "n", "doc_id", "text_hash", "1L AS times"), "classes")
    index = stage(ngram_join.indexed(df, classes, np.zeros(0, np.uint64)), "index")
    entries = stage(ngram_join.listed(index).join(classes.select("row", "n"), "row"), "entries")

    def depths(verify):
        monkeypatch.setattr(ngram_join, "VERIFY", verify)
        return {r["row"]: r["depth"] for r in ngram_join.chosen(entries).collect()}
    free, usual, dear = depths(0.0), depths(0.05), depths(100.0)
    assert {150, 151} <= set(free) and all(d <= 14 for d in free.values())
    assert all(free[r] <= usual[r] <= dear[r] for r in usual) and all(free[r] < dear[r] for r in usual)
    assert any(free[r] < usual[r] for r in usual)


def test_frequent_values_are_counted_within_their_bound():
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.integers(0, 20, 4000), rng.integers(1000, 10 ** 6, 6000)]).astype(np.uint64)
    rng.shuffle(values)
    often = ngram_join.Frequent(200)
    for part in np.array_split(values, 9):
        often.add(part)
    true = dict(zip(*np.unique(values, return_counts=True), strict=True))
    counted = dict(zip(often.values, often.counts, strict=True))
    assert all(true[v] - len(values) / 200 <= counted.get(v, 0) <= true[v] for v in true)
    assert set(range(20)) <= {int(v) for v in often.leading(1)[0]}


def test_ngram_classes_need_a_partner_of_fitting_size(spark):
    # All hold the same 94 of 100 shingles: nine tenths of each set, but two sets of 100 must share 95.
    common = list(range(94))
    sets = {k: common + [1000 * k + i for i in range(6)] for k in range(1, 21)}
    sets |= {30: common + [30_000, 30_001, 30_002, 30_003, 30_004, 30_005], 31: common + [30_000, 30_001, 30_002, 30_003, 30_004, 31_000]}
    whole = spark.createDataFrame([(k, len(s), bytearray(np.array(s, np.uint64).tobytes())) for k, s in sets.items()], "row long, n long, set binary")
    assert sorted(map(tuple, ngram_join.dense(whole).collect())) == [(30, 1), (31, 1)]
    # A smaller partner asks for less.
    smaller = spark.createDataFrame([(40, 92, bytearray(np.array(common[:92], np.uint64).tobytes()))], whole.schema)
    assert (40, 0) in map(tuple, ngram_join.dense(whole.where("row <= 20").unionByName(smaller)).collect())


def test_ngram_bitmaps_bound_what_is_shared():
    rng = np.random.default_rng(3)
    for n in (1, 3, 16, 17, 400):
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for m in (n, max(n // 3, 1), 2 * n):
            y = np.concatenate((x[:m - m // 5], rng.integers(0, 1 << 63, m).astype(np.uint64)))[:m]
            most, total = ngram_join.most_shared(ngram_join.bitmap(x), ngram_join.bitmap(y))
            both, size = ngram_join.shared(np.unique(x).tobytes(), np.unique(y).tobytes())
            assert total == size == n + m
            assert both <= most <= min(n, m)
    far = rng.integers(0, 1 << 63, 800).astype(np.uint64)
    most, _ = ngram_join.most_shared(ngram_join.bitmap(far[:400]), ngram_join.bitmap(far[400:]))
    assert most < 200


def one_text_cut(number, length, most, seed):
    """Copies of one text without up to ``most`` of its words: some link, others are too far from most of them."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(length)]
    return [" ".join(w for k, w in enumerate(base) if k not in out)
            for out in (set(rng.sample(range(length), rng.randrange(most + 1))) for _ in range(number))]


def test_ngram_classes_of_a_group_are_not_paired_with_each_other(spark, monkeypatch):
    compared = []
    verified = ngram_join.verified

    def counted(whole, pairs, *more):
        compared.append(pairs.count())
        return verified(whole, pairs, *more)
    monkeypatch.setattr(ngram_join, "verified", counted)
    rows = list(enumerate(one_text_cut(400, 120, 9, 4)))
    found = sorted(map(tuple, ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert found == plain_join(rows)
    # The last comparison is that of classes of different clusters.
    assert compared[-1] < 400


@pytest.mark.parametrize(("percent", "block"), [(90, 256), (90, 2), (75, 3), (80, 256)])
def test_ngram_meetings_lose_no_pair(spark, percent, block):
    rng = random.Random(percent + block)
    apart, whole = [], {}
    for pivot in (1000, 2000):
        centre = set(range(pivot, pivot + 40))
        whole[pivot] = centre
        for row in range(pivot + 1, pivot + 90):
            # Differences come from few values, so that many are shared, and reach beyond a link.
            lost = rng.sample(sorted(centre), rng.choice((0, 1, 2, 3, 5, 9)))
            whole[row] = (centre - set(lost)) | set(rng.sample(range(pivot + 500, pivot + 512), rng.choice((0, 1, 2, 4, 8))))
        for row, values in whole.items():
            if pivot < row < pivot + 100:
                tokens = sorted(values ^ centre)
                apart.append((row, len(values), row, pivot, 40, len(tokens), tokens))
    df = spark.createDataFrame(apart, "row long, n long, cluster long, pivot long, pn long, d long, tokens array<long>")
    found = set(map(tuple, ngram_join.meetings(df, percent, block).collect()))

    def link(a, b):
        return 100 * len(whole[a] & whole[b]) >= percent * len(whole[a] | whole[b])
    wanted = {(a[0], b[0]) for a in apart for b in apart if a[0] < b[0] and a[3] == b[3] and link(a[0], b[0])
              and not (link(a[0], a[3]) and link(b[0], b[3]))}
    assert len(wanted) > 5 and wanted <= found
