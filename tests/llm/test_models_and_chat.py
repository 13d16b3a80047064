"""Trained models by gradients and held-out accuracy; role repair against all possible repairs."""

import itertools
import random

import numpy as np
import pytest
from conftest import SF

from turnmill.llm import chat, language, quality
from turnmill.llm.common import table

HARD = [None, "", " ", "123 !?", "é", "x" * 9000]


# ---- language network ----------------------------------------------------------------------------------------------

def test_backpropagation_matches_differences():
    rng = np.random.default_rng(0)
    h, k, steps = 3, 2, np.array([[1, 2], [3, 1], [0, 2]])
    inputs, loops, out = rng.normal(size=(4, 3 * h)), rng.normal(size=(h, 3 * h)), rng.normal(size=(h, k))
    y = np.array([0, 1])

    def loss(inputs, loops):
        p = language._softmax(language._run(inputs, loops, steps).astype(np.float64) @ out)
        return -np.log(p[:, np.arange(2), y]).sum()

    kept = []
    p = language._softmax(language._run(inputs, loops, steps, kept).astype(np.float64) @ out)
    p[:, np.arange(2), y] -= 1
    _, d_loops = language._back(loops, steps, kept, p @ out.T)
    for i, j in itertools.product(range(h), range(3 * h)):
        moved = loops.copy()
        moved[i, j] += 1e-2
        back = loops.copy()
        back[i, j] -= 1e-2
        assert d_loops[i, j] == pytest.approx((loss(inputs, moved) - loss(inputs, back)) / 2e-2, abs=2e-2)


def test_pooled_probabilities_are_the_mean_over_all_positions():
    model = language.train(["the and of " * 30, "le de la et " * 30], ["en", "fr"], steps=5)
    texts = ["abc", "x" * (language.WINDOW + 1), "the le " * 2000]
    for text, p in zip(texts, language.probabilities(model, [t.encode() for t in texts]), strict=True):
        rows, lengths = language.windows(text.encode())
        each = language.position_labels(model, rows)
        mean = np.concatenate([e[:n] for e, n in zip(each, lengths, strict=True)]).mean(axis=0)
        assert p == pytest.approx(mean, abs=1e-4)


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, SF, "documents")


def test_languages_of_held_out_documents(spark, documents):
    model = language.fit(documents)
    got = {r["doc_id"]: r for r in language.identify(documents, model).collect()}
    truth = {r["doc_id"]: r["lang"] for r in documents.select("doc_id", "lang").collect()}
    aside = [k for k, r in got.items() if r["held_out"]]
    assert len(got) == len(truth) and len(aside) > 20
    assert np.mean([got[k]["lang_pred"] == truth[k] for k in aside]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got.values())
    odd = spark.createDataFrame([(i, t, "x") for i, t in enumerate(HARD)], "doc_id long, text string, score string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(odd, model).collect()}
    assert [found[k] == ("und", 0.0) for k in range(len(HARD))] == [True, True, True, True, False, False]


def test_language_without_labels_or_rows(spark, documents):
    bare = documents.selectExpr("doc_id", "text", "CAST(null AS string) AS lang")
    assert {(r["lang_pred"], r["score"]) for r in language.identify(bare).collect()} == {("und", 0.0)}
    assert language.identify(documents.limit(0)).count() == 0
    kept = language.accepted(documents)
    assert kept.columns == documents.columns and kept.count() > 0.95 * documents.count()


def test_the_stage_rejects_noise_and_keeps_short_clean_texts(spark, documents):
    rng = np.random.default_rng(9)
    clean = [(r["doc_id"], r["text"]) for r in documents.where("length(text) > 300").limit(60).collect()]
    short = [(10_000 + i, " ".join(t.split()[5:9])) for i, t in clean]
    pool = [list("0123456789abcdef"), [chr(c) for c in range(33, 127)], list("qxzjkvwpbfgh")]
    noise = [(20_000 + 3 * k + j, "".join(rng.choice(pool[j], 400))) for k in range(20) for j in range(3)]
    labelled = documents.select("doc_id", "text", "lang")
    probe = spark.createDataFrame([(i, t, None) for i, t in short + noise], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in language.accepted(labelled.unionByName(probe)).collect()}
    assert not kept & {i for i, _ in noise}
    assert len(kept & {i for i, _ in short}) >= 58 and {i for i, _ in clean} <= kept


def test_rare_languages_are_learned(spark):
    common = [f"the house number {k} stands near the river and the old mill" for k in range(4000)]
    rare = [f"das Haus Nummer {k} steht nahe beim Fluss und der alten Muehle" for k in range(24)]
    data = [(i, t, "en" if i < 4000 else "de") for i, t in enumerate(common + rare)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    pairs = language.sampled(df)
    assert len(pairs) <= language.SAMPLE_DOCS and {y for _, y in pairs} == {"en", "de"}
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(df).where("doc_id >= 3900").collect()}
    assert np.mean([got[i] == ("en" if i < 4000 else "de") for i in got]) > 0.98


def test_stage_without_a_model_keeps_texts_with_a_letter(spark):
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate([None, "", "12 ?!", "a clean text", "é"])], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in language.accepted(df).collect()) == [3, 4]
    assert language.accepted(df.limit(0)).count() == 0


# ---- quality -------------------------------------------------------------------------------------------------------

def test_context_vectors_match_a_plain_sum():
    texts = ["the cat sat on the mat", "The dog", "", "a"]
    places, signs = quality.index_vectors()
    total = np.zeros(quality.SLOTS * quality.DIM)
    quality.add_contexts(total, [quality.codes(t) for t in texts], places, signs)
    want = np.zeros((quality.SLOTS, quality.DIM))
    for t in texts:
        both = quality.codes(t)
        for i, j in itertools.product(range(len(both)), repeat=2):
            if i != j and abs(i - j) <= quality.REACH:
                for c in (0, 1):
                    for place, sign in zip(places[both[j, c]], signs[both[j, c]], strict=True):
                        want[both[i, c], place] += sign
    assert (total.reshape(want.shape) == want).all()


def test_quality_of_held_out_documents(spark, documents):
    labels = table(spark, SF, "labels")
    got = {r["doc_id"]: r for r in quality.score(documents, labels).collect()}
    assert len(got) == documents.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    learnt = [(got[k]["score"], y) for k, y in truth.items() if k in got]
    good, bad = [s for s, y in learnt if y == 1], [s for s, y in learnt if y == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.85


def test_quality_of_hard_texts_and_without_labels(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(HARD)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, labels).collect()} == {0.5}
    assert quality.score(docs.limit(0), labels).count() == 0


def test_temperature_calibrates():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 3 * quality.DIM)).astype(np.float32)
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    model = quality.train(x, y, None)
    p = model.scores(x[3::4])
    for low, high in ((0, 0.3), (0.3, 0.7), (0.7, 1.01)):
        part = (p >= low) & (p < high)
        assert abs(p[part].mean() - y[3::4][part].mean()) < 0.1


# ---- role repair ---------------------------------------------------------------------------------------------------

def cheapest(roles):
    """Over all labels and merges, by trying every one; empty turns by search from state to state."""
    far = {k: len(v) for k, v in chat.detours().items()}
    best = None
    for labels in itertools.product(range(3), repeat=len(roles)):
        for merges in itertools.product((0, 1), repeat=len(roles)):
            cost, state = 0, chat.START
            for role, label, merged in zip(roles, labels, merges, strict=True):
                cost += chat.RELABEL * (label != role)
                if merged:
                    if state != label:
                        break
                    cost += chat.MERGE
                else:
                    ways = [far[state, e] for e in range(4) if (state, e) in far and label in chat.LEGAL[e]]
                    if not ways:
                        break
                    cost += chat.INSERT * min(ways)
                state = label
            else:
                cost += chat.INSERT * far[state, chat.FINAL]
                best = cost if best is None else min(best, cost)
    return best


def legal(roles):
    state = chat.START
    for r in roles:
        if r not in chat.LEGAL[state]:
            return False
        state = r
    return state == chat.FINAL


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_repairs_are_the_cheapest_and_legal(n):
    for roles in itertools.product((-1, 0, 1, 2), repeat=n):
        names = [chat.ROLES[r] if r >= 0 else "tool" for r in roles]
        found = chat.render(names, ["t"] * n)
        assert found["cost"] == cheapest(roles), roles
        assert legal([chat.ROLES.index(r) for r in found["roles"].split(",")])


def test_legal_dialogues_stay_as_they_are():
    found = chat.render(["system", "user", "assistant"], ["be kind", "hi", "hello"])
    assert found["cost"] == 0
    assert found["rendered"] == "<|system|>\nbe kind<|end|>\n<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n"
    assert "<|end|>\n<|user|>\n<|end|>" in chat.render(["assistant"], ["x"])["rendered"] or chat.render(["assistant"], ["x"])["n_inserted"] == 1
    assert chat.render(["user"], ["a <|end|> b"])["rendered"].count("<|end|>") == 2


@pytest.mark.parametrize("part", [1, 2, 3, 1000])
def test_parts_give_the_whole_dialogue(spark, part):
    rng = random.Random(8)
    data = [(c, t, rng.choice(["system", "user", "assistant", "tool", None]), rng.choice(["a", "b b", None, ""])) for c in (1, 2, 3) for t in range(rng.randint(3, 11))]
    data += [(None, 0, "user", "n"), (9, None, "user", "first"), (9, 5, "assistant", "x"), (9, 5, "assistant", "x"), (9, 5, "assistant", "y")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").selectExpr("*", "'q' AS part", "1 AS entry")
    got = {}
    for r in sorted(chat.format_dialogues(df, part).collect(), key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0, r["part"])):
        text, cost = got.get(r["conv_id"], ("", 0))
        got[r["conv_id"]] = (text + r["rendered"], cost + r["cost"])
    key = lambda m: (m[1] is not None, m[1] or 0, m[2] is not None, m[2] or "", m[3] is not None, m[3] or "")
    for conv in {d[0] for d in data}:
        rows = sorted((d for d in data if d[0] == conv), key=key)
        whole = chat.render([d[2] for d in rows], [d[3] for d in rows])
        assert got[conv][1] == whole["cost"]
        assert part < 1000 or got[conv][0] == whole["rendered"]
        assert got[conv][0].endswith("<|end|>\n")
    assert chat.format_dialogues(df.limit(0), part).count() == 0


def test_hot_dialogues_are_cut_by_messages(spark):
    rng = random.Random(4)
    data = [(None, rng.randint(0, 2), rng.choice(["system", "user", "assistant", None]), rng.choice(["a", "b", None])) for _ in range(300)]
    data += [(7, None, "user", "x")] * 90 + [(8, 5000 * k, "user", "y") for k in range(4)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(5)
    out = sorted(chat.format_dialogues(df, 16).collect(), key=lambda r: r["part"])
    assert max(r["n_messages"] for r in out) == 16 and sum(r["n_messages"] for r in out) == len(data)
    key = lambda m: (m[1] is not None, m[1] or 0, m[2] is not None, m[2] or "", m[3] is not None, m[3] or "")
    for conv, parts in ((None, 19), (7, 6), (8, 1)):
        rows = sorted((d for d in data if d[0] == conv), key=key)
        mine = [r for r in out if r["conv_id"] == conv]
        whole = chat.render([d[2] for d in rows], [d[3] for d in rows])
        assert [r["part"] for r in mine] == list(range(parts))
        assert sum(r["cost"] for r in mine) == whole["cost"]
        said = [line for line in "".join(r["rendered"] for r in mine).replace("<|end|>", "").split("\n") if line in ("a", "b", "x", "y")]
        assert said == [d[3] for d in rows if d[3]]
