"""Queries: preference pairs, losses and rewards over logged scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.functions.tokens import HashEncoder, joined, supervised
from turnmill.operators import metrics as mt
from turnmill.operators import pairs as pr
from turnmill.operators import rl
from turnmill.operators.order import int_div
from turnmill.plans import inputs, sql
from turnmill.plans.formats import pair_lists
from turnmill.plans.inputs import six
from turnmill.plans.packing import _PAIR_LENGTHS
from turnmill.plans.registry import query
from turnmill.session import stage

ENC = HashEncoder()
_M = 200


def _sides(reward: bool) -> str:
    def side(name, ids, label):
        cut = f"{ids}[1:{_M}]"
        if reward:
            return (f"{sql.text(f'list_concat({cut}, [CAST(99 AS BIGINT)])')} AS {name}_ids, "
                    f"{sql.text(f'list_concat({sql.masked(cut)}, [CAST({label} AS BIGINT)])')} AS {name}_labels")
        head = f"least(len(pi), {_M})"
        return (f"{sql.text(cut)} AS {name}_ids, {sql.text(f'list_concat(list_transform(range({head}), lambda x: CAST(-100 AS BIGINT)), {cut}[{head} + 1:])')} AS {name}_labels")
    return f"SELECT sample_id AS pair_id, {side('chosen', 'ci', 0)}, {side('rejected', 'ri', 1)} FROM pairs"


def _shown(df):
    return df.select("pair_id", *[joined(c).alias(c) for c in ("chosen_ids", "chosen_labels", "rejected_ids", "rejected_labels")])


@query("encode_dpo", f"WITH {_PAIR_LENGTHS} {_sides(False)}")
def encode_dpo(spark, d):
    return _shown(pr.encode_pairs(pair_lists(spark, d), "qwen2", ENC, max_length=_M))


@query("encode_reward_pair", f"WITH {_PAIR_LENGTHS} {_sides(True)}")
def encode_reward_pair(spark, d):
    return _shown(pr.encode_pairs(pair_lists(spark, d), "qwen2", ENC, max_length=_M, reward_token=99))


@query("preference_set", f"""
WITH {_PAIR_LENGTHS}
SELECT count(*) AS n_pairs, CAST(sum(least(len(ci), {_M}) + least(len(ri), {_M})) AS BIGINT) AS n_tokens,
       CAST(sum(greatest(least(len(ci), {_M}) - len(pi), 0) + greatest(least(len(ri), {_M}) - len(pi), 0)) AS BIGINT) AS n_supervised FROM pairs""")
def preference_set(spark, d):
    coded = pr.preference_set(pair_lists(spark, d), "qwen2", ENC, max_length=_M, is_dpo=True, is_reward=False)
    return coded.agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(F.size("chosen_ids") + F.size("rejected_ids")).alias("n_tokens"),
                     F.sum(supervised("chosen_labels") + supervised("rejected_labels")).alias("n_supervised"))


# ---------------------------------------------------------------- token log-probabilities

def token_rows(spark, d):
    """Lines as tokens: an order is a pair, odd line numbers are the chosen side."""
    li = inputs.table(spark, d, "lineitem")
    label = F.when(F.col("l_partkey") % 7 == 0, -100).when(F.col("l_partkey") % 5 == 0, 0).otherwise(F.col("l_partkey") % 1000 + 1)
    return li.select(F.col("l_orderkey").alias("pair_id"), F.when(F.col("l_linenumber") % 2 == 1, "chosen").otherwise("rejected").alias("side"),
                     F.col("l_linenumber").alias("pos"), (-(F.col("l_discount") + F.col("l_quantity") / 100 + 0.01)).alias("policy_lp"),
                     (-(F.col("l_tax") + F.col("l_quantity") / 90 + 0.02)).alias("ref_lp"), label.cast("long").alias("label"))


_TOKENS = """
tok AS (SELECT l_orderkey AS pair_id, l_linenumber % 2 = 1 AS ch, -(l_discount + l_quantity / 100 + 0.01) AS p, -(l_tax + l_quantity / 90 + 0.02) AS r,
          CASE WHEN l_partkey % 7 = 0 THEN -100 WHEN l_partkey % 5 = 0 THEN 0 ELSE l_partkey % 1000 + 1 END AS label FROM lineitem),
s AS (SELECT pair_id, sum(CASE WHEN label NOT IN (0, -100) THEN p ELSE 0 END) FILTER (WHERE ch) AS pc,
        sum(CASE WHEN label NOT IN (0, -100) THEN p ELSE 0 END) FILTER (WHERE NOT ch) AS pj,
        sum(CASE WHEN label NOT IN (0, -100) THEN r ELSE 0 END) FILTER (WHERE ch) AS rc,
        sum(CASE WHEN label NOT IN (0, -100) THEN r ELSE 0 END) FILTER (WHERE NOT ch) AS rj,
        count(*) FILTER (WHERE ch AND label <> -100) AS nc, count(*) FILTER (WHERE NOT ch AND label <> -100) AS nj
      FROM tok GROUP BY pair_id),
lp AS (SELECT * FROM s WHERE nc > 0 AND nj > 0)
"""


@query("sequence_logps", f"""
WITH {_TOKENS}
SELECT 'sum' AS kind, pair_id, {sql.r6('pc')} AS policy_chosen, {sql.r6('pj')} AS policy_rejected, {sql.r6('rc')} AS ref_chosen, {sql.r6('rj')} AS ref_rejected, nc AS n_chosen, nj AS n_rejected FROM lp
UNION ALL SELECT 'average', pair_id, round(pc / nc, 6), round(pj / nj, 6), round(rc / nc, 6), round(rj / nj, 6), nc, nj FROM lp""")
def sequence_logps(spark, d):
    """Both readings of the same sums: the lines are aggregated once."""
    sides = ("policy_chosen", "policy_rejected", "ref_chosen", "ref_rejected")
    lp = pr.sequence_logps(token_rows(spark, d))
    kinds = [F.struct(F.lit(kind).alias("kind"), *[six(F.col(c) / F.col("n_" + c.split("_")[1]) if average else F.col(c)).alias(c) for c in sides])
             for kind, average in (("sum", False), ("average", True))]
    return lp.select("pair_id", "n_chosen", "n_rejected", F.inline(F.array(*kinds)))


def _ls(x: str) -> str:
    return f"(least({x}, 0.0) - ln(1 + exp(-abs({x}))))"


_DPO = f"""
{_TOKENS},
b AS (SELECT pair_id, pair_id % 64 AS batch, pc - rc AS c, pj - rj AS j, (pc - pj) - (rc - rj) AS x, (pc - rc) / nc - (pj - rj) / nj AS xa FROM lp),
k AS (SELECT *, greatest(avg(c) OVER (PARTITION BY batch), 0.0) AS klc, greatest(avg(j) OVER (PARTITION BY batch), 0.0) AS klj FROM b)
"""


@query("dpo_losses", f"""
WITH {_DPO}
SELECT pair_id, round(-{_ls('0.1 * x')} * 0.9 - {_ls('-0.1 * x')} * 0.1, 6) AS loss_sigmoid,
       round((-{_ls('0.1 * x')} * 0.9 + {_ls('-0.1 * x')} * 0.1) / 0.8, 6) AS loss_robust, round(greatest(1 - 0.1 * x, 0.0), 6) AS loss_hinge,
       round(pow(xa - 5, 2), 6) AS loss_ipo,
       round(((1 - 1 / (1 + exp(-0.1 * (c - klj)))) + (1 - 1 / (1 + exp(-0.1 * (klc - j))))) / 2, 6) AS loss_kto_pair,
       round(pow(c - 5, 2) + pow(j + 5, 2), 6) AS loss_sppo_hard,
       round(-{_ls('0.1 * c')} - 0.5 * {_ls('-0.1 * c')} - 0.5 * {_ls('-0.1 * j')}, 6) AS loss_nca_pair,
       {sql.r6('0.1 * c')} AS chosen_reward, {sql.r6('0.1 * j')} AS rejected_reward, CASE WHEN c > j THEN 1 ELSE 0 END AS reward_acc, {sql.r6('0.1 * (c - j)')} AS reward_margin FROM k""")
def dpo_losses(spark, d):
    lp = stage(pr.sequence_logps(token_rows(spark, d)).withColumn("batch", F.col("pair_id") % 64), "logps")
    out = pr.dpo_losses(lp, beta=0.1, label_smoothing=0.1, batch="batch")
    return out.select("pair_id", *[six(c).alias(c) for c in out.columns if c.startswith("loss_")], six("chosen_reward").alias("chosen_reward"),
                      six("rejected_reward").alias("rejected_reward"), "reward_acc", six("reward_margin").alias("reward_margin"))


@query("orpo_report", f"""
WITH {_TOKENS},
a AS (SELECT pc / nc AS c, pj / nj AS j FROM lp),
g AS (SELECT *, CASE WHEN exp(c) >= 1 THEN '-Infinity'::DOUBLE ELSE ln(1 - exp(c)) END AS lc,
             CASE WHEN exp(j) >= 1 THEN '-Infinity'::DOUBLE ELSE ln(1 - exp(j)) END AS lj FROM a),
o AS (SELECT *, (c - j) - (lc - lj) AS odds FROM g),
v AS (SELECT avg({_ls('odds')}) AS lor FROM o WHERE NOT isnan(odds)),
n AS (SELECT sum(-p) FILTER (WHERE ch AND label <> -100) / count(*) FILTER (WHERE ch AND label <> -100) AS nll FROM tok)
SELECT round(any_value(lor), 6) AS log_odds_ratio, round(avg(odds), 6) AS log_odds_chosen, round(avg(0.1 * c), 6) AS chosen_rewards,
       round(avg(0.1 * j), 6) AS rejected_rewards, round(avg(CASE WHEN c > j THEN 1.0 ELSE 0.0 END), 6) AS reward_acc, round(avg(0.1 * (c - j)), 6) AS reward_margin,
       round(any_value(nll), 6) AS nll_loss, round(any_value(nll) - 0.1 * any_value(lor), 6) AS loss FROM o, n, v""")
def orpo_report(spark, d):
    tok = token_rows(spark, d)
    lp = pr.sequence_logps(tok, average=True)
    learned = tok.where("side = 'chosen' and label <> -100")
    nll = learned.agg(F.sum(-F.col("policy_lp")) / F.count(F.lit(1))).scalar()
    out = pr.orpo_report(lp, nll, beta=0.1)
    return out.select(*[six(c).alias(c) for c in out.columns])


def score_pairs(spark, d):
    """Consecutive events as scored pairs; the data set is the chosen event's type."""
    e = inputs.table(spark, d, "events").select(int_div("event_id", 2).alias("pair_id"), (F.col("event_id") % 2).alias("k"), "event_type",
                                                (F.col("value") / 100).alias("x"))
    first = F.col("k") == 0
    return e.groupBy("pair_id").agg(F.max(F.when(first, F.col("event_type"))).alias("ds_name"), F.max(F.when(first, F.col("x"))).alias("chosen"),
                                    F.max(F.when(~first, F.col("x"))).alias("rejected")).where("chosen is not null and rejected is not null")


_SCORES = """
sc AS (SELECT a.event_type AS ds_name, a.value / 100 AS c, b.value / 100 AS r FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_id % 2 = 0)
"""


@query("reward_losses", f"""
WITH {_SCORES}
SELECT ds_name, round(avg(-{_ls('c - r')} + 0.01 * (-ln(5 - least(greatest(c, -4.999), 4.999)) - ln(least(greatest(c, -4.999), 4.999) + 5) - ln(5 - least(greatest(r, -4.999), 4.999)) - ln(least(greatest(r, -4.999), 4.999) + 5))), 6) AS loss,
       round(avg(-{_ls('c - r')}), 6) AS ranking_loss, round(avg(pow(1 - 2 * greatest(1 / (1 + exp(-(c - r))) - 0.5, 0.0), 2) * -{_ls('c - r')}), 6) AS focal_loss,
       round(avg(-ln(5 - least(greatest(c, -4.999), 4.999)) - ln(least(greatest(c, -4.999), 4.999) + 5) - ln(5 - least(greatest(r, -4.999), 4.999)) - ln(least(greatest(r, -4.999), 4.999) + 5)), 6) AS log_barrier,
       round(avg(c * c + r * r), 6) AS l2, round(avg(CASE WHEN c > r THEN 1.0 ELSE 0.0 END), 6) AS acc, round(avg(c), 6) AS chosen_score_mean,
       round(avg(r), 6) AS rejected_score_mean, count(*) AS num_samples FROM sc GROUP BY ds_name""")
def reward_losses(spark, d):
    out = pr.reward_losses(score_pairs(spark, d), by=["ds_name"])
    return out.select("ds_name", *[six(c).alias(c) for c in out.columns if c not in ("ds_name", "num_samples")], "num_samples")


@query("reward_accuracy", f"""
WITH {_SCORES} SELECT ds_name, count(*) AS n, round(avg(CASE WHEN c > r THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(c), 6) AS chosen_score, round(avg(r), 6) AS rejected_score FROM sc GROUP BY ds_name""")
def reward_accuracy(spark, d):
    out = mt.reward_accuracy(score_pairs(spark, d))
    return out.select("ds_name", "n", *[six(c).alias(c) for c in ("accuracy", "chosen_score", "rejected_score")])


# ---------------------------------------------------------------- trajectories

_STEPS = """
st AS (SELECT user_id AS traj_id, event_id, value / 100 AS x, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step,
         count(*) OVER (PARTITION BY user_id) AS n FROM events)
"""


def logged_steps(spark, d):
    s = inputs.steps(spark, d)
    return s.withColumn("policy_lp", -F.col("x") / 2).withColumn("ref_lp", -F.col("x") / 3).withColumn("score", F.col("x"))


@query("kl_rewards", f"WITH {_STEPS} SELECT traj_id, step, round(CASE WHEN step = n - 1 THEN x ELSE 0.01 * (-x / 3 + x / 2) END, 9) AS kl_reward FROM st")
def kl_rewards(spark, d):
    return rl.kl_rewards(logged_steps(spark, d)).select(
        "traj_id", "step", F.round("kl_reward", 9).alias("kl_reward"))


_DELTA = f"""
{_STEPS},
dl AS (SELECT traj_id, step, n, x / 2 AS v, x + 0.99 * coalesce(lead(x / 2) OVER (PARTITION BY traj_id ORDER BY step), 0) - x / 2 AS delta FROM st)
"""


@query("gae", f"""
WITH {_DELTA}
SELECT a.traj_id, a.step, {sql.r6('sum(b.delta * pow(0.99 * 0.95, b.step - a.step))')} AS advantage,
       round(sum(b.delta * pow(0.99 * 0.95, b.step - a.step)) + any_value(a.v), 6) AS ret
FROM dl a JOIN dl b ON b.traj_id = a.traj_id AND b.step >= a.step GROUP BY a.traj_id, a.step""")
def gae(spark, d):
    s = stage(inputs.steps(spark, d).select("traj_id", "step", F.col("x").alias("reward"), (F.col("x") / 2).alias("value")), "steps")
    return rl.gae(s, gamma=0.99, lam=0.95).select("traj_id", "step", six("advantage").alias("advantage"), six("ret").alias("ret"))


@query("ppo_losses", f"""
WITH {_STEPS},
p AS (SELECT traj_id, exp(-x / 2 + x / 3) AS ratio, x - 1 AS adv, x / 2 AS v, x / 3 AS ov, x * 0.9 AS ret FROM st),
l AS (SELECT traj_id, greatest(-ratio * adv, -least(greatest(ratio, 0.8), 1.2) * adv) AS pl,
        greatest(pow(ov + least(greatest(v - ov, -0.5), 0.5) - ret, 2), pow(v - ret, 2)) AS vl FROM p)
SELECT traj_id, round(avg(pl), 6) AS policy_loss, round(0.5 * avg(vl), 6) AS value_loss, round(sum(pl * 0.5), 6) AS policy_loss_token, round(0.5 * sum(vl * 0.5), 6) AS value_loss_token
FROM l GROUP BY traj_id""")
def ppo_losses(spark, d):
    e = inputs.table(spark, d, "events").select(F.col("user_id").alias("traj_id"), (F.col("value") / 100).alias("x"))
    x = F.col("x")
    s = e.select("traj_id", (-x / 2).alias("policy_lp"), (-x / 3).alias("old_lp"), (x - 1).alias("advantage"), (x / 2).alias("value"),
                 (x / 3).alias("old_value"), (x * 0.9).alias("ret"))
    out = rl.ppo_losses(s, loss_factor=F.lit(0.5))
    return out.select("traj_id", *[six(c).alias(c) for c in out.columns if c != "traj_id"])


@query("reward_normalize", """
WITH r AS (SELECT event_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS batch, value / 100 AS ori, greatest(least(value / 100, 5.0), -5.0) AS x FROM events),
b AS (SELECT batch, avg(x) AS m, var_samp(x) AS v FROM r GROUP BY batch),
c AS (SELECT batch, avg(m) OVER (ORDER BY batch) AS rm, avg(v) OVER (ORDER BY batch) AS rv FROM b)
SELECT event_id, batch, round((x - rm) / sqrt(rv + 1e-5), 6) + CAST(0 AS DOUBLE) AS reward, ori AS ori_reward FROM r JOIN c USING (batch)""")
def reward_normalize(spark, d):
    e = inputs.table(spark, d, "events").select("event_id", F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("batch"),
                                                (F.col("value") / 100).alias("reward"))
    return rl.reward_normalise(e).select("event_id", "batch", six("reward").alias("reward"), "ori_reward")


@query("supervised_tokens", f"""
WITH {sql.samples(256)}
SELECT 's' || (sample_id % 3) AS source, CAST(sum(len(labels)) AS BIGINT) AS n_total, CAST(sum(len(list_filter(labels, lambda x: x >= 0))) AS BIGINT) AS n_action FROM samples GROUP BY 1""")
def supervised_tokens(spark, d):
    s = inputs.samples(spark, d, 256)
    return s.groupBy(F.concat(F.lit("s"), (F.col("sample_id") % 3).cast("string")).alias("source")).agg(
        F.sum(F.size("labels")).alias("n_total"), F.sum(supervised("labels")).alias("n_action"))


@query("token_logprob", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS l FROM embeddings)
SELECT vec_id, round(l[vec_id % 64 + 1] - list_max(l) - ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))), 6) AS logprob FROM e""")
def token_logprob(spark, d):
    e = inputs.table(spark, d, "embeddings")
    return e.select("vec_id", six(rl.token_logprob("embedding", (F.col("vec_id") % 64).cast("int"))).alias("logprob"))
