"""Preference pairs: encoding, and loss and reward reports over logged log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.catalog import ChatTemplate
from turnmill.functions.tokens import IGNORE_INDEX, HashEncoder, clip, int_array
from turnmill.operators.order import join_keys
from turnmill.operators.render import chat_template, rendered_chat


def encode_pairs(pairs: DataFrame, template: str | ChatTemplate, encoder=HashEncoder(), *, max_length: int,
                 reward_token: int | None = None) -> DataFrame:
    """``prompt`` / ``chosen`` / ``rejected`` message lists -> ids and labels of both sides.

    Without ``reward_token`` the prompt's tokens carry no loss; with it the token is appended behind the
    cut and is the only label: 0 for chosen, 1 for rejected.
    """
    t = chat_template(template)
    p = (pairs.withColumn("_prompt", rendered_chat(t, F.col("prompt")))
         .withColumn("_chosen", rendered_chat(t, F.concat("prompt", "chosen")))
         .withColumn("_rejected", rendered_chat(t, F.concat("prompt", "rejected")))
         .withColumn("_head", F.least(encoder.length("_prompt"), F.lit(max_length))))
    for side, label in (("chosen", 0), ("rejected", 1)):
        ids = clip(encoder.ids(f"_{side}"), max_length)
        if reward_token is None:
            p = p.withColumn(f"{side}_ids", ids)
            rest = F.slice(f"{side}_ids", F.col("_head") + 1, F.greatest(F.size(f"{side}_ids") - F.col("_head"), F.lit(0)))
            labels = F.concat(F.array_repeat(F.lit(IGNORE_INDEX), F.col("_head")), rest)
        else:
            p = p.withColumn(f"{side}_ids", F.concat(ids, int_array([reward_token])))
            labels = F.concat(F.array_repeat(F.lit(IGNORE_INDEX), F.size(f"{side}_ids") - 1), int_array([label]))
        p = p.withColumn(f"{side}_labels", labels)
    return p.drop("_prompt", "_chosen", "_rejected", "_head", "prompt", "chosen", "rejected")


def preference_set(pairs: DataFrame, template: str | ChatTemplate, encoder=HashEncoder(), *, max_length: int,
                   is_dpo: bool, is_reward: bool, reward_token: int | None = None) -> DataFrame:
    """Checked entry point: exactly one of DPO and reward; reward needs its token id."""
    if is_dpo == is_reward:
        raise ValueError("choose exactly one of is_dpo and is_reward")
    if is_reward and reward_token is None:
        raise ValueError("is_reward needs reward_token")
    return encode_pairs(pairs, template, encoder, max_length=max_length,
                        reward_token=reward_token if is_reward else None)


# ---------------------------------------------------------------- reports

def log_sigmoid(x: Column) -> Column:
    """log(sigmoid(x)) without overflow."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def log1m_exp(x: Column) -> Column:
    """log(1 - exp(x)); minus infinity at 0 and not a number above, where Spark's ``log1p`` would give null."""
    p = F.exp(x)
    return F.when(p == 1, F.lit(float("-inf"))).when(p > 1, F.lit(float("nan"))).otherwise(F.log1p(-p))


def sequence_logps(tokens: DataFrame, *, average: bool = False, pair: str = "pair_id", side: str = "side") -> DataFrame:
    """Token rows -> one row per pair with summed (or averaged) log-probs of both sides.

    Labels are already shifted.  Labels 0 and -100 add nothing to a sum; only -100 is left out of the
    count of an average.  Pairs without both sides are left out.
    """
    counted = F.col("label") != IGNORE_INDEX
    hit = counted & (F.col("label") != 0)
    chosen = F.col(side) == "chosen"

    def total(lp: str, which: Column) -> Column:
        s = F.sum(F.when(which & hit, F.col(lp)).otherwise(F.when(which, 0.0)))
        return s / F.count_if(which & counted) if average else s

    return tokens.groupBy(pair).agg(
        total("policy_lp", chosen).alias("policy_chosen"), total("policy_lp", ~chosen).alias("policy_rejected"),
        total("ref_lp", chosen).alias("ref_chosen"), total("ref_lp", ~chosen).alias("ref_rejected"),
        F.count_if(chosen & counted).alias("n_chosen"), F.count_if(~chosen & counted).alias("n_rejected"),
    ).where("n_chosen > 0 and n_rejected > 0")


DPO_LOSSES = ("sigmoid", "robust", "hinge", "ipo", "kto_pair", "sppo_hard", "nca_pair")


def dpo_losses(logps: DataFrame, *, beta: float = 0.1, label_smoothing: float = 0.0,
               batch: str | None = None) -> DataFrame:
    """All losses of the family per pair: ``loss_<name>`` columns, rewards, ``reward_acc``, margin.

    ``logps`` are sums (see ``sequence_logps``).  ``ipo`` alone works on averages over the counted tokens
    (``n_chosen``, ``n_rejected``).  ``kto_pair`` takes the clamped mean log-ratio of its batch (or of all
    rows); the means are one aggregate, joined back.
    """
    chosen = F.col("policy_chosen") - F.col("ref_chosen")
    rejected = F.col("policy_rejected") - F.col("ref_rejected")
    logits = (F.col("policy_chosen") - F.col("policy_rejected")) - (F.col("ref_chosen") - F.col("ref_rejected"))
    if batch:
        means = logps.groupBy(batch).agg(F.greatest(F.avg(chosen), F.lit(0.0)).alias("_kl_c"),
                                         F.greatest(F.avg(rejected), F.lit(0.0)).alias("_kl_r"))
        p = join_keys(logps, means, [batch])
    else:
        p = (logps.withColumn("_kl_c", logps.agg(F.greatest(F.avg(chosen), F.lit(0.0))).scalar())
             .withColumn("_kl_r", logps.agg(F.greatest(F.avg(rejected), F.lit(0.0))).scalar()))
    per_token = ((F.col("policy_chosen") - F.col("ref_chosen")) / F.col("n_chosen")
                 - (F.col("policy_rejected") - F.col("ref_rejected")) / F.col("n_rejected"))
    b, s = F.lit(beta), label_smoothing
    good, bad = log_sigmoid(b * logits), log_sigmoid(-b * logits)
    kto_c = 1 - sigmoid(b * (chosen - F.col("_kl_r")))
    kto_r = 1 - sigmoid(b * (F.col("_kl_c") - rejected))
    losses = {
        "sigmoid": -good * (1 - s) - bad * s,
        "robust": (-good * (1 - s) + bad * s) / (1 - 2 * s),
        "hinge": F.greatest(1 - b * logits, F.lit(0.0)),
        "ipo": F.pow(per_token - 1 / (2 * beta), 2),
        "kto_pair": (kto_c + kto_r) / 2,
        "sppo_hard": F.pow(chosen - 0.5 / beta, 2) + F.pow(rejected + 0.5 / beta, 2),
        "nca_pair": -log_sigmoid(b * chosen) - 0.5 * log_sigmoid(-b * chosen) - 0.5 * log_sigmoid(-b * rejected),
    }
    return p.select(
        *logps.columns, *[losses[n].alias(f"loss_{n}") for n in DPO_LOSSES],
        (b * chosen).alias("chosen_reward"), (b * rejected).alias("rejected_reward"),
        (chosen > rejected).cast("int").alias("reward_acc"), (b * (chosen - rejected)).alias("reward_margin"))


def orpo_report(logps: DataFrame, nll: Column | float, *, beta: float = 0.1) -> DataFrame:
    """One-row report over length-averaged log-probs of all pairs.

    A log-prob of 0 has infinite odds.  Only the mean ratio skips pairs whose odds are not a number (both
    sides 0); all other means are over every pair.
    """
    c, r = F.col("policy_chosen"), F.col("policy_rejected")
    odds = (c - r) - (log1m_exp(c) - log1m_exp(r))
    ratio = F.when(~F.isnan(odds), log_sigmoid(odds))
    out = logps.agg(
        F.avg(ratio).alias("log_odds_ratio"), F.avg(odds).alias("log_odds_chosen"),
        F.avg(beta * c).alias("chosen_rewards"), F.avg(beta * r).alias("rejected_rewards"),
        F.avg((c > r).cast("double")).alias("reward_acc"), F.avg(beta * (c - r)).alias("reward_margin"))
    nll = nll if isinstance(nll, Column) else F.lit(nll)
    return out.withColumn("nll_loss", nll).withColumn(
        "loss", F.col("nll_loss") - beta * F.coalesce("log_odds_ratio", F.lit(0.0)))


def reward_losses(scores: DataFrame, *, by: list[str], gamma: int = 2, low: float = -5.0, high: float = 5.0,
                  epsilon: float = 1e-3, loss: str = "ranking", penalty: str = "log_barrier",
                  penalty_weight: float = 0.01) -> DataFrame:
    """Ranking and focal losses with both penalties, averaged over pairs, per group.

    ``loss`` is the chosen one of ``ranking`` and ``focal`` plus the weighted ``penalty`` (``log_barrier``, ``l2``
    or ``none``).
    """
    if loss not in ("ranking", "focal") or penalty not in ("log_barrier", "l2", "none"):
        raise ValueError("loss is ranking or focal, penalty is log_barrier, l2 or none")
    c, r = F.col("chosen"), F.col("rejected")
    rank = -log_sigmoid(c - r)
    focal = F.pow(1 - 2 * F.greatest(sigmoid(c - r) - 0.5, F.lit(0.0)), gamma) * rank

    def barrier(x: Column) -> Column:
        x = F.greatest(F.least(x, F.lit(high - epsilon)), F.lit(low + epsilon))
        return -F.log(high - x) - F.log(x - low)

    rest = {"log_barrier": barrier(c) + barrier(r), "l2": c * c + r * r, "none": F.lit(0.0)}[penalty]
    return scores.groupBy(*by).agg(
        F.avg((rank if loss == "ranking" else focal) + penalty_weight * rest).alias("loss"),
        F.avg(rank).alias("ranking_loss"), F.avg(focal).alias("focal_loss"),
        F.avg(barrier(c) + barrier(r)).alias("log_barrier"), F.avg(c * c + r * r).alias("l2"),
        F.avg((c > r).cast("double")).alias("acc"), F.avg(c).alias("chosen_score_mean"),
        F.avg(r).alias("rejected_score_mean"), F.count(F.lit(1)).alias("num_samples"))
