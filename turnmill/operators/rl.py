"""Trajectory analytics over step logs: shaped rewards, advantages, clipped losses, normalisation.

A trajectory's steps carry a dense 0-based ``step``.  Work that runs along a trajectory goes in chunks of
steps, so one trajectory that holds a third of the log is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions.text import col
from turnmill.functions.tokens import joined
from turnmill.operators.order import chunk_bucket, join_keys, running

STEPS = 1024


def kl_rewards(steps: DataFrame, *, kl_coef: float = 0.01, total: str = "n_steps") -> DataFrame:
    """``kl_coef * (ref - policy)`` on every step but the last, which gets the score."""
    last = F.col("step") == F.col(total) - 1
    return steps.withColumn("kl_reward", F.when(last, F.col("score")).otherwise(
        F.lit(kl_coef) * (F.col("ref_lp") - F.col("policy_lp"))))


# Elements that are folded by appending; longer arrays are folded in pieces of so many.
PIECE = 32


def backward_sums(deltas: Column, decay: float) -> Column:
    """A_t = d_t + decay * A_(t+1) along one array.

    The array is cut from its end in pieces, each folded on its own, so that no fold copies more than a piece; what follows a
    piece then reaches it as the first sum of the next one, weighted by the distance.
    """
    def fold(values: Column, start: Column) -> Column:
        return F.aggregate(values, F.struct(F.array().cast("array<double>").alias("out"), start.cast("double").alias("last")),
                           lambda acc, d: (lambda a: F.struct(F.concat(acc["out"], F.array(a)).alias("out"), a.alias("last")))(d + F.lit(decay) * acc["last"]),
                           lambda acc: acc["out"])
    back = F.reverse(deltas)
    cuts = F.sequence(F.lit(1), F.greatest(F.size(deltas), F.lit(1)), F.lit(PIECE))
    pieces = F.transform(cuts, lambda at: fold(F.slice(back, at, F.lit(PIECE)), F.lit(0.0)))
    # Per piece: the sum that enters it, from the whole pieces before.
    entering = fold_entries(pieces, decay)
    whole = F.zip_with(pieces, entering, lambda piece, start: F.transform(
        piece, lambda a, i: a + F.pow(F.lit(decay), (i + 1).cast("double")) * start))
    return F.reverse(F.flatten(whole))


def fold_entries(pieces: Column, decay: float) -> Column:
    """The sum that stands before each piece: that before the last one, moved over its length, and the last one's own end."""
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("last"))
    return F.aggregate(pieces, start, lambda acc, piece: F.struct(
        F.concat(acc["out"], F.array(acc["last"])).alias("out"),
        (F.coalesce(F.try_element_at(piece, F.lit(-1)), F.lit(0.0)) + F.pow(F.lit(decay), F.size(piece).cast("double")) * acc["last"]).alias("last")),
        lambda acc: acc["out"])


def gae_arrays(rewards: Column | str, values: Column | str, *, gamma: float = 1.0, lam: float = 0.99) -> Column:
    """Advantages of one trajectory that is one row of arrays."""
    r, v = col(rewards), col(values)
    following = F.concat(F.slice(v, F.lit(2), F.size(v)), F.array(F.lit(0.0)))
    deltas = F.zip_with(F.zip_with(r, following, lambda a, b: a + F.lit(gamma) * b), v, lambda a, b: a - b)
    return backward_sums(deltas, gamma * lam)


def gae(steps: DataFrame, *, gamma: float = 1.0, lam: float = 0.99, traj: str = "traj_id", reward: str = "reward",
        value: str = "value", chunk: int = STEPS, bounded: bool = False) -> DataFrame:
    """``advantage`` and ``ret`` of every step, folded backwards in chunks of ``chunk`` steps.

    ``bounded`` is the caller's word that every trajectory is short: each is then folded as one array.
    """
    def short(rows: DataFrame) -> DataFrame:
        lists = rows.groupBy(traj).agg(F.array_sort(F.collect_list(F.struct(
            "step", F.col(reward).alias("r"), F.col(value).alias("v")))).alias("_s"))
        rewards, values = F.transform("_s", lambda s: s["r"]), F.transform("_s", lambda s: s["v"])
        found = lists.withColumn("_a", gae_arrays(rewards, values, gamma=gamma, lam=lam))
        each = found.select(traj, F.explode(F.arrays_zip("_s", "_a")).alias("_r"))
        return each.select(traj, F.col("_r._s.step").alias("step"), F.col("_r._a").alias("advantage"),
                           (F.col("_r._a") + F.col("_r._s.v")).alias("ret"))

    return short(steps) if bounded else _gae_chunks(
        steps, gamma=gamma, lam=lam, traj=traj, reward=reward, value=value, chunk=chunk)


def _gae_chunks(steps: DataFrame, *, gamma: float, lam: float, traj: str, reward: str, value: str,
                chunk: int) -> DataFrame:
    """Each chunk of steps is folded backwards on its own, in the one shuffle that gathers it; the first step of a chunk is sent to
    the chunk before as well, whose last step needs its value.  What follows a chunk reaches it as the first sum of the next one,
    weighted by the distance: one number per chunk, and only of trajectories with more than one.
    """
    decay = gamma * lam
    own = steps.select(traj, "step", F.col(reward).alias("r"), F.col(value).alias("v"), chunk_bucket("step", chunk).alias("_at"))
    opens = (F.col("step") % chunk == 0) & (F.col("step") > 0)
    sent = own.select(traj, "step", "r", "v", F.explode(F.when(opens, F.array("_at", F.col("_at") - 1)).otherwise(F.array("_at"))).alias("_chunk"))
    cut = sent.groupBy(traj, "_chunk").agg(F.array_sort(F.collect_list(F.struct("step", "r", "v"))).alias("_s"))
    followed = chunk_bucket(F.element_at("_s", -1)["step"], chunk) != F.col("_chunk")
    cut = cut.withColumn("_followed", followed).withColumn("_size", F.size("_s") - F.col("_followed").cast("int"))
    deltas = F.transform(F.slice("_s", F.lit(1), F.col("_size")), lambda s, i: s["r"] + F.lit(gamma) * F.coalesce(
        F.get("_s", i + 1)["v"], F.lit(0.0)) - s["v"])
    folded = lambda rows: rows.withColumn("_local", backward_sums(deltas, decay))
    heads = folded(cut.where(F.col("_followed") | (F.col("_chunk") > 0))).groupBy(traj).agg(
        F.array_sort(F.collect_list(F.struct("_chunk", F.element_at("_local", 1).alias("head")))).alias("_heads"))
    # All chunks but the last are full.
    carried = heads.select(traj, backward_sums(F.transform("_heads", lambda h: h["head"]), decay ** chunk).alias("_sums"))
    rows = join_keys(folded(cut), carried, [traj], "left").select(
        traj, "_size", F.coalesce(F.get("_sums", F.col("_chunk") + 1), F.lit(0.0)).alias("_carry"),
        F.posexplode(F.arrays_zip(F.slice("_s", F.lit(1), F.col("_size")).alias("_s"), "_local")).alias("_i", "_r"))
    advantage = F.col("_r._local") + F.pow(F.lit(decay), F.col("_size") - F.col("_i")) * F.col("_carry")
    return rows.select(traj, F.col("_r._s.step").alias("step"), advantage.alias("advantage"),
                       (advantage + F.col("_r._s.v")).alias("ret"))


def ppo_losses(steps: DataFrame, *, traj: str = "traj_id", clip_ratio: float = 0.2, clip_value: float = 0.5,
               loss_factor: Column | None = None) -> DataFrame:
    """Clipped policy and value losses per trajectory: means, and sums weighted by ``loss_factor``.

    The factor is applied inside both sums.
    """
    ratio = F.exp(F.col("policy_lp") - F.col("old_lp"))
    bounded = F.greatest(F.least(ratio, F.lit(1 + clip_ratio)), F.lit(1 - clip_ratio))
    policy = F.greatest(-ratio * F.col("advantage"), -bounded * F.col("advantage"))
    moved = F.greatest(F.least(F.col("value") - F.col("old_value"), F.lit(clip_value)), F.lit(-clip_value))
    critic = F.greatest(F.pow(F.col("old_value") + moved - F.col("ret"), 2), F.pow(F.col("value") - F.col("ret"), 2))
    factor = F.lit(1.0) if loss_factor is None else loss_factor
    return steps.groupBy(traj).agg(
        F.avg(policy).alias("policy_loss"), (0.5 * F.avg(critic)).alias("value_loss"),
        F.sum(policy * factor).alias("policy_loss_token"), (0.5 * F.sum(critic * factor)).alias("value_loss_token"))


def reward_normalise(rewards: DataFrame, *, batch: str = "batch", reward: str = "reward", low: float = -5.0,
                     high: float = 5.0, epsilon: float = 1e-5, batch_bucket: Column | None = None) -> DataFrame:
    """Clip, then scale by the running mean and variance over update batches.

    The running values are plain averages of the batch means and unbiased batch variances up to the
    row's batch.  The variance of a batch of one row is 0.  Batch statistics are map-side combined; the
    join back is on the batch.
    """
    clipped = F.greatest(F.least(F.col(reward), F.lit(high)), F.lit(low))
    stats = rewards.groupBy(batch).agg(F.avg(clipped).alias("_mean"), F.coalesce(F.var_samp(clipped), F.lit(0.0)).alias("_var"),
                                       F.avg(reward).alias("current_mean"))
    bucket = batch_bucket if batch_bucket is not None else chunk_bucket(batch)
    stats = running(stats, order=[batch], bucket=bucket, index="_k", as_type="double",
                    sums={"_m": F.col("_mean"), "_v": F.col("_var")})
    k = F.col("_k") + 1
    stats = stats.select(batch, "current_mean", ((F.col("_m") + F.col("_mean")) / k).alias("running_mean"),
                         ((F.col("_v") + F.col("_var")) / k).alias("running_var"))
    return join_keys(rewards, stats, [batch]).withColumn("ori_reward", F.col(reward)).withColumn(
        reward, (clipped - F.col("running_mean")) / F.sqrt(F.col("running_var") + epsilon))


def token_logprob(logits: Column | str, label: Column | str) -> Column:
    """``logits[label] - logsumexp(logits)``, shifted by the maximum."""
    x = F.transform(col(logits), lambda v: v.cast("double"))
    top = F.array_max(x)
    total = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    return F.get(x, col(label)) - top - F.log(total)


def trajectory_lines(trajectories: DataFrame, *, debug: bool = False) -> DataFrame:
    """The logged form of trajectories: ``num_tokens``, ``reward`` (as scored), ``sequence``."""
    cols = [F.col("num_tokens"), F.col("ori_reward").alias("reward"), F.col("sequence")]
    if debug:
        cols += [joined("input_ids").alias("input_ids"), joined("labels").alias("labels")]
    return trajectories.select(*cols)
