"""Group-wise and sequential advantage estimators over outcome scores: (uid, score, ...) rows, one a response.

Each estimator takes rows with uid, score and row_id and returns them with advantage; a registry has them by name. Group
statistics are windows over uid, whose groups are the responses drawn for one prompt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}

def _g():
    return Window.partitionBy("uid")


def register(name: str):
    """Adds an estimator; a name is taken once."""

    def add(f):
        if name in ESTIMATORS:
            raise ValueError(f"estimator {name} exists")
        ESTIMATORS[name] = f
        return f

    return add


def advantage(rows: DataFrame, estimator: str, **options) -> DataFrame:
    if estimator not in ESTIMATORS:
        raise ValueError(f"no such estimator: {estimator}")
    return ESTIMATORS[estimator](rows, **options)


def _centre() -> tuple[Column, Column, Column]:
    n = F.count("score").over(_g())
    return F.when(n > 1, F.avg("score").over(_g())).otherwise(0.0), F.when(n > 1, F.stddev_samp("score").over(_g())).otherwise(1.0), n


@register("grpo")
def grpo(rows: DataFrame, eps: float = 1e-6, by_std: bool = True) -> DataFrame:
    """(score - mean) / (std + eps), std of the sample; a group of one has mean 0, std 1; without by_std centred only."""
    mean, std, _ = _centre()
    d = F.col("score") - mean
    return rows.withColumn("advantage", d / (std + eps) if by_std else d)


@register("grpo_vectorized")
def grpo_vectorized(rows: DataFrame, eps: float = 1e-6) -> DataFrame:
    """As grpo, with a variance of at least eps."""
    mean, _, n = _centre()
    std = F.when(n > 1, F.sqrt(F.greatest(F.var_samp("score").over(_g()), F.lit(eps)))).otherwise(1.0)
    return rows.withColumn("advantage", (F.col("score") - mean) / (std + eps))


@register("grpo_passk")
def grpo_passk(rows: DataFrame, eps: float = 1e-6, by_std: bool = True) -> DataFrame:
    """The best of a group gets best - second, over std + eps; the others 0. A group of one is an error."""
    ranked = Window.partitionBy("uid").orderBy(F.col("score").desc(), "row_id")
    second = F.lead("score").over(ranked)
    gap = F.col("score") - F.when(F.count("score").over(_g()) < 2, F.raise_error(F.lit("pass@k needs two responses a group")).cast("double")).otherwise(second)
    best = gap / (F.stddev_samp("score").over(_g()) + eps) if by_std else gap
    return rows.withColumn("advantage", F.when(F.row_number().over(ranked) == 1, best).otherwise(0.0))


@register("rloo")
def rloo(rows: DataFrame) -> DataFrame:
    """n / (n - 1) * (score - mean); a group of one keeps its score."""
    n = F.count("score").over(_g())
    return rows.withColumn("advantage", F.when(n > 1, n / (n - 1) * (F.col("score") - F.avg("score").over(_g()))).otherwise(F.col("score")))


@register("rloo_vectorized")
def rloo_vectorized(rows: DataFrame) -> DataFrame:
    """(n * score - sum) / max(n - 1, 1); a group of one has 0."""
    n, s = F.count("score").over(_g()), F.sum("score").over(_g())
    return rows.withColumn("advantage", F.when(n > 1, (n * F.col("score") - s) / F.greatest(n - 1, F.lit(1))).otherwise(0.0))


@register("opo")
def opo(rows: DataFrame) -> DataFrame:
    """Score less the length-weighted mean of its group; a group of one has baseline 0. Needs length."""
    n = F.count("score").over(_g())
    base = F.sum(F.col("score") * F.col("length")).over(_g()) / F.sum("length").over(_g())
    return rows.withColumn("advantage", F.col("score") - F.when(n > 1, base).otherwise(0.0))


@register("gpg")
def gpg(rows: DataFrame, norm: float = 1.0) -> DataFrame:
    """batch / max(nonzero, 1) * (score - mean) / norm, batch and nonzero counted over all rows."""
    mean, _, _ = _centre()
    scale = rows.agg((F.count("*") / F.greatest(F.count_if(F.col("score") != 0), F.lit(1))).alias("scale")).scalar()
    return rows.withColumn("advantage", scale * (F.col("score") - mean) / norm)


@register("reinforce_baseline")
def reinforce_baseline(rows: DataFrame) -> DataFrame:
    """score - mean of the group, whitened over all tokens: each of `length` tokens of a response has its value."""
    mean, _, _ = _centre()
    d = rows.withColumn("d_", F.col("score") - mean)
    n = F.sum("length")
    m = F.sum(F.col("d_") * F.col("length")) / (n + 1e-8)
    stats = d.agg(m.alias("m_"), n.alias("n_"), F.sum(F.col("d_") * F.col("length")).alias("s_"), F.sum(F.col("d_") * F.col("d_") * F.col("length")).alias("q_"))
    var = (F.col("q_") - F.col("s_") * F.col("s_") / F.col("n_")) / (F.col("n_") - 1)
    return d.join(F.broadcast(stats.select("m_", var.alias("v_"))), F.lit(True)).withColumn("advantage", (F.col("d_") - F.col("m_")) / F.sqrt(F.col("v_") + 1e-8)).drop("d_", "m_", "v_")


def remax(rows: DataFrame, baseline: str) -> DataFrame:
    """(uid, pos, reward) tokens -> returns (sums to the end) and advantage, less the sequence's baseline."""
    w = Window.partitionBy("uid").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    returns = F.sum("reward").over(w)
    return rows.withColumn("returns", returns).withColumn("advantage", returns - F.col(baseline))


def dynamic_filter(rows: DataFrame) -> DataFrame:
    """Rows of groups whose scores differ, and of groups of one."""
    kept = rows.withColumn("sd_", F.stddev_pop("score").over(_g())).withColumn("n_", F.count("*").over(_g()))
    return kept.filter((F.col("sd_") > 0) | (F.col("n_") == 1)).drop("sd_", "n_")


def overlong(rows: DataFrame, expected: int, buffer: int, factor: float = 1.0) -> DataFrame:
    """rows with penalty (0 at most, grows with what exceeds expected) and score with it added."""
    p = F.least(-(F.col("length") - expected) / buffer * factor, F.lit(0.0))
    return rows.withColumn("penalty", p).withColumn("score", F.col("score") + p)


def adaptive_kl(steps: DataFrame, start: float, target: float, horizon: float) -> DataFrame:
    """(run, step, kl, n) -> run, coefficients: the KL coefficient after each step, its changes clipped to 20% of the error."""
    ordered = F.array_sort(F.collect_list(F.struct("step", "kl", "n")))

    def fold(acc, s):
        error = F.greatest(F.least(s["kl"] / target - 1, F.lit(0.2)), F.lit(-0.2))
        now = acc["now"] * (1 + error * s["n"] / horizon)
        return F.struct(now.alias("now"), F.array_append(acc["all"], now).alias("all"))

    zero = F.struct(F.lit(float(start)).alias("now"), F.array().cast("array<double>").alias("all"))
    return steps.groupBy("run").agg(F.aggregate(ordered, zero, fold, lambda acc: acc["all"]).alias("coefficients"))


def preference_weights(score: Column, method: str = "pow", power: float = 2.0, low: Column | None = None, high: Column | None = None) -> Column:
    """Resampling weights: pow |score|^power; max_min 1 for the batch's lowest and highest score, else 0; max_random 0.4 for the highest, else 0.1.

    low and high are the batch's extremes, as scalar subqueries, so that no window runs over the whole batch.
    """
    if method == "pow":
        return F.pow(F.abs(score), F.lit(power))
    if method not in ("max_min", "max_random"):
        raise ValueError(f"no such method: {method}")
    if high is None or (low is None and method == "max_min"):
        raise ValueError(f"{method} needs the batch's extremes")
    return F.when((score == high) | (score == low), 1.0).otherwise(0.0) if method == "max_min" else F.when(score == high, 0.4).otherwise(0.1)


def policy_loss(logp: Column, old: Column, advantage: Column, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> Column:
    """The clipped surrogate's value a token, with the dual clip for negative advantages."""
    ratio = F.exp(F.greatest(F.least(logp - old, F.lit(20.0)), F.lit(-20.0)))
    one = -advantage * ratio
    two = -advantage * F.greatest(F.least(ratio, F.lit(1 + high)), F.lit(1 - low))
    first = F.greatest(one, two)
    return F.when(advantage < 0, F.least(first, -advantage * dual)).otherwise(first)


def value_loss(pred: Column, value: Column, returns: Column, clip: float = 0.5) -> Column:
    clipped = F.greatest(F.least(pred, value + clip), value - clip)
    return F.lit(0.5) * F.greatest((pred - returns) * (pred - returns), (clipped - returns) * (clipped - returns))


def sequence_ratio_loss(logp: Column, old: Column, mask: Column, advantage: Column, low: float = 0.2, high: float = 0.2) -> Column:
    """Sequence-level surrogate over token arrays: the ratio is the exponential of the mean log ratio under the mask."""
    from ..functions.arrays import masked_mean

    ratio = F.exp(F.least(masked_mean(F.zip_with(logp, old, lambda a, b: a - b), mask), F.lit(10.0)))
    return F.greatest(-advantage * ratio, -advantage * F.greatest(F.least(ratio, F.lit(1 + high)), F.lit(1 - low)))


def geometric_mean_loss(logp: Column, old: Column, mask: Column, advantage: Column, low: float = 0.4, high: float = 0.4) -> Column:
    """-A times the exponential of the mean log ratio, each token's log ratio clipped on the side the advantage's sign asks for."""
    from ..functions.arrays import masked_mean

    sign = F.signum(advantage)
    clip = lambda d: F.greatest(F.least(d, F.lit(high)), F.lit(-low))
    kept = F.zip_with(logp, old, lambda a, b: sign * F.least(sign * (a - b), sign * clip(a - b)))
    return -advantage * F.exp(masked_mean(kept, mask))


def covariance_choice(tokens: DataFrame, share: float) -> DataFrame:
    """(row_id, pos, logp, advantage) tokens with chosen: the share of tokens of highest covariance of log probability and advantage.

    The cut is a quantile of all tokens, so no token order is sorted in one task.
    """
    m = tokens.agg(F.avg("logp").alias("ml_"), F.avg("advantage").alias("ma_"))
    cov = tokens.join(F.broadcast(m), F.lit(True)).withColumn("cov", (F.col("logp") - F.col("ml_")) * (F.col("advantage") - F.col("ma_"))).drop("ml_", "ma_")
    cut = cov.agg(F.expr(f"percentile(cov, {1 - share})")).scalar()
    return cov.withColumn("chosen", F.col("cov") >= cut)


def kl_cov_loss(tokens: DataFrame, share: float = 0.002, coefficient: float = 1.0) -> DataFrame:
    """Tokens (with old) and loss: -A ratio, and on the chosen tokens a KL penalty more."""
    chosen = covariance_choice(tokens, share)
    d = F.col("logp") - F.col("old")
    base = -F.col("advantage") * F.exp(d)
    return chosen.withColumn("loss", F.when(F.col("chosen"), base + coefficient * F.abs(d)).otherwise(base))


def clip_cov_loss(tokens: DataFrame, share: float = 0.002, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """Tokens (with old) and loss: the clipped surrogate, 0 on the chosen tokens."""
    chosen = covariance_choice(tokens, share)
    ratio = F.exp(F.col("logp") - F.col("old"))
    surrogate = F.greatest(-F.col("advantage") * ratio, -F.col("advantage") * F.greatest(F.least(ratio, F.lit(1 + high)), F.lit(1 - low)))
    return chosen.withColumn("loss", F.when(F.col("chosen"), 0.0).otherwise(surrogate))


#: Policy losses by name: what compares log probabilities, advantages and masks.
POLICY_LOSSES = {"clip": policy_loss, "sequence": sequence_ratio_loss, "geometric": geometric_mean_loss, "kl_cov": kl_cov_loss, "clip_cov": clip_cov_loss}
