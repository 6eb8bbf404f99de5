"""Off-policy correction: importance weights, rejection masks and their metrics over token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import masked_mean, masked_sum, total

SAFE = 20.0


def _clamp(x: Column, bound: float = SAFE) -> Column:
    return F.greatest(F.least(x, F.lit(bound)), F.lit(-bound))


def log_ratio(old: Column, rollout: Column) -> Column:
    return F.zip_with(old, rollout, lambda a, b: a - b)


def _level(ratio: Column, mask: Column, level: str) -> Column:
    """exp of the log ratio by token, or of its sum or mean over the sequence, at every token."""
    if level == "token":
        return F.transform(ratio, lambda x: F.exp(_clamp(x)))
    s = masked_sum(ratio, mask) if level == "sequence" else masked_mean(ratio, mask)
    if level not in ("sequence", "geometric"):
        raise ValueError(f"no such level: {level}")
    return F.transform(ratio, lambda _: F.exp(_clamp(s)))


def weights(ratio: Column, mask: Column, level: str = "token", threshold: float = 2.0) -> Column:
    """Importance weights, truncated above; 0 outside the mask."""
    return F.zip_with(F.transform(_level(ratio, mask, level), lambda x: F.least(x, F.lit(threshold))), mask, lambda x, m: x * m)


def rejection(ratio: Column, mask: Column, level: str = "token", upper: float = 2.0, lower: float | None = None) -> Column:
    """The mask without tokens whose ratio is outside [lower, upper]; lower is 1 / upper by default."""
    low = 1 / upper if lower is None else lower
    return F.zip_with(_level(ratio, mask, level), mask, lambda x, m: F.when((x >= low) & (x <= upper), m).otherwise(F.lit(0)))


def veto(ratio: Column, mask: Column, threshold: float) -> Column:
    """Does some valid token's log ratio lie below the log of threshold?"""
    return F.exists(F.arrays_zip(ratio.alias("r"), mask.alias("m")), lambda z: (z["m"] > 0) & (z["r"] < F.log(F.lit(threshold))))


def correct(rows: DataFrame, old: str, rollout: str, mask: str, is_level: str = "token", is_threshold: float = 2.0, rs_level: str | None = None, rs_threshold: float = 2.0, veto_threshold: float | None = None) -> DataFrame:
    """rows with weights and corrected_mask: weights, rejection and veto together."""
    r, m = log_ratio(F.col(old), F.col(rollout)), F.col(mask)
    kept = rejection(r, m, rs_level, rs_threshold) if rs_level else m
    if veto_threshold is not None:
        gone = veto(r, m, veto_threshold)
        kept = F.transform(kept, lambda x: F.when(gone, F.lit(0)).otherwise(x))
    return rows.withColumn("weights", weights(r, m, is_level, is_threshold)).withColumn("corrected_mask", kept)


def weight_metrics(rows: DataFrame, ratio: Column, mask: Column, threshold: float = 2.0) -> DataFrame:
    """One row on the token-level weights before truncation: mean, max, min, std, effective sample size, shares beyond the band."""
    tokens = rows.select(F.explode(F.arrays_zip(F.transform(ratio, lambda x: F.exp(_clamp(x))).alias("w"), mask.alias("m"))).alias("t")).select("t.*").filter("m > 0")
    w = F.col("w")
    return tokens.agg(F.avg(w).alias("is_mean"), F.max(w).alias("is_max"), F.min(w).alias("is_min"), F.stddev_samp(w).alias("is_std"), (F.avg(w) * F.avg(w) / F.avg(w * w)).alias("is_ess"), F.avg((w > threshold).cast("double")).alias("is_high"), F.avg((w < 1 / threshold).cast("double")).alias("is_low"))


def rejection_metrics(rows: DataFrame, kept: Column, mask: Column) -> DataFrame:
    """One row: share of valid tokens masked out, share of sequences that lose a token, share that lose all."""
    n, k = total(F.transform(mask, lambda m: m.cast("double"))), total(F.transform(kept, lambda m: m.cast("double")))
    return rows.select(n.alias("n"), k.alias("k")).agg((1 - F.sum("k") / F.sum("n")).alias("rs_masked"), F.avg((F.col("k") < F.col("n")).cast("double")).alias("rs_touched"), F.avg((F.col("k") == 0).cast("double")).alias("rs_lost"))


def offpolicy_metrics(rows: DataFrame, old: str, rollout: str, mask: str) -> DataFrame:
    """One row: perplexities of both policies, KL, k3 KL, perplexity ratio, chi-square by token and by sequence."""
    a, b, m = F.col(old), F.col(rollout), F.col(mask)
    r = log_ratio(a, b)
    seq = rows.select(
        (-masked_mean(a, m)).alias("la"),
        (-masked_mean(b, m)).alias("lb"),
        masked_sum(F.transform(r, lambda x: -x), m).alias("kl"),
        masked_sum(F.transform(r, lambda x: F.exp(_clamp(x)) - x - 1), m).alias("k3"),
        masked_sum(F.transform(r, lambda x: F.exp(_clamp(2 * x))), m).alias("c"),
        F.exp(_clamp(2 * masked_sum(r, m))).alias("cs"),
        total(F.transform(m, lambda x: x.cast("double"))).alias("n"),
    )
    n = F.sum("n") + 1e-8
    return seq.agg(F.avg(F.exp("la")).alias("training_ppl"), F.avg(F.exp("lb")).alias("rollout_ppl"), F.avg("la").alias("training_log_ppl"), F.avg("lb").alias("rollout_log_ppl"), (F.sum("kl") / n).alias("kl"), (F.sum("k3") / n).alias("k3_kl"), F.avg(F.exp(F.col("la") - F.col("lb"))).alias("ppl_ratio"), (F.sum("c") / n - 1).alias("chi2_token"), (F.avg("cs") - 1).alias("chi2_seq"))
