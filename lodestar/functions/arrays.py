"""Masked reductions, folds and sequence reshaping over array columns: one row is one sequence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def masked(values: Column, mask: Column) -> Column:
    """Values where the mask is set, 0 elsewhere, whatever stands there."""
    return F.zip_with(values, mask, lambda x, m: F.when(m > 0, x * m).otherwise(F.lit(0.0)))


def masked_sum(values: Column, mask: Column) -> Column:
    return total(masked(values, mask))


def masked_mean(values: Column, mask: Column) -> Column:
    return masked_sum(values, mask) / (total(F.transform(mask, lambda m: m.cast("double"))) + F.lit(1e-8))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    d = lambda x, y: x.cast("double") - y.cast("double")
    return F.aggregate(F.zip_with(a, b, lambda x, y: d(x, y) * d(x, y)), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v over its length."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.try_divide(x, n))


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is set."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda z: z["m"] > 0), lambda z: z["v"])
    first = F.transform(kept[0], lambda _: F.lit(0.0))
    return F.transform(F.aggregate(kept, first, lambda a, v: F.zip_with(a, v, lambda x, y: x + y)), lambda x: x / F.size(kept))


def last_token_pool(vectors: Column, mask: Column) -> Column:
    return F.try_element_at(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda z: z["m"] > 0), F.lit(-1))["v"]


def entropy(logits: Column) -> Column:
    """Entropy of the softmax of logits: logsumexp less the mean logit, shifted by the largest."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    z = total(e)
    return F.log(z) + top - total(F.zip_with(e, logits, lambda p, x: p * x)) / z


def reverse_returns(rewards: Column, mask: Column, gamma: float = 1.0) -> Column:
    """Discounted sums from each position to the end; a masked position starts anew."""
    step = F.aggregate(
        F.reverse(F.arrays_zip(rewards.alias("r"), mask.alias("m"))),
        F.struct(F.lit(0.0).alias("run"), F.array().cast("array<double>").alias("out")),
        lambda acc, z: F.struct(((z["r"] + gamma * acc["run"]) * z["m"]).alias("run"), F.array_append(acc["out"], z["r"] + gamma * acc["run"]).alias("out")),
        lambda acc: acc["out"],
    )
    return F.reverse(step)


def reverse_cumsum(values: Column) -> Column:
    return F.reverse(
        F.aggregate(
            F.reverse(values),
            F.struct(F.lit(0.0).alias("run"), F.array().cast("array<double>").alias("out")),
            lambda acc, x: F.struct((acc["run"] + x).alias("run"), F.array_append(acc["out"], acc["run"] + x).alias("out")),
            lambda acc: acc["out"],
        )
    )


def gae(rewards: Column, values: Column, mask: Column, gamma: float = 1.0, lam: float = 1.0) -> Column:
    """Generalised advantages before whitening; masked positions carry the next value and advantage on."""
    zero = F.lit(0.0)

    def step(acc, z):
        delta = z["r"] + gamma * acc["next"] - z["v"]
        run = delta + gamma * lam * acc["run"]
        on = z["m"] > 0
        kept = F.when(on, run).otherwise(acc["run"])
        return F.struct(F.when(on, z["v"]).otherwise(acc["next"]).alias("next"), kept.alias("run"), F.array_append(acc["out"], kept).alias("out"))

    start = F.struct(zero.alias("next"), zero.alias("run"), F.array().cast("array<double>").alias("out"))
    return F.reverse(F.aggregate(F.reverse(F.arrays_zip(rewards.alias("r"), values.alias("v"), mask.alias("m"))), start, step, lambda acc: acc["out"]))


def kl(logp: Column, ref: Column, kind: str = "k1") -> Column:
    """Per-token KL estimates: k1, abs, k2 (squared half), k3 (low variance, clamped)."""
    d = logp - ref
    if kind == "k1":
        return d
    if kind == "abs":
        return F.abs(d)
    if kind == "k2":
        return F.lit(0.5) * d * d
    if kind == "k3":
        e = F.greatest(F.least(-d, F.lit(20.0)), F.lit(-20.0))
        return F.greatest(F.least(F.exp(e) - e - 1, F.lit(10.0)), F.lit(-10.0))
    raise ValueError(f"no such KL estimate: {kind}")


def pad(tokens: Column, size: int, value, left: bool = False) -> Column:
    """tokens padded to size; longer ones stay."""
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(0), F.lit(size) - F.size(tokens)))
    return F.concat(fill, tokens) if left else F.concat(tokens, fill)


def truncate(tokens: Column, size: int, side: str = "right") -> Column:
    """At most size tokens: the right end cut, the left end cut, the middle cut, or an error."""
    n = F.size(tokens)
    if side == "right":
        return F.slice(tokens, 1, size)
    if side == "left":
        return F.when(n > size, F.slice(tokens, n - size + 1, F.lit(size))).otherwise(tokens)
    if side == "middle":
        head = size // 2
        tail = size - head
        return F.when(n > size, F.concat(F.slice(tokens, 1, head), F.slice(tokens, n - tail + 1, F.lit(tail)))).otherwise(tokens)
    if side == "error":
        return F.when(n > size, F.raise_error(F.concat(F.lit("sequence of "), n.cast("string"), F.lit(f" tokens; {size} at most"))).cast("array<string>")).otherwise(tokens)
    raise ValueError(f"no such side: {side}")


def sft_loss_mask(prompt: Column, response: Column) -> Column:
    """0 on the prompt, 1 on the response but for its last token."""
    p, n = F.size(prompt), F.size(prompt) + F.size(response)
    return F.transform(F.sequence(F.lit(1), n), lambda i: ((i > p) & (i < n)).cast("int"))


def response_mask(attention: Column, response: Column) -> Column:
    """The attention mask's part on the response."""
    return F.slice(attention, F.size(attention) - F.size(response) + 1, F.size(response))


def position_ids(mask: Column) -> Column:
    return F.transform(mask, lambda m, i: i * m)


def until_eos(tokens: Column, eos: Column) -> Column:
    """1 up to and with the first end token, 0 after it."""
    at = F.array_position(tokens, eos)
    return F.transform(tokens, lambda _, i: ((at == 0) | (i < at)).cast("int"))
