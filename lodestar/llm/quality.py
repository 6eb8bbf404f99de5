"""Quality rules: robust multivariate outliers.

Statistics of every whole text are transformed into seven numbers: the logarithm of the mean word length; square roots of the
shares of symbols, of repeated lines, of words in repeated windows, of punctuation and of capitals; and the ratio of the logarithms
of distinct and of all words. Minimum-covariance-determinant estimates per language and source come from concentration steps
over all rows: distances to the present estimate, the h-th smallest distance of each group, then mean and covariance of the
rows below it. Each group has several starts (medians, and small subsets drawn by hash); the start of the least determinant
goes on until its determinant falls no more. A document is rejected where its squared Mahalanobis distance is beyond the
chi-square quantile. Each step aggregates partially before its shuffle, so a hot source is one small row a task.

Symbols, repeats and repeated lines are exactly none in most texts, so their covariance would be singular: the diagonal gets a
floor (FLOORS) that says what such a share may vary by in clean text. The other numbers' floors only keep the matrix regular, their
estimates decide. Groups of fewer than MIN_ROWS rows are estimated together, by language and, if those are still few, all
together. Quantiles of distances are Spark's approximate ones.

Defined cases: a null text has no words and fails the base rules; null languages and sources are groups of their own;
repeated rows count as often as they occur and get the same verdict; an empty table gives an empty result. Added columns
replace input columns of the same names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, materialize, packed, small, table

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEATED = 50, 50  # words; percent of words
PUNCTUATION = b".,;:!?"
CAPITALS = bytes(range(65, 91))
#: Standard deviations added to the seven numbers' own: word length, symbols, repeated lines and windows, punctuation, capitals, distinct words.
FLOORS = (0.005, 0.03, 0.12, 0.12, 0.005, 0.005, 0.003)
H = 0.75  # share of a group's rows that the estimate rests on
STARTS, FIRST_STEPS, MOST_STEPS = 4, 2, 30
SETTLED = 0.01  # a fall of the logarithm of the determinant that is none: a thousandth of each deviation
TAIL = 1e-8  # chance that normal data are beyond the cutoff; texts have longer tails than normal data
MIN_ROWS = 100
P = len(FLOORS)
STAT_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_punctuation", "n_capitals", "n_types")


def text_stats(text: str | None) -> tuple[int, ...]:
    """STAT_COLUMNS of one whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    chars = len(text or "") - (len(data) - len(data.translate(None, SPACES)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeats = 0
    if n > 3:
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
        first = ids[:-1] * len(seen) + ids[1:]
        if len(seen) > 2_000_000:
            first = np.unique(first, return_inverse=True)[1]
        windows = first[:-1] * len(seen) + ids[2:]
        order = np.argsort(windows)
        same = windows[order][1:] == windows[order][:-1]
        if same.any():
            again = np.zeros(n - 2, bool)
            again[order[1:][same]] = again[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            covered[:-2] |= again
            covered[1:-1] |= again
            covered[2:] |= again
            repeats = int(covered.sum())
    marks, capitals = (len(data) - len(data.translate(None, x)) for x in (PUNCTUATION, CAPITALS))
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, len(lines), marks, capitals, len(set(words))


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in STAT_COLUMNS]))
def _stats(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(np.array([text_stats(t) for t in texts], np.int64).reshape(-1, len(STAT_COLUMNS)), columns=STAT_COLUMNS)


def with_stats(docs: DataFrame) -> DataFrame:
    """docs with a struct column `stats_` and the transformed numbers in an array `x_`."""
    stats = docs.withColumn("stats_", _stats.asNondeterministic()("text"))
    least = lambda c, k: F.greatest(F.col(f"stats_.{c}"), F.lit(k))
    share = lambda a, b: F.sqrt(F.col(f"stats_.{a}") / least(b, 1))
    length = F.log(F.greatest(F.col("stats_.word_chars") / least("n_words", 1), F.lit(0.1)))
    shares = [share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_punctuation", "n_words"), share("n_capitals", "n_words")]
    return stats.withColumn("x_", F.array(length, *shares, F.log(least("n_types", 1)) / F.log(least("n_words", 2))))


def base_failed() -> Column:
    return (F.col("stats_.n_words") < MIN_WORDS) | (100 * F.col("stats_.n_repeat_words") > MAX_REPEATED * F.col("stats_.n_words"))


def chi_square_below(x: float, k: int) -> float:
    """The chi-square distribution of k degrees of freedom, by the series of the incomplete gamma function."""
    a, y = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-17:
        n += 1
        term *= y / (a + n)
        total += term
    return total * math.exp(a * math.log(y) - y - math.lgamma(a)) if x > 0 else 0.0


def chi_square_quantile(share: float, k: int) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_below(mid, k) < share else (lo, mid)
    return lo


def consistency(h: float, k: int = P) -> float:
    """What the covariance of the h closest rows is multiplied by to be that of normal data."""
    return h / chi_square_below(chi_square_quantile(h, k), k + 2)


CUTOFF = chi_square_quantile(1 - TAIL, P)


def distance(x: str = "x_", centre: str = "centre", precision: str = "precision") -> Column:
    """Squared Mahalanobis distance of an array column, precision being the inverse covariance row by row."""
    d = [F.col(x)[i] - F.col(centre)[i] for i in range(P)]
    return sum((F.col(precision)[P * i + j] * d[i] * d[j] for i in range(P) for j in range(P)), F.lit(0.0))


def _estimate(moments: DataFrame) -> DataFrame:
    """Rows of key_, start, n, sums, products and before -> key_, start, centre, precision, its determinant, and before; numpy over one row a group."""
    factor, floors = consistency(H), np.diag(np.square(FLOORS))

    def run(frames):
        for f in frames:
            centre, precision, logdet = [], [], []
            for n, s, p in zip(f["n"], f["sums"], f["products"]):
                m = np.array(s) / n
                cov = np.array(p).reshape(P, P) / n - np.outer(m, m)
                whole = factor * (cov + cov.T) / 2 + floors
                centre.append(m.tolist())
                precision.append(np.linalg.inv(whole).ravel().tolist())
                logdet.append(float(np.linalg.slogdet(whole)[1]))
            yield pd.DataFrame({"key_": f["key_"], "start": f["start"], "centre": centre, "precision": precision, "logdet": logdet, "before": f["before"]})

    return moments.mapInPandas(run, "key_ string, start int, centre array<double>, precision array<double>, logdet double, before double")


def _moments(rows: DataFrame) -> DataFrame:
    """key_, start, x_ rows -> what _estimate() takes, but before."""
    sums = [F.sum(F.col("x_")[i]).alias(f"s{i}") for i in range(P)]
    products = [F.sum(F.col("x_")[i] * F.col("x_")[j]).alias(f"p{i}_{j}") for i in range(P) for j in range(i, P)]
    whole = rows.groupBy("key_", "start").agg(F.count("*").alias("n"), *sums, *products)
    return whole.select("key_", "start", "n", F.array(*[f"s{i}" for i in range(P)]).alias("sums"), F.array(*[f"p{min(i, j)}_{max(i, j)}" for i in range(P) for j in range(P)]).alias("products"))


def _starts(x: DataFrame) -> DataFrame:
    """The starting estimates of each group: its medians with the floors, and subsets of P + 1 rows each, drawn by hash."""
    medians = x.groupBy("key_").agg(*[F.percentile_approx(F.col("x_")[i], 0.5).alias(f"m{i}") for i in range(P)])
    # a spread of some tenths in every direction: the first step takes the rows nearest to the medians
    wide = [1.0 / (f + 0.05) ** 2 if i == j else 0.0 for i, f in enumerate(FLOORS) for j in range(P)]
    none = F.lit(None).cast("double")
    middle = medians.select("key_", F.lit(0).alias("start"), F.array(*[f"m{i}" for i in range(P)]).alias("centre"), F.array(*map(F.lit, wide)).alias("precision"), none.alias("logdet"), none.alias("before"))
    drawn = [F.min_by("x_", F.xxhash64("x_", F.lit(100 * s + k))).alias(f"d{s}_{k}") for s in range(1, STARTS) for k in range(P + 1)]
    subsets = x.groupBy("key_").agg(*drawn).select("key_", F.explode(F.array(*[F.struct(F.lit(s).alias("start"), F.array(*[f"d{s}_{k}" for k in range(P + 1)]).alias("rows")) for s in range(1, STARTS)])).alias("s"))
    rows = subsets.select("key_", "s.start", F.explode("s.rows").alias("x_"))
    return middle.unionByName(_estimate(_moments(rows).withColumn("before", none)))


def _step(x: DataFrame, now: DataFrame, put) -> DataFrame:
    """A concentration step of every start of every group; put writes tables of a row a group and start."""
    far = x.join(now, "key_").select("key_", "start", "x_", distance().alias("d"), "logdet")
    within = put(far.groupBy("key_", "start").agg(F.percentile_approx("d", H).alias("most"), F.first("logdet").alias("before")), "quality-within")
    near = far.join(within.drop("before"), ["key_", "start"]).filter("d <= most")
    return put(_estimate(_moments(near).join(within.select("key_", "start", "before"), ["key_", "start"])), "quality-estimate")


def keys(rows: DataFrame) -> DataFrame:
    """(lang, source) -> key_, the name of the group whose estimate counts: own, the language's small groups, or all small ones."""
    counts = materialize(rows.groupBy("lang", "source").agg(F.count("*").alias("n")), "quality-counts")
    quoted = lambda c: F.coalesce(F.to_json(F.struct(F.col(c))), F.lit("{}"))
    few = counts.filter(F.col("n") < MIN_ROWS).groupBy("lang").agg((F.sum("n") >= MIN_ROWS).alias("enough")).withColumnRenamed("lang", "few_lang")
    joined = counts.join(few, counts["lang"].eqNullSafe(few["few_lang"]), "left")
    return joined.select(F.col("lang").alias("key_lang"), F.col("source").alias("key_source"), F.when(F.col("n") >= MIN_ROWS, F.concat_ws("|", quoted("lang"), quoted("source"))).when(F.col("enough"), F.concat_ws("|", quoted("lang"), F.lit("*"))).otherwise(F.lit("*")).alias("key_"))


def estimates(rows: DataFrame) -> DataFrame:
    """rows: lang, source, x_ -> key_lang, key_source, centre, precision, one row a language and source."""
    named = materialize(keys(rows), "quality-keys")
    few = named.count() * STARTS <= BROADCAST_ROWS  # counted: a row a language and source, in one file and broadcast where they are few

    def put(df: DataFrame, name: str) -> DataFrame:
        return F.broadcast(materialize(df.coalesce(1), name)) if few else materialize(df, name)

    named = F.broadcast(named) if few else named
    x = rows.join(named, rows["lang"].eqNullSafe(named["key_lang"]) & rows["source"].eqNullSafe(named["key_source"])).select("key_", "x_")
    x = materialize(x, "quality-x")
    now = put(_starts(x), "quality-starts")
    for _ in range(FIRST_STEPS):
        now = _step(x, now, put)
    best = now.groupBy("key_").agg(F.min_by(F.struct("start", "centre", "precision", "logdet", "before"), F.struct("logdet", "start")).alias("b"))
    now = put(best.select("key_", "b.*"), "quality-best")
    for _ in range(MOST_STEPS):
        now = _step(x, now, put)
        if now.filter(F.col("before") - F.col("logdet") > SETTLED).isEmpty():
            break
    return materialize(named.join(now, "key_").select("key_lang", "key_source", "centre", "precision"), "quality-final")


def judge(stats: DataFrame) -> DataFrame:
    """Rows of with_stats() with base_failed and kept. Rows that fail the base rules do not enter the estimates."""
    found = small(estimates(stats.filter(~base_failed()).select("lang", "source", "x_")))
    joined = stats.join(found, stats["lang"].eqNullSafe(found["key_lang"]) & stats["source"].eqNullSafe(found["key_source"]), "left")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(distance() <= CUTOFF, F.lit(True)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass the base rules and are no outliers, as they came."""
    bare = with_stats(docs.select("lang", "source", "text")).select("lang", "source", "stats_", "x_")
    found = small(estimates(bare.filter(~base_failed()).select("lang", "source", "x_")))
    every = with_stats(packed(docs, "lang", "source", "text"))
    joined = every.join(found, every["lang"].eqNullSafe(found["key_lang"]) & every["source"].eqNullSafe(found["key_source"]), "left")
    return joined.filter(~base_failed() & F.coalesce(distance() <= CUTOFF, F.lit(True))).select("row_.*")


def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    stats = materialize(with_stats(docs).select("doc_id", "lang", "source", "stats_", "x_"), "quality-stats")
    return judge(stats).select("doc_id", *[f"stats_.{c}" for c in STAT_COLUMNS[:5]], "base_failed", "kept")
