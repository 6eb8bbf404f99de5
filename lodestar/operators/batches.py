"""Batches as tables: concatenation with metadata, resampling, collation, selection, slices, splits, rate limits and joins by time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import ROUND_HALF_EVEN, Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .samples import with_position


# --- concatenation, repetition, collation

def concat_batches(batches: Sequence[tuple[DataFrame, Mapping]]) -> tuple[DataFrame, dict]:
    """Rows of all batches under each other, and their metadata: metrics gathered in lists, other entries must agree.

    Columns that a batch lacks are null; a `metrics` entry is a mapping of numbers, or a list of such.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [b.select("*") for b, _ in batches])
    meta: dict = {}
    metrics: dict[str, list] = {}
    for _, own in batches:
        for name, value in own.items():
            if name == "metrics":
                for m in value if isinstance(value, list) else [value]:
                    for k, v in m.items():
                        metrics.setdefault(k, []).append(v)
            elif meta.setdefault(name, value) != value:
                raise ValueError(f"metadata {name} differs: {meta[name]!r} and {value!r}")
    return rows, meta | ({"metrics": metrics} if metrics else {})


def concat_repeated(parts: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """Each part's rows as often as its number says, with copy, 0-based; 0 leaves a part out."""
    each = [rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) for rows, n in parts if n > 0]
    return reduce(DataFrame.unionByName, each) if each else parts[0][0].withColumn("copy", F.lit(0)).limit(0)


def collate(rows: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Rows to columns of lists: one row a key, each column an array in order (nulls kept)."""
    listed = F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order])))
    return rows.groupBy(key).agg(listed.alias("l_")).select(key, *[F.col(f"l_.{c}").alias(c) for c in columns])


def scatter(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """collate() undone: one row a place of arrays of one length."""
    others = [c for c in rows.columns if c not in columns]
    return rows.select(*others, F.posexplode(F.arrays_zip(*columns)).alias("place", "z_")).select(*others, "place", *[F.col(f"z_.{c}").alias(c) for c in columns])


def union_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of either side, with which sides have them."""
    sides = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    both = sides(left, "in_left").join(sides(right, "in_right"), key, "full_outer")
    return both.select(key, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("in_left", "in_right")])


def common_and_only(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct rows that both have, and those that only the left one has."""
    return left.intersect(right), left.subtract(right)


# --- resampling

def unit(*parts: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the md5 of the parts and a seed: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed)))), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def resample(rows: DataFrame, position: str, weight: str, n: int | None = None, seed: int = 0) -> DataFrame:
    """n rows (as many as there are, by default) drawn with replacement in proportion to weight: draw and the row.

    Weights are summed in order of position by partition offsets; draws are joined to the row whose share they fall in by equal
    buckets of the whole, a share's buckets being those that it overlaps. An error where no weight is positive.
    """
    placed = with_position(rows.withColumn(weight, F.coalesce(F.greatest(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))), position)
    blocks = placed.withColumn("block_", F.floor(F.col("position") / 4096))
    sums = blocks.groupBy("block_").agg(F.sum(weight).alias("held_"))
    before = sums.withColumn("before_", F.coalesce(F.sum("held_").over(Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("held_")
    high = F.col("before_") + F.sum(weight).over(Window.partitionBy("block_").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    shares = blocks.join(before, "block_").withColumn("high_", high).withColumn("low_", F.col("high_") - F.col(weight)).filter(F.col(weight) > 0)
    count, total = rows.agg(F.count("*"), F.sum(F.greatest(F.col(weight).cast("double"), F.lit(0.0)))).first()
    n = count if n is None else n
    if n and not (total or 0) > 0:
        raise ValueError("no weight is positive")
    buckets = max(1, n)
    drawn = rows.sparkSession.range(n).select(F.col("id").alias("draw"), (unit(F.col("id"), seed=seed) * (total or 0.0)).alias("at_"))
    bucket = lambda x: F.least(F.greatest(F.floor(x / F.lit(total or 1.0) * buckets), F.lit(0)), F.lit(buckets - 1))
    drawn = drawn.withColumn("bucket_", bucket(F.col("at_")))
    spread = shares.withColumn("bucket_", F.explode(F.sequence(bucket(F.col("low_")), bucket(F.col("high_")))))
    met = drawn.join(spread, "bucket_").filter((F.col("at_") >= F.col("low_")) & (F.col("at_") < F.col("high_")))
    # rounding of sums may leave two neighbours for a draw: the first counts
    first = met.groupBy("draw").agg(F.min_by(F.struct(*[met[c] for c in rows.columns]), "position").alias("r_"))
    return first.select("draw", "r_.*")


# --- selection

def project(rows: DataFrame, keep: Sequence[str] | None = None, drop: Sequence[str] = (), rename: Mapping[str, str] | None = None) -> DataFrame:
    """Columns kept, dropped and renamed; a name that is not there is an error."""
    missing = [c for c in [*(keep or ()), *drop, *(rename or ())] if c not in rows.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    names = [c for c in (keep if keep is not None else rows.columns) if c not in drop]
    return rows.select(*[F.col(c).alias((rename or {}).get(c, c)) for c in names])


def pop(rows: DataFrame, columns: Sequence[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(the columns with the key, the rest with the key)."""
    return project(rows, [key, *[c for c in columns if c != key]]), project(rows, drop=[c for c in columns if c != key])


def nested(rows: DataFrame, path: Sequence[str], column: str) -> Column:
    """The value under a path of keys in a struct column; arrays of one element on the way are that element."""
    kind, at = rows.schema[column].dataType, F.col(column)
    for key in [*path, None]:
        while kind.typeName() == "array":
            at, kind = F.when(F.size(at) == 1, F.element_at(at, 1)), kind.elementType
        if key is not None:
            at, kind = at[key], kind[key].dataType
    return at


def plain_lists(json: Column, kind: str) -> Column:
    """A nested value held as JSON as typed arrays and structs; null where it is malformed."""
    return F.from_json(json, kind)


def not_empty(column: str) -> Column:
    return F.length(F.coalesce(F.col(column), F.lit(""))) > 0


def within_dates(column: str, low: str, high: str) -> Column:
    """ISO dates compared as text: low <= date < high."""
    return (F.col(column) >= low) & (F.col(column) < high)


def take_mask(rows: DataFrame, mask: Column) -> DataFrame:
    return rows.filter(F.coalesce(mask, F.lit(False)))


def take_slice(rows: DataFrame, position: str, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows start, start + step .. before stop, by 0-based position; negative bounds count from the end."""
    if step < 1:
        raise ValueError("a step is 1 at least")
    if start < 0 or (stop is not None and stop < 0):
        n = rows.count()
        start, stop = max(0, start + n) if start < 0 else start, max(0, stop + n) if stop is not None and stop < 0 else stop
    at = F.col(position)
    kept = (at >= start) & ((at - start) % step == 0)
    return rows.filter(kept if stop is None else kept & (at < stop))


def split_slice(rows: DataFrame, order: str, spec: str, halves: str = ROUND_HALF_EVEN) -> DataFrame:
    """A split expression such as [:75%], [-25%:] or [10:20] over rows in order; percent bounds are rounded to whole rows.

    halves is decimal's rounding: to even, or ROUND_HALF_UP, away from zero as SQL does.
    """
    inner = spec.strip()[1:-1] if spec.strip().startswith("[") else spec
    low, _, high = inner.partition(":")
    placed = with_position(rows, order)
    n = placed.count()

    def bound(x: str, default: int) -> int:
        if not x.strip():
            return default
        at = int((Decimal(x.strip()[:-1]) * n / 100).to_integral_value(halves)) if x.strip().endswith("%") else int(x)
        return min(n, max(0, at + n if x.strip().startswith("-") else at))

    return placed.filter((F.col("position") >= bound(low, 0)) & (F.col("position") < bound(high, n)))


# --- sinks

def insert_batches(rows: DataFrame, path: str, position: str, size: int = 500) -> DataFrame:
    """Appends rows to a table partitioned by batches of `size` by position; returns batch and its number of rows."""
    marked = rows.withColumn("batch", F.floor(F.col(position) / size).cast("int"))
    marked.write.mode("append").partitionBy("batch").parquet(path)
    return rows.sparkSession.read.parquet(path).groupBy("batch").agg(F.count("*").alias("n"))


def write_shards(rows: DataFrame, path: str, position: str, shards: int, transform) -> DataFrame:
    """Row i goes to shard i mod `shards`, is transformed there and written; read back the shards in order are the merge.

    No shard is padded to the others' length, so no row is written twice.
    """
    dealt = rows.withColumn("shard", (F.col(position) % shards).cast("int"))
    transform(dealt).write.mode("overwrite").partitionBy("shard").parquet(path)
    return rows.sparkSession.read.parquet(path)


def save_with_meta(rows: DataFrame, path: str, meta: Mapping[str, str]) -> None:
    """A table and its metadata, a row of JSON beside it: count and schema are added."""
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    n = rows.sparkSession.read.parquet(f"{path}/rows").count()
    named = rows.sparkSession.range(1).select(*[F.lit(str(v)).alias(k) for k, v in meta.items()], F.lit(n).alias("count"), F.lit(rows.schema.simpleString()).alias("schema"))
    named.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_with_meta(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The table and its metadata; an error where the rows are not those that were saved."""
    rows, meta = spark.read.parquet(f"{path}/rows"), spark.read.json(f"{path}/meta").first().asDict()
    if rows.schema.simpleString() != meta["schema"] or rows.count() != meta["count"]:
        raise ValueError(f"{path} is not what was saved")
    return rows, meta


# --- rate limits

def token_bucket(requests: DataFrame, key: str, time: str, tokens: str, rate: float, most: float) -> DataFrame:
    """requests with wait and level: how long each waits for a bucket that refills by elapsed time, and what is left then.

    A bucket starts full and holds `most`; requests are served in order of time, those of a key by one bucket. A request larger
    than the bucket is let through from a full one, whose level is negative after it. A key's requests are one array.
    """
    listed = F.array_sort(F.collect_list(F.struct(F.col(time).cast("double").alias("t"), F.col(tokens).cast("double").alias("k"), F.struct(*[c for c in requests.columns if c != key]).alias("row"))))

    def serve(state: Column, r: Column) -> Column:
        now = F.greatest(r["t"], state["at"])
        level = F.least(F.lit(float(most)), state["level"] + (now - state["at"]) * rate)
        wait = F.greatest(F.lit(0.0), (F.least(r["k"], F.lit(float(most))) - level) / rate)
        after = level + wait * rate - r["k"]
        served = F.struct(r["row"].alias("row"), (now + wait - r["t"]).alias("wait"), after.alias("level"))
        return F.struct((now + wait).alias("at"), after.alias("level"), F.array_append(state["out"], served).alias("out"))

    kind = requests.groupBy(key).agg(listed.alias("l")).schema["l"].dataType.elementType["row"].dataType.simpleString()
    start = F.struct(F.lit(0.0).alias("at"), F.lit(float(most)).alias("level"), F.array().cast(f"array<struct<row: {kind}, wait: double, level: double>>").alias("out"))
    served = requests.groupBy(key).agg(F.aggregate(listed, start, serve, lambda s: s["out"]).alias("out"))
    return served.select(key, F.explode("out").alias("o")).select(key, "o.row.*", "o.wait", "o.level")


# --- joins by time

def as_of(left: DataFrame, right: DataFrame, key: str, time: str, columns: Sequence[str]) -> DataFrame:
    """left with the columns of the latest row of right of its key at or before its time: one union and one window, no range join."""
    a = left.select(F.col(key), F.col(time), F.lit(1).alias("side_"), F.struct(*left.columns).alias("l_"), F.lit(None).cast(right.select(F.struct(*columns).alias("r")).schema["r"].dataType).alias("r_"))
    b = right.select(F.col(key), F.col(time), F.lit(0).alias("side_"), F.lit(None).cast(a.schema["l_"].dataType).alias("l_"), F.struct(*columns).alias("r_"))
    seen = Window.partitionBy(key).orderBy(time, "side_").rowsBetween(Window.unboundedPreceding, 0)
    filled = a.unionByName(b).withColumn("last_", F.last("r_", ignorenulls=True).over(seen)).filter("side_ = 1")
    return filled.select("l_.*", *[F.col(f"last_.{c}").alias(f"as_of_{c}") for c in columns])


def interval_join(points: DataFrame, spans: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """points with the spans that hold them, low <= at < high: an equi-join on buckets of `width`, then the exact test."""
    p = points.withColumn("bucket_", F.floor(F.col(at) / width))
    s = spans.filter(F.col(high) > F.col(low)).withColumn("bucket_", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(s, "bucket_").filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("bucket_")
