"""Queries on batches: concatenation, resampling, collation, selection, slices, sinks with metadata, rate limits, joins by time."""

from __future__ import annotations

from decimal import ROUND_HALF_UP

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import grading as G
from ..functions import text as T
from ..operators import batches as B
from ..operators import lexical, samples, stats
from ..operators import recipes as R
from ..operators import reshape as S
from ..sources import jsonl
from ..sources.scratch import scratch_path
from .base import query, r6, table
from .rollouts import ROLL, SEQ, exploded, roll, sequences

# --- concatenation, repetition, collation

@query("concat_batches", "SELECT n_nationkey AS id, n_name AS name, NULL::BIGINT AS region, '[1.5, 2.5]' AS loss FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey, n_name, n_regionkey, '[1.5, 2.5]' FROM nation WHERE n_nationkey >= 20")
def concat_batches(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))
    rows, meta = B.concat_batches([(n.filter("id < 10").drop("region"), {"step": 3, "metrics": {"loss": 1.5}}), (n.filter("id >= 20"), {"step": 3, "metrics": [{"loss": 2.5}]})])
    return rows.withColumn("loss", F.lit(str(meta["metrics"]["loss"])))


@query("concat_repeated", "SELECT n_nationkey AS id, c AS copy FROM nation, range(4) t(c) WHERE n_nationkey < 5 UNION ALL SELECT r_regionkey + 100, c FROM region, range(2) t(c)")
def concat_repeated(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id")).filter("id < 5")
    r = table(spark, sf, "region").select((F.col("r_regionkey") + 100).cast("long").alias("id"))
    return B.concat_repeated([(n, 4), (r, 2), (r, 0)]).select("id", F.col("copy").cast("long").alias("copy"))


@query("collate_columns", "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, string_agg(md5(text), ',' ORDER BY turn) AS texts FROM conversations GROUP BY conv_id")
def collate_columns(spark, sf):
    got = B.collate(table(spark, sf, "conversations"), "conv_id", "turn", ["role", "text"])
    return got.select("conv_id", F.array_join("role", ",").alias("roles"), F.array_join(F.transform("text", F.md5), ",").alias("texts"))


@query("scatter_columns", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, role FROM conversations")
def scatter_columns(spark, sf):
    got = B.scatter(B.collate(table(spark, sf, "conversations"), "conv_id", "turn", ["role"]), ["role"])
    return got.select("conv_id", F.col("place").cast("long").alias("place"), "role")


@query("union_keys", "SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS in_left, b.k IS NOT NULL AS in_right FROM (SELECT DISTINCT event_id % 70 AS k FROM events) a FULL JOIN (SELECT DISTINCT event_id % 90 + 30 AS k FROM events) b ON a.k = b.k")
def union_keys(spark, sf):
    e = table(spark, sf, "events")
    return B.union_keys(e.select((F.col("event_id") % 70).alias("k")), e.select((F.col("event_id") % 90 + 30).alias("k")), "k")


@query("common_rows", "SELECT source, lang FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT source, lang FROM documents WHERE doc_id % 3 = 0")
def common_rows(spark, sf):
    d = table(spark, sf, "documents")
    return B.common_and_only(d.filter("doc_id % 2 = 0").select("source", "lang"), d.filter("doc_id % 3 = 0").select("source", "lang"))[0]


@query("only_rows", "SELECT doc_id % 500 AS k FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT doc_id % 500 FROM documents WHERE doc_id % 3 = 0")
def only_rows(spark, sf):
    k = (F.col("doc_id") % 500).alias("k")
    d = table(spark, sf, "documents")
    return B.common_and_only(d.filter("doc_id % 2 = 0").select(k), d.filter("doc_id % 3 = 0").select(k))[1]


# --- resampling and group statistics

@query("resample_rows", "WITH w AS (SELECT n_nationkey AS id, n_nationkey % 4 AS w FROM nation), c AS (SELECT *, sum(w) OVER (ORDER BY id) AS high FROM w), d AS (SELECT i AS draw, ('0x' || substr(md5(i || '|3'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 * (SELECT sum(w) FROM w) AS x FROM range(300) t(i)) SELECT draw, id FROM d JOIN c ON w > 0 AND x >= high - w AND x < high")
def resample_rows(spark, sf):
    """Draws with replacement; the number of draws is a parameter of the operator."""
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey") % 4).alias("w"))
    return B.resample(rows, "id", "w", 300, seed=3).select("draw", "id")


@query("group_index", "SELECT event_id % 37 + 5 AS label, event_id % 37 + 5 AS index FROM events GROUP BY ALL")
def group_index(spark, sf):
    """Floats near whole numbers are those numbers; labels of other kinds are tested by hand."""
    rows = table(spark, sf, "events").select(((F.col("event_id") % 37) + 5 + 1e-8).alias("label"))
    return stats.group_index(rows, "label").select(F.rint("label").cast("long").alias("label"), "index")


@query("outcome_shares", "SELECT count(*) AS total, count(*) FILTER (WHERE quality = 1) AS success, count(*) FILTER (WHERE quality IS DISTINCT FROM 1) AS failure, round(100.0 * count(*) FILTER (WHERE quality = 1) / count(*), 6)::DOUBLE AS success_pct, round(100.0 * count(*) FILTER (WHERE quality IS DISTINCT FROM 1) / count(*), 6)::DOUBLE AS failure_pct FROM labels")
def outcome_shares(spark, sf):
    got = stats.outcome_shares(table(spark, sf, "labels"), F.col("quality") == 1)
    return got.select("total", "success", "failure", r6("success_pct").alias("success_pct"), r6("failure_pct").alias("failure_pct"))


@query("source_cube", "SELECT lang, source, count(*) AS n, count(DISTINCT n_chars) AS sizes FROM documents GROUP BY CUBE (lang, source)")
def source_cube(spark, sf):
    return table(spark, sf, "documents").cube("lang", "source").agg(F.count("*").alias("n"), F.count_distinct("n_chars").alias("sizes"))


@query("window_ranks", f"WITH {ROLL} SELECT row_id, ntile(4) OVER (PARTITION BY uid ORDER BY row_id)::INT AS quarter, round(score - lag(score) OVER (PARTITION BY uid ORDER BY row_id), 6) AS change, round(percent_rank() OVER (PARTITION BY uid ORDER BY score), 6) AS share, count(*) OVER (PARTITION BY uid ORDER BY row_id RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS near FROM roll")
def window_ranks(spark, sf):
    w = Window.partitionBy("uid").orderBy("row_id")
    return roll(spark, sf).select("row_id", F.ntile(4).over(w).alias("quarter"), r6(F.col("score") - F.lag("score").over(w)).alias("change"), r6(F.percent_rank().over(Window.partitionBy("uid").orderBy("score"))).alias("share"), F.count("*").over(w.rangeBetween(-500, 0)).alias("near"))


# --- selection

@query("project_columns", "SELECT n_nationkey AS id, n_name AS title FROM nation")
def project_columns(spark, sf):
    return B.project(table(spark, sf, "nation"), ["n_nationkey", "n_name", "n_regionkey"], ["n_regionkey"], {"n_nationkey": "id", "n_name": "title"})


@query("pop_columns", "SELECT n_nationkey, n_name FROM nation")
def pop_columns(spark, sf):
    return B.pop(table(spark, sf, "nation"), ["n_name"], "n_nationkey")[0]


@query("nested_paths", "SELECT item_id, md5(text) AS content FROM benchmark")
def nested_paths(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", F.struct(F.array(F.struct(F.lit("user").alias("role"), F.array("text").alias("content"))).alias("messages")).alias("prompt"))
    return rows.select("item_id", F.md5(B.nested(rows, ["messages", "content"], "prompt")).alias("content"))


@query("plain_lists", "SELECT event_id, props::JSON ->> 'k' AS k, 2 AS n FROM events")
def plain_lists(spark, sf):
    value = B.plain_lists(F.concat(F.lit("["), F.col("props"), F.lit(", {}]")), "array<struct<k: string>>")
    return table(spark, sf, "events").select("event_id", F.element_at(value, 1)["k"].alias("k"), F.size(value).alias("n"))


@query("label_filter", "SELECT event_id FROM events WHERE event_id % 3 <> 0")
def label_filter(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, F.lit(""))).otherwise("x").alias("label"))
    return rows.filter(B.not_empty("label")).select("event_id")


@query("date_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1996-07-01'")
def date_range(spark, sf):
    rows = table(spark, sf, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return rows.filter(B.within_dates("day", "1995-01-01", "1996-07-01")).select("o_orderkey")


@query("kind_filter", "SELECT event_id FROM events WHERE event_type = 'click'")
def kind_filter(spark, sf):
    return table(spark, sf, "events").filter(F.col("event_type") == "click").select("event_id")


@query("mask_slice", "SELECT n_nationkey FROM nation WHERE n_nationkey % 3 = 1 AND n_nationkey >= 5 AND n_nationkey < 23 AND (n_nationkey - 5) % 2 = 0")
def mask_slice(spark, sf):
    n = table(spark, sf, "nation")
    return B.take_mask(B.take_slice(n, "n_nationkey", 5, -2, 2), F.when(F.col("n_nationkey") % 3 == 1, True)).select("n_nationkey")


@query("split_slices", "WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents) SELECT doc_id, 'head' AS part FROM p WHERE p < round(n * 0.75) UNION ALL SELECT doc_id, 'tail' FROM p WHERE p >= n - round(n * 0.25) UNION ALL SELECT doc_id, 'some' FROM p WHERE p >= 10 AND p < 20")
def split_slices(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    part = lambda spec, name: B.split_slice(d, "doc_id", spec, ROUND_HALF_UP).select("doc_id", F.lit(name).alias("part"))
    return part("[:75%]", "head").unionByName(part("[-25%:]", "tail")).unionByName(part("[10:20]", "some"))


@query("query_head", "SELECT item_id, md5(left(text, 256)) AS q FROM benchmark")
def query_head(spark, sf):
    """A query is cut to 256 characters, as the operator says."""
    return table(spark, sf, "benchmark").select("item_id", F.md5(F.left("text", F.lit(256))).alias("q"))


@query("index_contents", "SELECT doc_id::VARCHAR AS id, md5(CASE WHEN doc_id % 4 = 0 THEN source ELSE text END) AS contents FROM documents WHERE CASE WHEN doc_id % 4 = 0 THEN length(trim(source)) ELSE length(trim(text, ' ')) END > 0")
def index_contents(spark, sf):
    """The first of contents, text and body that is not blank."""
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.lit("  ")).otherwise(F.col("text")).alias("contents"), F.when(F.col("doc_id") % 4 == 0, F.col("source")).alias("body"))
    return lexical.index_rows(d, "doc_id").select("id", F.md5("contents").alias("contents"))


# --- sinks

@query("insert_batches", "SELECT (i // 500)::INT AS batch, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) GROUP BY ALL")
def insert_batches(spark, sf):
    rows = samples.with_position(table(spark, sf, "events").select("event_id", "value"), "event_id")
    return B.insert_batches(rows, scratch_path(spark, "inserted"), "position", 500)


@query("sharded_transform", "SELECT vec_id, (vec_id % 4)::INT AS shard, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def sharded_transform(spark, sf):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return B.write_shards(rows, scratch_path(spark, "shards"), "vec_id", 4, lambda d: d.select("vec_id", "shard", r6(norm).alias("norm"))).select("vec_id", F.col("shard").cast("int").alias("shard"), "norm")


@query("persona_index", "SELECT item_id AS id, 'a reader of ' || item_id AS persona, 'hash' AS model, (SELECT count(*) FROM benchmark)::BIGINT AS count FROM benchmark")
def persona_index(spark, sf):
    path = scratch_path(spark, "persona-index")
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.concat(F.lit("a reader of "), F.col("item_id").cast("string")).alias("persona"))
    B.save_with_meta(rows, path, {"model": "hash", "metric": "ip"})
    got, meta = B.load_with_meta(spark, path)
    return got.withColumn("model", F.lit(meta["model"])).withColumn("count", F.lit(meta["count"]).cast("long"))


# --- rate limits and joins by time

BUCKET = """s AS (SELECT event_id, user_id, (event_id * 2)::DOUBLE AS t, (event_id % 5 * 30)::DOUBLE AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f(user_id, i, event_id, free, level, wait) AS (SELECT user_id, 0::BIGINT, NULL::BIGINT, 0.0::DOUBLE, 100.0::DOUBLE, 0.0::DOUBLE FROM s GROUP BY user_id
UNION ALL SELECT f.user_id, s.i, s.event_id, greatest(t, free) + greatest(0, (least(k, 100) - least(100, level + (greatest(t, free) - free) * 0.01)) / 0.01),
  least(100, level + (greatest(t, free) - free) * 0.01) + greatest(0, least(k, 100) - least(100, level + (greatest(t, free) - free) * 0.01)) - k,
  greatest(t, free) + greatest(0, (least(k, 100) - least(100, level + (greatest(t, free) - free) * 0.01)) / 0.01) - t FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1)"""


@query("token_bucket", f"WITH RECURSIVE {BUCKET} SELECT user_id, event_id, round(wait, 3) AS wait, round(level, 3) AS level FROM f WHERE i > 0")
def token_bucket(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") * 2).cast("double").alias("t"), (F.col("event_id") % 5 * 30).cast("double").alias("k"))
    got = B.token_bucket(e, "user_id", "t", "k", 0.01, 100.0)
    return got.select("user_id", "event_id", F.round("wait", 3).alias("wait"), F.round("level", 3).alias("level"))


@query("as_of_join", "SELECT a.event_id, b.event_id AS seen FROM events a ASOF LEFT JOIN (SELECT * FROM events WHERE event_id % 3 = 0) b ON a.user_id = b.user_id AND a.event_id >= b.event_id WHERE a.event_id % 3 <> 0")
def as_of_join(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("at"), "event_id")
    got = B.as_of(e.filter("event_id % 3 <> 0"), e.filter("event_id % 3 = 0"), "user_id", "at", ["event_id"])
    return got.select("event_id", F.col("as_of_event_id").alias("seen"))


@query("interval_join", "SELECT event_id, n_nationkey FROM events JOIN nation ON value >= n_nationkey * 7 AND value < n_nationkey * 7 + 10")
def interval_join(spark, sf):
    spans = table(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") * 7.0).alias("low"), (F.col("n_nationkey") * 7.0 + 10).alias("high"))
    return B.interval_join(table(spark, sf, "events").select("event_id", "value"), spans, "value", "low", "high", 10.0).select("event_id", "n_nationkey")


# --- recipes

TOKEN_RLOO = f"""{SEQ}, x AS (SELECT *, uid % 5 AS g, (uid % 3)::DOUBLE AS o, max(CASE WHEN m > 0 THEN pos END) OVER (PARTITION BY uid) AS last FROM tok),
u AS (SELECT uid, any_value(g) AS g, any_value(o) AS o, coalesce(avg(r) FILTER (WHERE m > 0), 0) AS mean FROM x GROUP BY uid), w AS (SELECT g, count(*) AS n, sum(mean) AS held, sum(o) AS os FROM u GROUP BY g),
t AS (SELECT uid, pos, CASE WHEN m > 0 AND n > 1 THEN 0.5 * (r * n - held) / (n - 1) + CASE WHEN pos = last THEN 2 * (o * n - os) / (n - 1) ELSE 0 END ELSE 0 END AS v FROM x JOIN w USING (g))"""


@query("token_rloo", f"WITH {TOKEN_RLOO} SELECT uid, pos::INT AS pos, round(sum(v) OVER (PARTITION BY uid ORDER BY pos DESC), 6) AS returns FROM t")
def token_rloo(spark, sf):
    rows = sequences(spark, sf).select("uid", "r", "m", (F.col("uid") % 5).alias("g"), (F.col("uid") % 3).cast("double").alias("o"))
    return exploded(R.token_rloo(rows, "g", "r", "m", "o", 0.5, 2.0), "returns", "returns")


@query("contrast_loss", f"WITH {ROLL}, o AS (SELECT row_id, score, acc, coalesce(CASE WHEN acc > 0 THEN (sum(score) FILTER (WHERE acc < 1) OVER (PARTITION BY uid)) / (count(*) FILTER (WHERE acc < 1) OVER (PARTITION BY uid)) ELSE (sum(score) FILTER (WHERE acc > 0) OVER (PARTITION BY uid)) / (count(*) FILTER (WHERE acc > 0) OVER (PARTITION BY uid)) END, 0) AS other FROM roll) SELECT row_id, round(ln(1 + exp(-2 * (score - other) * CASE WHEN acc > 0 THEN 1 ELSE -1 END)), 6) AS loss FROM o")
def contrast_loss(spark, sf):
    return R.contrast_loss(roll(spark, sf), 2.0).select("row_id", r6("loss").alias("loss"))


@query("sppo_loss", f"WITH {SEQ} SELECT uid, round(pow(sum((a - b) * m) - 0.5 * (uid % 4), 2), 6) AS loss FROM tok GROUP BY uid HAVING sum(m) > 0")
def sppo_loss(spark, sf):
    loss = R.sppo_loss(F.col("a"), F.col("b"), F.col("m"), F.col("uid") % 4, 0.5)
    return sequences(spark, sf).select("uid", r6(loss).alias("loss")).filter("loss IS NOT NULL")


@query("last_reply", "WITH l AS (SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'assistant') || CASE WHEN conv_id % 2 = 0 THEN ' #### 7' ELSE '' END, '') AS response FROM conversations GROUP BY conv_id), s AS (SELECT *, coalesce(list_extract(regexp_extract_all(right(response, 300), '#### (-?[0-9.,]+)', 1), -1) = '7', false) AS ok FROM l) SELECT conv_id, md5(response) AS response, ok::INT::DOUBLE AS reward, CASE WHEN ok THEN 'Your response is correct!' ELSE 'Your response is incorrect! You need to reflect on your answer and try again.' END AS reply, ok AS done FROM s")
def last_reply(spark, sf):
    turns = table(spark, sf, "conversations")
    last = F.max("turn").over(Window.partitionBy("conv_id", "role"))
    marked = turns.withColumn("text", F.when((F.col("conv_id") % 2 == 0) & (F.col("turn") == last) & (F.col("role") == "assistant"), F.concat("text", F.lit(" #### 7"))).otherwise(F.col("text")))
    truth = turns.select("conv_id", F.lit("7").alias("truth")).distinct()
    return R.last_reply(marked, truth, G.SCORERS["hash"]).withColumn("response", F.md5("response"))


# --- corpora, sinks and samples

def _corpus(spark, sf):
    """A corpus written as JSON lines: every fifth document twice, the later row with another text; a broken and a blank line."""
    path = scratch_path(spark, "corpus")
    d, i = table(spark, sf, "documents"), F.col("doc_id")
    vector = F.when(i % 3 != 0, F.array((i % 7).cast("float"), F.lit(1.0).cast("float")))
    line = lambda text: F.to_json(F.struct(i.cast("string").alias("id"), text.alias("contents"), vector.alias("embedding")))
    first, again = d.select(i, F.lit(0).alias("n"), line(F.col("text")).alias("value")), d.filter("doc_id % 5 = 0").select(i, F.lit(1).alias("n"), line(F.col("source")).alias("value"))
    bad = spark.range(2).select(F.lit(-1).cast("long").alias("doc_id"), F.lit(2).alias("n"), F.when(F.col("id") == 0, F.lit("{broken")).otherwise(F.lit("")).alias("value"))
    first.unionByName(again).unionByName(bad).coalesce(1).sortWithinPartitions("n", "doc_id").select("value").write.option("lineSep", "\n").text(path)
    return path


@query("corpus_scan", "SELECT doc_id::VARCHAR AS id, md5(CASE WHEN doc_id % 5 = 0 THEN source ELSE text END) AS contents FROM documents")
def corpus_scan(spark, sf):
    """The last row of an id counts; undecodable and blank lines go."""
    rows = spark.read.schema(f"{jsonl.CORPUS}, {jsonl.BAD} string").option("columnNameOfCorruptRecord", jsonl.BAD).json(_corpus(spark, sf))
    return jsonl.last_rows(rows.filter(F.col(jsonl.BAD).isNull() & F.col("id").isNotNull() & F.col("contents").isNotNull())).select("id", F.md5("contents").alias("contents"))


@query("corpus_vectors", "SELECT doc_id::VARCHAR AS id, (doc_id % 7)::DOUBLE AS x FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id::VARCHAR, (doc_id % 7)::DOUBLE FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 = 0")
def corpus_vectors(spark, sf):
    """Rows with an embedding, whatever their order; those without are skipped."""
    rows = spark.read.schema(jsonl.CORPUS).option("mode", "DROPMALFORMED").json(_corpus(spark, sf))
    return rows.filter("id IS NOT NULL AND embedding IS NOT NULL").select("id", F.col("embedding")[0].cast("double").alias("x"))


@query("single_file_sink", "SELECT n_nationkey, n_name, 1::BIGINT AS files FROM nation")
def single_file_sink(spark, sf):
    path = scratch_path(spark, "single")
    jsonl.write_single(table(spark, sf, "nation").select("n_nationkey", "n_name").repartition(4), path)
    rows = spark.read.parquet(path)
    files = rows.select(F.input_file_name().alias("f")).agg(F.count_distinct("f").alias("files"))
    return rows.join(F.broadcast(files), F.lit(True))


@query("merged_files", "SELECT n_nationkey, CASE WHEN n_nationkey >= 10 THEN n_name END AS n_name FROM nation")
def merged_files(spark, sf):
    """Parquet files of different columns read as one table."""
    path = scratch_path(spark, "merged")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    n.filter("n_nationkey < 10").drop("n_name").write.parquet(path)
    n.filter("n_nationkey >= 10").write.mode("append").parquet(path)
    return spark.read.option("mergeSchema", "true").parquet(path).select("n_nationkey", "n_name")


@query("vector_index_files", "SELECT vec_id AS id, label AS cluster, len(embedding)::INT AS dim FROM embeddings WHERE label IN (1, 2)")
def vector_index_files(spark, sf):
    """A vector index saved by cluster; the clusters asked for are the folders read."""
    path = scratch_path(spark, "vector-index")
    jsonl.save_vectors(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("cluster")), path, "cluster")
    return spark.read.parquet(path).filter(F.col("cluster").isin(1, 2)).select("id", F.col("cluster").cast("long").alias("cluster"), F.size("embedding").alias("dim"))


@query("compact_json", """SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS contents FROM events""")
def compact_json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.to_json(F.struct("event_id", "event_type")).alias("contents"))


@query("preference_rows", "SELECT event_id AS id, event_type AS prompt, value::VARCHAR AS chosen FROM events")
def preference_rows(spark, sf):
    """Pairs passed through as they are."""
    pairs = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("prompt"), F.col("value").cast("string").alias("chosen"), F.lit("x").alias("rejected"))
    return B.project(pairs, ["id", "prompt", "chosen", "rejected"], ["rejected"])


@query("pad_truncate", "SELECT event_id, repeat('_', greatest(0, 4 - (event_id % 7)::INT)) || substr('abcdef', 1, (event_id % 7)::INT) AS padded, right(substr('abcdef', 1, (event_id % 7)::INT), 3) AS tail, CASE WHEN event_id % 7 > 3 THEN 'a' || right(substr('abcdef', 1, (event_id % 7)::INT), 2) ELSE substr('abcdef', 1, (event_id % 7)::INT) END AS middle FROM events")
def pad_truncate(spark, sf):
    letters = F.slice(F.array(*map(F.lit, "abcdef")), F.lit(1), (F.col("event_id") % 7).cast("int"))
    text = lambda x: F.array_join(x, "")
    return table(spark, sf, "events").select("event_id", text(A.pad(letters, 4, "_", left=True)).alias("padded"), text(A.truncate(letters, 3, "left")).alias("tail"), text(A.truncate(letters, 3, "middle")).alias("middle"))


@query("restore_order", "SELECT n_nationkey AS position, n_name FROM nation")
def restore_order(spark, sf):
    """Rows put in another order by an index table, and back by its inverse."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("position"), "n_name")
    indices = n.select((F.col("position") * 7 % 25).alias("out_position"), F.col("position").alias("index"))
    moved = S.reorder(n, "position", indices)
    return S.reorder(moved.withColumnRenamed("out_position", "position"), "position", S.inverse(indices)).select(F.col("out_position").alias("position"), "n_name")


@query("geometry_score", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS format, round(0.9 * (event_id % 2) + CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE 0.1 END, 6)::DOUBLE AS score FROM events")
def geometry_score(spark, sf):
    i = F.col("event_id")
    text = F.concat(F.when(i % 3 == 0, F.lit("")).otherwise("<think>\nwell\n</think>"), F.lit(" so \\boxed{"), (i % 2).cast("string"), F.lit("}"))
    form = T.geometry_format(text)
    right = F.coalesce((G.last_boxed(text) == "1").cast("double"), F.lit(0.0))
    return table(spark, sf, "events").select("event_id", form.alias("format"), r6(0.9 * right + 0.1 * form).alias("score"))


@query("validation_sections", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'val-core' ELSE 'val-aux' END AS section FROM events")
def validation_sections(spark, sf):
    return table(spark, sf, "events").select("event_id", stats.section(F.lit(1), F.col("event_id") % 3 == 0).alias("section"))


@query("judged_or_ruled", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN (event_id % 2 = 0)::INT ELSE (event_id % 3 = 0)::INT END::DOUBLE AS score FROM events")
def judged_or_ruled(spark, sf):
    """Rows of split test are graded by the rule, the others by the judge's verdict."""
    i = F.col("event_id")
    judge = F.when(i % 3 == 0, F.lit("so \\boxed{True}")).otherwise("\\boxed{False}")
    rule = F.coalesce((G.last_boxed(F.concat(F.lit("\\boxed{"), (i % 2).cast("string"), F.lit("}"))) == "0").cast("double"), F.lit(0.0))
    return table(spark, sf, "events").select("event_id", F.when(i % 4 == 0, rule).otherwise(G.verdict(judge)).alias("score"))


@query("usable_samples", "SELECT item_id FROM benchmark WHERE item_id % 4 <> 0 AND item_id % 5 <> 0")
def usable_samples(spark, sf):
    """Rows with a query and an id, neither blank."""
    i = F.col("item_id")
    rows = table(spark, sf, "benchmark").select(i, F.when(i % 4 != 0, F.col("text")).alias("contents"), F.when(i % 5 == 0, F.lit("")).otherwise(i.cast("string")).alias("id"))
    return rows.filter(B.not_empty("contents") & B.not_empty("id")).select("item_id")


@query("growing_columns", "SELECT n_nationkey, n_name, NULL::VARCHAR AS note FROM nation WHERE n_nationkey < 12 UNION ALL SELECT n_nationkey, n_name, 'late' FROM nation WHERE n_nationkey >= 12")
def growing_columns(spark, sf):
    """Later batches have a column more."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return B.concat_batches([(n.filter("n_nationkey < 12"), {}), (n.filter("n_nationkey >= 12").withColumn("note", F.lit("late")), {})])[0]


@query("greedy_balance", "SELECT n_regionkey AS batch, count(*) AS n, sum(n_nationkey) AS held FROM nation GROUP BY n_regionkey")
def greedy_balance(spark, sf):
    """Every item is in one part; the parts themselves are tested against a plain loop."""
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("batch"), F.col("n_nationkey").alias("key"), F.col("n_nationkey").alias("cost"))
    parts = S.balance(n, "batch", "key", "cost", 2, greedy=True).filter("part < 2")
    return parts.groupBy("batch").agg(F.count("*").alias("n"), F.sum("key").alias("held"))
