"""Whole sequences: nothing is cut off."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from lodestar import plans
from lodestar.operators import lexical, reshape, vector
from lodestar.plans import rollouts


def test_unfold_holds_every_value(spark):
    rows = spark.createDataFrame([(n, list(range(n))) for n in (0, 3, 8, 11, 99)], "n int, r array<int>")
    got = {}
    for r in reshape.unfold(rows, "r", 4).orderBy("n", "part").collect():
        got.setdefault(r["n"], []).append(r["r"])
    assert all(len(v) == 4 and sum(v, []) == list(range(n)) for n, v in got.items()) and len(got) == 5


def test_response_of_a_long_sequence(spark, monkeypatch):
    one = spark.range(12_000).agg(F.lit(1).alias("uid"), F.transform(F.array_sort(F.collect_list("id")), lambda i: F.when(i < 2000, 1).otherwise(i.cast("int") % 2)).alias("m")).withColumn("r", F.col("m").cast("array<double>"))
    monkeypatch.setattr(rollouts, "sequences", lambda spark, sf: one)
    got = rollouts.sequence_masks(spark, "").first()
    assert (got["n"], got["response"]) == (12_000, 2000 - 5 + 5000)


def test_ivf_answers_every_vector(spark):
    sf = "/root/testdata/sf0.001"
    want = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").distinct().count()
    assert plans.QUERIES["ivf_search"](spark, sf).select("qid").distinct().count() == want


def test_unfold_parts_of_a_size(spark):
    rows = spark.createDataFrame([(n, list(range(n))) for n in (0, 5, 45, 48)], "n int, r array<int>")
    got = {}
    for r in reshape.unfold(rows, "r", 4, 12).orderBy("n", "part").collect():
        got.setdefault(r["n"], []).append(r["r"])
    assert got == {n: [list(range(n))[a : a + 12] for a in (0, 12, 24, 36)] for n in (0, 5, 45, 48)}


def test_unfold_chunks_of_short_sequences_equal_sql(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("event_id"), F.when(F.col("id") < 45, 1).otherwise(2).cast("long").alias("user_id"), (F.col("id") * 3.5).alias("value")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {(r[0], r[1]): r[2] for r in con.sql(plans.ORACLE_SQL["unfold_chunks"]).fetchall()}
    got = {(r["uid"], r["part"]): r["s"] for r in plans.QUERIES["unfold_chunks"](spark, str(tmp_path)).collect()}
    assert got == want and got[(2, 3)] is None


def test_unfold_chunks_hold_every_event(spark, tmp_path):
    spark.range(250).select(F.col("id").alias("event_id"), F.when(F.col("id") < 50, 1).otherwise(2).cast("long").alias("user_id"), (F.col("id") * 97.0).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["uid"]: (r["n"], r["s"]) for r in plans.QUERIES["unfold_chunks"](spark, str(tmp_path)).groupBy("uid").agg(F.count("*").alias("n"), F.sum("s").alias("s")).collect()}
    assert got == {1: (5, sum(range(50))), 2: (17, sum(range(50, 250)))}


def test_split_slices_round_halves_as_sql(spark, tmp_path):
    for n in (22, 26):  # a quarter is 5.5 and 6.5, three quarters are 16.5 and 19.5
        spark.range(n).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/{n}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{n}/documents.parquet/*.parquet'")
        got = sorted(tuple(r) for r in plans.QUERIES["split_slices"](spark, f"{tmp_path}/{n}").select("doc_id", "part").collect())
        assert got == sorted(con.sql(plans.ORACLE_SQL["split_slices"]).fetchall())


def test_micro_batches_of_a_long_sequence(spark):
    lengths = {"a": [40, 900, 30, 60, 20, 301], "b": [700], "c": [10, 20]}
    rows = spark.createDataFrame([(b, i, n) for b, ns in lengths.items() for i, n in enumerate(ns)], "b string, k int, n int")
    got = {}
    for r in reshape.micro_batches(rows, "b", "k", "n", 300).collect():
        got.setdefault(r["b"], {}).setdefault(r["micro"], []).append(lengths[r["b"]][r["k"]])
    parts = {b: sorted(sorted(p) for p in of.values()) for b, of in got.items()}
    assert parts == {"a": [[20, 30, 40, 60], [301], [900]], "b": [[700]], "c": [[10, 20]]}
    assert all(sorted(of) == list(range(len(of))) for of in got.values())


def test_holders_are_all_texts_that_contain_a_passage(spark):
    texts = {1: "(alpha beta gamma delta epsilon zeta", 2: "xalpha beta gamma delta epsilon zetas", 3: "alpha beta gamma zeta delta epsilon", 4: "one\ttwo", 5: "", 6: "Alpha Beta Gamma Delta Epsilon Zeta", 7: None}
    asked = {0: "alpha beta gamma delta epsilon zeta", 1: "two", 2: "ma delta eps", 3: "nowhere near any of these", 4: "", 5: None, 6: "beta gamma"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r["qid"], r["doc_id"]) for r in lexical.holders(spark.createDataFrame(list(asked.items()), "qid long, text string"), lexical.build_index(docs), docs).collect()}
    assert got == {(q, d) for q, a in asked.items() for d, t in texts.items() if a is not None and t is not None and a in t}


def test_planted_truth_is_any_text_that_contains_the_passage(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES (1, 'other words only, none of it'), (2, '(alpha beta gamma delta epsilon zeta'), (3, 'alpha beta gamma delta epsilon zeta')) t(doc_id, text)")
    con.execute("CREATE TABLE benchmark AS SELECT * FROM (VALUES (0, 'alpha beta gamma delta epsilon zeta'), (1, 'words only')) t(item_id, text)")
    for t in ("documents", "benchmark"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    got = plans.QUERIES["ranking_eval_planted"](spark, str(tmp_path))
    rel = con.sql(plans.ORACLE_SQL["ranking_eval_planted"])
    want = dict(zip(rel.columns, rel.fetchall()[0]))
    assert got.first().asDict() == want and want["n_usable"] == 2


def test_ivf_over_all_clusters_is_exact_and_packed(spark, monkeypatch):
    monkeypatch.setattr(vector, "TILES", 7)
    monkeypatch.setattr(vector, "SHARE", 30)
    monkeypatch.setattr(vector, "CELLS", 64)
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (90, 4)).astype(float)
    x[20:60] = x[5]  # many equal vectors: ties go to the smaller id
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(90, None)]
    e = spark.createDataFrame(rows, "id long, embedding array<double>")
    centroids = vector.train_centroids(e, 4)
    got = vector.ivf_search(e.withColumnRenamed("id", "qid"), vector.assign(e, centroids), centroids, 5, len(centroids))
    assert "zip_with" not in got._jdf.queryExecution().optimizedPlan().toString()
    s = x @ x.T
    want = sorted((q, r + 1, i, s[q, i]) for q in range(90) for r, i in enumerate(sorted(range(90), key=lambda i: (-s[q, i], i))[:5]))
    assert sorted(map(tuple, got.collect())) == want
