"""Queries on search, fusion, ranking quality, negatives and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import sft_loss_mask
from ..operators import fusion, lexical, negatives, samples, vector
from .base import query, r6, table

TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def bm25_ctes(tf: str = "tf", boost: str = "1.0") -> str:
    return rf"""
toks AS (SELECT doc_id, {TOK} AS t FROM documents WHERE length(text) > 0),
lens AS (SELECT doc_id, len(t) AS len FROM toks),
post AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY ALL),
terms AS (SELECT term, count(*) AS df FROM post GROUP BY term),
corpus AS (SELECT count(*) AS n, avg(len) AS avgdl FROM lens),
asked AS (SELECT DISTINCT item_id AS qid, unnest({TOK}) AS term FROM benchmark),
scored AS (SELECT qid, doc_id, sum({boost} * ln(1 + (n - df + 0.5) / (df + 0.5)) * {tf} * 1.9 / ({tf} + 0.9 * (0.6 + 0.4 * len / avgdl))) AS score
  FROM asked JOIN terms USING (term) JOIN post USING (term) JOIN lens USING (doc_id) CROSS JOIN corpus GROUP BY qid, doc_id),
lex AS (SELECT qid, doc_id AS id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM scored)"""


def _asked(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _bm25(spark, sf, k=10, **options):
    return lexical.bm25(_asked(spark, sf), lexical.build_index(table(spark, sf, "documents")), k, **options)


@query("bm25_topk", f"WITH {bm25_ctes()} SELECT qid, rank, id AS doc_id, round(score, 6) AS score FROM lex WHERE rank <= 10")
def bm25_topk(spark, sf):
    return _bm25(spark, sf).withColumn("score", r6("score"))


@query("bm25_tuned", f"WITH {bm25_ctes('least(tf, 5)', "CASE WHEN term IN ('the', 'of') THEN 1.2 ELSE 1.0 END")} SELECT qid, rank, id AS doc_id, round(score, 6) AS score FROM lex WHERE rank <= 10")
def bm25_tuned(spark, sf):
    return _bm25(spark, sf, most_tf=5, boost=("the", "of")).withColumn("score", r6("score"))


@query("bm25_weights", f"WITH {bm25_ctes()} SELECT doc_id, count(*) AS terms, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * len / avgdl))), 6) AS weight FROM post JOIN terms USING (term) JOIN lens USING (doc_id) CROSS JOIN corpus GROUP BY doc_id")
def bm25_weights(spark, sf):
    return lexical.weights(lexical.build_index(table(spark, sf, "documents"))).groupBy("doc_id").agg(F.count("*").alias("terms"), r6(F.sum("weight")).alias("weight"))


@query("inverted_index", f"WITH {bm25_ctes()} SELECT term, df, sum(tf)::BIGINT AS cf FROM terms JOIN post USING (term) GROUP BY ALL")
def inverted_index(spark, sf):
    ix = lexical.build_index(table(spark, sf, "documents"))
    return ix.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def knn_sql(k: int, score: str, direction: str, where: str = "true", extra: str = "") -> str:
    return f"""
q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
c AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings WHERE {where}),
s AS (SELECT qid, id, {score} AS score FROM q JOIN c ON {extra or 'true'}),
near AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) {direction}, id)::INT AS rank FROM s QUALIFY rank <= {k})"""


IP = "list_inner_product(q.e, c.e)"
L2 = "list_sum(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) ** 2))"


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding"), e.select(F.col("vec_id").alias("id"), "embedding", "label")


@query("dense_topk_ip", f"WITH {knn_sql(5, IP, 'DESC')} SELECT qid, rank, id, round(score, 6) AS score FROM near")
def dense_topk_ip(spark, sf):
    q, c = _vectors(spark, sf)
    return vector.knn_join(q, c, 5).withColumn("score", r6("score"))


@query("dense_topk_l2", f"WITH {knn_sql(5, L2, 'ASC')} SELECT qid, rank, id, round(score, 6) AS score FROM near")
def dense_topk_l2(spark, sf):
    q, c = _vectors(spark, sf)
    return vector.knn_join(q, c, 5, "l2").withColumn("score", F.abs(r6("score")))


@query("dense_topk_filtered", f"WITH {knn_sql(5, IP, 'DESC', 'label IN (1, 3, 5)')} SELECT qid, rank, near.id, label, round(score, 6) AS score FROM near JOIN embeddings ON vec_id = near.id")
def dense_topk_filtered(spark, sf):
    q, c = _vectors(spark, sf)
    kept = c.filter(F.col("label").isin(1, 3, 5))
    return vector.knn_join(q, kept, 5).join(c.select("id", "label"), "id").select("qid", "rank", "id", "label", r6("score").alias("score"))


@query("dense_topk_others", f"WITH {knn_sql(5, IP, 'DESC', extra='qid <> id')} SELECT qid, rank, id, round(score, 6) AS score FROM near")
def dense_topk_others(spark, sf):
    q, c = _vectors(spark, sf)
    return vector.knn_join(q, c, 5, exclude_self=True).withColumn("score", r6("score"))


@query("ivf_search")
def ivf_search(spark, sf):
    """Approximate, so rows only: recall is tested. Every vector is a query."""
    _, c = _vectors(spark, sf)
    q = c.select(F.col("id").alias("qid"), "embedding")
    centroids = vector.train_centroids(c, 16)
    return vector.ivf_search(q, vector.assign(c, centroids), centroids, 5, 10)


#: Queries are every fiftieth vector and every benchmark text: an id that is both has both lists.
#: Dense and lexical lists meet on vec_id = doc_id, a convention of these tables: they have no other common key.
HYBRID = f"{bm25_ctes()}, {knn_sql(10, IP, 'DESC')}, lists AS (SELECT qid, id, 0.5 / (60 + rank) AS s FROM near UNION ALL SELECT qid, id, 0.5 / (60 + rank) FROM lex WHERE rank <= 10), fused AS (SELECT qid, id, sum(s) AS score FROM lists GROUP BY qid, id), hits AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, id)::INT AS rank FROM fused QUALIFY rank <= 10)"


def _hybrid(spark, sf):
    q, c = _vectors(spark, sf)
    lex = _bm25(spark, sf).withColumnRenamed("doc_id", "id")
    return fusion.rrf(vector.knn_join(q, c, 10), lex, 10)


@query("rrf_fusion", f"WITH {HYBRID} SELECT qid, rank, id, round(score, 9) AS score FROM hits")
def rrf_fusion(spark, sf):
    return _hybrid(spark, sf).withColumn("score", F.round("score", 9))


@query("minmax_fusion", f"WITH {bm25_ctes()} SELECT qid, id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS norm FROM (SELECT * FROM lex WHERE rank <= 10) WINDOW w AS (PARTITION BY qid)")
def minmax_fusion(spark, sf):
    hits = _bm25(spark, sf).withColumnRenamed("doc_id", "id")
    return fusion.min_max(hits).select("qid", "id", r6("norm").alias("norm"))


@query("ranking_eval", f"WITH {bm25_ctes()}, truth AS (SELECT item_id AS qid, item_id * 7 % 100 AS id FROM benchmark), met AS (SELECT rank FROM truth LEFT JOIN (SELECT * FROM lex WHERE rank <= 10) USING (qid, id)) SELECT count(*) AS n, count(*) AS n_usable, round(avg(coalesce(rank <= 3, false)::INT), 6) AS top3, round(avg(coalesce(rank <= 5, false)::INT), 6) AS top5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM met")
def ranking_eval(spark, sf):
    truth = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), (F.col("item_id") * 7 % 100).alias("id"))
    got = fusion.evaluate_ranking(truth, _bm25(spark, sf).withColumnRenamed("doc_id", "id"))
    return got.select("n", "n_usable", *[r6(c).alias(c) for c in ("top3", "top5", "mrr")])


@query("ranking_eval_planted", f"WITH {bm25_ctes()}, truth AS (SELECT item_id AS qid, (SELECT min(doc_id) FROM documents d WHERE contains(d.text, b.text)) AS id FROM benchmark b), met AS (SELECT t.*, rank FROM truth t LEFT JOIN (SELECT * FROM lex WHERE rank <= 10) l ON t.qid = l.qid AND t.id = l.id) SELECT count(*) AS n, count(id) AS n_usable, round(avg(coalesce(rank <= 3, false)::INT), 6) AS top3, round(avg(coalesce(rank <= 5, false)::INT), 6) AS top5, round(avg(CASE WHEN id IS NOT NULL THEN coalesce(1.0 / rank, 0) END), 6) AS mrr FROM met")
def ranking_eval_planted(spark, sf):
    """Truth: the first document that holds a benchmark passage, found by the passage's rarest terms."""
    asked, docs = _asked(spark, sf), table(spark, sf, "documents")
    index = lexical.build_index(docs)
    found = lexical.holders(asked, index, docs).groupBy("qid").agg(F.min("doc_id").alias("id"))
    truth = asked.select("qid").join(found, "qid", "left")
    got = fusion.evaluate_ranking(truth, lexical.bm25(asked, index, 10).withColumnRenamed("doc_id", "id"))
    return got.select("n", "n_usable", *[r6(c).alias(c) for c in ("top3", "top5", "mrr")])


@query("search_passages", f"""WITH {bm25_ctes()}, h AS (SELECT qid, rank, text AS c FROM lex JOIN documents ON doc_id = id WHERE rank <= 3)
SELECT qid, md5(string_agg('Doc ' || rank || ' (Title: ' || split_part(c, chr(10), 1) || ')' || chr(10) || CASE WHEN contains(c, chr(10)) THEN substr(c, instr(c, chr(10)) + 1) ELSE '' END || chr(10), '' ORDER BY rank)) AS passages FROM h GROUP BY qid""")
def search_passages(spark, sf):
    hits = _bm25(spark, sf, 3).withColumnRenamed("doc_id", "id")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("contents"))
    return fusion.passages(fusion.with_contents(hits, docs), T.title_line, T.after_title).withColumn("passages", F.md5("passages"))


# --- negatives

HARD = f"{knn_sql(10, IP, 'DESC', extra='qid <> id')}, hard AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY md5(qid || '|' || id || '|0'))::INT AS pick FROM near WHERE rank > 3 QUALIFY pick <= 3)"


@query("hard_negatives", f"WITH {HARD} SELECT qid, id, pick FROM hard")
def hard_negatives(spark, sf):
    q, c = _vectors(spark, sf)
    return negatives.hard_negatives(q, c).select("qid", "id", "pick")


EASY = """
b AS (SELECT item_id AS id, text AS contents FROM benchmark),
ring AS (SELECT contents AS other, row_number() OVER (ORDER BY md5(contents || '|0')) - 1 AS p FROM (SELECT DISTINCT contents FROM b WHERE contents IS NOT NULL)),
k AS (SELECT count(*) AS m FROM ring),
want AS (SELECT id, contents, m, ('0x' || substr(md5(id || '|0'), 1, 12))::BIGINT % m AS start, unnest(range(least(4, m))) AS step FROM b, k),
easy AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY step)::INT AS pick FROM want JOIN ring ON p = (start + step) % m WHERE other IS DISTINCT FROM contents QUALIFY pick <= 3)"""


@query("easy_negatives", f"WITH {EASY} SELECT id, other AS contents, pick FROM easy")
def easy_negatives(spark, sf):
    return negatives.easy_negatives(table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("contents")))


@query("contrastive", f"WITH {EASY}, {HARD}, h AS (SELECT qid AS id, list(text ORDER BY pick) AS hs FROM hard JOIN documents ON doc_id = hard.id GROUP BY qid), e AS (SELECT id, list(other ORDER BY pick) AS es FROM easy GROUP BY id) SELECT b.id, md5(b.contents) AS positive, list_reduce(list_prepend('', list_transform(list_concat(coalesce(hs, []), coalesce(es, [])), lambda x: md5(x))), lambda a, x: a || x) AS negatives FROM b LEFT JOIN h ON b.id = h.id LEFT JOIN e ON b.id = e.id")
def contrastive(spark, sf):
    s = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("contents")).withColumn("query", F.col("contents"))
    q, c = _vectors(spark, sf)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("contents"))
    hard = negatives.hard_negatives(q, c).join(docs, "id").select(F.col("qid").alias("id"), "contents", "pick")
    rows = negatives.contrastive(s, hard, negatives.easy_negatives(s.select("id", "contents")))
    return rows.select("id", F.md5(F.col("positive_messages")[0][0]["content"]).alias("positive"), F.array_join(F.transform("negative_messages", lambda m: F.md5(m[0]["content"])), "").alias("negatives"))


@query("false_negative_filter", "SELECT event_id FROM events WHERE value <= event_id % 100")
def false_negative_filter(spark, sf):
    pairs = table(spark, sf, "events").select("event_id", F.col("value").alias("negative_score"), (F.col("event_id") % 100).alias("positive_score"))
    return negatives.drop_false_negatives(pairs).select("event_id")


# --- corpus rows and conversations

@query("keyword_filter", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license')")
def keyword_filter(spark, sf):
    return table(spark, sf, "documents").filter(F.contains(F.lower("text"), F.lower(F.lit("LICENSE")))).select("doc_id")


@query("chunk_map", "SELECT doc_id::VARCHAR AS id, md5(substr(text, 1, 1024)) AS chunk, CASE WHEN doc_id % 3 = 0 THEN 20240101 + doc_id % 28 ELSE 0 END::BIGINT AS publish_time, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS source FROM documents")
def chunk_map(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("contents"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("doc_id") % 28).cast("string"), 2, "0"))).otherwise("20240101").alias("last_modified_date"),
        F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("file_name"), F.col("lang").alias("source_file"),
    )
    return samples.chunk_rows(d, 1024).select("id", F.md5("text_chunk").alias("chunk"), "publish_time", "source")


@query("contents_flatten", """SELECT event_id, '"k":"' || (props::JSON ->> 'k') || '"' AS quoted, 'k:' || (props::JSON ->> 'k') AS spaced FROM events""")
def contents_flatten(spark, sf):
    return table(spark, sf, "events").select("event_id", T.pairs_text("props").alias("quoted"), T.pairs_text("props", spaced=True).alias("spaced"))


@query("instruct_queries", "SELECT item_id, md5('Instruct: find it' || chr(10) || 'Query:' || left(text, 256)) AS q FROM benchmark")
def instruct_queries(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.md5(T.instruct("find it", F.left("text", F.lit(256)))).alias("q"))


@query("sft_pairs", "SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE upper(role) IN ('USER', 'HUMAN')), '') AS question, coalesce(arg_max(text, turn) FILTER (WHERE upper(role) = 'ASSISTANT'), '') AS answer FROM conversations GROUP BY conv_id")
def sft_pairs(spark, sf):
    return samples.question_answer(table(spark, sf, "conversations"))


@query("sft_train_test_split", "WITH c AS (SELECT DISTINCT conv_id FROM conversations), r AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS position FROM c) SELECT conv_id, position, CASE WHEN position < floor((SELECT count(*) FROM c) * 0.9) THEN 'train' ELSE 'test' END AS split FROM r")
def sft_train_test_split(spark, sf):
    return samples.ordered_split(table(spark, sf, "conversations").select("conv_id").distinct(), "conv_id", 0.9)


@query("conversation_messages", "SELECT conv_id, count(*) AS n, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def conversation_messages(spark, sf):
    m = samples.messages(table(spark, sf, "conversations"))
    return m.select("conv_id", F.size("messages").cast("long").alias("n"), F.md5(F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")).alias("digest"))


@query("multi_turn_mask", r"SELECT conv_id, sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')))::BIGINT AS n_tokens, coalesce(sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS n_loss FROM conversations GROUP BY conv_id")
def multi_turn_mask(spark, sf):
    mask = samples.multi_turn_mask(F.col("messages"))
    return samples.messages(table(spark, sf, "conversations")).select("conv_id", F.size(mask).cast("long").alias("n_tokens"), F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_loss"))


@query("sft_loss_mask", r"WITH p AS (SELECT item_id, len(string_split(text, ' ')) AS n, 3 AS r FROM benchmark) SELECT item_id, (n + r)::BIGINT AS size, (r - 1)::BIGINT AS ones FROM p")
def sft_loss(spark, sf):
    m = sft_loss_mask(F.split("text", " "), F.array(*map(F.lit, "abc")))
    return table(spark, sf, "benchmark").select("item_id", F.size(m).cast("long").alias("size"), F.aggregate(m, F.lit(0).cast("long"), lambda a, x: a + x).alias("ones"))


@query("rl_sample", "SELECT 'bench_' || 'qa' AS data_source, item_id AS index, md5(text) AS question, (item_id * 3)::VARCHAR AS ground_truth FROM benchmark")
def rl_sample(spark, sf):
    b = table(spark, sf, "benchmark")
    s = samples.rl_sample(b, F.lit("qa"), F.col("text"), (F.col("item_id") * 3).cast("string"), F.col("item_id"), tag="bench_")
    return s.select("data_source", F.col("extra_info.index").alias("index"), F.md5(F.col("prompt")[1]["content"]).alias("question"), F.col("reward_model.ground_truth").alias("ground_truth"))


PREF = "p AS (SELECT a.doc_id AS id, a.lang AS prompt, a.text AS chosen, b.text AS rejected FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 JOIN labels l ON l.doc_id = a.doc_id WHERE l.quality = 1)"


@query("preference_explode", f"WITH {PREF} SELECT id, prompt, 0 AS place, md5(chosen) AS response FROM p UNION ALL SELECT id, prompt, 1, md5(rejected) FROM p")
def preference_explode(spark, sf):
    d = table(spark, sf, "documents")
    good = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    a = d.select("doc_id", F.col("doc_id").alias("id"), F.col("lang").alias("prompt"), F.col("text").alias("chosen")).join(good, "doc_id", "left_semi")
    b = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("rejected"))
    return samples.preference_rows(a.join(b, "doc_id")).select("id", "prompt", "place", F.md5("response").alias("response"))


@query("dedupe_prompt", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedupe_prompt(spark, sf):
    return samples.dedupe(table(spark, sf, "documents"), F.col("text"), "doc_id").select("doc_id")


@query("latest_turn", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def latest_turn(spark, sf):
    return samples.latest_turn(table(spark, sf, "conversations"), ["conv_id"], [F.col("turn").desc()]).select("conv_id", "turn", "role")


@query("length_filter", r"SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) <= 300")
def length_filter(spark, sf):
    return table(spark, sf, "documents").filter(F.size(T.words("text")) <= 300).select("doc_id")


@query("sample_rows", "SELECT doc_id FROM documents ORDER BY md5(doc_id || '|5'), doc_id LIMIT 50")
def sample_rows(spark, sf):
    """A sampling operator: its 50 rows are the feature."""
    return table(spark, sf, "documents").orderBy(negatives.hash_order(F.col("doc_id"), seed=5), "doc_id").limit(50).select("doc_id")


@query("hash_split", "SELECT doc_id, CASE WHEN substr(md5(doc_id || '|1'), 1, 1) < 'd' THEN 'train' ELSE 'validation' END AS split FROM documents")
def hash_split(spark, sf):
    h = F.substring(negatives.hash_order(F.col("doc_id"), seed=1), 1, 1)
    return table(spark, sf, "documents").select("doc_id", F.when(h < "d", "train").otherwise("validation").alias("split"))


@query("content_parts", "SELECT item_id, 'text:' || md5('see ') || ' image: text:' || md5(text || ' ') || ' video:' AS parts FROM benchmark")
def content_parts(spark, sf):
    p = samples.content_parts(F.concat(F.lit("see <image>"), F.col("text"), F.lit(" <video>")))
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.transform(p, lambda x: F.concat(x["type"], F.lit(":"), F.coalesce(F.md5(x["text"]), F.lit("")))), " ").alias("parts"))


@query("role_order", "WITH t AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE role <> 'system') SELECT conv_id, bool_and(role = CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END) AS alternates FROM t GROUP BY conv_id")
def role_order(spark, sf):
    m = samples.messages(table(spark, sf, "conversations"))
    return m.filter(F.exists("messages", lambda x: x["role"] != "system")).select("conv_id", samples.roles_alternate(F.col("messages")).alias("alternates"))


@query("transcript_messages", "SELECT item_id, 'assistant=I will compute.|assistant=print(' || item_id || ')|tool=' || item_id || '|assistant=done' AS said FROM benchmark")
def transcript_messages(spark, sf):
    i = F.col("item_id").cast("string")
    t = F.concat(F.lit("I will compute.\n<code>print("), i, F.lit(")</code><interpreter>\n"), i, F.lit("\n</interpreter><answer>done</answer>"))
    said = F.array_join(F.transform(samples.transcript_messages(t), lambda x: F.concat(x["role"], F.lit("="), x["content"])), "|")
    return table(spark, sf, "benchmark").select("item_id", said.alias("said"))


@query("collapse_rows", """SELECT conv_id, md5('system:Answer the question step by step.|' || string_agg(role || ':' || text, '|' ORDER BY turn)) AS said, '{"origin":"synthetic","turns":' || count(*) || '}' AS extra FROM conversations GROUP BY conv_id""")
def collapse_rows(spark, sf):
    m = samples.messages(table(spark, sf, "conversations")).withColumn("origin", F.lit("synthetic")).withColumn("turns", F.size("messages"))
    said = F.md5(F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|"))
    return samples.collapse(m, ["conv_id"], "messages").select("conv_id", said.alias("said"), F.col("extra_info").alias("extra"))


@query("multiple_choice", "WITH o AS (SELECT item_id, k, md5(item_id || '|' || k || '|0') AS h FROM benchmark, range(4) t(k)), r AS (SELECT item_id, k, row_number() OVER (PARTITION BY item_id ORDER BY h) AS i FROM o) SELECT item_id, max(CASE WHEN k = 0 THEN substr('ABCD', i::INT, 1) END) AS gold, string_agg('rxyz'[k::INT + 1], '' ORDER BY i) AS choices FROM r GROUP BY item_id")
def multiple_choice(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.lit("r").alias("r"), F.lit("x").alias("x"), F.lit("y").alias("y"), F.lit("z").alias("z"))
    return samples.multiple_choice(b, "item_id", "r", ["x", "y", "z"]).select("item_id", "gold", F.array_join("choices", "").alias("choices"))


@query("search_hybrid", f"WITH {HYBRID} SELECT qid, rank, id FROM hits")
def search_hybrid(spark, sf):
    from .search import search

    q, c = _vectors(spark, sf)
    asked = q.join(_asked(spark, sf), "qid", "full_outer")
    return search(asked, 10, "hybrid", 0.5, c, lexical.build_index(table(spark, sf, "documents"))).select("qid", "rank", "id")
