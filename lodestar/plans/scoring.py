"""Queries on extraction, normalisation and grading of answers. Responses are built from the tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grading as G
from ..functions import text as T
from ..operators import stats
from .base import query, r6, table

#: A response a document, the same in both engines: think with steps, an answer with a box, now and then none.
RESPONSE_SQL = """resp AS (SELECT doc_id, left(text, 12) AS lead,
  CASE WHEN doc_id % 5 = 0 THEN 'no answer' ELSE '<think>Step 1: look at ' || left(lang, 2) || 'xx Step 2: add' || (doc_id % 9) || CASE WHEN doc_id % 4 = 0 THEN ' Step 3: ab' || chr(10) || chr(10) ELSE '' END || '</think>' ||
  '<answer>' || chr(10) || 'The ' || source || CASE WHEN doc_id % 3 = 0 THEN ' <|box_start|>' || chr(9) || (doc_id % 7) || chr(10) || '<|box_end|>' ELSE '' END || chr(10) || '</answer>' END AS response, source, lang FROM documents)"""


def responses(spark, sf):
    d, i = table(spark, sf, "documents"), F.col("doc_id")
    s = lambda x: (x if not isinstance(x, (str, int)) else F.lit(x)).cast("string")
    third = F.when(i % 4 == 0, F.lit(" Step 3: ab\n\n")).otherwise("")
    box = F.when(i % 3 == 0, F.concat(F.lit(" <|box_start|>\t"), s(i % 7), F.lit("\n<|box_end|>"))).otherwise("")
    full = F.concat(F.lit("<think>Step 1: look at "), F.left("lang", F.lit(2)), F.lit("xx Step 2: add"), s(i % 9), third, F.lit("</think><answer>\nThe "), F.col("source"), box, F.lit("\n</answer>"))
    return d.select("doc_id", F.when(i % 5 == 0, F.lit("no answer")).otherwise(full).alias("response"), "source", "lang")


#: Articles between characters that are no letters or digits of any language; twice, for articles next to each other.
ARTICLE = r"""'(^|[^\p{{L}}\p{{N}}_])(a|an|the)($|[^\p{{L}}\p{{N}}_])', '\1 \3', 'g'"""
NORM = rf"""trim(regexp_replace(regexp_replace(regexp_replace(translate(lower({{0}}), '!"#$%&''()*+,-./:;<=>?@[\]^_`{{{{|}}}}~', ''), {ARTICLE}), {ARTICLE}), '\s+', ' ', 'g'))"""


@query("qa_normalize", f"SELECT doc_id, md5({NORM.format('text')}) AS n FROM documents")
def qa_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.normalize_answer("text")).alias("n"))


ANSWER = "list_extract(list_transform(regexp_extract_all(response, '(?s)<answer>(.*?)</answer>', 1), lambda x: trim(x, ' ' || chr(9) || chr(10))), -1)"


@query("em_score", f"WITH {RESPONSE_SQL}, a AS (SELECT *, {ANSWER} AS answer FROM resp) SELECT doc_id, answer, CASE WHEN answer IS NULL THEN 0.0 WHEN {NORM.format('answer')} = {NORM.format('source')} THEN 1.0 ELSE 0.1 END::DOUBLE AS em, CASE WHEN answer IS NULL THEN 0.0 WHEN contains({NORM.format('answer')}, {NORM.format('source')}) THEN 1.0 ELSE 0.1 END::DOUBLE AS subem FROM a")
def em_score(spark, sf):
    gold = F.array("source")
    return responses(spark, sf).select("doc_id", T.last_answer("response").alias("answer"), T.qa_score("response", gold, format_score=0.1).alias("em"), T.qa_score("response", gold, substring=True, format_score=0.1).alias("subem"))


@query("semantic_score", f"WITH {RESPONSE_SQL} SELECT doc_id, round(0.3 * CASE WHEN response = 'no answer' THEN 0 ELSE 1 END + 0.7 * (doc_id % 10) / 10, 6)::DOUBLE AS score FROM resp")
def semantic_score(spark, sf):
    return responses(spark, sf).select("doc_id", r6(T.semantic_score("response", (F.col("doc_id") % 10) / 10)).alias("score"))


STEPS = "list_filter(list_transform((regexp_split_to_array(regexp_extract(response, '(?s)<think>(.*?)</think>', 1), 'Step\\s*\\d+\\s*[：:]\\s*'))[2:], lambda x: trim(x, ' ' || chr(9) || chr(10))), lambda x: x <> '')"


@query("process_format", f"WITH {RESPONSE_SQL} SELECT doc_id, len({STEPS})::INT AS n_steps, len(list_filter({STEPS}, lambda x: length(x) > 3))::INT AS n_valid, round(CASE WHEN response = 'no answer' THEN 0 ELSE 0.7 + CASE WHEN doc_id % 3 = 0 THEN 0.3 ELSE 0 END END, 6)::DOUBLE AS format, CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 = 0 AND doc_id % 7 = 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS answer FROM resp")
def process_format(spark, sf):
    think = T.first_tagged(F.col("response"), "think")
    return responses(spark, sf).select("doc_id", F.coalesce(F.size(T.steps(think)), F.lit(0)).alias("n_steps"), F.coalesce(F.size(T.valid_steps(think)), F.lit(0)).alias("n_valid"), r6(T.process_format("response")).alias("format"), T.process_answer("response", F.lit("3")).alias("answer")).withColumn("n_steps", F.greatest("n_steps", F.lit(0))).withColumn("n_valid", F.greatest("n_valid", F.lit(0)))


@query("process_total", "SELECT doc_id, round(CASE WHEN doc_id % 2 = 0 THEN (0.5 * (doc_id % 3) + doc_id % 5) / 1.5 ELSE (0.5 * (doc_id % 3) + doc_id % 5 + doc_id % 7) / 2.5 END, 6)::DOUBLE AS total FROM documents")
def process_total(spark, sf):
    i = F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", r6(T.process_total((i % 3).cast("double"), (i % 5).cast("double"), F.when(i % 2 == 1, (i % 7).cast("double")))).alias("total"))


@query("judge_number", "SELECT event_id, round(least(value / 10, 1.0), 6) AS score FROM events")
def judge_number(spark, sf):
    reply = F.concat(F.lit("Score: "), F.col("value").cast("string"), F.lit(" of 10"))
    return table(spark, sf, "events").select("event_id", r6(T.judge_number(reply)).alias("score"))


@query("hash_answer", "SELECT event_id, (event_id * 1000 + 7)::VARCHAR AS strict, (event_id % 13)::VARCHAR AS flexible, (event_id * 1000 + 7)::VARCHAR AS truth FROM events")
def hash_answer(spark, sf):
    text = F.concat(F.lit("so #### "), F.format_number(F.col("event_id") * 1000 + 7, 0), F.lit("\nor "), (F.col("event_id") % 13).cast("string"))
    return table(spark, sf, "events").select("event_id", T.hash_answer(text).alias("strict"), T.hash_answer(text, strict=False).alias("flexible"), T.truth_after_hash(text).alias("truth"))


@query("choice_letter", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE substr('ABCD', event_id % 5 + 1, 1) END AS letter FROM events")
def choice_letter(spark, sf):
    text = F.concat(F.lit("I think.\nAnswer: $"), F.substr(F.lit("ABCDE"), (F.col("event_id") % 5 + 1).cast("int"), F.lit(1)), F.lit("$"))
    return table(spark, sf, "events").select("event_id", T.choice_letter(text).alias("letter"))


@query("tool_calls", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END AS n, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'search' END AS name, CASE WHEN event_id % 4 = 0 THEN NULL ELSE '{"k":' || (props::JSON ->> 'k') || '}' END AS arguments, 'ask  end' AS rest FROM events""")
def tool_calls(spark, sf):
    good = F.concat(F.lit('{"name": "search", "arguments": '), F.col("props"), F.lit("}"))
    text = F.concat(F.lit("ask <tool_call>"), F.when(F.col("event_id") % 4 == 0, F.lit("{broken")).otherwise(good), F.lit("</tool_call> end"))
    calls = T.tool_calls(text)
    first = F.try_element_at(calls, F.lit(1))
    return table(spark, sf, "events").select("event_id", F.size(calls).alias("n"), first["name"].alias("name"), first["arguments"].alias("arguments"), T.without_tool_calls(text).alias("rest"))


@query("channel_calls", "SELECT event_id, 'find' AS name, props AS arguments FROM events")
def channel_calls(spark, sf):
    text = F.concat(F.lit("<|channel|>analysis<|message|>to=functions.no <|end|><|start|>assistant to=functions.find<|channel|>commentary json<|message|>"), F.col("props"), F.lit("<|call|>"))
    first = F.try_element_at(T.channel_calls(text), F.lit(1))
    return table(spark, sf, "events").select("event_id", first["name"].alias("name"), first["arguments"].alias("arguments"))


@query("title_lines", "SELECT doc_id, split_part(text, chr(10), 1) AS title, length(CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END)::INT AS rest FROM documents")
def title_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.title_line("text").alias("title"), F.length(T.after_title("text")).alias("rest"))


@query("clean_contents", "SELECT doc_id, md5(trim(replace(replace(text, chr(10), ''), ' ', ''))) AS c FROM documents")
def clean_contents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.clean_contents("text")).alias("c"))


@query("clean_title", r"SELECT item_id, md5('Make tea. ' || replace(regexp_replace(trim(text), '\[.*?\]', '', 'g'), '  ', ' ')) AS c FROM benchmark")
def clean_title(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.md5(T.clean_title(F.concat(F.lit("Make tea [title] [step]"), F.trim("text")))).alias("c"))


@query("reply_fields", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'plain' ELSE 'q' || event_id END AS query FROM events""")
def reply_fields(spark, sf):
    text = F.when(F.col("event_id") % 3 == 0, F.lit("plain")).otherwise(F.concat(F.lit('{"query": "q'), F.col("event_id").cast("string"), F.lit('"}')))
    return table(spark, sf, "events").select("event_id", T.reply_field(text, "query").alias("query"))


@query("code_blocks", "SELECT event_id, 'print(' || event_id || ')' || chr(10) AS code, round((event_id % 4) / 4.0, 6)::DOUBLE AS rate FROM events")
def code_blocks(spark, sf):
    text = F.concat(F.lit("try\n```python\nprint("), F.col("event_id").cast("string"), F.lit(")\n```\ndone"))
    results = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: i < F.col("event_id") % 4)
    return table(spark, sf, "events").select("event_id", T.code_block(text).alias("code"), r6(G.pass_rate(results)).alias("rate"))


@query("boxed_score", "SELECT event_id, '{' || event_id || '}^{2}' AS box, CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS verdict, repeat('{', (event_id % 40)::INT) || event_id || repeat('}', (event_id % 40)::INT) AS deep, 300 AS long, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'x' || chr(10) END AS last FROM events")
def boxed_score(spark, sf):
    """Boxes whose braces nest up to 40 deep, one of a hundred inner pairs, one that is never closed where event_id divides by 3."""
    i = F.col("event_id").cast("string")
    text = F.concat(F.lit("first \\boxed{1}, then \\boxed{{"), i, F.lit("}^{2}} end"))
    judge = F.when(F.col("event_id") % 2 == 0, F.lit("\\boxed{\nTrue }")).otherwise("\\boxed{False}")
    n = (F.col("event_id") % 40).cast("int")
    deep = F.concat(F.lit("so \\boxed{"), F.repeat(F.lit("{"), n), i, F.repeat(F.lit("}"), n), F.lit("} end}"))
    long = F.concat(F.lit("\\fbox{"), F.repeat(F.lit("{1}"), F.lit(100)), F.lit("}"))
    last = F.concat(F.lit("\\boxed{1} \\boxed{x\n"), F.when(F.col("event_id") % 3 == 0, F.lit("{}")).otherwise(F.lit("}")))
    return table(spark, sf, "events").select("event_id", G.last_boxed(text).alias("box"), G.verdict(judge).alias("verdict"), G.last_boxed(deep).alias("deep"), F.length(G.last_boxed(long)).alias("long"), G.last_boxed(last).alias("last"))


@query("latex_equal", "SELECT event_id, true AS same, event_id % 9 = 3 AS other FROM events")
def latex_equal(spark, sf):
    k = (F.col("event_id") % 9).cast("string")
    a, b = F.concat(F.lit("\\dfrac{"), k, F.lit("}{7}")), F.concat(k, F.lit("/7"))
    return table(spark, sf, "events").select("event_id", G.latex_equal(a, b).alias("same"), G.latex_equal(a, F.lit("3/7")).alias("other"))


@query("minerva_score", "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 1.0 ELSE -1.0 END::DOUBLE AS score, (1000 + event_id % 3)::VARCHAR AS pred FROM events")
def minerva_score(spark, sf):
    text = F.concat(F.lit("Thus\nAnswer: x = $1,00"), (F.col("event_id") % 3).cast("string"), F.lit("$ dollars"))
    m = G.minerva(text, F.lit("1001"))
    return table(spark, sf, "events").select("event_id", m["score"].alias("score"), m["pred"].alias("pred"))


@query("infix_value", "SELECT event_id, (3 * (2 + event_id % 7) - 2 * 4 - 1)::DOUBLE AS v FROM events")
def infix_value(spark, sf):
    text = F.concat(F.lit("(2+"), (F.col("event_id") % 7).cast("string"), F.lit(") @ 4 - 1"))
    return table(spark, sf, "events").select("event_id", G.infix_value(text).alias("v"))


@query("score_by_source", f"WITH {RESPONSE_SQL}, a AS (SELECT *, {ANSWER} AS answer FROM resp) SELECT doc_id, CASE WHEN lang = 'en' THEN CASE WHEN {NORM.format('answer')} = {NORM.format('source')} THEN 1.0 ELSE 0.0 END WHEN lang = 'de' THEN CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 = 0 AND (doc_id % 7)::VARCHAR = source THEN 1.0 ELSE 0.0 END ELSE 0.0 END::DOUBLE AS score FROM a")
def score_by_source(spark, sf):
    s = G.score(F.col("lang"), F.col("response"), F.col("source"), {"en": "qa", "de": "process", "fr": "hash", "es": "boxed"})
    return responses(spark, sf).select("doc_id", s.alias("score"))


@query("offline_eval", "SELECT source AS data_source, round(avg((CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) / 2.0), 6) AS score FROM documents GROUP BY source")
def offline_eval(spark, sf):
    yes = lambda n: F.when(F.col("doc_id") % n == 0, F.lit("#### 1")).otherwise("#### 0")
    rows = table(spark, sf, "documents").select(F.col("source").alias("data_source"), F.col("doc_id").alias("id"), F.array(yes(2), yes(3)).alias("responses"))
    got = stats.offline_eval(rows, G.SCORERS["hash"](F.col("response"), F.lit("1")))
    return got.select("data_source", r6("score").alias("score"))


@query("token_amount", r"SELECT conv_id, sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')))::BIGINT AS tokens FROM conversations WHERE turn > 0 GROUP BY conv_id")
def token_amount(spark, sf):
    return table(spark, sf, "conversations").filter("turn > 0").groupBy("conv_id").agg(F.sum(F.size(T.words("text"))).alias("tokens"))


LETTERS_SQL = """w AS (SELECT i AS id, translate(substr(md5('0|' || i), 1, 10), '0123456789', 'aebtaesrae') AS word, substr('abcdef', (i % 6 + 1)::INT, 1) AS letter FROM range(200) t(i)),
c AS (SELECT *, length(word) - length(replace(word, letter, '')) AS n FROM w)"""


@query("letter_counts", f"""WITH {LETTERS_SQL} SELECT id, 'How many ' || letter || ' are in ' || word || '?' AS prompt,
md5(list_reduce(list_transform(string_split(word, ''), lambda x: x || CASE WHEN x = letter THEN ': yes' ELSE ': no' END), lambda a, x: a || '; ' || x) || '; \\boxed{{' || n || '}}') AS response, n::VARCHAR AS truth, 1.0::DOUBLE AS score FROM c""")
def letter_counts(spark, sf):
    from ..operators import samples

    made = samples.letter_counts(spark, 200)
    return made.select("id", "prompt", F.md5("response").alias("response"), "truth", G.letter_count_score(F.col("response"), F.col("truth")).alias("score"))


#: A text without its third word and with its first word once more, against the text.
BLEU_SQL = r"""t AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS r FROM benchmark),
u AS (SELECT item_id, r, list_concat(list_concat(r[1:2], r[4:]), r[1:1]) AS c FROM t),
g AS (SELECT item_id, n, 'c' AS side, unnest(list_transform(range(1, len(c) - n + 2), lambda i: array_to_string(c[i : i + n - 1], ' '))) AS gram FROM u, range(1, 5) k(n)
  UNION ALL SELECT item_id, n, 'r', unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i : i + n - 1], ' '))) FROM u, range(1, 5) k(n)),
m AS (SELECT item_id, n, gram, count(*) FILTER (WHERE side = 'c') AS nc, count(*) FILTER (WHERE side = 'r') AS nr FROM g GROUP BY ALL),
p AS (SELECT item_id, n, sum(least(nc, nr)) AS hits, sum(nc) AS own FROM m GROUP BY ALL),
s AS (SELECT item_id, exp(avg(ln((hits + CASE WHEN n > 1 THEN 1 ELSE 0 END) / (own + CASE WHEN n > 1 THEN 1 ELSE 0 END)))) AS s FROM p GROUP BY item_id)"""


@query("bleu", f"WITH {BLEU_SQL} SELECT item_id, round(s * least(1.0, exp(1 - len(r)::DOUBLE / len(c))), 6) AS bleu, 1.0::DOUBLE AS own, 0.0::DOUBLE AS other FROM s JOIN u USING (item_id)")
def bleu(spark, sf):
    """A text without a word and with another twice, against itself and against other words; smoothing is tested by hand."""
    w = T.words("text")
    changed = F.array_join(F.concat(F.slice(w, 1, 2), F.slice(w, F.lit(4), F.greatest(F.size(w), F.lit(1))), F.slice(w, 1, 1)), " ")
    return table(spark, sf, "benchmark").select("item_id", r6(T.bleu(changed, F.col("text"))).alias("bleu"), r6(T.bleu(F.col("text"), F.col("text"))).alias("own"), r6(T.bleu(F.col("text"), F.lit("0"))).alias("other"))


@query("math_grade", "SELECT event_id, event_id % 9 = 3 AS fraction, event_id % 9 = 3 AS unit, event_id % 2 = 0 AS pair, true AS mixed FROM events")
def math_grade(spark, sf):
    """Answers with phrases, units, mixed numbers and tuples against a truth."""
    i = F.col("event_id")
    k = (i % 9).cast("string")
    fraction = G.grade_answer(F.concat(F.lit("The final answer is $\\dfrac{"), k, F.lit("}{7}$.")), F.lit("3/7"))
    unit = G.grade_answer(F.concat(k, F.lit(",000 \\text{ cm}")), F.lit("3000"))
    pair = G.grade_answer(F.concat(F.lit("(1, "), F.when(i % 2 == 0, F.lit("0.5")).otherwise("0.6"), F.lit(")")), F.lit("(1,\\frac{1}{2})"))
    mixed = G.grade_answer(F.concat(k, F.lit(" 1/2 inches")), F.concat(k, F.lit(".5")))
    return table(spark, sf, "events").select("event_id", fraction.alias("fraction"), unit.alias("unit"), pair.alias("pair"), mixed.alias("mixed"))


@query("infix_deep", "SELECT n_nationkey, (n_nationkey % 11)::DOUBLE AS v FROM nation")
def infix_deep(spark, sf):
    """3,000 parentheses deep."""
    text = F.concat(F.repeat(F.lit("("), F.lit(3000)), (F.col("n_nationkey") % 11).cast("string"), F.repeat(F.lit(")"), F.lit(3000)))
    return table(spark, sf, "nation").select("n_nationkey", G.infix_value(text).alias("v"))
