"""Text extraction, normalisation and rule-based grading as Column builders; no Python runs on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: ASCII punctuation, as answers are stripped of it.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
TOKEN = r"[\p{L}\p{N}]+"
#: All white space, not the space alone.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text: Column | str) -> Column:
    """text without white space of any kind at either end."""
    return F.btrim(_c(text), F.lit(WHITE))


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits; digits stay tokens."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(f"({TOKEN})"), 1)


def words(text: Column | str) -> Column:
    """White-space words; none for blank text."""
    return F.filter(F.split(_c(text), r"\s+"), lambda w: w != "")


# --- question answering

def normalize_answer(text: Column | str) -> Column:
    """Lower case, no punctuation, no articles, single spaces."""
    bare = F.translate(F.lower(_c(text)), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def exact_match(prediction: Column, golds: Column) -> Column:
    """Does the prediction equal any gold answer, both normalised?"""
    p = normalize_answer(prediction)
    return F.exists(golds, lambda g: normalize_answer(g) == p)


def substring_match(prediction: Column, golds: Column) -> Column:
    """Does the prediction contain any gold answer, both normalised?"""
    p = normalize_answer(prediction)
    return F.exists(golds, lambda g: F.contains(p, normalize_answer(g)))


def all_tagged(text: Column, open_: str, close: str) -> Column:
    """Contents between a pair of literal tags, trimmed, in order; lazy, over line ends."""
    quote = lambda s: "".join("\\" + ch if ch in "|[]()<>{}.$^*+?\\" and ch not in "<>" else ch for ch in s)
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?s){quote(open_)}(.*?){quote(close)}"), 1), lambda x: strip(x))


def last_answer(text: Column | str) -> Column:
    """The last <answer> element, null without one."""
    return F.try_element_at(all_tagged(_c(text), "<answer>", "</answer>"), F.lit(-1))


def answer_tags(text: Column | str) -> Column:
    """Number of opening and of closing answer tags, as a struct."""
    return F.struct(F.regexp_count(_c(text), F.lit("<answer>")).alias("opened"), F.regexp_count(_c(text), F.lit("</answer>")).alias("closed"))


def qa_score(text: Column | str, golds: Column, substring: bool = False, format_score: float = 0.0, score: float = 1.0) -> Column:
    """0 without an answer; the score if it matches, a quarter of it where tags abound; else the format score."""
    answer, tags = last_answer(text), answer_tags(text)
    match = (substring_match if substring else exact_match)(answer, golds)
    many = (tags["opened"] > 10) | (tags["closed"] > 10)
    return F.when(answer.isNull(), F.lit(0.0)).when(match, F.when(many, F.lit(score / 4)).otherwise(F.lit(float(score)))).otherwise(F.lit(float(format_score)))


def tag_format(text: Column | str) -> Column:
    """1 with one think element before one answer element, 0.25 with an answer only, else 0."""
    t = _c(text)
    both = t.rlike(r"(?s)<think>.*?</think>\s*<answer>.*?</answer>")
    return F.when(both, F.lit(1.0)).when(t.rlike(r"(?s)<answer>.*?</answer>"), F.lit(0.25)).otherwise(F.lit(0.0))


def semantic_score(text: Column | str, judge: Column | str, weight: float = 0.3) -> Column:
    """Format and judge scores combined; the judge's score is a column."""
    return F.lit(weight) * tag_format(text) + F.lit(1 - weight) * _c(judge)


# --- process rewards
#: The forms that process rewards read (steps, boxes and tags), as their producers write them.

def first_tagged(text: Column, tag: str) -> Column:
    return F.try_element_at(all_tagged(text, f"<{tag}>", f"</{tag}>"), F.lit(1))


def last_box(text: Column) -> Column:
    return F.try_element_at(all_tagged(text, "<|box_start|>", "<|box_end|>"), F.lit(-1))


def steps(think: Column) -> Column:
    """Contents of `Step n:` sections, the colon ASCII or full-width; case matters."""
    return F.transform(F.regexp_extract_all(think, F.lit(r"(?s)Step\s*\d+\s*[：:]\s*(.+?)(?=Step\s*\d+|$)"), 1), lambda x: strip(x))


def valid_steps(think: Column) -> Column:
    return F.filter(steps(think), lambda s: F.length(s) > 3)


def process_format(response: Column | str) -> Column:
    """.2 think, .2 steps, .3 answer, .3 box; 0 with more than five steps."""
    r = _c(response)
    think, answer = first_tagged(r, "think"), first_tagged(r, "answer")
    n = F.coalesce(F.size(valid_steps(think)), F.lit(0))
    n = F.when(think.isNull(), F.lit(0)).otherwise(n)
    parts = F.when(think.isNotNull(), 0.2).otherwise(0.0) + F.when(n > 0, 0.2).otherwise(0.0) + F.when(answer.isNotNull(), 0.3).otherwise(0.0) + F.when(last_box(r).isNotNull(), 0.3).otherwise(0.0)
    return F.when(n > 5, F.lit(0.0)).otherwise(parts)


def process_answer(response: Column | str, truth: Column | str) -> Column:
    """1 where the boxed answer (in the answer, else anywhere, else the answer's text) equals the truth."""
    r = _c(response)
    answer = first_tagged(r, "answer")
    given = F.coalesce(last_box(answer), last_box(r), answer)
    return F.coalesce((F.lower(strip(given)) == F.lower(strip(truth))).cast("double"), F.lit(0.0))


def process_total(format_: Column, answer: Column, process: Column | None = None, weights=(0.5, 1.0, 1.0)) -> Column:
    """Weighted mean of format, answer and process scores; without a process score the other weights are scaled up."""
    a, b, c = weights
    two = (a * format_ + b * answer) / (a + b)
    return two if process is None else F.when(process.isNull(), two).otherwise((a * format_ + b * answer + c * process) / (a + b + c))


def judge_number(text: Column | str) -> Column:
    """The first number in a judge's reply, out of ten, 1 at most; null without one."""
    found = F.regexp_extract(_c(text), r"(\d+(?:\.\d+)?)", 1)
    return F.least(F.try_divide(F.when(found != "", found).cast("double"), F.lit(10.0)), F.lit(1.0))


# --- arithmetic answers

def hash_answer(text: Column | str, strict: bool = True) -> Column:
    """Of the last 300 characters: strict, the last number after ####; flexible, the last number. Commas and $ go."""
    tail = F.right(_c(text), F.lit(300))
    if strict:
        found = F.try_element_at(F.regexp_extract_all(tail, F.lit(r"#### (-?[0-9.,]+)"), 1), F.lit(-1))
        return F.translate(found, ",$", "")
    numbers = F.filter(F.regexp_extract_all(tail, F.lit(r"(-?[0-9.,]+)"), 1), lambda x: (x != "") & (x != "."))
    return F.try_element_at(numbers, F.lit(-1))


def truth_after_hash(text: Column | str) -> Column:
    """The number after ####; an error without one."""
    found = F.regexp_extract(_c(text), r"#### (-?[0-9.,]+)", 1)
    return F.when(found == "", F.raise_error(F.lit("no answer after ####"))).otherwise(F.translate(found, ",", ""))


def choice_letter(text: Column | str) -> Column:
    """The letter of `Answer: X`, null without one."""
    found = F.regexp_extract(_c(text), r"(?i)answer[ \t]*:[ \t]*\$?([A-D])\$?", 1)
    return F.upper(F.when(found != "", found))


def geometry_format(text: Column | str) -> Column:
    return F.when(_c(text).rlike(r"(?s)^.*<think>.*</think>.*\\boxed\{.*\}.*$"), F.lit(1.0)).otherwise(F.lit(0.0))


# --- tools, code, cleaning

def tool_calls(text: Column | str) -> Column:
    """array<struct<name, arguments>> of <tool_call> elements that hold a JSON object with a name; others are skipped."""
    raw = all_tagged(_c(text), "<tool_call>", "</tool_call>")
    parsed = F.transform(raw, lambda x: F.struct(F.get_json_object(x, "$.name").alias("name"), F.get_json_object(x, "$.arguments").alias("arguments")))
    return F.filter(parsed, lambda p: p["name"].isNotNull())


def without_tool_calls(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"(?s)<tool_call>.*?</tool_call>", "")


def channel_calls(text: Column | str) -> Column:
    """array<struct<name, arguments>> of channel-format calls, analysis channels left out first."""
    bare = F.regexp_replace(_c(text), r"(?s)<\|channel\|>analysis.*?<\|end\|>", "")
    pattern = r"(?s)to=functions\.(\w+).*?<\|message\|>(.*?)<\|call\|>"
    names, arguments = F.regexp_extract_all(bare, F.lit(pattern), 1), F.regexp_extract_all(bare, F.lit(pattern), 2)
    return F.zip_with(names, arguments, lambda n, a: F.struct(n.alias("name"), strip(a).alias("arguments")))


def code_block(text: Column | str) -> Column:
    """The last fenced python block, else the last fenced block, else null."""
    t = _c(text)
    python = F.try_element_at(F.regexp_extract_all(t, F.lit(r"(?s)```python\n(.*?)```"), 1), F.lit(-1))
    return F.coalesce(python, F.try_element_at(F.regexp_extract_all(t, F.lit(r"(?s)```\w*\n(.*?)```"), 1), F.lit(-1)))


def clean_title(text: Column | str) -> Column:
    """[title] becomes a full stop, other brackets go, double spaces shrink."""
    t = F.replace(strip(text), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(t, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def clean_contents(text: Column | str) -> Column:
    """Line ends and spaces go, as for text without word spaces."""
    return strip(F.replace(F.replace(_c(text), F.lit("\n"), F.lit("")), F.lit(" "), F.lit("")))


def title_line(text: Column | str) -> Column:
    return F.substring_index(_c(text), "\n", 1)


def after_title(text: Column | str) -> Column:
    t = _c(text)
    return F.when(F.instr(t, "\n") > 0, F.substr(t, F.instr(t, "\n") + 1)).otherwise(F.lit(""))


def reply_field(text: Column | str, field: str) -> Column:
    """A field of a JSON reply, the raw text where the reply is no JSON object."""
    t = _c(text)
    return F.when(F.get_json_object(t, "$").isNull(), t).otherwise(F.get_json_object(t, f"$.{field}"))


def instruct(task: str, query: Column | str, chinese: bool = False) -> Column:
    """The instruction prefix of an embedding query."""
    return F.concat(F.lit(f"指令: {task}\n查询: " if chinese else f"Instruct: {task}\nQuery:"), _c(query))


def date_number(date: Column | str) -> Column:
    """yyyy-mm-dd as a number, 0 without a hyphen."""
    d = _c(date)
    return F.when(F.contains(d, F.lit("-")), F.replace(d, F.lit("-"), F.lit("")).try_cast("bigint")).otherwise(F.lit(0).cast("long"))


def pairs_text(json: Column | str, spaced: bool = False) -> Column:
    """A JSON object as text: "k":"v" joined by comma, or k:v joined by spaces without nulls."""
    entries = F.map_entries(F.from_json(_c(json), "map<string,string>"))
    if spaced:
        kept = F.filter(entries, lambda e: e["value"].isNotNull())
        return F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit(":"), e["value"])), " ")
    return F.array_join(F.transform(entries, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":"'), F.coalesce(e["value"], F.lit("null")), F.lit('"'))), ", ")


def bleu(candidate: Column | str, reference: Column | str, most: int = 4) -> Column:
    """Sentence BLEU of white-space words, n-grams up to `most`, add-one smoothing from bigrams on, with the brevity penalty.

    The nth occurrence of an n-gram is one of its own, so that clipped matches are an intersection of sets.
    """
    bound = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)  # noqa: E731  # x is made once, not once an element

    def grams(w: Column, n: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, made).otherwise(F.array().cast("array<string>"))

    def numbered(w: Column, n: int) -> Column:
        return bound(F.array_sort(grams(w, n)), lambda s: F.transform(s, lambda g, i: F.concat(g, F.lit("\n"), (i - F.array_position(s, g)).cast("string"))))

    def whole(c: Column, r: Column) -> Column:
        logs = []
        for n in range(1, most + 1):
            plus = 0 if n == 1 else 1
            hits = F.size(F.array_intersect(numbered(c, n), numbered(r, n)))
            logs.append(F.log((hits + plus) / F.greatest(F.size(c) - n + 1 + plus, F.lit(1))))
        brevity = F.least(F.lit(1.0), F.exp(1 - F.size(r) / F.greatest(F.size(c), F.lit(1))))
        scored = F.coalesce(brevity * F.exp(sum(logs[1:], logs[0]) / most), F.lit(0.0))
        return F.when((F.size(c) == 0) | (F.size(r) == 0), F.lit(0.0)).otherwise(scored)

    return bound(F.struct(words(candidate).alias("c"), words(reference).alias("r")), lambda w: whole(w["c"], w["r"]))
