"""Conversations and documents reshaped into training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import date_number, strip
from ..sources.scratch import written

SYSTEM = "Answer the question step by step."


def chunk_rows(docs: DataFrame, most: int | None = None) -> DataFrame:
    """(id, contents, last_modified_date, file_name, source_file) -> chunk rows; text cut to `most` characters if given."""
    text = F.substring("contents", 1, most) if most else F.col("contents")
    source = F.coalesce(F.nullif("file_name", F.lit("")), F.nullif("source_file", F.lit("")), F.lit(""))
    return docs.select("id", text.alias("text_chunk"), F.coalesce(date_number("last_modified_date"), F.lit(0).cast("long")).alias("publish_time"), source.alias("source"), F.struct(F.lit(0.0).alias("score")).alias("metadata"))


def question_answer(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, question, answer: the last user and the last assistant text, else ''."""
    role = F.upper("role")
    picked = turns.groupBy("conv_id").agg(
        F.max(F.when(role.isin("USER", "HUMAN"), F.struct("turn", "text"))).alias("q"),
        F.max(F.when(role == "ASSISTANT", F.struct("turn", "text"))).alias("a"),
    )
    return picked.select("conv_id", F.coalesce("q.text", F.lit("")).alias("question"), F.coalesce("a.text", F.lit("")).alias("answer"))


def messages(turns: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, messages in turn order."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def ordered_split(rows: DataFrame, order: str, ratio: float, head: int | None = None) -> DataFrame:
    """rows with split: the first floor(n * ratio) in order are train, the rest test; only the first `head` if given.

    Positions come from a range-partitioned sort and one offset a partition, not from one task's window.
    """
    placed = with_position(rows, order)
    if head is not None:
        placed = placed.filter(F.col("position") < head)
    n = placed.count()
    return placed.withColumn("split", F.when(F.col("position") < int(n * ratio), F.lit("train")).otherwise(F.lit("test")))


def with_position(rows: DataFrame, order: str) -> DataFrame:
    """rows with position, 0-based in order: counts by partition of a range partitioning, then row numbers within.

    The partitioned rows are written once: the counts and the numbers come from the same partitions, whatever is planned anew.
    """
    numbered = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("part_", F.spark_partition_id()).withColumn("in_part_", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    parted = written(numbered, "positions")
    counts = parted.groupBy("part_").agg((F.max("in_part_") + 1).alias("n_"))
    before = counts.select("part_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    return parted.join(F.broadcast(before), "part_").withColumn("position", F.col("before_") + F.col("in_part_")).drop("part_", "in_part_", "before_")


def rl_sample(rows: DataFrame, source: Column, question: Column, truth: Column, index: Column, split: str = "train", ability: str = "qa", system: str = SYSTEM, tag: str = "") -> DataFrame:
    """A reinforcement-learning sample a row: data_source, prompt, ability, reward_model, extra_info."""
    say = lambda role, x: F.struct(F.lit(role).alias("role"), x.alias("content"))
    return rows.select(
        F.concat(F.lit(tag), source).alias("data_source"),
        F.array(say("system", F.lit(system)), say("user", question)).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), index.alias("index"), truth.alias("answer"), question.alias("question")).alias("extra_info"),
    )


def preference_rows(pairs: DataFrame) -> DataFrame:
    """(id, prompt, chosen, rejected) -> two rows each, the chosen response first."""
    both = F.array(F.struct(F.lit(0).alias("place"), F.col("chosen").alias("response")), F.struct(F.lit(1).alias("place"), F.col("rejected").alias("response")))
    return pairs.select("id", "prompt", F.inline(both))


def collapse(rows: DataFrame, keep: list[str], prompt: str, system: str = SYSTEM) -> DataFrame:
    """The kept columns, the prompt array with a system message before it, the rest packed as JSON extra_info."""
    rest = [c for c in rows.columns if c not in {*keep, prompt}]
    say = F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))
    return rows.select(*keep, F.concat(F.array(say), F.col(prompt)).alias(prompt), F.to_json(F.struct(*rest)).alias("extra_info"))


def latest_turn(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn_", F.row_number().over(w)).filter("rn_ = 1").drop("rn_")


def dedupe(rows: DataFrame, key: Column, position: str) -> DataFrame:
    """The first row, by position, of each value of key. Only digests and positions are shuffled to find them."""
    firsts = rows.groupBy(F.md5(key).alias("k_")).agg(F.min(position).alias(position)).drop("k_")
    return rows.join(firsts, position, "left_semi")


def content_parts(text: Column) -> Column:
    """Text cut at <image> and <video> markers into typed parts, empty texts left out."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)(<image>|<video>|(?:(?!<image>|<video>).)+)"), 1)
    kind = lambda p: F.when(p == "<image>", F.lit("image")).when(p == "<video>", F.lit("video")).otherwise(F.lit("text"))
    return F.transform(pieces, lambda p: F.struct(kind(p).alias("type"), F.when(kind(p) == "text", p).alias("text")))


def multi_turn_mask(msgs: Column) -> Column:
    """Per white-space token 1 in assistant messages, 0 elsewhere."""
    ones = lambda m: F.array_repeat((F.lower(m["role"]) == "assistant").cast("int"), F.size(F.filter(F.split(m["content"], r"\s+"), lambda w: w != "")))
    return F.flatten(F.transform(msgs, ones))


def roles_alternate(msgs: Column) -> Column:
    """After an optional system message: user, assistant, user and so on."""
    turns = F.filter(msgs, lambda m: F.lower(m["role"]) != "system")
    return F.forall(F.transform(turns, lambda m, i: F.lower(m["role"]) == F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))), lambda ok: ok)


def transcript_messages(text: Column) -> Column:
    """A transcript with <code>, <interpreter> and <answer> elements as messages: assistant, and tool for interpreter output."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)(<code>.*?</code>|<interpreter>.*?</interpreter>|<answer>.*?</answer>|(?:(?!<code>|<interpreter>|<answer>).)+)"), 1)
    role = lambda p: F.when(p.startswith("<interpreter>"), F.lit("tool")).otherwise(F.lit("assistant"))
    body = lambda p: strip(F.regexp_replace(p, r"^<(code|interpreter|answer)>|</(code|interpreter|answer)>$", ""))
    return F.filter(F.transform(pieces, lambda p: F.struct(role(p).alias("role"), body(p).alias("content"))), lambda m: m["content"] != "")


def multiple_choice(rows: DataFrame, id_col: str, right: str, wrong: list[str], seed: int = 0) -> DataFrame:
    """rows with choices (the right one and the wrong ones in an order by md5 of id and seed) and gold, the right one's letter."""
    key = lambda k: F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(k)), F.lit(str(seed))))
    options = F.array_sort(F.array(*[F.struct(key(k).alias("o"), F.col(c).alias("x"), F.lit(k == 0).alias("gold")) for k, c in enumerate([right, *wrong])]))
    letters = F.array(*[F.lit(chr(65 + i)) for i in range(len(wrong) + 1)])
    at = F.array_position(F.transform(options, lambda o: o["gold"]), F.lit(True))
    return rows.withColumn("choices", F.transform(options, lambda o: o["x"])).withColumn("gold", F.element_at(letters, at.cast("int")))


def letter_counts(spark, n: int, seed: int = 0) -> DataFrame:
    """A synthetic set: id, prompt, response (counting step by step), truth."""
    word = F.translate(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string"))), 1, 10), "0123456789", "aebtaesrae")
    letter = F.substring(F.lit("abcdef"), (F.col("id") % 6 + 1).cast("int"), F.lit(1))
    base = spark.range(n).select("id", word.alias("word"), letter.alias("letter"))
    count = F.length("word") - F.length(F.replace("word", F.col("letter"), F.lit("")))
    steps = F.array_join(F.transform(F.split("word", ""), lambda c: F.concat(c, F.when(c == F.col("letter"), F.lit(": yes")).otherwise(F.lit(": no")))), "; ")
    prompt = F.concat(F.lit("How many "), F.col("letter"), F.lit(" are in "), F.col("word"), F.lit("?"))
    return base.select("id", prompt.alias("prompt"), F.concat(steps, F.lit("; \\boxed{"), count.cast("string"), F.lit("}")).alias("response"), count.cast("string").alias("truth"))
