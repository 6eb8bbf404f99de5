"""Grading of mathematical and other answers, as Column builders over replacement tables, and a registry of scorers."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import choice_letter, hash_answer, process_answer, qa_score, strip

#: Text that a final answer's normalisation replaces, in order.
REPLACED = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
#: Text that it removes, in order.
REMOVED = ["square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots"]
#: Text that comparing LaTeX replaces, in order.
LATEX = [("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")]


def braced(tail: Column) -> Column:
    """Contents of the first pair of braces, matched to any depth and length in one pass over the braces; null if they do not match."""
    step = lambda s, p: F.when(s["end"] > 0, s).otherwise(
        F.struct(
            (s["depth"] + F.when(p == "{", 1).when(p == "}", -1).otherwise(0)).alias("depth"),
            (s["at"] + F.length(p)).alias("at"),
            F.when((p == "}") & (s["depth"] == 1), s["at"] + 1).otherwise(0).alias("end"),
        )
    )
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))
    own = F.substr(tail, F.instr(tail, "{"))
    pieces = F.regexp_extract_all(own, F.lit(r"([{}]|[^{}]+)"), 1)
    end = F.when(F.instr(tail, "{") > 0, F.aggregate(pieces, start, step)["end"])
    return F.when(end > 0, F.substr(own, F.lit(2), end - 2))


def last_boxed(text: Column) -> Column:
    r"""Contents of the last \boxed{...}, braces matched, else of the last \fbox{...}; of `\boxed x`, where there is one, up to a dollar sign.

    null without one, and where the last one's braces do not match.
    """
    after = lambda marker: F.when(F.contains(text, F.lit(marker)), F.substring_index(text, marker, -1))
    spaced = F.substring_index(after("\\boxed "), "$", 1)
    return F.coalesce(spaced, braced(F.coalesce(after("\\boxed"), after("\\fbox"))))


def _replace_all(text: Column, table: list[tuple[str, str]]) -> Column:
    for a, b in table:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def latex_normal(text: Column) -> Column:
    """A LaTeX answer in a form that equal answers share: spaces, units and sizes go, fractions and roots get braces."""
    t = _replace_all(text, LATEX)
    t = F.regexp_replace(t, r"(?s)\\text\{ .*$", "")
    t = _replace_all(t, [("\\%", ""), (" .", " 0."), ("{.", "{0.")])
    t = F.regexp_replace(t, r"^\.", "0.")
    t = F.regexp_replace(t, r"(?s)^[^=]{0,2}=([^=]*)$", "$1")
    t = F.replace(F.regexp_replace(t, r"\\sqrt([^{])", r"\\sqrt{$1}"), F.lit(" "), F.lit(""))
    t = F.regexp_replace(F.regexp_replace(t, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}"), r"\\frac([^{])\{", r"\\frac{$1}{")
    t = F.when(t == "0.5", F.lit("\\frac{1}{2}")).otherwise(t)
    return F.regexp_replace(t, r"^(-?(?:0|[1-9]\d*))/(-?(?:0|[1-9]\d*))$", r"\\frac{$1}{$2}")


def latex_equal(a: Column, b: Column) -> Column:
    return F.coalesce(latex_normal(a) == latex_normal(b), a.isNull() & b.isNull())


def final_answer(text: Column) -> Column:
    """A final answer normalised: after the last =, units and words gone, markup unwrapped, numbers without commas."""
    t = F.substring_index(text, "=", -1)
    t = _replace_all(t, REPLACED + [(x, "") for x in REMOVED])
    t = F.regexp_replace(t, r".*?\$(.*?)\$.*", r"\$$1\$")
    for tag in ("text", "textbf", "overline"):
        t = F.regexp_replace(t, r"\\" + tag + r"\{(.*?)\}", "$1")
    t = F.regexp_replace(t, r"\\boxed\{(.*)\}", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"frac([^{])(.)", r"frac{$1}{$2}"), r"sqrt([^{])", r"sqrt{$1}")
    t = F.replace(t, F.lit("$"), F.lit(""))
    bare = F.replace(t, F.lit(","), F.lit(""))
    return strip(F.when(bare.rlike(r"^\d+$"), bare).otherwise(t))


def minerva(solution: Column, truth: Column) -> Column:
    """struct(score 1 or -1, acc, pred) by the last `Answer:` line of the last 300 characters."""
    found = F.try_element_at(F.regexp_extract_all(F.right(solution, F.lit(300)), F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), 1), F.lit(-1))
    pred = final_answer(F.coalesce(found, F.lit("[INVALID]")))
    acc = pred == final_answer(truth)
    return F.struct(F.when(acc, 1.0).otherwise(-1.0).alias("score"), acc.alias("acc"), pred.alias("pred"))


def strict_box(solution: Column, truth: Column) -> Column:
    """1 where the box in the last 100 characters equals the truth, else -1."""
    return F.when(F.coalesce(last_boxed(F.right(solution, F.lit(100))) == truth, F.lit(False)), 1.0).otherwise(-1.0)


def numbers_equal(a: Column, b: Column, tolerance: float = 1e-4) -> Column:
    """Are both numbers (percent signs, commas and simple fractions read) and within a relative tolerance?"""

    def value(x: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(F.trim(x), r"[,$]|\\%|%$", ""), r"^\\frac\{(-?[\d.]+)\}\{(-?[\d.]+)\}$", "$1/$2")
        top, low = F.substring_index(bare, "/", 1).try_cast("double"), F.substring_index(bare, "/", -1).try_cast("double")
        return F.when(F.contains(bare, F.lit("/")), F.try_divide(top, low)).otherwise(bare.try_cast("double"))

    x, y = value(a), value(b)
    return F.coalesce(F.abs(x - y) <= tolerance * F.greatest(F.abs(y), F.lit(1e-9)), F.lit(False))


def math_equal(given: Column, truth: Column) -> Column:
    """Equal as text, as LaTeX, as numbers, or element by element as tuples or intervals; symbolic equality is not tried."""
    inner = lambda x: F.regexp_extract(F.trim(x), r"^[\(\[](.*)[\)\]]$", 1)
    brackets = lambda x: F.concat(F.left(F.trim(x), F.lit(1)), F.right(F.trim(x), F.lit(1)))
    same = lambda p, q: (p == q) | latex_equal(p, q) | numbers_equal(p, q)
    a, b = F.split(inner(given), ","), F.split(inner(truth), ",")
    tuples = (inner(given) != "") & (inner(truth) != "") & (brackets(given) == brackets(truth)) & (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, same), lambda ok: F.coalesce(ok, F.lit(False)))
    return F.coalesce(same(given, truth) | tuples, F.lit(False))


#: Words of measure that an answer's number may carry.
UNITS = "degree|cm|centimeter|mm|km|kg|gram|meter|mile|second|minute|hour|day|week|month|year|foot|feet|inch|yard|liter|dollar|cent|point|unit|mph|percent"


def bare_answer(text: Column) -> Column:
    """An answer without its phrase, dollar signs, units and closing mark; a mixed number as a sum of halves, commas of thousands gone."""
    t = F.regexp_replace(strip(text), r"(?is)^.*?(?:final\s+)?answer\s*(?:is|:)\s*:?\s*", "")
    t = F.regexp_replace(F.replace(t, F.lit("$"), F.lit("")), r"\\text\{([^{}]*)\}", "$1")
    t = F.regexp_replace(t, r"\^?\{?\\circ\}?", "")
    t = F.regexp_replace(t, r"(?i)(?<=[\d}])\s*(?:" + UNITS + r")(?:es|s)?(?:\s*\^?\s*[23])?\.?$", "")
    t = F.regexp_replace(strip(t), r"[.]$", "")
    t = F.regexp_replace(t, r"(?<=\d),(?=\d{3}(?:\D|$))", "")
    whole, top, low = (F.regexp_extract(t, r"^(-?\d+)\s+(\d+)/(\d+)$", k).try_cast("bigint") for k in (1, 2, 3))
    mixed = F.when(t.rlike(r"^-?\d+\s+\d+/\d+$"), F.concat((whole * low + F.when(F.startswith(t, F.lit("-")), -top).otherwise(top)).cast("string"), F.lit("/"), low.cast("string")))
    return F.coalesce(mixed, strip(t))


def grade_answer(given: Column, truth: Column) -> Column:
    """math_equal() of both answers bare; false where either is null."""
    return math_equal(bare_answer(given), bare_answer(truth))


def letter_count_score(text: Column, truth: Column) -> Column:
    return F.when(F.coalesce(strip(last_boxed(text)) == truth, F.lit(False)), 1.0).otherwise(0.0)


def verdict(text: Column) -> Column:
    """1 where a judge's boxed verdict is True."""
    return F.when(F.coalesce(strip(last_boxed(text)) == "True", F.lit(False)), 1.0).otherwise(0.0)


def pass_rate(results: Column, most: int = 10) -> Column:
    """Share of passed cases among the first `most`; the results of running code are an input, code is never run here."""
    cases = F.slice(results, 1, most)
    return F.coalesce(F.try_divide(F.size(F.filter(cases, lambda ok: ok)), F.size(cases)), F.lit(0.0))


def infix_number(text: str | None) -> float | None:
    """Value of an infix expression by two stacks, so that no depth of parentheses is too much; null if malformed or not finite."""
    tight = {"+": 1, "-": 1, "*": 2, "/": 2, "@": 2, "~": 3}
    values: list[float] = []
    waiting: list[str] = []

    def apply() -> None:
        op = waiting.pop()
        w = values.pop()
        if op == "~":
            values.append(-w)
            return
        v = values.pop()
        values.append(v + w if op == "+" else v - w if op == "-" else v * w if op == "*" else v / w if op == "/" else 3 * v - 2 * w)

    operand = True  # is a number or an opening parenthesis next?
    try:
        for t in re.findall(r"\d+|[-+*/@()]", text or ""):
            if operand:
                if t.isdigit():
                    values.append(float(t))
                    operand = False
                elif t in "(-":
                    waiting.append("(" if t == "(" else "~")
                else:
                    return None
            elif t == ")":
                while waiting[-1] != "(":
                    apply()
                waiting.pop()
            elif t in tight:
                while waiting and waiting[-1] != "(" and tight[waiting[-1]] >= tight[t]:
                    apply()
                waiting.append(t)
                operand = True
            else:
                return None
        if operand:
            return None
        while waiting:
            if waiting[-1] == "(":
                return None
            apply()
        return values[0] if math.isfinite(values[0]) else None
    except (IndexError, ZeroDivisionError, OverflowError):
        return None


@F.pandas_udf(T.DoubleType())
def infix_value(texts: pd.Series) -> pd.Series:
    """Value of an infix expression of integers, + - * / @ (a @ b is 3a - 2b, as tight as *) and parentheses; null if malformed."""
    return pd.Series([infix_number(t) for t in texts], dtype="float64")


# --- scorers by data source

SCORERS: dict[str, Callable[[Column, Column], Column]] = {}


def register_scorer(name: str, build: Callable[[Column, Column], Column]) -> None:
    """A scorer builds a double column of (response, truth)."""
    if name in SCORERS:
        raise ValueError(f"scorer {name} exists")
    SCORERS[name] = build


register_scorer("hash", lambda r, t: F.coalesce((hash_answer(r) == t).cast("double"), F.lit(0.0)))
register_scorer("minerva", lambda r, t: minerva(r, t)["score"])
register_scorer("boxed", lambda r, t: F.coalesce(latex_equal(last_boxed(r), t), F.lit(False)).cast("double"))
register_scorer("qa", lambda r, t: qa_score(r, F.array(t)))
register_scorer("choice", lambda r, t: F.coalesce((choice_letter(r) == t).cast("double"), F.lit(0.0)))
register_scorer("process", process_answer)


def score(source: Column, response: Column, truth: Column, sources: dict[str, str]) -> Column:
    """The score by the scorer of each data source; a source that has none is an error."""
    out = None
    for name, scorer in sources.items():
        own = SCORERS[scorer](response, truth)
        out = F.when(source == name, own) if out is None else out.when(source == name, own)
    return out.otherwise(F.raise_error(F.concat(F.lit("no scorer for "), F.coalesce(source, F.lit("null")))).cast("double"))
