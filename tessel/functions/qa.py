"""Question-answering record shaping as column builders.

A record line is ``question \\n [options \\n] [context] <TAB> answer`` where ``\\n`` is a backslash and an n; several answers are
written ``#!#a#!#b#!#``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessel.functions import text as T

SEPARATOR, MANY = "\\n", "#!#"
#: Fixed value: what precedes a rationale's answer, compared without case.
ANSWER_PREFIX = "so the answer is"


def answers(x: Column) -> Column:
    """One answer, or the several of an encoded list; its outer # and ! are stripped as a set of characters."""
    bare = T.strip(x)
    many = F.transform(F.split(F.regexp_replace(bare, "^[#!]+|[#!]+$", ""), MANY), T.strip)
    return F.when(bare.startswith(MANY), many).otherwise(F.array(bare))


def parse(question: Column) -> Column:
    """struct(q_only, mc_options, context); options and context are null without a separator."""

    def build(parts: Column) -> Column:
        second = T.strip(F.get(parts, F.lit(1)))
        has_options = second.startswith("(A)")
        third = F.coalesce(T.strip(F.get(parts, F.lit(2))), F.lit(""))
        return F.struct(
            T.strip(F.get(parts, F.lit(0))).alias("q_only"),
            F.when(second.isNotNull(), F.when(has_options, second).otherwise("")).alias("mc_options"),
            F.when(second.isNotNull(), F.when(has_options, third).otherwise(second)).alias("context"),
        )

    return T.let(F.split(question, r"\\n"), build)


def options(mc: Column) -> Column:
    """Option texts after the markers (A) to (H), trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(mc, r"\([A-H]\) "), T.strip), lambda o: o != "")


def options_by_token(mc: Column) -> Column:
    """Option texts between markers (A) to (Z) that stand as words of their own; blanks squeezed."""
    marked = F.regexp_replace(T.squeeze(mc), r"(^| )\([A-Z]\)(?= |$)", "\x01")
    return F.filter(F.transform(F.split(marked, "\x01"), lambda o: F.trim(o)), lambda o: o != "")


def option_after(context: Column, letter: str) -> Column:
    """The text after ``(letter)`` up to the next opening bracket; empty if the marker is not there."""
    return T.strip(F.regexp_extract(context, rf"\({letter}\)([^(]*)", 1))


def example(question: Column, context: Column, answer: Column) -> Column:
    """The record line of a question, a context (or null) and an answer (or null)."""
    bare = lambda x: F.regexp_replace(T.strip(x), r"[\n\t]", "")
    q = F.concat(F.regexp_replace(bare(question), r"[.!?]$", ""), F.lit("?"))
    q = F.regexp_replace(q, r"\?\?$", "?")
    c = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit(" "), bare(context))).otherwise("")
    a = F.when(F.coalesce(answer, F.lit("")) != "", F.concat(F.lit(" \t"), bare(answer))).otherwise("")
    return F.concat(q, F.lit(" \\n"), c, a)


def encode_answers(many: Column) -> Column:
    return F.concat(F.lit(MANY), F.array_join(many, MANY), F.lit(MANY))


def context(mc: Column, para: Column) -> Column:
    """Options, paragraph, both with a separator between, or null."""
    m, p = T.strip(F.coalesce(mc, F.lit(""))), T.strip(F.coalesce(para, F.lit("")))
    return F.when((m != "") & (p != ""), F.concat(m, F.lit(SEPARATOR), p)).when(m != "", m).when(p != "", p)


def reformat_title(x: Column) -> Column:
    """The first bracketed group without its brackets, blanks for underscores, a colon at its end."""
    group = F.regexp_extract(x, r"\([^)]*\)", 0)
    plain = F.translate(group, "_()", " \x01:")
    at = F.instr(x, group)
    return F.when(group == "", x).otherwise(
        F.concat(F.substring(x, 1, at - 1), F.replace(plain, F.lit("\x01"), F.lit("")), F.substring(x, at + F.length(group), F.lit(1 << 30)))
    )


def rationale(x: Column) -> Column:
    """struct(text, answer): the first line up to the last 'so the answer is', closed by a mark; what follows, without its stop."""
    line = T.strip(F.element_at(F.split(x, "\n", 2), 1))
    pattern = rf"(?is)^(.*){ANSWER_PREFIX}(.*)$"
    body = F.when(line.rlike(pattern), T.strip(F.regexp_extract(line, pattern, 1))).otherwise(line)
    answer = T.strip(F.regexp_replace(T.strip(F.regexp_extract(line, pattern, 2)), r"\.$", ""))
    return F.struct(T.close_sentence(body, T.SENTENCE_END).alias("text"), answer.alias("answer"))


def restate(question: Column, answer: Column) -> Column:
    """Question and answer as a statement: the answer fills the blank, or follows capitalised; options are dropped."""
    close = lambda x: T.close_sentence(x, T.SENTENCE_END)

    def build(parts: Column) -> Column:
        q, a = F.element_at(parts, 1), F.regexp_replace(T.strip(answer), r"\.+$", "")
        capital = F.concat(F.upper(F.substring(a, 1, 1)), F.lower(F.substring(a, 2, 1 << 30)))
        at = F.instr(q, " _ ")
        filled = F.concat(F.substring(q, F.lit(1), at), a, F.substring(q, at + 2, F.lit(1 << 30)))
        whole = F.when(at > 0, filled).otherwise(F.concat(close(q), F.lit(" "), capital))
        whole = F.replace(F.regexp_replace(close(F.regexp_replace(whole, r"\?+$", "")), f"{T.WS}+", " "), F.lit(" ."), F.lit("."))
        part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
        second = F.when((part(1) == "") | part(1).startswith("(A)"), "").otherwise(F.concat(close(part(1)), F.lit(" ")))
        third = F.when(part(2) == "", "").otherwise(F.concat(close(part(2)), F.lit(" ")))
        return F.concat(whole, F.lit(" "), second, third, F.lit("\\n"))

    parts = F.filter(F.transform(F.split(question, r"\\n"), T.strip), lambda p: p != "")
    return F.when(T.strip(answer) == "", question).otherwise(T.let(parts, build))


def decomposition(x: Column) -> Column:
    """'answer ## q1? a1 ## q2? a2' as struct(ans, steps array<struct(q, a)>): the last question mark ends a step's question."""
    parts = F.transform(F.split(x, "##"), T.strip)
    step = lambda s: F.struct(F.regexp_extract(s, r"^(.*\?)(?=.)", 1).alias("q"), T.strip(F.regexp_replace(s, r"^.*\?(?=.)", "")).alias("a"))
    return F.struct(F.element_at(parts, 1).alias("ans"), F.transform(F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda s: s != ""), step).alias("steps"))
