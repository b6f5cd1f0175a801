"""Sections of a transcript, and speech without the banners of speakers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callscope.functions.text import once, strip

STOP = r"(?i)^(questions and answers|q&a|operator)$"
QUESTIONS = r"(?i)^(questions and answers|q&a)$"
MARK = r"\n[ \t]*+[-=]{5,}+[ \t]*+(?=\n|\z)"  # a separator line, with the end of the line before
BREAK = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"  # all that ends a line


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), BREAK)


def _first(rows: Column, test) -> Column:
    return F.array_position(F.transform(rows, lambda x: test(strip(x))), True)


def presentation(body: Column) -> Column:
    """Lines after Presentation up to a heading of questions or the operator; nothing if such a heading comes first."""

    def cut(rows, at, stop):
        n = F.when(stop > 0, stop - at - 1).otherwise(F.size(rows))
        return F.when((at > 0) & ((stop == 0) | (stop > at)), strip(F.array_join(F.slice(rows, (at + 1).cast("int"), n.cast("int")), "\n"))).otherwise(F.lit(""))

    def found(rows):
        return once(F.struct(_first(rows, lambda x: x == "Presentation").alias("at"), _first(rows, lambda x: x.rlike(STOP)).alias("stop")), lambda p: cut(rows, p["at"], p["stop"]))

    return once(lines(body), found)


def questions(body: Column) -> Column:
    """Lines after the first heading of questions."""

    def cut(rows, at):
        return F.when(at > 0, strip(F.array_join(F.slice(rows, (at + 1).cast("int"), F.size(rows)), "\n"))).otherwise(F.lit(""))

    return once(lines(body), lambda rows: once(_first(rows, lambda x: x.rlike(QUESTIONS)), lambda at: cut(rows, at)))


def spoken(text: Column, strict: bool = False) -> Column:
    """Without separator lines and the two lines after each.

    A separator among those two is passed over with them, so the next one counts. strict drops only a line between two
    separators, with them. One pass from the left over the text: each line is looked at once.
    """
    gone = f"{MARK}\\n[^\\n]*+{MARK}" if strict else MARK + r"(?:\n[^\n]*+){0,2}"
    return strip(F.regexp_replace(F.concat(F.lit("\n"), F.regexp_replace(F.coalesce(text, F.lit("")), BREAK, "\n")), gone, ""))


def match_text(body: Column, strict: bool = False) -> Column:
    """Presentation and questions, cleaned: what keywords are matched in."""
    return spoken(F.concat(presentation(body), F.lit("\n\n"), questions(body)), strict)
