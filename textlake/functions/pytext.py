"""Text primitives with the reference's Unicode rules, as column expressions.

White space, digits and word characters are spelt out as classes, because Java's defaults are ASCII
and the reference's are Unicode. The same classes work in DuckDB's RE2, so the oracles share them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_NO_SPACE = r"\x09-\x0D\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_WS = rf"\x20{_NO_SPACE}"
WS = f"[{_WS}]"  #: what str.isspace calls white space
RUNS = f" {WS}+|[{_NO_SPACE}]{WS}*"  #: all runs of white space but those that are one space already
DIGIT = r"\p{Nd}"
NOT_WORD_DEVANAGARI_WS = rf"[^\p{{L}}\p{{N}}_\x{{0900}}-\x{{097F}}{_WS}]"
DEVANAGARI = r"[\x{0900}-\x{097F}]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once; a column used inside a lambda would be for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


@dataclass(frozen=True)
class Steps:
    """An ordered list of replacements: (pattern, replacement) pairs, plain where is_plain says so.

    apply gives the Spark expression, sql the same for DuckDB. Groups are written \\1. trim takes
    plain spaces off the ends, where no other white space can be.
    """

    steps: tuple[tuple[str, str, bool], ...] = ()

    def regex(self, pattern: str, by: str = "") -> Steps:
        return Steps((*self.steps, (pattern, by, False)))

    def plain(self, text: str, by: str = "") -> Steps:
        return Steps((*self.steps, (text, by, True)))

    def trim(self) -> Steps:
        return self.plain("", "")

    def then(self, other: Steps) -> Steps:
        return Steps(self.steps + other.steps)

    def apply(self, c: str | Column) -> Column:
        out = F.coalesce(col(c).cast("string"), F.lit(""))
        for pattern, by, plain in self.steps:
            out = (F.replace(out, F.lit(pattern), F.lit(by)) if pattern else F.trim(out)) if plain else F.regexp_replace(out, pattern, by.replace("\\", "$"))
        return out

    def sql(self, expression: str) -> str:
        out = f"coalesce({expression}, '')"
        for pattern, by, plain in self.steps:
            out = (f"replace({out}, {literal(pattern)}, {literal(by)})" if pattern else f"trim({out}, ' ')") if plain else f"regexp_replace({out}, {literal(pattern)}, {literal(by)}, 'g')"
        return out


STRIP = Steps().regex(rf"^{WS}+|{WS}+$")
COLLAPSE = Steps().regex(RUNS, " ").trim()


def strip(c: str | Column) -> Column:
    """c without white space at its ends; null stays null."""
    return F.regexp_replace(col(c), rf"^{WS}+|{WS}+$", "")


def strip_sql(e: str) -> str:
    return f"regexp_replace(regexp_replace({e}, {literal(f'^{WS}+')}, ''), {literal(f'{WS}+$')}, '')"


def words(c: str | Column) -> Column:
    """The words of c as str.split() gives them."""
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), f"{WS}+", -1), lambda w: w != "")


def words_sql(e: str) -> str:
    return f"list_filter(string_split_regex(coalesce({e}, ''), {literal(f'{WS}+')}), lambda w: w <> '')"


def word_count(c: str | Column) -> Column:
    """How many words str.split() gives; the empty parts that white space at an end makes are taken off."""
    text = F.coalesce(col(c), F.lit(""))
    blank = lambda at: F.substring(text, at, 1).rlike(WS).cast("int")
    return F.when(text == "", 0).otherwise(F.size(F.split(text, f"{WS}+", -1)) - blank(1) - blank(-1))


def contains_any(c: str | Column, keywords: str) -> Column:
    """Whether lower(c) holds any of the keywords, which are parted by |; null is false."""
    text = F.coalesce(F.lower(col(c)), F.lit(""))
    out = F.lit(False)
    for k in keywords.split("|"):
        out = out | text.contains(k)
    return out


def contains_any_sql(e: str, keywords: str) -> str:
    return "(" + " OR ".join(f"contains(coalesce(lower({e}), ''), {literal(k)})" for k in keywords.split("|")) + ")"
