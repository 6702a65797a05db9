"""Cleaners and normalisers, each an ordered chain of replacements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlake.functions.pytext import COLLAPSE, DEVANAGARI, DIGIT, NOT_WORD_DEVANAGARI_WS, RUNS, STRIP, WS, Steps, col, literal, strip, strip_sql, words, words_sql

NAVIGATION = "Back|Next|अगला|अधिक जानकारी|ईमेल|ट्विटर|पिछला|प्रिंट|फेसबुक|मुख्य पृष्ठ|साझा करें|होम|होम पेज"
GARBAGE = "[\\x{FFFD}\\x{25A0}\\x{25A1}\\x{25C6}\\x{25FB}\\x{25FC}]"


SITE = r"\w+\s*-\s*Agriculture"  # a site's name and section behind page titles, as a pattern


def _passage(site: str = SITE) -> Steps:
    out = Steps().regex("[\\x{200C}\\x{200D}\\x{FEFF}]")
    for text in NAVIGATION.split("|"):
        out = out.plain(text, " ")
    out = out.regex(RUNS, " ").regex("[.]{2,}", ".").regex("।{2,}", "।")
    out = out.regex(rf"(?i)\|\s*{site}")
    out = out.regex("स्(?:त्)?रोत *[:：][^।]*").regex("लेख[कन] *[:：].*")
    return out.regex("इस +(?:पृष्ठ|भाग|लेख) +में.*?जानकारी +दी +(?:गई|गयी|है)।?").then(STRIP)


PASSAGE = _passage()
PAIR = COLLAPSE
QUESTION = Steps().regex(NOT_WORD_DEVANAGARI_WS).then(COLLAPSE)
EXTRACTED = Steps().plain("\r", "\n").regex("\n{3,}", "\n\n").regex("[ \t]+", " ").regex("\n +", "\n").then(STRIP)
FENCES = Steps().plain("```json").plain("```").then(STRIP)
INTRO = ("भाग", "लेख", "पृष्ठ")


def clean_passage(c: str | Column, site: str = SITE) -> Column:
    """A scraped passage without invisible marks, navigation, credits and the opening notice. site is
    the pattern of the site's name, which goes where it stands behind a bar."""
    return (PASSAGE if site == SITE else _passage(site)).apply(c)


def clean_pair_text(c: str | Column) -> Column:
    return PAIR.apply(c)


def clean_extracted(c: str | Column) -> Column:
    """Text got out of HTML: blank lines and spaces reduced, lines kept."""
    return EXTRACTED.apply(c)


def normalise_question(c: str | Column) -> Column:
    """Lower case, words and Devanagari only; two questions are the same if this is."""
    return QUESTION.apply(F.lower(PAIR.apply(c)))


def normalise_question_sql(e: str) -> str:
    return QUESTION.sql(f"lower({PAIR.sql(e)})")


def strip_intro(c: str | Column, nouns: tuple[str, ...] = INTRO, opening: str = "इस", inside: str = "में") -> Column:
    """c without an opening sentence of each form "opening noun inside ..."; null stays null."""
    out = strip(c)
    for noun in nouns:
        out = strip(F.regexp_replace(out, rf"(?is)^{opening}{WS}+{noun}{WS}+{inside}.*?[।|.!?]", ""))
    return out


def strip_intro_sql(e: str, nouns: tuple[str, ...] = INTRO, opening: str = "इस", inside: str = "में") -> str:
    out = strip_sql(e)
    for noun in nouns:
        out = strip_sql(f"regexp_replace({out}, {literal(rf'(?is)^{opening}{WS}+{noun}{WS}+{inside}.*?[।|.!?]')}, '')")
    return out


def is_repeated_word(c: str | Column) -> Column:
    """Four words or more, all the same."""
    w = words(c)
    return (F.size(w) >= 4) & (F.size(F.array_distinct(w)) == 1)


def is_repeated_word_sql(e: str) -> str:
    w = words_sql(e)
    return f"(len({w}) >= 4 AND len(list_distinct({w})) = 1)"


def has_script(c: str | Column, script: str = DEVANAGARI) -> Column:
    return F.coalesce(col(c), F.lit("")).rlike(script)


def has_garbage(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit("")).rlike(GARBAGE)


def digit_ratio(c: str | Column) -> Column:
    """The part of the characters that are digits of any script; null if there are none."""
    return F.try_divide(F.regexp_count(col(c), F.lit(DIGIT)).cast("double"), F.length(col(c)).cast("double"))


def after_thinking(c: str | Column, default: str = "No answer was given.") -> Column:
    """A model's answer behind its last </think>; a blank one is the default."""
    text = strip(F.substring_index(F.coalesce(col(c), F.lit("")), "</think>", -1))
    return F.when(text == "", F.lit(default)).otherwise(text)


def without_fences(c: str | Column) -> Column:
    """A model's JSON without the Markdown fences round it."""
    return FENCES.apply(c)
