"""URL functions and keyword rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlake.functions.pytext import col, contains_any, contains_any_sql, literal

#: Alphabetical, parted by |. In TRIAGE_SKIP "rti" is part of words like "article", as in the rules
#: this follows; triage(whole_words=True) matches whole words instead.
TRIAGE_KEEP = "agri|agriculture|crop|disease|farmer|fertiliser|fertilizer|fruit|guide|handbook|horticulture|indian farming|indian horticulture|indigenous|innovation|irrigation|itk|kheti|manual|package|pest|research|seed|soil|technology|traditional|vegetable|weed"
TRIAGE_SKIP = "accounts|achievement|achievements|advertisement|annual report|annual reports|audit|career|circular|directory|event|finance|gallery|meeting|minutes|monthly achievements|monthly summary|newsletter|notice|office order|pension|photo|press release|procurement|recruitment|rti|telephone|tender|vacancy|video"
JUNK = "account|audit|career|circular|contact|copyright|event|feedback|gallery|login|notice|notification|photo|privacy|telephone|tender|vacancy|video|webmail"
CATEGORIES = {"books": "book|ebook|guide|manual", "magazines": "indian farming|indian horticulture|journal|kheti|magazine", "publications": "bulletin|catalogue|publication", "reports": "annual report|dare|report"}
OTHER = "html_articles"
FAQ = "faq|frequently asked questions|" + " ".join(("अक्सर", "पूछे जाने", "वाले प्रश्न"))


_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"


def slug(url: str | Column) -> Column:
    """The last segment of the path with all but letters, digits, Devanagari, _ and - as _, 100
    characters at most; "home" for an empty path. It is the document's id."""
    path = F.regexp_replace(F.regexp_extract(F.coalesce(col(url), F.lit("")), _PATH, 1), "^/+|/+$", "")
    last = F.element_at(F.split(path, "/", -1), -1)
    clean = F.regexp_replace(F.when(path == "", F.lit("home")).otherwise(last), r"[^a-zA-Z0-9\x{0900}-\x{097F}_-]", "_")
    return F.substring(clean, 1, 100)


def slug_sql(e: str) -> str:
    path = f"regexp_replace(regexp_replace(regexp_extract(coalesce({e}, ''), {literal(_PATH)}, 1), '^/+', ''), '/+$', '')"
    return f"substr(regexp_replace(CASE WHEN {path} = '' THEN 'home' ELSE string_split({path}, '/')[-1] END, {literal('[^a-zA-Z0-9' + chr(92) + 'x{0900}-' + chr(92) + 'x{097F}_-]')}, '_', 'g'), 1, 100)"


def is_content_url(url: str | Column, marks: tuple[str, ...] = ("?lgn=hi", "/viewcontent/")) -> Column:
    out = F.lit(True)
    for m in marks:
        out = out & F.coalesce(col(url).contains(m), F.lit(False))
    return out


def is_junk_url(url: str | Column, keywords: str = JUNK) -> Column:
    return contains_any(url, keywords)


def triage(url: str | Column, skip: str = TRIAGE_SKIP, keep: str = TRIAGE_KEEP, whole_words: bool = False) -> Column:
    """"SKIP" before "KEEP" before "REVIEW", by the keywords in the URL."""
    if whole_words:
        text = F.coalesce(F.lower(col(url)), F.lit(""))
        hit = lambda ks: text.rlike(rf"(?<![a-z])(?:{ks})(?![a-z])")
    else:
        hit = lambda ks: contains_any(url, ks)
    return F.when(hit(skip), "SKIP").when(hit(keep), "KEEP").otherwise("REVIEW")


def triage_sql(e: str, skip: str = TRIAGE_SKIP, keep: str = TRIAGE_KEEP) -> str:
    return f"CASE WHEN {contains_any_sql(e, skip)} THEN 'SKIP' WHEN {contains_any_sql(e, keep)} THEN 'KEEP' ELSE 'REVIEW' END"


def about(*columns: str | Column) -> Column:
    """A page's title, description and URL as one text, to look for keywords in."""
    return F.concat_ws(" ", *[F.coalesce(col(c), F.lit("")) for c in columns])


def categories(text: str | Column, rules: dict[str, str] | None = None, other: str = OTHER) -> Column:
    """All categories of which the text holds a keyword; the other one if none."""
    found = F.array_compact(F.array(*[F.when(contains_any(text, ks), F.lit(name)) for name, ks in (rules or CATEGORIES).items()]))
    return F.when(F.size(found) == 0, F.array(F.lit(other))).otherwise(found)


def categories_sql(e: str, rules: dict[str, str] | None = None, other: str = OTHER) -> str:
    found = "list_filter([" + ", ".join(f"CASE WHEN {contains_any_sql(e, ks)} THEN {literal(name)} END" for name, ks in (rules or CATEGORIES).items()) + "], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({found}) = 0 THEN [{literal(other)}] ELSE {found} END"


def is_faq(*columns: str | Column) -> Column:
    return contains_any(F.concat_ws(" ", *[F.coalesce(col(c), F.lit("")) for c in columns]), FAQ)
