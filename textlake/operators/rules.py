"""Ordered rules: the first that holds gives the reason; rows without one are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import clean
from textlake.functions.pytext import DEVANAGARI, col, strip, word_count

Rule = tuple[str, Column]

#: Question patterns that go, parted by |, alphabetical; \b-free substring search without case.
BLACKLIST = "₹|अनुदान|आत्मा|आवेदन|इकाई लागत|उत्तराखंड|उत्पत्ति|ऋण|एनएमओओपी|एफपीओ|एफ\\.एम\\.सी\\.एस|ऑनलाइन आवेदन|ऑफलाइन आवेदन|कब शुरू|कहाँ आवेदन|कितना अनुदान|कितनी राशि|कितनी सहायता|किस वर्ष|गठन|गुजरात|झारखंड|ढूंडी|निगम|पोर्टल|प्रति किसान|प्रति दिन|प्रति माह|प्रति वर्ष|प्रधानमंत्री|प्रशिक्षण शुल्क|प्राधिकरण|प्रीमियम|प्रोत्साहन राशि|बजट|बिहार|बीज ग्राम|बीमा|मंत्रालय|मानदेय|मानधन|मुख्यमंत्री|मुख्यालय|योजना|राजस्थान|रुपये|लागत|लोन|विभाग|वेतन|वेबसाइट|शहजादापुर|सब्सिडी|समस्तीपुर|समिति|सहायता राशि|स्कीम|स्थापना|हरियाणा|हाजीपुर|हेल्पलाइन"
BAD_ENDINGS = tuple(f"{e}?" for e in "कब शुरू हुई|कहाँ आवेदन करें|कब शुरू हुआ|कहाँ स्थित है|किस वर्ष".split("|"))
CURRENCY = "करोड़|प्रतिशत अनुदान|रुपये|लाख|₹"
DIGITS_AT_MOST = 0.18


def first_reason(rules: list[Rule]) -> Column:
    """The name of the first rule that holds; null if none does. A null condition does not hold."""
    out = None
    for name, holds in rules:
        out = F.when(holds, F.lit(name)) if out is None else out.when(holds, F.lit(name))
    return out.otherwise(F.lit(None)) if out is not None else F.lit(None).cast("string")


def pair_rules(
    question: str | Column = "question", positive: str | Column = "positive", least_question: int = 4, most_question: int = 40, least_positive: int = 15, script: str = DEVANAGARI, mark: str = "?", most_marks: int = 2
) -> list[Rule]:
    """The rules for question and passage pairs, which clean_pair_text has cleaned."""
    q, p = col(question), col(positive)
    literal_mark = rf"\{mark}"
    return [
        ("empty_question", q == ""),
        ("empty_positive", p == ""),
        ("short_question", word_count(q) < least_question),
        ("long_question", word_count(q) > most_question),
        ("short_positive", word_count(p) < least_positive),
        ("no_hindi", ~clean.has_script(q, script)),
        ("missing_question_mark", ~q.endswith(mark)),
        ("multiple_question_marks", F.regexp_count(q, F.lit(literal_mark)) > most_marks),
        ("ocr_garbage", clean.has_garbage(q) | clean.has_garbage(p)),
        ("question_equals_positive", clean.normalise_question(q) == clean.normalise_question(p)),
        ("repeated_word", clean.is_repeated_word(q)),
    ]


def filter_pairs(pairs: DataFrame, order: list[str | Column], question: str = "question", positive: str = "positive", **rules) -> DataFrame:
    """pairs with remove_reason: that of the first rule, or duplicate_question for all but the first
    (in order) of the passing rows whose normalised questions are equal; null for kept rows."""
    found = pairs.withColumns({"__q": clean.clean_pair_text(question), "__p": clean.clean_pair_text(positive)})
    found = found.withColumn("__reason", first_reason(pair_rules("__q", "__p", **rules)))
    # only passing rows compete; a removed one has a key of its own, so they don't gather in one task
    alone = F.concat(F.lit("\0"), F.xxhash64(*order).cast("string"))
    key = F.when(F.col("__reason").isNull(), clean.normalise_question("__q")).otherwise(alone)
    later = F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1
    return found.withColumn("remove_reason", F.when(F.col("__reason").isNotNull(), F.col("__reason")).when(later, F.lit("duplicate_question"))).drop("__reason", "__q", "__p")


def final_rules(question: str | Column = "question", positive: str | Column = "positive", blacklist: str = BLACKLIST, endings: tuple[str, ...] = BAD_ENDINGS, currency: str = CURRENCY, most_digits: float = DIGITS_AT_MOST) -> list[Rule]:
    """The stateless rules of the last stage."""
    q, p = strip(F.coalesce(col(question), F.lit(""))), F.coalesce(col(positive), F.lit(""))
    ends = F.lit(False)
    for e in endings:
        ends = ends | q.endswith(e)
    return [
        ("blacklisted", q.rlike(f"(?iu){blacklist}")),
        ("too_short", F.length(q) <= 10),
        ("bad_ending", ends),
        ("mostly_digits", F.coalesce(clean.digit_ratio(p) > most_digits, F.lit(True))),
        ("currency", p.rlike(currency)),
    ]


def flag(c: str) -> Column:
    return F.coalesce(F.col(c).cast("boolean"), F.lit(False))


BAD_FLAGS = ("person_specific", "identity_lookup", "contact_information", "navigation_or_metadata", "encoding_problem")


def route_flags() -> Column:
    """REMOVE for any bad flag or no match; else KEEP if on the subject and reusable; else REVIEW."""
    bad = ~flag("question_answer_match")
    for c in BAD_FLAGS:
        bad = bad | flag(c)
    return F.when(bad, "REMOVE").when(flag("agriculture") & flag("reusable"), "KEEP").otherwise("REVIEW")


def flag_mask() -> Column:
    """Whether all flags are set as the last stage wants them; a null flag is neither true nor false."""
    out = F.col("reusable").eqNullSafe(True) & F.col("question_answer_match").eqNullSafe(True)
    for c in BAD_FLAGS:
        out = out & F.col(c).eqNullSafe(False)
    return out


def is_api_error(*columns: str | Column) -> Column:
    """Whether any of the columns starts with api_error."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(col(c).cast("string").startswith("api_error"), F.lit(False))
    return out


def reason_counts(df: DataFrame, reason: str = "remove_reason") -> DataFrame:
    """Rows by reason, the most first; kept rows do not count."""
    return df.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("n")).orderBy(F.desc("n"), reason)


def subject_rules(question: str | Column, positive: str | Column, unwanted: str, places: str, wanted: str | None = None) -> list[Rule]:
    """An optional rule set by keyword lists parted by |: unwanted words in the question or passage,
    place names in the question, and none of the wanted words."""
    q, p = F.coalesce(col(question), F.lit("")), F.coalesce(col(positive), F.lit(""))
    out = [("unwanted", q.rlike(f"(?iu){unwanted}") | p.rlike(f"(?iu){unwanted}")), ("place", q.rlike(f"(?iu){places}"))]
    return out if wanted is None else [*out, ("off_subject", ~q.rlike(f"(?iu){wanted}"))]
