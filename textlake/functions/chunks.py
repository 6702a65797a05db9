"""Sentence splitters and chunkers.

Chunkers are folds over the sentences' sizes that carry index spans; the text is joined once, from
the spans. All stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions.pytext import COLLAPSE, WS, Steps, col, let, literal, strip, strip_sql, word_count, words_sql

SPANS = "array<struct<s:int,e:int>>"
_MARK = "\x01"


def _kept(parts: Column, longer_than: int) -> Column:
    blank = lambda s: F.substring(s, 1, 1).rlike(WS) | F.substring(s, -1, 1).rlike(WS)
    return F.filter(F.transform(parts, lambda s: F.when(blank(s), strip(s)).otherwise(s)), lambda s: F.length(s) > longer_than)


def _kept_sql(parts: str, longer_than: int) -> str:
    return f"list_filter(list_transform({parts}, lambda s: {strip_sql('s')}), lambda s: length(s) > {longer_than})"


def sentences_a(c: str | Column, ends: str = "।.!?", longer_than: int = 20) -> Column:
    """Parts after any of the ends and white space, stripped, longer than so many characters."""
    return _kept(F.split(F.coalesce(col(c), F.lit("")), rf"(?<=[{ends}]){WS}+", -1), longer_than)


def sentences_a_sql(e: str, ends: str = "।.!?", longer_than: int = 20) -> str:
    marked = Steps().regex(rf"([{ends}]){WS}+", rf"\1{_MARK}").sql(e)
    return _kept_sql(f"string_split({marked}, {literal(_MARK)})", longer_than)


_B = Steps().plain("\n", " ").regex(rf"([।!?]){WS}+", "\\1\n").regex(rf"\|{WS}*", "|\n").regex(rf":{WS}+", ":\n")


def sentences_b(c: str | Column) -> Column:
    """Parts after a danda, ! or ? and white space, after a bar, and after a colon and white space."""
    return _kept(F.split(_B.apply(c), "\n", -1), 5)


def sentences_b_sql(e: str) -> str:
    return _kept_sql(f"string_split({_B.sql(e)}, chr(10))", 5)


def sentences_c(c: str | Column) -> Column:
    """Parts of a page after a danda or full stop and white space."""
    return sentences_a(COLLAPSE.apply(c), "।.", 40)


def sentences_c_sql(e: str) -> str:
    return sentences_a_sql(COLLAPSE.sql(e), "।.", 40)


def word_spans(counts: Column, max_words: int) -> Column:
    """Spans of sentences, each as long as max_words allow (one at least), each starting with the
    last sentence of the one before; a final span of several is followed by its last sentence."""
    n = F.size(counts)
    span = lambda s, e: F.array(F.struct(s.cast("int").alias("s"), e.cast("int").alias("e")))
    make = lambda spans, start, held, last: F.struct(spans.alias("spans"), start.cast("int").alias("start"), held.cast("int").alias("held"), last.cast("int").alias("last"))

    def step(a: Column, x: Column) -> Column:
        i, w = x["i"], x["w"]
        full = F.concat(a["spans"], span(a["start"], i))
        again = make(full, i - 1, a["last"] + w, w)
        alone = make(F.concat(full, span(i - 1, i)), i, w, w)
        fits = (a["start"] == i) | (a["held"] + w <= max_words)
        return F.when(fits, make(a["spans"], a["start"], a["held"] + w, w)).when(i - a["start"] < 2, make(full, i, w, w)).when(a["last"] + w <= max_words, again).otherwise(alone)

    def finish(a: Column) -> Column:
        last = F.concat(a["spans"], span(a["start"], n))
        return F.when(n == 0, a["spans"]).when(n - a["start"] < 2, last).otherwise(F.concat(last, span(n - 1, n)))

    zero = F.lit(0)
    start = make(F.array().cast(SPANS), zero, zero, zero)
    return F.aggregate(F.transform(counts, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), start, step, finish)


def window_spans(counts: Column, max_words: int, overlap: int) -> Column:
    """Spans of sentences, each as long as max_words allow (one at least), each but the first starting
    overlap sentences before the end of the one before it, though at least one after its start."""
    make = lambda spans, i, j, held: F.struct(spans.alias("spans"), i.cast("int").alias("i"), j.cast("int").alias("j"), held.cast("int").alias("held"))

    def spans(w: Column) -> Column:
        n = F.size(w)

        def step(a: Column, _: Column) -> Column:
            more = F.get(w, a["j"])
            longer = (a["j"] < n) & ((a["i"] == a["j"]) | (a["held"] + more <= max_words))
            again = F.greatest(a["j"] - overlap, a["i"] + 1)
            left = F.aggregate(F.slice(w, a["i"] + 1, again - a["i"]), F.lit(0), lambda s, x: s + x)
            closed = make(F.concat(a["spans"], F.array(F.struct(a["i"].alias("s"), a["j"].alias("e")))), again, a["j"], a["held"] - left)
            return F.when(a["i"] >= n, a).when(longer, make(a["spans"], a["i"], a["j"] + 1, a["held"] + more)).otherwise(closed)

        zero = F.lit(0)  # either end moves on at each step, so that twice as many as there are sentences do
        return F.aggregate(F.sequence(F.lit(0), 2 * n), make(F.array().cast(SPANS), zero, zero, zero), step, lambda a: a["spans"])

    return let(counts, spans)


def char_spans(lengths: Column, max_chars: int) -> Column:
    """Consecutive spans without overlap; a sentence goes on a span while the characters so far, one
    more for each sentence that was added, and its own are at most max_chars."""
    n = F.size(lengths)
    make = lambda spans, start, held: F.struct(spans.alias("spans"), start.cast("int").alias("start"), held.cast("int").alias("held"))

    def closed(a: Column, i: Column) -> Column:
        return F.when(i > a["start"], F.concat(a["spans"], F.array(F.struct(a["start"].alias("s"), i.cast("int").alias("e"))))).otherwise(a["spans"])

    def step(a: Column, x: Column) -> Column:
        return F.when(a["held"] + x["w"] <= max_chars, make(a["spans"], a["start"], a["held"] + x["w"] + 1)).otherwise(make(closed(a, x["i"]), x["i"], x["w"]))

    start = make(F.array().cast(SPANS), F.lit(0), F.lit(0))
    return F.aggregate(F.transform(lengths, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), start, step, lambda a: closed(a, n))


def joined(sentences: Column, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.array_join(F.slice(sentences, s["s"] + 1, s["e"] - s["s"]), " "))


def chunk_words(sentences: Column, max_words: int = 200, longer_than: int | None = 80, least_words: int | None = None, overlap: int = 1) -> Column:
    """array<struct<text, words, chars>>: overlapping chunks, of which those stay that are longer than
    so many characters, or have so many words. Words and characters are added up from the sentences',
    which are counted once, and only chunks that stay are put together."""

    def made(s: Column) -> Column:
        counted = F.transform(s, lambda x: F.struct(word_count(x).alias("w"), F.length(x).alias("n")))

        def spanned(c: Column) -> Column:
            w = F.transform(c, lambda x: x["w"])
            spans = word_spans(w, max_words) if overlap == 1 else window_spans(w, max_words, overlap)
            total = lambda p, of: F.aggregate(F.slice(c, p["s"] + 1, p["e"] - p["s"]), F.lit(0), lambda t, x: t + x[of])
            out = F.transform(spans, lambda p: F.struct(p.alias("p"), total(p, "w").alias("words"), (total(p, "n") + p["e"] - p["s"] - 1).alias("chars")))
            out = out if longer_than is None else F.filter(out, lambda x: x["chars"] > longer_than)
            return out if least_words is None else F.filter(out, lambda x: x["words"] >= least_words)

        return F.transform(let(counted, spanned), lambda x: F.struct(F.array_join(F.slice(s, x["p"]["s"] + 1, x["p"]["e"] - x["p"]["s"]), " ").alias("text"), x["words"].alias("words"), x["chars"].alias("chars")))

    return let(sentences, made)


def chunk_chars(sentences: Column, max_chars: int = 400, longer_than: int = 80) -> Column:
    made = let(sentences, lambda s: joined(s, char_spans(F.transform(s, F.length), max_chars)))
    return F.filter(made, lambda c: F.length(c) > longer_than)


def listed(df: DataFrame, items: Column, keep: list[str | Column], place: str, item: str) -> DataFrame:
    """keep, place (from 0) and item of each element of items.

    An inner posexplode would make Spark filter on the size of items first and so make them twice;
    the outer one does not.
    """
    return df.select(*keep, F.posexplode_outer(items).alias(place, item)).where(F.col(place).isNotNull())


# the same folds in DuckDB: list_reduce over states


def chunk_words_sql(sentences: str, max_words: int = 200) -> str:
    """Expression of all chunks of a list column (by name), before any filter."""
    state = f"list_transform(range(1, len({sentences}) + 1), lambda i: {{'spans': []::STRUCT(s INT, e INT)[], 'start': (i - 1)::INT, 'held': len({words_sql(f'{sentences}[i]')})::INT, 'last': (i - 1)::INT}})"
    full = "list_append(a.spans, {'s': a.start, 'e': x.start})"
    make = lambda spans, start, held, last: f"{{'spans': {spans}, 'start': ({start})::INT, 'held': ({held})::INT, 'last': ({last})::INT}}"
    step = (
        f"CASE WHEN a.start = x.start OR a.held + x.held <= {max_words} THEN {make('a.spans', 'a.start', 'a.held + x.held', 'x.held')} "
        f"WHEN x.start - a.start < 2 THEN {make(full, 'x.start', 'x.held', 'x.held')} "
        f"WHEN a.last + x.held <= {max_words} THEN {make(full, 'x.start - 1', 'a.last + x.held', 'x.held')} "
        f"ELSE {make(f'list_append({full}, {{' + chr(39) + 's' + chr(39) + ': (x.start - 1)::INT, ' + chr(39) + 'e' + chr(39) + ': x.start})', 'x.start', 'x.held', 'x.held')} END"
    )
    zero = make("[]::STRUCT(s INT, e INT)[]", "0", "0", "0")
    folded = f"list_reduce({state}, lambda a, x: {step}, {zero})"
    ends = f"list_transform([{folded}], lambda r: CASE WHEN len({sentences}) = 0 THEN r.spans WHEN len({sentences}) - r.start < 2 THEN list_append(r.spans, {{'s': r.start, 'e': len({sentences})::INT}}) ELSE list_concat(r.spans, [{{'s': r.start, 'e': len({sentences})::INT}}, {{'s': (len({sentences}) - 1)::INT, 'e': len({sentences})::INT}}]) END)[1]"
    return f"list_transform({ends}, lambda p: array_to_string({sentences}[p.s + 1 : p.e], ' '))"


def chunk_chars_sql(sentences: str, max_chars: int = 400, longer_than: int = 80) -> str:
    state = f"list_transform(range(1, len({sentences}) + 1), lambda i: {{'spans': []::STRUCT(s INT, e INT)[], 'start': (i - 1)::INT, 'held': length({sentences}[i])::INT}})"
    close = lambda i: f"CASE WHEN {i} > a.start THEN list_append(a.spans, {{'s': a.start, 'e': ({i})::INT}}) ELSE a.spans END"
    step = f"CASE WHEN a.held + x.held <= {max_chars} THEN {{'spans': a.spans, 'start': a.start, 'held': (a.held + x.held + 1)::INT}} ELSE {{'spans': {close('x.start')}, 'start': x.start, 'held': x.held}} END"
    folded = f"list_reduce({state}, lambda a, x: {step}, {{'spans': []::STRUCT(s INT, e INT)[], 'start': 0::INT, 'held': 0::INT}})"
    ends = f"list_transform([{folded}], lambda a: {close(f'len({sentences})')})[1]"
    return f"list_filter(list_transform({ends}, lambda p: array_to_string({sentences}[p.s + 1 : p.e], ' ')), lambda c: length(c) > {longer_than})"
