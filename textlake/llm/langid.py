"""Language identification by interpolated Kneser-Ney character models.

One model per language over the letters of words (a word starts and ends with a space), orders 1 to
5. All models share one sorted array of n-gram hashes per order, with a row of discounted
probabilities and of back-off weights, one column per language. A text goes to the language with the
lowest cross-entropy per character; it is rejected (language "und") if it has no letters or if that
cross-entropy lies too far above what held-out texts of the language show, given its length, and also
nearer to that of the likest other language's texts, or of its own with their letters shuffled, than
to its own. So a text that is in part something else stays, as long as the language prevails. The
limits come from medians and a
quantile of the held-out texts, so a share of wrong labels among them does not move them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.common import cut, hash_u63, slices, small_side, spaced_units, text_or_empty

ORDER = 5
UNKNOWN = "und"
CLEAN = 0.9  # the part of held-out texts, the likest to their language, that sets the limits of rejection
_ALPHABET = 4096  # the uniform distribution under the unigrams: letters in use, generously
_ROWS = 1 << 18  # character positions scored at once
_R = np.random.default_rng(20240607).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Model:
    """languages, and per order: sorted hashes, discounted probabilities, back-off weights."""

    languages: list[str]
    hashes: list[np.ndarray] = field(default_factory=list)
    prob: list[np.ndarray] = field(default_factory=list)
    back: list[np.ndarray] = field(default_factory=list)
    base: np.ndarray | None = None
    mean: np.ndarray | None = None  # of held-out texts' cross-entropy, bits per character
    var_char: np.ndarray | None = None  # variance within texts, falls with the length
    var_text: np.ndarray | None = None  # variance between texts
    limit: np.ndarray | None = None  # largest accepted deviation
    near: np.ndarray | None = None  # bits per character half-way to what is another language, accepted whatever the deviation
    ceiling: np.ndarray | None = None  # largest accepted bits per character, however short the text


def letters(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Lower case, each run of anything but letters one space, none at the ends."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    return pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(col), r"[^\p{L}\p{M}]+", " "), " ")


def _codes(units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all units, each closed by a space, and their offsets."""
    closed = pc.binary_join_element_wise(units, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    lengths = np.asarray(pc.utf8_length(closed), np.int64)
    text = b"".join(closed.cast(pa.large_binary()).to_pylist()).decode() if len(closed) else ""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64), np.concatenate([[0], np.cumsum(lengths)])


def _grams(codes: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, hash of the n-gram that ends at each position, whether it lies within its unit)."""
    place = np.arange(len(codes)) - np.repeat(off[:-1], np.diff(off))
    h = np.zeros(len(codes), np.uint64)
    for m in range(1, ORDER + 1):
        shifted = np.zeros_like(codes)
        shifted[m - 1 :] = codes[: len(codes) - m + 1] if m > 1 else codes
        h = h + (shifted + np.uint64(m << 32)) * _R[m]
        yield m, h ^ (h >> np.uint64(29)), place >= m - 1


def fit(texts: dict[str, list[str]], held_out: dict[str, list[str]]) -> Model | None:
    """Models of the languages' texts; None if there are no texts with letters."""
    counted = {}
    for lang in sorted(texts):
        units, pieces, _ = spaced_units(letters(pa.array(texts[lang], pa.large_string())))
        if len(units):
            codes, off = _codes(units)
            counted[lang] = (codes, off, np.repeat(np.bincount(pieces, minlength=len(units)), np.diff(off)))
    if not counted:
        return None
    model = Model(list(counted))
    per: list[list[tuple]] = [[] for _ in range(ORDER + 1)]  # by order: (hashes, prob, contexts, back) of each language
    base = []
    for codes, off, weight in counted.values():
        place = np.arange(len(codes)) - np.repeat(off[:-1], np.diff(off))
        grams = {m: (h, ok) for m, h, ok in _grams(codes, off)}
        for m in range(1, ORDER + 1):
            h, ok = grams[m]
            predicted = ok & (place > 0)
            first, ctx_at = np.unique(h[predicted], return_index=True)
            at = np.flatnonzero(predicted)[ctx_at]
            raw = np.bincount(np.searchsorted(first, h[predicted]), weights=weight[predicted], minlength=len(first))
            if m < ORDER:  # continuation counts, but of n-grams that open a word, which nothing precedes
                longer, inner = grams[m + 1]
                inside = inner & (place > 0)
                _, one = np.unique(longer[inside], return_index=True)
                cont = np.bincount(np.searchsorted(first, h[np.flatnonzero(inside)[one]]), minlength=len(first))
                opens = place[at] == m - 1
                raw = np.where(opens & (m > 1), raw, np.maximum(cont, 1))
            once, twice = (raw == 1).sum(), (raw == 2).sum()
            d = min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
            if m == 1:
                ctx, inv = np.zeros(1, np.uint64), np.zeros(len(first), np.int64)
            else:
                ctx, inv = np.unique(grams[m - 1][0][at - 1], return_inverse=True)
            total, kinds = np.bincount(inv, weights=raw), np.bincount(inv)
            back = d * kinds / total
            per[m].append((first, np.maximum(raw - d, 0) / total[inv], ctx, back))
            if m == 1:
                base.append(back[0])
    langs = len(counted)
    model.base = np.array(base, np.float32) / _ALPHABET
    for m in range(1, ORDER + 1):
        ctx_of = per[m + 1] if m < ORDER else []
        hashes = np.unique(np.concatenate([x[0] for x in per[m]] + [x[2] for x in ctx_of]))
        prob, back = np.zeros((len(hashes) + 1, langs), np.float32), np.ones((len(hashes) + 1, langs), np.float32)
        for k, x in enumerate(per[m]):
            prob[np.searchsorted(hashes, x[0]), k] = x[1]
        for k, x in enumerate(ctx_of):
            back[np.searchsorted(hashes, x[2]), k] = x[3]
        model.hashes.append(hashes), model.prob.append(prob), model.back.append(back)
    return _calibrate(model, held_out, texts)


def _score_units(model: Model, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each unit: bits by language, squared bits by language, characters predicted."""
    langs = len(model.languages)
    bits, squares, chars = np.zeros((len(units), langs)), np.zeros((len(units), langs)), np.zeros(len(units), np.int64)
    size = np.asarray(pc.utf8_length(units), np.int64) + 1
    ends = np.cumsum(size)
    a = 0
    while a < len(units):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _ROWS)))
        codes, off = _codes(units[a:b])
        p, found = np.repeat(model.base[None], len(codes), 0), None
        for m, h, ok in _grams(codes, off):
            table = model.hashes[m - 1]
            at = np.searchsorted(table, h)
            at[at == len(table)] = 0
            at = np.where(ok & (table[at] == h), at, len(table))
            if m == 1:
                p += model.prob[0][at]
            else:
                ctx = np.empty_like(found)
                ctx[1:], ctx[0] = found[:-1], len(model.hashes[m - 2])
                ctx[~ok] = len(model.hashes[m - 2])
                p *= model.back[m - 2][ctx]
                p += model.prob[m - 1][at]
            found = at
        x = -np.log2(p)
        x[off[:-1]] = 0  # the opening space is given
        bits[a:b], squares[a:b], chars[a:b] = np.add.reduceat(x, off[:-1], 0), np.add.reduceat(x * x, off[:-1], 0), np.diff(off) - 1
        a = b
    return bits, squares, chars


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values[off[i]:off[i+1]]; empty ranges give 0."""
    out = np.zeros((len(off) - 1, *values.shape[1:]), values.dtype)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        out[some] = np.add.reduceat(values, off[some], 0)
    return out


class Known:
    """Figures of words seen before, up to so many numbers; words come again and again."""

    def __init__(self, model: Model, numbers: int = 1 << 20) -> None:
        self.model, self.most = model, numbers // (len(model.languages) + 1)
        self.units = pa.array([], pa.large_string())
        self.bits, self.chars = np.zeros((0, len(model.languages))), np.zeros(0, np.int64)

    def of(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits by language and characters of distinct units."""
        at = np.asarray(pc.fill_null(pc.index_in(units, self.units), -1), np.int64)
        new = np.flatnonzero(at < 0)
        fresh = units.take(pa.array(new))
        b, _, c = _score_units(self.model, fresh)
        bits, chars = np.empty((len(units), b.shape[1])), np.empty(len(units), np.int64)
        old = at >= 0
        bits[old], chars[old] = self.bits[at[old]], self.chars[at[old]]
        bits[new], chars[new] = b, c
        room = self.most - len(self.units)
        if room > 0 and len(new):
            self.units = pa.concat_arrays([self.units, fresh[:room]])
            self.bits, self.chars = np.concatenate([self.bits, b[:room]]), np.concatenate([self.chars, c[:room]])
        return bits, chars


def score(model: Model, col: pa.Array | pa.ChunkedArray, known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bits per character by language (inf without letters), and the characters predicted."""
    units, pieces, off = spaced_units(letters(col))
    bits, chars = (known or Known(model, 0)).of(units)
    n = _sums(chars[pieces], off)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n[:, None] > 0, _sums(bits[pieces], off) / n[:, None], np.inf), n


def shuffled(texts: list[str], seed: int = 3) -> list[str]:
    """The texts' letters in another order, words of the same lengths."""
    rng, out = np.random.default_rng(seed), []
    for t in letters(pa.array(texts, pa.large_string())).to_pylist():
        x = np.array(list(t))
        at = np.flatnonzero(x != " ")
        x[at] = x[rng.permutation(at)]
        out.append("".join(x))
    return out


def _calibrate(model: Model, held_out: dict[str, list[str]], texts: dict[str, list[str]]) -> Model:
    langs = len(model.languages)
    model.mean, model.var_char, model.var_text, model.limit, model.ceiling = (np.zeros(langs) for _ in range(5))
    last, other = None, np.full((langs, langs), np.inf)  # the median of each language's texts by each model
    for k, lang in enumerate(model.languages):
        own = held_out.get(lang) or texts[lang]
        if own is not last:  # one list may serve all
            units, pieces, off = spaced_units(letters(pa.array(own, pa.large_string())))
            bits, squares, chars = _score_units(model, units)
            noise, _ = score(model, pa.array(shuffled(own), pa.large_string()))
            last = own
        n = _sums(chars[pieces], off)
        has = n > 0
        every = _sums(bits[pieces], off)[has] / n[has, None]
        ce, within = every[:, k], _sums(squares[pieces][:, k], off)[has] / n[has]
        if not len(ce):
            model.mean[k], model.var_char[k], model.limit[k], model.ceiling[k] = 4, 16, 8, 12
            continue
        model.mean[k] = np.median(ce)
        other[k] = np.median(every, 0)
        other[k, k] = np.median(noise[has, k])
        # the characters of a word hang together: three times the variance of single ones
        model.var_char[k] = 3 * max(1e-6, float(np.average(within, weights=n[has]) - np.average(ce, weights=n[has]) ** 2))
        model.var_text[k] = (1.4826 * np.median(np.abs(ce - model.mean[k]))) ** 2
        z = (ce - model.mean[k]) / np.sqrt(model.var_char[k] / n[has] + model.var_text[k] + 1e-9)
        model.limit[k] = max(8.0, 1.5 * float(np.quantile(z, CLEAN)))
        model.ceiling[k] = max(3 * model.mean[k], 1.5 * float(np.quantile(ce, CLEAN)))
    least = other.min(0)
    model.near = np.where(np.isfinite(least), (model.mean + least) / 2, 0)
    return model


def decide(model: Model, col: pa.Array | pa.ChunkedArray, known: Known | None = None) -> dict[str, np.ndarray]:
    """lang, bits_per_char, margin to the runner-up and deviation, one of each per text."""
    ce, n = score(model, col, known)
    best = ce.argmin(1)  # ties: the first language in alphabetical order
    row = np.arange(len(best))
    low = ce[row, best]
    rest = ce.copy()
    if len(rest):
        rest[row, best] = np.inf
    with np.errstate(invalid="ignore", divide="ignore"):
        z = (low - model.mean[best]) / np.sqrt(model.var_char[best] / n + model.var_text[best] + 1e-9)
        margin = np.where(np.isfinite(rest.min(1)) if len(rest) else [], rest.min(1) - low if len(rest) else [], np.nan)
    ok = (n > 0) & ((z <= model.limit[best]) | (low <= model.near[best])) & (low <= model.ceiling[best])
    names = np.array([*model.languages, UNKNOWN], object)
    return {"lang": names[np.where(ok, best, len(model.languages))], "bits_per_char": low, "margin": margin, "deviation": z, "ok": ok}


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from slices(b, size=4_000_000)


def trusted(texts: list[str], parts_of: int = 10) -> list[str]:
    """texts without those that a model of a few of the others finds to be no text of the language.

    Wrong labels are a small part, so that of ten models of ten texts each some have seen none; what
    lies beyond the limits of any of them is out. Lists of under 40 texts stay as they are.
    """
    if len(texts) < 4 * parts_of:
        return texts
    few = {str(k): texts[k::parts_of][:10] for k in range(parts_of)}
    model = fit(few, dict.fromkeys(few, texts))
    if model is None:
        return texts
    ce, n = score(model, pa.array(texts, pa.large_string()))
    with np.errstate(invalid="ignore", divide="ignore"):
        z = (ce - model.mean) / np.sqrt(model.var_char / n[:, None] + model.var_text + 1e-9)
    out = (n > 0) & (((z > model.limit) & (ce > model.near)) | (ce > model.ceiling)).any(1)
    return [t for t, x in zip(texts, out) if not x]


def train(docs: DataFrame, label: str = "lang", max_docs: int = 400, max_held_out: int = 200, max_chars: int = 8_000_000, max_languages: int = 256, seed: int = 7) -> Model | None:
    """Fit on at most max_docs labelled texts of each language, calibrate on max_held_out others.

    The sample is the distinct texts with the lowest hashes, so it does not depend on the layout; a
    language's texts end with the one that brings them to max_chars characters. There is a model for
    each label, or for the max_languages with the most distinct texts in the sample (ties by name).
    The four bounds are those of the sample: they hold what the driver takes to max_languages x
    max_chars. Rows with a null or blank label or text are left out. None if nothing is left. The
    hashes of each language's distinct texts are ranked first, whatever the number of copies; only
    the texts of the chosen hashes are moved. Repeated rows and texts count once; other columns play
    no part.
    """
    rows = docs.select(F.col(label).cast("string").alias("l"), text_or_empty().alias("t")).where("trim(l) <> '' and trim(t) <> ''").withColumn("h", hash_u63("t", seed=seed))
    wanted = max_docs + max_held_out
    w = Window.partitionBy("l").orderBy("h")
    chosen = cut(rows.select("l", "h").distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= wanted))
    most = chosen.groupBy("l").count().orderBy(F.desc("count"), "l").limit(max_languages).select("l")
    rows = rows.join(small_side(chosen), ["l", "h"]).join(F.broadcast(most), "l").groupBy("l", "r").agg(F.min("t").alias("t"))
    so_far = F.sum(F.length("t")).over(Window.partitionBy("l").orderBy("r").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.where("t is not null").withColumn("__n", F.coalesce(so_far, F.lit(0))).where(F.col("__n") < max_chars).drop("__n")
    texts: dict[str, list[str]] = {}
    held: dict[str, list[str]] = {}
    for x in sorted(rows.collect(), key=lambda x: (x.l, x.r)):
        (texts if x.r % 3 != 0 or x.r > 3 * max_held_out else held).setdefault(x.l, []).append(x.t)
    return fit({k: trusted(x) for k, x in texts.items()}, held) if texts else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang, bits_per_char, margin, deviation: one row for each row of docs.

    Null, empty and letterless texts are "und" with null figures; so is every text if there is no
    model. margin is null if there is one language only. Repeated rows each get their row, equal
    texts equal figures, ties go to the first language in alphabetical order. Other columns of docs,
    whatever their names, play no part.
    """
    kept = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    schema = "doc_id bigint, lang string, bits_per_char double, margin double, deviation double"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for b in parts(batches):
            if shared.value is None:
                none = pa.nulls(len(b), pa.float64())
                yield pa.record_batch([b.column("doc_id"), pa.array([UNKNOWN] * len(b)), none, none, none], ["doc_id", "lang", "bits_per_char", "margin", "deviation"])
                continue
            known = known or Known(shared.value)
            d = decide(shared.value, b.column("text"), known)
            figures = [pa.array(np.where(np.isfinite(d[k]), d[k], np.nan), from_pandas=True) for k in ("bits_per_char", "margin", "deviation")]
            yield pa.record_batch([b.column("doc_id"), pa.array(d["lang"], pa.string()), *figures], ["doc_id", "lang", "bits_per_char", "margin", "deviation"])

    return kept.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs without the rejected rows, in the same columns; lang holds the language found.

    Null, empty and letterless texts are rejected; so is every row if there is no model. Rows are
    judged by their text alone: a null doc_id, repeated rows and all other columns, whatever their
    names, are passed on as they are. Texts of any length are scored whole. An empty table gives no
    rows. docs must have the columns text and lang, which becomes a string.
    """
    cols = docs.columns
    rows = docs.withColumn("lang", F.col("lang").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for b in parts(batches):
            if shared.value is None:
                yield b.slice(0, 0)
                continue
            known = known or Known(shared.value)
            d = decide(shared.value, b.column("text"), known)
            at = b.schema.get_field_index("lang")
            yield b.set_column(at, b.schema.field(at), pa.array(d["lang"], b.schema.field(at).type)).filter(pa.array(d["ok"]))

    return rows.select(*cols).mapInArrow(run, rows.schema)
