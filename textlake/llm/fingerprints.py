"""Document fingerprints: a Merkle tree over paragraphs and sections.

A paragraph is a line. A section is a run of paragraphs that ends after a blank one, and after one
whose hash opens with the digit 0 (so sections hold 16 lines or so, and a line that is put in or
taken out changes the borders near it only). A section's hash covers its paragraphs', the root the
sections'. Leaves, sections and roots are hashed with different prefixes. Equal roots mean equal
texts; where roots differ, the sections that differ, and below them the paragraphs, say where.
The tree is one expression over the scan. compact does both for a table: it names the first text with
the same root, and the places at which a text differs from one before that it shares paragraphs with.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlake.functions.pytext import let
from textlake.llm.common import BROADCAST_ROWS, cut, fresh, small_side


def _sha(prefix: str, c: Column) -> Column:
    return F.sha2(F.concat(F.lit(prefix), c), 256)


def _tree(text: Column) -> Column:
    """struct(root, sections, section_ends, paragraphs) of a text, each part computed once."""
    lines = F.transform(F.split(text, "\n", -1), lambda p, i: F.struct((i + 1).alias("i"), _sha("P", p).alias("h"), (F.trim(p) == "").alias("blank")))

    def parts(m: Column) -> Column:
        closing = F.transform(F.filter(m, lambda x: x["blank"] | x["h"].startswith("0")), lambda x: x["i"])
        ends = F.array_union(closing, F.array(F.size(m)))  # numbers rise, so the last paragraph's comes last
        return F.struct(F.transform(m, lambda x: x["h"]).alias("h"), ends.alias("ends"))

    def sections(p: Column) -> Column:
        # each section's paragraphs lie between the end before it and its own
        before = F.concat(F.array(F.lit(0)), F.slice(p["ends"], 1, F.size(p["ends"]) - 1))
        made = F.zip_with(before, p["ends"], lambda a, b: _sha("S", F.array_join(F.slice(p["h"], a + 1, b - a), "")))
        return let(made, lambda s: F.struct(_sha("R", F.array_join(s, "")).alias("root"), s.alias("sections"), p["ends"].alias("section_ends"), p["h"].alias("paragraphs")))

    return F.when(text.isNotNull(), let(lines, lambda m: let(parts(m), sections)))


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with all their columns, and root, sections (their hashes), section_ends (the number of
    each one's last paragraph) and paragraphs (their hashes).

    A null text has null in all four; an empty one is one section of one empty paragraph. Input
    columns of these names give way. Repeated rows get equal fingerprints. Texts of any length are
    covered whole. An empty table gives no rows.
    """
    names = ("root", "sections", "section_ends", "paragraphs")
    tree = fresh(docs, "__tree")
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    return docs.withColumn(tree, _tree(F.col(text).cast("string"))).select(*rest, *[F.col(f"{tree}.{c}").alias(c) for c in names])


def bases(docs: DataFrame) -> DataFrame:
    """r, base, b: for each text that shares a paragraph with one before it, the text that it is compared with.

    r and b are roots (as bytes), base is the doc_id of b. Texts (equal ones are one) are ordered by
    their least doc_id, then by root; null ids come last, and are no base. Each distinct paragraph
    that is not blank points at the last text before that has it too; the text that most paragraphs
    of r point at is its base, of several the last. All paragraphs of all texts take part, and the
    work follows their number, however many texts share one.
    """
    lines = F.array_distinct(F.filter(F.split("text", "\n", -1), lambda p: F.trim(p) != ""))
    known = fingerprint(docs.where("text is not null")).select("doc_id", F.unhex("root").alias("r"), F.explode(F.transform(lines, lambda p: F.unhex(F.substring(_sha("P", p), 1, 32)))).alias("p"))
    # copies fall together where the paragraphs meet, so one shuffle does for both
    held = known.repartition("p").groupBy("p", "r").agg(F.min("doc_id").alias("id"))
    earlier = Window.partitionBy("p").orderBy(F.col("id").asc_nulls_last(), "r").rowsBetween(Window.unboundedPreceding, -1)
    points = held.select("r", F.last(F.when(F.col("id").isNotNull(), F.struct("id", "r")), ignorenulls=True).over(earlier).alias("to")).where("to is not null")
    most = points.groupBy("r", "to").agg(F.count("*").alias("n")).groupBy("r").agg(F.max(F.struct("n", "to.id", "to.r")).alias("m"))
    return most.select("r", F.col("m.id").alias("base"), F.col("m.r").alias("b"))


def edits(docs: DataFrame) -> DataFrame:
    """r, base, base_root, edits of each text that bases finds one for: where its tree differs from its base's.

    edits are structs old_from, old_to, new_from, new_to of paragraphs as in differences, in order;
    the old text is the base.
    """
    links = cut(bases(docs))
    wanted = links.select("r").union(links.select("b")).distinct()
    trees = fingerprint(docs.where("text is not null")).select(
        F.unhex("root").alias("t"), *[F.transform(c, lambda h: F.unhex(h)).alias(c) for c in ("sections", "paragraphs")], "section_ends"
    )
    wanted = cut(wanted.withColumnRenamed("r", "t"))
    trees = cut(trees.join(small_side(wanted, 8), "t", "left_semi").dropDuplicates(["t"]))
    a, b = (trees.select(F.col("t").alias(f"{s}_t"), *[F.col(c).alias(f"{s}_{c}") for c in _PARTS]) for s in "ab")
    both = links.join(a, F.col("b") == F.col("a_t")).join(b, F.col("r") == F.col("b_t")).select("r", *_sides())
    place = F.struct("old_from", "old_to", "new_from", "new_to")
    found = _located(both, "r").groupBy("r").agg(F.sort_array(F.collect_list(place)).alias("edits"))
    return found.join(links, "r").select("r", "base", F.lower(F.hex("b")).alias("base_root"), "edits")


def compact(docs: DataFrame) -> DataFrame:
    """doc_id, root, n_sections, n_paragraphs, sections, same_as (the least doc_id with that root), and
    base, base_root, edits: a document before that this one shares paragraphs with, and where they differ.

    One row for each row of docs, repeated ones too; all is null but doc_id for a null text, and same_as
    where all ids of a root are null. An empty text is one section of one empty paragraph. Whole texts
    of any length are covered. An empty table gives no rows; other columns play no part. doc_id is
    cast to bigint, as in all of this subpackage.

    Every text that shares a paragraph which is not blank with one before it is compared with one such
    text, its base (see bases for which; base_root tells texts of one doc_id apart). With the new
    paragraphs of all edits in place of the base's, the base's text is this one. Rows of one root have
    the same base and edits; base, base_root and edits are null for texts that share none.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = F.col("root").isNotNull()
    f = fingerprint(d).select("doc_id", "root", F.when(known, F.size("sections")).alias("n_sections"), F.when(known, F.size("paragraphs")).alias("n_paragraphs"), "sections")
    first = cut(f.where(known).groupBy(F.col("root").alias("__root")).agg(F.min("doc_id").alias("same_as"), F.count("*").alias("n")).where("n > 1").select("__root", "same_as"))
    # only roots that occur twice are joined; the others are their own first
    out = f.join(small_side(first, 8), F.col("root") == F.col("__root"), "left").drop("__root")
    out = out.withColumn("same_as", F.when(known, F.coalesce("same_as", "doc_id")))
    changed = cut(edits(d))
    numbers = changed.agg(F.sum(20 + 4 * F.size("edits"))).first()[0] or 0
    changed = F.broadcast(changed) if numbers <= BROADCAST_ROWS else changed
    return out.join(changed, F.unhex("root") == F.col("r"), "left").drop("r")


def aligned(a: Sequence, b: Sequence) -> list[tuple[int, int, int, int]]:
    """The ranges (i, j, k, l) in which a and b differ, a[i:j] against b[k:l], in order.

    Equal elements at both ends are passed over; what occurs once on either side, in rising order, is
    equal in between (the longest such row of them), and so on between any two of these.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, n = todo.pop()
        while i < j and k < n and a[i] == b[k]:
            i, k = i + 1, k + 1
        while i < j and k < n and a[j - 1] == b[n - 1]:
            j, n = j - 1, n - 1
        if i == j and k == n:
            continue
        once = Counter(a[i:j]), Counter(b[k:n])
        at = {b[y]: y for y in range(k, n) if once[1][b[y]] == 1}
        pairs = [(x, at[a[x]]) for x in range(i, j) if once[0][a[x]] == 1 and a[x] in at]
        tops: list[int] = []  # the least end of a rising row of each length
        ends: list[tuple[int, int]] = []
        before: dict[tuple[int, int], tuple[int, int] | None] = {}
        for p in pairs:
            spot = bisect.bisect_left(tops, p[1])
            before[p] = ends[spot - 1] if spot else None
            tops[spot:spot + 1], ends[spot:spot + 1] = [p[1]], [p]
        row, p = [], ends[-1] if ends else None
        while p is not None:
            row.append(p)
            p = before[p]
        if not row:
            out.append((i, j, k, n))
            continue
        x, y = i, k
        for u, v in [*reversed(row), (j, n)]:
            todo.append((x, u, y, v))
            x, y = u + 1, v + 1
    return sorted(out)


def tree_differences(a: tuple[Sequence, Sequence, Sequence], b: tuple[Sequence, Sequence, Sequence]) -> list[tuple[int, int, int, int]]:
    """The ranges of paragraphs in which two trees differ; each tree is (sections, their ends,
    paragraphs). Only in branches that differ are the paragraphs looked at."""
    out = []
    for i, j, k, n in aligned(a[0], b[0]):
        first, last = [int(t[1][x - 1]) if x else 0 for t, x in ((a, i), (b, k))], [int(t[1][x - 1]) if x else 0 for t, x in ((a, j), (b, n))]
        out += [(first[0] + w, first[0] + x, first[1] + y, first[1] + z) for w, x, y, z in aligned(a[2][first[0] : last[0]], b[2][first[1] : last[1]])]
    return out


def differences(old: DataFrame, new: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, change, and the paragraphs changed: old_from, old_to, new_from, new_to (from 1, both ends
    within; to = from - 1 where nothing is): a row for each place at which the texts of a key differ.

    change is "added" or "removed" (one row, all paragraphs) or "edited". Roots are compared first;
    below those that differ the sections are aligned, and below the sections that differ the
    paragraphs, so that equal branches are passed over unseen wherever they lie. With the new
    paragraphs of all rows in place of the old ones the old text is the new one. A key that occurs
    several times on a side has the rows of each combination. Null keys are left out; a null text
    counts as absent, an empty one is one empty paragraph. Equal texts and empty tables give no rows.
    Texts of any length are compared whole; other columns, whatever their names, play no part.
    """
    sides = []
    for d, s in ((old, "a"), (new, "b")):
        f = fingerprint(d.select(F.col(key).alias("k"), F.col(text).alias("text"))).where("k is not null and root is not null")
        sides.append(f.select(F.col("k").alias(f"{s}_k"), *[F.col(c).alias(f"{s}_{c}") for c in ("root", *_PARTS)]))
    both = sides[0].join(sides[1], F.col("a_k") == F.col("b_k"), "full_outer").where(~F.col("a_root").eqNullSafe(F.col("b_root")))
    return _located(both.select(F.coalesce("a_k", "b_k").alias(key), *_sides()), key)


_PARTS = ("sections", "section_ends", "paragraphs")


def _sides() -> list[Column]:
    return [F.col(f"{s}_{c}") for s in "ab" for c in _PARTS]


def _located(both: DataFrame, key: str) -> DataFrame:
    """The rows of differences, of trees side by side: key and the columns of _sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in batches:
            rows, change, place = [], [], []
            columns = [c.column(f"{s}_{x}") for s in "ab" for x in _PARTS]
            for r in range(len(c)):
                a, b = (tuple(columns[k + x][r].as_py() for x in range(3)) for k in (0, 3))
                if a[0] is None or b[0] is None:
                    found = [(0, len(a[2] or ()), 0, len(b[2] or ()))]
                else:
                    found = tree_differences(a, b)
                rows += [r] * len(found)
                change += ["added" if a[0] is None else "removed" if b[0] is None else "edited"] * len(found)
                place += [(i + 1, j, k + 1, n) for i, j, k, n in found]
            yield pa.record_batch([c.column(key).take(pa.array(rows, pa.int64())), pa.array(change, pa.string()), *(pa.array([p[x] for p in place], pa.int32()) for x in range(4))], out.names)

    out = T.StructType([both.schema[key], *T._parse_datatype_string("change string, old_from int, old_to int, new_from int, new_to int").fields])
    return both.mapInArrow(run, out)
