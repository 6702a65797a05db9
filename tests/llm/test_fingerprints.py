import difflib
import hashlib
import random

import pytest

from textlake.llm import fingerprints as fp

from .cases import empty, odd, odd_rows


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(text):
    if text is None:
        return None, None, None, None
    lines = text.split("\n")
    leaves = [sha("P" + x) for x in lines]
    sections, ends, at = [], [], 0
    for i, (line, h) in enumerate(zip(lines, leaves), 1):
        if i == len(lines) or line.strip(" ") == "" or h[0] == "0":
            sections.append(sha("S" + "".join(leaves[at:i])))
            ends.append(i)
            at = i
    return sha("R" + "".join(sections)), sections, ends, leaves


def test_against_brute_force(spark):
    df = odd(spark).selectExpr("*", "'x' AS root", "1 AS sections", "2 AS i", "3 AS p", "4 AS __text")
    out = fp.fingerprint(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "i", "p", "__text", "root", "sections", "section_ends", "paragraphs"]
    found = out.collect()
    assert len(found) == len(odd_rows())
    for r in found:
        assert (r.root, r.sections, r.section_ends, r.paragraphs) == brute(r.text)


def test_equal_roots_are_equal_texts(spark):
    texts = ["", "\n", "\n\n", "a", "a\n", "\na", "a\n\nb", "a\nb", "ab", " ", None, "a"]
    f = [r.root for r in fp.fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)).orderBy("doc_id").collect()]
    assert f[3] == f[11] and f[10] is None and len(set(f)) == 11


def test_compact(spark):
    found = sorted(fp.compact(odd(spark)).collect(), key=repr)
    assert len(found) == len(odd_rows())
    by = {(r.doc_id, r.root): r for r in found}
    one = brute(odd_rows()[0][1])[0]
    assert by[1, one].same_as == by[2, one].same_as == 1
    assert by[4, None].same_as is None and by[4, None].n_sections is None
    assert by[3, brute("")[0]].n_paragraphs == 1
    alone = [r for r in found if r.doc_id is None and r.root]
    assert len(alone) == 1 and alone[0].same_as is None
    assert fp.compact(empty(spark)).collect() == []


def test_differences_locate_edits(spark):
    r = random.Random(4)
    old, new = {}, {}
    for k in range(60):
        a = [f"line {r.randrange(50)}" if r.random() > 0.1 else "" for _ in range(r.randrange(1, 80))]
        b = list(a)
        for _ in range(r.randrange(3)):
            i = r.randrange(len(b) + 1)
            if r.random() < 0.5 or not b:
                b.insert(i, f"new {r.random()}")
            else:
                del b[i - 1]
        old[k], new[k] = "\n".join(a), "\n".join(b)
    old[100], new[101], old[102], new[103] = "gone", "came", None, None
    frame = lambda d: spark.createDataFrame([*d.items(), (None, "x")], "doc_id bigint, text string")
    found = {}
    for x in fp.differences(frame(old), frame(new)).collect():
        found.setdefault(x.doc_id, []).append(x)
    assert set(found) == {k for k in {*old, *new} if old.get(k) != new.get(k)}
    assert found[100][0].change == "removed" and found[101][0].change == "added"
    for k, rows in found.items():
        a, b = (old.get(k) or "").split("\n") if old.get(k) is not None else [], (new.get(k) or "").split("\n") if new.get(k) is not None else []
        assert replayed(a, b, rows) == b
        blocks = [m for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if m[0] != "equal"]
        if len(blocks) == 1 and k < 100:
            (x,) = rows
            assert x.old_to - x.old_from + 1 <= blocks[0][2] - blocks[0][1] and x.new_to - x.new_from + 1 <= blocks[0][4] - blocks[0][3]


def replayed(a, b, rows):
    """The old paragraphs with the new ones of all rows in place of theirs."""
    out, at = [], 0
    for x in sorted(rows, key=lambda x: (x.old_from, x.new_from)):
        out += a[at : x.old_from - 1] + b[x.new_from - 1 : x.new_to]
        at = x.old_to
    return out + a[at:]


def test_edits_far_apart_are_two_rows(spark):
    a = [f"line {k}" for k in range(1, 101)]
    b = ["first", *a[1:99], "last"]
    frame = lambda x: spark.createDataFrame([(1, "\n".join(x)), (2, "same"), (3, "")], "doc_id bigint, text string").selectExpr("*", "'x' AS root", "1 AS k")
    rows = fp.differences(frame(a), frame(b)).collect()
    assert [(r.old_from, r.old_to, r.new_from, r.new_to) for r in sorted(rows)] == [(1, 1, 1, 1), (100, 100, 100, 100)]
    assert replayed(a, b, rows) == b
    empty_ = frame(a).limit(0)
    assert fp.differences(empty_, empty_).collect() == []
    assert {(r.doc_id, r.change, r.new_to) for r in fp.differences(empty_, frame(a)).collect()} == {(1, "added", 100), (2, "added", 1), (3, "added", 1)}


@pytest.mark.parametrize("seed", range(30))
def test_alignment_can_be_replayed(seed):
    r = random.Random(seed)
    a = [r.randrange(12) for _ in range(r.randrange(40))]
    b = [x for x in a if r.random() < 0.8]
    for _ in range(r.randrange(5)):
        b.insert(r.randrange(len(b) + 1), r.randrange(20))
    out, at = [], 0
    for i, j, k, n in fp.aligned(a, b):
        assert a[i:j] != b[k:n]
        out += a[at:i] + b[k:n]
        at = j
    assert out + a[at:] == b


def brute_bases(rows):
    """root: (base, its root) of rows (doc_id, text), by looking at all texts before each one."""
    least, texts = {}, {}
    for d, x in rows:
        if x is not None:
            root = brute(x)[0]
            texts[root] = x
            least[root] = min((i for i in (least.get(root), d) if i is not None), default=None)
    order = sorted(texts, key=lambda root: (least[root] is None, least[root] or 0, root))
    out = {}
    for at, root in enumerate(order):
        votes = {}
        for p in {x for x in texts[root].split("\n") if x.strip(" ")}:
            to = next((k for k in range(at - 1, -1, -1) if least[order[k]] is not None and p in texts[order[k]].split("\n")), None)
            if to is not None:
                votes[to] = votes.get(to, 0) + 1
        if votes:
            to = max(votes, key=lambda k: (votes[k], k))
            out[root] = least[order[to]], order[to]
    return out, texts


def holds(spark, rows):
    found = fp.compact(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(found) == len(rows)
    bases, texts = brute_bases(rows)
    for x in found:
        assert (x.base, x.base_root) == bases.get(x.root, (None, None))
        if x.base_root is None:
            assert x.edits is None
        else:
            b = texts[x.root].split("\n")
            assert x.edits and replayed(texts[x.base_root].split("\n"), b, x.edits) == b
    return found


def test_compact_locates_edits(spark):
    a = [f"line {k}" for k in range(1, 101)]
    b = ["first", *a[1:99], "last"]
    (_, x, y, z) = sorted(holds(spark, [(1, "\n".join(a)), (2, "\n".join(b)), (3, "\n".join(b)), (4, "alone")]))
    assert [tuple(e) for e in x.edits] == [(1, 1, 1, 1), (100, 100, 100, 100)] and x.base == 1
    assert (y.base, y.base_root, y.edits, y.same_as) == (1, x.base_root, x.edits, 2)
    assert (z.base, z.base_root, z.edits, z.same_as) == (None, None, None, 4)


def test_compact_against_all_earlier_texts(spark):
    r = random.Random(8)
    rows = [(d, x) for d, x, *_ in odd_rows()]
    texts = [[r.choice(["", "  ", *(f"line {r.randrange(90)}" for _ in range(6))]) for _ in range(r.randrange(1, 30))] for _ in range(12)]
    for _ in range(80):
        x = list(r.choice(texts))
        for _ in range(r.randrange(5)):
            at = r.randrange(len(x) + 1)
            x[at : at + r.randrange(2)] = [] if r.random() < 0.4 else [f"line {r.randrange(90)}", ""][: r.randrange(1, 3)]
        if r.random() < 0.2:
            x = x[len(x) // 2 :] + x[: len(x) // 2]  # paragraphs that moved
        texts.append(x or [""])
    rows += [(r.choice([None, *range(20, 90)]), "\n".join(x)) for x in texts]
    found = holds(spark, rows)
    assert sum(x.base is not None for x in found) > 60 and any(x.doc_id is None and x.base is not None for x in found)


def test_a_paragraph_that_all_texts_share(spark):
    n = 3000
    found = fp.compact(spark.range(n).selectExpr("id AS doc_id", "concat('of all\\n', id) AS text")).collect()
    assert {(x.doc_id, x.base) for x in found} == {(k, k - 1 if k else None) for k in range(n)}
    assert all([tuple(e) for e in x.edits] == [(2, 2, 2, 2)] for x in found if x.doc_id)
