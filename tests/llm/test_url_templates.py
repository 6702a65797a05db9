import math
import random
import re
from collections import Counter, defaultdict

from textlake.llm import url_templates as ut

PAGES, LABELS = "page_id bigint, url string, html string", "doc_id bigint, quality int, toxic int"


def made(seed=1, n=600):
    r = random.Random(seed)
    pages, labels = [], []
    for k in range(n):
        host = r.choice(["a.example", "b.example:80", "u@C.example"])
        kind = r.random()
        path = f"/blog/{k}" if kind < 0.4 else f"/news/{k}.html" if kind < 0.6 else f"/spam/{k}?x=/9" if kind < 0.8 else f"/user/name{r.choice('abcdef')}{chr(97 + k % 26)}/" if kind < 0.9 else f"/only{chr(97 + k % 26)}{chr(97 + k // 26)}/{k}"
        pages.append((k, f"http{r.choice(['', 's'])}://{host}{path}", "<html>"))
        if r.random() < 0.7:
            bad = "/spam/" in path
            labels.append((k, int(r.random() < (0.1 if bad else 0.95)), 0))
    return pages, labels


def kind(s):
    ext = re.search(r"(\.[A-Za-z][A-Za-z0-9]{0,4})?$", s)[0]
    for p, name in ut._KINDS:
        if re.search(p, s):
            return name + ext
    return s


def grown(shapes):
    """A tree of one host as nested dicts: n, lab, good, here, kids, names."""
    new = lambda: {"n": 0, "lab": 0, "good": 0, "here": 0, "kids": {}, "names": set()}
    root = new()
    for segments, n, lab, good in shapes:
        path = [root]
        for x in segments:
            path.append(path[-1]["kids"].setdefault(x, new()))
        for x in path:
            x["n"], x["lab"], x["good"] = x["n"] + n, x["lab"] + lab, x["good"] + good
        path[-1]["here"] += n
    return root


def same(a, b):
    keys = {*a["kids"], *b["kids"], None}
    p, q = ({k: (x["here"] if k is None else x["kids"].get(k, {"n": 0})["n"]) / x["n"] for k in keys} for x in (a, b))
    js = sum(z / 2 * math.log2(2 * z / (p[k] + q[k])) for k in keys for z in (p[k], q[k]) if z)
    if js > ut.SPREAD:
        return False
    if not a["lab"] or not b["lab"]:
        return True
    pool = (a["good"] + b["good"] + 1) / (a["lab"] + b["lab"] + 2)
    return abs(a["good"] / a["lab"] - b["good"] / b["lab"]) <= ut.SIGNIFICANCE * math.sqrt(pool * (1 - pool) * (1 / a["lab"] + 1 / b["lab"]))


def called(names):
    return min(names) if len(names) == 1 else "*" if len(names) > 4 or "*" in names else "{" + "|".join(sorted(names)) + "}"


def poured(a, b):
    """b added to a; kids that share a name are one."""
    for k in ("n", "lab", "good", "here"):
        a[k] += b[k]
    a["names"] |= b["names"]
    kids = list(a["kids"].values())
    for x in sorted(b["kids"].values(), key=lambda x: min(x["names"])):
        mine = sorted((y for y in kids if y["names"] & x["names"]), key=lambda y: min(y["names"] & x["names"]))
        kids = [y for y in kids if not any(y is z for z in mine)]
        home = mine[0] if mine else x
        for y in [*mine[1:], *([x] if mine else [])]:
            poured(home, y)
        kids.append(home)
    a["kids"] = {}
    for x in sorted(kids, key=lambda x: min(x["names"])):
        k = called(x["names"])
        a["kids"][f"*({min(x['names'])}..)" if k in a["kids"] else k] = x
    return a


def thinned(node):
    """The node with like siblings merged, everywhere below it."""
    for k, x in node["kids"].items():
        x["names"] = x["names"] or {k}
        thinned(x)
    leaders = []
    for _, x in sorted(node["kids"].items(), key=lambda i: (-i[1]["n"], i[0])):
        home = next((y for y in leaders if same(y, x)), None)
        if home is None:
            leaders.append(x)
        else:
            poured(home, x)
    node["kids"] = {}
    for x in leaders:
        k = called(x["names"])
        node["kids"][f"*({min(x['names'])}..)" if k in node["kids"] else k] = x
    return node


def named(shapes):
    root, out = thinned(grown(sorted(shapes))), {}
    for segments, *_ in shapes:
        at, path = root, ""
        for x in segments:
            k, at = next((k, y) for k, y in at["kids"].items() if x in y["names"])
            path += "/" + k
        out[segments] = path or "/"
    return out


def numbered(path):
    """The first number of a path that is no part of a date."""
    x, i = path.split("/")[1:], 0
    while i < len(x):
        if re.fullmatch(r"(19|20)\d\d", x[i]) and i + 1 < len(x) and re.fullmatch(r"0[1-9]|1[0-2]", x[i + 1]):
            day = i + 3 < len(x) and x[i + 3] and re.fullmatch(r"0[1-9]|[12]\d|3[01]", x[i + 2])
            if day or (i + 2 < len(x) and x[i + 2]):
                i += 3 if day else 2
                continue
        if m := re.fullmatch(r"(\d{1,18})(?:\.\w+)?", x[i]):
            return int(m[1])
        i += 1
    return None


def brute(pages, labels, min_share, smoothing, cut):
    """The definition, on dicts."""
    good = {}
    for d, q, t in labels:
        if d is not None and q is not None:
            good[d] = min(good.get(d, 1), int(q == 1 and t != 1))
    seen = []
    for _, url, *_ in pages:
        m = re.match(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
        host = m[1].lower() if m else ""
        path = re.match(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", url or "")[1]
        parts = [x for x in path.split("/") if x]
        parts = parts[:8] + ["**"] if len(parts) > 8 else parts
        number = numbered(path) if host else None
        seen.append((host, tuple(map(kind, parts)), good.get(number)))
    general = [() for _ in seen]
    for d in range(max((len(s) for _, s, _ in seen), default=0)):
        total, count = Counter(), Counter()
        for (h, s, _), g in zip(seen, general):
            total[h, g] += 1
            if len(s) > d:
                count[h, g, s[d]] += 1
        general = [g + ((s[d],) if s[d] in ("{n}", "{date}", "{id}", "**") or count[h, g, s[d]] >= min_share * total[h, g] else ("*",)) if len(s) > d else g for (h, s, _), g in zip(seen, general)]
    shapes = defaultdict(lambda: [0, 0, 0])
    for (h, _, g), t in zip(seen, general):
        x = shapes[h, t]
        x[0], x[1], x[2] = x[0] + 1, x[1] + (g is not None), x[2] + (g or 0)
    of = {}
    for h in {k[0] for k in shapes}:
        for t, name in named([(t, *x) for (h2, t), x in shapes.items() if h2 == h]).items():
            of[h, t] = name
    lab, ok, hl, hg = Counter(), Counter(), Counter(), Counter()
    n = Counter()
    for (h, t), (c, k, g) in shapes.items():
        n[h, of[h, t]] += c
        lab[h, of[h, t]] += k
        ok[h, of[h, t]] += g
        hl[h] += k
        hg[h] += g
    whole = sum(hg.values()) / sum(hl.values()) if sum(hl.values()) else None
    out = []
    for (pid, url, *_), (h, _, _), t in zip(pages, seen, general):
        name = of[h, t]
        p = None if whole is None else round((ok[h, name] + smoothing * (hg[h] + smoothing * whole) / (hl[h] + smoothing)) / (lab[h, name] + smoothing), 6)
        out.append((pid, url, h, name, n[h, name], lab[h, name], p, p is None or p >= cut))
    return sorted(out, key=repr)


def ours(spark, pages, labels, **k):
    df = ut.filter_urls(spark.createDataFrame(pages, PAGES).selectExpr("*", "'x' AS host", "1 AS n", "2 AS segs"), spark.createDataFrame(labels, LABELS), **k)
    return sorted(((r.page_id, r.url, r.host, r.template, r.n_urls, r.n_labelled, None if r.purity is None else round(r.purity, 6), r.keep) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    pages, labels = made()
    found = ours(spark, pages, labels)
    assert found == brute(pages, labels, ut.MIN_SHARE, ut.SMOOTHING, ut.MIN_PURITY)
    assert {r[3] for r in found if not r[7]} and all("spam" in r[1] for r in found if not r[7])
    assert all(not r[7] for r in found if "/spam/" in r[1])


def test_large_hosts_level_by_level(spark, monkeypatch):
    pages, labels = made(3, 400)
    pages += [(900 + k, "http://a.example/" + "/".join("abcdefghijk"[: k % 12]) + f"/x{chr(97 + k)}", "") for k in range(24)]
    before = ours(spark, pages, labels)
    for limit in (0, 40):
        monkeypatch.setattr(ut, "HOST_SHAPES", limit)
        assert ours(spark, pages, labels) == before


def test_odd_rows(spark):
    pages = [
        (1, "http://h/5", None), (1, "http://h/5", None), (2, None, None), (None, "http://h/6.html", ""), (3, "", ""), (4, "not a url", ""), (5, "//h", ""),
        (6, "http://h/" + "/".join(f"d{chr(97 + k)}" for k in range(20)), ""), (7, "http://h//2024-05-01//a%20b?q#f", ""), (8, "http://H:8/" + "x" * 20_000, ""), (9, "ftp://h/0aF3-bc9_12/é", ""),
        (10, "http://h/999999999999999999999", ""), (11, "/7", ""),
    ]
    labels = [(5, 1, 0), (5, 0, 0), (6, 1, None), (None, 1, 0), (7, None, 1), (7, 1, 1)]
    assert ours(spark, pages, labels) == brute(pages, labels, ut.MIN_SHARE, ut.SMOOTHING, ut.MIN_PURITY)
    found = ours(spark, pages, [])
    assert len(found) == len(pages) and all(r[6] is None and r[7] for r in found)


def test_empty(spark):
    assert ours(spark, [], [(1, 1, 0)]) == []


def test_siblings_merge_unless_labels_differ():
    same = [(("en", "{n}"), 50, 40, 38), (("de", "{n}"), 50, 40, 37), (("fr", "{n}"), 10, 0, 0)]
    assert set(ut.templates(same).values()) == {"/{de|en|fr}/{n}"}
    unlike = [(("en", "{n}"), 50, 40, 38), (("spam", "{n}"), 50, 40, 3)]
    assert set(ut.templates(unlike).values()) == {"/en/{n}", "/spam/{n}"}
    deeper = [(("en", "{n}"), 50, 0, 0), (("en2", "a", "{n}"), 50, 0, 0)]
    assert len(set(ut.templates(deeper).values())) == 2


def test_small_sections_are_judged_by_themselves(spark):
    name = lambda k: f"sec{chr(97 + k // 26)}{chr(97 + k % 26)}"
    urls = [(k, j, f"http://h/{name(k)}/{k * 100 + j}") for k in range(60) for j in range(10)]
    urls += [(k, j, "http://deep/" + "/".join("abcdefghi") + f"/{name(k)}/{100_000 + k * 100 + j}") for k in range(2) for j in range(20)]
    pages = [(i, u, "") for i, (_, _, u) in enumerate(urls)]
    labels = [(int(u.rpartition("/")[2]), k % 2, 0) for k, _, u in urls]
    found = {r[1]: r for r in ours(spark, pages, labels)}
    assert all(found[u][7] == bool(k % 2) for k, _, u in urls)
    assert {found[u][5] for _, _, u in urls if "//h/" in u} == {300}


def test_wide_nodes_keep_unlike_labels_apart():
    shapes = [((f"u{k}", f"p{k % 7}", "{n}"), 20 + k % 5, 10 * (k % 3 > 0), (k % 2) * 10 * (k % 3 > 0)) for k in range(300)]
    found = ut.templates(shapes)
    assert len(found) == 300
    rates = {}
    for s, n, labelled, good in shapes:
        rates.setdefault(found[s], set()).update({good / labelled} if labelled else ())
    assert all(len(x) <= 1 for x in rates.values())


def test_several_groups_of_many_siblings():
    kinds = {"a": ("x", "{n}"), "b": ("y", "{id}"), "c": ("z", "w", "{n}")}
    shapes = [((f"{g}{k}", *tail), 10, 5, 5 if g == "a" else k % 2) for g, tail in kinds.items() for k in range(6)] + [(("*", "q"), 9, 0, 0), ((), 3, 1, 1)]
    found = ut.templates(shapes)
    assert found == named(shapes) and len(set(found.values())) == 5


def test_merging_against_brute_force():
    for seed in range(40):
        r = random.Random(seed)
        name = lambda: r.choice(["a", "b", "c", "d", "e", "f", "g", "{n}", "*"])
        held = {tuple(name() for _ in range(r.randint(0, 4))): None for _ in range(r.randint(1, 80))}
        shapes = [(t, n := r.randint(1, 60), k := r.randint(0, n), r.randint(0, k)) for t in held]
        assert ut.templates(shapes) == named(shapes), seed


def test_two_groups_of_six_alike_parents(spark):
    pages = [(k, f"http://h/{g}{chr(97 + k % 6)}/{t}/{k}", "") for g, t in (("p", "one"), ("q", "two/three")) for k in range(60)]
    pages += [(200 + k, f"http://h/rare{chr(97 + k)}", "") for k in range(5)]
    assert ours(spark, pages, [(3, 1, 0)]) == brute(pages, [(3, 1, 0)], ut.MIN_SHARE, ut.SMOOTHING, ut.MIN_PURITY)


def test_the_number_of_a_label(spark):
    from pyspark.sql import functions as F

    urls = {
        "http://h/777/foo/888": "777", "http://h/2024/05/story/777.html": "777", "http://h/2024/05/06/777": "777", "http://h/2024/05": "2024", "http://h/a/2024/x": "2024", "http://h//5": "5",
        "http://h/x5/7a/9?n=3": "9", "http://h/?/5": "", "http://h/2024/05/": "2024", "http://h/2024/05/06": "06", "//h/3#4": "3", "http://h/1/2/3": "1",
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.n for r in df.select("url", ut.labelled_number(F.col("url")).alias("n")).collect()} == urls
    for u, n in urls.items():
        m = re.match(r"^(?:[a-z]+:)?//[^/?#]*([^?#]*)", u)
        assert str(numbered(m[1]) or "").lstrip("0") == n.lstrip("0"), u
