"""URL filters by a path-template tree.

Per host, the path segments of all URLs form a tree. A segment that looks variable (a number, a
date, an identifier) becomes a wildcard of its kind; below each node, children that are a small part
of its URLs, and have too few URLs and labels to be told apart, become the wildcard "*". Beyond 8
segments, what follows a path of so few URLs and labels becomes "**". Siblings whose children are
spread alike and whose labels do not differ significantly are merged. Each root-to-leaf path that
remains is a template; those whose share of good labels, smoothed towards the host's and the host's towards the whole, is too low
are rejected.

Only counts of distinct shapes are ever grouped. A host of up to HOST_SHAPES of them is generalised in
one task, at once with its merging; larger hosts are generalised level by level in joins, with the
same result, until the nodes that remain (of at least MIN_URLS URLs, MIN_LABELS labels or min_share
of their parent) are merged in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import cut, small_side

MIN_SHARE, MAX_DEPTH = 0.02, 8
MIN_URLS, MIN_LABELS = 8, 2  # a branch of so many is judged by itself, however small a part it is
SMOOTHING, MIN_PURITY = 8.0, 0.6
HOST_SHAPES = 200_000  # distinct shapes of a host that one task generalises
SPREAD, SIGNIFICANCE = 0.05, 2.58  # largest Jensen-Shannon divergence (bits) and |z| of what is alike
_WILD = ("{n}", "{date}", "{id}", "**")
_EXT = r"(\.[A-Za-z][A-Za-z0-9]{0,4})?"
_DATE = r"/(?:19|20)\d\d/(?:0[1-9]|1[0-2])(?:/(?:0[1-9]|[12]\d|3[01]))?(?=/[^/?#])"
_KINDS = (
    (rf"^\d+{_EXT}$", "{n}"),
    (rf"^\d{{4}}-\d{{2}}(-\d{{2}})?{_EXT}$", "{date}"),
    (rf"^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}{_EXT}$", "{id}"),
    (rf"^(?=.*\d)(?=.*[A-Za-z])[A-Za-z0-9_-]{{8,}}?{_EXT}$", "{id}"),
)


def host_of(url: Column) -> Column:
    """The host in lower case, without user and port; "" if there is none."""
    found = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(found, F.lit(""))


def segments_of(url: Column) -> Column:
    """The path's segments, variable ones as wildcards of their kind."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda s: s != "")

    def kind(s: Column) -> Column:
        out = None
        for pattern, name in _KINDS:
            wild = F.concat(F.lit(name), F.regexp_extract(s, rf"{_EXT}$", 1))
            out = F.when(s.rlike(pattern), wild) if out is None else out.when(s.rlike(pattern), wild)
        return out.otherwise(s)

    return F.transform(parts, kind)


def labelled_number(url: Column) -> Column:
    """The first number that is a whole segment of the path, as the key of a label; a year and month,
    and a day behind them, that other segments follow are a date and no such number."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), rf"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(?:{_DATE}|/(?!\d{{1,18}}(?:\.\w+)?(?:[/?#]|$))[^/?#]*)*+/(\d{{1,18}})(?:\.\w+)?(?:[/?#]|$)", 1)


@dataclass
class Node:
    """Counts of the URLs at and below a node, of those with a label, and of the good ones."""

    n: int = 0
    labelled: int = 0
    good: int = 0
    here: int = 0  # URLs that end here
    below: dict[str, Node] = field(default_factory=dict)
    names: set[str] = field(default_factory=set)  # of the branches merged into this one

    def add(self, other: Node) -> None:
        """Pour other into this node; children that share a name are one from then on."""
        self.n, self.labelled, self.good, self.here = self.n + other.n, self.labelled + other.labelled, self.good + other.good, self.here + other.here
        self.names |= other.names
        at = {s: x for x in self.below.values() for s in x.names}
        for x in sorted(other.below.values(), key=lambda x: min(x.names)):
            homes = {id(at[s]): at[s] for s in sorted(x.names) if s in at}
            home, *rest = homes.values() or [x]
            for y in [*rest, *([x] if homes else [])]:
                home.add(y)
            at.update(dict.fromkeys(home.names, home))
        self.below = keyed(sorted({id(x): x for x in at.values()}.values(), key=lambda x: min(x.names)))

    def spread(self) -> dict[str, float]:
        out = {k: x.n / self.n for k, x in self.below.items()}
        if self.here:
            out[""] = self.here / self.n
        return out


def alike(a: Node, b: Node) -> bool:
    """Whether two siblings' children are spread alike and their labels could be of one rate."""
    p, q = a.spread(), b.spread()
    js = 0.0
    for k in sorted({*p, *q}):
        x, y = p.get(k, 0.0), q.get(k, 0.0)
        m = (x + y) / 2
        js += sum(z / 2 * math.log2(z / m) for z in (x, y) if z > 0)
    if js > SPREAD:
        return False
    if not a.labelled or not b.labelled:
        return True
    pool = (a.good + b.good + 1) / (a.labelled + b.labelled + 2)
    z = (a.good / a.labelled - b.good / b.labelled) / math.sqrt(pool * (1 - pool) * (1 / a.labelled + 1 / b.labelled))
    return abs(z) <= SIGNIFICANCE


def merge(node: Node) -> None:
    """Merge like siblings everywhere below the node, deepest first; the largest (ties: by name) lead."""
    for x in node.below.values():
        merge(x)
    leaders: list[Node] = []
    having: dict[str, set[int]] = {}  # the leaders that have or had a child of the name
    for k, x in sorted(node.below.items(), key=lambda i: (-i[1].n, i[0])):
        x.names = x.names or {k}
        for i in sorted(set().union(*(having.get(c, ()) for c in telling(x)))):
            if alike(leaders[i], x):
                leaders[i].add(x)
                break
        else:
            i = len(leaders)
            leaders.append(x)
        for c in leaders[i].spread():
            having.setdefault(c, set()).add(i)
    node.below = keyed(leaders)


def keyed(nodes: list[Node]) -> dict[str, Node]:
    """Siblings under the names of what they hold, each name once."""
    out: dict[str, Node] = {}
    for x in nodes:
        name = label(x.names)
        out[name if name not in out else f"*({min(x.names)}..)"] = x
    return out


def telling(x: Node) -> list[str]:
    """The least children of which a sibling must have one to be alike: distributions of a divergence
    up to SPREAD bits differ by at most sqrt(2 ln 2 SPREAD) in any set's share (Pinsker)."""
    out, mass = [], 0.0
    for c, share in sorted(x.spread().items(), key=lambda i: (-i[1], i[0])):
        out.append(c)
        mass += share
        if mass > math.sqrt(2 * math.log(2) * SPREAD) + 1e-9:
            break
    return out


def label(names: set[str]) -> str:
    """One name as it is, few as {a|b}, more as *."""
    if len(names) == 1:
        return next(iter(names))
    return "*" if len(names) > 4 or "*" in names else "{" + "|".join(sorted(names)) + "}"


def templates(shapes: list[tuple[tuple[str, ...], int, int, int]]) -> dict[tuple[str, ...], str]:
    """The template of each shape (segments, URLs, labelled, good) of one host."""
    root = Node()
    for segments, n, labelled, good in sorted(shapes):
        at = root
        for s in (*segments, None):
            at.n, at.labelled, at.good = at.n + n, at.labelled + labelled, at.good + good
            if s is not None:
                at = at.below.setdefault(s, Node())
        at.here += n
    merge(root)
    out = {}
    branch: dict[int, dict[str, tuple[str, Node]]] = {}  # by node: where each segment leads; siblings share no name

    def branches(at: Node) -> dict[str, tuple[str, Node]]:
        if id(at) not in branch:
            branch[id(at)] = {s: (k, x) for k, x in at.below.items() for s in x.names}
        return branch[id(at)]

    for segments, *_ in shapes:
        at, path = root, []
        for s in segments:
            name, at = branches(at)[s]
            path.append(name)
        out[segments] = "/" + "/".join(path)
    return out


Shape = tuple[tuple[str, ...], int, int, int]


def generalise(shapes: list[Shape], min_share: float) -> list[tuple[str, ...]]:
    """The segments of each of a host's distinct shapes (segments, URLs, labelled, good), in which
    rare children are "*"."""
    general: list[tuple[str, ...]] = [()] * len(shapes)
    open_ = set(range(len(shapes)))
    d = 0
    while open_:
        total: dict[tuple, list[int]] = {}
        count: dict[tuple, list[int]] = {}
        for g, (_, n, labelled, _) in zip(general, shapes):
            t = total.setdefault(g, [0, 0])
            t[0], t[1] = t[0] + n, t[1] + labelled
        child = {}
        for k in sorted(open_):
            segs, n, labelled, _ = shapes[k]
            if len(segs) <= d:
                open_.discard(k)
                continue
            t = total[general[k]]
            if d >= MAX_DEPTH and t[0] < MIN_URLS and t[1] < MIN_LABELS:
                child[k] = "**"
                open_.discard(k)
            else:
                child[k] = segs[d]
            c = count.setdefault((general[k], child[k]), [0, 0])
            c[0], c[1] = c[0] + n, c[1] + labelled
        named = {}
        for k, x in child.items():
            n, labelled = count[general[k], x]
            enough = n >= min_share * total[general[k]][0] or n >= MIN_URLS or labelled >= MIN_LABELS
            named[k] = x if enough or x in _WILD else "*"
        for k, x in named.items():
            general[k] = (*general[k], x)
        d += 1
    return general


def _generalised(shapes: DataFrame, min_share: float) -> DataFrame:
    """host, segs, n, labelled, good with gsegs, in which rare children are "*"."""
    now = shapes.withColumns({"gsegs": F.array().cast("array<string>"), "open": F.lit(True)})
    d, depth = 0, shapes.agg(F.max(F.size("segs"))).first()[0] or 0
    few = (F.col("t") < MIN_URLS) & (F.col("k") < MIN_LABELS)
    while d < depth:
        total = now.groupBy("host", "gsegs").agg(F.sum("n").alias("t"), F.sum("labelled").alias("k"))
        child = F.when(F.col("open") & (F.size("segs") > d), F.get("segs", F.lit(d)))
        deep = now.withColumn("child", child)
        if d >= MAX_DEPTH:
            deep = deep.join(total, ["host", "gsegs"]).withColumn("open", F.col("child").isNotNull() & ~few)
            deep = deep.withColumn("child", F.when(F.col("child").isNotNull() & few, "**").otherwise(F.col("child"))).drop("t", "k")
        count = deep.where("child is not null").groupBy("host", "gsegs", "child").agg(F.sum("n").alias("c"), F.sum("labelled").alias("l"))
        enough = (F.col("c") >= min_share * F.col("t")) | (F.col("c") >= MIN_URLS) | (F.col("l") >= MIN_LABELS)
        kept = count.join(total, ["host", "gsegs"]).where(enough | F.col("child").isin(*_WILD)).select("host", "gsegs", "child", F.lit(True).alias("kept"))
        name = F.when(F.col("child").isNull(), F.array().cast("array<string>")).when(F.col("kept"), F.array("child")).otherwise(F.array(F.lit("*")))
        now = cut(deep.join(kept, ["host", "gsegs", "child"], "left").withColumn("gsegs", F.concat("gsegs", name)).drop("child", "kept"))
        d += 1
        if d > MAX_DEPTH:
            depth = now.where("open").agg(F.max(F.size("segs"))).first()[0] or 0
    return now.drop("open")


def filter_urls(pages: DataFrame, labels: DataFrame, url: str = "url", id: str = "page_id", min_share: float = MIN_SHARE, smoothing: float = SMOOTHING, min_purity: float = MIN_PURITY) -> DataFrame:  # noqa: A002
    """id, url, host, template, n_urls, n_labelled, purity, keep: one row for each row of pages.

    labels holds doc_id, quality and toxic of the documents whose number stands in the URL's path; a
    label is good if quality is 1 and toxic is not. A doc_id labelled repeatedly is good if each
    label is; null ids and labels with a null quality count for nothing. Null and odd URLs have the
    host "" and the template of what path they have. With no labels at all purity is null and all
    URLs are kept. Repeated rows count and get their row each. Other columns play no part; an empty
    table gives no rows.
    """
    rows = pages.select(F.col(id).cast("bigint").alias("id"), F.col(url).cast("string").alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "segs": segments_of(F.col("url")), "number": F.nullif(labelled_number(F.col("url")), F.lit("")).cast("bigint")})
    known = labels.select(F.col("doc_id").cast("bigint").alias("number"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1)).cast("int").alias("good")).where("number is not null and good is not null")
    known = known.groupBy("number").agg(F.min("good").alias("good"))
    seen = rows.select("host", "segs", "number").join(known, "number", "left")
    shapes = cut(seen.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")))
    kind = "host string, gsegs array<string>, n bigint, labelled bigint, good bigint, template string"

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        found = templates([(tuple(s), int(n), int(k), int(g)) for s, n, k, g in zip(frame["gsegs"], frame["n"], frame["labelled"], frame["good"])])
        frame["template"] = [found[tuple(s)] for s in frame["gsegs"]]
        return frame

    def whole_host(frame: pd.DataFrame) -> pd.DataFrame:
        shapes = [(tuple(s), int(n), int(k), int(g)) for s, n, k, g in zip(frame["segs"], frame["n"], frame["labelled"], frame["good"])]
        general = generalise(shapes, min_share)
        sums: dict[tuple[str, ...], list[int]] = {}
        for g, x in zip(general, shapes):
            t = sums.setdefault(g, [0, 0, 0])
            for k in range(3):
                t[k] += x[k + 1]
        found = templates([(g, *t) for g, t in sums.items()])
        frame["template"] = [found[g] for g in general]
        return frame

    large = cut(shapes.groupBy("host").count().where(F.col("count") > HOST_SHAPES).select("host"))
    of_shape = shapes.join(small_side(large), "host", "left_anti").groupBy("host").applyInPandas(whole_host, "host string, segs array<string>, n bigint, labelled bigint, good bigint, template string")
    if large.count():
        general = _generalised(shapes.join(small_side(large), "host", "left_semi"), min_share)
        tree = general.groupBy("host", "gsegs").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
        named = cut(tree.groupBy("host").applyInPandas(merged, kind))
        of_shape = of_shape.unionByName(general.join(named.select("host", "gsegs", "template"), ["host", "gsegs"]).drop("gsegs"))
    named = cut(of_shape)
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "good")]
    by_host = named.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("good").alias("hg"))
    whole = named.agg(F.sum("labelled").alias("wl"), F.sum("good").alias("wg"))
    base = F.try_divide(F.col("wg"), F.col("wl"))
    hosts = by_host.crossJoin(F.broadcast(whole)).select("host", ((F.col("hg") + smoothing * base) / (F.col("hl") + smoothing)).alias("rate"))
    judged = named.groupBy("host", "template").agg(*sums).join(hosts, "host").withColumn("purity", F.round((F.col("good") + smoothing * F.col("rate")) / (F.col("labelled") + smoothing), 9))
    judged = cut(judged.select("host", "template", F.col("n").alias("n_urls"), F.col("labelled").alias("n_labelled"), "purity"))
    of_shape = cut(named.select("host", "segs", "template").join(small_side(judged, 4), ["host", "template"]))
    out = rows.join(small_side(of_shape, 8), ["host", "segs"], "left")
    return out.select(F.col("id").alias(id), "url", "host", "template", "n_urls", "n_labelled", "purity", F.coalesce(F.col("purity") >= min_purity, F.lit(True)).alias("keep"))
