"""Graph operators over (entity, edge): subtrees, neighbourhoods, components, communities, redirects.
Loops keep one materialised frame per round and stop when nothing new appears."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import HUB_TYPES, Library
from ..session import broadcast_if_small, cut, stored


def live(edge: DataFrame) -> DataFrame:
    return edge.filter(F.col("status") != "rejected")


def topic_subtree(lib: Library, roots: DataFrame) -> DataFrame:
    """(root, key, depth): every root with all its live is_a descendants. Cycles end because a pair
    already seen is never expanded again; the number of rounds is the depth of the tree."""
    is_a = live(lib.edge).filter(F.col("type") == "is_a").select(F.col("src").alias("child"), F.col("dst").alias("parent"))
    found = frontier = roots.select(F.col("key").alias("root"), "key", F.lit(0).alias("depth"))
    depth = 0
    while True:
        depth += 1
        step = (frontier.join(is_a, F.col("key") == F.col("parent")).select("root", F.col("child").alias("key")).distinct()
                .join(found.select("root", "key"), ["root", "key"], "left_anti"))
        frontier = cut(step.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)


def both_ways(edge: DataFrame, *extra: str) -> DataFrame:
    """(node, other): every edge seen from both ends."""
    return (edge.select(F.col("src").alias("node"), F.col("dst").alias("other"), *extra)
            .unionAll(edge.select(F.col("dst").alias("node"), F.col("src").alias("other"), *extra)))


def neighbors(lib: Library, centers: DataFrame, hops: int = 1, edge_types: list[str] | None = None,
              include_rejected: bool = False) -> DataFrame:
    """(center, key): nodes within one or two hops. Hubs are reached but never expanded."""
    edge = lib.edge if include_rejected else live(lib.edge)
    if edge_types:
        edge = edge.filter(F.col("type").isin(*edge_types))
    adj = both_ways(edge)
    start = centers.select(F.col("key").alias("center"))
    hop1 = start.join(adj, F.col("center") == F.col("node")).select("center", F.col("other").alias("key")).distinct()
    reach = hop1
    if hops >= 2:
        hubs = lib.entity.filter(F.col("type").isin(*HUB_TYPES)).select("key")
        open_ = hop1.join(hubs, "key", "left_anti").filter(F.col("key") != F.col("center"))
        hop2 = open_.join(adj, F.col("key") == F.col("node")).select("center", F.col("other").alias("key"))
        reach = hop1.unionByName(hop2).distinct()
    reach = reach.filter(F.col("key") != F.col("center"))
    if not include_rejected:
        reach = reach.join(lib.entity.filter(F.col("status") != "rejected").select("key"), "key", "left_semi")
    return reach


def edges_at(lib: Library, keys: DataFrame) -> DataFrame:
    """The edges with an end among ``keys`` (key, each once). Where they are folded from statements, the statements
    elsewhere are left out before."""
    def apart(e: DataFrame) -> tuple[DataFrame, DataFrame]:
        out = e
        for end in ("src", "dst"):
            out = out.join(k.select(F.col("key").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
        return out.filter(F.coalesce("_src", "_dst").isNotNull()).select(*e.columns), e

    k = broadcast_if_small(keys)
    return (lib.edge_parts(apart) if hasattr(lib, "edge_parts") else apart(lib.edge))[0]


def within_two_hops(lib: Library, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) joined by an edge or by a shared non-hub neighbour. Only the end of lower degree is expanded;
    whether its neighbours reach the other end is a semi-join on the edge itself, whatever the degree of that end. All
    edges this asks for have an end among the pairs', so no others are read."""
    p = cut(pairs.select("a", "b").distinct())
    ends = cut(p.select(F.col("a").alias("node")).unionByName(p.select(F.col("b").alias("node"))).filter("node is not null").distinct())
    near = cut(live(edges_at(lib, ends.withColumnRenamed("node", "key"))).select("src", "dst").distinct())
    adj = cut(both_ways(near).join(ends, "node", "left_semi").distinct())
    degree = cut(adj.groupBy("node").agg(F.count(F.lit(1)).alias("d")))
    p = (p.join(degree.select(F.col("node").alias("a"), F.col("d").alias("da")), "a")  # an end without an edge has no path
         .join(degree.select(F.col("node").alias("b"), F.col("d").alias("db")), "b"))
    low = F.col("da") <= F.col("db")
    p = cut(p.select("a", "b", F.when(low, F.col("a")).otherwise(F.col("b")).alias("near"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("far")))
    edge = adj.select(F.col("other").alias("mid"), F.col("node").alias("far"))
    direct = p.join(edge.withColumnRenamed("mid", "near"), ["near", "far"], "left_semi").select("a", "b")
    hubs = lib.entity.filter(F.col("type").isin(*HUB_TYPES)).select(F.col("key").alias("mid"))
    open_ = p.join(direct, ["a", "b"], "left_anti").join(adj.select(F.col("node").alias("near"), F.col("other").alias("mid")), "near").join(hubs, "mid", "left_anti")
    shared = open_.join(edge, ["mid", "far"], "left_semi").select("a", "b")
    return direct.unionByName(shared).distinct()


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, component): connected components, named by their smallest key. Each round takes the
    smallest label among a node and its neighbours, then jumps to the label's own label, so long
    chains close in a logarithmic number of rounds."""
    adj = cut(both_ways(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).distinct())
    label = cut(nodes.select("key", F.col("key").alias("component")))
    while True:
        seen = (adj.join(label.withColumnRenamed("key", "other"), "other")
                .groupBy(F.col("node").alias("key")).agg(F.min("component").alias("best")))
        step = (label.join(seen, "key", "left")
                .select("key", F.least("component", F.coalesce("best", "component")).alias("near"),
                        F.col("component").alias("old")))
        jump = step.select(F.col("key").alias("near"), F.col("near").alias("far"))
        nxt = cut(step.join(jump, "near", "left")
                  .select("key", F.least("near", F.coalesce("far", "near")).alias("component"), "old"))
        changed = not nxt.filter(F.col("component") != F.col("old")).isEmpty()
        label = nxt.select("key", "component")
        if not changed:
            return label


def numbered_by_size(labels: DataFrame, key: str = "key", label: str = "component", min_size: int = 1) -> DataFrame:
    """(label, n, number): labels numbered 0, 1, ... by size, the smaller label first among equals."""
    from ..session import global_row_number
    sizes = labels.groupBy(label).agg(F.count("*").alias("n")).filter(F.col("n") >= min_size)
    return global_row_number(sizes, [F.col("n").desc(), F.col(label)], "number", start=F.lit(-1))


def families(topics: DataFrame, is_a: DataFrame) -> DataFrame:
    """(key, family): components of the drawn topics' is_a links, numbered by size; null when alone."""
    inside = (is_a.join(topics.select(F.col("key").alias("src")), "src", "left_semi")
              .join(topics.select(F.col("key").alias("dst")), "dst", "left_semi"))
    comp = components(topics.select("key"), inside.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    number = numbered_by_size(comp, min_size=2)
    return comp.join(number, "component", "left").select("key", F.col("number").alias("family"))


def best_labels(adj: DataFrame, label: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """(key, best): the label most neighbours have, the smallest among equals; of the nodes ``at`` (key) only if given.
    adj(node, other), label(key, label)."""
    near = adj if at is None else adj.join(at.select(F.col("key").alias("node")), "node", "left_semi")
    votes = (near.join(label.select(F.col("key").alias("other"), "label"), "other").groupBy(F.col("node").alias("key"), "label").agg(F.count(F.lit(1)).alias("v")))
    return votes.groupBy("key").agg(F.min(F.struct((-F.col("v")).alias("v"), F.col("label").alias("l")))["l"].alias("best"))


def settled_labels(adj: DataFrame, label: DataFrame) -> DataFrame:
    """(key, label) after label propagation to its end: every node has the best label of its neighbours. Of the nodes
    that want another label, a round moves those whose turn comes before that of all their neighbours who want a different
    one. Neighbours who move together move to one label, so the number of edges inside a label grows, or labels fall at
    the same number, and the rounds end. Turns go by the number of binary digits of the degree, then by a hash of node and
    round: with hashes alone, a neighbour of many hubs waits for all of them and they for it, hundreds of rounds. Only a
    moved node's neighbours look again."""
    weight = stored(adj.groupBy(F.col("node").alias("key")).agg(F.length(F.bin(F.count(F.lit(1)))).alias("digits")), "degrees")
    open_, r = best_labels(adj, label), 0
    while True:
        turn = F.struct("digits", F.xxhash64("key", F.lit(r)).alias("hash")).alias("turn")
        wish = stored(open_.join(label, "key").filter("best != label").join(weight, "key").select("key", "best", turn), "wish")
        if wish.isEmpty():
            return label
        other = wish.select(F.col("key").alias("other"), F.col("best").alias("wanted"), F.col("turn").alias("theirs"))
        rival = (adj.join(wish.select(F.col("key").alias("node"), "best", "turn"), "node").join(other, "other")
                 .filter((F.col("wanted") != F.col("best")) & (F.struct("theirs", "other") < F.struct("turn", "node"))).select(F.col("node").alias("key")).distinct())
        moved = stored(wish.join(rival, "key", "left_anti").select("key", "best"), "moved")
        label = stored(label.join(moved, "key", "left").select("key", F.coalesce("best", "label").alias("label")), "labels")
        again = (adj.join(moved.select(F.col("key").alias("node")), "node", "left_semi").select(F.col("other").alias("key"))
                 .unionByName(wish.join(moved.select("key"), "key", "left_anti").select("key")).distinct())
        open_, r = best_labels(adj, label, again), r + 1


def community_links(lib: Library) -> tuple[DataFrame, DataFrame]:
    """(nodes, adj): the entities without hubs, and (node, other) for each live pair, from both ends."""
    nodes = lib.entity.filter(~F.col("type").isin(*HUB_TYPES)).select("key").distinct()
    inside = (live(lib.edge).filter("src != dst").select("src", "dst").distinct()
              .join(nodes.withColumnRenamed("key", "src"), "src", "left_semi")
              .join(nodes.withColumnRenamed("key", "dst"), "dst", "left_semi"))
    return stored(nodes, "nodes"), stored(both_ways(inside), "adjacent")


def communities(lib: Library, links: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(key, community): label propagation without hubs, numbered by size. An edge in both directions counts twice. Only
    nodes with links go through its rounds. ``links`` are the ``community_links``, if they are known."""
    nodes, adj = links or community_links(lib)
    linked = stored(adj.select(F.col("node").alias("key")).distinct().withColumn("label", F.col("key")), "labels")
    alone = nodes.join(linked.select("key"), "key", "left_anti").withColumn("label", F.col("key"))
    label = stored(settled_labels(adj, linked).unionByName(alone), "settled")
    number = numbered_by_size(label, label="label")
    return label.join(number, "label").select("key", F.col("number").alias("community"))


def redirect_closure(links: DataFrame) -> DataFrame:
    """(key, target): each redirected key with the end of its chain; ``links`` is (key, into), one row
    per key. Pointer jumping doubles the distance every round, so whatever is still open once the
    distance exceeds the number of links runs into a cycle: such keys stay themselves and get no row."""
    cur = cut(links.select("key", F.col("into").alias("target")))
    total, reach = cur.count(), 1
    while True:
        hop = cur.select(F.col("key").alias("target"), F.col("target").alias("next"))
        step = cut(cur.join(hop, "target", "left")
                   .select("key", F.coalesce("next", "target").alias("target"), F.col("next").isNotNull().alias("open")))
        cur = step.select("key", "target")
        if step.filter("open").isEmpty():
            return cur
        reach *= 2
        if reach > total:
            return step.filter("not open").select("key", "target")


def one_hop(lib: Library, edge_type: str, up: bool) -> DataFrame:
    """(key, other): live parents (up) or children of each node by one edge type."""
    e = live(lib.edge).filter(F.col("type") == edge_type)
    a, b = ("src", "dst") if up else ("dst", "src")
    return e.select(F.col(a).alias("key"), F.col(b).alias("other"))


def degree(lib: Library) -> DataFrame:
    """(key, degree): live edges on either side."""
    return both_ways(live(lib.edge)).groupBy(F.col("node").alias("key")).agg(F.count("*").alias("degree"))


def rank_in(partition: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
