"""Citation, similarity and co-occurrence graphs as node and edge frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.search import BROADCAST_ROWS, small
from scriptorium.sources.tables import parts_for, stored


def shared_pairs(rows: DataFrame, item: str, group: str) -> DataFrame:
    """(a, b), a < b, for each group that two items share, dealt by the pair. Rows and pairs are counted first and dealt by their number."""
    named = rows.select(F.col(group).alias("_group"), F.col(item).alias("_item"))
    each = named.groupBy("_group").agg(F.count(F.lit(1)).alias("n"))
    size = each.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).first()
    once = named.repartition(parts_for(rows.sparkSession, size["rows"] or 0), "_group").distinct()
    left, right = once.select("_group", F.col("_item").alias("a")), once.select("_group", F.col("_item").alias("b"))
    return left.join(right, "_group").filter("a < b").select("a", "b").repartition(parts_for(rows.sparkSession, int(size["pairs"] or 0)), "a", "b")


def co_occurrence(rows: DataFrame, item: str, group: str, least: int = 1) -> DataFrame:
    """(a, b, weight): pairs of items with the number of groups they share, a < b, at the least or above."""
    return shared_pairs(rows, item, group).groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight")).filter(F.col("weight") >= least)


def citation_edges(citations: DataFrame, source: str, target: str) -> DataFrame:
    """Directed edges, each once, no loops."""
    return citations.filter(F.col(target).isNotNull() & (F.col(source) != F.col(target))).select(F.col(source).alias("a"), F.col(target).alias("b")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each edge (a, b, ...). Edges are worked out once."""
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.withColumn("_ends", F.explode(ends)).withColumns({"a": F.col("_ends.a"), "b": F.col("_ends.b")}).drop("_ends")


def strongest(edges: DataFrame, k: int, weight: str = "weight") -> DataFrame:
    """Edges that are among the k heaviest of one of their ends."""
    both = undirected(edges)
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc(weight), "b"))).filter(F.col("rank") <= k)
    return ranked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), weight).distinct()


def combined(edges: list[tuple[str, DataFrame]]) -> DataFrame:
    """(a, b, weight, kind): of several kinds of edges between two nodes the first kind stays."""
    every = None
    for place, (kind, df) in enumerate(edges):
        part = df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("weight").cast("double").alias("weight"), F.lit(kind).alias("kind"), F.lit(place).alias("place"))
        every = part if every is None else every.unionByName(part)
    best = every.groupBy("a", "b").agg(F.min(F.struct("place", F.col("kind"), F.col("weight"))).alias("e"))
    return best.select("a", "b", "e.weight", "e.kind")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, degree) of directed edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("b").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"), F.count(F.lit(1)).alias("degree"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean degree, density = edges / (n (n - 1))."""
    n, m = nodes.agg(F.count(F.lit(1)).alias("nodes")), edges.agg(F.count(F.lit(1)).alias("edges"))
    both = n.crossJoin(m)  # one row each
    pairs = F.col("nodes").cast("double") * (F.col("nodes") - 1)
    return both.select("nodes", "edges", F.round(F.coalesce(F.try_divide(2 * F.col("edges"), "nodes"), F.lit(0.0)), 6).alias("mean_degree"), F.round(F.coalesce(F.try_divide("edges", pairs), F.lit(0.0)), 9).alias("density"))


def subgraph(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Edges with both ends among the nodes."""
    kept = nodes.select(F.col(node).alias("_n")).distinct()
    return edges.join(kept, F.col("a") == F.col("_n"), "left_semi").join(kept, F.col("b") == F.col("_n"), "left_semi")


def neighbours(edges: DataFrame, similar: DataFrame, seeds: DataFrame, k: int = 10) -> DataFrame:
    """(seed, relation, node, weight): nodes cited by the seeds, citing them, and the k most similar ones."""
    s = seeds.select(F.col("node").alias("seed"))
    out = edges.join(s, F.col("a") == F.col("seed")).select("seed", F.lit("out").alias("relation"), F.col("b").alias("node"), F.lit(1.0).alias("weight"))
    into = edges.join(s, F.col("b") == F.col("seed")).select("seed", F.lit("in").alias("relation"), F.col("a").alias("node"), F.lit(1.0).alias("weight"))
    near = undirected(similar).join(s, F.col("a") == F.col("seed")).select("seed", F.lit("similar").alias("relation"), F.col("b").alias("node"), F.col("weight").cast("double").alias("weight"))
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("weight"), "node"))).filter(F.col("rank") <= k).drop("rank")
    return out.unionByName(into).unionByName(best)


#: Links and notes of one target that meet in a task, where a target has many of both.
CELL_ROWS = 1000


def linked_notes(links: DataFrame, notes: DataFrame) -> DataFrame:
    """(source, target): links to notes by path without .md, by path, or by title; one equi join each, no theta join.

    A pair comes out where the first of the note's names that its source links to is met, so pairs are never shuffled to make them one. Targets
    with many links and notes are dealt to cells of about ``CELL_ROWS`` of each.
    """
    keys = F.array_distinct(F.filter(F.array(F.regexp_replace("path", r"\.md$", ""), F.col("path"), F.col("title")), lambda k: k.isNotNull()))
    named = notes.filter("note_id is not null").select("note_id", keys.alias("k")).groupBy("note_id").agg(F.array_distinct(F.flatten(F.collect_list("k"))).alias("keys")).select("note_id", "keys", F.explode("keys").alias("target"))
    asked = links.filter("source is not null").groupBy("source").agg(F.collect_set("target").alias("targets")).select("source", "targets", F.explode("targets").alias("target"))
    many = lambda df, c: df.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).alias(c))
    dealt = stored(many(asked, "p").join(many(named, "q"), "target").filter("p > 1 or q > 1"))
    cell = lambda c, n: F.pmod(F.xxhash64(c), F.coalesce(n, F.lit(1)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(n), F.lit(1)) - 1))
    left = asked.join(small(dealt), "target", "left").select("source", "targets", "target", cell("source", F.col("p")).alias("i"), every("q").alias("j"))
    right = named.join(small(dealt), "target", "left").select("note_id", "keys", "target", cell("note_id", F.col("q")).alias("j"), every("p").alias("i"))
    met = left.join(right, ["target", "i", "j"]).filter((F.col("source") != F.col("note_id")) & (F.get(F.array_intersect("keys", "targets"), F.lit(0)) == F.col("target")))
    return met.select("source", F.col("note_id").alias("target"))


def propagated(edges: DataFrame) -> DataFrame:
    """(node, community) by label propagation: a node wants the heaviest label around it, its own on a tie, then the least.

    In each round about half of the nodes, by a hash of node and round, take the label that they want, so neighbours
    don't swap labels for ever; rounds end when no node wants another. The state is written down each round.
    """
    both = stored(undirected(edges.select("a", "b", F.col("weight").cast("double").alias("weight"))))
    labels = stored(both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node")))
    turn = 0
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a", "community").agg(F.round(F.sum("weight"), 6).alias("w"))
        held = seen.join(labels.select(F.col("node").alias("a"), F.col("community").alias("own")), "a")
        wanted = held.groupBy("a", "own").agg(F.min_by("community", F.struct(-F.col("w"), F.col("community") != F.col("own"), F.col("community"))).alias("wanted"))
        moved = F.when(F.pmod(F.xxhash64("a", F.lit(turn)), F.lit(2)) == 0, F.col("wanted")).otherwise(F.col("own"))
        state = stored(wanted.select(F.col("a").alias("node"), moved.alias("community"), (F.col("own") != F.col("wanted")).alias("open")))
        labels, turn = state.select("node", "community"), turn + 1
        if state.filter("open").isEmpty():
            return labels


def modularity(edges: DataFrame, communities: DataFrame, weighted: bool = True) -> float:
    """Modularity of (node, community) over undirected (a, b, weight) edges; 0 without edges."""
    both = _doubled(edges, weighted)
    of = lambda c, to: communities.select(F.col("node").alias(c), F.col("community").alias(to))
    sums = both.join(of("a", "ca"), "a").join(of("b", "cb"), "b").groupBy("ca").agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("inner"))
    r = sums.agg(F.sum("total").alias("m"), F.sum("inner").alias("inner"), F.sum(F.col("total") * F.col("total")).alias("squares")).first()
    return r["inner"] / r["m"] - r["squares"] / r["m"] ** 2 if r["m"] else 0.0


def _ends(edges: DataFrame, weighted: bool) -> DataFrame:
    weight = F.col("weight").cast("double") if weighted else F.lit(1.0)
    return edges.filter("a is not null and b is not null").select("a", "b", weight.alias("weight")).filter("weight > 0")


def _doubled(edges: DataFrame, weighted: bool, parts: int | None = None) -> DataFrame:
    """Both directions of each undirected edge once, weights of repeated ones summed; an edge from a node to itself counts twice, as its ends do.

    With ``parts``, all edges from a node lie together in one of so many tasks.
    """
    both = undirected(_ends(edges, weighted))
    both = both.repartition(parts, "a") if parts else both
    return both.groupBy("a", "b").agg((F.sum("weight") if weighted else F.when(F.col("a") == F.col("b"), 2.0).otherwise(1.0)).alias("weight"))


#: Gains below this share of the mean weight are none. Where fewer than one in so many nodes may move together, moves are chosen apart.
LEAST_GAIN, LEAST_SHARE = 1e-6, 40


def communities(edges: DataFrame, weighted: bool = True, tolerance: float = 1e-4) -> DataFrame:
    """(node, community, level) by modularity: nodes move to the neighbouring community of greatest gain, communities become nodes, and again.

    Edges are undirected, (a, b, weight). A community is named by its least node; level counts the contractions. In a round every node
    works out its best move from its links, its strength and the communities' totals. First half of the
    nodes, by a hash, move at once; if modularity doesn't grow by that, the round is undone and an eighth moves, and
    so on; below one in forty only moves between communities that no better move touches are made, whose gains add
    up exactly. So modularity grows in every round that stays. A level ends where no single move gains any more, or where such a careful round gains less
    than ``tolerance`` (0: never for that reason). States are written down; each job
    reads one level's edges, which shrink with every level. Nodes with edges only are known.
    """
    once = stored(_ends(edges, weighted))
    # what a round adds up for a node and a community is one row in one task, before anything is shuffled
    links = stored(_doubled(once, weighted, parts_for(edges.sparkSession, 2 * once.count())))
    members = stored(links.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node")))
    whole, level = links.agg(F.sum("weight")).first()[0], 0
    while whole:
        found = _moved(links, whole, tolerance)
        if found is None:
            break
        level += 1
        names = stored(found.groupBy("community").agg(F.min("node").alias("name")).join(found, "community").select("node", "name"))
        members = stored(members.join(names.withColumnRenamed("node", "community"), "community").select("node", F.col("name").alias("community")))
        of = lambda c, to: names.select(F.col("node").alias(c), F.col("name").alias(to))
        links = stored(links.join(of("a", "x"), "a").join(of("b", "y"), "b").groupBy("x", "y").agg(F.sum("weight").alias("weight")).select(F.col("x").alias("a"), F.col("y").alias("b"), "weight"))
    return members.withColumn("level", F.lit(level))


def _moved(links: DataFrame, whole: float, tolerance: float) -> DataFrame | None:
    """(node, community) after the rounds of one level; None if no move gains."""
    least = LEAST_GAIN * whole / links.count()
    labels = stored(links.groupBy("a").agg(F.sum("weight").alias("strength")).select(F.col("a").alias("node"), F.col("a").alias("community"), "strength"))
    near = F.broadcast if labels.count() <= BROADCAST_ROWS else lambda df: df  # rows a node and a community; their number is that of the level's nodes at most
    start, turn, reached, share = labels, 0, None, 2  # one in so many nodes moves
    while True:
        state = _proposals(links, labels, whole, near)
        r = state.agg(F.sum("inner").alias("inner"), F.sum(F.when(F.col("gain") > least, 1).otherwise(0)).alias("moves")).first()
        squares = labels.groupBy("community").agg(F.sum("strength").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0]
        now = r["inner"] / whole - squares / whole**2
        more = None if reached is None else now - reached[0]
        if r["moves"] == 0 or share > LEAST_SHARE and more < tolerance:
            break
        if more is not None and share <= LEAST_SHARE and more <= 0:
            now, labels, state = reached  # undone
        if more is not None and more <= tolerance:
            share = min(share * 4, 2 * LEAST_SHARE)
        else:
            share = max(2, share // 2)
        reached = (now, labels, state)
        wanted = state.filter(F.col("gain") > least)
        if share > LEAST_SHARE:
            # a move stays if it is the best of all that touch either community
            order = F.struct((-F.col("gain")).alias("g"), F.col("node").alias("n"))
            touched = wanted.select("node", F.explode(F.array("community", "wanted")).alias("c"), order.alias("order"))
            first = touched.groupBy("c").agg(F.min("order").alias("first"))
            alone = touched.join(first, "c").groupBy("node").agg(F.min((F.col("order") == F.col("first")).cast("int")).alias("best")).filter("best = 1")
            goes = wanted.join(alone.select("node"), "node", "left_semi")
        else:
            goes = wanted.filter(F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(share)) == 0)
        labels = stored(labels.join(goes.select("node", "wanted"), "node", "left").select("node", F.coalesce("wanted", "community").alias("community"), "strength"))
        turn += 1
    return None if labels is start else labels.select("node", "community")


def _proposals(links: DataFrame, labels: DataFrame, whole: float, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, community, inner, wanted, gain): the weight of each node's links into its own community, and its best move with the gain in units of weight, stored."""
    total = labels.groupBy("community").agg(F.sum("strength").alias("total"))
    outer = links.filter("a <> b").join(near(labels.select(F.col("node").alias("b"), F.col("community").alias("to"))), "b").groupBy("a", "to").agg(F.sum("weight").alias("w"))
    loops = links.filter("a = b").select(F.col("a").alias("node"), F.col("weight").alias("loop"))
    own = labels.join(near(total), "community").select("node", "community", "strength", F.col("total").alias("own_total"))
    beside = outer.join(near(total.select(F.col("community").alias("to"), "total")), "to").withColumnRenamed("a", "node")
    joined = own.join(beside, "node", "left")
    # of moving there from a community of its own, over the whole weight; what stays behind doesn't count itself
    value = F.col("w") - F.col("strength") * F.col("total") / whole
    stay = F.coalesce(F.max(F.when(F.col("to") == F.col("community"), F.col("w"))), F.lit(0.0))
    best = joined.groupBy("node", "community", "strength", "own_total").agg(
        stay.alias("held"), F.min(F.when(F.col("to") != F.col("community"), F.struct((-F.round(value, 9)).alias("v"), F.col("to").alias("to")))).alias("best")
    )
    gain = -F.col("best.v") - (F.col("held") - F.col("strength") * (F.col("own_total") - F.col("strength")) / whole)
    return stored(
        best.join(loops, "node", "left").select("node", "community", (F.col("held") + F.coalesce("loop", F.lit(0.0))).alias("inner"), F.col("best.to").alias("wanted"), F.coalesce(gain, F.lit(0.0)).alias("gain"))
    )
