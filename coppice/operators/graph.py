"""The import graph: degrees, reachability, impact, strong components, exports.

Edges are rows ``repo, snapshot, src, dst`` (and ``decl_only``); all trees are
worked on at once.  The loops join a frontier with the edges and write each
round to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.functions import paths
from coppice.operators.skew import by_merge, first_n, numbered, salted_join, skew_join
from coppice.schema import TREE
from coppice.session import Folder, Newest, Rounds, cut, is_empty, loop_settings

EDGE = [*TREE, "src", "dst"]


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(*TREE, F.col("dst").alias("src"), F.col("src").alias("dst"))


def degrees(edges: DataFrame) -> DataFrame:
    """Imports and importers of every file in the graph, in one aggregation."""
    ends = edges.select(
        *TREE,
        F.explode(
            F.array(
                F.struct(F.col("src").alias("path"), F.lit(1).alias("out"), F.lit(0).alias("in")),
                F.struct(F.col("dst").alias("path"), F.lit(0).alias("out"), F.lit(1).alias("in")),
            )
        ).alias("_e"),
    )
    return ends.groupBy(*TREE, F.col("_e.path").alias("path")).agg(
        F.sum("_e.out").alias("imports"), F.sum("_e.in").alias("imported_by")
    )


def most_depended(edges: DataFrame, n: int = 10) -> DataFrame:
    """Files imported by most others.

    Equal ones go by their first importer in path order, then by path: that is
    the order in which importers, read in path order, first mention them.
    """
    counted = edges.groupBy(*TREE, F.col("dst").alias("path")).agg(
        F.count("*").alias("used_by_count"), F.min("src").alias("_first")
    )
    order = [F.col("used_by_count").desc(), F.col("_first"), F.col("path")]
    return first_n(counted, TREE, order, n).drop("_first")


# ---------------------------------------------------------------- reachability


def _number(seed: int, file: str) -> Column:
    """A number for a file, from its tree and path; a null is not an empty text."""
    whole = [*TREE, file]
    return F.xxhash64(F.lit(seed), *whole, *[F.isnull(c) for c in whole])


def _tree() -> Column:
    """A number for a tree, by which trees are told apart where it does no harm that two share one."""
    return F.xxhash64(*TREE).alias("tree")


def _alike(nodes: DataFrame) -> bool:
    """Whether two files have one number."""
    return not is_empty(nodes.groupBy("id").count().where("count > 1"))


def _coded(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(nodes, links)``: the files with a number each, and the edges as pairs of numbers.

    Numbers are unique over all trees, so the loops carry two longs where they
    would carry four strings.  A number is a hash of the file, so edges get
    theirs without a join; should two files share one, all are numbered anew.
    """
    edges = cut(edges.select(*EDGE), "edges")
    names = cut(edges.select(*TREE, F.explode(F.array("src", "dst")).alias("node")).distinct(), "names")
    seed = 0
    while _alike(nodes := names.withColumn("id", _number(seed, "node"))):
        seed += 1
    # An edge with a null in it leads nowhere.
    whole = edges.dropna()
    return nodes, cut(whole.select(_number(seed, "src").alias("a"), _number(seed, "dst").alias("b")).distinct(), "links")


def _follow(frontier: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of ``frontier`` (``node`` and others) for every link from their node, which ends in ``b``.

    The links of a hub are split by the adaptive skew join: what comes of them
    is grouped anew in any case.
    """
    return frontier.join(by_merge(links.withColumnRenamed("a", "node")), "node")


HOPS = 4


def _steps(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, to, own``: the links, and for every node one ``own`` row to itself.

    Joined with a loop's state they give both what is sent and what stays, so
    a hop reads the state once and it need not move between hops.
    """
    own = nodes.select("node", F.col("node").alias("to"), F.lit(True).alias("own"))
    sent = links.select(F.col("a").alias("node"), F.col("b").alias("to"), F.lit(False).alias("own"))
    return cut(sent.unionByName(own), "steps")


#: So many numbers of trees can be sent to every task, some 8 MB.
FEW_TREES = 1 << 17


class _Settled:
    """Rows of trees in which a loop has nothing more to do.

    No link leaves its tree, so a tree in which nothing moved stays as it is,
    and the next rounds need not carry it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self._rounds = Rounds(spark, name)

    def going(self, state: DataFrame) -> DataFrame | None:
        """The rows of trees in which something moved, if any; those of the others are put aside."""
        moved = cut(state.where("moved").select("tree").distinct(), "moved")
        n = moved.count()
        if not n:
            self._rounds.add(state)
            return None

        def joined(how: str) -> DataFrame:
            if n <= FEW_TREES:
                return state.join(F.broadcast(moved), "tree", how)
            return salted_join(state, moved, ["tree"], ["node"], how, grows=True)

        self._rounds.add(joined("left_anti"))
        return joined("left_semi")

    def all(self, like: DataFrame) -> DataFrame:
        return self._rounds.all(like)


def _reach(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """Numbers reached from ``seeds`` (``node`` and maybe ``root``), with the distance.

    Breadth first, ``HOPS`` steps in each written round: what the last step
    found goes on along the links, and the smallest distance of each node stays.
    """
    spark = links.sparkSession
    key = [c for c in ("root", "node") if c in seeds.columns]
    keep = [c for c in key if c != "node"]
    with loop_settings(spark):
        steps = _steps(links, links.select(F.col("b").alias("node")).distinct())
        state = _follow(seeds.select(*key).distinct(), links).select(*keep, F.col("b").alias("node")).distinct()
        state = state.select(*key, F.lit(1).alias("dist"), F.lit(True).alias("moved"))
        rounds = Newest(spark, "reach")
        while True:
            for _ in range(HOPS):
                state = (
                    state.join(by_merge(steps), "node")
                    .where("own or moved")
                    .select(
                        *keep,
                        F.col("to").alias("node"),
                        F.when(F.col("own"), F.col("dist")).otherwise(F.col("dist") + 1).alias("dist"),
                        F.when(F.col("own"), F.col("dist")).alias("before"),
                    )
                    .groupBy(*key)
                    .agg(F.min("dist").alias("dist"), F.min("before").alias("before"))
                    .select(*key, "dist", F.col("before").isNull().alias("moved"))
                )
            state = rounds.set(state)
            if is_empty(state.where("moved")):
                return state.drop("moved")


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Files reached from ``seeds`` in one or more steps, with the distance.

    ``seeds`` has ``repo, snapshot, node`` and maybe ``root``, a file as well:
    then every root has a closure of its own.  A seed is among the reached
    files only if some path leads back to it.
    """
    nodes, links = _coded(edges)
    rooted = "root" in seeds.columns
    coded = seeds.join(by_merge(nodes), [*TREE, "node"])
    if rooted:
        roots = nodes.select(*TREE, F.col("node").alias("root"), F.col("id").alias("_r"))
        coded = coded.join(by_merge(roots), [*TREE, "root"]).select(F.col("_r").alias("root"), F.col("id").alias("node"))
    else:
        coded = coded.select(F.col("id").alias("node"))
    found = _reach(links, coded)
    # A file that many roots reach is a hot key on the way back to names.
    named = skew_join(
        found.withColumnRenamed("node", "id"), nodes, ["id"], ["root"] if rooted else ["id"]
    ).drop("id")
    if not rooted:
        return named.select(*TREE, "node", "dist")
    back = nodes.select(F.col("id").alias("root"), F.col("node").alias("_root"))
    return (
        skew_join(named, back, ["root"], ["node"])
        .drop("root")
        .withColumnRenamed("_root", "root")
        .select(*TREE, "root", "node", "dist")
    )


def impact(edges: DataFrame, roots: DataFrame, reverse: bool = False) -> DataFrame:
    """What each root depends on (or, reversed, what depends on it), root left out.

    ``direct`` marks distance 1.
    """
    seeds = roots.select(*TREE, F.col("path").alias("root"), F.col("path").alias("node"))
    graph = reversed_edges(edges) if reverse else edges
    return (
        reachable(graph, seeds)
        .where(F.col("node") != F.col("root"))
        .withColumn("direct", F.col("dist") == 1)
    )


def _levels(dag: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, level``: the longest way from each node of an acyclic graph to one without links.

    ``nodes`` has ``tree``, too.
    """
    spark = dag.sparkSession
    steps = _steps(dag.select(F.col("b").alias("a"), F.col("a").alias("b")), nodes.select("node"))
    state = nodes.select("node", "tree", F.lit(0).alias("level"), F.lit(True).alias("moved"))
    rounds, settled = Newest(spark, "levels"), _Settled(spark, "settled-levels")
    while True:
        for _ in range(HOPS):
            state = (
                state.join(by_merge(steps), "node")
                .where("own or moved")
                .select(
                    F.col("to").alias("node"),
                    "tree",
                    F.when(F.col("own"), F.col("level")).otherwise(F.col("level") + 1).alias("level"),
                    F.when(F.col("own"), F.col("level")).alias("before"),
                )
                .groupBy("node")
                .agg(F.min("tree").alias("tree"), F.max("level").alias("level"), F.max("before").alias("before"))
                .select("node", "tree", "level", (F.col("level") > F.col("before")).alias("moved"))
            )
        whole = rounds.set(state)
        state = settled.going(whole)
        if state is None:
            return settled.all(whole).select("node", "level")


def _reach_bits(edges: DataFrame, reverse: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(placed, bits, links)``: what every file reaches, as bits.

    Files that can reach each other become one node first.  What a node of the
    acyclic rest reaches is a row of bits for every 64 files of its tree.  Nodes
    are done level by level from those without links on: a node's bits are its
    own files' and those sent by the nodes it links to, and are sent on once
    along each link, so no round moves what earlier rounds found.  ``placed``
    has each file with its node, ``label``, and its place ``n`` in its tree.
    """
    spark = edges.sparkSession
    graph = (reversed_edges(edges) if reverse else edges).where(F.col("src") != F.col("dst"))
    with loop_settings(spark):
        nodes, links, members = _members(graph)
        labels_ = nodes.join(by_merge(members.withColumnRenamed("node", "id")), "id", "left").select(
            *TREE, "node", "id", F.coalesce("label", "id").alias("label")
        )
        placed = cut(numbered(labels_, TREE, [F.col("label"), F.col("node")], "n"), "placed")
        by_id = placed.select(F.col("id").alias("a"), F.col("label").alias("_a"))
        to_id = placed.select(F.col("id").alias("b"), F.col("label").alias("_b"))
        between = skew_join(skew_join(links, by_id, ["a"], ["b"]), to_id, ["b"], ["a"])
        dag = cut(between.where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), "dag")
        level = _levels(dag, placed.select(F.col("label").alias("node"), _tree()).distinct())
        top = level.agg(F.max("level")).first()[0]

        rounds = Folder(spark, "reach-bits")
        n = F.col("n") - 1
        own = placed.groupBy(F.col("label").alias("node"), F.floor(n / 64).cast("int").alias("block")).agg(
            F.expr("bit_or(shiftleft(1L, cast((n - 1) % 64 AS int)))").alias("bits")
        )
        own.join(by_merge(level), "node").write.partitionBy("level").parquet(rounds.path("own"))
        by_user = dag.join(by_merge(level.select(F.col("node").alias("a"), F.col("level").alias("for"))), "a")
        by_level = by_user.join(by_merge(level.select(F.col("node").alias("b"), F.col("level").alias("of"))), "b")
        # Each level reads the links to its own nodes only.
        by_level.select(F.col("b").alias("node"), "a", "for", "of").write.partitionBy("of").parquet(rounds.path("uses"))
        schema = "node bigint, block int, bits bigint"
        for now in range(0 if top is None else top + 1):
            held = spark.read.schema(schema).parquet(rounds.path(f"own/level={now}"))
            if now:
                sent = spark.read.schema(schema).parquet(rounds.path(f"sent/from=*/for={now}"))
                held = held.unionByName(sent).groupBy("node", "block").agg(F.expr("bit_or(bits)").alias("bits"))
            held.write.parquet(rounds.path(f"done/level={now}"))
            done = spark.read.schema(schema).parquet(rounds.path(f"done/level={now}"))
            if now < top:
                uses = spark.read.schema("node bigint, a bigint, for int").parquet(rounds.path(f"uses/of={now}"))
                onward = skew_join(uses, done, ["node"], ["a"])
                onward.select(F.col("a").alias("node"), "block", "bits", "for").write.partitionBy("for").parquet(
                    rounds.path(f"sent/from={now}")
                )
            rounds.drop(f"sent/from=*/for={now}")
        every = [rounds.path(f"done/level={k}") for k in range(0 if top is None else top + 1)]
        bits = spark.read.schema(schema).parquet(*every) if every else spark.createDataFrame([], schema)
        return placed, bits.withColumnRenamed("node", "label"), links


def impact_counts(edges: DataFrame, reverse: bool = False) -> DataFrame:
    """For every file of the graph: how many files it depends on, ``direct`` and in all (or, reversed, that depend on it)."""
    placed, bits, links = _reach_bits(edges, reverse)
    reached = bits.groupBy("label").agg(F.sum(F.bit_count("bits")).alias("files"))
    direct = links.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("direct"))
    return (
        placed.join(by_merge(reached), "label")
        .join(by_merge(direct), "id", "left")
        .select(*TREE, F.col("node").alias("path"), F.coalesce("direct", F.lit(0)).alias("direct"), (F.col("files") - 1).alias("files"))
    )


def impact_pairs(edges: DataFrame, reverse: bool = False) -> DataFrame:
    """``repo, snapshot, root, node`` for all files: what each depends on (or, reversed, what depends on it), itself left out.

    A row of bits becomes rows of its own only at the end, by a list of the 64
    files it stands for, so no round and no shuffle carries the pairs.
    """
    placed, bits, _ = _reach_bits(edges, reverse)
    n = F.col("n") - 1
    listed = (
        placed.groupBy(*TREE, F.floor(n / 64).cast("int").alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct((n % 64).cast("int").alias("at"), "node"))).alias("files"))
    )
    roots = placed.select(*TREE, F.col("node").alias("root"), "label")
    marked = skew_join(roots, bits, ["label"], ["root"])
    held = salted_join(marked, listed, [*TREE, "block"], ["root"], grows=True)
    there = F.filter("files", lambda f: F.getbit("bits", f["at"]) == 1)
    return held.select(*TREE, "root", F.explode(there["node"]).alias("node")).where("root <> node")


def impact_in_order(edges: DataFrame, roots: DataFrame, reverse: bool = False) -> DataFrame:
    """``impact`` with the place ``pos`` of each node in a breadth-first walk.

    A walk that visits neighbours in path order lists the nodes of a level by
    their smallest shortest route, so the route is the sort key.  Routes are as
    long as the distance: meant for chosen roots.
    """
    spark = edges.sparkSession
    graph = reversed_edges(edges) if reverse else edges
    with loop_settings(spark):
        step = cut(graph.select(*TREE, F.col("src").alias("node"), F.col("dst").alias("_next")).distinct(), "edges")
        key = [*TREE, "root", "node"]
        frontier = cut(
            roots.select(
                *TREE,
                F.col("path").alias("root"),
                F.col("path").alias("node"),
                F.array().cast("array<string>").alias("route"),
            ).distinct(),
            "roots",
        )
        rounds = Rounds(spark, "routes")
        rounds.add(frontier)
        like = frontier
        while not is_empty(frontier):
            found = (
                frontier.join(step, [*TREE, "node"])
                .groupBy(*TREE, "root", F.col("_next").alias("node"))
                .agg(F.min(F.concat("route", F.array("_next"))).alias("route"))
                .join(rounds.all(like).select(*key), key, "left_anti")
            )
            frontier = rounds.add(found.select(*like.columns))
        reached = rounds.all(like).where(F.col("node") != F.col("root"))
    dist = F.size("route")
    ranked = numbered(
        reached.withColumn("dist", dist), [*TREE, "root"], [F.col("dist"), F.col("route")], "pos"
    )
    return ranked.select(*key, "dist", (F.col("dist") == 1).alias("direct"), "pos")


# ---------------------------------------------------------------- strong components


def without_declarations(edges: DataFrame) -> DataFrame:
    """Edges for cycle search: module declarations alone make no cycle."""
    if "decl_only" not in edges.columns:
        return edges.select(*EDGE)
    return edges.where(~F.col("decl_only")).select(*EDGE)


def _ends(links: DataFrame) -> DataFrame:
    """``node, to, ahead``: every link from both its ends."""
    return links.select(
        F.inline(
            F.array(
                F.struct(F.col("a").alias("node"), F.col("b").alias("to"), F.lit(True).alias("ahead")),
                F.struct(F.col("b").alias("node"), F.col("a").alias("to"), F.lit(False).alias("ahead")),
            )
        )
    )


def _spread_min(links: DataFrame, trees: DataFrame) -> DataFrame:
    """Per node: ``f``, the smallest number that reaches it, and ``b``, the smallest it reaches.

    A few hops per written round; only nodes whose numbers changed send again.
    In the hops of the first round all send, and nodes to which nothing comes
    from one side are on no cycle and go; what they sent before stays with
    those it reached.
    """
    spark = links.sparkSession
    ends = _ends(links)
    nodes = cut(
        ends.groupBy("node").agg(F.bool_or("ahead").alias("out"), F.bool_or(~F.col("ahead")).alias("in")).where("out and in").select("node"),
        "inner-nodes",
    )
    # Ahead, back, or (null) to the node itself, by which its own numbers stay.
    both = cut(ends.unionByName(nodes.select("node", F.col("node").alias("to"), F.lit(None).cast("boolean").alias("ahead"))), "both")
    own, ahead = F.col("ahead").isNull(), F.col("ahead")
    state = nodes.select(
        "node", F.col("node").alias("f"), F.col("node").alias("b"), F.lit(True).alias("moved")
    )
    labels_, settled = Newest(spark, "labels"), _Settled(spark, "settled-labels")
    first = True
    while True:
        tree = [] if first else ["tree"]
        for _ in range(HOPS):
            state = (
                state.join(by_merge(both), "node")
                .where(F.lit(True) if first else own | F.col("moved"))
                .select(
                    F.col("to").alias("node"),
                    *tree,
                    F.when(own | ahead, F.col("f")).alias("f"),
                    F.when(own | ~ahead, F.col("b")).alias("b"),
                    F.when(own, F.col("f")).alias("f0"),
                    F.when(own, F.col("b")).alias("b0"),
                    *([ahead.alias("ahead")] if first else []),
                )
                .groupBy("node")
                .agg(
                    *[F.min(c).alias(c) for c in (*tree, "f", "b", "f0", "b0")],
                    *([F.bool_or("ahead").alias("in"), F.bool_or(~ahead).alias("out")] if first else []),
                )
                # Nodes that went have no row of their own.
                .where("f0 is not null and in and out" if first else "f0 is not null")
                .select(
                    "node",
                    *tree,
                    "f",
                    "b",
                    ((F.col("f") < F.col("f0")) | (F.col("b") < F.col("b0"))).alias("moved"),
                )
            )
        whole = labels_.set(state)
        if first:
            whole = cut(whole.join(by_merge(trees), "node"), "treed")
            first = False
        state = settled.going(whole)
        if state is None:
            return settled.all(whole).drop("moved", "tree")


def _contracted(links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bypass chains: nodes with one link in and one link out.

    Returns the shorter links (some may come twice), without those of nodes that
    lead nowhere, ``inner`` (each bypassed node with the two ends of its chain)
    and ``rings`` (nodes of chains that close on themselves, with their smallest
    number).  Pointers double each round, so a chain of n nodes
    takes about log2 n rounds.
    """
    ends = links.select(
        F.inline(
            F.array(
                F.struct(F.col("a").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("b").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        )
    )
    # Nodes with no link in or no link out are on no cycle.
    gone = cut(
        ends.groupBy("node")
        .agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
        .select("node", ((F.col("o") == 1) & (F.col("i") == 1)).alias("single"), ((F.col("o") == 0) | (F.col("i") == 0)).alias("dead"))
        .where("single or dead"),
        "gone",
    )
    single = gone.where("single").select("node")
    after = links.join(by_merge(single.withColumnRenamed("node", "a")), "a", "left_semi").select(
        F.col("a").alias("node"), F.col("b").alias("next")
    )
    before = links.join(by_merge(single.withColumnRenamed("node", "b")), "b", "left_semi").select(
        F.col("b").alias("node"), F.col("a").alias("prev")
    )
    chains = Newest(links.sparkSession, "chains")
    state = chains.set(
        after.join(by_merge(before), "node").withColumns(
            {
                "low": F.least("node", "next"),
                "active": F.lit(True),
                "lower": F.lit(True),
            }
        )
    )
    active = None
    while True:
        hop_on = state.select(
            F.col("node").alias("next"), F.col("next").alias("_n2"), F.col("low").alias("_l2")
        )
        hop_back = state.select(F.col("node").alias("prev"), F.col("prev").alias("_p2"))
        state = chains.set(
            state.join(by_merge(hop_on), "next", "left")
            .join(by_merge(hop_back), "prev", "left")
            .select(
                "node",
                F.coalesce("_n2", "next").alias("next"),
                F.coalesce("_p2", "prev").alias("prev"),
                F.least("low", F.coalesce("_l2", "low")).alias("low"),
                F.col("_n2").isNotNull().alias("active"),
                F.coalesce(F.col("_l2") < F.col("low"), F.lit(False)).alias("lower"),
            )
        )
        # An open chain has fewer active nodes every round; a ring keeps all of
        # its nodes active, and is settled once no number gets smaller.
        counts = state.agg(F.count_if("active").alias("a"), F.count_if("lower").alias("l")).first()
        if counts["a"] == 0 or (counts["a"] == active and counts["l"] == 0):
            break
        active = counts["a"]
    on_single = by_merge(single.withColumnRenamed("node", "next"))
    rings = state.join(on_single, "next", "left_semi").select("node", F.col("low").alias("label"))
    open_ = state.join(on_single, "next", "left_anti")
    inner = cut(open_.select("node", F.col("prev").alias("head"), F.col("next").alias("tail")), "inner")
    kept = links.join(by_merge(gone.select(F.col("node").alias("a"))), "a", "left_anti").join(
        by_merge(gone.select(F.col("node").alias("b"))), "b", "left_anti"
    )
    bypass = inner.select(F.col("head").alias("a"), F.col("tail").alias("b")).distinct()
    shorter = kept.select("a", "b").unionByName(bypass)
    return cut(shorter, "shorter"), inner, cut(rings, "rings")


def _core_components(links: DataFrame, trees: DataFrame) -> DataFrame:
    """``node, label`` of every node of a component of two or more, by colouring.

    Each node learns the smallest number that reaches it and the smallest it
    reaches.  Where the two are one, that node's component is found.  Members
    of a component always agree in both, so links between nodes that differ can
    go, and the rest goes round again, all components at once.
    """
    done, core = Rounds(links.sparkSession, "components"), Newest(links.sparkSession, "core")
    left, like = links, None
    while like is None or not is_empty(left):
        state = _spread_min(left, trees)
        like = done.add(state.where(F.col("f") == F.col("b")).select("node", F.col("f").alias("label")))
        rest = state.where(F.col("f") != F.col("b"))
        source = rest.select(F.col("node").alias("a"), F.col("f").alias("_f"), F.col("b").alias("_b"))
        target = rest.select(F.col("node").alias("b"), F.col("f").alias("_f"), F.col("b").alias("_b"))
        left = core.set(left.join(by_merge(source), "a").join(by_merge(target), ["b", "_f", "_b"]).select("a", "b"))
    found = done.all(like)
    # A node alone under its own number is on no cycle.
    several = found.groupBy("label").count().where(F.col("count") > 1).select("label")
    return cut(found.join(by_merge(several), "label", "left_semi").select("node", "label"), "found")


def _members(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbered nodes and links of a graph without loops, and ``node, label`` of every node on some cycle."""
    nodes, links = _coded(edges)
    shorter, inner, rings = _contracted(links)
    # A chain from a node back to itself is a ring through that node.
    loops = shorter.where(F.col("a") == F.col("b")).select(F.col("a").alias("node")).distinct()
    trees = nodes.select(F.col("id").alias("node"), _tree())
    core = _core_components(shorter.where(F.col("a") != F.col("b")), trees)
    alone = loops.join(by_merge(core.select("node")), "node", "left_anti")
    groups = cut(core.unionByName(alone.select("node", F.col("node").alias("label"))), "groups")
    by_head = groups.select(F.col("node").alias("head"), "label")
    by_tail = groups.select(F.col("node").alias("tail"), F.col("label").alias("_tail_label"))
    on_chain = (
        inner.join(by_merge(by_head), "head")
        .join(by_merge(by_tail), "tail")
        .where(F.col("label") == F.col("_tail_label"))
        .select("node", "label")
    )
    return nodes, links, groups.unionByName(on_chain).unionByName(rings).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``repo, snapshot, node, component`` for every file on some cycle.

    ``component`` is the smallest path among the files that can reach each
    other.  Chains are bypassed first, so one long ring or a long tail costs
    log2 of its length in rounds.
    """
    with loop_settings(edges.sparkSession):
        nodes, _, members = _members(without_declarations(edges).where(F.col("src") != F.col("dst")))
        named = cut(members.withColumnRenamed("node", "id").join(by_merge(nodes), "id").drop("id"), "members")
        names = named.groupBy("label").agg(F.min("node").alias("component"))
        return skew_join(named, names, ["label"], ["node"]).select(*TREE, "node", "component")


def cycle_sizes(components_: DataFrame) -> DataFrame:
    return components_.groupBy(*TREE, "component").agg(F.count("*").alias("members"))


def witness_cycles(edges: DataFrame, components_: DataFrame) -> DataFrame:
    """One shortest cycle through the smallest file of each component.

    Rows ``component, pos, path``; the last row is the first file again.  Every
    file's next one on its shortest way to the root is known from distances.
    The way from the root is then laid out by doubling: pointers over 1, 2, 4,
    ... files, and from the longest to the shortest every place known gives the
    one that far behind it.
    """
    spark = edges.sparkSession
    graph = without_declarations(edges)
    with loop_settings(spark):
        member = components_.select(*TREE, F.col("node").alias("src"), "component")
        other = components_.select(*TREE, F.col("node").alias("dst"), F.col("component").alias("_c"))
        inside = cut(
            graph.join(by_merge(member), [*TREE, "src"])
            .join(by_merge(other), [*TREE, "dst"])
            .where((F.col("component") == F.col("_c")) & (F.col("src") != F.col("dst")))
            .select(*EDGE, "component"),
            "inside",
        )
        roots = components_.where(F.col("node") == F.col("component"))
        # Distance to the root, walking edges backwards from it; the root's own is the cycle's length.
        seeds = roots.select(*TREE, "node")
        dist = cut(reachable(reversed_edges(inside), seeds), "dist")
        home = dist.select(*TREE, F.col("node").alias("src"), F.col("dist").alias("_from"))
        to = dist.select(*TREE, F.col("node").alias("dst"), "dist")
        # The root itself is at distance 0 when it closes the cycle.
        left = F.when(F.col("dst") == F.col("component"), 0).otherwise(F.col("dist"))
        onward = (
            inside.join(by_merge(home), [*TREE, "src"])
            .join(by_merge(to), [*TREE, "dst"])
            .where(left == F.col("_from") - 1)
            .groupBy(*TREE, "component", "src")
            .agg(F.min("dst").alias("next"))
        )
        pointers = [cut(onward.select(*TREE, "src", "next"), "next")]
        lengths = roots.join(by_merge(dist), [*TREE, "node"]).select(*TREE, "component", F.col("dist").alias("length"))
        longest = lengths.agg(F.max("length")).first()[0] or 0
        while 1 << len(pointers) < longest:
            hop = pointers[-1].select(*TREE, F.col("src").alias("next"), F.col("next").alias("_far"))
            pointers.append(cut(pointers[-1].join(by_merge(hop), [*TREE, "next"]).select(*TREE, "src", F.col("_far").alias("next")), "next"))
        at = cut(lengths.select(*TREE, "component", "length", F.lit(0).alias("pos"), F.col("component").alias("path")), "at")
        for k in reversed(range(len(pointers))):
            hop = pointers[k].select(*TREE, F.col("src").alias("path"), "next")
            further = at.join(by_merge(hop), [*TREE, "path"]).withColumn("pos", F.col("pos") + (1 << k)).where("pos < length")
            at = cut(at.unionByName(further.select(*TREE, "component", "length", "pos", F.col("next").alias("path"))), "at")
        closing = lengths.select(*TREE, "component", F.col("length").alias("pos"), F.col("component").alias("path"))
        return at.drop("length").unionByName(closing).select(*TREE, "component", "pos", "path")


# ---------------------------------------------------------------- reports on files


def cycles_of(components_: DataFrame, requested: DataFrame) -> DataFrame:
    """Members of the components that hold a requested file."""
    held = requested.select(*TREE, F.col("path").alias("node")).join(
        by_merge(components_), [*TREE, "node"]
    ).select(*TREE, F.col("node").alias("focus"), "component")
    return salted_join(components_, held, [*TREE, "component"], ["node"], grows=True).select(
        *TREE, "focus", "component", F.col("node").alias("path")
    )


def externals_of(externals: DataFrame, requested: DataFrame) -> DataFrame:
    return externals.join(
        requested.select(*TREE, F.col("path").alias("src")).distinct(), [*TREE, "src"], "left_semi"
    )


def reading_order(entries: DataFrame, edges: DataFrame, top: int = 5, limit: int = 8) -> DataFrame:
    """Files to read first: entry points by path, then the most depended on.

    ``(top, limit)`` is ``(3, 5)`` for a text summary.
    """
    first = first_n(entries.select(*TREE, "path").distinct(), TREE, [F.col("path")], limit, "_n").select(
        *TREE, "path", F.lit(0).alias("_group"), "_n"
    )
    used = most_depended(edges, top).select(
        *TREE, "path", F.lit(1).alias("_group"), F.col("rank").alias("_n")
    )
    # The top files have to be known not to be entries, also those past the limit.
    fresh = used.join(by_merge(entries.select(*TREE, "path")), [*TREE, "path"], "left_anti")
    both = first.unionByName(fresh)
    return first_n(both, TREE, [F.col("_group"), F.col("_n")], limit).select(*TREE, "rank", "path")


# Manifests that make a directory a project, by language of the file.
NEAREST = {
    "js": (
        [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"],
        ["tsconfig.json", "jsconfig.json", "package.json"],
    ),
    "go": ([".go"], ["go.mod"]),
}


def manifest_hints(requested: DataFrame, files: DataFrame) -> DataFrame:
    """The closest directory above a file, below the root, with its own manifest.

    Aliases and modules are resolved from the scanned root; a hint says where a
    nested project begins.
    """
    ext = paths.ext(paths.basename(F.lower("path")))
    lang, rank = F.lit(None), F.lit(None)
    for name, (exts, manifests) in NEAREST.items():
        lang = F.when(ext.isin(exts), F.lit(name)).otherwise(lang)
        for i, manifest in enumerate(manifests):
            rank = F.when(
                F.col("name") == manifest,
                F.struct(F.lit(name).alias("lang"), F.lit(i).alias("rank")),
            ).otherwise(rank)
    asked = requested.select(
        *TREE, "path", lang.alias("lang"), F.explode(paths.ancestors(F.col("path"))).alias("dir")
    ).where(F.col("lang").isNotNull() & (F.col("dir") != ""))
    held = (
        files.where((F.col("kind") == "file"))
        .select(*TREE, F.col("parent").alias("dir"), F.col("name").alias("manifest"), rank.alias("_r"))
        .where(F.col("_r").isNotNull())
        .select(*TREE, "dir", "manifest", "_r.lang", "_r.rank")
    )
    found = salted_join(asked, held, [*TREE, "lang", "dir"], ["path"])
    nearest = F.struct(paths.depth(F.col("dir")).alias("d"), (-F.col("rank")).alias("r"))
    return (
        found.groupBy(*TREE, "path")
        .agg(F.max_by(F.struct("dir", "manifest"), nearest).alias("_m"))
        .select(*TREE, "path", "_m.dir", "_m.manifest")
    )


def suggestions(requested: DataFrame, edges: DataFrame, n: int = 3) -> DataFrame:
    """For paths not in the graph: up to ``n`` graph files of the same name, sorted."""
    nodes = (
        edges.select(*TREE, F.col("src").alias("path"))
        .unionByName(edges.select(*TREE, F.col("dst").alias("path")))
        .distinct()
    )
    asked = requested.select(*TREE, "path").join(nodes, [*TREE, "path"], "left_anti")
    named = asked.select(
        *TREE, F.col("path").alias("given"), paths.basename(F.col("path")).alias("_name")
    )
    # Per name the first n are enough, whatever the number of files of that name.
    first = first_n(
        nodes.where(F.contains("path", F.lit("/"))).withColumn("_name", paths.basename(F.col("path"))),
        [*TREE, "_name"],
        [F.col("path")],
        n,
    )
    return named.join(first, [*TREE, "_name"]).select(*TREE, "given", "rank", "path")


def node_numbers(edges: DataFrame) -> DataFrame:
    """Number of each file by first mention, sources and their targets in path order."""
    mentions = edges.select(
        *TREE,
        F.explode(
            F.array(
                F.struct(F.col("src").alias("path"), F.col("src").alias("a"), F.lit("").alias("b")),
                F.struct(F.col("dst").alias("path"), F.col("src").alias("a"), F.col("dst").alias("b")),
            )
        ).alias("_m"),
    )
    first = mentions.groupBy(*TREE, F.col("_m.path").alias("path")).agg(
        F.min(F.struct("_m.a", "_m.b")).alias("_first")
    )
    return numbered(first, TREE, [F.col("_first.a"), F.col("_first.b")], "n").select(
        *TREE, "path", (F.col("n") - 1).alias("n")
    )


def degree_of(edges: DataFrame, column: str, name: str) -> DataFrame:
    """Edges per file at one end (``src`` or ``dst``)."""
    return edges.groupBy(*TREE, F.col(column).alias("path")).agg(F.count("*").alias(name))
