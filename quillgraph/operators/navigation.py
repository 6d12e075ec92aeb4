"""Walks over the graph: resolution, impact, trace, context, inheritors,
connections and caller chains.

Traversals go level by level.  Each level's edges are written once, so every
plan stays as small as its first level, sizes are exact for the next join, and a
lost executor costs one level.  A frontier of up to ``FEW`` ids becomes a filter,
which on a stored revision reads only the row groups that hold them; a larger
one is joined (Spark sends it to every task or shuffles, by its size).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.functions import text as X
from quillgraph.functions.ranking import top
from quillgraph.functions.storage import dealt, written
from quillgraph.graph import Graph


#: Ids up to which a frontier is a pushed-down filter.
FEW = 1_000


def touching(edges: DataFrame, end: str, ids: DataFrame) -> DataFrame:
    """The edges with an end among the ids."""
    few = _few(ids)
    return edges.join(ids.select(F.col("id").alias(end)), end, "left_semi") if few is None else edges.filter(F.col(end).isin(few))


def _few(ids: DataFrame) -> list[int] | None:
    """The ids if they are few, else None."""
    found = [r["id"] for r in ids.select("id").limit(FEW + 1).collect()]
    return found if len(found) <= FEW else None


def of_types(edges: DataFrame, types) -> DataFrame:
    return edges.filter(F.col("edge_type").isin(*types))


def ordinal(edge_type: Column) -> Column:
    out = F.lit(len(schemas.EDGE_TYPES))
    for name, i in schemas.EDGE_ORDINAL.items():
        out = F.when(edge_type == name, i).otherwise(out)
    return out


def resolve(graph: Graph, identifiers: DataFrame) -> DataFrame:
    """(identifier) -> (identifier, id): a number is an id if there is such a
    node; else the least id whose canonical id or qualified name is equal; else
    the least whose qualified name is equal when A-Z is folded.  None: id null.
    """
    code = graph.code().select("id", "canonical_id", "fully_qualified_name")
    asked = identifiers.select("identifier").distinct()
    wanted = asked.select(F.explode(F.array("identifier", X.ascii_fold(F.col("identifier")))).alias("key")).distinct()
    if identifiers.limit(FEW + 1).count() <= FEW:
        # few names: nodes that bear none of them go before they are spread
        names = [r["key"] for r in wanted.filter("key is not null").collect()]
        numbers = [int(n) for n in names if n.isascii() and n.isdigit() and len(n) < 19]
        some = F.col("canonical_id").isin(names) | F.col("fully_qualified_name").isin(names) | X.ascii_fold(F.col("fully_qualified_name")).isin(names)
        code = code.filter(some | F.col("id").isin(numbers) if numbers else some)
    keys = code.select("id", F.explode(F.array(
        F.struct(F.lit(0).alias("priority"), F.col("id").cast("string").alias("key")),
        F.struct(F.lit(1).alias("priority"), F.col("canonical_id").alias("key")),
        F.struct(F.lit(1).alias("priority"), F.col("fully_qualified_name").alias("key")),
        F.struct(F.lit(2).alias("priority"), X.ascii_fold(F.col("fully_qualified_name")).alias("key")),
    )).alias("k")).select("id", "k.*")
    number = F.when(F.col("identifier").rlike("^[0-9]+$"), F.expr("try_cast(identifier AS bigint)").cast("string"))
    tries = asked.select("identifier", F.explode(F.array(
        F.struct(F.lit(0).alias("priority"), number.alias("key")),
        F.struct(F.lit(1).alias("priority"), F.col("identifier").alias("key")),
        F.struct(F.lit(2).alias("priority"), X.ascii_fold(F.col("identifier")).alias("key")),
    )).alias("k")).select("identifier", "k.*").filter("key is not null")
    best = tries.join(keys, ["priority", "key"]).groupBy("identifier").agg(F.min(F.struct("priority", "id")).alias("best"))
    return asked.join(best, "identifier", "left").select("identifier", F.col("best.id").alias("id"))


@dataclass
class Walk:
    nodes: DataFrame
    edges: DataFrame
    truncated: bool = False


def _levels(edges: DataFrame, roots: DataFrame, depth: int, inward: bool) -> tuple[list[DataFrame], DataFrame]:
    """The edges met at each level, and (id, depth) of all nodes they lead to.
    Edges back to visited nodes are kept, but such nodes are not expanded."""
    near, far = ("callee", "caller") if inward else ("caller", "callee")
    frontier = visited = roots.select("id").distinct()
    met: list[DataFrame] = []
    for level in range(1, depth + 1):
        step = written(touching(edges, near, frontier).withColumn("depth", F.lit(level)), "walk")
        met.append(step)
        reached = step.select(F.col(far).alias("id")).distinct()
        if level < depth:
            frontier = reached.join(visited, "id", "left_anti")
            few = _few(frontier)
            if few == []:
                break
            frontier = written(frontier, "frontier") if few is None else frontier.sparkSession.createDataFrame([(i,) for i in few], "id bigint")
            visited = visited.unionByName(frontier)
    reached = met[0].select(F.col(far).alias("id"), "depth")
    for step in met[1:]:
        reached = reached.unionByName(step.select(F.col(far).alias("id"), "depth"))
    return met, reached.groupBy("id").agg(F.min("depth").cast("long").alias("depth"))


def impact(graph: Graph, roots: DataFrame, max_depth: int = 3, transitive: bool = True, edge_types=None) -> Walk:
    """Everything that depends on the roots.  Nodes are the distinct callers met
    (so a cycle brings the root itself in); callers that are no code nodes are
    not returned, but their edges are."""
    edges = of_types(graph.edges_in, edge_types or schemas.FUNCTIONAL)
    met, reached = _levels(edges, roots, max(1, max_depth) if transitive else 1, inward=True)
    kept = met[0]
    for step in met[1:]:
        kept = kept.unionByName(step)
    few = _few(reached)
    return Walk(graph.code(only=few).join(reached, "id"), kept.drop("depth").distinct())


def ordered_edges(graph: Graph, edges: DataFrame) -> DataFrame:
    """Edges with canonical ids, by caller, callee and the ordinal of the type."""
    ids = graph["graph_nodes"]
    a = ids.select(F.col("id").alias("caller"), F.col("canonical_id").alias("caller_canonical_id"))
    b = ids.select(F.col("id").alias("callee"), F.col("canonical_id").alias("callee_canonical_id"))
    out = edges.join(a, "caller").join(b, "callee")
    out = out.select("caller", "callee", "caller_canonical_id", "callee_canonical_id", "edge_type", ordinal(F.col("edge_type")).cast("long").alias("edge_ordinal"), "metadata")
    return out.orderBy("caller_canonical_id", "callee_canonical_id", "edge_ordinal")


def callees(graph: Graph, roots: DataFrame, edge_types=None) -> DataFrame:
    """Distinct code nodes one step out."""
    out = touching(of_types(graph.edges, edge_types or schemas.FUNCTIONAL), "caller", roots).select(F.col("callee").alias("id"))
    return graph.code(only=_few(out.distinct())).join(out, "id", "left_semi")


def edges_among(graph: Graph, nodes: DataFrame, edge_types=None) -> DataFrame:
    """Edges whose both ends are among the nodes.  Unless these are few, they may be most
    of the graph, so edges and ids are dealt out by id, and no task holds all ids."""
    edges = of_types(graph.edges, edge_types or schemas.FUNCTIONAL)
    few = _few(nodes)
    if few is not None:
        return edges.filter(F.col("caller").isin(few) & F.col("callee").isin(few))
    ids = dealt(nodes.select("id"), "id").distinct()
    for end in ("caller", "callee"):
        edges = dealt(edges, end).join(ids.withColumnRenamed("id", end).hint("merge"), end, "left_semi")
    return edges


def trace(graph: Graph, root_id: int, direction: str = "callee", max_depth: int = 3, budget: int = 1000, edge_types=None) -> Walk:
    """The trace graph of one node.  Callees are taken level by level in the
    order of their first parent, then name, then id, while the budget (root
    included) lasts; ``truncated`` says that some did not fit."""
    if root_id <= 0 or not 1 <= max_depth <= 10 or direction not in ("caller", "callee"):
        raise ValueError("node id must be positive, depth 1 to 10, direction caller or callee")
    root = graph.spark.createDataFrame([(root_id,)], "id bigint")
    if direction == "caller":
        found = impact(graph, root, max_depth, edge_types=edge_types)
        nodes = found.nodes.select("id", F.lit(None).cast("long").alias("ord"), "depth")
        return Walk(nodes, found.edges)
    edges = of_types(graph.edges, edge_types or schemas.FUNCTIONAL).select("caller", "callee")
    names = graph.code().select(F.col("id").alias("callee"), "fully_qualified_name")
    kept = root.select("id", F.lit(0).cast("long").alias("ord"), F.lit(0).cast("long").alias("depth"))
    level, used, truncated = kept, 1, False
    for depth in range(1, max_depth + 1):
        step = touching(edges, "caller", level).join(level.select(F.col("id").alias("caller"), "ord"), "caller").groupBy("callee").agg(F.min("ord").alias("parent"))
        fresh = step.join(kept.select(F.col("id").alias("callee")), "callee", "left_anti").join(names, "callee")
        left = budget - used
        first = written(top(fresh, ["parent", "fully_qualified_name", "callee"], left + 1, "place"), "trace")
        n = first.count()
        truncated |= n > left
        level = first.filter(F.col("place") <= left).select(F.col("callee").alias("id"), (F.col("place") + used - 1).alias("ord"), F.lit(depth).cast("long").alias("depth"))
        kept, used = kept.unionByName(level), used + min(n, left)
        if n == 0 or left <= 0:
            break
    return Walk(kept, edges_among(graph, kept, edge_types), truncated)


def inheritors(graph: Graph, roots: DataFrame) -> DataFrame:
    """Classes that implement the roots directly."""
    up = touching(graph.edges_in.filter("edge_type = 'Implements'"), "callee", roots)
    return graph.code().filter("node_type = 'Class'").join(up.select(F.col("caller").alias("id")), "id", "left_semi")


RELATIONS = ("callers", "callees", "implementers", "inherits", "parents", "children")


def context(graph: Graph, node_id: int, limit: int = 10) -> DataFrame:
    """The six bounded lists around a node: (relation, ord, id, name).  The four
    code lists are ordered by qualified name, the structural two by trimmed name
    and may hold projects."""
    if node_id <= 0:
        raise ValueError("node id must be positive")
    limit = min(max(limit, 1), 50)
    kind = F.when(F.col("edge_type") == "Implements", "implements").when(F.col("edge_type") == "ParentOf", "parent").otherwise("call")
    into = graph.edges_in.filter(F.col("callee") == node_id).select(F.col("caller").alias("id"), kind.alias("kind"), F.lit("in").alias("way"))
    out = graph.edges.filter(F.col("caller") == node_id).select(F.col("callee").alias("id"), kind.alias("kind"), F.lit("out").alias("way"))
    names = {("call", "in"): "callers", ("call", "out"): "callees", ("implements", "in"): "implementers", ("implements", "out"): "inherits", ("parent", "in"): "parents", ("parent", "out"): "children"}
    relation = F.lit(None).cast("string")
    for (k, w), name in names.items():
        relation = F.when((F.col("kind") == k) & (F.col("way") == w), name).otherwise(relation)
    peers = into.unionByName(out).select("id", relation.alias("relation")).distinct()
    code = graph["code_nodes"].select("id", F.col("fully_qualified_name").alias("name"), F.col("node_type").alias("type"))
    both = code.unionByName(graph["project_nodes"].select("id", "name", F.lit("Project").alias("type")))
    met = peers.join(both, "id")
    structural = F.col("relation").isin("parents", "children")
    met = met.filter(structural | (F.col("type") != "Project"))
    shown = F.when(structural, X.trimmed_name(F.col("name"), F.col("type"))).otherwise(F.col("name"))
    w = Window.partitionBy("relation").orderBy("shown", "id")
    ranked = met.withColumn("shown", shown).withColumn("ord", F.row_number().over(w)).filter(F.col("ord") <= limit)
    return ranked.select("relation", F.col("ord").cast("long").alias("ord"), "id", F.col("shown").alias("name"), F.lower("type").alias("type"))


def _peers(graph: Graph, node_id: int, after: int = 0) -> DataFrame:
    """(peer, edge_type, direction, metadata) of every edge at the node."""
    self_edge = F.col("caller") == F.col("callee")
    out = graph.edges.filter(F.col("caller") == node_id).select(F.col("callee").alias("peer"), "edge_type", F.when(self_edge, "self").otherwise("outgoing").alias("direction"), "metadata")
    into = graph.edges_in.filter((F.col("callee") == node_id) & (F.col("caller") != node_id)).select(F.col("caller").alias("peer"), "edge_type", F.lit("incoming").alias("direction"), "metadata")
    return out.unionByName(into).filter(F.col("peer") > after)


def connections(graph: Graph, node_id: int, page_size: int = 100, after: int = 0, more: int = 0) -> DataFrame:
    """One page of peers by id, each with all edges to and from the node:
    (peer, label, type, relationships array<struct<type, direction, metadata>>),
    and so many ``more`` peers, which tell whether another page follows.
    """
    if not 1 <= page_size <= 500:
        raise ValueError("page size must be 1 to 500")
    both = _peers(graph, node_id, after)
    page = [r["peer"] for r in both.select("peer").distinct().orderBy("peer").limit(page_size + more).collect()]
    rel = F.struct(X.edge_label(F.col("edge_type")).alias("type"), "direction", "metadata")
    grouped = both.filter(F.col("peer").isin(page)).groupBy("peer").agg(F.sort_array(F.collect_list(rel)).alias("relationships"))
    shown = graph.display(only=page).select(F.col("id").alias("peer"), "label", "type")
    return shown.join(F.broadcast(grouped), "peer").select("peer", "label", "type", "relationships")


def connection_total(graph: Graph, node_id: int) -> int:
    """The number of peers."""
    return _peers(graph, node_id).select("peer").distinct().count()


def highlight(graph: Graph, node_id: int) -> DataFrame:
    """What a view lights up for a selected node: (id, role), where role is
    selected, incoming, outgoing or both; a self edge adds nothing."""
    ways = _peers(graph, node_id).filter("direction <> 'self'").groupBy(F.col("peer").alias("id")).agg(F.min("direction").alias("a"), F.max("direction").alias("b"))
    peers = ways.select("id", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("both").alias("role"))
    return graph.spark.createDataFrame([(node_id, "selected")], "id bigint, role string").unionByName(peers)


def chains(walk_edges: DataFrame, root_id: int, max_depth: int, limit: int | None = None) -> DataFrame:
    """All simple paths from the root up through the given edges, as arrays of
    ids from the root outwards; a path ends where no new caller follows.  Their
    number may grow as the power of a node's callers to the depth; with ``limit``
    a walk that would hold more open paths raises instead."""
    up = walk_edges.select("caller", "callee").distinct()
    spark = walk_edges.sparkSession
    paths = spark.createDataFrame([([root_id],)], "path array<bigint>")
    done: DataFrame | None = None
    for level in range(max_depth):
        ends = paths.withColumn("callee", F.element_at("path", -1))
        grown = ends.join(up, "callee").filter(~F.array_contains("path", F.col("caller"))).select(F.concat("path", F.array("caller")).alias("path"))
        grown = written(grown, "chains")
        if limit is not None and grown.count() > limit:
            raise ValueError(f"more than {limit} chains at depth {level + 1}; lower the depth or raise the limit")
        prefix = grown.select(F.expr("slice(path, 1, size(path) - 1)").alias("path")).distinct()
        ended = paths.join(prefix, "path", "left_anti")
        done = ended if done is None else done.unionByName(ended)
        paths = grown
    return done.unionByName(paths) if done is not None else paths


def chains_page(walk_edges: DataFrame, root_id: int, max_depth: int, size: int = 100, after: list[int] | None = None) -> DataFrame:
    """The ``size`` chains that come next after the chain ``after`` in the order of
    their arrays of ids; those that ``chains`` gives.

    Every open path leads to one chain at least, and paths of one length stand in
    the order of the chains they lead to.  So of each length the first ``size``
    that do not come before the cursor are enough, and one that leads up to it:
    no more than that times a node's callers is ever made, however many chains
    there are."""
    up = walk_edges.select("caller", "callee").distinct()
    spark = walk_edges.sparkSession
    cursor = after or []
    paths = spark.createDataFrame([([root_id],)], "path array<bigint>")
    done = paths.limit(0)
    for level in range(1, max_depth + 1):
        ends = paths.withColumn("callee", F.element_at("path", -1))
        near = up.join(F.broadcast(ends.select("callee").distinct()), "callee", "left_semi")
        grown = ends.join(near, "callee", "left").withColumn("_on", F.col("caller").isNotNull() & ~F.array_contains("path", F.coalesce("caller", F.lit(root_id))))
        ended = grown.groupBy("path").agg(F.bool_or("_on").alias("_on")).filter("not _on").select("path")
        further = grown.filter("_on").select(F.concat("path", F.array("caller")).alias("path"))
        from_here = F.lit(True) if not cursor else F.col("path") >= F.array(*[F.lit(i).cast("bigint") for i in cursor[: level + 1]])
        paths = written(further.filter(from_here).orderBy("path").limit(size + 1), "chain-page")
        done = written(done.unionByName(ended), "chain-ends")
        if paths.isEmpty():
            break
    every = done.unionByName(paths)
    beyond = every if not cursor else every.filter(F.col("path") > F.array(*[F.lit(i).cast("bigint") for i in cursor]))
    return beyond.orderBy("path").limit(size)
