"""Edges from facts, calls to their declarations, client views, and reuse of
earlier contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.graph import Graph
from quillgraph.operators.extraction import body_hash

# The edge type that each kind of fact stands for.
FACT_EDGES = {"project": "ProjectReference", "contains": "ParentOf", "implements": "Implements", "inherits": "Implements", "calls": "MethodCall", "reads": "FieldAccess", "writes": "FieldAccess", "registers": "ServiceRegistration", "imports": "Import"}
#: Facts whose edge depends on what the target is.
BY_TARGET = ("constructs", "injects", "locates")


def dependency_type(target_is_abstract: Column) -> Column:
    """An interface or abstract class is called; a concrete one is made."""
    return F.when(target_is_abstract, "MethodCall").otherwise("Instantiates")


def edges_of_facts(facts: DataFrame) -> DataFrame:
    """Facts (symbol, fact, target, target_is_abstract) -> (caller_id, callee_id,
    edge_type): by rule, without edges to oneself, each once."""
    kind = F.when(F.col("fact").isin(*BY_TARGET), dependency_type(F.col("target_is_abstract")))
    for fact, edge in FACT_EDGES.items():
        kind = kind.when(F.col("fact") == fact, edge)
    made = facts.filter(F.col("symbol") != F.col("target")).select(F.col("symbol").alias("caller_id"), F.col("target").alias("callee_id"), kind.alias("edge_type"))
    return made.filter("edge_type is not null").distinct()


def documentation_text(doc: Column) -> Column:
    """The summary, then the remarks, of an XML documentation comment as text: tags
    go, references leave the name they refer to, white space is one blank."""
    bare = F.regexp_replace(F.coalesce(doc, F.lit("")), r"(?m)^[ \t]*///? ?", "")

    def flat(x: Column) -> Column:
        named = F.regexp_replace(x, r"<(?:see|paramref|typeparamref)\s+(?:cref|langword|name)\s*=\s*[\"']([^\"']*)[\"']\s*/>", " $1")
        plain = F.regexp_replace(named, r"<[^>]*>", "")
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            plain = F.replace(plain, F.lit(entity), F.lit(char))
        return F.trim(F.regexp_replace(plain, r"\s+", " "))

    def element(name: str) -> Column:
        found = F.regexp_extract_all(bare, F.lit(rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>"), F.lit(1))
        return F.array_join(F.filter(F.transform(found, flat), lambda x: x != ""), "\n")

    return F.array_join(F.filter(F.array(element("summary"), element("remarks")), lambda x: x != ""), "\n")


def nodes_of_facts(parts: DataFrame) -> DataFrame:
    """Declaration parts (project_id, symbol, fully_qualified_name, display_name,
    node_type, path, start_line, end_line, documentation, token_hash, ordinal) ->
    one node a project and symbol.  Partial declarations are one node: the part that
    comes first (by ordinal, path, line) gives the place and the summary, and the
    body hash is that of all parts' token hashes, whatever their order; it is null
    where no part has any.  Parts without a symbol are none."""
    first = F.struct("ordinal", "path", "start_line", "end_line")
    shown = ["fully_qualified_name", "display_name", "node_type", "path", "start_line", "end_line", "documentation"]
    met = parts.filter("symbol is not null").groupBy("project_id", "symbol").agg(F.min_by(F.struct(*shown), first).alias("f"), F.collect_list("token_hash").alias("_hashes"), F.count(F.lit(1)).alias("n_parts"))
    summary = documentation_text(F.col("f.documentation"))
    made = met.select("project_id", "symbol", *[F.col(f"f.{c}").alias(c) for c in shown[:-1]], summary.alias("summary"), F.when(F.size("_hashes") > 0, body_hash(F.col("_hashes"))).alias("body_hash"), "n_parts")
    text = F.when(F.col("summary") == "", F.col("display_name")).otherwise(F.concat("display_name", F.lit("\n"), "summary"))
    return made.select(F.concat(F.lit("code:"), "project_id", F.lit(":"), "symbol").alias("canonical_id"), *made.columns, text.alias("search_text"))


def _dyadic(start: Column, end: Column) -> Column:
    """The blocks of 2^level aligned lines that make up the lines start to end, two of
    a level at most: an array of (level, block)."""
    least, beyond = start.cast("long"), end.cast("long") + 1
    level = F.sequence(F.lit(0), F.floor(F.log2(beyond - least)).cast("int") + 1)

    def at(k: Column) -> Column:
        first = F.call_function("shiftright", least + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k)
        last = F.call_function("shiftright", beyond, k)
        left = F.when((first < last) & (F.pmod(first, F.lit(2)) == 1), F.struct(k.alias("level"), first.alias("block")))
        right = F.when((first < last) & (F.pmod(last, F.lit(2)) == 1), F.struct(k.alias("level"), (last - 1).alias("block")))
        return F.array(left, right)

    return F.filter(F.flatten(F.transform(level, at)), lambda x: x.isNotNull())


def enclosing(calls: DataFrame, declarations: DataFrame) -> DataFrame:
    """Calls (call_id, path, line) -> (call_id, declaration_id) of the smallest
    declaration (declaration_id, path, start_line, end_line) around the line; ties
    to the first.  A declaration is cut into aligned blocks of 1, 2, 4, ... lines, of
    which one block keeps its smallest declaration only; a line lies in one block of
    each level.  So the join has a row for each line asked and level, however many
    declarations lie around a line."""
    order = F.struct((F.col("end_line") - F.col("start_line")).alias("size"), "start_line", "declaration_id")
    spread = declarations.filter("end_line >= start_line").select("path", order.alias("_d"), F.explode(_dyadic(F.col("start_line"), F.col("end_line"))).alias("_b"))
    blocks = spread.groupBy("path", F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")).agg(F.min("_d").alias("_d"))
    top = declarations.filter("end_line >= start_line").agg(F.max(F.floor(F.log2(F.col("end_line").cast("long") - F.col("start_line") + 1)).cast("int") + 1).alias("_top"))
    lines = calls.select("path", "line").distinct().crossJoin(F.broadcast(top.filter("_top is not null")))
    probe = lines.select("path", "line", F.explode(F.sequence(F.lit(0), F.col("_top"))).alias("_level"))
    probe = probe.withColumn("_block", F.call_function("shiftright", F.col("line").cast("long"), F.col("_level")))
    best = probe.join(blocks, ["path", "_level", "_block"]).groupBy("path", "line").agg(F.min("_d").alias("_d"))
    return calls.join(best, ["path", "line"]).groupBy("call_id").agg(F.min("_d").alias("_d")).select("call_id", F.col("_d.declaration_id").alias("declaration_id"))


def visible(graph: Graph, types=("*",), text: str = "") -> tuple[DataFrame, DataFrame]:
    """The client's view: nodes of the types whose label, type or id hold the
    text (letter case aside), and the edges between two such nodes."""
    nodes = graph.display()
    if "*" not in types:
        nodes = nodes.filter(F.col("type").isin(*types))
    if text.strip():
        needle = text.strip().lower()
        nodes = nodes.filter(F.contains(F.lower("label"), F.lit(needle)) | F.contains("type", F.lit(needle)) | F.contains(F.lower("canonical_id"), F.lit(needle)))
    ids = nodes.select("id")
    edges = graph.edges.join(ids.withColumnRenamed("id", "caller"), "caller", "left_semi").join(ids.withColumnRenamed("id", "callee"), "callee", "left_semi")
    return nodes, edges


def histogram(nodes: DataFrame) -> DataFrame:
    """(type, n) of the nodes of a view."""
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def reusable(contributions: DataFrame, inputs: DataFrame, changes: DataFrame) -> DataFrame:
    """Contributions (contribution_id, source_kind), their inputs
    (contribution_id, path) and changes (action, path) -> (contribution_id,
    reuse).  A batch is reused only if it touches documentation alone, none of
    the inputs, and, for C#, adds or renames nothing."""
    markdown = F.col("path").rlike(r"(?i)\.(md|markdown|mdown|mkd)$")
    batch = changes.agg(F.coalesce(F.bool_and(markdown), F.lit(True)), F.coalesce(F.bool_or(F.col("action").isin("Added", "Renamed")), F.lit(False))).first()
    docs, grows = F.lit(batch[0]), F.lit(batch[1])
    touched = inputs.join(changes.select("path").distinct(), "path", "left_semi").select("contribution_id").distinct().withColumn("_touched", F.lit(True))
    joined = contributions.join(touched, "contribution_id", "left")
    reuse = docs & F.col("_touched").isNull() & ~((F.col("source_kind") == "CSharp") & grows)
    return joined.select("contribution_id", reuse.alias("reuse"))
