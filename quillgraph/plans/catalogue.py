"""The registered graph queries: name -> callable, name -> SQL twin.

Each query binds an operator to the derived graph (``derive``) and flattens its
result to plain columns, so that both engines can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.functions import text as X
from quillgraph.functions.ranking import global_rank
from quillgraph.operators import build, extraction, facts, logs, memories, navigation, paging, render, search, statistics
from quillgraph.plans import catalogue_sources, derive, sql, sql_sources
from quillgraph.streaming import notify, watch

FLAGSHIP = "impact_nation_d3"
QUERIES: dict = {}
SQL: dict[str, str] = sql.SQL | sql_sources.SQL
ROOT = 1003
SEARCH = "Tion reand licensed"
NOTE_SEARCH = "tion"


def query(f):
    QUERIES[f.__name__] = f
    return f


def _ids(spark: SparkSession, *ids: int) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id bigint")


def _nodes(df: DataFrame) -> DataFrame:
    return df.select("id", "canonical_id", F.col("fully_qualified_name").alias("name"), "node_type", "depth")


@query
def impact_nation_d3(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(navigation.impact(derive.stored(spark, d), _ids(spark, ROOT), 3).nodes)


@query
def impact_edges_d2(spark: SparkSession, d: str) -> DataFrame:
    g = derive.stored(spark, d)
    return navigation.ordered_edges(g, navigation.impact(g, _ids(spark, ROOT), 2).edges).drop("metadata")


@query
def impact_all_types(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(navigation.impact(derive.stored(spark, d), _ids(spark, ROOT), 2, edge_types=schemas.EDGE_TYPES).nodes)


@query
def impact_filtered_methodcall(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(navigation.impact(derive.stored(spark, d), _ids(spark, 1_000_007), 2, edge_types=["MethodCall"]).nodes)


@query
def direct_callees(spark: SparkSession, d: str) -> DataFrame:
    return navigation.callees(derive.stored(spark, d), _ids(spark, 10_000_001)).select("id", "canonical_id", "node_type")


@query
def trace_callee_budget(spark: SparkSession, d: str) -> DataFrame:
    return navigation.trace(derive.stored(spark, d), 1_003, "callee", 3, 40, edge_types=["ParentOf", "Implements"]).nodes.select("id", "ord", "depth")


@query
def edges_among_nodes(spark: SparkSession, d: str) -> DataFrame:
    g = derive.stored(spark, d)
    shown = g["code_nodes"].filter("node_type in ('Method', 'Class')").select("id")
    return navigation.edges_among(g, shown).select("caller", "callee", "edge_type")


@query
def root_resolution(spark: SparkSession, d: str) -> DataFrame:
    asked = ["1003", "nation:4", "NATION_7", "nation_7", "customer#000000011", "Customer#000000012", "blue bolt", "BLUE BOLT", "99999999999", "nobody", "12x"]
    return navigation.resolve(derive.stored(spark, d), spark.createDataFrame([(a,) for a in asked], "identifier string"))


@query
def inheritors_nation(spark: SparkSession, d: str) -> DataFrame:
    return navigation.inheritors(derive.stored(spark, d), _ids(spark, ROOT)).select("id", "canonical_id", F.col("fully_qualified_name").alias("name"))


@query
def context360_order(spark: SparkSession, d: str) -> DataFrame:
    g = derive.stored(spark, d)
    return navigation.context(g, 10_000_003).unionByName(navigation.context(g, ROOT))


@query
def connections_supplier(spark: SparkSession, d: str) -> DataFrame:
    page = navigation.connections(derive.stored(spark, d), 2_000_005, 100)
    flat = F.array_join(F.transform("relationships", lambda r: F.concat(r["type"], F.lit("/"), r["direction"])), ",")
    return page.select("peer", "label", "type", flat.alias("relationships"))


def _some_directories(g) -> list[int]:
    return [r["id"] for r in g["directories"].filter("path like 'blog.%' and path not like '%/%'").select("id").collect()]


@query
def scope_nodes_page(spark: SparkSession, d: str) -> DataFrame:
    g = derive.stored(spark, d)
    return paging.nodes_page(g, _some_directories(g), 500, after=(0, 1_000_100)).select(F.col("phase").cast("long").alias("phase"), "id", "label", "type", "scope", "project_id")


@query
def scope_edges_page(spark: SparkSession, d: str) -> DataFrame:
    g = derive.stored(spark, d)
    return paging.edges_page(g, _some_directories(g), 700, after=(1_000_100, 1_005, "Implements")).select("caller", "callee", "edge_type", "label", "scope")


@query
def scope_totals(spark: SparkSession, d: str) -> DataFrame:
    g = derive.stored(spark, d)
    nodes = paging.scoped_nodes(g, _some_directories(g)).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    edges = paging.scoped_edges(g, _some_directories(g)).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    return nodes.unionByName(edges)


@query
def tree_children(spark: SparkSession, d: str) -> DataFrame:
    g = derive.stored(spark, d)
    return paging.tree(g, "").unionByName(paging.tree(g, "spam-farm.example.org/en")).select(F.col("kind_order").cast("long").alias("kind_order"), "kind", "label", "path", "child_count", "has_children")


@query
def directory_closure(spark: SparkSession, d: str) -> DataFrame:
    g = derive.stored(spark, d)
    return g["directory_closures"].select(F.col("ancestor_directory_id").alias("ancestor"), F.col("descendant_directory_id").alias("descendant"), F.col("depth").cast("long").alias("depth"))


@query
def graph_stats_counts(spark: SparkSession, d: str) -> DataFrame:
    return statistics.counts(derive.stored(spark, d))


@query
def language_stats(spark: SparkSession, d: str) -> DataFrame:
    c = derive.corpus(spark, d)
    lang = F.substring_index("display_name", " ", 1)
    return c.groupBy(lang.alias("language")).agg(F.countDistinct("id").alias("documents"), F.count(F.when(F.size("vector_embedding") > 0, 1)).alias("vectors"), F.sum(F.length("search_text")).alias("chars"))


@query
def edge_type_stats(spark: SparkSession, d: str) -> DataFrame:
    return statistics.by_edge_type(derive.stored(spark, d))


@query
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    ranked = search.keyword_ranks(derive.corpus(spark, d), SEARCH, 200, index=derive.stored_index(spark, d))
    return ranked.select("id", F.round("score", 6).alias("score"))


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(v) for v in derive.read(spark, d, "embeddings").filter("vec_id = 7").first()["embedding"]]


@query
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    ranked = search.vector_ranks(derive.corpus(spark, d), _query_vector(spark, d), 50)
    return ranked.select("id", "rank", F.round("similarity", 6).alias("similarity"))


@query
def memory_lexical_rank(spark: SparkSession, d: str) -> DataFrame:
    return search.memory_ranks(derive.notes(spark, d), NOTE_SEARCH, 100).select("memory_id", "id", "score", "rank")


@query
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return search.hybrid(derive.corpus(spark, d), SEARCH, _query_vector(spark, d), 10, index=derive.stored_index(spark, d)).select("id", "rank", F.round("score", 6).alias("score"))


@query
def normalised_tags(spark: SparkSession, d: str) -> DataFrame:
    c = derive.read(spark, d, "conversations")
    tags = F.array(F.concat(F.lit(" "), F.upper("role"), F.lit(" ")), F.col("role"), F.lit("Zeta"), F.lit(" "))
    return c.select("conv_id", "turn", F.array_join(memories.normal_tags(tags), ",").alias("tags"), F.sha2(F.trim("text"), 256).alias("content_hash"))


@query
def embedding_reuse_plan(spark: SparkSession, d: str) -> DataFrame:
    now = derive.corpus(spark, d)
    before = now.withColumn("body_hash", F.when(F.col("id") % 3 == 0, F.lit("changed")).otherwise(F.col("body_hash")))
    plan = build.embedding_plan(now.select("id", "canonical_id", "search_text", "body_hash"), before.select("canonical_id", "search_text", "body_hash", "vector_embedding"))
    return plan.select("id", "action", F.coalesce(F.size("vector_embedding").cast("long"), F.lit(0)).alias("dims"))


def _two_states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = derive.read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    after = c.filter("c_custkey % 11 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 13 == 0, F.concat("c_name", F.lit("*"))).otherwise(F.col("c_name")))
    more = c.filter("c_custkey % 17 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000)
    return c, after.unionByName(more)


@query
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return build.diff(*_two_states(spark, d), ["c_custkey"])


@query
def canonicalize_last_wins(spark: SparkSession, d: str) -> DataFrame:
    e = derive.read(spark, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("canonical_id"), "value", F.col("event_id").alias("ingest_ordinal"))
    return build.last_wins(e, ["canonical_id"], "ingest_ordinal").select("canonical_id", "value", "ingest_ordinal")


@query
def canonical_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of two contributions: dangling callees go, synthetic ones stay."""
    orders = derive.read(spark, d, "orders")
    nodes = orders.filter("o_orderkey % 5 <> 0").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("canonical_id"), F.lit("/src//").alias("path"), F.lit(1).alias("ingest_ordinal"))
    projects = spark.createDataFrame([], "id string, relative_file_path string, ingest_ordinal int")
    callee = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("package:p"), (F.col("o_orderkey") % 3).cast("string"))).otherwise(F.concat(F.lit("o:"), (F.col("o_orderkey") + 1).cast("string")))
    edges = orders.select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("caller_id"), callee.alias("callee_id"), F.lit("Import").alias("edge_type"), F.col("o_orderpriority").alias("metadata"), F.lit(1).alias("ingest_ordinal"))
    return build.canonicalise(projects, nodes, edges)[2].select("caller_id", "callee_id", "edge_type", "metadata")


@query
def identity_assign(spark: SparkSession, d: str) -> DataFrame:
    c = derive.read(spark, d, "customer").select(F.col("c_name").alias("canonical_id"), "c_custkey")
    return build.assign_ids(c.select("canonical_id"), c.filter("c_custkey % 3 = 0").select("canonical_id", F.col("c_custkey").alias("id")))


@query
def move_detection(spark: SparkSession, d: str) -> DataFrame:
    p = derive.read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_name", "p_brand", "p_type", "p_size")
    after = p.withColumn("path", F.when(F.col("path").cast("long") % 4 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")))
    return build.moved(p, after, "path", ["p_name", "p_brand", "p_type", "p_size"])


def _log(spark: SparkSession, d: str) -> DataFrame:
    docs = derive.read(spark, d, "documents").select(F.col("doc_id").alias("log_id"), "text")
    return logs.split_lines(docs)


@query
def log_windows(spark: SparkSession, d: str) -> DataFrame:
    lines = _log(spark, d)
    return logs.blocks(lines, logs.matches(F.col("text"), any_of=["licensed", "licens*", "reserved"]), 3).select("log_id", F.col("block").cast("long").alias("block"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "n_matches")


@query
def log_budget(spark: SparkSession, d: str) -> DataFrame:
    return logs.capture(_log(spark, d), 12, 3000).groupBy("log_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.max("cut").alias("cut"))


@query
def log_range(spark: SparkSession, d: str) -> DataFrame:
    return logs.line_range(_log(spark, d), 3, 5).select("log_id", "line_number", F.length("text").cast("long").alias("chars"))


@query
def run_state_latest(spark: SparkSession, d: str) -> DataFrame:
    e = derive.read(spark, d, "events")
    runs = e.select(F.col("user_id").alias("workspace"), F.col("ts").alias("completed_at"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("outcome"), F.col("event_id").alias("ordinal"))
    return statistics.latest_runs(runs)


@query
def notification_reduce(spark: SparkSession, d: str) -> DataFrame:
    e = derive.read(spark, d, "events")
    kind = F.when((F.col("event_type") == "purchase") & (F.col("value") > 80), "succeeded").otherwise(F.col("event_type"))
    return notify.reduce_batch(e.select(F.col("user_id").alias("operation_id"), F.col("event_id").alias("sequence"), kind.alias("kind"), F.col("props").alias("message")))


@query
def change_batches(spark: SparkSession, d: str) -> DataFrame:
    e = derive.read(spark, d, "events").select("user_id", "ts", "event_id")
    b = watch.batches(e, "user_id", "ts", 6 * 3600 * 1000)
    return b.groupBy("user_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query
def change_windows(spark: SparkSession, d: str) -> DataFrame:
    return watch.windowed_counts(derive.read(spark, d, "events"))


@query
def change_sessions(spark: SparkSession, d: str) -> DataFrame:
    return watch.sessions(derive.read(spark, d, "events"), "user_id", gap="2 hours")


@query
def slugify_titles(spark: SparkSession, d: str) -> DataFrame:
    p = derive.read(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return p.select("page_id", X.slug(F.col("title")).alias("slug"))


@query
def synthetic_http_nodes(spark: SparkSession, d: str) -> DataFrame:
    links = extraction.page_links(derive.read(spark, d, "pages"))
    edges = links.select(F.concat(F.lit("http:GET:"), X.uri_encode(F.col("href"))).alias("callee_id"))
    made = build.synthetic_nodes(edges)
    return made.select("canonical_id", "kind", X.node_label(F.col("canonical_id"), F.lit(None).cast("string")).alias("label"))


@query
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return extraction.page_links(derive.read(spark, d, "pages"))


@query
def document_paths(spark: SparkSession, d: str) -> DataFrame:
    p = derive.page_paths(spark, d)
    path = F.col("path")
    return p.select("page_id", path, X.parent_path(path).alias("parent"), X.file_name(path).alias("file_name"), X.extension(path).alias("extension"), X.document_kind(path).alias("kind"))


@query
def toon_search_groups(spark: SparkSession, d: str) -> DataFrame:
    classes = derive.stored(spark, d).code().filter("node_type = 'Class'")
    return render.search_groups(global_rank(classes, ["fully_qualified_name", "id"], "rank"))


@query
def path_chains(spark: SparkSession, d: str) -> DataFrame:
    g = derive.stored(spark, d)
    up = navigation.impact(g, _ids(spark, 3_000_005), 2)
    paths = navigation.chains(up.edges, 3_000_005, 2)
    return render.chain_lines(paths, g["code_nodes"].select("id", F.col("fully_qualified_name").alias("name")))


@query
def path_chains_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of caller chains, from the last chain of the first."""
    edges = derive.stored(spark, d).edges.filter(F.col("edge_type").isin(*schemas.FUNCTIONAL))
    first = navigation.chains_page(edges, 1003, 2, 40).agg(F.max("path")).first()[0]
    page = navigation.chains_page(edges, 1003, 2, 40, first)
    return page.select(F.array_join("path", ">").alias("ids"))


@query
def json_rows(spark: SparkSession, d: str) -> DataFrame:
    s = derive.read(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("s_name"))
    return render.as_json(s)


@query
def fact_edges(spark: SparkSession, d: str) -> DataFrame:
    """Facts about orders, customers and suppliers through the edge rules."""
    o, c, s = (derive.read(spark, d, n) for n in ("orders", "customer", "supplier"))

    def rows(df, symbol, fact, target, abstract):
        return df.select(symbol.cast("string").alias("symbol"), F.lit(fact).alias("fact"), target.cast("string").alias("target"), abstract.alias("target_is_abstract"))

    parts = rows(o, F.col("o_orderkey"), "constructs", F.col("o_custkey"), F.col("o_custkey") % 3 == 0)
    parts = parts.unionByName(rows(c, F.col("c_custkey"), "implements", F.col("c_nationkey"), F.lit(False)))
    parts = parts.unionByName(rows(s, F.col("s_suppkey"), "reads", F.col("s_nationkey"), F.lit(True))).unionByName(rows(s, F.col("s_suppkey"), "unknown", F.col("s_nationkey"), F.lit(True)))
    return facts.edges_of_facts(parts)


@query
def enclosing_declaration(spark: SparkSession, d: str) -> DataFrame:
    p, o = derive.read(spark, d, "part"), derive.read(spark, d, "orders")
    declared = p.select(F.col("p_partkey").alias("declaration_id"), F.col("p_brand").alias("path"), (F.col("p_partkey") % 200).alias("start_line"), (F.col("p_partkey") % 200 + F.col("p_size") * 3).alias("end_line"))
    calls = o.select(F.col("o_orderkey").alias("call_id"), F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")).alias("path"), (F.col("o_orderkey") % 330).alias("line"))
    return facts.enclosing(calls, declared)


@query
def visible_projection(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = facts.visible(derive.stored(spark, d), ("class", "interface"), "er")
    n = nodes.groupBy(F.col("type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(edges.groupBy(F.col("edge_type").alias("kind")).agg(F.count(F.lit(1)).alias("n")))


@query
def contribution_reuse(spark: SparkSession, d: str) -> DataFrame:
    c, o = derive.read(spark, d, "customer"), derive.read(spark, d, "orders")
    made = c.select(F.col("c_custkey").alias("contribution_id"), F.when(F.col("c_custkey") % 2 == 0, "CSharp").otherwise("Markdown").alias("source_kind"))
    inputs = o.select(F.col("o_custkey").alias("contribution_id"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"))
    changes = o.filter("o_orderkey % 10 = 0").select(F.lit("Added").alias("action"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"))
    return facts.reusable(made, inputs, changes)


@query
def context_lines(spark: SparkSession, d: str) -> DataFrame:
    return render.context_lines(navigation.context(derive.stored(spark, d), ROOT))


@query
def memory_blocks(spark: SparkSession, d: str) -> DataFrame:
    n = derive.notes(spark, d)
    return render.memory_blocks(n.select(F.col("memory_id").alias("id"), F.col("id").alias("node_id"), "intent", "tags", "content", (F.col("now_hash") != F.col("target_hash")).alias("stale")))


@query
def log_summary(spark: SparkSession, d: str) -> DataFrame:
    lines = _log(spark, d)
    return logs.summary(lines, logs.blocks(lines, logs.matches(F.col("text"), any_of=["the"], none_of=["licensed"]), 0))


QUERIES |= catalogue_sources.QUERIES
