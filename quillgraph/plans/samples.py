"""Sources made from the test tables: Markdown, TypeScript, file listings, notes
on nodes, a graph of pages and one of project files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.functions import text as X
from quillgraph.functions.ranking import global_rank
from quillgraph.graph import Graph
from quillgraph.operators import extraction
from quillgraph.operators.build import closure, directory_table
from quillgraph.plans.derive import corpus, notes, page_paths, read


def _s(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def handbook(spark: SparkSession, d: str) -> DataFrame:
    """(relative_path, text): one Markdown file a conversation: an underlined
    title, then nine lines a turn, then a link definition."""
    said = F.translate("text", "\n\r`[]", "     ")
    here = F.concat(
        F.repeat(F.lit("#"), (F.col("turn") % 3 + 1).cast("int")), F.lit(" Turn "), _s("turn"), F.lit("\n\nSaid: "), said,
        F.lit(" See [next](c"), _s(F.col("conv_id") + 1), F.lit(".md#turn-"), _s("turn"), F.lit(") and [more][ ref ].\n\n~~~\n# no heading\n```\n~~~\n\n"),
    )
    turns = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", here.alias("t")))), lambda x: x["t"]), "").alias("body"))
    text = F.concat(F.lit("Talk "), _s("conv_id"), F.lit("\n====\n\n"), F.col("body"), F.lit("[REF]: c"), _s(F.col("conv_id") + 2), F.lit(".md"))
    return turns.select(F.concat(F.lit("docs/c"), _s("conv_id"), F.lit(".md")).alias("relative_path"), text.alias("text"))


def notebook(spark: SparkSession, d: str) -> DataFrame:
    """(relative_path, text): one Markdown file a conversation with headings in
    quotes, lists, HTML and code, and wiki links."""
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    k, after = _s("conv_id"), _s(F.col("conv_id") + 1)
    text = F.concat(
        F.lit("# Talk "), k, F.lit("\n\n> # quoted\n> lazy\nstill [[c"), after, F.lit("|next]]\n\n1. item\n\n   ## inside [[c"), k, F.lit("#In Short]]\n\n   > ### deeper\n\n<div>\n## html [[gone]] [x](gone.md)\n</div>\n\n"),
        F.when(F.col("conv_id") % 2 == 0, F.lit("- ~~~\n  # [[gone]]\n  ~~~\n")).otherwise(F.lit("    # [[gone]]\n\n<!-- a\n# b -->\n")), F.lit("In\nshort\n---\n\n"), F.lit("`[[gone]]` [["), k, F.lit("/up]] "), _s("turns"), F.lit(" turns\n"),
    )
    return c.select(F.concat(F.lit("docs/wiki/c"), k, F.lit(".md")).alias("relative_path"), text.alias("text"))


def scripts(spark: SparkSession, d: str) -> DataFrame:
    """(relative_path, text): a module a supplier, a barrel a nation and one over
    all, and a consumer a customer, with a tsconfig and a package."""
    nation, supplier, customer = (read(spark, d, n) for n in ("nation", "supplier", "customer"))
    n_suppliers = supplier.count()
    home = F.concat(F.lit("src/n"), _s("s_nationkey"))
    body = F.concat(F.lit("const glob = 'src/*'; const tail = '*/x';\n/** Module "), _s("s_suppkey"), F.lit(". */\nexport class S"), _s("s_suppkey"), F.lit(" {\n  run(x: number): void;\n  run(x: string): void { if (x) { go(x); } }\n  private hidden = 1;\n  #own = '{';\n  readonly size?: number;\n  constructor() {}\n}\n"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("export default function make"), _s("s_suppkey"), F.lit("() {}\n"))).otherwise(""))
    modules = supplier.select(F.concat(home, F.lit("/s"), _s("s_suppkey"), F.lit(".ts")).alias("relative_path"), body.alias("text"))
    star = F.concat(F.lit("export * from './s"), _s("s_suppkey"), F.lit("';\n"))
    named = F.concat(F.lit("export { S"), _s("s_suppkey"), F.lit(" as T"), _s("s_suppkey"), F.lit(' } from "./s'), _s("s_suppkey"), F.lit('";\n'))
    line = F.when(F.col("s_suppkey") % 3 == 0, named).otherwise(star)
    barrels = supplier.groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "").alias("text")).select(F.concat(F.lit("src/n"), _s("s_nationkey"), F.lit("/index.ts")).alias("relative_path"), "text")
    # a cycle: the barrel over all is also starred by one nation's neighbour
    every = F.concat(F.lit("export * as n"), _s("n_nationkey"), F.lit(" from './n"), _s("n_nationkey"), F.lit("';\n"))
    top = nation.groupBy().agg(F.array_join(F.array_sort(F.collect_list(every)), "").alias("t")).select(F.lit("src/all.ts").alias("relative_path"), F.concat("t", F.lit("export * from './ring';\n")).alias("text"))
    ring = spark.createDataFrame([("src/ring.ts", "export * from './all';\nexport { useState as state } from 'react';\n"), ("tsconfig.json", '{ // of the root\n "compilerOptions": { "baseUrl": ".", "paths": { "@lib/*": ["src/*"], "@lib/ring": ["src/ring"], } },\n /* roots */ "include": ["src/**/*", "app/*"], }'), ("packages/kit/package.json", '{ "name": "@kit/core", "main": "lib/main.ts" }'), ("packages/kit/lib/main.ts", "export const kit = 1;\n")], "relative_path string, text string")
    k, wanted = F.col("c_custkey"), F.col("c_custkey") % n_suppliers
    owner = customer.select("c_custkey", "c_nationkey", wanted.alias("s_suppkey")).join(supplier.select("s_suppkey", "s_nationkey"), "s_suppkey")
    uses = F.concat(
        F.lit("import { S"), _s("s_suppkey"), F.lit(" } from '@lib/n"), _s("s_nationkey"), F.lit("';\n"),
        F.when(k % 5 == 0, F.concat(F.lit("import * as all from 'src/n"), _s("c_nationkey"), F.lit("';\n"))).otherwise(""),
        F.when(k % 7 == 0, F.concat(F.lit("import { n"), _s("c_nationkey"), F.lit(", state } from '@lib/ring';\n"))).otherwise(""),
        F.when(k % 11 == 0, F.lit("import { kit } from '@kit/core';\nimport gone from './gone';\n")).otherwise(""),
        F.lit("import React, { memo as m } from 'react';\nexport class C"), _s(k), F.lit(" { go(): void; go(x?: number) { return /[/}]/; } }\n"),
        F.when(k % 2 == 0, F.concat(F.lit("export interface f"), _s(k), F.lit(" { gone: '}' }\nexport function f"), _s(k), F.lit("(a: string): void;\nexport function f"), _s(k), F.lit("() { return fetch('/c/"), _s(k), F.lit("'); }\n"))).otherwise(""),
    )
    consumers = owner.select(F.concat(F.lit("app/c"), _s(k), F.lit(".ts")).alias("relative_path"), uses.alias("text"))
    view = F.concat(
        F.lit("import * as Lib from 'lib-ui';\nexport const V"), _s(k), F.lit(" = () => <Lib.Box.Item>don't {`${'}'}`}</Lib.Box.Item>\nexport class W"), _s(k),
        F.lit(" {\n  send() { return axios.post('/w', {}) }\n  static all() { fetch(`/w/${1}`) }\n}\nenum E { A = 1, B }\nexport { E as Kinds }\nexport type { C"), _s(k), F.lit(" } from './c"), _s(k), F.lit("'\n"),
    )
    views = owner.filter(k % 13 == 0).select(F.concat(F.lit("app/v"), _s(k), F.lit(".tsx")).alias("relative_path"), view.alias("text"))
    return modules.unionByName(barrels).unionByName(top).unionByName(ring).unionByName(consumers).unionByName(views)


def settings(spark: SparkSession, d: str) -> DataFrame:
    """(relative_path, text): a tsconfig a nation that extends others, and a
    source and a generated file a customer."""
    nation, customer = read(spark, d, "nation"), read(spark, d, "customer")
    folder = F.concat(F.lit("web/n"), _s("n_nationkey"))
    even = F.lit('{ "extends": ["../base", "@cfg/strict"], // two parents\n "compilerOptions": { "paths": { "@app/*": ["src/*"], "": ["x"], "none": [] } }, "include": ["src/**/*"], }')
    odd = F.lit('{ /* "include": ["*"] */ "extends": "../base.json", "compilerOptions": { "outDir": "./out" } }')
    own = nation.select(F.concat(folder, F.lit("/tsconfig.json")).alias("relative_path"), F.when(F.col("n_nationkey") % 2 == 0, even).otherwise(odd).alias("text"))
    shared = spark.createDataFrame([
        ("web/base.json", '{ "extends": "./root.json", "compilerOptions": { "baseUrl": "." }, "exclude": ["**/gen*.ts"] }'),
        ("web/root.json", '{ "compilerOptions": { "baseUrl": "deep", "paths": { "*": ["lib/*"] }, "outDir": "n1" }, "include": ["n3", "n1/src/*"] }'),
        ("web/node_modules/@cfg/strict/tsconfig.json", '{ "extends": "./more", "compilerOptions": { "paths": {} } }'),
        ("web/node_modules/@cfg/strict/more.json", '{ "files": ["own.ts"], "exclude": ["x/* none */y"] }'),
    ], "relative_path string, text string")
    name = F.when(F.col("c_custkey") % 3 == 0, "src/gen").otherwise("src/c")
    sources = customer.select(F.concat(F.lit("web/n"), _s("c_nationkey"), F.lit("/"), name, _s("c_custkey"), F.lit(".ts")).alias("relative_path"), F.lit("").alias("text"))
    return own.unionByName(shared).unionByName(sources)


def noted(spark: SparkSession, d: str) -> Graph:
    """Documents as nodes, conversations as notes on them."""
    c, n = corpus(spark, d), notes(spark, d)
    g = Graph(spark)
    g.tables["code_nodes"] = c.select("id", "body_hash")
    made = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60)
    g.tables["memory_nodes"] = n.select(F.col("memory_id").alias("id"), F.col("id").alias("target_code_node_id"), F.col("target_hash").alias("target_code_hash"), "content", F.sha2("content", 256).alias("content_hash"), "tags", "intent", F.lit(None).cast("array<float>").alias("vector_embedding"), made.alias("created_at"))
    return g


def note_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The notes, with the vector of their conversation's number."""
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector_embedding"))
    return notes(spark, d).join(v, "id", "left")


def kinds(spark: SparkSession, d: str) -> DataFrame:
    """The search corpus in three projects and two node types."""
    return corpus(spark, d).withColumn("project_node_id", F.col("id") % 3).withColumn("node_type", F.when(F.col("id") % 2 == 0, "Document").otherwise("Method"))


def web(spark: SparkSession, d: str) -> Graph:
    """Pages as nodes, and the addresses they link to."""
    paths = page_paths(spark, d)
    dirs = directory_table(paths)
    links = extraction.page_links(read(spark, d, "pages"))
    target = global_rank(links.select("href").distinct(), ["href"], "n", "hrefs").select("href", (F.col("n") + 10_000_000).alias("id"), F.concat(F.lit("http:GET:"), X.uri_encode(F.col("href"))).alias("canonical_id"))
    page = F.col("page_id") + 1
    unused = spark.createDataFrame([(9_999_999, "http:GET:unused", "Http")], schemas.schema("graph_nodes"))
    nodes = paths.select(page.alias("id"), F.concat(F.lit("page:"), _s("page_id")).alias("canonical_id"), F.lit("Code").alias("kind")).unionByName(target.select("id", "canonical_id", F.lit("Http").alias("kind"))).unionByName(unused)
    none = F.lit(None)
    code = paths.select(page.alias("id"), none.cast("long").alias("project_node_id"), F.col("page_id").alias("document_id"), F.col("path").alias("fully_qualified_name"), F.col("path").alias("display_name"), F.lit("Document").alias("node_type"), none.cast("int").alias("start_line"), none.cast("int").alias("end_line"), none.cast("string").alias("summary"), none.cast("string").alias("search_text"), none.cast("string").alias("body_hash"), none.cast("array<float>").alias("vector_embedding"))
    edges = links.join(target, "href").select((F.col("page_id") + 1).alias("caller_node_id"), F.col("id").alias("callee_node_id"), F.lit("HttpRequest").alias("edge_type"), none.cast("string").alias("metadata")).distinct()
    docs = paths.join(dirs.select(F.col("id").alias("directory_id"), F.col("path").alias("_dir")), X.parent_path(F.col("path")) == F.col("_dir"))
    documents = docs.select(F.col("page_id").alias("id"), "directory_id", X.file_name(F.col("path")).alias("file_name"), X.extension(F.col("path")).alias("extension"), F.col("path").alias("relative_path"), X.document_kind(F.col("path")).alias("kind"))
    return Graph(spark, {"graph_nodes": nodes, "code_nodes": code, "dependency_edges": edges, "documents": documents, "directories": dirs, "directory_closures": closure(dirs)})


def shelves(spark: SparkSession, d: str) -> Graph:
    """A folder a region, a project file and a source a nation, suppliers as the
    projects of their nation's file; vectors on every third supplier."""
    region, nation, supplier = (read(spark, d, n) for n in ("region", "nation", "supplier"))
    dirs = region.select((F.col("r_regionkey") + 2).cast("long").alias("id"), F.lit(1).cast("long").alias("parent_id"), F.concat(F.lit("r"), _s("r_regionkey")).alias("path"), F.concat(F.lit("r"), _s("r_regionkey")).alias("name"))
    dirs = dirs.unionByName(spark.createDataFrame([(1, None, "", "/")], schemas.schema("directories")))
    endings = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(e).alias("e")) for i, e in enumerate((".csproj", ".cs", ".tsx", ".md", ".txt"))]))
    files = nation.select("n_nationkey", "n_regionkey", endings.alias("f"))
    name = F.concat(F.lit("n"), _s("n_nationkey"), F.col("f.e"))
    path = F.concat(F.lit("r"), _s("n_regionkey"), F.lit("/"), name)
    documents = files.select((F.col("n_nationkey") * 10 + F.col("f.i")).cast("long").alias("id"), (F.col("n_regionkey") + 2).cast("long").alias("directory_id"), name.alias("file_name"), F.col("f.e").alias("extension"), path.alias("relative_path"), X.document_kind(path).alias("kind"))
    projects = supplier.select((F.col("s_suppkey") + 1000).alias("id"), F.col("s_name").alias("name"), (F.col("s_nationkey") * 10).cast("long").alias("project_document_id"), F.lit("h").alias("content_hash"))
    vector = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit(1.0).cast("float")))
    code = supplier.select("s_suppkey", (F.col("s_nationkey") * 10 + 1 + F.col("s_suppkey") % 3).cast("long").alias("document_id"), vector.alias("vector_embedding"))
    return Graph(spark, {"directories": dirs, "documents": documents, "project_nodes": projects, "code_nodes": code})


def listing(spark: SparkSession, d: str) -> DataFrame:
    """(relative_path): files of seven kinds, some twice."""
    c = read(spark, d, "customer")
    k, n = _s("c_custkey"), _s("c_nationkey")
    forms = [("src/n", n, "/c", k, ".cs"), ("docs\\n", n, "/c", k, ".md"), ("docs/BIN/c", k, ".md"), ("gen/c", k, ".md"), ("gen/keep/c", k, ".md"), ("app/dist/c", k, ".tsx"), ("app/n", n, "/c", k, ".ts"), ("app/n", n, "/tsconfig.json"), ("lib/n", n, "/Core.csproj"), ("lib/n", n, "/Directory.Build.props")]
    path = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        path = F.when(F.col("c_custkey") % len(forms) == i, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in form])).otherwise(path)
    return c.select(path.alias("relative_path"))
