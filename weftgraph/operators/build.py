"""The graph from analyses: nodes of sources, concepts, modules, symbols and rationales, and the edges between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.functions.scoring import node_confidence
from weftgraph.operators import analysis as A
from weftgraph.operators.graph import Graph, first_wins
from weftgraph.session import written


def _id(kind: str, c: Column | str) -> Column:
    return F.concat(F.lit(f"{kind}:"), (F.col(c) if isinstance(c, str) else c).cast("string"))


def _edges(df: DataFrame, source: Column, target: Column, relation: str, evidence: str, confidence: Column) -> DataFrame:
    return df.select(source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), F.lit(evidence).alias("evidence_class"), confidence.cast("double").alias("confidence"))


def document_graph(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Graph:
    """Sources and the concepts that they mention, claims of two sources that conflict on a concept, claims that contradict by their words.

    nodes(id, type, label, confidence, sources), edges(id, source, target, relation, evidence_class, confidence).
    """
    # Texts are analysed once, whatever reads the terms and claims.
    terms = written(A.top_terms(docs, 6, key, text), "terms")
    said = written(A.claims(docs, 4, key, text), "claims").withColumn("confidence", F.lit(0.55))
    concepts = A.aggregate_terms(terms, key)
    nodes = docs.select(_id("source", key).alias("id"), F.lit("source").alias("type"), T.truncate(F.coalesce(T.first_sentences(T.normalize_whitespace(F.col(text)), 1), F.lit("")), 80).alias("label"), F.lit(1.0).alias("confidence"), F.lit(1).cast("long").alias("sources"))
    nodes = nodes.unionByName(concepts.select("id", F.lit("concept").alias("type"), F.col("name").alias("label"), "confidence", "sources"))
    concept = _id("concept", T.slugify(F.col("term")))
    mentions = _edges(A.mention_edges(terms, said, key), _id("source", key), concept, "mentions", "extracted", F.col("confidence"))
    polar = terms.select(key, "term").join(said, key).where(F.contains(F.lower("claim"), F.col("term"))).select(F.col("term").alias("concept"), F.col(key).alias("source"), "at", "polarity", "confidence")
    conflicted = _edges(A.conflicts(polar), _id("source", "a"), _id("source", "b"), "conflicted_with", "ambiguous", F.col("confidence"))
    numbered = said.select(F.struct(key, "at").alias("id"), F.col(key).alias("source"), "claim", "polarity")
    against = A.contradictions(numbered).select(F.least("left_id", "right_id")[key].alias("a"), F.greatest("left_id", "right_id")[key].alias("b")).distinct()
    contradicts = _edges(against, _id("source", "a"), _id("source", "b"), "contradicts", "ambiguous", F.lit(0.0))
    edges = reduce(DataFrame.unionByName, [mentions, conflicted, contradicts]).withColumn("id", F.concat("source", F.lit("->"), "target", F.lit(":"), "relation"))
    return Graph(nodes, first_wins(edges, "id", [F.desc("confidence")]))


def code_graph(symbols: DataFrame, imports: DataFrame, calls: DataFrame | None = None) -> Graph:
    """Sources, modules and symbols of code: symbols(source_id, module, name, kind, exported), imports(module, name, reexport), calls(module, caller, name).

    Symbol ids number the repetitions of a name in its module. An import is resolved where one module has that name; imported symbols take part in calls.
    """
    from pyspark.sql.window import Window

    nth = F.row_number().over(Window.partitionBy("module", "name", "kind").orderBy("source_id"))
    own = symbols.withColumn("n", nth).withColumn("symbol", F.concat(F.lit("symbol:"), "module", F.lit(":"), T.slugify(F.col("name")), F.lit("."), "kind", F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise("")))
    modules = own.groupBy("module").agg(F.min("source_id").alias("source_id"))
    node = lambda df, id_, kind, label: df.select(id_.alias("id"), F.lit(kind).alias("type"), label.alias("label"))
    nodes = reduce(DataFrame.unionByName, [node(modules.select("source_id").distinct(), _id("source", "source_id"), "source", F.col("source_id").cast("string")), node(modules, _id("module", "module"), "module", F.col("module")), node(own, F.col("symbol"), "symbol", F.col("name"))])
    one = F.lit(1.0)
    parts = [
        _edges(modules, _id("source", "source_id"), _id("module", "module"), "contains_code", "extracted", one), _edges(own, _id("module", "module"), F.col("symbol"), "defines", "extracted", one),
        _edges(own.where("exported"), _id("module", "module"), F.col("symbol"), "exports", "extracted", one),
    ]
    found = A.resolve_imports(imports, modules.select(F.regexp_extract("module", r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1).alias("name"), F.col("module").alias("target"))).where("target is not null and target <> module")
    for relation, kept in (("imports", ~F.coalesce("reexport", F.lit(False))), ("exports", F.coalesce("reexport", F.lit(False)))):
        parts.append(_edges(found.where(kept), _id("module", "module"), _id("module", "target"), relation, "extracted", one))
    if calls is not None:
        names = own.select("module", "name", "symbol")
        far = found.select("module", F.col("target").alias("_m")).distinct().join(names.select(F.col("module").alias("_m"), "name", "symbol"), "_m").select("module", "name", "symbol")
        caller = names.select("module", F.col("name").alias("caller"), F.col("symbol").alias("_from")).groupBy("module", "caller").agg(F.min("_from").alias("_from"))
        made = A.resolve_calls(calls, names, far).join(caller, ["module", "caller"]).where("target <> _from")
        parts.append(made.select(F.col("_from").alias("source"), "target", F.lit("calls").alias("relation"), F.when(F.col("confidence") < 1, "inferred").otherwise("extracted").alias("evidence_class"), "confidence"))
    edges = reduce(DataFrame.unionByName, parts).withColumn("id", F.concat("source", F.lit("->"), "target", F.lit(":"), "relation"))
    return Graph(nodes, first_wins(edges, "id", [F.desc("confidence")]))


def rationale_graph(rationales: DataFrame, symbols: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and rationale_for edges of rationales (source_id, at, kind, text, and for code module, symbol): to the symbol (module, name, symbol) of that name, else to the module, else to the source."""
    own = rationales.withColumn("id", F.concat(F.lit("rationale:"), F.col("source_id").cast("string"), F.lit(":"), (F.col("at") + 1).cast("string")))
    target = _id("source", "source_id")
    if symbols is not None:
        known = symbols.groupBy("module", F.col("name").alias("symbol")).agg(F.min("symbol").alias("_s"))
        own = own.join(known, ["module", "symbol"], "left")
        target = F.coalesce("_s", _id("module", "module"), target)
    edges = _edges(own, F.col("id"), target, "rationale_for", "extracted", F.lit(1.0)).withColumn("id", F.concat("source", F.lit("->"), "target"))
    return own.select("id", F.lit("rationale").alias("type"), T.truncate(F.col("text"), 80).alias("label")), edges


def unique_scope_symbols(symbols: DataFrame) -> DataFrame:
    """(scope, short, symbol): symbols (scope, name, symbol) by the last part of their name, where only one in the package has it."""
    short = F.element_at(F.split("name", r"\."), -1)
    return symbols.select("scope", short.alias("short"), "symbol").distinct().groupBy("scope", "short").agg(F.count("*").alias("n"), F.min("symbol").alias("symbol")).where("n = 1").drop("n")


def analysed(manifests: DataFrame, analyses: DataFrame) -> DataFrame:
    """manifests with their analysis; ``missing`` where there is none."""
    return manifests.join(analyses.withColumn("_there", F.lit(True)), "source_id", "left").withColumn("missing", F.col("_there").isNull()).drop("_there")


def dirty_sources(now: DataFrame, before: DataFrame) -> DataFrame:
    """(source_id, reason) to analyse again: new, changed content, changed schema; (source_id, content_hash, schema_hash)."""
    old = before.select("source_id", F.col("content_hash").alias("_c"), F.col("schema_hash").alias("_s"), F.lit(True).alias("_was"))
    reason = F.when(F.col("_was").isNull(), "new").when(~F.col("content_hash").eqNullSafe(F.col("_c")), "content").when(~F.col("schema_hash").eqNullSafe(F.col("_s")), "schema")
    return now.join(old, "source_id", "left").select("source_id", reason.alias("reason")).where("reason is not null")


def upsert_sources(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """(source_id, origin, content_hash, change) after incoming (origin, title, text): texts are redacted before they are hashed; a source is found again by its origin, else by its hash, and keeps its id; new ids are the title's slug and eight digits of the hash."""
    clean = incoming.select("origin", "title", F.sha2(T.redact(F.col("text"))[0], 256).alias("content_hash"))
    once = first_wins(clean, "origin", [F.col("content_hash")])
    by_origin = known.select("origin", F.col("source_id").alias("_o"), F.col("content_hash").alias("_h"))
    by_hash = known.groupBy("content_hash").agg(F.min("source_id").alias("_c"))
    met = once.join(by_origin, "origin", "left").join(by_hash, "content_hash", "left")
    fresh = F.concat(T.slugify(F.col("title")), F.lit("-"), F.substring("content_hash", 1, 8))
    # New origins with one text are one source: that of the first of them, the others find it there.
    is_new = F.col("_o").isNull() & F.col("_c").isNull()
    first = met.where(is_new).groupBy("content_hash").agg(F.min(F.struct("origin", fresh.alias("fresh"))).alias("_first"))
    found = met.join(first, "content_hash", "left")
    change = F.when(is_new & (F.col("_first.origin") == F.col("origin")), "created").when(F.col("_o").isNull() | (F.col("_h") == F.col("content_hash")), "unchanged").otherwise("updated")
    return found.select(F.coalesce("_o", "_c", "_first.fresh").alias("source_id"), "origin", "content_hash", change.alias("change"))


def quarantine(rows: DataFrame, problems: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, failed rows with ``problem``): the first of the named conditions that holds sends a row to quarantine."""
    said = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in problems.items()])
    marked = rows.withColumn("problem", said)
    return marked.where("problem is null").drop("problem"), marked.where("problem is not null")


def sync_counts(changes: DataFrame) -> DataFrame:
    """One row of changes (key, change): scanned, imported, updated, removed, skipped."""
    of = lambda c: F.count_if(F.col("change") == c)
    return changes.agg((F.count("*") - of("removed")).alias("scanned"), of("created").alias("imported"), of("updated").alias("updated"), of("removed").alias("removed"), of("unchanged").alias("skipped"))


def embeddable_items(nodes: DataFrame, pages: DataFrame, hyperedges: DataFrame) -> DataFrame:
    """(kind, item_id, text, content_hash): texts of nodes (id, type, label, description), pages (id, title, body) and hyperedges (id, label, why), each once, without blank ones."""
    made = reduce(DataFrame.unionByName, [
        nodes.select(F.lit("node").alias("kind"), F.col("id").alias("item_id"), F.concat_ws("\n", "label", "type", "description").alias("text")), pages.select(F.lit("page"), F.col("id").alias("item_id"), F.concat_ws("\n", "title", "body").alias("text")).withColumnRenamed("page", "kind"),
        hyperedges.select(F.lit("hyperedge").alias("kind"), F.col("id").alias("item_id"), F.concat_ws("\n", "label", "why").alias("text")),
    ])
    return first_wins(made.where(F.trim("text") != ""), ["kind", "item_id"], [F.col("text")]).withColumn("content_hash", F.sha2("text", 256))


def concept_confidence(sources: Column) -> Column:
    return node_confidence(sources)


def crawl(links: DataFrame, start: str, max_pages: int = 50, max_depth: int = 2) -> DataFrame:
    """(url, depth) of at most ``max_pages`` pages of start's host, breadth first over links (url, href), by depth and url. One join a level, on the level's pages only."""
    host = F.lower(F.regexp_extract("href", r"^[a-zA-Z]+://([^/?#]+)", 1))
    inside = links.select("url", F.regexp_replace("href", "#.*$", "").alias("href")).where(host == F.lower(F.regexp_extract(F.lit(start), r"^[a-zA-Z]+://([^/?#]+)", 1))).distinct()
    seen = level = links.sparkSession.createDataFrame([(start, 0)], "url string, depth int")
    for depth in range(1, max_depth + 1):
        left = max_pages - seen.count()
        if left <= 0:
            break
        level = inside.join(level, "url").select(F.col("href").alias("url")).distinct().join(seen, "url", "left_anti").orderBy("url").limit(left).withColumn("depth", F.lit(depth)).checkpoint()
        seen = seen.unionByName(level)
    return seen


def node_type_of(c: Column) -> Column:
    """The node type of another tool's kind."""
    k = F.lower(c)
    return (
        F.when(k.isin("source", "file", "document", "paper", "image", "video"), "source").when(k.isin("module", "code"), "module").when(k.isin("function", "class", "symbol", "method", "component"), "symbol")
        .when(k.isin("entity", "person", "org", "organization"), "entity").when(k.isin("rationale", "comment", "docstring", "why"), "rationale").when(k.isin("decision", "adr"), "decision").otherwise("concept")
    )


def from_node_link(nodes: DataFrame, links: DataFrame) -> Graph:
    """A graph of node-link tables: nodes (id, label, kind), links (source, target, relation, evidence)."""
    evidence = F.lower(F.coalesce("evidence", F.lit("")))
    kept = F.when(evidence.isin("extracted", "ambiguous"), evidence).otherwise("inferred")
    edges = links.select(F.concat("source", F.lit("->"), "target", F.lit(":"), F.coalesce("relation", F.lit("related_to"))).alias("id"), "source", "target", F.coalesce("relation", F.lit("related_to")).alias("relation"), kept.alias("evidence_class"))
    return Graph(nodes.select("id", F.coalesce("label", "id").alias("label"), node_type_of(F.coalesce("kind", F.lit(""))).alias("type")), first_wins(edges, "id", [F.col("evidence_class")]))
