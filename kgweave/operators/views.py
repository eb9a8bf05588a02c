"""Views of graphs and clauses as callers see them: canonical nodes and edges, name search, provenance, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import both_ways, of_graph
from .tabular import keep_one

#: Labels that a caller may name.
LABELS = ("Entity", "Topic", "Clause", "Image", "Table", "Term", "Episode")
#: Columns that a search by name looks at besides name and topic, by label.
SEARCHED = {"Clause": ("clause_id",), "Image": ("caption", "img_path"), "Table": ("caption", "table_id", "table_content")}
#: Labels that a search looks at when none is named.
DEFAULT_SEARCHED = ("Entity", "Topic", "Clause", "Image", "Table")
#: Properties in the order in which they are shown; others follow by name.
PROPERTY_ORDER = (
    "name", "type", "labels", "uuid", "summary", "topic", "data", "definition", "attributes", "clause_id", "pdf_source", "pdf_page",
    "pdf_bbox", "pdf_bboxes", "pdf_page_width", "pdf_page_height", "created_at", "graph_id",
)


def filled(c: Column | str) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def valid_labels(wanted: list) -> list[str]:
    """Those of the wanted labels that may be named, without white space around."""
    return [w.strip() for w in wanted if isinstance(w, str) and w.strip().isalnum() and w.strip() in LABELS]


def node_view(nodes: DataFrame) -> DataFrame:
    """uuid, name, labels, summary, data: clauses, images and tables under that label alone and by their own names.

    nodes: uuid, labels (array), name, summary, data, clause_id, caption, img_path, table_id. A clause is named by its
    id, else by the first 50 characters of its data; images and tables by caption, else path or table id."""
    has = lambda label: F.array_contains("labels", label)
    name = (
        F.when(has("Clause"), F.coalesce(filled("clause_id"), F.substring("data", 1, 50), F.lit("")))
        .when(has("Image"), F.coalesce(filled("caption"), "img_path", F.lit("")))
        .when(has("Table"), F.coalesce(filled("caption"), "table_id", F.lit("")))
        .otherwise(F.coalesce("name", F.lit("")))
    )
    labels = F.when(has("Clause"), F.array(F.lit("Clause"))).when(has("Image"), F.array(F.lit("Image"))).when(has("Table"), F.array(F.lit("Table"))).otherwise(F.coalesce("labels", F.array().cast("array<string>")))
    return nodes.select("uuid", name.alias("name"), labels.alias("labels"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("summary", "data")])


def edge_view(edges: DataFrame) -> DataFrame:
    """uuid, name (the relation's where there is none), fact, ends, and whether the fact is expired or invalid."""
    name = F.coalesce(filled("name"), filled("rel"), F.lit(""))
    flags = [F.col(c).isNotNull().alias(f"is_{c.removesuffix('_at')}") for c in ("expired_at", "invalid_at")]
    return edges.select("uuid", name.alias("name"), F.coalesce("fact", F.lit("")).alias("fact"), "src", "dst", *flags)


def search_by_name(nodes: DataFrame, query: str, labels: list | None = None, limit: int = 20, graph: str | None = None) -> DataFrame:
    """Nodes of the labels (of all searchable ones, where none is named) with the query in a column of theirs, whatever
    the case; the first by uuid. A blank query finds nothing, nor do labels that may not be named."""
    keyword = query.strip().lower()
    wanted = list(DEFAULT_SEARCHED) if not labels else valid_labels(labels)
    if not keyword or not wanted:
        return nodes.where("false")
    said = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(keyword)), F.lit(False))
    hits = [said("name") | said("topic")]
    hits += [F.array_contains("labels", label) & reduce(lambda a, b: a | b, map(said, SEARCHED[label])) for label in wanted if label in SEARCHED]
    some = F.arrays_overlap("labels", F.array(*map(F.lit, wanted)))
    return of_graph(nodes, graph).where(some & reduce(lambda a, b: a | b, hits)).orderBy("uuid").limit(limit)


def episodes(table: DataFrame, uuids: list[str] | None = None) -> DataFrame:
    """uuid, text, source, page and metadata (a map; empty where its JSON doesn't parse) of the named episodes,
    of all where none is named."""
    meta = F.coalesce(F.from_json("metadata_json", "map<string, string>"), F.create_map().cast("map<string, string>"))
    named = table if uuids is None else table.where(F.col("uuid").isin(list(uuids)))
    return named.select("uuid", F.col("data").alias("text"), "source", "page", meta.alias("metadata"))


def node_episodes(mentions: DataFrame, table: DataFrame, limit: int = 3) -> DataFrame:
    """node, uuid, text, source, page: of each node the first episodes, by uuid, that mention it.

    mentions: node, episode."""
    from .tabular import top_per_group

    found = mentions.distinct().join(table.withColumnRenamed("uuid", "episode"), "episode")
    first = top_per_group(found, ["node"], [F.col("episode")], limit)
    return first.select("node", F.col("episode").alias("uuid"), F.col("data").alias("text"), "source", "page")


def clauses_by_id(clauses: DataFrame, ids: list) -> DataFrame:
    """Clauses with the given ids; white space around ids doesn't count, blank ones are dropped."""
    wanted = sorted({i.strip() for i in ids if i and i.strip()})
    return clauses.where(F.trim("clause_id").isin(wanted)) if wanted else clauses.where("false")


def node_edges(edges: DataFrame, node: str) -> DataFrame:
    """Edges at a node, either way, and whether they leave it. Two equality filters, each of which prunes files."""
    out = edges.where(F.col("src") == node).withColumn("outgoing", F.lit(True))
    return out.unionByName(edges.where((F.col("dst") == node) & (F.col("src") != node)).withColumn("outgoing", F.lit(False)))


def neighbour_descriptions(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """description, node: what one hop around a node says, each text once. edges: src, dst, rel, name; nodes: uuid,
    name, summary."""
    said = F.coalesce(filled("edge"), filled("rel"), F.lit("related"))
    around = edges.where((F.col("src") == node) | (F.col("dst") == node)).where("src <> dst").select("src", "dst", "rel", F.col("name").alias("edge"))
    ends = [nodes.select(F.col("uuid").alias(end), F.col("name").alias(f"{end}_name"), F.col("summary").alias(f"{end}_summary")) for end in ("src", "dst")]
    both = around.join(ends[0], "src").join(ends[1], "dst")
    other = lambda what: F.when(F.col("src") == node, F.col(f"dst_{what}")).otherwise(F.col(f"src_{what}"))
    line = F.concat(F.lit("["), "src_name", F.lit("] --("), said, F.lit(")--> ["), "dst_name", F.lit("]: "), F.coalesce(filled(other("summary")), F.lit("no summary")))
    return both.select(line.alias("description"), other("name").alias("node")).distinct()


def merged_graphs(graphs: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Nodes by uuid and edges by uuid, target and name of several graphs, each once, from the first that has it."""
    stack = lambda k: reduce(DataFrame.unionByName, [g[k].withColumn("_graph", F.lit(n)) for n, g in enumerate(graphs)])
    nodes = keep_one(stack(0), ["uuid"], [F.col("_graph")])
    edges = keep_one(stack(1), ["uuid", "dst", "name"], [F.col("_graph"), F.col("src")])
    return nodes.drop("_graph"), edges.drop("_graph")


def type_legend(nodes: DataFrame) -> DataFrame:
    """type, n: nodes by their first label that isn't Entity, else Entity."""
    kind = F.coalesce(F.get(F.filter("labels", lambda x: x != "Entity"), F.lit(0)), F.lit("Entity"))
    return nodes.groupBy(kind.alias("type")).agg(F.count("*").alias("n"))


def root_type(labels: Column) -> Column:
    """Term where the row's root is one, else Entity."""
    return F.when(F.array_contains(labels, "Term"), "Term").otherwise("Entity")


def of_root_types(rows: DataFrame, wanted: list[str], labels: str = "labels") -> DataFrame:
    """Rows with their root_type, of the wanted types."""
    return rows.withColumn("root_type", root_type(F.coalesce(labels, F.array().cast("array<string>")))).where(F.col("root_type").isin(wanted))


def hit_summary(rows: DataFrame) -> DataFrame:
    """One row: roots, Terms and Entities among them, distinct topics and facts. rows: labels, topics, facts (arrays)."""
    size = lambda c: F.greatest(F.size(F.coalesce(c, F.array().cast("array<string>"))), F.lit(0))
    term = F.array_contains("labels", "Term")
    totals = rows.agg(F.count("*").alias("n_rows"), F.count_if(term).alias("n_terms"), F.count_if(F.array_contains("labels", "Entity") & ~term).alias("n_entities"), F.coalesce(F.sum(size("facts")), F.lit(0)).alias("n_facts"))
    topics = rows.select(F.explode("topics").alias("t")).agg(F.count_distinct("t").alias("n_topics"))
    return totals.crossJoin(F.broadcast(topics))  # one row each


def facts_by_source(facts: DataFrame, order: str) -> DataFrame:
    """source, facts (position from 0 and text, in order); facts without a source under Unknown.

    facts: a query's result, numbered over all of it."""
    from .ordered import numbered

    each = numbered(facts, [], [order]).select(F.coalesce(filled("source"), F.lit("Unknown")).alias("source"), F.struct((F.col("place") - 1).alias("place"), "fact").alias("f"))
    return each.groupBy("source").agg(F.sort_array(F.collect_list("f")).alias("facts"))


def best_over_graphs(rows: DataFrame, score: str, key: str) -> DataFrame:
    """Rows of several graphs by score."""
    return rows.orderBy(F.desc(score), key)


def shown_properties(nodes: DataFrame, key: str, properties: list[str]) -> DataFrame:
    """key, prop, val, place: the properties of text that aren't blank, in the order in which they are shown."""
    from pyspark.sql import Window as W

    ranks = F.array(*map(F.lit, PROPERTY_ORDER))
    rows = nodes.select(key, *properties).unpivot([key], properties, "prop", "val").where(F.trim("val") != "")
    at = F.array_position(ranks, F.col("prop"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.when(at == 0, len(PROPERTY_ORDER) + 1).otherwise(at), "prop")))


def expired_partition(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Active and expired facts of each key."""
    gone = F.col("expired_at").isNotNull() | F.col("invalid_at").isNotNull()
    return facts.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(gone).alias("expired"), F.count_if(~gone).alias("active"))


def curvatures(edges: DataFrame, order: str) -> DataFrame:
    """edges (src, dst, ...) with place and curvature among those of an unordered pair: spread evenly, 0 for single ones,
    turned where the edge runs from the larger end."""
    from pyspark.sql import Window as W

    pair = W.partitionBy(F.least("src", "dst"), F.greatest("src", "dst"))
    place, n = F.row_number().over(pair.orderBy(order)) - 1, F.count("*").over(pair)
    spread = F.least(F.lit(1.2), 0.6 + n * 0.15)
    bend = F.when(n > 1, (place / (n - 1) - 0.5) * spread * 2).otherwise(0.0)
    return edges.withColumn("place", place).withColumn("curvature", F.when(F.col("src") > F.col("dst"), -bend).otherwise(bend))


def mapped_progress(done: Column, total: Column) -> Column:
    """Per cent of a build that runs from 15 to 75."""
    return 15 + F.floor(F.when(total > 0, done / total).otherwise(0.0) * 60)


def degrees(edges: DataFrame) -> DataFrame:
    """node, n: edges at each node, loops once."""
    return both_ways(edges.where("src <> dst")).union(both_ways(edges.where("src = dst")).distinct()).groupBy("node").agg(F.count("*").alias("n"))
