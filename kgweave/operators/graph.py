"""Property-graph operators: typed edge and node tables, expands, paths, neighbourhoods, traversal.

Edges: graph_id, src, rel, dst. Nodes: graph_id, uuid, label, name (and more). Every operator filters by
graph first, so tenants never meet; with tables partitioned by graph_id that prunes files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored


def of_graph(df: DataFrame, graph: str | None) -> DataFrame:
    return df if graph is None else df.where(F.col("graph_id") == graph)


def scan(nodes: DataFrame, graph: str | None = None, labels: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """Nodes of a graph by labels to have and not to have; labels is an array column."""
    out = of_graph(nodes, graph)
    for keep, names in ((True, labels or []), (False, without or [])):
        for name in names:
            hit = F.array_contains("labels", name)
            out = out.where(hit if keep else ~hit)
    return out


def union_distinct(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).distinct()


def lookup(df: DataFrame, key: str, wanted: DataFrame | list) -> DataFrame:
    """Rows with the wanted keys: a short list becomes a pushed filter, a table a semi-join."""
    return df.join(wanted, key, "left_semi") if isinstance(wanted, DataFrame) else df.where(F.col(key).isin([w.strip() if isinstance(w, str) else w for w in wanted if str(w).strip()]))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge seen from either end: node, other, outgoing, rel."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(True).alias("outgoing"), "rel").union(edges.select("dst", "src", F.lit(False), "rel"))


def expand(starts: DataFrame, key: str, edges: DataFrame, rel: str, forward: bool = True, to: str = "other") -> DataFrame:
    """starts with the nodes at the other end of their edges of a kind."""
    near, far = ("src", "dst") if forward else ("dst", "src")
    hop = edges.where(F.col("rel") == rel).select(F.col(near).alias(key), F.col(far).alias(to)).distinct()
    return starts.join(hop, key)


def two_hop_paths(roots: DataFrame, mentions: DataFrame, has_topic: DataFrame) -> DataFrame:
    """root, topic, clause for Entity <- Topic <- Clause; roots without a path keep a row of nulls.

    roots: root. mentions: topic, root. has_topic: clause, topic. Inner joins on equal keys, then one
    outer join back to the roots; whichever side measures small is broadcast by the planner."""
    paths = roots.select("root").join(mentions, "root").join(has_topic, "topic")
    return roots.join(paths, "root", "left")


def collect_related(starts: DataFrame, key: str, related: DataFrame, groups: dict[str, Column], value: Column) -> DataFrame:
    """starts with one sorted array of distinct values per named condition; empty arrays where there is none."""
    rows = related.groupBy(key).agg(*[F.sort_array(F.collect_set(F.when(cond, value))).alias(name) for name, cond in groups.items()])
    out = starts.join(rows, key, "left")
    kind = dict(rows.dtypes)
    return out.withColumns({n: F.coalesce(F.col(n), F.array().cast(kind[n])) for n in groups})


def neighbourhood(edges: DataFrame, start, src: tuple[str, ...] = ("src",), dst: tuple[str, ...] = ("dst",)) -> DataFrame:
    """node, hops (1 or 2) around a start, either direction, without the start itself; the fewest hops win.

    src and dst: the columns that name an edge's ends; where they are several (a kind and a key, say), start is a tuple of
    as many values and node a struct. Compared as they are stored, the start's columns reach the scan."""
    start = start if isinstance(start, tuple) else (start,)
    near, far = [f"near{k}" for k in range(len(start))], [f"far{k}" for k in range(len(start))]
    one_way = lambda a, b: edges.select(*[F.col(c).alias(n) for c, n in zip((*a, *b), (*near, *far), strict=True)])
    around = one_way(src, dst).unionByName(one_way(dst, src))
    at_start = lambda names: reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.lit(v)) for n, v in zip(names, start, strict=True)])
    one = around.where(at_start(near) & ~at_start(far)).select(*far).distinct()
    two = around.join(one.toDF(*near), near, "left_semi").select(*far).where(~at_start(far))
    found = one.withColumn("hops", F.lit(1)).union(two.withColumn("hops", F.lit(2))).groupBy(*far).agg(F.min("hops").alias("hops"))
    return found.select((F.struct(*[F.col(f).alias(c) for f, c in zip(far, src, strict=True)]) if len(far) > 1 else F.col(far[0])).alias("node"), "hops")


def reach(edges: DataFrame, starts: DataFrame, depth: int, either_way_first: bool = False) -> DataFrame:
    """root, node, hops: nodes along outgoing edges within so many hops; each with its fewest. With either_way_first the
    first hop also goes against its edges, as entities are named by topics and name nothing themselves. Nodes are of any
    type; short ones shuffle less. Edges without a target lead nowhere.

    What a node reaches is found once, however many roots come by it: first which nodes are as many hops from any root,
    then, from the furthest back, what each reaches in the hops that are left. Each step is kept as a table."""
    hop = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    if depth < 1:
        return starts.select("root", F.col("root").alias("node"), F.lit(0).alias("hops")).limit(0)
    first = hop.union(hop.select("next", "node")) if either_way_first else hop
    roots = starts.select(F.col("root").alias("node")).distinct()
    steps = [first.join(roots, "node", "left_semi")]
    for _ in range(1, depth):
        # nodes that lead nowhere end here
        steps[-1] = stored(steps[-1].distinct(), "steps")
        steps.append(hop.join(steps[-1].select(F.col("next").alias("node")).distinct(), "node", "left_semi"))
    reached = steps[-1].select("node", F.col("next").alias("to"), F.lit(1).alias("hops"))
    for k, step in enumerate(reversed(steps[:-1])):
        reached = stored(reached.distinct() if k == 0 else reached, "reached")
        further = step.join(reached.withColumnRenamed("node", "next"), "next").select("node", "to", F.col("hops") + 1)
        reached = step.select("node", F.col("next").alias("to"), F.lit(1)).union(further).toDF("node", "to", "hops").groupBy("node", "to").agg(F.min("hops").alias("hops"))
    reached = reached if depth > 1 else reached.distinct()
    return reached.where("node <> to").select(F.col("node").alias("root"), F.col("to").alias("node"), "hops")


def edges_within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are both among nodes (uuid)."""
    return edges.join(nodes.select(F.col("uuid").alias("src")), "src", "left_semi").join(nodes.select(F.col("uuid").alias("dst")), "dst", "left_semi")


def edges_touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with either end among nodes, once each."""
    a = edges.join(nodes.select(F.col("uuid").alias("src")), "src", "left_semi")
    b = edges.join(nodes.select(F.col("uuid").alias("dst")), "dst", "left_semi")
    return a.select(*edges.columns).union(b.select(*edges.columns)).distinct()


def name_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends' names; unknown ends are called so."""
    n = nodes.select("uuid", "name")
    out = edges.join(n.select(F.col("uuid").alias("src"), F.col("name").alias("src_name")), "src", "left").join(n.select(F.col("uuid").alias("dst"), F.col("name").alias("dst_name")), "dst", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("Unknown")) for c in ("src_name", "dst_name")})


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind (node or edge), type, n."""
    a = nodes.groupBy(F.col("label").alias("type")).agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "type", "n")
    b = edges.groupBy(F.col("rel").alias("type")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "type", "n")
    return a.union(b)


def delete_graph(df: DataFrame, graph: str) -> DataFrame:
    """Without the graph's rows; rows of no graph stay."""
    return df.where(~F.col("graph_id").eqNullSafe(F.lit(graph)))


def entity_type(labels: Column) -> Column:
    """The first label that is neither Entity nor Node."""
    return F.get(F.filter(labels, lambda x: ~x.isin("Entity", "Node")), F.lit(0))


def relabel(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rows labelled old become new, unless a row labelled new has their uuid already."""
    stay = df.where(F.col("label") != old)
    clash = stay.where(F.col("label") == new).select("uuid")
    return stay.unionByName(df.where(F.col("label") == old).join(clash, "uuid", "left_anti").withColumn("label", F.lit(new)).select(*df.columns))


def build_document_graph(clauses: DataFrame, graph: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of clauses (clause_id, title, content, topics array<struct<topic, entities>>,
    terms array<struct<term_name, definition>>, images array<struct<img_path, caption>>,
    referenced_tables array<struct<table_id, caption, chunk_id>>, referenced_clauses array<string>).

    Clause -HAS_TOPIC-> Topic -MENTIONS-> Entity / Term, Clause -MENTIONS-> Image / Table, Clause
    -CROSS_REFERENCE-> Clause, Clause -PART_OF-> parent. A clause's terms belong to its first topic with a
    name. All edges are kept, whichever clause named an entity before."""
    from ..functions.ids import node_id
    from ..functions.text import parent_id

    g = F.lit(graph)
    c = clauses.withColumn("clause", node_id("clause", g, F.col("clause_id")))
    topics = c.select("clause", "clause_id", F.posexplode("topics").alias("ord", "t")).where(F.trim("t.topic") != "").select("clause", "clause_id", "ord", F.col("t.topic").alias("topic"), F.col("t.entities").alias("entities")).withColumn("uuid", node_id("topic", g, F.col("clause_id"), F.col("topic")))
    entities = topics.select("uuid", F.explode("entities").alias("name")).where(F.trim("name") != "").select(F.col("uuid").alias("src"), F.trim("name").alias("name")).withColumn("dst", node_id("entity", g, F.col("name")))
    first = topics.groupBy("clause").agg(F.min_by("uuid", "ord").alias("src"))
    terms = c.select("clause", F.explode("terms").alias("t")).where(F.trim("t.term_name") != "").select("clause", F.col("t.term_name").alias("name"), F.col("t.definition").alias("summary")).withColumn("dst", node_id("term", g, F.col("name"))).join(first, "clause", "left")
    images = c.select("clause", F.explode("images").alias("i")).select("clause", F.col("i.caption").alias("name"), node_id("image", g, F.col("i.img_path")).alias("dst"))
    tables = c.select("clause", F.explode("referenced_tables").alias("t")).select("clause", F.coalesce(F.nullif("t.caption", F.lit("")), "t.table_id").alias("name"), node_id("table", g, F.coalesce(F.nullif("t.table_id", F.lit("")), "t.chunk_id")).alias("dst"))
    refs = c.select("clause", "clause_id", F.explode("referenced_clauses").alias("ref")).where("ref <> clause_id").join(c.select(F.col("clause_id").alias("ref"), F.col("clause").alias("dst")), "ref")
    parents = c.select("clause", parent_id(F.col("clause_id")).alias("ref")).join(c.select(F.col("clause_id").alias("ref"), F.col("clause").alias("dst")), "ref")
    node = lambda df, uuid, label, name, summary=None: df.select(g.alias("graph_id"), F.col(uuid).alias("uuid"), F.lit(label).alias("label"), F.col(name).alias("name"), (F.col(summary) if summary else F.lit(None).cast("string")).alias("summary"))
    nodes = reduce(DataFrame.unionByName, [node(c, "clause", "Clause", "clause_id", "content"), node(topics, "uuid", "Topic", "topic"), node(entities, "dst", "Entity", "name"), node(terms, "dst", "Term", "name", "summary"), node(images, "dst", "Image", "name"), node(tables, "dst", "Table", "name")])
    nodes = nodes.groupBy("graph_id", "uuid", "label").agg(F.min("name").alias("name"), F.max("summary").alias("summary"))
    edge = lambda df, src, rel, dst: df.where(F.col(src).isNotNull()).select(g.alias("graph_id"), F.col(src).alias("src"), F.lit(rel).alias("rel"), F.col(dst).alias("dst"))
    edges = reduce(DataFrame.unionByName, [edge(topics, "clause", "HAS_TOPIC", "uuid"), edge(entities, "src", "MENTIONS", "dst"), edge(terms, "src", "MENTIONS", "dst"), edge(images, "clause", "MENTIONS", "dst"), edge(tables, "clause", "MENTIONS", "dst"), edge(refs, "clause", "CROSS_REFERENCE", "dst"), edge(parents, "clause", "PART_OF", "dst")]).distinct()
    return nodes, edges


def named_references(clauses: DataFrame, graph: str) -> DataFrame:
    """graph_id, src, rel, ref: the clauses that clauses name, and their parents, by number, whether or not they are there."""
    from ..functions.ids import node_id
    from ..functions.text import parent_id

    g = F.lit(graph)
    c = clauses.select(g.alias("graph_id"), node_id("clause", g, F.col("clause_id")).alias("src"), "clause_id", "referenced_clauses")
    refs = c.select("graph_id", "src", F.lit("CROSS_REFERENCE").alias("rel"), F.explode("referenced_clauses").alias("ref"), "clause_id").where("ref <> clause_id").drop("clause_id")
    parents = c.select("graph_id", "src", F.lit("PART_OF").alias("rel"), parent_id(F.col("clause_id")).alias("ref")).where("ref IS NOT NULL")
    return refs.unionByName(parents).distinct()


GRAPHS = "graph_id string, name string, description string, ontology_json string, created_at string"


def created_graph(graphs: DataFrame, name: str, at: str, description: str = "") -> DataFrame:
    """graphs (GRAPHS) with one more, whose id is made from its name and time; again the same leaves it as it is."""
    from ..functions.ids import uuid_of

    row = graphs.sparkSession.createDataFrame([(name, description, "{}", at)], "name string, description string, ontology_json string, created_at string")
    new = row.withColumn("graph_id", uuid_of(F.lit("graph"), F.col("name"), F.col("created_at"))).select(*graphs.columns)
    return graphs.unionByName(new.join(graphs.select("graph_id"), "graph_id", "left_anti").select(*graphs.columns))


def with_ontology(graphs: DataFrame, graph: str, ontology: str) -> DataFrame:
    """graphs with one graph's ontology set."""
    return graphs.withColumn("ontology_json", F.when(F.col("graph_id") == graph, F.lit(ontology)).otherwise(F.col("ontology_json")))


def merged_clause(nodes: DataFrame, edges: DataFrame, clause: DataFrame, graph: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after one clause (a row as build_document_graph takes it) was written or written again."""
    from .tabular import add_edges, upsert

    n, e = build_document_graph(clause, graph)
    return upsert(nodes, n, ["graph_id", "uuid", "label"], {"name": "keep_nonempty"}), add_edges(edges, e, ["graph_id", "src", "rel", "dst"])


def synced_terms(nodes: DataFrame, edges: DataFrame, graph: str, clause_id: str, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after a clause's terms (term_name, definition) were set: a Term node for each named one, with its
    definition, and DEFINES from it to the clause. Nothing is taken away."""
    from ..functions.ids import node_id
    from .tabular import add_edges, upsert

    g = F.lit(graph)
    t = terms.where(F.coalesce("term_name", F.lit("")) != "").select(g.alias("graph_id"), node_id("term", g, F.col("term_name")).alias("uuid"), F.lit("Term").alias("label"), F.col("term_name").alias("name"), F.col("definition").alias("summary"))
    t = t.groupBy("graph_id", "uuid", "label", "name").agg(F.max("summary").alias("summary"))
    e = t.select("graph_id", F.col("uuid").alias("src"), F.lit("DEFINES").alias("rel"), node_id("clause", g, F.lit(clause_id)).alias("dst"))
    return upsert(nodes, t.select(*nodes.columns), ["graph_id", "uuid", "label"], {}), add_edges(edges, e, ["graph_id", "src", "rel", "dst"])
