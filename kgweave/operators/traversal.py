"""Search from roots along stored adjacency lists: the nodes, edges and facts around each root.

Edges are stored once by their source and once by their target, as lists of a bounded length in folders of hashed
nodes. Each round of a search writes its frontier and joins it with the folders of the frontier's nodes alone; nothing
of the rounds before is computed again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..session import stored

#: Edges of a list; a node with more has several lists. Folders of hashed nodes.
PIECE, BUCKETS = 512, 64
#: How an edge without a fact of its own is put into words, by its name.
WORDED = {"MENTIONS": "提及: ", "HAS_TOPIC": "关联主题: "}


def _bucket(node: Column) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(BUCKETS)).cast("int")


class Adjacency:
    """Adjacency lists below a folder that driver and executors share. edges: uuid, src, dst, rel, fact."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, edges: DataFrame, sides: tuple[str, ...] = ("out", "in")) -> Adjacency:
        """Edges without a source or target are left out; edges that repeat are kept each."""
        e = edges.where("src IS NOT NULL AND dst IS NOT NULL")
        for side in sides:
            near = {"out": "src", "in": "dst"}[side]
            # the lists of a node with many edges are dealt by the edges' ids
            sizes = e.groupBy(F.col(near).alias("node")).agg(F.ceil(F.count("*") / PIECE).alias("pieces"))
            dealt = e.withColumnRenamed(near, "node").withColumn("other", F.col("dst" if near == "src" else "src")).join(sizes, "node")
            dealt = dealt.withColumn("piece", F.pmod(F.xxhash64("uuid", "other"), F.col("pieces")))
            lists = dealt.groupBy("node", "piece").agg(F.collect_list(F.struct("uuid", "other", "rel", "fact")).alias("edges")).withColumn("bucket", _bucket(F.col("node")))
            lists.repartition("bucket", F.xxhash64("node", "piece") % 4).sortWithinPartitions("bucket", "node").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/{side}")
        return self

    def around(self, front: DataFrame, side: str = "out") -> DataFrame:
        """front (a table with a column node) with its nodes' edges: uuid, other, rel, fact. Reads the folders of its nodes."""
        buckets = [r[0] for r in front.select(_bucket(F.col("node"))).distinct().collect()]  # at most BUCKETS
        lists = self.spark.read.parquet(f"{self.path}/{side}").where(F.col("bucket").isin(buckets)).drop("bucket", "piece")
        return front.join(lists, "node").withColumn("e", F.explode("edges")).select(*front.columns, "e.uuid", "e.other", "e.rel", "e.fact")


def from_roots(graph: Adjacency, roots: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(root, node, hops) and (root, uuid, src, dst, rel, fact, hops) around each root (column root): all edges at the root,
    outgoing ones elsewhere, followed to their targets up to depth hops; nodes and edges once for a root, at their fewest."""
    front = stored(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("hops")).distinct(), "front")
    seen, met = [front], []
    for k in range(depth + 1):
        out = graph.around(front).select("root", "uuid", F.col("node").alias("src"), F.col("other").alias("dst"), "rel", "fact", "hops")
        if k == 0:
            into = graph.around(front, "in").select("root", "uuid", F.col("other").alias("src"), F.col("node").alias("dst"), "rel", "fact", "hops")
            out = out.unionByName(into.where(~F.col("src").eqNullSafe(F.col("dst"))))
        out = stored(out, "edges")
        met.append(out)
        if k == depth:
            break
        found = out.select("root", F.col("dst").alias("node")).distinct()
        front = stored(found.join(reduce(DataFrame.unionByName, seen).select("root", "node"), ["root", "node"], "left_anti").withColumn("hops", F.lit(k + 1)), "front")
        if front.isEmpty():
            break
        seen.append(front)
    # a node is expanded once for a root, so only an edge at the root meets again: from its other end
    edges = reduce(DataFrame.unionByName, met).groupBy("root", "uuid", "src", "dst", "rel", "fact").agg(F.min("hops").alias("hops"))
    return reduce(DataFrame.unionByName, seen), edges


def hops_of(edges: DataFrame) -> DataFrame:
    """One bare edge for all from a node to another: what a search for nodes alone is to be built from."""
    none = F.lit(None).cast("string")
    return edges.select("src", "dst").distinct().select(none.alias("uuid"), "src", "dst", none.alias("rel"), none.alias("fact"))


def nodes_from_roots(graph: Adjacency, roots: DataFrame, depth: int) -> DataFrame:
    """from_roots' nodes alone: the last round's edges and those against the search aren't read. graph needs the outgoing
    lists, best of hops_of's edges."""
    front = stored(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("hops")).distinct(), "front")
    seen = [front]
    for k in range(1, depth + 1):
        found = graph.around(front).select("root", F.col("other").alias("node")).distinct()
        front = stored(found.join(reduce(DataFrame.unionByName, seen).select("root", "node"), ["root", "node"], "left_anti").withColumn("hops", F.lit(k)), "front")
        if front.isEmpty():
            break
        seen.append(front)
    return reduce(DataFrame.unionByName, seen)


def nearest_roots(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """node, ord, root, hops: of the roots (root, ord) within depth hops of a node the first two by ord, with their fewest hops.

    Each round hands a node's two on along its edges (src, dst). No more are needed: a root that is among a node's first
    two is so as well for the nodes on its way there, as all their roots are the node's too."""
    hop = edges.select(F.col("src").alias("node"), "dst")
    now = roots.select(F.col("root").alias("node"), "ord", "root", F.lit(0).alias("hops"))
    best = F.min(F.struct("ord", "root", "hops")).alias("r")
    for _ in range(depth):
        further = now.join(hop, "node").select(F.col("dst").alias("node"), "ord", "root", F.col("hops") + 1)
        met = stored(now.union(further).groupBy("node", "ord", "root").agg(F.min("hops").alias("hops")), "met")
        # minima are summed per task, so a node with many edges is no long group
        first = met.groupBy("node").agg(best)
        second = met.join(first, "node").where(F.col("ord") != F.col("r.ord")).drop("r").groupBy("node").agg(best)
        now = stored(first.union(second).select("node", "r.*"), "nearest")
    return now


def first_edges(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """from_roots' edges of all that facts() can keep, so that their number is that of the edges, not that of roots times
    what each reaches: as edges that say the same are told once, by the first root that meets them.

    edges: uuid, src, dst, rel, fact. roots: root, ord (no two roots have the same). An edge has the first root within
    depth hops of its source and the second, for where the first is its target, and its target, if that is a root; of edges
    that differ by uuid alone the smallest stays."""
    kept = edges.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst", "rel", "fact").agg(F.min(F.struct("uuid")).alias("u"))
    kept = stored(kept.select("u.uuid", "src", "dst", "rel", "fact"), "edges")
    first = roots.groupBy("root").agg(F.min("ord").alias("ord"))
    near = nearest_roots(stored(kept.select("src", "dst").distinct(), "hops"), first, depth)
    columns = ["root", "uuid", "src", "dst", "rel", "fact", "hops"]
    out = kept.join(near.select(F.col("node").alias("src"), "root", "hops"), "src").select(*columns)
    at = first.select(F.col("root").alias("dst"), "root", F.lit(0).alias("hops"))
    return out.unionByName(kept.where("src <> dst").join(at, "dst").select(*columns))


def facts(edges: DataFrame, nodes: DataFrame, roots: DataFrame, only: list[str] | None = None) -> DataFrame:
    """One row for each different fact of from_roots' or first_edges' edges: text, root, score, uuid, rel, src, dst, hops, source, page,
    box, original.

    An edge without a fact is put into words by its name and its target's, if it leads away from the root and, where only
    is given, is of one of these names. Facts are the same where their letters and digits are; the one of the first root
    (by ord) stays, told ones before worded ones, then the nearest, then by edge. nodes: uuid, name, summary, source, page,
    boxes ([page, x0, y0, x1, y1] each); a fact's place is that of its source node, a worded one's that of its target, and
    where these have none that of the root. roots: root, ord, score."""
    n = nodes.select("uuid", "name", "summary", "source", "page", "boxes")
    told = F.coalesce(F.col("fact"), F.lit("")) != ""
    at = F.when(told, F.col("src")).otherwise(F.col("dst"))
    rows = edges.where(told | ((F.coalesce(F.col("rel"), F.lit("")) != "") & (F.col("dst") != F.col("root")) & (F.lit(True) if only is None else F.col("rel").isin(only))))
    rows = rows.withColumns({"told": told, "at": at}).join(roots.select("root", "ord", "score"), "root")
    rows = rows.join(n.select(F.col("uuid").alias("at"), *[F.col(c).alias(f"at_{c}") for c in n.columns[1:]]), "at", "left")
    rows = rows.join(n.select(F.col("uuid").alias("root"), *[F.col(c).alias(f"root_{c}") for c in ("source", "page", "boxes")]), "root", "left")
    words = F.lit(None).cast("string")
    for name, start in WORDED.items():
        words = F.when(F.col("rel") == name, F.concat(F.lit(start), F.coalesce("at_name", F.lit("")))).otherwise(words)
    words = F.coalesce(words, F.concat(F.lit("["), "rel", F.lit("] "), F.coalesce("at_name", F.lit(""))))
    rows = rows.withColumn("text", F.when(told, F.col("fact")).otherwise(words)).withColumn("same", normalize_text(F.col("text"))).where("same <> ''")
    boxed = F.when(F.size("at_boxes") > 0, F.get("at_boxes", F.lit(0)))
    root_box = F.when(F.size("root_boxes") > 0, F.get("root_boxes", F.lit(0)))
    box = F.coalesce(F.when(F.size(boxed) >= 5, boxed), F.when(F.size(root_box) >= 5, root_box))
    place = F.struct(
        "ord", (~F.col("told")).cast("int").alias("worded"), "hops", "uuid", "text", "root", "score", "rel", "src", "dst", F.coalesce("at_source", "root_source", F.lit("Graph")).alias("source"),
        F.coalesce(F.get(F.when(F.size(boxed) >= 5, boxed), F.lit(0)).cast("int"), F.col("at_page"), F.col("root_page")).alias("page"), F.slice(box, 2, 4).alias("box"), F.when(F.col("told"), F.lit("")).otherwise(F.coalesce("at_summary", F.lit(""))).alias("original"),
    )
    first = rows.groupBy("same").agg(F.min(place).alias("f"))
    return first.select(*[f"f.{c}" for c in ("text", "root", "score", "uuid", "rel", "src", "dst", "hops", "source", "page", "box", "original")])


def typed(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """from_roots' nodes with name, labels and summary; nodes that aren't known are left out."""
    return rows.join(nodes.select(F.col("uuid").alias("node"), "name", "labels", "summary"), "node").select("root", "node", "hops", "name", "labels", "summary")
