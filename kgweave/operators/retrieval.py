"""Retrieval flows over a document graph: multi-root path search, intent match, rerank and its threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from .graph import two_hop_paths
from .tabular import keep_one, top_per_group

#: Most facts that one reranking takes.
RERANK_CAP = 50


def batch_path_search(roots: DataFrame, mentions: DataFrame, has_topic: DataFrame, facts: DataFrame, limit: int, query: str = "") -> DataFrame:
    """Ranked roots with their facts.

    roots: root, name, type_ord, root_ord, score. facts: clause, fact. A fact text, normalised, belongs to the
    first root that reaches it, in the order of type, root, topic and clause; roots without facts go. Each type
    keeps its `limit` roots with the most facts; a root named like the query comes first."""
    paths = two_hop_paths(roots.select("root"), mentions, has_topic).where("clause is not null").join(facts, "clause").join(roots.select("root", "type_ord", "root_ord"), "root")
    order = [F.col(c) for c in ("type_ord", "root_ord", "topic", "clause")]
    once = keep_one(paths.withColumn("seen", normalize_text(F.col("fact"))), ["seen"], order)
    counted = once.groupBy("root").agg(F.count("*").alias("n_facts"), F.countDistinct("topic").alias("n_topics"))
    rows = roots.join(counted, "root")
    ranked = top_per_group(rows, ["type_ord"], [F.desc("n_facts"), F.col("root_ord")], limit)
    same = F.lower(F.trim("name")) == query.strip().lower()
    place = F.row_number().over(W.orderBy(F.when(same, 0).otherwise(1), "type_ord", "rank"))
    return ranked.withColumn("place", place).drop("rank")


def rerank(facts: DataFrame, score: Column, cap: int = RERANK_CAP, order: list[Column] | None = None) -> DataFrame:
    """The first `cap` facts with a score in per cent to one digit, half to even; missing scores are 0."""
    first = facts.orderBy(*order).limit(cap) if order else facts.limit(cap)
    return first.withColumn("score", F.bround(F.coalesce(score, F.lit(0.0)) * 100, 1))


def retrieval_flow(facts: DataFrame, score: Column, at_least: float, top: int, ord_col: str = "ord") -> DataFrame:
    """Facts (root, fact, ord) once per text and root, reranked, by score down to a threshold, at most so many;
    all scored ones where none reaches it."""
    once = keep_one(facts, ["fact", "root"], [F.col(ord_col)])
    scored = rerank(once, score, order=[F.col(ord_col)])
    reached = F.max((F.col("score") >= at_least).cast("int")).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    kept = scored.withColumn("_any", reached).where((F.col("score") >= at_least) | (F.col("_any") == 0)).drop("_any")
    return kept.orderBy(F.desc("score"), ord_col).limit(top)


def intent_match(topics: DataFrame, topic_entity: DataFrame, topic_clause: DataFrame, entity_score: DataFrame, topic_limit: int, entity_limit: int) -> DataFrame:
    """topics: topic, score. Best topics with their entities (best entity_limit over all topics, then per topic)
    and clauses in order of their id, each once."""
    best = topics.orderBy(F.desc("score"), "topic").limit(topic_limit)
    pairs = best.join(topic_entity, "topic").join(entity_score, "entity", "left").withColumn("entity_score", F.coalesce("entity_score", F.lit(0.0)))
    allowed = pairs.select("entity", "entity_score").distinct().orderBy(F.desc("entity_score"), "entity").limit(entity_limit)
    named = top_per_group(pairs.join(allowed.select("entity"), "entity", "left_semi"), ["topic"], [F.desc("entity_score"), F.col("entity")], entity_limit)
    entities = named.groupBy("topic").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "entity"))), lambda s: s["entity"].cast("string")), ",").alias("entities"))
    clauses = best.join(topic_clause, "topic").groupBy("topic").agg(F.count_distinct("clause").alias("n_clauses"), F.min("clause").alias("first_clause"))
    return best.join(entities, "topic", "left").join(clauses, "topic", "left")


def intent_details(topics: DataFrame, nodes: DataFrame, edges: DataFrame, entity_score: DataFrame, topic_limit: int, entity_limit: int) -> DataFrame:
    """topic, kind (entity, clause, table, image), place (from 1), uuid, of, name, score: all that hangs on the best topics.

    topics: topic, score. nodes: uuid, label, name, clause_id. edges: src, rel, dst. entity_score: uuid, score, of the
    reranker. A topic's entities and terms come by score, at most entity_limit; only the entity_limit best of all topics
    have one, the others 0. Its clauses come by clause_id, each id once (a clause without one by itself); the tables and
    images that they mention come with the clause they are of. Each node once for a topic, or for a clause."""
    best = topics.orderBy(F.desc("score"), "topic").limit(topic_limit).select("topic")
    n = nodes.select("uuid", "label", "name", "clause_id")
    ends = edges.select("src", "rel", "dst").distinct()
    named = best.join(ends.where("rel = 'MENTIONS'"), F.col("topic") == F.col("src")).select("topic", F.col("dst").alias("uuid")).join(n.where(F.col("label").isin("Entity", "Term")), "uuid")
    top = named.select("uuid").distinct().join(entity_score, "uuid").orderBy(F.desc("score"), "uuid").limit(entity_limit)
    entities = named.join(top, "uuid", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    entities = top_per_group(entities, ["topic"], [F.desc("score"), F.col("uuid")], entity_limit)
    of = F.lit(None).cast("string").alias("of")
    out = entities.select("topic", F.lit("entity").alias("kind"), F.col("rank").alias("place"), "uuid", of, "name", "score")
    held = best.join(ends.where("rel = 'HAS_TOPIC'"), F.col("topic") == F.col("dst")).select("topic", F.col("src").alias("uuid")).join(n.where("label = 'Clause'"), "uuid")
    once = keep_one(held.withColumn("key", F.coalesce(F.nullif("clause_id", F.lit("")), F.concat(F.lit(":"), "uuid"))), ["topic", "key"], [F.col("uuid")])
    clauses = once.withColumn("place", F.row_number().over(W.partitionBy("topic").orderBy(F.asc_nulls_last(F.nullif("clause_id", F.lit(""))), "uuid")))
    nothing = F.lit(None).cast("double").alias("score")
    out = out.unionByName(clauses.select("topic", F.lit("clause").alias("kind"), "place", "uuid", of, "name", nothing))
    shown = clauses.select("topic", F.col("uuid").alias("of")).join(ends.where("rel = 'MENTIONS'"), F.col("of") == F.col("src")).select("topic", "of", F.col("dst").alias("uuid")).join(n.where(F.col("label").isin("Table", "Image")), "uuid")
    place = F.row_number().over(W.partitionBy("topic", "of", "label").orderBy("uuid"))
    return out.unionByName(shown.select("topic", F.lower("label").alias("kind"), place.alias("place"), "uuid", "of", "name", nothing))


def attached(rows: DataFrame, facts: DataFrame, key: str = "root", every: bool = False) -> DataFrame:
    """rows with the facts (struct of score, ord, fact; by score, then ord) that a retrieval flow kept of them; rows without
    any go, unless every row is wanted."""
    best = facts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("off"), "ord", "fact", "score"))).alias("kept"))
    told = best.select(key, F.transform("kept", lambda f: F.struct(f["score"].alias("score"), f["ord"].alias("ord"), f["fact"].alias("fact"))).alias("facts"))
    return rows.join(told, key, "left" if every else "inner")


def fact_location(facts: DataFrame) -> DataFrame:
    """page and box of facts (clause_boxes, own_boxes, episode_boxes arrays of [page, x0, y0, x1, y1]; root_page):
    the first of the three that has a box of five numbers, else the root's page alone."""
    chain = [F.get(F.col(c), 0) for c in ("clause_boxes", "own_boxes", "episode_boxes")]
    box = F.coalesce(*[F.when(F.size(b) >= 5, b) for b in chain])
    return facts.withColumn("page", F.coalesce(F.get(box, 0).cast("int"), F.col("root_page"))).withColumn("box", F.when(box.isNotNull(), F.slice(box, 2, 4)))


def coarse_scores(df: DataFrame, name: str, query: str, n_facts: str) -> DataFrame:
    """df with score: name match 50 / 35 / 20 / 0, up to 30 for facts against the most of any row, and 20."""
    n, q = F.lower(F.trim(name)), F.lit(query.strip().lower())
    match = F.when(n == q, 50).when(F.contains(n, q), 35).when(F.contains(q, n), 20).otherwise(0)
    most = df.agg(F.greatest(F.max(n_facts), F.lit(1)).alias("_most"))  # one row
    return df.crossJoin(F.broadcast(most)).withColumn("score", match + 30 * F.col(n_facts) / F.col("_most") + 20).drop("_most")


def answer_lines(facts: DataFrame, order: str) -> DataFrame:
    """Numbered facts with source and page, and a link with the boxes in it."""
    n = F.row_number().over(W.orderBy(order))
    return facts.withColumn("line", F.format_string("[%d] %s (%s, P%s)", n, F.col("fact"), F.coalesce("source", F.lit("")), F.coalesce(F.col("page").cast("string"), F.lit("?")))).withColumn("link", F.concat(F.lit("?page="), F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit("&bboxes="), F.url_encode(F.to_json(F.coalesce("boxes", F.array().cast("array<array<double>>"))))))
