"""Ties between clauses, chunks, tables and elements: backfills, cascades of candidates, lookups, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import grams, ngrams, strip
from ..session import stored
from .tabular import keep_one

DOTTED = r"(?U)\b(\d+(?:\.\d+)+)\b"


def backfill_pages(clauses: DataFrame, chunks: DataFrame) -> DataFrame:
    """Clauses without boxes get those of the chunks that mention their id: page of the first, and per page the
    first chunk's box as [page, x0, y0, x1, y1]. Clauses with boxes, or without a mention, stay.

    clauses: clause_id, boxes, page (and more). chunks: chunk_seq, page_idx, content, bbox_pdf."""
    said = chunks.where("page_idx is not null and content <> ''").select("chunk_seq", "page_idx", "bbox_pdf", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(DOTTED), F.lit(1)))).alias("clause_id"))
    needs = said.join(clauses.where(F.size(F.coalesce("boxes", F.array().cast("array<array<double>>"))) <= 0).select("clause_id"), "clause_id", "left_semi")
    once = keep_one(needs, ["clause_id", "page_idx"], [F.col("chunk_seq")])
    box = F.when(F.size("bbox_pdf") == 4, F.concat(F.array(F.col("page_idx").cast("double")), "bbox_pdf"))
    found = once.groupBy("clause_id").agg(F.min_by("page_idx", "chunk_seq").alias("_page"), F.sort_array(F.collect_list(box)).alias("_boxes"))
    out = clauses.join(found, "clause_id", "left")
    return out.withColumn("page", F.coalesce("_page", "page")).withColumn("boxes", F.coalesce("_boxes", "boxes")).drop("_page", "_boxes")


def resolve_positions(clauses: DataFrame, chunks: DataFrame, least_ratio: float = 0.3, least_ngrams: int = 3) -> DataFrame:
    """clause_id, chunk_seq, tier of each clause's chunk: one that starts with its id, a title first (1); one of 10 characters
    or more that contains its text, the shortest, if the text is at least least_ratio of it (2); one with the most shared
    20-character n-grams, at least so many (3). Ties go to the first chunk. Clauses that nothing fits are left out.

    clauses: clause_id, content. chunks: chunk_seq, content and perhaps type. Chunks and clauses meet by id, by the
    clause's rarest piece of three characters (or by all of a shorter text), or by a shared n-gram: never all with all.
    Of equal texts one meets, so many clauses that say what many chunks say are no pairs."""
    title = F.coalesce(F.col("type") == "title", F.lit(False)) if "type" in chunks.columns else F.lit(False)
    c, k = clauses.select("clause_id", strip(F.coalesce("content", F.lit(""))).alias("clause_text")), chunks.select("chunk_seq", title.alias("title"), strip(F.coalesce("content", F.lit(""))).alias("chunk_text"))
    number = F.regexp_extract("chunk_text", r"^(\d+(?:\.\d+)+)(?![\d.]*\d)", 1)
    first = keep_one(k.withColumn("clause_id", number).where("clause_id <> ''"), ["clause_id"], [F.desc("title"), F.col("chunk_seq")])
    exact = first.join(c, "clause_id").select("clause_id", "chunk_seq", F.lit(1).alias("tier"), F.col("title").cast("double").alias("score"))
    # what texts say of each other is the same for all that have them: each distinct pair meets once, for the first such chunk
    texts = stored(c.select("clause_text").where("clause_text <> ''").distinct(), "clause_texts")
    said = stored(k.groupBy("chunk_text").agg(F.min("chunk_seq").alias("chunk_seq")), "chunk_texts")
    long = said.where(F.length("chunk_text") >= 10)
    pieces = long.select("chunk_seq", F.length("chunk_text").alias("n"), F.explode(grams(F.col("chunk_text"))).alias("gram"))
    often = pieces.groupBy("gram").agg(F.count("*").alias("df"))
    # a piece that no chunk has drops its clause: the outer join keeps it, as the rarest
    own = texts.select("clause_text", F.length("clause_text").alias("size"), F.explode(F.filter(grams(F.col("clause_text")), lambda g: F.length(g) == F.least(F.length("clause_text"), F.lit(3)))).alias("gram"))
    rarest = own.join(often, "gram", "left").groupBy("clause_text", "size").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("r")).where("r.df > 0").select("clause_text", "size", F.col("r.gram").alias("gram"))
    near = rarest.join(pieces, "gram").where((F.col("n") >= F.col("size")) & (F.col("size") / F.col("n") >= least_ratio)).select("clause_text", "chunk_seq")
    second = near.join(long, "chunk_seq").where(F.contains("chunk_text", F.col("clause_text")))
    second = second.select("clause_text", "chunk_seq", F.lit(2).alias("tier"), (F.length("clause_text") / F.length("chunk_text")).alias("score"))
    probe = texts.select("clause_text", F.explode(ngrams(F.col("clause_text"), 20, 5)).alias("g"))
    index = said.select("chunk_seq", F.explode(ngrams(F.col("chunk_text"), 20, 10)).alias("g"))
    shared = probe.groupBy("clause_text", "g").agg(F.count("*").alias("a")).join(index.groupBy("chunk_seq", "g").agg(F.count("*").alias("b")), "g").groupBy("clause_text", "chunk_seq").agg(F.sum(F.col("a") * F.col("b")).alias("n"))
    third = shared.where(F.col("n") >= least_ngrams).select("clause_text", "chunk_seq", F.lit(3).alias("tier"), F.col("n").cast("double").alias("score"))
    best = lambda df, key: keep_one(df, [key], [F.col("tier"), F.desc("score"), F.col("chunk_seq")])
    by_text = best(second.unionByName(third), "clause_text").join(c, "clause_text").select("clause_id", "chunk_seq", "tier", "score")
    return best(exact.unionByName(by_text), "clause_id").select("clause_id", "chunk_seq", "tier")


def table_chunks(chunks: DataFrame) -> DataFrame:
    """number, chunk_id: the chunk that each numbered table's caption is in; of more, a table first, then the first."""
    numbered = chunks.withColumn("number", F.regexp_extract("content", r"表\s*(\d+(?:\.\d+)+)", 1)).where("number <> ''")
    return keep_one(numbered, ["number"], [F.when(F.col("type") == "table", 0).otherwise(1), F.col("chunk_seq")]).select("number", "chunk_id")


def clause_elements(clauses: DataFrame, elements: DataFrame) -> DataFrame:
    """clause_id, element_id where the element names the clause as its source or its chunk id starts with it."""
    by_id = elements.select("element_id", F.col("source_clause_id").alias("clause_id")).join(clauses.select("clause_id"), "clause_id")
    head = elements.select("element_id", F.split_part("chunk_id", F.lit("_"), F.lit(1)).alias("clause_id")).join(clauses.select("clause_id"), "clause_id")
    return by_id.select("clause_id", "element_id").union(head.select("clause_id", "element_id")).distinct()


def missing_parents(sections: DataFrame, parents: DataFrame, number: str = "number") -> DataFrame:
    """Numbers of chapters that sections imply and parents lack."""
    return sections.select(F.regexp_replace(number, r"\.[^.]+$", "").alias(number)).where(F.col(number) != "").distinct().join(parents.select(number), number, "left_anti")


def batch_results(clauses: DataFrame, results: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Clauses with their first result, and those without one, which go row by row."""
    first = keep_one(results, ["clause_id"], [F.col(order)])
    return clauses.join(first.drop(order), "clause_id"), clauses.join(first.select("clause_id"), "clause_id", "left_anti")


def edited(clauses: DataFrame, clause_id: str, changes: dict[str, object], terms: DataFrame | None = None) -> DataFrame:
    """One clause with changed columns; given terms (term_name, definition) replace those of the same name."""
    hit = F.col("clause_id") == clause_id
    out = clauses.withColumns({c: F.when(hit, F.lit(v).cast(clauses.schema[c].dataType)).otherwise(F.col(c)) for c, v in changes.items()})
    if terms is None:
        return out
    fresh = F.broadcast(terms.agg(F.sort_array(F.collect_list(F.struct("term_name", "definition"))).alias("_terms")))  # one row of one clause's terms
    names = F.transform("_terms", lambda t: t["term_name"])
    kept = F.filter("terms", lambda t: ~F.array_contains(names, t["term_name"]))
    return out.crossJoin(fresh).withColumn("terms", F.when(hit, F.concat(kept, "_terms")).otherwise(F.col("terms"))).drop("_terms")


def clause_tree(clauses: DataFrame) -> DataFrame:
    """One row per chapter, in natural order, with its clauses' ids sorted and their number."""
    from ..functions.text import natural_key

    chapter = F.coalesce(F.nullif("parent_chapter", F.lit("")), F.split_part("clause_id", F.lit("."), F.lit(1)))
    return clauses.groupBy(chapter.alias("chapter")).agg(F.count("*").alias("n_clauses"), F.sort_array(F.collect_list("clause_id")).alias("clause_ids")).withColumn("place", F.row_number().over(W.orderBy(natural_key(F.col("chapter")))))


def annotations(clauses: DataFrame) -> DataFrame:
    """page, clause_id, box for drawing: each of a clause's boxes, or its single box on the page after page_idx."""
    several = clauses.where(F.size("boxes") > 0).select("clause_id", F.explode("boxes").alias("b")).select(F.get("b", F.lit(0)).cast("int").alias("page"), "clause_id", F.slice("b", 2, 4).alias("box"))
    single = clauses.where((F.size(F.coalesce("boxes", F.array().cast("array<array<double>>"))) == 0) & (F.size("bbox") == 4)).select((F.col("page_idx") + 1).alias("page"), "clause_id", F.col("bbox").alias("box"))
    return several.unionByName(single)


def analysis(clauses: DataFrame) -> DataFrame:
    """Per source: clauses, terms, topics and entities named."""
    return clauses.groupBy("source").agg(F.count("*").alias("n_clauses"), F.sum(F.greatest(F.size("terms"), F.lit(0))).alias("n_terms"), F.sum(F.greatest(F.size("topics"), F.lit(0))).alias("n_topics"), F.sum(F.aggregate(F.coalesce("topics", F.array().cast(clauses.schema["topics"].dataType)), F.lit(0), lambda a, t: a + F.greatest(F.size(t["entities"]), F.lit(0)))).alias("n_entities"))
