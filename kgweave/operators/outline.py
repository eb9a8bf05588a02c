"""Outlines of numbered texts: chapters, sections, clauses, paragraphs and elements by their numbering, and what is
looked up in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import standards
from ..functions import text as tx
from .tabular import fill_down, keep_one

#: How numbered lines begin.
CHAPTER = r"(?U)^第([一二三四五六七八九十\d]+)[章篇部]\s*[:：]?\s*(.*)"
SECTION = r"(?U)^(\d+)\.(\d+)\s+(.+)"
CLAUSE = r"(?ms)^(\d+\.\d+\.\d+)\s+(.+?)(?=\n\d+\.\d+\.\d+\s|\n\n[A-Z第]|\z)"
PARAGRAPH = r"(?ms)^\d+\.\d+\.\d+\.(\d+)\s+(.+?)(?=\n\d+\.\d+\.\d+\.\d+\s|\n\d+\.\d+\.\d+\s|\z)"
TERM = r"(?ms)(?:^|\n)(2\.0\.\d+)\s+([^\n]+?)\s*[:：]\s*([^\n]+?)(?=\n\d|\n[A-Z]|\z)"
TABLE_ROW = r"(?U)^\s*(\d+(?:\.\d+)?)\s*\|\s*(.+?)\s*\|\s*(.+?)\s*(?:\||$)"


def clauses(texts: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """key, ord, clause_id, clause_title, content, paragraphs, formula_id, table_refs, systems, requirement_type,
    cross_refs of every numbered clause: a line that begins with a three-part number, up to the next such line, an
    empty line before a capital or a chapter, or the end."""
    found = texts.select(key, F.posexplode(F.arrays_zip(F.regexp_extract_all(text, F.lit(CLAUSE), F.lit(1)).alias("id"), F.regexp_extract_all(text, F.lit(CLAUSE), F.lit(2)).alias("body"))).alias("ord", "c"))
    body = tx.strip(F.col("c.body"))
    rows = found.select(key, "ord", F.col("c.id").alias("clause_id"), body.alias("content"))
    content = F.col("content")
    paragraphs = F.zip_with(F.regexp_extract_all(content, F.lit(PARAGRAPH), F.lit(1)), F.regexp_extract_all(content, F.lit(PARAGRAPH), F.lit(2)), lambda n, p: F.concat(n, F.lit(" "), tx.strip(p)))
    return rows.select(
        key, "ord", "clause_id", standards.title(content).alias("clause_title"), "content", paragraphs.alias("paragraphs"), standards.formula_reference(content).alias("formula_id"),
        standards.table_references(content).alias("table_refs"), standards.systems(content).alias("systems"), tx.requirement_first_ban(content).alias("requirement_type"), standards.cross_references(content).alias("cross_refs"),
    )


def sections(texts: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """key, ord, chapter_number, title, content of the outline's first level.

    A chapter line (第n章) opens a chapter; lines before the first one belong to nothing, unless a section line (x.y title)
    comes first, which opens a chapter of its number. A section that follows another in its chapter closes it: what has
    been gathered is then a row under the number and title of the one that begins."""
    line = tx.strip(F.col("line"))
    lines = texts.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("no", "line")).select(key, "no", line.alias("line")).where("line <> ''")
    chapter, section = F.regexp_extract("line", CHAPTER, 1), F.regexp_extract("line", SECTION, 1)
    lines = lines.withColumn("is_chapter", chapter != "").withColumn("is_section", (chapter == "") & (section != ""))
    before = W.partitionBy(key).orderBy("no").rowsBetween(W.unboundedPreceding, W.currentRow)
    lines = lines.withColumn("chapters", F.count_if("is_chapter").over(before))
    within = W.partitionBy(key, "chapters").orderBy("no").rowsBetween(W.unboundedPreceding, W.currentRow)
    lines = lines.withColumn("sections", F.count_if("is_section").over(within))
    # a section that isn't its chapter's first closes what was gathered
    lines = lines.withColumn("part", F.greatest(F.col("sections") - 1, F.lit(0)))
    first = lambda c, cond: F.first(F.when(cond, c), ignorenulls=True)
    number = F.when(F.col("is_chapter"), tx.chinese_number(chapter)).otherwise(section.try_cast("int"))
    opened = F.col("is_chapter") | (F.col("is_section") & (F.col("chapters") == 0))
    head = lines.where(opened).groupBy(key, "chapters").agg(F.min_by(number, "no").alias("chapter_number"), F.min_by(F.when(F.col("is_chapter"), F.regexp_extract("line", CHAPTER, 2)).otherwise(F.concat(F.lit("第"), section, F.lit("章"))), "no").alias("chapter_title"), F.min("no").alias("from_no"))
    kept = lines.join(head, [key, "chapters"]).where("no >= from_no and chapter_title <> ''")
    # the row of a closed part is named by the section that closes it
    closing = lines.where("is_section").select(key, "chapters", (F.col("sections") - 2).alias("part"), F.concat(section, F.lit(" "), F.regexp_extract("line", SECTION, 3)).alias("closing")).where("part >= 0")
    rows = kept.groupBy(key, "chapters", "part").agg(F.min("no").alias("ord"), F.first("chapter_number").alias("chapter_number"), F.first("chapter_title").alias("chapter_title"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "line"))), lambda s: s["line"]), "\n").alias("content"))
    return rows.join(closing, [key, "chapters", "part"], "left").select(key, "ord", "chapter_number", F.coalesce("closing", "chapter_title").alias("title"), "content")


def terms(texts: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """key, term_id, term_name, definition of numbered terms: 2.0.n name: definition."""
    part = lambda i: F.regexp_extract_all(text, F.lit(TERM), F.lit(i))
    each = texts.select(key, F.explode(F.arrays_zip(part(1).alias("i"), part(2).alias("n"), part(3).alias("d"))).alias("t"))
    return each.select(key, F.col("t.i").alias("term_id"), tx.strip(F.col("t.n")).alias("term_name"), tx.strip(F.col("t.d")).alias("definition"))


def table_rows(texts: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """key, no, table_id, row, name, value of table lines (n | name | value) under a line that names their table.

    A line with 表n opens a table; rules between rows are skipped; any other line that isn't empty and doesn't begin
    with a bar closes it."""
    lines = texts.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("no", "line"))
    named, rule = F.regexp_extract("line", r"(?U)表\s*(\d+(?:\.\d+)?)", 1), F.col("line").rlike(r"(?U)^\s*[-|:\s]+\s*$")
    index = F.regexp_extract("line", TABLE_ROW, 1)
    stripped = tx.strip(F.col("line"))
    state = F.when(named != "", F.concat(F.lit("表"), named)).when(rule | (index != "") | (stripped == "") | stripped.startswith("|"), None).otherwise("")
    run = fill_down(lines.withColumn("state", state), [key], ["no"], ["state"])
    rows = run.where((named == "") & ~rule & (index != "") & (F.coalesce("state", F.lit("")) != ""))
    return rows.select(key, "no", F.col("state").alias("table_id"), index.alias("row"), F.regexp_extract("line", TABLE_ROW, 2).alias("name"), F.regexp_extract("line", TABLE_ROW, 3).alias("value"))


def hierarchy_type(text: Column) -> Column:
    """What a piece of text begins with: chapter, section, term, clause or formula; null otherwise."""
    t = F.regexp_replace(text, r"(?U)^\s+", "")
    return (
        F.when(t.rlike(r"(?U)^第[一二三四五六七八九十\d]+[章篇]"), "chapter")
        .when(t.rlike(r"(?U)^\d+\.\d+\s+"), "section")
        .when(t.rlike(r"(?U)^\d+\.\d+\.\d+") & t.startswith("2.0."), "term")
        .when(t.rlike(r"(?U)^\d+\.\d+\.\d+"), "clause")
        .when(t.rlike(r"(?U)^\(\s*[A-Z]?\.\d+\.\d+(?:-\d+)?\s*\)"), "formula")
    )


def sections_of_chunks(chunks: DataFrame) -> DataFrame:
    """source, chapter_number, title, page_idx: titles with a one- or two-part number; of a number the first."""
    number = F.regexp_extract("content", r"(?U)^(\d+(?:\.\d+)?)\s+(.+)", 1)
    found = chunks.where((F.col("type") == "title") & (number != "")).select("source", "chunk_seq", number.alias("chapter_number"), F.regexp_extract("content", r"(?U)^(\d+(?:\.\d+)?)\s+(.+)", 2).alias("title"), F.coalesce("page_idx", F.lit(0)).alias("page_idx"))
    return keep_one(found, ["source", "chapter_number"], [F.col("chunk_seq")]).select("source", "chapter_number", "title", "page_idx")


#: Key words of the levels of clauses made from chunks, in the order in which they are tried.
CHUNK_LEVELS = [("mandatory", ("应", "必须", "严禁", "不得", "应不", "不应", "不宜")), ("recommended", ("宜", "可", "建议", "推荐")), ("prohibited", ("禁止", "不应", "不得"))]


def clauses_of_chunks(chunks: DataFrame, layout: str = "is_layout") -> DataFrame:
    """source, chunk_seq, clause_id, clause_title (80 characters at most), requirement_type: chunks that begin with a
    two- or three-part number; layout boxes and empty chunks are none."""
    pattern = r"(?U)^(\d+\.\d+(?:\.\d+)?)\s*(.*)"
    found = chunks.where(~F.coalesce(layout, F.lit(False)) & (F.regexp_extract("content", pattern, 1) != ""))
    title = F.substring(tx.strip(F.regexp_extract("content", pattern, 2)), 1, 80)
    return found.select("source", "chunk_seq", F.regexp_extract("content", pattern, 1).alias("clause_id"), title.alias("clause_title"), tx.classify(F.col("content"), CHUNK_LEVELS, "recommended").alias("requirement_type"))


def content_and_layout(chunks: DataFrame, layout: str = "is_layout") -> tuple[DataFrame, DataFrame]:
    """Chunks with content that aren't layout boxes, and the layout boxes."""
    box = F.coalesce(layout, F.lit(False))
    return chunks.where(~box & (F.coalesce("content", F.lit("")) != "")), chunks.where(box)


def chunk_summary(chunks: DataFrame, layout: str = "is_layout") -> DataFrame:
    """One row: pages, chunks, those with content, texts (categories 0 and 1) and tables (2)."""
    box = F.coalesce(layout, F.lit(False))
    return chunks.agg(
        (F.coalesce(F.max("page_idx"), F.lit(0)) + 1).alias("n_pages"), F.count("*").alias("n_chunks"), F.count_if(~box & (F.coalesce("content", F.lit("")) != "")).alias("n_content"),
        F.count_if(F.col("category_id").isin(0, 1)).alias("n_texts"), F.count_if(F.col("category_id") == 2).alias("n_tables"),
    )


def without_level(rows: DataFrame, level: int = 3) -> DataFrame:
    """Rows of other levels; such without a level stay."""
    return rows.where(~F.col("level").eqNullSafe(F.lit(level)))


def element_histogram(elements: DataFrame) -> DataFrame:
    """element_type, n; missing types under noun_entity."""
    kind = F.coalesce(F.nullif(F.nullif("element_type", F.lit("")), F.lit("unknown")), F.lit("noun_entity"))
    return elements.groupBy(kind.alias("element_type")).agg(F.count("*").alias("n"))


def with_chapter_title(clauses: DataFrame, chapters: DataFrame) -> DataFrame:
    """Clauses with the title of their parent chapter (of a number the first title), null without one."""
    first = keep_one(chapters, ["chapter_number"], [F.col("ord")]).select(F.col("chapter_number").cast("string").alias("parent_chapter"), F.col("title").alias("parent_chapter_title"))
    return clauses.join(first, "parent_chapter", "left")


def analysis_chunks(clauses: DataFrame, elements: DataFrame, chapters: DataFrame) -> DataFrame:
    """chunk_type, level, key, text: clauses (level 2), elements (3) and chapters that have content (1) as chunks.

    An element reads `key: content`, or its content without a key; a chapter its title, an empty line and its content."""
    c = clauses.select(F.lit("clause").alias("chunk_type"), F.lit(2).alias("level"), F.col("clause_id").alias("key"), F.col("content").alias("text"))
    named = F.when(F.coalesce("key", F.lit("")) != "", F.concat("key", F.lit(": "), "content")).otherwise(F.col("content"))
    e = elements.select(F.lit("element"), F.lit(3), F.coalesce("source_id", F.lit("")), named)
    s = chapters.where(F.coalesce("content", F.lit("")) != "").select(F.lit("section"), F.lit(1), F.col("chapter_number").cast("string"), F.concat("title", F.lit("\n\n"), "content"))
    return c.union(e).union(s)


def elements_by_keyword(elements: DataFrame, keyword: str) -> DataFrame:
    """Elements with the keyword in key or definition, or as one of their keywords, whatever its case."""
    k = keyword.lower()
    said = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(k)), F.lit(False))
    return elements.where(said("key") | said("definition") | F.coalesce(F.array_contains("keywords", k), F.lit(False)))


def hierarchy_tree(chapters: DataFrame, clauses: DataFrame, elements: DataFrame) -> DataFrame:
    """Chapters with the sorted ids of their clauses and elements; empty arrays without any."""
    ids = lambda df, key, name: df.groupBy(F.col("parent_chapter").alias("chapter_number")).agg(F.sort_array(F.collect_list(key)).alias(name))
    out = chapters.withColumn("chapter_number", F.col("chapter_number").cast("string")).join(ids(clauses, "clause_id", "clause_ids"), "chapter_number", "left").join(ids(elements, "element_id", "element_ids"), "chapter_number", "left")
    for c in ("clause_ids", "element_ids"):
        out = out.withColumn(c, F.coalesce(c, F.array().cast(out.schema[c].dataType)))
    return out


def refined_positions(chapters: DataFrame, texts: DataFrame, key: str = "source", window: int = 50_000) -> DataFrame:
    """chapters (key, ord, chapter_number, title, start_position) with the places where they start and end.

    A chapter starts where its title, else 第n章, else its number with a point and the title, stands first among the
    text's first `window` characters, whatever the case; else at the given place. It ends before the next one starts, the
    last with the text; one that would be empty gets 10,000 characters, within the text."""
    head = F.lower(F.substring("text", 1, window))
    at = lambda what: F.nullif(F.instr(F.col("_head"), what), F.lit(0)) - 1
    numbered = F.nullif(F.regexp_instr("_head", F.concat(F.col("chapter_number"), F.lit(r"\s*[.、]\s*\Q"), F.lower("title"), F.lit(r"\E"))), F.lit(0)) - 1
    rows = chapters.join(texts.select(key, head.alias("_head"), F.length("text").alias("_length")), key)
    rows = rows.withColumn("start_position", F.coalesce(F.when(F.col("title") != "", at(F.lower("title"))), at(F.concat(F.lit("第"), "chapter_number", F.lit("章"))), numbered, "start_position", F.lit(0)))
    after = F.lead("start_position").over(W.partitionBy(key).orderBy("ord"))
    end = F.when(after.isNull(), F.col("_length")).otherwise(F.greatest("start_position", after - 1))
    rows = rows.withColumn("end_position", end)
    fixed = F.when(F.col("end_position") <= F.col("start_position"), F.least(F.col("start_position") + 10_000, "_length")).otherwise(F.col("end_position"))
    return rows.withColumn("end_position", fixed).drop("_head", "_length")


def cleaned_extraction(entities: DataFrame, relations: DataFrame, key: str = "doc") -> tuple[DataFrame, DataFrame]:
    """Entities (key, ord, name, type, description) and relations (key, ord, source, target, type, fact) as a model
    gave them, cleaned: names trimmed, blank ones dropped, of names that differ by case the first; ends of relations that
    no entity has are added as entities; a relation without a fact says `source type target`."""
    name = lambda c: tx.strip(F.coalesce(c, F.lit("")))
    e = entities.select(key, "ord", name("name").alias("name"), F.coalesce(name("type"), F.lit("Entity")).alias("type"), name("description").alias("description")).where("name <> ''")
    r = relations.select(key, "ord", name("source").alias("source"), name("target").alias("target"), F.when(F.col("type").isNull(), "RELATED_TO").otherwise(name("type")).alias("type"), name("fact").alias("fact")).where("source <> '' and target <> ''")
    r = r.withColumn("fact", F.coalesce(F.nullif("fact", F.lit("")), F.concat_ws(" ", "source", "type", "target")))
    ends = r.select(key, "ord", F.posexplode(F.array("source", "target")).alias("side", "name")).select(key, F.struct(F.lit(1).alias("late"), "ord", "side").alias("at"), "name", F.lit("Entity").alias("type"), F.lit("").alias("description"))
    all_named = e.select(key, F.struct(F.lit(0).alias("late"), "ord", F.lit(0).alias("side")).alias("at"), "name", "type", "description").unionByName(ends)
    once = keep_one(all_named.withColumn("_name", F.lower("name")), [key, "_name"], [F.col("at")])
    return once.select(key, "name", "type", "description"), r.select(key, "ord", "source", "target", "type", "fact")
