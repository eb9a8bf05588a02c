"""Scans: JSON records, page logs, clause trees, text in unknown encodings, layout pages, object listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.layout import lines_box
from ..operators.tabular import keep_one
from ..workers import shipped
from .writers import CSV

CORRUPT = "_corrupt_record"
_SPAN = "STRUCT<content STRING, image_path STRING, html STRING, cross_page BOOLEAN>"
_LINES = f"ARRAY<STRUCT<bbox ARRAY<DOUBLE>, spans ARRAY<{_SPAN}>>>"
PAGES = f"source STRING, page_num INT, md_content STRING, images MAP<STRING, STRING>, middle_json STRUCT<pdf_info: ARRAY<STRUCT<page_idx: INT, page_size: ARRAY<DOUBLE>, preproc_blocks: ARRAY<STRUCT<type: STRING, bbox: ARRAY<DOUBLE>, lines: {_LINES}, blocks: ARRAY<STRUCT<type: STRING, lines: {_LINES}>>>>>>>"
PROJECTS = "project_id STRING, name STRING, status STRING, created_at STRING, updated_at STRING, current_step INT, files ARRAY<STRUCT<filename: STRING, path: STRING, size: BIGINT>>, graph_id STRING, deleted BOOLEAN"
APPS = "app_id STRING, name STRING, is_published BOOLEAN, workflow_data STRUCT<selectedProjectIds: ARRAY<STRING>, selectedGraphIds: ARRAY<STRING>, rootTypes: ARRAY<STRING>, similarityThreshold: DOUBLE, topK: INT, rerankMinScore: DOUBLE, maxDepth: INT>, created_at STRING, updated_at STRING"
PIPELINES = "pipeline_id STRING, status STRING, current_stage_index INT, stages ARRAY<STRUCT<name: STRING, label: STRING, status: STRING, message: STRING, duration_ms: BIGINT>>, created_at STRING, total_duration_ms BIGINT"


def json_records(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """JSON objects, one a file or one a line; what doesn't parse is left out."""
    full = T._parse_datatype_string(schema).add(CORRUPT, T.StringType())
    rows = spark.read.schema(full).option("multiLine", str(not lines)).option("mode", "PERMISSIVE").json(path)
    # the corrupt column can't be read alone, so the good rows are told by it next to the others
    good = rows.where(F.col(CORRUPT).isNull())
    first = T._parse_datatype_string(schema).fieldNames()[0]
    return good.where(F.col(first).isNotNull()).drop(CORRUPT)


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows that writers.write_csv has written."""
    return spark.read.schema(schema).options(**CSV).csv(path)


def json_array(spark: SparkSession, path: str, element: str, id_name: str = "chunk_seq") -> DataFrame:
    """Elements of one JSON array a file, in order, numbered from 0."""
    text = spark.read.option("wholetext", "true").text(path)
    return text.select(F.posexplode(F.from_json("value", f"ARRAY<STRUCT<{element}>>")).alias(id_name, "e")).select(id_name, "e.*")


def parsed_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page log, one JSON object a line; bad and empty lines are skipped, of a page seen again the last line stays: the
    one furthest in its file, of the last file by name."""
    rows = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("line")).alias("ord"))
    lines = rows.where(F.trim("value") != "")
    pages = lines.select("ord", F.from_json("value", PAGES).alias("p")).where("p.page_num is not null").select("ord", "p.*")
    return keep_one(pages.withColumn("source", F.coalesce("source", F.lit(""))), ["source", "page_num"], [F.desc("ord")]).drop("ord")


def assembled(pages: DataFrame) -> DataFrame:
    """Each source's pages as one text in page order."""
    ordered = F.sort_array(F.collect_list(F.struct("page_num", "md_content")))
    return pages.groupBy("source").agg(F.array_join(F.transform(ordered, lambda p: F.coalesce(p["md_content"], F.lit(""))), "\n\n").alias("text"))


def clauses(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Clause records by chapter and id, missing chapters as 0, as text."""
    rows = json_records(spark, path, schema, lines=True)
    return rows.orderBy(F.coalesce(F.col("parent_chapter").cast("string"), F.lit("0")), F.coalesce("clause_id", F.lit("")))


def decode(raw: bytes | None) -> str:
    """UTF-8, with or without a mark; else UTF-16 by its mark, GB18030, and at last UTF-8 with replacements."""
    if raw is None:
        return ""
    for bom, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(bom):
            return raw.decode(name, "replace")
    for name in ("utf-8", "gb18030"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def texts(spark: SparkSession, path: str, pattern: str = "*.{txt,md,markdown}") -> DataFrame:
    """path, text of files in whatever encoding."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(text=[decode(bytes(b)) for b in pdf["content"]])[["path", "text"]]

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(shipped(run), "path string, text string")


def listing(spark: SparkSession, path: str, pattern: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """path, length, modificationTime of objects; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length", "modificationTime")


def is_pdf(content: Column) -> Column:
    return F.substring(content, 1, 5) == F.lit(b"%PDF-")


def accepted(name: Column, extensions: tuple[str, ...] = ("pdf", "doc", "docx")) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1)).isin(*extensions)


def layout_chunks(pages: DataFrame) -> DataFrame:
    """Typed rows of parsed pages: pages, blocks, sub-blocks, lines and spans unfolded in reading order.

    Tables and images take their caption, body and footnote from sub-blocks of those types. A block's box is that around
    its lines of its own page, as some run on to the next."""
    info = pages.select("source", "page_num", F.explode("middle_json.pdf_info").alias("i"))
    blocks = info.select("source", "page_num", F.col("i.page_idx").alias("page_idx"), F.get("i.page_size", F.lit(0)).alias("page_width"), F.get("i.page_size", F.lit(1)).alias("page_height"), F.posexplode("i.preproc_blocks").alias("block", "b"))
    text = lambda lines: F.array_join(F.flatten(F.transform(F.coalesce(lines, F.array().cast(_LINES)), lambda l: F.transform(l["spans"], lambda s: F.coalesce(s["content"], F.lit(""))))), "")
    sub = lambda kind: F.array_join(F.transform(F.filter(F.coalesce("b.blocks", F.array().cast(f"ARRAY<STRUCT<type STRING, lines {_LINES}>>")), lambda x: x["type"] == kind), lambda x: text(x["lines"])), "")
    html = F.get(F.filter(F.flatten(F.flatten(F.transform(F.coalesce("b.blocks", F.array().cast(f"ARRAY<STRUCT<type STRING, lines {_LINES}>>")), lambda x: F.transform(x["lines"], lambda l: F.transform(l["spans"], lambda s: s["html"]))))), lambda h: h.isNotNull()), F.lit(0))
    kind = F.col("b.type")
    category = F.when(kind == "title", 0).when(kind == "table", 2).when(kind == "image", 3).otherwise(1)
    seq = F.row_number().over(W.partitionBy("source").orderBy("page_num", "page_idx", "block")) - 1
    return blocks.select("source", seq.alias("chunk_seq"), F.concat(F.lit("chunk_"), seq).alias("chunk_id"), (F.col("page_num") - 1).alias("page_idx"), kind.alias("type"), category.alias("category_id"), F.when(kind == "table", sub("table_caption")).when(kind == "image", sub("image_caption")).otherwise(text(F.col("b.lines"))).alias("content"), F.coalesce(lines_box(F.col("b.lines"), F.col("b.bbox")), F.col("b.bbox")).alias("bbox_pdf"), "page_width", "page_height", F.when(kind == "table", sub("table_caption")).alias("table_caption"), F.when(kind == "table", html).alias("table_content"), F.when(kind == "table", sub("table_footnote")).alias("table_footnote"), F.when(kind == "image", sub("image_caption")).alias("image_caption"))


def ocr_blocks(words: DataFrame, least: float = 30, zoom: float = 2) -> DataFrame:
    """Words (page, block, ord, text, conf, x0, y0, x1, y1) to blocks: text in order and the box around, unzoomed."""
    w = words.where((F.col("conf") >= least) & (F.trim("text") != ""))
    return w.groupBy("page", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]), " ").alias("text"), *[f(c) / zoom for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]).toDF("page", "block", "text", "x0", "y0", "x1", "y1")


def remote_pages(rows: DataFrame, fetch, tries: int = 3) -> DataFrame:
    """page_idx, body, error of rows (page_idx, request) through a function that may fail: each row is tried so
    many times with growing waits; order doesn't matter, as rows carry their page."""

    def run(batches):
        from kgweave.plugins import retried

        for pdf in batches:
            found = [retried(fetch, r, tries) for r in pdf["request"]]
            yield pdf.assign(body=[f[0] for f in found], error=[f[1] for f in found])[["page_idx", "body", "error"]]

    return rows.mapInPandas(shipped(run), "page_idx int, body string, error string")


def joined_sources(df: DataFrame, name: str = "source", text: str = "text") -> DataFrame:
    """One text of all sources, each under its name, in order of name."""
    part = F.concat(F.lit("=== "), F.col(name), F.lit(" ===\n"), F.coalesce(text, F.lit("")))
    return df.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(name).alias("n"), part.alias("p")))), lambda s: s["p"]), "\n\n").alias("text"))


def page_texts(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, page_idx, text: plain pages of files that no layout is known of, cut at form feeds; blank pages are left out."""
    pages = texts.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\f")).alias("page_idx", "text"))
    return pages.where(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")) != "")


def objects(spark: SparkSession, paths: list[str], at_most: int | None = None) -> DataFrame:
    """path, length, content of named objects, wherever Spark reads; larger ones than at_most bytes are left out unread."""
    files = spark.read.format("binaryFile").load(paths).select("path", "length", "content")
    return files if at_most is None else files.where(F.col("length") <= at_most)
