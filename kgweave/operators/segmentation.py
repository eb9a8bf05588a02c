"""Two-level segmentation of layout blocks: chapters, containers, clauses, and what has none of them.

A document's blocks pass a state (chapter, container, clause) from one to the next. Each block alone says what it does
to the state: it opens a chapter (which ends container and clause), a container or a clause, or leaves things as they
are. The state at a block is what the last blocks before it that set something have set, so it is made of running
values (ordered.running), and a long document is several tasks. Documents without numbered titles are cut at their
titles (title mode), documents without any chapter have a virtual one, and a chapter without clauses keeps its blocks
as one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import stored
from .ordered import LAST, TOTAL, running

#: Numbers at the beginning of a block by depth, as they are counted, and as titles open chapters and
#: containers with them; appendices, and clauses of chapters and of appendices.
COUNTED = (r"^(\d+)(?!\.\d)", r"^(\d+\.\d+)(?!\.\d)", r"^(\d+\.\d+\.\d+)(?!\.\d)", r"^(\d+\.\d+\.\d+\.\d+)")
TITLED = (r"^(\d+)(?!\.\d)\.?\s*(.+)", r"^(\d+\.\d+)(?!\.\d)\.?\s*(.+)", r"^(\d+\.\d+\.\d+)(?!\.\d)\.?\s*(.+)", r"^(\d+\.\d+\.\d+\.\d+)\.?\s*(.+)")
APPENDIX, CLAUSE, APPENDIX_CLAUSE = r"^附录([A-Z])(?:\s+(.+))?$", r"^(\d+(?:\.\d+)+)\.?\s*(.*)", r"^([A-Z](?:\.\d+)+)\s*(.*)"
#: Key words of the kinds of requirement, looked for in this order; the title of a document without a name.
MUST, SHOULD, BANNED = ("应", "必须", "严禁", "不得", "应不", "不应", "不宜"), ("宜", "可", "建议", "推荐"), ("禁止", "不应", "不得")
UNNAMED, UNTITLED = "文档内容", "章节内容"
#: Height of a page that doesn't say, share of a page that a block without a box counts for, shares of a
#: page above which containers are made finer and at which that ends, and how much finer they have to be.
HEIGHT, UNBOXED, SOFT, HARD, FINER = 841, 0.05, 0.5, 0.2, 0.7


def requirement(text: Column) -> Column:
    has = lambda words: F.array_contains(F.transform(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), True)
    return F.when(has(MUST), "mandatory").when(has(SHOULD), "recommended").when(has(BANNED), "prohibited").otherwise("recommended")


def _text() -> Column:
    return strip(F.coalesce("content", F.lit("")))


def anchor_plan(chunks: DataFrame) -> DataFrame:
    """source, chapter_depth, container_depth, title_mode, avg_ratio (mean share of a page that a container takes), a row
    for each source of chunks (source, chunk_seq, page_idx, type, content, bbox, page_height).

    Chapters are the shallowest depth with three numbered titles, or with five numbers one of which is a title;
    containers a deeper one with enough titles beside the chapters, made finer where they take more than half a page
    and finer ones take less. Documents without chapters, or with titles but hardly a number, are cut at their titles."""
    c = chunks.withColumn("_t", _text())
    number = [F.nullif(F.regexp_extract("_t", p, 1), F.lit("")) for p in COUNTED]
    found = c.select("source", (F.col("type") == "title").alias("title"), F.posexplode(F.array(*number)).alias("depth", "number")).where("number IS NOT NULL")
    distinct = found.groupBy("source", "depth", "number").agg(F.max("title").alias("title"))
    counts = distinct.groupBy("source").agg(*[x for k in range(4) for x in (F.count_if(F.col("depth") == k).alias(f"a{k}"), F.count_if((F.col("depth") == k) & F.col("title")).alias(f"t{k}"))])
    titles = c.groupBy("source").agg(F.count_if((F.col("type") == "title") & (F.col("_t") != "")).alias("titles"))
    plan = titles.join(counts, "source", "left").join(_ratios(c, number), "source", "left").fillna(0, [f"{x}{k}" for x in "at" for k in range(4)]).fillna(1.0, [f"r{k}" for k in (1, 2, 3)])
    chosen = F.lit(None).cast("int")
    for k in (2, 1, 0):
        chosen = F.when((F.col(f"t{k}") >= 3) | ((F.col(f"a{k}") >= 5) & (F.col(f"t{k}") >= 1)), k).otherwise(chosen)
    plan = plan.withColumn("enough", chosen.isNotNull()).withColumn("chapter", F.coalesce(chosen, F.lit(1)))
    of = lambda x, depth: F.element_at(F.array(*[F.col(f"{x}{k}") for k in range(4)]), depth + 1)
    plan = plan.withColumn("chapters", F.greatest(of("t", F.col("chapter")), of("a", F.col("chapter"))))
    container = F.least(F.col("chapter") + 1, F.lit(3))
    for k in (3, 2, 1):
        few = (F.col(f"t{k}") >= 3) & (F.col(f"t{k}") >= F.col("chapters") * 0.15)
        deeper = (F.col(f"a{k}") >= 5) & (F.col(f"t{k}") >= 1) & (F.col(f"a{k + 1}") > F.col(f"a{k}") * 1.5) if k < 3 else F.lit(False)
        container = F.when((F.col("chapter") < k) & (few | deeper), k).otherwise(container)
    plan = plan.withColumn("container", container).withColumn("ratio", F.element_at(F.array("r1", "r2", "r3"), F.col("container")))
    plan = plan.withColumn("refine", F.col("ratio") > SOFT).withColumn("done", F.lit(False))
    for k in (2, 3):
        finer = F.col("refine") & ~F.col("done") & (F.col("container") < k) & (F.col(f"t{k}") >= 3) & (F.col(f"r{k}") < F.col("ratio") * FINER)
        plan = plan.withColumn("finer", finer).withColumns({"container": F.when(F.col("finer"), k).otherwise(F.col("container")), "ratio": F.when(F.col("finer"), F.col(f"r{k}")).otherwise(F.col("ratio"))})
        plan = plan.withColumn("done", F.col("done") | (F.col("finer") & (F.col("ratio") <= HARD)))
    by_titles = ~F.col("enough") | ((F.col("a2") < 3) & (F.col("titles") >= 3) & (F.col("t0") + F.col("t1") < 3))
    return plan.select("source", (F.col("chapter") + 1).alias("chapter_depth"), (F.col("container") + 1).alias("container_depth"), by_titles.alias("title_mode"), F.col("ratio").alias("avg_ratio"))


def _ratios(c: DataFrame, number: list[Column]) -> DataFrame:
    """source, r1, r2, r3: mean share of a page that containers of depth 2, 3 and 4 take, if they were the containers."""
    carried = running(c, ["source"], ["chunk_seq"], {f"_c{k}": (LAST, number[k]) for k in (1, 2, 3)})
    y0, y1 = F.get("bbox", F.lit(1)), F.get("bbox", F.lit(3))
    boxed = F.size("bbox") >= 4
    each = carried.select("source", "page_idx", "chunk_seq", "page_height", F.when(boxed, y0).alias("y0"), F.when(boxed, y1).alias("y1"), F.posexplode(F.array("_c1", "_c2", "_c3")).alias("depth", "container")).where("container IS NOT NULL")
    height = F.min_by("page_height", "chunk_seq")
    pages = each.groupBy("source", "depth", "container", "page_idx").agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.when(height > 0, height).otherwise(HEIGHT).alias("height"), F.count("*").alias("n"))
    share = F.least(F.coalesce((F.col("bottom") - F.col("top")) / F.col("height"), F.col("n") * UNBOXED), F.lit(1.0))
    mean = pages.groupBy("source", "depth").agg(F.bround(F.avg(share), 2).alias("mean"))
    return mean.groupBy("source").agg(*[F.max(F.when(F.col("depth") == k - 1, F.col("mean"))).alias(f"r{k}") for k in (1, 2, 3)])


def blocks(chunks: DataFrame, plan: DataFrame) -> DataFrame:
    """chunks with what they are (role: chapter, container, clause, content, or null before any chapter) and where they
    belong: chapter_ord (from 1, in the order of the source; 0: none), chapter, chapter_title, kind (normative, appendix,
    title_root, virtual), container, clause_id, clause_title; a chunk that opens something has its own.

    plan: source, chapter_depth, container_depth, title_mode, as of anchor_plan; a source without a plan has the default
    depths 2 and 3. Chunks without text open nothing and belong nowhere."""
    p = plan.select(F.col("source").alias("_of"), "chapter_depth", "container_depth", "title_mode")
    c = chunks.join(p, F.col("source").eqNullSafe(F.col("_of")), "left").withColumn("_t", _text())
    c = c.withColumns({"by_titles": F.coalesce("title_mode", F.lit(False)), "is_title": F.coalesce(F.col("type") == "title", F.lit(False))})
    at = lambda pattern, group: F.regexp_extract("_t", pattern, group)

    def titled(depth: Column, default: int, group: int) -> Column:
        out = at(TITLED[default], group)
        for k in range(4):
            out = F.when(depth == k + 1, at(TITLED[k], group)).otherwise(out)
        return F.when(F.col("is_title"), out).otherwise("")

    # columns of their own, so that a pattern is matched once for a row
    found = {"_chapter_no": titled(F.col("chapter_depth"), 1, 1), "_inner": titled(F.col("container_depth"), 2, 1), "_numbered": at(CLAUSE, 1), "_listed": at(APPENDIX_CLAUSE, 1), "_letter": F.when(F.col("is_title"), at(APPENDIX, 1)).otherwise("")}
    c = c.withColumns(found)
    appendix = F.col("_letter") != ""
    numbered, listed, inner = F.col("_numbered"), F.col("_listed"), F.col("_inner")
    opens = ~F.col("by_titles") & (F.col("_chapter_no") != "")
    role = F.when(F.col("_t") == "", None).when(opens | appendix, "chapter")
    role = role.when(F.col("by_titles") & F.col("is_title"), "container").when(~F.col("by_titles") & (inner != ""), "container")
    role = role.when(~F.col("by_titles") & (numbered != ""), "clause").when(listed != "", "clause").when(F.col("by_titles") & (F.col("type") == "text"), "clause").otherwise("content")
    c = c.withColumn("role", role)
    named = F.when(opens, F.struct(F.col("_chapter_no").alias("number"), strip(titled(F.col("chapter_depth"), 1, 2)).alias("title"), F.lit("normative").alias("kind")))
    letter = F.col("_letter")
    called = strip(F.coalesce(at(APPENDIX, 2), F.lit("")))
    named = named.otherwise(F.struct(F.concat(F.lit("附录"), letter).alias("number"), F.concat(F.lit("附录"), letter, F.lit(" "), F.when(called != "", called).otherwise(letter)).alias("title"), F.lit("appendix").alias("kind")))
    makes = F.col("role").isin("container", "clause")
    own = F.when(F.col("by_titles") & (F.col("role") == "container"), F.lit("container-")).when(F.col("role") == "container", inner)
    own = own.when(~F.col("by_titles") & (numbered != ""), numbered).when(listed != "", listed).otherwise(F.lit(""))  # '': numbered within its chapter
    heading = F.when(F.col("by_titles") & (F.col("role") == "container"), F.col("_t")).when(F.col("role") == "container", strip(titled(F.col("container_depth"), 2, 2)))
    heading = heading.when(~F.col("by_titles") & (numbered != ""), F.substring(strip(at(CLAUSE, 2)), 1, 80)).when(listed != "", F.substring(strip(at(APPENDIX_CLAUSE, 2)), 1, 80)).otherwise(F.substring("_t", 1, 60))
    state = F.struct(own.alias("id"), heading.alias("title"))
    reset = F.struct(F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("title"))
    values = {
        "chapter_ord": (TOTAL, F.when(F.col("role") == "chapter", 1).otherwise(0)),
        "_chapter": (LAST, F.when(F.col("role") == "chapter", named)),
        "_made": (TOTAL, F.when(makes, 1).otherwise(0)),
        "_clause": (LAST, F.when(F.col("role") == "chapter", reset).when(makes, state)),
        "_container": (LAST, F.when(F.col("role") == "chapter", reset).when((F.col("role") == "container") & ~F.col("by_titles"), state)),
    }
    r = running(c, ["source"], ["chunk_seq"], values)
    root = F.struct(F.lit("1").alias("number"), F.coalesce(F.nullif("source", F.lit("")), F.lit(UNNAMED)).alias("title"), F.lit("title_root").alias("kind"))
    r = r.withColumn("_chapter", F.when((F.col("chapter_ord") == 0) & F.col("by_titles"), root).otherwise(F.col("_chapter")))
    r = r.withColumn("chapter_ord", F.col("chapter_ord") + F.col("by_titles").cast("int"))
    inside = (F.col("chapter_ord") > 0) & F.col("role").isNotNull()
    id_ = F.when(F.col("_clause.id") == "container-", F.concat(F.col("_clause.id"), "_made")).when(F.col("_clause.id") == "", F.concat_ws("-", "_chapter.number", "_made")).otherwise(F.col("_clause.id"))
    added = {
        "role": F.when(inside, F.col("role")),
        "chapter": F.when(F.col("chapter_ord") > 0, F.col("_chapter.number")),
        "chapter_title": F.when(F.col("chapter_ord") > 0, F.col("_chapter.title")),
        "kind": F.when(F.col("chapter_ord") > 0, F.col("_chapter.kind")),
        "container": F.when(inside, F.col("_container.id")),
        "clause_id": F.when(inside, id_),
        "clause_title": F.when(inside & makes, F.col("_clause.title")),
    }
    names = [n for n in chunks.columns if n not in (*added, "chapter_ord")]
    return r.select(*[F.col(f"`{n}`") for n in names], F.col("chapter_ord").cast("int").alias("chapter_ord"), *[e.alias(n) for n, e in added.items()])


def sections(placed: DataFrame) -> DataFrame:
    """source, chapter_ord, chapter, title, kind, start_seq, end_seq (its last block with text), n_clauses; a row for each
    chapter of blocks(). Documents without a chapter are one virtual chapter."""
    seq, text = F.col("chunk_seq"), _text() != ""
    inside = placed.where("chapter_ord > 0").groupBy("source", "chapter_ord").agg(F.first("chapter").alias("chapter"), F.first("chapter_title").alias("title"), F.first("kind").alias("kind"), F.min("chunk_seq").alias("start_seq"), F.max(F.when(text, seq)).alias("end_seq"), F.count_if(F.col("role").isin("container", "clause")).alias("n_clauses"))
    none = placed.groupBy("source").agg(F.max("chapter_ord").alias("most"), F.min("chunk_seq").alias("start_seq"), F.max("chunk_seq").alias("end_seq")).where("most = 0")
    virtual = none.select("source", F.lit(0).alias("chapter_ord"), F.lit("1").alias("chapter"), F.coalesce(F.nullif("source", F.lit("")), F.lit(UNNAMED)).alias("title"), F.lit("virtual").alias("kind"), "start_seq", "end_seq", F.lit(0).cast("long").alias("n_clauses"))
    return inside.unionByName(virtual)


def last_sections(found: DataFrame) -> DataFrame:
    """Of sections that repeat a chapter's number, as in a table of contents, the last."""
    last = found.groupBy("source", "chapter").agg(F.max("chapter_ord").alias("chapter_ord"))
    return found.join(last, ["source", "chapter", "chapter_ord"], "left_semi")


def _members(placed: DataFrame, found: DataFrame) -> DataFrame:
    """The blocks with a member_of: their clause, the content of their chapter where it has no clause but text, or the
    clause whose number a block outside of any begins with."""
    bare = found.where("n_clauses = 0").select(F.col("source").alias("_s"), F.col("chapter_ord").alias("_o"), F.concat("chapter", F.lit("-content")).alias("_id"), "start_seq", "end_seq")
    rows = placed.join(bare, F.col("source").eqNullSafe(F.col("_s")) & (F.col("chapter_ord") == F.col("_o")) & (F.col("chunk_seq") > F.col("start_seq")) & (F.col("chunk_seq") <= F.col("end_seq")), "left")
    fills = (F.col("type").isNull() | (F.col("type") != "title")) & (_text() != "")
    full = rows.where(F.col("_id").isNotNull() & fills).select(F.col("source").alias("_fs"), F.col("chapter_ord").alias("_fo")).distinct()
    rows = rows.join(full, F.col("source").eqNullSafe(F.col("_fs")) & (F.col("chapter_ord") == F.col("_fo")), "left")
    number = F.nullif(F.coalesce(F.nullif(F.regexp_extract(_text(), CLAUSE, 1), F.lit("")), F.regexp_extract(_text(), APPENDIX_CLAUSE, 1)), F.lit(""))
    belongs = F.coalesce("clause_id", F.when(F.col("_fs").isNotNull(), F.col("_id")), F.when(F.coalesce(F.col("kind") != "title_root", F.lit(True)), number))
    return rows.withColumn("member_of", belongs).withColumn("filler", F.col("_id").isNotNull() & fills).drop("_s", "_o", "_id", "start_seq", "end_seq", "_fs", "_fo")


def clauses(placed: DataFrame, told: Callable[[Column], Column] | None = None, counts: bool = False) -> DataFrame:
    """One row for each container and clause of blocks(), and for each chapter that has text but no clause: source, seq
    (of the block that opens it), clause_id, title, chapter, chapter_title, container, requirement, page_idx, content,
    boxes ([page from 1, x0, y0, x1, y1] around its blocks, page by page), chunks (their ids).

    Content is the text of all its blocks, tables with their caption and HTML, without the first line where it repeats
    that of the first block. Clauses of one number in a source share their blocks: where many do, ask for less than all of
    them in each row. told: what is given of a content, as a digest; counts: boxes and chunks as their numbers. Both are
    made once for each number, before its clauses take them."""
    told = told or (lambda c: c)
    found = sections(placed)
    rows = _members(placed, found)
    table = F.nullif(strip(F.coalesce("table_content", F.lit(""))), F.lit("")) if "table_content" in placed.columns else F.lit(None).cast("string")
    text = F.when(F.col("type") == "table", F.concat_ws("\n", F.nullif(_text(), F.lit("")), table)).otherwise(_text())
    line = F.split_part(text, F.lit("\n"), F.lit(1))
    rows = stored(rows.withColumns({"_text": text, "_line": line, "_own": _text()}), "members")
    mine = rows.where("member_of IS NOT NULL")
    part = F.struct("chunk_seq", F.col("chunk_id").alias("id"), F.col("_text").alias("text"), F.col("_line").alias("line"))
    head = mine.where("_text <> ''").groupBy(F.col("source").alias("_of"), F.col("member_of").alias("_in")).agg(F.min(part).alias("_head"))
    headed = mine.join(head, F.col("source").eqNullSafe(F.col("_of")) & (F.col("member_of") == F.col("_in")), "left")
    rest = strip(F.substring(F.col("_text"), F.length("_line") + 2, F.length("_text")))
    kept = F.when((F.col("chunk_seq") != F.col("_head.chunk_seq")) & (F.col("_line") == F.col("_head.line")), rest).otherwise(F.col("_text"))
    parts = headed.groupBy("source", "member_of").agg(F.sort_array(F.collect_list(F.struct("chunk_seq", F.col("chunk_id").alias("id"), "_text", F.nullif(kept, F.lit("")).alias("kept")))).alias("parts"))
    # kept as tables, as Spark would join the texts anew wherever an expression names them
    merged = stored(parts.select("source", "member_of", F.array_join(F.transform("parts", lambda x: x["kept"]), "\n").alias("merged"), F.transform("parts", lambda x: x["id"]).alias("chunks")), "bodies")
    pages = mine.where(F.size("bbox") >= 4).groupBy("source", "member_of", "page_idx").agg(*[f(F.get("bbox", F.lit(k))).alias(n) for f, k, n in ((F.min, 0, "x0"), (F.min, 1, "y0"), (F.max, 2, "x1"), (F.max, 3, "y1"))])
    boxes = pages.groupBy("source", "member_of").agg(F.sort_array(F.collect_list(F.array((F.col("page_idx") + 1).cast("double"), *[F.col(n).cast("double") for n in ("x0", "y0", "x1", "y1")]))).alias("boxes"))
    opened = rows.where(F.col("role").isin("container", "clause")).select("source", F.col("chunk_seq").alias("seq"), "clause_id", F.col("clause_title").alias("title"), "chapter", "chapter_title", F.when(F.col("role") == "clause", F.col("container")).alias("container"), requirement(F.col("_own")).alias("requirement"), "page_idx", F.col("_own").alias("own"))
    bare = rows.where("filler").groupBy("source", "chapter_ord").agg(F.min("page_idx").alias("page_idx"), F.sort_array(F.collect_list(F.struct("chunk_seq", F.col("_own").alias("text")))).alias("all"))
    bare = stored(bare.select("source", "chapter_ord", "page_idx", F.array_join(F.transform("all", lambda x: x["text"]), "\n\n").alias("joined")), "fillers")
    named = found.where("n_clauses = 0").select(F.col("source").alias("_s"), F.col("chapter_ord").alias("_o"), "chapter", "title", "start_seq")
    joined = F.col("joined")
    filled = bare.join(named, F.col("source").eqNullSafe(F.col("_s")) & (F.col("chapter_ord") == F.col("_o"))).select(
        "source", F.col("start_seq").alias("seq"), F.concat("chapter", F.lit("-content")).alias("clause_id"), F.coalesce(F.nullif(F.substring("title", 1, 60), F.lit("")), F.lit(UNTITLED)).alias("title"), "chapter", F.col("title").alias("chapter_title"),
        F.lit(None).cast("string").alias("container"), requirement(joined).alias("requirement"), "page_idx", joined.alias("own"),
    )
    every = opened.unionByName(filled)
    size = F.length("merged").alias("size")
    if counts:
        boxes = boxes.withColumn("boxes", F.size("boxes"))
    merged = merged.select("source", "member_of", size, F.size("chunks").alias("n"), told(F.nullif("merged", F.lit(""))).alias("merged"), (F.size("chunks") if counts else F.col("chunks")).alias("chunks"))
    of = lambda df: df.select(F.col("source").alias("_of"), F.col("member_of").alias("_in"), *[c for c in df.columns if c not in ("source", "member_of")])
    same = F.col("source").eqNullSafe(F.col("_of")) & (F.col("clause_id") == F.col("_in"))
    out = every.join(of(merged), same, "left").drop("_of", "_in").join(of(boxes), same, "left").drop("_of", "_in")
    content = F.when((F.col("n") == 1) & (F.col("size") <= F.length("own")), told(F.col("own"))).otherwise(F.coalesce("merged", told(F.col("own"))))
    return out.select("source", "seq", "clause_id", "title", "chapter", "chapter_title", "container", "requirement", "page_idx", content.alias("content"), "boxes", "chunks")
