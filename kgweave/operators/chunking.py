"""Segmentation of layout blocks into chapters and clauses, and text splitting."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import numbering_depth
from ..workers import shipped
from .tabular import fill_down, keep_one


def chunk_rows(pages: DataFrame) -> DataFrame:
    """Layout blocks of parsed pages (source, page_idx, page_size array, blocks array<struct<type, bbox, lines
    array<struct<spans array<struct<content>>>>>>) in reading order, one row each, numbered from 0 per source."""
    blocks = pages.select("source", "page_idx", F.get("page_size", F.lit(0)).alias("page_width"), F.get("page_size", F.lit(1)).alias("page_height"), F.posexplode("blocks").alias("block", "b"))
    text = F.array_join(F.flatten(F.transform("b.lines", lambda l: F.transform(l["spans"], lambda s: F.coalesce(s["content"], F.lit(""))))), "")
    seq = F.row_number().over(W.partitionBy("source").orderBy("page_idx", "block")) - 1
    return blocks.select("source", seq.alias("chunk_seq"), "page_idx", F.col("b.type").alias("type"), text.alias("content"), F.col("b.bbox").alias("bbox"), "page_width", "page_height").withColumn("chunk_id", F.concat(F.lit("chunk_"), F.col("chunk_seq")))


def anchor_statistics(chunks: DataFrame) -> DataFrame:
    """One row: distinct numbers by depth 1, 2, 3, over all blocks and over titles."""
    number = F.regexp_extract(F.trim("content"), r"^(\d+(?:\.\d+)*)(?![\d.]*\d)", 1)
    c = chunks.withColumn("number", F.nullif(number, F.lit(""))).withColumn("depth", numbering_depth(F.col("content")))
    d = lambda depth, title: F.count_distinct(F.when((F.col("depth") == depth) & ((F.col("type") == "title") | F.lit(not title)), F.col("number")))
    return c.agg(*[d(k, t).alias(f"{'titles' if t else 'all'}_{k}") for t in (False, True) for k in (1, 2, 3)])


def infer_anchors(chunks: DataFrame) -> dict:
    """Chapter and container depth from the statistics of one row: chapters are the shallowest depth with two
    numbers or more, containers the depth below that has at least as many; titles alone where no text is numbered."""
    s = anchor_statistics(chunks).first()
    kind = "all" if any(s[f"all_{k}"] for k in (1, 2, 3)) else "titles"
    chapter = next((k for k in (1, 2, 3) if s[f"{kind}_{k}"] >= 2), None)
    if chapter is None:
        return {"chapter_depth": None, "container_depth": None, "title_mode": True}
    container = next((k for k in range(chapter + 1, 4) if s[f"{kind}_{k}"] >= s[f"{kind}_{chapter}"]), chapter)
    return {"chapter_depth": chapter, "container_depth": container, "title_mode": False}


def segment(chunks: DataFrame, chapter_depth: int = 1, container_depth: int = 2) -> DataFrame:
    """Blocks with their chapter and clause carried down; a chapter resets its clause.

    Numbers of chapter depth open chapters, of container depth clauses; blocks before any chapter belong to
    the preface (chapter 0). Appendix titles open chapters of their own, named by their letter."""
    c = chunks.withColumn("depth", numbering_depth(F.col("content"))).withColumn("number", F.regexp_extract(F.trim("content"), r"^(\d+(?:\.\d+)*)", 1)).withColumn("appendix", F.regexp_extract(F.trim("content"), r"^(?:Appendix|附录)\s*([A-Z])", 1))
    opens = (F.col("depth") == chapter_depth) & (F.col("type") == "title")
    c = c.withColumn("chapter", F.when(F.col("appendix") != "", F.col("appendix")).when(opens, F.col("number")))
    w = W.partitionBy("source").orderBy("chunk_seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    c = c.withColumn("chapter_ord", F.count("chapter").over(w))
    c = c.withColumn("clause", F.when(F.col("depth") == container_depth, F.col("number")))
    c = fill_down(c, ["source"], ["chunk_seq"], ["chapter"])
    c = fill_down(c, ["source", "chapter_ord"], ["chunk_seq"], ["clause"])
    return c.withColumn("chapter", F.coalesce("chapter", F.lit("0"))).drop("depth", "number", "appendix")


def clause_texts(segmented: DataFrame) -> DataFrame:
    """One row per clause: text in block order, pages, and per page the box around its blocks."""
    rows = segmented.where("clause is not null")
    text = rows.groupBy("source", "chapter", "clause").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_seq", "content"))), lambda s: s["content"]), "\n").alias("content"), F.min("page_idx").alias("page_idx"), F.min("chunk_seq").alias("first_seq"))
    return text.join(page_boxes(rows), ["source", "chapter", "clause"], "left")


def page_boxes(rows: DataFrame) -> DataFrame:
    """boxes of each clause: [page from 1, x0, y0, x1, y1] around its blocks, page by page."""
    b = rows.where(F.size("bbox") == 4).groupBy("source", "chapter", "clause", "page_idx").agg(F.min(F.get("bbox", F.lit(0))).alias("x0"), F.min(F.least(F.get("bbox", F.lit(1)), F.get("bbox", F.lit(3)))).alias("y0"), F.max(F.get("bbox", F.lit(2))).alias("x1"), F.max(F.greatest(F.get("bbox", F.lit(1)), F.get("bbox", F.lit(3)))).alias("y1"))
    return b.groupBy("source", "chapter", "clause").agg(F.sort_array(F.collect_list(F.array((F.col("page_idx") + 1).cast("double"), "x0", "y0", "x1", "y1"))).alias("boxes"))


def drop_text_in_tables(texts: DataFrame, tables: DataFrame) -> DataFrame:
    """Text blocks whose centre is in no table of their page (source, page_idx, bbox)."""
    from ..functions.layout import centre_inside

    t = tables.select("source", "page_idx", F.col("bbox").alias("_table"))
    return texts.join(t, (texts.source == t.source) & (texts.page_idx == t.page_idx) & centre_inside(texts.bbox, t["_table"]), "left_anti")


def span_ratios(rows: DataFrame) -> DataFrame:
    """Share of page height that each container takes: mean, most and pages; 0.05 a block where none has a box."""
    y0, y1 = (F.get("bbox", F.lit(i)) for i in (1, 3))
    per = rows.groupBy("container", "page_idx").agg(F.least(F.lit(1.0), (F.max(y1) - F.min(y0)) / F.max("page_height")).alias("ratio"), F.count("*").alias("n"))
    return per.groupBy("container").agg(F.coalesce(F.avg("ratio"), 0.05 * F.sum("n")).alias("mean"), F.max("ratio").alias("most"), F.count("*").alias("pages"))


def split_text(text: str | None, size: int = 500, overlap: int = 50, ends: tuple[str, ...] = ("。", "！", "？", ".", "!", "?", "\n")) -> list[str]:
    """Windows of at most `size` characters that overlap; texts up to one and a half sizes stay whole. A window
    ends after the last separator in it, if that is past two fifths of it."""
    text = (text or "").strip()
    if not text:
        return []
    if len(text) <= size * 3 // 2:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            cut = max(text.rfind(e, at, end) + len(e) if text.rfind(e, at, end) >= 0 else -1 for e in ends)
            if cut - at > size * 2 // 5:
                end = cut
        if part := text[at:end].strip():
            out.append(part)
        if end == len(text):
            break
        at = max(end - overlap, at + 1)
    return out


#: Characters of pieces that a task holds before they leave.
PIECES = 1 << 20


def split_texts(df: DataFrame, key: str, text: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """key, part, piece: each text's windows, by Arrow batches, as every window depends on the one before. Pieces leave in
    batches of some PIECES characters, so a task holds few of them."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            kind = batch.schema.field(0).type
            make = lambda rows, kind=kind: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], [key, "part", "piece"])
            rows, chars = [], 0
            for at in range(batch.num_rows):
                k = batch.column(0)[at].as_py()
                for i, p in enumerate(split_text(batch.column(1)[at].as_py(), size, overlap)):
                    rows.append((k, i, p))
                    chars += len(p)
                    if chars >= PIECES:
                        yield make(rows)
                        rows, chars = [], 0
            if rows:
                yield make(rows)

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("part", T.IntegerType()), T.StructField("piece", T.StringType())])
    return df.select(key, text).mapInArrow(shipped(run), schema)


#: Rows of a tile, in which batches are followed at once.
TILE = 16_384


def _steps(sizes: list[int], rows: int, most: int, alone: int) -> list[int]:
    """For each row how many rows a batch that it begins has."""
    out = []
    for i, size in enumerate(sizes):
        n, total = 1, size
        if size <= alone:
            for other in sizes[i + 1 : i + rows]:
                if other > alone or total + other > most:
                    break
                n, total = n + 1, total + other
        out.append(n)
    return out


def capacity_batches(df: DataFrame, keys: list[str], order: str, chars: str, rows: int = 8, most: int = 8000, alone: int = 1500, tile: int = TILE) -> DataFrame:
    """Numbers batches of neighbours: so many rows and characters at most; longer rows than `alone` by themselves. Null sizes
    are 0; order tells the rows of a group apart.

    Where a batch ends depends on where it begins, but a row within `rows` of any place begins one. So a group is cut into
    tiles of neighbours, each with the first rows of the next; a tile alone tells for each of its first rows, if a batch
    begins there, where the first one of the next tile begins and how many there are; one row a tile composes that along
    the group; and each tile, with its first batch known, numbers its rows."""
    from .ordered import numbered

    laid = numbered(df, keys, [order], "__place").withColumn("__place", F.col("__place") - 1).withColumn("__tile", F.floor(F.col("__place") / tile)).withColumn("__size", F.coalesce(F.col(chars), F.lit(0)).cast("long"))
    narrow = laid.select(*keys, "__tile", "__place", "__size")
    halo = narrow.where((F.col("__place") % tile < rows - 1) & (F.col("__tile") > 0)).withColumn("__tile", F.col("__tile") - 1)
    both = narrow.withColumn("own", F.lit(True)).unionByName(halo.withColumn("own", F.lit(False)))
    key_fields = [df.schema[k] for k in keys]

    def each(pdf):
        pdf = pdf.sort_values("__place")
        own = int(pdf["own"].sum())
        steps = _steps(pdf["__size"].tolist(), rows, most, alone)[:own]
        ends, counts = [], []
        for at in range(rows):
            n = 0
            while at < own:
                at, n = at + steps[at], n + 1
            ends.append(at - own)
            counts.append(n)
        return pdf.head(1)[[*keys, "__tile"]].assign(ends=[ends], counts=[counts])

    schema = T.StructType([*key_fields, T.StructField("__tile", T.LongType()), T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])
    maps = both.groupBy(*keys, "__tile").applyInPandas(shipped(each), schema)

    def composed(pdf):
        pdf, at, n, firsts, numbers = pdf.sort_values("__tile"), 0, 0, [], []
        for ends, counts in zip(pdf["ends"], pdf["counts"], strict=True):
            firsts.append(at)
            numbers.append(n)
            at, n = int(ends[at]), n + int(counts[at])
        return pdf[[*keys, "__tile"]].assign(first=firsts, number=numbers)

    begins = maps.groupBy(*keys).applyInPandas(shipped(composed), T.StructType([*key_fields, T.StructField("__tile", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("number", T.LongType())]))
    same = [both[k].eqNullSafe(begins[k]) for k in keys]
    told = both.join(begins, [both["__tile"] == begins["__tile"], *same]).select(*[both[k] for k in keys], both["__tile"], "__place", "__size", "own", "first", "number")

    def marked(pdf):
        pdf = pdf.sort_values("__place")
        own, at, n = int(pdf["own"].sum()), int(pdf["first"].iloc[0]), int(pdf["number"].iloc[0])
        steps = _steps(pdf["__size"].tolist(), rows, most, alone)[:own]
        out = [n - 1] * own  # before the first begin: the batch of the tile before
        while at < own:
            for k in range(at, min(at + steps[at], own)):
                out[k] = n
            at, n = at + steps[at], n + 1
        return pdf.head(own)[[*keys, "__place"]].assign(batch=out)

    numbers = told.groupBy(*keys, "__tile").applyInPandas(shipped(marked), T.StructType([*key_fields, T.StructField("__place", T.LongType()), T.StructField("batch", T.IntegerType())]))
    same = [laid[k].eqNullSafe(numbers[k]) for k in keys]
    return laid.join(numbers, [laid["__place"] == numbers["__place"], *same]).select(*[laid[c] for c in df.columns], "batch")


def _likeness(vectors, starts):
    """Cosines of a list array's vectors with the ones before, as functions.vectors.cosine adds them up: 0 where either is
    missing or zero or their lengths differ, or nan at starts."""
    import numpy as np
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    m = np.zeros((len(lengths), max(int(lengths.max()), 0)))
    m[np.arange(m.shape[1]) < lengths[:, None]] = pc.list_flatten(vectors).to_numpy(zero_copy_only=False)
    sides, dots = np.zeros(len(m)), np.zeros(len(m) - 1)
    for v in np.ascontiguousarray(m.T):
        sides += v * v
        dots += v[:-1] * v[1:]
    sides = np.sqrt(sides)
    both = sides[:-1] * sides[1:]
    some = (both != 0) & (lengths[:-1] == lengths[1:]) & (lengths[1:] >= 0)
    out = np.full(len(m), np.nan)
    out[1:] = np.where(some, np.divide(dots, both, out=np.zeros_like(dots), where=both != 0), 0.0)
    out[starts] = np.nan
    return out


def _percentile(values: list[float], share: float) -> float:
    """As Spark's percentile has it, of ascending values."""
    at = (len(values) - 1) * share
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high


def semantic_chunks(df: DataFrame, keys: list[str], order: str, sentence: str, vector: str, size: int = 500) -> DataFrame:
    """Sentences (with vectors) to chunk numbers: a chunk ends where likeness to the next sentence is below the
    20th percentile and it is over 0.8 sizes long, or where it would pass two sizes.

    sentence: a column of texts, or of their lengths. Rows are shuffled once, and a batch has the sentences of many keys;
    a null key is one. Adds likeness (to the sentence before), bound, chars and chunk to df's columns but the vector."""
    length = F.col(sentence) if isinstance(df.schema[sentence].dataType, T.IntegralType) else F.length(sentence)
    whole = F.when(~F.exists(vector, lambda x: x.isNull()), F.col(vector))
    kept = [c for c in df.columns if c != vector]
    rows = df.select(*[c for c in kept if c != "chars"], whole.alias("_vector"), length.cast("int").alias("chars"))
    rows = rows.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(order)))
    given = [f for f in rows.schema.fields if f.name not in ("_vector", "_place", "chars")]
    schema = T.StructType([*given, T.StructField("likeness", T.DoubleType()), T.StructField("bound", T.DoubleType()), T.StructField("chars", T.IntegerType()), T.StructField("chunk", T.IntegerType())])
    names = [f.name for f in given]

    def chunked(table):
        import numpy as np
        import pyarrow as pa

        table = table.combine_chunks()
        starts = np.flatnonzero(table["_place"].to_numpy() == 1)
        like = _likeness(table["_vector"].combine_chunks(), starts)
        chars, likeness, bounds, out = [c or 0 for c in table["chars"].to_pylist()], like.tolist(), [], []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(like)], strict=True):
            bound = _percentile(np.sort(like[a + 1 : b]).tolist(), 0.2) if b - a > 1 else None
            bounds += [bound] * (b - a)
            chunk, total = 0, 0
            for i in range(a, b):
                if i > a and ((likeness[i] < bound and total > 0.8 * size) or total + chars[i] > 2 * size):
                    chunk, total = chunk + 1, 0
                out.append(chunk)
                total += chars[i]
        told = [pa.array(like, mask=table["_place"].to_numpy() == 1), pa.array(bounds, pa.float64()), table["chars"].cast(pa.int32()), pa.array(out, pa.int32())]
        made = pa.table([*[table[n] for n in names], *told], [*names, "likeness", "bound", "chars", "chunk"])
        return made.to_batches()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        # the last key of a batch may go on in the next
        open_rows = []
        for batch in batches:
            starts = np.flatnonzero(batch.column(batch.schema.get_field_index("_place")).to_numpy() == 1)
            if open_rows and len(starts):
                done = pa.Table.from_batches([*open_rows, batch.slice(0, starts[-1])])
                open_rows = [batch.slice(starts[-1])]
                yield from chunked(done)
            elif len(starts) and starts[-1]:
                open_rows = [batch.slice(starts[-1])]
                yield from chunked(pa.Table.from_batches([batch.slice(0, starts[-1])]))
            elif batch.num_rows:
                open_rows.append(batch)
        if open_rows:
            yield from chunked(pa.Table.from_batches(open_rows))

    return rows.mapInArrow(shipped(run), schema)


def last_chapters(chapters: DataFrame) -> DataFrame:
    """A chapter number seen again (as in a table of contents) keeps its last row."""
    return keep_one(chapters, ["source", "chapter"], [F.desc("chunk_seq")])
