"""Expressions over texts of technical standards: applicability, references, units, topic cores, sampling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: What stands before the sampled middle of a long text, and before its end.
SAMPLED, ENDING = "\n\n...[Middle Content Sampled]...\n\n", "\n\n...[End Content]...\n\n"
#: Endings of topics that name a function, not a thing; the first that fits is cut.
TOPIC_ENDINGS = (
    "尺寸偏差允许值及检验方法", "允许值及检验方法", "偏差允许值及检验方法", "质量验收规范", "及检验方法", "施工质量验收", "质量验收", "施工质量", "检验方法",
    "安装要求", "设计要求", "配置要求", "选择要求", "验收要求", "允许值", "尺寸偏差", "偏差值", "的规定", "的要求", "的方法", "的标准", "的检验", "及测量", "及检查", "及验收",
    "规定", "要求", "方法", "标准", "检验", "验收", "施工", "测量", "检查", "选择", "设计", "安装", "配置", "设置", "偏差", "及",
)


def topic_core(topic: Column) -> Column:
    """The topic without its first fitting ending, if at least two characters are left; else null."""
    cut = lambda e: F.trim(F.substring(topic, F.lit(1), F.length(topic) - F.length(e)))
    fits = F.filter(F.array(*map(F.lit, TOPIC_ENDINGS)), lambda e: topic.endswith(e) & (F.length(cut(e)) >= 2))
    return F.when(F.size(fits) > 0, cut(F.get(fits, F.lit(0))))


def with_core(topic: Column, entities: Column) -> Column:
    """entities, with the topic's core added where none of them is part of the topic."""
    core = topic_core(topic)
    known = F.coalesce(F.exists(entities, lambda e: F.contains(topic, e)), F.lit(False))
    missing = ~known & core.isNotNull() & ~F.coalesce(F.array_contains(entities, core), F.lit(False))
    return F.when(missing, F.array_append(F.coalesce(entities, F.array().cast("array<string>")), core)).otherwise(entities)


def unit(value: Column) -> Column:
    """The unit after the first number, or an empty string."""
    return F.regexp_extract(value, "[\\d.]+\\s*([a-zA-Z°%Ωμ²³]+)", 1)


def title(text: Column) -> Column:
    """First line without white space around, cut at 100 characters."""
    line = strip(F.split_part(text, F.lit("\n"), F.lit(1)))
    return F.when(F.length(line) > 100, F.concat(F.substring(line, 1, 100), F.lit("..."))).otherwise(line)


def cross_references(text: Column) -> Column:
    """Distinct three-part numbers in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\d+\.\d+\.\d+)"), F.lit(1)))


#: How texts name tables, formulas and the systems they apply to.
TABLE_REFERENCE = r"(?U)表\s*(\d+\.\d+(?:\.\d+)?)"
FORMULA_REFERENCE = r"(?i)(?:公式[\(（]?(\d+\.\d+(?:-\d+)?)[\)）]?|\(([A-Z]\.\d+\.\d+(?:-\d+)?)\)|式[\(（]?(\d+\.\d+(?:-\d+)?)[\)）]?)"
SYSTEM = r"(?iU)适用于?\s*((?:TN|TT|IT)(?:-C-S|-C|-S)?)\s*系统"


def table_references(text: Column) -> Column:
    """Distinct tables named by a dotted number, as 表n, sorted."""
    return F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TABLE_REFERENCE), F.lit(1)), lambda n: F.concat(F.lit("表"), n))))


def formula_reference(text: Column) -> Column:
    """The number of the first formula that the text names; null without one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, FORMULA_REFERENCE, i), F.lit("")) for i in (1, 2, 3)])


def systems(text: Column) -> Column:
    """Earthing systems that the text says it applies to: TN with its kind (as -S), TT and IT as written."""
    found = F.regexp_extract_all(text, F.lit(SYSTEM), F.lit(1))
    tn = lambda s: F.upper(s).startswith("TN")
    return F.transform(found, lambda s: F.struct(F.when(tn(s), "TN").otherwise(s).alias("system_type"), F.when(tn(s) & (F.length(s) > 2), F.substring(s, F.lit(3), F.length(s))).alias("sub_type")))


def scope_prefix(clause_id: Column, has_children: Column) -> Column:
    """2.0.1 to 2.0; 3.1 to itself where it has clauses below, else to 3; A.0 to A."""
    parts = F.split(clause_id, r"\.")
    letter = F.get(parts, F.lit(0)).rlike("^[A-Za-z]+$")
    return F.when(F.size(parts) == 3, F.array_join(F.slice(parts, 1, 2), ".")).when(F.size(parts) == 2, F.when(letter, F.get(parts, F.lit(0))).when(has_children, clause_id).otherwise(F.get(parts, F.lit(0)))).otherwise(clause_id)


def sampled(text: Column, most: int = 50_000, samples: int = 10) -> Column:
    """Whole up to `most` characters; beyond, its first and last 30 % of that and samples of the middle."""
    edge = int(most * 0.3)
    size = (most - 2 * edge) // samples
    middle = F.length(text) - 2 * edge
    step = F.floor(middle / samples)
    parts = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.substring(text, (F.lit(edge) + i * step + 1).cast("int"), F.least(F.lit(size).cast("long"), middle - i * step).cast("int")))
    cut = F.concat(F.substring(text, 1, edge), F.lit(SAMPLED), F.array_join(parts, "\n\n..."), F.lit(ENDING), F.substring(text, -edge, edge))
    return F.when(F.length(text) > most, cut).otherwise(text)


def username(name: Column, key: Column) -> Column:
    """Lower case with underscores, letters and digits only, and three digits from a hash of the key."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"\s+", "_"), r"(?U)[^\w]", "")
    return F.concat(slug, F.lit("_"), F.lpad(F.pmod(F.xxhash64(key), F.lit(1000)).cast("string"), 3, "0"))


def base_status(status: Column) -> Column:
    """The last word of a stage status."""
    return F.when(status.endswith("_completed"), "completed").when(status.endswith("_failed"), "failed").when(status.endswith("_processing"), "processing").otherwise(status)


def duration_text(ms: Column) -> Column:
    """1m 5s, 5s, or 250ms under a second; a dash for none."""
    s = F.floor(ms / 1000)
    return F.when(ms.isNull(), "-").when(ms < 1000, F.concat(ms, F.lit("ms"))).when(s < 60, F.concat(s, F.lit("s"))).otherwise(F.concat(F.floor(s / 60), F.lit("m "), s % 60, F.lit("s")))


def markdown_cells(line: Column) -> Column:
    """Cells of a table row in Markdown, trimmed; null for rules and other lines."""
    row = line.rlike(r"^\s*\|.*\|\s*$") & ~line.rlike(r"^\s*\|(\s*:?-+:?\s*\|)+\s*$")
    inner = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    return F.when(row, F.transform(F.split(inner, r"\|"), lambda c: F.trim(c)))


def image_placeholders(text: Column, captions: Column) -> Column:
    """Each ![...](...) in order becomes [image n: caption]; without a caption, [image n]."""
    parts = F.split(text, r"!\[[^\]]*\]\([^)]*\)")
    mark = lambda i: F.concat(F.lit("[image "), i, F.coalesce(F.concat(F.lit(": "), F.nullif(F.get(captions, i - 1), F.lit(""))), F.lit("")), F.lit("]"))
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(mark(i), p))), "")
