"""Text expressions: normalisation, clause numbers, classifiers, sort keys, tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Key words of the two requirement classifiers, by level.
PROHIBITED, MANDATORY, RECOMMENDED = ("严禁", "不得", "禁止", "不应", "必须不"), ("必须", "应"), ("宜", "可")
#: Chinese digits; ten adds as the digit ten. Other digits are their own.
NUMERALS = {str(i): i for i in range(10)} | {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}

WORD = r"[a-z]+"


def any_of(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_text(text: Column) -> Column:
    """Without white space and signs, lower case; letters of all scripts stay. Null stays null."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", ""), r"(?U)[^\w\s]", ""))


def clause_ids(text: Column, depth: int = 3) -> Column:
    """Dotted numbers of that many parts, bounded as words, in order."""
    pattern = r"(?U)\b(\d+" + r"\.\d+" * (depth - 1) + r")\b"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def numbering_depth(title: Column) -> Column:
    """How many parts the number at a title's start has; 0 without one. A number followed by more digits and dots isn't cut."""
    number = F.regexp_extract(F.trim(title), r"^(\d+(?:\.\d+)*)(?![\d.]*\d)", 1)
    return F.when(number == "", 0).otherwise(F.size(F.split(number, r"\.")))


def requirement_first_ban(text: Column) -> Column:
    """Prohibited, then mandatory, else recommended."""
    return F.when(any_of(text, PROHIBITED), "prohibited").when(any_of(text, MANDATORY), "mandatory").otherwise("recommended")


def requirement_first_must(text: Column) -> Column:
    """Mandatory key words first, among them 不得 and 不应; then recommended; then the other bans."""
    return F.when(any_of(text, (*MANDATORY, "不得", "不应")), "mandatory").when(any_of(text, RECOMMENDED), "recommended").when(any_of(text, ("严禁", "禁止")), "prohibited")


def classify(text: Column, levels: list[tuple[str, tuple[str, ...]]], otherwise: str | None = None) -> Column:
    """The first level one of whose words the text contains."""
    out = None
    for name, words in levels:
        hit = any_of(text, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.lit(otherwise))


def chinese_number(text: Column) -> Column:
    """Digit by digit, each times ten for what follows; unknown signs are skipped."""
    table = F.create_map(*[F.lit(x) for kv in NUMERALS.items() for x in kv])
    return F.aggregate(F.split(text, ""), F.lit(0), lambda acc, c: F.when(F.try_element_at(table, c).isNull(), acc).otherwise(acc * 10 + F.try_element_at(table, c)))


def natural_key(label: Column) -> Column:
    """Sorts whole numbers first, dotted ones by their parts, then other strings, then appendices by letter."""
    label = F.trim(label)
    whole, dotted, appendix = label.rlike(r"^\d+$"), label.rlike(r"^\d+(\.\d+)+$"), label.rlike(r"(?i)^(appendix|附录)\s*[A-Z]")
    parts = F.transform(F.split(label, r"\."), lambda p: F.try_to_number(p, F.lit("9999999999")).cast("long"))
    none = F.array().cast("array<bigint>")
    return F.struct(F.when(whole, 0).when(dotted, 1).when(appendix, 3).otherwise(2).alias("kind"), F.when(whole | dotted, parts).otherwise(none).alias("parts"), F.when(appendix, F.upper(F.regexp_extract(label, r"(?i)^(?:appendix|附录)\s*([A-Z])", 1))).otherwise(label).alias("label"))


def parent_id(clause_id: Column) -> Column:
    """The id without its last part; null at the top."""
    return F.when(F.contains(clause_id, F.lit(".")), F.regexp_replace(clause_id, r"\.[^.]+$", ""))


def sentences(text: Column) -> Column:
    """Sentences with their ends, without white space around: after each of 。！？?!；; and empty line, and after a full stop
    with white space. A text without any is its own only sentence; null has
    none."""
    parts = F.regexp_extract_all(text, F.lit(r"(?sU).*?(?:[。！？?!；;]|\n\n|\.\s+|\z)"), F.lit(0))
    found = F.filter(F.transform(parts, strip), lambda s: s != "")
    return F.when(F.size(found) > 0, found).when(text.isNotNull(), F.array(text))


def ngrams(text: Column, width: int = 20, step: int = 10) -> Column:
    """Character n-grams from 0 in steps; their starts stop before length - width, so a text of just that width has none."""
    # one pass: a match looks ahead over its n-gram and takes `step` characters
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?s)(?=(.{{{width}}}).).{{{step}}}"), F.lit(1)) if step <= width else _far_ngrams(text, width, step)


def _far_ngrams(text: Column, width: int, step: int) -> Column:
    n = F.length(text) - width
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda i: F.substring(text, i + 1, F.lit(width)))).otherwise(F.array().cast("array<string>"))


#: Longest substring of grams().
GRAM = 3


def grams(text: Column) -> Column:
    """Distinct substrings of 1 to GRAM characters."""
    n = F.length(text)
    cut = lambda size: F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[cut(size) for size in range(1, GRAM + 1)]))


def leading_grams(text: Column) -> Column:
    """Distinct substrings of GRAM characters from each place on, shorter ones at the end: each shorter substring leads one."""
    n = F.length(text)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def tokens(text: Column) -> Column:
    """Search tokens: lower-case Latin words and overlapping pairs of CJK characters."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1))
    runs = F.regexp_extract_all(text, F.lit("([\\u4e00-\\u9fff]+)"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))))
    return F.concat(words, pairs)


def escape_query(text: str) -> str:
    """A query string with the signs that query parsers read put in backslashes."""
    return "".join("\\" + c if c in '+-&|!(){}[]^"~*?:\\/' else c for c in text)


#: How many entities are wanted for up to so many clauses.
ENTITY_STEPS = ((1, 3), (3, 8), (10, 15))


def entity_target(clauses: Column) -> Column:
    out = F.when(clauses <= ENTITY_STEPS[0][0], ENTITY_STEPS[0][1])
    for most, target in ENTITY_STEPS[1:]:
        out = out.when(clauses <= most, target)
    return out.otherwise(999)
