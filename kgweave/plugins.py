"""Plug-ins for what models do elsewhere, with deterministic defaults that need no network."""

from __future__ import annotations

import hashlib
import json
import random
import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workers import shipped

KINDS = ("embedder", "scorer", "extractor", "describer", "chat", "tagger", "ontology", "triplets", "contents", "persona", "filter")
#: Characters whose trigrams are counted at once.
PIECE = 1 << 20
REGISTRY: dict[str, dict[str, Callable]] = {kind: {} for kind in KINDS}


def register(kind: str, name: str):
    def add(fn: Callable) -> Callable:
        REGISTRY[kind][name] = fn
        return fn

    return add


def retried(fn: Callable, arg, tries: int = 3, wait: float = 0.2, sleep: Callable = time.sleep) -> tuple:
    """(result, None) or (None, last error): waits double, with up to a tenth more by chance."""
    error = None
    for k in range(tries):
        try:
            return fn(arg), None
        except Exception as e:  # a row's failure is its own
            error = f"{type(e).__name__}: {e}"
            if k + 1 < tries:
                sleep(wait * 2**k * (1 + random.random() / 10))
    return None, error


@register("embedder", "hashed")
def hashed_embedding(texts: list[str | None], size: int = 64) -> list[list[float]]:
    """Character trigrams hashed to signed counts, of length 1; blank texts are zero vectors. A trigram is hashed once for
    PIECE characters, which may be many texts or a part of one."""
    import numpy as np
    import pandas as pd

    counts = np.zeros((len(texts), size))

    def add(rows: list[int], parts: list[str]) -> None:
        points = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        row = np.repeat(rows, [len(p) for p in parts])
        part = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        inside = part[:-2] == part[2:]
        grams, distinct = pd.factorize(((points[:-2] << 42) | (points[1:-1] << 21) | points[2:])[inside])
        hashes = [int.from_bytes(hashlib.blake2b("".join(map(chr, (g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF))).encode(), digest_size=8).digest(), "big") for g in distinct.tolist()]
        place = np.array([h % size for h in hashes], dtype=np.int64)
        sign = np.array([1.0 if h >> 63 else -1.0 for h in hashes])
        low, high = rows[0], rows[-1] + 1
        cells = (row[:-2][inside] - low) * size + place[grams]
        counts[low:high] += np.bincount(cells, sign[grams], (high - low) * size).reshape(-1, size)

    rows, parts, held = [], [], 0
    for i, text in enumerate(texts):
        t = f" {(text or '').strip().lower()} "
        for at in range(0, len(t) - 2 if t.strip() else 0, PIECE):
            part = t[at : at + PIECE + 2]
            rows.append(i)
            parts.append(part)
            held += len(part)
            if held >= PIECE:
                add(rows, parts)
                rows, parts, held = [], [], 0
    if parts:
        add(rows, parts)
    squares = (counts * counts).sum(axis=1).tolist()
    return (counts / np.array([x**0.5 or 1.0 for x in squares]).reshape(-1, 1)).tolist()


@register("scorer", "overlap")
def overlap_score(query: str, text: str | None) -> float:
    """Share of the query's words in the text, 0 to 1."""
    q, t = set(re.findall(r"\w+", query.lower())), set(re.findall(r"\w+", (text or "").lower()))
    return len(q & t) / len(q) if q else 0.0


@register("extractor", "rules")
def rule_extractor(text: str | None) -> dict:
    """Capitalised runs as entities, quoted strings as terms, the first sentence as topic."""
    text = text or ""
    entities = list(dict.fromkeys(re.findall(r"\b[A-Z][\w-]+(?: [A-Z][\w-]+)*", text)))
    terms = list(dict.fromkeys(re.findall(r'["“「]([^"”」]{2,40})["”」]', text)))
    topic = re.split(r"(?<=[.!?。])\s*", text.strip(), maxsplit=1)[0][:80]
    return {"topics": [{"topic": topic, "entities": entities}] if topic else [], "terms": [{"term_name": t, "definition": ""} for t in terms]}


@register("describer", "size")
def describe_image(content: str | None) -> dict:
    return {"text": f"image of {len(content or '')} characters" if content else "", "status": "ok" if content else "error"}


def embed(df: DataFrame, text: str, name: str = "hashed", size: int = 64, out: str = "embedding") -> DataFrame:
    """df with vectors, by Arrow batches; equal texts of a batch are embedded once."""
    fn = REGISTRY["embedder"][name]

    def run(batches):
        for pdf in batches:
            texts = pdf[text].tolist()
            once = list(dict.fromkeys(texts))
            found = dict(zip(once, fn(once, size), strict=True))
            yield pdf.assign(**{out: [found[t] for t in texts]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(shipped(run), f"{fields}, `{out}` array<float>")


def extract(df: DataFrame, text: str, name: str = "rules") -> DataFrame:
    """df with topics and terms; a row that fails has none."""
    fn = REGISTRY["extractor"][name]

    def run(batches):
        from kgweave.plugins import retried

        for pdf in batches:
            found = [retried(fn, t, 1)[0] or {"topics": [], "terms": []} for t in pdf[text]]
            yield pdf.assign(topics=[f["topics"] for f in found], terms=[f["terms"] for f in found])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(shipped(run), f"{fields}, topics array<struct<topic: string, entities: array<string>>>, terms array<struct<term_name: string, definition: string>>")


def score(df: DataFrame, query: str, text: str, name: str = "overlap", out: str = "score") -> DataFrame:
    """df with a scorer's numbers; the default stays in the JVM."""
    if name == "overlap":
        wanted = F.array(*map(F.lit, sorted(set(re.findall(r"\w+", query.lower())))))
        found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1)))
        return df.withColumn(out, F.size(F.array_intersect(found, wanted)) / F.greatest(F.size(wanted), F.lit(1)))
    fn = REGISTRY["scorer"][name]

    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{out: [fn(query, t) for t in pdf[text]]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(shipped(run), f"{fields}, `{out}` double")


def repaired_json(text: str | None):
    """A model's answer as an object: as it is, out of a fence, cut back to the last whole member and closed; else None."""
    if not text:
        return None
    body = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text.strip())
    start = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    body = body[start:]
    try:
        return json.JSONDecoder().raw_decode(body)[0]
    except ValueError:
        pass
    cuts, stack, quoted, escaped = [], [], False, False
    for i, c in enumerate(body):
        if quoted:
            quoted = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
        elif c == ",":
            cuts.append((i, list(stack)))
    for i, open_ends in [(len(body), stack), *reversed(cuts)]:
        for tail in ('"', "") if quoted and i == len(body) else ("",):
            try:
                return json.loads(re.sub(r",\s*$", "", body[:i] + tail) + "".join(reversed(open_ends)))
            except ValueError:
                continue
    return None


def salvaged_json(text: str | None, name: str, kind: str, summary: str = "") -> dict:
    """A profile from a model's broken answer: closed where it was cut off, line ends and controls in strings as spaces;
    else what can be read of its bio and persona; else one made from the summary."""
    body = (text or "").strip()
    if body and body[-1] not in '",}]':
        body += '"'
    body += "]" * max(0, body.count("[") - body.count("]")) + "}" * max(0, body.count("{") - body.count("}"))
    if found := re.search(r"\{[\s\S]*\}", body):
        plain = re.sub(r'"[^"\\]*(?:\\.[^"\\]*)*"', lambda m: re.sub(r"\s+", " ", m[0]), found[0])
        for attempt in (plain, re.sub(r"\s+", " ", re.sub(r"[\x00-\x1f\x7f-\x9f]", " ", plain))):
            try:
                return {**json.loads(attempt), "_fixed": True}
            except ValueError:
                continue
    parts = {k: re.search(rf'"{k}"\s*:\s*"([^"]*)', body) for k in ("bio", "persona")}
    made = {"bio": summary[:200] if summary else f"{kind}: {name}", "persona": summary or f"{name} is a {kind}."}
    read = {k: m[1] for k, m in parts.items() if m}
    return made | read | ({"_fixed": True} if read else {})


@register("chat", "echo")
def echo_chat(prompt: str | None) -> str:
    """The offline stand-in for a chat model: an empty JSON object."""
    return "{}"


#: Type names by which an ontology is taken as one of people and media, not of engineering.
SOCIAL = ("person", "student", "professor", "journalist", "celebrity", "executive", "media", "organization")


def tagging_mode(types: list[str]) -> str:
    """social where most of an ontology's type names are of people and media, else engineering."""
    names = [t.lower() for t in types]
    return "social" if names and 2 * sum(any(s in n for s in SOCIAL) for n in names) > len(names) else "engineering"


@register("tagger", "rules")
def rule_tagger(text: str | None, types: tuple[str, ...] = ()) -> dict:
    """Capitalised runs as entities of the first type named, neighbours within a sentence as related."""
    entities, relations = [], []
    for sentence in re.split(r"(?<=[.!?。])\s*", text or ""):
        names = list(dict.fromkeys(re.findall(r"\b[A-Z][\w-]+(?: [A-Z][\w-]+)*", sentence)))
        entities += [{"name": n, "type": types[0] if types else "Entity", "description": ""} for n in names]
        relations += [{"source": a, "target": b, "type": "RELATED_TO", "fact": sentence.strip()} for a, b in zip(names, names[1:], strict=False)]
    return {"entities": entities, "relations": relations}


@register("ontology", "fixed")
def fixed_ontology(texts: list[str]) -> dict:
    """The ontology of documents that needs no model."""
    return {"entity_types": ["Clause", "Topic", "Entity", "Term", "Table", "Image"], "edge_types": ["HAS_TOPIC", "MENTIONS", "CROSS_REFERENCE", "PART_OF"], "mode": "engineering"}


@register("triplets", "rules")
def rule_triplets(text: str | None) -> list[dict]:
    """(subject, relation, object) of plain sentences: X is / has / uses Y."""
    return [{"subject": m[1].strip(), "relation": m[2], "object": m[3].strip()} for m in re.finditer(r"([^.!?\n]+?)\s+(is|has|uses|contains|requires)\s+([^.!?\n]+)", text or "")]


@register("contents", "numbers")
def numbered_contents(text: str | None) -> list[dict]:
    """A table of contents from lines that begin with a number."""
    return [{"chapter_number": m[1], "title": m[2].strip(), "start_position": m.start()} for m in re.finditer(r"(?m)^(\d+(?:\.\d+)?)\s+(\S[^\n]*)$", text or "")]


@register("persona", "rules")
def rule_persona(entity: dict) -> dict:
    """A profile by rules from an entity's name, type and summary."""
    return salvaged_json(None, entity.get("name") or "", entity.get("type") or "Entity", entity.get("summary") or "")


@register("filter", "overlap")
def overlapping(query: str, facts: list[str]) -> list[int]:
    """Places of the facts that share a word with the query."""
    return [i for i, f in enumerate(facts) if overlap_score(query, f) > 0]


def filtered_facts(query: str, facts: list[str], name: str = "overlap", least: int = 5) -> list[str]:
    """The facts that a filter names by place; all of them if it fails or there is one, the first `least` if it names none."""
    if len(facts) < 2:
        return facts
    chosen, error = retried(lambda _: REGISTRY["filter"][name](query, facts), None, 1)
    if error is not None:
        return facts
    kept = [facts[i] for i in chosen if isinstance(i, int) and 0 <= i < len(facts)]
    return kept or facts[:least]


def mapped(df: DataFrame, column: str, kind: str, schema: str, name: str, out: str = "result") -> DataFrame:
    """df with a plug-in's answer for each row, by Arrow batches, and an error where it failed three times; a row's
    place doesn't matter, as answers stay with their rows."""
    fn = REGISTRY[kind][name]

    def run(batches):
        from kgweave.plugins import retried

        for pdf in batches:
            found = [retried(fn, v) for v in pdf[column]]
            yield pdf.assign(**{out: [f[0] for f in found], f"{out}_error": [f[1] for f in found]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(shipped(run), f"{fields}, `{out}` {schema}, `{out}_error` string")


class Progress:
    """Counts handled rows on the executors and tells a callback on the driver."""

    def __init__(self, spark, total: int, tell: Callable[[int, int], None]):
        self.done, self.total, self.tell = spark.sparkContext.accumulator(0), total, tell

    def counted(self, df: DataFrame) -> DataFrame:
        done = self.done

        def run(batches):
            for pdf in batches:
                done.add(len(pdf))
                yield pdf

        return df.mapInPandas(run, df.schema)

    def report(self) -> None:
        self.tell(min(self.done.value, self.total), self.total)


#: The last answers of queries, by all their arguments.
_MEMO: dict = {}


def remembered(key: tuple, make: Callable, seconds: float = 30.0, now: Callable[[], float] = time.monotonic):
    """make()'s result, or the one made at most so many seconds ago under the same key (name and all arguments)."""
    at, value = _MEMO.get(key, (None, None))
    if at is None or now() - at > seconds:
        for k in [k for k, (t, _) in _MEMO.items() if now() - t > seconds]:
            del _MEMO[k]
        value = make()
        _MEMO[key] = now(), value
    return value
