"""Segmentation in all modes against a plain pass over each document, in one part and in many; anchor plans by hand."""

import random
import re

import pytest

from kgweave.operators import ordered
from kgweave.operators import segmentation as sg

SCHEMA = "source string, chunk_seq long, chunk_id string, page_idx int, type string, content string, table_content string, bbox array<double>, page_height double"


def plain(chunks, chapter_depth, container_depth, title_mode):
    """roles, and for each block its (chapter_ord, chapter, container, clause_id)."""
    ord_, chapter, container, clause, made, out = int(title_mode), "1" if title_mode else None, None, None, 0, []
    for c in chunks:
        text, title = (c["content"] or "").strip(), c["type"] == "title"
        head = re.match(sg.TITLED[chapter_depth - 1], text) if title and not title_mode else None
        app = re.match(sg.APPENDIX, text) if title else None
        if not text:
            out.append((None, ord_, chapter, None, None))
            continue
        if head or app:
            ord_, chapter, container, clause = ord_ + 1, head.group(1) if head else "附录" + app.group(1), None, None
            out.append(("chapter", ord_, chapter, None, None))
            continue
        if not ord_:
            out.append((None, 0, None, None, None))
            continue
        role = "content"
        inner = re.match(sg.TITLED[container_depth - 1], text) if title and not title_mode else None
        number = re.match(sg.CLAUSE, text) if not title_mode else None
        listed = re.match(sg.APPENDIX_CLAUSE, text)
        if title and title_mode:
            role, clause = "container", f"container-{made + 1}"
        elif inner:
            role, clause = "container", inner.group(1)
            container = clause
        elif number or listed:
            role, clause = "clause", (number or listed).group(1)
        elif title_mode and c["type"] == "text":
            role, clause = "clause", f"{chapter}-{made + 1}"
        made += role in ("container", "clause")
        out.append((role, ord_, chapter, container, clause))
    return out


def random_documents(seed, n=12):
    r = random.Random(seed)
    docs = {}
    for d in range(n):
        numbers = r.random() < 0.7
        chunks = []
        for k in range(r.choice([0, 1, 5, 40, 80])):
            ch, se, cl = r.randint(1, 4), r.randint(1, 4), r.randint(1, 5)
            kinds = ["text", "words", "title", "table", "image", "blank", "Preface"]
            kinds += ["ch", "ch.", "sec", "cl", "cl4", "app", "app2", "A.0.1", "must", "12", "sec"] if numbers else []
            kind = r.choice(kinds)
            content = {
                "ch": f"{ch} Chapter", "ch.": f"{ch}. Other\nline", "sec": f"{ch}.{se} Section", "cl": f"{ch}.{se}.{cl} clause 应 x", "cl4": f"{ch}.{se}.{cl}.1 deep", "app": "附录A", "app2": f"附录{r.choice('BC')} Extra words",
                "A.0.1": f"A.0.{cl} of appendix", "must": f"{ch}.{se}.{cl}必须", "12": "12", "blank": r.choice([None, "", " \n"]), "Preface": "前 言", "title": "A title",
            }.get(kind, f"{kind} {r.randint(0, 3)}\nmore {k}")
            type_ = "title" if kind in ("ch", "ch.", "app", "app2", "title", "Preface", "12") or (kind == "sec" and r.random() < 0.7) or r.random() < 0.05 else kind if kind in ("table", "image") else "text"
            bbox = r.choice([None, [], [float(r.randint(0, 9)), float(r.randint(0, 50)), 20.0, float(r.randint(50, 90))]])
            chunks.append({"source": f"d{d}", "chunk_seq": k * 3, "chunk_id": f"c{k}", "page_idx": k // 7, "type": type_, "content": content, "table_content": r.choice([None, "", "<t/>"]), "bbox": bbox, "page_height": r.choice([None, 0.0, 100.0])})
        docs[f"d{d}"] = chunks
    return docs


@pytest.mark.parametrize(("seed", "parts"), [(1, None), (2, 25), (3, 7)])
def test_blocks_and_sections(spark, seed, parts, monkeypatch):
    docs = random_documents(seed)
    r = random.Random(seed)
    plans = {d: (r.randint(1, 3), r.randint(2, 4), r.random() < 0.3) for d in docs}
    if parts:  # every document is several parts
        usual = sg.running
        monkeypatch.setattr(sg, "running", lambda *a: usual(*a, parts=parts))
    df = spark.createDataFrame([c for chunks in docs.values() for c in chunks], SCHEMA)
    plan = spark.createDataFrame([(d, *p) for d, p in plans.items()], "source string, chapter_depth int, container_depth int, title_mode boolean")
    placed = sg.blocks(df, plan)
    got = {(x["source"], x["chunk_seq"]): (x["role"], x["chapter_ord"], x["chapter"], x["container"], x["clause_id"]) for x in placed.collect()}
    want, whole, bare = {}, {}, {}
    for d, chunks in docs.items():
        states = plain(chunks, *plans[d])
        want |= {(d, c["chunk_seq"]): s for c, s in zip(chunks, states, strict=True)}
        for c, s in zip(chunks, states, strict=True):
            if s[1]:
                x = whole.setdefault((d, s[1]), [s[2], c["chunk_seq"], None, 0])
                x[2] = c["chunk_seq"] if (c["content"] or "").strip() else x[2]
                x[3] += s[0] in ("container", "clause")
        if chunks and not any(s[1] for s in states):
            whole[d, 0] = ["1", 0, chunks[-1]["chunk_seq"], 0]
        for (_, o), (chapter, a, z, n) in {k: v for k, v in whole.items() if k[0] == d}.items():
            texts = [c["content"].strip() for c, s in zip(chunks, states, strict=True) if s[1] == o and z is not None and a < c["chunk_seq"] <= z and c["type"] != "title" and (c["content"] or "").strip()]
            if not n and texts:
                bare[d, a] = (f"{chapter}-content", texts)
    assert got == want
    found = sg.sections(placed)
    assert {(x["source"], x["chapter_ord"]): [x["chapter"], x["start_seq"], x["end_seq"], x["n_clauses"]] for x in found.collect()} == whole
    last = {(d, v[0]): o for (d, o), v in sorted(whole.items())}
    assert {(x["source"], x["chapter"]): x["chapter_ord"] for x in sg.last_sections(found).collect()} == last
    rows = {(x["source"], x["seq"], x["clause_id"]): x for x in sg.clauses(placed).collect()}
    made = {(d, seq, s[4]) for (d, seq), s in want.items() if s[0] in ("container", "clause")}
    assert set(rows) == made | {(d, seq, id_) for (d, seq), (id_, _) in bare.items()}
    for (d, seq), (id_, texts) in bare.items():
        assert all(t.split("\n")[0] in rows[d, seq, id_]["content"] for t in texts)
    for (d, seq, id_), x in rows.items():
        if not id_.endswith("-content"):
            by_title = plans[d][2]
            members = [c for c in docs[d] if want[d, c["chunk_seq"]][4] == id_ or (want[d, c["chunk_seq"]][4] is None and not by_title and numbered(c) == id_ and not in_bare(d, c, want, bare, docs))]
            assert x["chunks"] == [c["chunk_id"] for c in members]
            pages = sorted({c["page_idx"] + 1.0 for c in members if c["bbox"]})
            assert [b[0] for b in x["boxes"] or []] == pages


def numbered(c):
    text = (c["content"] or "").strip()
    m = re.match(sg.CLAUSE, text) or re.match(sg.APPENDIX_CLAUSE, text)
    return m.group(1) if m else None


def in_bare(d, c, want, bare, docs):
    """Whether a block is in a chapter that keeps its blocks as one."""
    o = want[d, c["chunk_seq"]][1]
    start = 0 if not any(want[d, x["chunk_seq"]][1] for x in docs[d]) else min((x["chunk_seq"] for x in docs[d] if want[d, x["chunk_seq"]][1] == o and o), default=None)
    return (d, start) in bare and start < c["chunk_seq"]


def document(spark, lines, height=100.0):
    return spark.createDataFrame([("d", k, f"c{k}", p, t, x, None, b, height) for k, (t, x, p, b) in enumerate(lines)], SCHEMA)


def plan_of(spark, lines):
    r = sg.anchor_plan(document(spark, lines)).first()
    return r["chapter_depth"], r["container_depth"], r["title_mode"], r["avg_ratio"]


def test_plans(spark):
    box = lambda a, b: [0.0, float(a), 1.0, float(b)]
    chapters = [("title", f"{k} Chapter", k, box(0, 5)) for k in range(1, 4)]
    sections = [("title", f"{k}.1 Section", k, box(5, 20)) for k in range(1, 4)]
    assert plan_of(spark, [x for pair in zip(chapters, sections, strict=True) for x in pair]) == (1, 2, False, 0.11)
    assert plan_of(spark, [("text", "plain", 0, None)] * 3) == (2, 3, True, 1.0)
    assert plan_of(spark, [("title", "Intro", 0, None), ("title", "Use", 0, None), ("title", "End", 0, None), *chapters]) == (1, 2, False, 1.0)
    # sections take whole pages, their clauses a tenth
    large = [x for k in range(1, 4) for x in (("title", f"{k} Chapter", k, box(0, 1)), ("title", f"{k}.1 Section", k, box(1, 50)), *[("title", f"{k}.1.{j} Clause", k, box(10 * j, 10 * j + 10)) for j in range(1, 10)])]
    assert plan_of(spark, large) == (1, 3, False, 0.13)  # 27 tenths, and what follows the last of a page on the next: 2 halves


def test_no_blocks(spark):
    none = document(spark, [])
    placed = sg.blocks(none, sg.anchor_plan(none))
    assert placed.count() == sg.sections(placed).count() == sg.clauses(placed).count() == 0


def test_text_of_a_clause(spark):
    lines = [("title", "1 One", 0, None), ("text", "1.1.1 must\nrest", 0, [0.0, 1.0, 2.0, 3.0]), ("table", "Table 1", 0, [0.0, 0.0, 9.0, 2.0]), ("text", "1.1.1 must\nagain", 1, []), ("title", "2 Two", 1, None), ("text", "宜 a", 1, None), ("text", "b", 2, None)]
    df = document(spark, lines).na.fill("<t/>", ["table_content"])
    placed = sg.blocks(df, spark.createDataFrame([("d", 1, 2, False)], "source string, chapter_depth int, container_depth int, title_mode boolean"))
    rows = {r["seq"]: r for r in sg.clauses(placed).collect()}
    assert rows[1]["content"] == rows[3]["content"] == "1.1.1 must\nrest\nTable 1\n<t/>\nagain"
    assert rows[1]["boxes"] == [[1.0, 0.0, 0.0, 9.0, 3.0]] and rows[1]["chunks"] == ["c1", "c2", "c3"]
    assert (rows[4]["clause_id"], rows[4]["content"], rows[4]["requirement"], rows[4]["page_idx"], rows[4]["title"]) == ("2-content", "宜 a\nb", "recommended", 1, "Two")


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_running_values(spark, parts):
    r = random.Random(parts)
    rows = [(r.choice(["a", "b", None, "hot", "hot", "hot"]), k, r.choice([None, 1, 2]), r.choice([None, "x", "y"])) for k in range(200)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k long, n int, s string")
    values = {"last": (ordered.LAST, df.s), "total": (ordered.TOTAL, df.n), "lag": (ordered.LAG, df.s), "first": (ordered.FIRST, df.s)}
    for keys in (["g"], []):
        got = {(x["g"], x["k"]): (x["last"], x["total"], x["lag"], x["first"]) for x in ordered.running(df, keys, ["k"], values, parts).collect()}
        state, want = {}, {}
        for g, k, n, s in sorted(rows, key=lambda x: x[1]):
            last, total, before, first = state.get(g if keys else 0, (None, 0, None, s))
            want[g, k] = (s or last, total + (n or 0), before, first)
            state[g if keys else 0] = (s or last, total + (n or 0), s, first)
        assert got == want
    assert [x["place"] for x in ordered.numbered(df, [], ["k"], parts=parts).orderBy("k").collect()] == list(range(1, 201))
    assert ordered.running(df.limit(0), ["g"], ["k"], values, parts).count() == 0
