"""Hand-made cases of operators that the star schema doesn't reach."""

import pytest
from pyspark.sql import functions as F

from kgweave import plugins
from kgweave.functions import ids, layout, text
from kgweave.functions.vectors import cosine, similarity
from kgweave.operators import chunking, graph, records, retrieval, search, tabular


def one(df):
    return [tuple(r) for r in df.collect()]


def test_normalize_text_keeps_all_scripts(spark):
    df = spark.createDataFrame([("第5.2.8条 消防,  车道!",), (" A b-C ",), (None,)], "t string")
    assert [r[0] for r in df.select(text.normalize_text(F.col("t"))).collect()] == ["第528条消防车道", "abc", None]


def test_clause_ids_need_word_bounds(spark):
    df = spark.createDataFrame([("see 5.2.8 and 第5.2.9条, 1.2.3.",)], "t string")
    assert df.select(text.clause_ids(F.col("t"))).first()[0] == ["5.2.8", "1.2.3"]


@pytest.mark.parametrize(("t", "a", "b"), [("不得堵塞", "prohibited", "mandatory"), ("必须设置", "mandatory", "mandatory"), ("宜采用", "recommended", "recommended"), ("禁止", "prohibited", "prohibited"), ("必须不用", "prohibited", "mandatory"), ("none", "recommended", None)])
def test_requirement_classifiers_differ(spark, t, a, b):
    r = spark.createDataFrame([(t,)], "t string").select(text.requirement_first_ban(F.col("t")), text.requirement_first_must(F.col("t"))).first()
    assert tuple(r) == (a, b)


def test_chinese_numbers_add_ten_as_a_digit(spark):
    df = spark.createDataFrame([("三",), ("十二",), ("二三",), ("x",)], "t string")
    assert [r[0] for r in df.select(text.chinese_number(F.col("t"))).collect()] == [3, 102, 23, 0]


def test_natural_order(spark):
    labels = ["Appendix B", "10", "2", "1.10", "1.2", "Preface", "Appendix A"]
    df = spark.createDataFrame([(x,) for x in labels], "label string").orderBy(text.natural_key(F.col("label")))
    assert [r[0] for r in df.collect()] == ["2", "10", "1.2", "1.10", "Preface", "Appendix A", "Appendix B"]


def test_ngrams_of_short_texts(spark):
    df = spark.createDataFrame([("x" * 20,), ("x" * 21,), ("x" * 41,), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(F.size(text.ngrams(F.col("t")))).collect()] == [0, 1, 3, 0, 0]


def test_sentences_and_tokens(spark):
    df = spark.createDataFrame([("One. Two!三。Four 1.5 x",)], "t string")
    assert [s.strip() for s in df.select(text.sentences(F.col("t"))).first()[0]] == ["One.", "Two!", "三。", "Four 1.5 x"]
    assert df.select(text.tokens(F.lit("Fire 消防车 a"))).first()[0] == ["fire", "a", "消防", "防车"]


def test_sentence_rules(spark):
    texts = ["a;b", "Hi?No", "a\nb", "a\n\nb", "One. Two!", "  ", "", None, "x.y", "。。", " a ！ b"]
    want = [["a;", "b"], ["Hi?", "No"], ["a\nb"], ["a", "b"], ["One.", "Two!"], ["  "], [""], None, ["x.y"], ["。", "。"], ["a ！", "b"]]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert [r[1] for r in df.select("k", text.sentences(F.col("t"))).orderBy("k").collect()] == want


def test_ids(spark):
    r = spark.range(1).select(ids.node_id("entity", F.lit("g"), F.lit("泵")), ids.uuid_of(F.lit("g"), F.lit(None).cast("string"), F.lit("x")), ids.node_id("episode", F.lit("g"), F.lit(""), F.lit("text"))).first()
    import hashlib
    import uuid

    assert list(r) == [str(uuid.UUID(hashlib.md5(s.encode()).hexdigest())) for s in ("g:泵:entity", "g::x", "g:text")]


def test_cosine_of_zero(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [tuple(r) for r in df.select(cosine(F.col("a"), F.col("b")), similarity(F.col("a"), F.col("b"))).collect()] == [(1.0, 1.0), (0.0, 0.5), (0.0, 0.5)]


def test_rank_fusion_golden(spark):
    v = spark.createDataFrame([("a", 0.9), ("b", 0.8)], "key string, score double")
    k = spark.createDataFrame([("b", 5.0), ("c", 4.0)], "key string, score double")
    got = search.hybrid(v, k).orderBy(F.desc("rrf")).collect()
    assert [r["key"] for r in got] == ["b", "c", "a"]
    assert [r["rrf"] for r in got] == pytest.approx([1 / 62 + 2 / 61, 2 / 62, 1 / 61])
    assert got[0]["score"] == 1.0


def test_boost_moves_only_the_first_equal_name(spark):
    df = spark.createDataFrame([(1, "Pump", 0.2), (2, "pump ", 0.9), (3, "x", 0.5)], "key int, name string, score double")
    got = {r["key"]: (r["boosted"], r["score"]) for r in search.boost_exact(df, "name", " PUMP", [F.desc("score")]).collect()}
    assert got == {2: (True, 1.0), 1: (False, 0.2), 3: (False, 0.5)}


def test_upsert_policies(spark):
    schema = "k int, a string, b string, c string, d string"
    old = spark.createDataFrame([(1, "o", "o", "", "o"), (2, "o", None, "o", "o")], schema)
    new = spark.createDataFrame([(1, None, "n", "n", None), (3, "n", "n", "n", "n")], schema)
    got = tabular.upsert(old, new, ["k"], {"a": "overwrite", "b": "keep_first", "c": "keep_nonempty"}).orderBy("k")
    assert one(got) == [(1, None, "o", "n", "o"), (2, "o", None, "o", "o"), (3, "n", "n", "n", "n")]


def test_keep_longest_and_nameless(spark):
    df = spark.createDataFrame([("1", "ab", 0), ("1", "abc", 1), ("1", "xyz", 2), ("", "t", 3), (None, "t", 4)], "id string, t string, ord int")
    assert sorted(one(tabular.keep_longest(df, "id", "t", "ord").select("t", "ord"))) == [("abc", 1), ("t", 4)]


def test_page_ranges(spark):
    df = spark.createDataFrame([(1, p) for p in (1, 2, 3, 7, 7, 10)], "k int, page int")
    assert one(tabular.page_ranges(df, ["k"], "page")) == [(1, "P1~P3, P7, P7, P10")]


CLAUSES = "clause_id string, content string, topics array<struct<topic: string, entities: array<string>>>, terms array<struct<term_name: string, definition: string>>, images array<struct<img_path: string, caption: string>>, referenced_tables array<struct<table_id: string, caption: string, chunk_id: string>>, referenced_clauses array<string>"


def clauses(spark):
    return spark.createDataFrame(
        [
            ("5.1", "a", [("T1", ["pump", "valve"]), (" ", ["lost"])], [("term", "d")], [("i.png", "pic")], [("", "", "chunk_7")], ["5.2", "5.1", "9.9"]),
            ("5.2", "b", [("T2", ["pump"])], [("term", "")], [], [("t1", "Table", "c")], []),
            ("5.1.1", "c", [], [("orphan", "x")], [], [], []),
        ],
        CLAUSES,
    )


def test_document_graph(spark):
    nodes, edges = graph.build_document_graph(clauses(spark), "g")
    assert {(r["label"], r["n"]) for r in nodes.groupBy("label").agg(F.count("*").alias("n")).collect()} == {("Clause", 3), ("Topic", 2), ("Entity", 2), ("Term", 2), ("Image", 1), ("Table", 2)}
    assert {(r["rel"], r["n"]) for r in edges.groupBy("rel").agg(F.count("*").alias("n")).collect()} == {("HAS_TOPIC", 2), ("MENTIONS", 8), ("CROSS_REFERENCE", 1), ("PART_OF", 1)}
    again, _ = graph.build_document_graph(clauses(spark), "g")
    assert nodes.exceptAll(again).count() == 0


def test_neighbourhood_and_reach(spark):
    e = spark.createDataFrame([("g", "a", "r", "b"), ("g", "b", "r", "c"), ("g", "c", "r", "a"), ("g", "a", "r", "a"), ("g", "c", "r", "d")], "graph_id string, src string, rel string, dst string")
    assert sorted(one(graph.neighbourhood(e, "a"))) == [("b", 1), ("c", 1), ("d", 2)]
    starts = spark.createDataFrame([("a",)], "root string")
    assert sorted(one(graph.reach(e, starts, 3))) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 3)]


def test_path_search_shares_facts_once(spark):
    roots = spark.createDataFrame([("r1", "pump", 0, 0, 1.0), ("r2", "Valve", 0, 1, 1.0), ("r3", "none", 1, 0, 1.0)], "root string, name string, type_ord int, root_ord int, score double")
    mentions = spark.createDataFrame([("t1", "r1"), ("t1", "r2"), ("t2", "r2")], "topic string, root string")
    has = spark.createDataFrame([("c1", "t1"), ("c2", "t2"), ("c3", "t2")], "clause string, topic string")
    facts = spark.createDataFrame([("c1", "Fact one"), ("c2", "fact  ONE!"), ("c3", "two")], "clause string, fact string")
    got = retrieval.batch_path_search(roots, mentions, has, facts, 5, "valve").orderBy("place").collect()
    assert [(r["root"], r["n_facts"], r["place"]) for r in got] == [("r2", 1, 1), ("r1", 1, 2)]


def test_retrieval_flow_falls_back_to_all(spark):
    f = spark.createDataFrame([("a", "x", 1, 0.1225), ("a", "x", 2, 0.9), ("b", "y", 3, None)], "root string, fact string, ord int, s double")
    got = retrieval.retrieval_flow(f, F.col("s"), 50, 5).collect()
    assert [(r["ord"], r["score"]) for r in got] == [(1, 12.2), (3, 0.0)]


def test_segmentation(spark):
    rows = [("1 General", "title"), ("1.1 Scope", "text"), ("more", "text"), ("2 Rules", "title"), ("loose", "text"), ("2.1 Must", "text"), ("Appendix A", "title"), ("tail", "text")]
    chunks = spark.createDataFrame([("s", i, 0 if i < 3 else 1, k, t, [0.0, 10.0 * i, 5.0, 10.0 * i + 5]) for i, (t, k) in enumerate(rows)] + [("s", -1, 0, "text", "preface", [])], "source string, chunk_seq int, page_idx int, type string, content string, bbox array<double>")
    seg = {r["chunk_seq"]: (r["chapter"], r["clause"]) for r in chunking.segment(chunks).collect()}
    assert seg == {-1: ("0", None), 0: ("1", None), 1: ("1", "1.1"), 2: ("1", "1.1"), 3: ("2", None), 4: ("2", None), 5: ("2", "2.1"), 6: ("A", None), 7: ("A", None)}
    clause = {r["clause"]: (r["content"], r["boxes"]) for r in chunking.clause_texts(chunking.segment(chunks)).collect()}
    assert clause["1.1"] == ("1.1 Scope\nmore", [[1.0, 0.0, 10.0, 5.0, 25.0]])
    assert chunking.infer_anchors(chunks) == {"chapter_depth": 1, "container_depth": 2, "title_mode": False}


def test_split_text_windows():
    assert chunking.split_text(None) == [] and chunking.split_text("a" * 750) == ["a" * 750]
    parts = chunking.split_text("One two. " * 200, 500, 50)
    assert all(len(p) <= 500 for p in parts) and all(p.endswith(".") for p in parts[:-1])


def test_batches_by_capacity(spark):
    df = spark.createDataFrame([("c", i, n) for i, n in enumerate([100, 100, 2000, 100, 4000, 4000, 100])], "k string, i int, n int")
    got = {r["i"]: r["batch"] for r in chunking.capacity_batches(df, ["k"], "i", "n").collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5}


def test_positions_against_all_pairs(spark):
    from kgweave.operators import linking

    import random

    r = random.Random(6)
    word = lambda: r.choice(["pump", "fire lane", "a", "消防", "x y", "valve 3.2"])
    chunks = [(k, r.choice(["title", "text"]), r.choice(["", "3.1.2 ", "4.1 "]) + " ".join(word() for _ in range(r.choice([1, 3, 12, 30])))) for k in range(60)] + [(90, "text", None), (91, "text", "")]
    long = " ".join(f"word{k}" for k in range(30))
    chunks.append((95, "text", "starting: " + long))
    clauses = [("3.1.2", "z"), ("4.1", ""), ("m", None), ("c95", long[:150] + " other end"), ("none", "qqq")] + [(f"s{k}", chunks[k][2][: r.choice([1, 2, 3, 9, 40])]) for k in range(40)]
    want = {}
    for id_, text in clauses:
        text = (text or "").strip()
        kept = [(n, t, (x or "").strip()) for n, t, x in chunks]
        found = [(1, -(t == "title"), n) for n, t, x in kept if x.startswith(id_ + " ")]
        found += [(2, -len(text) / len(x), n) for n, _, x in kept if len(x) >= 10 and text and text in x and len(text) / len(x) >= 0.3]
        index = lambda x, step: [x[i : i + 20] for i in range(0, max(len(x) - 20, 0), step)]
        for n, _, x in kept:
            same = sum(index(x, 10).count(g) for g in index(text, 5))
            found += [(3, -same, n)] if same >= 3 else []
        if found:
            want[id_] = min(found)[2], min(found)[0]
    c, k = spark.createDataFrame(clauses, "clause_id string, content string"), spark.createDataFrame(chunks, "chunk_seq int, type string, content string")
    assert {x["clause_id"]: (x["chunk_seq"], x["tier"]) for x in linking.resolve_positions(c, k).collect()} == want
    assert {t for _, t in want.values()} == {1, 2, 3}


@pytest.mark.parametrize("tile", [8, 16, 4096])
def test_batches_over_tiles(spark, tile):
    import random

    r = random.Random(tile)
    rows = [(r.choice(["a", None, "hot", "hot"]), i, r.choice([None, 0, 10, 700, 1500, 1501, 4000])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, n int")
    got = {r["i"]: r["batch"] for r in chunking.capacity_batches(df, ["k"], "i", "n", tile=tile).collect()}
    want = {}
    for key in ("a", None, "hot"):
        batch, n, total, was_alone = -1, 0, 0, True
        for _, i, size in [x for x in rows if x[0] == key]:
            size = size or 0
            if was_alone or size > 1500 or n == 8 or total + size > 8000:
                batch, n, total = batch + 1, 0, 0
            want[i], n, total, was_alone = batch, n + 1, total + size, size > 1500
    assert got == want


def test_text_inside_tables_goes(spark):
    t = spark.createDataFrame([("s", 0, 1, [0.0, 0.0, 2.0, 2.0]), ("s", 0, 2, [8.0, 8.0, 12.0, 12.0]), ("s", 1, 3, [0.0, 0.0, 2.0, 2.0])], "source string, page_idx int, id int, bbox array<double>")
    boxes = spark.createDataFrame([("s", 0, [0.0, 0.0, 5.0, 5.0])], "source string, page_idx int, bbox array<double>")
    assert sorted(r["id"] for r in chunking.drop_text_in_tables(t, boxes).collect()) == [2, 3]
    assert spark.range(1).select(layout.upright(F.array(F.lit(1.0), F.lit(9.0), F.lit(2.0), F.lit(3.0)))).first()[0] == [1.0, 3.0, 2.0, 9.0]


def test_records(spark):
    from kgweave.sources.readers import APPS, PROJECTS

    projects = spark.createDataFrame([("p1", "A", "ok", "1", "1", 1, [], "g1", False), ("p2", "B", "ok", "2", "1", 1, [], "g2", True)], PROJECTS)
    flow = lambda ids, graphs: (ids, graphs, [], 0.0, 5, 0.0, 3)
    apps = spark.createDataFrame([("a1", "x", True, flow(["p1", "p2"], ["s"]), "1", "1"), ("a2", "y", True, flow(["p9"], ["s1", "s2"]), "1", "1"), ("a3", "z", False, flow(["p1"], []), "1", "1")], APPS)
    assert sorted(one(records.resolve_graphs(apps, projects).select("app_id", "graph_id"))) == [("a1", "g1"), ("a2", "s1"), ("a2", "s2")]
    assert sorted(one(records.resolve_graphs(apps, projects, "unlisted").select("app_id", "graph_id"))) == [("a1", "g1")]
    assert records.deletable(projects, apps.where("app_id = 'a2'")).count() == 2
    changed = records.with_project(apps, "a2", "p1").where("app_id = 'a2'").first()
    assert changed["workflow_data"]["selectedProjectIds"] == ["p9", "p1"]


def test_plugins(spark):
    df = spark.createDataFrame([(1, "Fire Pump must start."), (2, ""), (3, None)], "id int, t string")
    v = {r["id"]: r["embedding"] for r in plugins.embed(df, "t").collect()}
    assert abs(sum(x * x for x in v[1]) - 1) < 1e-5 and not any(v[2]) and not any(v[3])
    assert plugins.extract(df, "t").where("id = 1").first()["topics"][0]["entities"] == ["Fire Pump"]
    assert plugins.score(df, "fire valve", "t").orderBy("id").first()["score"] == 0.5
    assert plugins.repaired_json('```json\n{"a": [1, 2], "b": {"c": "d", "e": "f') == {"a": [1, 2], "b": {"c": "d", "e": "f"}}
    assert plugins.repaired_json("no") is None
    assert plugins.retried(lambda x: 1 / x, 0, 2, 0)[1].startswith("ZeroDivisionError")


def test_standards(spark):
    from kgweave.functions import standards as st

    r = spark.range(1).select(
        st.topic_core(F.lit("消防车道的要求")), st.topic_core(F.lit("及")), st.with_core(F.lit("水泵安装要求"), F.array(F.lit("阀门"))), st.with_core(F.lit("水泵安装要求"), F.array(F.lit("水泵"))),
        st.unit(F.lit("10.5 mm")), st.title(F.lit("x" * 101 + "\ny")), st.cross_references(F.lit("见5.2.8和5.2.9、5.2.8")), st.systems(F.lit("适用于TN-S系统，仅适用 IT 系统。It is said that it works, TT too")),
        st.scope_prefix(F.lit("2.0.1"), F.lit(False)), st.scope_prefix(F.lit("3.1"), F.lit(False)), st.scope_prefix(F.lit("A.0"), F.lit(True)), st.duration_text(F.lit(65_000)), st.base_status(F.lit("graph_building_failed")),
        st.markdown_cells(F.lit("| a | b |")), st.markdown_cells(F.lit("|---|---|")), st.image_placeholders(F.lit("x ![](a) y ![](b)"), F.array(F.lit("cap"))), F.length(st.sampled(F.lit("z" * 60_000))),
    ).first()
    assert list(r)[:4] == ["消防车道", None, ["阀门", "水泵"], ["水泵"]]
    assert r[4] == "mm" and r[5] == "x" * 100 + "..." and r[6] == ["5.2.8", "5.2.9"]
    assert [tuple(s) for s in r[7]] == [("TN", "-S"), ("IT", None)]
    assert list(r)[8:13] == ["2.0", "3", "A", "1m 5s", "failed"]
    assert r[13] == ["a", "b"] and r[14] is None and r[15] == "x [image 1: cap] y [image 2]" and 49_000 < r[16] < 50_300


def test_linking(spark):
    from kgweave.operators import linking

    chunks = spark.createDataFrame([(0, 0, "5.2.1 see 5.2.2", [0.0, 0.0, 1.0, 1.0], "text"), (1, 0, "5.2.1 again", [5.0, 5.0, 6.0, 6.0], "text"), (2, 3, "about 5.2.1", [2.0, 2.0, 3.0, 3.0], "text"), (3, 4, "表5.1.2 sizes", [], "table")], "chunk_seq int, page_idx int, content string, bbox_pdf array<double>, type string")
    clauses = spark.createDataFrame([("5.2.1", None, None), ("5.2.2", 9, [[1.0, 0.0, 0.0, 1.0, 1.0]]), ("9.9", None, None)], "clause_id string, page int, boxes array<array<double>>")
    got = {r["clause_id"]: (r["page"], r["boxes"]) for r in linking.backfill_pages(clauses, chunks).collect()}
    assert got == {"5.2.1": (0, [[0.0, 0.0, 0.0, 1.0, 1.0], [3.0, 2.0, 2.0, 3.0, 3.0]]), "5.2.2": (9, [[1.0, 0.0, 0.0, 1.0, 1.0]]), "9.9": (None, None)}
    long = "every pump shall be tested under full load before the system is handed over"
    c = spark.createDataFrame([("1.1", "title one"), ("8.8", long[:60]), ("7.7", "x" * 10)], "clause_id string, content string")
    k = spark.createDataFrame([(0, "1.1 Title"), (1, long), (2, long + " " + "filler " * 40)], "chunk_seq int, content string")
    assert sorted((r["clause_id"], r["chunk_seq"], r["tier"]) for r in linking.resolve_positions(c, k).collect()) == [("1.1", 0, 1), ("8.8", 1, 2)]
    assert [r["number"] for r in linking.table_chunks(chunks.withColumn("chunk_id", F.lit("c"))).collect()] == ["5.1.2"]
