"""Hand-made cases of views, outlines, the stored index, state and plug-ins."""

from pyspark.sql import functions as F

from kgweave import plugins
from kgweave.functions import standards
from kgweave.operators import chunking, graph, linking, outline, retrieval, search, tabular, text_index, views
from kgweave.sources import readers, versioned, writers
from kgweave.streaming import state


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_upsert_keeps_rows_of_null_keys(spark):
    schema = "k string, v string"
    old, new = spark.createDataFrame([(None, "keep me"), ("a", "old")], schema), spark.createDataFrame([("a", "new"), ("b", "more")], schema)
    assert sorted(map(str, rows(tabular.upsert(old, new, ["k"], {})))) == ["('a', 'new')", "('b', 'more')", "(None, 'keep me')"]


def test_rows_of_no_graph_stay(spark):
    df = spark.createDataFrame([("g", 1), (None, 2), ("h", 3)], "graph_id string, n int")
    assert sorted(r[1] for r in rows(graph.delete_graph(df, "g"))) == [2, 3]


def test_edges_are_added_once_and_in_order(spark):
    schema = "src string, dst string, note string"
    old, new = spark.createDataFrame([("a", "b", "z")], schema), spark.createDataFrame([("a", "b", "a"), ("c", "d", "y"), ("c", "d", "x")], schema)
    assert sorted(rows(tabular.add_edges(old, new, ["src", "dst"]))) == [("a", "b", "z"), ("c", "d", "x")]


def test_versions_are_replaced_without_a_gap(spark, tmp_path):
    t = versioned.Versioned(spark, f"file://{tmp_path}/t")
    for n in range(4):
        t.replace(spark.createDataFrame([(n,)], "n int"))
        assert rows(t.read()) == [(n,)]
    assert t.version() == 4


def test_systems_and_references(spark):
    r = spark.range(1).select(standards.systems(F.lit("仅适用于TN-C-S系统；适用 it 系统；it is said")), standards.table_references(F.lit("见表5和表 5.1、表5.1.2，表5.1")), standards.formula_reference(F.lit("按式（3.1-2）")), standards.formula_reference(F.lit("none"))).first()
    assert [tuple(s) for s in r[0]] == [("TN", "-C-S"), ("it", None)] and r[1] == ["表5.1", "表5.1.2"] and r[2] == "3.1-2" and r[3] is None


def test_boxes_stay_with_their_chapter(spark):
    df = spark.createDataFrame([("s", "1", "1.1", 0, 0, [0.0, 0.0, 1.0, 1.0], "a"), ("s", "2", "1.1", 1, 3, [5.0, 5.0, 6.0, 6.0], "b")], "source string, chapter string, clause string, chunk_seq int, page_idx int, bbox array<double>, content string")
    assert sorted((r["chapter"], r["boxes"]) for r in chunking.clause_texts(df).collect()) == [("1", [[1.0, 0.0, 0.0, 1.0, 1.0]]), ("2", [[4.0, 5.0, 5.0, 6.0, 6.0]])]


def test_outline_without_chapters_and_before_them(spark):
    texts = spark.createDataFrame([("a", "lost\n1.1 One\nx\n1.2 Two\ny"), ("b", "lost\nnothing numbered"), ("c", None)], "source string, text string")
    got = sorted((r["source"], r["chapter_number"], r["title"], r["content"]) for r in outline.sections(texts).collect())
    assert got == [("a", 1, "1 Two", "1.1 One\nx"), ("a", 1, "第1章", "1.2 Two\ny")]


def test_paragraphs_of_clauses(spark):
    text = "3.1.2 必须\n3.1.2.1 first\n3.1.2.2 second\n3.1.3 宜\n\nAppendix"
    got = outline.clauses(spark.createDataFrame([("s", text)], "source string, text string")).orderBy("ord").collect()
    assert [(r["clause_id"], r["paragraphs"], r["requirement_type"]) for r in got] == [("3.1.2", ["1 first", "2 second"], "mandatory"), ("3.1.3", [], "recommended")]


def test_blank_searches_find_nothing(spark):
    n = spark.createDataFrame([("u1", ["Entity"], "pump", None, None, None, None, None, None)], "uuid string, labels array<string>, name string, topic string, clause_id string, caption string, img_path string, table_id string, table_content string")
    assert views.search_by_name(n, " ").count() == views.search_by_name(n, "pump", ["No!"]).count() == 0
    assert views.search_by_name(n, " PUMP").count() == 1
    assert views.valid_labels([" Clause ", "x", None, "a b"]) == ["Clause"]


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "消防车道 width", "g"), (2, "水泵 width width", "g"), (3, "消防 pump", "h"), (4, None, "g")], "key long, text string, scope string")
    index = text_index.Index(spark, f"file://{tmp_path}/clauses").build(docs, "key", F.col("text"), F.col("scope"))
    from kgweave.functions.text import tokens

    plain = {r["key"]: r["score"] for r in search.bm25(docs.where("scope = 'g'"), "key", tokens(F.coalesce("text", F.lit(""))), ["消防", "width"]).collect()}
    found = {r["key"]: r["score"] for r in index.search("消防 WIDTH", "g").collect()}
    assert found == plain and set(found) == {1, 2}
    assert rows(index.wildcard("防车", "g")) == [(1, 1.0)]
    plan = index.search("width", "g")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters" in plan and "token" in plan
    assert sorted(r["scope"] for r in text_index.indexes(spark, f"file://{tmp_path}").collect()) == ["g", "h"]
    assert search.degraded(text_index.Index(spark, f"file://{tmp_path}/none").search, "x") is None


def test_graphs_are_created_and_changed(spark):
    graphs = spark.createDataFrame([], graph.GRAPHS)
    one = graph.created_graph(graphs, "n", "2024-01-01")
    assert graph.created_graph(one, "n", "2024-01-01").count() == 1
    g = one.first()["graph_id"]
    assert graph.with_ontology(one, g, '{"a":1}').first()["ontology_json"] == '{"a":1}'


def test_terms_and_clauses_are_synced(spark):
    from tests.test_operators import clauses

    nodes, edges = graph.build_document_graph(clauses(spark), "g")
    again_n, again_e = graph.merged_clause(nodes, edges, clauses(spark).limit(1), "g")
    assert again_n.count() == nodes.count() and again_e.count() == edges.count()
    terms = spark.createDataFrame([("new term", "d"), ("", "x")], "term_name string, definition string")
    n, e = graph.synced_terms(nodes, edges, "g", "1.1", terms)
    assert n.count() == nodes.count() + 1 and e.where("rel = 'DEFINES'").count() == 1


def test_batches_edits_and_lines(spark):
    schema = "clause_id string, title string, terms array<struct<term_name: string, definition: string>>"
    c = spark.createDataFrame([("1.1", "t", [("a", "x"), ("b", "y")]), ("1.2", "u", [])], schema)
    got = {r["clause_id"]: r for r in linking.edited(c, "1.1", {"title": "new"}, spark.createDataFrame([("a", "z")], "term_name string, definition string")).collect()}
    assert got["1.1"]["title"] == "new" and sorted(map(tuple, got["1.1"]["terms"])) == [("a", "z"), ("b", "y")] and got["1.2"]["title"] == "u"
    facts = spark.createDataFrame([(1, "f", "s", 2, [[1.0, 2.0]]), (2, "g", None, None, None)], "ord int, fact string, source string, page int, boxes array<array<double>>")
    lines = rows(retrieval.answer_lines(facts, "ord").orderBy("ord").select("line", "link"))
    assert lines[0][0] == "[1] f (s, P2)" and lines[1] == ("[2] g (, P?)", "?page=&bboxes=%5B%5D")


def test_recovery_and_retry(spark):
    schema = "pipeline_id string, status string, stages array<struct<name: string, status: string>>"
    p = spark.createDataFrame([("a", "running", [("parse", "parse_completed"), ("build", "build_processing")]), ("b", "completed", [])], schema)
    got = {r["pipeline_id"]: r for r in state.recovered(p).collect()}
    assert got["a"]["status"] == "pending" and [s["status"] for s in got["a"]["stages"]] == ["parse_completed", "pending"] and got["b"]["status"] == "completed"


def test_models_stand_ins(spark):
    assert plugins.salvaged_json('{"bio": "a\nb", "persona": "cut', "N", "K") == {"bio": "a b", "persona": "cut", "_fixed": True}
    assert plugins.salvaged_json('{"bio": "x" "persona": "y', "N", "K", "s") == {"bio": "x", "persona": "y", "_fixed": True}
    assert plugins.salvaged_json(None, "N", "K") == {"bio": "K: N", "persona": "N is a K."}
    assert plugins.tagging_mode(["Person", "MediaOutlet", "Pump"]) == "social" and plugins.tagging_mode(["Pump"]) == "engineering"
    assert plugins.filtered_facts("red pump", ["a pump", "b", "c"]) == ["a pump"] and plugins.filtered_facts("x", list("abcdefg")) == list("abcde")
    plugins.register("filter", "broken")(lambda q, f: 1 / 0)
    assert plugins.filtered_facts("x", ["a", "b"], "broken") == ["a", "b"]
    assert [t["relation"] for t in plugins.rule_triplets("A pump has a valve. It is red.")] == ["has", "is"]
    assert [c["chapter_number"] for c in plugins.numbered_contents("1 One\n1.1 Two\nx")] == ["1", "1.1"]
    assert plugins.rule_tagger("Alpha meets Beta.", ("Thing",))["relations"][0]["target"] == "Beta"
    made = plugins.mapped(spark.createDataFrame([("x",), (None,)], "t string"), "t", "chat", "string", "echo").collect()
    assert [(r["result"], r["result_error"]) for r in made] == [("{}", None), ("{}", None)]
    told = []
    p = plugins.Progress(spark, 3, lambda done, total: told.append((done, total)))
    p.counted(spark.range(3)).count()
    p.report()
    assert told == [(3, 3)]
    calls, clock = [], [0.0]
    for at in (0.0, 10.0, 31.0):
        clock[0] = at
        plugins.remembered(("q", 1), lambda: calls.append(1) or len(calls), now=lambda: clock[0])
    assert len(calls) == 2


def test_more_sources(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"12345")
    (tmp_path / "b.bin").write_bytes(b"1")
    assert readers.objects(spark, [str(tmp_path / "a.bin"), str(tmp_path / "b.bin")], 3).select("length").collect()[0][0] == 1
    broken = readers.remote_pages(spark.createDataFrame([(0, "ok"), (1, "bad")], "page_idx int, request string"), lambda r: r.upper() if r == "ok" else 1 / 0, 1)
    assert sorted((r["page_idx"], r["body"], r["error"] is None) for r in broken.collect()) == [(0, "OK", True), (1, None, False)]
