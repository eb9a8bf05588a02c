"""Rolling window features, URL filters and periodic runs against plain versions, with odd rows."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgweave.llm import periodic, rolling, url_filter

EVENTS = "id long, source string, lang string, length long, event_s long"


# ---- rolling windows


def plain_windows(rows, windows):
    out = set()
    for id_, source, _, _, t in rows:
        for w in windows:
            inside = [r for r in rows if t is not None and r[1] == source and r[4] is not None and t - w <= r[4] < t]
            lengths = sorted(r[3] for r in inside if r[3] is not None)
            m = len(lengths)
            kth = lambda part, whole: lengths[-(-part * m // whole) - 1] if m else None  # noqa: B023, E731
            out.add((id_, t, w, len(inside), sum(lengths), len({r[2] for r in inside} - {None}), kth(1, 2), kth(90, 100)))
    return out


def windows_of(df, windows):
    names = ["id", "event_s", "window_s", "n_events", "sum_chars", "n_langs", "median_chars", "high_chars"]
    return [tuple(r) for r in rolling.with_features(df, windows).select(*names).collect()]


@pytest.mark.parametrize("windows", [(600, 43200), (1, 7), (5,)])
def test_windows(spark, windows):
    r = random.Random(3)
    span = 5 * max(windows)
    rows = [(k, r.choice([None, "", "a", "b", "a", "a"]), r.choice([None, "en", "de", "fr", ""]), r.choice([None, 0, 1, 5, 5, r.randint(0, 10**6)]), r.choice([None, r.randint(-span, span), 0, 60 * r.randint(0, 9)])) for k in range(300)]
    got = windows_of(spark.createDataFrame(rows, EVENTS), windows)
    assert len(got) == 300 * len(windows)
    assert set(got) == plain_windows(rows, windows)


def test_windows_hot_time_repeats_and_clashing_names(spark):
    rows = [(k, "a", "en", k % 3, 10) for k in range(200)] + [(k, "a", None, None, 11) for k in range(200)] + [(7, "a", "en", 1, 12), (7, "a", "en", 1, 12)]
    df = spark.createDataFrame(rows, EVENTS).withColumns({"t": F.lit(1), "window_s": F.lit("x"), "found": F.lit(2), "tile": F.lit(3)})
    got = windows_of(df, (1, 2))
    assert len(got) == 2 * len(rows) and set(got) == plain_windows(rows, (1, 2))
    assert {"t", "tile", "found"} <= set(rolling.with_features(df, (1,)).columns)


def test_windows_of_nothing(spark):
    assert windows_of(spark.createDataFrame([], EVENTS), (600, 43200)) == []
    assert windows_of(spark.createDataFrame([(None, None, None, None, None)], EVENTS), (5,)) == [(None, None, 5, 0, 0, 0, None, None)]


def test_windows_span_many_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k, "ab"[k % 2], "en", k * 37 % 101, k * 3 % 50) for k in range(150)]
        assert set(windows_of(spark.createDataFrame(rows, EVENTS), (10, 40))) == plain_windows(rows, (10, 40))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 4)), min_size=1, max_size=40), st.data())
def test_wavelet_matrix(pairs, data):
    codes, weights = (np.array(x) for x in zip(*pairs, strict=True))
    left = data.draw(st.integers(0, len(pairs) - 1))
    right = data.draw(st.integers(left + 1, len(pairs)))
    flat = sorted(np.repeat(codes[left:right], weights[left:right]).tolist())
    every = np.arange(1, len(flat) + 1)
    found = rolling.WaveletMatrix(codes, weights).kth(np.full(len(flat), left), np.full(len(flat), right), every)
    assert found.tolist() == flat


@pytest.mark.parametrize("id_", [0, 1, 5, 9999, -1, -17, 123456789012, None, 2**63 - 1])
def test_event_seconds(spark, id_):
    found = spark.createDataFrame([(id_,)], "i long").select(rolling.event_seconds(F.col("i"))).first()[0]
    want = None if id_ is None else 60 * ((id_ + zlib.crc32(str(id_).encode()) % 10000) // 6)
    assert found == (None if want is None or want >= 2**63 else want)


# ---- URLs

ODD_URLS = [
    None, "", "no scheme", "http://", "HTTP://Example.ORG", "http://example.org/es/", "https://www.example.org/es/x?y#z", "http://notexample.org/es/1", "http://example.org/en/1513.html", "http://a.b.example.org/en/2",
    "ftp://x.com/fr/", "http://x.com/FR/", "http://m.x.com/de/5/", "http://org/", "http://org", "http://x.org?q=/de/", "http://x.net/a?b=2&utm_source=f&a=1#t", "http://www.x.net/a/?a=1&b=2", "http://ÄX.com/de/", "a://b://c/d", "x" * 50_000 + "://y.net/" + "z" * 50_000,
    "http://x.net/a?&&utm_=1", "http://x.net:80/a.html", "http://x.net/b", "http://user@x.com:8080/de/\nq", "http://x.net/a?refer=1",
]


def plain_rule(url):
    _, mark, rest = (url or "").partition("://")
    rest = rest if mark else ""
    stop = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:stop])
    path = rest[stop : min([rest.find(c, stop) for c in "?#" if c in rest[stop:]] or [len(rest)])]
    fitting = [(text, says) for says, text in url_filter.RULES if ("." + host).endswith("." + text.partition("/")[0]) and path.startswith("/" + text.partition("/")[2])]
    rule, says = max(fitting, key=lambda f: len(f[0]), default=(None, None))
    return host, path, rule, says


def canonicals(spark, urls):
    return [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(url_filter.canonical(F.col("u"))).collect()]


def test_canonical_urls(spark):
    same = ["http://www.x.net/a/?b=2&a=1", "https://X.net:443/a.html?a=1&b=2&utm_medium=q#top", "http://m.x.net/a?a=1&&b=2&ref=z"]
    assert set(canonicals(spark, same)) == {"x.net/a?a=1&b=2"}
    assert canonicals(spark, [None, "", "x.net/a", "http:///a"]) == [None] * 4


@pytest.mark.parametrize("most_blocks", [1, 1 << 18])  # one block passes nearly all; the join must judge them
def test_urls(spark, most_blocks):
    urls = ODD_URLS + [f"http://h{k}.net/{k % 50}" for k in range(400)] + ["http://x.net/a"] * 50
    listed = ["https://x.net/a", "http://x.com/de/never", None, "junk", *[f"https://www.h{k}.net/{k % 50}.html" for k in range(0, 400, 7)]]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").withColumns({"block": F.lit(1), "canonical": F.lit("mine"), "w0": F.lit(2), "key": F.lit(3)})
    got = url_filter.filter_urls(pages, spark.createDataFrame([(u,) for u in listed], "url string"), most_blocks=most_blocks)
    found = {r["page_id"]: r for r in got.collect()}
    known = set(canonicals(spark, listed)) - {None}
    on_list = [c in known for c in canonicals(spark, urls)]
    assert len(found) == len(urls) and {"block", "canonical", "w0", "key"} <= set(got.columns)
    for k, u in enumerate(urls):
        host, path, rule, says = plain_rule(u)
        r = found[k]
        assert (r["host"], r["path"], r["rule"], r["listed"]) == (host, path, rule, on_list[k])
        assert r["verdict"] == (says or ("block" if on_list[k] else "allow"))
        assert r["possible"] or not r["listed"]
    if most_blocks > 1:
        assert sum(r["possible"] for r in found.values()) < sum(on_list) + 20  # the filter does filter


def test_no_urls(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    some = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/")], "page_id long, url string")
    assert url_filter.filter_urls(none, some.select("url")).count() == 0
    assert [r["verdict"] for r in url_filter.filter_urls(some, none.select("url")).collect()] == ["allow"] * 2


# ---- periodic runs


def plain_runs(words):
    n, found = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(24, 3 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, length, p) for (s, length), p in found.items())


def plain_collapsed(words, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def tandem_texts(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        words = []
        for _ in range(r.randint(0, 5)):
            unit = [r.choice("abcd") * r.randint(1, 2) for _ in range(r.choice([1, 1, 2, 3, 7, 8, 9, 24, 40]))]
            words += (unit * r.randint(1, 30))[: r.randint(1, 150)] + [r.choice("abxyz") for _ in range(r.choice([0, 0, 3, 30]))]
        out.append(r.choice([" ", "  ", "\n", "\t \x0b"]).join(words))
    return out


def test_runs(spark):
    texts = tandem_texts(5, 150) + [None, "", " \t\n", "a", "a " * 23, "a " * 24, " " + "a b " * 12, "a\xa0b " * 30, "é ü " * 40, "x y " * 20_000, "w" * 100_000, " ".join(map(str, range(30_000))), "a " * 23 + "b " + "a " * 23]
    df = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumns({"runs": F.lit(1), "id": F.lit("x")})
    got = sorted(((tuple(map(tuple, r["runs"])), r["collapsed"]) for r in periodic.periodic_runs(df).collect()))
    want = []
    for t in texts:
        words = [w.decode() for w in (t or "").encode().split()]
        runs = plain_runs(words) if len(words) < 3000 else [(0, 40_000, 2)] if words[0] == "x" else []
        want.append((tuple(runs), plain_collapsed(words, runs)))
    assert got == sorted(want)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=90), max_size=4), st.integers(1, 30), st.integers(1, 5))
def test_runs_of_few_words(lists, period, times):
    documents = [np.array((d[:period] * times + d)[:150], np.int64) for d in lists]
    assert periodic.find_runs(documents) == [plain_runs(d.tolist()) for d in documents]


def test_one_word_over_and_over():
    n = 60_000  # every period fits; all but the first are skipped
    assert periodic.find_runs([np.zeros(n, np.int64), np.arange(n) % 7]) == [[(0, n, 1)], [(0, n, 7)]]


def test_short_runs_are_refused():
    with pytest.raises(ValueError):
        periodic.find_runs([], least=8)
    with pytest.raises(ValueError):
        periodic.find_runs([], times=2)


def test_query_of_runs_with_odd_rows(spark, tmp_path):
    texts = [t for t in tandem_texts(8, 40) if t] + ["one two three four five six seven", "", "  "]
    rows = [(k, t) for k, t in enumerate(texts * 4)] + [(10, None), (None, "a " * 30), (3, "b c " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for id_, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        h, n = zlib.crc32(("" if id_ is None else str(id_)).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.add((id_, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{x},{p}\n" for s, x, p in runs)), sha(plain_collapsed(words, runs))))
    got = periodic.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want
