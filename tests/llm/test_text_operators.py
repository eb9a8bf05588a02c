"""Token, packing, mixing, record, media and dedup operators against plain versions and round trips."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgweave.llm.components import components
from kgweave.llm import exact_dedup, line_dedup, mixing, packing, tiff, token_counts, token_records
from kgweave.llm.queries import QUERIES, SQL
from kgweave.llm.tokens import Encoder, public_path
from tests.oracle import connect, same

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def odd_texts(seed=1, n=400):
    r = random.Random(seed)
    alphabet = "ab cAB'sre \n\t  \r_.,!19éß'd 'vemll 字İ\x00\xa0²<|▁"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["", " ", "  ", "a ", "<|endoftext|> hi", None, "x" * 30_000, "the " * 9_000]


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    same(QUERIES[name](spark, DIR).toPandas(), connect(DIR).execute(SQL[name]).fetch_df())


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_library(file):
    from tokenizers import Tokenizer

    lib, texts = Tokenizer.from_file(public_path(file)), odd_texts()
    encode = Encoder(public_path(file), limit=50)  # small, so that generations turn over
    for k in range(0, len(texts), 64):
        part = texts[k : k + 64]
        assert [np.frombuffer(b, "<u4").tolist() for b in encode(part)] == [lib.encode(t or "", add_special_tokens=False).ids for t in part]


@pytest.mark.parametrize("file", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts(spark, file):
    texts = odd_texts(2)
    df = docs(spark, [(k, t, "s") for k, t in enumerate(texts)]).withColumn("n_tokens", F.lit(-1))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(df, public_path(file)).collect()}
    if file.endswith("model"):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=public_path(file))
        count = lambda t: len(lib.encode(t))
    else:
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(public_path(file))
        count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    assert got == {k: (len((t or "").encode()), count(t or "")) for k, t in enumerate(texts)}


def plain_best_fit(lengths, capacity):
    """Sequences of one-by-one best fit, longest first."""
    import bisect

    gaps = []
    opened = 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, n)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        opened += at >= len(gaps) and gap == capacity
        bisect.insort(gaps, gap - n)
    return opened


def test_plan_places_every_piece_once():
    r = np.random.RandomState(3)
    alike = r.randint(170, 180, 3000), r.randint(75, 105, 3000), np.array([512, 1, 1]), r.randint(1, 513, 3000)
    for make, lengths in [(packing.best_plan, x) for x in alike] + [(make, np.clip(r.lognormal(5, spread, 3000).astype(int), 1, 512)) for spread in (0.3, 1.0, 2.0) for make in (packing.plan, packing.plan_by_length, packing.best_plan)]:
        runs = make(dict(Counter(lengths.tolist())), 512)
        sequences = max(f + c for _, _, c, f, _ in runs)
        fill, ranks = np.zeros(sequences, int), defaultdict(list)
        for length, rank, count, first, offset in sorted(runs, key=lambda x: x[4]):
            assert (fill[first : first + count] == offset).all()  # gapless
            fill[first : first + count] += length
            ranks[length] += range(rank, rank + count)
        assert fill.max() <= 512 and {k: sorted(v) for k, v in ranks.items()} == {k: list(range(c)) for k, c in Counter(lengths.tolist()).items()}
        plain = plain_best_fit(lengths.tolist(), 512)
        assert sequences <= plain * 1.02 + 1 if make is packing.plan else sequences <= plain


def test_packing_documents(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    texts = [None, "", "a b c", "a b c", "one two " * 3000, *odd_texts(4, 60)]
    rows = packing.pack_documents(docs(spark, [(k, t, "s") for k, t in enumerate(texts)] + [(2, "a b c", "s"), (None, "x", None)]), public_path("word_bpe_49k.json")).collect()
    where = defaultdict(list)
    for r in rows:
        where[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in where.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    ids = np.array(lib.encode(texts[4], add_special_tokens=False).ids + [0], "<u4")
    mine = sorted((r for r in rows if r["doc_id"] == 4), key=lambda r: r["piece"])
    assert [(r["start"], r["length"], r["ids_crc32"]) for r in mine] == [(k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    assert sum(r["doc_id"] == 2 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1
    assert packing.pack_documents(docs(spark, []), public_path("word_bpe_49k.json")).count() == 0


def plain_targets(sizes):
    """Shares again and again until no target is above its bound."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(2.0 * sizes[s] for s in over)
        free -= over
    return target


def test_mixing_targets_and_copies(spark):
    r = random.Random(5)
    rows = [(k, " ".join(["w"] * r.randint(0, 400)), r.choice(["a", "a", "a", "b", "ü", None, "z"])) for k in range(3000)] + [(3000, None, "empty"), (3001, " \t", "empty")]
    df = docs(spark, rows).withColumn("size", F.lit("clash"))
    got = mixing.mix(df).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(dict(sizes))
    taken = Counter()
    for g in got:
        assert g["source_size"] == sizes[g["source"]] and g["target"] == pytest.approx(want[g["source"]], rel=1e-9)
        assert 0 <= g["copies"] <= 2
        taken[g["source"]] += g["copies"] * g["size"]
    for s, t in want.items():
        assert taken[s] == pytest.approx(t, rel=0.1)
    assert mixing.emit(docs(spark, rows)).count() == sum(g["copies"] for g in got)
    assert sorted((g["doc_id"], g["copies"]) for g in mixing.mix(df).collect()) == sorted((g["doc_id"], g["copies"]) for g in got)
    assert mixing.mix(docs(spark, [])).count() == 0


def test_taken_words_come_near_targets(spark):
    for sf, near in (("sf0.001", 0.03), ("sf0.01", 0.01)):
        d = f"/root/testdata/{sf}"
        sources = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source")
        got = mixing.op2_source_mixing(spark, d).join(sources, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
        assert got and all(abs(r["taken"] - r["target"]) <= near * r["target"] for r in got)


def test_null_and_repeated_ids_draw_by_text(spark):
    rows = [(None if k % 2 else 7, f"text {k} " + "w " * 100, "one") for k in range(200)] + [(k, "w " * 150, "two") for k in range(100)]
    got = mixing.mix(docs(spark, rows)).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 0.02 * r["target"] for r in got)


CLASHES = ("size", "source_size", "target", "copies", "copy", "rate", "k", "draw_a", "_source", "keep_id", "kept", "group_size", "text_sha256", "row", "norm", "salt", "score", "_kept", "component_id")


def test_stages_leave_clashing_columns_alone(spark):
    rows = [(k, f"words of text {k // 2} " * 3, "en", f"s{k % 3}", k) for k in range(12)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in CLASHES})
    for out in (mixing.emit(df), exact_dedup.kept_rows(df)):
        assert out.columns == df.columns
        got = out.collect()
        assert got and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in CLASHES)
    assert exact_dedup.kept_rows(df).count() == 6


def test_records_round_trip(spark, tmp_path):
    texts = odd_texts(6, 120)
    rows = [(k * 7 % len(texts), t, "s") for k, t in enumerate(texts)] + [(None, "null id", "s"), (3, "same id", "s")]
    path = f"file://{tmp_path}/records"
    token_records.write_records(docs(spark, rows), path, public_path("byte_bpe_50k.json"))
    index = token_records.index_records(spark, path)
    encode = Encoder(public_path("byte_bpe_50k.json"))
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for i, t, _ in ordered:
        ids = encode([t])[0] + bytes(4)
        want.append((i, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_records.with_starts(index).collect()), key=lambda r: r[1])
    assert got == want
    some = index.where("doc_id % 5 = 0")
    read = {(r["doc_id"], tuple(r["ids"])) for r in token_records.read_records(spark, some).collect()}
    assert read == {(i, tuple(np.frombuffer(encode([t])[0] + bytes(4), "<u4").tolist())) for i, t, _ in rows if i is not None and i % 5 == 0}


def test_records_of_string_ids(spark, tmp_path):
    rows = [("b", "two words"), ("a\ud7ff", "x"), (None, None), ("", "long " * 30_000), ("b", "again")]
    path = f"file://{tmp_path}/strings"
    token_records.write_records(spark.createDataFrame(rows, "doc_id string, text string").withColumn("bytes", F.lit(1)), path, public_path("byte_bpe_50k.json"))
    index = token_records.index_records(spark, path, "string")
    assert [r["doc_id"] for r in index.orderBy("shard", "offset").collect()] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or ""))
    encode = Encoder(public_path("byte_bpe_50k.json"))
    read = sorted((str(r["doc_id"]), r["ids"]) for r in token_records.read_records(spark, index, chunk=1000).collect())
    assert read == sorted((str(i), np.frombuffer(encode([t])[0] + bytes(4), "<u4").tolist()) for i, t in rows)
    with pytest.raises(ValueError):
        token_records.write_records(spark.createDataFrame([(0.5, "x")], "doc_id double, text string"), path, public_path("byte_bpe_50k.json"))


def test_records_tell_damage():
    good = token_records.frame(5, np.array([1, 70_000], "<u4").tobytes()) + token_records.END
    assert [(d, np.frombuffer(i, "<u4").tolist()) for _, _, d, i in token_records.walk(good)] == [(5, [1, 70_000])]
    for k in (0, 9, 15, len(good) - 2):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            list(token_records.walk(bytes(bad)))


def test_empty_records(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    token_records.write_records(docs(spark, []), path, public_path("byte_bpe_50k.json"))
    assert token_records.with_starts(token_records.index_records(spark, path)).count() == 0


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_round_trip(compression, predictor):
    r = random.Random(compression)
    for n in (64, 640, 64 * 700):
        payload = bytes(r.choice(b"aaaaab \0\xff") for _ in range(n))
        media = tiff.write(payload, page_rows=300, strip_rows=64, compression=compression, predictor=predictor)
        pages = list(tiff.read(media))
        assert b"".join(p.samples for p in pages) == payload and len(pages) == -(-n // 64 // 300)


def test_tiff_tiles_and_big_endian():
    import struct

    image = np.arange(40 * 20, dtype=np.uint8).reshape(20, 40)
    tiles = [np.pad(image[t : t + 16, l : l + 16], ((0, max(0, t + 16 - 20)), (0, max(0, l + 16 - 40)))).tobytes() for t in (0, 16) for l in (0, 16, 32)]
    head = bytearray(b"MM\0*" + struct.pack(">I", 0))
    offsets, packed = [], [tiff.pack_bits(t) for t in tiles]
    for p in packed:
        offsets.append(len(head))
        head += p
    lists = len(head)
    head += struct.pack(">6I", *offsets) + struct.pack(">6I", *map(len, packed))
    entries = [(256, 4, 1, 40), (257, 4, 1, 20), (258, 3, 1, 8 << 16), (259, 3, 1, tiff.PACKBITS << 16), (322, 4, 1, 16), (323, 4, 1, 16), (324, 4, 6, lists), (325, 4, 6, lists + 24)]
    struct.pack_into(">I", head, 4, len(head))
    head += struct.pack(">H", len(entries)) + b"".join(struct.pack(">HHII", *e) for e in entries) + struct.pack(">I", 0)
    page = next(tiff.read(bytes(head)))
    assert page.samples == image.tobytes() and page.parts == 6
    with pytest.raises(ValueError):
        list(tiff.read(b"PK\3\4"))


@pytest.mark.parametrize("form", tiff.FORMS)
def test_tiff_forms_round_trip(form):
    r = random.Random(5)
    compression, predictor, tiled = form
    for rows in (1, 63, 64, 700):
        payload = bytes(r.choice(b"aab \n\xff") for _ in range(64 * rows))
        media = tiff.write(payload, page_rows=300, strip_rows=64, compression=compression, predictor=predictor, tiled=tiled)
        assert b"".join(p.samples for p in tiff.read(media)) == payload


def test_tiff_errors_are_rows(spark):
    good = tiff.stored(bytes(64 * 9000))
    rows = [(1, 0, good), (2, 0, b"no image"), (None, None, None), (3, 0, good[: len(good) - 10]), (3, 0, b"")]
    got = tiff.tiff_pages(spark.createDataFrame(rows, "doc_id int, n_bytes long, media binary")).collect()
    assert [(r["doc_id"], r["page"], r["is_last"], r["error"] is None) for r in got] == [
        (1, 0, False, True), (1, 1, False, True), (1, 2, True, True), (2, None, True, False), (None, None, True, False),
        (3, 0, False, True), (3, 1, False, True), (3, None, True, False), (3, None, True, False),
    ]
    assert tiff.tiff_pages(spark.createDataFrame([], "doc_id int, n_bytes long, media binary")).count() == 0


def test_tiff_query_columns(spark):
    texts = [None, "", "a", "é" * 40, "same", "same", "z" * 300_000]
    df = docs(spark, [(k, t, "s") for k, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in tiff.tiff_pages(tiff.texts_to_tiff(df)).where("is_last").collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[4]["feature"] == got[5]["feature"] and got[4]["media_sha256"] == got[5]["media_sha256"] and got[6]["page"] == 1
    assert tiff.tiff_pages(tiff.texts_to_tiff(df), samples=True).count() == len(texts) + 1


def plain_dedup(rows):
    norm = lambda t: "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, k))
    out = {}
    for n, g in groups.items():
        first = min(g)
        for m in g:
            out[m[3]] = (rows[first[3]][0], len(g), m[3] == first[3], hashlib.sha256(n.encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot_rows", [1000, 3])
def test_exact_dedup(spark, hot_rows):
    rows = [(1, "a b"), (2, "ab "), (3, "ab  "), (4, None), (5, " \n"), (None, "ab"), (7, "A b"), (8, " x"), (9, "x")] + [(k, "hot " * (1 + k % 3)) for k in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keep_id", F.lit("clash")).withColumn("n", F.lit(1))
    got = exact_dedup.exact_duplicates(df, hot_rows=hot_rows).collect()
    want = Counter((rows[k][0], *v) for k, v in plain_dedup(rows).items())
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want
    twice = spark.createDataFrame([(1, "x"), (1, "x")], "doc_id long, text string")
    assert [r["kept"] for r in exact_dedup.exact_duplicates(twice, hot_rows=1).collect()].count(True) == 1
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fuzzy_lines(spark):
    line = "the quick brown fox jumps over the lazy dog near the old stone bridge by the river bank today"
    near = line.replace("lazy", "sleepy")
    other = "completely different words stand in this other line that nothing else repeats anywhere at all here"
    df = spark.createDataFrame([(1, f"{line}\n\nshort\n{other}"), (2, f"{near}\nSHORT \n{line}"), (3, None), (4, ""), (5, "short"), (None, line)], "doc_id long, text string").withColumn("row", F.lit(0))
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["dropped"]) for r in line_dedup.fuzzy_lines(df).collect()}
    assert got[1] == (4, 0, []) and got[2][0] == 3 and {1, 2} <= set(got[2][2]) and got[3] == (1, 0, []) and got[4] == (1, 0, []) and got[5] == (1, 1, [0]) and got[None] == (1, 1, [0])
    text = {r["doc_id"]: r["text"] for r in line_dedup.without_lines(df.select("doc_id", "text"), line_dedup.fuzzy_lines(df)).collect()}
    assert text[1] == f"{line}\n\nshort\n{other}" and text[5] == ""
    assert line_dedup.fuzzy_lines(df.where("false")).count() == 0


def test_lane_sums_are_simhashes(spark):
    r = random.Random(2)
    long = [r.choice("alpha beta gamma delta eps zeta".split()) for _ in range(1_700)]  # of many parts
    lines = [["alpha", "beta", "gamma", "delta", "beta"], long, long[:500], long[:501], long[:502]]
    got = {g["id"]: g for g in line_dedup.signatures(spark.createDataFrame([(i, " ".join(w), len(w)) for i, w in enumerate(lines)], "id long, norm string, n_words int")).collect()}
    for i, words in enumerate(lines):
        pairs = list(zip(words, words[1:]))
        h = [x[0] for x in spark.createDataFrame(pairs, "a string, b string").select(F.xxhash64("a", "b")).collect()]
        want = sum(1 << (lane * 10 + k) for lane in range(6) for k in range(10) if sum((x >> (lane * 10 + k)) & 1 for x in h) * 2 > len(h))
        assert got[i]["bits"] == want and (i == 0 or got[i]["pairs"] == len(pairs))


def test_verification_is_edit_similarity(spark):
    """Against plain distances, on texts that share beginnings, ends, words and little else."""
    r = random.Random(8)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    lines = []
    for _ in range(300):
        a = "".join(r.choice("ab c\u00e9d") for _ in range(r.randint(1, 40)))
        b = list(a)
        for _ in range(r.randint(0, 10)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randint(0, 1)] = r.choice(["", "x", " ", "yz"])
        lines += [a, "".join(b)]
    for edits in (5, 60, 300):  # long lines, with words put in and left out
        a = [r.choice("alpha be gam delta epsilon".split()) for _ in range(500)]
        b = list(a)
        for _ in range(edits):
            k = r.randrange(len(b))
            b[k : k + r.randint(0, 1)] = r.choice([["zz"], [], ["new", "one"]])
        lines += [" ".join(a), " ".join(b)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id long, norm string")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, len(lines), 2)], "a long, b long")
    got = {p["a"] for p in line_dedup.verified(pairs, df, 0.8).collect()}
    want = {i for i in range(0, len(lines), 2) if distance(lines[i], lines[i + 1]) <= int(max(len(lines[i]), len(lines[i + 1])) * 0.2 + 1e-9)}
    assert got == want and 50 < len(want) < 250


def similar_pairs(r, share):
    """Lines of 4 to 2,000 words, and each again with a share of its words replaced (one at least) by others of
    like length, so that the edit similarity stays at 0.8 or more (exactly measured by the caller)."""
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    for size in (4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 50, 100, 300, 600, 2000):
        for _ in range(12 if size < 300 else 4):
            line = [r.choice(words) for _ in range(size)]
            other = list(line)
            for at in r.sample(range(size), max(1, int(share * size))):
                other[at] = r.choice([w for w in words if len(w) <= len(line[at])])
            yield size, " ".join(line), " ".join(other)


@pytest.mark.parametrize("share", [0.0, 0.1, 0.2])
def test_recall_of_similar_lines(spark, share):
    lines, pairs = [], []
    for size, a, b in similar_pairs(random.Random(9), share):
        pairs.append((size, len(lines), len(lines) + 1))
        lines += [(len(lines), a, size), (len(lines) + 1, b, size)]
    df = spark.createDataFrame(lines, "id long, norm string, n_words int")
    at = {i: x for i, x, _ in lines}
    known = spark.createDataFrame([(a, b, at[a], at[b]) for _, a, b in pairs], "a long, b long, x string, y string")
    similar = {(r["a"], r["b"]) for r in known.where("levenshtein(x, y) <= floor(greatest(length(x), length(y)) * 0.2 + 1e-9)").collect()}
    groups = {r["node"]: r["component"] for r in line_dedup.line_groups(df).collect()}
    found = [(size, groups.get(a, -1) == groups.get(b, -2)) for size, a, b in pairs if (a, b) in similar]
    print(share, len(found), sorted(Counter(size for size, ok in found if not ok).items()))
    assert len(found) > 60 and sum(ok for _, ok in found) >= 0.95 * len(found)


def test_crowded_blocks_keep_their_similar_lines(spark, monkeypatch):
    """Lines that share most of their runs, but aren't similar, beside pairs that are: blocks above CROWD."""
    monkeypatch.setattr(line_dedup, "CROWD", 6)
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    passage = [word() for _ in range(40)]
    lines = []
    for _ in range(120):
        own = [word() for _ in range(60)]
        lines += [" ".join(own[:30] + passage + own[30:]), " ".join(own[:30] + passage + own[30:-1] + [word()])]
    df = spark.createDataFrame([(i, x, 100) for i, x in enumerate(lines)], "id long, norm string, n_words int")
    groups = {g["node"]: g["component"] for g in line_dedup.line_groups(df).collect()}
    met = sum(groups.get(i) == i and groups.get(i + 1) == i for i in range(0, len(lines), 2))
    print(met)
    assert met >= 0.95 * len(lines) / 2 and all(c // 2 == n // 2 for n, c in groups.items())


def test_similar_lines_meet(spark):
    words = "alpha bravo carbon delta echoes foxtrot golfer hotel indigo juliet kilogram limousine".split()
    ten, twenty = words[:10], words + [w[::-1] for w in words[:8]]
    replaced = lambda ws, at: " ".join("zz" if i in at else w for i, w in enumerate(ws))
    lines = [" ".join(ten), replaced(ten, {4}), " ".join(twenty), replaced(twenty, {3, 9, 14})]
    groups = {r["node"]: r["component"] for r in line_dedup.line_groups(spark.createDataFrame([(i, x, len(x.split())) for i, x in enumerate(lines)], "id long, norm string, n_words int")).collect()}
    assert groups == {0: 0, 1: 0, 2: 2, 3: 2}


def test_lines_are_similar_by_characters(spark):
    typos = "the quick brown foxes jump over the lazy dogs near some ancient bridge"
    lines = ["copyright 2023 example inc", "copyright 2024 example inc", typos, typos.replace("foxes", "faxes").replace("lazy", "lacy").replace("ancient", "anciant"), "数据处理流水线需要完整的结果集合", "数据处理流水线需要完整的结果集台", "short", "shirt", "wholly different"]
    groups = {r["node"]: r["component"] for r in line_dedup.line_groups(spark.createDataFrame([(i, x, len(x.split())) for i, x in enumerate(lines)], "id long, norm string, n_words int")).collect()}
    assert groups == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6, 7: 6}


def test_components_end_or_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    assert {r["component"] for r in components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(chain, rounds=1)


@pytest.mark.parametrize("n", [1, 300, 3837, 3838, 9000])
def test_lzw_tables_that_are_never_cleared(n):
    data = np.random.RandomState(n).randint(0, 256, n).astype(np.uint8)
    widths = [9, *np.concatenate([tiff._WIDTHS, np.full(n, 12)])[: n + 1].tolist()]  # the clearing, each byte by itself, the end
    bits = "".join(format(code, f"0{width}b") for code, width in zip([256, *data.tolist(), 257], widths, strict=True))
    packed = bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))
    assert tiff.unpack_lzw(packed) == data.tobytes()
