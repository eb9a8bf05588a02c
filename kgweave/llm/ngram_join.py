"""N-gram Jaccard self-join by adaptive multi-match prefixes, and the components of its links.

A document's set is its distinct five-word shingles, as 48-bit hashes in hash order. Two sets with
similarity >= 0.8 share a token among the first P = n - ceil(0.8 n) + 1 of each, and more generally so many
of these that what is left of the longer one can't make up for what is missing: that count is asked for
before a pair's whole sets are compared. Prefixes are `slack` tokens longer than P, so that every similar
pair shares at least 1 + slack.

Estimated cost makes prefixes longer still. A token that many unlinked documents hold is costly. A pair
that shares a cheap prefix token is a candidate already. Any other similar pair has more than slack costly
tokens in both its prefixes. Such documents' prefixes grow by one token for each costly one, and one more
shared token is needed, so that at least one of those shared is cheap: candidates come from cheap tokens
only. A document with too few cheap tokens is saturated; pairs of two such are compared within clusters of
documents that share prefix tokens, in blocks of bounded size, of which only spanning links leave.

Groups of copies never make all their pairs: equal sets are one node, and first each document is
compared with its tokens' smallest node only. Documents already connected are not compared again.

Hashes: words and shingles by 64 bits mixed down to 48, sets by 128 (nodes of sets that share 64 are told
apart). Chances of a wrong answer are about n * n / 2^48 for a pair of sets of n shingles, and N * N / 2^129
that any two of N sets are taken as equal."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import apart, documents, map_arrow, slices, struct
from .common import materialise as written
from .components import components

WORDS, PERCENT = 5, 80
#: A token is costly from so many unlinked components on (more if too many tokens were), and so many
#: costly tokens are broadcast at most; the rest stay ordinary tokens.
COSTLY, COSTLY_TOKENS = 8, 1 << 20
BLOCK_DOCS, BLOCK_TOKENS = 512, 1 << 19
#: Nodes that a comparison needs are told to the scan of whole sets by hash buckets, so many at most.
BUCKETS = 1 << 20
_K = np.uint64(0x9E3779B97F4A7C15)
_UPPER = re.compile("[A-Z]+")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """A scratch table, with small batches for Python: sorts of whole sets need the memory beside it."""
    return written(df, tag, batch="4m")


class _Words(dict):
    """word: its 64-bit hash; starts anew beyond a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v


def shingle_hashes(texts: list[str | None], words: int = WORDS, known: dict | None = None) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 48-bit hashes; fewer words make one, none make none."""
    get = (_Words() if known is None else known).__getitem__
    out = []
    for text in texts:
        parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII spaces
        a = np.fromiter(map(get, parts), np.uint64, len(parts))
        width = min(words, len(a))
        h = np.full(len(a) - width + 1 if len(a) else 0, width, np.uint64)
        for k in range(width):
            h = (h ^ (h >> np.uint64(29))) * _K + a[k : k + len(h)]
        h = (h ^ (h >> np.uint64(32))) * _K
        out.append(np.unique((h ^ (h >> np.uint64(29))) >> np.uint64(16)))
    return out


def pack48(a: np.ndarray) -> bytes:
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(b: bytes) -> np.ndarray:
    wide = np.zeros((len(b) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def slack(n):
    """How many tokens more a first prefix has; of numbers and of columns."""
    return F.floor(n / 32) + 2 if isinstance(n, Column) else n // 32 + 2


def shingle_sets(df: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, node (the set's hash; null without words), tokens."""

    def run(batches):
        known = _Words()
        for batch in batches:
            for rows in slices(batch, "text", 1 << 19):
                sets = shingle_hashes(rows["text"], words, known)
                packed = [pack48(s) for s in sets]
                nodes, checks = ([xxhash.xxh3_64_intdigest(b, seed) - (1 << 63) if b else None for b in packed] for seed in (0, 1))
                yield {"doc_id": rows["doc_id"], "n_shingles": [len(s) for s in sets], "node": nodes, "check": checks, "text_hash": rows["text_hash"], "tokens": packed}

    kind = df.schema["doc_id"].dataType.simpleString()
    return map_arrow(df.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), run, f"doc_id {kind}, n_shingles long, node long, check long, text_hash long, tokens binary")


def told_apart(sets: DataFrame) -> DataFrame:
    """sets, where different sets have different nodes: those of one node that differ in the other 64 bits of their
    hash get new ones. Seldom any do."""
    same = sets.where("node is not null").groupBy("node").agg(F.min("check").alias("least"), F.max("check").alias("most")).where("least <> most")
    same = materialise(same.select("node", "least"), "same")
    if not same.limit(1).count():
        return sets
    found = sets.join(same, "node", "left")
    new = F.when(F.col("check") != F.col("least"), F.xxhash64("node", "check")).otherwise(F.col("node"))
    return materialise(found.withColumn("node", new).select(*sets.columns), "sets")


def postings(sets: DataFrame, percent: int) -> DataFrame:
    """token, node, n: the first tokens of each node in hash order, P and slack."""

    def run(batches):
        for batch in batches:
            seen, out, total = set(), [], 0
            for node, n, tokens in zip(batch["node"].to_pylist(), batch["n_shingles"].to_pylist(), batch["tokens"], strict=True):
                if not n or node in seen:
                    continue
                seen.add(node)
                size = min(n, prefix_length(n, percent) + slack(n))
                out.append((unpack48(tokens.as_py()[: 6 * size]).astype(np.int64), node, n))
                total += size
                if total > 1 << 16:
                    yield _rows(out)
                    out, total = [], 0
            if out:
                yield _rows(out)

    return map_arrow(sets.select("node", "n_shingles", "tokens"), run, "token long, node long, n long")


def longer_postings(sets: DataFrame, percent: int, costly, explore: bool = False) -> DataFrame:
    """token, node, n, saturated, cheap: of nodes with over slack costly tokens among their first ones, a prefix
    longer by as many as are costly: P cheap tokens in hash order. A node with too few of them adds costly
    ones, the least costly first. With explore, all tokens of such nodes.

    costly: broadcast (sorted tokens, their ranks by cost; how many of them, from the first on, tell nodes)."""

    def run(batches):
        heavy, rank, telling = costly.value
        for batch in batches:
            seen, out, total = set(), [], 0
            for node, n, tokens in zip(batch["node"].to_pylist(), batch["n_shingles"].to_pylist(), batch["tokens"], strict=True):
                if not n or node in seen:
                    continue
                seen.add(node)
                raw = tokens.as_py()
                size = prefix_length(n, percent)
                first = unpack48(raw[: 6 * min(n, size + slack(n))]).astype(np.int64)
                at = np.minimum(np.searchsorted(telling, first), len(telling) - 1)
                if int((telling[at] == first).sum()) <= slack(n):
                    continue
                t = unpack48(raw).astype(np.int64)
                if explore:
                    out.append((t, node, n, False, np.ones(n, bool)))
                else:
                    at = np.minimum(np.searchsorted(heavy, t), len(heavy) - 1)
                    flags = heavy[at] == t
                    cheap = t[~flags][:size]
                    rest = np.flatnonzero(flags)
                    rest = rest[np.argsort(rank[at[rest]])][: size - len(cheap)]
                    out.append((np.concatenate([cheap, t[rest]]), node, n, len(rest) > 0, np.r_[np.ones(len(cheap), bool), np.zeros(len(rest), bool)]))
                total += len(out[-1][0])
                if total > 1 << 16:
                    yield _rows(out)
                    out, total = [], 0
            if out:
                yield _rows(out)

    return map_arrow(sets.select("node", "n_shingles", "tokens"), run, "token long, node long, n long, saturated boolean, cheap boolean")


def _rows(out: list) -> dict:
    sizes = [len(o[0]) for o in out]
    spread = lambda k, kind: np.repeat(np.array([o[k] for o in out], kind), sizes)
    rows = {"token": np.concatenate([o[0] for o in out]), "node": spread(1, np.int64), "n": spread(2, np.int64)}
    if len(out[0]) > 3:
        rows |= {"saturated": spread(3, bool), "cheap": np.concatenate([o[4] for o in out])}
    return rows


def live(posted: DataFrame) -> DataFrame:
    """Postings of tokens that more than one node has, once each, with the token's smallest node as lead.

    Tokens' minima are summed per task before they are shuffled. The join is written as it is, so that adaptive
    execution can split a hot token's rows; repeated ones go by a shuffle over token and node."""
    shared = posted.groupBy("token").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead <> last").drop("last")
    return materialise(posted.join(shared, "token"), "posted").distinct()


def needed(a: str, b: str, percent: int, slacked: bool) -> Column:
    """How many shared prefix tokens a pair of sizes a, b must have: what it shares at least, without what can
    be shared beyond the longer rest."""
    n, m = F.col(a), F.col(b)
    least = F.ceil(percent * (n + m) / (100 + percent))
    rest = lambda x: F.greatest(F.ceil(percent * x / 100) - 1 - (slack(x) if slacked else F.lit(0)), F.lit(0))
    return least - F.greatest(rest(n), rest(m))


def close(a: str, b: str, percent: int) -> F.Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def verified(pairs: DataFrame, sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of pairs of nodes (a, b) those whose whole sets are similar."""
    known = nodes.select("node", "rep")
    p = materialise(pairs.select("a", "b"), "pairs")
    p = p.join(known.select(F.col("node").alias("a"), F.col("rep").alias("rep_a")), "a").join(known.select(F.col("node").alias("b"), F.col("rep").alias("rep_b")), "b")
    # a bounded table of buckets keeps most whole sets that no pair needs out of the shuffle
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
    wanted = p.select(F.explode(F.array(bucket("a"), bucket("b"))).alias("bucket")).distinct()
    whole = sets.select("node", "doc_id", "tokens").join(F.broadcast(wanted), bucket("node") == F.col("bucket"), "left_semi")
    one = whole.select(F.col("node").alias("a"), F.col("doc_id").alias("rep_a_"), F.col("tokens").alias("tokens_a"))
    two = whole.select(F.col("node").alias("b"), F.col("doc_id").alias("rep_b_"), F.col("tokens").alias("tokens_b"))
    p = p.join(one, (p.a == one.a) & p.rep_a.eqNullSafe(one.rep_a_)).select(p.a, p.b, "rep_b", "tokens_a")
    p = p.join(two, (p.b == two.b) & p.rep_b.eqNullSafe(two.rep_b_)).select(p.a, p.b, "tokens_a", "tokens_b")

    def run(batches):
        for batch in batches:
            found = []
            for a, b, x, y in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["tokens_a"], batch["tokens_b"], strict=True):
                x, y = unpack48(x.as_py()), unpack48(y.as_py())
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    found.append((a, b))
            yield {"a": [f[0] for f in found], "b": [f[1] for f in found]}

    return map_arrow(p, run, "a long, b long")


def with_component(rows: DataFrame, linked: DataFrame) -> DataFrame:
    return rows.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))


def contested(rows: DataFrame) -> DataFrame:
    """Rows of tokens that more than one component has."""
    open_tokens = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    return rows.join(open_tokens, "token", "left_semi")


def costly_tokens(rows: DataFrame, at_least: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with more than so many components, and those components' counts; the bound on their number raises at_least."""
    counts = rows.select("token", "component").distinct().groupBy("token").count().where(F.col("count") > at_least)
    by_size = {r["k"]: r["n"] for r in counts.groupBy(F.floor(F.log2("count")).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()}  # at most 63 rows
    total, lowest = 0, None
    for k in sorted(by_size, reverse=True):
        if total + by_size[k] > COSTLY_TOKENS:
            break
        total, lowest = total + by_size[k], k
    if lowest is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = counts.where(F.col("count") >= (1 << lowest)).toPandas()
    return found["token"].to_numpy(np.int64), found["count"].to_numpy(np.int64)


def ranked_tokens(spark: SparkSession, tokens: np.ndarray, cost: np.ndarray, telling: np.ndarray):
    """Broadcast: tokens sorted, their ranks by cost, and the sorted tokens that tell endangered nodes. At most
    COSTLY_TOKENS of each."""
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, cost))] = np.arange(len(tokens))
    order = np.argsort(tokens)
    return spark.sparkContext.broadcast((tokens[order], rank[order], np.sort(telling)))


def candidates(rows: DataFrame, percent: int, slacked: bool, costly: np.ndarray | None = None) -> DataFrame:
    """Pairs (a, b) of nodes in different components that share a token and may be similar.

    costly: tokens to leave out; how many of them a node has is then taken off what it must share. Pairs of
    two saturated nodes are left to their clusters."""
    if costly is not None and len(costly):
        table = rows.sparkSession.createDataFrame(costly.reshape(-1, 1), "token long")  # COSTLY_TOKENS rows at most
        rows = rows.join(F.broadcast(table.withColumn("hot", F.lit(True))), "token", "left")
        hot = rows.where("hot").groupBy("node").agg(F.count("*").alias("h"))
        rows = rows.where("hot is null").drop("hot").join(hot, "node", "left").withColumn("h", F.coalesce("h", F.lit(0)))
    else:
        rows = rows.withColumn("h", F.lit(0))
    if "saturated" not in rows.columns:
        rows = rows.withColumn("saturated", F.lit(False))
    columns = ("node", "n", "h", "saturated", "component")
    side = lambda k: rows.select("token", *[F.col(c).alias(f"{c}_{k}") for c in columns])
    pairs = side("a").join(side("b"), "token").where((F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")) & close("n_a", "n_b", percent) & ~(F.col("saturated_a") & F.col("saturated_b")))
    counted = pairs.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(F.count("*").alias("c"), *[F.min(f"{c}_{k}").alias(f"{c}_{k}") for c in ("n", "h") for k in "ab"])
    return counted.where(F.col("c") >= needed("n_a", "n_b", percent, slacked) - F.least("h_a", "h_b")).select("a", "b")


def cluster_links(rows: DataFrame, sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Spanning links among saturated nodes that share prefix tokens."""
    lead = rows.groupBy("token").agg(F.min("node").alias("b"))
    clusters = components(rows.join(lead, "token").where("node <> b").select(F.col("node").alias("a"), "b")).withColumnRenamed("component", "cluster")
    members = clusters.join(nodes, "node")
    sizes = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    placed = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    whole = sets.select(F.col("node").alias("node_"), F.col("doc_id").alias("doc_id_"), "tokens")
    placed = placed.join(whole, (F.col("node") == F.col("node_")) & F.col("rep").eqNullSafe(F.col("doc_id_")))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = placed.select("cluster", "block", "node", "tokens", every).select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "tokens")
    out = to_arrow_schema(struct("a long, b long"))

    def link(table):
        import pyarrow as pa

        at = {n: k for k, n in enumerate(table["node"].to_pylist())}  # repeated rows once
        node = list(at)
        found = block_links([unpack48(table["tokens"][k].as_py()) for k in at.values()], percent)
        return pa.table({"a": [node[i] for i, _ in found], "b": [node[j] for _, j in found]}, schema=out)

    return dealt.groupBy("cluster", "i", "j").applyInArrow(shipped(link), "a long, b long")


def shipped(fn):
    """fn for workers that may not have this package on their path."""
    from pathlib import Path

    from pyspark import cloudpickle

    packed, home = cloudpickle.dumps(fn), str(Path(__file__).resolve().parents[2])

    def call(table):
        import sys

        if home not in sys.path:
            sys.path.append(home)
        return cloudpickle.loads(packed)(table)

    return call


def block_links(sets: list[np.ndarray], percent: int, step: int = 4096) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs: overlaps of all pairs at once as products of 0/1 matrices."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if n < 2:
        return []
    tokens, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    keep = counts[where] > 1
    column = (np.cumsum(counts > 1) - 1)[where[keep]]
    owner = owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    shared = np.zeros((n, n), np.float32)
    for low in range(0, int((counts > 1).sum()), step):
        lo, hi = np.searchsorted(column, (low, low + step))
        x = np.zeros((n, step), np.float32)
        x[owner[lo:hi], column[lo:hi] - low] = 1
        shared += x @ x.T
    similar = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i, j in zip(*np.nonzero(np.triu(similar, 1)), strict=True):
        a, b = root(int(i)), root(int(j))
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((int(i), int(j)))
    return links


def grouped(df: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and text_hash of every row of df
    (doc_id, text).

    Null, empty and white texts have no shingles and stay alone. Repeated rows, also of one doc_id, are
    linked by their equal sets. Null ids don't name components unless there is no other. Columns besides
    doc_id and text don't matter. An empty table gives none."""
    spark = df.sparkSession
    sets = told_apart(materialise(shingle_sets(df, words), "sets"))
    nodes = materialise(sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n")), "nodes")
    rows = materialise(live(postings(sets, percent)).select("token", "node", "n", "lead"), "live")
    sizes = nodes.select(F.col("node").alias("b"), F.col("n").alias("m"))
    stars = rows.where("node <> lead").groupBy(F.col("node").alias("a"), F.col("lead").alias("b")).agg(F.count("*").alias("c"), F.min("n").alias("n")).join(sizes, "b")
    stars = stars.where(close("n", "m", percent) & (F.col("c") >= needed("n", "m", percent, True)))
    links = [materialise(verified(stars, sets, nodes, percent), "links")]
    linked = materialise(components(links[0]), "linked")
    open_rows = materialise(contested(with_component(rows, linked)), "open")
    tokens, cost = costly_tokens(open_rows, COSTLY)
    pairs, longer = candidates(open_rows, percent, True, tokens), None
    if len(tokens):
        # the nodes that costly tokens endanger show all their tokens once; then all costly ones are known
        endangered = longer_postings(sets, percent, ranked_tokens(spark, tokens, cost, tokens), explore=True)
        shown = materialise(contested(with_component(materialise(endangered.select("token", "node"), "shown"), linked)), "open")
        more, more_cost = costly_tokens(shown, COSTLY)
        known = np.isin(more, tokens)
        every, every_cost = np.concatenate([tokens, more[~known]]), np.concatenate([cost, more_cost[~known]])
        posted = materialise(longer_postings(sets, percent, ranked_tokens(spark, every, every_cost, tokens)), "longer")
        longer = materialise(contested(with_component(live(posted).drop("lead"), linked)), "open")
        pairs = pairs.union(candidates(longer.where("cheap"), percent, False)).distinct()
    links.append(materialise(verified(pairs, sets, nodes, percent), "links"))
    if longer is not None and (full := longer.where("saturated")).limit(1).count():
        links.append(materialise(cluster_links(full, sets, nodes, percent), "links"))
    if any(x.limit(1).count() for x in links[1:]):
        every = links[0]
        for x in links[1:]:
            every = every.union(x)
        linked = materialise(components(every), "linked")
    named = with_component(nodes, linked)
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.select("node", "component").join(smallest, "component").select("node", "component_id")
    narrow = sets.select("doc_id", "n_shingles", "node", "text_hash")
    return narrow.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash")


def near_duplicates(df: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of df, as grouped() finds them."""
    return grouped(df, words, percent).drop("text_hash")


def first_of_groups(df: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """df's rows, whatever their columns' names, without those that are linked to a document of a smaller id."""
    plain, back = apart(df, "doc_id", "text")
    groups = grouped(plain, words, percent)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept id"), F.col("text_hash").alias("kept text")).distinct()
    return back(plain.join(first, F.col("doc_id").eqNullSafe(F.col("kept id")) & (F.xxhash64("text") == F.col("kept text")), "left_semi"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS MATERIALIZED (
  SELECT r, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))) END AS shingles FROM w
), t AS MATERIALIZED (
  SELECT r, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), p AS (
  SELECT a.r AS x, b.r AS y, a.n + b.n AS sizes, count(*) AS shared FROM t a JOIN t b ON a.shingle = b.shingle AND a.r <> b.r GROUP BY ALL
), l AS MATERIALIZED (
  SELECT x, y FROM p WHERE 100 * shared >= 80 * (sizes - shared)
), reach AS (
  SELECT r AS x, r AS y FROM s UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x
)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM s JOIN reach ON reach.x = s.r JOIN s o ON o.r = reach.y GROUP BY s.r, s.doc_id, len(s.shingles)
"""
