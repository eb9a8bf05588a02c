"""Periodic runs of words, by harmonic grid probing.

A run is a stretch of words that repeats with a smallest period q, at least `times` periods and `least` words
long, which no neighbouring word extends. A run of period p is longer than 2p, so two neighbouring multiples of
p lie in it: for each p the words at jp and (j+1)p are compared, n / p pairs, and n log n over all p. Pairs that
agree, and whose neighbours agree as well, are extended both ways by comparing arrays in chunks. Periods go up,
and grid points in a run already found whose period divides p are skipped, as they would give that run again.

Documents of a batch are laid end to end, the longest first, so that one comparison of strided arrays probes all
of them for a period. Texts stay bytes: a word is what lies between ASCII white space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, documents, map_arrow, slices

LEAST, TIMES = 24, 3
#: Words compared at once at most, when a stretch is followed.
CHUNK = 1 << 16
#: Agreeing words on the right or on the left that a pair needs; a stretch of 2 * NEAR words has one or the other.
NEAR = 7


def _ahead(ids: np.ndarray, i: int, p: int) -> int:
    """First place from i on whose word differs from the one p later."""
    step = 64
    while True:
        later = ids[i + p : i + p + step]
        differ = ids[i : i + len(later)] != later
        k = int(differ.argmax())
        if differ[k]:
            return i + k
        i, step = i + len(differ), min(step * 4, CHUNK)


def _behind(ids: np.ndarray, i: int, p: int) -> int:
    """First place of the stretch of agreeing pairs that holds i."""
    step = 64
    while True:
        low = max(0, i - step)
        differ = ids[low:i] != ids[low + p : i + p]
        k = int(differ[::-1].argmax())
        if differ[len(differ) - 1 - k]:
            return i - k
        i, step = low, min(step * 4, CHUNK)


def _near(ids: np.ndarray, at: np.ndarray, p: int) -> np.ndarray:
    """Those of the places whose NEAR followers or NEAR forerunners agree with the words p later."""
    right, left = at, at
    for k in range(1, NEAR + 1):
        right = right[ids[right + k] == ids[right + k + p]] if len(right) else right
        left = left[ids[left - k] == ids[left - k + p]] if len(left) else left
    return np.union1d(left, right)


def _known(at: np.ndarray, p: int, runs: np.ndarray) -> np.ndarray:
    """Which places lie, with the word p later, in a run whose period divides p. runs: start, end, period a row."""
    same = runs[p % runs[:, 2] == 0]
    if not len(same):
        return np.zeros(len(at), bool)
    same = same[same[:, 0].argsort()]
    before = same[:, 0].searchsorted(at, "right")
    return np.where(before > 0, np.maximum.accumulate(same[:, 1])[before - 1], -1) > at + p


def find_runs(documents: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """For each document, an array of word numbers (not negative), its runs (start, length, period) by start, then
    period. least must be 24 or more and times 3 or more: shorter runs could slip past the look at neighbours."""
    if least < LEAST or times < TIMES:
        raise ValueError(f"least is at least {LEAST}, times at least {TIMES}")
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    order = sorted((k for k, d in enumerate(documents) if len(d) >= least), key=lambda k: -len(documents[k]))
    if not order:
        return out
    # a number of its own before each document and after the last keeps stretches within one
    pad, sizes = NEAR + 1, np.array([len(documents[k]) for k in order])
    begins = pad + np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    ids = -np.arange(1, int(begins[-1] + sizes[-1]) + 2 * pad + 1)
    stops = np.zeros(len(ids), np.int64)
    for k, b in zip(order, begins, strict=True):
        ids[b : b + len(documents[k])] = documents[k]
        stops[b : b + len(documents[k])] = b + len(documents[k])
    ends, found, table = begins + sizes, {}, np.empty((0, 3), np.int64)
    reach = len(order)
    for p in range(1, int(sizes[0]) // times + 1):
        while sizes[reach - 1] < times * p:
            reach -= 1
        m = int(ends[reach - 1])
        later = ids[p:m:p]
        at = np.flatnonzero(ids[: m - p : p][: len(later)] == later) * p
        at = at[stops[at] > at + p]
        if not len(at) or not len(at := _near(ids, at, p)) or not len(at := at[~_known(at, p, table)]):
            continue
        done, new = -1, []
        for i in at.tolist():
            if i < done:
                continue
            first, done = _behind(ids, i, p), _ahead(ids, i, p)
            if done + p - first >= max(least, times * p) and (first, done + p) not in found:
                found[first, done + p] = p
                new.append((first, done + p, p))
        if new:
            table = np.concatenate([table, np.array(new)])
    for (first, end), p in found.items():
        k = int(begins.searchsorted(first, "right")) - 1
        out[order[k]].append((first - int(begins[k]), end - first, p))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside all runs, with each run's first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(depth[:-1]).tolist(), strict=True) if not d]


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES, chars: int = 4 << 20) -> DataFrame:
    """One row per row: id, runs (start, length, period in words, by start, then period), collapsed: the words outside
    the runs and each run's first period, joined by one space.

    Null and empty texts have no runs and collapse to an empty text. Null ids and repeated rows are rows like
    others; other columns don't matter. Whole texts are read, whatever their length. An empty table gives none."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for rows in slices(batch, "text", chars):
                texts, known = [(t or b"").split() for t in rows["text"]], {}
                found = find_runs([np.array([known.setdefault(w, len(known)) for w in words], np.int64) for words in texts], least, times)
                yield {
                    "id": rows["id"],
                    "runs": [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in found],
                    "collapsed": [b" ".join(kept_words(words, runs)) for words, runs in zip(texts, found, strict=True)],
                }

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("id"), df[text_col].cast("binary").alias("text"))
    return map_arrow(rows, run, f"id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string").withColumnRenamed("id", id_col)


def strongest(runs: str) -> F.Column:
    """The run with the greatest exact length / period; ties go to the smallest start, then period."""

    def better(best, run):
        more = run["length"] * best["period"] - best["length"] * run["period"]
        return F.when(best.isNull() | (more > 0), run).otherwise(best)  # runs come by start, then period

    return F.aggregate(runs, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), better)


def planted(df: DataFrame) -> DataFrame:
    """df (doc_id, text) where a tenth of the documents, by checksum of the id, repeat from word g mod n on a period of
    their own words. Native expressions; a null id counts as an empty one."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all("text", F.lit(f"[^{SPACES}]+"), F.lit(0))
    g, n, a, p = F.expr("h div 10"), F.size("words").cast("long"), F.col("a"), F.col("p")
    other = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")))
    rows = df.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    rows = rows.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, g % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - a) / (3 + g % 8)))
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(other, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = periodic_runs(planted(documents(spark, sf_dir)))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    best = runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest("runs").alias("best"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: crc32 of decimal ASCII, for the SQL: a table of 256 remainders, and one step a character.
CRC_SQL = """crc_table AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda r, _: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END) ORDER BY b) AS remainders FROM range(256) AS t(b)
), crc AS (
  SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ascii(c)::BIGINT)),
    lambda r, c: xor(r // 256, remainders[(xor(r, c) & 255) + 1]))) AS h FROM (SELECT DISTINCT doc_id FROM documents), crc_table
)"""

OP13_SQL = rf"""
WITH {CRC_SQL}, d AS (
  SELECT doc_id, h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents JOIN crc USING (doc_id)
), g AS (
  SELECT *, len(words) AS n, (h // 10) % greatest(len(words), 1) AS a, 3 + (h // 10) % 8 AS k FROM d
), m AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 THEN list_transform(range(n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END]) ELSE words END AS words FROM g
), w AS (
  SELECT doc_id, n, unnest(words) AS word, unnest(range(n)) AS pos FROM m
), e AS (
  SELECT x.doc_id, x.pos, y.pos - x.pos AS p FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.pos > x.pos AND y.pos - x.pos <= x.n // 3
), i AS (
  SELECT doc_id, p, pos, pos - row_number() OVER (PARTITION BY doc_id, p ORDER BY pos) AS island FROM e
), s AS (
  SELECT doc_id, p, min(pos) AS start, count(*) + p AS length FROM i GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(24, 3 * p)
), r AS (
  SELECT doc_id, start, length, min(p) AS period FROM s GROUP BY ALL
), b AS (
  SELECT doc_id, start, length, period, 1000 * length // period AS exponent_milli FROM r x
  WHERE NOT EXISTS (SELECT 1 FROM r y WHERE x.doc_id = y.doc_id AND (y.length * x.period > x.length * y.period OR (y.length * x.period = x.length * y.period AND (y.start, y.period) < (x.start, x.period))))
), l AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id
), c AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS collapsed FROM w
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = w.doc_id AND w.pos >= start + period AND w.pos < start + length) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)
"""
