"""Features of the rows before each row, over windows of time, with a wavelet matrix for the order statistics.

Rows with the same source, time, length and language are one cell with a count, made before rows are shuffled. A
source's time is cut into tiles, and a tile gets its own cells and those of one window before it, so a hot source
is as many tasks as it has tiles. Within a tile the cells are in the order of time; prefix sums give counts and
sums, prefix counts of each language the distinct ones, and a wavelet matrix of the lengths the k-th smallest of
any range: on each bit plane two ranks lead a range to its zeros or its ones. Ranks are prefix sums in numpy, and
all windows of a tile go down the planes together.

Rows of one time have the same windows, so a window is computed once for each source and time and joined to the
rows afterwards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import apart, documents, map_arrow, materialise
from .periodic import CRC_SQL

#: Seconds of the windows, and (name, numerator, denominator) of the order statistics.
WINDOWS = (600, 43200)
SHARES = (("median_chars", 1, 2), ("high_chars", 90, 100))


class WaveletMatrix:
    """Range k-th smallest over values (codes from 0) in a given order, each with a weight (how often it stands there)."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray):
        self.bits = range(max(int(codes.max(initial=0)).bit_length(), 1) - 1, -1, -1)
        self.planes = []
        for bit in self.bits:
            zero = (codes >> bit & 1) == 0
            places = np.concatenate([[0], np.cumsum(zero)])
            heavy = np.concatenate([[0], np.cumsum(np.where(zero, weights, 0))])
            self.planes.append((places, heavy))
            codes, weights = np.concatenate([codes[zero], codes[~zero]]), np.concatenate([weights[zero], weights[~zero]])

    def kth(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Codes of the k-th smallest (from 1, with repeats) of the ranges [left, right)."""
        out = np.zeros(len(k), np.int64)
        for bit, (places, heavy) in zip(self.bits, self.planes, strict=True):
            low = heavy[right] - heavy[left]
            one = k > low
            zeros = places[-1]
            left = np.where(one, zeros + left - places[left], places[left])
            right = np.where(one, zeros + right - places[right], places[right])
            k = k - np.where(one, low, 0)
            out |= one.astype(np.int64) << bit
        return out


def tile_features(times: np.ndarray, lengths: np.ndarray, known: np.ndarray, langs: np.ndarray, counts: np.ndarray, at: np.ndarray, windows, shares) -> list[dict]:
    """For each window a dict of arrays, one value for each time of `at`. Cells are in the order of time; lengths count
    where known; langs are codes, negative where there is none."""
    prefix = lambda x: np.concatenate([[0], np.cumsum(x)])
    rows, total = prefix(counts), prefix(np.where(known, lengths * counts, 0))
    measured, weight = prefix(known), prefix(np.where(known, counts, 0))
    values, codes = np.unique(lengths[known], return_inverse=True)
    matrix = WaveletMatrix(codes.astype(np.int64), counts[known])
    right, out = np.searchsorted(times, at, "left"), []
    for seconds in windows:
        left = np.searchsorted(times, at - seconds, "left")
        made = {"n_events": rows[right] - rows[left], "sum_chars": total[right] - total[left], "n_langs": np.zeros(len(at), np.int64)}
        m = weight[right] - weight[left]
        for name, part, whole in shares:
            some = np.flatnonzero(m)
            found = np.full(len(at), -1, np.int64)
            if len(some):
                found[some] = values[matrix.kth(measured[left[some]], measured[right[some]], -(-part * m[some] // whole))]
            made[name] = np.ma.array(found, mask=m == 0)
        out.append(made | {"left": left})
    for code in np.unique(langs[langs >= 0]):
        seen = prefix(langs == code)  # one language's prefix counts at a time
        for made in out:
            made["n_langs"] += seen[right] > seen[made["left"]]
    for made in out:
        del made["left"]
    return out


def window_features(df: DataFrame, windows: tuple[int, ...] = WINDOWS, shares=SHARES, time: str = "event_s", source: str = "source", length: str = "length", lang: str = "lang") -> DataFrame:
    """One row for each source, time and window: source, event_s, window_s, n_events, sum_chars, n_langs and a column for
    each share: of the rows of the source with event_s - window_s <= their time < event_s.

    time and length are whole numbers. A null source is a source. Null lengths count as events only, null languages
    as none; rows without a time are in no window and have no row here. Repeated rows count each, ties in time have
    one window. An empty table gives none. A task holds the distinct (time, length, language) of one tile of a source
    and of the longest window before it."""
    longest, names = max(windows), [n for n, _, _ in shares]
    width = max(1, longest // 2)
    cells = df.where(F.col(time).isNotNull()).groupBy(F.col(source).alias("source"), F.col(time).cast("long").alias("t"), F.col(length).cast("long").alias("length"), F.col(lang).cast("string").alias("lang")).agg(F.count("*").alias("n"))
    cells = materialise(cells, "cells")
    # a cell is in the windows of times up to `longest` later
    own = F.floor(F.col("t") / width)
    dealt = cells.withColumn("own", own).withColumn("tile", F.explode(F.sequence(F.col("own"), F.floor((F.col("t") + longest) / width))))
    dealt = dealt.repartitionByRange("source", "tile")  # tiles of a hot source lie side by side, in even partitions
    run = W.partitionBy("source", "tile").orderBy("t")
    laid = dealt.withColumn("begins", F.row_number().over(run) == 1).select("begins", "source", "t", "length", "lang", "n", (F.col("own") == F.col("tile")).alias("asks"))

    def tiles(batches: Iterator[dict]) -> Iterator[list[dict]]:
        """The batches of each tile; a tile may begin and end within a batch."""
        held: list[dict] = []
        for batch in batches:
            marks = np.flatnonzero(batch["begins"].to_numpy(zero_copy_only=False)).tolist()
            for a, b in zip([0, *marks], [*marks, len(batch["t"])], strict=True):
                if a in marks and held:
                    yield held
                    held = []
                if b > a:
                    held.append({c: v.slice(a, b - a) for c, v in batch.items()})
        if held:
            yield held

    def features(batches: Iterator[dict]) -> Iterator[dict]:
        import pyarrow as pa

        for parts in tiles(batches):
            whole = {c: pa.chunked_array([p[c] for p in parts]).combine_chunks() for c in parts[0]}
            t, n, asks = (whole[c].to_numpy(zero_copy_only=False) for c in ("t", "n", "asks"))
            at = np.unique(t[asks])
            if not len(at):
                continue
            known = whole["length"].is_valid().to_numpy(zero_copy_only=False)
            lengths = whole["length"].fill_null(0).to_numpy(zero_copy_only=False)
            langs = whole["lang"].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for seconds, made in zip(windows, tile_features(t, lengths, known, langs, n, at, windows, shares), strict=True):
                yield {"source": whole["source"].take(pa.array(np.zeros(len(at), np.int64))), "event_s": at, "window_s": np.full(len(at), seconds)} | made

    more = "".join(f", {n} long" for n in names)
    return map_arrow(laid, features, f"source {df.schema[source].dataType.simpleString()}, event_s long, window_s long, n_events long, sum_chars long, n_langs long{more}")


def with_features(df: DataFrame, windows: tuple[int, ...] = WINDOWS, shares=SHARES, time: str = "event_s", source: str = "source", length: str = "length", lang: str = "lang") -> DataFrame:
    """df's rows, once for each window, with window_s and the features. Rows without a time have empty windows. Columns of df with
    the names added here are replaced."""
    made = ["n_events", "sum_chars", "n_langs", *[n for n, _, _ in shares]]
    found = window_features(df, windows, shares, time, source, length, lang)
    by_time = found.groupBy(F.col("source").alias("of"), F.col("event_s").alias("at")).agg(F.collect_list(F.struct("window_s", *made)).alias("found"))  # as many as there are windows
    empty = F.array(*[F.struct(F.lit(w).cast("long").alias("window_s"), *[F.lit(0 if k < 3 else None).cast("long").alias(n) for k, n in enumerate(made)]) for w in windows])
    rest = df.drop(*[c for c in ("window_s", *made) if c not in (time, source)])
    own, back = apart(rest)
    mine = {c: F.col(f"`{n}`") for c, n in zip(rest.columns, own.columns, strict=True)}
    joined = own.join(by_time, mine[source].eqNullSafe(F.col("of")) & (mine[time].cast("long") == F.col("at")), "left")
    return back(joined.withColumn("one", F.explode(F.coalesce("found", empty))), *[F.col("one").getField(n).alias(n) for n in ("window_s", *made)])


def event_seconds(doc_id: Column) -> Column:
    """60 * floor((doc_id + (h mod 10000)) / 6), h the crc32 of the id in decimal; null for a null id, or where it has no
    room in a long."""
    x = F.try_add(doc_id.cast("long"), F.crc32(doc_id.cast("string").cast("binary")) % 10000)
    return F.try_multiply(x - F.pmod(x, F.lit(6)), F.lit(10))  # the multiple of 6 at or below, by 60 / 6


def op11_rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "source", "lang", event_seconds(F.col("doc_id")).alias("event_s"), F.length("text").cast("long").alias("length"))
    return with_features(rows).select("doc_id", "window_s", "event_s", "n_events", "sum_chars", "n_langs", "median_chars", "high_chars")


OP11_SQL = rf"""
WITH {CRC_SQL}, d AS (
  SELECT doc_id, source, lang, length(text) AS n, 60 * CAST(floor((doc_id + h % 10000) / 6) AS BIGINT) AS event_s FROM documents LEFT JOIN crc USING (doc_id)
), f AS (
  SELECT doc_id, window_s, event_s, (SELECT {{'n': count(*), 's': coalesce(sum(n), 0), 'l': count(DISTINCT lang), 'a': list_sort(list(n) FILTER (n IS NOT NULL))}}
    FROM d y WHERE y.source IS NOT DISTINCT FROM x.source AND y.event_s >= x.event_s - window_s AND y.event_s < x.event_s) AS w FROM d x, (VALUES (600), (43200)) AS v(window_s)
)
SELECT doc_id, window_s::BIGINT AS window_s, event_s, w.n AS n_events, w.s::BIGINT AS sum_chars, w.l AS n_langs, w.a[(len(w.a) + 1) // 2] AS median_chars, w.a[(90 * len(w.a) + 99) // 100] AS high_chars FROM f
"""
