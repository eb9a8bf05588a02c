"""Best-fit packing of documents into sequences of bounded length, in bulk-synchronous rounds.

A round sorts waiting pieces and open gaps by size. Each piece asks for its successor among the gaps,
the smallest that holds it; where more ask than a gap size has places, the larger pieces rank first and
the rest wait. Then all gaps are updated and the next round begins. When nobody waiting fits, the largest
waiting pieces open new sequences, as many as their tokens need at least.

Pieces of one length are alike, and so are sequences with one gap and one history. The rounds therefore
run on classes: runs of pieces of a length by rank, and runs of sequences. Lengths are bounded by the
capacity, so the state of the rounds is bounded by it, not by the data, and the sweeps take one pass
over at most `capacity` sizes each. The rounds run twice: with all waiting lengths at once, and with the largest
waiting length alone, whose pieces take as many places of each gap as it holds and open no more sequences than they
need (that is better where lengths are alike); the plan with fewer sequences is taken. What grows with the data is distributed: cutting, the length
histogram (partial sums), the rank of each piece within its length (salted, so that a length which holds
a third of all pieces still spreads), and placing each piece by its rank."""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, map_arrow, materialise, slices
from .tokens import encoder, public_path

PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def cut_pieces(df: DataFrame, path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Encodes whole texts, adds end_id and cuts what is longer than capacity: one row per piece."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            for rows in slices(batch, "text", 1 << 23):
                out = defaultdict(list)
                for i, ids in zip(rows["doc_id"], encode(rows["text"]), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for name, v in zip(("doc_id", "piece", "start", "length", "ids_crc32"), (i, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            out[name].append(v)
                yield out

    return map_arrow(df.select("doc_id", "text"), run, PIECES.format(id=df.schema["doc_id"].dataType.simpleString()))


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset): pieces of that length with ranks
    first .. first + count - 1 go to as many sequences from the first on, all at that offset."""
    waiting = {n: (0, c) for n, c in histogram.items() if c}  # length: next rank, how many
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs (first sequence, count)
    runs, sequences = [], 0

    def take(length: int, count: int) -> int:
        rank, left = waiting.pop(length)
        if left > count:
            waiting[length] = (rank + count, left - count)
        return rank

    def place(length: int, count: int, first: int, gap: int, into: dict) -> None:
        runs.append((length, take(length, count), count, first, capacity - gap))
        if gap > length:
            into[gap - length].append((first, count))

    while waiting:
        # every waiting length asks for its successor among the gaps
        sizes = sorted(g for g, r in gaps.items() if r)
        asked: dict[int, list[int]] = defaultdict(list)
        for length in sorted(waiting, reverse=True):
            if (at := bisect.bisect_left(sizes, length)) < len(sizes):
                asked[sizes[at]].append(length)
        if not asked:
            # nobody fits: the largest open as many sequences as the waiting tokens fill at least
            tokens = sum(n * c for n, (_, c) in waiting.items())
            room = max(1, -(-tokens // capacity))
            # pieces over half the capacity never share: each of them needs its own
            room = max(room, sum(c for n, (_, c) in waiting.items() if 2 * n > capacity))
            for length in sorted(waiting, reverse=True):
                n = min(room, waiting[length][1])
                place(length, n, sequences, capacity, gaps)
                sequences, room = sequences + n, room - n
                if not room:
                    break
            continue
        # conflicts: within a gap size the larger pieces rank first; a sequence takes one piece a round
        changed: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for gap, lengths in asked.items():
            free = gaps.pop(gap)
            for length in lengths:
                while free and length in waiting:
                    first, count = free.pop()
                    n = min(count, waiting[length][1])
                    place(length, n, first, gap, changed)
                    if count > n:
                        free.append((first + n, count - n))
            changed[gap].extend(free)
        for gap, found in changed.items():
            gaps[gap] = merged(gaps[gap] + found)
    return runs


def plan_by_length(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs as of plan(), from rounds of the largest waiting length each: its pieces fill the smallest gaps that hold one,
    as many as a gap holds, and the rest open new sequences in the same way."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    runs, sequences = [], 0
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left, rank, found = histogram[length], 0, defaultdict(list)

        def fill(gap: int, first: int, count: int) -> int:
            """Puts waiting pieces into sequences from the first on, all with that gap; says how many sequences it used."""
            nonlocal left, rank
            used = 0
            while left and used < count:
                each = min(gap // length, left)
                many = min(count - used, left // each)
                for k in range(each):
                    runs.append((length, rank, many, first + used, capacity - gap + k * length))
                    rank += many
                left -= each * many
                if gap > each * length:
                    found[gap - each * length].append((first + used, many))
                used += many
            return used

        for gap in sorted(g for g in gaps if g >= length):
            if not left:
                break
            free = gaps.pop(gap)
            while free and left:
                first, count = free.pop()
                used = fill(gap, first, count)
                if used < count:
                    free.append((first + used, count - used))
            if free:
                found[gap].extend(free)
        if left:
            sequences += fill(capacity, sequences, -(-left // (capacity // length)))
        for gap, more in found.items():
            gaps[gap] = merged(gaps.get(gap, []) + more)
    return runs


def opened(runs: list[tuple[int, int, int, int, int]]) -> int:
    """How many sequences a plan has."""
    return max((first + count for _, _, count, first, _ in runs), default=0)


def best_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    return min((plan(histogram, capacity), plan_by_length(histogram, capacity)), key=opened)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Neighbouring runs joined."""
    out: list[tuple[int, int]] = []
    for first, count in sorted(runs):
        if out and out[-1][0] + out[-1][1] == first:
            out[-1] = (out[-1][0], out[-1][1] + count)
        else:
            out.append((first, count))
    return out


def ranked(pieces: DataFrame, salts: int = 64) -> DataFrame:
    """rank from 0 within each length. Salted: a length's pieces rank in `salts` parts, each part after the
    ones before it."""
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")
    pieces = pieces.withColumn("salt", salt)
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    parts = pieces.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    local = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return pieces.withColumn("local", local).join(parts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("local")).drop("salt", "before", "local")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (any columns with doc_id, piece, length, ids_crc32) with sequence_id and offset.

    Ties, repeated rows and null ids: every row is placed once; equal lengths are interchangeable. A piece
    longer than capacity is an error, zero-length pieces are too. An empty table gives none."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    runs = np.array(best_plan(counts, capacity) or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    lengths, first_rank, first_sequence, offset = runs[:, 0], runs[:, 1], runs[:, 3], runs[:, 4]
    keys = (lengths << 48) | first_rank
    spark = pieces.sparkSession
    shared = spark.sparkContext.broadcast((keys, first_rank, first_sequence, offset))  # bounded by the capacity
    kept = [c for c in pieces.columns]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def run(batches):
        keys, first_rank, first_sequence, offset = shared.value
        for batch in batches:
            length, rank = batch["length"].to_numpy(zero_copy_only=False).astype(np.int64), batch["rank"].to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            yield {c: batch[c] for c in kept} | {"sequence_id": first_sequence[at] + rank - first_rank[at], "offset": offset[at]}

    return map_arrow(ranked(pieces).select(*kept, "rank"), run, f"{fields}, sequence_id long, offset long")


def pack_documents(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Documents (doc_id, text) to placed pieces. Null and empty texts are one piece of the end id alone."""
    return pack(materialise(cut_pieces(df, path, capacity, end_id), "pieces"), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_path("word_bpe_49k.json"))
