"""Toxicity by a gap-weighted subsequence kernel and a support vector machine on Nyström landmarks.

Texts are folded to units: words in lower case without marks inside, digits and signs that stand for
letters read as those, and runs of single letters joined, so that s p a c e d, do.tt.ed and l3tt3r
spellings are words again. Their sentences are windows of 1, 2, 4 and 8 neighbouring units. Two sentences are
alike as far as they share three-letter subsequences, also such that run from a unit into the next; one that
spans more letters counts less by DECAY for each, up to SPAN, so inserted and left-out letters, and a space put
into a word, only weaken a match. A unit's start is a letter of its own.

Training takes a bounded sample of labelled rows. A toxic row's sentences are labelled by the row around its
witnesses: units, pairs of units, or beginnings, that toxic rows hold far more often than clean ones could by
chance; later also where the machine so far finds a toxic row's strongest sentence above nearly all clean rows.
Sentences of clean rows are clean, those the machine likes best among them. Landmarks are sentences of both
kinds; the machine is trained on the landmarks' features (squared hinge). As the kernel's feature space is
finite, the trained machine is then one table of 32^3 weights, and a sentence's decision value is a sum of table
cells over its subsequences. A text's score is that of its strongest sentence, turned into a probability on the
training sample."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, documents, held_out, labels, map_arrow, materialise, slices

DECAY, SPAN, LETTERS = 0.6, 5, 32
#: Units in a sentence.
WINDOWS = (1, 2, 4, 8)
_STEPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN + 1 - a)]
_DROP, _START = 255, 0


def _folding() -> np.ndarray:
    """UTF-8 bytes to letters: 1-26 for a-z, 27-31 for what follows a lead byte, _START for white space."""
    table = np.full(256, _DROP, np.uint8)
    for i in range(26):
        table[97 + i] = table[65 + i] = i + 1
    for sign, letter in zip("013457@$", "oieastas", strict=True):
        table[ord(sign)] = ord(letter) - 96
    table[0x80:0xC0] = 27 + np.arange(64) % 5
    table[[9, 10, 11, 12, 13, 32]] = _START
    return table


_FOLD = _folding()
#: Letters from which on a window's norm grows with its length, no longer with its root.
LONG = 96
_NORM = np.sqrt(np.maximum(sum(np.maximum(np.arange(LONG + 1) - a - b, 0) * DECAY ** (2 * (a + b)) for a, b in _STEPS), 1e-9))


def norm(size: np.ndarray) -> np.ndarray:
    """The norm of windows of so many letters and starts without repeated subsequences, up to LONG."""
    return _NORM[np.minimum(size, LONG)] * np.maximum(1.0, size / LONG)


def fold(raw: bytes) -> np.ndarray:
    """Letters with a start before each unit."""
    c = _FOLD[np.frombuffer(b" " + raw.lower(), np.uint8)]
    c = c[c != _DROP]
    starts = np.flatnonzero(c == _START)
    sizes = np.diff(np.append(starts, len(c))) - 1
    single = sizes == 1
    # a start between two single letters is no start; empty units go
    joined = np.zeros(len(starts), bool)
    full = np.flatnonzero(sizes > 0)
    joined[full[1:]] = single[full[1:]] & single[full[:-1]]
    keep = np.ones(len(c), bool)
    keep[starts[joined | (sizes == 0)]] = False
    return c[keep]


def unit_sums(c: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each unit of c starts (and where the last one ends), and two kernel sums of each with a table of
    weights: of its own subsequences, and of those that run on into the next unit."""
    c = np.append(c, np.uint8(_START))  # ends the last unit
    first = c == _START
    starts, owner = np.flatnonzero(first), np.cumsum(first, dtype=np.int32)
    ends = owner - first  # a start also ends the unit before
    code = c.astype(np.int32)
    heads, mids = code << 10, code << 5
    own, on = np.zeros(len(c), np.float32), np.zeros(len(c), np.float32)
    value = {d: np.zeros(max(0, len(c) - d), np.float32) for d in range(2, SPAN + 1)}
    for a in range(1, SPAN):
        if len(c) > a:
            pair = heads[:-a] + mids[a:]
            for d in range(a + 1, SPAN + 1):
                if len(c) > d:
                    value[d] += table[pair[: len(c) - d] + code[d:]]
    for d, v in value.items():
        if len(v):
            v *= np.float32(DECAY**d)
            crossed = ends[d:] - owner[:-d]
            own[:-d] += v * (crossed == 0)
            on[:-d] += v * (crossed == 1)
    return starts, np.add.reduceat(own, starts)[:-1], np.add.reduceat(on, starts)[:-1]


def window_scores(c: np.ndarray, text: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row for each of WINDOWS: its scores at all first units (-inf where it would leave the text), that is
    kernel sums over the norm of their length; and where units start. text: of each unit of c."""
    starts, own, on = unit_sums(c, table)
    own, on = (np.concatenate([[0], np.cumsum(x, dtype=np.float64)]) for x in (own, on))
    scores = np.full((len(WINDOWS), len(text)), -np.inf, np.float32)
    for row, w in zip(scores, WINDOWS, strict=True):
        n = len(text) - w + 1
        if n > 0:
            total = own[w:] - own[:n] + on[w - 1 : w - 1 + n] - on[:n]
            found = total / norm(starts[w:] - starts[:n] + 1)
            row[:n] = np.where(text[:n] == text[w - 1 :], found, -np.inf)
    return scores, starts


def window_features(window: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Cells and values of one window (its letters as bytes, units parted by starts), over the norm of its length."""
    c = np.frombuffer(b"\0" + window + b"\0", np.uint8).astype(np.int64)
    crossed = np.cumsum(c == _START)
    cells, values = [], []
    for a, b in _STEPS:
        n = len(c) - a - b
        if n > 0:
            # as in unit_sums: within a unit, or into the next one
            near = (crossed[a + b :] - (c[a + b :] == _START) - crossed[:n]) <= 1
            cells.append(((c[:n] << 10) + (c[a : a + n] << 5) + c[a + b :])[near])
            values.append(np.full(int(near.sum()), DECAY ** (a + b)))
    if not cells:
        return np.zeros(0, np.int64), np.zeros(0)
    cell, where = np.unique(np.concatenate(cells), return_inverse=True)
    return cell, np.bincount(where, np.concatenate(values)) / float(norm(np.array([len(c)]))[0])


def by_cell(windows: list[bytes]) -> np.ndarray:
    """A row for each cell, a column for each of a few windows."""
    x = np.zeros((LETTERS**3, len(windows)), np.float32)
    for k, w in enumerate(windows):
        cell, value = window_features(w)
        x[cell, k] = value
    return x


def kernel(windows: list[bytes], marks: np.ndarray) -> np.ndarray:
    """Each window's kernel with those of marks (by_cell)."""
    out = np.empty((len(windows), marks.shape[1]), np.float32)
    for k, w in enumerate(windows):
        cell, value = window_features(w)
        out[k] = value.astype(np.float32) @ marks[cell]
    return out


class Scorer:
    """Scores texts: the score of each text's strongest window; LEAST for texts without a likely one."""

    LEAST = 0.0

    def __init__(self, table: np.ndarray):
        self.table = table

    def _scores(self, texts: list[str | None]):
        folded = [folded_text(t) for t in texts]
        counts = np.array([int((f == _START).sum()) for f in folded])
        if not counts.sum():
            return None
        c = np.concatenate(folded)
        scores, starts = window_scores(c, np.repeat(np.arange(len(texts), dtype=np.int32), counts), self.table)
        return c, counts, scores, starts

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        best = np.full(len(texts), self.LEAST)
        if (found := self._scores(texts)) is not None:
            _, counts, scores, _ = found
            some = np.flatnonzero(counts)
            firsts = (np.cumsum(counts) - counts)[some]
            best[some] = np.maximum(np.maximum.reduceat(scores.max(axis=0), firsts), self.LEAST)
        return best

    def strongest(self, texts: list[str | None]) -> list[tuple[float, bytes]]:
        """Score and letters of each text's strongest window; no letters where none is likely."""
        out = [(self.LEAST, b"")] * len(texts)
        if (found := self._scores(texts)) is not None:
            c, counts, scores, starts = found
            letters, at = c.tobytes(), 0
            for t, n in enumerate(counts.tolist()):
                if n:
                    k, i = divmod(int(scores[:, at : at + n].argmax()), n)
                    if (s := float(scores[k, at + i])) > self.LEAST:
                        out[t] = s, letters[starts[at + i] + 1 : starts[at + i + WINDOWS[k]]]
                at += n
        return out


def folded_text(text: str | None) -> np.ndarray:
    return fold((text or "").encode("utf-8", "surrogatepass"))


def units(text: str | None) -> list[bytes]:
    return folded_text(text).tobytes().split(b"\0")[1:]


def _sample(known: DataFrame, rows: int) -> DataFrame:
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


_BEGINNING, _UNIT, _PAIR = range(3)


def _counts(rows: DataFrame) -> DataFrame:
    """How many toxic and clean rows hold each unit, each pair of neighbouring ones, and each beginning of 4 to 7
    letters."""

    def run(batches):
        for batch in batches:
            for r in slices(batch, "text", 1 << 18):
                out: dict = {"unit": [], "kind": [], "toxic": []}
                for text, label in zip(r["text"], r["label"], strict=True):
                    found = units(text)
                    pairs = {a + b"\0" + b for a, b in zip(found, found[1:], strict=False)}
                    found = set(found)
                    starts = {u[:n] for u in found for n in (4, 5, 6, 7) if len(u) >= n}
                    for kind, some in ((_UNIT, found), (_PAIR, pairs), (_BEGINNING, starts)):
                        out["unit"] += some
                        out["kind"] += [kind] * len(some)
                        out["toxic"] += [label] * len(some)
                yield out

    each = map_arrow(rows.select("text", "label"), run, "unit binary, kind int, toxic int")
    return each.groupBy("unit", "kind").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))


def _witnesses(counts: DataFrame, chance: float, most: int) -> tuple[dict[bytes, int], tuple[bytes, ...]]:
    """Units and pairs that toxic rows hold far more often than clean ones could by chance, with their toxic rows;
    and the shortest beginnings of that kind."""
    tried = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # three rows at most
    limit = F.coalesce(*[F.when(F.col("kind") == k, float(np.log(n)) + 1) for k, n in sorted(tried.items())], F.lit(1.0))
    # surprise of so many toxic rows among those that hold the unit, against all of its kind that were tried
    held = F.col("toxic") + F.col("clean")
    pure = F.col("toxic") / held
    surprise = held * (pure * F.log(pure / chance) + F.when(pure < 1, (1 - pure) * F.log((1 - pure) / (1 - chance))).otherwise(0))
    good = counts.where((F.col("toxic") >= 2) & (pure >= 0.9) & (surprise > limit))
    found = [(bytes(r["unit"]), r["kind"], r["toxic"]) for r in good.orderBy(F.desc(surprise), "unit").limit(most).collect()]
    stems = {u for u, kind, _ in found if kind == _BEGINNING}
    shortest = tuple(sorted(s for s in stems if not any(s[:n] in stems for n in range(4, len(s)))))
    known = {u: t for u, kind, t in found if kind == _UNIT}
    # a pair tells more than its units only where neither does alone
    known |= {u: t for u, kind, t in found if kind == _PAIR and not any(w in known or w.startswith(shortest) for w in u.split(b"\0"))}
    return known, shortest


def _labelled_windows(rows: DataFrame, known: dict[bytes, int], stems: tuple[bytes, ...], each: int) -> DataFrame:
    """window, label: of toxic rows the windows of all widths around their first `each` witnesses; of clean rows
    `each` windows of each width, from places that a hash of the text deals."""

    def run(batches):
        for batch in batches:
            for r in slices(batch, "text", 1 << 18):
                out: dict = {"window": [], "label": []}
                for text, label in zip(r["text"], r["label"], strict=True):
                    found = units(text)
                    if label:
                        at = [i for i, u in enumerate(found) if u in known or u.startswith(stems) or b"\0".join(found[i : i + 2]) in known][:each]
                    else:
                        seed = zlib.crc32((text or "").encode("utf-8", "surrogatepass"))
                        at = [(seed + k * 2654435761) % len(found) for k in range(each)] if found else []
                    for i in at:
                        for w in WINDOWS:
                            start = max(0, min(i - (w - 1) // 2, len(found) - w))
                            out["window"].append(b"\0".join(found[start : start + w]))
                            out["label"].append(label)
                yield out

    return map_arrow(rows.select("text", "label"), run, "window binary, label int").distinct()


def _strongest(rows: DataFrame, table: np.ndarray) -> list[tuple[float, bytes, int]]:
    """Score, window and label of each row's strongest window; the sample's rows."""

    def run(batches):
        score = Scorer(table)
        for batch in batches:
            for r in slices(batch, "text"):
                found = score.strongest(r["text"])
                yield {"s": [f[0] for f in found], "window": [f[1] for f in found], "label": r["label"]}

    found = map_arrow(rows.select("text", "label"), run, "s double, window binary, label int").collect()
    return sorted(((r["s"], bytes(r["window"]), r["label"]) for r in found), key=lambda f: (-f[0], f[1], f[2]))


def train(docs: DataFrame, known: DataFrame, toxic_rows: int = 2500, clean_rows: int = 5000, landmarks: int = 400, windows: int = 8000, witnesses: int = 5000, each: int = 4, rounds: int = 3) -> tuple[np.ndarray, float, float]:
    """Table, slope and offset of the probability. docs: doc_id, text; known: doc_id, label (0/1).

    At most toxic_rows and clean_rows labelled rows are learnt from, the first by a hash of their id, whole texts.
    Of their sentences (windows) at most `windows` of each label train the machine, the first by a hash, and half as
    many more clean ones in each round; `witnesses` bounds the telling units. Units are counted and windows found
    on the executors; the driver holds windows only. Rows without an id or a label teach nothing; repeated ids are
    learnt as often as they stand with a text; other columns don't matter. Where one label is absent, or nothing
    tells the labels apart, every text gets the same low score."""
    usable = known.where("doc_id is not null and label is not null").select("doc_id", "label")
    chosen = _sample(usable.where("label = 1"), toxic_rows).union(_sample(usable.where("label = 0"), clean_rows))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # toxic_rows + clean_rows
    none = np.zeros(LETTERS**3, np.float32), 1.0, -2.0
    totals = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}  # two rows
    toxic_n, clean_n = totals.get(1, 0), totals.get(0, 0)
    if not toxic_n or not clean_n:
        return none
    rows = materialise(rows.select("text", "label"), "labelled")
    telling, stems = _witnesses(materialise(_counts(rows), "units"), toxic_n / (toxic_n + clean_n), witnesses)
    if not telling and not stems:
        return none
    found = materialise(_labelled_windows(rows, telling, stems, each), "windows")
    first = lambda label: [bytes(r["window"]) for r in found.where(F.col("label") == label).orderBy(F.xxhash64("window"), "window").limit(windows).collect()]
    toxic, clean = first(1), first(0)
    # windows of both labels tell nothing
    both = set(toxic) & set(clean)
    toxic, clean = ([w for w in some if w not in both] for some in (toxic, clean))
    if not toxic or not clean:
        return none
    hard: list[bytes] = []
    for _ in range(rounds):
        table = _machine(toxic, clean, hard, telling, landmarks)
        best = _strongest(rows, table)
        # the clean windows that the machine so far likes best join the training set and the landmarks
        likely = [(s, w) for s, w, label in best if not label and w]
        seen = set(toxic) | set(clean) | set(hard)
        hard += [w for w in dict.fromkeys(w for _, w in likely[: windows // 2]) if w not in seen]
        # and of toxic rows those above nearly all clean rows, wherever a row's telling sentence was not known
        limit = likely[clean_n // 50][0] if len(likely) > clean_n // 50 else 0.0
        toxic += [w for w in dict.fromkeys(w for s, w, label in best if label and s > limit) if w not in seen]
    table = _machine(toxic, clean, hard, telling, landmarks)
    # probability of a text from its strongest window, on the sample
    pairs = _strongest(rows, table)
    s, y = np.array([p[0] for p in pairs]), np.array([p[2] for p in pairs])
    shares = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}  # two rows or so
    weights = np.where(y == 1, shares[1] / toxic_n, shares[0] / clean_n)
    slope, _ = _platt(s, y, weights)
    return table, slope, -slope * _cut(s, y, weights)


def _machine(toxic: list[bytes], clean: list[bytes], hard: list[bytes], telling: dict[bytes, int], landmarks: int) -> np.ndarray:
    """A squared-hinge machine on Nyström features of windows. Landmarks: the commonest telling units and toxic
    windows, the hardest clean windows, and other clean ones."""
    words = toxic + clean + hard
    y = np.r_[np.ones(len(toxic)), -np.ones(len(clean) + len(hard))]
    quarter = landmarks // 4
    spread = lambda some: some[:: max(1, len(some) // quarter)]
    common = sorted(telling, key=lambda u: (-telling[u], u))
    marks = list(dict.fromkeys(common[:quarter] + spread(toxic)[:quarter] + hard[:quarter] + spread(clean)))[:landmarks]
    z = by_cell(marks)
    values, vectors = np.linalg.eigh(kernel(marks, z).astype(np.float64) + 1e-4 * np.eye(len(marks)))
    root = ((vectors / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T).astype(np.float32)
    x = np.c_[kernel(words, z) @ root, np.ones(len(words), np.float32)]
    # Newton steps on the rows within the margin; both classes weigh the same
    c = (np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)).astype(np.float32)
    y = y.astype(np.float32)
    w, ridge = np.zeros(x.shape[1]), 1e-4 * np.eye(x.shape[1]) * len(y)
    ridge[-1, -1] = 1e-6
    for _ in range(15):
        near = y * (x @ w.astype(np.float32)) < 1
        a = x[near] * c[near, None]
        new = np.linalg.solve((a.T @ x[near]).astype(np.float64) + ridge, (a.T @ y[near]).astype(np.float64))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return z @ (root @ w[:-1].astype(np.float32))


def _cut(s: np.ndarray, y: np.ndarray, weights: np.ndarray) -> float:
    """The score from which on a text is toxic with the fewest errors on the sample; of equal cuts the lowest."""
    order = np.argsort(-s, kind="stable")
    s, gain = s[order], np.cumsum(np.where(y[order] == 1, weights[order], -weights[order]))
    ends = np.flatnonzero(np.append(s[1:] != s[:-1], True))  # after all rows of one score
    best = ends[len(ends) - 1 - int(np.argmax(gain[ends][::-1]))]
    if gain[best] <= 0:
        return float(s[0]) + 1.0
    below = s[best + 1] if best + 1 < len(s) else s[best] - 1.0
    return float((s[best] + below) / 2)


def _platt(s: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve on weighted scores of unit spread."""
    mean, spread = s.mean(), s.std() or 1.0
    x = np.c_[(s - mean) / spread, np.ones(len(s))]
    c = weights / weights.sum()
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (c * p * (1 - p))[:, None]).T @ x + 1e-5 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (c * (p - y)) + 1e-5 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


def score(docs: DataFrame, model: tuple[np.ndarray, float, float], keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns to keep) and score of every row; whole texts, however long.

    Null and empty texts score like ones without a likely sentence; equal texts score alike. Repeated rows and null
    ids don't matter; an empty table gives none. A column named score is replaced (without_toxic() leaves it alone)."""
    table, slope, offset = model
    shared = docs.sparkSession.sparkContext.broadcast(table)  # 32^3 numbers

    def run(batches):
        strongest = Scorer(shared.value)
        for batch in batches:
            for r in slices(batch, "text"):
                s = np.array(strongest(r["text"]))
                yield {c: r[c] for c in kept} | {"score": 1 / (1 + np.exp(-np.clip(slope * s + offset, -35, 35)))}

    kept = [c for c in keep or ["doc_id"] if c != "score"]
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    return map_arrow(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, "text"])]), run, f"{fields}score double")


def without_toxic(docs: DataFrame, model: tuple[np.ndarray, float, float], threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold: its own columns, whatever their names."""
    plain, back = apart(docs, "doc_id", "text")
    return back(score(plain, model, keep=plain.columns).where(F.col("score") < threshold))


def trained(spark: SparkSession, sf_dir: str) -> tuple[np.ndarray, float, float]:
    known = labels(spark, sf_dir).where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("label"))
    return train(documents(spark, sf_dir), known)


def op5_toxicity(spark: SparkSession, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    scored = score(documents(spark, sf_dir), trained(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
