"""Token counts by the whole-token shortcut.

Some vocabulary strings encode alone as exactly one token. Which ones is proved before counting, by
encoding each of them; a pre-token among them adds one without any merge. Only the rest is merged by
the library, and remembered.

A pre-token is a run of spaces with the characters up to the next space. No vocabulary string has a
space mark after another character (checked when the counter is made), so no merge crosses the cut
and the counts add up to the library's."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_arrow, slices
from .tokens import encoder, public_path

_MARK = "▁"
_CUT = re.compile(r" *[^ ]+| +")


class PieceCounter:
    """Counts for sentencepiece models."""

    def __init__(self, path: str, limit: int = 400_000):
        import sentencepiece

        self.lib, self.limit = sentencepiece.SentencePieceProcessor(model_file=path), limit
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        self.cuts = not any(re.search(f"[^{_MARK}]{_MARK}", p) for p in pieces)
        # the proof: each string after one space mark, encoded alone
        alone = [p[1:] for p in pieces if p.startswith(_MARK) and _MARK not in p[1:] and len(p) > 1]
        self.whole = {" " + s for s, ids in zip(alone, self.lib.encode(alone, num_threads=1), strict=True) if len(ids) == 1}
        self.known = dict.fromkeys(self.whole, 1)

    def __call__(self, texts: list[str | None]) -> list[int]:
        known = self.known
        parts = []
        for text in texts:
            text = text or ""
            plain = self.cuts and text and _MARK not in text and "\x00" not in text
            parts.append(_CUT.findall(" " + text) if plain else len(self.lib.encode(text, num_threads=1)))
        missing = set().union(*(p for p in parts if isinstance(p, list))).difference(known)
        if missing:
            if len(known) + len(missing) > self.limit:
                known = self.known = dict.fromkeys(self.whole, 1)
                missing = set().union(*(p for p in parts if isinstance(p, list))).difference(known)
            new = list(missing)
            # the library puts one space before each text, which stands for the first one here
            for piece, ids in zip(new, self.lib.encode([p[1:] for p in new], num_threads=1), strict=True):
                known[piece] = len(ids)
            if " " in missing:  # one space at a text's end; the library gives an empty text none
                known[" "] = len(self.lib.encode("a ", num_threads=1)) - len(self.lib.encode("a", num_threads=1))
        return [sum(map(known.__getitem__, p)) if isinstance(p, list) else p for p in parts]


class JsonCounter:
    """Counts for files of the tokenizers library."""

    def __init__(self, path: str):
        self.encode = encoder(path)

    def __call__(self, texts: list[str | None]) -> list[int]:
        return [len(b) // 4 for b in self.encode(texts)]


@functools.lru_cache(maxsize=2)
def counter(path: str):
    return PieceCounter(path) if path.endswith(".model") else JsonCounter(path)


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_bytes (UTF-8), n_tokens, whole texts. Null text counts as empty: 0 bytes, 0
    tokens. Null ids, repeated rows and other columns don't matter; an empty table gives none."""

    def run(batches):
        count = counter(path)
        for batch in batches:
            for rows in slices(batch, "text"):
                yield {"id": rows["id"], "n_bytes": [len((t or "").encode()) for t in rows["text"]], "n_tokens": count(rows["text"])}

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(df[id_col].alias("id"), df[text_col].alias("text")), run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def op9_token_counts(spark: SparkSession, sf_dir: str, limit: int = 4096) -> DataFrame:
    counts = count_tokens(documents(spark, sf_dir), public_path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", counts.n_tokens > limit)
