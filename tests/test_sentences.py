"""sentence_chunks has every sentence of every document."""

import re

import pyarrow.parquet as pq

from kgweave.plans import catalogue

DIR = "/root/testdata/sf0.001"


def test_every_document_is_cut_into_sentences(spark):
    t = pq.read_table(f"{DIR}/documents.parquet", columns=["doc_id", "text"])
    want = {}
    for doc, text in zip(t["doc_id"].to_pylist(), t["text"].to_pylist()):
        ends = re.sub(r"([。！？?!；;]|\n\n|\.\s+)", "\\1\0", text or "").split("\0")
        if text is not None:
            want[doc] = max(1, sum(s.strip() != "" for s in ends))
    got = {}
    for r in catalogue.QUERIES["sentence_chunks"](spark, DIR).collect():
        got.setdefault(r["doc_id"], []).append((r["ord"], r["chunk"]))
    assert {doc: len(x) for doc, x in got.items()} == want
    for x in got.values():
        chunks = [c for _, c in sorted(x)]
        assert chunks[0] == 0 and all(b - a in (0, 1) for a, b in zip(chunks, chunks[1:]))
