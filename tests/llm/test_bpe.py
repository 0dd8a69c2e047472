import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from wetcell.llm import bpe


def texts():
    rng = random.Random(5)
    odd = " '\t\n\r\x0b\x0c\x1c\x85\xa0 　ſ’sétABC09²½٣ªßß日本語👍🏽́\x00_-#<|>"
    mixed = ["".join(rng.choice(odd + "re ll don't ") for _ in range(rng.randrange(60))) for _ in range(150)]
    low = "".join("a" + chr(c) for c in range(0x2C2))
    return [
        None, "", " ", "  x", "I'm we'll they'd 'S ''s", "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>", "<|endoftext|", low,
        "word " * 40_000, "x" * 3000, "x" * 3000,
    ] + mixed


def test_ids_and_text_match_the_library(spark):
    rows = [(i, t, "k", 1) for i, t in enumerate(texts())] + [(None, "null id", "k", 1), (3, "  x", "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, ids int")
    tok = bpe.tokenizer(bpe.default_path())
    want = sorted((i if i is not None else -1, tok.encode(t or "", add_special_tokens=False).ids) for i, t, _, _ in rows)
    for block_chars in (1 << 25, 50):
        out = bpe.decoded(bpe.encode(docs, block_chars=block_chars)).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids)) for r in out) == want
        by_id = {i: t or "" for i, t, _, _ in rows}
        assert all(r.text == by_id[r.doc_id] for r in out)


def test_query_digests(spark, tmp_path):
    spark.createDataFrame([(1, "Hello world"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = bpe.tokenizer(bpe.default_path()).encode("Hello world", add_special_tokens=False).ids
    got = {r.doc_id: r for r in bpe.op8_bpe_encoding(spark, str(tmp_path)).collect()}
    assert got[1].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got[1].n_tokens == len(ids)
    assert got[1].decoded_sha256 == hashlib.sha256(b"Hello world").hexdigest()
    assert got[2].n_tokens == 0 and got[2].ids_sha256 == got[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()


def test_invalid_bytes_and_unknown_ids_decode(spark):
    tok = bpe.tokenizer(bpe.default_path())
    part = tok.encode("👍", add_special_tokens=False).ids[:1]
    rows = [(1, part), (2, [99_999_999, -1, None]), (3, []), (4, None), (None, part), (None, part)]
    for piece_bytes in (1 << 26, 0):
        encoded = spark.createDataFrame(rows, "doc_id long, ids array<int>").selectExpr("*", "1 AS pos", "2 AS id", "'x' AS text", "3 AS row", "4 AS head")
        out = bpe.decoded(encoded, piece_bytes=piece_bytes).collect()
        assert {(r.pos, r.id, r.row, r.head) for r in out} == {(1, 2, 3, 4)}
        want = [(i, ids or [], tok.decode(ids or []) if i != 2 else "") for i, ids in rows]
        assert sorted(((r.doc_id, list(r.ids), r.text) for r in out), key=str) == sorted(want, key=str)


def test_decoding_by_either_join_gives_the_texts_back(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string").repartition(3)
    for piece_bytes, kind in ((1 << 26, "BroadcastHashJoin"), (0, "ShuffledHashJoin")):
        out = bpe.decoded(bpe.encode(docs), piece_bytes=piece_bytes)
        assert kind in out._jdf.queryExecution().executedPlan().toString()
        assert {r.doc_id: r.text for r in out.collect()} == {i: t or "" for i, t in enumerate(texts())}


def test_documents_are_put_together_over_batches(monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_BYTES", 5000)
    rng, docs, rows = random.Random(8), [], []
    for doc in range(300):
        ids = [rng.randrange(2000) for _ in range(rng.choice([0, 1, 2, 50, 3000]))]
        docs.append({"doc_id": doc if doc % 9 else None, "ids": ids, "text": "".join(f"p{i} " for i in ids)})
        head = {"doc_id": docs[-1]["doc_id"], "ids": ids}
        rows += [(None if at else head, i, b"p%d " % i) for at, i in enumerate(dict.fromkeys(ids))] or [(head, None, None)]
    kinds = (pa.struct([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]), pa.int32(), pa.binary())
    columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
    whole = pa.RecordBatch.from_arrays(columns, names=["head", "id", "piece"])
    out = list(bpe.in_documents(whole.slice(i, 1000) for i in range(0, len(rows), 1000)))
    assert len(out) > 5 and pa.Table.from_batches(out).to_pylist() == docs
    with pytest.raises(RuntimeError, match="apart"):
        list(bpe.in_documents([whole.take(pa.array([0, *range(len(rows) - 1, 0, -1)]))]))


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
