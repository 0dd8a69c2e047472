import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wetcell.llm import bpe, token_files

SCHEMA = "doc_id long, text string, ids string, part int, k double"
TEXTS = [None, "", " ", "<|endoftext|>a<|endoftext|>", "naïve café 日本語 \U0001f600", "it's 3.14\r\n\r\n  x", "\x00\x01", "word " * 40_000, "a" * 5000, "ab ab ab"]


def brute(rows):
    """doc_id, start, n_tokens, crc by the library alone."""
    key = lambda r: (r[0] is not None, r[0] or 0)
    out, start = [], 0
    for i, text in sorted(rows, key=key):
        ids = [*bpe.tokenizer(bpe.default_path()).encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5000) | st.integers(1, 3), min_size=1, max_size=400))
def test_ends_by_select_and_all_at_once(steps):
    values = np.cumsum(steps)
    ends = token_files.Ends.of(values)
    assert ends.values().tolist() == values.tolist()
    assert [ends.select(i) for i in range(len(values))] == values.tolist()
    assert 8 * (len(ends.low) + len(ends.high)) <= len(values) * (3 + ends.low_bits) + 16


def test_files_match_the_library(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i * 3, rng.choice(TEXTS[1:7]) + f" {rng.random()} zz" * rng.randrange(9)) for i in range(400)]
    rows += [(10_000 + k, t) for k, t in enumerate(TEXTS)] + [(None, "null id"), (-5, "negative"), (2**62, None)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], SCHEMA).repartition(5)
    for n, (chars, ids) in enumerate([(1 << 24, 1 << 18), (2000, 300), (1, 1)]):
        folder = f"{tmp_path}/{n}"
        token_files.write(docs, folder, block_chars=chars, segment_ids=ids)
        got = token_files.documents(spark, folder).collect()
        found = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in sorted(got, key=lambda r: r.start)]
        assert found == brute(rows)
        assert {tuple(r) for r in token_files.boundaries(spark, folder).collect()} == {(r.doc_id, r.start, r.n_tokens) for r in got}
        wanted = spark.createDataFrame([(0,), (10_003,), (10_007,), (-5,), (77_777,), (0,)], "doc_id long")
        some = {r.doc_id: (r.start, r.ids) for r in token_files.lookup(spark, folder, wanted).collect()}
        assert some == {r.doc_id: (r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in got if r.doc_id in (0, 10_003, 10_007, -5)}


def test_boundaries_read_no_ids(spark, tmp_path):
    token_files.write(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), f"{tmp_path}/x")
    plan = token_files.boundaries(spark, f"{tmp_path}/x")._jdf.queryExecution().executedPlan().toString()
    assert "ids:binary" not in plan and "high:binary" in plan
    row = spark.read.parquet(f"{tmp_path}/x/segments").first()
    assert (row.width, len(row.ids), row.n_docs) == (2, 2 * row.n_ids, 1)


def test_forgotten_words_are_encoded_again(monkeypatch):
    monkeypatch.setattr(token_files, "MOST_WORDS", 3)
    words = token_files.Words(bpe.default_path(), 0)
    for text in ("one two", "three four five", "one two", ""):
        ids, ends = words.ids([words.number(text), words.number("x" + text)])
        want = [[*bpe.tokenizer(bpe.default_path()).encode(t, add_special_tokens=False).ids, 0] for t in (text, "x" + text)]
        assert ids.tolist() == sum(want, []) and ends.tolist() == [len(want[0]), len(want[0]) + len(want[1])]


def test_ids_that_repeat_keep_a_row_each(spark, tmp_path):
    rows = [(7, f"t {i % 4}") for i in range(40)] + [(None, None), (None, "x")]
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/r", segment_ids=8)
    got = sorted(token_files.documents(spark, f"{tmp_path}/r").collect(), key=lambda r: r.start)
    assert sorted((r.doc_id is None, r.n_tokens, zlib.crc32(r.ids)) for r in got) == sorted((i is None, n, c) for i, _, n, c in brute(rows))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))


def test_empty_table(spark, tmp_path):
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/e")
    assert token_files.documents(spark, f"{tmp_path}/e").count() == 0 == token_files.boundaries(spark, f"{tmp_path}/e").count()


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, token_files.op11_token_files(spark, sf).collect())) == sorted(brute(docs))
