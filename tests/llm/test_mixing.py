import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wetcell.llm import mixing


def brute(rows):
    """taken by walking the words: each source's stream, three passes at most, up to its target."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    own = defaultdict(list)
    for i, t, s in rows:
        own[s].append((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), -1 if i is None else i, size(t)))
    sources = sorted(own, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(x[2] for x in own[s]) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, free, rest = {}, set(sources), float(sum(total.values()))
    while free:
        shares = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if shares[s] > 3 * total[s]}
        if not over:
            target |= shares
            break
        target |= {s: 3.0 * total[s] for s in over}
        rest -= sum(3 * total[s] for s in over)
        free -= over
    out = {}
    for s in sources:
        left = min(round(target[s]), 3 * total[s])
        for _ in range(3):
            for mark in sorted(own[s]):
                use = min(left, mark[2])
                out[s, mark] = out.get((s, mark), 0) + use
                left -= use
    return sorted((m[1], m[2], total[s], round(target[s], 6), out[s, m]) for s, m in ((s, m) for s in sources for m in sorted(own[s])))


def rows():
    names = ["b", "", None, "é", "a", "B", "z"]
    found = [(i, " ".join(["w"] * (i * 7 % 50)), names[(i * i) % 7 if i % 3 else 0]) for i in range(200)]
    return found + [(500, None, "a"), (501, "", "only empty"), (None, "x y", "a"), (502, "long\x0bword " * 30_000, "z"), (503, "\xa0", "B")]


def test_targets_and_words_match_brute_force(spark):
    docs = spark.createDataFrame([(*r, 9, 9) for r in rows()], "doc_id long, text string, source string, place int, chunk int")
    want = brute(rows())
    for block in (16, 8192):
        got = mixing.taken(docs, block=block).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == want
        assert all(r.taken <= 3 * r.size for r in got)


def test_schedule_is_even_and_whole(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    _, plan, mix = mixing.mixed(docs, block=64)
    by_slot = {r.slot: r.place for r in mix.select("slot", "place").distinct().collect()}
    quota = {r.place: -(-r.taken // 64) for r in plan.collect()}
    order = [by_slot[k] for k in sorted(by_slot)]
    for place, n in quota.items():
        assert order.count(place) == n
        for k in range(0, len(order), 97):  # every prefix has the source in proportion
            assert abs(order[:k].count(place) - k * n / len(order)) < 8
    assert sorted(map(tuple, mix.collect())) == sorted(map(tuple, mixing.mixed(docs, block=64)[2].collect()))


def test_a_block_without_a_slot_is_an_error(spark, monkeypatch):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    whole = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda plan, block: whole(plan, block).filter("place <> 2 OR rank <> 0"))
    with pytest.raises(Exception, match="a block has no slot"):
        mixing.taken(docs, block=64).collect()


def test_slots_and_parts_of_documents(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    own, _, mix = mixing.mixed(docs, block=16)
    place = {(r.doc_id, r.source): (r.place, r.start) for r in own.collect()}
    parts = defaultdict(list)
    for r in mix.collect():
        parts[r.place, r.start].append(r.slot)
    sources = {i: s for i, _, s in rows()}
    for r in mixing.taken(docs, block=16).collect():
        slots = parts[place[r.doc_id, sources[r.doc_id]]] if r.size else []
        assert (r.first_slot, r.n_blocks) == (min(slots, default=None), len(slots)) and (r.taken > 0) == bool(slots)


def test_empty_tables(spark):
    assert mixing.taken(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    none = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in mixing.taken(none).collect()) == [(1, 0, 0, 0.0, 0, None, 0), (2, 0, 0, 0.0, 0, None, 0)]


def test_mixed_documents_hold_the_words_taken(spark):
    data = [(i, t, s, len(t or ""), k) for k, (i, t, s) in enumerate(rows())] + [(7, rows()[7][1], rows()[7][2], 1, -1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, n_chars int, id_ int")
    out = mixing.mixed_documents(docs, block=16)
    assert out.schema.fieldNames() == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    words = defaultdict(int)
    for r in out.collect():
        words[r.doc_id, r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    want = defaultdict(int)
    sources = {r.doc_id: r.source for r in docs.collect()}
    for r in mixing.taken(docs, block=16).collect():
        want[r.doc_id, sources[r.doc_id]] += r.taken
    assert dict(words) == {k: n for k, n in want.items() if n}
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_reversed_bits(spark):
    rows = spark.range(64).select(mixing.reversed_bits(F.col("id"), 6).alias("x")).collect()
    assert [r.x for r in rows] == [int(f"{i:06b}"[::-1], 2) for i in range(64)]
    big = spark.createDataFrame([(2**40 + 5,)], "id long").select(mixing.reversed_bits(F.col("id"), 62).alias("x")).first().x
    assert big == int(f"{2**40 + 5:062b}"[::-1], 2)


def test_every_block_has_a_slot(spark):
    """Also of sources with few blocks beside large ones."""
    plan = spark.createDataFrame([(0, 3), (1, 900_000), (2, 1), (3, 77), (4, 0)], "place int, taken long")
    got = mixing.schedule(plan, 1).groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("top")).collect()
    assert sorted(map(tuple, got)) == [(0, 3, 2), (1, 900_000, 899_999), (2, 1, 0), (3, 77, 76)]


def test_ids_that_are_null_or_repeat(spark):
    data = [(None if i % 3 else i % 5, " ".join(["w"] * (i % 9 + i % 2)), "a" if i % 2 else None) for i in range(9000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.taken(docs, block=64)
    assert got.count() == len(data) and not got.filter("taken > 3 * size").count()
    by = {r.source_size: (r.t, r.n) for r in got.groupBy("source_size").agg(F.max("target").alias("t"), F.sum("taken").alias("n")).collect()}
    assert all(abs(t - n) <= 1 for t, n in by.values())


def test_a_part_is_the_text_as_it_was(spark):
    docs = spark.createDataFrame([(1, " \n a  b\tc \n\n d e ", "x"), (2, "one two  three", "y"), (3, "four", "z")], "doc_id long, text string, source string")
    whole = {r.doc_id: r.text for r in docs.collect()}
    out = mixing.mixed_documents(docs, block=2).collect()
    assert all(whole[r.doc_id].startswith(r.text) for r in out)
    parts = {r.text for r in out} - set(whole.values())
    assert parts and all(not t.endswith((" ", "\n", "\t")) for t in parts)
