import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from wetcell.llm import jaccard_join


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    label = list(range(n))
    links = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                a, b = label[i], label[j]
                if a != b:
                    label = [min(a, b) if x in (a, b) else x for x in label]
    ids = defaultdict(list)
    for k, (i, _) in zip(label, rows, strict=True):
        if i is not None:
            ids[k].append(i)
    return sorted(((i, min(ids[k], default=None), x) for (i, _), k, x in zip(rows, label, links, strict=True)), key=str)


def corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows = [" ".join(text(rng.randrange(1, 120))) for _ in range(60)]
    passage = text(40)
    rows += [" ".join(text(30) + passage + text(30)) for _ in range(40)]  # a shared passage, far below 0.8
    for changes in (0, 1, 2, 3, 4, 6):
        base = text(150)
        for _ in range(15):
            near = list(base)
            for _ in range(changes):
                near[rng.randrange(150)] = rng.choice(words)
            rows.append(" ".join(near))
    found = list(enumerate(rows))
    odd = [(900, None), (901, ""), (902, " \n"), (903, "Two  words"), (904, "two words"), (905, rows[0].upper()), (None, rows[0]), (None, "all alone without an id"), (906, "long " * 30_000), (907, "long " * 29_000), (3, rows[3]), (3, "another text of id three")]
    return found + odd


def result(df):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in df.collect()), key=str)


def test_links_and_classes_match_brute_force(spark):
    docs = spark.createDataFrame([(*r, "c", 1) for r in corpus()], "doc_id long, text string, code string, n int")
    assert result(jaccard_join.classes(docs)) == brute(corpus())


def test_large_buckets_are_split_and_then_dealt_in_blocks(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    for depth, most in ((0, 6), (2, 6)):
        assert result(jaccard_join.classes(docs, depth=depth, most=most, runs=24)) == brute(corpus())


def test_classes_without_links_are_the_same(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    want = sorted(((i, c) for i, c, _ in brute(corpus())), key=str)
    for options in ({}, {"most": 6, "runs": 24}, {"depth": 0, "most": 6}):
        got = jaccard_join.classes(docs, links=False, **options)
        assert sorted(((r.doc_id, r.class_id) for r in got.collect()), key=str) == want
        assert got.filter("n_links > 0").count() == 0


def test_a_large_group_of_near_copies_takes_few_buckets(spark):
    """Sets of one group that all differ: the buckets that are left hold fewer rows than there are sets."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:k] + [f"x{i}"] + base[k:]) for i in range(600) for k in (rng.randrange(200),)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    plain = jaccard_join.buckets_of
    jaccard_join.buckets_of = lambda *a: seen.append(plain(*a)) or seen[-1]
    try:
        got = jaccard_join.classes(docs, links=False, most=40)
        assert {r.class_id for r in got.collect()} == {0}
    finally:
        jaccard_join.buckets_of = plain
    rows = seen[0].select(F.explode("members")).count()
    assert rows < 20 * len(texts)  # every pair of blocks would be 16 runs of 30 blocks for each set


def test_the_check_before_loses_no_pair_at_the_threshold():
    rng = np.random.default_rng(6)
    for own in ((50, 50), (100, 0)):
        lost = 0
        for _ in range(3000):
            both, *rest = (rng.integers(0, 2**63, k, np.uint64) * np.uint64(2) for k in (400, *own))
            sets = [np.unique(np.concatenate((both, x))) for x in rest]
            samples = np.frombuffer(b"".join(map(jaccard_join.sampled, sets)), np.uint8).reshape(2, -1)
            lost += not jaccard_join.alike(np.array([len(x) for x in sets]), samples)[0, 1]
        assert lost <= (1 - jaccard_join.RECALL) * 3000


def test_recall_of_choosing_at_the_threshold():
    rng = np.random.default_rng(3)
    found = 0
    for _ in range(2000):
        both, a, b = (np.unique(rng.integers(0, 2**63, k, np.uint64)) for k in (80, 10, 10))
        codes = [set(jaccard_join.chosen(np.unique(np.concatenate((both, x))), jaccard_join.RUNS).tolist()) for x in (a, b)]
        found += bool(codes[0] & codes[1])
    assert found >= jaccard_join.RECALL * 2000


def test_recall_at_the_threshold_through_all_splits():
    """What a run loses, counted over all runs of pairs at 0.8, of equal sizes and one inside the other."""
    rng = np.random.default_rng(4)
    for own in ((50, 50), (100, 0)):
        lost = 0
        for _ in range(400):
            both, *rest = (rng.integers(0, 2**63, k, np.uint64) * np.uint64(2) for k in (400, *own))
            sets = [np.unique(np.concatenate((both, x))) for x in rest]
            samples = [jaccard_join.sampled(x) for x in sets]
            for r in range(jaccard_join.RUNS):
                codes = [set(jaccard_join.chosen(x, r + 1)[len(jaccard_join.chosen(x, r)) if r else 0 :].tolist()) for x in sets]
                met = codes[0] & codes[1]
                for _ in range(jaccard_join.DEPTH):
                    met = {c for m in met for c in set(jaccard_join.children(m, samples[0])) & set(jaccard_join.children(m, samples[1]))}
                lost += not met
        missed = (lost / (400 * jaccard_join.RUNS)) ** jaccard_join.RUNS
        assert missed <= 1 - jaccard_join.RECALL, (own, missed)


def test_one_document_of_each_class_stays(spark):
    docs = spark.createDataFrame([(*r, "m") for r in corpus()], "doc_id long, text string, mark_ string")
    kept = jaccard_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    rows = {(i, t) for i, t in corpus()}
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) <= rows
    want = sorted(i for i, c, _ in brute(corpus()) if i == c and i not in (None, 3))
    assert sorted(i for i, _ in got if i not in (None, 3)) == want
    assert {(900, None), (901, ""), (902, " \n"), (3, "another text of id three"), (None, "all alone without an id")} <= set(got)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.classes(empty).count() == 0
    assert jaccard_join.drop_near_copies(empty).count() == 0


def test_a_set_is_joined_once_with_all_its_buckets(spark):
    rows = spark.createDataFrame([(code, bytes([k])) for code in range(30) for k in range(4) if (code + k) % 3], "code long, digest binary")
    sets = spark.createDataFrame([(bytes([k]), k, b"s") for k in range(4)], "digest binary, n int, sample binary")
    got = jaccard_join.at_once(rows, sets)
    assert sorted(tuple(r) for r in got.collect()) == sorted((r.code, r.digest, r.digest[0], b"s") for r in rows.collect())
