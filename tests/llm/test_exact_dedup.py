import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from wetcell.llm import exact_dedup

ROWS = [
    (1, "Abc"), (5, "aBC"), (3, "ABC"), (2, "Äbc"), (4, "äbc"), (6, None), (7, ""), (8, " "), (None, "abc"), (None, "alone"),
    (9, "twice"), (9, "twice"), (10, "one"), (10, "two"), (11, "x" * 300_000), (12, "X" * 300_000),
]


def brute(rows):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=lambda i: (i != keep, i is None)):
            out.append((i, keep, len(ids), i == keep and first, hashlib.sha256(t.encode()).hexdigest()))
            first = first and i != keep
    return sorted(out, key=str)


def found(df):
    rows = df.withColumn("digest", F.lower(F.hex("digest"))).collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_classes_match_brute_force(spark):
    docs = spark.createDataFrame([(*r, "n", 1) for r in ROWS], "doc_id long, text string, norm string, salt int")
    assert found(exact_dedup.exact_classes(docs)) == brute(ROWS)
    hot = ROWS + [(i, "Hot") for i in range(100, 3000)]
    assert found(exact_dedup.exact_classes(spark.createDataFrame(hot, docs.select("doc_id", "text").schema))) == brute(hot)


def test_content_decides_where_digests_clash(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    clash = exact_dedup.exact_classes(docs, digest=lambda norm: F.lit("same").cast("binary"))
    got = sorted((tuple(r)[:4] for r in clash.collect()), key=str)
    assert got == sorted((r[:4] for r in brute(ROWS)), key=str)


def test_drop_copies_keeps_rows_whole(spark):
    docs = spark.createDataFrame([(*r, "s", 7) for r in ROWS], "doc_id long, text string, digest string, id_ int")
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    want = sorted((i for i, _, _, k, _ in brute(ROWS) if k), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == want
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0
