import random

from wetcell.operators.components import components


def brute(edges):
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_components_match_brute_force(spark):
    rng = random.Random(4)
    path = [(i, i + 1) for i in range(1000, 1120)]
    rng.shuffle(path)
    star = [(5, i) for i in range(2000, 2300)]
    loose = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]
    edges = path + star + [(a + 9000, b + 9000) for a, b in loose if a != b] + [(1, 2), (2, 1)]
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.label for r in got.collect()} == brute(edges)
    assert got.count() == len(brute(edges))


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_contraction_in_tasks_changes_nothing(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(200) if i % 37] + [(rng.randrange(500), rng.randrange(500)) for _ in range(100)]
    df = spark.createDataFrame([e for e in edges if e[0] != e[1]], "a long, b long")
    want = brute([e for e in edges if e[0] != e[1]])
    for near in (None, F.col("a") % 7, F.lit(0)):
        assert {r.node: r.label for r in components(df, near=near).collect()} == want


def test_only_nodes_of_several_groups_go_through_the_rounds(spark, monkeypatch):
    from pyspark.sql import functions as F

    from wetcell.operators import components as module

    seen = []
    plain = module.rounds
    monkeypatch.setattr(module, "rounds", lambda pairs: seen.append(pairs.count()) or plain(pairs))
    edges = [(i, i + 1) for i in range(1000) if i % 100 != 99]
    got = components(spark.createDataFrame(edges, "a long, b long"), near=(F.col("a") / 50).cast("long"))
    assert {r.node: r.label for r in got.collect()} == brute(edges)
    assert got.count() == 1000 and seen == [10]


def test_regions_cross_tiles_and_scenes(spark, monkeypatch):
    from pyspark.sql import functions as F

    from wetcell.operators import regions

    monkeypatch.setattr(regions, "TILE", 3)
    rng = random.Random(8)
    wet = {(s, r, c) for s in ("a", "b", "b/1") for r in range(11) for c in range(14) if rng.random() < 0.6}
    cells = spark.createDataFrame([(s, r, c, (s, r, c) in wet) for s in ("a", "b", "b/1", "dry") for r in range(11) for c in range(14)], "scene string, r int, c int, on boolean")
    want = brute([(x, y) for x in wet for y in [x, (x[0], x[1] + 1, x[2]), (x[0], x[1], x[2] + 1)] if y in wet])
    got = {(x.scene, x.r, x.c): (x.scene, x.region.r, x.region.c) for x in regions.labelled(cells, "on").collect()}
    assert got == want
    assert regions.labelled(cells.filter(~F.col("on")), "on").count() == 0
