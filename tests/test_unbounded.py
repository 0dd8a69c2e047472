import math
import random

from wetcell.queries import fields

MEASURES = {
    "n1_distance_chessboard": lambda dr, dc: max(abs(dr), abs(dc)),
    "n2_distance_taxicab": lambda dr, dc: abs(dr) + abs(dc),
    "n3_distance_euclidean": lambda dr, dc: math.sqrt(dr * dr + dc * dc),
}


def test_unbounded_queries_match_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-0.1, 0.1) for _ in range(64)]) for i in range(48)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    cells = fields.partial(spark, str(tmp_path)).select("r", "c", "wse2").collect()
    wet = [(x.r, x.c, x.wse2) for x in cells if x.wse2 is not None]
    assert wet and len(cells) == 48 * 64

    def best(r, c, measure):
        return min((measure(a - r, b - c), (a - r) ** 2 + (b - c) ** 2, a, b, v) for a, b, v in wet)

    far = 0
    for name, measure in MEASURES.items():
        got = fields.QUERIES[f"{name}_unbounded"](spark, str(tmp_path)).collect()
        want = {(x.r, x.c): best(x.r, x.c, measure) for x in cells}
        assert {(x.r, x.c): (x.d, x.sr, x.sc) for x in got} == {k: (n[0], n[2], n[3]) for k, n in want.items()}
        far += sum(n[0] > fields.REACH for n in want.values())
    assert far
    got = fields.QUERIES["n5_nearest_fill_fine_unbounded"](spark, str(tmp_path)).collect()
    assert {(x.r, x.c): x.fill for x in got} == {(x.r, x.c): best(x.r, x.c, MEASURES["n1_distance_chessboard"])[4] for x in cells}
