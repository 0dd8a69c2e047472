import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from wetcell.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, leaf string, tree int, pos int, root string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*map(text, row[:5]))


def tree(leaves, fanout):
    """The root and each leaf's (place, siblings) by level."""
    nodes, at, proofs = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(nodes) > 1:
        for k, i in enumerate(at):
            low = i - i % fanout
            run = nodes[low : low + fanout]
            proofs[k].append((i % fanout, run[: i % fanout] + run[i % fanout + 1 :]))
        nodes, at = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)], [i // fanout for i in at]
    return nodes[0], proofs


def brute(rows, fanout=3):
    """doc_id, leaf, proof, subroot, root, by one tree a source and one above."""
    own = {}
    for r in rows:
        own.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0), leaf(r)))
    sources = sorted(own, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: tree([x for _, x in sorted(own[s])], fanout) for s in sources}
    root, tops = tree([subs[s][0] for s in sources], fanout)
    out = []
    for s, top in zip(sources, tops, strict=True):
        for ((some, i), x), proof in zip(sorted(own[s]), subs[s][1], strict=True):
            out.append((i if some else None, x, tuple((a, tuple(b)) for a, b in proof + top), subs[s][0], root))
    return sorted(out, key=str)


def rows_of(sizes):
    rng, out = random.Random(4), []
    for k, n in enumerate(sizes):
        source = [None, "", "b", "é", "a", "B", "zz"][k % 7] if k < 7 else f"s{k}"
        out += [(rng.randrange(-50, 10**6), source, None if i % 3 else "en", i if i % 4 else None, None if i % 5 == 0 else f"a\nb {i}\n") for i in range(n)]
    out += [(None, "a", "x", 1, ""), (5, "a", "x", 1, "p"), (5, "a", "x", 1, "p"), (5, "a", "x", 1, "q"), (6, "a", None, None, "ä" * 200_000)]
    rng.shuffle(out)
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2, "r") for r in rows], SCHEMA).repartition(4)


def found(df):
    rows = df.select("doc_id", "leaf", "proof", "subroot", "root").collect()
    return sorted(((r.doc_id, r.leaf, tuple((s["at"], tuple(s["siblings"])) for s in r.proof), r.subroot, r.root) for r in rows), key=str)


@pytest.mark.parametrize(("sizes", "fanout", "levels"), [([1, 3, 9, 10, 28, 200, 4], 3, 1), ([37, 1, 0, 5, 64], 2, 0), ([300, 82, 81, 27], 3, 2), ([2, 9] * 12, 3, 7)])
def test_every_proof_matches_one_tree(spark, sizes, fanout, levels):
    rows = rows_of(sizes)
    leaves = merkle.leaves_of(table(spark, rows))
    assert found(merkle.manifest(leaves, fanout=fanout, levels=levels)) == brute(rows, fanout)


def test_columns_are_carried_and_proofs_fold(spark):
    rows = rows_of([30, 4, 12])
    leaves = merkle.leaves_of(table(spark, rows)).withColumns({"tree": F.lit("mine"), "n": F.col("doc_id") * 2, "Pos": F.lit(None).cast("double")})
    got = merkle.manifest(leaves, levels=1)
    assert got.columns == [*leaves.columns, "proof", "subroot", "root"]
    got = got.withColumns({"up": merkle.folded(F.col("leaf"), F.col("proof")), "wrong": merkle.folded(F.lit("0" * 64), F.col("proof"))})
    assert got.filter("up = root AND wrong != root AND tree = 'mine' AND n <=> doc_id * 2").count() == len(rows)


def test_empty_table_and_a_single_row(spark):
    assert merkle.manifest(merkle.leaves_of(table(spark, []).limit(0))).count() == 0
    only = merkle.manifest(merkle.leaves_of(table(spark, [(1, None, None, None, None)]))).first()
    want = h("1:1", "-", "-", "-", "-")
    assert (only.leaf, only.subroot, only.root, only.proof) == (want, want, want, [])


def test_tampered_rows_are_found(spark, tmp_path):
    rows = rows_of([40, 3, 12])
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()
    changed = sum(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and "\n" in (r[4] or "") for r in rows)
    assert sum(not r.verified for r in got) == changed and len(got) == len(rows)
    proofs = {(i, x): h(*(y for _, own in p for y in own)) for i, x, p, _, _ in brute(rows)}
    assert all(r.proof_sha256 in {proofs[r.doc_id, r.leaf]} or [x[0] for x in brute(rows)].count(r.doc_id) > 1 for r in got)
