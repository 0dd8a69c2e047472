import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from wetcell.llm import line_dedup


def rows():
    found = []
    for i in range(600):
        own = [f"this line is of document {i}", f"  shared by group {i % 7} of the sites  ", "short"]
        if i % 3 == 0:
            own.insert(1, "one very common line of many sites")
        found.append((i, "\n".join(own), f"site{i % 40}"))
    near = [(1000 + k * 50 + j, f"near the threshold {k:03d} padded", f"site{j}") for k in range(8, 13) for j in range(k)]
    return found + near + [(2000, None, "site1"), (2001, "", None), (2002, "one very common line of many sites", None), (5, "another\ntext of id five", "x"), (None, "one very common line of many sites\nx", "y"), (2003, "word " * 50_000, "z")]


def brute(data, sites, least):
    on = defaultdict(set)
    for _, t, s in data:
        for line in (t or "").split("\n"):
            if len(line.strip(" ")) >= least and s is not None:
                on[line.strip(" ")].add(s)
    shared = {x for x, s in on.items() if len(s) >= sites}
    out = []
    for i, t, _ in data:
        lines = (t or "").split("\n")
        kept = [x for x in lines if x.strip(" ") not in shared]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    docs = spark.createDataFrame([(*r, "k") for r in rows()], "doc_id long, text string, source string, keys string")
    for sites in (2, 10, 30, 41):
        got = line_dedup.without_shared_lines(docs, sites=sites).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows(), sites, 1)


def test_many_sites_need_the_sketch(spark):
    data = [(k * 1000 + j, f"line number {k} of the many sites", f"s{j}") for k, n in enumerate((150, 199, 200, 201, 260)) for j in range(n)]
    got = line_dedup.without_shared_lines(spark.createDataFrame(data, "doc_id long, text string, source string"), sites=200)
    removed = {r[0] for r in got.filter("n_removed > 0").select(F.expr("doc_id div 1000")).distinct().collect()}
    assert removed == {2, 3, 4}


def test_empty_table(spark):
    assert line_dedup.without_shared_lines(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_the_query_removes_short_lines_too(spark, tmp_path):
    texts = [f"Les.\nown {i}\n\n \t\nNt onor. The of it.\r" for i in range(10)] + ["Les.\nand more", "rare\nkept"]
    data = [(i, t, f"s{i % 10}") for i, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.clean_sha256) for r in line_dedup.op9_line_dedup(spark, str(tmp_path)).collect()}
    want = [f"own {i}\n\n \t" for i in range(10)] + ["and more", "rare\nkept"]
    lost = [2] * 10 + [1, 0]
    assert got == {i: (t.count("\n") + 1, n, hashlib.sha256(w.encode()).hexdigest()) for i, (t, n, w) in enumerate(zip(texts, lost, want, strict=True))}


def test_many_rows_without_id_are_kept_apart(spark):
    shared = [(None, f"all of them\nown {i}\n", f"s{i % 12}", i) for i in range(300)]
    docs = spark.createDataFrame(shared + [(None, None, "s1", -1), (None, "alone", None, -2)], "doc_id long, text string, source string, digest int")
    found = line_dedup.without_shared_lines(docs, sites=10).collect()
    assert sorted((x.text, x.n_lines, x.n_removed) for x in found) == sorted([(f"own {i}\n", 3, 1) for i in range(300)] + [("", 1, 0), ("alone", 1, 0)])


def test_a_text_of_many_shared_lines_takes_time_in_proportion(spark):
    many = [f"shared line number {i}" for i in range(60_000)]
    own = ["first", *many[:30_000], "", "middle", *many[30_000:], "last"]
    data = [(0, "\n".join(own), "a"), (1, "\n".join(many), "b"), (2, "\n".join(["first", *many[:10]]), "c")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.without_shared_lines(docs, sites=2).collect()}
    assert got == {0: ("\nmiddle\nlast", 60_004, 60_001), 1: ("", 60_000, 60_000), 2: ("", 11, 11)}
