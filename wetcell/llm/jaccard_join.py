"""N-gram Jaccard join by chosen paths (operator 4).

A document is the set of its five-word shingles (lower case, split at white space; a shorter text is one shingle), as
64-bit tokens. Documents with equal sets are one class of copies; links are between classes with Jaccard >= 0.8.

1. Choose: in each of `runs` runs a set goes into one bucket per token whose hash is under 1 / (0.8 * size), so that two
   sets linked at 0.8 share at least one bucket a run on average.
2. Recurse: buckets over `most` classes or `most_tokens` tokens are split again, on minima of the sets' tokens (a sample
   of 128 of them travels with the set) chosen in the same way; what is too large after `depth` splits is dealt into
   blocks, and every pair of blocks becomes a bucket: slower, but no pair is lost.
3. Brute force: equal buckets are merged; pairs whose samples agree too little for 0.8 are put aside; the others' whole
   sets are fetched and intersected exactly. A pair that meets in several buckets counts in the first one.

With the default 16 runs a link at exactly 0.8 is missed with a chance of about 1e-7 without recursion and 5e-4 after two
splits (RECALL); a third would miss 2e-3 and more, so buckets too large after two are dealt into blocks. Buckets return
sums and one edge a class, never pairs; their size is bounded by the limits above.

Exact numbers of links take every pair of a group of linked sets. Where only the classes are wanted (links=False, as in
the pipeline) the sets of an oversized bucket first meet a few representatives and the sets of their chunk, which takes
work in proportion to the bucket; pairs within the largest group that this connects are then left out.

Nulls, ties and odd input: null and blank texts have no shingles, no links and their own doc_id as class; a null doc_id
is never a class id unless all ids of the class are null; repeated rows are copies of each other; an empty table gives an
empty result; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from wetcell.llm.common import small_batches, unused
from wetcell.operators.components import components
from wetcell.storage import durable

WORDS = 5
NEAR = 0.8
RECALL = 0.999
RUNS = 16
BINS = 128
REPRESENTATIVES = 16  # of an oversized bucket
DEPTH = 2  # a third split would bring recall at 0.8 under RECALL with RUNS runs
MOST = 2000
MOST_TOKENS = 4_000_000
FORGET = 1 << 18  # distinct words that a task remembers before it starts anew
LEAST_ALIKE = 0.6  # samples of sets at 0.8 agree less than this with a chance below 1e-5
_MIX = np.random.Generator(np.random.PCG64(20)).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)  # odd multipliers


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(32))) * _MIX[60]
    x = (x ^ (x >> np.uint64(29))) * _MIX[61]
    return x ^ (x >> np.uint64(32))


class Shingler:
    def __init__(self):
        self.known: dict[str, int] = {}

    def tokens(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit tokens of the text's shingles."""
        known, words = self.known, text.lower().split()
        if len(known) > FORGET:
            known.clear()
        hashes = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"))
            hashes[i] = h
        if not words:
            return hashes
        n = max(1, len(words) - WORDS + 1)
        total = np.zeros(n, np.uint64)
        for j in range(min(WORDS, len(words))):
            total += mixed(hashes[j : j + n] + _MIX[50 + j]) * _MIX[40 + j]
        return np.unique(mixed(total))


def sampled(tokens: np.ndarray) -> bytes:
    """One byte for the least token of each of BINS ranges; 0 where a range has none."""
    bins = (tokens >> np.uint64(57)).astype(np.intp)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out = np.zeros(BINS, np.uint8)
    out[bins[first]] = (mixed(tokens[first]) % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes()


def chosen(tokens: np.ndarray, runs: int) -> np.ndarray:
    """The codes of the set's buckets: run and token."""
    limit = np.uint64(min(2**64 - 1, int(2**64 / (NEAR * len(tokens)))))
    found = [mixed(tokens[tokens * _MIX[r % 40] + np.uint64(r) <= limit] + _MIX[r % 40]) for r in range(runs)]
    return np.concatenate(found).view(np.int64)


def children(code: int, sample: bytes) -> list[int]:
    """The buckets that a set with this sample goes to from bucket `code`."""
    values = np.frombuffer(sample, np.uint8)
    held = np.flatnonzero(values)
    draws = mixed(np.uint64(code & (2**64 - 1)) ^ (held.astype(np.uint64) * _MIX[45]))
    held = held[draws <= np.uint64(min(2**64 - 1, int(2**64 / (NEAR * max(1, len(held))))))]
    keys = held.astype(np.uint64) * np.uint64(256) + values[held]
    return mixed(mixed(keys + _MIX[46]) ^ np.uint64(code & (2**64 - 1))).view(np.int64).tolist()


_FEATURES = "doc_id long, mark long, digest binary, n int, sample binary, codes array<long>"


def featurer(runs: int):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            rows = []
            for text in batch.column(2):
                tokens = shingler.tokens(text.as_py() or "")
                digest = xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None
                rows.append((digest, len(tokens), sampled(tokens), chosen(tokens, runs).tolist() if len(tokens) else []))
            kinds = (pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "mark", "digest", "n", "sample", "codes"])

    return features


def token_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        tokens = [shingler.tokens(x.as_py() or "") for x in batch.column(0)]
        digests = pa.array([xxhash.xxh3_128_digest(t.tobytes()) for t in tokens], pa.binary())
        yield pa.RecordBatch.from_arrays([digests, pa.array([t.tobytes() for t in tokens], pa.binary())], names=["digest", "tokens"])


@F.arrow_udf(T.ArrayType(T.LongType()))
def split_on(codes: pa.Array, samples: pa.Array) -> pa.Array:
    return pa.array([children(c.as_py(), s.as_py()) for c, s in zip(codes, samples, strict=True)], pa.list_(pa.int64()))


def alike(n: np.ndarray, samples: np.ndarray) -> np.ndarray:
    """Which pairs could have Jaccard >= NEAR, by their samples and sizes; a square of booleans."""
    m = len(n)
    out = np.zeros((m, m), bool)
    for i in range(m):
        held = (samples[i] > 0) | (samples > 0)
        same = ((samples[i] == samples) & held).sum(axis=1)
        out[i] = (same >= LEAST_ALIKE * held.sum(axis=1)) & (np.minimum(n, n[i]) >= NEAR * np.maximum(n, n[i]))
    np.fill_diagonal(out, False)
    return out


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def hopeful(sets: pa.Array) -> pa.Array:
    """The digests of a bucket's sets (digest, n, sample) that have a partner to be compared with, sorted."""
    out = []
    for bucket in sets.to_pylist():
        n = np.array([x["n"] for x in bucket])
        samples = np.frombuffer(b"".join(x["sample"] for x in bucket), np.uint8).reshape(len(bucket), BINS)
        out.append(sorted(bucket[i]["digest"] for i in np.flatnonzero(alike(n, samples).any(axis=1))))
    return pa.array(out, pa.list_(pa.binary()))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairs' intersections: a product of membership matrices, some tokens at a time."""
    m = len(sets)
    if m == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, token, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[token] > 1
    column = (np.cumsum(counts > 1) - 1)[token[shared]]
    owner, total, width = owner[shared], np.zeros((m, m)), max(256, 2**24 // m)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        part = np.zeros((m, min(width, int(column[-1]) + 1 - low)), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        total += part @ part.T
    return total.astype(np.int64)


def linked(bucket: list[dict], code: int) -> list[tuple[bytes, bytes, int]]:
    """(digest, root, links) of a bucket's sets that have links. root: the least set that links lead to in this bucket;
    links: the documents at the other ends of the links that no smaller code of both sets has."""
    sets = [np.frombuffer(x["tokens"], np.uint64) for x in bucket]
    n, m = np.array([len(s) for s in sets]), len(sets)
    both = intersections(sets)
    link = 5 * both >= 4 * (n[:, None] + n[None, :] - both)
    np.fill_diagonal(link, False)
    if not link.any():
        return []
    lower = [np.array(sorted(c for c in x["buckets"] or () if c < code), np.int64) for x in bucket]
    links = (link & (intersections(lower) == 0)) @ np.array([x["size"] for x in bucket], np.int64)
    rank = np.argsort(np.argsort(np.array([x["digest"] for x in bucket], object)))
    root, last = rank, None
    reach = link | np.eye(m, dtype=bool)
    while last is None or (root != last).any():
        last, root = root, np.where(reach, root[None, :], m).min(axis=1)
    by_rank = np.argsort(rank)
    return [(bucket[i]["digest"], bucket[by_rank[root[i]]]["digest"], int(links[i])) for i in np.flatnonzero(link.any(axis=1))]


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for code, bucket in zip(batch.column(0), batch.column(1), strict=True):
            rows = linked(bucket.as_py(), code.as_py())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.binary(), pa.binary(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "root", "links"])


def one_group_aside(large: DataFrame, groups: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """large: rows of oversized buckets; groups: digest, label of sets known to be connected. Pairs within the largest group
    of a bucket tell nothing new. Where at most most / 2 sets are outside it, they meet the group's sets in chunks: those
    buckets (code, digest), and the rows of the other oversized buckets."""
    rows = large.join(groups, "digest", "left")
    by = rows.filter("label IS NOT NULL").groupBy("code", "label").agg(F.count(F.lit(1)).alias("own"))
    top = by.groupBy("code").agg(F.max_by("label", F.struct("own", "label")).alias("top"), F.max("own").alias("own"))
    rows = rows.join(top, "code", "left").withColumn("others", F.col("count") - F.coalesce("own", F.lit(0)))
    few = F.col("others") * 2 <= most
    chunks = F.greatest(F.ceil(F.col("own") * 2 / most), F.lit(1))
    member = F.coalesce(F.col("label") == F.col("top"), F.lit(False))
    chunk = F.when(member, F.array(F.pmod(F.xxhash64("digest"), chunks))).otherwise(F.sequence(F.lit(0).cast("long"), chunks - 1))
    near = rows.filter(few & (F.col("others") > 0)).withColumn("chunk", F.explode(chunk))
    return near.select(F.xxhash64("code", "chunk", F.lit("aside")).alias("code"), "digest"), rows.filter(~few).select(*large.columns)


def at_once(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows (code, digest) with the columns of sets. A set is joined once, with the codes of all its buckets: they are some
    20 a split, whatever the buckets' sizes."""
    held = rows.groupBy("digest").agg(F.collect_list("code").alias("held")).join(sets, "digest")
    return held.select(F.explode("held").alias("code"), *sets.columns)


def buckets_of(sets: DataFrame, depth: int, most: int, most_tokens: int, grouped=None) -> DataFrame:
    """sets: digest, n, sample, codes. code, members (sorted digests) of buckets within the limits, equal ones merged.
    grouped, if links need no count: a function from rows of oversized buckets to digest, label of connected sets."""
    rows = sets.select(F.explode("codes").alias("code"), "digest", "n")
    small: DataFrame | None = None
    fits = (F.col("count") <= most) & (F.col("total") <= most_tokens)
    for level in range(depth + 1):
        rows = durable(rows)
        counts = rows.groupBy("code").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("total")).filter(F.col("count") > 1)
        sized = rows.join(counts, "code")
        found = sized.filter(fits).select("code", "digest")
        small = found if small is None else small.unionByName(found)
        large = durable(sized.filter(~fits))
        if large.isEmpty():
            break
        if grouped is not None:
            groups = grouped(large) if level == 0 else groups
            near, large = one_group_aside(large, groups, most)
            small, large = small.unionByName(near), durable(large)
            if large.isEmpty():
                break
        if level < depth:
            picked = at_once(large.select("code", "digest"), sets.select("digest", "n", "sample"))
            rows = picked.select(F.explode(split_on("code", "sample")).alias("code"), "digest", "n")
        else:  # every pair of blocks is a bucket
            halves = F.greatest(F.ceil(F.col("count") * 2 / most), F.ceil(F.col("total") * 2 / most_tokens))
            own = large.withColumn("blocks", halves).withColumn("own", F.pmod(F.xxhash64("digest"), F.col("blocks")))
            own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            code = F.xxhash64("code", F.least("own", "other"), F.greatest("own", "other"))
            small = small.unionByName(own.select(code.alias("code"), "digest"))
    members = small.groupBy("code").agg(F.array_sort(F.collect_list("digest")).alias("members"))
    return members.filter(F.size("members") > 1).groupBy("members").agg(F.min("code").alias("code"))


def classes(docs: DataFrame, *, links: bool = True, runs: int = RUNS, depth: int = DEPTH, most: int = MOST, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """One row per document: doc_id, mark (hash of its text), class_id (least doc_id of all that links lead to), copies
    (documents with the same shingles, itself too), n_links (other documents at 0.8 or more, copies too; null without
    links). The count takes every pair of linked sets; without it the sets of a large group meet its representatives,
    and pairs within the group are left out, since they are of one class already."""
    small_batches(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").alias("text"))
    every = durable(text.mapInArrow(featurer(runs), _FEATURES))
    held = every.filter("digest IS NOT NULL")
    sets = durable(held.groupBy("digest").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("sample").alias("sample"), F.first("codes").alias("codes")
    ))
    no_id = F.lit(-(2**63))

    def whole_sets(wanted: DataFrame) -> DataFrame:
        """wanted (digest, least, ...) with tokens: their texts are found by one doc_id of each."""
        ids = wanted.select(F.coalesce("least", no_id).alias("id")).distinct()
        texts = text.withColumn("id", F.coalesce("doc_id", no_id)).join(ids, "id", "left_semi").select("text")
        whole = texts.mapInArrow(token_sets, "digest binary, tokens binary")
        return whole.join(wanted, "digest").dropDuplicates(["digest"])

    def grouped(large: DataFrame) -> DataFrame:
        """Each set meets the representatives of its largest bucket, and the sets of its chunk."""
        at = large.groupBy("digest").agg(F.max(F.struct("count", "code", "total")).alias("b")).select("digest", "b.*")
        chunks = F.greatest(F.ceil(F.col("count") * 2 / most), F.ceil(F.col("total") * 2 / most_tokens))
        place = F.row_number().over(W.partitionBy("code").orderBy(F.xxhash64("digest"), "digest"))
        heads = at.withColumn("place", place).filter(F.col("place") <= REPRESENTATIVES)
        dealt = at.select("code", F.pmod(F.xxhash64("digest"), chunks).alias("chunk"), "digest")
        dealt = dealt.unionByName(heads.select("code", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"), "digest")).distinct()
        dealt = durable(dealt.select(F.xxhash64("code", "chunk").alias("code"), "digest"))
        wanted = dealt.groupBy("digest").agg(F.collect_list("code").alias("at")).join(sets.select("digest", "least"), "digest")
        full = whole_sets(wanted).select(F.explode("at").alias("code"), "digest", F.lit(0).cast("long").alias("size"), F.lit(None).cast("array<long>").alias("buckets"), "tokens")
        full = full.groupBy("code").agg(F.collect_list(F.struct("digest", "size", "buckets", "tokens")).alias("bucket"))
        edges = durable(full.mapInArrow(joined, "digest binary, root binary, links long"))
        found.append(edges)
        return durable(components(edges.select(F.col("digest").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "digest"))

    found: list[DataFrame] = []
    buckets = durable(buckets_of(sets, depth, most, most_tokens, None if links else grouped))
    sketched = at_once(buckets.select("code", F.explode("members").alias("digest")), sets.select("digest", "n", "sample"))
    sketched = sketched.groupBy("code").agg(F.collect_list(F.struct("digest", "n", "sample")).alias("sets"))
    likely = sketched.select("code", hopeful("sets").alias("members")).filter(F.size("members") > 1)
    likely = durable(likely.groupBy("members").agg(F.min("code").alias("code")).select("code", F.explode("members").alias("digest")))
    per_set = likely.groupBy("digest").agg(F.collect_list("code").alias("buckets"))
    wanted = durable(per_set.join(sets.select("digest", "least", "size"), "digest"))
    full = whole_sets(wanted).select(F.explode("buckets").alias("code"), "digest", "size", "buckets", "tokens")
    full = full.groupBy("code").agg(F.collect_list(F.struct("digest", "size", "buckets", "tokens")).alias("bucket"))
    found.append(durable(full.mapInArrow(joined, "digest binary, root binary, links long")))
    edges = reduce(DataFrame.unionByName, found)
    labels = components(edges.select(F.col("digest").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "digest")
    others = edges.groupBy("digest").agg(F.sum("links").alias("links"))
    named = sets.select("digest", "least", "size").join(labels, "digest", "left").join(others, "digest", "left")
    named = named.withColumn("label", F.coalesce("label", "digest"))
    heads = named.groupBy("label").agg(F.min("least").alias("class_id"))
    n_links = F.col("size") - 1 + F.coalesce("links", F.lit(0)) if links else F.lit(None).cast("long")
    named = durable(named.join(heads, "label").select("digest", "class_id", F.col("size").alias("copies"), n_links.alias("n_links")))
    alone = every.filter("digest IS NULL").select("doc_id", "mark", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("copies"), F.lit(0 if links else None).cast("long").alias("n_links"))
    return held.select("doc_id", "mark", "digest").join(named, "digest").drop("digest").unionByName(alone)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each class, that of the class's id; all columns as they were. Texts without shingles all stay."""
    found = classes(docs, links=False).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    no_id = F.lit(-(2**63))
    stay = found.select(F.coalesce("doc_id", no_id).alias("stay"), F.col("mark").alias("text_mark"))
    id_, mark, one = (unused(docs, x) for x in ("id_", "mark_", "one_"))
    rows = docs.withColumns({id_: F.coalesce("doc_id", no_id), mark: F.xxhash64("text")})
    rows = rows.join(stay, (rows[id_] == stay["stay"]) & (rows[mark] == stay["text_mark"]), "left_semi")
    first = F.row_number().over(W.partitionBy(id_, mark).orderBy(F.lit(0)))
    return rows.withColumn(one, first).filter(F.col(one) == 1).drop(id_, mark, one)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("mark")


#: Every pair of documents that share a shingle, by exact Jaccard; classes by the least id that links lead to.
OP4_SQL = """
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\s\\x0B\\x1C-\\x1F\\x85\\xA0]+'), lambda w: w <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS t FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b, m = x.n AND m = y.n AS same FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * m >= 4 * (x.n + y.n - m)),
reach AS (SELECT doc_id AS a, doc_id AS least FROM d UNION SELECT l.b, r.least FROM reach r JOIN link l ON l.a = r.a WHERE r.least < l.b)
SELECT doc_id, (SELECT min(least) FROM reach WHERE a = doc_id) AS class_id, 1 + count(*) FILTER (same) AS copies, count(b) AS n_links
FROM d LEFT JOIN link ON a = doc_id GROUP BY doc_id
"""
