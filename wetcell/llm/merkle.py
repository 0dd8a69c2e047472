"""Merkle manifests by a butterfly exchange (operator 13).

A manifest has a tree for each group (source): its leaves ascend by id, and every `fanout` consecutive nodes become their
hash, level by level, until one is left, the subroot. Subroots in order of groups are the leaves of one more tree, whose
root stands for the whole table. A leaf's proof has its siblings on every level.

1. leaves: a hash per row, made where the text is read; texts never move.
2. order: narrow rows are dealt by ranges of (group, id, leaf), so that a group with a third of the rows is many ranges.
   Each range numbers its groups and rows; what the ranges before it had comes from one line per range.
3. blocks: fanout ** levels consecutive leaves of a tree are a block, hashed within a task.
4. butterfly: in round r the blocks of `fanout` neighbouring subtrees of fanout ** r blocks swap the subtrees' roots, each
   with those at its own rank in the other subtrees. All of them hash the ancestor they now share, so that after the last
   round every block has its tree's root and the siblings above it, and nothing has to be sent down. In the last, partly
   filled subtree the blocks serve the ranks beyond it too, in turn.
5. proofs: a block's leaves meet the block's upper proof and hash their part again. The tree of subroots is built by the
   same steps.

Only hashes move, twice: by range and by block. A round moves a row for each block.

Nulls, ties and odd input: the null group is a tree of its own and comes first, null ids come first in their group; rows
with the same id are ordered by leaf, rows that tie in both are the same row; an empty text is not a null one; an empty
table gives an empty result; columns beyond those that are named are carried along by manifest() and ignored by leaves_of().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wetcell.storage import durable

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<at: int, siblings: array<string>>"
PROOF = f"array<{STEP}>"
_STEP = pa.struct([("at", pa.int32()), ("siblings", pa.list_(pa.string()))])


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def joined_hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def numbering(group: str):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows -> with chunk (the range), tree (the group's number in it) and pos (the row's number in that)."""
        chunk, tree, last, n = TaskContext.get().partitionId(), -1, None, 0
        for batch in batches:
            runs = pc.run_end_encode(batch[group])
            ends = runs.run_ends.to_numpy()
            lengths = np.diff(ends, prepend=0)
            values = runs.values.to_pylist()
            news = np.array([v != w for v, w in zip(values, [last, *values], strict=False)], bool)
            news[0] |= tree < 0
            trees = tree + np.cumsum(news)
            begins = np.where(news, 0, n)  # only the first run can go on with what came before
            pos = np.arange(batch.num_rows) - np.repeat(ends - lengths, lengths) + np.repeat(begins, lengths)
            tree, last, n = int(trees[-1]), values[-1], int(pos[-1]) + 1
            own = [pa.array(np.full(batch.num_rows, chunk, np.int64)), pa.array(np.repeat(trees, lengths).astype(np.int64)), pa.array(pos.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, "chunk", "tree", "pos"])

    return number


def ordered(rows: DataFrame, group: str, id: str) -> DataFrame:
    """rows with tree, the rank of the group (null first, by bytes), and pos, the rank in the group by id and leaf."""
    spark = rows.sparkSession
    rows = durable(rows)
    order = [F.col(c).asc_nulls_first() for c in (group, id, "leaf")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in ("chunk", "tree", "pos"))])
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = durable(sorted_rows.mapInArrow(numbering(group), schema))
    edge = F.struct("tree", "pos", F.col(group).alias("group"))
    lines = rows.groupBy("chunk").agg(F.min(edge).alias("first"), F.max(edge).alias("last")).orderBy("chunk").collect()  # one a range
    known, before, last, count = [], 0, None, 0
    for k, x in enumerate(lines):
        goes_on = k > 0 and x.first.group == last
        before = before - 1 if goes_on else before  # trees before the range's first one
        carried = count if goes_on else 0
        known.append((x.chunk, before, carried))
        count = x.last.pos + 1 + (carried if x.last.tree == 0 else 0)
        before, last = before + x.last.tree + 1, x.last.group
    offsets = spark.createDataFrame(known, "chunk long, before long, carried long")
    joined = rows.join(F.broadcast(offsets), "chunk")
    pos = F.col("pos") + F.when(F.col("tree") == 0, F.col("carried")).otherwise(0)
    return joined.select(*(c for c in rows.columns if c not in ("chunk", "tree", "pos")), (F.col("tree") + F.col("before")).alias("tree"), pos.alias("pos"))


def levels_of(leaves: list[str], fanout: int, levels: int, alone: bool) -> list[list[str]]:
    """The block's nodes, from the leaves up to its root. A tree's only block ends where one node is left."""
    out = [leaves]
    while len(out) <= levels and not (alone and len(out[-1]) == 1):
        nodes = out[-1]
        out.append([joined_hash(nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)])
    return out


def block_roots(fanout: int, levels: int):
    def root(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        alone = rows["block"][0].as_py() == 0 and rows.num_rows <= fanout**levels  # a full first block has the same levels
        top = levels_of(rows["leaf"].to_pylist(), fanout, levels, alone)[-1]
        return pa.table({"tree": rows["tree"].slice(0, 1), "block": rows["block"].slice(0, 1), "hash": pa.array(top)})

    return root


def swapped(nodes: DataFrame, r: int, fanout: int) -> DataFrame:
    """Round r. nodes: tree, block, n (the tree's blocks), hash (of the block's ancestor so far), proof."""
    width, wide = fanout**r, fanout ** (r + 1)
    block, n = F.col("block"), F.col("n")
    nodes = nodes.withColumns({"subtree": F.expr(f"block div {width}"), "rank": block % width, "team": F.expr(f"block div {wide}")})
    own = F.least(F.lit(width), n - F.col("subtree") * width)  # blocks of the subtree
    first = F.least(F.lit(width), n - F.col("team") * wide)  # blocks of the team's first subtree, the largest
    # to its own rank, and in turn to those that the subtree does not reach
    sent = nodes.withColumn("to", F.explode(F.sequence(F.col("rank"), first - 1, own)))
    message = F.struct("subtree", "hash", F.when(F.col("to") == F.col("rank"), F.col("proof")).alias("proof"))
    teams = sent.groupBy("tree", "n", "team", "to").agg(F.sort_array(F.collect_list(message)).alias("team_nodes"))  # fanout at most
    hashes = F.transform("team_nodes", lambda x: x["hash"])
    ends = F.col("n") <= width  # this tree's root is reached already
    teams = teams.withColumn("parent", F.when(ends, F.element_at(hashes, 1)).otherwise(F.sha2(F.array_join(hashes, ""), 256)))
    member = F.posexplode("team_nodes").alias("at", "member")
    members = teams.select("tree", "n", "to", "parent", hashes.alias("hashes"), member).filter("member.proof IS NOT NULL")
    others = F.expr("filter(hashes, (x, i) -> i != at)")
    step = F.struct(F.col("at").cast("int").alias("at"), others.alias("siblings"))
    proof = F.when(F.col("n") <= width, F.col("member.proof")).otherwise(F.concat("member.proof", F.array(step)))
    return members.select("tree", (F.col("member.subtree") * width + F.col("to")).alias("block"), "n", F.col("parent").alias("hash"), proof.alias("proof"))


def climbed(leaves: DataFrame, fanout: int, levels: int) -> DataFrame:
    """leaves: tree, pos, leaf. tree, block, n, hash (the tree's root) and proof (above the block) of every block."""
    rows = leaves.select("tree", "pos", "leaf", F.expr(f"pos div {fanout**levels}").alias("block"))
    roots = durable(rows.groupBy("tree", "block").applyInArrow(block_roots(fanout, levels), "tree long, block long, hash string"))
    counts = durable(roots.groupBy("tree").agg(F.count(F.lit(1)).alias("n")))
    most, rounds = counts.agg(F.max("n")).first()[0] or 0, 0
    nodes = roots.join(counts, "tree").withColumn("proof", F.array().cast(PROOF))
    while fanout**rounds < most:
        nodes = swapped(nodes, rounds, fanout)
        rounds += 1
    return durable(nodes.select("tree", "block", "n", "hash", "proof"))


def proving(fanout: int, levels: int, kept: list[str], schema: pa.Schema):
    def prove(rows: pa.Table, blocks: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        rows = rows.sort_by("pos")
        steps = levels_of(rows["leaf"].to_pylist(), fanout, levels, blocks["n"][0].as_py() == 1)
        at, siblings, index, base = [], [], [], 0
        place = np.arange(rows.num_rows)
        for nodes in steps[:-1]:
            for i in range(len(nodes)):
                low = i - i % fanout
                at.append(i % fanout)
                siblings.append([*nodes[low:i], *nodes[i + 1 : low + fanout]])
            index.append(base + place)
            base, place = base + len(nodes), place // fanout
        upper = blocks["proof"][0].as_py()
        at += [s["at"] for s in upper]
        siblings += [s["siblings"] for s in upper]
        index += [np.full(rows.num_rows, base + k) for k in range(len(upper))]
        every = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(siblings, pa.list_(pa.string()))], fields=list(_STEP))
        taken = every.take(pa.array(np.stack(index, axis=1).ravel() if index else np.zeros(0, np.int64)))
        proof = pa.ListArray.from_arrays(pa.array(np.arange(rows.num_rows + 1) * len(index), pa.int32()), taken)
        repeat = lambda c: pa.array([blocks[c][0].as_py()] * rows.num_rows, pa.string())
        return pa.table([*(rows[c].combine_chunks() for c in kept), proof, repeat("subroot"), repeat("root")], schema=schema)

    return prove


def proved(leaves: DataFrame, blocks: DataFrame, fanout: int, levels: int) -> DataFrame:
    """leaves with proof, subroot, root. blocks: tree, block, n, proof, subroot, root."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = leaves.columns
    ends = T.StructType.fromDDL(f"proof {PROOF}, subroot string, root string")
    schema = T.StructType([*leaves.schema.fields, *ends.fields])
    rows = leaves.withColumn("block", F.expr(f"pos div {fanout**levels}"))
    return rows.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(proving(fanout, levels, kept, to_arrow_schema(schema)), schema)


def manifest(leaves: DataFrame, *, id: str = "doc_id", group: str = "source", fanout: int = 3, levels: int = 7) -> DataFrame:
    """leaves: id, group, leaf (hex) and columns that are carried along. Adds proof (a step a level, from the leaf up: the
    node's place in its run and the run's other nodes), subroot and root."""
    names = leaves.columns
    own = leaves.select(*(F.col(c).alias(c if c in (id, group, "leaf") else f"more_{k}") for k, c in enumerate(names)))
    rows = durable(ordered(own, group, id))
    blocks = climbed(rows, fanout, levels)
    tops = blocks.filter("block = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("hash").alias("leaf"))
    above = climbed(tops, fanout, levels).select("tree", "block", "n", "proof", F.col("hash").alias("subroot"), F.col("hash").alias("root"))
    tops = durable(proved(tops, above, fanout, levels))
    upper = tops.select(F.col("pos").alias("tree"), F.col("leaf").alias("subroot"), "root", F.col("proof").alias("top_proof"))
    blocks = blocks.select("tree", "block", "n", "proof").join(upper, "tree")
    blocks = blocks.select("tree", "block", "n", F.concat("proof", "top_proof").alias("proof"), "subroot", "root")
    found = proved(rows, blocks, fanout, levels)
    return found.select(*(F.col(o).alias(n) for o, n in zip(own.columns, names, strict=True)), "proof", "subroot", "root")


def leaves_of(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source and leaf of every document, and more columns."""
    return docs.select("doc_id", "source", leaf_hash(*map(F.col, FIELDS)).alias("leaf"), *more)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that leaf and proof give."""
    up = lambda acc, s: F.sha2(F.concat(F.array_join(F.slice(s["siblings"], 1, s["at"]), ""), acc, F.array_join(F.slice(s["siblings"], s["at"] + 1, F.size(s["siblings"])), "")), 256)
    return F.aggregate(proof, leaf, up)


def proof_hash(proof: Column) -> Column:
    """The hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda s: s["siblings"])), ""), 256)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    text = F.when(crc % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = leaves_of(docs, leaf_hash(*map(F.col, FIELDS[:-1]), text).alias("tampered"))
    found = manifest(rows.withColumn("tampered", F.when(F.col("tampered") != F.col("leaf"), F.col("tampered"))))
    found = found.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", proof_hash(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def _climb(table: str, levels: int) -> str:
    """SQL: a level at a time, each node with the siblings before and after it; at most `levels` levels."""
    out = []
    for k in range(levels):
        out.append(f"""{table}_s{k} AS (
  SELECT tree, pos, h, count(*) OVER (PARTITION BY tree) AS n,
    coalesce(string_agg(h, '') OVER (PARTITION BY tree, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre,
    coalesce(string_agg(h, '') OVER (PARTITION BY tree, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post
  FROM {table}_{k}),
{table}_{k + 1} AS (
  SELECT tree, pos // 3 AS pos, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h
  FROM {table}_s{k} GROUP BY tree, pos // 3)""")
    return ",\n".join(out)


def _fold(rows: str, table: str, levels: int, tree: str, pos: str) -> str:
    """SQL: proof and folded hash of rows, up the levels of a table."""
    joins = [f"""{rows}_{table}{k + 1} AS (
  SELECT r.* REPLACE (CASE WHEN n = 1 THEN fold ELSE sha256(pre || fold || post) END AS fold, CASE WHEN n = 1 THEN proof ELSE proof || pre || post END AS proof)
  FROM {rows}_{table}{k} r JOIN {table}_s{k} s ON s.tree = {tree} AND s.pos = {pos} // {3**k})""" for k in range(levels)]
    return ",\n".join(joins)


_TREE, _TOP = 12, 5  # levels that the SQL has room for: 531,441 documents a source, 243 sources
_F = {c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in FIELDS}
_LOW = "replace(text, chr(10), '')"
OP13_SQL = f"""
WITH b AS (
  SELECT *, sha256({' || '.join(_F.values())}) AS leaf, sha256({' || '.join([*list(_F.values())[:-1], f"coalesce(strlen({_LOW}) || ':' || {_LOW}, '-')"])}) AS less,
    list_reduce(list_prepend(4294967295::UBIGINT, flatten([[256 + ascii(c), 1, 1, 1, 1, 1, 1, 1, 1] FOR c IN string_split(doc_id::VARCHAR, '')])::UBIGINT[]),
      lambda a, x: CASE WHEN x > 1 THEN xor(a, x - 256) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS crc
  FROM documents),
d AS (
  SELECT *, dense_rank() OVER (ORDER BY source IS NOT NULL, source) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    CASE WHEN xor(crc, 4294967295::UBIGINT) % 2 = 0 THEN less ELSE leaf END AS start
  FROM b),
t_0 AS (SELECT tree, pos, leaf AS h FROM d),
{_climb('t', _TREE)},
u_0 AS (SELECT 0 AS tree, tree AS pos, h FROM t_{_TREE}),
{_climb('u', _TOP)},
r_t0 AS (SELECT doc_id, leaf, tree, pos, start AS fold, '' AS proof FROM d),
{_fold('r', 't', _TREE, 'r.tree', 'r.pos')},
r_u0 AS (SELECT * FROM r_t{_TREE}),
{_fold('r', 'u', _TOP, '0', 'r.tree')}
SELECT doc_id, leaf, t_{_TREE}.h AS subroot, u_{_TOP}.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = u_{_TOP}.h AS verified
FROM r_u{_TOP} r JOIN t_{_TREE} ON t_{_TREE}.tree = r.tree, u_{_TOP}
"""
