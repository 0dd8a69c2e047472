"""Mixing sources to target weights by a low-discrepancy schedule (operator 6).

A source's documents stand in shuffled order (by the md5 of the id) and their words form a stream, which the mix may go
through up to three times. The stream is cut into blocks of `block` words; the last one ends at the source's target.
Slot k of the schedule has the van der Corput point of k: its bits in reverse, a whole number of L bits, so that 2^L slots
meet every point once. The points go through the cumulative numbers of blocks, so that a slot picks a source in
proportion; with 2^L at least twice the blocks, every source has a slot for each of its blocks. A source's slots are
ranked and rank r takes its block r; slots past its last block are left out. Joining blocks and slots gives the mix: which
words of which document stand in which slot. Words are counted as taken where their block has a slot, and a block without
one is an error. Whole numbers alone: nothing is rounded.

All ranks and running sums are two-level: within chunks, plus the running sums of the chunks' totals, so a source with a
third of the rows is spread over many tasks; chunks are ranges of the whole order, the row's own hash last, so that ids
that repeat or are null are spread too. There are a few chunks for each of the session's shuffle partitions, whatever the
rows, and fewer where the rows are few. Only per-source rows are ordered in one task.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating, and share all words; a target stops at three
times its source's words and the excess is shared anew by weight. That is the water level L with
sum(min(3 * size, L * weight)) = all words, found by sorting sources by 3 * size / weight.

Nulls, ties and odd input: a null text has 0 words; the null source is a source of its own, apart from the empty string;
a null doc_id is shuffled like an empty text; rows that tie in the order are equal in id and size, and so are
interchangeable; documents without words take nothing; an empty table gives an empty result; columns other than doc_id,
text and source are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wetcell.llm.common import unused
from wetcell.storage import durable

WEIGHTS = (5, 2, 1)
PASSES = 3
CHUNK = 4096
#: The masks of bits that change places when a word's bits are reversed by halves.
HALVES = ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF))


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """sizes: source, source_size, one row per source. Adds place (code point order, null last), weight and target."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    every = W.partitionBy(F.lit(0))
    level = every.orderBy(F.col("cap") / F.col("weight"), "place")
    below = level.rowsBetween(W.unboundedPreceding, -1)
    rows = sizes.withColumn("place", F.row_number().over(order) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    rows = rows.withColumn("cap", F.col("source_size") * PASSES)
    rows = rows.withColumns({
        "left": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(below), F.lit(0)),
        "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)),
    })
    # while a source's cap is under its share of what the caps before it leave, it stops there; the first that isn't sets the level
    rows = rows.withColumn("fits", F.col("cap") * F.col("open") >= F.col("left") * F.col("weight"))
    rows = rows.withColumn("water", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "place", "left", "open"))).over(every))
    share = F.col("water.left") * F.col("weight") / F.col("water.open")
    capped = F.struct(F.col("cap") / F.col("weight"), F.col("place")) < F.struct(F.col("water").getField("col1"), F.col("water.place"))
    return rows.select("source", "source_size", "place", "weight", F.when(F.col("water").isNull() | capped, F.col("cap").cast("double")).otherwise(share).alias("target"))


def ordered(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_hash, size and start: where the document begins in its source's shuffled stream of words."""
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), size_of(F.col("text")).alias("size"))
    rows = rows.withColumn("mark", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    rows = durable(rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id())))
    order = ["mark", "doc_id", "text_hash", "tie"]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    ranges = rows.repartitionByRange(max(1, min(4 * parts, -(-rows.count() // CHUNK))), "source", *order)
    rows = durable(ranges.withColumn("chunk", F.spark_partition_id()))
    chunks = rows.groupBy("source", "chunk").agg(F.sum("size").alias("total"))
    before = W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.select("source", "chunk", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("source", "chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = rows.alias("a").join(chunks.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.chunk") == F.col("b.chunk")))
    return joined.select("a.doc_id", "a.source", "a.text_hash", "a.size", (F.col("start") + F.col("offset")).alias("start"))


def reversed_bits(x: Column, bits: int) -> Column:
    """The lowest bits of x in reverse order."""
    for step, mask in HALVES:
        low = F.lit(mask)
        x = F.shiftleft(x.bitwiseAND(low), step).bitwiseOR(F.shiftrightunsigned(x, step).bitwiseAND(low))
    return F.shiftrightunsigned(x, 64 - bits)


def schedule(plan: DataFrame, block: int) -> DataFrame:
    """plan: place, taken. slot, place, rank for every block of every source, by van der Corput points."""
    spark = plan.sparkSession
    quotas = plan.select("place", F.ceil(F.col("taken") / block).alias("quota")).filter("quota > 0")
    upto = W.partitionBy(F.lit(0)).orderBy("place")
    spans = quotas.withColumn("high", F.sum("quota").over(upto)).withColumn("low", F.col("high") - F.col("quota"))
    blocks = spans.agg(F.max("high")).first()[0] or 0
    bits = max(1, blocks).bit_length() + 1  # 2 ** bits slots are twice the blocks and more
    # a source's share of the points, exact; a range join by bands of points
    width = 2**bits
    point = lambda n: F.expr(f"(cast({n} as decimal(20, 0)) * cast({width} as decimal(18, 0))) div {max(1, blocks)}")
    band = max(1, width // max(1, blocks)) * CHUNK
    spans = spans.withColumns({"low": point("low"), "high": point("high")})
    spans = spans.withColumn("band", F.explode(F.sequence(F.expr(f"low div {band}"), F.expr(f"(high - 1) div {band}"))))
    slots = spark.range(width if blocks else 0).withColumnRenamed("id", "slot").withColumn("at", reversed_bits(F.col("slot"), bits))
    slots = slots.withColumn("band", F.expr(f"at div {band}"))
    picks = slots.join(spans, "band").filter((F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
    picks = picks.select("slot", "place", "quota", F.expr(f"slot div {CHUNK}").alias("chunk"))
    counts = picks.groupBy("place", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("place").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("place", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(W.partitionBy("place", "chunk").orderBy("slot")) - 1 + F.col("offset")
    return picks.join(counts, ["place", "chunk"]).withColumn("rank", rank).filter(F.col("rank") < F.col("quota")).select("slot", "place", "rank")


def blocks_of(rows: DataFrame, plan: DataFrame, block: int) -> DataFrame:
    """rows: place, start, size. place, rank, start, pass, first, words: the parts of documents in each block that is taken."""
    rows = rows.filter("size > 0").join(plan.select("place", "source_size", "taken"), "place")
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1))))
    rows = rows.withColumn("from", F.col("pass") * F.col("source_size") + F.col("start"))
    rows = rows.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("taken"))).filter("to > from")
    rows = rows.withColumn("rank", F.explode(F.sequence(F.expr(f"from div {block}"), F.expr(f"(to - 1) div {block}"))))
    low, high = F.greatest("from", F.col("rank") * block), F.least("to", (F.col("rank") + 1) * block)
    return rows.select("place", "rank", "start", "pass", (low - F.col("from")).alias("first"), (high - low).alias("words"))


def mixed(docs: DataFrame, *, block: int = 8192) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents in order with place and source columns; per-source plan; the mix: slot, place, start, pass, first, words."""
    rows = durable(ordered(docs))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes)
    plan = durable(plan.withColumn("taken", F.least(F.round("target").cast("long"), F.col("source_size") * PASSES)))
    rows = rows.alias("a").join(plan.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    rows = rows.select("doc_id", "a.source", "text_hash", "size", "start", "place", "source_size", "target")
    parts = blocks_of(rows.select("place", "start", "size"), plan, block)
    mix = parts.join(schedule(plan, block), ["place", "rank"], "left")
    mix = mix.withColumn("slot", F.coalesce("slot", F.raise_error(F.lit("mixing: a block has no slot")).cast("long")))
    mix = mix.select("slot", "place", "start", "pass", "first", "words")
    return rows, plan, mix


def taken(docs: DataFrame, *, block: int = 8192) -> DataFrame:
    """doc_id, size, source_size, target, taken (the words of the document that the mix takes, repeats counted), first_slot
    (the first slot with words of it, null without any) and n_blocks (its parts: blocks it has words in, by passes)."""
    rows, _, mix = mixed(docs, block=block)
    words = mix.groupBy("place", "start").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count("slot").alias("n_blocks"))
    found = rows.join(words, ["place", "start"], "left")
    has = F.col("size") > 0  # a document without words starts where another one does
    count = lambda c: F.when(has, F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c)
    return found.select("doc_id", "size", "source_size", "target", count("taken"), F.when(has, F.col("first_slot")).alias("first_slot"), count("n_blocks"))


def mixed_documents(docs: DataFrame, *, block: int = 8192) -> DataFrame:
    """The documents as the mix takes them, all columns as they were: a row for every pass that takes words of one, in the
    order of the slots of their first words.

    At a source's target a document may be taken in part: its row has the text up to the end of the last word taken, as it
    was, and n_chars, where there is such a column, is its length. Rows repeated with the same doc_id, source and text
    have the other columns of one of them. Documents without words are left out.
    """
    rows, _, mix = mixed(docs, block=block)
    parts = mix.groupBy("place", "start", "pass").agg(F.sum("words").alias("words"), F.min(F.struct("slot", "first")).alias("at"))
    takes = rows.filter("size > 0").join(parts, ["place", "start"])
    id_, source, text_hash, part, n = (unused(docs, x) for x in ("id_", "source_", "hash_", "part_", "copy_"))
    key = {id_: F.coalesce("doc_id", F.lit(-(2**63))), source: F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))}
    takes = takes.select(*(c.alias(f"k_{k}") for k, c in enumerate([*key.values(), F.col("text_hash")])), F.struct("pass", "words", "size", "at", "start").alias("take"))
    takes = takes.groupBy("k_0", "k_1", "k_2").agg(F.collect_list("take").alias("takes"))  # PASSES for each repeated row
    marked = docs.withColumns({**key, text_hash: F.xxhash64("text")})
    found = marked.join(takes, (marked[id_] == takes["k_0"]) & (marked[source] == takes["k_1"]) & (marked[text_hash] == takes["k_2"]))
    copy = F.row_number().over(W.partitionBy(id_, source, text_hash).orderBy(F.lit(0)))
    found = found.withColumn(n, copy).filter(F.col(n) == 1).withColumn(part, F.explode("takes"))
    found = found.orderBy(F.col(part)["at"]["slot"], F.col(part)["at"]["first"], F.col(part)["start"], F.col(part)["pass"])
    taken_, space = F.col(part)["words"], r"[\x20\x09-\x0D]+"
    cut = taken_ < F.col(part)["size"]
    # split after so many gaps, one more if the text begins with one: the last part is what comes after the words
    pieces = F.split("text", F.lit(space), (taken_ + 1 + F.when(F.col("text").rlike("^" + space), 1).otherwise(0)).cast("int"))
    head = F.regexp_replace(F.left("text", F.length("text") - F.length(F.element_at(pieces, -1))), space + "$", "")
    found = found.withColumn("text", F.when(cut, head).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Targets by the same water level; a document's words lie in the stream [start, start + size) of each pass; slots by points.
OP6_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
o AS (
  SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start,
    (sum(size) OVER (PARTITION BY source))::BIGINT AS source_size FROM d),
s AS (
  SELECT source, source_size, 3 * source_size AS cap, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place, [5, 2, 1][place % 3 + 1] AS weight
  FROM (SELECT DISTINCT source, source_size FROM o)),
a AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) AS rest, (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS open
  FROM s WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(rest / open, cap / weight) FILTER (cap * open >= rest * weight) AS level FROM a),
t AS (SELECT source, source_size, place, least(cap::DOUBLE, level * weight) AS target FROM s, l),
u AS (SELECT *, least(round(target)::BIGINT, 3 * source_size) AS take FROM t),
q AS (
  SELECT place, (take + 8191) // 8192 AS quota, (sum(quota) OVER (ORDER BY place))::BIGINT AS high, (sum(quota) OVER ())::BIGINT AS blocks
  FROM u),
w AS (SELECT max(blocks) AS blocks, len(bin(greatest(1, max(blocks)))) + 1 AS bits FROM q),
k AS (
  SELECT slot, list_sum([((slot >> i) & 1) << (bits - 1 - i) FOR i IN range(bits)])::HUGEINT AS point, bits
  FROM (SELECT unnest(range(CASE WHEN blocks > 0 THEN 1 << bits ELSE 0 END)) AS slot, bits FROM w)),
p AS (
  SELECT slot, place, quota, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS rank
  FROM k JOIN q ON point >= ((high - quota)::HUGEINT << bits) // blocks AND point < (high::HUGEINT << bits) // blocks),
m AS (
  SELECT place, start, pass, unnest(range(low // 8192, (least(low + size, take) - 1) // 8192 + 1)) AS rank, low, least(low + size, take) AS top
  FROM (SELECT o.*, place, take, pass, pass * o.source_size + start AS low FROM o JOIN u ON o.source IS NOT DISTINCT FROM u.source, range(3) AS x(pass))
  WHERE size > 0 AND low < take),
b AS (
  SELECT m.place, start, sum(least(top, (m.rank + 1) * 8192) - greatest(low, m.rank * 8192))::BIGINT AS taken, min(slot) AS first_slot, count(*) AS n_blocks
  FROM m JOIN p ON p.place = m.place AND p.rank = m.rank WHERE p.rank < quota GROUP BY m.place, start)
SELECT doc_id, size, o.source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot, coalesce(n_blocks, 0) AS n_blocks
FROM o JOIN u ON o.source IS NOT DISTINCT FROM u.source LEFT JOIN b ON size > 0 AND b.place = u.place AND b.start = o.start
"""
