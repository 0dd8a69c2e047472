"""Token ids as binary files with Elias-Fano boundaries (operator 11).

A dataset is a folder with two Parquet tables, written and read by Spark wherever Spark can write:

- `segments`: a row is up to segment_ids ids in a row (more where a document alone is longer). `ids` holds them as
  little-endian unsigned integers of `width` bytes, two where the vocabulary allows it. The documents' ends in it are kept by
  Elias and Fano's code: `low` has the lowest `low_bits` bits of each end, `high` the others in unary, so that an end takes
  about 2 + low_bits bits; `samples` has the place of every SAMPLE-th one bit, from which select() finds an end without
  the ends before it. `at` is the number of ids before it in its part, `doc_ids` whose the documents are.
- `parts`: the number of ids before each part. A document's start is parts.before + segments.at + the end before its own:
  no table has a 64-bit number for each document's offset.

Writing: texts are dealt by ranges of doc_id and sorted, each range (part) is written by one task in that order. A task
splits texts into words, encodes each distinct word once and puts the ids together by word number; a block has block_chars
characters and a Python worker remembers MOST_WORDS words, so memory doesn't grow with the part. Every document ends in end_id.

Nulls, ties and odd input: a null text counts as empty and has the end id alone; null ids come first, rows with the same
id are in order of the text's hash, rows that tie in both have the same text; a special token's string in a text is that
token, as in the tokenizers library; an empty table gives an empty dataset; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wetcell.llm.bpe import default_path, gathered, tokenizer, words_of
from wetcell.llm.common import small_batches
from wetcell.storage import PREFIX, shared_folder

SAMPLE = 64
MOST_WORDS = 1 << 19
SEGMENT = pa.schema([
    ("part", pa.int32()), ("k", pa.int32()), ("at", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
    ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.list_(pa.int32())), ("width", pa.int32()), ("ids", pa.binary()),
])
SEGMENTS = "part int, k int, at long, n_docs int, n_ids int, doc_ids array<long>, low_bits int, low binary, high binary, samples array<int>, width int, ids binary"


class Ends(NamedTuple):
    """Whole numbers that don't fall, in Elias and Fano's code."""

    n: int
    low_bits: int
    low: bytes
    high: bytes
    samples: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> Ends:
        n = len(values)
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low_bits)) & 1
        ones = (values >> low_bits) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        pack = lambda x: np.packbits(x.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return cls(n, low_bits, pack(bits), pack(unary), ones[::SAMPLE].astype(np.int32))

    def select(self, i: int) -> int:
        """The i-th number, from the sample before it."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        bits = self.high[byte] >> (at & 7) << (at & 7)
        while (there := bits.bit_count()) <= left:
            left, byte = left - there, byte + 1
            bits = self.high[byte]
        for _ in range(left):
            bits &= bits - 1  # clears the lowest one
        one = 8 * byte + (bits & -bits).bit_length() - 1
        first = i * self.low_bits
        low = int.from_bytes(self.low[first >> 3 : ((first + self.low_bits - 1) >> 3) + 1], "little") >> (first & 7) if self.low_bits else 0
        return (one - i) << self.low_bits | low & ((1 << self.low_bits) - 1)

    def values(self) -> np.ndarray:
        """All numbers."""
        unpack = lambda x: np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")
        high = np.flatnonzero(unpack(self.high))[: self.n] - np.arange(self.n)
        low = unpack(self.low)[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return high << self.low_bits | low @ (1 << np.arange(self.low_bits, dtype=np.int64))


class Numbers(dict):
    """Words by order of their first lookup."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Words:
    """The ids of words, each encoded once while it is known; number 0 stands for a text's end. All are forgotten after
    MOST_WORDS, so that memory is bounded; nothing depends on what is known."""

    def __init__(self, path: str, end_id: int):
        self.path, self.end_id = path, end_id
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbers({None: 0})
        self.sizes, self.starts, self.flat = np.ones(1, np.int32), np.zeros(1, np.int32), np.array([self.end_id], np.int32)

    def number(self, text: str) -> np.ndarray:
        """The numbers of a text's words and its end."""
        found = words_of(text, self.path)
        out = np.zeros(len(found) + 1, np.int32)
        out[:-1] = np.fromiter(map(self.numbers.__getitem__, found), np.int32, len(found))
        return out

    def ids(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of numbered texts in a row, and where each text's end."""
        new = list(islice(self.numbers, len(self.sizes), None))
        known = [x.ids for x in tokenizer(self.path).encode_batch(new, add_special_tokens=False)]
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, known), np.int32, len(known))])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(known), np.int32)])
        self.starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        order = np.concatenate(texts)
        lengths = self.sizes[order].astype(np.int64)
        ends = np.cumsum(lengths)[np.cumsum([len(x) for x in texts]) - 1]
        out = gathered(self.flat, self.starts[order], lengths)
        if len(self.numbers) > MOST_WORDS:
            self.forget()
        return out, ends


@cache
def words_known(path: str, end_id: int) -> Words:
    """One for all tasks of a Python worker."""
    return Words(path, end_id)


def segmenting(path: str, end_id: int, block_chars: int, segment_ids: int):
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, before = TaskContext.get().partitionId(), 0, 0
        width = 2 if max(end_id, tokenizer(path).get_vocab_size() - 1) < 1 << 16 else 4
        doc_ids, texts, chars, words = [], [], 0, words_known(path, end_id)

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal k, before
            ids, ends = words.ids(texts)
            first = 0
            while first < len(ends):
                begin = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, begin + segment_ids, "right")))
                own = Ends.of(ends[first:last] - begin)
                n = int(ends[last - 1]) - begin
                row = [part, k, before, last - first, n, doc_ids[first:last], own.low_bits, own.low, own.high, own.samples, width, ids[begin : begin + n].astype(f"<u{width}").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, SEGMENT, strict=True)], schema=SEGMENT)
                k, before, first = k + 1, before + n, last
            doc_ids.clear(), texts.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                texts.append(words.number(text))
                doc_ids.append(doc_id.as_py())
                chars += len(text)
                if chars >= block_chars:
                    yield from block()
                    chars = 0
        if texts:
            yield from block()

    return segments


def write(docs: DataFrame, folder: str, *, path: str | None = None, end_id: int = 0, block_chars: int = 1 << 24, segment_ids: int = 1 << 18) -> None:
    """The dataset of the documents, in ascending doc_id order."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("hash"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    made = dealt.mapInArrow(segmenting(path or default_path(), end_id, block_chars, segment_ids), SEGMENTS)
    made.write.option("compression", "uncompressed").parquet(f"{folder}/segments")
    sizes = spark.read.parquet(f"{folder}/segments").groupBy("part").agg(F.sum(F.col("n_ids").cast("long")).alias("n_ids"))
    before = F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # a row for each part
    sizes.select("part", F.coalesce(before, F.lit(0)).alias("before")).coalesce(1).write.parquet(f"{folder}/parts")


def ends_in(row: dict) -> Ends:
    return Ends(row["n_docs"], row["low_bits"], row["low"], row["high"], np.array(row["samples"], np.int32))


def reading(with_ids: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a row is a segment
                row = {c: batch[c][i].as_py() for c in batch.schema.names if c != "ids"}
                ends = ends_in(row).values()
                starts = np.concatenate(([0], ends[:-1]))
                out = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["before"] + row["at"] + starts), pa.array(ends - starts)]
                if with_ids:
                    ids = np.frombuffer(batch["ids"][i].as_buffer(), f"<u{row['width']}").astype("<u4")
                    offsets = pa.array(np.concatenate(([0], 4 * ends)), pa.int32())
                    out.append(pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, offsets.buffers()[1], pa.py_buffer(ids.tobytes())]))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids"][: len(out)])

    return read


def located(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """Segments with the ids before their part; a dataset has as many parts as it had tasks, so the join is a broadcast."""
    segments = spark.read.schema(SEGMENTS).parquet(f"{folder}/segments")
    parts = spark.read.schema("part int, before long").parquet(f"{folder}/parts")
    return segments.join(F.broadcast(parts), "part").select("before", "at", "n_docs", "doc_ids", "low_bits", "low", "high", "samples", *more)


def boundaries(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens of every document; ids are not read."""
    return located(spark, folder).mapInArrow(reading(False), "doc_id long, start long, n_tokens long")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit integers) of every document."""
    small_batches(spark)
    return located(spark, folder, "width", "ids").mapInArrow(reading(True), "doc_id long, start long, n_tokens long, ids binary")


def selecting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch[c][i].as_py() for c in batch.schema.names if c != "ids"}
            ends, ids = ends_in(row), np.frombuffer(batch["ids"][i].as_buffer(), f"<u{row['width']}")
            spans = [(ends.select(p - 1) if p else 0, ends.select(p)) for p in row["places"]]
            found = pa.array([ids[a:b].astype(np.int32) for a, b in spans], pa.list_(pa.int32()))
            starts = pa.array([row["before"] + row["at"] + a for a, _ in spans], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([row["doc_ids"][p] for p in row["places"]], pa.int64()), starts, found], names=["doc_id", "start", "ids"])


def lookup(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """doc_id, start and ids (array<int>) of the documents whose doc_id is in wanted, by select() in their segments."""
    segments = spark.read.schema(SEGMENTS).parquet(f"{folder}/segments")
    places = segments.select("part", "k", F.posexplode("doc_ids").alias("place", "doc_id")).join(wanted.select("doc_id").distinct(), "doc_id")
    places = places.groupBy("part", "k").agg(F.collect_list("place").alias("places"))  # a segment's documents at most
    parts = spark.read.schema("part int, before long").parquet(f"{folder}/parts")
    rows = segments.join(places, ["part", "k"]).join(F.broadcast(parts), "part")
    return rows.drop("part", "k", "n_ids").mapInArrow(selecting, "doc_id long, start long, ids array<int>")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/{PREFIX}tokens-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    found = documents(spark, folder)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
