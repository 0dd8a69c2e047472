"""BPE encoding and decoding through a table of distinct words (operator 8).

Byte-level BPE never merges across the words of its split pattern, so a text's ids are its words' ids in a row.

1. split: each task cuts its texts into words and numbers a block's distinct words. A block (the texts of a task, up to
   block_chars characters) yields its documents as word numbers, packed, and a row (word, block, number) for each of its
   distinct words.
2. encode: the rows of all blocks are dealt by word and sorted, so that a distinct word is a run of rows, encoded once;
   nothing is remembered but the last word.
3. join back: the words' ids return to their block, where documents take them by word number, in order of position.
4. decode: the distinct ids of a document, a row each, are joined to the vocabulary's table of pieces by id, and its pieces
   are put together in order of position. The table's size is checked: below piece_bytes it is broadcast, so that a
   document's rows stay together without a sort; a larger one is joined by a shuffle and the rows are sorted back.

One exchange carries the documents and the words; the words' branch and the documents' branch both read it. A hot word
is in each block once at most, and a block is bounded, so no key is larger than others. The number of parts grows with
the splits of the input.

Nulls, ties and odd input: a null text counts as empty and has no ids; null and repeated doc_ids keep a row each; the
special token's string in a text is that token, as in the tokenizers library; ids outside the vocabulary decode to
nothing; a null list of ids decodes as an empty one; an empty table gives an empty result; columns other than doc_id and
text (in decoding doc_id and ids) are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wetcell.llm.common import from_files, small_batches
from wetcell.storage import durable

DOCS_IN_ROW = 256
WORDS_IN_BATCH = 1 << 15
BATCH_BYTES = 1 << 21
_LETTER, _NUMBER, _SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ˁ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
#: The vocabulary's split pattern for texts whose characters are all below U+02C2; the library splits the others.
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_BEYOND = re.compile("[^\x00-ˁ]")
MOVED = "key string, block long, at int, body binary"
_MOVED = pa.schema([("key", pa.string()), ("block", pa.int64()), ("at", pa.int32()), ("body", pa.binary())])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's other cores have tasks of their own
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@cache
def specials(path: str) -> re.Pattern | None:
    tokens = sorted((t.content for t in tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, tokens)) + ")") if tokens else None


def words_of(text: str, path: str) -> list[str]:
    """The words of a text; joined they are the text. A special token's string is a word."""
    cut = specials(path)
    if cut is not None and (parts := cut.split(text))[1:]:
        return [w for i, x in enumerate(parts) for w in ([x] if i % 2 else words_of(x, path))]
    if _BEYOND.search(text):
        return [text[a:b] for _, (a, b) in tokenizer(path).pre_tokenizer.pre_tokenize_str(text)]
    return _WORDS.findall(text)


def packed(**columns: pa.Array) -> bytes:
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(body: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(body).read_next_batch()


def splitter(path: str, block_chars: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, chars, numbers = TaskContext.get().partitionId() << 24, 0, {}
        ids, texts = [], []

        def documents() -> pa.RecordBatch:
            planes = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes() for x in texts]  # bytes of one rank together pack well
            body = packed(doc_id=pa.array(ids, pa.int64()), words=pa.array(planes, pa.large_binary()))
            ids.clear(), texts.clear()
            return pa.RecordBatch.from_arrays([pa.array([str(block)]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([body], pa.binary())], schema=_MOVED)

        def words() -> Iterator[pa.RecordBatch]:
            own = list(numbers)
            for low in range(0, len(own), WORDS_IN_BATCH):
                part = pa.array(own[low : low + WORDS_IN_BATCH], pa.string())
                at = pa.array(np.arange(low, low + len(part), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part, pa.array(np.full(len(part), block)), at, pa.nulls(len(part), pa.binary())], schema=_MOVED)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                found = words_of(text, path)
                texts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int32, len(found)))
                ids.append(doc_id.as_py())
                chars += len(text)
                if len(ids) >= DOCS_IN_ROW or chars >= block_chars:
                    yield documents()
                if chars >= block_chars:
                    yield from words()
                    block, chars, numbers = block + 1, 0, {}
        if ids:
            yield documents()
        yield from words()

    return split


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of WORDS_IN_BATCH rows and more, the last one excepted."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= WORDS_IN_BATCH:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def word_encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """key (word, sorted), block, at. A row for the batch's words of a block: their numbers, how many ids each has, the ids."""
        last, last_ids = None, None
        for batch in merged(batches):
            runs = pc.run_end_encode(batch.column(0))  # a run is a distinct word
            words = runs.values.to_pylist()
            ids = [x.ids for x in tokenizer(path).encode_batch(words[words[0] == last :], add_special_tokens=False)]
            if words[0] == last:  # the batch before ended in this word
                ids.insert(0, last_ids)
            last, last_ids = words[-1], ids[-1]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            times = np.diff(runs.run_ends.to_numpy(), prepend=0)
            starts = np.repeat(np.cumsum(sizes) - sizes, times)
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
            sizes, blocks = np.repeat(sizes, times), batch.column(1).to_numpy()
            order = np.argsort(blocks, kind="stable")
            first = np.flatnonzero(np.diff(blocks[order], prepend=blocks[order[0]] - 1))
            flat, sizes = gathered(flat, starts[order], sizes[order]), sizes[order]
            cuts = np.append(first, len(order))
            ends = np.concatenate(([0], np.cumsum(sizes)))
            cut_lists = lambda values, at: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))
            columns = [cut_lists(batch.column(2).to_numpy()[order], cuts), cut_lists(sizes, cuts), cut_lists(flat, ends[cuts])]
            yield pa.RecordBatch.from_arrays([pa.array(blocks[order[first]]).cast(pa.string()), *columns], names=["key", "at", "n", "ids"])

    return encode


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of flat at starts, of these lengths, in a row."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def join_back(documents: pa.Table, words: pa.Table) -> pa.Table:
    """doc_id, ids and their digest of a block's documents, whose words are numbers into the block's words."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_sha256", pa.string())])
    at, counts, flat = (words[x].combine_chunks().flatten().to_numpy() for x in ("at", "n", "ids"))
    starts, lengths = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    starts[at], lengths[at] = np.cumsum(counts, dtype=np.int64) - counts, counts
    out = []
    for body in documents["body"]:
        rows = unpacked(body.as_py())
        planes = [np.frombuffer(x.as_buffer(), np.uint8).reshape(4, -1) for x in rows["words"]]
        numbers = np.concatenate([np.ascontiguousarray(x.T).view(np.int32).ravel() for x in planes])
        offsets = np.concatenate(([0], np.cumsum([x.shape[1] for x in planes])))
        size = np.concatenate(([0], np.cumsum(lengths[numbers])))[offsets]
        ids = gathered(flat, starts[numbers], lengths[numbers])
        digests = pa.array([hashlib.sha256(ids[a:b].astype("<u4").tobytes()).hexdigest() for a, b in zip(size, size[1:], strict=False)], pa.string())
        lists = pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(ids))
        out.append(pa.RecordBatch.from_arrays([rows["doc_id"], lists, digests], schema=schema))
    return pa.Table.from_batches(out, schema=schema)


def encode(docs: DataFrame, *, path: str | None = None, block_chars: int = 1 << 25) -> DataFrame:
    """doc_id, ids (array<int>) and ids_sha256 (of the ids as little-endian unsigned 32-bit integers) of every document.
    Word numbers depend on the order of a task's rows, so docs that do not come straight from files, where a task that
    runs again reads the same rows in the same order, are written first."""
    path = path or default_path()
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    rows = rows if from_files(rows) else durable(rows)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    moved = rows.mapInArrow(splitter(path, block_chars), MOVED).repartition(parts, "key")
    # one exchange for both branches: what depends on the row's number stays above it, so neither is pruned or filtered below
    moved = moved.select("key", F.when(F.monotonically_increasing_id() >= 0, F.struct("block", "at", "body")).alias("row"))
    words = moved.filter("row.at IS NOT NULL").select("key", "row.block", "row.at").sortWithinPartitions("key")
    encoded = words.mapInArrow(word_encoder(path), "key string, at array<int>, n array<int>, ids array<int>")
    documents = moved.filter("row.body IS NOT NULL").select("key", "row.body")
    return documents.groupBy("key").cogroup(encoded.repartition(parts, "key").groupBy("key")).applyInArrow(join_back, "doc_id long, ids array<int>, ids_sha256 string")


def piece_table(path: str) -> list[bytes]:
    """The bytes of each id's piece. Byte-level vocabularies write a byte as a character: itself where it is printable,
    the others as U+0100 and on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    found = tokenizer(path)
    tokens = {i: t for t, i in found.get_vocab(with_added_tokens=True).items()}
    piece = lambda t: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
    return [piece(tokens[i]) if i in tokens else b"" for i in range(max(tokens) + 1)]


def in_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """head (the document's columns, null but in its first row), id, piece -> the document's columns and text."""

    def documents(rows: pa.RecordBatch) -> pa.RecordBatch:
        first = np.flatnonzero(rows["head"].is_valid().to_numpy(zero_copy_only=False))
        heads = rows["head"].take(pa.array(first))
        pieces, known = pc.fill_null(rows["piece"], b""), pc.fill_null(rows["id"], -1).to_numpy()
        ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset :][: len(pieces) + 1].astype(np.int64)
        flat, starts, lengths = np.frombuffer(pieces.buffers()[2] or b"", np.uint8), ends[:-1], np.diff(ends)
        texts = []
        for low, high, ids in zip(first, [*first[1:], len(known)], heads.field("ids"), strict=True):
            own = pc.fill_null(ids.values, -1).to_numpy()
            order = low + np.argsort(known[low:high])
            at = order[np.minimum(np.searchsorted(known[order], own), high - low - 1)]
            if not np.array_equal(known[at], own):
                raise RuntimeError("a document is apart from the pieces of its ids")
            texts.append(gathered(flat, starts[at], lengths[at]).tobytes().decode("utf-8", "replace"))
        return pa.RecordBatch.from_arrays([*heads.flatten(), pa.array(texts, pa.string())], names=[*(x.name for x in heads.type), "text"])

    held, size = [], 0
    for batch in batches:
        starts = np.flatnonzero(batch["head"].is_valid().to_numpy(zero_copy_only=False)) if size >= BATCH_BYTES else ()
        if len(starts):
            yield documents(pa.concat_batches([*held, batch.slice(0, starts[-1])]))
            batch, held, size = batch.slice(starts[-1]), [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield documents(pa.concat_batches(held))


def decoded(encoded: DataFrame, *, path: str | None = None, piece_bytes: int = 1 << 26) -> DataFrame:
    """encoded with a column text (in place of one it may have): ids joined to their pieces, the pieces joined in order, as UTF-8."""
    found = piece_table(path or default_path())
    columns = {"id": pa.array(np.arange(len(found), dtype=np.int32)), "piece": pa.array(found, pa.binary())}
    table = encoded.sparkSession.createDataFrame(pa.table(columns))
    rows = encoded.drop("text").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    schema = T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())])
    small = sum(map(len, found)) + 16 * len(found) <= piece_bytes
    rows = (rows if small else durable(rows)).select(F.struct("*").alias("head"), "ids", F.monotonically_increasing_id().alias("row"))
    rows = rows.select("row", "head", F.posexplode_outer(F.array_distinct("ids")).alias("pos", "id"))
    rows = rows.select("row", "pos", "id", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("head")).alias("head"))
    if small:
        joined = rows.join(F.broadcast(table), "id", "left")
    else:
        joined = rows.join(table.hint("shuffle_hash"), "id", "left").repartition("row").sortWithinPartitions("row", "pos")
    return joined.select("head", "id", "piece").mapInArrow(in_documents, schema)


def op8_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = decoded(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("text", 256).alias("decoded_sha256")
    )
