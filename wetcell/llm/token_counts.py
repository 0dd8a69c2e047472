"""Token counts: a linear longest-match automaton (operator 3).

Greedy word-piece cuts a word at the longest piece of the vocabulary, then cuts the rest in the same way. The automaton
gives the number of pieces in one walk over the word's bytes and builds none of them. Each trie node has a failure link:
the node that stands for what is left of its string once the longest pieces at its start have been popped, and the number
of pieces popped on the way. A byte that the node has no child for pops along failure links until one has it.

A vocabulary has pieces that start a word and pieces that go on in one. The default is the public byte-level vocabulary:
pieces that begin with a space start a word, the others go on; a word is a run of characters outside [\\x20\\x09-\\x0D]
and is read with a space before it. A word that the vocabulary cannot cut counts as one unknown token.

Nulls, ties and odd input: a null, empty or blank text has no words and no tokens; repeated rows each get their row; an
empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wetcell.llm.bpe import default_path, piece_table, specials

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FORGET = 1 << 20  # distinct words that a task remembers before it starts anew


class Automaton:
    """Pieces that start a word begin with the byte `mark`; the words that count() reads begin with it as well."""

    def __init__(self, pieces: Iterable[bytes]):
        child: dict[int, int] = {}  # node << 8 | byte -> node; 0 is the root
        parent, depth, piece_end = [0], [0], [False]
        for piece in sorted(set(pieces) - {b""}):
            node = 0
            for byte in piece:
                step = child.get(node << 8 | byte)
                if step is None:
                    step = child[node << 8 | byte] = len(parent)
                    parent.append(node)
                    depth.append(depth[node] + 1)
                    piece_end.append(False)
                node = step
            piece_end[node] = True
        fail, popped = [-1] * len(parent), [0] * len(parent)  # -1: nothing can be popped
        by_depth = sorted((depth[node], node, key & 255) for key, node in child.items())
        for _, node, byte in by_depth:
            if piece_end[node]:
                fail[node], popped[node] = 0, 1  # the whole string is one piece
                continue
            z, n = fail[parent[node]], popped[parent[node]]
            while z >= 0 and (z << 8 | byte) not in child:
                n += popped[z]
                z = fail[z]
            if z >= 0:
                fail[node], popped[node] = child[z << 8 | byte], n
        self.child, self.fail, self.popped = child, fail, popped

    def count(self, word: bytes) -> int:
        """The number of pieces; 0 if the word can't be cut."""
        child, fail, popped = self.child, self.fail, self.popped
        node = pieces = 0
        for byte in word:
            step = child.get(node << 8 | byte)
            while step is None:
                pieces += popped[node]
                node = fail[node]
                if node < 0:
                    return 0
                step = child.get(node << 8 | byte)
            node = step
        while node:
            pieces += popped[node]
            node = fail[node]
            if node < 0:
                return 0
        return pieces


@cache
def automaton(path: str) -> Automaton:
    cut = specials(path)
    return Automaton(p for p in piece_table(path) if not (cut and cut.fullmatch(p.decode("latin-1"))))


def counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = automaton(path), {}
        for batch in batches:
            words, tokens, unknown = [], [], []
            for text in batch.column(1):
                found = Counter(WORD.findall(text.as_py() or ""))
                n = missing = 0
                for word, times in found.items():
                    pieces = known.get(word)
                    if pieces is None:
                        pieces = known[word] = machine.count(b" " + word.encode("utf-8", "replace"))
                    n += times * (pieces or 1)
                    missing += times * (not pieces)
                words.append(sum(found.values()))
                tokens.append(n)
                unknown.append(missing)
                if len(known) > FORGET:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return count


def token_counts(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every document, in the scan's own tasks: no shuffle."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(counter(path or default_path()), "doc_id long, n_words long, n_tokens long, n_unknown long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
