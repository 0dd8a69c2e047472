"""Secret scans: base patterns and character Markov models (operator 2).

A token is a run of characters of ALPHABET. A first pass over the texts counts character transitions of two labelled
samples: the values of base spans (assign, access, hex) are random strings, the tokens outside base spans are ordinary
identifiers. Spark sums the counts of all rows into two first-order Markov chains; their size is fixed. A second pass finds
the base spans and every token, of any length, that no base span touches: it becomes a markov span when the log-likelihood
ratio of the two chains, each transition of the token counted once, reaches `odds` and 1 a transition. `odds` is the
logarithm of how many ordinary tokens there are for a secret.

Nulls, ties and odd input: a null text counts as empty and has no spans; spans that start together are ordered by kind as
in KINDS; markov spans never overlap a base span; repeated rows each get their row; without any base value in the corpus
there is nothing to learn "secret" from, so the chain is uniform; an empty table gives an empty result; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wetcell.llm.common import small_batches

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs: shorter ones fail anyway
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_SIZE = len(ALPHABET) + 1  # state 0 is any other character: the ends of a token
_STATE = np.zeros(128, np.int16)
_STATE[list(ALPHABET.encode())] = np.arange(1, _SIZE)
ODDS = 20.0  # a secret in some hundred million tokens
UNSEEN = 0.05  # the share of characters that the samples say nothing about, alike in both


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value), sorted; leftmost non-overlapping per kind, matches that are too short dropped."""
    lower = text.lower()
    found = []
    if any(k in lower for k in _KEYS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def states_of(text: str) -> np.ndarray:
    """The state of each character; 127 is in no token and stands for all beyond it."""
    return _STATE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 127)]


def transitions(states: np.ndarray) -> np.ndarray:
    """Counts of the state pairs, with an end before and after."""
    ends = np.zeros(1, np.int16)
    states = np.concatenate((ends, states, ends))
    return np.bincount(states[:-1] * np.int16(_SIZE) + states[1:], minlength=_SIZE * _SIZE)


def samples_of(text: str) -> np.ndarray:
    """Transition counts of a text's ordinary tokens and of its secret values."""
    spans, states = base_spans(text), states_of(text).copy()
    for start, _, end, _ in spans:
        states[start:end] = 0
    secret = transitions(states_of("\n".join(x[3] for x in spans))) if spans else np.zeros(_SIZE * _SIZE, np.int64)
    return np.stack((transitions(states), secret))


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """log P(secret) - log P(ordinary) of each transition, from the samples' counts; 0 at the ends of tokens."""
    counts = counts.astype(float).reshape(2, _SIZE, _SIZE)
    counts[:, :, 0] = counts[:, 0, :] = 0
    single = counts.sum(axis=1, keepdims=True)  # a state seldom seen backs off to the single characters
    single = (1 - UNSEEN) * single / np.maximum(single.sum(axis=2, keepdims=True), 1) + UNSEEN / (_SIZE - 1)
    # a transition counts once less than it was seen, so that an unlabelled secret does not make its own ones ordinary
    n, kinds = counts.sum(axis=2, keepdims=True), (counts > 0).sum(axis=2, keepdims=True)
    chains = (np.maximum(counts - 1, 0) + (kinds + 1) * single) / (n + 1)
    out = np.zeros((_SIZE, _SIZE))
    out[1:, 1:] = np.log(chains[1, 1:, 1:]) - np.log(chains[0, 1:, 1:])
    return out.ravel()


def random_spans(text: str, spans: list, ratios: np.ndarray, odds: float) -> list[tuple[int, int]]:
    """(start, end) of the tokens outside base spans that the chains take for random strings."""
    states = states_of(text)
    inside = np.concatenate(([False], states > 0, [False]))
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    if not len(starts):
        return []
    pairs = states[:-1] * np.int16(_SIZE) + states[1:]
    upto = np.concatenate(([0.0], np.cumsum(np.maximum(ratios, 0)[pairs])))
    likely = upto[ends - 1] - upto[starts] >= odds - 1e-6  # no token's ratio is more than what speaks for it
    for start, _, end, _ in spans:  # tokens are in order: those that a span touches are a range
        likely[np.searchsorted(ends, start, "right") : np.searchsorted(starts, end, "left")] = False
    out = []
    for i in np.flatnonzero(likely):
        own = np.unique(pairs[starts[i] : ends[i] - 1])  # each transition once: a repeated character is no evidence
        if ratios[own].sum() >= max(odds, len(own)):
            out.append((int(starts[i]), int(ends[i])))
    return out


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for the task: the counts of its samples."""
    total = np.zeros((2, _SIZE * _SIZE), np.int64)
    for batch in batches:
        for text in batch.column(0):
            total += samples_of(text.as_py() or "")
    yield pa.RecordBatch.from_arrays([pa.array([x.tolist()]) for x in total], names=["ordinary", "secret"])


def trained(docs: DataFrame) -> np.ndarray:
    """log_ratios() of all documents; a table of fixed size comes to the driver."""
    rows = docs.select("text").mapInArrow(counted, "ordinary array<long>, secret array<long>")
    rows = rows.select(F.posexplode(F.arrays_zip("ordinary", "secret")).alias("pair", "n"))
    counts = np.zeros((2, _SIZE * _SIZE), np.int64)
    for r in rows.groupBy("pair").agg(F.sum("n.ordinary").alias("a"), F.sum("n.secret").alias("b")).collect():
        counts[:, r["pair"]] = r["a"], r["b"]
    return log_ratios(counts)


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


def scanner(ratios: np.ndarray, odds: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                spans = base_spans(text)
                more = [(s, 3, e) for s, e in random_spans(text, spans, ratios, odds)]
                base.append([{"start": s, "kind": k, "end": e} for s, k, e, _ in spans])
                every.append([{"start": s, "kind": k, "end": e} for s, k, e in sorted([x[:3] for x in spans] + more)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, _SPAN), pa.array(every, _SPAN)], names=["doc_id", "base", "spans"])

    return scan


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])))


def secret_spans(docs: DataFrame, *, odds: float = ODDS) -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind, end), sorted; kind is an index into KINDS."""
    span = "array<struct<start:int,kind:int,end:int>>"
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(scanner(trained(docs), odds), f"doc_id long, base {span}, spans {span}")


def n_of(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [n_of(k).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return rows.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
