"""License scans: Dice coefficient of word bigrams against licence templates (operator 10).

A text's units are its lines, its paragraphs of more than one line, and the whole of it where it has more than one
paragraph. A unit and a template are sets of word bigrams (lower case, word characters). Dice >= least needs
|unit| between |template| * least / (2 - least) and |template| * (2 - least) / least; templates out of these bounds are
not compared, and a unit is given up as soon as its set outgrows the largest template's bound. A unit takes the template
of the highest coefficient, ties to the first name.

A notice that is no unit of its own is found by word windows (`windows`): all runs of words of the whole text with Dice >=
least count; of a template's overlapping ones the highest coefficient stays, then the shortest, then the first; of
different templates' the one that shares most bigrams. Windows that overlap the best window of a matching unit are that
unit's. Only windows that start at a bigram of the template not seen again and end at one not seen before are tried; any
other has one of these inside it that is as good and shorter.

Nulls, ties and odd input: a null text counts as empty; texts of less than two words match nothing; repeated rows each
get their row; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 0.8
#: Common licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
_WORD = re.compile(r"\w+")
_STEP = 1024  # words added to a unit's set before its size is looked at again


def bigrams(words: list[str], most: float = float("inf")) -> set[tuple[str, str]] | None:
    """The set of word pairs; None as soon as it is larger than most."""
    found: set[tuple[str, str]] = set()
    for at in range(0, max(0, len(words) - 1), _STEP):
        found.update(zip(words[at : at + _STEP], words[at + 1 : at + 1 + _STEP], strict=False))
        if len(found) > most:
            return None
    return found


class Spans:
    """Spans of places, ends included, that lie apart; those that meet become one."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        i = bisect_right(self.starts, b)
        return i == 0 or self.ends[i - 1] < a

    def add(self, a: int, b: int) -> None:
        low, high = bisect_left(self.ends, a), bisect_right(self.starts, b)
        if low < high:
            a, b = min(a, self.starts[low]), max(b, self.ends[high - 1])
        self.starts[low:high], self.ends[low:high] = [a], [b]


def apart(rows: list[tuple[float, int, int, int]]) -> list[tuple[float, int, int, int]]:
    """The first of the windows that overlap."""
    out, taken = [], Spans()
    for row in rows:
        if taken.free(row[2], row[2] + row[1]):
            taken.add(row[2], row[2] + row[1])
            out.append(row)
    return out


class Matcher:
    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        self.templates = sorted((name, bigrams(_WORD.findall(text.lower()))) for name, text in templates.items())
        sizes = [len(t) for _, t in self.templates]
        self.low, self.high = min(sizes) * least / (2 - least), max(sizes) * (2 - least) / least
        self.known = set().union(*(t for _, t in self.templates))

    def best(self, words: list[str]) -> tuple[str, float] | None:
        """The licence of a unit and its Dice coefficient."""
        if len(words) - 1 < self.low:
            return None
        own = bigrams(words, self.high)
        if own is None or len(own & self.known) * 2 < self.least * len(own):
            return None
        found = None
        for name, other in self.templates:
            if len(other) * self.least <= len(own) * (2 - self.least) and len(own) * self.least <= len(other) * (2 - self.least):
                dice = 2 * len(own & other) / (len(own) + len(other))
                if dice >= self.least and (found is None or dice > found[1]):
                    found = (name, dice)
        return found

    def candidates(self, pairs: list[tuple[str, str]], at: list[int], template: set[tuple[str, str]]) -> list[tuple[float, int, int, int]]:
        """(-dice, pairs after the first, first pair, shared pairs) of windows, best first. at: where pairs of the template are."""
        m, out = len(template), []
        if len({pairs[i] for i in at}) * (2 - self.least) < self.least * m - 1e-9:
            return out
        for start in at:
            seen, shared = set(), 0
            for end in range(start, len(pairs)):
                pair = pairs[end]
                if pair in seen:
                    if pair == pairs[start]:
                        break
                    continue
                seen.add(pair)
                if len(seen) * self.least > m * (2 - self.least) + 1e-9:
                    break
                if pair in template:
                    shared += 1
                    dice = 2 * shared / (len(seen) + m)
                    if dice >= self.least:
                        out.append((-dice, end - start, start, shared))
        return sorted(out)

    def windows(self, lines: list[list[str]], units: list[dict]) -> list[dict]:
        """Matches of word windows outside the units that match."""
        words, where = [w for x in lines for w in x], [i for i, x in enumerate(lines) for _ in x]
        pairs = list(zip(words, words[1:], strict=False))
        hits = [i for i, p in enumerate(pairs) if p in self.known]
        found = {name: self.candidates(pairs, [i for i in hits if pairs[i] in t], t) for name, t in self.templates} if hits else {}
        taken, in_order = Spans(), {name: sorted(rows, key=lambda x: x[2]) for name, rows in found.items()}
        for u in units:
            a, b = bisect_left(where, u["first"]), bisect_right(where, u["last"]) - 2
            rows = in_order[u["license"]]
            inside = rows[bisect_left(rows, a, key=lambda x: x[2]) : bisect_right(rows, b, key=lambda x: x[2])]
            for _, n, s, _ in sorted(x for x in inside if x[2] + x[1] <= b)[:1]:
                taken.add(s, s + n)
        picked = [(-shared, dice, name, s, s + n) for name, rows in found.items() for dice, n, s, shared in apart(rows)]
        out = []
        for _, dice, name, a, b in sorted(picked):
            if taken.free(a, b):
                taken.add(a, b)
                out.append({"license": name, "first": where[a], "last": where[b + 1], "dice": -dice})
        return out

    def matches(self, text: str, windows: bool = True) -> list[dict]:
        """license, first, last (line numbers from 0), dice of every unit that matches, in order."""
        lines = [_WORD.findall(x) for x in text.lower().split("\n")]
        units = [(i, i, x) for i, x in enumerate(lines)]
        start, paragraphs = 0, 0
        for i in range(len(lines) + 1):
            if i == len(lines) or not lines[i]:
                paragraphs += i > start
                if i - start > 1:
                    units.append((start, i - 1, [w for x in lines[start:i] for w in x]))
                start = i + 1
        if paragraphs > 1:
            units.append((0, len(lines) - 1, [w for x in lines for w in x]))
        found = [(a, b, self.best(words)) for a, b, words in units]
        out = [{"license": x[0], "first": a, "last": b, "dice": x[1]} for a, b, x in found if x]
        return sorted(out + (self.windows(lines, out) if windows else []), key=lambda m: (m["first"], m["last"]))


_MATCHES = pa.list_(pa.struct([("license", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("dice", pa.float64())]))


def license_matches(docs: DataFrame, *, templates: dict[str, str] = TEMPLATES, least: float = LEAST, windows: bool = True) -> DataFrame:
    """doc_id and matches: array of (license, first, last, dice), in the scan's own tasks: no shuffle. windows: search word
    windows too, not only lines, paragraphs and the whole text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, least)
        for batch in batches:
            found = [matcher.matches(x.as_py() or "", windows) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _MATCHES)], names=["doc_id", "matches"])

    schema = "doc_id long, matches array<struct<license:string,first:int,last:int,dice:double>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, schema)


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    named = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["first"], m["last"]))
    best = F.array_min(F.transform("matches", lambda m: F.struct((-m["dice"]).alias("dice"), m["license"])))  # ties to the first name
    return rows.select(
        "doc_id", F.size("matches").cast("long").alias("n_matches"), best["license"].alias("license"), F.round(-best["dice"], 9).alias("dice"),
        F.concat_ws(",", named).alias("spans"),
    )
