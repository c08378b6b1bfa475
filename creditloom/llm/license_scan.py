"""License scan: an exact containment join between text blocks and templates.

A template is a set of words with a threshold t; a block is any run of ``span``
consecutive words of a document. The join finds every block that contains at
least ceil(t |T|) words of a template T:

* words are ordered by their frequency over all documents, rarest first;
* prefix filter: such a block holds one of the first |T| - ceil(t |T|) + 1 words of T
  in that order, so only places of these words start a comparison;
* length filter: around such a place there must be as many template words as needed;
* positional filter: words of T not before the place's word in the order must suffice;
* what is left is verified word by word.

The first pass reduces documents to the places of template words (a staged table),
from which both the frequencies and the join are made. Templates go to the tasks in groups of at
most ``GROUP_WORDS`` words; more templates mean more passes over that table, never fewer
comparisons.

Rows: null or wordless text has no blocks; null ids stay; repeated rows are repeated;
empty tables give empty results; overlapping blocks are all reported;
a template without words is refused; further columns are ignored; texts are read whole.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import query, read, stage
from creditloom.llm.textops import chunks

GROUP_WORDS = 200_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Template:
    """``phrase``: the words have to stand in this order, one after the other."""

    label: str
    text: str
    threshold: float = 0.8
    slack: float = 1.25
    phrase: bool = False

    def words(self) -> list[str]:
        return [w.decode() for w in _WORD.findall(self.text.encode().lower())]

    def span(self) -> int:
        n = len(self.words())
        return n if self.phrase else math.ceil(self.slack * n)

    def needed(self) -> int:
        n = len(set(self.words()))
        return n if self.phrase else max(1, math.ceil(self.threshold * n - 1e-9))


# Phrases and their labels.
BASE = (
    Template("gpl", "gnu general public license", 1.0, phrase=True),
    Template("apache", "apache license", 1.0, phrase=True),
    Template("cc-by", "cc by", 1.0, phrase=True),
    Template("mit", "mit license", 1.0, phrase=True),
)
# Notices as the licenses' own texts word them.
NOTICES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    Template("gpl-2.0", "under the terms of the GNU General Public License, version 2"),
    Template("lgpl", "under the terms of the GNU Lesser General Public License"),
    Template("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", 1.0),
    Template("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", 1.0),
    Template("mit-notice", "released under the MIT License", 1.0),
    Template("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)


def _places(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n_words, and the positions and numbers of template words in each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            counts, positions, numbers = [], [], []
            for text in batch.column("text").to_pylist():
                words = _WORD.findall((text or "").encode().lower())
                at = [i for i, w in enumerate(words) if w in vocabulary]
                counts.append(len(words))
                positions.append(np.array(at, dtype="<i4").tobytes())
                numbers.append(np.array([vocabulary[words[i]] for i in at], dtype="<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(positions, pa.binary()), pa.array(numbers, pa.binary())],
                ["doc_id", "n_words", "positions", "numbers"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        work, "doc_id long, n_words long, positions binary, numbers binary"
    )


def _frequencies(places: DataFrame, size: int) -> np.ndarray:
    """Occurrences of each template word over all documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            numbers = np.frombuffer(b"".join(x for x in batch.column("numbers").to_pylist() if x), dtype="<i4")
            total += np.bincount(numbers, minlength=size)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(total[full], pa.int64())], ["number", "n"])

    found = places.select("numbers").mapInArrow(work, "number int, n long").groupBy("number").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, dtype=np.int64)
    for r in found:
        out[r["number"]] = r["n"]
    return out


@dataclass(frozen=True)
class _Plan:
    """A template by word numbers: its order, prefix, and the phrase to verify."""

    number: int
    rank: dict[int, int]
    prefix: frozenset[int]
    needed: int
    span: int
    phrase: tuple[int, ...]


def _plan(number: int, template: Template, vocabulary: dict[bytes, int], place: np.ndarray) -> _Plan:
    words = tuple(vocabulary[w.encode()] for w in template.words())
    ordered = sorted(set(words), key=lambda w: place[w])
    needed = template.needed()
    return _Plan(
        number, {w: k for k, w in enumerate(ordered)}, frozenset(ordered[: len(ordered) - needed + 1]), needed, template.span(),
        words if template.phrase else (),
    )


def _blocks(plan: _Plan, anchors: list[int], positions: list[int], numbers: list[int]) -> Iterator[tuple[int, int, float]]:
    """First word, last word and containment of every block around anchor entries, by first word."""
    done = -1  # windows starting up to here are settled
    for a in anchors:
        p, r = positions[a], plan.rank[numbers[a]]
        lo, hi = bisect_left(positions, p - plan.span + 1), bisect_right(positions, p + plan.span - 1)
        near = [(positions[k], numbers[k]) for k in range(lo, hi) if numbers[k] in plan.rank]
        if len(near) < plan.needed:
            continue
        # A block whose rarest template word is this one has no word before it in the order.
        if len({w for _, w in near if plan.rank[w] >= r}) < plan.needed:
            continue
        for s, (start, first) in enumerate(near):
            if start > p:
                break
            if start <= done:
                continue
            inside = [x for x in near[s:] if x[0] < start + plan.span]
            if inside[-1][0] < p:
                continue
            done = start
            kinds = {w for _, w in inside}
            if len(kinds) < plan.needed:
                continue
            if plan.phrase:
                if tuple(w for _, w in inside) == plan.phrase and inside[-1][0] - start == plan.span - 1:
                    yield start, inside[-1][0], 1.0
            else:
                yield start, inside[-1][0], len(kinds) / len(plan.rank)


def scan(docs: DataFrame, templates: Sequence[Template] = BASE + NOTICES) -> DataFrame:
    """doc_id, n_words, blocks: array of (template, first_word, last_word, containment), by template.

    ``template`` is the number in ``templates``. Every place is reported: each template word that
    starts a block with enough words of the template, also where blocks overlap. A block ends with its last template word.
    """
    if any(not t.words() for t in templates):
        raise ValueError("a template needs words")
    vocabulary = {w: k for k, w in enumerate(sorted({w.encode() for t in templates for w in t.words()}))}
    places = stage(_places(docs, vocabulary), "template-places")
    # Rarest first; equal counts in alphabetical order.
    place = np.empty(len(vocabulary), dtype=np.int64)
    place[np.argsort(_frequencies(places, len(vocabulary)), kind="stable")] = np.arange(len(vocabulary))
    groups: list[list[_Plan]] = [[]]
    held = 0
    for number, template in enumerate(templates):
        size = len(template.words())
        if held + size > GROUP_WORDS and groups[-1]:
            groups.append([])
            held = 0
        groups[-1].append(_plan(number, template, vocabulary, place))
        held += size
    kind = pa.list_(pa.struct([("template", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("containment", pa.float64())]))
    out = places.withColumn("blocks", F.expr("cast(array() as array<struct<template: int, first_word: bigint, last_word: bigint, containment: double>>)"))
    for plans in groups:
        starts: dict[int, list[_Plan]] = {}
        for plan in plans:
            for w in plan.prefix:
                starts.setdefault(w, []).append(plan)
        out = out.mapInArrow(_joiner(starts, kind), out.schema)
    return out.select("doc_id", "n_words", "blocks")


def _joiner(starts: dict[int, list[_Plan]], kind: pa.DataType):
    wanted = np.array(sorted(starts), dtype=np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("blocks").to_pylist()
            rows = zip(batch.column("positions").to_pylist(), batch.column("numbers").to_pylist(), strict=True)
            for row, (positions, numbers) in enumerate(rows):
                n = np.frombuffer(numbers, dtype="<i4")
                hits = np.flatnonzero(np.isin(n, wanted)).tolist() if len(n) else []
                if not hits:
                    continue
                at, words = np.frombuffer(positions, dtype="<i4").tolist(), n.tolist()
                anchors: dict[int, tuple[_Plan, list[int]]] = {}
                for k in hits:
                    for plan in starts[words[k]]:
                        anchors.setdefault(plan.number, (plan, []))[1].append(k)
                for number in sorted(anchors):
                    plan, own = anchors[number]
                    blocks[row] += [
                        {"template": number, "first_word": a, "last_word": b, "containment": c} for a, b, c in _blocks(plan, own, at, words)
                    ]
            columns = [batch.column(c) for c in ("doc_id", "n_words", "positions", "numbers")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(blocks, kind)], ["doc_id", "n_words", "positions", "numbers", "blocks"])

    return work


@query("op4_license_scan")
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = BASE + NOTICES
    found = scan(read(spark, sf_dir, "documents"), templates)
    labels = F.array(*[F.lit(t.label) for t in templates])
    base = F.filter("blocks", lambda b: b["template"] < len(BASE))

    def named(blocks):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(blocks, lambda b: F.get(labels, b["template"])))), ",")

    starts = F.transform(base, lambda b: b["first_word"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        named(base).alias("base_labels"), named(F.col("blocks")).alias("labels"),
        F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0)).alias("score"),
    )
