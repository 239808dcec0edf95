"""License notices: base phrases by place, and templates by an exact set-similarity join."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled, slices

# Phrases and labels of the base, and public license notices.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "apache": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by": "This work is licensed under a Creative Commons Attribution International License",
}
#: Part of a template's distinct words a block must hold.
CONTAINMENT = 0.8

#: Bytes of words: digits, letters and all of non-ASCII; others become blanks.
_CLEAN = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def word_list(text: bytes) -> list[bytes]:
    """Words of a text with A-Z in lower case."""
    return text.lower().translate(_CLEAN).split()


def _frequencies(tokens: set[bytes]):
    """Documents that hold each template word, summed over a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in (piece for whole in batches for piece in slices(whole, "text", 8 << 20)):
            for text in batch.column("text").to_pylist():
                sums.update(tokens.intersection(word_list(text.encode("utf-8"))))
        yield pa.RecordBatch.from_arrays([pa.array([t.decode() for t in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], ["token", "n"])

    return count


class Templates:
    """Templates with their words in the global order, the rarest first."""

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], containment: float) -> None:
        self.sets = []
        self.by_prefix: dict[bytes, list[int]] = {}
        for label, text in templates.items():
            tokens = sorted(set(word_list(text.encode())), key=lambda t: (frequency.get(t, 0), t))
            need = math.ceil(containment * len(tokens) - 1e-9)
            for t in tokens[: len(tokens) - need + 1]:  # a block that misses all of these can't reach the threshold
                self.by_prefix.setdefault(t, []).append(len(self.sets))
            self.sets.append((label, tokens, need))
        self.prefixes = self.by_prefix.keys()

    def search(self, block: set[bytes]) -> dict[str, float]:
        """Labels of the templates the block contains, with the part of each it holds.

        Prefix: the block holds one of the rarest words. Length: it has as many words as must match. Position: reading a
        template in order, it is given up as soon as the words left can't reach the threshold.
        """
        found: dict[str, float] = {}
        for i in sorted({i for t in self.prefixes & block for i in self.by_prefix[t]}):
            label, tokens, need = self.sets[i]
            if len(block) < need:
                continue
            hits = 0
            for place, t in enumerate(tokens):
                hits += t in block
                if hits + len(tokens) - place - 1 < need:
                    break
            else:
                found[label] = max(found.get(label, 0.0), hits / len(tokens))
        return found


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row.

    ``n_base`` counts the places of base phrases, ``first_word`` and ``last_word`` are the smallest and largest of their
    first words (from 0, null if there are none). A block is a line or a run of lines between empty ones; a block that
    holds ``containment`` of a template's distinct words gets its label. ``score`` is 1 with a base phrase, else the largest
    part of a template that is held, 0 without a label. Null text is empty. Other columns are ignored.

    The word order is the number of documents over the whole table, for the words of the templates, a set that does not
    grow with the table. Both passes are map only.
    """
    templates = TEMPLATES if templates is None else templates
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), filled(F.col(text_col).cast("string")).alias("text"))
    tokens = {t for text in templates.values() for t in word_list(text.encode())}
    counts = base.select("text").mapInArrow(_frequencies(tokens), "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    known = Templates(templates, {r["token"].encode(): r["n"] for r in counts}, containment)
    phrases = [(p.encode().split(), label) for p, label in PHRASES.items()]

    def blocks(text: bytes) -> Iterator[set[bytes]]:
        for run in re.split(rb"\n[ \t\r]*\n", text):
            lines = run.split(b"\n")
            if len(lines) > 1:
                yield set(word_list(run))
            for line in lines:
                yield set(word_list(line))

    def one(text: bytes) -> tuple:
        words = word_list(text)
        held = set(words)
        places, labels = [], set()
        for phrase, label in phrases:
            if held.issuperset(phrase):
                n = len(phrase)
                at = [i for i, w in enumerate(words) if w == phrase[0] and words[i : i + n] == phrase]
                places += at
                labels |= {label} if at else set()
        found: dict[str, float] = {}
        if known.search(held):
            for block in blocks(text):
                for label, part in known.search(block).items():
                    found[label] = max(found.get(label, 0.0), part)
        score = 1.0 if places else max(found.values(), default=0.0)
        return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | found.keys())), score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
        for batch in (piece for whole in batches for piece in slices(whole, "text", 8 << 20)):
            rows = [one(t.encode("utf-8")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], [f.split(" ")[0] for f in SCHEMA.split(", ")])

    return base.mapInArrow(run, SCHEMA)
