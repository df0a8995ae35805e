"""Licence scan with a positional index of rare words.

Templates are word sequences. The index lists, for every word of a template, its places there. In a file only
the rarest licence words are looked up (rare by how many documents of the whole corpus hold them): each of
their places points to where a template would begin, and beginnings on which all of a template's rare key words
agree are candidates. A candidate counts only if the template's mandatory key phrase stands at that place.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import widened

# Words are runs of 0-9, a-z (A-Z lowered) and all bytes of non-ASCII characters; everything else parts them.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
ANCHORS = 3  # rarest words of a key phrase that are looked up
DRIFT = 2  # words by which a longer template may be shifted
COVERAGE = 0.8  # part of a longer template's words that must be found


@dataclass(frozen=True)
class Template:
    """``words`` of a notice and ``key``, the phrase in it that must stand there unchanged."""

    label: str
    words: tuple[bytes, ...]
    key: tuple[bytes, ...]
    base: bool = False

    @property
    def key_at(self) -> int:
        n = len(self.key)
        return next(i for i in range(len(self.words) - n + 1) if self.words[i : i + n] == self.key)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def template(label: str, text: str, key: str | None = None, base: bool = False) -> Template:
    words = tuple(words_of(text))
    found = Template(label, words, tuple(words_of(key)) if key else words, base)
    found.key_at  # noqa: B018  raises if the phrase is not part of the text
    return found


# Phrases whose every place counts, and wordings of common notices with their key phrases.
BASE = (
    template("mit", "mit license", base=True),
    template("apache", "apache license", base=True),
    template("gpl", "general public license", base=True),
)
NOTICES = (
    template("mit-notice", "released under the MIT License", "the mit license"),
    template("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
             "permission is hereby granted free of charge"),
    template("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license version 2 0"),
    template("gpl-3.0", "licensed under the GNU General Public License, version 3", "gnu general public license version 3"),
    template("gpl-2.0", "licensed under the GNU General Public License, version 2", "gnu general public license version 2"),
    template("lgpl", "licensed under the GNU Lesser General Public License", "lesser general public license"),
    template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc by nc 4 0"),
    template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", "cc by sa 4 0"),
    template("cc-by-4.0", "Licensed under CC BY 4.0", "cc by 4 0"),
    template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted",
             "redistribution and use in source and binary forms"),
)


class Index:
    """Postings of the templates' rarest words; ``documents`` tells how many documents hold a word."""

    def __init__(self, templates: tuple[Template, ...], documents: dict[bytes, int]):
        self.templates = templates
        self.vocabulary = frozenset(w for t in templates for w in t.words)
        self.anchors: list[list[int]] = []  # places of a template's rarest key words, the rarest first
        self.postings: dict[bytes, list[int]] = defaultdict(list)  # templates by their rarest key word
        for n, t in enumerate(templates):
            inside = range(t.key_at, t.key_at + len(t.key))
            rarest = sorted(inside, key=lambda i: (documents.get(t.words[i], 0), t.words[i], i))  # noqa: B023
            self.anchors.append(rarest[:ANCHORS])
            self.postings[t.words[rarest[0]]].append(n)

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """``(template, start of its key phrase, part of the template found)`` of every verified place."""
        if self.postings.keys().isdisjoint(words):
            return []
        places: dict[bytes, list[int]] = defaultdict(list)
        for at, word in enumerate(words):
            if word in self.vocabulary:
                places[word].append(at)
        found = []
        for n in {n for word, posted in self.postings.items() if word in places for n in posted}:
            t = self.templates[n]
            starts: set[int] | None = None
            for i in self.anchors[n]:
                here = {at - i for at in places.get(t.words[i], ())}
                starts = here if starts is None else starts & here
            for start in starts or ():
                at = start + t.key_at
                if at < 0 or tuple(words[at : at + len(t.key)]) != t.key:
                    continue
                present = sum(self._near(places.get(w, ()), start + i) for i, w in enumerate(t.words))
                if len(t.key) == len(t.words) or present >= COVERAGE * len(t.words):
                    found.append((n, at, present / len(t.words)))
        return sorted(found)

    @staticmethod
    def _near(places, wanted: int) -> bool:
        k = bisect_left(places, wanted - DRIFT)
        return k < len(places) and places[k] <= wanted + DRIFT


def licence_words(docs: DataFrame, templates: tuple[Template, ...], text: str = "text") -> dict[bytes, int]:
    """How many documents hold each word of the templates, over all documents (bounded by the templates)."""
    vocabulary = frozenset(w for t in templates for w in t.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts.update(vocabulary.intersection(words_of(t)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
        )

    held = docs.select(F.col(f"`{text}`")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"].encode(): r["n"] for r in held.collect()}


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, text: str = "text") -> DataFrame:
    """Add ``n_words``, ``matches`` and ``score`` to every row.

    ``matches`` is an array of ``(label, base, start, words, share)``: start is the word (from 0) where the key
    phrase begins, words its length and share the part of the template that was found around it. ``score`` is
    1 for a base phrase, otherwise the best share, 0 without a match. A null or empty text has no words and no
    matches; repeated rows stay; columns named like the new ones are replaced. Rows are independent.
    """
    index = Index(templates, licence_words(docs, templates, text))
    new = ("n_words", "matches", "score")
    kept = [c for c in docs.columns if c not in new]
    inner = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_text"))
    match = "array<struct<label:string,base:boolean,start:bigint,words:bigint,share:double>>"
    schema = widened(inner.drop("_text"), n_words="long", matches=match, score="double")
    kind = pa.list_(pa.struct([
        ("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("words", pa.int64()), ("share", pa.float64())
    ]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, matches, scores = [], [], []
            for t in batch.column(len(kept)).to_pylist():
                words = words_of(t)
                found = [
                    {"label": index.templates[n].label, "base": index.templates[n].base, "start": at,
                     "words": len(index.templates[n].key), "share": share}
                    for n, at, share in index.scan(words)
                ]
                counts.append(len(words))
                matches.append(found)
                scores.append(max([0.0, *(m["share"] for m in found)]))
            columns = [batch.column(i) for i in range(len(kept))]
            added = [pa.array(counts, pa.int64()), pa.array(matches, kind), pa.array(np.array(scores, float), pa.float64())]
            yield pa.RecordBatch.from_arrays([*columns, *added], names=[*kept, *new])

    return inner.mapInArrow(run, schema)
