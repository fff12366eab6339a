"""License scans with a positional index of rare words.

Templates are licence notices and short phrases with a label; some of their phrases are
mandatory.  Word frequencies come from all documents.  Every template is indexed under its
rarest positions (highest IDF): word -> (template, position).  A notice may lack a fifth of its words, so it
is indexed under one position more than it may lack: every text that passes holds one of them in place.
A text's licence words are looked up in order;
each match fixes the template's place in the text by the difference of positions, and
places that several words agree on are visited once.  There the template's words are
compared one by one, and the mandatory phrases are searched in the stretch.
A phrase template is nothing but its mandatory phrase, and every place of the phrase
holds its rarest word, so all places are found.

Texts are read twice (frequencies, scan) and never shuffled; per task only counts of the
licence words leave, which the templates bound.  Null texts have no words; repeated rows are scanned each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundswell.llm.frames import annotate, encoded, fresh, slices
from groundswell.llm.words import word_list
from groundswell.plans.shared import ship_package


@dataclass(frozen=True)
class Notice:
    """A licence text and the phrases that must stand in it."""

    label: str
    text: str
    mandatory: tuple[str, ...]


# Phrases, then notices, with their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
NOTICES = (
    Notice(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ("permission is hereby granted free of charge",),
    ),
    Notice(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        ("apache license", "except in compliance with the license"),
    ),
    Notice(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    Notice(
        "gpl",
        "under the terms of the gnu general public license as published by the free software foundation",
        ("gnu general public license",),
    ),
    Notice("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Notice(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify", "with or without fee is hereby granted"),
    ),
    Notice("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0", "public domain dedication")),
    Notice("cc-by-nc", "creative commons attribution noncommercial", ("creative commons attribution noncommercial",)),
)
LEAST_SHARE = 0.8


def anchors(n_words: int) -> int:
    """One more than the words that a notice of `n_words` may lack."""
    return 1 + sum(k / n_words >= LEAST_SHARE for k in range(n_words))


class Index:
    """Postings of the templates' rarest positions."""

    def __init__(self, phrases, notices, frequency: dict[bytes, int], documents: int):
        self.templates = [(label, tuple(word_list(p.encode())), (), True) for p, label in phrases]
        self.templates += [(n.label, tuple(word_list(n.text.encode())), tuple(tuple(word_list(m.encode())) for m in n.mandatory), False) for n in notices]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for number, (_, words, _, phrase) in enumerate(self.templates):
            idf = {w: math.log((1 + documents) / (1 + frequency.get(w, 0))) for w in words}
            rarest = sorted(range(len(words)), key=lambda i: (-idf[words[i]], words[i], i))
            for position in rarest[: 1 if phrase else anchors(len(words))]:
                self.postings[words[position]].append((number, position))
        self.postings = dict(self.postings)

    @staticmethod
    def vocabulary(phrases, notices) -> set[bytes]:
        return {w for text in [p for p, _ in phrases] + [n.text for n in notices] for w in word_list(text.encode())}

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """Places of phrases `(start, label)`, and the best score of every label whose template stands in the text."""
        postings, places = self.postings, set()
        for at, word in enumerate(words):
            for number, position in postings.get(word, ()) if word in postings else ():
                places.add((number, at - position))
        found: set[tuple[int, str]] = set()
        labels: dict[str, float] = {}
        for number, start in places:
            label, template, mandatory, phrase = self.templates[number]
            if phrase:
                if start >= 0 and tuple(words[start : start + len(template)]) == template:
                    found.add((start, label))
                    labels[label] = 1.0
                continue
            low = max(0, start)
            stretch = words[low : start + len(template)]
            share = sum(a == b for a, b in zip(stretch, template[low - start :])) / len(template)
            if share >= LEAST_SHARE and all(_holds(stretch, m) for m in mandatory):
                labels[label] = max(labels.get(label, 0.0), share)
        return sorted(found), labels


def _holds(words: list[bytes], phrase: tuple[bytes, ...]) -> bool:
    k = len(phrase)
    return any(tuple(words[i : i + k]) == phrase for i in range(len(words) - k + 1))


def document_frequency(docs: DataFrame, text: str, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many documents each word of the vocabulary occurs, and the number of documents."""

    def run(batches):
        seen: dict[bytes, int] = defaultdict(int)
        rows = 0
        for batch in batches:
            for part in slices(batch, 0):
                for t in encoded(part.column(0)):
                    rows += 1
                    for word in vocabulary.intersection(word_list(t)):
                        seen[word] += 1
        yield pa.RecordBatch.from_arrays([pa.array([b"", *seen], pa.binary()), pa.array([rows, *seen.values()], pa.int64())], ["word", "n"])

    ship_package(docs.sparkSession)
    sums = docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r.word): r.n for r in sums}
    return counts, counts.pop(b"", 0)


RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
]


def scan_licenses(docs: DataFrame, text: str = "text", phrases=PHRASES, notices=NOTICES, keep=None) -> tuple[DataFrame, str]:
    """`keep` (default: all columns) and a struct column of `RESULT`, whose name is returned.

    Base columns speak of phrases; `labels` has the notices' too; `score` is the best share of a template's words in place.
    """
    frequency, documents = document_frequency(docs, text, Index.vocabulary(phrases, notices))
    name = fresh(docs, "license")
    kind = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def make():
        index = Index(phrases, notices, frequency, documents)

        def work(texts):
            rows = []
            for t in encoded(texts):
                words = word_list(t)
                found, labels = index.scan(words)
                starts = [s for s, _ in found]
                rows.append(
                    {
                        "n_words": len(words),
                        "n_base": len(found),
                        "first_word": starts[0] if starts else None,
                        "last_word": starts[-1] if starts else None,
                        "base_labels": ",".join(sorted({label for _, label in found})),
                        "labels": ",".join(sorted(labels)),
                        "score": max(labels.values(), default=0.0),
                    }
                )
            return [pa.array(rows, kind)]

        return work

    return annotate(docs, text, [T.StructField(name, T.StructType(RESULT))], make, keep), name
