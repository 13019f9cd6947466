"""Licence scans with a positional index of rare template words.

Of each licence template the words that are rarest in the corpus are indexed
with their positions. A text looks its own words up in this index; postings
that agree on where the template would begin make a candidate, which counts if
the template's mandatory phrases stand there and enough of its words do.

Words are runs of letters a-z (A-Z in lower case), digits and non-ASCII
characters; positions count words from 0. A null text counts as empty. Every
row is scanned for itself, so rows and ids may repeat.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: bytes below 128 that are no letter or digit become blanks, A-Z become a-z
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


# Phrases that name a licence wherever they stand, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Openings and notices of public licences with their mandatory phrases.
TEMPLATES = (
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
        ("with or without fee", "hereby granted"),
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice",
        ("redistribution and use in source and binary forms", "are permitted provided that"),
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    (
        "gpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version",
        ("gnu general public license", "free software foundation"),
    ),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    ("lgpl", "under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the GNU Affero General Public License", ("gnu affero general public license",)),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at",
        ("mozilla public license v 2 0",),
    ),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", ("cc by nd 4 0",)),
    (
        "cc-by-text",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        ("creative commons attribution",),
    ),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights. CC0 1.0 Universal", ("cc0 1 0",)),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software",
        ("free and unencumbered software", "public domain"),
    ),
    ("mit", "Released under the MIT License", ("mit license",)),
)

RARE = 6  # words of a template that are indexed, the rarest first; half of them where that is more
DRIFT = 3  # words by which postings of one place may disagree
LEAST = 0.6  # of a template's words must stand in its place


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    mandatory: tuple[bytes, ...]


def templates(given=TEMPLATES) -> list[Template]:
    return [
        Template(label, tuple(words_of(text.encode())), tuple(b" ".join(words_of(p.encode())) for p in phrases))
        for label, text, phrases in given
    ]


def document_frequencies(docs: DataFrame, text: str, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many texts each word of the templates stands: one row per word and task, then per word."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                seen.update(vocabulary.intersection(words_of(value.as_py())))
        yield pa.RecordBatch.from_pydict(
            {"word": pa.array(list(seen), "binary"), "n": pa.array(list(seen.values()), "int64")}
        )

    counts = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(counted, "word binary, n bigint")
    return {bytes(r["word"]): r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


@dataclass(frozen=True)
class Index:
    templates: list[Template]
    postings: dict[bytes, list[tuple[int, int]]]
    needed: list[int]  # different rare words that must agree


def rare_index(known: list[Template], frequency: dict[bytes, int]) -> Index:
    postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    needed = []
    for number, template in enumerate(known):
        different = sorted(set(template.words), key=lambda w: (frequency.get(w, 0), w))
        rare = different[: max(RARE, len(different) // 2)]
        # words that no text holds cannot vote; of the rest, a quarter must
        present = [w for w in rare if frequency.get(w, 0)]
        needed.append(max(2, len(present) // 4))
        for position, word in enumerate(template.words):
            if word in rare:
                postings[word].append((number, position))
    return Index(known, dict(postings), needed)


def candidates(words: list[bytes], index: Index) -> Iterator[tuple[int, int]]:
    """(template, begin) of places on which enough rare words agree."""
    rare = index.postings.keys() & set(words)
    if not rare:
        return
    votes = defaultdict(list)
    for at, word in enumerate(words):
        if word in rare:
            for number, position in index.postings[word]:
                votes[number].append((at - position, word))
    for number, cast in votes.items():
        cast.sort()
        group: list[tuple[int, bytes]] = []
        for begin, word in [*cast, (len(words) + 10 * DRIFT + 1_000, b"")]:
            if group and begin - group[-1][0] > DRIFT:
                if len({w for _, w in group}) >= index.needed[number]:
                    yield number, Counter(b for b, _ in group).most_common(1)[0][0]
                group = []
            group.append((begin, word))


def verified(words: list[bytes], begin: int, template: Template) -> float:
    """The share of the template's words that stand in its place, 0 if a mandatory phrase does not."""
    place = words[max(0, begin - DRIFT) : max(0, begin + len(template.words) + DRIFT)]
    line = b" " + b" ".join(place) + b" "
    if not all(b" " + phrase + b" " in line for phrase in template.mandatory):
        return 0.0
    common = Counter(place) & Counter(template.words)
    return sum(common.values()) / len(template.words)


def places(words: list[bytes], phrase: bytes, line: bytes) -> list[int]:
    """Word positions at which the phrase begins; ``line`` is the words with blanks around each."""
    found, at, position, last = [], line.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        position += line.count(b" ", last, at)
        last = at
        found.append(position)
        at = line.find(b" " + phrase + b" ", at + 1)
    return found


COLUMNS = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, id: str = "doc_id", text: str = "text", given=TEMPLATES) -> DataFrame:
    """One row per text: places of the phrases, labels of phrases and templates, the best share as score.

    A phrase is a template all of whose words are mandatory: it scores 1.
    """
    known = templates(given)
    vocabulary = frozenset(w for t in known for w in t.words)
    index = rare_index(known, document_frequencies(docs, text, vocabulary))
    phrases = [(phrase.encode(), label) for phrase, label in PHRASES]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                words = words_of(value.as_py())
                line = b" " + b" ".join(words) + b" "
                base = [(at, label) for phrase, label in phrases for at in places(words, phrase, line)]
                labels = {label for _, label in base}
                own = sorted(labels)
                score = 1.0 if base else 0.0
                for number, begin in candidates(words, index):
                    share = verified(words, begin, known[number])
                    if share >= LEAST:
                        labels.add(known[number].label)
                        score = max(score, share)
                starts = [at for at, _ in base]
                rows.append(
                    (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(own), ",".join(sorted(labels)), score)
                )
            kinds = ["int64"] * 4 + ["string"] * 2 + ["float64"]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [c.split()[0] for c in COLUMNS.split(", ")])

    picked = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return picked.mapInArrow(scanned, COLUMNS)
