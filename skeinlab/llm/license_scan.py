"""License scans with a positional index of rare licence words.

The index holds, for each word of the licence templates, its postings (template, position) and its
inverse document frequency over the templates. Of each template the places of highest inverse frequency open a
look-up, as many as together weigh more than a match may lack; so a file that holds the template has at least one of
them at its place, and no match is lost by leaving the frequent words out. A file's words that are openers are looked up; each
posting names a template and the place of its first word in the file, where the template's other postings are then
intersected by relative position. A place with enough of the template's weight is a match if every mandatory phrase of the
template stands in the file near it.

Independent of that, base phrases are counted at every place where their words stand consecutively.
Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. Null or empty text: no words, no labels, score
0. Repeated rows are scanned each. Memory: a slice of texts and the fixed index.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skeinlab.llm import _text as X

#: Phrases of the base rule and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label, opening words of the licence or of its usual notice, phrases that must be there.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "free of charge"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "2 0"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["general public license", "version 3"]),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2", ["general public license", "version 2"]),
    ("lgpl", "this library is free software you can redistribute it under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ["affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms", "without modification"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc", "4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa", "4 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright dedicated to the public domain cc0", ["public domain"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("reserved", "all rights reserved", ["all rights reserved"]),
]
LEAST_SHARE = 0.75


def _hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(X.span_hashes(X.LOWER_BYTE_VALUES[data], np.array([0]), np.array([len(data)]))[0])


class Index:
    """Postings and weights of the templates' words; its size is that of the templates."""

    def __init__(self, templates: list = TEMPLATES):
        self.templates = [(label, [_hash(w) for w in text.split()], [[_hash(w) for w in p.split()] for p in phrases]) for label, text, phrases in templates]
        df = Counter(h for _, words, _ in self.templates for h in set(words))
        self.idf = {h: math.log((1 + len(self.templates)) / n) for h, n in df.items()}
        self.weight = [sum(self.idf[h] for h in words) for _, words, _ in self.templates]
        #: Postings (template, place) of the words that open a look-up.
        self.openers: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text, _) in enumerate(templates):
            words, held = self.templates[k][1], 0.0
            signs = [len(w) for w in text.split()]
            for i in sorted(range(len(words)), key=lambda i: (-self.idf[words[i]], -signs[i], i)):
                if held > (1 - LEAST_SHARE) * self.weight[k] + 1e-9:
                    break
                self.openers[words[i]].append((k, i))
                held += self.idf[words[i]]
        self.rare = np.array(sorted(self.openers), np.uint64)

    def matches(self, words: np.ndarray, at: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(label, first word, words, share) of the templates that stand in a text; words: its hashes, at: the places of openers."""
        starts = {(k, p - i) for p in at.tolist() for k, i in self.openers[int(words[p])]}
        found = []
        for k, start in sorted(starts):
            label, own, phrases = self.templates[k]
            skipped = max(0, -start)
            here = words[start + skipped : start + len(own)].tolist()
            share = sum(self.idf[w] for w, h in zip(own[skipped:], here, strict=False) if w == h) / self.weight[k]
            if share < LEAST_SHARE:
                continue
            near = words[max(0, start - 3) : max(0, start + len(own) + 3)].tolist()
            if all(any(near[i : i + len(p)] == p for i in range(len(near) - len(p) + 1)) for p in phrases):
                found.append((label, start, len(own), share))
        return found


def scan(documents: DataFrame, base: dict[str, str] = BASE_PHRASES, templates: list = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and matches (label, first word, words, share)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        phrases = [([np.uint64(_hash(w)) for w in p.split()], label) for p, label in base.items()]
        for batch in batches:
            out: dict[str, list] = defaultdict(list)
            for _, _, texts in X.slices(batch.column("text")):
                start, end, before = texts.words(X.ALPHANUMERIC)
                words = X.span_hashes(X.LOWER_BYTE_VALUES[texts.data], start, end)
                of = np.repeat(np.arange(len(texts)), np.diff(before))
                places, labels = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for j, (phrase, _) in enumerate(phrases):
                    at = np.flatnonzero(words[: max(0, len(words) - len(phrase) + 1)] == phrase[0])
                    for k, h in enumerate(phrase[1:], 1):
                        at = at[(words[at + k] == h) & (of[at + k] == of[at])]
                    places.append(at)
                    labels.append(np.full(len(at), j))
                place, label = np.concatenate(places), np.concatenate(labels)
                rare = np.flatnonzero(index.rare[np.minimum(np.searchsorted(index.rare, words), len(index.rare) - 1)] == words)
                edge = np.searchsorted(rare, before)
                by_text: dict[int, list] = defaultdict(list)
                for p, j in zip(place.tolist(), label.tolist(), strict=True):
                    by_text[int(of[p])].append((p, j))
                for i in range(len(texts)):
                    own = by_text.get(i, [])
                    found = index.matches(words[before[i] : before[i + 1]], rare[edge[i] : edge[i + 1]] - before[i]) if edge[i] < edge[i + 1] else []
                    base_labels = {phrases[j][1] for _, j in own}
                    out["n_words"].append(int(before[i + 1] - before[i]))
                    out["n_base"].append(len(own))
                    out["first_word"].append(min(p for p, _ in own) - int(before[i]) if own else None)
                    out["last_word"].append(max(p for p, _ in own) - int(before[i]) if own else None)
                    out["base_labels"].append(",".join(sorted(base_labels)))
                    out["labels"].append(",".join(sorted(base_labels | {m[0] for m in found})))
                    out["score"].append(min(1.0, max((m[3] for m in found), default=0.5 if own else 0.0)))
                    out["matches"].append([dict(zip(("label", "first_word", "n_words", "share"), m, strict=True)) for m in found])
            kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "matches": pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("share", pa.float64())]))}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[n], k) for n, k in kinds.items())], ["doc_id", *kinds])

    return documents.select("doc_id", "text").mapInArrow(X.tidy(each), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first_word:long,n_words:long,share:double>>")
