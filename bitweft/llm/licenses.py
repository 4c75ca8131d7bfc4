"""License scan with a positional rare-token index.

Every licence template keeps its RARE words of highest inverse document frequency (counted over all
documents) with their positions. A file looks up its words in that index; each hit votes for (template,
file position - template position). Templates whose rare words agree on a relative position and whose
mandatory key phrases stand in the file near it are reported. Base labels come from fixed phrases.

Words: after lower-casing A-Z, runs of [0-9a-z] and non-ASCII characters. Edge cases: null or empty text has
no words, no labels and score 0; repeated rows and null ids give a row each; ties between alignments are
all verified; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitweft.llm.arrow import as_bytes, map_rows
from bitweft.session import pick, table

#: Fixed values of the contract: phrase -> label.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Licence notices and key passages (public texts): label, passage, mandatory key phrases.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["permission is hereby granted", "without restriction"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license", "in compliance with the license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ["gnu general public license", "version 2"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("agpl-3.0", "under the terms of the gnu affero general public license version 3", ["affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice", ["redistribution and use in source and binary forms", "conditions are met"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc0-1.0", "cc0 1 0 universal public domain dedication", ["cc0 1 0 universal"]),
]

#: ASCII bytes that are no word characters become spaces.
_SPACES = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_SPACES).split()


def places(words: list[bytes], phrase: tuple[bytes, ...]) -> list[int]:
    """Starts of all places where the phrase's words stand consecutively."""
    found, i, n = [], -1, len(phrase)
    try:
        while True:
            i = words.index(phrase[-1], i + 1)
            if i >= n - 1 and tuple(words[i - n + 1 : i + 1]) == phrase:
                found.append(i - n + 1)
    except ValueError:
        return found


class RareTokenIndex:
    """Postings of each template's rarest words, with relative positions."""

    def __init__(self, templates, document_frequency: dict[str, int], documents: int, rare: int, min_share: float, slack: int):
        self.min_share, self.slack = min_share, slack
        self.labels, self.mass, self.keys, self.length = [], [], [], []
        self.postings: dict[bytes, list[tuple[int, int, float]]] = defaultdict(list)
        idf = lambda w: math.log((documents + 1) / (document_frequency.get(w, 0) + 1)) + 1.0
        for t, (label, passage, keys) in enumerate(templates):
            words = passage.split()
            chosen = sorted(set(words), key=lambda w: (-idf(w), words.index(w)))[:rare]
            self.labels.append(label)
            self.keys.append([tuple(w.encode() for w in k.split()) for k in keys])
            self.mass.append(sum(idf(w) for w in chosen))
            self.length.append(len(words))
            for w in chosen:
                for p in (i for i, x in enumerate(words) if x == w):
                    self.postings[w.encode()].append((t, p, idf(w)))
        self.vocabulary = frozenset(self.postings)

    def scan(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, start word, end word, share of the template's rare weight) of every verified template place."""
        hits = [i for i, w in enumerate(words) if w in self.vocabulary]
        votes: dict[int, dict[int, dict[bytes, float]]] = defaultdict(lambda: defaultdict(dict))
        for i in hits:
            for t, p, weight in self.postings[words[i]]:
                votes[t][i - p][words[i]] = weight
        out = []
        for t, offsets in votes.items():
            done = -1
            for o in sorted(offsets):
                if o <= done:
                    continue
                seen: dict[bytes, float] = {}
                for d in range(self.slack + 1):  # a word put in or left out shifts what follows by one
                    seen.update(offsets.get(o + d, {}))
                share = sum(seen.values()) / self.mass[t]
                start, end = max(0, o - self.slack), max(0, o + self.length[t] + 2 * self.slack)
                if share >= self.min_share and all(places(words[start:end], k) for k in self.keys[t]):
                    out.append((self.labels[t], max(0, o), min(len(words), o + self.length[t]), min(1.0, share)))
                    done = o + self.slack
        return out


def document_frequency(docs: DataFrame, text_col: str = "text") -> tuple[dict[str, int], int]:
    """In how many documents each template word stands, over all documents; bounded by the templates' words."""
    vocabulary = frozenset(w.encode() for _, passage, _ in TEMPLATES for w in passage.split())

    def make():
        def count(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = Counter()
            for text in as_bytes(batch, "text"):
                n.update(vocabulary.intersection(words_of(text)))
            n[b""] = batch.num_rows
            return pa.record_batch({"word": pa.array([w.decode() for w in n], pa.string()), "n": pa.array(list(n.values()), pa.int64())})

        return count

    rows = map_rows(pick(docs, text=text_col), "word string, n long", "text", make).groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r.word: r.n for r in rows}
    return found, found.pop("", 0)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = 12, min_share: float = 0.6, slack: int = 2) -> DataFrame:
    """A row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score and
    spans (label, start word, end word, score) of the templates found."""
    frequency, documents = document_frequency(docs, text_col)
    base = [(tuple(w.encode() for w in p.split()), label) for p, label in BASE.items()]

    def make():
        index = RareTokenIndex(TEMPLATES, frequency, documents, rare, min_share, slack)

        def look(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = defaultdict(list)
            for text in as_bytes(batch, "text"):
                words = words_of(text)
                starts, labels = [], set()
                for phrase, label in base:
                    if found := places(words, phrase):
                        starts += found
                        labels.add(label)
                spans = index.scan(words)
                out["n_words"].append(len(words))
                out["n_base"].append(len(starts))
                out["first_word"].append(min(starts, default=None))
                out["last_word"].append(max(starts, default=None))
                out["base_labels"].append(",".join(sorted(labels)))
                out["labels"].append(",".join(sorted(labels | {s[0] for s in spans})))
                out["score"].append(1.0 if labels else max((s[3] for s in spans), default=0.0))
                out["spans"].append([{"label": a, "start": b, "end": c, "score": d} for a, b, c, d in spans])
            kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))}
            return pa.record_batch({"id": batch.column("id")} | {k: pa.array(out[k], t) for k, t in kinds.items()})

        return look

    d = pick(docs, id=id_col, text=text_col)
    kind = d.schema["id"].dataType.simpleString()
    return map_rows(d, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,score:double>>", "text", make)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
