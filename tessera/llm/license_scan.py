"""License scan by a positional rare-token index.

Licence words are ranked by their rarity over the whole corpus. Of each template whose mandatory words a
file holds, the rarest few of these words are looked up in an index word -> (template, position); places of
the file vote for (template, start), and starts that all of them agree on are verified: every mandatory key
phrase of the template must stand where the template has it. As a notice holds all mandatory words in their
places, no other licence in the file, however rare its words, can take one away. A template without
mandatory phrases is looked up by all its words.

Defined results: a null or empty text has no words, no place and score 0; ties in rarity go to the
smaller word; repeated rows are scanned each on its own; an empty table gives an empty result; extra
columns of the input, whatever their names, are not looked at. Texts are scanned whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.support import as_bytes, slices, tidy

#: Bytes of text that a task takes at a time (about).
SLICE = 4 << 20

_MAP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def scan_words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased words of ASCII letters, digits and all characters beyond ASCII."""
    return text.translate(_MAP).split() if text else []


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Every one of these must stand at the template's own relative position.
    mandatory: tuple[str, ...]


@dataclass(frozen=True)
class Phrase:
    """A phrase that counts wherever its words stand consecutively."""

    text: str
    label: str


PHRASES = (Phrase("under the mit license", "mit"), Phrase("apache license version 2", "apache-2"), Phrase("cc by nc", "cc-by-nc"))

#: Short notices as licences word them.
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "licensed under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("hereby granted free of charge", "any person obtaining a copy")),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    Template("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("lgpl-3", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license", "version 3")),
    Template("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license", "version 3")),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee is hereby granted",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0 universal",)),
    Template("epl-2", "made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
)


class Index:
    """word -> [(template, position)], with each word's rarity."""

    def __init__(self, templates: tuple[Template, ...], phrases: tuple[Phrase, ...], keep: int, least_aligned: int, least_cover: float):
        self.templates, self.phrases, self.keep, self.least_aligned, self.least_cover = templates, phrases, keep, least_aligned, least_cover
        self.words = [t.text.encode().split() for t in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for k, words in enumerate(self.words):
            for p, w in enumerate(words):
                self.postings.setdefault(w, []).append((k, p))
        self.mandatory = [[(self._place(words, m.encode().split()), m.encode().split()) for m in t.mandatory] for t, words in zip(templates, self.words, strict=True)]
        self.vocabulary = frozenset(self.postings) | {w.encode() for p in phrases for w in p.text.split()}
        self.idf: dict[bytes, float] = dict.fromkeys(self.vocabulary, 1.0)
        self.phrase_words = [p.text.encode().split() for p in phrases]
        self.needs = [frozenset(w for _, m in mandatory for w in m) for mandatory in self.mandatory]
        self.phrase_needs = [frozenset(p) for p in self.phrase_words]
        self._rank()

    @staticmethod
    def _place(words: list[bytes], phrase: list[bytes]) -> int:
        for i in range(len(words) - len(phrase) + 1):
            if words[i : i + len(phrase)] == phrase:
                return i
        raise ValueError(f"mandatory phrase {b' '.join(phrase)!r} is not in its template")

    def _rank(self) -> None:
        self.anchors = [max(range(len(p)), key=lambda i: (self.idf[p[i]], -i)) for p in self.phrase_words]
        self.lookups = []
        for words, mandatory in zip(self.words, self.mandatory, strict=True):
            held = {p + i for p, m in mandatory for i in range(len(m))}
            rarest = sorted(held, key=lambda p: (-self.idf[words[p]], words[p], p))[: max(1, self.keep)]
            self.lookups.append([(words[p], p) for p in rarest or range(len(words))])
        self.weight = [sum(self.idf[w] for w in words) for words in self.words]

    def rarities(self, files: int, with_word: dict[bytes, int]) -> None:
        self.idf = {w: math.log((files + 1) / (with_word.get(w, 0) + 1)) + 1e-6 for w in self.vocabulary}
        self._rank()

    def scan(self, text: bytes | None) -> tuple:
        """n_words, places of phrases (start, phrase), verified (template, start, cover)."""
        words = scan_words(text)
        present = self.vocabulary.intersection(words)
        postings: dict[bytes, list[tuple[int, int]]] = {}
        for k, need in enumerate(self.needs):
            if need <= present:
                for w, p in self.lookups[k]:
                    postings.setdefault(w, []).append((k, p))
        live = [k for k, need in enumerate(self.phrase_needs) if need <= present]
        wanted = present & (postings.keys() | {self.phrase_words[k][self.anchors[k]] for k in live})
        if not wanted:
            return len(words), [], []
        places = [(i, w) for i, w in enumerate(words) if w in wanted]
        base = []
        for k in live:
            phrase, a = self.phrase_words[k], self.anchors[k]
            base += [(i - a, k) for i, w in places if w == phrase[a] and i >= a and words[i - a : i - a + len(phrase)] == phrase]
        votes: Counter = Counter()
        for i, w in places:
            for k, p in postings.get(w, ()):
                votes[k, i - p] += 1  # a start before the text: a notice without its first words
        found = []
        for (k, start), n in votes.items():
            template = self.words[k]
            least = min(self.least_aligned, len(template))
            if n < (len(self.lookups[k]) if self.needs[k] else least):
                continue
            if any(start + p < 0 or words[start + p : start + p + len(m)] != m for p, m in self.mandatory[k]):
                continue
            lo, hi = max(0, -start), min(len(template), len(words) - start)
            aligned = [template[p] for p in range(lo, hi) if words[start + p] == template[p]]
            cover = sum(self.idf[w] for w in aligned) / self.weight[k]
            if len(aligned) >= least and cover >= self.least_cover:
                found.append((k, max(0, start), min(1.0, cover)))
        return len(words), sorted(base), sorted(found)


def _rarities(docs: DataFrame, text: str, index: Index) -> None:
    """Number of files holding each licence word, over all files. The result is bounded by the templates' vocabulary."""
    vocabulary = index.vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        files = 0
        for b in batches:
            files += b.num_rows
            for at, n in slices(b.column(0), SLICE):
                for t in as_bytes(b.column(0).slice(at, n)):
                    seen.update(vocabulary.intersection(scan_words(t)))
        yield pa.RecordBatch.from_pydict({"w": pa.array(["", *(w.decode() for w in seen)]), "n": pa.array([files, *seen.values()], pa.int64())})

    rows = docs.select(F.col(text).alias("t")).mapInArrow(tidy(count), "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    got = {r.w.encode(): r.n for r in rows}
    index.rarities(got.pop(b"", 0), got)


SCHEMA = (
    "doc_id long, n_words long, places array<struct<word:long,label:string>>, "
    "notices array<struct<word:long,label:string,template:int,cover:double>>"
)


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES, phrases: tuple[Phrase, ...] = PHRASES, keep: int = 8, least_aligned: int = 2, least_cover: float = 0.6) -> DataFrame:
    """One row per file: its phrase places and its verified licence notices (start word, label, cover).

    keep: how many of a template's rarest mandatory words are looked up; it changes the work, not the result.
    least_aligned: words that must agree on a start. least_cover: share of the template, weighted by rarity, that must match.
    """
    index = Index(templates, phrases, keep, least_aligned, least_cover)
    _rarities(docs, text, index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = [pa.int64(), pa.int64(), pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())])), pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("template", pa.int32()), ("cover", pa.float64())]))]
        for b in batches:
            n, base, found = [], [], []
            for t in (t for at, k in slices(b.column(1), SLICE) for t in as_bytes(b.column(1).slice(at, k))):
                a, p, f = index.scan(t)
                n.append(a)
                base.append([{"word": i, "label": index.phrases[k].label} for i, k in p])
                found.append([{"word": i, "label": index.templates[k].label, "template": k, "cover": c} for k, i, c in f])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, kind[1]), pa.array(base, kind[2]), pa.array(found, kind[3])], names=["doc_id", "n_words", "places", "notices"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(scan), SCHEMA)


def license_digest(scanned: DataFrame) -> DataFrame:
    """The flat columns of the registered query, from scan_licenses' rows."""
    starts = F.transform("places", lambda p: p["word"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    both = F.array_sort(F.array_distinct(F.concat(F.transform("places", lambda p: p["label"]), F.transform("notices", lambda p: p["label"]))))
    cover = F.coalesce(F.array_max(F.transform("notices", lambda p: p["cover"])), F.lit(0.0))
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), F.when(F.size("places") > 0, F.lit(1.0)).otherwise(cover).alias("score"),
    )
