"""Licence scan with a positional index of rare words.

Document frequencies of all words that licence templates use are counted over
the whole table. Each file looks up its licence words that are rare enough: at
least as rare as some template's rarest word, so that no template is without a
looked-up word. Each posting (template, place) of a found word votes for the
offset at which the template would start; offsets with votes are checked word
by word, and a template counts only where all its mandatory phrases stand too.

Words are A-Z lower-cased runs of letters, digits and bytes beyond ASCII. Null
and empty texts have no words, no labels and score 0. Repeated rows each get a
row; an empty table gives an empty result; extra columns are ignored."""

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_text, table

_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))

# Phrases whose places are counted, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Label, usual wording, mandatory phrases.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     ("permission is hereby granted", "free of charge")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license", "version 3")),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license", "version 2")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ("redistribution and use", "source and binary forms")),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license",
     ("creative commons attribution 4 0",)),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ("free and unencumbered software", "public domain")),
)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD).split()


class _Index:
    def __init__(self, templates, df: dict, n_docs: int, min_cover: float, slack: int):
        self.templates = [(label, w.encode().split(), [k.encode() for k in keys]) for label, w, keys in templates]
        self.min_cover, self.slack = min_cover, slack
        idf = {w: math.log((n_docs + 1) / (df.get(w.decode(), 0) + 1)) + 1 for _, ws, _ in self.templates for w in ws}
        # A word as rare as the rarest of any template is looked up; commoner words would only add votes.
        floor = min(max(idf[w] for w in ws) for _, ws, _ in self.templates)
        self.idf = {w: v for w, v in idf.items() if v >= floor}
        self.postings = defaultdict(list)
        for t, (_, ws, _) in enumerate(self.templates):
            for p, w in enumerate(ws):
                if w in self.idf:
                    self.postings[w].append((t, p))
        self.base = [(re.compile(b"(?<= )" + re.escape(p.encode()) + b"(?= )"), p.encode(), label)
                     for p, label in BASE.items()]

    def labels(self, words: list[bytes]) -> dict[str, float]:
        """Label -> share of the template's words that stand in place, for verified templates."""
        found = {}
        if not self.postings.keys() & set(words):
            return found
        votes = Counter()
        for i, w in enumerate(words):
            for t, p in self.postings.get(w, ()):
                votes[t, i - p] += self.idf[w]
        for (t, at), _ in votes.most_common():
            label, ws, keys = self.templates[t]
            lo, hi = max(0, at - self.slack), at + len(ws) + self.slack
            here = words[lo:hi]
            near = lambda p: here[max(0, at + p - 2 - lo):max(0, at + p + 3 - lo)]
            cover = sum(w in near(p) for p, w in enumerate(ws)) / len(ws)
            if cover >= self.min_cover and cover > found.get(label, 0):
                passage = b" " + b" ".join(here) + b" "
                if all(b" " + k + b" " in passage for k in keys):
                    found[label] = cover
        return found

    def scan(self, text: str):
        words = words_of(text)
        found = self.labels(words)
        joined = b" " + b" ".join(words) + b" "
        n, first, last, base = 0, None, None, set()
        for pattern, phrase, label in self.base:
            if phrase in joined:
                at = [m.start() for m in pattern.finditer(joined)]
                if at:
                    # The number of spaces before a word, less the one in front of the text, is its place.
                    ends = [joined.count(b" ", 0, a) - 1 for a in (at[0], at[-1])]
                    n, base = n + len(at), base | {label}
                    first = ends[0] if first is None else min(first, ends[0])
                    last = ends[1] if last is None else max(last, ends[1])
        score = 1.0 if base else max(found.values(), default=0.0)
        return (len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(base | set(found))), score)


def _frequencies(vocabulary):
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        seen = Counter()
        for b in cut(batches):
            for t in b.column("text").to_pylist():
                seen.update(vocabulary.intersection(words_of(t)))
        yield table(schema, word=[w.decode() for w in seen], n=list(seen.values()))
    return run


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()),
                     ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
                     ("labels", pa.string()), ("score", pa.float64())])


def license_scan(docs: DataFrame, templates=TEMPLATES, min_cover: float = 0.6, slack: int = 6,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    `min_cover` is the share of a template's words that must stand within two
    places of where the offset puts them; `slack` the words around a match in
    which mandatory phrases may stand. A base phrase scores 1."""
    d = id_text(docs, id_col, text_col)
    vocabulary = frozenset(w for _, ws, _ in templates for w in ws.encode().split())
    # As many rows as templates have words, whatever the size of the table.
    n_docs = d.count()
    counts = d.mapInArrow(_frequencies(vocabulary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    df = {r["word"]: r["n"] for r in counts.collect()}

    def run(batches):
        index = _Index(templates, df, n_docs, min_cover, slack)
        for b in cut(batches):
            rows = [index.scan(t) for t in b.column("text").to_pylist()]
            yield table(_SCHEMA, doc_id=b.column("doc_id"),
                        **{f.name: list(c) for f, c in zip(list(_SCHEMA)[1:], zip(*rows))})

    return d.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                             "base_labels string, labels string, score double")
