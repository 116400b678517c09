"""Operators whose rows depend on one text at a time, or on line counts, against brute force."""

import hashlib
import re

import public_tokenizers
import pytest

from spendalloc.llm import license_scan, line_dedup, quality, token_counts

from .data import SCHEMA, frame, plain, result, rows


def texts():
    return [(r[0], r[1] or "") for r in rows()]


def test_token_counts_match_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    count = {t: len(lib.encode(t, add_special_tokens=False).ids) for _, t in texts()}
    want = sorted(((i, len(t.encode()), count[t], count[t] > 512) for i, t in texts()), key=repr)
    cache = str(tmp_path / "cache")
    for _ in range(2):  # the second run finds all counts in the cache
        got = token_counts.token_counts(frame(spark), path, cache_path=cache)
        assert result(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t for _, t in texts()})
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA), path).count() == 0


def test_token_counts_of_pieces(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.token_counts(frame(spark), path, limit=3)
    assert result(got, "doc_id", "n_tokens") == sorted(((i, len(lib.encode(t))) for i, t in texts()), key=repr)


def lines_brute(data, min_docs, min_chars, keep):
    strip = " \t\n\x0b\x0c\r"
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(strip))
    holders = {}
    for i, t in data:
        for line in t.split("\n"):
            holders.setdefault(low(line), set()).update({i} - {None})
    gone = {k for k, v in holders.items() if len(v) >= min_docs and len(k) >= min_chars}
    out = []
    for i, t in data:
        kept, had = [], set()
        for line in t.split("\n"):
            k = low(line)
            if k not in gone or (keep == "first" and i == min(holders[k]) and k not in had):
                kept.append(line)
            had.add(k)
        out.append((i, "\n".join(kept), len(t.split("\n")), len(t.split("\n")) - len(kept),
                    hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs,min_chars,keep,bits", [(10, 1, "none", 1 << 28), (2, 5, "first", 1 << 28),
                                                         (2, 0, "none", 1 << 13), (3, 1, "first", 1 << 13)])
def test_line_dedup(spark, min_docs, min_chars, keep, bits):
    got = line_dedup.line_dedup(frame(spark), min_docs, min_chars, keep, max_bits=bits)
    assert result(got, "doc_id", "text", "n_lines", "n_dropped", "kept_sha256") == lines_brute(
        texts(), min_docs, min_chars, keep)
    assert line_dedup.line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def license_brute(t):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    at = [(i, label) for p, label in license_scan.BASE.items() for i in range(len(words))
          if words[i:i + len(p.split())] == p.split()]
    return (len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None),
            ",".join(sorted({x for _, x in at})))


def test_license_base(spark):
    got = result(license_scan.license_scan(frame(spark)), "doc_id", "n_words", "n_base", "first_word", "last_word",
                 "base_labels")
    assert got == sorted(((i, *license_brute(t)) for i, t in texts()), key=repr)
    assert license_scan.license_scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_license_labels(spark):
    docs = plain(spark, [
        "see\nLicensed under the Apache License, Version 2.0.\nend", "Released under the MIT License.",
        "licensed under the GNU General Public License, version 3", "Licensed under CC BY-NC 4.0.",
        "apache version license the 2 licensed 0 under", "the license of the house", None] + ["plain words of text"] * 9)
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.license_scan(docs).collect()}
    assert got[0] == ("apache-2.0", 1.0) and got[1] == ("mit", 1.0)
    assert got[2][0] == "gpl,gpl-3.0" and got[3][0] == "cc-by,cc-by-nc"
    assert got[4] == ("", 0.0) and got[5] == ("", 0.0) and got[6] == ("", 0.0)


def quality_brute(t):
    words = re.findall("[^\x20\x09-\x0d]+", t)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    inside = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)} if len(words) < 500 else \
        set(range(len(words))) if len(set(words)) == 1 else set()
    with_word = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall("[#*$%&|<>]", t)), len(with_word) - len(set(with_word)), len(inside),
            n < 20 or 100 * len(inside) > 30 * n)


def test_quality_base(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (3, None, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality.quality_rules(frame(spark), labels)
    assert result(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                  "base_failed") == sorted(((i, *quality_brute(t)) for i, t in texts()), key=repr)
    assert not [r for r in got.collect() if r["base_failed"] and r["kept"]]
    none = quality.quality_rules(frame(spark), labels.filter("false"))
    assert all(r["kept"] != r["base_failed"] for r in none.collect())
    assert quality.quality_rules(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    g = np.random.default_rng(5)
    for _ in range(30):
        e, t = g.normal(size=(6, 2)), g.normal(size=(2, 2))
        value = lambda p: sum(e[i, s] for i, s in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:]))
        best = max(itertools.product((0, 1), repeat=6), key=value)
        assert tuple(quality.viterbi(e, t)) == best


def test_field_learns_noise_lines(spark):
    good = "\n".join("The tale goes on and people talk of it again number %d." % i for i in range(8))
    bad = "\n".join("BUY!! NOW!! %d | $$$ | ###" % i for i in range(8))
    docs = plain(spark, [good.replace("tale", "tale%d" % i) for i in range(30)] + [bad + str(i) for i in range(30)] + [good, bad])
    labels = spark.createDataFrame([(i, int(i < 30), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["content_share"] for r in quality.quality_rules(docs, labels).collect()}
    assert got[60] > 0.9 and got[61] < 0.1
