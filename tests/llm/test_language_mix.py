"""Language mixtures against a plain estimation, odd rows, ties and held-out labels."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spendalloc.llm.language_mix import BUCKETS, has_letter, language_mix

from .data import SCHEMA, frame, plain, rows

SOUNDS = {"aa": "ka lo mi tu ra ne so".split(), "bb": "schr bla ung keit wor ter".split(),
          "cc": "qui eau oix mme ette ille".split()}


def text(r, lang, n):
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def grams(t):
    """Hashed trigrams of a text, letter by letter."""
    raw = t.lower().encode("utf-8", "surrogatepass")
    raw = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in raw)
    raw = b" " + b" ".join(raw.split()) + b" "
    out = Counter()
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        out[((a * 65599 * 65599 + b * 65599 + c) * 2654435761 % (1 << 32)) >> 18] += 1
    return out


def estimate(counts, probs, langs, rounds):
    """Shares of `langs` by expectation-maximisation, and the log-likelihood."""
    share = {x: 1 / len(langs) for x in langs}
    total = sum(counts.values())
    for _ in range(rounds):
        new = dict.fromkeys(langs, 0.0)
        for g, n in counts.items():
            mass = {x: probs[x][g] * share[x] for x in langs}
            for x in langs:
                new[x] += n * mass[x] / sum(mass.values())
        share = {x: v / total for x, v in new.items()}
    return share, sum(n * math.log(sum(probs[x][g] * share[x] for x in langs)) for g, n in counts.items())


def brute(t, probs, rounds=12, penalty=3.0):
    langs, counts = sorted(probs), grams(t)
    alone = {x: estimate(counts, probs, [x], 0)[1] for x in langs}
    first = max(langs, key=lambda x: alone[x])
    every, _ = estimate(counts, probs, langs, rounds)
    order = [first] + sorted((x for x in langs if x != first), key=lambda x: -every[x])
    best, value = {first: 1.0}, alone[first]
    for k in range(2, len(langs) + 1):
        share, like = estimate(counts, probs, order[:k], rounds)
        like -= penalty * (k - 1) * math.log(max(sum(counts.values()), 2))
        if like <= value:
            break
        best, value = share, like
    return best


@pytest.fixture(scope="module")
def learned():
    r = random.Random(6)
    return [(i, text(r, lang, r.randint(5, 40)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 15)]


def test_mixture_as_estimated_plainly(spark, learned):
    r = random.Random(8)
    probe = [text(r, a, r.randint(1, 60)) + " " + text(r, b, r.randint(1, 60))
             for a in SOUNDS for b in SOUNDS for _ in range(3)] + ["k", "é", "ka 12", "日本語", text(r, "aa", 4000)]
    probs = {}
    for lang in SOUNDS:
        seen = sum((grams(t) for _, t, x in learned if x == lang), Counter())
        total = sum(seen.values()) + 0.5 * BUCKETS
        probs[lang] = [(seen[g] + 0.5) / total for g in range(BUCKETS)]
    docs = spark.createDataFrame(learned + [(1000 + i, t, None) for i, t in enumerate(probe)],
                                 "doc_id long, text string, lang string").repartition(3)
    got = {x["doc_id"]: x for x in language_mix(docs, train_docs=10**6).collect()}
    n_mixed = 0
    for i, t in enumerate(probe):
        want = brute(t, probs)
        row = got[1000 + i]
        mine = {p.split(":")[0]: float(p.split(":")[1]) for p in row["mixture"].split()}
        assert mine == pytest.approx({x: s for x, s in want.items() if s > 0}, abs=6e-4), t[:60]
        assert row["score"] == pytest.approx(max(want.values()), abs=1e-9)
        assert want[row["lang_pred"]] == pytest.approx(row["score"], abs=1e-9)
        n_mixed += len(mine) > 1
    assert n_mixed > 5


def test_odd_rows(spark):
    got = language_mix(frame(spark)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted(
        (i is None, i or 0) for i, *_ in rows())
    text_of = {i: t for i, t, *_ in rows() if i is not None and i > 10}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "fr", "und")
        if r["doc_id"] in text_of:
            assert (r["lang_pred"] == "und") == (not has_letter(text_of[r["doc_id"]]))
    assert language_mix(spark.createDataFrame([], SCHEMA)).count() == 0
    none = language_mix(plain(spark, ["abc", None]).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert [(r["lang_pred"], r["score"], r["mixture"]) for r in none] == [("und", 0.0, "")] * 2


def test_no_language_is_dropped(spark):
    r = random.Random(1)
    sounds = {f"l{i:03d}": [chr(97 + i % 26) + chr(97 + i // 26) + x for x in ("ra", "mo", "ti")] for i in range(300)}
    docs = spark.createDataFrame([(i, " ".join(r.choice(s) for _ in range(60)), lang)
                                  for i, (lang, s) in enumerate(sounds.items())], "doc_id long, text string, lang string")
    got = {x["doc_id"]: x["lang_pred"] for x in language_mix(docs.repartition(2), train_docs=10**6).collect()}
    assert [got[i] for i in range(300)] == list(sounds)
    with pytest.raises(ValueError):
        language_mix(docs, max_langs=299)


def test_tie_goes_to_the_first_name(spark):
    same = [(i, "same words for both", lang) for i, lang in enumerate(["zz", "bb", "zz", "bb"])]
    docs = spark.createDataFrame(same + [(9, "same words", None)], "doc_id long, text string, lang string")
    got = language_mix(docs, train_docs=10**6).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("bb", 1.0)}


def test_held_out_labels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    want = {r["doc_id"]: r["lang"] for r in docs.filter(held & F.col("lang").isNotNull()).collect()
            if has_letter(r["text"])}
    assert zlib.crc32(b"1") == spark.range(1).select(F.crc32(F.lit("1"))).first()[0]
    got = {r["doc_id"]: r["lang_pred"] for r in language_mix(docs, train=~held).collect()}
    assert sum(got[i] == x for i, x in want.items()) >= 0.95 * len(want) and len(want) > 20
