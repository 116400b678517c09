"""The pipeline's stages against brute force on their own input, and the whole run."""

import random
import re

import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(seed=3):
    r = random.Random(seed)
    words = {"en": ["the", "water", "house", "thing", "which", "with", "that", "night", "through", "word"],
             "fr": ["le", "maison", "quelque", "eau", "était", "nuit", "mots", "aussi", "travers", "chose"]}
    rare = {k: [a + b for a in v for b in v] for k, v in words.items()}
    make = lambda k, n: [r.choice(words[k]) if r.random() < 0.3 else r.choice(rare[k]) for _ in range(n)]
    line = lambda k, n=12: " ".join(make(k, n))
    bench = [line("en", 25) for _ in range(5)]
    texts, kinds = [], []

    def add(kind, k, text):
        texts.append((text, k))
        kinds.append(kind)
    for i in range(80):
        k = "en" if i % 3 else "fr"
        add("clean", k, "\n".join(line(k) for _ in range(r.randint(2, 9))))
    for i in range(12):
        body = [line("en") for _ in range(4)]
        add("footer", "en", "\n".join(body + ["Read more: the next thing"]))
    for i in range(6):
        base = make("en", 120)
        add("head", "en", " ".join(base))
        for _ in range(3):
            near = list(base)
            near[r.randrange(len(near))] = "changed%d" % r.randrange(99)
            add("near", "en", " ".join(near))
    for i in range(5):
        add("leak", "en", line("en", 40) + "\n" + bench[i].upper() + ".\n" + line("en", 40))
    for t in ("", "12 34 !!", None, "\n\n"):
        add("und", "en", t)
    return [(i, t, k, "s", len(t or "")) for i, (t, k) in enumerate(texts)], kinds, list(enumerate(bench))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows, kinds, bench = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, kinds


def test_each_stage_keeps_clean_documents_and_acts_on_the_others(spark, tables):
    path, rows, kinds = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()} if "text" in docs.columns else {}
        docs = corpus_pipeline.stash(stage(spark, docs, path), name)
        if name != "packing":
            assert docs.columns == COLUMNS
        seen[name] = (before, docs.collect())
    of = lambda kind: {i for i, k in enumerate(kinds) if k == kind}
    ids = {name: {r["doc_id"] for r in after} for name, (_, after) in seen.items()}
    assert ids["language_id"] == set(range(len(rows))) - of("und")
    # Lines: exactly those of brute force are gone.
    before, after = seen["line_dedup"]
    holders = {}
    for i, r in before.items():
        for line in r["text"].split("\n"):
            holders.setdefault(line.strip().lower(), set()).add(i)
    for r in after:
        want = [x for x in before[r["doc_id"]]["text"].split("\n")
                if len(holders[x.strip().lower()]) < 10 or r["doc_id"] == min(holders[x.strip().lower()])]
        assert r["text"] == "\n".join(want) and r["n_chars"] == len(r["text"])
    assert ids["line_dedup"] == ids["language_id"]
    # Near copies: the smallest document of each component of brute force.
    before, after = seen["near_duplicates"]
    sets = {}
    for i, r in before.items():
        w = re.findall(r"\S+", r["text"].lower())
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
        if all(root[root[i]] == root[i] for i in root):
            break
    assert ids["near_duplicates"] == {i for i in sets if root[i] == i}
    assert ids["near_duplicates"] == ids["line_dedup"] - of("near")
    assert ids["decontaminate"] == ids["near_duplicates"] - of("leak")
    # Packing: all tokens of all documents that were left.
    before, after = seen["packing"]
    assert ids["packing"] == ids["decontaminate"]
    library = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    size = {i: len(library.encode(r["text"], add_special_tokens=False).ids) for i, r in before.items()}
    got = {}
    for r in after:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        assert r["bin_offset"] + r["length"] <= r["bin_used"] <= r["bin_capacity"]
    assert got == size


def test_columns_named_like_those_of_an_operator_stay(spark, tables):
    path, rows, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "'mine' AS score", "1 AS lang_pred")
    kept = corpus_pipeline.language_id(spark, docs, path)
    assert kept.columns == docs.columns
    assert {(r["score"], r["lang_pred"]) for r in kept.collect()} == {("mine", 1)}


def test_run_is_registered_and_gives_the_last_stage(spark, tables):
    import __spark_entry__

    got = __spark_entry__.queries()["pipeline"](spark, tables[0])
    assert "bin_id" in got.columns and got.count() > 0
    assert "pipeline" not in __spark_entry__.oracle_sql()


def test_empty_documents(spark, tables, tmp_path):
    empty = spark.read.parquet(f"{tables[0]}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, tables[0]).count() == 0
