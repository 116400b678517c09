"""Decontamination against brute-force subsequences over all passages."""

import random

import numpy as np

from spendalloc.llm import decontaminate as d

from .data import SCHEMA, frame


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_common_subsequence():
    r = random.Random(3)
    for _ in range(200):
        a, b = ([r.choice("abcdef") for _ in range(r.randint(1, 70))] for _ in range(2))
        assert d.common_subsequence(a, b) == plain_lcs(a, b)


def corpus(seed=8):
    r = random.Random(seed)
    common = ["the", "of", "and", "in", "to", "that"]
    vocab = ["v%d" % i for i in range(900)]
    text = lambda n: [r.choice(common) if r.random() < 0.4 else r.choice(vocab) for _ in range(n)]
    items = [text(r.randint(15, 45)) for _ in range(40)]
    docs, leaks = [], set()
    for i in range(240):
        words = text(r.randint(20, 700))
        if i % 4 == 0:
            k = r.randrange(40)
            item = list(items[k])
            if i % 8 == 0:  # a paraphrase: some words changed, some put in
                for _ in range(len(item) // 8):
                    item[r.randrange(len(item))] = r.choice(vocab)
                item.insert(len(item) // 2, "indeed")
            at = r.randrange(len(words))
            words[at:at] = item
            leaks.add((i, k))
        docs.append((i, " ".join(words).capitalize() + "."))
    return docs, [(k, " ".join(w).upper() + ".") for k, w in enumerate(items)], leaks


def test_leaks_are_found_and_clean_documents_left_alone(spark):
    docs, items, leaks = corpus()
    got = d.decontaminate(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                          spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    # Brute force: every passage, every item.
    want = set()
    for i, t in docs:
        words = d.tokens(t)
        for k, q in items:
            q = d.tokens(q)
            for at in range(0, max(1, len(words) - d.HALF), d.HALF):
                part = words[max(0, at - len(q)):at + 2 * d.HALF + len(q)]
                if plain_lcs_fast(q, part) >= 0.75 * len(q):
                    want.add((i, k))
    assert want >= leaks - {p for p in leaks if p not in want} and len(want) >= 0.9 * len(leaks)
    assert len(pairs & want) >= 0.9 * len(want)
    assert pairs <= want | leaks
    in_blocks = d.decontaminate(spark.createDataFrame(docs[:80], "doc_id long, text string"),
                                spark.createDataFrame(items, "item_id long, text string"), block_items=10).collect()
    assert len({(r["doc_id"], r["item_id"]) for r in in_blocks} & want) >= 0.9 * len([p for p in want if p[0] < 80])


def plain_lcs_fast(a, b):
    return d.common_subsequence(a, b)


def test_answers_settle_fair_matches(spark):
    item = "what is the name of the old river that flows past the mill in the town the mersey"
    # Two thirds of the words in order; one text has the answer, the other not.
    near = "what is called the old river flows past a mill in some town {}"
    docs = spark.createDataFrame([(1, near.format("the mersey")), (2, near.format("a thames"))] + [
        (i, "entirely other words number %d stand here and there" % i) for i in range(3, 30)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, item, "mersey"), (1, None, None), (2, "too short", None)],
                                  "item_id long, text string, answer string")
    got = d.decontaminate(docs, bench, answer_col="answer").collect()
    assert [(r["doc_id"], r["item_id"], r["answer_found"]) for r in got] == [(1, 0, True)]


def test_odd_rows(spark):
    bench = spark.createDataFrame([(0, "read more next home beta gamma delta"), (None, "alpha beta gamma delta zeta"),
                                   (5, "")], "item_id long, text string")
    got = d.decontaminate(frame(spark), bench)
    assert got.columns == ["doc_id", "item_id", "cosine", "lcs", "answer_found", "start_word"]
    got.collect()
    assert d.decontaminate(spark.createDataFrame([], SCHEMA), bench).count() == 0
    assert d.decontaminate(frame(spark), bench.filter("false")).count() == 0


def test_space_is_the_singular_space(spark):
    g = np.random.default_rng(1)
    terms = [[int(x) for x in g.choice(20, 6) % (5 + i % 3 * 5)] for i in range(120)]
    idf = np.ones(20)
    a = np.zeros((120, 20))
    for i, t in enumerate(terms):
        f, w = d._weighted(np.array(t), idf)
        a[i, f] = w
    v = d.latent_space(spark.createDataFrame([(t,) for t in terms], "terms array<int>").repartition(3), idf, 4, rounds=4)
    best = np.linalg.svd(a, full_matrices=False)[2][:4]
    assert np.allclose(np.abs(np.linalg.svd(best @ v)[1]), 1, atol=1e-2)


def test_every_verbatim_or_reworded_item_is_found_whatever_the_space(spark):
    """Many items in a space of two dimensions fitted on a few documents; brute force over all passages and items."""
    r = random.Random(12)
    common = ["the", "of", "and", "in", "to", "that"]
    vocab = ["v%d" % i for i in range(400)]
    text = lambda n: [r.choice(common) if r.random() < 0.5 else r.choice(vocab) for _ in range(n)]
    items = [text(r.choice((5, 7, 12, 20, 40, 59, 150))) for _ in range(250)]
    docs = []
    for i in range(120):
        words = text(r.randint(0, 1500))
        for k in r.sample(range(250), 3):
            item = list(items[k])
            if i % 2:
                for _ in range(len(item) // 5):
                    item[r.randrange(len(item))] = "other%d" % r.randrange(99)
            at = r.randrange(len(words) + 1)
            words[at:at] = item
        docs.append((i, " ".join(words)))
    want = set()
    for i, t in docs:
        words = d.tokens(t)
        for k, q in enumerate(items):
            q = [w.encode() for w in q]
            for at in range(len(words) // d.HALF + 1):
                part = words[max(0, at * d.HALF - len(q)):(at + 2) * d.HALF + len(q)]
                here = set(part)
                if sum(w in here for w in q) >= 0.75 * len(q) and plain_lcs_fast(q, part) >= 0.75 * len(q):
                    want.add((i, k))
                    break
    got = d.decontaminate(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                          spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string"),
                          rank=2, fit_docs=5)
    assert len(want) >= 300
    assert {(x["doc_id"], x["item_id"]) for x in got.collect()} == want


def test_short_items_and_scripts_without_spaces(spark):
    cjk = "机器学习模型的训练数据不应该包含测试题目的原文，否则结果没有意义。"
    docs = spark.createDataFrame([
        (1, "前面有很多别的文字" * 9 + cjk[2:] + "后面也有别的文字" * 9), (2, "完全不同的一段文字" * 20),
        (3, "here the golden ratio stands"), (4, "the ratio is golden here"), (5, "一二三四五 はやい 茶色"),
        (6, "はやい 一二三")], "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame([(0, cjk), (1, "Golden ratio!"), (2, "はやい茶色"), (3, "..."), (4, "")],
                                  "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.decontaminate(docs, bench).collect()}
    assert got == {(1, 0), (3, 1), (5, 2)}


def test_cosine_alone_finds_nine_of_ten(spark):
    """Recall of the cosine candidates against brute force, for verbatim and reworded items."""
    docs, items, leaks = corpus(seed=9)
    want = set()
    for i, t in docs:
        words = d.tokens(t)
        for k, q in items:
            q = d.tokens(q)
            if any(plain_lcs_fast(q, words[max(0, at - len(q)):at + 2 * d.HALF + len(q)]) >= 0.75 * len(q)
                   for at in range(0, max(1, len(words) - d.HALF), d.HALF)):
                want.add((i, k))
    got = d.decontaminate(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                          spark.createDataFrame(items, "item_id long, text string"), complete=False).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert len(want & leaks) >= 0.9 * len(leaks)
    assert len(found & want) >= 0.9 * len(want) and found <= want | leaks


def test_far_paraphrases_need_the_cosine_and_the_answer(spark):
    """Half of an item's words in order, all of them there: a leak only by the cosine, and only with the answer."""
    r = random.Random(5)
    vocab = ["w%d" % i for i in range(600)]
    items = [r.sample(vocab, 24) for _ in range(30)]
    q = items[0]
    turned = q[12:22] + q[:12]  # two halves that changed places: a subsequence of 12 or 14 of 24
    docs = [(1, " ".join(turned + ["zz"] + q[22:])), (2, " ".join(turned))] + [
        (i, " ".join(r.choice(vocab) for _ in range(300))) for i in range(3, 60)]
    bench = [(k, " ".join(w), " ".join(w[22:])) for k, w in enumerate(items)]

    def found(**more):
        return {(x["doc_id"], x["item_id"]) for x in d.decontaminate(
            spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(bench, "item_id long, text string, answer string"), answer_col="answer", **more).collect()}
    assert found() == {(1, 0)}
    assert found(min_cosine=2.0) == set()


def test_the_space_is_fitted_on_passages_of_all_documents(spark, monkeypatch):
    seen = []
    fit = d.latent_space
    monkeypatch.setattr(d, "latent_space", lambda passages, *more: seen.append(passages.count()) or fit(passages, *more))
    docs = spark.range(7000).selectExpr("id AS doc_id", "concat('alpha beta ', id % 7, ' gamma') AS text").repartition(2)
    items = [(0, "alpha beta gamma delta epsilon zeta"), (1, "gamma of the alpha and the beta")]
    d.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), rank=2)
    assert seen == [7000 + len(items)]
