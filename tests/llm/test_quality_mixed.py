"""Texts that mix content and boilerplate, and the sample that the field is fitted on."""

import random

import pytest

from spendalloc.llm import quality

WORDS = "the river ran past old mills and quiet fields while people walked home slowly under grey evening skies".split()
MENU = ["Home | About | Contact >>", "LOGIN | REGISTER | CART (0)", "## >> click & share <<", "* FAQ * HELP * TERMS *",
        "$$$ SALE 50% $$$ >>", "< prev | 1 | 2 | 3 | next >"]


def prose(r, n):
    return [" ".join(r.choice(WORDS) for _ in range(r.randint(9, 22))).capitalize() + "." for _ in range(n)]


def menu(r, n):
    return r.sample(MENU, n)


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(2)
    texts = ["\n".join(prose(r, r.randint(4, 90)) if i % 2 else [r.choice(MENU) for _ in range(r.randint(3, 80))])
             for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    return texts, labels


def test_footers_and_headers_are_marked(spark, labelled):
    texts, labels = labelled
    r = random.Random(7)
    mixed = []
    for i in range(40):
        a, b = prose(r, r.randint(5, 30)), menu(r, 2 + i % 2)
        lines = a + b if i % 4 < 2 else b + a
        mixed.append(("\n".join(lines), sum(map(len, a)) / sum(map(len, lines))))
    docs = spark.createDataFrame(list(enumerate(texts)) + [(1000 + i, t) for i, (t, _) in enumerate(mixed)],
                                 "doc_id long, text string")
    share = {x["doc_id"]: x["content_share"] for x in quality.quality_rules(docs, labels).collect()}
    assert all(share[i] == i % 2 for i in range(80))
    assert [share[1000 + i] for i in range(40)] == pytest.approx([s for _, s in mixed])


def test_sample_does_not_depend_on_partitions(spark, labelled):
    texts, labels = labelled
    rows = [(i % 10, t) for i, t in enumerate(texts)]
    fits = []
    for parts, order in ((1, 1), (5, -1)):
        docs = spark.createDataFrame(rows[::order], "doc_id long, text string").repartition(parts)
        fits.append(quality.fit(docs, labels, train_docs=6, train_lines=20))
    assert all((a == b).all() for a, b in zip(*fits))


def test_runs_come_from_the_whole_text(spark):
    # Only the tail of the poor documents is unlike the good ones.
    r = random.Random(5)
    texts = ["\n".join(prose(r, 100)) if i % 2 else "\n".join(prose(r, 30) + [r.choice(MENU) for _ in range(300)])
             for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(list(enumerate(texts)) + [(99, "\n".join(MENU * 4))], "doc_id long, text string")
    share = {x["doc_id"]: x["content_share"] for x in quality.quality_rules(docs, labels, train_lines=25).collect()}
    assert share[99] == 0 and all(share[i] == 1 for i in range(1, 40, 2))


def test_chains_without_one_side():
    assert quality.mixed_chains([], []) == quality.mixed_chains([1], []) == ([], [])
