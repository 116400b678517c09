"""The set join against all pairs, and components against a plain search."""

import random
import re

from spendalloc.llm import set_join
from spendalloc.llm.components import components

from .data import SCHEMA, frame, result, rows


def brute(data, width=4, percent=85):
    sets = []
    for _, t in data:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else
                    {tuple(w)} if w else set())
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(data):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(data)), key=repr)


def test_odd_rows(spark):
    got = set_join.similar_components(frame(spark), 4, 85)
    assert result(got, "doc_id", "n_shingles", "component_id") == brute([(r[0], r[1]) for r in rows()])
    assert set_join.similar_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chains_and_groups_of_near_copies(spark):
    r = random.Random(11)
    vocab = ["t%d" % i for i in range(300)]
    passage = [r.choice(vocab) for _ in range(60)]
    texts = []
    for g in range(6):
        base = [r.choice(vocab) for _ in range(r.choice((30, 80, 150)))]
        now = base
        for k in range(25):
            # Half are altered copies of the base, half make a chain.
            now = list(now if k % 2 else base)
            for _ in range(r.randint(0, 3)):
                now[r.randrange(len(now))] = r.choice(vocab)
            texts.append(" ".join(now))
    texts += [" ".join(passage + [r.choice(vocab) for _ in range(40)]) for _ in range(60)]
    r.shuffle(texts)
    data = [(i * 3, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    for percent in (85, 70):
        got = set_join.similar_components(docs, 4, percent, max_bits=1 << 13, max_common=50)
        assert result(got, "doc_id", "n_shingles", "component_id") == brute(data, percent=percent)


def test_whole_sets_meet_only_where_prefixes_allow_a_link(spark, monkeypatch):
    r = random.Random(4)
    word = lambda: "w%d" % r.randrange(10 ** 6)
    passage = [word() for _ in range(60)]
    # Sixty texts share a passage but are not alike; six are near copies of one of them.
    texts = [[word() for _ in range(60)] + passage + [word() for _ in range(60)] for _ in range(60)]
    texts += [texts[0][:k * 20] + [word()] + texts[0][k * 20 + 1:] for k in range(6)]
    data = [(i, " ".join(t)) for i, t in enumerate(texts)]
    compared, held, sketched = [], [], set_join._sketch
    compare = set_join._compare
    monkeypatch.setattr(set_join, "_compare", lambda pairs, *a: compared.append(pairs.count()) or compare(pairs, *a))
    monkeypatch.setattr(set_join, "_sketch", lambda *a: held.append(a[4:]) or sketched(*a))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    for bits in (1 << 20, 1 << 13):
        got = set_join.similar_components(docs, 4, 85, max_bits=bits)
        assert result(got, "doc_id", "n_shingles", "component_id") == brute(data)
    # Far fewer shingles than bits: all go into the filter. More: a part that it can tell apart, one place each.
    (part, places), (less, place) = held
    assert (part, places) == (1, 2) and 0 < less < 1 and place == 1
    assert sum(compared) < 60


def test_prefixes_keep_all_pairs_that_link(spark):
    r = random.Random(5)
    rows, sets = [], []
    for i in range(60):
        base = sets[r.randrange(i)][0] if i and r.random() < .7 else {r.randrange(4000) for _ in range(r.randint(1, 90))}
        s = set(base)
        for _ in range(r.randint(0, 12)):
            s ^= {r.randrange(4000)}
        n = len(s)
        sets.append((s, n))
        rows.append((i, sorted(s)[:n - (85 * n + 99) // 100 + 1 if n else 0]))
    pairs = [(i, sets[i][1], j, sets[j][1]) for i in range(60) for j in range(60) if i != j and sets[i][1] and sets[j][1]]
    got = set_join._prefixes_allow(spark.createDataFrame(pairs, "sid long, n long, pivot long, pn long"),
                                   spark.createDataFrame(rows, "sid long, prefix array<long>"), 85)
    got = {(x["sid"], x["pivot"]) for x in got.collect()}
    links = {(i, j) for i, _, j, _ in pairs if 100 * len(sets[i][0] & sets[j][0]) >= 85 * len(sets[i][0] | sets[j][0])}
    assert links and links <= got < {(i, j) for i, _, j, _ in pairs}


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 360)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert result(got, "node", "root") == sorted(((a, b) for a, b in root.items() if any(
        a in e and e[0] != e[1] for e in edges)), key=repr)
