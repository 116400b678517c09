"""Small tables with every odd case that the operators must stand."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n_tokens long, key binary, words string, "
          "_text string, _id long")


def rows(n=60, seed=1):
    r = random.Random(seed)
    vocab = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "Eta", "theta", "iota", "kappa"] + [
        "w%d" % i for i in range(80)]
    line = lambda: " ".join(r.choice(vocab) for _ in range(r.randint(3, 14)))
    shared = ["  Shared Line one here ", "shared line ONE here", "read more | next | home"]
    texts = ["\n".join(r.choice(shared) if r.random() < 0.3 else line() for _ in range(r.randint(1, 12)))
             for _ in range(n)]
    texts[3] = texts[4] = texts[5]
    texts[6] = texts[5] + " one more"
    texts += [None, "", " ", "\n\n", "x", "é" * 60, "a b c", "word " * 3000, "Ünï çødé 日本語 text\t with tabs\r\n",
              "<|endoftext|> inside # $ %", "Licensed under CC BY-NC 4.0.\nAll rights reserved.",
              "under the GNU General Public License, version 3", "z" * 70000, "\U0001F600 emoji \U0001F600"]
    out = [(i, t) for i, t in enumerate(texts)]
    out += [(7, texts[7]), (None, texts[8]), (None, None), (8, "another text with the id of eight")]
    return [(i, t, ("en", "fr", None)[k % 3], "s", 1, 2, b"k", "clash", "clash", 9) for k, (i, t) in enumerate(out)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def plain(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t) for i, t in enumerate(texts)], "doc_id long, text string")


def result(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
