"""Small tables with the awkward cases that every corpus operator has to take."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id long, t string, key long, n long, "
          "node long, label long, shard int, bucket long, line string, q long, part int, `class` int, words long, score double")


def prose(n, seed, vocab=400):
    r = random.Random(seed)
    v = ["".join(r2.choice("abcdefghijklmnop") for _ in range(r2.randint(2, 8))) for r2 in [random.Random(7)] for _ in range(vocab)]
    return " ".join(r.choice(v) for _ in range(n))


def rows():
    long = prose(30_000, 1)
    base = prose(200, 2)
    near = base.split()
    near[50] = "changed"
    run = "\n".join(prose(30, s) for s in (11, 12, 13))
    texts = [
        (1, base), (2, " ".join(near)), (3, base), (3, base),          # copies, near copy, repeated row
        (4, None), (5, ""), (6, " \n \t\n"), (7, "one two"), (8, "One TWO"), (9, "!!! 123 ..."),
        (10, long), (11, "x" * 200_000),                               # very long text, very long word
        (12, "intro line\n" + run + "\nlast"), (13, "other\n" + run), (14, run),
        (None, base), (None, None), (None, "null id only here"),
        (15, "é ü ñ ç w v \U0001f600 end"), (16, prose(60, 3)), (16, prose(60, 4)),
    ]
    return [(i, x, "en" if k % 2 else None, f"s{k % 3}", len(x) if x is not None else None,
             None, "clash", 5, None, 1, 2, 3, None, "c", 7, 0, 1, None, 0.5) for k, (i, x) in enumerate(texts)]


def edge_docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
