"""Small documents that hold every awkward case, and brute-force helpers."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp long, size long, score double, n_tokens long"


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7))) for _ in range(n))


def texts(seed=7):
    rnd = random.Random(seed)
    base = words(rnd, 300)
    near = base.split()
    near[150] = "changed"
    out = [None, "", " ", "\n\t", "one", "Two words", base, base, " ".join(near), base.upper(), words(rnd, 20000),
           "é漢字 \U0001F600 x\x1cy " * 30, "same line\n" * 200, base + " tail", "x" * 5000, "a b c d e f g"]
    return out + [words(rnd, rnd.randrange(1, 400)) for _ in range(40)]


def rows(seed=7):
    out = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t), 5, 6, 7, 0.5, 9)
           for i, t in enumerate(texts(seed))]
    return out + [out[6], out[6], (None, out[8][1], "en", "s1", 3, 5, 6, 7, 0.5, 9), (3, "other text with the id of another row", "en", None, 1, 5, 6, 7, 0.5, 9)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def same_rows(df, expected):
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted((tuple(r) for r in df.collect()), key=key)
    assert got == sorted(expected, key=key)
