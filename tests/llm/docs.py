"""Small tables for the tests of the training-data operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 long, row string, id long, open int"


def words(rng, n, letters="abcdehilnorst"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n)]


def texts():
    """Texts of every awkward kind: null, empty, blank, copies, near-copies, ties, long, other scripts."""
    rng = random.Random(5)
    body = words(rng, 120)
    near = body.copy()
    near[60] = "changed"
    shared = "A passage that many documents share, word for word."
    out = [None, "", " ", "\n\n \t\n", "one", "Two words", " ".join(body), " ".join(body), " ".join(near), "x" * 3000]
    out += [f"{' '.join(words(rng, 30))}\n{shared if i % 2 else '  ' + shared.upper() + chr(9)}\n{' '.join(words(rng, 5))}" for i in range(14)]
    out += ["Ünïcode ıſK\u00a0text　here 123 你好 мир \U0001f600 'll don't", "tab\tand\r\nline  double \x0b\x0c \x1c end ", " ".join(words(rng, 20000))]
    out += ["the same line\n" * 5 + "more words to make up ten or so of them here", "a b c d e " * 6 + " ".join(words(rng, 12))]
    out += [" | ".join(words(rng, 40)), "# * $ % & | < >" * 3]
    return out


def rows():
    out = [(i, t, ["en", "de", None][i % 3], "s", len(t or ""), i, "r", 9, 1) for i, t in enumerate(texts())]
    return [*out, (None, "a row without an id and with words enough", None, None, None, None, None, None, None), out[6]]


def table(spark, given=None):
    return spark.createDataFrame(rows() if given is None else given, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
