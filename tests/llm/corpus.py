"""Small awkward corpora for the tests of the training-data operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, KEY string, _order long, spans string"


def texts(seed=1, n=40):
    """Random documents with copies, near copies, shared passages, repeats, blanks and one long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]

    def words(k):
        return [rng.choice(vocabulary) for _ in range(k)]

    passage = " ".join(words(60))
    out = [" ".join(words(rng.randint(5, 120))) for _ in range(n)]
    for i in range(0, n, 5):
        out[i] = " ".join(words(20)) + "\n" + passage + "  " + " ".join(words(15))
    out[7] = out[3]
    near = out[4].split(" ")
    near[2] = "changed"
    out[9] = " ".join(near)
    out[11] = "x " * 400
    out[12] = "same line here\n" * 30
    out[13] = "".join(rng.choice("ab") for _ in range(700))
    return [*out, " ".join(words(4000)), "", None, " \n\t", "one", "a" * 500]


def rows(seed=1, n=40):
    """With a null id, one row given twice, and one id with two texts."""
    found = list(enumerate(texts(seed, n)))
    return [*found, (None, found[2][1]), (None, "only here " * 12), found[5], (6, "another text under a known id " * 4)]


def frame(spark, data):
    """Extra columns have names that the operators use themselves."""
    full = [(i, t, "en", "s", None if t is None else len(t), 1, "k", 2, "z") for i, t in data]
    return spark.createDataFrame(full, SCHEMA)
