"""Documents of every odd kind: nulls, empty and very long texts, ties, repeated rows, columns whose names clash with results."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row long, blob string, node long, slot long, removed string, digest string"
FOOT = "This Footer line stands below every page of the site and is the same   everywhere"


def rows(docs):
    """docs: (doc_id, text, lang, source)."""
    return [(i, t, lang, s, None if t is None else len(t), None, 7, "x", None, -1, "r", "d") for i, t, lang, s in docs]


def words(rnd, n, alphabet="abcdefgh"):
    return " ".join("".join(rnd.choice(alphabet) for _ in range(rnd.randint(2, 7))) for _ in range(n))


def documents(seed=1):
    rnd = random.Random(seed)
    docs = []
    for k in range(120):
        text = "\n".join(words(rnd, rnd.randint(5, 40)) for _ in range(rnd.randint(1, 5)))
        if k % 3 == 0:
            text += "\n" + FOOT.replace("page", "PAGE" if k % 2 else "page")
        docs.append((k, text, ["en", "fr", None][k % 3], ["a", "b", None, "hot", "hot", "hot"][k % 6]))
    docs += [(200 + k, docs[3][1], "en", "hot") for k in range(5)]  # copies
    docs += [docs[4], docs[4]]  # repeated rows
    docs += [(None, "no id here but words enough to be kept " * 3, "en", "a"), (None, None, None, None), (300, "", "en", "b"), (301, " \n\t\n", None, "b"), (302, None, "fr", "a")]
    docs += [(303, FOOT, "en", "hot"), (304, "one two\none two\none  two", "en", "a"), (305, words(rnd, 30_000), "en", "a"), (306, "x" * 200_000, "en", "b"), (307, "é\U0001f600 " * 30, "fr", "b")]
    return docs


def frame(spark, docs=None):
    return spark.createDataFrame(rows(documents() if docs is None else docs), SCHEMA)
