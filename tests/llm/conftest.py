import random

import pytest

WORDS = [f"{a}{b}" for a in "ba de fi go hu ka le mi no pu ra se ti vo wu".split() for b in ("", "na", "lo", "ri", "st", "xen")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def edited(rng: random.Random, text: str, n: int) -> str:
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = prose(rng, 1)
    return " ".join(words)


@pytest.fixture(scope="session")
def rows():
    """Small documents with every awkward case: nulls, blanks, repeats, copies, near copies, shared passages, a very long text."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(20, 160)) for _ in range(24)]
    base = prose(rng, 120)
    passage = prose(rng, 60)
    texts += [edited(rng, base, rng.randrange(0, 9)) for _ in range(30)]
    texts += [f"{prose(rng, 30)}\n{passage}\n{prose(rng, 25)}" for _ in range(5)]
    texts += [texts[0], texts[0].replace(" ", "\n"), texts[1].upper(), "", None, " \t\n", "one", "Éa ÉA", "ab " * 400, "x" * 500, prose(rng, 4000), "naïve 😀 café " * 30]
    out = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    out.append(out[3])  # a row that repeats
    out.append((None, "a row without an id", "en", "s", 3))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def clash(docs):
    """The same with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = ["digest", "key", "id", "n", "a", "b", "hub", "links", "uid", "seed", "other", "mark", "spans", "g", "score", "sha"]
    return docs.withColumns({x: F.lit("clash") for x in names})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
