"""Small tables with every awkward case."""

import random

import pytest

WORDS = "the of and shore bleren tion wharf ouad inst, er. Ñandú être 東京 x".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def docs_rows():
    rng = random.Random(5)
    rows = [(k, prose(rng, rng.randrange(1, 120))) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(10)]  # copies
    rows += [(120 + k, "  " + rows[k][1].replace(" ", "\n")) for k in range(5)]  # equal but for white space
    rows += [(130 + k, rows[20 + k][1] + " more") for k in range(8)]  # near copies
    rows += [(3, rows[3][1]), (3, rows[3][1])]  # repeated rows
    rows += [(200, None), (201, ""), (202, " \n\t "), (None, "null id " + prose(rng, 20)), (None, None)]
    rows += [(210, prose(rng, 20_000)), (211, "x" * 5_000), (212, "▁ a▁b\u00a0 c\r\n\n  d  "), (213, "<|endoftext|> ### </s> <0x41>")]
    rows += [(220, "one"), (221, "one two"), (222, "ONE two"), (223, "a b c"), (-5, "a b c"), (224, "é\u0301 İ ΣΑΣ \U0001f600")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    """Extra columns clash with names that the operators use."""
    rows = [(d, t, "en", "src0", 1, "c", "d", 3) for d, t in docs_rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, __digest string, digest string, n int"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty_docs(docs):
    return docs.where("1 = 0")
