import random

import pytest

SCHEMA = "doc_id bigint, text string, t string, h string, key int, rid bigint, value string, keep_id int, n_lines int, b int, e int, k1 string, sigs string, region int, block int, page_id string, score string"
NONE = (None,) * 15


def sentence(rng, n):
    return " ".join(rng.choice("the of and to in alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(n))


def edge_rows():
    """Nulls, empty and very long texts, repeated rows and ids, copies, near copies, shared passages, odd characters."""
    rng = random.Random(7)
    base, passage, line = sentence(rng, 120), sentence(rng, 60), "Shared line  "
    rows = [(None, "no id"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, sentence(rng, 30_000)), (5, base), (5, base), (6, base), (7, "other text under id five"), (5, "a third text")]
    rows += [(10 + i, base.replace(base.split()[i * 7], f"edit{i}", 1)) for i in range(8)]
    rows += [(30 + i, f"{sentence(rng, 20)}\n{line}\n{passage}\n{sentence(rng, 15)}") for i in range(14)]
    rows += [(60, "é中😀 ▁▁ \x00\x01\r\n" * 40), (61, "word"), (62, "two words"), (63, "Oi " * 400), (64, "x" * 5000), (65, "\n" * 30), (66, "|".join("abcdef") * 50)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    rows = edge_rows()
    return spark.createDataFrame([(i, x, *NONE) for i, x in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
