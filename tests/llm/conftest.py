import random

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from conftest_words import prose  # noqa: E402

@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text, lang, source, n_chars, words): null in each column, empty, blank, long and equal texts, repeated rows and ids, a clashing column."""
    rng = random.Random(3)
    base = [prose(rng, 60) for _ in range(8)]
    passage = prose(rng, 40)
    long = "\n".join(prose(rng, 30) for _ in range(400))
    near = base[0].split()
    near[30] = "changed"
    texts = [base[0], base[1], f"{base[2]} {passage}", f"{passage} {base[3]}", base[0], " ".join(near), "", "  \n\t", None, long, long, "one", "déjà vu ici", base[4], base[4], f"{base[5]}\n{base[5]}\n{base[5]}\n{base[6]}", f"{base[5]}\n{base[5]}\n{base[5]}", "1234 5678 !!", passage]
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None][i % 3], None if t is None else len(t), "clash") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base[7], "en", "a", 3, None), (None, base[1], "en", None, 3, None), (5, base[6], "en", "a", 3, "other text, same id")]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, "doc_id long, text string, lang string, source string, n_chars long, words string").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)
