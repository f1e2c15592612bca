import os
import random
from pathlib import Path

import pytest
from docs_fixture import DOCS, words

os.environ["PYTHONPATH"] = str(Path(__file__).resolve().parents[2])


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    rng = random.Random(11)
    long_text = " ".join(words(rng, 40_000))
    shared = " ".join(words(rng, 80))
    rows = [
        (1, "", "en", "a", 0), (2, None, "en", None, None), (3, " \n\t", None, "a", 3), (None, "alone here", "fr", "b", 10),
        (4, long_text, "en", "a", len(long_text)), (5, "Same  text", "en", "a", 10), (6, "Sametext", "en", "a", 8), (6, "Sametext", "en", "a", 8),
        (7, "42 17", "en", "a", 5), (8, "x" * 200_000, "fr", "a", 200_000), (9, f"one {shared} two", "de", "a", 1), (10, f"{shared} three", "de", "a", 1),
        (None, "alone here", "fr", "b", 10), (11, "mot de la fin é ü ß 漢 \U0001f600 ́", "fr", "a", 9),
    ]
    names = ["kept", "id", "key", "hash", "n", "root", "component_id", "x", "block", "rank", "score", "rejected", "lang_pred"]
    frame = spark.createDataFrame(rows, DOCS)
    return frame.selectExpr("*", *[f"'c' AS {n}" for n in names])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
