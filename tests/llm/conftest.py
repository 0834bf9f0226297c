import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, ids string, kept string, node string, key string, line string, row string, n long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with extra columns whose names clash with those that the operators add or use inside."""

    def make(texts, ids=None, lang="en", source="s"):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, lang, source, len(t or ""), "x", "x", "x", "x", "x", "x", "x", 1) for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def prose():
    """Sentences of invented words, the same for the same seed."""

    def make(n_words, seed, line=12):
        rng = random.Random(seed)
        words = ["".join(rng.choices(["ba", "ke", "lo", "mi", "ru", "sa", "te", "vo"], k=rng.randint(1, 4))) for _ in range(n_words)]
        return "\n".join(" ".join(words[k : k + line]) for k in range(0, n_words, line))

    return make
