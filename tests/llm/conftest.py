import random

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def make_docs(spark):
    """Documents from texts, or (id, text) pairs."""
    def make(texts, schema=DOC, source=None):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", source(i) if source else f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], schema)
    return make


def sentence(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words):03d}" for _ in range(n))
