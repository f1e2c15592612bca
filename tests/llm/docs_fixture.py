import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars int"


def words(rng: random.Random, n: int, vocabulary: int = 3000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
