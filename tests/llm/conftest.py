import random

import pytest

WORDS = "the of and reading larger than stone river light under morning careful garden never window small".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


# doc_id, text, lang, source, n_chars and columns whose names the operators use themselves.
CLASHES = ("score", "kept", "keep_id", "copy_no", "position", "fp", "component_id", "words", "n_words", "n_tokens", "piece_ids", "digest", "label", "edits")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHES)


def odd_rows() -> list[tuple]:
    long = prose(7, 30_000)
    texts = [
        (1, prose(1, 80)),
        (2, prose(1, 80)),  # the same text
        (3, prose(1, 80).replace(" ", "\n\t ")),  # but for white space
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, long),
        (8, long + " end"),
        (9, "word"),
        (10, prose(2, 60)),
        (10, prose(2, 60)),  # a repeated row
        (10, prose(3, 60)),  # a repeated id
        (None, prose(4, 60)),
        (None, prose(4, 60)),
        (None, None),
        (11, "Ünïcödé 漢字 🙂  two  spaces\r\n\x0b\x0c end"),
        (12, prose(5, 40) + "\n" + prose(5, 40)),
    ]
    sources = ["a", "a", "b", None, "c.d", "`e`"]
    return [(i, t, "en", sources[n % 6], None if t is None else len(t), *["own"] * len(CLASHES)) for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
