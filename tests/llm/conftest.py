import random

import pytest

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sigma tau ups phi chi psi omega".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "x", "Y", "é"]) for _ in range(n))


def cases() -> list[tuple]:
    """(doc_id, text, lang, source) with nulls, empty and long texts, ties, copies, near copies and repeated rows."""
    rng = random.Random(5)
    base = sentence(rng, 80)
    words = base.split()
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base.upper(), "de", "b"), (4, None, "en", "a"), (5, "", None, None), (6, " \n\t ", "en", ""), (7, "one", "fr", None), (8, "one two three", "en", "b"),
        (9, "ONE two\x0bthree", "en", "b"), (10, "one  two three", "en", "c"), (11, sentence(rng, 30_000), "en", "c"), (12, "x" * 50_000, "en", "a"), (13, "q w e r t y\n" * 30, "en", "a"),
        (14, "<|endoftext|> it's <|endoftext|>they'll", "en", "a"), (16, "a b c d e", "en", "a"), (17, "a b c d e f", "en", "a"), (18, "a b c d e f g", "en", "a"), (19, "a b c d e f g h", "en", "a"), (20, "a b c d e f g h i", "en", "a"),
        (21, "# $$ * <tag> | & %\n\n# $$ *\n# $$ *", "en", "a"), (None, "an id is missing here but words are not", "en", "a"),
    ]
    for k in range(22, 60):
        w = list(words)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((k, " ".join(w), "en", rng.choice("abc")))
    for k in range(60, 90):
        rows.append((k, sentence(rng, rng.randrange(5, 60)), rng.choice(["en", "de"]), rng.choice("abc")))
    rows += [rows[0], rows[3], rows[4]]
    return rows


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return cases()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The cases as documents, with extra columns whose names the operators use inside."""
    extra = ("size", "n", "row", "node", "key", "label", "g", "h", "src", "held", "x", "part", "gid", "words")
    data = [(*r, *([7] * len(extra))) for r in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} int" for c in extra)).repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("doc_id = -5")
