"""Small tables with everything that is odd: nulls, repeats, empty and long texts."""

import random

WORDS = "the a of and rain sun river stone tree house dog cat blue green old new runs walks sees likes".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_documents(seed=7):
    """(doc_id, text, id): ``id`` clashes with the operators' own working names."""
    rng = random.Random(seed)
    base = prose(rng, 80)
    texts = [
        None,
        "",
        "   ",
        " \n\t ",
        "one two three",
        "One TWO three",
        base,
        base,
        base.replace(" ", "\n", 5),
        base.upper(),
        f"{base} tail",
        prose(rng, 4000),
        "é ü 中文 👍🏽 <|endoftext|> x",
        "a" * 3000,
        "mail me at a.b@c.de or +1 (555) 123-4567, card 4111111111111111, host 10.0.0.1.",
    ]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    rows += [(3, base, "again"), (None, base, None), (None, None, None), (6, base, "copy"), (6, base, "copy")]
    rows += [(100 + i, prose(rng, rng.randint(1, 120)), None) for i in range(30)]
    return rows


SCHEMA = "doc_id long, text string, id string"


def odd_frame(spark, rows=None):
    return spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA)
