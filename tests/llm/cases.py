"""Rows with the awkward cases, for the tests of all training-data operators."""

import random

VERY_LONG = "lorem ipsum dolor " * 4000


def documents(spark, rows):
    """Documents with a column too many, whose name operators use inside."""
    schema = "doc_id long, text string, lang string, id string, fp string, spans string, n_chars long"
    return spark.createDataFrame([(d, t, None, "x", "y", None, None) for d, t in rows], schema).repartition(3)


ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "one two three four five six seven"), (4, "same text here"), (4, "same text here"), (5, "é" * 5000), (6, VERY_LONG)]


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeiounrstl") for _ in range(rng.randint(3, 8))) + ("." if k % 12 == 11 else "") for k in range(n))
