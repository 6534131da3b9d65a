"""Small documents with every awkward case: nulls, empty and long texts, repeated rows, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark, texts: list[str | None], sources: list[str | None] = ("a", "b", None)):
    """A row per text, then a repeated row, one without id, and columns named like the operators' own."""
    rows = [(i, t, "en", sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], (None, "no id here at all my friend", None, None, 27)]
    extra = "key string, score double, node string, line string, size long, kept boolean, t string, rank int"
    values = ("x", 0.5, "n", "l", 7, True, "t", 3)
    return spark.createDataFrame([r + values for r in rows], f"{SCHEMA}, {extra}")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    out = [f"w{rng.randrange(vocabulary)}" for _ in range(words)]
    for i in range(12, words, 17):
        out[i] += ".\n" if i % 2 else "."
    return " ".join(out)


TEXTS = [prose(1, 60), None, "", "   \n\t ", prose(2, 4000), prose(3, 30), prose(1, 60), "one", "日本語 😀 ünïcode\x0bx", prose(4, 80)]
