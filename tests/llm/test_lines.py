import random

import pytest

from tessel.llm import lines
from tests.llm.helpers import TEXTS, awkward, empty


def close(a, b):
    a, b = a.split(), b.split()
    if min(len(a), len(b)) < lines.LEAST:
        return False
    if a == b:
        return True
    if min(len(a), len(b)) < lines.NEAR or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rng = random.Random(seed)
    voc = [f"w{i}" for i in range(30)]
    base = [" ".join(rng.choice(voc) for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 12, 25]))) for _ in range(25)]

    def edited(x):
        w, i = x.split(), rng.randrange(len(x.split()))
        kind = rng.randrange(4)
        if kind == 0:
            w[i] = rng.choice(voc)
        elif kind == 1:
            w.insert(i, rng.choice(voc))
        elif kind == 2 and len(w) > 1:
            del w[i]
        return " ".join(w)

    docs = [(d, "\n".join(edited(rng.choice(base)) for _ in range(rng.randrange(0, 7)))) for d in range(80)] + [(90, None), (91, ""), (None, "\n".join(base[:3]))]
    order = sorted((d is None, d or 0, p, x) for d, t in docs if t for p, x in enumerate(t.split("\n")))
    gone = {o[:3] for i, o in enumerate(order) if any(close(o[3], q[3]) for q in order[:i])}
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for d, t in docs:
        assert got[d] == (None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (d is None, d or 0, p) not in gone))


def test_short_lines(spark):
    kept = ["All rights reserved", "Copyright 2023 Example Incorporated", "Read the terms of use here", "Les.", "Volume 1", "https://example.org/page/number/1"]
    gone = ["All rights  reserved", "Copyright 2024 Example Incorporated", "Read our terms of use here", "Les.", "Read the terms of use", "opyright 2023 Example Incorporated"]
    other = ["Copyright 2023 Someone Incorporated", "Volume 2", "https://example.org/page/number/2", "Read the terms of Sale there", ""]
    docs = spark.createDataFrame([(0, "\n".join(kept)), (1, "\n".join(gone + other))], "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split("\n") for r in lines.dedup_lines(docs).collect()}
    assert got == {0: kept, 1: other}


def test_short_lines_by_brute_force(spark):
    rng = random.Random(5)
    base = ["Copyright 2023 Example Incorporated", "Printed in the Netherlands", "internationally recognised", "x" * 9 + " " + "y" * 10]
    texts = []
    for _ in range(300):
        x = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            i, kind = rng.randrange(len(x)), rng.randrange(3)
            x[i : i + (kind != 1)] = [] if kind == 0 else [rng.choice("abc")]
        texts.append("".join(x))

    def near(a, b):
        a, b = " ".join(a.split()), " ".join(b.split())
        if a == b:
            return True
        if min(len(a), len(b)) < lines.LONG or min(len(a.split()), len(b.split())) < 2 or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = (a, b) if len(a) > len(b) else (b, a)
        return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))

    want = {i: t if not any(near(t, u) for u in texts[:i]) else "" for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()} == want


def test_variants_meet():
    a = [f"x{i}".encode() for i in range(12)]
    for i in range(12):
        assert (lines.variants(a)[i] == lines.variants(a[:i] + a[i + 1 :])[-1]).all()


def test_awkward_rows(spark):
    docs = awkward(spark, TEXTS)
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_dropped"] and out.count() == docs.count()
    rows = out.filter("doc_id = 0").collect()
    assert len(rows) == 2 and sorted(r["text"] for r in rows) == ["", TEXTS[0]]  # a repeated row is a later document
    assert sorted(r["n_dropped"] for r in rows) == [0, len(TEXTS[0].split("\n"))]
    assert lines.dedup_lines(docs, "drop").filter("doc_id = 0").count() == 1
    assert lines.dedup_lines(docs, "drop").filter("doc_id = 6").count() == 0  # a copy of document 0: nothing is left
    assert lines.dedup_lines(empty(spark)).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    docs = spark.createDataFrame([(1, "alpha beta\ngamma"), (1, "delta one\ngamma"), (None, "alpha beta\n\nomega"), (None, "alpha beta\n\nomega")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in lines.dedup_lines(docs).collect())
    assert [t for _, t in got if "omega" in t] == ["\nomega"] and sum(t == "" for _, t in got) == 1
    assert sum(t.count("gamma") for _, t in got) == 1 and sum(t.count("alpha") for _, t in got) == 1 and sum(t.count("delta") for _, t in got) == 1


def test_a_text_of_very_many_lines(spark):
    text = "\n".join(f"line {i % 50000} and {i % 50000 + 3} here" for i in range(100000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = lines.dedup_lines(docs).first()
    assert row["n_dropped"] == 50000 and row["text"] == "\n".join(text.split("\n")[:50000])
