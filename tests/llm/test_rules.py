import re
from collections import Counter

import numpy as np

from tessel.llm import rules
from tests.llm.helpers import TEXTS, awkward, empty, prose


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


CASES = [*TEXTS, "a b c d e " * 4, "x\ny\nx\n \n \nx", "#a *b $$ c|d <e> 100% &", "a b c d e f a b c d e", "\x85 a\xa0b \x1c", "x " * 3000]


def test_base_measures():
    for t in CASES:
        assert rules.measure(t)[:5] == brute(t), repr((t or "")[:40])


def test_verdicts(spark):
    junk = ["of%%% the$$$ and*** " * 30, "HELLO!! WORLD!! AGAIN!! " * 20, " ".join("abc" for _ in range(60))]
    docs = awkward(spark, [*[prose(100 + i, 80) for i in range(60)], *junk, *TEXTS])
    got = {r["doc_id"]: r for r in rules.judge_quality(docs).collect()}
    assert len(got) == docs.select("doc_id").distinct().count()
    assert all(got[i]["kept"] for i in range(60))
    assert not any(got[i]["kept"] for i in (60, 61, 62))
    for r in got.values():
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_empty_table(spark):
    assert rules.judge_quality(empty(spark)).count() == 0


def test_em_finds_a_bad_rule():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.8
    good = np.array([np.where(rng.random(4000) < 0.9, y, ~y) for _ in range(4)] + [rng.random(4000) < 0.5]).T.astype(int)
    patterns, counts = np.unique(good, axis=0, return_counts=True)
    share, right_g, _ = rules.fit_accuracies(patterns, counts)
    assert abs(share - 0.8) < 0.05 and (right_g[:4] > 0.85).all() and right_g[4] < 0.6
