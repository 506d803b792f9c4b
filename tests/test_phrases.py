"""Phrases and patterns in one scan, against Python's regex."""

import random
import re
from collections import Counter

import pytest

from veristrata.operators import gates, phrases


def show(t, pattern, before, after, flags):
    return [(m.start(), t[max(0, m.start() - before) : m.end() + after]) for m in re.finditer(pattern, t, flags)]


@pytest.mark.parametrize("ignore_case", [True, False])
def test_a_thousand_phrases_in_one_scan(spark, ignore_case):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abAB É") for _ in range(rng.randrange(1, 6)))
    wanted = sorted({word() for _ in range(1000)} | {"aa", "aaa", "", "A", "a"})
    rows = [(i, "".join(word() for _ in range(40)), "x") for i in range(40)] + [(50, None, "x"), (51, "", "x"), (52, "aaaaaaa", "x"), (53, "İaaİ", "x")]
    got = phrases.find_phrases(spark.createDataFrame(rows, "i int, text string, phrase string"), wanted, keep=["i", "text"], ignore_case=ignore_case, before=3, after=5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1
    want = Counter()
    for i, t, _ in rows:
        for p in wanted:
            if t and p:
                flags = re.I if ignore_case else 0
                want.update((i, t, p, at, c) for at, c in show(t, re.escape(p), 3, 5, flags))
    assert Counter(tuple(r) for r in got.collect()) == want


def test_pattern_contexts_overlap(spark):
    t = "a1b22c333 4"
    df = spark.createDataFrame([(1, t), (2, None), (3, "none")], "i int, text string")
    assert sorted((r.i, r.match, r.at, r.context) for r in phrases.find_pattern(df, "[0-9]+", keep=["i"], before=2, after=3).collect()) == [(1, "1", 1, "a1b22"), (1, "22", 3, "1b22c33"), (1, "333", 6, "2c333 4"), (1, "4", 10, "3 4")]
    assert phrases.find_pattern(df, "[0-9]", most=2).count() == 2


def test_gates_by_phrases(spark):
    texts = spark.createDataFrame([("A cure! a CURE for all.\nwe do not claim a cure",), ("x 41.5 % y",), (None,)], "value string")
    got = {(r.problem, r.phrase): r.n for r in gates.prose_problems(texts, ["41.5 %", "missing"], ["a cure", "never"], "do not claim").collect()}
    assert got == {("missing", "missing"): 1, ("asserted", "a cure"): 2}
    assert gates.prose_problems(texts, [], [], "$^").count() == 0
    with pytest.raises(ValueError):
        phrases.find_phrases(texts, ["x" * (phrases.MOST_BYTES + 1)], "value")
