"""The verdict of the quality rules against plain expectation-maximisation over brute-force votes."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from docsift.llm import quality_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def plain_votes(text):
    """Votes of each rule, from Python's own string functions."""
    words = WORDS.findall(text)
    n, at = len(words), defaultdict(list)
    for k in range(n - 4):
        at[tuple(words[k : k + 5])].append(k)
    repeated = len({p + j for v in at.values() if len(v) > 1 for p in v for j in range(5)})
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    doubles, letters = len(lines) - len(set(lines)), max(1, sum(map(len, words)))
    upper, symbols = sum("A" <= c <= "Z" for c in text), sum(c in "#*$%&|<>" for c in text)
    bare = sum(not regex.search(r"\p{L}", w) for w in words)
    decorated = sum(len(regex.search(r"[^\p{L}\p{N}]*$", w)[0]) >= 2 for w in words)
    m = max(n, 1)
    bad_good = [
        (n < 10, n >= 30),
        (repeated > 0.2 * m, repeated <= 0.05 * m),
        (symbols > 0.3 * m, symbols <= 0.05 * m),
        (doubles > 0.3 * max(1, len(lines)), doubles == 0),
        (sum(map(len, words)) < 2 * m or letters > 15 * m, 3 * m <= sum(map(len, words)) <= 10 * m),
        (upper > 0.4 * letters, upper <= 0.15 * letters),
        (m >= 20 and len(set(words)) < 0.2 * m, len(set(words)) >= 0.3 * m),
        (bare > 0.2 * m, bare <= 0.1 * m),
        (decorated > 0.2 * m, decorated <= 0.05 * m),
    ]
    return tuple(-1 if bad else int(good) for bad, good in bad_good), n < 10 or 100 * repeated > 20 * n


def plain_posteriors(votes):
    """Posterior of good of every row, one row for each text, by vectors."""
    v = np.array(votes)
    bad, cast = (v < 0).astype(float), (v != 0).astype(float)
    share, hit, alarm = 0.85, np.full(v.shape[1], 0.3), np.full(v.shape[1], 0.02)
    while True:
        def likelihood(rate):
            return np.prod(np.where(v < 0, rate, np.where(v > 0, 1 - rate, 1.0)), axis=1)

        good = share * likelihood(alarm)
        good /= good + (1 - share) * likelihood(hit)
        n = len(v)
        new = (good.sum() + 0.85 * 0.1 * n) / (1.1 * n)
        hit = ((1 - good) @ bad + 0.3 * 0.1 * n) / ((1 - good) @ cast + 0.1 * n)
        alarm = (good @ bad + 0.02 * 0.3 * n) / (good @ cast + 0.3 * n)
        if abs(new - share) < 1e-12:
            good = new * likelihood(alarm)
            return good / (good + (1 - new) * likelihood(hit))
        share = new


def test_verdicts_equal_plain_estimation(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    votes = [plain_votes(t) for _, t in texts]
    good = plain_posteriors([v for v, _ in votes])
    want = {i: (not failed and g >= 0.5, float(g)) for (i, _), (_, failed), g in zip(texts, votes, good, strict=True)}
    rows = quality_rules.counted(docs).select("doc_id", "counts")
    found = quality_rules.verdicts(rows, quality_rules.fitted(rows)).collect()
    assert len(found) == len(want)
    for r in found:
        assert r.kept == want[r.doc_id][0], r
        assert r.quality_probability == pytest.approx(want[r.doc_id][1], abs=1e-6)
    # The verdict is not all-must-pass: some texts with a bad vote stay, and no single rule decides alone.
    verdict = Counter((any(x < 0 for x in v), want[i][0]) for (i, _), (v, _) in zip(texts, votes, strict=True))
    assert verdict[True, True] and verdict[True, False] and verdict[False, True]


def test_estimation_finds_faults_that_two_rules_see():
    """A fault that two rules see is told from a rule's false alarms, without labels."""
    rng, patterns, truth = random.Random(3), Counter(), defaultdict(list)
    for _ in range(4000):
        fault = rng.randrange(3) if rng.random() < 0.15 else None
        p = [1] * 7
        for k in range(6):
            if k // 2 == fault and rng.random() < 0.9:
                p[k] = -1
        # The last rule fails texts at random: its bad votes say nothing.
        p[6] = -1 if rng.random() < 0.1 else 1
        patterns[tuple(p)] += 1
        truth[tuple(p)].append(fault is not None)
    prior, odds = quality_rules.estimate(sorted(patterns.items()))
    judged = {p: prior + sum(o[v] for o, v in zip(odds, p, strict=True)) < 0 for p in patterns}
    two = {p for p in patterns if sum(v < 0 for v in p[:6]) == 2}
    assert all(judged[p] for p in two)
    assert not judged[(1, 1, 1, 1, 1, 1, -1)]
    assert sum(judged[p] != b for p, bs in truth.items() for b in bs) < 120
    assert odds[6][-1] > max(o[-1] for o in odds[:6]) + 2


def test_marks_of_long_runs_take_linear_time(spark):
    text = "$" * 300_000 + "a " + "1" * 300_000 + " ok!! " + "-" * 300_000
    row = quality_rules.counted(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.col("counts.n_letterless"), F.col("counts.n_decorated")).first()
    assert tuple(row) == (2, 2)
