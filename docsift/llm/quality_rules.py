"""Quality rules combined by weak supervision (operator 6), in DataFrame functions only.

Counts of a text are taken inside its row with array functions, so nothing is shuffled: five-word windows are hashed,
sorted and compared with their neighbours.  Each rule votes good, bad or abstains, and most kinds of fault are seen by two
rules or more, since votes that fall together are what unlabelled estimation learns from.  How often each pattern of votes
occurs is counted over the whole corpus (at most ``3 ** rules`` rows); expectation-maximisation on that table, as a naive
Bayes model with a hidden quality, estimates how far each rule's votes can be trusted, and a text is kept if its posterior
probability of being good reaches the threshold.  A bad vote of a rule that fails good texts as well is outweighed by the
others' good votes; one that nearly all bad texts share is not.

Results: a null or blank text has no words and fails the base rule; rows are judged by themselves given the corpus
estimates, so ties and repeated rows get equal verdicts; an empty table gives an empty table (the estimates stay at their
priors); columns other than id and text are not read for the counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A word is a run of anything but ASCII white space; these characters are symbols.
SPACE = "[ \\t-\\r]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
#: Words without a letter, and words that end in two or more marks; each begins at one place only, so long runs take linear time.
LETTERLESS = "(?<![^ \\t-\\r])[^ \\t-\\r\\p{L}]++(?![^ \\t-\\r])"
DECORATED = "(?<![^ \\t-\\r\\p{L}\\p{N}])[^ \\t-\\r\\p{L}\\p{N}]{2,}+(?![^ \\t-\\r])"
THRESHOLD = 0.5
#: What is assumed before texts are seen: how often a rule votes bad on bad texts, on good ones, and the share of good texts;
#: then what each assumption weighs, as a share of all texts, so that estimates are alike at every size of the corpus.
HIT, FALSE_ALARM, GOOD = 0.3, 0.02, 0.85
HIT_WEIGHT, ALARM_WEIGHT, GOOD_WEIGHT = 0.1, 0.3, 0.1


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _repeat_words(words: Column) -> Column:
    """Words in windows of five that occur at least twice in the text."""

    def marked(windows: Column) -> Column:
        n = F.size(windows)
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            near = F.zip_with(F.slice(s, F.lit(1), n - 1), F.slice(s, F.lit(2), n - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
            places = F.array_sort(F.array_distinct(F.flatten(near)))
            return let(places, lambda p: F.when(F.size(p) == 0, F.lit(0)).otherwise(WINDOW + F.aggregate(F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(0), lambda acc, x: acc + x)))

        return F.when(F.size(F.array_distinct(windows)) == n, F.lit(0)).otherwise(let(pairs, covered))

    def of(hashes: Column) -> Column:
        n = F.size(hashes) - (WINDOW - 1)
        at = lambda k: F.slice(hashes, F.lit(1 + k), n)
        first = F.zip_with(at(0), at(1), lambda a, b: F.xxhash64(a, b))
        second = F.zip_with(at(2), at(3), lambda a, b: F.xxhash64(a, b))
        windows = F.zip_with(F.zip_with(first, second, lambda a, b: F.xxhash64(a, b)), at(4), lambda a, b: F.xxhash64(a, b))
        return F.when(n < 2, F.lit(0)).otherwise(let(windows, marked))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def counted(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows with a struct ``counts``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and shares of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE[1:-1]}]"))

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))).cast("long").alias("n_upper"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            F.regexp_count(text, F.lit(LETTERLESS)).cast("long").alias("n_letterless"),
            F.regexp_count(text, F.lit(DECORATED)).cast("long").alias("n_decorated"),
        )

    return docs.withColumn("counts", let(words, of))


def base_failed(c: Column) -> Column:
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def votes(c: Column) -> list[Column]:
    """Of each rule: 1 good, -1 bad, 0 abstains."""
    n = F.greatest(c["n_words"], F.lit(1))

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return [
        rule(c["n_words"] < 10, c["n_words"] >= 30),
        rule(100 * c["n_repeat_words"] > 20 * n, 100 * c["n_repeat_words"] <= 5 * n),
        rule(100 * c["n_symbols"] > 30 * n, 100 * c["n_symbols"] <= 5 * n),
        rule(100 * c["n_dup_lines"] > 30 * F.greatest(c["n_lines"], F.lit(1)), c["n_dup_lines"] == 0),
        rule((c["word_chars"] < 2 * n) | (c["word_chars"] > 15 * n), (c["word_chars"] >= 3 * n) & (c["word_chars"] <= 10 * n)),
        rule(100 * c["n_upper"] > 40 * F.greatest(c["word_chars"], F.lit(1)), 100 * c["n_upper"] <= 15 * F.greatest(c["word_chars"], F.lit(1))),
        rule((n >= 20) & (100 * c["n_distinct"] < 20 * n), 100 * c["n_distinct"] >= 30 * n),
        rule(100 * c["n_letterless"] > 20 * n, 100 * c["n_letterless"] <= 10 * n),
        rule(100 * c["n_decorated"] > 20 * n, 100 * c["n_decorated"] <= 5 * n),
    ]


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, list[dict[int, float]]]:
    """Prior log odds of good and, for each rule, the log odds that each vote adds, by expectation-maximisation.

    A rule has two unknown rates: how often it votes bad on bad texts and on good ones, among the texts on which it votes;
    abstaining says nothing.  Both, and the share of good texts, start at what is assumed and are estimated with that
    assumption worth a share of the texts; nothing is capped.
    """
    rules = len(patterns[0][0]) if patterns else 0
    share, hits, alarms = GOOD, [HIT] * rules, [FALSE_ALARM] * rules
    total = sum(n for _, n in patterns)

    def odds() -> list[dict[int, float]]:
        return [{-1: math.log(a / h), 0: 0.0, 1: math.log((1 - a) / (1 - h))} for h, a in zip(hits, alarms, strict=True)]

    def rate(k: int, assumed: float, worth: float, weights: list[float]) -> float:
        cast = [(w * n, p[k]) for w, (p, n) in zip(weights, patterns, strict=True) if p[k]]
        return (sum(w for w, v in cast if v < 0) + assumed * worth * total) / (sum(w for w, _ in cast) + worth * total)

    for _ in range(rounds if total else 0):
        weights, prior = odds(), math.log(share / (1 - share))
        good = [1 / (1 + math.exp(-(prior + sum(o[v] for o, v in zip(weights, pattern, strict=True))))) for pattern, _ in patterns]
        before = share
        share = (sum(g * n for g, (_, n) in zip(good, patterns, strict=True)) / total + GOOD * GOOD_WEIGHT) / (1 + GOOD_WEIGHT)
        hits = [rate(k, HIT, HIT_WEIGHT, [1 - g for g in good]) for k in range(rules)]
        alarms = [rate(k, FALSE_ALARM, ALARM_WEIGHT, good) for k in range(rules)]
        if abs(before - share) < 1e-12:
            break
    return math.log(share / (1 - share)), odds()


def posterior(c: Column, prior: float, odds: list[dict[int, float]]) -> Column:
    score = F.lit(prior)
    for vote, weights in zip(votes(c), odds, strict=False):
        score = score + F.when(vote > 0, F.lit(weights[1])).when(vote < 0, F.lit(weights[-1])).otherwise(F.lit(weights[0]))
    return 1 / (1 + F.exp(-score))


def fitted(rows: DataFrame) -> tuple[float, list[dict[int, float]]]:
    """Estimates from the vote patterns of all rows that have ``counts``."""
    names = [f"v{k}" for k in range(len(votes(F.col("counts"))))]
    seen = rows.select(*(v.alias(n) for v, n in zip(votes(F.col("counts")), names, strict=True))).groupBy(*names).count().collect()
    return estimate([(tuple(r[n] for n in names), r["count"]) for r in sorted(seen)])


def verdicts(rows: DataFrame, model: tuple[float, list[dict[int, float]]], threshold: float = THRESHOLD) -> DataFrame:
    """Adds base_failed, quality_probability and kept to rows that have ``counts``."""
    c = F.col("counts")
    return rows.withColumns({"base_failed": base_failed(c), "quality_probability": posterior(c, *model)}).withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= threshold))
