"""Licence scan by Dice coefficient over word bigrams (operator 5), in DataFrame functions only.

Texts are normalised (lower case, everything but letters and digits to one space, line breaks as well).  A licence notice is a
passage of a document, so every run of words is compared with every template, wherever lines begin and end, up to ``(2 - t) / t``
times the template's bigrams in length (repeats count).  Runs and templates are sets of word bigrams; the Dice coefficient is
``2 * shared / (size of one + size of other)``.  Runs that need not be tried: a run that does not begin and end with a bigram
of the template scores no more than the run within it that does, and reaching the threshold takes ``t / (2 - t)`` of a
template's bigrams, so a run begins where that many of them follow within the length.  For each template a few words are chosen
that all but fewer bigrams than that contain; texts without any of these words are left out first.

Of runs that overlap the closest counts, and those of other licences that tie with it.

Results: one row for each document and licence found, with the best passage; a document without a notice gives one row
with nulls; null and empty texts count as without; repeated rows give repeated results; an empty table gives an empty
table; columns other than id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import texts
from docsift.llm.quality_rules import let

# Short notices of public licences, in the words their publishers ask for.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["Released under the CC0 1.0 Universal public domain license."],
}
# Words too common to tell a notice by.
COMMON = ["a", "and", "any", "at", "be", "by", "can", "do", "for", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "under", "use", "with", "work", "you", "your"]
THRESHOLD = 0.7
RUNS = "array<struct<dice:double,licence:string,start:int,end:int>>"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def bigrams(text: Column) -> Column:
    """Word bigrams of a normalised text in order, with repeats."""
    return let(F.split(text, " "), lambda w: F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>")))


def template_bigrams(text: str) -> list[str]:
    import re

    w = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def marks(threshold: float) -> list[str]:
    """Words of which every passage that reaches the threshold for some template has at least one."""
    chosen: set[str] = set()
    for notice in (t for notices in TEMPLATES.values() for t in notices):
        grams = [g.split(" ") for g in template_bigrams(notice)]
        words = sorted({w for g in grams for w in g}, key=lambda w: (w in COMMON, w not in chosen, -sum(w in g for g in grams), -len(w), w))
        for w in words:
            # A passage shares at least t / (2 - t) of the bigrams, more than there are without a chosen word.
            if sum(not chosen.intersection(g) for g in grams) < threshold / (2 - threshold) * len(grams):
                break
            chosen.add(w)
    return sorted(chosen)


def _templates(threshold: float) -> Column:
    """Array of (licence, grams, least, span): bigrams that a run shares at least, and bigrams of a run at most."""
    out = []
    for name, notices in TEMPLATES.items():
        for notice in notices:
            t = template_bigrams(notice)
            # A little to the safe side of rounding; runs are compared with the threshold itself.
            least, span = math.ceil(threshold / (2 - threshold) * len(t) - 1e-9), math.floor((2 - threshold) / threshold * len(t) + 1e-9)
            out.append(F.struct(F.lit(name).alias("licence"), F.array(*map(F.lit, t)).alias("grams"), F.lit(least).alias("least"), F.lit(span).alias("span")))
    return F.array(*out)


def _runs(grams: Column, hits: Column, t: Column, threshold: float) -> Column:
    """Array of (dice, licence, start, end) of the runs that reach the threshold for a template; start and end count bigrams."""

    def scored(own: Column) -> Column:
        def run(a: Column, b: Column) -> Column:
            start, end = own[a]["p"], own[b]["p"]
            shared = F.size(F.array_distinct(F.transform(F.slice(own, a + 1, b - a + 1), lambda h: h["gram"])))
            n = F.size(F.array_distinct(F.slice(grams, start + 1, end - start + 1)))
            return F.struct((2.0 * shared / (n + F.size(t["grams"]))).alias("dice"), t["licence"].alias("licence"), start.alias("start"), end.alias("end"))

        near = lambda a, b: own[b]["p"] - own[a]["p"] < t["span"]
        starts = F.filter(F.sequence(F.lit(0), F.size(own) - t["least"]), lambda a: near(a, a + t["least"] - 1))
        ends = lambda a: F.filter(F.sequence(a + t["least"] - 1, F.least(F.size(own) - 1, a + t["span"] - 1)), lambda b: near(a, b))
        return F.flatten(F.transform(starts, lambda a: F.filter(F.transform(ends(a), lambda b: run(a, b)), lambda r: r["dice"] >= threshold)))

    own = F.filter(hits, lambda h: F.array_contains(t["grams"], h["gram"]))
    return let(own, lambda o: F.when(F.size(o) >= t["least"], scored(o)).otherwise(F.array().cast(RUNS)))


def _closest(runs: Column) -> Column:
    """Runs that overlap no closer one that counts itself, and none of the same licence."""
    order = F.transform(runs, lambda r: F.struct((-r["dice"]).alias("far"), r["start"].alias("start"), r["end"].alias("end"), r["licence"].alias("licence"), r["dice"].alias("dice")))
    ordered = F.transform(F.array_sort(order), lambda r: F.struct(r["dice"].alias("dice"), r["licence"].alias("licence"), r["start"].alias("start"), r["end"].alias("end")))
    beaten = lambda r, kept: F.exists(kept, lambda k: (k["start"] <= r["end"]) & (r["start"] <= k["end"]) & ((k["dice"] > r["dice"]) | (k["licence"] == r["licence"])))
    return F.aggregate(ordered, F.array().cast(RUNS), lambda kept, r: F.when(beaten(r, kept), kept).otherwise(F.concat(kept, F.array(r)).cast(RUNS)))


def licence_matches(docs: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licence, dice (best passage, six decimals), passages (how many reach the threshold, overlapping ones once); nulls and 0 if none."""
    text = F.col("text")
    # Whole words only; text is compared in lower case.
    pattern = "(?<![\\p{L}\\p{N}])(?:" + "|".join(marks(threshold)) + ")(?![\\p{L}\\p{N}])"
    known = sorted({g for notices in TEMPLATES.values() for t in notices for g in template_bigrams(t)})

    def scanned(grams: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(grams) - 1), lambda p: grams[p].isin(known))
        hits = F.transform(at, lambda p: F.struct(p.alias("p"), grams[p].alias("gram")))
        runs = let(hits, lambda h: F.flatten(F.transform(_templates(threshold), lambda t: _runs(grams, h, t, threshold))))
        return F.when(F.size(grams) > 0, let(runs, _closest)).otherwise(F.array().cast(RUNS))

    found = F.when(F.lower(text).rlike(pattern), let(bigrams(normalised(text)), scanned))
    kinds = F.array_distinct(F.transform(F.col("found"), lambda h: h["licence"]))
    best = F.transform(kinds, lambda k: let(F.filter(F.col("found"), lambda h: h["licence"] == k), lambda own: F.struct(k.alias("licence"), F.round(F.array_max(F.transform(own, lambda h: h["dice"])), 6).alias("dice"), F.size(own).cast("long").alias("passages"))))
    rows = texts(docs, id_col=id_col, text_col=text_col).select("doc_id", found.alias("found")).select("doc_id", F.explode_outer(best).alias("hit"))
    return rows.select("doc_id", "hit.licence", "hit.dice", F.coalesce("hit.passages", F.lit(0).cast("long")).alias("passages"))
