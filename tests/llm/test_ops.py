"""The ten operators against brute force on small tables with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import random
import re
import textwrap
import time
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from docsift.llm import bpe, decontamination, license_scan, minhash_forest, pii, quality_classifier, quality_rules, suffix_dedup, token_counts, token_output

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, counts int, spans string, node long, signature int, shard int, set_key string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "é", "ß"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + ".\n" + " ".join(word() for _ in range(n // 2))
    base = [prose(rng.randint(12, 90)) for _ in range(30)]
    passage = prose(70)
    out = [*base, *base[:5]]
    for t in base[:8]:
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    out += [prose(20) + "\n" + passage + "\n" + prose(15) for _ in range(4)]
    out += ["", None, "   \n\t ", "one two", "One TWO", "a" * 30_000, "ab " * 5_000, "x " * 3, "Mail bob.42@mail8.example.com or +1 (988) 555-2485, 4539578763621486 at 42.144.35.254 and 300.1.1.1."]
    out += ["bad@@x.y a@b.c%d@e.f 1.2.3.4.5 007.1.1.1 +12 4111 1111 1111 1111 mail me: jo (at) ex (dot) com", "<|endoftext|> it's  \n\n x <|startoftext|>", "日本語 テスト ΑΣ Σ ﬁ 𝔘 🎉 \x1c\x85 ３"]
    out += ["Text above.\nReleased under the MIT License.\nThis work is licensed under the GNU General Public License, version 3."]
    rows = [(k, t) for k, t in enumerate(out)]
    return [*rows, rows[3], (None, base[4]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, 7, "x", 1, 2, 3, "k") for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [(i, t or "") for i, t in corpus()]


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def shingles(t):
    w = WORDS.findall(ascii_lower(t))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates(docs, empty):
    assert minhash_forest.near_duplicates(empty).count() == 0
    rows = [(n, i, shingles(t)) for n, (i, t) in enumerate(texts())]
    group = list(range(len(rows)))
    for a, _, x in rows:
        for b, _, y in rows[:a]:
            if x and 100 * len(x & y) >= 85 * len(x | y):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    ids = defaultdict(list)
    for n, i, _ in rows:
        ids[group[n]].append(i)
    want = sorted(((i, len(s), min((x for x in ids[group[n]] if x is not None), default=None)) for n, i, s in rows), key=str)
    got = minhash_forest.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_dense_regions_lose_no_link(spark, monkeypatch):
    """Without neighbours as candidates, the exact join alone finds the groups of a region of similar texts."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(160)]
    rows = []
    for k in range(40):
        words = base[:]
        for at in rng.sample(range(160), rng.choice([1, 2, 3, 4, 5])):
            words[at] = f"x{k}-{at}"
        rows.append((k, " ".join(words[: rng.choice([160, 160, 150])])))
    rows = [(k, t) for k, t in rows] + [(100 + k, f"alone {k} " + " ".join(f"y{k}-{j}" for j in range(30))) for k in range(5)]
    sets = {k: shingles(t) for k, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    group = {k: k for k in sets}
    for _ in sets:
        for a, b in linked:
            group[a] = group[b] = min(group[a], group[b])
    assert 5 < len(set(group.values())) < len(sets) - 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real = minhash_forest.candidates

    def hubs_only(classes):
        return real(classes).where("a = 0").withColumn("first", F.lit(False))

    monkeypatch.setattr(minhash_forest, "candidates", hubs_only)
    got = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(docs).collect()}
    assert got == group
    # The join itself proposes every link between sets that no group joins yet.
    packed = minhash_forest.signatures(docs).select(F.col("doc_id").alias("node"), "packed_text", F.col("doc_id").alias("component"))
    proposed = {(r.a, r.b) for r in minhash_forest.sharing(minhash_forest.rare_shingles(packed, 85), 85).collect()}
    assert proposed >= set(linked)


def test_links_through_null_and_shared_ids(spark):
    """A null id links others, and rows of one id with different texts belong to different groups."""
    rng = random.Random(31)
    words = lambda: [f"{rng.choice('bcdfg')}{rng.randrange(9999)}" for _ in range(120)]
    swapped = lambda w, at: [*w[:at], "zz", *w[at + 1 :]]
    chain = words()
    first, second, third = chain, swapped(chain, 30), swapped(swapped(chain, 30), 80)
    other, alone = words(), words()
    rows = [(7, first), (None, second), (5, third), (9, other), (9, alone), (8, swapped(other, 50)), (None, words())]
    found = minhash_forest.near_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string"))
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in found.collect()), key=str)
    assert got == sorted([(7, 5, False), (None, 5, False), (5, 5, True), (9, 8, False), (9, 9, True), (8, 8, True), (None, None, True)], key=str)


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 99), (99, 98)], "a long, b long")
    got = {r.node: r.component for r in minhash_forest.components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 98: 98, 99: 98, 100: 98}


def test_suffix_dedup(docs, empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    data = [(i, t.encode()) for i, t in texts()]
    seen = defaultdict(int)
    for _, b in data:
        for k in range(len(b) - 199):
            seen[b[k : k + 200]] += 1
    want = []
    for i, b in data:
        mark = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                mark[k : k + 200] = b"\1" * 200
        left = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        want.append((i, len(b), sum(mark), sum(1 for run in bytes(mark).split(b"\0") if run), hashlib.sha256(left).hexdigest()))
    got = [tuple(r) for r in suffix_dedup.remove_repeats(docs).drop("kept").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def fine(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(sum(divmod(2 * int(c), 10)) if n % 2 else int(c) for n, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def test_pii(docs, empty):
    assert pii.digests(pii.find(empty)).count() == 0
    want = []
    for i, t in texts():
        spans = sorted((m.start(), n, k, m.end()) for n, k in enumerate(BASE) for m in re.finditer(BASE[k], t) if fine(k, m[0]))
        listed = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        want.append((i, *(sum(s[2] == k for s in spans) for k in BASE), hashlib.sha256(listed.encode()).hexdigest()))
    found = pii.digests(pii.find(docs)).collect()
    assert sorted((tuple(r)[:6] for r in found), key=str) == sorted(want, key=str)
    assert any(r.spans.count("email") == 3 and r.n_email == 2 for r in found)


def test_pii_additions_and_redaction(spark):
    cases = {"mail me: john (at) example (dot) com now": "mail me: <EMAIL> now", "call (555) 123-4567 ok": "call <PHONE> ok", "order 555-123-4567": None, "we met at noon. Then": None, "a@b.co +1 (988) 555-2485": "<EMAIL> <PHONE>"}
    found = pii.find(spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "doc_id long, text string"))
    got = [r[0] for r in found.orderBy("doc_id").select(pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()]
    assert got == [w or t for t, w in cases.items()]


def test_long_runs_take_linear_time(spark):
    text = "a" * 200_000 + " " + "1" * 200_000 + " " + "1." * 50_000 + " " + "a." * 50_000
    assert pii.digests(pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))).count() == 1


def test_licences(docs, empty):
    assert license_scan.licence_matches(empty).count() == 0
    got = license_scan.licence_matches(docs).where("licence is not null").collect()
    assert {(r.licence, r.dice) for r in got} == {("MIT", 1.0), ("GPL-3.0", 1.0)}
    # Pruned comparison equals plain Dice over all lines and templates.
    want = set()
    for i, t in texts():
        lines = [x for x in t.split("\n") if x]
        for p in [*lines, *(f"{a} {b}" for a, b in zip(lines, lines[1:], strict=False))]:
            w = re.sub(r"[\W_]+", " ", p.lower()).split()
            x = {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)} or set(w)
            scored = [(2 * len(x & y) / (len(x) + len(y)), name) for name, notices in license_scan.TEMPLATES.items() for y in map(set, map(license_scan.template_bigrams, notices))]
            best = max(scored)[0]
            want |= {(i, name) for score, name in scored if score == best >= license_scan.THRESHOLD}
    assert {(r.doc_id, r.licence) for r in got} == want


def test_licences_in_running_text(spark):
    """Notices inside longer lines, wrapped, next to each other and changed; equal to plain Dice over all runs of words."""
    rng = random.Random(6)
    gpl, bsd, mit = license_scan.TEMPLATES["GPL-3.0"][1], license_scan.TEMPLATES["BSD-3-Clause"][1], "Released under the MIT License."
    filler = lambda n: " ".join(rng.choice(["stone", "river", "under", "the", "license", "is"]) for _ in range(n))
    rows = ["Copyright (c) 2024 Example Corp. Released under the MIT License.", "Copyright 2024 by the project authors, all rights reserved. Licensed under the Apache License, Version 2.0.", f"{filler(60)} {bsd} {filler(60)}", f"{gpl} {mit}"]
    rows += [textwrap.fill(gpl, n) for n in (30, 40, 50, 60)] + [filler(150), " ".join(w for n, w in enumerate(gpl.split()) if n % 9 != 4)]
    want = [{"MIT"}, {"Apache-2.0"}, {"BSD-3-Clause"}, {"GPL-3.0", "MIT"}, *[{"GPL-3.0"}] * 4, set(), {"GPL-3.0"}]
    got = defaultdict(dict)
    for r in license_scan.licence_matches(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect():
        got[r.doc_id] |= {r.licence: r.dice} if r.licence else {}
    assert [set(got[k]) for k in range(len(rows))] == want
    for k, t in enumerate(rows):
        w = re.sub(r"[\W_]+", " ", t.lower()).split()
        g, best = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)], 0
        for y in (set(license_scan.template_bigrams(n)) for notices in license_scan.TEMPLATES.values() for n in notices):
            for a in range(len(g)):
                for b in range(a + 1, min(len(g), a + 2 * len(y)) + 1):
                    x = set(g[a:b])
                    best = max(best, 2 * len(x & y) / (len(x) + len(y)))
        assert max(got[k].values(), default=0) == (round(best, 6) if best >= license_scan.THRESHOLD else 0)


def test_quality_counts(docs, empty):
    assert quality_rules.verdicts(quality_rules.counted(empty), quality_rules.fitted(quality_rules.counted(empty))).count() == 0
    want = []
    for i, t in texts():
        w, at = WORDS.findall(t), defaultdict(list)
        for k in range(len(w) - 4):
            at[tuple(w[k : k + 5])].append(k)
        marked = {p + j for v in at.values() if len(v) > 1 for p in v for j in range(5)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked)))
    got = quality_rules.counted(docs).select("doc_id", *(f"counts.{n}" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_compression_classifier(spark, docs, empty):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "river", "and", "stone", "walked", "over", "slowly"]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["BUY!!", "$$$", "click", "NOW!!", "***", "win%%%"]) for _ in range(60))
    rows = [(k, good() if k % 2 else bad()) for k in range(600)] + [(1001, ""), (1002, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(600)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier.scores(table, labels).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k].held_out for k in held)
    assert sum(got[k].predicted == k % 2 for k in held) >= 0.95 * len(held)
    assert all(0 <= got[k].score <= 1 for k in got)
    assert quality_classifier.scores(empty, labels).count() == 0
    assert {r.score for r in quality_classifier.scores(docs, labels.where("false")).collect()} == {0.5}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    library, model, rng = Tokenizer.from_file(public_tokenizers.path(name)), bpe.load(public_tokenizers.path(name)), random.Random(9)
    made = ["".join(rng.choice("abcé \n'tsre.,!0１٣́ßΣ日<|endoftext|>\x00") for _ in range(50)) for _ in range(500)]
    for t in [*(t for _, t in texts()), *made]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert model.encode(t) == ids
        assert model.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_encoding_digests(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, want = Tokenizer.from_file(path), []
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.encoding_digests(docs, path).collect()), key=str) == sorted(want, key=str)
    assert bpe.encoding_digests(empty, path).count() == 0


def test_token_counts(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = [(i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 1024) for i, t in texts()]
    assert sorted(map(tuple, token_counts.token_counts(docs, path).collect()), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(empty, path).count() == 0


def test_counts_at_every_prefix():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, model, rng = Tokenizer.from_file(path), bpe.load(path), random.Random(4)
    made = ["".join(rng.choice(["a", "the", " ", "  ", "\n", "'", "'re", "é", "日", "!", "9", " <|endoftext|>"]) for _ in range(14)) for _ in range(150)]
    for t in made:
        counts = token_counts.PrefixCounts(model, t)
        want = [len(library.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
        assert counts.at == want, t
        cut = counts.fitting(3)
        assert max(want[: cut + 1]) <= 3
        assert cut == len(t) or want[cut + 1] > 3


def test_prefix_counts_take_linear_time():
    model = bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("\n" + "abcdefgh" * 12_500, " " * 100_000, "a b\n" * 25_000, "!" * 100_000 + "<|endoftext|>", "<|endoftext|>" * 8_000):
        began = time.process_time()
        counts = token_counts.PrefixCounts(model, text).at
        assert time.process_time() - began < 10
        assert len(counts) == len(text) + 1
        assert counts[-1] == len(model.encode(text))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library_on_every_code_point(name):
    library, model = Tokenizer.from_file(public_tokenizers.path(name)), bpe.load(public_tokenizers.path(name))
    for lo in range(0, 0x110000, 1024):
        t = "".join(f"a{chr(c)}1{chr(c)}{chr(c)}!{chr(c)} " for c in range(lo, lo + 1024) if not 0xD800 <= c < 0xE000)
        assert model.encode(t) == library.encode(t, add_special_tokens=False).ids, hex(lo)


def test_memo_is_bounded_by_characters():
    memo = bpe.Memo(str.upper, size=10_000)
    for k in range(2000):
        assert memo[f"{k}" * 20] == f"{k}" * 20
    assert memo["x" * 50_000] == "X" * 50_000
    assert sum(len(k) for k in [*memo, *memo.older]) <= 20_000


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, docs, empty, tmp_path, encoding):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    token_output.write_token_files(docs, f"file://{tmp_path}/ids", path, encoding=encoding)
    got = sorted(map(tuple, token_output.with_checksum(token_output.read_token_files(spark, f"file://{tmp_path}/ids")).collect()), key=lambda r: r[1])
    want, start = [], 0
    for i, t in sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert token_output.token_file_digests(empty, path).count() == 0


def test_decontamination(spark, docs, empty):
    rng = random.Random(8)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(900)]
    item = [" ".join(rng.sample(words, 40)) + "." for _ in range(12)]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(item)] + [(50, None), (51, "")], "item_id long, text string")
    dropped = [" ".join(w for n, w in enumerate(t.split()) if n % 8 != 3) for t in item]
    inserted = [" ".join(f"{w} zug" if n % 9 == 4 else w for n, w in enumerate(t.split())) for t in item]
    filler = lambda: " ".join(rng.choices(words, k=90))
    rows = [(100 + k, f"{filler()} {t} {filler()}") for k, t in enumerate(item)] + [(200 + k, f"{filler()} {t} {filler()}") for k, t in enumerate(dropped)] + [(300 + k, t) for k, t in enumerate(inserted)] + [(400 + k, filler() + filler()) for k in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(table, bench).collect()}
    assert got == {(b + k, k) for b in (100, 200, 300) for k in range(12)}
    assert decontamination.leaks(empty, bench).count() == 0
    assert decontamination.leaks(docs, bench).count() == 0
    assert decontamination.leaks(table, bench.where("false")).count() == 0


def test_decontamination_of_an_item_in_most_documents(spark):
    """All words of such an item are frequent; they stay terms."""
    rng = random.Random(9)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(5000)]
    hot, rare = " ".join(words[:30]), " ".join(words[30:60])
    filler = lambda: " ".join(rng.sample(words[100:], 60))
    rows = [(k, f"{filler()} {hot} {filler()}" if k % 3 else f"{filler()} {filler()}") for k in range(60)] + [(60, f"{filler()} {rare}")]
    bench = spark.createDataFrame([(0, hot), (1, rare), (2, "zzyzx")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(spark.createDataFrame([*rows, (61, "so zzyzx it is")], "doc_id long, text string"), bench).collect()}
    assert got == {(k, 0) for k in range(60) if k % 3} | {(60, 1), (61, 2)}


def test_decontamination_of_short_items_in_a_large_corpus():
    """Short items in passages of other words, with counts as of three million documents: verbatim ones of any length, and changed ones."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(n)).encode()
    common, other = [word(3) for _ in range(300)], [word(5) for _ in range(3000)]
    items = [(k, b" ".join(rng.sample(common, n)).decode()) for k, n in enumerate([1, 2, 3, 5, 8, 8, 12, 16] * 6)]
    sample = [rng.choices(other, k=200) for _ in range(100)]
    block = decontamination.Block(items)
    block.weigh(dict.fromkeys(range(len(block.vocab)), 150_000), 3_000_000, sample)
    block.place(np.eye(len(block.vocab), dtype=np.float32))
    for k, (_, words) in enumerate(block.items):
        around = [rng.choices(other, k=60) for _ in range(2)]
        assert k in block.search(around[0] + words + around[1])
        if len(words) >= 8:
            changed = [w for n, w in enumerate(words) if n % 6 != 3]
            assert k in block.search(around[0] + changed + around[1])


def perturbed_corpus(seed, n_items):
    """Items, and documents that hold each one with words dropped, replaced or inserted."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(1500)]
    items = [(k, " ".join(rng.sample(words, rng.randint(8, 60)))) for k in range(n_items)]
    rows = []
    for k, t in items:
        for share in (0.0, 0.1, 0.2, 0.3):
            for how in ("drop", "replace", "insert"):
                out = []
                for w in t.split():
                    if rng.random() < share:
                        out += [] if how == "drop" else [rng.choice(words)] if how == "replace" else [w, rng.choice(words)]
                    else:
                        out.append(w)
                filler = [" ".join(rng.choices(words, k=rng.randint(5, 120))) for _ in range(2)]
                rows.append((len(rows), f"{filler[0]} {' '.join(out)} {filler[1]}"))
    return items, rows + [(10_000 + k, " ".join(rng.choices(words, k=150))) for k in range(100)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("rank", [256, 8])
def test_decontamination_recall_against_every_pair(spark, monkeypatch, rank):
    """All pairs by longest common subsequence, also with a space of too few directions; equal results however rows are dealt."""
    monkeypatch.setattr(decontamination, "RANK", rank)
    items, rows = perturbed_corpus(3, 25)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = []
    for parts in (2, 16):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got.append(sorted(map(tuple, decontamination.leaks(docs, bench).collect())))
    assert got[0] == got[1]
    want = set()
    for i, t in rows:
        w = t.split()
        for k, item in items:
            x = item.split()
            if len(set(x) & set(w)) >= 0.65 * len(x):
                best = max(lcs(x, w[at : at + 2 * len(x)]) for at in range(0, max(1, len(w) - len(x)), 4))
                want |= {(i, k)} if best >= 0.65 * len(x) else set()
    found = {(r[0], r[1]) for r in got[0]}
    assert len(found & want) >= 0.97 * len(want) > 200
    assert not {i for i, _ in found if i >= 10_000}


def test_decontamination_space_of_all_documents(spark, monkeypatch):
    """A space one direction too small gives up the item that no document holds, and long documents count as others do."""
    rng = random.Random(31)
    placed = []
    place = decontamination.Block.place
    monkeypatch.setattr(decontamination, "RANK", 4)
    monkeypatch.setattr(decontamination.Block, "place", lambda block, space: (placed.append((block, space)), place(block, space)))
    items = [(k, " ".join(f"item{k}word{n}" for n in range(8))) for k in range(5)]
    rows = [(d, " ".join(f"{' '.join(f'other{rng.randrange(900)}' for _ in range(40))} {items[(0, 1, 3, 4)[d % 4]][1]}" for _ in range(50))) for d in range(40)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontamination.leaks(docs, bench).count() == 40
    (block, space), *more = placed
    assert not more
    kept = [sum(space[block.vocab[w.encode()]] for w in t.split()) / 8**0.5 for _, t in items]
    assert [round(float(x @ x), 2) for x in kept] == [1, 1, 0, 1, 1]
    # Four items in ten documents each: other words weigh as much as theirs.
    assert abs(block.weights[-1] - (np.log(41 / 11) + 1)) < 1e-9


def test_decontamination_counts_and_space_against_plain_loops(spark, monkeypatch):
    """Counts and mean products of every passage of every document: more than a sample's, long, empty and repeated ones."""
    rng = random.Random(32)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.sample(words[:200], 30))) for k in range(9)]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 200)))) for k in range(300)] + [(None, ""), (None, None), (7, " ".join(rng.choices(words[:60], k=30_000)))]
    rows.append(rows[0])
    texts_of = [decontamination.words_of(t or "") for _, t in rows]
    got = []
    for parts in (1, 7):
        docs = decontamination.texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts))
        block = decontamination.Block(items)
        counts, documents, numbers = decontamination._document_counts(docs, block)
        assert documents == len(rows)
        assert counts == {k: n for w, k in block.vocab.items() if (n := sum(w in t for t in map(set, texts_of)))}
        kept = numbers.where("words is not null").collect()
        assert sorted(tuple(block.unpacked(r.words)) for r in kept) == sorted(tuple(block.vocab.get(w, -1) for w in t) for t in texts_of)
        block.weigh(counts, documents)
        got.append(decontamination._corpus_space(numbers, block))
        decontamination.drop_scratch(numbers)
    assert (got[0] == got[1]).all()
    want, n = np.zeros((len(block.vocab),) * 2), 0
    for t in texts_of:
        for at in range(0, len(t), decontamination.PASSAGE):
            v = np.zeros(len(block.vocab))
            for w in t[at : at + decontamination.PASSAGE]:
                if w in block.vocab:
                    v[block.vocab[w]] += block.idf[block.vocab[w]]
            if v.any():
                want, n = want + np.outer(v, v) / (v @ v), n + 1
    assert np.abs(got[0] @ got[0].T - want / n).max() < 1e-4
    # With columns for a part of the terms only, what is kept is no more than there is, and most of its largest direction.
    monkeypatch.setattr(decontamination, "RANK", 30)
    _, _, numbers = decontamination._document_counts(docs, block)
    part = decontamination._corpus_space(numbers, block)
    values, vectors = np.linalg.eigh(want / n)
    assert part.shape[1] <= 62
    assert np.linalg.eigvalsh(want / n - part @ part.T).min() > -1e-4
    assert ((part.T @ vectors[:, -1]) ** 2).sum() > 0.8 * values[-1]


def test_decontamination_of_short_items_wants_them_in_sequence(spark):
    bench = spark.createDataFrame([(1, "alpha bravo charlie delta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "foo alpha one bravo two charlie three delta bar"), (2, "foo Alpha, bravo charlie delta bar")], "doc_id long, text string")
    assert {r.doc_id for r in decontamination.leaks(docs, bench).collect()} == {2}


def test_decontamination_of_a_very_long_text():
    rng = random.Random(2)
    words = [f"w{rng.randrange(5000)}".encode() for _ in range(400_000)]
    item = [f"w{k}".encode() for k in rng.sample(range(5000), 40)]
    block = decontamination.Block([(1, b" ".join(item).decode())])
    block.weigh({}, 100, [words[:500]])
    block.place(np.eye(len(block.vocab), dtype=np.float32))
    tracemalloc.start()
    assert block.search(words) == {}
    assert list(block.search([*words[:200_000], *item[:15], b"zz", *item[16:], *words[200_000:]])) == [0]
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert decontamination.common_subsequence(a, b) == lcs(a, b)


def test_pipeline(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Nothing of this is in any text here at all, so all stay.")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "bpe":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(now.count())
    assert sizes[0] > sizes[1] == sizes[2] == sizes[3] == sizes[4]
    plain = spark.read.parquet(f"{tmp_path}/pii").where("text like '%<EMAIL>%'")
    assert plain.count() >= 1
    assert plain.where("n_chars <> length(text)").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sizes[4]


def test_pipeline_decontamination_space_of_all_documents(spark, monkeypatch, tmp_path):
    """The stage's space follows documents of any length: with a direction too few it gives up the item that none holds."""
    placed = []
    place = decontamination.Block.place
    monkeypatch.setattr(decontamination, "RANK", 2)
    monkeypatch.setattr(decontamination.Block, "place", lambda block, space: (placed.append((block, space)), place(block, space)))
    items = [(k, " ".join(f"item{k}word{n}" for n in range(8))) for k in range(3)]
    rows = [(d, " ".join(f"{'other ' * 40}{items[d % 2 * 2][1]}" for _ in range(50))) for d in range(20)] + [(20, "nothing of it")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert [r.doc_id for r in left.collect()] == [20]
    ((block, space),) = placed
    kept = [sum(space[block.vocab[w.encode()]] for w in t.split()) / 8**0.5 for _, t in items]
    assert [round(float(x @ x), 2) for x in kept] == [1, 0, 1]


def test_pipeline_rows_with_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4))
    one, two, three, item = (" ".join(word() for _ in range(40)) for _ in range(4))
    rows = [(1, one), (None, one), (None, one + " more"), (2, two), (2, three), (2, three), (None, f"{two} {item}"), (3, ""), (3, ""), (None, None), (2, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, one), (2, two), (2, three), (None, f"{two} {item}"), (3, ""), (3, ""), (None, None), (2, item)], key=str)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.decontaminate(spark, got, str(tmp_path))
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(1, one), (2, two), (2, three), (3, ""), (3, ""), (None, None)], key=str)
