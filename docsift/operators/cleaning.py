"""Block cleaning: repeated margins, titles, section paths and paragraphs that go on over a page break.

``cleaned`` runs all steps over whole documents and falls back to a document's own blocks where the outcome cannot be traced.
Every step is a window or an aggregation within a document, so one shuffle by document serves nearly all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.config import DEFAULT, Config
from docsift.functions.text import normalized, repeat_key, strip
from docsift.sources.scratch import dealt, materialize

# Block types with rules of their own.
PROTECTED = ["table", "formula", "equation", "interline_equation", "image", "chart", "code"]
ATOMIC = ["table", "formula", "equation", "interline_equation"]
PRESERVED = ["table", "formula", "equation", "interline_equation", "page_footnote", "footnote", "ref_text", "reference"]
EMPTY_OUT = ["text", "paragraph", "title", "header", "footer", "page_number"]
PARAGRAPHS = ["text", "paragraph"]
UNTITLED = ["list", "caption", "ref_text", "reference", "page_footnote", "footnote"]
KNOWN = [*PROTECTED, *PARAGRAPHS, "title", "caption", "list", "page_footnote", "footnote", "ref_text", "reference", "header", "footer", "page_number", "discarded"]
# Numbering rules of titles with their name and level (None: by the number of dots), then the weak rules, and
# the prefixes and endings that decide about titles and merging.
NUMBER = "[一二三四五六七八九十百千零〇两]+"
TITLES = [
    ("chinese_chapter", rf"(?U)^第(?:[0-9]+|{NUMBER})章(?:\s*[:：、.]?\s*.*)?$", 1),
    ("chinese_section", rf"(?U)^第(?:[0-9]+|{NUMBER})节(?:\s*[:：、.]?\s*.*)?$", 2),
    ("arabic_hierarchy", r"(?U)^([0-9]+(?:\.[0-9]+){0,5})(?:[.、])?\s+\S.+$", None),
    ("arabic_compact", r"(?U)^([0-9]+(?:\.[0-9]+){0,5})[.、]([A-Z\x{3400}-\x{9fff}]\S*)$", None),
    ("chinese_major", rf"(?U)^{NUMBER}、\s*\S.+$", 1),
    ("chinese_parenthesized", rf"(?U)^[（(]{NUMBER}[）)]\s*\S.+$", 2),
]
WEAK_TITLES = [("arabic_parenthesized", r"(?U)^(?:[（(][0-9]+[）)]|[0-9]+[）)])\s*\S.+$", 3), ("circled_number", r"(?U)^[①②③④⑤⑥⑦⑧⑨⑩]\s*\S.+$", 3)]
HEADING = rf"(?U)^(?:第(?:[0-9]+|{NUMBER})[章节]|[0-9]+(?:\.[0-9]+)*[.、]?\s+|[0-9]+(?:\.[0-9]+)*[.、][A-Z\x{{3400}}-\x{{9fff}}]|{NUMBER}、|[（(](?:[0-9]+|{NUMBER})[）)]|[0-9]+[）)]|[①②③④⑤⑥⑦⑧⑨⑩])"
CAPTION = r"(?i)^(?:图|表|Figure|Table)\s*[A-Za-z0-9一二三四五六七八九十.-]+"
REFERENCE = r"^\s*(?:\[[0-9]+\]|[0-9]+[.)、])\s*"
PAGE_ONLY = r"(?iU)^\s*(?:[-—–]\s*)?(?:[0-9]+|[ivxlcdm]+)(?:\s*[-—–])?\s*$"
SENTENCE_ENDS = "[。.！!？?]$"
ENDS = "[。！？.!?；;：:]$"
CONTINUES = "^(?:的|了|和|与|及|或|而|并|但|则|其|这|该|其中|以及|同时)"
COUNTERS = {"normalize_text": "normalized_blocks", "promote_title": "promoted_titles", "assign_title_level": "assigned_title_levels", "cross_page_paragraph_merge": "merged_cross_page_paragraphs"}
MARGIN_COUNTERS = {"repeated_header": "excluded_headers", "repeated_footer": "excluded_footers", "page_number": "excluded_page_numbers"}
OPERATION = "struct<op:string,rule:string>"


def _operation(when: Column, name: str, rule: Column | str) -> Column:
    """The operations of a block with one more where the condition holds."""
    new = F.array(F.struct(F.lit(name).alias("op"), (rule if isinstance(rule, Column) else F.lit(rule)).alias("rule")))
    return F.when(F.coalesce(when, F.lit(False)), F.concat("operations", new)).otherwise(F.col("operations"))


def prepared(blocks: DataFrame) -> DataFrame:
    """Blocks with every column that cleaning reads; document_id, block_seq and text must be there, others have defaults.

    A block without an id gets one from its document, page, place and text; a block is atomic by its type unless it says so.
    """
    have = set(blocks.columns)
    given = lambda name, kind: F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
    page = F.coalesce(given("page_start", "int"), given("page", "int"), F.lit(1))
    text = F.coalesce(F.col("text"), F.lit(""))
    made = F.concat(F.lit("block_"), F.left(F.sha2(F.to_json(F.array(F.col("document_id").cast("string"), page.cast("string"), F.col("block_seq").cast("string"), text)), 256), F.lit(20)))
    kind = F.when(given("block_type", "string") == "", "unknown").otherwise(F.coalesce(given("block_type", "string"), F.lit("text")))
    block_id = F.coalesce(given("block_id", "string"), made)
    sources = F.when(F.size(given("source_block_ids", "array<string>")) > 0, given("source_block_ids", "array<string>")).otherwise(F.array(block_id))
    new = {
        "text": text,
        "block_id": block_id,
        "source_block_ids": sources,
        "block_type": kind,
        "page_start": page,
        "page_end": F.coalesce(given("page_end", "int"), page),
        "title_level": F.coalesce(given("title_level", "int"), given("text_level", "int")),
        "bbox": given("bbox", "array<double>"),
        "page_height": given("page_height", "double"),
        "atomic": F.coalesce(given("atomic", "boolean"), kind.isin(ATOMIC)),
        "excluded": F.coalesce(given("excluded", "boolean"), F.lit(False)),
        "excluded_reason": given("excluded_reason", "string"),
        "operations": given("operations", f"array<{OPERATION}>"),
    }
    return blocks.withColumns(new | {"operations": F.coalesce(new["operations"], F.array().cast(f"array<{OPERATION}>"))})


def normalized_blocks(blocks: DataFrame) -> DataFrame:
    """Plain text in normal form; objects and code stay as they are, and blocks of text without any are left out."""
    text = F.when(F.col("block_type").isin(PROTECTED), F.col("text")).otherwise(normalized(F.col("text")))
    rows = blocks.withColumn("plain", text)
    rows = rows.withColumn("operations", _operation(F.col("plain") != F.col("text"), "normalize_text", "collapse_plain_spaces")).withColumn("text", F.col("plain")).drop("plain")
    empty = (strip(F.col("text")) == "") & F.col("block_type").isin(EMPTY_OUT)
    return rows.withColumns({"excluded": F.col("excluded") | empty, "excluded_reason": F.when(empty, F.coalesce("excluded_reason", F.lit("empty_text"))).otherwise(F.col("excluded_reason"))})


def _as_prepared(blocks: DataFrame) -> DataFrame:
    return blocks if {"operations", "page_start", "page_height"} <= set(blocks.columns) else prepared(blocks)


def margin_candidates(blocks: DataFrame) -> DataFrame:
    """Adds pages of the document, and position and key of blocks that may be a margin, null for others.

    The type decides, then the box; without a box of known scale the first two and last two blocks of a page are candidates,
    a header before a footer on short pages.
    """
    rows = _as_prepared(blocks)
    page = Window.partitionBy("document_id", "page_start")
    rows = rows.withColumns({"from_top": F.row_number().over(page.orderBy("block_seq")), "on_page": F.count("*").over(page)})
    box = F.when(F.size("bbox") >= 4, bbox_position(F.col("bbox")[1], F.col("bbox")[3], F.col("page_height")))
    by_order = F.when(F.col("from_top") <= 2, "header").when(F.col("from_top") > F.col("on_page") - 2, "footer")
    position = F.when(F.col("block_type") == "header", "header").when(F.col("block_type").isin("footer", "page_number"), "footer").when(box.isin("header", "footer"), box).when(box.isNull(), by_order)
    position = F.when(strip(F.col("text")) != "", position)
    rows = rows.withColumns({"position": position, "key": F.when(position.isNotNull(), repeat_key(F.col("text")))})
    # The number of pages is the largest dense rank.
    rows = rows.withColumn("page_rank", F.dense_rank().over(Window.partitionBy("document_id").orderBy("page_start")))
    return rows.withColumn("pages", F.max("page_rank").over(Window.partitionBy("document_id"))).drop("from_top", "on_page", "page_rank")


def _repeats(hits: Column, config: Config) -> Column:
    return (F.col("pages") >= config.margin_pages) & ((hits >= config.margin_hits) | (hits / F.col("pages") >= config.margin_share))


def repeated_margins(blocks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """document_id, position, key, pages on which it stands, of documents with three pages or more."""
    found = margin_candidates(blocks).where("position is not null").groupBy("document_id", "position", "key")
    return found.agg(F.countDistinct("page_start").alias("hits"), F.max("pages").alias("pages")).where(_repeats(F.col("hits"), config))


def without_margins(blocks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Blocks whose template repeats in one position on enough pages are excluded, with the reason."""
    same = Window.partitionBy("document_id", "position", "key")
    rows = margin_candidates(blocks).withColumn("nth_page", F.dense_rank().over(same.orderBy("page_start"))).withColumn("hits", F.max("nth_page").over(same))
    out = F.col("position").isNotNull() & _repeats(F.col("hits"), config) & (~F.col("excluded") | F.coalesce(F.col("excluded_reason") == "empty_text", F.lit(False)))
    reason = F.when((F.col("block_type") == "page_number") | F.col("text").rlike(PAGE_ONLY), "page_number").otherwise(F.concat(F.lit("repeated_"), "position"))
    rows = rows.withColumn("out", F.coalesce(out, F.lit(False))).withColumn("operations", _operation(F.col("out"), "exclude_repeated_margin", reason))
    return rows.withColumns({"excluded": F.col("excluded") | F.col("out"), "excluded_reason": F.when(F.col("out"), reason).otherwise(F.col("excluded_reason"))}).drop("position", "key", "pages", "nth_page", "hits", "out")


def title_rule(text: Column, marked: Column) -> Column:
    """struct(level, rule) by the numbering rules, the weak ones only for blocks that the parser marked as titles; null if none fits."""
    found = F
    for name, pattern, fixed in TITLES:
        dots = F.regexp_extract(text, pattern, 1)
        level = F.lit(fixed) if fixed else F.least(F.lit(6), F.length(dots) - F.length(F.replace(dots, F.lit("."), F.lit(""))) + 1)
        found = found.when(text.rlike(pattern), F.struct(level.cast("int").alias("level"), F.lit(name).alias("rule")))
    for name, pattern, fixed in WEAK_TITLES:
        found = found.when(marked & text.rlike(pattern), F.struct(F.lit(fixed).alias("level"), F.lit(name).alias("rule")))
    return found


def _open_to_titles(text: Column) -> Column:
    return (text != "") & (F.length(text) <= 100) & ~F.col("block_type").isin(UNTITLED) & ~text.rlike(CAPTION) & ~text.rlike(SENTENCE_ENDS)


def _only_reference(text: Column) -> Column:
    return text.rlike(REFERENCE) & (F.length(text) < 8) & ~text.rlike(HEADING)


def titles(blocks: DataFrame) -> DataFrame:
    """Adds level: null for lists, notes, references, long texts, captions and texts that end a sentence."""
    text, marked = strip(F.col("text")), F.col("block_type") == "title"
    return blocks.withColumn("level", F.when(_open_to_titles(text) & (marked | ~_only_reference(text)), title_rule(text, marked)["level"]))


def classified(blocks: DataFrame) -> DataFrame:
    """Texts with a clear number become titles; levels follow the number, else a parser's level from 1 to 6 stays."""
    text, marked = F.col("bare"), F.col("block_type") == "title"
    rows = blocks.withColumn("bare", strip(F.col("text")))
    rows = rows.withColumn("open", ~F.col("excluded") & _open_to_titles(text)).withColumn("found", F.when(F.col("open"), title_rule(text, marked)))
    promote = ~marked & F.col("found").isNotNull() & ~_only_reference(text)
    rows = rows.withColumn("promote", promote).withColumn("operations", _operation(F.col("promote"), "promote_title", F.col("found.rule")))
    takes = F.col("found").isNotNull() & (marked | F.col("promote"))
    rows = rows.withColumn("takes", takes).withColumn("operations", _operation(F.col("takes") & ~F.col("title_level").eqNullSafe(F.col("found.level")), "assign_title_level", F.col("found.rule")))
    unsure = F.col("open") & marked & F.col("found").isNull() & ~F.coalesce(F.col("title_level").between(1, 6), F.lit(False))
    level = F.when(F.col("takes"), F.col("found.level")).when(unsure, F.lit(None)).otherwise(F.col("title_level"))
    return rows.withColumns({"title_level": level.cast("int"), "block_type": F.when(F.col("promote"), "title").otherwise(F.col("block_type"))}).drop("bare", "open", "found", "promote", "takes")


def section_paths(blocks: DataFrame) -> DataFrame:
    """Adds depth and section_path to blocks with document_id, block_seq, text, level.

    The stack of open sections has a closed form: with levelled titles numbered k = 0, 1, .. its depth after title k is
    k + min(1, least of level_j - j up to k), so running minima and last values replace the loop.
    """
    order = Window.partitionBy("document_id").orderBy("block_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    k = F.sum(F.col("level").isNotNull().cast("int")).over(order) - 1
    rows = blocks.withColumn("k", k).withColumn("low", F.min(F.col("level") - F.col("k")).over(order))
    rows = rows.withColumn("depth", F.when(F.col("k") < 0, 0).otherwise(F.col("k") + F.least(F.lit(1), F.col("low"))).cast("int"))
    is_title = F.col("level").isNotNull()
    entries = [F.last(F.when(is_title & (F.col("depth") == d), F.col("text")), ignorenulls=True).over(order) for d in range(1, 7)]
    return rows.withColumn("section_path", F.slice(F.array(*entries), F.lit(1), F.greatest(F.col("depth"), F.lit(0)))).drop("k", "low")


def sections(blocks: DataFrame) -> DataFrame:
    """Adds section_path and level_gap, and sets the level of each title to its place in the path.

    Excluded blocks and text have the path that is open; a title without a level stands on top of it and does not change it.
    A level that skips one is a gap, and becomes the next one.
    """
    counts = ~F.col("excluded") & (F.col("block_type") == "title")
    rows = section_paths(blocks.withColumn("level", F.when(counts, F.col("title_level"))))
    loose = counts & F.col("title_level").isNull()
    gap = F.coalesce(F.col("level") > F.col("depth"), F.lit(False))
    return rows.withColumns({"section_path": F.when(loose, F.concat("section_path", F.array("text"))).otherwise(F.col("section_path")), "level_gap": gap, "title_level": F.when(F.col("level").isNotNull(), F.col("depth")).otherwise(F.col("title_level"))}).drop("level", "depth")


def merge_rule(left: Column, right: Column) -> Column:
    """struct(text, rule) of two paragraphs where the second surely goes on from the first, else null."""
    a, b = F.rtrim(left), F.ltrim(right)
    apart = (a == "") | (b == "") | a.rlike(ENDS) | b.rlike(HEADING) | ((F.length(b) <= 12) & b.rlike(ENDS))
    cjk = (a.rlike(r"[\x{3400}-\x{9fff}]$") | a.rlike("[，、]$")) & b.rlike(r"^[\x{3400}-\x{9fff}]") & (a.rlike("[，、]$") | b.rlike(CONTINUES))
    pair = lambda text, rule: F.struct(text.alias("text"), F.lit(rule).alias("rule"))
    return (
        F.when(apart, F.lit(None))
        .when(a.rlike("[A-Za-z]-$") & b.rlike("^[A-Za-z]"), pair(F.concat(F.substring(a, F.lit(1), F.length(a) - 1), b), "english_hyphenated_word"))
        .when(a.rlike("[A-Za-z]$") & b.rlike("^[a-z]"), pair(F.concat_ws(" ", a, b), "english_lowercase_continuation"))
        .when(cjk, pair(F.concat(a, b), "chinese_conservative_continuation"))
    )


def cross_page_merges(blocks: DataFrame) -> DataFrame:
    """document_id, page, left_seq, right_seq, text, rule of the paragraphs that are merged over a page break.

    The last block of a page that is not excluded and the first one of the next page are held against each other.  A block
    serves once, which matters only on pages of one block: chains of mergeable pairs through such pages take every other
    pair, beginning with the first.
    """
    have = set(blocks.columns)
    page = F.col("page_start") if "page_start" in have else F.col("page")
    rows = blocks.where(~F.col("excluded")) if "excluded" in have else blocks
    kind = F.col("block_type") if "block_type" in have else F.lit("text")
    block = F.struct("block_seq", "text", (kind.isin(PARAGRAPHS) & (strip(F.col("text")) != "")).alias("paragraph"))
    ends = rows.groupBy("document_id", page.alias("page")).agg(F.max_by(block, "block_seq").alias("last"), F.min_by(block, "block_seq").alias("first"), F.count("*").alias("n"))
    by_page = Window.partitionBy("document_id").orderBy("page")
    after = F.when(F.lead("page").over(by_page) == F.col("page") + 1, F.lead("first").over(by_page))
    pairs = ends.withColumn("next", after).withColumn("joined", F.when(F.col("last.paragraph") & F.col("next.paragraph"), merge_rule(F.col("last.text"), F.col("next.text"))))
    chained = (F.lag("joined").over(by_page).isNotNull()) & (F.lag("page").over(by_page) == F.col("page") - 1) & (F.col("n") == 1)
    marked = pairs.withColumn("start", F.when(F.col("joined").isNotNull() & F.coalesce(chained, F.lit(False)), 0).otherwise(1))
    chains = marked.withColumn("chain", F.sum("start").over(by_page))
    place = F.row_number().over(Window.partitionBy("document_id", "chain").orderBy("page"))
    return chains.withColumn("place", place).where("joined is not null and place % 2 = 1").select("document_id", "page", F.col("last.block_seq").alias("left_seq"), F.col("next.block_seq").alias("right_seq"), "joined.text", "joined.rule")


def merged(blocks: DataFrame) -> DataFrame:
    """The merged text stands at its first half, with the ids and pages of both; the second half is marked as gone.

    The pairs are those of ``cross_page_merges``, found by windows, so that no block is joined.
    """
    order = Window.partitionBy("document_id").orderBy("excluded", "page_start", "block_seq")
    page = Window.partitionBy("document_id", "excluded", "page_start")
    paragraph = F.col("block_type").isin(PARAGRAPHS) & (strip(F.col("text")) != "")
    rows = blocks.withColumn("paragraph", paragraph & ~F.col("excluded"))
    rows = rows.withColumns({"ends_page": ~F.col("excluded") & (F.col("block_seq") == F.max("block_seq").over(page)), "on_page": F.count("*").over(page)})
    second = F.lead(F.struct("paragraph", "page_start", "page_end", "text", "source_block_ids")).over(order)
    rows = rows.withColumn("second", F.when(F.col("ends_page"), second))
    fits = F.col("paragraph") & F.col("second.paragraph") & (F.col("second.page_start") == F.col("page_start") + 1)
    rows = rows.withColumn("join", F.when(fits, merge_rule(F.col("text"), F.col("second.text"))))
    # A block serves once: chains through pages of one block take every other pair.
    ends = Window.partitionBy("document_id").orderBy(F.desc("ends_page"), "page_start")
    chained = F.lag("join").over(ends).isNotNull() & (F.lag("page_start").over(ends) == F.col("page_start") - 1) & (F.col("on_page") == 1)
    rows = rows.withColumn("start", F.when(F.col("join").isNotNull() & F.coalesce(chained, F.lit(False)), 0).otherwise(1)).withColumn("chain", F.sum("start").over(ends))
    place = F.row_number().over(Window.partitionBy("document_id", "ends_page", "chain").orderBy("page_start"))
    rows = rows.withColumn("picked", F.col("join").isNotNull() & (place % 2 == 1))
    rows = rows.withColumn("gone", F.coalesce(F.lag("picked").over(order), F.lit(False)))
    is_pair, ids = F.col("picked"), F.array_distinct(F.concat("source_block_ids", "second.source_block_ids"))
    merged_id = F.concat(F.lit("merged_"), F.left(F.sha2(F.array_join(ids, "\u0000"), 256), F.lit(20)))
    new = {
        "operations": _operation(is_pair, "cross_page_paragraph_merge", F.col("join.rule")),
        "text": F.when(is_pair, F.col("join.text")).otherwise(F.col("text")),
        "block_id": F.when(is_pair, merged_id).otherwise(F.col("block_id")),
        "source_block_ids": F.when(is_pair, ids).otherwise(F.col("source_block_ids")),
        "page_end": F.when(is_pair, F.col("second.page_end")).otherwise(F.col("page_end")),
    }
    return rows.withColumns(new).drop("paragraph", "ends_page", "on_page", "second", "join", "start", "chain", "picked")


def traced(blocks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """All blocks through every step, with what they were (given_id, given_type); those that were merged into another are gone.

    Blocks are shuffled once, by document, into parts of bounded size, and every step is a window within a document.
    """
    rows = prepared(dealt(blocks, "document_id")).withColumns({"given_id": F.col("block_id"), "given_type": F.col("block_type")})
    return sections(merged(classified(without_margins(normalized_blocks(rows), config))))


def audit(done: DataFrame) -> DataFrame:
    """Of traced blocks one row for each document: counters, warnings, and the first rule that it breaks, null for a sound one.

    Ids are unique, every block is traced to the blocks it came from and none is lost, pages and levels are in range, merges
    span one page break, and the number of objects, notes and references is unchanged.
    """
    kept = lambda c: F.when(~F.col("gone"), c)
    span = F.exists("operations", lambda o: o["op"] == "cross_page_paragraph_merge")
    bad = {
        "page range": (F.col("page_start") < 1) | (F.col("page_end") < F.col("page_start")),
        "title level": ~F.coalesce(F.col("title_level").between(1, 6), F.lit(True)),
        "merge span": span & (F.col("page_end") != F.col("page_start") + 1),
    }

    def times(op: str, rule: str | None = None) -> Column:
        is_it = lambda o: (o["op"] == op) & (F.lit(True) if rule is None else o["rule"] == rule)
        return F.sum(kept(F.size(F.filter("operations", is_it))))

    counted = {"output_blocks": F.count_if(~F.col("gone"))} | {name: times(op) for op, name in COUNTERS.items()} | {name: times("exclude_repeated_margin", rule) for rule, name in MARGIN_COUNTERS.items()}
    unknown = F.when(~F.col("block_type").isin([*KNOWN]), F.concat(F.lit("unknown_block_type "), "block_id"))
    gaps = F.when(F.col("level_gap"), F.concat(F.lit("title_level_gap "), "block_id"))
    rows = done.groupBy("document_id").agg(
        F.count("*").alias("input_blocks"),
        *(c.alias(name) for name, c in counted.items()),
        F.array_sort(F.flatten(F.collect_list(kept(F.array_compact(F.array(unknown, gaps)))))).alias("warnings"),
        F.array_sort(F.collect_set("given_id")).alias("ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(kept(F.col("source_block_ids")))))).alias("traced"),
        F.collect_list(kept(F.col("block_id"))).alias("own"),
        *(F.max(kept(c)).alias(name.replace(" ", "_")) for name, c in bad.items()),
        *(F.count_if(F.col("given_type") == k).alias(f"n_{k}") for k in PRESERVED),
        *(F.count_if(~F.col("gone") & (F.col("block_type") == k)).alias(f"new_{k}") for k in PRESERVED),
    )
    changed = reduce(lambda x, y: x | y, [F.col(f"n_{k}") != F.col(f"new_{k}") for k in PRESERVED])
    reason = F.when(F.size("own") != F.size(F.array_distinct("own")), "repeated block id").when(F.col("ids") != F.col("traced"), "trace")
    for name in bad:
        reason = reason.when(F.col(name.replace(" ", "_")), name)
    rows = rows.withColumn("reason", reason.when(changed, "preserved types"))
    fallen = F.col("reason").isNotNull()
    counters = [F.when(fallen, F.lit(0)).otherwise(F.coalesce(F.col(n), F.lit(0))).alias(n) for n in counted]
    return rows.select("document_id", "input_blocks", *counters, F.when(fallen, F.array(F.concat(F.lit("postprocess_failed "), "reason"))).otherwise(F.col("warnings")).alias("warnings"), fallen.alias("fail_open"))


def cleaned(blocks: DataFrame, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Cleaned blocks, and one audit row for each document: counters, warnings, and whether it fell back to its own blocks.

    A document whose cleaned blocks break a rule of ``audit`` comes back as it was, with fail_open set and no counts.
    Null texts count as empty; documents do not see each other; an empty table gives two empty tables.
    """
    done = materialize(traced(blocks, config), "cleaned")
    report = materialize(audit(done), "cleaning-audit")
    broken = report.where("fail_open").select("document_id")
    sound = done.where(~F.col("gone")).join(broken, "document_id", "left_anti")
    columns = [c for c in done.columns if c not in ("section_path", "level_gap", "gone", "given_id", "given_type")]
    plain = prepared(blocks.join(broken, "document_id", "left_semi")).select(*columns, F.array().cast("array<string>").alias("section_path"), F.lit(False).alias("level_gap"))
    return sound.select(*columns, "section_path", "level_gap").union(plain), report


def bbox_position(y0: Column, y1: Column, height: Column) -> Column:
    """header, footer or body of a block by its box; null if the box is of unknown scale."""
    scaled = height.isNotNull() & (height != 0)
    top, end = (F.when(scaled, y / F.nullif(height, F.lit(0.0))).when(height.isNull() & y0.between(0, 1) & y1.between(0, 1), y) for y in (y0, y1))
    return F.when(top.isNull() | end.isNull(), F.lit(None)).when(end <= 0.20, "header").when(top >= 0.80, "footer").otherwise("body")


def type_counts(blocks: DataFrame) -> DataFrame:
    """document_id and a map of block types to their number of blocks."""
    n = blocks.groupBy("document_id", "block_type").agg(F.count("*").alias("n"))
    return n.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("block_type", "n")))).alias("block_types"))


def page_stats(blocks: DataFrame) -> DataFrame:
    """document_id, pages, text_pages, empty_pages, characters of all blocks."""
    pages = blocks.groupBy("document_id", "page").agg(F.max((strip(F.col("text")) != "").cast("int")).alias("filled"), F.sum(F.length("text")).alias("characters"))
    return pages.groupBy("document_id").agg(F.count("*").alias("pages"), F.sum("filled").alias("text_pages"), F.sum(1 - F.col("filled")).alias("empty_pages"), F.sum("characters").alias("characters"))
