"""Sources and sinks: files with their identity, archives, layout JSON, evaluation sets, exports."""

from __future__ import annotations

import io
import json
import re
import stat
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions.text import basename, csv_guard, html_text, strip
from docsift.operators.evaluation import question_order
from docsift.sources.store import IndexStore  # noqa: F401  part of this module's surface


class SourceError(ValueError):
    """Input that breaks a rule of its format."""


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf", root: str | None = None) -> DataFrame:
    """document_id, source, source_path, sha256 and content of the files right in a folder, in order of their path.

    The id follows the path below ``root`` (the folder itself unless given), without regard to case.
    """
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    place = spark._jvm.org.apache.hadoop.fs.Path(root or folder)
    base = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri().getPath().rstrip("/") + "/"
    full = F.regexp_replace("path", "^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?(?=/)", "")
    below = F.when(F.startswith(full, F.lit(base)), F.substr(full, F.lit(len(base) + 1))).otherwise(F.raise_error(F.concat(F.lit("outside of the folder: "), full)).cast("string"))
    rows = rows.select(below.alias("source_path"), F.sha2("content", 256).alias("sha256"), "content")
    named = F.sha2(F.to_json(F.struct(F.lower("source_path").alias("source_path"))), 256)
    return rows.select(named.alias("document_id"), basename(F.col("source_path")).alias("source"), "source_path", "sha256", "content").orderBy("source_path")


def pypdf_pages(content: bytes) -> list[str]:
    """Text of each page by the pypdf package, which is optional."""
    import pypdf

    return [page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(content)).pages]


def pages(documents: DataFrame, extract: Callable[[bytes], list[str]] = pypdf_pages) -> tuple[DataFrame, DataFrame]:
    """Page rows (document_id, source, page from 1, text) and report rows (document_id, ok, pages, error) of files.

    A file that cannot be read fails by itself; the report has the kind of its error and no text of it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                try:
                    found, error = list(extract(r.content)), None
                except Exception as e:  # noqa: BLE001  any fault of a file is that file's result
                    found, error = None, type(e).__name__
                yield pd.DataFrame({"document_id": [r.document_id], "source": [r.source], "texts": [found], "error": [error]})

    read = documents.select("document_id", "source", "content").mapInPandas(run, "document_id string, source string, texts array<string>, error string")
    rows = read.select("document_id", "source", F.posexplode("texts").alias("at", "text")).select("document_id", "source", (F.col("at") + 1).alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    reports = read.select("document_id", F.col("error").isNull().alias("ok"), F.when(F.col("error").isNull(), F.size("texts")).cast("long").alias("pages"), "error")
    return rows, reports


def as_blocks(page_rows: DataFrame) -> DataFrame:
    """One text block for each page."""
    return page_rows.select("document_id", "source", (F.col("page") - 1).cast("long").alias("block_seq"), "page", F.lit("text").alias("block_type"), "text")


#: Members of an archive and bytes that they may declare together.
MEMBERS, EXTRACTED = 10_000, 2 << 30


def checked_members(archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """The archive's files, after every member has been found safe: names, links, sizes and no two that differ in case only."""
    members = archive.infolist()
    if len(members) > MEMBERS or sum(m.file_size for m in members) > EXTRACTED:
        raise SourceError("too many members or bytes")
    seen = set()
    for m in members:
        name = m.filename.rstrip("/").casefold()
        if unsafe_member(m.filename) or stat.S_ISLNK(m.external_attr >> 16) or not name or name in seen:
            raise SourceError("unsafe or repeated member")
        seen.add(name)
    return [m for m in members if not m.is_dir()]


def extracted(archives: DataFrame, pattern: str = ".*") -> DataFrame:
    """document_id, member, content of the members that match, of archives (document_id, content); an unsafe archive is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                with zipfile.ZipFile(io.BytesIO(r.content)) as z:
                    for m in checked_members(z):
                        if re.fullmatch(pattern, m.filename):
                            # What a member holds may be more than it declares.
                            with z.open(m) as f:
                                data = f.read(m.file_size + 1)
                            if len(data) > m.file_size:
                                raise SourceError("a member is larger than it declares")
                            yield pd.DataFrame({"document_id": [r.document_id], "member": [m.filename], "content": [data]})

    return archives.select("document_id", "content").mapInPandas(run, "document_id string, member string, content binary")


#: Levels of child blocks under a block, and discarded blocks that are read as well.
CHILD_LEVELS = 4
DISCARDED = ["page_footnote", "header", "footer", "page_number"]


def _block_schema(levels: int) -> str:
    children = f",blocks:array<{_block_schema(levels - 1)}>" if levels else ""
    return f"struct<type:string,text_level:int,bbox:array<double>,lines:array<struct<spans:array<struct<type:string,content:string,html:string>>>>{children}>"


LAYOUT = f"pdf_info array<struct<page_idx:int,page_height:double,preproc_blocks:array<{_block_schema(CHILD_LEVELS)}>,discarded_blocks:array<{_block_schema(CHILD_LEVELS)}>>>"


def _span_text(span: Column) -> Column:
    return F.when(F.coalesce(F.trim(span["html"]), F.lit("")) != "", html_text(span["html"])).otherwise(F.coalesce(span["content"], F.lit("")))


def _joined(*parts: Column) -> Column:
    """Arrays of strings as one text, a line for each that is not empty."""
    return F.array_join(F.filter(F.concat(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts)), lambda x: x != ""), "\n")


def _lines(block: Column) -> Column:
    return F.transform(block["lines"], lambda line: F.array_join(F.transform(line["spans"], _span_text), ""))


def _block_text(block: Column, levels: int) -> Column:
    """Lines of a block, then those of its child blocks; a table's captions come before its body and its footnotes behind."""
    if not levels:
        return _joined(_lines(block))
    own = lambda keep: F.transform(F.filter(block["blocks"], keep), lambda child: _block_text(child, levels - 1))
    if levels < CHILD_LEVELS:
        return _joined(_lines(block), own(lambda c: F.lit(True)))
    around = ["table_caption", "table_footnote"]
    table = _joined(own(lambda c: c["type"] == around[0]), _lines(block), own(lambda c: ~F.coalesce(c["type"].isin(around), F.lit(False))), own(lambda c: c["type"] == around[1]))
    return F.when(block["type"] == "table", table).otherwise(_joined(_lines(block), own(lambda c: F.lit(True))))


def layout_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks in reading order: page from 1, block_seq, block_type, text; spans join within a line, lines by line breaks.

    Footnotes, headers, footers and page numbers among a page's discarded blocks come after its other blocks.
    """
    pages = spark.read.schema(LAYOUT).option("multiLine", True).json(path).select(F.explode("pdf_info").alias("page"))
    margins = F.filter("page.discarded_blocks", lambda b: b["type"].isin(DISCARDED))
    every = F.concat("page.preproc_blocks", F.coalesce(margins, F.array().cast(f"array<{_block_schema(CHILD_LEVELS)}>")))
    blocks = pages.select((F.col("page.page_idx") + 1).alias("page"), "page.page_height", F.posexplode(every).alias("block_seq", "block"))
    kind = F.when(F.col("block.type") == "interline_equation", "equation").otherwise(F.col("block.type"))
    name = F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_b"), F.col("block_seq").cast("string"))
    level = F.when(kind == "title", F.col("block.text_level"))
    captions = F.when(kind == "table", F.size(F.filter("block.blocks", lambda c: c["type"] == "table_caption")))
    return blocks.select("page", "block_seq", kind.alias("block_type"), _block_text(F.col("block"), CHILD_LEVELS).alias("text"), "block.bbox", "page_height", name.alias("block_id"), level.alias("title_level"), F.greatest(F.coalesce(captions, F.lit(0)), F.lit(0)).alias("captions"))


CONTENT = "array<struct<page_idx:int,type:string,text:string,list_items:array<string>,text_level:int,bbox:array<double>,table_body:string,table_caption:array<string>,table_footnote:array<string>,image_caption:array<string>,image_footnote:array<string>,chart_caption:array<string>,chart_footnote:array<string>,content:string>>"


def content_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a content list: page from 1, block_seq, block_type, text by the kind of block, bbox, block_id, title_level."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", CONTENT)).alias("block_seq", "b"))
    b = F.col("b")
    listed = F.array_join(b["list_items"], "\n")
    lines = lambda *names: [F.array_join(b[n], "\n") for n in names]
    joined = lambda parts: F.array_join(F.filter(F.array(*(F.coalesce(p, F.lit("")) for p in parts)), lambda x: x != ""), "\n")
    body = F.when(F.lower(b["table_body"]).contains("<table"), html_text(b["table_body"])).otherwise(b["table_body"])
    text = F.when(b["type"] == "table", joined([*lines("table_caption"), body, *lines("table_footnote")]))
    for kind in ("image", "chart"):
        text = text.when(b["type"] == kind, joined([*lines(f"{kind}_caption", f"{kind}_footnote"), b["content"]]))
    plain = F.coalesce(F.nullif(b["text"], F.lit("")), F.nullif(listed, F.lit("")), F.when(~b["type"].isin(*KINDS), b["content"]), F.lit(""))
    page = b["page_idx"] + 1
    name = F.concat(F.lit("p"), page.cast("string"), F.lit("_b"), F.col("block_seq").cast("string"))
    return rows.select(page.alias("page"), "block_seq", F.coalesce(b["type"], F.lit("unknown")).alias("block_type"), strip(text.otherwise(plain)).alias("text"), b["bbox"].alias("bbox"), F.lit(None).cast("double").alias("page_height"), name.alias("block_id"), b["text_level"].alias("title_level"))


# Kinds of blocks whose text is under text or list_items.
KINDS = ["text", "title", "equation", "code", "list", "page_footnote", "ref_text", "header", "footer", "page_number"]


def adapted(spark: SparkSession, layout: str, content: str | None, expected_pages: int) -> tuple[DataFrame, dict]:
    """Blocks of a parsed document and its statistics.

    The layout must have each page from 0 to ``expected_pages`` - 1 once.  Its blocks are taken if every page has some list of
    them, else those of the content list; a document without any block is an error.
    """
    found = spark.read.schema(LAYOUT).option("multiLine", True).json(layout).select(F.explode("pdf_info").alias("page"))
    ids = found.agg(F.array_sort(F.collect_list("page.page_idx")).alias("ids"), F.count_if(F.col("page.preproc_blocks").isNull()).alias("lacking")).first()
    if ids["ids"] != list(range(expected_pages)):
        raise SourceError(f"expected {expected_pages} pages, got {len(ids['ids'])}")
    own = not ids["lacking"]
    if not own and content is None:
        raise SourceError("a page has no blocks and there is no content list")
    blocks = layout_blocks(spark, layout) if own else content_blocks(spark, content)
    blocks = blocks.withColumn("text", strip(F.col("text")))
    if not blocks.where(F.col("page").isNull() | (F.col("page") < 1) | (F.col("page") > expected_pages)).isEmpty():
        raise SourceError("a block has no page, or one outside of the document")
    filled = strip(F.col("text")) != ""
    kinds = F.col("block_type")
    n = blocks.agg(F.count("*").alias("blocks"), F.array_sort(F.collect_set(F.when(filled, F.col("page")))).alias("text_pages"), F.count_if(kinds == "text").alias("body_blocks"), F.count_if(kinds == "table").alias("table_blocks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters")).first()
    if not n["blocks"]:
        raise SourceError("no page has any block")
    types = {r["block_type"]: r["count"] for r in blocks.groupBy("block_type").count().collect()}
    stats = {"expected_pages": expected_pages, "parsed_pages": len(ids["ids"]), "text_pages": len(n["text_pages"]), "empty_text_pages": [p for p in range(1, expected_pages + 1) if p not in set(n["text_pages"])], "body_blocks": n["body_blocks"], "table_blocks": n["table_blocks"], "block_types": types, "characters": n["characters"], "page_source": "preproc_blocks" if own else "content_list"}
    return blocks, stats


def text_value(value: object) -> str:
    """A text, or a list of texts in lines; null is empty and anything else an error."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, list) and all(isinstance(x, str) for x in value):
        return "\n".join(value)
    raise SourceError("neither a text nor a list of texts")


def uncovered_pages(blocks: DataFrame, expected: int) -> DataFrame:
    """Page numbers from 1 to ``expected`` without a block."""
    return blocks.sparkSession.range(1, expected + 1).select(F.col("id").cast("int").alias("page")).join(blocks.select("page").distinct(), "page", "left_anti")


def questions(spark: SparkSession, path: str, source_map: DataFrame) -> DataFrame:
    """An evaluation set after its rules: unique ids, five texts that are not blank, references that the map knows."""
    rows = spark.read.option("multiLine", True).json(path).withColumn("question_id", F.col("question_id").cast("string"))
    blank = F.lit(False)
    for name in ("question", "ground_truth", "question_type", "difficulty", "eval_criteria"):
        blank = blank | F.coalesce(F.trim(name) == "", F.lit(True))
    refs = rows.select("question_id", F.explode("reference_context_ids").alias("doc_code"))
    wrong = [("blank field", rows.where(blank)), ("repeated id", rows.groupBy("question_id").count().where("count > 1")), ("unknown reference", refs.join(source_map, "doc_code", "left_anti"))]
    for what, bad in wrong:
        if not bad.isEmpty():
            raise ValueError(f"{what} in {path}")
    return rows


def unsafe_member(name: str) -> bool:
    """Archive member names that must not be extracted."""
    parts = name.replace("\\", "/").split("/")
    reserved = re.compile(r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$")
    return name.startswith(("/", "\\")) or "\\" in name or ":" in name or any(p in ("..", "") and k < len(parts) - 1 or p == ".." or p != p.rstrip(". ") or bool(reserved.match(p)) for k, p in enumerate(parts) if p != "" or k < len(parts) - 1)


def load_items(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Results of single questions from a folder of JSON files, in order of the question; broken, nameless and repeated ones are errors."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    rows = rows.withColumn("file", F.col("_metadata.file_path"))
    bad = rows.agg(F.count("*"), F.count_if(F.col("_corrupt").isNotNull() | F.col("question_id").isNull()), F.count("*") - F.countDistinct("question_id")).first()
    if not bad[0]:
        raise SourceError(f"no results in {folder}")
    if bad[1] or bad[2]:
        raise SourceError(f"{bad[1]} results without a question, {bad[2]} repeated in {folder}")
    return rows.drop("_corrupt").orderBy(*question_order(F.col("question_id")))


def export_csv(df: DataFrame, path: str, *, mark: bool = False) -> None:
    """CSV whose text cells cannot act as formulas; ``mark`` puts a byte order mark before the header, for spreadsheets."""
    safe = {c: csv_guard(F.col(c)) for c, kind in df.dtypes if kind == "string"}
    rows = df.withColumns(safe)
    if mark and rows.columns:
        rows = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls included."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
