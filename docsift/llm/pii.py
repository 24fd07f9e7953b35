"""Personal data by candidate generation and gradient boosting (operator 4), in DataFrame functions only.

The base patterns find plain e-mail addresses, IPv4 addresses, card and telephone numbers; their spans always stay.
Further generators with high recall propose more, overlapping spans: disguised addresses, IPv6, shortened or not, numbers
without a leading plus or in pairs, cards with other separators.  Boosted trees see each proposal's format and the words around it, and a threshold
calibrated on rows they were not trained on selects those to redact.  The trees are trained here on made-up sentences of
both classes, as no labelled personal data is at hand, and run as column expressions.

Places are code points.  Patterns are possessive and anchored at run starts where that leaves their matches as they are, so
long runs of one kind of character cost linear time.

Results: a null text counts as empty (no spans, the hash of nothing); rows are searched by themselves, so repeated rows
give equal results; spans of different kinds may overlap and are listed by start, then kind; an empty table gives an empty
table; columns other than id and text are not read.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.boosting import Boosted
from docsift.llm.common import texts
from docsift.llm.quality_rules import let

KINDS = ["email", "ip", "card", "phone"]
# The base patterns.  (?:\G|(?<!..)) keeps a run from being tried again at each of its characters.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further generators: kind and pattern.
MORE = [
    ("email", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[{]\x20?at\x20?[)\]}]\x20?[A-Za-z0-9-]++(?:\x20?(?:[(\[{]\x20?dot\x20?[)\]}]|\x20dot\x20|\.)\x20?[A-Za-z0-9-]++)++"),
    ("email", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[./_\x20-]{1,3}[0-9]{4}){3}(?![0-9])"),
    ("phone", r"(?<![0-9+.-])(?:00[1-9][0-9]{0,2}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20./-]?[0-9]{3,4}[\x20./-]?[0-9]{3,4}(?![0-9])"),
    # Shortened IPv6, and telephone numbers in pairs.
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![0-9A-Fa-f:])"),
    ("phone", r"(?<![0-9+.-])(?:00[1-9][0-9]{0,2}[\x20.-]?)?[0-9]{1,2}(?:[\x20./-][0-9]{2}){4}(?![0-9])"),
]
NEAR = 24
#: Texts that can hold a proposal of the further generators.
MAY = r"[0-9]|::|[A-Fa-f]:[A-Fa-f]|(?i)[(\[{ ]at[)\]} ]"


def running(lengths: Column) -> Column:
    """Sums of the elements before each element; two levels, so the cost stays near linear."""

    def scan(values: Column, start: Column) -> Column:
        sums = F.aggregate(values, F.array(start.cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return let(sums, lambda s: F.slice(s, F.lit(1), F.size(s) - 1))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def of(x: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / 256) - 1, F.lit(0)).cast("int")), lambda c: F.slice(x, c * 256 + 1, F.lit(256)))
        return let(chunks, lambda cs: F.flatten(F.zip_with(cs, scan(F.transform(cs, total), F.lit(0)), scan)))

    return let(lengths, of)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value>> of the leftmost non-overlapping matches."""
    # What stands between matches and the matches themselves give the places.
    parts = F.zip_with(F.split(text, pattern), F.concat(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array(F.lit(None).cast("string"))), lambda a, b: F.struct(F.length(a).cast("long").alias("gap"), b.alias("value")))

    def of(p: Column) -> Column:
        before = running(F.transform(p, lambda x: x["gap"] + F.coalesce(F.length(x["value"]), F.lit(0))))
        placed = F.zip_with(p, before, lambda x, b: F.struct((b + x["gap"]).alias("start"), (b + x["gap"] + F.length(x["value"])).alias("end"), x["value"].alias("value")))
        return F.filter(placed, lambda x: x["value"].isNotNull())

    return let(parts, of)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    at = F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1)))

    def weight(i: Column) -> Column:
        x = F.coalesce(F.try_to_number(F.substring(F.reverse(d), i, F.lit(1)), F.lit("9")).cast("int"), F.lit(0))
        return F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.aggregate(F.transform(at, weight), F.lit(0), lambda acc, x: acc + x) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        significant = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(value, r"\."), lambda p: let(significant(p), lambda s: (F.length(s) < 3) | ((F.length(s) == 3) & (s <= "255"))))
    n = F.length(digits(value))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits(value))).otherwise(F.lit(False))
    return n.between(10, 15)


NO_SPANS = "array<struct<start:bigint,end:bigint,kind:int,value:string>>"


def _spans(kind: str, found: Column) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"), m["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """Spans of the base patterns that pass their tests, by start, then kind."""
    empty = F.array().cast(NO_SPANS)
    may = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]"), "phone": F.contains(text, F.lit("+"))}

    def of(kind: str) -> Column:
        return F.when(may[kind], _spans(kind, F.filter(matches(text, BASE[kind]), lambda m: _passes(kind, m["value"])))).otherwise(empty)

    return _ordered(F.concat(*map(of, KINDS)))


def _ordered(spans: Column) -> Column:
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))))
    return F.transform(keyed, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))


def _features(text: Column, s: Column, source: Column) -> list[Column]:
    """Format and context of a proposal, as numbers."""
    value, d = s["value"], digits(s["value"])
    before = F.lower(F.substring(text, F.greatest(s["start"] - NEAR + 1, F.lit(1)).cast("int"), F.least(s["start"], F.lit(NEAR)).cast("int")))
    after = F.lower(F.substring(text, (s["end"] + 1).cast("int"), F.lit(NEAR)))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        source.cast("double"),
        F.length(value).cast("double"),
        F.length(d).cast("double"),
        F.length(F.regexp_replace(value, r"[^\x20./_-]", "")).cast("double"),
        F.length(F.regexp_replace(value, "[^(){}\\[\\]]", "")).cast("double"),
        F.size(F.array_distinct(F.split(d, ""))).cast("double"),
        flag(luhn(d)),
        flag(before.rlike(r"(?:mail|contact|write|reach|address)\P{L}*(?:\p{L}+\P{L}+)?$")),
        flag(before.rlike(r"(?:phone|tel|tél|call|appel|mobile|handy|cell|fax|whatsapp|dial|sms|text)\p{L}*\P{L}*(?:\p{L}+\P{L}+)?$")),
        flag(before.rlike(r"(?:card|visa|master|amex|credit|debit|payment)\p{L}*\P{L}*(?:\p{L}+\P{L}+)?$")),
        flag(before.rlike(r"(?:\bip|host|server|client|login|network|ipv6)\p{L}*\P{L}*(?:\p{L}+\P{L}+)?$")),
        flag(before.rlike(r"(?:order|invoice|version|isbn|serial|part|item|ref|page|section|build|no|id|code|model|total|sku)\p{L}*\P{L}*$")),
        flag(before.rlike(r"[\p{L}0-9_/=#-]$")),
        flag(after.rlike(r"^[\p{L}_/=%-]")),
        flag(value.rlike(r"(?:19|20)[0-9]{2}")),
        flag(value.rlike(r"(?i)(?:com|org|net|edu|gov|io|de|fr|es|uk)$")),
    ]


def proposals(text: Column, base: Column) -> Column:
    """Further spans that touch no base span, with the number of their generator."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:int,value:string,source:int>>")
    may = [text.rlike(r"(?i)[(\[{]\x20?at\x20?[)\]}]"), text.rlike(r"(?i)\x20at\x20[A-Za-z0-9-]++\x20dot\x20"), text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]"), text.rlike("[0-9]"), text.rlike("[0-9]"), F.contains(text, F.lit("::")), text.rlike(r"[0-9][\x20./-][0-9]")]

    def of(k: int, kind: str, pattern: str) -> Column:
        spans = F.transform(_spans(kind, matches(text, pattern)), lambda s: s.withField("source", F.lit(k)))
        return F.when(may[k], spans).otherwise(empty)

    found = [of(k, *more) for k, more in enumerate(MORE)]
    return let(base, lambda b: F.filter(F.concat(*found), lambda s: ~F.exists(b, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"]))))


def _sentences(seed: int = 4, n: int = 240) -> list[tuple[str, str]]:
    """Made-up sentences, each with the one piece of personal data in it, empty if it has none."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 9)))
    pick = lambda *options: rng.choice(options)

    def card() -> str:
        d = "4" + num(14)
        total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(d))
        return d + str(-total % 10)

    def four(d: str) -> str:
        return pick(".", "/", "_", "  ").join(d[k : k + 4] for k in range(0, 16, 4))

    hextets = lambda low, high: ":".join(f"{rng.getrandbits(pick(4, 16, 16)):x}" for _ in range(rng.randint(low, high)))
    tld = lambda: pick("com", "org", "net", "edu", "de", "fr")
    good = [
        lambda: (pick("email me:", "contact", "write to", "mail", word()), f"{word()} (at) {word()} (dot) {tld()}"),
        lambda: (pick("reach me at", "contact", word()), f"{word()}[at]{word()}{pick('[dot]', '.')}{tld()}"),
        lambda: (pick("email", "mail to", "address", word()), f"{word()} at {word()} dot {tld()}"),
        lambda: (pick("call", "phone:", "tel", "mobile", "fax"), f"({num(3)}) {num(3)}-{num(4)}"),
        lambda: (pick("call me", "phone", "tel.", "text", "my cell is"), f"{num(3)}-{num(3)}-{num(4)}"),
        lambda: (pick("dial", "telephone", "phone"), f"00{rng.randint(30, 49)} {num(3)} {num(3)} {num(4)}"),
        lambda: (pick("card", "credit card", "visa", "payment card"), four(card())),
        lambda: (pick("from host", "ip", "server", word()), ":".join(f"{rng.getrandbits(pick(4, 16, 16)):x}" for _ in range(8))),
        lambda: (pick("from host", "ip", "server", "client", word()), f"{hextets(1, 4)}::{hextets(1, 3)}"),
        lambda: (pick("appelez le", "tél.", "mobile", "phone", "téléphone"), pick(" ", ".", "-").join([f"0{rng.randint(1, 9)}", *(num(2) for _ in range(4))])),
    ]
    bad = [
        lambda: f"{pick('order', 'invoice', 'part no', 'serial', 'ref')} {num(3)}-{num(3)}-{num(4)}",
        lambda: f"{pick('item', 'id', 'code', 'total', word())} {num(10)}",
        lambda: f"{word()} {num(4)}-{num(3)}-{num(3)}",
        lambda: f"{pick('build', 'version', word())} {num(3)}.{num(3)}.{num(3)}",
        lambda: f"{word()} {rng.randint(1900, 2099)} {num(4)} {num(4)}",
        lambda: f"{pick('serial', 'sku', 'order', word())} {four(num(16))}",
        lambda: f"{word()}={num(9)}{word()}",
        lambda: f"{word()} {num(11)}",
        lambda: f"{word()} {pick('at', 'on')} {word()} dot {word()}",
        lambda: f"{pick('std', 'use', word())}{pick('', ' ', 'a', 'be')}::{pick('', 'fe', 'add', word())}",
        lambda: f"{pick('sizes', 'scores', 'item', word())} {' '.join(num(2) for _ in range(5))}",
    ]
    out = []
    for _ in range(n):
        for made in good:
            lead, value = made()
            out.append((f"{word()} {lead} {value} {word()}", value))
        out += [(f"{word()} {made()} {word()}", "") for made in bad]
    return out


def _rows(spark: SparkSession, sentences: list[tuple[str, str]]) -> DataFrame:
    """Features of the proposals in the sentences; label 1 where one is exactly the personal data."""
    made = spark.createDataFrame([(k, s, v) for k, (s, v) in enumerate(sentences)], "k int, text string, value string")
    text = F.col("text")
    found = made.select("k", "value", "text", F.explode(proposals(text, base_spans(text))).alias("s"))
    return found.select("k", F.when(F.col("s.value") == F.col("value"), 1).otherwise(0).alias("label"), F.array(*_features(text, F.col("s"), F.col("s.source"))).alias("x"))


@lru_cache(1)
def _trained(application: str, precision: float) -> Boosted:
    spark = SparkSession.getActiveSession()
    rows = sorted((r["k"], r["label"], tuple(r["x"])) for r in _rows(spark, _sentences()).collect())
    k, y, x = (np.array([r[n] for r in rows], float) for n in range(3))
    held = k % 3 == 0
    return Boosted().fit(x[~held], y[~held]).calibrate(x[held], y[held], precision)


def model(spark: SparkSession, precision: float = 0.98) -> Boosted:
    return _trained(spark.sparkContext.applicationId, precision)


def all_spans(text: Column, base: Column, trees: Boosted) -> Column:
    """Base spans and the proposals that the model selects, by start, then kind."""
    # Generators may overlap: of selected proposals over the same place the one that begins first stays, the longest of these.
    chosen = F.filter(proposals(text, base), lambda s: let(F.array(*_features(text, s, s["source"])), lambda x: trees.expression([x[k] for k in range(16)]) >= trees.threshold))
    by_start = F.array_sort(F.transform(chosen, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"), s["value"].alias("value"))))

    def joined(acc: Column, s: Column) -> Column:
        new = F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))
        last = F.element_at(F.concat(acc, F.array(new)), F.greatest(F.size(acc), F.lit(1)))
        return F.when((F.size(acc) > 0) & (last["end"] > s["start"]), acc).otherwise(F.concat(acc, F.array(new)))

    apart = F.aggregate(by_start, F.array().cast(NO_SPANS), joined)
    return _ordered(F.concat(base, apart))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, base (array of spans) and spans (base ones and those that the method adds)."""
    trees, text = model(docs.sparkSession), F.col("text")
    rows = texts(docs, id_col=id_col, text_col=text_col).select("doc_id", "text", F.explode(F.array(base_spans(text))).alias("base"))
    return rows.withColumn("spans", F.when(text.rlike(MAY), all_spans(text, F.col("base"), trees)).otherwise(F.col("base")))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (listed)."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by its first kind in angle brackets."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>")

    def joined(acc: Column, s: Column) -> Column:
        new = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        last = F.element_at(F.concat(acc, F.array(new)), F.greatest(F.size(acc), F.lit(1)))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when((F.size(acc) > 0) & (s["start"] < last["end"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(new)))

    def cut(runs: Column) -> Column:
        starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(runs, lambda r: r["end"]))
        ends = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.length(text).cast("long")))
        kept = F.zip_with(starts, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
        tags = F.concat(F.transform(runs, lambda r: names[r["kind"]]), F.array(F.lit("")))
        return F.array_join(F.zip_with(kept, tags, lambda a, b: F.concat(a, b)), "")

    return F.when(F.size(spans) == 0, text).otherwise(let(F.aggregate(spans, none, joined), cut))
