"""Removal of repeated byte strings by bucket-pointer refinement (operator 3).

A byte is removed if a 200-byte string over it also starts elsewhere.  Sorting every suffix of the corpus would move many
times its size, so suffixes are bucketed by content first: the smallest q-gram hash among the q-grams of a 200-byte string
names its anchor, and equal strings have equal anchors at equal distance.  Suffixes are thus held by anchor:

* q-gram buckets: anchors whose q-gram occurs once are settled, none of their strings repeats;
* the bytes that all strings of an anchor cover together are its bucket's next key: where two anchors agree in them, all
  of their strings repeat and the anchor is settled too;
* what is left is refined by the buckets of its later offsets: strings are split by their distance to the anchor, first
  into blocks, then one by one.  A block whose common core is alone is settled as not repeated, one whose full reach
  recurs as repeated, and only the others go down to the next level, with the settled anchors of their bucket standing in
  by one member each.

Each level counts keys with partial sums before any shuffle, so a passage that a third of all documents share is one row
for each task.  Keys are pairs of 64-bit hashes.

Results: a null text counts as empty (no bytes, nothing removed, the hash of nothing); repeated rows repeat each other's
text; rows that share a doc_id are told apart by a checksum of their text; an empty table gives an empty table; columns
other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import batch_rows, drop_scratch, lean, materialize, texts

LENGTH = 200
GRAM = 32
SPAN = LENGTH - GRAM + 1
#: Distances to the anchor that share a block on the first level of refinement.
BLOCK = 16
#: String starts handled at once, so memory does not follow the length of a document.
PIECE = 1 << 19

_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 2**64)
_VALUES = np.random.default_rng(3).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class _Tables:
    up = down = np.empty(0, np.uint64)

    @classmethod
    def at_least(cls, n: int) -> None:
        if len(cls.up) < n:
            n = max(n, 1 << 16)
            cls.up, cls.down = _powers(_BASE, n), _powers(_INVERSE, n)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sums(data: np.ndarray) -> np.ndarray:
    _Tables.at_least(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * _Tables.up[: len(data)], out=out[1:])
    return out


def _hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal strings wherever they stand."""
    return _mixed((sums[end] - sums[start]) * _Tables.down[start] + (end - start).astype(np.uint64))


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive keys."""
    n = len(keys) - width + 1
    rows = -(-len(keys) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """For documents laid end to end (``ends`` exclusive): place, first and last start, q-gram hash, reach hash."""
    none = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    if len(data) < LENGTH:
        return none
    sums = _sums(data)
    start = np.arange(len(data) - GRAM + 1)
    grams = _hashes(sums, start, start + GRAM)
    # The hash in the upper bits; below it the place counted down, so the last of equal grams is the least.
    keys = (grams >> np.uint64(31) << np.uint64(31)) | (np.uint64(2**31 - 1) - start.astype(np.uint64))
    least = _sliding_least(keys, SPAN)
    place = 2**31 - 1 - (least & np.uint64(2**31 - 1)).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    lengths = ends - begins
    last_start = np.repeat(ends - LENGTH, lengths)[: len(place)]
    good = np.flatnonzero(np.arange(len(place)) <= last_start)
    if not len(good):
        return none
    place = place[good]
    cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(good) != 1))
    lo, hi = good[np.concatenate([[0], cut + 1])], good[np.concatenate([cut, [len(good) - 1]])]
    at = place[np.concatenate([[0], cut + 1])]
    reach = _hashes(sums, lo, hi + LENGTH) ^ (at - lo).astype(np.uint64)
    return at, lo, hi, grams[at], reach


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc_id, checksum, offset) of each slice, the bytes laid end to end, and where each slice ends.

    Long documents come in slices that overlap by all but one byte of a string, so each start is in one slice.
    """
    who, parts, ends, total = [], [], [], 0
    for doc_id, text in batch_rows(batch, "doc_id", "text"):
        raw = text.encode("utf-8", "surrogatepass")
        crc = zlib.crc32(raw)
        for at in range(0, max(1, len(raw) - LENGTH + 1), PIECE):
            part = raw[at : at + PIECE + LENGTH - 1]
            who.append((doc_id, crc, at))
            parts.append(part)
            total += len(part)
            ends.append(total)
            if total >= PIECE:
                yield who, np.frombuffer(b"".join(parts), np.uint8), np.array(ends)
                who, parts, ends, total = [], [], [], 0
    if who:
        yield who, np.frombuffer(b"".join(parts), np.uint8), np.array(ends)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for who, data, ends in _pieces(batch):
            at, lo, hi, gram, reach = _anchors(data, ends)
            mine = np.searchsorted(ends, lo, side="right")
            offset = np.array([w[2] for w in who])[mine] - np.concatenate([[0], ends[:-1]])[mine]
            ids = pa.array([w[0] for w in who], pa.int64()).take(pa.array(mine))
            crc = pa.array(np.array([w[1] for w in who], np.uint32).astype(np.int32)[mine])
            # place, then the distances of the first and last start
            packed = ((at + offset) << 16) | ((at - lo) << 8) | (at - hi)
            yield pa.RecordBatch.from_arrays([ids, crc, pa.array(packed), pa.array(gram.view(np.int64)), pa.array(reach.view(np.int64))], ["doc_id", "crc", "packed", "core", "reach"])


ITEM = "doc_id long, crc int, packed long, core long, reach long"


def _item_rows(block: int):
    """Splits the strings of the given items by their distance to the anchor, ``block`` distances to an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc_id, crc, packed_text, items in batch_rows(batch, "doc_id", "crc", "packed_text", "items"):
                raw = np.frombuffer(unpack.decompress(packed_text), np.uint8)
                base = np.array([x["core"] for x in items], np.int64)
                packed = np.array([x["packed"] for x in items], np.int64)
                at, far, close = packed >> 16, packed >> 8 & 255, packed & 255
                first, last = close // block, far // block
                count = last - first + 1
                of = np.repeat(np.arange(len(at)), count)
                grid = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                o_min, o_max = np.maximum(close[of], grid * block), np.minimum(far[of], grid * block + block - 1)
                place = at[of]
                core = np.empty(len(of), np.uint64)
                reach = np.empty(len(of), np.uint64)
                order = np.argsort(place, kind="stable")
                for cut in np.split(order, np.flatnonzero(np.diff(place[order] // PIECE)) + 1):
                    if not len(cut):
                        continue
                    p = place[cut]
                    left = max(0, int(p[0]) - LENGTH)
                    sums = _sums(raw[left : int(p[-1]) + 2 * LENGTH])
                    g0, g1 = grid[cut] * block, grid[cut] * block + block - 1
                    # What every string of the whole block would cover; the strings at hand do cover it.
                    core[cut] = _hashes(sums, p - g0 - left, p - np.minimum(g1, SPAN - 1) + LENGTH - left)
                    reach[cut] = _hashes(sums, p - o_max[cut] - left, p - o_min[cut] + LENGTH - left)
                key = _mixed(core ^ _mixed(base[of].view(np.uint64) + grid.astype(np.uint64)))
                reach ^= (o_min << 8 | o_max).astype(np.uint64)
                n = len(of)
                new = (place << 16) | (o_max << 8) | o_min
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * n, pa.int64()), pa.array([crc] * n, pa.int32()), pa.array(new), pa.array(key.view(np.int64)), pa.array(reach.view(np.int64))], ["doc_id", "crc", "packed", "core", "reach"])

    return run


def _packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, crc and the compressed text, so a shuffle moves less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rows = [(i, raw := t.encode("utf-8", "surrogatepass"), zlib.crc32(raw)) for i, t in batch_rows(batch, "doc_id", "text")]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(np.array([r[2] for r in rows], np.uint32).astype(np.int32)), pa.array([pack.compress(r[1]) for r in rows], pa.binary())], ["doc_id", "crc", "packed_text"])

    return docs.mapInArrow(lean(run), "doc_id long, crc int, packed_text binary")


def _settle(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items whose strings all repeat, and those to refine with one settled member of each of their keys."""
    # Keys are written before they are joined: only a join of two shuffled tables can split a hot key.
    twice = materialize(items.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "repeated-keys")
    shared = materialize(items.join(twice.hint("merge"), "core").select("doc_id", "crc", "packed", "core", "reach"), "shared-buckets")
    keys = materialize(shared.groupBy("core", "reach").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "crc", "packed")).alias("one")), "bucket-keys")
    marked = materialize(shared.join(keys.select("core", "reach", "n").hint("merge"), ["core", "reach"]), "marked-buckets")
    repeated = marked.where("n > 1").select("doc_id", "crc", "packed")
    open_items = marked.where("n = 1").select("doc_id", "crc", "packed", "core")
    open_cores = materialize(open_items.select("core").distinct(), "open-keys")
    stand_ins = keys.where("n > 1").select("one.*", "core").join(open_cores.hint("merge"), "core", "left_semi").select("doc_id", "crc", "packed", "core")
    refine = materialize(open_items.union(stand_ins), "open-buckets")
    drop_scratch(twice, shared, keys, open_cores)
    return repeated, refine


def _refined(refine: DataFrame, packed: DataFrame, block: int) -> DataFrame:
    """Items of the next level, from the texts of the documents they stand in."""
    of_doc = refine.groupBy("doc_id", "crc").agg(F.collect_list(F.struct("packed", "core")).alias("items"))
    same = packed.join(of_doc, (packed.doc_id.eqNullSafe(of_doc.doc_id)) & (packed.crc == of_doc.crc)).select(packed.doc_id, packed.crc, "packed_text", "items")
    return same.mapInArrow(lean(_item_rows(block)), ITEM)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, crc and spans array<struct<start,end>> of repeated strings, in bytes, not yet merged."""
    packed = _packed_texts(docs)
    repeated, refine = _settle(docs.mapInArrow(lean(_anchor_rows), ITEM))
    blocks = materialize(_refined(refine, packed, BLOCK), "blocks")
    in_blocks, refine = _settle(blocks)
    single = materialize(_refined(refine, packed, 1), "strings")
    strings, rest = _settle(single)
    drop_scratch(blocks, single, rest)
    found = repeated.union(in_blocks).union(strings)
    span = F.struct((F.shiftright("packed", 16) - F.shiftright("packed", 8).bitwiseAND(255)).alias("start"), (F.shiftright("packed", 16) - F.col("packed").bitwiseAND(255) + LENGTH).alias("end"))
    return found.groupBy("doc_id", "crc").agg(F.collect_set(span).alias("spans"))


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for doc_id, packed_text, spans in batch_rows(batch, "doc_id", "packed_text", "spans"):
            raw = unpack.decompress(packed_text)
            runs: list[list[int]] = []
            for s, e in sorted((x["start"], x["end"]) for x in spans or []):
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], e)
                else:
                    runs.append([s, e])
            ends = [0, *(e for _, e in runs)]
            left = b"".join(raw[a:b] for a, b in zip(ends, [*(s for s, _ in runs), len(raw)], strict=True))
            row = (doc_id, len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left)
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal runs), kept_sha256, kept (the remaining bytes)."""
    docs = texts(docs, id_col=id_col, text_col=text_col)
    spans, packed = repeated_spans(docs), _packed_texts(docs)
    joined = packed.join(spans, (packed.doc_id.eqNullSafe(spans.doc_id)) & (packed.crc == spans.crc), "left").select(packed.doc_id, "packed_text", "spans")
    return joined.mapInArrow(lean(_cut_rows), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
