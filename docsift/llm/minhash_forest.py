"""Near-duplicate documents with a MinHash LSH forest (operator 2).

Each text becomes the set of its five-word shingles, and texts with equal sets one class.  A class has a signature of
``TREES * STEP`` minimum hashes; each tree sorts all classes by the signature rotated to another beginning.  Candidates are
neighbours in such an order that share a prefix of at least ``MIN_DEPTH`` values.  Depth adapts to the region: a sparse
region pairs all of its members from the minimum depth on, a dense one only those with the longest common prefixes, and its
members are also held against the region's smallest one, so the number of candidates stays linear in the classes.  A
sketch of the signatures discards hopeless candidates and the full sets confirm the rest.

Links serve connectivity only, so confirmation runs twice: once for one candidate of each class, then for the candidates
whose ends are still apart.  Groups are found by alternating large and small star steps over tables.

A dense region does not pair all of its members, so those of dense regions that still hold several groups go through an
exact join as well: each set is ordered from its rarest shingle on, and two sets that are similar enough share one among
the first few of both.  The smaller set of a pair must hold it even earlier than the larger one, so what a template has in
common, which comes behind each page's own shingles, joins only sets that can reach the threshold.  Pairs with the same such
shingle but of different groups are confirmed on full sets, with no limit on them.

Nodes are numbers of rows, given when the signatures are written; ids come back only at the end, so null, repeated and
shared ids neither lose nor make a link.

Results: null, empty and blank texts have no shingles, are linked with nothing and keep themselves; a text of fewer than
five words is one shingle; equal texts are linked; each row of the input gives one row, also if rows repeat; rows that
share a doc_id but not the text belong to their own groups; a null doc_id takes part and links others, but is the id of a
group only if the group has no other; an empty table gives an empty table; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import batch_rows, drop_scratch, lean, materialize, small_batches

WORDS = 5
TREES, STEP = 20, 6
SIZE = TREES * STEP
#: Values in a sorted prefix, at two bytes each, and the least shared depth.  With a similarity of 0.85 a pair shares four
#: values in one of the 20 orders but for 4 pairs in ten million.
DEPTH, MIN_DEPTH = 12, 4
#: Neighbours in each order; a region of more than one member beside them is dense.
NEAR = 3
#: Rows of a batch whose results a worker holds at once.
ROWS = 256
#: Counters for how frequent shingles are; shared counters cost time only, as any order of shingles gives the same links.
COUNTERS = 1 << 18
#: A pair is confirmed if its sketches agree in this share of places: five standard deviations below 0.85.
SKETCH_SHARE = 0.68

_rng = np.random.default_rng(20)
_MULTIPLIERS = _rng.integers(0, 2**63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 2**63, SIZE, dtype=np.uint64)
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; A-Z are lower-cased, words end at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(WORDS, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = _mixed(h * _FOLD + w[k : len(w) - size + 1 + k])
    return np.unique(h)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over the set."""
    out = np.full(SIZE, 2**32 - 1, np.uint64)
    for at in range(0, len(hashes), 2048):
        block = hashes[at : at + 2048, None] * _MULTIPLIERS + _SHIFTS
        out = np.minimum(out, (block >> np.uint64(32)).min(axis=0))
    return out.astype(np.uint32)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (16 bytes that identify the set; null if empty), signature (two bytes a value), packed_text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            # Few rows at a time, so a worker holds the compressed texts of those alone.
            for batch in (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS)):
                sizes, keys, sketches, packed = [], [], [], []
                for (text,) in batch_rows(batch, "text"):
                    s = shingle_set(text)
                    sizes.append(len(s))
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sketches.append(_mixed(signature(s).astype(np.uint64)).astype(">u2").tobytes() if len(s) else None)
                    packed.append(pack.compress(text.encode("utf-8", "surrogatepass")) if len(s) else None)
                ids = batch.column(batch.schema.get_field_index("doc_id"))
                columns = [ids, pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in (keys, sketches, packed))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_key", "signature", "packed_text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(lean(run), f"doc_id {kind}, n_shingles long, set_key binary, signature binary, packed_text binary")


def forest_rows(classes: DataFrame) -> DataFrame:
    """One row for each class and tree: tree, prefix of the rotated signature, node."""
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    around = F.concat("signature", F.substring("signature", 1, 2 * DEPTH))
    return classes.select("node", around.alias("around"), trees).select("tree", F.expr(f"substring(around, tree * {2 * STEP} + 1, {2 * DEPTH})").alias("prefix"), "node")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows at most NEAR places apart that share MIN_DEPTH values; the first and last rows pass on with them."""
    kept, first, empty = None, True, np.empty(0, np.int64)
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        tree = batch.column(0).to_numpy()
        prefix = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, DEPTH)
        node = batch.column(2).to_numpy()
        head = np.frombuffer(np.ascontiguousarray(prefix[:, :MIN_DEPTH]).tobytes(), ">u8")
        fresh = (tree, head, node, prefix)
        if first:
            yield _edge_rows(*(x[:NEAR] for x in fresh))
            first = False
        if kept is not None:
            fresh = tuple(np.concatenate(x) for x in zip(kept, fresh, strict=True))
        tree, head, node, _ = fresh
        # Pairs among the rows that were kept have been given already.
        old = 0 if kept is None else len(kept[0])
        left, right = [empty], [empty]
        for k in range(1, NEAR + 1):
            same = (tree[k:] == tree[:-k]) & (head[k:] == head[:-k]) & (node[k:] != node[:-k])
            at = np.flatnonzero(same)
            at = at[at + k >= old]
            left.append(np.minimum(node[at], node[at + k]))
            right.append(np.maximum(node[at], node[at + k]))
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
        n = pairs.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["a", "b", "tree", "prefix"])
        kept = tuple(x[-NEAR:] for x in fresh)
        last = kept
    if last is not None:
        yield _edge_rows(*last)


def _edge_rows(tree: np.ndarray, head: np.ndarray, node: np.ndarray, prefix: np.ndarray) -> pa.RecordBatch:
    n = len(tree)
    return pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(n, pa.int64()), pa.array(tree.astype(np.int32)), pa.array([p.tobytes() for p in prefix], pa.binary())], ["a", "b", "tree", "prefix"])


PAIR_SCHEMA = "a long, b long, tree int, prefix binary"


def candidates(classes: DataFrame) -> DataFrame:
    """Distinct pairs a < b of nodes; ``first`` marks one pair of each node, with the smallest partner there is."""
    rows = forest_rows(classes)
    ordered = rows.repartitionByRange("tree", "prefix", "node").sortWithinPartitions("tree", "prefix", "node")
    found = materialize(ordered.mapInArrow(lean(_neighbours), PAIR_SCHEMA), "forest-neighbours")
    # Neighbours across the borders of partitions: a few rows of each partition, sorted in one task.
    edges = found.where("b is null").select("tree", "prefix", F.col("a").alias("node")).distinct()
    across = edges.repartition(1).sortWithinPartitions("tree", "prefix", "node").mapInArrow(lean(_neighbours), PAIR_SCHEMA).where("b is not null")
    # Every region's members against its smallest.
    region = F.substring("prefix", 1, 2 * MIN_DEPTH).alias("region")
    hubs = rows.groupBy("tree", region).agg(F.count("*").alias("members"), F.min("node").alias("a")).where("members > 1")
    stars = rows.select("tree", region, F.col("node").alias("b")).join(hubs, ["tree", "region"]).where("a <> b").select("a", "b")
    stars = stars.groupBy("a", "b").agg(F.lit(True).alias("hub"))
    near = found.where("b is not null").union(across).select("a", "b", F.lit(False).alias("hub"))
    pairs = materialize(stars.union(near).groupBy("a", "b").agg(F.max("hub").alias("hub")), "forest-pairs")
    drop_scratch(found)
    first = pairs.where("hub").groupBy("b").agg(F.min("a").alias("a")).withColumn("first", F.lit(True))
    out = materialize(pairs.select("a", "b").join(first, ["a", "b"], "left").select("a", "b", F.coalesce("first", F.lit(False)).alias("first")), "forest-candidates")
    drop_scratch(pairs)
    return out


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, SIZE) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).mean(axis=1) >= SKETCH_SHARE))


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple = (None, None)
        unpack = zstandard.ZstdDecompressor().decompress
        shingles = lambda packed: shingle_set(unpack(packed).decode("utf-8", "surrogatepass"))
        for batch in batches:
            keep = []
            for text_a, text_b in batch_rows(batch, "text_a", "text_b"):
                if seen[0] != text_a:
                    seen = text_a, shingles(text_a)
                x, y = seen[1], shingles(text_b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def links(pairs: DataFrame, classes: DataFrame, stored: DataFrame, percent: int, *, sketched: bool = True) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union; ``sketched`` drops hopeless ones first.  Hot nodes are left to the skew join."""
    sketch = lambda x: classes.select(F.col("node").alias(x), F.col("signature").alias(f"sketch_{x}"))
    likely = pairs.select("a", "b")
    if sketched:
        likely = likely.join(sketch("b"), "b").join(sketch("a"), "a").select("a", "b", "sketch_a", "sketch_b").mapInArrow(lean(_likely), "a long, b long")
    text = lambda x: stored.select(F.col("node").alias(x), F.col("packed_text").alias(f"text_{x}"))
    both = likely.join(text("b"), "b").join(text("a"), "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(lean(_confirmed(percent)), "a long, b long").distinct()


def unsettled(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """node and component of the members of dense regions that hold more than one group."""
    of = classes.join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    rows = forest_rows(classes).select("tree", F.substring("prefix", 1, 2 * MIN_DEPTH).alias("region"), "node").join(of, "node")
    rows = materialize(rows, "forest-regions")
    mixed = rows.groupBy("tree", "region").agg(F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high")).where((F.col("members") > NEAR + 1) & (F.col("low") < F.col("high")))
    out = materialize(rows.join(mixed.select("tree", "region"), ["tree", "region"]).select("node", "component").distinct(), "unsettled")
    drop_scratch(rows)
    return out


def _unpacked(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    for (packed,) in batch_rows(batch, "packed_text"):
        yield shingle_set(unpack(packed).decode("utf-8", "surrogatepass"))


def _shingle_counts(sets: DataFrame) -> np.ndarray:
    """For each counter, how many sets have its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for s in _unpacked(batch):
                n += np.bincount((s % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["counter", "n"])

    found = sets.select("packed_text").mapInArrow(lean(run), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[found["counter"].to_numpy()] = found["n"].to_numpy()
    return counts


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """shingle, place, n, node, component: the shingles of each set of which a set similar enough must share one."""
    counts = _shingle_counts(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, s in enumerate(_unpacked(batch)):
                first = len(s) - -(-percent * len(s) // 100) + 1
                rare = s[np.lexsort((s, counts[(s % np.uint64(COUNTERS)).astype(np.int64)]))[:first]]
                own = lambda c: pa.repeat(batch.column(batch.schema.get_field_index(c))[k], len(rare))  # noqa: B023,E731
                yield pa.RecordBatch.from_arrays([pa.array(rare.view(np.int64)), pa.array(np.arange(len(rare))), pa.repeat(pa.scalar(len(s), pa.int64()), len(rare)), own("node"), own("component")], ["shingle", "place", "n", "node", "component"])

    return sets.mapInArrow(lean(run), "shingle long, place long, n long, node long, component long")


def sharing(rare: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs a < b of different groups that share a rare shingle early enough for so similar sets.

    With n <= m shingles, similar enough sets share at least percent * (n + m) / (100 + percent) of them, hence at least
    2 * percent * n / (100 + percent): the smaller one holds the first common shingle among its first n minus so many plus
    one.  Only such rows stand on the smaller side of the join.
    """
    several = rare.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    rows = materialize(rare.join(several.select("shingle"), "shingle"), "shared-shingles")
    side = lambda x: rows.select("shingle", *(F.col(c).alias(f"{c}_{x}") for c in ("place", "n", "node", "component")))
    early = side("a").where(f"(n_a - place_a) * {100 + percent} >= {2 * percent} * n_a")
    # At the first shingle that both have, what follows in the shorter rest bounds the intersection.
    enough = f"{100 + percent} * least(n_a - place_a, n_b - place_b) >= {percent} * (n_a + n_b)"
    smaller = "(n_a < n_b or n_a = n_b and node_a < node_b)"
    found = early.join(side("b"), "shingle").where(f"component_a <> component_b and {smaller} and {enough}")
    return found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node and component (smallest node reachable) for every node with an edge, by alternating star steps."""
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), label)
    seen = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        mid = materialize(large, label)
        smallest = mid.groupBy("u").agg(F.min("v").alias("m"))
        joined = mid.join(smallest, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = materialize(small, label)
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_scratch(now, mid)
        now = after
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state


def near_duplicates(docs: DataFrame, *, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the group), kept (whether it is that document).

    The id may be of any type with an order.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = materialize(signatures(docs).withColumn("row", F.monotonically_increasing_id()), "signatures", compression="none")
    per_set = signed.where("set_key is not null").groupBy("set_key").agg(F.min(F.struct("row", "signature")).alias("least"), F.min("doc_id").alias("least_id"))
    classes = materialize(per_set.select(F.col("least.row").alias("node"), "set_key", "least.signature", "least_id"), "classes")
    pairs = candidates(classes)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # The wanted rows grow with the corpus, so this is a merge join at every size.
    text = materialize(signed.select(F.col("row").alias("node"), "packed_text").join(wanted.hint("merge"), "node"), "candidate-texts", compression="none")
    sure = materialize(links(pairs.where("first"), classes, text, percent), "links")
    groups = components(sure)
    of = lambda x: groups.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    apart = pairs.where("not first").join(of("a"), "a", "left").join(of("b"), "b", "left").where("of_a is null or of_b is null or of_a <> of_b")
    more = materialize(links(apart, classes, text, percent), "links")
    groups = materialize(components(sure.union(more)), "groups")
    open_sets = unsettled(classes, groups)
    sets = materialize(open_sets.join(text, "node"), "unsettled-texts", compression="none")
    rare = materialize(rare_shingles(sets, percent), "rare-shingles")
    exact = materialize(links(sharing(rare, percent), classes, text, percent, sketched=False), "links")
    drop_scratch(sets, rare, open_sets)
    if not exact.isEmpty():
        groups = components(sure.union(more).union(exact))
    drop_scratch(text, pairs)
    of_class = classes.select("set_key", "node", "least_id").join(groups, "node", "left").select("set_key", "least_id", F.coalesce("component", "node").alias("component"))
    of_class = materialize(of_class, "class-groups")
    least = of_class.groupBy("component").agg(F.min("least_id").alias("component_id"))
    # A hot set is one row here and many on the other side, which the skew join splits.
    of_set = of_class.join(least, "component").select("set_key", "component_id")
    full = signed.where("set_key is not null").select("doc_id", "n_shingles", "set_key").join(of_set, "set_key", "left").select("doc_id", "n_shingles", "component_id")
    blank = signed.where("set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.union(blank).select("doc_id", "n_shingles", "component_id").withColumn("kept", F.expr("doc_id <=> component_id"))
