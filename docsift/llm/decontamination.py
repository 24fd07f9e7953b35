"""Benchmark decontamination by latent semantic retrieval (operator 1).

Benchmark items are taken in blocks of bounded size, which hold thousands of items.  For each block:

1. one pass over all documents counts in how many of them each of the block's words occurs, and writes every document as
   numbers of the block's words;
2. the TF-IDF vectors of the block's passages and of the passages of all documents go through a randomised singular value
   decomposition of fixed rank.  The documents enter by the product of their term matrix with one that adds terms with
   random signs, which one pass over the numbers sums in whole numbers, so it does not depend on partitions; products with
   the block's passages are summed over Spark tasks, and the basis is made orthogonal by its small Gram matrix.  The right vectors span the latent space;
3. one more pass over the numbers projects every passage of every document into that space and compares it with the block's
   items by cosine, where the document side keeps the length of its full TF-IDF vector, so words outside the space count
   against it;
4. a candidate is a leak if the longest common subsequence of words covers enough of the item, and if the item's answer
   (its rarest words) is there too.  This finds paraphrases that drop, insert or replace words.

A space of fixed rank cannot hold every item.  Items of which it keeps too little are compared with each document that holds
enough of their words, and verbatim items of any length are found by their rarest sequence of words, so a full space costs
time and loses no leak.

Only words of a block's items have weight in step 3's dot product, so other words enter by their weight alone: one weight for
all of them, which is that of the block's words on average over all documents.

Results: null, empty and very short texts match nothing; items with fewer than ``MIN_WORDS`` words need their exact
sequence of words; repeated documents and items each give their own rows; very long texts are searched in stretches, so
memory does not follow their length; empty tables give an empty table; columns other than ids and texts are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.common import batch_rows, drop_scratch, lean, materialize, texts

#: Items of a block, their distinct words and the bytes of their texts, so that what every task gets is bounded.
BLOCK_ITEMS, BLOCK_TERMS, BLOCK_BYTES = 8192, 65536, 16 << 20
#: Words of a passage and between the beginnings of passages.
PASSAGE, STRIDE = 48, 16
#: The same of short passages, and the words of the items that they are for: any so many words lie within one of them.
SHORT_PASSAGE, SHORT_STRIDE, SHORT_ITEM = 24, 8, 16
#: Words of a document whose passages are projected at once.
STRETCH = 4096
#: Words of the sequence by which a verbatim item is looked up.
ANCHOR = 3
#: Directions of the latent space, and the weight of the items against all documents.
RANK, OVERSAMPLE, POWER_STEPS, ITEM_WEIGHT = 256, 32, 2, 10.0
#: Share of an item's squared length that the space must keep for its cosine to be relied on.
LEAST_KEPT = 0.15
#: Steps of a unit to which weights of documents' passages are rounded for the space, and passages taken at once.
STEPS, PASSAGES = 512, 256
#: Words in more than this share of all documents are not terms, but for those of items that would be left with fewer terms
#: than this and than a quarter of their words.
MAX_SHARE, LEAST_OWN = 0.2, 6
COSINE, LCS_SHARE, ANSWER_SHARE, ANSWER_WORDS, MIN_WORDS = 0.2, 0.65, 0.5, 8, 8

_PLAIN = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case words; everything in ASCII but letters and digits separates."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    masks: dict = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        u = row & masks.get(w, 0)
        if u:
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


class Block:
    """What a task needs to search one block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, w) for i, t in items if (w := words_of(t))]
        self.vocab = {w: k for k, w in enumerate(sorted({w for _, ws in self.items for w in ws}))}
        self.idf: np.ndarray | None = None
        self.weights: np.ndarray | None = None

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words in the vocabulary, -1 for others."""
        return np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))

    def packed(self, words: list[bytes]) -> bytes:
        """The same in two bytes a word where they suffice, as they are written."""
        return self.numbers(words).astype(self._width()).tobytes()

    def unpacked(self, data: bytes) -> np.ndarray:
        ids = np.frombuffer(data, self._width()).astype(np.int64)
        ids[ids >= len(self.vocab)] = -1
        return ids

    def _width(self) -> str:
        # -1 becomes 65535 in two bytes.
        return "<u2" if len(self.vocab) < 65535 else "<i4"

    def weigh(self, counts: dict[int, int], documents: int, given: list[list[bytes]] | None = None) -> None:
        """Inverse document frequencies from counts over all documents; words of too many documents get none, but where an item has hardly any others.

        Words outside the vocabulary weigh as its words do, root mean square over the documents with them, or as in texts
        that are given.
        """
        df = np.array([counts.get(k, 0) for k in range(len(self.vocab))], float)
        self.idf = np.log((1 + documents) / (1 + df)) + 1
        outside = float(np.sqrt(np.average(self.idf**2, weights=df))) if df.any() else np.log(1 + documents) + 1
        if given is not None:
            outside = self._outside(given, documents)
        frequent, spared = df > MAX_SHARE * max(documents, 5), set()
        for _, words in self.items:
            own = np.array(sorted({self.vocab[w] for w in words}))
            # An item that itself is frequent would be left with few terms or none: its words stay terms.
            if (~frequent[own]).sum() < min(LEAST_OWN, -(-len(own) // 4)):
                spared.update(own.tolist())
        frequent[list(spared)] = False
        self.idf[frequent] = 0.0
        self.least_terms = min([2, *(len({w for w in words if self.idf[self.vocab[w]] > 0}) for _, words in self.items)])
        self.weights = np.append(self.idf, outside)
        # The first rarest sequence of an item; its first word marks where a document is looked at.
        self.anchors: dict[tuple, list[tuple[int, int]]] = {}
        self.first = np.zeros(len(self.vocab) + 1, bool)
        for k, (_, words) in enumerate(self.items):
            size = min(ANCHOR, len(words))
            at = min(range(len(words) - size + 1), key=lambda p, words=words: (df[self.vocab[words[p]]], p))
            self.anchors.setdefault(tuple(self.vocab[w] for w in words[at : at + size]), []).append((k, at))
            self.first[self.vocab[words[at]]] = True
        self.sizes = sorted({len(a) for a in self.anchors})

    def _outside(self, given: list[list[bytes]], documents: int) -> float:
        """Weight of a word outside the vocabulary: root mean square over such words of the given texts."""
        df = Counter(w for words in given for w in set(words) if w not in self.vocab)
        n = Counter(w for words in given for w in words if w not in self.vocab)
        most = np.log(1 + documents) + 1
        if not n:
            return most
        idf = np.log((1 + len(given)) / (1 + np.array([df[w] for w in n]))) + 1
        return min(most, float(np.sqrt(np.average(idf**2, weights=list(n.values())))))

    def passages(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Terms and weights of each passage, of unit length."""
        ids = self.numbers(words)
        for at in range(0, max(1, len(ids) - PASSAGE + STRIDE), STRIDE):
            part = ids[at : at + PASSAGE]
            terms, n = np.unique(part[part >= 0], return_counts=True)
            weights = n * self.idf[terms]
            terms, weights = terms[weights > 0], weights[weights > 0]
            if len(terms):
                yield terms, (weights / np.sqrt((weights**2).sum())).astype(np.float32)

    def place(self, space: np.ndarray) -> None:
        """Project the items' passages; ``space`` has a row of latent coordinates for each word."""
        owners, rows = [], []
        for k, (_, words) in enumerate(self.items):
            for terms, weights in self.passages(words):
                owners.append(k)
                rows.append(weights @ space[terms])
        points = np.array(rows, np.float32).reshape(len(rows), space.shape[1])
        kept = np.sqrt((points**2).sum(axis=1))
        self.owners, self.points = np.array(owners, np.int64), (points / np.maximum(kept, 1e-6)[:, None]).astype(np.float32)
        # A passage's point is a sum over its words.
        self.space = (space * self.idf[:, None]).astype(np.float32)
        sizes = np.array([len(w) for _, w in self.items])
        long_enough, held = sizes[self.owners] >= MIN_WORDS, kept**2 >= LEAST_KEPT
        self.scales = [(PASSAGE, STRIDE, np.flatnonzero(held & long_enough)), (SHORT_PASSAGE, SHORT_STRIDE, np.flatnonzero(held & long_enough & (sizes[self.owners] <= SHORT_ITEM)))]
        self.scales = [(size, stride, columns, np.ascontiguousarray(self.points[columns].T)) for size, stride, columns in self.scales if len(columns)]
        # Items with a passage of which the space keeps too little.
        weak = np.zeros(len(self.items), bool)
        weak[self.owners[~held]] = True
        self.weak = np.flatnonzero(weak & (sizes >= MIN_WORDS))
        self.word_ids = np.concatenate([np.zeros(0, np.int64), *([self.vocab[w] for w in words] for _, words in self.items)]).astype(np.int64)
        self.sequences = [[self.vocab[w] for w in words] for _, words in self.items]
        self.begins, self.sizes_of = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), sizes
        rare = [sorted(set(w), key=lambda x: (-self.idf[self.vocab[x]], x))[:ANSWER_WORDS] for _, w in self.items]
        self.answers = [frozenset(self.vocab[w] for w in r) for r in rare]

    def search(self, words: list[bytes]) -> dict[int, tuple[float, float, float]]:
        """Leaked items of a document: cosine, share of the longest common subsequence, share of the answer."""
        return self.search_numbers(self.numbers(words))

    def search_numbers(self, ids: np.ndarray) -> dict[int, tuple[float, float, float]]:
        """The same of a document's numbers."""
        out: dict[int, tuple[float, float, float]] = {}
        weights = self.weights[ids]
        hit = np.flatnonzero((ids >= 0) & (weights > 0))
        if len(hit):
            there = np.zeros(len(self.vocab) + 1, bool)
            there[ids] = True
            there[-1] = False
            # A common subsequence has at most the item's words that are in the document at all.
            able = np.add.reduceat(there[self.word_ids], self.begins) >= LCS_SHARE * self.sizes_of
            squares = np.concatenate([[0.0], np.cumsum(weights**2)])
            for part in range(0, len(ids), STRETCH):
                self._close(ids, hit, squares, part, able, out)
            for k in self.weak[able[self.weak]].tolist():
                self._compare(k, ids, self._cosine(k, ids), out)
        self._verbatim(ids, out)
        return out

    def _close(self, ids: np.ndarray, hit: np.ndarray, squares: np.ndarray, part: int, able: np.ndarray, out: dict[int, tuple[float, float, float]]) -> None:
        """Items whose cosine with a passage that begins in one stretch reaches the threshold and that pass the comparison of words."""
        inside = hit[np.searchsorted(hit, part) : np.searchsorted(hit, part + STRETCH + PASSAGE)]
        if not len(inside) or not self.scales:
            return
        # Points of pieces of the least stride, which every passage is a whole number of.
        least = min(stride for _, stride, _, _ in self.scales)
        piece = (inside - part) // least
        begins = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
        fine = np.zeros(((min(STRETCH, len(ids) - part) + 2 * PASSAGE) // least, self.space.shape[1]), np.float32)
        fine[piece[begins]] = np.add.reduceat(self.space[ids[inside]], begins, axis=0)
        for size, stride, columns, points in self.scales:
            starts = np.arange(part, min(part + STRETCH, max(1, len(ids) - size + stride)), stride)
            # Passages with at least two terms of the block, or one if an item has no more.
            first, last = np.searchsorted(inside, starts), np.searchsorted(inside, starts + size)
            some = np.flatnonzero(last - first >= self.least_terms)
            if not len(some):
                continue
            at = (starts[some] - part) // least
            ends = np.minimum(starts[some] + size, len(ids))
            norm = np.maximum(np.sqrt(squares[ends] - squares[starts[some]]), 1e-9).astype(np.float32)
            cosine = (sum(fine[at + k] for k in range(size // least)) / norm[:, None]) @ points
            for p, q in zip(*np.nonzero((cosine >= COSINE) & able[self.owners[columns]]), strict=True):
                k, begin = int(self.owners[columns[q]]), int(starts[some[p]])
                item = self.sequences[k]
                # An item longer than a passage may begin well before it or end well behind it.
                around = max(len(item) // 2, STRIDE, len(item) - STRIDE)
                self._compare(k, ids[max(0, begin - around) : begin + size + around], float(cosine[p, q]), out)

    def _compare(self, k: int, part: np.ndarray, cosine: float, out: dict[int, tuple[float, float, float]]) -> None:
        """Enters item k if its words and its answer are in the region, in order as far as they must be."""
        region = part.tolist()
        item, there = self.sequences[k], set(region)
        answer = len(self.answers[k] & there) / max(1, len(self.answers[k]))
        if answer < ANSWER_SHARE or sum(map(there.__contains__, item)) / len(item) < LCS_SHARE:
            return
        lcs = _covering(item, region)
        found = (round(cosine, 6), round(lcs, 6), round(answer, 6))
        if lcs >= LCS_SHARE and found > out.get(k, (-1.0, 0.0, 0.0)):
            out[k] = found

    def _cosine(self, k: int, ids: np.ndarray) -> float:
        """Cosine of item k in the space with the words of a document, or of a part of one, that are terms."""
        own = ids[ids >= 0]
        terms, n = np.unique(own, return_counts=True)
        length = max(float(np.sqrt(((n * self.idf[terms]) ** 2).sum())), 1e-9)
        points = self.points[self.owners == k]
        return float((points @ (n @ self.space[terms])).max(initial=0.0)) / length if len(terms) else 0.0

    def _verbatim(self, ids: np.ndarray, out: dict[int, tuple[float, float, float]]) -> None:
        """Items whose words stand in the document in sequence and that no cosine found; theirs is that of the item's own stretch."""
        places = np.flatnonzero(self.first[ids]).tolist()
        words = ids.tolist() if places else []
        for p in places:
            for size in self.sizes:
                for k, offset in self.anchors.get(tuple(words[p : p + size]), ()):
                    item, begin = self.sequences[k], p - offset
                    if k in out or begin < 0 or words[begin : begin + len(item)] != item:
                        continue
                    out[k] = (round(self._cosine(k, ids[begin : begin + len(item)]), 6), 1.0, 1.0)


def _covering(item: list[bytes], region: list[bytes]) -> float:
    """Largest share of the item in the longest common subsequence with a stretch of twice its length."""
    size = 2 * len(item) + 4
    best = 0
    for at in range(0, max(1, len(region) - size + len(item) // 2 + 1), max(1, len(item) // 2)):
        best = max(best, common_subsequence(item, region[at : at + size]))
    return best / len(item)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    """Items in order of their id, some thousand at a time."""
    rows = texts(benchmark, id_col=id_col, text_col=text_col).orderBy("doc_id", "text").toLocalIterator()
    batch, size, terms = [], 0, set()
    for r in rows:
        batch.append((r["doc_id"], r["text"]))
        size += len(r["text"])
        terms.update(words_of(r["text"]))
        if len(batch) >= BLOCK_ITEMS or size >= BLOCK_BYTES or len(terms) >= BLOCK_TERMS:
            yield Block(batch)
            batch, size, terms = [], 0, set()
    if batch:
        yield Block(batch)


def _document_counts(docs: DataFrame, block: Block) -> tuple[dict[int, int], int, DataFrame]:
    """Documents with each word of the block, all documents, and a table of every document as numbers of the block's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, documents = np.zeros(len(block.vocab) + 1, np.int64), 0
        for batch in batches:
            rows = []
            for (text,) in batch_rows(batch, "text"):
                ids = block.packed(words_of(text))
                df[np.unique(block.unpacked(ids))] += 1
                rows.append(ids)
            documents += len(rows)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(rows, pa.binary()), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64())], ["doc_id", "words", "key", "n"])
        # The last place, which -1 points at too, is for the number of documents.
        df[-1] = documents
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary()), pa.array(at, pa.int64()), pa.array(df[at])], ["doc_id", "words", "key", "n"])

    found = materialize(docs.mapInArrow(lean(run), "doc_id long, words binary, key long, n long"), "document-words")
    counts = {r["key"]: r["n"] for r in found.where("key is not null").groupBy("key").agg(F.sum("n").alias("n")).collect()}
    documents = counts.pop(len(block.vocab), 0)
    return counts, documents, found


def _folds(terms: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A column and a random sign for each term, the same for everyone who asks; as many terms in each column, one if that is enough."""
    rng = np.random.default_rng(2)
    return rng.permutation(terms) % width, rng.integers(0, 2, terms) * 2.0 - 1


class _Products:
    """Sum over passages of w (F w)': w are their TF-IDF vectors, rounded, and F adds terms of one column with their signs.

    All numbers are whole and below 2 ** 53, so the sum is the same in any order.
    """

    def __init__(self, block: Block, width: int):
        self.block, self.width = block, width
        self.columns, self.signs = _folds(len(block.vocab), width)
        self.sums, self.passages = np.zeros(len(block.vocab) * width), 0
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, ids: np.ndarray) -> None:
        """A document, as consecutive passages: each of its words is in one."""
        terms, most = len(self.block.vocab), PASSAGE * PASSAGES
        for part in range(0, len(ids), most):
            own = ids[part : part + most]
            at = np.flatnonzero((own >= 0) & (self.block.weights[own] > 0))
            if not len(at):
                continue
            size = -(-len(own) // PASSAGE)
            if self.held + size > PASSAGES:
                self.flush()
            # Passage and term in one number.
            self.waiting.append((at // PASSAGE + self.held) * terms + own[at])
            self.held += size

    def flush(self) -> None:
        if not self.waiting:
            return
        keys, n = np.unique(np.concatenate(self.waiting), return_counts=True)
        self.waiting, self.held = [], 0
        passage, term = np.divmod(keys, len(self.block.vocab))
        begins = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        sizes = np.diff(np.append(begins, len(keys)))
        weights = n * self.block.idf[term]
        weights = np.rint(STEPS * weights / np.repeat(np.sqrt(np.add.reduceat(weights**2, begins)), sizes))
        # Each term of a passage with each of them.
        partners = np.repeat(sizes, sizes)
        right = np.arange(partners.sum()) + np.repeat(np.repeat(begins, sizes) - np.cumsum(partners) + partners, partners)
        values = np.repeat(weights, partners) * (weights * self.signs[term])[right]
        np.add.at(self.sums, np.repeat(term * self.width, partners) + self.columns[term][right], values)
        self.passages += len(begins)


def _corpus_space(words: DataFrame, block: Block) -> np.ndarray:
    """A matrix of few columns whose product with its transpose stands for the mean of w w' over all documents' passages w.

    By Nystrom's formula, from the product of that mean with a matrix that adds terms with random signs.
    """
    terms, band = len(block.vocab), 16
    width = min(RANK + OVERSAMPLE, terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = _Products(block, width)
        for batch in batches:
            for (data,) in batch_rows(batch, "words"):
                products.add(block.unpacked(data))
        products.flush()
        if not products.passages:
            return
        # Half the bytes where 32 bits hold a band's sums.
        parts = np.split(products.sums, range(band * width, terms * width, band * width))
        packed = [p.astype("<i4" if np.abs(p).max() < 2**31 else "<f8").tobytes() for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([products.passages] * len(parts), pa.int64()), pa.array(packed, pa.binary())], ["band", "passages", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        passages: dict[int, int] = {}
        for batch in batches:
            for k, n, sums in batch_rows(batch, "band", "passages", "sums"):
                size = width * min(band, terms - k * band)
                passages[k] = passages.get(k, 0) + n
                totals.setdefault(k, np.zeros(size))
                totals[k] += np.frombuffer(sums, "<i4" if len(sums) == 4 * size else "<f8")
        for k, total in totals.items():
            mean = (total / (STEPS**2 * passages[k])).astype("<f4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([mean], pa.binary())], ["band", "mean"])

    sums = words.where("words is not null").mapInArrow(lean(run), "band int, passages long, sums binary")
    parts = sorted(sums.repartition(8, "band").mapInArrow(lean(added), "band int, mean binary").collect(), key=lambda r: r["band"])
    if not parts:
        return np.zeros((terms, 0), np.float32)
    product = np.concatenate([np.frombuffer(r["mean"], "<f4").reshape(-1, width) for r in parts])
    columns, signs = _folds(terms, width)
    core = np.zeros((width, width))
    np.add.at(core, columns, product * signs[:, None])
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-6 * max(values.max(), 1e-30)
    return product @ (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)


def _orthogonal(basis: np.ndarray) -> np.ndarray:
    """The same span with orthonormal columns, by the Gram matrix, so nothing of the basis' size is decomposed.

    Directions that hardly occur beside the strongest one are dropped.  Twice, since the first pass leaves rounding errors.
    """
    for _ in range(2):
        gram = np.zeros((basis.shape[1],) * 2)
        for at in range(0, len(basis), 4096):
            part = basis[at : at + 4096].astype(np.float64)
            gram += part.T @ part
        values, vectors = np.linalg.eigh(gram)
        good = values > 1e-10 * max(values.max(), 1e-30)
        basis = basis @ (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)
    return basis


def randomised_svd(spark: SparkSession, rows: list[tuple[np.ndarray, np.ndarray]], beside: np.ndarray, terms: int, rank: int) -> np.ndarray:
    """Right singular vectors (terms x rank) of a sparse matrix whose products are summed over Spark tasks.

    ``rows`` are bounded (a block's passages); the columns of ``beside`` are further rows, few and dense.  Each power step multiplies the transposed matrix with the
    matrix times a basis: tasks work on their rows and give one partial sum in bands of terms, which are added by band, always
    in the same order.  The driver holds one matrix of terms x rank, at most 75 MB.
    """
    rank = max(1, min(rank, len(rows) + beside.shape[1], terms))
    width = min(rank + OVERSAMPLE, terms)
    table = pd.DataFrame({"part": [k % 4 for k in range(len(rows))], "place": range(len(rows)), "idx": [r[0].astype("<i4").tobytes() for r in rows], "val": [r[1].astype("<f4").tobytes() for r in rows]})
    stored = materialize(spark.createDataFrame(table, "part int, place int, idx binary, val binary"), "item-passages")
    matrix = stored.repartition(4, "part").sortWithinPartitions("part", "place")
    band = 1024

    def product(basis: np.ndarray) -> np.ndarray:
        bands = range(0, terms, band)

        def partial(part: int, out: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(bands), pa.int32()), pa.array([part] * len(bands), pa.int32()), pa.array([out[b : b + band].tobytes() for b in bands], pa.binary())], ["band", "part", "sums"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, out = -1, None
            for batch in batches:
                for part, idx, val in batch_rows(batch, "part", "idx", "val"):
                    if part != now:
                        if out is not None:
                            yield partial(now, out)
                        now, out = part, np.zeros((terms, basis.shape[1]), np.float32)
                    i, v = np.frombuffer(idx, "<i4"), np.frombuffer(val, "<f4")
                    out[i] += v[:, None] * (v @ basis[i])
            if out is not None:
                yield partial(now, out)

        def added(key, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"band": [key[0]], "sums": [sum(np.frombuffer(p, np.float32) for p in pdf.sort_values("part")["sums"]).tobytes()]})

        parts = matrix.mapInArrow(lean(run), "band int, part int, sums binary").groupBy("band").applyInPandas(added, "band int, sums binary").collect()
        out = np.concatenate([np.frombuffer(r["sums"], np.float32).reshape(-1, basis.shape[1]) for r in sorted(parts, key=lambda r: r["band"])])
        return out + beside @ (beside.T @ basis)

    basis = _orthogonal(np.random.default_rng(1).standard_normal((terms, width), np.float32))
    for _ in range(POWER_STEPS):
        basis = _orthogonal(product(basis))
    # Rayleigh-Ritz in the basis: eigenvectors of Q'A'AQ, largest first.
    small = basis.T.astype(np.float64) @ product(basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    drop_scratch(stored)
    return (basis @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share for each document that holds an item."""
    spark = docs.sparkSession
    docs = texts(docs, id_col=id_col, text_col=text_col)
    schema = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, item_id_col, item_text_col):
        if not block.items:
            continue
        counts, documents, words = _document_counts(docs, block)
        block.weigh(counts, documents)
        own = [p for _, item in block.items for p in block.passages(item)]
        if own:
            # The items weigh more than all documents together, so the space holds them and not only what is frequent.
            scale = np.float32(np.sqrt(ITEM_WEIGHT / len(own)))
            rows = [(terms, weights * scale) for terms, weights in own]
            block.place(randomised_svd(spark, rows, _corpus_space(words, block), len(block.vocab), RANK))
            out = out.union(materialize(words.where("words is not null").mapInArrow(lean(_searcher(block)), schema), "leaks"))
        drop_scratch(words)
    return out


def _searcher(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, data in batch_rows(batch, "doc_id", "words"):
                for k, scores in sorted(block.search_numbers(block.unpacked(data)).items()):
                    for column, value in zip(out, (doc_id, block.items[k][0], *scores), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

    return run
