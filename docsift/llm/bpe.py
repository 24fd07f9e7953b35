"""Byte-pair encoding and decoding with a backtracking encoder (operator 8).

An Aho-Corasick automaton over the vocabulary proposes, at each place of a word, the longest token that starts there.
A proposed token is taken only if it may stand behind the token before it: the pair-compatibility test asks whether the
merge list would have joined characters across their border.  If no token fits, the last one is replaced by its next
shorter prefix token.  Places that cannot be completed are remembered, so each is left once and the work is linear.
The outcome equals that of the merge list.  Decoding slices one string of all token texts by an offset table.

Results: a null text counts as empty (no ids, empty decoded text); each row is encoded by itself, so ties and repeated
rows give equal results; an empty table gives an empty table; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from docsift.llm.common import batch_rows, lean, texts

# The white space of Unicode's White_Space property.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# The pre-tokenization patterns of the public vocabulary files, for letters, numbers and white space as given.
_WORDS = "[{L}]+|'(?:s|t|re|ve|m|ll|d)|[{N}]|[^{S}{L}{N}]+"
_BYTES = " ?[{L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
_UNICODE = {"L": r"\p{L}", "N": r"\p{N}", "S": SPACES}
# The same classes within Latin-1, for which the plain engine takes half the time.
_LATIN = {"L": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "N": "0-9\xb2\xb3\xb9\xbc-\xbe", "S": "\\t-\\r \x85\xa0"}
WORD_END = "\x00"
#: Characters of the words in a generation of a Python worker's memo, with so many more for each word.
MEMO_CHARS, MEMO_EXTRA = 5 << 20, 64
#: The same where an entry holds only numbers.
LEAN_MEMO_CHARS = 14 << 20
#: Code points from here on are in no version of Unicode letters or numbers: unassigned, tags or for private use.
PLANES = 0x40000


@lru_cache(1)
def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 bytes stand for themselves, others count up from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


class Memo(dict):
    """A dict that computes what it lacks.

    It holds two generations of words with at most ``size`` characters together, ``MEMO_EXTRA`` added for each: when the newer
    is full it becomes the older, and entries that are asked for again move up, so frequent ones stay while memory is bounded.
    """

    def __init__(self, compute, size: int = MEMO_CHARS):
        super().__init__()
        self.compute, self.size, self.held, self.older = compute, size, 0, {}

    def __missing__(self, key):
        weight = len(key) + MEMO_EXTRA
        out = self.older.get(key)
        if out is None:
            out = self.compute(key)
        if weight > self.size // 8:
            return out  # a single huge word is not worth the place of many
        if self.held + weight > self.size:
            self.older, self.held = dict(self), 0
            self.clear()
        self.held += weight
        self[key] = out
        return out


def _splitter(path: str) -> Tokenizer:
    """The library's normalizer and pre-tokenizer of a file, without its vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    parts = {k: spec.get(k) for k in ("version", "normalizer", "pre_tokenizer")}
    return Tokenizer.from_str(json.dumps(parts | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}))


@lru_cache(4)
def library_classes(path: str) -> tuple[str, str, str]:
    """Letters and numbers as the library's pre-tokenizer has them, and code points to treat with its own tables.

    All code points in a row are split into runs of one class, and one member of each run is tried between letters, marks and
    numbers.  The last are those beyond the first plane, those that Python's tables do not know, and those on which the
    tables differ.  The results are the insides of character classes.
    """
    pre, spaces = _splitter(path).pre_tokenizer, re.compile(f"[{SPACES}]")
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, PLANES)])
    kinds, own = np.zeros(len(points), np.uint8), np.zeros(len(points), np.uint8)
    one = lambda x: len(pre.pre_tokenize_str(x)) == 1
    for at in range(0, len(points), 4096):
        text = "".join(map(chr, points[at : at + 4096].tolist()))
        for _, (begin, end) in pre.pre_tokenize_str(text):
            c = text[end - 1]
            if one(f"a{c}a"):
                kinds[at + begin : at + end] = 1
            elif not one(f"!{c}!") and not spaces.match(c):
                kinds[at + begin : at + end] = 2
        for m in regex.finditer(r"(\p{L}+)|\p{N}+", text):
            own[at + m.start() : at + m.end()] = 1 if m[1] else 2

    def ranges(mask: np.ndarray) -> str:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
        return "".join(f"\\U{points[a]:08x}-\\U{points[b - 1]:08x}" for a, b in edges.reshape(-1, 2))

    unknown = np.array([unicodedata.category(chr(c)) == "Cn" for c in points[: 0x10000 - 0x800].tolist()])
    return ranges(kinds == 1), ranges(kinds == 2), ranges(unknown | (kinds != own)[: len(unknown)]) + "\U00010000-\U0010ffff"


class Bpe:
    """A vocabulary file of the tokenizers library, read into match, prefix, split and offset tables."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.lowers = bool(self.suffix)
        shape = _WORDS if self.lowers else _BYTES
        self.unicode, self.latin = regex.compile(shape.format(**_UNICODE)), re.compile(shape.format(**_LATIN))
        letters, numbers, odd = library_classes(path)
        # The exact classes are long, so they are used only for texts with a character on which tables may differ.
        self.exact, self.odd = re.compile(shape.format(L=letters, N=numbers, S=SPACES)), re.compile(f"[{odd}]")
        self.normalizer = _splitter(path).normalizer
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.added_pattern = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = [self.vocab[a + b] for a, b in merges]
        # Tokens are numbered by rank here: the letters first, then the merges in their order.
        later = {*made, *self.added.values()}
        self.ids = [i for i in self.vocab.values() if i not in later] + made
        rank = {i: r for r, i in enumerate(self.ids)}
        self.left, self.right = list(range(len(self.ids))), list(range(len(self.ids)))
        self.joined: dict[tuple[int, int], int] = {}
        for (a, b), i in zip(merges, made, strict=True):
            x, y, z = rank[self.vocab[a]], rank[self.vocab[b]], rank[i]
            self.joined[x, y] = z
            self.left[z], self.right[z] = x, y
        names = {i: s for s, i in self.vocab.items()}
        self.shape = [self._shape(names[i]) for i in self.ids]
        self.length = [len(s) for s in self.shape]
        self.automaton = ahocorasick.Automaton()
        for r, s in enumerate(self.shape):
            self.automaton.add_word(s, r)
        self.automaton.make_automaton()
        known = {s: r for r, s in enumerate(self.shape)}
        self.shorter = [next((known[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in known), -1) for s in self.shape]
        self.fits = Memo(self._fits)
        # Decoding: the texts of all ids in one string and where each begins.
        texts_of = {**names, **{i: s for s, i in self.added.items()}}
        self.offsets, self.blob = [0], "".join(texts_of.get(i, "") for i in range(max(texts_of) + 1))
        for i in range(max(texts_of) + 1):
            self.offsets.append(self.offsets[-1] + len(texts_of.get(i, "")))
        self.letters = byte_letters()

    def _shape(self, name: str) -> str:
        return name[: -len(self.suffix)] + WORD_END if self.suffix and name.endswith(self.suffix) and name != self.suffix else name

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether the two tokens stay apart: undo the younger one step by step and look for a merge across the border."""
        a, b = pair
        bound = len(self.ids)
        while True:
            if self.joined.get((a, b), bound) < bound:
                return False
            whole_a, whole_b = self.left[a] == a, self.left[b] == b
            if whole_a and whole_b:
                return True
            if not whole_a and (whole_b or a > b):
                bound, a = a, self.right[a]  # merges across the border now count only if older than a's own
            else:
                bound, b = b + 1, self.left[b]  # on equal rank the merge further left comes first

    def shaped(self, word: str) -> str:
        letters = self.letters
        return "".join([letters[b] for b in word.encode("utf-8", "surrogatepass")]) + (WORD_END if self.suffix else "")

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        s = self.shaped(word)
        length, shorter, fits = self.length, self.shorter, self.fits
        n, longest = len(s), [-1] * (len(s) + 1)
        for end, token in self.automaton.iter(s):
            longest[end + 1 - length[token]] = token  # ends ascend, so the longest comes last
        path: list[int] = []
        at, token, dead, before = 0, longest[0], bytearray(n + 1), -1
        while at < n:
            while token >= 0 and (dead[at + length[token]] or before >= 0 and not fits[before, token]):
                token = shorter[token]
            if token >= 0:
                path.append(token)
                at += length[token]
                before, token = token, longest[at]
            else:
                dead[at] = 1
                if not path:
                    raise ValueError(f"no encoding for {word!r}")
                token = path.pop()
                at -= length[token]
                before, token = path[-1] if path else -1, shorter[token]
        return [self.ids[t] for t in path]

    def prefix_counts(self, s: str) -> list[int]:
        """Tokens in the encoding of each prefix of a shaped word; entry k is for its first k letters (operator 9).

        The encoding of a prefix ends in exactly one token: the one that fits behind the encoding of what precedes it.
        """
        last, count = [-1] * (len(s) + 1), [0] * (len(s) + 1)
        for end, token in self.automaton.iter(s):
            begin = end + 1 - self.length[token]
            if last[end + 1] < 0 and (not begin or last[begin] >= 0 and self.fits[last[begin], token]):
                last[end + 1], count[end + 1] = token, count[begin] + 1
        return count

    def sections(self, text: str) -> Iterator[tuple[str, int]]:
        """The text between added tokens with -1, and each added token's text with its id."""
        if self.added_pattern is None or "<|" not in text:
            yield text, -1
            return
        at = 0
        for m in self.added_pattern.finditer(text):
            yield text[at : m.start()], -1
            yield m[0], self.added[m[0]]
            at = m.end()
        yield text[at:], -1

    def words(self, section: str) -> list[str]:
        if self.lowers:
            if section.isascii():
                section = section.lower()
            elif self.odd.search(section):
                section = self.normalizer.normalize_str(section)
            else:
                s = unicodedata.normalize("NFC", section)
                section = s.lower() if "Σ" not in s else "".join([c.lower() for c in s])
        return self.splitter(section).findall(section)

    def splitter(self, section: str) -> re.Pattern:
        """The pre-tokenization pattern for a text: the fastest one that is exact for its characters."""
        try:
            section.encode("latin-1")
        except UnicodeEncodeError:
            return self.exact if self.odd.search(section) else self.unicode
        return self.latin

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for section, added in self.sections(text):
            if added >= 0:
                out.append(added)
            else:
                for w in self.words(section):
                    out += self.encode_word(w)
        return out

    def piece(self, i: int) -> str:
        return self.blob[self.offsets[i] : self.offsets[i + 1]]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; files without a decoder, as the word-end vocabulary, put a space between tokens."""
        if self.suffix:
            return " ".join([self.piece(i) for i in ids])
        value = {c: b for b, c in enumerate(self.letters)}
        named = {i: s for s, i in self.added.items()}
        data = b"".join(named[i].encode() if i in named else bytes(value[c] for c in self.piece(i)) for i in ids)
        return data.decode("utf-8", "replace")


@lru_cache(4)
def load(path: str) -> Bpe:
    return Bpe(path)


@lru_cache(4)
def _digests(path: str) -> Memo:
    model = load(path)
    names, piece = [str(i) for i in range(len(model.offsets) - 1)], model.piece

    def of(word: str) -> tuple[int, str, str]:
        ids = model.encode_word(word)
        return len(ids), " ".join([names[i] for i in ids]), " ".join([piece(i) for i in ids])

    return Memo(of)


def encode_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of each row: doc_id, ids array<int>, decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(tokenizer_path)
        for batch in batches:
            rows = [(i, ids := model.encode(t), model.decode(ids)) for i, t in batch_rows(batch, "doc_id", "text")]
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.int32())), pa.array(cols[2], pa.string())], ["doc_id", "ids", "decoded"])

    return texts(docs, id_col=id_col, text_col=text_col).mapInArrow(lean(run), "doc_id long, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the word-end vocabulary; words are encoded once per worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = load(tokenizer_path), _digests(tokenizer_path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc_id, text in batch_rows(batch, "doc_id", "text"):
                parts = []
                for section, added in model.sections(text):
                    if added >= 0:
                        parts.append((1, str(added), section))
                    else:
                        parts += map(memo.__getitem__, model.words(section))
                counts, ids, pieces = zip(*parts, strict=True) if parts else ((), (), ())
                out[0].append(doc_id)
                out[1].append(sum(counts))
                out[2].append(sha(" ".join(ids)))
                out[3].append(sha(" ".join(pieces)))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
