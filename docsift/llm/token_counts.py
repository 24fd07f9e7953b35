"""Token counts by prefix dynamic programming (operator 9).

The encoding of every prefix of a pre-token ends in one token, the only one that fits behind the encoding of what
precedes it; its count is that of the shorter prefix plus one.  One pass therefore stores the exact count at every
prefix, and questions of truncation and budget are answered by a search in the stored counts instead of encoding again.
Counts of whole documents are sums over their pre-tokens, each of which a worker computes once.

Results: a null text counts as empty (0 bytes, 0 tokens); rows are counted by themselves, so ties and repeated rows give
equal results; an empty table gives an empty table; columns other than id and text are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from docsift.llm.bpe import LEAN_MEMO_CHARS, SPACES, Bpe, Memo, load
from docsift.llm.common import batch_rows, lean, texts

_SPACE = re.compile(f"[{SPACES}]+")


class PrefixCounts:
    """Exact token counts at the prefixes of one text.

    ``at[k]`` is the number of tokens that the vocabulary gives the first k code points.  A prefix that ends within a
    pre-token is split like the whole text up to there, but for three cases: white space at its end is one pre-token, a
    contraction that is cut falls apart into its mark and letter, and a special token that is cut is plain text, split
    together with the marks or white space before it.  Each place is passed a bounded number of times.
    """

    def __init__(self, model: Bpe, text: str):
        self.at, rest = [0], ""
        for section, added in model.sections(text):
            total = self.at[-1]
            if added < 0:
                counts, last = section_counts(model, section)
                self.at += [total + n for n in counts]
                rest = section[last:]
                continue
            # The cut token is split together with the piece before it.
            before = self.at[len(self.at) - 1 - len(rest)]
            self.at += [before + n for n in section_counts(model, rest + section[:-1])[0][len(rest) :]]
            self.at.append(total + 1)
            rest = ""

    def fitting(self, budget: int) -> int:
        """Code points of the longest prefix up to which no prefix needs more than ``budget`` tokens."""
        best = [0]
        for n in self.at[1:]:
            best.append(max(best[-1], n))
        return bisect_right(best, budget) - 1


def section_counts(model: Bpe, section: str) -> tuple[list[int], int]:
    """Tokens of each prefix but the empty one of a text without special tokens, and where its last piece begins."""
    out, last, total = [0] * len(section), 0, 0
    runs = _SPACE.finditer(section)
    blank = next(runs, None)
    for piece in model.splitter(section).finditer(section):
        begin, end = piece.span()
        if blank and begin <= blank.start() < end:
            # Prefixes that end in this white space: all of it from its beginning on is one pre-token.
            _fill(model, section, blank.start(), blank.end(), total, out)
            last = blank.start()
            blank = next(runs, None)
        if _SPACE.fullmatch(piece[0]):
            total += model.prefix_counts(model.shaped(piece[0]))[-1]
            continue
        last = begin
        total = _fill(model, section, begin, end, total, out, section[begin] == " ")
        if section[begin] == "'" and end - begin == 3 and section[begin + 1 : end].isalpha():
            out[begin + 1] = out[begin] + model.prefix_counts(model.shaped(section[begin + 1]))[-1]
    return out, last


def _fill(model: Bpe, section: str, begin: int, end: int, total: int, out: list[int], skip: bool = False) -> int:
    """Counts at the prefixes that end in one pre-token, its blank in front left out with ``skip``; returns the last."""
    counts, byte = model.prefix_counts(model.shaped(section[begin:end])), 0
    for k in range(begin, end):
        c = section[k]
        byte += 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
        if k >= begin + skip:
            out[k] = total + counts[byte]
    return total + counts[-1]


@lru_cache(4)
def _counts(path: str) -> Memo:
    model = load(path)
    return Memo(lambda word: model.prefix_counts(model.shaped(word))[-1], LEAN_MEMO_CHARS)


def prefix_counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and prefix_tokens array<int>, the count at every prefix, entry 0 being the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(tokenizer_path)
        for batch in batches:
            for doc_id, text in batch_rows(batch, "doc_id", "text"):
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([PrefixCounts(model, text).at], pa.list_(pa.int32()))], ["doc_id", "prefix_tokens"])

    return texts(docs, id_col=id_col, text_col=text_col).mapInArrow(lean(run), "doc_id long, prefix_tokens array<int>")


def token_counts(docs: DataFrame, tokenizer_path: str, *, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = load(tokenizer_path), _counts(tokenizer_path)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc_id, text in batch_rows(batch, "doc_id", "text"):
                n = 0
                for section, added in model.sections(text):
                    n += 1 if added >= 0 else sum(map(memo.__getitem__, model.words(section)))
                out[0].append(doc_id)
                out[1].append(len(text.encode("utf-8", "surrogatepass")))
                out[2].append(n)
                out[3].append(n > limit)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
