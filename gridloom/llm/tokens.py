"""Token counts that follow edits (operator 2).

A text is cut into pre-tokens by the tokenizer's pattern; no token crosses their borders.  A document keeps
its pre-tokens' lengths and token counts in blocks, and a segment tree of sums (characters, tokens) over the
blocks.  An edit finds its block by descending the character sums, cuts anew from the last border that the
edit can't have moved (the pattern looks at most two characters past a border) until a new border meets an
old one behind the edit, encodes only what was cut anew, and updates the sums on the block's path to the
root.  Pre-tokens seen before are counted from memory.

Defined results: a null or empty text has 0 tokens; edits are (start, end, text) in characters of the text
before any of them, in any order, applied from the last to the first; overlapping or outlying edits raise
ValueError; repeated rows give repeated results; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The pattern of this vocabulary's pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters past a border that the pattern may have looked at.
LOOK = 2
BLOCK = 128
REMEMBER = 400_000

#: The edits of the registered query: personal data give way to marks.
REDACTIONS = ((regex.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), "<email>"), (regex.compile(r"\+?\d[\d -]{7,}\d"), "<number>"))


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


class Counter:
    """Token counts of pre-tokens, remembered."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:  # a file of the installed tokenizer package, not an input table
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.find = regex.compile(PATTERN)
        self.seen: dict[str, int] = {}
        self.encoded = 0

    def count(self, piece: str) -> int:
        n = self.seen.get(piece)
        if n is None:
            if len(self.seen) >= REMEMBER:
                self.seen.clear()
            n = self.seen[piece] = len(self.encoding.encode_ordinary(piece))
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


class Tree:
    """Blocks of (characters, tokens) leaves under a segment tree of sums."""

    def __init__(self, text: str, c: Counter):
        self.c, self.text, self.cut_anew = c, text, 0
        pieces = c.find.findall(text)
        leaves = list(zip(map(len, pieces), map(c.count, pieces), strict=True))
        self.blocks = [leaves[i : i + BLOCK] for i in range(0, len(leaves), BLOCK)] or [[]]
        self._sums()

    def _sums(self) -> None:
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, b in enumerate(self.blocks):
            self.chars[self.width + i] = sum(x[0] for x in b)
            self.tokens[self.width + i] = sum(x[1] for x in b)
        for i in range(self.width - 1, 0, -1):
            self._up(i)

    def _up(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def n_leaves(self) -> int:
        return sum(map(len, self.blocks))

    def find(self, at: int) -> tuple[int, int]:
        """(block, characters before it) of the block that holds character at."""
        i, before = 1, 0
        while i < self.width:
            i *= 2
            if at >= before + self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return i - self.width, before

    def edit(self, start: int, end: int, new: str) -> None:
        if not 0 <= start <= end <= len(self.text):
            raise ValueError("an edit must lie within its text")
        self.text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        block, before = self.find(max(0, start - LOOK))
        while block and before > start - LOOK:
            block -= 1
            before -= self.chars[self.width + block]
        leaf, at = 0, before
        b = self.blocks[block]
        while leaf < len(b) and at + b[leaf][0] <= start - LOOK:
            at += b[leaf][0]
            leaf += 1
        # old borders behind the edit, walked alongside the new ones
        j, k, old = block, leaf, at
        fresh: list[tuple[int, int]] = []
        new_at, met = at, False
        scan = self.c.find.finditer(self.text, at)
        while True:
            while j < len(self.blocks) and (old < end or old + shift < new_at):
                if k == len(self.blocks[j]):
                    j, k = j + 1, 0
                    continue
                old += self.blocks[j][k][0]
                k += 1
            if old >= end and old + shift == new_at and new_at >= start + len(new):
                met = True
                break
            m = next(scan, None)
            if m is None:
                break
            fresh.append((m.end() - m.start(), self.c.count(m.group())))
            new_at = m.end()
        self.cut_anew += len(fresh)
        if not met:
            j, k = len(self.blocks), 0
        tail = self.blocks[j][k:] if j < len(self.blocks) else []
        merged = self.blocks[block][:leaf] + fresh + tail
        last = min(j, len(self.blocks) - 1)
        if last == block and len(merged) <= 2 * BLOCK:
            self.blocks[block] = merged
            i = self.width + block
            self.chars[i], self.tokens[i] = sum(x[0] for x in merged), sum(x[1] for x in merged)
            while i > 1:
                i //= 2
                self._up(i)
        else:  # blocks join or split: their number changes, so the sums are laid out anew
            self.blocks[block : last + 1] = [merged[i : i + BLOCK] for i in range(0, len(merged), BLOCK)]
            self.blocks = self.blocks or [[]]
            self._sums()


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits that put marks in place of personal data; of overlapping finds the first rule's stays."""
    out: list[tuple[int, int, str]] = []
    for pattern, mark in REDACTIONS:
        for m in pattern.finditer(text):
            if not any(m.start() < e and s < m.end() for s, e, _ in out):
                out.append((m.start(), m.end(), mark))
    return out


def counted(text: str | None, edits: list[tuple[int, int, str]], c: Counter) -> tuple[int, int, int, int, int]:
    """(tokens before, tokens after, edits, pre-tokens before, pre-tokens cut anew)."""
    t = Tree(text or "", c)
    before, leaves = t.total, t.n_leaves
    edits = sorted(edits)
    if any(a[1] > b[0] for a, b in zip(edits, edits[1:], strict=False)):
        raise ValueError("edits must not overlap")
    for start, end, new in reversed(edits):
        t.edit(start, end, new)
    return before, t.total, len(edits), leaves, t.cut_anew


FIELDS = ("n_tokens", "n_tokens_edited", "n_edits", "n_pretokens", "n_cut_anew")
SCHEMA = "doc_id long, " + ", ".join(f"{f} long" for f in FIELDS)


def count(
    docs: DataFrame, edits: str | Callable[[str], list[tuple[int, int, str]]] = redactions, vocabulary: str | None = None
) -> DataFrame:
    """Token counts of each document before and after its edits.

    edits: the name of a column array<struct<start, end, text>>, or a rule that makes a text's edits.
    """
    path = vocabulary or default_vocabulary()
    rule = None if isinstance(edits, str) else edits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            rows = []
            for i, t in enumerate(b.column(1)):
                t = t.as_py()
                own = rule(t or "") if rule else [tuple(e.values()) for e in b.column(2)[i].as_py() or []]
                rows.append(counted(t, own, c))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(len(FIELDS)))], names=["doc_id", *FIELDS]
            )

    more = [] if rule else [docs[edits].alias("edits")]
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *more)
    return d.mapInArrow(run, SCHEMA)
