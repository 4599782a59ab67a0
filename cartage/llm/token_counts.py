"""Operator 8: edit-aware token counts.

A document's text is cut into pre-tokens by the tokenizer's pattern; each has its own number of tokens.  Blocks of
pre-tokens are the leaves of a segment tree whose nodes hold sums of characters, pre-tokens and tokens.  An edit
descends by characters, re-cuts from two pre-tokens before it until the cuts meet the old ones again, encodes only the
new pre-tokens and updates the sums on the path; a leaf that has grown to twice a block is split.

Defined cases: null and empty texts have 0 tokens; edits beyond the end are moved to the end; edits of one document are
applied in order of (seq, pos, ins), positions counted in the text as it then is; repeated edits are applied again; null
inserts are empty; edits of unknown documents are ignored; rows that repeat an id each get all its edits; a text of any
length is one tree in one task; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK, CONTEXT, MAX_CACHE = 128, 2, 500_000
EDIT = "array<struct<seq: long, pos: long, del: long, ins: string>>"


@lru_cache(maxsize=2)
def encoder(path: str) -> tuple[regex.Pattern, tiktoken.Encoding, dict[str, int]]:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return regex.compile(PATTERN), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), {}


class CountTree:
    """Blocks of pre-tokens under a segment tree of (characters, pre-tokens, tokens)."""

    def __init__(self, text: str, path: str) -> None:
        self.pattern, self.encoding, self.cache = encoder(path)
        self.encoded = 0
        pieces = self.pattern.findall(text)
        blocks = [pieces[i : i + BLOCK] for i in range(0, len(pieces), BLOCK)] or [[]]
        self._plant(blocks, [self._leaf(b) for b in blocks])

    def _plant(self, blocks: list[list[str]], leaves: list[tuple[int, int, int]]) -> None:
        self.blocks, self.size = blocks, 1
        while self.size < len(self.blocks):
            self.size *= 2
        self.sums = [(0, 0, 0)] * (2 * self.size)
        self.sums[self.size : self.size + len(leaves)] = leaves
        for k in range(self.size - 1, 0, -1):
            self.sums[k] = self._pair(k)

    def _count(self, piece: str) -> int:
        n = self.cache.get(piece)
        if n is None:
            if len(self.cache) >= MAX_CACHE:
                self.cache.clear()
            n = self.cache[piece] = len(self.encoding.encode_ordinary(piece))
        return n

    def _leaf(self, block: list[str]) -> tuple[int, int, int]:
        get, count = self.cache.get, self._count
        return sum(map(len, block)), len(block), sum([get(p) or count(p) for p in block])

    def _pair(self, k: int) -> tuple[int, int, int]:
        return tuple(a + b for a, b in zip(self.sums[2 * k], self.sums[2 * k + 1], strict=True))

    @property
    def totals(self) -> tuple[int, int, int]:
        return self.sums[1]

    def _find(self, pos: int) -> tuple[int, int, int]:
        """(block, pre-token in it, start of the pre-token) that holds the character at ``pos``, or the last one."""
        k, at = 1, 0
        while k < self.size:
            k *= 2
            if pos >= at + self.sums[k][0] and self.sums[k + 1][0]:
                at += self.sums[k][0]
                k += 1
        b = k - self.size
        i = 0
        pieces = self.blocks[b] if b < len(self.blocks) else []
        while i < len(pieces) - 1 and pos >= at + len(pieces[i]):
            at += len(pieces[i])
            i += 1
        return b, i, at

    def _pieces_from(self, b: int, i: int) -> Iterator[tuple[int, int, str]]:
        while b < len(self.blocks):
            for j in range(i, len(self.blocks[b])):
                yield b, j, self.blocks[b][j]
            b, i = b + 1, 0

    def edit(self, pos: int, delete: int, insert: str) -> None:
        total = self.sums[1][0]
        pos = min(max(pos, 0), total)
        delete = min(max(delete, 0), total - pos)
        b, i, at = self._find(pos)
        for _ in range(CONTEXT):
            if i == 0:
                prior = b - 1
                while prior >= 0 and not self.blocks[prior]:
                    prior -= 1
                if prior < 0:
                    break
                b, i = prior, len(self.blocks[prior])
            i -= 1
            at -= len(self.blocks[b][i])
        # The old text from ``at`` on is read piece by piece until new cuts meet old ones behind the edit.
        old = self._pieces_from(b, i)
        taken: list[tuple[int, int, str]] = []
        reach = at
        want = pos + delete + 64
        new: list[str] = []
        while True:
            while reach < want and (x := next(old, None)) is not None:
                taken.append(x)
                reach += len(x[2])
            source = "".join(x[2] for x in taken)
            edited = source[: pos - at] + insert + source[pos - at + delete :]
            ended = reach >= total
            shift = len(insert) - delete
            cuts, c = {}, at
            for n, x in enumerate(taken):
                c += len(x[2])
                cuts[c] = n + 1
            new, end, met = [], at, 0
            for m in self.pattern.finditer(edited):
                new.append(m[0])
                end = at + m.end()
                if end - shift >= pos + delete and end >= pos + len(insert) and end - shift in cuts and (ended or end - shift < reach - 1):
                    met = cuts[end - shift]
                    break
            if met or ended:
                break
            want = reach + 4096
        met = met or len(taken)
        self.encoded += len(new)
        gone = taken[:met]
        first = (b, i)
        by_block: dict[int, int] = {}
        for x in gone:
            by_block[x[0]] = by_block.get(x[0], 0) + 1
        for block, n in by_block.items():
            start = first[1] if block == first[0] else 0
            del self.blocks[block][start : start + n]
        self.blocks[first[0]][first[1] : first[1]] = new
        for block in {*by_block, first[0]}:
            k = self.size + block
            self.sums[k] = self._leaf(self.blocks[block])
            while k > 1:
                k //= 2
                self.sums[k] = self._pair(k)

        if any(len(self.blocks[block]) > 2 * BLOCK for block in {*by_block, first[0]}):
            self._split()

    def _split(self) -> None:
        """Cut leaves that have grown beyond twice the block; the sums of the others are taken over, nothing else is encoded."""
        blocks, leaves = [], []
        for k, b in enumerate(self.blocks):
            parts = [b] if len(b) <= 2 * BLOCK else [b[i : i + BLOCK] for i in range(0, len(b), BLOCK)]
            blocks += parts
            leaves += [self.sums[self.size + k]] if len(parts) == 1 else [self._leaf(p) for p in parts]
        self._plant(blocks, leaves)

    def text(self) -> str:
        return "".join(p for b in self.blocks for p in b)


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits that mask mail addresses and runs of three digits or more, last first, so that positions stay true."""
    return [(m.start(), m.end() - m.start(), "<mail>" if "@" in m[0] else "<num>") for m in reversed(list(MASKED.finditer(text)))]


MASKED = regex.compile(r"[\w.+-]{1,64}@[\w-]+(?:\.[\w-]+)+|[0-9]{3,}")


def _recount(batches: Iterator[pa.RecordBatch], path: str, given: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        edits = b.column(2).to_pylist() if given else [None] * b.num_rows
        for text, own in zip(b.column(1).to_pylist(), edits, strict=True):
            text = text or ""
            tree = CountTree(text, path)
            _, pieces, tokens = tree.totals
            todo = [(e["pos"] or 0, e["del"] or 0, e["ins"] or "") for e in own or ()] if given else redactions(text)
            for e in todo:
                tree.edit(*e)
            rows.append((pieces, tokens, len(todo), tree.totals[1], tree.totals[2], tree.encoded))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "n_pretokens", "n_tokens", "n_edits", "n_pretokens_after", "n_tokens_after", "n_reencoded"])


def count_tokens(docs: DataFrame, edits: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Counts before and after edits (doc_id, seq, pos, del, ins); without ``edits``, after masking mail addresses and numbers."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if edits is not None:
        own = edits.groupBy(F.col("doc_id").alias("__id")).agg(F.sort_array(F.collect_list(F.struct("seq", "pos", F.col("del").alias("del"), "ins"))).alias("edits"))
        rows = rows.join(own, F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", "edits")
    return rows.mapInArrow(partial(_recount, path=vocabulary, given=edits is not None), "doc_id long, n_pretokens long, n_tokens long, n_edits long, n_pretokens_after long, n_tokens_after long, n_reencoded long")
