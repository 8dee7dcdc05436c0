"""Token counts that follow edits: a segment tree over pre-tokens for each document.

Leaves are blocks of neighbouring pre-tokens with their characters and token counts; inner
nodes hold sums. An edit finds its block by descending the tree, starts again at a
pre-token boundary a few characters before the edit, and stops at the first old boundary
after it: the rule only looks ahead, so all beyond is as before. Only touched leaves and
their ancestors change. Trees are kept as a table, with the text and the sums of each leaf:
edits read it, and give it back with the leaves that they changed.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .tokens import CACHE_PIECES

#: Characters before an edit whose pre-tokens may change with it: the longest contraction.
BACK = 3
#: Pre-tokens in a leaf when a tree is built.
LEAF = 64


class Counter:
    """Tokens of a pre-token, remembered."""

    def __init__(self, name: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(name), "rb"))}
        self.rule = regex.compile(public_tokenizers.PATTERN)
        self.coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            n = len(self.coder.encode_ordinary(word))
            if len(self.known) < CACHE_PIECES:
                self.known[word] = n
        return n


@lru_cache(maxsize=2)
def counter(name: str) -> Counter:
    return Counter(name)


class Tree:
    """Leaves from ``width`` on, inner nodes below. chars and tokens: a binary tree each in an array. A leaf's pre-tokens are cut out of
    its stored text only where an edit touches it."""

    def __init__(self, text: str, coder: Counter):
        self.coder, self.encoded = coder, 0
        self._build(coder.rule.findall(text))

    @classmethod
    def stored(cls, leaves: list[dict], coder: Counter) -> Tree:
        """The tree of stored leaves: sums are taken from them, nothing is encoded."""
        tree = cls.__new__(cls)
        tree.coder, tree.encoded = coder, 0
        tree.kept = [(x["text"], np.frombuffer(x["cuts"], "<u4")) for x in leaves] or [("", np.zeros(0, "<u4"))]
        tree.blocks = [None] * len(tree.kept)
        tree._sum([len(t) for t, _ in tree.kept], [x["tokens"] for x in leaves] or [0])
        return tree

    def leaves(self) -> list[dict]:
        """What ``stored`` takes."""
        return [{"text": t, "cuts": c.tobytes(), "tokens": self.tokens[self.width + k]} for k, (t, c) in ((k, self._kept(k)) for k in range(len(self.blocks)))]

    def _kept(self, k: int) -> tuple[str, np.ndarray]:
        return self.kept[k] if self.blocks[k] is None else ("".join(self.blocks[k]), np.array([len(w) for w in self.blocks[k]], "<u4"))

    def block(self, k: int) -> list[str]:
        """The pre-tokens of a leaf."""
        if self.blocks[k] is None:
            text, cuts = self.kept[k]
            ends = np.cumsum(cuts).tolist()
            self.blocks[k] = [text[i:j] for i, j in zip([0, *ends], ends, strict=False)]
        return self.blocks[k]

    @property
    def pretokens(self) -> int:
        return sum(len(self.kept[k][1]) if b is None else len(b) for k, b in enumerate(self.blocks))

    def _build(self, words: list[str]) -> None:
        self.blocks = [words[k : k + LEAF] for k in range(0, len(words), LEAF)] or [[]]
        self.kept = [None] * len(self.blocks)
        sums = [self._sums(b) for b in self.blocks]
        self._sum([c for c, _ in sums], [t for _, t in sums])

    def _sum(self, chars: list[int], tokens: list[int]) -> None:
        self.width = 1 << (len(chars) - 1).bit_length()
        rest = [0] * (self.width - len(chars))
        self.chars, self.tokens = [0] * self.width + chars + rest, [0] * self.width + tokens + rest
        for k in range(self.width - 1, 0, -1):
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    def _sums(self, block: list[str]) -> tuple[int, int]:
        return sum(map(len, block)), sum(map(self.coder.count, block))

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _leaf(self, place: int) -> tuple[int, int]:
        """The leaf that holds character ``place``, and the characters before that leaf."""
        k, before = 1, 0
        while k < self.width:
            k *= 2
            if place >= before + self.chars[k]:
                before += self.chars[k]
                k += 1
        return min(k - self.width, len(self.blocks) - 1), before

    def _set(self, leaf: int, block: list[str]) -> None:
        self.blocks[leaf] = block
        k = leaf + self.width
        self.chars[k], self.tokens[k] = self._sums(block)
        while k := k // 2:
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    def edit(self, at: int, removed: int, inserted: str) -> None:
        """Replaces ``removed`` characters from ``at`` by ``inserted``; both are cut to the text."""
        at = max(0, min(at, self.chars[1]))
        removed = max(0, min(removed, self.chars[1] - at))
        first, before = self._leaf(max(0, at - BACK))
        keep, place = 0, before
        while keep < len(self.block(first)) and place + len(self.block(first)[keep]) <= at - BACK:
            place += len(self.block(first)[keep])
            keep += 1
        # Old text from the boundary on, as many leaves as it takes until old and new boundaries meet.
        last, old = first, self.block(first)[keep:]
        while last + 1 < len(self.blocks) and place + sum(map(len, old)) < at + removed:
            last += 1
            old = old + self.block(last)
        while True:
            ends_here = last + 1 >= len(self.blocks)
            ahead = "" if ends_here else "".join(self.block(last + 1))
            text = "".join(old)
            new_text = text[: at - place] + inserted + text[at - place + removed :]
            scanned = self.coder.rule.findall(new_text + ahead)
            shift = len(inserted) - removed
            bounds, end = {}, 0
            for k, w in enumerate(old):
                bounds[end] = k
                end += len(w)
            bounds[end] = len(old)
            fresh, end = [], 0
            stop = None
            for w in scanned:
                if end >= at - place + len(inserted) and end <= len(new_text) and (end - shift) in bounds and end - shift >= at - place + removed:
                    stop = bounds[end - shift]
                    break
                fresh.append(w)
                end += len(w)
            else:
                if ends_here:
                    stop = len(old)
            if stop is not None:
                break
            last += 1
            old = old + self.block(last)
        self.encoded += len(fresh)
        self._set(first, self.block(first)[:keep] + fresh + old[stop:])
        for k in range(first + 1, last + 1):
            self._set(k, [])
        if len(self.blocks[first]) > 16 * LEAF:
            self._split(first)

    def _split(self, k: int) -> None:
        """Deals a leaf that has grown over several; the others keep their sums."""
        words, n = self.blocks[k], len(self.blocks)
        parts = [words[j : j + LEAF] for j in range(0, len(words), LEAF)]
        sums = [self._sums(b) for b in parts]
        chars, tokens = self.chars[self.width : self.width + n], self.tokens[self.width : self.width + n]
        self.blocks[k : k + 1], self.kept[k : k + 1] = parts, [None] * len(parts)
        self._sum([*chars[:k], *(c for c, _ in sums), *chars[k + 1 :]], [*tokens[:k], *(t for _, t in sums), *tokens[k + 1 :]])

    def text(self) -> str:
        return "".join(self._kept(k)[0] for k in range(len(self.blocks)))


#: A stored tree: each leaf's text, the characters of its pre-tokens (four bytes each), its tokens.
_LEAVES = "array<struct<text:string,cuts:binary,tokens:int>>"
_LEAF_TYPE = pa.list_(pa.struct([("text", pa.string()), ("cuts", pa.binary()), ("tokens", pa.int32())]))
_COUNTS = ("n_before", "n_tokens", "n_pretokens", "n_reencoded")


def plant(docs: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """docs (text and others) with ``leaves``, a segment tree of each whole text, in place of the text. A null text is empty."""
    base.short_batches(docs.sparkSession)

    def planted(batches):
        coder = counter(tokenizer)
        for batch in batches:
            trees = pa.array([Tree(t or "", coder).leaves() for t in batch.column("text").to_pylist()], _LEAF_TYPE)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), trees], names=[*rest, "leaves"])
        base.give_back()

    rest = [c for c in docs.columns if c not in ("text", "leaves")]
    kinds = dict(docs.dtypes)
    return docs.select(*rest, "text").mapInArrow(planted, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), f"leaves {_LEAVES}"]))


def edited(trees: DataFrame, keep: bool = True, tokenizer: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, n_before, n_tokens (after its edits), n_pretokens (before), n_reencoded pre-tokens, and with ``keep`` the leaves after the
    edits, to be stored in place of the old ones.

    trees: doc_id, leaves, edits array<struct<at int, removed int, inserted string>>, applied in that order. What no edit touches is
    neither cut nor encoded: its sums are those that are stored. Null edits are none; fields that are null are 0 or empty.
    """
    base.short_batches(trees.sparkSession)

    def applied(batches):
        coder = counter(tokenizer)
        for batch in batches:
            rows, leaves = [], []
            for doc, held, changes in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "leaves", "edits")), strict=True):
                tree = Tree.stored(held or [], coder)
                before, pretokens = tree.total, tree.pretokens
                for e in changes or []:
                    if e is not None:
                        tree.edit(e["at"] or 0, e["removed"] or 0, e["inserted"] or "")
                rows.append((doc, before, tree.total, pretokens, tree.encoded))
                if keep:
                    leaves.append(tree.leaves())
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(leaves, _LEAF_TYPE)] if keep else [])], names=names)
        base.give_back()

    names = ["doc_id", *_COUNTS, *(["leaves"] if keep else [])]
    return trees.select("doc_id", "leaves", "edits").mapInArrow(applied, ", ".join([*(f"{n} long" for n in ("doc_id", *_COUNTS)), *([f"leaves {_LEAVES}"] if keep else [])]))


def count(docs: DataFrame, edits: DataFrame | None = None, tokenizer: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, n_before, n_tokens, n_pretokens, n_reencoded, as ``edited`` gives them: each whole text's tree is planted and stored,
    then read and edited. edits: doc_id, edits, one row a document; or the column ``edits`` in docs."""
    if edits is not None:
        docs = base.only(docs, "doc_id", "text").join(edits.select("doc_id", "edits"), "doc_id", "left")
    return edited(base.settle(plant(docs.select("doc_id", "text", "edits"), tokenizer), "trees"), False, tokenizer)


def sample_edits(docs: DataFrame) -> DataFrame:
    """The edits of the registered query, for every document: a word goes in the middle, some characters are replaced
    at a place that its id fixes, the last third loses its first ten characters, and a line is put in front."""
    n = F.coalesce(F.char_length("text"), F.lit(0))

    def one(at, removed, inserted):
        return F.struct(at.cast("int").alias("at"), F.lit(removed).alias("removed"), F.lit(inserted).alias("inserted"))

    place = F.pmod(F.xxhash64("doc_id"), F.greatest(n, F.lit(1)))
    return base.only(docs, "doc_id", "text").withColumn("edits", F.array(one(n / 2, 0, " inserted"), one(place, 7, "'ll 42 "), one(2 * n / 3, 10, ""), one(F.lit(0), 0, "Title\n")))
