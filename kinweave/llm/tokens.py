"""Exact token ids of many texts at the speed of a dictionary look-up.

The pre-tokens of ``word_bpe_49k`` never influence each other and white space only
separates them, so the ids of a text are the ids of its pieces between white
space and marks, one after another. Texts of plain characters are cut by Arrow, each distinct piece of a batch is
looked up once, and pieces unknown so far go through the tokenizers library. Any other
text goes through the library whole. Both ways give the ids of ``Tokenizer.encode``.
"""

from __future__ import annotations

import gc
import os
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that one Python worker remembers; those that come later are encoded each time.
CACHE_PIECES = 500_000
#: Characters of text handled at a time, so that memory is bounded for any batch.
SLICE_CHARS = 2_000_000

#: Characters whose lower case, composition and class are the same in every library:
#: white space, printable ASCII and Latin letters up to U+024F, except U+0130.
_PLAIN = "\t\n\r" + "".join(map(chr, [*range(0x20, 0x7F), *range(0xA1, 0x130), *range(0x131, 0x250), 0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x2026, 0x20AC]))
_plain = re.compile(f"[{re.escape(_PLAIN)}]*")


def _of(kind: str) -> str:
    return re.escape("".join(c for c in _PLAIN if unicodedata.category(c)[0] == kind))


#: The pre-token rule of word_bpe_49k over the plain characters in lower case.
_word_rule = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_of('L')}]+|[{_of('N')}]|[^\s{_of('L')}{_of('N')}]+")

#: Runs of marks that are tokens by themselves; a lone apostrophe may belong to a contraction and stays.
_runs = r"[^\s\pL\pN'][^\s\pL\pN]*|'[^\s\pL\pN]+"


def slices(texts: Sequence[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts with at most ``limit`` characters, one text at least."""
    first = size = 0
    for k, text in enumerate(texts):
        if k > first and size + len(text) > limit:
            yield first, k
            first, size = k, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def expand(codes: np.ndarray, lists: Sequence[bytes], dtype=np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """All lists[code], packed numbers, one after another, and where each code's list ends."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists)) // np.dtype(dtype).itemsize
    flat = np.frombuffer(b"".join(lists), dtype)
    begins = np.cumsum(sizes) - sizes
    each = sizes[codes]
    ends = np.cumsum(each)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[codes] - (ends - each), each)
    return flat[at], ends


def split_words(texts: Sequence[str] | pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Codes of all white-space pieces, the distinct pieces, and each text's bounds among the codes."""
    lists = pc.utf8_split_whitespace(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), lists.offsets.to_numpy()


class Encoder:
    """``ids(texts)`` has what ``Tokenizer.encode(text, add_special_tokens=False).ids`` gives for each text; null counts as empty."""

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.cuts = name == "word_bpe_49k.json"
        self.pieces: dict[str, bytes] = {}
        gc.freeze()

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_pieces(self, distinct: list[str]) -> list[bytes]:
        found = [*map(self.pieces.get, distinct)]
        unknown = [k for k, ids in enumerate(found) if ids is None]
        cut = [_word_rule.findall(distinct[k]) for k in unknown]
        ids = iter(self._library([*chain.from_iterable(cut)]))
        for k, words in zip(unknown, cut, strict=True):
            found[k] = np.array([*chain.from_iterable(next(ids) for _ in words)], np.uint32).tobytes()
        room = max(0, CACHE_PIECES - len(self.pieces))
        self.pieces.update((distinct[k], found[k]) for k in unknown[:room])
        return found

    def _slice(self, texts: Sequence[str]) -> list[np.ndarray]:
        plain = [bool(self.cuts and "<|" not in t and _plain.fullmatch(t)) for t in texts]
        lower = pa.array([t.lower() if p else "" for t, p in zip(texts, plain, strict=True)], pa.large_string())
        codes, distinct, bounds = split_words(pc.replace_substring_regex(lower, _runs, r" \0 "))
        flat, ends = expand(codes, self._of_pieces(distinct))
        ends = np.concatenate([[0], ends])[bounds]
        other = iter(self._library([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [flat[ends[k] : ends[k + 1]] if p else np.asarray(next(other), np.uint32) for k, p in enumerate(plain)]

    def ids(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        texts = [t or "" for t in texts]
        for a, b in slices(texts):
            yield from self._slice(texts[a:b])


@lru_cache(maxsize=4)
def encoder(name: str) -> Encoder:
    """One encoder a Python worker."""
    return Encoder(name)
