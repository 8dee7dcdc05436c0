"""Merge-type piece encoding by backtracking, equal to the sentencepiece library's, and decoding.

A sequence of vocabulary pieces is the merge result of its text exactly if every two
neighbours are: if re-merging their joined text gives those two again. So encoding takes
the longest piece at each place (found for all places by one Aho-Corasick pass), checks it
against the piece before, tries shorter ones where they don't fit, and steps back where
none does; a bitfield remembers places from which no encoding leads on. No piece of the
vocabulary goes on after a character with a space mark or line feed, so texts are cut
there, and each distinct cut of a batch is encoded once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import base
from .tokens import CACHE_PIECES, expand, slices

MARK = "▁"
#: Longest cut whose ids are remembered.
CACHE_CHARS = 200
_cuts = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


class Pieces:
    def __init__(self, name: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        count = model.get_piece_size()
        self.text = [model.id_to_piece(k) for k in range(count)]
        special = [model.is_control(k) or model.is_unknown(k) or model.is_unused(k) for k in range(count)]
        is_byte = [model.is_byte(k) for k in range(count)]
        self.id = {t: k for k, t in enumerate(self.text) if not special[k] and not is_byte[k]}
        self.score = {t: model.get_score(k) for t, k in self.id.items()}
        self.byte = {int(self.text[k][3:5], 16): k for k in range(count) if is_byte[k]}
        self.raw = [b"" if special[k] else bytes([int(t[3:5], 16)]) if is_byte[k] else t.replace(MARK, " ").encode() for k, t in enumerate(self.text)]
        self.search = ahocorasick.Automaton()
        for t in self.id:
            self.search.add_word(t, t)
        self.search.make_automaton()
        #: No piece goes on from a letter to a mark, so a cut there is safe too.
        self.marks_apart = not any(a.isalpha() and not b.isalnum() and b != MARK for t in self.id for a, b in zip(t, t[1:], strict=False))
        runs = {t for t in self.id if t == MARK * len(t)}
        self.runs = {len(t) for t in runs}
        merges = [x for t, x in self.score.items() if len(t) > 1 and t not in runs]
        run_scores = {self.score[t] for t in runs if len(t) > 1}
        if any(MARK in t[1:] for t in self.id if t not in runs) or len(run_scores) > 1 or run_scores and merges and max(run_scores) >= min(merges):
            raise ValueError(f"{name}: runs of space marks don't merge last and among themselves")
        self.fits: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {"": b""}

    def merged(self, text: str) -> list[str]:
        """The definition: of all neighbours whose joined text is a piece, the best score merges first, the leftmost at a tie."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        fits = self.fits.get((a, b))
        if fits is None:
            fits = self.merged(a + b) == [a, b]
            if len(self.fits) < CACHE_PIECES:
                self.fits[a, b] = fits
        return fits

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a text all of whose characters are pieces."""
        at: list[list[str]] = [[] for _ in text]  # pieces that begin here, short ones first
        for end, piece in self.search.iter(text):
            at[end - len(piece) + 1].append(piece)
        failed, taken, place = bytearray(len(text) + 1), [], 0
        rank = len(at[0]) - 1
        ranks: list[int] = []
        while place < len(text):
            while rank >= 0:
                piece = at[place][rank]
                if not failed[place + len(piece)] and (not taken or self.compatible(taken[-1], piece)):
                    break
                rank -= 1
            if rank >= 0:
                taken.append(piece)
                ranks.append(rank)
                place += len(piece)
                rank = len(at[place]) - 1 if place < len(text) else -1
            elif taken:
                failed[place] = 1
                place -= len(taken.pop())
                rank = ranks.pop() - 1
            else:
                raise ValueError(f"no encoding of {text!r}")
        return taken

    def spaced(self, text: str) -> list[str]:
        """Pieces of a text that may begin with many space marks.

        Runs of marks merge last, all with one score: the last mark goes with the letters behind it where these take it, and
        the others join from the left, each as soon as it makes a piece with what stands before it.
        """
        marks = len(text) - len(text.lstrip(MARK))
        if marks < 2:
            return self.backtrack(text)
        rest = self.backtrack(text[marks - 1 :])
        alone = rest[0] == MARK
        run: list[int] = []
        for _ in range(marks - 1 + alone):
            run.append(1)
            while len(run) > 1 and run[-2] + run[-1] in self.runs:
                run[-2:] = [run[-2] + run[-1]]
        return [MARK * n for n in run] + rest[alone:]

    def _ids(self, cut: str) -> list[int]:
        """ids of a cut: characters that are no pieces stand alone, as their bytes."""
        out: list[int] = []
        for known, run in groupby(cut, self.id.__contains__):
            out += map(self.id.__getitem__, self.spaced("".join(run))) if known else [self.byte[b] for b in "".join(run).encode()]
        return out

    def ids_of_cut(self, cut: str) -> bytes:
        ids = self.known.get(cut)
        if ids is None:
            ids = np.array(self._ids(cut), np.uint32).tobytes()
            if len(self.known) < CACHE_PIECES and len(cut) <= CACHE_CHARS:
                self.known[cut] = ids
        return ids

    def encode(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        texts = [t or "" for t in texts]
        for a, b in slices(texts):
            yield from self._slice(texts[a:b])

    def _slice(self, texts: Sequence[str]) -> list[np.ndarray]:
        cut = []
        for t in texts:
            if not t:
                cut.append("")
            elif "  " in t or t[0] == " " or MARK in t or "\0" in t:
                cut.append(None)
            else:
                cut.append(f"{MARK}{t}".replace(" ", f"\0{MARK}").replace("\n", "\0\n\0"))
        joined = pa.array([c or "" for c in cut], pa.large_string())
        if self.marks_apart:
            joined = pc.replace_substring_regex(joined, f"(\\pL)([^\\pL\\pN{MARK}\\x00])", "\\1\0\\2")
        lists = pc.split_pattern(joined, "\0")
        coded = lists.flatten().dictionary_encode()
        flat, ends = expand(coded.indices.to_numpy(), [*map(self.ids_of_cut, coded.dictionary.to_pylist())])
        ends = np.concatenate([[0], ends])[lists.offsets.to_numpy()]
        return [
            flat[ends[k] : ends[k + 1]] if c is not None else np.frombuffer(b"".join(map(self.ids_of_cut, _cuts.findall(MARK + t.replace(" ", MARK)))), np.uint32)
            for k, (c, t) in enumerate(zip(cut, texts, strict=True))
        ]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: pieces and bytes joined, marks as spaces, without the one that encoding put in front."""
        whole = b"".join(map(self.raw.__getitem__, ids))
        return (whole[1:] if whole[:1] == b" " else whole).decode(errors="replace")


@lru_cache(maxsize=2)
def pieces(name: str) -> Pieces:
    """One a Python worker."""
    return Pieces(name)


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", full: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text (null: empty, which has no ids), and with
    ``full`` also ids and decoded. Rows with equal or null doc_id stay rows of their own."""
    base.short_batches(docs.sparkSession)

    def encoded(batches):
        coder = pieces(model)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text").to_pylist()), strict=True):
                ids = ids.tolist()
                text = coder.decode(ids)
                rows.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), *([ids, text] if full else [])))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.string()][: 6 if full else 4]
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names[: len(kinds)])

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    return base.only(docs, "doc_id", "text").mapInArrow(encoded, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * full)
