"""Terms of whole texts, counted on UTF-8 bytes: ASCII characters of a set and all others beyond ASCII, A to Z lower-cased."""

from __future__ import annotations

import re
from collections import Counter

#: Bytes of a text that are cut into terms at once.
SLICE = 4_000_000


class Terms:
    """Counts the maximal runs of the ASCII letters and, if asked for, digits, and of everything beyond ASCII."""

    def __init__(self, digits: bool):
        held = rb"0-9A-Za-z\x80-\xff" if digits else rb"A-Za-z\x80-\xff"
        self.term, self.gap = re.compile(rb"[" + held + rb"]+"), re.compile(rb"[^" + held + rb"]")

    def counted(self, text: bytes | None, size: int = SLICE) -> Counter[bytes]:
        """Null and empty texts have no terms. A long text is read a slice at a time, each ending where no term does."""
        text = text or b""
        if len(text) <= size:
            return Counter(self.term.findall(text.lower()))
        out, at = Counter(), 0
        while at < len(text):
            cut = self.gap.search(text, at + size)
            end = cut.start() if cut else len(text)
            out.update(self.term.findall(text[at:end].lower()))
            at = end
        return out
