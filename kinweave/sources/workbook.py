"""Workbooks as displayed: cells become the text that their number formats show. A workbook is bounded in size and read by one task,
its parts as streams of elements."""

from __future__ import annotations

import io
import math
import re
import zipfile
from collections.abc import Iterator
from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Decimal
from xml.etree import ElementTree

import pandas as pd

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

# The formats that a workbook names by number alone.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm",
    37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)",
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss.0", 48: "##0.0E+0", 49: "@",
}
# Names of months and days in formats.
_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

_token = re.compile(r'"[^"]*"|\\.|_.|\*.|\[[^\]]*\]|AM/PM|A/P|General|[Yy]+|[Mm]+|[Dd]+|[Hh]+|[Ss]+(?:\.0+)?|E[+-]|[0#?.,%@/]|.', re.IGNORECASE | re.DOTALL)


def _sections(code: str) -> list[list[str]]:
    """A format's sections as tokens."""
    out: list[list[str]] = [[]]
    for t in _token.findall(code):
        if t == ";":
            out.append([])
        else:
            out[-1].append(t)
    return out


def _literal(t: str) -> str | None:
    """The text of a token that stands for itself; None for one that shows a value."""
    if t[0] == '"':
        return t[1:-1]
    if t[0] == "\\":
        return t[1:]
    if t[0] == "_":
        return " "
    if t[0] == "*":
        return ""
    if t[0] == "[":
        return None if re.fullmatch(r"\[[hms]+\]", t, re.IGNORECASE) else re.sub(r"^\[\$([^\]-]*).*\]$", r"\1", t) if t.startswith("[$") else ""
    return None


def _is_date(tokens: list[str]) -> bool:
    return any(_literal(t) is None and (t[0] in "yYdDhHsS" or t[0] in "mM" or t[0] == "[") for t in tokens)


def _general(x: float) -> str:
    if x == int(x) and abs(x) < 1e11:
        return str(int(x))
    if 1e-9 <= abs(x) < 1e11:
        whole = len(str(int(abs(x))))
        return f"{x:.{max(0, 10 - whole)}f}".rstrip("0").rstrip(".")
    head, _, power = f"{x:.5E}".partition("E")
    return f"{head.rstrip('0').rstrip('.')}E{power}"


def day_of(serial: int, epoch_1904: bool) -> tuple[int, int, int, int]:
    """Year, month, day and week day of a serial number. The 1900 system counts a 29 February that 1900 did not have."""
    if epoch_1904:
        d = date(1904, 1, 1) + timedelta(serial)
    elif serial == 60:
        return 1900, 2, 29, 2
    else:
        d = date(1899, 12, 31) + timedelta(serial) - timedelta(serial > 60)
        if serial == 0:
            return 1900, 1, 0, 5
    return d.year, d.month, d.day, d.weekday()


def _date(x: float, tokens: list[str], epoch_1904: bool) -> str:
    shown = [t for t in tokens if t[0] in "sS" and _literal(t) is None]
    places = max([len(t.partition(".")[2]) for t in shown], default=0)
    units = 86_400 * 10**places
    # Rounded to what is shown: to seconds, or their fractions.
    ticks = math.floor(x * units + 0.5)
    days, rest = divmod(ticks, units)
    try:
        year, month, day, week = day_of(days, epoch_1904)
    except (OverflowError, ValueError):
        return "#" * 8
    seconds, fraction = divmod(rest, 10**places)
    hour, minute, second = seconds // 3600, seconds // 60 % 60, seconds % 60
    half = any(t.upper() in ("AM/PM", "A/P") for t in tokens)
    out, last = [], ""
    for k, t in enumerate(tokens):
        text, low = _literal(t), t.lower()
        if text is not None:
            out.append(text)
            continue
        following = next((u.lower() for u in tokens[k + 1 :] if _literal(u) is None and u[0].lower() in "ymdhs["), "")
        if low[0] == "y":
            out.append(f"{year:04d}" if len(t) > 2 else f"{year % 100:02d}")
        elif low[0] == "m" and (last in ("h", "[") or following.startswith("s")):
            out.append(f"{minute:0{min(len(t), 2)}d}")
        elif low[0] == "m":
            name = _MONTHS[month - 1]
            out.append({1: str(month), 2: f"{month:02d}", 3: name[:3], 5: name[0]}.get(len(t), name))
        elif low[0] == "d":
            out.append({1: str(day), 2: f"{day:02d}", 3: _DAYS[week][:3]}.get(len(t), _DAYS[week]))
        elif low[0] == "h":
            out.append(f"{(hour % 12 or 12) if half else hour:0{min(len(t), 2)}d}")
        elif low[0] == "s":
            out.append(f"{second:0{len(t.partition('.')[0][:2])}d}" + (f".{fraction:0{places}d}" if "." in t else ""))
        elif low[0] == "[":
            total = {"h": days * 24 + hour, "m": (days * 24 + hour) * 60 + minute, "s": days * 86_400 + seconds}[low[1]]
            out.append(f"{total:0{len(t) - 2}d}")
        elif low in ("am/pm", "a/p"):
            out.append(("PM" if hour >= 12 else "AM") if len(t) == 5 else ("P" if hour >= 12 else "A"))
        else:
            out.append(t)
        if low[0] in "ymdhs[":
            last = low[0]
    return "".join(out)


def _number(x: float, tokens: list[str], signed: bool) -> str:
    """x by a section of digits; signed: show a minus sign."""
    plain = [t for t in tokens if _literal(t) is None]
    if any(t.lower() == "general" for t in plain):
        shown = _general(abs(x))
        return ("-" if signed and x < 0 else "") + "".join(shown if _literal(t) is None else _literal(t) for t in tokens)
    if not any(t in "0#?" for t in plain):
        return "".join(x_ for x_ in (_literal(t) if _literal(t) is not None else t for t in tokens))
    value = abs(Decimal(repr(float(x)))) * 100 ** plain.count("%")
    digits = [k for k, t in enumerate(tokens) if t in ("0", "#", "?")]
    point = next((k for k, t in enumerate(tokens) if t == "."), None)
    power = next((k for k, t in enumerate(tokens) if t.upper() in ("E+", "E-")), None)
    before = [k for k in digits if (point is None or k < point) and (power is None or k < power)]
    after = [k for k in digits if point is not None and k > point and (power is None or k < power)]
    # Commas after the last digit divide by a thousand each; others group.
    end = max([*before, *after], default=-1)
    scale = sum(t == "," for t in tokens[end + 1 : power])
    group = any(t == "," for t in tokens[: before[-1] if before else 0])
    value = value / 1000**scale
    exponent = 0
    if power is not None and value:
        step = max(1, len(before))
        exponent = math.floor(value.log10() + Decimal("1e-12"))
        exponent -= exponent % step if step > 1 else 0
        value = value / Decimal(10) ** exponent
    value = value.quantize(Decimal(1).scaleb(-len(after)), ROUND_HALF_UP)
    whole, _, fraction = f"{value:f}".partition(".")
    least = sum(tokens[k] == "0" for k in before)
    whole = whole.lstrip("0").rjust(least, "0") if before else whole
    if group:
        whole = f"{int(whole or 0):,}".rjust(least, "0") if whole else whole
    kept = len(after)
    while kept and tokens[after[kept - 1]] == "#" and fraction[kept - 1] == "0":
        kept -= 1
    out = []
    for k, t in enumerate(tokens):
        text = _literal(t)
        if text is not None:
            out.append(text)
        elif before and k == before[0] or not before and k == point:
            out.append(whole + ("." + fraction[:kept] if kept else "." if point is not None and after and all(tokens[a] != "#" for a in after) else ""))
        elif t.upper() in ("E+", "E-"):
            places = sum(1 for j in digits if j > k)
            out.append("E" + ("-" if exponent < 0 else "+" if t.endswith("+") else "") + f"{abs(exponent):0{places}d}")
        elif t in ("0", "#", "?", ".", ","):
            continue
        else:
            out.append(t)
    return ("-" if signed and x < 0 and any(c != "0" for c in whole + fraction) else "") + "".join(out)


def shown(x: float, code: str, epoch_1904: bool = False) -> str:
    """A number as its format shows it. Fractions are shown as plain numbers."""
    sections = _sections(code)
    numbers = sections[:3]
    pick = 0 if x > 0 or len(numbers) == 1 or x == 0 and len(numbers) == 2 else 1 if x < 0 else 2
    tokens = numbers[pick]
    if _is_date(tokens):
        return "#" * 8 if x < 0 else _date(x, tokens, epoch_1904)
    if "/" in tokens and any(t == "?" for t in tokens):
        return _general(x)
    if any(t == "@" for t in tokens):
        return "".join(_general(x) if t == "@" else _literal(t) or "" for t in tokens)
    return _number(x, tokens, signed=pick == 0).strip() if tokens else ""


def _elements(book: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a part, one after another; what has been read is let go."""
    if name not in book.namelist():
        return
    with book.open(name) as part:
        for _, element in ElementTree.iterparse(part):
            if element.tag == f"{_MAIN}{tag}":
                yield element
                element.clear()


def _text(element: ElementTree.Element) -> str:
    """A string's text without its phonetic hints."""
    return "".join(t.text or "" for child in element for t in ([child] if child.tag == f"{_MAIN}t" else child.iter(f"{_MAIN}t") if child.tag == f"{_MAIN}r" else []))


class Workbook:
    """Sheets of a workbook as rows of displayed texts."""

    def __init__(self, content: bytes):
        self.book = zipfile.ZipFile(io.BytesIO(content))
        root = ElementTree.fromstring(self.book.read("xl/workbook.xml"))
        settings = root.find(f"{_MAIN}workbookPr")
        self.epoch_1904 = settings is not None and settings.get("date1904") in ("1", "true")
        targets = {}
        if "xl/_rels/workbook.xml.rels" in self.book.namelist():
            targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.book.read("xl/_rels/workbook.xml.rels"))}
        self.sheets = {}
        for k, s in enumerate(root.iter(f"{_MAIN}sheet")):
            target = targets.get(s.get(f"{_REL}id"), f"worksheets/sheet{k + 1}.xml")
            self.sheets[s.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        self.strings = [_text(s) for s in _elements(self.book, "xl/sharedStrings.xml", "si")]
        own, self.formats = {}, []
        if "xl/styles.xml" in self.book.namelist():
            styles = ElementTree.fromstring(self.book.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode") for f in styles.iter(f"{_MAIN}numFmt")}
            cells = styles.find(f"{_MAIN}cellXfs")
            self.formats = [own.get(n, BUILT_IN.get(n, "General")) for n in (int(x.get("numFmtId", "0")) for x in (cells if cells is not None else []))]

    def _cell(self, c: ElementTree.Element) -> str:
        kind, value = c.get("t", "n"), c.findtext(f"{_MAIN}v")
        if kind == "inlineStr":
            inner = c.find(f"{_MAIN}is")
            return _text(inner) if inner is not None else ""
        if value is None:
            return ""
        if kind == "s":
            return self.strings[int(value)]
        if kind == "b":
            return "TRUE" if value.strip() == "1" else "FALSE"
        if kind != "n":
            return value
        style = int(c.get("s", "0"))
        try:
            return shown(float(value), self.formats[style] if style < len(self.formats) else "General", self.epoch_1904)
        except ValueError:
            return value

    def rows(self, sheet: str) -> Iterator[list[str]]:
        """All rows from the first; those that the sheet leaves out are empty."""
        at = 0
        for row in _elements(self.book, self.sheets[sheet], "row"):
            number = int(row.get("r", at + 1))
            yield from ([] for _ in range(number - at - 1))
            at, cells, here = number, {}, 0
            for c in row.iter(f"{_MAIN}c"):
                if letters := re.match("[A-Z]+", c.get("r", "")):
                    here = 0
                    for letter in letters[0]:
                        here = 26 * here + ord(letter) - 64
                else:
                    here += 1
                cells[here - 1] = self._cell(c)
            yield [cells.get(k, "") for k in range(max(cells, default=-1) + 1)]


def rows(frames: Iterator[pd.DataFrame], sheet: str | int | None) -> Iterator[pd.DataFrame]:
    """number, cells of the named or numbered sheet, else of the first that has a header row. ValueError names the sheets there are."""
    from .tabular import HEADER_ROWS, header_at  # it reads workbooks through this module

    for frame in frames:
        for content in frame["content"]:
            book = Workbook(content)
            names = list(book.sheets)
            if isinstance(sheet, str) and sheet not in names and sheet.strip().isdigit():
                sheet = int(sheet)
            if isinstance(sheet, str) and sheet not in names or isinstance(sheet, int) and not 1 <= sheet <= len(names):
                raise ValueError(f"no sheet {sheet}; there are {', '.join(names)}")
            for name in [sheet] if isinstance(sheet, str) else [names[sheet - 1]] if sheet else names:
                grid = list(book.rows(name))
                try:
                    header_at(grid[:HEADER_ROWS])
                except ValueError:
                    continue
                yield pd.DataFrame({"number": range(len(grid)), "cells": grid})
                break
            else:
                raise ValueError(f"no header row found in {', '.join(names)}")
