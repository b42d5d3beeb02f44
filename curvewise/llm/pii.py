r"""Personal data, with disguises undone and spans given in the source text.

Base spans are plain pattern matches. A second search runs on a normalised text, in which
homoglyphs and other scripts' digits are Latin, invisible characters are gone, spelled digits
are digits, and spelled or bracketed `at` and `dot` are signs. Each rewriting step keeps, for
every character it writes, the source characters it came from, so a match maps back exactly.
A match there becomes an added span if something was rewritten in it and no base span of its
kind covers it. An added address must end in letters. A bare word "at" counts only before a domain whose dots are spelled too, so
that prose like "look at example.com" is left alone.

Defined cases: a null or empty text has no spans. Any length of text is searched whole, in time
linear in its length. Rows are judged each for itself, so repeated rows and ids do not matter.
An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvewise.llm.words import text_slices

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){15,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other scripts that look Latin, signs that look like ASCII ones,
# and names of digits.
_LOOKALIKES = {
    "АВЕКМНОРСТХІЈЅ": "ABEKMHOPCTXIJS",
    "аеорсухіјѕԁһӏ": "aeopcyxijsdhl",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "οαιν": "oaiv",
    "‐‑‒–—−": "------",
    "․。｡": "...",
    "    　": "     ",
}
_INVISIBLE = "­​‌‍⁠﻿"
_DIGIT_WORDS = dict(zip("zero one two three four five six seven eight nine oh".split(), "01234567890", strict=True))


def _char_map() -> dict[int, str]:
    table = {ord(a): b for source, target in _LOOKALIKES.items() for a, b in zip(source, target, strict=True)}
    table |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    for c in range(0x80, 0x20000):
        digit = unicodedata.decimal(chr(c), None)
        if digit is not None:
            table[c] = str(digit)
    return table


_CHARS = _char_map()
_ODD = frozenset(map(chr, _CHARS)) | frozenset(_INVISIBLE)
_ODD_RUN = re.compile("[" + _INVISIBLE + "]")
_WORD = "(?:" + "|".join(_DIGIT_WORDS) + ")"
_SPELLED = re.compile(rf"(?<![A-Za-z])(?:(plus[ -]+)?({_WORD}(?:[ -]+{_WORD})+)|((?<= dot ){_WORD}|{_WORD}(?= dot (?:[0-9]|{_WORD}))))(?![A-Za-z])", re.IGNORECASE)
_ONE_WORD = re.compile(_WORD, re.IGNORECASE)
_OPEN, _SHUT = r"[\[({<]", r"[\])}>]"
_DOT_SIGN = rf" ?{_OPEN} ?(?:dot|\.) ?{_SHUT} ?|&#46;"
_DOT = rf"(?:{_DOT_SIGN}| dot )"
_SIGN = re.compile(
    rf"(?P<at> ?{_OPEN} ?(?:at|@) ?{_SHUT} ?|&#64;|%40(?=[A-Za-z0-9-]+\.)| at (?=[A-Za-z0-9-]+{_DOT}[A-Za-z0-9]))"
    rf"|(?P<dot>{_DOT_SIGN}|(?<=[A-Za-z0-9]) dot (?=[A-Za-z0-9]))",
    re.IGNORECASE,
)
_BRACKETED = re.compile(rf"{_OPEN} ?(?:at|dot|\.|@) ?{_SHUT}")
_TOP_LEVEL = re.compile(r"\.[A-Za-z]{2,}$")
_TWO_DOTS = re.compile(r"\.[0-9]++\.[0-9]")


def _has_odd(text: str) -> bool:
    """Whether a character is in the map or invisible; Latin-1 texts can hold two of them only."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _ODD.isdisjoint(text)
    return "\u00a0" in text or "\u00ad" in text


def _has_signs(low: str) -> bool:
    return (
        " dot " in low or "&#" in low or "%40" in low
        or (any(c in low for c in "[({<") and _BRACKETED.search(low) is not None)
    )


def _has_words(low: str) -> bool:
    """Whether a digit's name stands between blanks or hyphens, as it does in any run of three."""
    low = low.replace("-", " ")
    return any(f" {w} " in low for w in _DIGIT_WORDS)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each `@`: the local part is the run before it, as far as
    the last match. Matching the local part first would take quadratic time in long runs."""
    out, after, at = [], 0, text.find("@")
    while at >= 0:
        found = _DOMAIN.match(text, at)
        start = at
        if found:
            while start > after and text[start - 1] in _LOCAL:
                start -= 1
        if found and start < at:
            after = found.end()
            out.append((start, after))
            at = text.find("@", after)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *span) for span in emails(text)]
    for m in _IP.finditer(text) if _TWO_DOTS.search(text) else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


class Tracked:
    """A rewritten text and, for each of its characters, the source characters it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1
        self.new = np.zeros(len(text), bool)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Put each string for the characters from start to before end; edits in order."""
        parts, starts, ends, news, at = [], [], [], [], 0
        for a, b, put in edits:
            parts += [self.text[at:a], put]
            starts += [self.start[at:a], np.full(len(put), self.start[a])]
            ends += [self.end[at:a], np.full(len(put), self.end[b - 1])]
            news += [self.new[at:a], np.ones(len(put), bool)]
            at = b
        self.text = "".join(parts) + self.text[at:]
        self.start = np.concatenate([*starts, self.start[at:]])
        self.end = np.concatenate([*ends, self.end[at:]])
        self.new = np.concatenate([*news, self.new[at:]])


def _undisguised(text: str) -> Tracked | None:
    """The normalised text, or None if nothing looks disguised."""
    low = text.lower()
    odd, signs = _has_odd(text), _has_signs(low)
    words = _has_words(low) or (odd and _has_words(low.translate(_CHARS)))
    if not (odd or signs or words):
        return None
    held = Tracked(text)
    if odd:
        plain = text.translate(_CHARS)
        held.new = np.fromiter((ord(c) in _CHARS for c in text), bool, len(text))
        held.text = plain
        held.rewrite([(*m.span(), "") for m in _ODD_RUN.finditer(plain)])
    spelled = []
    for m in _SPELLED.finditer(held.text) if words else ():
        digits = "".join(_DIGIT_WORDS[w.lower()] for w in _ONE_WORD.findall(m[2] or m[3]))
        spelled.append((*m.span(), ("+" if m[1] else "") + digits))
    if spelled:
        held.rewrite(spelled)
    marks = [(*m.span(), "@" if m["at"] else ".") for m in _SIGN.finditer(held.text)] if signs or odd else []
    if marks:
        held.rewrite(marks)
    return held if odd or spelled or marks else None


def spans_of(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by kind, start, end; end exclusive, in code points."""
    if not text:
        return []
    base = base_spans(text)
    out = [(*s, True) for s in base]
    held = _undisguised(text)
    if held is not None:
        for kind, a, b in base_spans(held.text):
            start, end = int(held.start[a]), int(held.end[b - 1])
            rewritten = held.new[a:b].any() or end - start != b - a
            inside = any(k == kind and s <= start and end <= e for k, s, e in base)
            named = kind != "email" or _TOP_LEVEL.search(held.text[a:b])
            if rewritten and named and not inside:
                out.append((kind, start, end, False))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2], not s[3]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def _span_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in text_slices(batches, "text"):
        found = [
            [{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in spans_of(t)] for t in piece.column("text").to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(found, _SPANS)], names=["doc_id", "spans"])


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id and spans, an array of (kind, start, end, base). No shuffle."""
    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(
        _span_batches, f"doc_id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
    )
