"""Boundaries of pre-tokens in whole texts, by code point classes and a scan of transition functions.

The pattern is that of the public byte-level vocabularies: contractions ('s 't 'm 'd 're 've
'll), an optional space with a run of letters, of numbers or of other signs, and runs of blanks,
of which the last goes to what follows. Read from left to right it is an automaton with eight
states. Every code point is a function from states to states; composing functions is associative,
so a text is cut into equal stretches whose functions are composed side by side, a scan over the
stretches gives the state in which each begins, and a second pass marks the boundaries. Looking
ahead is needed for two things only, the last blank of a run and the letters of a contraction,
and both are settled beforehand by comparing shifted arrays.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

LETTER, NUMBER, OTHER, GLUE, LAST, BLANK, EDGE, MARK1, MARK2, NONE = range(10)
SYMBOLS = 10
#: Inside nothing, letters, numbers, other signs, blanks, behind a glued space, one or two letters before the end of a contraction.
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, GLUED, ONE_LEFT, TWO_LEFT = range(8)
#: Code points per stretch of the scan.
STRETCH = 512

#: White_Space of Unicode, the space itself left out.
BLANKS = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters and numbers that Unicode 16.0 added to the 15.1 of Python's own table.
LATER_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
LATER_NUMBERS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point: LETTER, NUMBER, OTHER, GLUE (the space) or LAST (other blanks)."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for ranges, kind in ((LATER_LETTERS, LETTER), (LATER_NUMBERS, NUMBER)):
        for first, last in ranges:
            table[first : last + 1] = kind
    table[BLANKS] = LAST
    table[0x20] = GLUE
    return table


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a pre-token begins at the symbol."""
    if symbol == NONE:
        return state, False
    if symbol == EDGE:
        return CLOSED, True
    if state in (ONE_LEFT, TWO_LEFT):
        return (CLOSED if state == ONE_LEFT else ONE_LEFT), False
    sign = symbol in (OTHER, MARK1, MARK2)
    if state == GLUED:
        return (IN_OTHERS if sign else IN_LETTERS if symbol == LETTER else IN_NUMBERS), False
    if sign and state == IN_OTHERS:
        return IN_OTHERS, False
    after = {
        LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, GLUE: GLUED, LAST: CLOSED, BLANK: IN_BLANKS,
        MARK1: ONE_LEFT, MARK2: TWO_LEFT,
    }[symbol]
    return after, not (after == state and after in (IN_LETTERS, IN_NUMBERS, IN_BLANKS))


class Automaton:
    """Tables of the automaton and of its finite set of transition functions."""

    def __init__(self) -> None:
        steps = [[_step(state, symbol) for symbol in range(SYMBOLS)] for state in range(8)]
        #: Next state times SYMBOLS, so that adding a symbol indexes the tables.
        self.next = np.array([[s * SYMBOLS for s, _ in row] for row in steps], np.intp).ravel()
        self.begins = np.array([[b for _, b in row] for row in steps], bool).ravel()
        single = [tuple(steps[state][symbol][0] for state in range(8)) for symbol in range(SYMBOLS)]
        number = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(8)), *single]))}
        known = list(number)
        for f in known:  # grows while it is read: closure under one more symbol
            for g in single:
                both = tuple(g[s] for s in f)
                if both not in number:
                    number[both] = len(known)
                    known.append(both)
        self.functions = np.array(known, np.intp)
        self.count = len(known)
        self.append = np.array([[number[tuple(g[s] for s in f)] * SYMBOLS for g in single] for f in known], np.intp).ravel()
        self.compose = np.array([[number[tuple(g[s] for s in f)] for g in known] for f in known], np.intp).ravel()

    def starts(self, symbols: np.ndarray) -> np.ndarray:
        """True where a pre-token begins; the state before the first symbol is CLOSED."""
        n = symbols.size
        rows = max(1, -(-n // STRETCH))
        width = -(-n // rows) if n else 1
        padded = np.full(rows * width, NONE, np.uint8)
        padded[:n] = symbols
        grid = np.ascontiguousarray(padded.reshape(rows, width).T)
        whole = np.zeros(rows, np.intp)
        for column in grid:
            whole = self.append[whole + column]
        before = self._exclusive(whole // SYMBOLS)
        state = self.functions[before, CLOSED] * SYMBOLS
        marks = np.empty(grid.shape, bool)
        for k, column in enumerate(grid):
            at = state + column
            marks[k] = self.begins[at]
            state = self.next[at]
        return np.ascontiguousarray(marks.T).ravel()[:n]

    def _exclusive(self, functions: np.ndarray) -> np.ndarray:
        """Composition of all functions before each place, by doubling distances."""
        done = functions.copy()
        gap = 1
        while gap < done.size:
            done[gap:] = self.compose[done[:-gap] * self.count + done[gap:]]
            gap *= 2
        return np.concatenate([np.zeros(1, np.intp), done[:-1]])


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    return Automaton()


def _symbols(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Symbols of the automaton; `edges` are the places of the one code point behind each text."""
    symbols = classes()[points]
    symbols[edges] = EDGE
    blank = (symbols == GLUE) | (symbols == LAST)
    ends = blank | (symbols == EDGE)
    symbols[:-1][blank[:-1] & ends[1:]] = BLANK
    marks = np.flatnonzero(points == ord("'"))
    if marks.size:
        first, second = points[marks + 1], points[np.minimum(marks + 2, points.size - 1)]
        symbols[marks[np.isin(first, [ord(c) for c in "stmd"])]] = MARK1
        two = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
        symbols[marks[two]] = MARK2
    return symbols


def cut(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 of all texts end to end, first and last byte of every pre-token, and per text its number of pre-tokens."""
    data = "".join(texts).encode("utf-8")
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    edges = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    symbols = _symbols(points, edges)
    at = np.flatnonzero(automaton().starts(symbols))
    if len(data) + len(texts) == points.size:
        gone = np.cumsum(symbols[at] == EDGE) - (symbols[at] == EDGE)
        offsets = at - gone
    else:
        size = np.ones(points.size, np.int64)
        for least in (0x80, 0x800, 0x10000):
            size += points >= least
        size[edges] = 0
        offsets = (np.cumsum(size) - size)[at]
    real = symbols[at] != EDGE
    ends = np.append(offsets[1:], len(data))
    per_text = np.diff(np.searchsorted(at[real], edges), prepend=0)
    return data, offsets[real], ends[real], per_text
