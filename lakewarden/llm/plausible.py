"""How plausible a word is in a corpus: a character model of fixed size.

Each character has a probability given the two before it, backed off to one, then to the
class (script or category) of the characters; letter case has a model of its own.  Counts
stand in a table of two hashed rows (the smaller count of the two is taken), so the model
is as large for any corpus, and every word of the corpus counts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from functools import cache
from math import inf, log

import numpy as np
from xxhash import xxh3_64_intdigest

#: Counts in each of the two rows of the table: 2 x 2**19 x 8 bytes = 8 MB, whatever the corpus.
ROW = 1 << 19
#: Share of words that come from languages and names the corpus doesn't know.
FOREIGN = 0.01
#: Remembered costs, at most.
REMEMBERED = 500_000

#: Scripts with thousands of signs: as context, one sign is as good as another.
_LARGE = {"CJK", "HANGUL", "HIRAGANA", "KATAKANA", "YI", "HALFWIDTH"}


@cache
def kind(c: str) -> str:
    """The script of a letter (Latin letters outside of ASCII apart), else the category."""
    if c in "\x02\x03":
        return c
    category = unicodedata.category(c)
    if c < "\x80":
        return "ascii" if c.isalpha() else "digit" if c.isdigit() else category
    if category[0] == "L":
        return unicodedata.name(c, "?").split()[0].split("-")[0]
    return category


@cache
def _sizes() -> Counter:
    return Counter(kind(chr(i)) for i in range(4, 0x20000))


@cache
def _context(c: str) -> str:
    return kind(c) if kind(c) in _LARGE else c


@cache
def _low(c: str) -> str:
    low = c.lower()
    return low if len(low) == 1 else c


@cache
def _case(c: str) -> str:
    return "u" if c.isupper() else "l" if c.islower() else "o" if c.isalpha() else "d" if c.isdigit() else c if c in "\x02\x03" else "s"


def _places(gram: str) -> tuple[int, int]:
    h = xxh3_64_intdigest(gram)
    return h % ROW, ROW + (h >> 32) % ROW


def _grams(word: str) -> Iterable[str]:
    low, marks = f"\x02\x02{''.join(map(_low, word))}\x03", f"\x02\x02{''.join(map(_case, word))}\x03"
    seen = [_context(c) for c in low]
    kinds = [kind(c) for c in low]
    for i in range(2, len(low)):
        c, x, y = low[i], seen[i - 2], seen[i - 1]
        k, m, n = kinds[i - 2], kinds[i - 1], kinds[i]
        yield from (f"3{x} {y} {c}", f"2{x} {y}", f"B{y} {c}", f"b{y}", f"1{c}", f"k{n}", f"K{k} {m} {n}", f"L{k} {m}", f"M{m} {n}", f"m{m}", "n")
    for i in range(2, len(marks)):
        yield "C" + marks[i - 2 : i + 1]
        yield "c" + marks[i - 2 : i]


# Signs that may stand between and after letters, and those that open: before letters only.
_BETWEEN = "\xa0’‘‑–—…”»·׳״・、。，！？）」』"
_OPENING = "«“„‚¿¡（「『"
_TOKEN = re.compile(rf"((?:(?![\d_])\w[\u0300-\u036f]*)+)|([0-9]+)|([{_OPENING}]+)|([!-/:-@\[-`{{-~{_BETWEEN}]+)|(.)", re.S)
# Controls, private and unassigned characters.
_NO_TEXT = frozenset(("Cc", "Co", "Cn", "Cs"))
#: What one of these costs besides.
_NEVER = 30.0
# What a letter or sign costs in a language that is not known: one of so many.
_OF_MANY = {"ascii": log(32), "LATIN": log(1500), "CJK": log(4000), "HANGUL": log(2000)}
_OTHER, _SIGN, _PUNCTUATION, _DIGIT, _HIDDEN, _HUMP, _CHANGE, _SCRIPT = log(64), log(2000), log(20), log(10), log(200), log(1000), log(10), log(30)


def _letter(c: str) -> float:
    return _SIGN if kind(c) == "Mn" else _OF_MANY.get(kind(c), _OTHER)


def foreign(word: str) -> float:
    """What a word costs as one of an unknown language: letters of one script in natural case, or signs, each as likely as the other; one that is repeated is likelier.

    Infinite where letters and signs are mixed as in no language, and for what is no text.
    """
    kinds_of = {kind(c) for c in word}
    if kinds_of & _NO_TEXT:
        return inf
    total, letters = -log(FOREIGN), False
    bare = "".join([c for c in word if kind(c) != "Cf"]) if "Cf" in kinds_of else word
    for m in _TOKEN.finditer(bare):
        part, group = m[0], m.lastindex
        if group == 1:
            humps = sum(a.islower() and b.isupper() for a, b in zip(part, part[1:], strict=False))
            kinds = {kind(c) for c in part} - {"Mn"}
            mixed = len(kinds - {"ascii"}) > 1 or ("ascii" in kinds and not kinds <= {"ascii", "LATIN"})
            # Lower, upper or title case; or two of these in a row, as in McDonald.
            at = next((i + 1 for i, (a, b) in enumerate(zip(part, part[1:], strict=False)) if a.islower() and b.isupper()), 0)
            if humps > 1 or not all(x[1:] == x[1:].lower() or x == x.upper() for x in (part[:at], part[at:])):
                return inf
            if mixed and not kinds <= {"CJK", "HIRAGANA", "KATAKANA", "HALFWIDTH", "KATAKANA-HIRAGANA"}:
                return inf
            total += humps * _HUMP + (0.0 if kinds <= {"ascii", "LATIN"} else _SCRIPT) + sum(_letter(c) if c != before else _DIGIT for before, c in zip("\0" + part, part, strict=False))
            if mixed:
                total += sum(kind(a) != kind(b) for a, b in zip(part, part[1:], strict=False)) * _CHANGE
        elif letters and group in (3, 5):
            return inf
        elif group == 5 and unicodedata.category(part)[0] == "M":
            return inf
        elif group == 5:
            after = bare[m.end() : m.end() + 1]
            if after > "\x7f" and after.isalpha():
                return inf
            # Line drawings stay in one block; a sign of another one is a change.
            before = bare[m.start() - 1] if m.start() else ""
            rare = (_SCRIPT if part > "\u27bf" else 0.0) + (_CHANGE if before > "\x7f" and ord(before) >> 7 != ord(part) >> 7 else 0.0)
            total += _DIGIT if part == before else _SIGN + rare
        else:
            total += len(part) * (_DIGIT if group == 2 else _PUNCTUATION if part.isascii() else _SIGN)
        letters = group == 1 or (letters and group == 2)
    return total + (len(word) - len(bare)) * _HIDDEN


_AGAIN = re.compile(r"(.)\1{3,}", re.S)


class Tally:
    """Counts of words on their way into the table."""

    def __init__(self):
        self.table = np.zeros(2 * ROW, dtype=np.int64)
        self.words: Counter[str] = Counter()
        self.held = 0

    def add(self, word: str, n: int = 1) -> None:
        if word not in self.words:
            self.held += len(word)
        self.words[word] += n
        if self.held > 2_000_000:
            self.flush()

    def flush(self) -> None:
        at: Counter[str] = Counter()
        for word, n in self.words.items():
            for gram in _grams(word):
                at[gram] += n
        for gram, n in at.items():
            a, b = _places(gram)
            self.table[a] += n
            self.table[b] += n
        self.words.clear()
        self.held = 0

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """The places that aren't empty, and their counts."""
        self.flush()
        places = np.flatnonzero(self.table)
        return places, self.table[places]


class Model:
    """Costs in nats: -log of the probability of a word."""

    def __init__(self, table: np.ndarray, texts: int = 0, found: dict[tuple[str, str], int] | None = None):
        self.table = np.ascontiguousarray(table, dtype=np.int64)
        #: Texts that were looked at before, and in how many of them each wrong reading was found.
        self.texts, self.found = texts, found or {}
        self._at = memoryview(self.table)
        self._costs: dict[str, float] = {}

    def __reduce__(self) -> tuple:
        return Model, (self.table, self.texts, self.found)

    def count(self, gram: str) -> int:
        a, b = _places(gram)
        return min(self._at[a], self._at[b])

    def _char(self, three: str) -> float:
        """What the last of three characters costs after the first two."""
        count = self.count
        a, b, c = map(_low, three)
        x, y = _context(a), _context(b)
        k, m, n = kind(a), kind(b), kind(c)
        there = count(f"k{n}")
        p = (there + 1) / (count("n") + 64)
        p = (count(f"M{m} {n}") + p) / (count(f"m{m}") + 1)
        p = (count(f"K{k} {m} {n}") + p) / (count(f"L{k} {m}") + 1)
        p *= (count(f"1{c}") + 1) / (there + max(1, _sizes()[n]))
        p = (count(f"B{y} {c}") + p) / (count(f"b{y}") + 1)
        p = (count(f"3{x} {y} {c}") + p) / (count(f"2{x} {y}") + 1)
        marks = "".join(map(_case, three))
        case = (count("C" + marks) + 0.1) / (count("c" + marks[:2]) + 0.6)
        return -log(p) - log(case) + (_NEVER if n in _NO_TEXT else 0.0)

    def cost(self, word: str, most: float = inf) -> float:
        """How implausible ``word`` is, as one of the corpus or of an unknown language; ``most`` where it is more."""
        # A character that comes again and again tells nothing more.
        word = _AGAIN.sub(r"\1\1\1", word)
        known, total, text = self._costs, 0.0, f"\x02\x02{word}\x03"
        for i in range(len(text) - 2):
            three = text[i : i + 3]
            cost = known.get(three)
            if cost is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                cost = known[three] = self._char(three)
            total += cost
            if total > most:
                total = most
                break
        # No character costs less than a digit in an unknown language.
        return min(total, foreign(word)) if len(word) * _DIGIT - log(FOREIGN) < total else total
