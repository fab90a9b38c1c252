"""Text that was decoded with the wrong character encoding: find it, and undo it where possible.

The words of a text (between plain spaces and line ends, which no wrong decoding adds or
takes away) are states of a graph; an edge undoes one wrong reading: encode with the
encoding that the text was read in, decode with the one it truly is in.  References and
\\uXXXX escapes are resolved first.  A best-first search with visited states looks for
words that cost less: a word's cost is how implausible it is in the corpus
(llm.plausible).  No number of steps or states is capped: what a path has paid already
bounds what it can still gain.

What a path of readings gains is added up over neighbouring words, each word once, and the
stretch with the largest gain is garbled when that exceeds the price of the path: the
prior odds that a stretch was read wrongly, in that way of all.  So a text that was
misread as a whole is told by all its words, and one strange name alone needs a reading
that makes it far more plausible.

Garbled words must not pass for normal because they are frequent.  The model is made
twice: first without words that show a wrong reading by their bytes alone, then without
words that the first model finds garbled in most texts that have them.  Copies of a text
count once.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache, partial
from heapq import heappop, heappush
from itertools import repeat
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.plausible import ROW, Model, Tally, kind
from lakewarden.sources.tables import cut

SCHEMA = "doc_id bigint, words int, restored_words int, complete boolean, restored string"

# Encodings that texts are wrongly read in, and encodings that they may truly be in, besides UTF-8.
READ_AS = (
    "cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1255", "mac-roman", "cp437", "cp850", "cp852", "cp866", "koi8-r", "iso8859-2", "iso8859-15",
    "gbk", "cp932", "cp949", "big5",
)
TRULY = (
    "cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1255", "cp1256", "mac-roman", "cp437", "cp850", "cp852", "cp866", "koi8-r", "iso8859-2",
    "gbk", "cp932", "cp949", "big5",
)
MANY_BYTES = frozenset(("gbk", "cp932", "cp949", "big5"))

#: Prior odds that a stretch was read wrongly: 1 in so many texts, to which is added what the first model found of each reading.
TEXTS = 100
#: Odds that a stretch which was read wrongly was so once more.
AGAIN = 0.1
#: Cost of a character outside of ASCII that a reading of UTF-8 leaves: one of its bytes must have been lost, as happens to one in a hundred.
LOST = log(100)
#: Findings about words that a task remembers, some hundred bytes each.
REMEMBERED = 1_000_000

# Half of what is read wrongly is taken to be UTF-8, the other half any of the rest; of each half, all readings are as likely.
_WAYS = {"utf-8": 2 * len(READ_AS), "other": 2 * len(READ_AS) * (len(TRULY) - 1)}

_SPACE = re.compile(r"([ \t\r\n]+)")
_ESCAPE = re.compile(r"&(?:[A-Za-z]{2,8}|#\d{2,7}|#x[0-9A-Fa-f]{2,6});|(?:\\u[0-9A-Fa-f]{4})+")
_DEAD = re.compile("[\x80-\x84\x86-\x9f�]")
_UTF8 = re.compile(
    rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)

Step = tuple[str, str]
Path = tuple[Step, ...]


@cache
def _table(name: str) -> dict[str, bytes]:
    """Each character that a single-byte encoding reads a byte from 128 as; bytes without one stand for the control of the same number."""
    out = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        out[c] = bytes([b])
    return out


@cache
def _letters(name: str) -> dict[int, str]:
    return {b[0]: c for c, b in _table(name).items()}


@cache
def _byte(c: str, name: str) -> bytes | None:
    if c < "\x80":
        return c.encode()
    if name not in MANY_BYTES:
        return _table(name).get(c)
    try:
        return c.encode(name)
    except UnicodeEncodeError:
        return None


@cache
def _hint(name: str) -> re.Pattern:
    """What a word must hold to have UTF-8 that was read as ``name``: a lead byte's character before a following byte's."""
    if name in MANY_BYTES:
        return re.compile("[\u0370-\uffff]")
    letters = _letters(name)
    return re.compile("[{}][{}]".format(*(re.escape("".join(letters[b] for b in span)) for span in (range(0xC2, 0xF5), range(0x80, 0xC0)))))


def _decoded(raw: bytes, name: str) -> str | None:
    if name in MANY_BYTES:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            return None
    table = _letters(name)
    return "".join([chr(b) if b < 128 else table[b] for b in raw])


def _from_utf8(word: str, name: str) -> tuple[str, int] | None:
    """What from_utf8() gives, and how many characters outside of ASCII stayed as they are."""
    if not _hint(name).search(word):
        return None
    parts = [_byte(c, name) or b"\xff" for c in word]
    raw = b"".join(parts)
    if not _UTF8.search(raw):
        return None
    # Where each character's bytes begin; a match that ends inside of a character is cut before it.
    starts = {}
    at = 0
    for i, p in enumerate(parts):
        starts[at] = i
        at += len(p)
    starts[at] = len(word)
    out, last, kept = [], 0, sum(c > "\x7f" for c in word)
    for m in _UTF8.finditer(raw):
        a, b = m.span()
        while a < b and a not in starts:
            a += 1
        while b > a and b not in starts:
            b -= 1
        try:
            text = raw[a:b].decode("utf-8")
        except UnicodeDecodeError:
            continue
        if text:
            out += [word[last : starts[a]], text]
            kept -= sum(c > "\x7f" for c in word[starts[a] : starts[b]])
            last = starts[b]
    return ("".join([*out, word[last:]]), kept) if out else None


def from_utf8(word: str, name: str) -> str | None:
    """``word`` with every stretch that is UTF-8 read as ``name`` decoded; None if there is none.

    What can't be undone stays as it is, so a word with a lost byte is still restored in part.
    """
    found = _from_utf8(word, name)
    return found and found[0]


def undo(word: str, step: Step) -> tuple[str, float] | None:
    """``word`` with the reading of ``step`` (truly in, read as) undone, and what bytes that must have been lost make that cost; None where it can't be or changes nothing."""
    true, read = step
    if true == "utf-8":
        found = _from_utf8(word, read)
        return found and (found[0], found[1] * LOST)
    parts = [_byte(c, read) for c in word]
    if None in parts:
        return None
    out = _decoded(b"".join(parts), true)
    return None if out is None or out == word else (out, 0.0)


def _one(m: re.Match) -> str:
    text = m[0]
    if text[0] == "&":
        out = html.unescape(text)
    else:
        out = bytes.fromhex(text.replace("\\u", "")).decode("utf-16-be", "surrogatepass")
    return text if any("\ud800" <= c <= "\udfff" for c in out) else out


def unescape(word: str) -> str:
    """``word`` with character references and \\uXXXX resolved, repeated escapes too; half a pair stays as it is."""
    while _ESCAPE.search(word):
        out = _ESCAPE.sub(_one, word)
        if out == word:
            break
        word = out
    return word


def by_bytes(word: str) -> bool:
    """Whether all of a word outside of ASCII is UTF-8 read in a single-byte encoding, or it holds what only failed decoding leaves.

    Plain words of scripts other than Latin are no such words: in their encodings, letters are bytes
    that follow one another as those of UTF-8 do by chance.
    """
    if _DEAD.search(word):
        return True
    bare = word.strip("".join(c for c in word if not c.isalpha()))
    if bare.isalpha() and (bare[1:].islower() or bare.isupper()) and not any(kind(c) in ("LATIN", "ascii") for c in bare):
        return False
    outside = sum(c > "\x7f" for c in word)
    for name in READ_AS:
        if name not in MANY_BYTES and _hint(name).search(word):
            raw = b"".join([_byte(c, name) or b"\xff" for c in word])
            if sum(len(m) for m in _UTF8.findall(raw)) == outside:
                return True
    return False


def steps(word: str) -> Iterator[tuple[Step, str, float]]:
    """What undoing one reading leads to.  Readings that come from the same bytes lead to the same words, but differ in other words."""
    done: dict[bytes, list[tuple[str, str]]] = {}
    for read in READ_AS:
        found = _from_utf8(word, read)
        if found is not None:
            yield ("utf-8", read), found[0], found[1] * LOST
        parts = [_byte(c, read) for c in word]
        if None in parts:
            continue
        raw = b"".join(parts)
        if raw not in done:
            made = [(true, _decoded(raw, true)) for true in TRULY]
            done[raw] = [(true, out) for true, out in made if out is not None and out != word]
        for true, out in done[raw]:
            if true != read:
                yield (true, read), out, 0.0


def ways(step: Step) -> int:
    """Among how many readings of its half a step is one."""
    return _WAYS["utf-8" if step[0] == "utf-8" else "other"]


@cache
def further(path: Path) -> float:
    """-log of the odds of steps that follow others."""
    return sum(log(ways(step) / AGAIN) for step in path)


def price(path: Path, model: Model) -> float:
    """-log of the prior odds of a path: how often its first step was found, and one text in TEXTS spread over all readings."""
    odds = (model.found.get(path[0], 0) + 1 / ways(path[0])) / (model.texts + TEXTS)
    return further(path[1:]) - log(odds)


def search(word: str, model: Model) -> dict[Path, tuple[float, str]]:
    """The paths that lead to a cheaper word: what each gains before its price, and the word.

    Readings of UTF-8 may follow one another; another reading can only be the last to be undone,
    as what it gave was then saved as UTF-8 or not at all.  Such steps make a word shorter, so the
    graph has an end.
    """
    start = model.cost(word)
    found: dict[Path, tuple[float, str]] = {}
    heap: list[tuple[float, int, str, float, Path]] = [(start, 0, word, 0.0, ())]
    costs = {word: start}
    while heap:
        _, _, at, lost, path = heappop(heap)
        # A path that has paid as much as there is to gain leads to nothing; the first step's price is the stretch's.
        if further(path[1:]) + lost >= start:
            continue
        for step, there, more in steps(at):
            way = (*path, step)
            # A further step has to make up for its own price; where only words together do, they are judged again after this path.
            most = costs[at] - further((step,)) if path else start
            cost = costs.get(there)
            if cost is None and most <= 0.0 and step[0] != "utf-8":
                continue
            if cost is None:
                cost = model.cost(there, start if step[0] == "utf-8" else most)
                if step[0] == "utf-8":
                    costs[there] = cost
                    heappush(heap, (cost + lost + more + price(way, model), len(costs), there, lost + more, way))
                elif not path:
                    costs[there] = cost
            if cost < most and cost + lost + more < start:
                found[way] = (start - cost - lost - more, there)
    return found


def follow(word: str, path: Path) -> tuple[str, float] | None:
    """The word at the end of a path, and what lost bytes cost on it; None where the path can't be gone."""
    lost = 0.0
    for step in path:
        found = undo(word, step)
        if found is None:
            return None
        word, more = found
        lost += more
    return word, lost


class Judge:
    """Finds the garbled words of texts; remembers what it found out about words."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, dict[Path, float]] = {}
        self.paths: dict[Path, Path] = {}
        self.costs: dict[tuple[str, Path], float] = {}
        self.best: dict[str, float] = {}
        self.held = 0
        self.prices: dict[Path, float] = {}
        self.least = min(price((step,), model) for step in [*model.found, ("utf-8", READ_AS[0])])
        #: The readings that were undone in the last text.
        self.undone: set[Step] = set()

    def _remember(self, n: int) -> None:
        self.held += n
        if self.held > REMEMBERED:
            self.known.clear()
            self.costs.clear()
            self.best.clear()
            self.paths.clear()
            self.held = n

    def options(self, word: str) -> dict[Path, float]:
        """The paths that lead from a word to a cheaper one, and what each gains."""
        out = self.known.get(word)
        if out is None:
            out = {self.paths.setdefault(path, path): gain for path, (gain, _) in search(word, self.model).items()}
            self._remember(len(out) + len(word) // 100 + 1)
            self.known[word] = out
        return out

    def most(self, word: str) -> float:
        """The most that any path gains on a word."""
        out = self.best.get(word)
        if out is None:
            out = self.best[word] = max(self.options(word).values(), default=0.0)
        return out

    def gain(self, word: str, path: Path) -> float:
        """What a path gains on a word; negative where the word would be worse, 0 where nothing changes."""
        out = self.options(word).get(path)
        if out is None:
            out = self.costs.get((word, path))
        if out is None:
            there = follow(word, path)
            out = 0.0 if there is None or there[0] == word else self.model.cost(word) - self.model.cost(there[0]) - there[1]
            self._remember(1)
            self.costs[word, path] = out
        return out

    def words(self, words: list[str]) -> dict[int, str]:
        """The places of garbled words in a text's words (those outside of ASCII, in order), and what each should be."""
        self.undone = set()
        base = [unescape(w) for w in words]
        out = {i: w for i, w in enumerate(base) if _DEAD.search(w)}
        open_: dict[str, list[int]] = {}
        for i, w in enumerate(base):
            if not w.isascii():
                open_.setdefault(w, []).append(i)
        # Words, in the order of their first places.
        while open_:
            # What all words could gain together, each by its own best path, bounds what a stretch can.
            if sum(map(self.most, open_)) <= self.least:
                break
            most: dict[Path, float] = {}
            for w in open_:
                for path, gain in self.options(w).items():
                    most[path] = most.get(path, 0.0) + gain
            best, best_gain, stretch = None, 0.0, (0, 0)
            for path, upper in most.items():
                cost = self.prices.get(path)
                if cost is None:
                    cost = self.prices[path] = price(path, self.model)
                if upper - cost <= best_gain:
                    continue
                # The stretch of words with the largest sum; a word that comes again tells nothing new.
                run, begin = 0.0, 0
                for w, places in open_.items():
                    if run <= 0:
                        run, begin = 0.0, places[0]
                    run += self.gain(w, path)
                    if run - cost > best_gain:
                        best, best_gain, stretch = path, run - cost, (begin, places[0])
            if best is None:
                break
            self.undone.add(best[0])
            for w in list(open_):
                if stretch[0] <= open_[w][0] <= stretch[1] and self.gain(w, best) > 0:
                    # What is left may have been read wrongly in another way.
                    (there, _), places = follow(w, best), open_.pop(w)
                    out |= dict.fromkeys(places, there)
                    if not there.isascii():
                        open_[there] = sorted([*open_.get(there, []), *places])
            open_ = dict(sorted(open_.items(), key=lambda x: x[1][0]))
        return out


def judge(word: str, model: Model) -> tuple[bool, str]:
    """Whether a word that stands alone is garbled, and what it should be (itself where that can't be told)."""
    found = Judge(model).words([word])
    return bool(found), found.get(0, word)


def _suspect(text: str) -> tuple[list[str], list[int], list[str]]:
    """The parts of a text, the places of words that can be garbled, and those words."""
    parts = _SPACE.split(text)
    places = [i for i in range(0, len(parts), 2) if not parts[i].isascii() or "&" in parts[i] or "\\u" in parts[i]]
    return parts, places, [parts[i] for i in places]


def _counted(texts: DataFrame, plain: bool = True) -> np.ndarray:
    """The table of the words in ``texts`` (words ARRAY<STRING>) or, without ``plain``, of words with their number (word, n).

    Counts are made where the words lie and added up by place: at most 2 * ROW places come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        fine: dict[str, bool] = {}
        for batch in batches:
            words = batch.column(0).flatten().to_pylist() if plain else batch.column(0).to_pylist()
            for word, n in zip(words, repeat(1) if plain else batch.column(1).to_pylist(), strict=False):
                ok = fine.get(word)
                if ok is None:
                    if len(fine) > 200_000:
                        fine.clear()
                    ok = fine[word] = not by_bytes(word)
                if ok:
                    tally.add(word, n)
        places, counts = tally.rows()
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(counts, pa.int64())], ["place", "n"])

    made = texts.mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(2 * ROW, dtype=np.int64)
    table[made.column("place").to_numpy()] = made.column("n").to_numpy()
    return table


def train(documents: DataFrame) -> Model:
    """The model of a corpus, from all its documents; texts with the same words outside of ASCII in the same order count once."""
    split = F.split("text", r"[ \t\r\n]+")
    texts = documents.select(F.filter(split, lambda w: w.rlike(r"[^\x00-\x7F]")).alias("words")).where(F.size("words") > 0)
    texts = cut(texts.distinct())
    sent = documents.sparkSession.sparkContext.broadcast(Model(_counted(texts)))  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(sent.value)
        for batch in batches:
            # Texts, and those with each wrong reading, are counted under words that there can't be.
            found: dict[str, list[int]] = {"": [0, 0]}
            for words in batch.column(0).to_pylist():
                bad = judge.words(words)
                for i, w in enumerate(words):
                    have = found.setdefault(w, [0, 0])
                    have[0] += 1
                    have[1] += i in bad
                found[""][0] += 1
                for true, read in judge.undone:
                    found.setdefault(f"{true} {read}", [0, 0])[1] += 1
            n, bad = zip(*found.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(n, pa.int64()), pa.array(bad, pa.int64())], ["word", "n", "bad"])

    judged = cut(texts.mapInArrow(run, "word string, n bigint, bad bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    # One row per reading at most, and one for the texts.
    told = {r.word: r for r in judged.where("word = '' or contains(word, ' ')").collect()}
    found = {tuple(w.split(" ")): r.bad for w, r in told.items() if w}
    words = judged.where((F.col("bad") * 2 <= F.col("n")) & (F.col("word") != "") & ~F.contains("word", F.lit(" "))).select("word", "n")
    return Model(_counted(words, plain=False), told[""].n if "" in told else 0, found)


def repair(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents in which a word was decoded wrongly, once or more often.

    Columns: doc_id, words (how many are garbled), restored_words (how many of them changed to
    something cheaper), complete (no trace of failed decoding is left), restored (the text with
    them undone).  Documents with a null id or text, or only ASCII without escapes, give no row.
    """
    model = model or train(documents)
    sent = documents.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    asked = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x00-\x7F]|&(#\d|#x|[A-Za-z])[0-9A-Za-z]+;|\\u[0-9A-Fa-f]{4}"))
    return asked.mapInArrow(partial(_repaired, sent), SCHEMA)


def _repaired(sent: object, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    judge = Judge(sent.value)
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parts, places, words = _suspect(text)
            bad = judge.words(words)
            if bad:
                fixed = sum(words[i] != there for i, there in bad.items())
                for i, there in bad.items():
                    parts[places[i]] = there
                restored = "".join(parts)
                rows.append((doc_id, len(bad), fixed, not _DEAD.search(restored), restored))
        columns = list(zip(*rows, strict=True)) or [(), (), (), (), ()]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "words", "restored_words", "complete", "restored"])
