"""Evaluation texts that leak into a corpus: longest verbatim word matches and where they are.

Each shard of the corpus gets a suffix array over its words; every suffix of every test
item is looked up in it by binary search.  A match of at least ``min_words`` words shows
as a range of neighbouring suffixes, which are extended to their full length together.

Words that no item contains can't be part of a match, so a shard's array only covers
stretches of item words of at least ``min_words``: the array of a shard stays small however
long the documents are, and nothing that could match is left out.  Items are taken in
blocks of a bounded number of words, one pass over the corpus each, so neither the set of
items nor a shard has to fit into memory.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, item_id bigint, words int, doc_word int, item_word int"

_WORD = re.compile(r"[^\W_]+")
_HIDDEN = regex.compile("[\\p{Cf}\ufe00-\ufe0f\u034f]")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits in lower case, after characters without width are dropped."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFC", _HIDDEN.sub("", text))
    return _WORD.findall(text.lower())


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """The places of ``tokens`` in the order of their suffixes, as far as ``depth`` tokens tell them apart.

    Prefix doubling: ranks by the first 1, 2, 4, ... tokens.
    """
    n = len(tokens)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    k = 1
    while k < depth and rank.max() < n:
        after = np.zeros(n, dtype=np.int64)
        after[:-k] = rank[k:] if k < n else 0
        _, rank = np.unique(rank * (n + 2) + after, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        k *= 2
    return np.argsort(rank, kind="stable")


class Items:
    """A block of test items: their words as numbers, and every suffix long enough to match."""

    def __init__(self, items: list[tuple[int, list[str]]], min_words: int):
        self.vocabulary: dict[str, int] = {}
        self.min_words = min_words
        self.texts: list[tuple[int, bytes, int]] = []
        for item_id, own in items:
            if len(own) >= min_words:
                numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own], dtype=">u4")
                self.texts.append((item_id, numbers.tobytes(), len(own)))
        self.longest = max((n for _, _, n in self.texts), default=0)

    def stretches(self, own: list[str]) -> list[tuple[int, np.ndarray]]:
        """The stretches of item words in a document: first word and numbers of each."""
        known = np.fromiter((self.vocabulary.get(w, 0) for w in own), dtype=np.uint32, count=len(own))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (known > 0).astype(np.int8), [0]))))
        return [(int(a), known[a:b]) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= self.min_words]

    def search(self, shard: list[tuple[int, int, np.ndarray]]) -> Iterator[tuple]:
        """doc_id, item_id, words, doc_word, item_word: the longest match of each item in each document of a shard.

        ``shard``: doc_id, first word and numbers of each stretch.  Of the places where a suffix of an
        item is found, those that a longer match to the left covers are dropped, and the rest
        grow together, a word at a time.
        """
        if not shard:
            return
        lengths = np.array([len(x) + 1 for _, _, x in shard])
        starts = np.concatenate(([0], np.cumsum(lengths)))
        flat = np.zeros(starts[-1], dtype=">u4")
        for (_, _, x), at in zip(shard, starts, strict=False):
            flat[at : at + len(x)] = x
        text = flat.tobytes()
        flat = flat.astype(np.int64)
        places_in_order = suffix_array(flat, self.longest)
        order = places_in_order.tolist()
        doc_of = np.array([doc_id for doc_id, _, _ in shard], dtype=np.int64)
        first_of = np.array([first for _, first, _ in shard], dtype=np.int64)
        head = 4 * self.min_words

        def key(at: int) -> bytes:
            return text[4 * at : 4 * at + head]

        for item_id, item, n in self.texts:
            own = np.frombuffer(item, dtype=">u4").astype(np.int64)
            found: list[np.ndarray] = []
            for at in range(n - self.min_words + 1):
                wanted = item[4 * at : 4 * at + head]
                low = bisect_left(order, wanted, key=key)
                if low == len(order) or key(order[low]) != wanted:
                    continue
                places = places_in_order[low : bisect_right(order, wanted, lo=low, key=key)]
                if at:
                    # Before the first word of a shard stands the mark that ends its last stretch.
                    places = places[flat[places - 1] != own[at - 1]]
                length = np.full(len(places), self.min_words)
                growing, size = np.arange(len(places)), self.min_words
                while len(growing) and at + size < n:
                    growing = growing[flat[places[growing] + size] == own[at + size]]
                    size += 1
                    length[growing] = size
                found.append(np.stack([length, places, np.full(len(places), at)]))
            if not found:
                continue
            length, places, at = np.concatenate(found, axis=1)
            stretch = np.searchsorted(starts, places, side="right") - 1
            docs, doc_word = doc_of[stretch], first_of[stretch] + places - starts[stretch]
            best = np.lexsort((at, doc_word, -length, docs))
            best = best[np.concatenate(([True], docs[best][1:] != docs[best][:-1]))] if len(best) else best
            for i in best.tolist():
                yield int(docs[i]), item_id, int(length[i]), int(doc_word[i]), int(at[i])


def blocks(items: DataFrame, item_id: str, text: str, block_words: int, min_words: int) -> Iterator[Items]:
    """The items in blocks of about ``block_words`` words; rows come to the driver one partition at a time."""
    held: list[tuple[int, list[str]]] = []
    size = 0
    for row in items.select(item_id, text).toLocalIterator():
        own = words(row[1])
        if row[0] is not None and own:
            held.append((row[0], own))
            size += len(own)
        if size >= block_words:
            yield Items(held, min_words)
            held, size = [], 0
    if held:
        yield Items(held, min_words)


def leaks(documents: DataFrame, items: DataFrame, min_words: int = 12, shard_words: int = 1_000_000, block_words: int = 4_000_000) -> DataFrame:
    """The documents that hold at least ``min_words`` consecutive words of an item.

    Columns: doc_id, item_id, words (length of the longest match), doc_word, item_word (its first
    word in each; of equal matches the first).  ``documents`` has doc_id and text, ``items`` item_id
    and text.  One row per doc_id and item_id, also where an id has several rows; null ids and null or empty texts give none, items shorter than
    ``min_words`` have no matches.  Other columns are ignored.
    """
    spark = documents.sparkSession
    texts = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= min_words))
    found = []
    for block in blocks(items, "item_id", "text", block_words, min_words):
        if not block.texts:
            continue
        sent = spark.sparkContext.broadcast(block)  # bounded by block_words

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked = sent.value
            shard: list[tuple[int, int, np.ndarray]] = []
            size = 0
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for first, numbers in asked.stretches(words(text)):
                        shard.append((doc_id, first, numbers))
                        size += len(numbers)
                    if size >= shard_words:
                        yield _batch(asked.search(shard))
                        shard, size = [], 0
            yield _batch(asked.search(shard))

        found.append(texts.mapInArrow(run, SCHEMA))
    if not found:
        return spark.createDataFrame([], SCHEMA)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    # Matches only, so little is shuffled: an id may have rows in several shards, an item several texts.
    best = F.max(F.struct("words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("_m")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "_m.words", (-F.col("_m.d")).alias("doc_word"), (-F.col("_m.i")).alias("item_word"))


def _batch(rows: Iterator[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "words", "doc_word", "item_word"])


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """``documents`` without those that leaks() names."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
