"""A vocabulary trie and its intersection with Levenshtein automata.

The trie is implicit in a sorted list of words: a node is the range of words
that share a prefix, a child is found by bisection. The automaton of a word
accepts what differs from it by one error: a character taken for another, left
out or put in, or, as in text recognition, two characters read for one or one
for two. Both are walked together: as long as no error is spent only the
word's own prefix is alive, so the walk branches once, at the error, and goes
on along the rest of the word. The retrieval is complete, as every branch that
the automaton allows and the trie has is followed.

``candidates`` does this over tables: a word and what is one error away from it
share their first or their last characters, so both sides meet by these, and the
words that share them become one trie.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUBSTITUTED, MERGED, SPLIT, INSERTED, DELETED = "substituted", "merged", "split", "inserted", "deleted"
_END = "\U0010ffff"


class Trie:
    def __init__(self, words: Iterable[str]):
        self.words = sorted(set(words))

    def __contains__(self, word: str) -> bool:
        k = bisect_left(self.words, word)
        return k < len(self.words) and self.words[k] == word

    def children(self, lo: int, hi: int, depth: int) -> list[tuple[str, int, int]]:
        """(character, from, to) of the node lo:hi at ``depth``."""
        out = []
        while lo < hi:
            w = self.words[lo]
            if len(w) <= depth:
                lo += 1
                continue
            end = bisect_left(self.words, w[: depth + 1] + _END, lo, hi)
            out.append((w[depth], lo, end))
            lo = end
        return out

    def _has(self, word: str, lo: int, hi: int) -> bool:
        k = bisect_left(self.words, word, lo, hi)
        return k < hi and self.words[k] == word

    def within_one(self, read: str, at: int | None = None) -> list[tuple[str, str, str, str]]:
        """(word, error, what was read, what stands there) for every word one error away from ``read``, without ``read`` itself; with ``at``, the error is at that place."""
        found: dict[str, tuple[str, str, str, str]] = {}

        def see(word: str, lo: int, hi: int, *how: str) -> None:
            if word != read and word not in found and self._has(word, lo, hi):
                found[word] = (word, *how)

        lo, hi = 0, len(self.words)
        for i in range(len(read) + 1):
            prefix, rest = read[:i], read[i:]
            for c, a, b in self.children(lo, hi, i) if at is None or at == i else ():
                if rest:
                    if c != rest[0]:
                        see(prefix + c + rest[1:], a, b, SUBSTITUTED, rest[0], c)
                    if len(rest) > 1:
                        see(prefix + c + rest[2:], a, b, MERGED, rest[:2], c)
                    for d, a2, b2 in self.children(a, b, i + 1) if c != rest[0] else ():
                        see(prefix + c + d + rest[1:], a2, b2, SPLIT, rest[0], c + d)
                see(prefix + c + rest, a, b, DELETED, "", c)
            if rest:
                if at is None or at == i:
                    see(prefix + rest[1:], lo, hi, INSERTED, rest[0], "")
                if at == i:
                    break
                step = bisect_left(self.words, prefix + rest[0], lo, hi)
                lo, hi = step, bisect_left(self.words, prefix + rest[0] + _END, step, hi)
                if lo == hi:
                    break
        return list(found.values())


#: Words of a vocabulary that one trie of ``candidates`` is to hold on average.
TRIE_WORDS = 2000


def candidates(read: DataFrame, vocabulary: DataFrame, read_as: str, word: str) -> DataFrame:
    """(read_as, word): for each distinct value of ``read_as``, of three characters or more, the words of ``vocabulary`` one error away from it.

    Up to five characters meet by their first and by their last character,
    longer ones by two: an error at a place before that leaves the end alone,
    one after it the beginning. Words that share a key are dealt by hash over as many
    tries as keep these small, each of which sees all that was read with the key.
    """
    keys = lambda c, short, long: F.filter(F.array(*[F.when(on, F.concat(F.lit(f"{side}{k}"), f(c, F.lit(k)))) for on, k in ((short, 1), (long, 2)) for side, f in (("<", F.left), (">", F.right))]), lambda x: x.isNotNull())
    salts = max(1, vocabulary.count() // (TRIE_WORDS * 500))
    w = vocabulary.select(F.col(word).cast("string").alias("word")).where("word rlike '^[A-Za-z]{2,}$'")
    n: Column = F.length("word")
    have = w.select(F.explode(keys(F.col("word"), n <= 6, n >= 5)).alias("key"), F.pmod(F.xxhash64("word"), F.lit(salts)).cast("int").alias("salt"), F.lit(0).alias("ref"), "word")
    want = read.select(F.col(read_as).cast("string").alias("word")).distinct().where("length(word) >= 3")
    want = want.select(F.explode(keys(F.col("word"), n <= 5, n >= 6)).alias("key"), "word").select("key", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(1).alias("ref"), "word")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, words, trie = None, [], None
        for b in batches:
            out: list[tuple[str, str]] = []
            for key, salt, ref, x in zip(*(b.column(c).to_pylist() for c in ("key", "salt", "ref", "word")), strict=True):
                if (key, salt) != at:
                    at, words, trie = (key, salt), [], None
                if not ref:
                    words.append(x)
                    continue
                trie = trie or Trie(words)
                out += [(x, c) for c, *_ in trie.within_one(x)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in (0, 1)], names=["read", "word"])

    both = have.unionByName(want).repartition("key", "salt").sortWithinPartitions("key", "salt", "ref")
    return both.mapInArrow(meet, "read string, word string").distinct().select(F.col("read").alias(read_as), F.col("word").alias(word))
