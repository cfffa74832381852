"""Repairing text from scanned pages.

A file is taken as scanned if its lines break in mid sentence or mid word: if a
tenth of its line ends do. Of its items the page furniture is found first: lines
that are printed page numbers, lines that are repeated through the file apart
from their page number, and lines that carry the file's title (its first heading,
however cut short or misread).
Without them, lines flow together again: words broken by hyphen-like marks are
joined if the vocabulary has the whole word (or nearly), and lines become
paragraphs. What the vocabulary doesn't know is looked up by intersecting its
trie with the word's Levenshtein automaton; candidates are ranked by how often
one is read for the other, their frequency and their neighbours. Chinese, which
has no word spaces, is looked up by triples of characters in the same way.

Which characters are taken for which is counted over the scanned texts
themselves: of all unknown words, by the errors that would explain them as a
word that goes with a neighbour.

The vocabulary (words, pairs of words, Chinese pairs and triples) is counted
over all texts that aren't scanned and written as a table. Workers hold the most
frequent GRAMS of each kind; what these lack is asked of the table by a join
before anything is decided, so the result doesn't depend on GRAMS.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.lexicon import MERGED, SPLIT, SUBSTITUTED, Trie, candidates
from tessel.plans.lineage import Cut
from tessel.plans.sized import small_side

HYPHEN, MISREAD, HEADER, PAGE_NO = "hyphen", "misread", "header", "page_no"
#: The kind of error of a Chinese character read for another.
HAN_READ = "han"
#: Most frequent entries of each kind that workers hold; a cache, no limit of the vocabulary.
GRAMS = 400_000
#: Share of a file's line ends that break a sentence from which it counts as scanned.
BROKEN = 0.1
#: Share of a kind of error, among all unknown words that it may explain, from which it counts as usual, and the fewest such words.
USUAL, USUAL_LEAST = 0.002, 3
#: Nodes of a file whose texts hold a line from which it counts as repeated by the page layout. Chunks count with their node, as they hold its lines again.
REPEATS = 4
#: Characters from which a cut title is known by its beginning.
SHOWN = 16

#: Marks that break words, forms of page numbers.
MARKS = "-‐‑­¬"
PAGE = re.compile(r"\s*(?:第\s*\d+\s*页(?:\s*共\s*\d+\s*页)?|[—–-]\s*\d+\s*[—–-]|p\.?\s*\d+\s*(?:/|of)\s*\d+|page\s+\d+(?:\s*(?:/|of)\s*\d+)?|\[\s*\d+\s*\])\s*", re.IGNORECASE)
BARE = re.compile(r"\s*(?:\d{1,4}|[ivxlc]{1,8}|[IVXLC]{1,8})\s*")
WORD = re.compile(r"[A-Za-z0-9@!$|ﬁﬂ]*[A-Za-z][A-Za-z0-9@!$|ﬁﬂ]*")
RUNNING = re.compile(r"[。！？；，]|[.!?;,](?=\s|$)")
TAIL = re.compile(rf"([A-Za-z0-9@!$|ﬁﬂ]*[A-Za-zﬁﬂ])([{MARKS}])$")
HEAD = re.compile(r"[a-z@!$|0-9ﬁﬂ][A-Za-z0-9@!$|ﬁﬂ]*")
ENDS = "。！？.!?:：;；\"”）)"
COMPOUND = re.compile(r"[A-Za-z]+(?:-[A-Za-z]+)+")
HAN = re.compile(r"[一-鿿]")
#: A line end in mid sentence or mid word.
_BREAK = "\\n(?<=[A-Za-z,，\\u4e00-\\u9fff\\-‐‑­¬][ \\t]{0,20}\\r?\\n)(?=[A-Za-z\\u4e00-\\u9fff])"


def is_han(c: str) -> bool:
    return "一" <= c <= "鿿"


# the vocabulary -----------------------------------------------------------------


def _codes(text: str) -> np.ndarray:
    """Code points, figures as one, blanks left out."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    a = np.where((a >= 48) & (a < 58), 35, a)
    return a[(a != 32) & (a != 10) & (a != 13) & (a != 9) & (a != 0x3000)]


def _grams(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and triples as integers; triples around a Chinese character."""
    two = (a[:-1] << 21) | a[1:]
    return two, (two[:-1] << 21) | a[2:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter = Counter()
    pairs: Counter = Counter()
    compounds: Counter = Counter()
    han: dict[str, list] = {"2": [], "3": []}

    def flush(kind: str) -> None:
        keys, n = zip(*han[kind], strict=True) if han[kind] else ((), ())
        if keys:
            k, inv = np.unique(np.concatenate(keys), return_inverse=True)
            han[kind] = [(k, np.bincount(inv, np.concatenate(n)).astype(np.int64))]

    for b in batches:
        latin, chinese = [], []
        for t in b.column("text").to_pylist():
            (chinese if HAN.search(t) else latin).append(t)
        for t in [*latin, *chinese]:
            ws = [w.rstrip("!").lower() for w in WORD.findall(t)]
            words.update(ws)
            pairs.update(zip(ws, ws[1:], strict=False))
            if "-" in t:
                compounds.update(x.lower() for x in COMPOUND.findall(t))
        if chinese:
            a = _codes("。".join(chinese))
            mid = (a >= 0x4E00) & (a < 0xA000)
            two, three = _grams(a)
            for kind, g in (("2", two[mid[:-1] | mid[1:]]), ("3", three[mid[1:-1]])):
                k, n = np.unique(g, return_counts=True)
                han[kind].append((k, n))
                if len(han[kind]) > 32:
                    flush(kind)
    flush("2")
    flush("3")
    rows = [("w", w, 0, n) for w, n in words.items()] + [("p", f"{a} {c}", 0, n) for (a, c), n in pairs.items()] + [("c", w, 0, n) for w, n in compounds.items()]
    rows += [(kind, "", int(k), int(n)) for kind in han for ks, ns in han[kind] for k, n in zip(ks, ns, strict=True)]
    cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    for at in range(0, len(rows), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(cols[0][at : at + 50_000], pa.string()), pa.array(cols[1][at : at + 50_000], pa.string()), pa.array(cols[2][at : at + 50_000], pa.int64()), pa.array(cols[3][at : at + 50_000], pa.int64())], names=["kind", "gram", "code", "n"])


class Vocabulary:
    """What workers hold: the most frequent entries; ``cut`` are the kinds that the table has more of, ``usual`` the errors (error, read, true) that are usual."""

    def __init__(self, words: dict[str, int], pairs: set[str], compounds: set[str], two: np.ndarray, three: np.ndarray, three_n: np.ndarray, cut: frozenset[str] = frozenset(), usual: frozenset = frozenset()):
        self.words, self.pairs, self.compounds = words, pairs, compounds
        self.two, self.three, self.three_n = two, three, three_n
        self.cut, self.usual = cut, usual
        self._made = False

    def ready(self) -> Vocabulary:
        if not self._made:
            self.trie = Trie(w for w in self.words if is_plain(w))
            self.han = Trie("".join(chr((int(k) >> s) & 0x1FFFFF) for s in (42, 21, 0)) for k in self.three)
            self.candidates = lru_cache(maxsize=200_000)(lambda low: tuple(self.trie.within_one(low)))
            self.middles = lru_cache(maxsize=200_000)(lambda three: tuple(x[3] for x in self.han.within_one(three, 1) if x[1] == SUBSTITUTED and is_han(x[3])))
            self._made = True
        return self


class Known:
    """The vocabulary as one item sees it: what workers hold and what the table has answered. Lookups that neither settles are noted in ``asked``."""

    def __init__(self, v: Vocabulary, answers: list[dict] | None = None):
        self.v, self.usual = v.ready(), v.usual
        self.told = {(r["kind"], r["gram"], r["code"]): r["n"] for r in answers or ()}
        self.found = {(r["kind"], r["gram"], r["code"]): r["words"] for r in answers or () if r["kind"] in "um"}
        self.asked: set[tuple[str, str, int]] = set()

    def _ask(self, kind: str, gram: str, code: int = 0) -> int:
        n = self.told.get((kind, gram, code))
        if n is None:
            self.asked.add((kind, gram, code))
            return 0
        return n

    def word(self, w: str) -> int:
        return self.v.words.get(w) or (self._ask("w", w) if "w" in self.v.cut else 0)

    def pair(self, a: str, b: str) -> bool:
        p = f"{a} {b}"
        return p in self.v.pairs or "p" in self.v.cut and self._ask("p", p) > 0

    def compound(self, w: str) -> bool:
        return w in self.v.compounds or "c" in self.v.cut and self._ask("c", w) > 0

    def _has(self, g: np.ndarray, table: np.ndarray, kind: str) -> np.ndarray:
        hit = _in(g, table)
        if kind in self.v.cut:
            for i in np.flatnonzero(~hit):
                hit[i] = self._ask(kind, "", int(g[i])) > 0
        return hit

    def has2(self, g: np.ndarray) -> np.ndarray:
        return self._has(g, self.v.two, "2")

    def has3(self, g: np.ndarray) -> np.ndarray:
        return self._has(g, self.v.three, "3")

    def count3(self, g: int) -> int:
        k = bisect_left(self.v.three, g)
        if k < len(self.v.three) and self.v.three[k] == g:
            return int(self.v.three_n[k])
        return self._ask("3", "", g) if "3" in self.v.cut else 0

    def _found(self, kind: str, gram: str, code: int) -> list[str]:
        self._ask(kind, gram, code)
        return self.found.get((kind, gram, code)) or []

    def candidates(self, low: str) -> list[tuple[str, str, str, str]]:
        rare = Trie(self._found("u", low, 0)).within_one(low) if "w" in self.v.cut else ()
        return [*self.v.candidates(low), *rare]

    def middles(self, left: int, x: str, right: int) -> list[str]:
        """Characters that the vocabulary has between two others, but for ``x``."""
        held = self.v.middles(chr(left) + x + chr(right))
        return [*held, *(c for c in self._found("m", "", (left << 21) | right) if c != x)] if "3" in self.v.cut else list(held)


def is_plain(w: str) -> bool:
    """Whether a word may be a candidate."""
    return w.isalpha() and w.isascii() and len(w) > 1


def _in(g: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(g), dtype=bool)
    at = np.minimum(np.searchsorted(table, g), len(table) - 1)
    return table[at] == g


def vocabulary(clean: DataFrame, grams: int = GRAMS, cut: Cut | None = None) -> tuple[Vocabulary, DataFrame]:
    """Counts over the column ``text`` of all rows: the most frequent entries, at most ``grams`` of each kind, and the table of the others (kind, gram, code, n)."""
    cut = cut or Cut(clean.sparkSession)
    n = cut(clean.where("text <> ''").mapInArrow(_count, "kind string, gram string, code bigint, n bigint").groupBy("kind", "gram", "code").agg(F.sum("n").alias("n")), "grams")
    # the least count that keeps at most ``grams`` of a kind, from a histogram over eighths of powers of two: no kind is ever sorted in one task
    n = n.withColumn("step", F.floor(F.log2("n") * 8).cast("int"))
    least: dict[str, int] = {}
    held: Counter = Counter()
    for r in sorted(n.groupBy("kind", "step").count().collect(), key=lambda r: -r["step"]):
        held[r["kind"]] += r["count"]
        if held[r["kind"]] <= grams:
            least[r["kind"]] = r["step"]
    keep = F.lit(False)
    for k, step in least.items():
        keep = keep | ((F.col("kind") == k) & (F.col("step") >= step))
    rows = n.where(keep).select("kind", "gram", "code", "n").toArrow()  # at most ``grams`` of each kind
    kind = np.array(rows["kind"].to_pylist(), dtype=object)
    gram, code, count = rows["gram"].to_pylist(), rows["code"].to_numpy(), rows["n"].to_numpy()
    at = {k: np.flatnonzero(kind == k) for k in "wpc23"}
    three = at["3"][np.argsort(code[at["3"]])]
    lacks = frozenset(k for k, x in held.items() if x > grams)
    v = Vocabulary({gram[i]: int(count[i]) for i in at["w"]}, {gram[i] for i in at["p"]}, {gram[i] for i in at["c"]}, np.sort(code[at["2"]]), code[three], count[three], lacks)
    return v, n.where(~keep).select("kind", "gram", "code", "n")


def usual_errors(texts: DataFrame, held, rare: DataFrame, cut: Cut) -> frozenset:
    """The errors (error, read, true) that are usual over the column ``text`` of all rows: each unknown word counts for the errors by which it would be a word that goes with a neighbour, Chinese characters with both. What workers don't hold is asked of the table ``rare``; a text counts once it has nothing left to ask."""
    names = ["error", "read", "true", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, seen = Known(held.value), Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                seen.update(explained(t, k))
        rows = list(seen.items())
        yield pa.RecordBatch.from_arrays([*[pa.array([r[0][i] for r in rows], pa.string()) for i in range(3)], pa.array([r[1] for r in rows], pa.float64())], names=names)

    def count_or_ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = pa.list_(pa.struct([("kind", pa.string()), ("gram", pa.string()), ("code", pa.int64())]))
        seen = pa.list_(pa.struct([*((c, pa.string()) for c in names[:3]), ("n", pa.float64())]))
        for b in batches:
            asked, found = [], []
            for t, e in zip(b.column("text").to_pylist(), b.column("told").to_pylist(), strict=True):
                k = Known(held.value, e)
                errors = explained(t, k)
                asked.append([dict(zip(("kind", "gram", "code"), x, strict=True)) for x in sorted(k.asked)])
                found.append([dict(zip(names, (*x, n), strict=True)) for x, n in errors.items()])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("_row", "text", "told")], pa.array(asked, ask), pa.array(found, seen)], names=["_row", "text", "told", "asked", "found"])

    if not held.value.cut:
        n = texts.select("text").mapInArrow(count, "error string, read string, true string, n double")
    else:
        n = None
        todo = cut(texts.select("text").withColumn("_row", F.monotonically_increasing_id()).withColumn("told", F.array().cast(f"array<{_ANSWER}>")), "errors")
        while True:
            out = cut(todo.mapInArrow(count_or_ask, f"_row bigint, text string, told array<{_ANSWER}>, asked array<{_ASK}>, found array<struct<error:string,read:string,true:string,n:double>>"), "errors")
            done = out.where("size(asked) = 0").select(F.explode("found").alias("f")).select("f.*")
            n = done if n is None else n.unionByName(done)
            open_ = out.where("size(asked) > 0")
            if open_.isEmpty():
                break
            todo = cut(open_.join(told_more(open_, rare), "_row").select("_row", "text", F.concat("told", "more").alias("told")), "errors")
    n = n.groupBy("error", "read", "true").agg(F.sum("n").alias("n"))
    script = F.when(F.col("error") == HAN_READ, 1).otherwise(0)
    share = F.col("n") / F.sum("n").over(Window.partitionBy(script))  # one row a pair of characters
    rows = n.withColumn("share", share).where((F.col("share") >= USUAL) & (F.col("n") >= USUAL_LEAST)).select("error", "read", "true").collect()  # at most 1 / USUAL of each script
    return frozenset(tuple(r) for r in rows)


def explained(text: str, k: Known) -> Counter:
    """The errors that explain unknown words of a text; a word that several explain counts once in all."""
    out: Counter = Counter()
    t = re.sub(rf"[{MARKS}][ \t]*\r?\n\s*", "", text)
    for line in t.lower().splitlines():
        ws = WORD.findall(line)
        for i in range(1, len(ws) - 1):  # a line's first and last words may be parts of one that is broken around furniture
            low = ws[i]
            if len(low) < 3 or k.word(low) or k.word(low.rstrip("!")):
                continue
            before, after = ws[i - 1], ws[i + 1]
            fit = [(e, r, c) for word, e, r, c in k.candidates(low) if k.pair(before, word) | k.pair(word, after)]
            for x in fit:
                out[x] += 1 / len(fit)
    for _, x, found in han_spots(t, k, False):
        fit = [c for c, near, _ in found if near == 2]
        for c in fit:
            out[HAN_READ, x, c] += 1 / len(fit)
    return out


# one item ------------------------------------------------------------------------


def likely(read: str, true: str, error: str, name: bool, k: Known) -> float | None:
    """How readily ``true`` is read as ``read``: None if never."""
    if (error, read, true) in k.usual or (error, read.upper(), true.upper()) in k.usual:
        return 3.0
    if error == SUBSTITUTED:
        if not read.isalpha():
            return 2.0
        return None if name else 0.0
    return None


def best_word(read: str, before: str, after: str, k: Known) -> str | None:
    """The word that ``read`` was most likely printed as; None if it is known or like none."""
    low = read.lower()
    if len(low) < 3 or k.word(low) or low.endswith("!") and k.word(low.rstrip("!")):
        return None
    odd = sum(not c.isalpha() for c in low)
    if 2 * odd >= len(low):
        return None
    best, top = None, 0.0
    for word, error, r, t in k.candidates(low):
        fit = likely(r, t, error, read[0].isupper() and read[1:].isalpha(), k)
        if fit is None:
            continue
        score = fit + np.log1p(k.word(word)) / 4 + 3 * k.pair(before, word) + 3 * k.pair(word, after)
        if score > top:
            best, top = word, score
    if best is None:
        return None
    return best.capitalize() if read[0].isupper() or not read[0].isalpha() and before == "" else best


def han_spots(text: str, k: Known, weigh: bool = True) -> Iterator[tuple[int, str, list[tuple[str, int, float]]]]:
    """(place, character, candidates) of the Chinese characters that no known triple holds; a candidate is (character, how many of the triples beside it are known, weight), of those that its neighbours allow."""
    if not HAN.search(text):
        return
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    solid = np.flatnonzero((raw != 32) & (raw != 10) & (raw != 13) & (raw != 9) & (raw != 0x3000))
    a = np.concatenate([[0x3002], _codes(text), [0x3002]])
    if len(a) < 5:
        return
    two, three = _grams(a)
    mid = (a >= 0x4E00) & (a < 0xA000)
    around = np.zeros(len(three), dtype=bool)  # triples that hold a Chinese character in their middle are all the vocabulary has
    around[mid[1:-1]] = True
    known3 = np.zeros(len(three), dtype=bool)
    known3[around] = k.has3(three[around])
    ok = np.zeros(len(a), dtype=bool)
    ok[:-2] |= known3
    ok[1:-1] |= known3
    ok[2:] |= known3
    for i in np.flatnonzero(mid & ~ok):
        x, left, right = chr(int(a[i])), int(a[i - 1]), int(a[i + 1])
        pairs = None
        found = []
        for true in k.middles(left, x, right):
            usual = (HAN_READ, x, true) in k.usual
            if not usual:
                if pairs is None:
                    pairs = k.has2(two[i - 1 : i + 1]).any()
                if pairs:
                    continue
            c = ord(true)
            beside = [((int(a[i - 2]) << 42) | (left << 21) | c) if i > 1 else None, ((c << 42) | (right << 21) | int(a[i + 2])) if i + 2 < len(a) else None]
            near = sum(k.count3(g) > 0 for g in beside if g is not None)
            if near < (1 if usual else 2):
                continue
            found.append((true, near, 4 * usual + 2 * near + float(np.log1p(k.count3((left << 42) | (c << 21) | right))) if weigh else 0.0))
        yield int(solid[i - 1]), x, found


def han_misreads(text: str, k: Known) -> list[tuple[int, str]]:
    """(place in ``text``, character that should stand there) of misread Chinese characters."""
    return [(at, max(found, key=lambda f: f[2])[0]) for at, _, found in han_spots(text, k) if found]


def title_in(line: str, title: str) -> tuple[int, int, bool] | None:
    """(begin, end, exact) of ``title`` in ``line`` with at most one character in seven wrong; None if it isn't there."""
    at = line.find(title)
    if at >= 0:
        return at, at + len(title), True
    n, most = len(title), max(1, len(title) // 7)
    if n < 4:
        return None
    step = -(-n // (most + 1))  # of so many parts of the title, one must be without an error
    if not any(title[k : k + step] in line for k in range(0, n, step)):
        return None
    # each error spoils three of the title's n - 2 triples of characters at most
    if sum(title[k : k + 3] in line for k in range(n - 2)) < n - 2 - 3 * most:
        return None
    one = 1 << 20
    row = list(range(len(line) + 1))  # errors, times ``one``, and begin of the best match ending at j
    for i, t in enumerate(title, 1):
        left = i * one
        new = [left]
        for c, slant, above in zip(line, row, row[1:], strict=False):
            x = slant if c == t else slant + one
            left = min(x, above + one, left + one)
            new.append(left)
        row = new
        if min(row) >= (most + 1) * one:  # errors only grow
            return None
    j = min(range(len(line) + 1), key=lambda j: row[j] >> 20)
    return (row[j] & (one - 1), j, False)


def title_shown(line: str, title: str) -> tuple[int, int, bool] | None:
    """(begin, end, exact) of the title in a line, or of its beginning, SHOWN characters at least, where the layout has cut it at the line's end, a page number or a separator."""
    whole = title_in(line, title)
    if whole and whole[2] or len(title) <= SHOWN:
        return whole
    first = title_in(line, title[:SHOWN])
    if not first:
        return whole
    rest = re.sub(r"\s+\d+$", "", line[first[0] :])
    hits = [whole] if whole else []
    for shown in (rest, re.split(r"\s+[—–·|•/-]\s+", rest)[0]):
        n = min(len(title), len(shown.rstrip()))
        hit = title_in(line, title[:n].rstrip()) if n >= SHOWN else None
        if hit and abs(hit[0] - first[0]) <= 1:
            hits.append(hit)
    return max(hits, key=lambda h: h[2], default=None)  # an exact one, else the first


def is_listed(number: str, before: str, after: str) -> bool:
    """Whether a number alone on its line belongs to a list of figures rather than to the page. A page number may stand between such figures."""
    colon, amount = before.endswith((":", "：")), bool(re.fullmatch(r"\d[\d,]*\.\d+|\d{1,3}(,\d{3})+", after))
    if 1900 <= int(number) <= 2100:
        return colon or amount
    return colon and not BARE.fullmatch(after) or amount and not BARE.fullmatch(before)


def unnumbered(line: str) -> str | None:
    """The line without a page number at either end; None if it can't be a header: blank, a page number alone, a table row, or running text."""
    s = line.strip()
    if s.startswith("|") or PAGE.fullmatch(s) or BARE.fullmatch(s):
        return None
    s = re.sub(r"^\d+\s+|\s+\d+$", "", s)
    return s if sum(c.isalpha() for c in s) >= 4 and not RUNNING.search(s) else None


def furniture(lines: list[str], title: str, repeated: Trie | None = None) -> list[tuple[str, ...]]:
    """The noises that each line is as a whole: (), (page_no,), (header,) or both, with misread for a header unlike its title or the ``repeated`` line it is one error from."""
    out: list[tuple[str, ...]] = []
    text = [k for k, x in enumerate(lines) if x.strip()]
    place = {k: n for n, k in enumerate(text)}
    title = title.strip()
    for k, line in enumerate(lines):
        s = line.strip()
        if not s:
            out.append(())
            continue
        if PAGE.fullmatch(s):
            out.append((PAGE_NO,))
            continue
        if BARE.fullmatch(s):
            n = place[k]
            prev = lines[text[n - 1]].strip() if n else ""
            after = lines[text[n + 1]].strip() if n + 1 < len(text) else ""
            listed = s.isdigit() and is_listed(s, prev, after)
            out.append(() if listed or len(text) == 1 else (PAGE_NO,))
            continue
        hit = None
        if title and len(s) <= len(title) + 40 and not s.startswith("|"):
            hit = title_shown(s, title)
        if hit:
            b, e, exact = hit
            rest = s[:b] + s[e:]
            number = re.match(r"\d+\s", s) or re.search(r"\s\d+$", s)
            # a line of running text that only mentions the title goes on with it
            if RUNNING.search(rest) and not number:
                out.append(())
                continue
            out.append((HEADER, *([PAGE_NO] if number else []), *([] if exact else [MISREAD])))
            continue
        bare = unnumbered(s) if repeated else None
        if bare and (bare in repeated or any(e in (SUBSTITUTED, MERGED, SPLIT) for _, e, *_ in repeated.within_one(bare))):
            out.append((HEADER, *([PAGE_NO] if bare != s else []), *([] if bare in repeated else [MISREAD])))
            continue
        out.append(())
    return out


def repair(text: str, title: str, v: Known, repeated: Trie | None = None) -> tuple[str, set[str]]:
    """The text as continuous paragraphs and the kinds of noise it had."""
    noise: set[str] = set()
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    marks = furniture(lines, title, repeated)
    paragraphs: list[str] = []
    run = ""
    cut = False  # furniture since the last line of text
    for line, mark in zip(lines, marks, strict=True):
        s = line.strip()
        if mark:
            noise.update(mark)
            if HEADER in mark and MISREAD not in mark and title.strip() and (hit := title_shown(s, title.strip())) and header_misread(s[: hit[0]] + " " + s[hit[1] :], v):
                noise.add(MISREAD)
            cut = True
            continue
        if not s:
            if run and not (cut and not re.search(r"[。！？.!?：:；;”\"）)]$", run)) and not (run[-1] in MARKS):
                paragraphs.append(run)
                run = ""
            continue
        if s.startswith("|"):
            paragraphs += [x for x in (run, s) if x]
            run = ""
            continue
        if not run:
            run = s
        else:
            m = TAIL.search(run) if run[-1] in MARKS else None
            h = m and HEAD.match(s)
            if m and h and not h[0].isdigit():
                whole = m[1] + h[0]
                if broken(m[1], m[2], h[0], whole, v):
                    noise.add(HYPHEN)
                    run = run[:-1] + s
                else:
                    run += s
            else:
                run += s if is_han(run[-1]) or is_han(s[0]) or run[-1] in "，。、；：？！）" or s[0] in "，。、；：？！（" else " " + s
        cut = False
    if run:
        paragraphs.append(run)
    out = []
    for p in paragraphs:
        fixed, hit = respell(p, v)
        if hit:
            noise.add(MISREAD)
        out.append(fixed)
    return "\n\n".join(out), noise


def broken(tail: str, mark: str, head: str, whole: str, v: Known) -> bool:
    """Whether a mark at a line end breaks a word, rather than being a compound's own hyphen."""
    if mark != "-" or v.word(whole.lower()):
        return True
    if v.compound(f"{tail}-{head}".lower()):
        return False
    return best_word(whole, "", "", v) is not None or not (v.word(tail.lower()) and v.word(head.lower()))


def respell(p: str, v: Known) -> tuple[str, bool]:
    edits: list[tuple[int, int, str]] = []
    known, low = v.v.words, p.lower()
    same = len(low) == len(p)
    ms = list(WORD.finditer(p))
    for k, m in enumerate(ms):
        begin, end = m.span()
        if end - begin < 3 or (low[begin:end] if same else m[0].lower()) in known:
            continue
        if p[end : end + 1] and p[end] in MARKS[1:]:
            continue
        if end == len(p) and m[0].isalpha():
            continue  # an item cut off in mid word
        before = ms[k - 1][0].lower() if k else ""
        after = ms[k + 1][0].lower() if k + 1 < len(ms) else ""
        if (w := best_word(m[0], before, after, v)) is not None:
            edits.append((begin, end, w))
    edits += [(at, at + 1, c) for at, c in han_misreads(p, v)]
    for a, b, w in sorted(edits, reverse=True):
        p = p[:a] + w + p[b:]
    return p, bool(edits)


def header_misread(beside: str, v: Known) -> bool:
    """Whether a header misspells what stands beside the title."""
    beside = re.sub(r"^\d+\s|\s\d+$", "", beside).strip()
    for w in WORD.findall(beside):
        if best_word(w, "", "", v) is not None:
            return True
    return bool(han_misreads(beside, v)) or han_pair_misread(beside, v)


def han_pair_misread(text: str, v: Known) -> bool:
    """Whether a short text, whose triples the vocabulary needn't have, holds a character that no Chinese neighbour is known beside, while the one it is usually read for is."""
    for i, x in enumerate(text):
        for true in (t for e, read, t in v.usual if e == HAN_READ and read == x):
            beside = [(text[i - 1] + c, k) for k, c in enumerate((x, true)) if i and is_han(text[i - 1])]
            beside += [(c + text[i + 1], k) for k, c in enumerate((x, true)) if i + 1 < len(text) and is_han(text[i + 1])]
            known = [(k, bool(v.has2(np.array([(ord(t[0]) << 21) | ord(t[1])]))[0])) for t, k in beside]
            if any(hit for k, hit in known if k == 1) and not any(hit for k, hit in known if k == 0):
                return True
    return False


# tables --------------------------------------------------------------------------


def file_facts(items: DataFrame, headings: DataFrame, cut: Cut) -> DataFrame:
    """(file_id, broken, title): the share of line ends over all items of a file that break a sentence or a word, and the file's first heading."""
    ends = F.length(F.translate("text", "\r", "")) - F.length(F.translate("text", "\r\n", ""))
    counts = items.groupBy("file_id").agg(F.sum(F.regexp_count("text", F.lit(_BREAK))).alias("breaks"), F.sum(ends).alias("ends"))
    share = F.when(F.col("breaks") > 0, F.col("breaks") / F.greatest("ends", "breaks")).otherwise(0.0)
    first = headings.where("file_id is not null and node_index is not null").groupBy("file_id").agg(F.min(F.struct("node_index", "text")).alias("h")).select("file_id", F.col("h.text").alias("title"))
    return cut(counts.select("file_id", share.alias("broken")).join(first, "file_id", "left"), "files")


def repeated_lines(scanned: DataFrame, cut: Cut) -> DataFrame:
    """(file_id, repeated): the lines, without page numbers, that at least REPEATS nodes of a file hold, after as many different lines and before as many: text that itself recurs goes on in the same way, a header falls anywhere."""
    kinds = ", ".join(f"{k} {scanned.schema[k].dataType.simpleString()}" for k in ("file_id", "node_index"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, lines, befores, afters = [], [], [], []
            for k, t in enumerate(b.column("text").to_pylist()):
                text = [x.strip() for x in re.split(r"[\r\n]+", t) if x.strip()]
                for n, x in enumerate(text):
                    if u := unnumbered(x):
                        at.append(k)
                        lines.append(u)
                        befores.append(text[n - 1] if n else None)
                        afters.append(text[n + 1] if n + 1 < len(text) else None)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("file_id").take(rows), b.column("node_index").take(rows), *(pa.array(x, pa.string()) for x in (lines, befores, afters))], names=["file_id", "node_index", "line", "before", "after"])

    held = scanned.select("file_id", "node_index", "text").mapInArrow(split, f"{kinds}, line string, before string, after string")
    # neighbours as hashes; one that is missing at an item's edge differs from all others
    unlike = lambda c: F.coalesce(F.min(F.when(F.col(c).isNotNull(), F.xxhash64(c))), F.xxhash64("node_index")).alias(c)
    nodes = held.groupBy("file_id", "line", "node_index").agg(unlike("before"), unlike("after"))
    often = nodes.groupBy("file_id", "line").agg(F.size(F.collect_set("before")).alias("b"), F.size(F.collect_set("after")).alias("a")).where((F.col("b") >= REPEATS) & (F.col("a") >= REPEATS))
    return cut(often.groupBy("file_id").agg(F.collect_list("line").alias("repeated")), "repeated")


_ANSWER = "struct<kind:string,gram:string,code:bigint,n:bigint,words:array<string>>"
_ASK = "struct<kind:string,gram:string,code:bigint>"


def answers(asked: DataFrame, rare: DataFrame) -> DataFrame:
    """(kind, gram, code, n, words) for distinct questions (kind, gram, code): how often the table ``rare`` has the entry, 0 if it hasn't; for kind u its words one error away from ``gram``, for kind m its characters between the two of ``code``."""
    entry = asked.where("kind not in ('u', 'm')").join(rare, ["kind", "gram", "code"], "left").select("kind", "gram", "code", F.coalesce("n", F.lit(0)).alias("n"), F.lit(None).cast("array<string>").alias("words"))
    low = 0x1FFFFF
    window = F.shiftleft(F.shiftright("code", 42), 21).bitwiseOR(F.col("code").bitwiseAND(low))
    mid = F.shiftright("code", 21).bitwiseAND(low)
    three = rare.where((F.col("kind") == "3") & mid.between(0x4E00, 0x9FFF)).select(window.alias("code"), mid.alias("mid"))
    held = asked.where("kind = 'm'").join(three, "code", "left").groupBy("kind", "gram", "code").agg(F.collect_list("mid").alias("mids"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [[chr(x) for x in m] for m in b.column("mids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("kind", "gram", "code")], pa.array([len(w) for w in words], pa.int64()), pa.array(words, pa.list_(pa.string()))], names=["kind", "gram", "code", "n", "words"])

    middles = held.mapInArrow(spell, "kind string, gram string, code bigint, n bigint, words array<string>")
    near = candidates(asked.where("kind = 'u'").select("gram"), rare.where("kind = 'w'").select(F.col("gram").alias("word")), "gram", "word")
    words = asked.where("kind = 'u'").join(near.groupBy("gram").agg(F.collect_list("word").alias("words")), "gram", "left").select("kind", "gram", "code", F.coalesce(F.size("words"), F.lit(0)).cast("long").alias("n"), "words")
    return entry.unionByName(middles).unionByName(words)


def told_more(open_: DataFrame, rare: DataFrame) -> DataFrame:
    """(_row, more): the answers to each row's questions."""
    asks = open_.select("_row", F.explode("asked").alias("a")).select("_row", "a.*")
    got = asks.join(answers(asks.select("kind", "gram", "code").distinct(), rare), ["kind", "gram", "code"])
    return got.groupBy("_row").agg(F.collect_list(F.struct("kind", "gram", "code", "n", "words")).alias("more"))


def repair_scans(items: DataFrame, headings: DataFrame, corpus: DataFrame, keys: list[str], grams: int = GRAMS, cut: Cut | None = None) -> DataFrame:
    """(keys..., scanned, noises, text): every item with the kinds of noise found and its repaired text.

    ``items`` has file_id among ``keys`` and text, ``headings`` file_id,
    node_index and text, ``corpus`` text known to be clean. Items of files that
    aren't scanned pass as they are with no noise; so do null and empty texts.
    Repeated rows are kept. A file without a heading has no title to know its
    headers by, only their repetition; without clean text nothing counts as
    misread. The result is the same for any ``grams``.
    """
    spark = items.sparkSession
    cut = cut or Cut(spark)
    facts = small_side(file_facts(items.where("text <> ''"), headings, cut))
    known = items.join(facts, "file_id", "left")
    scanned: Column = F.coalesce(F.col("broken") >= BROKEN, F.lit(False))
    clean = known.where(~scanned).select("text").unionByName(corpus.select("text")).unionByName(headings.select("text"))
    v, rare = vocabulary(clean, grams, cut)
    dirty = known.where(scanned & (F.col("text") != ""))
    v.usual = usual_errors(dirty, spark.sparkContext.broadcast(v), rare, cut)
    held = spark.sparkContext.broadcast(v)
    own = ", ".join(f"`{k}` {items.schema[k].dataType.simpleString()}" for k in keys)

    def read(b: pa.RecordBatch, told: list) -> list[tuple[str, set[str], set]]:
        out = []
        for t, h, r, e in zip(*(b.column(c).to_pylist() for c in ("text", "title", "repeated")), told, strict=True):
            k = Known(held.value, e)
            out.append((*repair(t, h or "", k, Trie(r) if r else None), k.asked))
        return out

    def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = read(b, [None] * b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(k) for k in keys], pa.array([True] * b.num_rows), pa.array([sorted(n) for _, n, _ in got], pa.list_(pa.string())), pa.array([t for t, *_ in got], pa.string())],
                names=[*keys, "scanned", "noises", "text"],
            )

    def fix_or_ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = pa.list_(pa.struct([("kind", pa.string()), ("gram", pa.string()), ("code", pa.int64())]))
        for b in batches:
            got = read(b, b.column("told").to_pylist())
            asked = pa.array([[dict(zip(("kind", "gram", "code"), x, strict=True)) for x in sorted(a)] for *_, a in got], ask)
            kept = [b.column(c) for c in (*keys, "_row", "text", "title", "repeated", "told")]
            yield pa.RecordBatch.from_arrays([*kept, asked, pa.array([sorted(n) for _, n, _ in got], pa.list_(pa.string())), pa.array([t for t, *_ in got], pa.string())], names=[*keys, "_row", "text", "title", "repeated", "told", "asked", "noises", "fixed"])

    todo = dirty.join(small_side(repeated_lines(dirty, cut)), "file_id", "left").select(*keys, "text", F.trim("title").alias("title"), "repeated")
    rest = known.where(~scanned | F.col("text").isNull() | (F.col("text") == "")).select(*keys, F.lit(False).alias("scanned"), F.array().cast("array<string>").alias("noises"), "text")
    if not v.cut:
        return todo.mapInArrow(fix, own + ", scanned boolean, noises array<string>, text string").unionByName(rest)
    # what workers don't hold is asked of the table; an item is done when it has nothing left to ask, which takes as many rounds as questions follow from answers
    done = rest
    todo = todo.withColumn("_row", F.monotonically_increasing_id()).withColumn("told", F.array().cast(f"array<{_ANSWER}>"))
    todo = cut(todo, "scans")
    while True:
        out = cut(todo.mapInArrow(fix_or_ask, own + f", _row bigint, text string, title string, repeated array<string>, told array<{_ANSWER}>, asked array<{_ASK}>, noises array<string>, fixed string"), "scans")
        done = done.unionByName(out.where("size(asked) = 0").select(*keys, F.lit(True).alias("scanned"), "noises", F.col("fixed").alias("text")))
        open_ = out.where("size(asked) > 0")
        if open_.isEmpty():
            return done
        todo = cut(open_.join(told_more(open_, rare), "_row").select(*keys, "_row", "text", "title", "repeated", F.concat("told", "more").alias("told")), "scans")
