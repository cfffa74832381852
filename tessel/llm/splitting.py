"""Splitting oversized texts at natural boundaries by agglomerative merging.

A text starts as atomic segments: it is cut at every paragraph, line and
sentence end, and segments that are still too long to be moved about (half of
what a piece may hold) at clause marks, then blanks, then anywhere. Adjacent
pairs wait in a heap by the strength of the boundary between them, weakest
first and of equal ones the smaller pair; a pair is merged while both together
with the overlap fit the limit. The boundaries left over are the cuts. Every
piece but the first repeats the end of the piece before it.

Only texts beyond the limit go through Python; the others pass as they are.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 4096, (200, 400)
#: Room that a piece keeps for its body, or the body's length if that is less; titles that leave less are cut into pieces of their own.
LEAST_BODY = 1024
#: Boundaries by strength, a cut falling behind each match.
BOUNDARIES = (
    (5, re.compile(r"\n[ \t\r　]*\n\s*")),
    (4, re.compile(r"\n[ \t\r　]*")),
    (3, re.compile(r"[。！？；][”’」』）)\"']*\s*|[.!?;][)\"'”’]*\s+")),
    (2, re.compile(r"[，、：,:]\s*")),
    (1, re.compile(r"\s+")),
)


def boundaries(text: str, most: int) -> list[tuple[int, int]]:
    """(place, strength) of the cuts between atomic segments, ascending, both ends left out, no segment longer than ``most``."""
    strength: dict[int, int] = {}
    for s, pattern in BOUNDARIES[:3]:
        for m in pattern.finditer(text):
            if 0 < m.end() < len(text):
                strength.setdefault(m.end(), s)
    cuts = sorted(strength)
    for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
        if b - a <= most:
            continue
        inner = {m.end(): s for s, pattern in reversed(BOUNDARIES[3:]) for m in pattern.finditer(text, a, b) if a < m.end() < b}
        at = a
        strength |= inner
        for p in [*sorted(inner), b]:
            while p - at > most:
                at += most
                strength[at] = 0
            at = p
    return sorted(strength.items())


def overlap_start(text: str, start: int, cut: int, least: int, most: int) -> int:
    """Where the overlap before ``cut`` begins: at the strongest boundary ``least`` to ``most`` characters back, the longest at equal strength, and not before ``start``."""
    lo, hi = max(start, cut - most), max(start, cut - least)
    if lo >= hi:
        return lo
    for _, pattern in BOUNDARIES:
        for m in pattern.finditer(text, max(start, lo - 40), hi):
            if lo <= m.end() <= hi:
                return m.end()
    return lo


def pieces(text: str, room: int, least: int, most: int) -> list[tuple[int, int, int]]:
    """(begin, body, end) of the pieces: text[begin:end] is at most ``room`` long and text[begin:body] repeats the piece before."""
    if len(text) <= room:
        return [(0, 0, len(text))]
    atom = max(1, min((room - most) // 2, room // 2))
    marks = boundaries(text, atom)
    edge = [0, *[p for p, _ in marks], len(text)]
    power = [9, *[s for _, s in marks], 9]
    n = len(edge) - 1  # segment i is edge[i]:edge[i + 1]
    right, left, alive = list(range(1, n + 1)), list(range(-1, n)), [True] * n
    heap = [(power[i + 1], edge[i + 2] - edge[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    fits = room - most
    while heap:
        s, size, i, j = heapq.heappop(heap)
        if not (alive[i] and j < n and alive[j] and right[i] == j and edge[right[j]] - edge[i] == size):
            continue
        if size > fits + (most if i == 0 else 0):
            continue
        alive[j] = False
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
            heapq.heappush(heap, (power[right[i]], edge[right[right[i]]] - edge[i], i, right[i]))
        if left[i] >= 0:
            heapq.heappush(heap, (power[i], edge[right[i]] - edge[left[i]], left[i], i))
    cuts = [i for i in range(1, n) if alive[i]]
    # a piece too short to be overlapped takes segments from its neighbour, up to the strongest boundary
    bounds = [0, *cuts, n]
    for k in range(len(bounds) - 2):
        a, b, c = bounds[k], bounds[k + 1], bounds[k + 2]
        if edge[b] - edge[a] < least:
            fit = [x for x in range(b + 1, c) if least <= edge[x] - edge[a] <= fits and edge[c] - edge[x] >= min(least, edge[c] - edge[b])]
            if fit:
                bounds[k + 1] = max(fit, key=lambda x: (power[x], -x))
    out, begin = [], 0
    for a, b in zip(bounds, bounds[1:], strict=False):
        if a:
            begin = overlap_start(text, out[-1][0], edge[a], least, most)
        out.append((begin, edge[a], edge[b]))
    return out


def fit_titles(titles: str, limit: int, body: int) -> str:
    """The titles with two line feeds behind, outer ones left out until ``body`` characters of room remain; none of a title that is too long by itself."""
    room = limit - min(body, limit // 2) - 2
    while len(titles) > room:
        titles = titles.split(" > ", 1)[1] if " > " in titles else ""
    return titles + "\n\n" if titles else ""


def split_oversized(items: DataFrame, keys: list[str], body: str, titles: Column | None = None, limit: int = LIMIT, overlap: tuple[int, int] = OVERLAP) -> DataFrame:
    """(keys..., piece, n_pieces, begin, body_begin, end, content, oversize, titles_cut, of_titles): each item's pieces in order.

    An item is its titles (if any), two line feeds and its body, white space
    around the body left out; one piece if within ``limit`` characters. A piece is the
    titles and body[begin:end], of which body[begin:body_begin] is the overlap
    with the piece before. Cut pieces share ``overlap`` characters at least and
    at most, fewer only if a whole piece is shorter. Titles too long to stand in
    every piece come first, in pieces of their own (``of_titles``, their offsets being those in the titles);
    the pieces of the body then carry the inner levels that fit, and ``titles_cut`` is how many characters of the
    titles they lack. ``oversize`` tells whether the item as a whole exceeds
    ``limit``; such an item has two pieces at least. Null and empty bodies give one piece;
    repeated rows are kept. Clashing names: columns other than keys and body are
    not passed on.
    """
    least, most = overlap
    if not 0 <= least <= most < limit // 4:
        raise ValueError("overlap must be below a quarter of the limit")
    head = F.coalesce(titles, F.lit("")) if titles is not None else F.lit("")
    base = items.select(*keys, F.coalesce(F.btrim(F.col(body), F.lit(" \t\n\r　")), F.lit("")).alias("_body"), head.alias("_titles"))
    whole = F.when(F.col("_titles") == "", F.col("_body")).otherwise(F.concat("_titles", F.lit("\n\n"), F.col("_body")))
    base = base.withColumn("_size", F.length("_body") + F.when(F.col("_titles") == "", 0).otherwise(F.length("_titles") + 2))
    zero = F.lit(0)
    small = base.where(F.col("_size") <= limit).select(*keys, zero.alias("piece"), F.lit(1).alias("n_pieces"), zero.alias("begin"), zero.alias("body_begin"), F.length("_body").alias("end"), whole.alias("content"), F.lit(False).alias("oversize"), zero.alias("titles_cut"), F.lit(False).alias("of_titles"))
    schema = ", ".join(f"`{k}` {items.schema[k].dataType.simpleString()}" for k in keys) + ", piece int, n_pieces int, begin int, body_begin int, end int, content string, oversize boolean, titles_cut int, of_titles boolean"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = [], []
            for i, (t, h) in enumerate(zip(b.column("_body").to_pylist(), b.column("_titles").to_pylist(), strict=True)):
                full = len(h) + 2 if h else 0
                fit = fit_titles(h, limit, min(LEAST_BODY, len(t)))
                own = pieces(h, limit, least, most) if len(fit) < full else []
                found = [*[(x, y, z, h[x:z], 0, True) for x, y, z in own], *[(x, y, z, fit + t[x:z], full - len(fit), False) for x, y, z in pieces(t, limit - len(fit), least, most)]]
                for k, (x, y, z, content, lack, of) in enumerate(found):
                    rows.append(i)
                    out.append((k, len(found), x, y, z, content, True, lack, of))
            cols = list(zip(*out, strict=True)) if out else [()] * 9
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(take) for k in keys], *[pa.array(c, pa.int32()) for c in cols[:5]], pa.array(cols[5], pa.string()), pa.array(cols[6], pa.bool_()), pa.array(cols[7], pa.int32()), pa.array(cols[8], pa.bool_())], names=[*keys, "piece", "n_pieces", "begin", "body_begin", "end", "content", "oversize", "titles_cut", "of_titles"])

    large = base.where(F.col("_size") > limit).select(*keys, "_body", "_titles").mapInArrow(cut, schema)
    return small.unionByName(large)
