"""Reading level of documents: a linear pairwise ranker calibrated into bands.

Sentences are described by their vocabulary (words, pairs of Chinese
characters) and syntax (length, commas, length of words, figures, acronyms,
share of words the model does not know). A document of the graded sample is
the mean of its sentences by length; a linear ranker is learned so that of two
documents with different grades the harder scores higher (logistic loss on
pairs). A document's score is the median of its sentences' scores by length, so
what most of its text is decides and neither openings nor closings; lines with
which documents begin or end so often that they are furniture are left out as
far as the document has other text. Isotonic regression of the grades on the
scores turns scores into levels. The ranker is then fitted once more on the
sentences that agree with their document's level, as sentences of another
level say nothing about its grade.

Only the fit looks at a sample (``sample_docs`` graded documents, of them
``sample_chars`` characters, by hash); furniture is counted over all documents
and every document is scored on its whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENTENCE = re.compile(r"(?<=[。！？!?\n])|(?<=\.)\s+")
TOKEN = re.compile(r"[A-Za-z]+(?:[-'’][A-Za-z]+)*|[0-9]+|[一-鿿]+")
COMMA = re.compile(r"[,;，；、：:]")
SYNTAX = 6
#: Bounds of the fit, not of the data that is scored: graded documents and their characters, words (the commonest of the sample) that have a weight, and pairs of documents drawn for the ranker.
SAMPLE_DOCS, SAMPLE_CHARS, VOCABULARY = 5000, 8_000_000, 4000
#: Share and number of documents from which a first or last line is furniture; lines are told apart by their first and last EDGE characters, as names and dates stand between.
EDGE = 8
FURNITURE_SHARE, FURNITURE_LEAST = 0.002, 8
ROUNDS, STEPS, PAIRS, L2, LEAST_GAP = 2, 60, 60_000, 0.1, 0.75


def tokens(sentence: str) -> tuple[list[str], np.ndarray | list[float], bool]:
    """(vocabulary features, syntax features without the unknown share, Chinese?)."""
    words: list[str] = []
    latin = digits = acronyms = letters = chars = 0
    for t in TOKEN.findall(sentence):
        c = t[0]
        if c > "z":
            chars += len(t)
            words += [t[i : i + 2] for i in range(len(t) - 1)]
        elif c.isdigit():
            digits += 1
        else:
            latin += 1
            letters += len(t)
            if len(t) > 1 and t.isupper():
                acronyms += 1
            words.append(t.lower())
    zh = chars > latin
    n = max(1, chars + latin)
    return words, [float(np.log1p(n)), len(COMMA.findall(sentence)) / n, digits / n, acronyms / n, letters / latin / 10 if latin else 0.0], zh


def sentences(text: str, furniture: frozenset) -> list[str]:
    """Sentences of a text without furniture at its ends, or with it if there is nothing else."""
    lines = [x for x in text.splitlines() if x.strip()]
    kept = lines
    if len(lines) > 1 and furniture:
        kept = lines[(("first", *edge_key(lines[0])) in furniture) : len(lines) - (("last", *edge_key(lines[-1])) in furniture)] or lines
    return [s for s in SENTENCE.split("\n".join(kept)) if s and not s.isspace()]


def edge_key(line: str) -> tuple[str, str]:
    """A line's first and last EDGE characters, figures masked, speaker left out."""
    line = re.sub(r"[0-9]+", "#", re.sub(r"^[^:：]{1,10}[:：]\s*", "", line.strip()))
    return line[:EDGE], line[-EDGE:]


@dataclass(frozen=True)
class Model:
    words: dict[str, float] = field(default_factory=dict)
    syntax: tuple[float, ...] = (0.0,) * (2 * SYNTAX)
    edges: tuple[float, ...] = ()
    levels: tuple[float, ...] = ()
    furniture: frozenset = frozenset()

    def sentence(self, s: str) -> float:
        words, syn, zh = tokens(s)
        total, unknown, get = 0.0, 0, self.words.get
        for w in words:
            x = get(w)
            if x is None:
                unknown += 1
            else:
                total += x
        n = len(words) or 1
        w = self.syntax[SYNTAX:] if zh else self.syntax[:SYNTAX]
        return total / n + sum(a * b for a, b in zip(w, [*syn, unknown / n], strict=True))

    def document(self, text: str | None) -> float | None:
        rows = [(self.sentence(s), len(s)) for s in sentences(text or "", self.furniture)]
        return weighted_median(rows) if rows else None

    def level(self, score: float) -> float:
        return self.levels[max(0, int(np.searchsorted(self.edges, score, side="right")) - 1)] if self.levels else 3.0


def weighted_median(rows: list[tuple[float, int]]) -> float:
    rows = sorted(rows)
    half, run = sum(n for _, n in rows) / 2, 0
    for s, n in rows:
        run += n
        if run >= half:
            return s
    return rows[-1][0]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """Pool adjacent violators: (lower ends of the blocks, their levels), ties in ``x`` being one point."""
    blocks: list[list[float]] = []
    for v in np.unique(x):
        at = y[x == v]
        blocks.append([float(at.mean()), len(at), float(v)])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, n, _ = blocks.pop()
            p = blocks[-1]
            p[0], p[1] = (p[0] * p[1] + m * n) / (p[1] + n), p[1] + n
    return [b[2] for b in blocks], [b[0] for b in blocks]


def rank(x: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    """Weights of a linear ranker by the logistic loss on pairs at least LEAST_GAP apart."""
    rng = np.random.default_rng(seed)
    i, j = rng.integers(0, len(y), PAIRS), rng.integers(0, len(y), PAIRS)
    apart = y[i] - y[j] >= LEAST_GAP
    i, j = i[apart], j[apart]
    scale = (1 / np.sqrt(x.var(0) + 1e-5)).astype(np.float32)
    x = x * scale
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    for t in range(1, STEPS + 1):
        s = x @ w
        p = 1 / (1 + np.exp(np.clip(s[i] - s[j], -30, 30)))
        pull = (np.bincount(i, p, len(y)) - np.bincount(j, p, len(y))).astype(np.float32)
        g = -(x.T @ pull) / max(1, len(i)) + L2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w * scale


def fit(texts: list[str], grades: list[float], furniture: frozenset) -> Model:
    """The model of graded texts. Without any, all scores are 0 and all levels 3."""
    cut = [sentences(t, furniture) for t in texts]
    told = [[(*tokens(s), len(s)) for s in c] for c in cut]
    some = [k for k, t in enumerate(told) if t]
    if not some:
        return Model(furniture=furniture)
    told, y = [told[k] for k in some], np.array([grades[k] for k in some])
    df = Counter(w for t in told for w in {x for s in t for x in s[0]})
    words = [w for w, n in sorted(df.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if n >= 3]
    index = {w: k for k, w in enumerate(words)}
    v = len(words)

    def row(s) -> tuple[list[int], np.ndarray]:
        ws, syn, zh, _ = s
        at = [index[w] for w in ws if w in index]
        n = len(ws) or 1
        base = v + SYNTAX * zh
        return [*at, *range(base, base + SYNTAX)], np.array([*([1 / n] * len(at)), *syn, 1 - len(at) / n])

    rows = [[(*row(s), s[3]) for s in t] for t in told]
    keep = [[True] * len(t) for t in rows]
    model = Model(furniture=furniture)
    for k in range(ROUNDS):
        x = np.zeros((len(rows), v + 2 * SYNTAX), np.float32)
        for d, (t, use) in enumerate(zip(rows, keep, strict=True)):
            size = sum(n for (_, _, n), u in zip(t, use, strict=True) if u)
            for (at, val, n), u in zip(t, use, strict=True):
                if u:
                    np.add.at(x[d], at, val * (n / size))
        w = rank(x, y, k)
        scored = [[(float(val @ w[at]), n) for at, val, n in t] for t in rows]
        mid = np.array([weighted_median(s) for s in scored])
        edges, levels = isotonic(mid, y)
        model = Model({a: float(b) for a, b in zip(words, w, strict=False)}, tuple(map(float, w[v:])), tuple(edges), tuple(levels), furniture)
        keep = [[abs(model.level(s) - model.level(m)) <= 0.8 for s, _ in t] for t, m in zip(scored, mid, strict=True)]
    return model


def furniture_lines(docs: DataFrame, text: str) -> frozenset:
    """Keys of first and last lines that begin or end at least FURNITURE_SHARE of all documents: at most 2 / FURNITURE_SHARE keys."""
    t = F.btrim(F.col(text), F.lit(" \t\n\r　"))
    lines = docs.select(F.regexp_replace(t, "\\r", "\n").alias("t")).where("t like '%\n%'")
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.btrim(c, F.lit(" \t\n\r　")), "^[^:：]{1,10}[:：]\\s*", ""), "[0-9]+", "#")
    ends = lines.select(F.explode(F.array(*[F.struct(F.lit(k).alias("at"), plain(F.substring_index("t", "\n", n)).alias("line")) for k, n in (("first", 1), ("last", -1))])).alias("e"))
    keys = ends.select("e.at", F.left("e.line", F.lit(EDGE)).alias("a"), F.right("e.line", F.lit(EDGE)).alias("b")).groupBy("at", "a", "b").count()
    least = max(FURNITURE_LEAST, FURNITURE_SHARE * docs.count())
    return frozenset((r["at"], r["a"], r["b"]) for r in keys.where(F.col("count") >= least).collect())


def train(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on documents graded in ``labels`` (doc_id, rater_id, band): repeated rows count once, null bands not at all, several raters by their mean."""
    grades = labels.where("band is not null").select("doc_id", "rater_id", "band").distinct().groupBy("doc_id").agg(F.avg("band").alias("grade"))
    drawn = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    known = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).where("length(text) > 0").join(F.broadcast(drawn), "doc_id")  # at most sample_docs rows
    # lengths first: texts are fetched only of the documents that sample_chars allows
    sizes = known.select("doc_id", F.xxhash64("doc_id").alias("h"), F.length("text").alias("n")).collect()
    chosen, run = [], 0
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        run += r["n"]
        if run > sample_chars:
            break
        chosen.append(r["doc_id"])
    kind = docs.schema[doc].dataType.simpleString()
    ids = docs.sparkSession.createDataFrame([(x,) for x in chosen], f"doc_id {kind}")
    rows = known.join(F.broadcast(ids), "doc_id").collect()
    return fit([r["text"] for r in rows], [r["grade"] for r in rows], furniture_lines(docs, text))


def reading_levels(docs: DataFrame, model: Model, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, score, level, band): level is the calibrated score, band it rounded to 1..5. Texts without a sentence have nulls; every row is judged for itself."""
    kind = docs.schema[doc].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most VOCABULARY weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            s = [m.document(t) for t in b.column(text).to_pylist()]
            level = [None if x is None else m.level(x) for x in s]
            band = [None if x is None else min(5, max(1, int(x + 0.5))) for x in level]
            yield pa.RecordBatch.from_arrays([b.column(doc), pa.array(s, pa.float64()), pa.array(level, pa.float64()), pa.array(band, pa.int32())], names=[doc, "score", "level", "band"])

    return docs.select(doc, text).mapInArrow(score, f"`{doc}` {kind}, score double, level double, band int")
