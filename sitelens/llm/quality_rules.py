"""Quality rules: counts that a base rule judges, and gradient-boosted trees over document statistics.

Every whole text is reduced to counts and shares. The base rule refuses very short texts and texts that
repeat themselves. The trees are grown on the driver over the statistics of a sample of at most ``SAMPLE``
labelled documents, a parameter; no text reaches the driver. Of statistics that only speak against a text
(``FALLING``) more never raises a score: a split that would is not made, and what lies below a split
stays on its side of the middle. The grown trees are flattened into numpy arrays of nodes, and all rows of
a batch walk down all trees together.

Nulls and empty texts have zero counts and fail the base rule. Of several labels of a document the lowest
counts; labels without a document, and of other values than 0 and 1, are left out. Without labels of both
kinds the base rule alone decides. Equal texts fare alike; repeated rows are judged each. An empty table
gives no rows. Only doc_id and text are read, and labels by doc_id; doc_id, lang, source and labels are
never statistics.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import sampled, table
from sitelens.llm.hashing import rolled, word_hashes

SYMBOLS, BLANKS = "#*$%&|<>", "\x20\x09\x0a\x0b\x0c\x0d"
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "mean_word", "symbols_a_word", "repeated_lines", "repeated_words", "upper", "digits", "stops_a_word", "distinct_words", "mean_line", "closed_lines", "marks_a_word", "commonest_word",
)
#: Statistics of which more never speaks for a text.
FALLING = ("symbols_a_word", "repeated_lines", "repeated_words", "marks_a_word")
SAMPLE, TREES, DEPTH, RATE, BINS, LEAST_ROWS, PENALTY = 8192, 60, 3, 0.2, 32, 8, 1.0
THRESHOLD = 0.5
_PIECE = 1 << 20
_ASCII = np.arange(128)
_KIND = {"upper": (_ASCII >= 65) & (_ASCII <= 90), "digit": (_ASCII >= 48) & (_ASCII <= 57), "stop": np.isin(_ASCII, [ord(c) for c in ".,;:?"]), "mark": np.isin(_ASCII, [ord(c) for c in "!#$%&*+/<=>@\\^_`{|}~"])}


def _characters(text: str) -> np.ndarray:
    """How often each ASCII character occurs."""
    out = np.zeros(128, np.int64)
    for at in range(0, len(text), _PIECE):
        raw = np.frombuffer(text[at : at + _PIECE].encode("utf-8", "surrogatepass"), np.uint8)
        out += np.bincount(raw[raw < 128], minlength=128)
    return out


def repeated_words(hashes: np.ndarray, width: int = WINDOW) -> int:
    """Words inside a window of ``width`` words that occurs twice or more, its first place included."""
    windows = rolled(hashes, width)
    if not len(windows):
        return 0
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    edges = np.zeros(len(hashes) + 1, np.int64)
    twice = np.flatnonzero(times[which] > 1)
    edges[twice] += 1
    edges[twice + width] -= 1
    return int((np.cumsum(edges)[:-1] > 0).sum())


def counts(text: str, hashes: np.ndarray) -> tuple[tuple[int, ...], list[float]]:
    """The base counts of a text, whose words have these hashes, and its statistics."""
    chars = _characters(text)
    n = len(hashes)
    word_chars = len(text) - int(sum(chars[ord(c)] for c in BLANKS))
    symbols = int(sum(chars[ord(c)] for c in SYMBOLS))
    lines = Counter(text.split("\n"))
    filled = {line: k for line, k in lines.items() if line.strip(BLANKS)}
    n_lines = sum(filled.values())
    dup_lines = n_lines - len(filled)
    repeats = repeated_words(hashes)
    closed = sum(k for line, k in filled.items() if line.rstrip(BLANKS)[-1] in ".!?:;\"'")
    _, times = np.unique(hashes, return_counts=True)
    kinds = {name: int(chars[mask].sum()) for name, mask in _KIND.items()}
    words, letters, rows = max(n, 1), max(word_chars, 1), max(n_lines, 1)
    shares = [
        float(np.log1p(n)), word_chars / words, symbols / words, dup_lines / rows, repeats / words, kinds["upper"] / letters, kinds["digit"] / letters, kinds["stop"] / words,
        len(times) / words, n / rows, closed / rows, kinds["mark"] / words, int(times.max(initial=0)) / words,
    ]
    return (n, word_chars, symbols, dup_lines, repeats), shares


def all_counts(texts: list[str], chars: int = 4_000_000) -> Iterator[tuple[tuple[int, ...], list[float]]]:
    """Of every text; hashes are held for texts of about ``chars`` characters, or one longer text, at a time."""
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= chars:
            size += len(texts[end])
            end += 1
        yield from map(counts, texts[at:end], word_hashes(texts[at:end]))
        at = end


class Trees:
    """Boosted trees as arrays over all nodes: feature (-1: a leaf), threshold, left child (the right one follows), value."""

    def __init__(self, base: float, feature, threshold, left, value, root):
        self.base, self.feature, self.threshold = base, np.asarray(feature, np.int64), np.asarray(threshold, float)
        self.left, self.value, self.root = np.asarray(left, np.int64), np.asarray(value, float), np.asarray(root, np.int64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.root[None], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        while (inner := self.feature[at] >= 0).any():
            right = x[rows, np.maximum(self.feature[at], 0)] > self.threshold[at]
            at = np.where(inner, self.left[at] + right, at)
        return self.base + self.value[at].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Trees of second-order boosting on the logistic loss. ``signs``: 1 and -1 for features that may only raise and lower a score, 0 for free ones."""
    p = (y.sum() + 1) / (len(y) + 2)
    out: dict[str, list] = {name: [] for name in ("feature", "threshold", "left", "value", "root")}
    base = float(np.log(p / (1 - p)))
    if len(np.unique(y)) < 2:
        return Trees(base, **out)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    bins = np.column_stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)])
    margin = np.full(len(y), base)

    def node() -> int:
        for name, value in (("feature", -1), ("threshold", 0.0), ("left", 0), ("value", 0.0)):
            out[name].append(value)
        return len(out["feature"]) - 1

    def weight(g: np.ndarray, h: np.ndarray, low: float, high: float) -> np.ndarray:
        return np.clip(-g / (h + PENALTY), low, high)

    def split(at: int, rows: np.ndarray, low: float, high: float, left_depth: int) -> None:
        g, h = gradient[rows], hessian[rows]
        own = weight(g.sum(), h.sum(), low, high)
        # What a weight takes off the loss, to second order.
        gain = lambda g, h, w: -(g * w + 0.5 * (h + PENALTY) * w * w)
        best = (gain(g.sum(), h.sum(), own) + 1e-6, None)
        for f in range(x.shape[1]) if left_depth else ():
            many = len(cuts[f]) + 1
            gs, hs, ns = (np.cumsum(np.bincount(bins[rows, f], weights=w, minlength=many))[:-1] for w in (g, h, np.ones(len(rows))))
            a, b = weight(gs, hs, low, high), weight(g.sum() - gs, h.sum() - hs, low, high)
            fit = gain(gs, hs, a) + gain(g.sum() - gs, h.sum() - hs, b)
            fit[(np.minimum(ns, len(rows) - ns) < LEAST_ROWS) | (signs[f] * (b - a) < 0)] = -np.inf
            if len(fit) and fit.max() > best[0]:
                k = int(fit.argmax())
                best = (fit[k], (f, k, a[k], b[k]))
        if best[1] is None:
            out["value"][at] = RATE * float(own)
            margin[rows] += RATE * own
            return
        f, k, a, b = best[1]
        left, right = node(), node()
        out["feature"][at], out["threshold"][at], out["left"][at] = f, float(cuts[f][k]), left
        below = bins[rows, f] <= k
        middle = (a + b) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(signs[f])]
        split(left, rows[below], *bounds[0], left_depth - 1)
        split(right, rows[~below], *bounds[1], left_depth - 1)

    for _ in range(trees):
        now = 1 / (1 + np.exp(-margin))
        gradient, hessian = now - y, now * (1 - now)
        out["root"].append(node())
        split(out["root"][-1], np.arange(len(y)), -np.inf, np.inf, depth)
    return Trees(base, **out)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, and ``stats``, one number for each of FEATURES; ``docs``: doc_id, text."""
    rows = docs.select(F.col("doc_id").cast("bigint").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = list(all_counts(batch.text.tolist()))
            base = np.array([b for b, _ in made], np.int64).reshape(-1, len(COUNTS))
            yield pd.DataFrame({"doc_id": batch.doc_id, **{c: base[:, i] for i, c in enumerate(COUNTS)}, "stats": [s for _, s in made]})

    made = rows.mapInPandas(run, "doc_id string, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", stats array<double>")
    return made.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def base_failed(n_words, n_repeat_words):
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """``labels``: doc_id and quality of the rows that may be learned from. The statistics of at most ``sample`` documents reach the driver."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality").where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = sampled(known, F.col("doc_id"), sample)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    rows = statistics(texts).join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "stats").limit(sample).select("stats", "quality").collect()
    x, y = np.array([r.stats for r in rows], float).reshape(-1, len(FEATURES)), np.array([r.quality for r in rows], float)
    return grow(x, y, np.array([-1 if f in FALLING else 0 for f in FEATURES]))


def judge(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(stats: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.stack(stats.to_numpy())) if len(stats) else [], dtype=float)

    judged = statistics(docs).withColumn("score", score("stats")).withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    verdict = F.col("score") >= THRESHOLD if len(model.root) else F.lit(True)
    return judged.select("doc_id", *COUNTS, "base_failed", "score", (~F.col("base_failed") & verdict).alias("kept"))


def op13_monotone_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    # The rows that are held out are those of the quality classifier.
    learned = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    return judge(docs, train(docs, learned))
