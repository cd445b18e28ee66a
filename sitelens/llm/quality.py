"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are its own shape and that of the lines before and
after it. The field is fitted on a sample of labelled documents, whose lines all carry the
document's label; the sample is bounded by ``SAMPLE`` documents of at most ``SAMPLE_CHARS``
characters each, both parameters. Every whole text is scored: the forward-backward marginals,
weighted by line length, give the document's share of good lines, and a logistic curve fitted
on the sample turns it into a probability.

Nulls and empty texts are one empty line and get a score. Without labels of both kinds every
score is the prior. Repeated rows are scored alike. Only doc_id and text are read, and the
labels by doc_id; of several labels of one document the lowest counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import memory_goes_back, sampled, table

SAMPLE, SAMPLE_CHARS, STEPS, PENALTY = 3000, 20_000, 250, 1e-3
THRESHOLD = 0.7
_KINDS = 6


def _kinds() -> np.ndarray:
    """Classes of the code points up to the Latin blocks: letters, capitals, digits, spaces, stops, symbols."""
    out = np.zeros((0x250, _KINDS), np.int32)
    for i in range(0x250):
        c = chr(i)
        out[i] = c.isalpha(), c.isupper(), c.isdigit(), c.isspace(), c in ".,;:'?!\"", not (c.isalnum() or c.isspace() or c in ".,;:'?!\"")
    return out


_TABLE = _kinds()


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A row for each line of a text, and the lines' lengths."""
    lines = text.split("\n")
    points = np.frombuffer(f"{text}\n".encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.flatnonzero(points == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    counts = np.add.reduceat(_TABLE[np.minimum(points, 0x24F)], starts, axis=0).astype(float)
    length = (ends - starts).astype(float)
    n = np.maximum(length, 1)
    seen: set[str] = set()
    known: set[str] = set()
    more = np.zeros((len(lines), 5))
    for i, line in enumerate(lines):
        found = line.split()
        kinds = set(found)
        if found:
            more[i] = len(found), len(kinds) / len(found), len(kinds & known) / len(kinds), line in seen, max(map(len, found))
        known |= kinds
        seen.add(line)
    words = np.maximum(more[:, 0], 1)
    shape = [
        np.log1p(length), np.log1p(more[:, 0]), np.minimum(length / words, 30) / 10, counts[:, 0] / n, counts[:, 1] / n, counts[:, 2] / n,
        counts[:, 4] / n, counts[:, 5] / n, np.minimum(counts[:, 5] / words, 5), np.minimum(counts[:, 4] / words, 5), more[:, 1], more[:, 2], more[:, 3], np.log1p(more[:, 4]), length == 0,
    ]
    return np.column_stack(shape), length


def with_neighbours(own: np.ndarray) -> np.ndarray:
    edge = np.zeros((1, own.shape[1]))
    return np.column_stack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), np.ones(len(own))])


def marginals(unary: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(line is good) and the expected transitions of a padded batch (documents x lines)."""
    docs, most = unary.shape
    score = np.stack([np.zeros_like(unary), unary], axis=2)
    forward, backward = np.empty((docs, most, 2)), np.zeros((docs, most, 2))
    forward[:, 0] = score[:, 0]
    for t in range(1, most):
        forward[:, t] = np.logaddexp(forward[:, t - 1, :1] + transition[0], forward[:, t - 1, 1:] + transition[1]) + score[:, t]
    for t in range(most - 2, -1, -1):
        ahead = score[:, t + 1] + backward[:, t + 1]
        step = np.logaddexp(ahead[:, :1] + transition[:, 0], ahead[:, 1:] + transition[:, 1])
        backward[:, t] = np.where((t + 1 < lengths)[:, None], step, 0.0)
    total = forward + backward
    good = 1 / (1 + np.exp(np.clip(total[:, :, 0] - total[:, :, 1], -500, 500)))
    z = np.logaddexp(total[:, :1, 0], total[:, :1, 1])[:, :, None, None]
    moves = np.zeros((2, 2))
    if most > 1:
        pair = forward[:, :-1, :, None] + transition + (score + backward)[:, 1:, None, :] - z
        inside = (np.arange(1, most) < lengths[:, None])[:, :, None, None]
        moves = np.where(inside, np.exp(np.minimum(pair, 0)), 0).sum((0, 1))
    return good, moves


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), lengths.max(), *rows[0].shape[1:]))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, lengths


def blocks(sizes: list[int], most: int = 40_000) -> Iterator[list[int]]:
    """Documents of like length together, with a bound on the padded lines of a block."""
    block: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: sizes[i]):
        if block and sizes[i] * (len(block) + 1) > most:
            yield block
            block = []
        block.append(i)
    if block:
        yield block


class LineField:
    """The fitted field."""

    def __init__(self, mean, scale, weights, transition, curve):
        self.mean, self.scale, self.weights, self.transition, self.curve = mean, scale, weights, transition, curve

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], steps: int = STEPS, penalty: float = PENALTY) -> LineField:
        own = [line_features(t) for t in texts]
        if len(set(labels)) < 2:
            prior = (sum(labels) + 1) / (len(labels) + 2)
            size = line_features("")[0].shape[1]
            return cls(np.zeros(size), np.ones(size), np.zeros(3 * size + 1), np.zeros((2, 2)), (0.0, float(np.log(prior / (1 - prior)))))
        every = np.vstack([f for f, _ in own])
        mean, scale = every.mean(0), every.std(0) + 1e-6
        rows = [with_neighbours((f - mean) / scale) for f, _ in own]
        y = np.array(labels, float)
        batches = [(*padded([rows[i] for i in b]), y[b]) for b in blocks([len(r) for r in rows])]
        # A line weighs as its document's share, so that long documents do not rule the fit.
        theta, m, v = np.zeros(rows[0].shape[1] + 4), 0.0, 0.0
        for step in range(1, steps + 1):
            gradient = -penalty * len(y) * theta
            for x, lengths, label in batches:
                good, moves = marginals(x @ theta[:-4], lengths, theta[-4:].reshape(2, 2))
                inside = np.arange(x.shape[1]) < lengths[:, None]
                gradient[:-4] += np.einsum("dtf,dt->f", x, (label[:, None] - good) * inside)
                gradient[-1] += (label * (lengths - 1)).sum() - moves[1, 1]
                gradient[-4] += ((1 - label) * (lengths - 1)).sum() - moves[0, 0]
                gradient[-3:-1] -= [moves[0, 1], moves[1, 0]]
            gradient /= len(y)
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            theta += 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            theta[-4:] = np.clip(theta[-4:], -1, 1)  # neighbours persuade, they do not rule
        model = cls(mean, scale, theta[:-4], theta[-4:].reshape(2, 2), (1.0, 0.0))
        z = model.evidence(own)
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton's steps of the logistic curve
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            h = p * (1 - p) + 1e-9
            g = np.array([((y - p) * z).sum() - 0.1 * a, (y - p).sum()])
            hess = np.array([[(h * z * z).sum() + 0.1, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
            a, b = np.array([a, b]) + np.clip(np.linalg.solve(hess, g), -1, 1)
        model.curve = (float(a), float(b))
        return model

    def evidence(self, own: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Log odds of the length-weighted share of good lines."""
        out = np.zeros(len(own))
        rows = [with_neighbours((f - self.mean) / self.scale) for f, _ in own]
        for block in blocks([len(r) for r in rows]):
            unary, lengths = padded([rows[i] @ self.weights for i in block])
            good, _ = marginals(unary, lengths, self.transition)
            for i, k, p in zip(block, lengths, good, strict=True):
                weight = own[i][1] + 1e-3
                share = float((p[:k] * weight).sum() / weight.sum())
                out[i] = np.log((share + 1e-6) / (1 - share + 1e-6))
        return out

    def score(self, texts: list[str], chars: int = 4_000_000) -> np.ndarray:
        """Features are held for texts of about ``chars`` characters, or one longer text, at a time."""
        z, at = np.zeros(len(texts)), 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= chars:
                size += len(texts[end])
                end += 1
            z[at:end] = self.curve[0] * self.evidence([line_features(t) for t in texts[at:end]]) + self.curve[1]
            at = end
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def remainder(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> LineField:
    """``labels``: doc_id and quality; only rows that are not held out may be given."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality").where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # More than the bound, as some of the documents are longer than the sample takes or absent.
    chosen = sampled(known, F.col("doc_id"), sample + sample // 2)
    short = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.char_length(F.coalesce("text", F.lit(""))) <= chars)
    rows = short.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample).collect()
    return LineField.fit([r.text or "" for r in rows], [int(r.quality) for r in rows])


def score(docs: DataFrame, model: LineField, name: str = "score") -> DataFrame:
    """``docs`` with the score of each row's whole text as column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        out = pd.Series(shared.value.score(texts.tolist()) if len(texts) else [], dtype=float)
        memory_goes_back()
        return out

    return docs.withColumn(name, of(F.coalesce("text", F.lit(""))))


def trained(spark, docs: DataFrame, sf_dir: str) -> LineField:
    labels = table(spark, sf_dir, "labels").where(remainder(F.col("doc_id")) != 2)
    return train(docs, labels)


def op3_line_field_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), trained(spark, docs, sf_dir))
    held_out = F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
