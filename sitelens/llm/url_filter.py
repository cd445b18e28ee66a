"""URL filter: suffix and path rules, then gradient-boosted trees on lexical features.

The main path is SQL expressions alone. Trees are grown on the driver over a sample of at most
``SAMPLE`` labelled URLs (an operator parameter) and applied as nested CASE expressions.

A null url, or one without ``://``, has empty host and path and is judged by the trees.
Repeated rows are judged each for itself; an empty table gives no rows; a table without labelled
rows of both kinds is judged by the prior alone. Only page_id and url are read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import sampled, table

RULES = (
    ("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"), ("org", "/es/", "block"),
)
SAMPLE, ROUNDS, DEPTH, RATE = 4000, 30, 3, 0.3
FEATURES = ("length", "depth", "digits", "entropy", "params", "hyphens", "labels", "suffix")


def parts(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def match(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule and its verdict; the longest rule that fits wins."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.char_length(text)

    def term(total, c):
        p = (n - F.char_length(F.replace(text, c, F.lit("")))) / n
        return total - p * F.log2(p)

    kinds = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.when(n > 0, F.aggregate(kinds, F.lit(0.0), term)).otherwise(0.0)


def features(url: Column, host: Column, path: Column, rates: dict[str, float], prior: float) -> list[Column]:
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.char_length(u), F.lit(1))
    table_of = F.create_map(*[F.lit(x) for kv in rates.items() for x in kv]) if rates else None
    suffix = F.substring_index(host, ".", -1)
    rate = F.coalesce(F.element_at(table_of, suffix), F.lit(prior)) if rates else F.lit(prior)
    return [
        F.char_length(u).cast("double"), F.regexp_count(path, F.lit("/[^/]")).cast("double"),
        F.regexp_count(u, F.lit("[0-9]")) / n, entropy(u),
        F.when(F.contains(u, F.lit("?")), F.regexp_count(u, F.lit("[?&]"))).otherwise(0).cast("double"),
        F.regexp_count(u, F.lit("-")).cast("double"), F.regexp_count(host, F.lit("[.]")).cast("double"), rate,
    ]


def grow(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, depth: int):
    """A regression tree on second-order statistics: (feature, threshold, left, right) or a value."""
    value = float(gradient.sum() / (weight.sum() + 1.0))
    best = (1e-6, None, None)
    if depth and len(x) >= 20:
        whole = gradient.sum() ** 2 / (weight.sum() + 1.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, g, h = x[order, f], gradient[order].cumsum(), weight[order].cumsum()
            at = np.flatnonzero(v[1:] > v[:-1])
            at = at[(at >= 4) & (at < len(v) - 5)]
            if len(at):
                gain = g[at] ** 2 / (h[at] + 1) + (g[-1] - g[at]) ** 2 / (h[-1] - h[at] + 1) - whole
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], f, float((v[at[i]] + v[at[i] + 1]) / 2))
    if best[1] is None:
        return value
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow(x[left], gradient[left], weight[left], depth - 1), grow(x[~left], gradient[~left], weight[~left], depth - 1))


def predict(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], predict(tree[2], x), predict(tree[3], x))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> tuple[float, list]:
    p = (y.sum() + 1) / (len(y) + 2)
    prior = math.log(p / (1 - p))
    trees, margin = [], np.full(len(y), prior)
    if 0 < y.sum() < len(y):
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-margin))
            trees.append(grow(x, y - q, q * (1 - q), depth))
            margin += rate * predict(trees[-1], x)
    return prior, trees


def as_sql(tree, names: list[str]) -> str:
    if isinstance(tree, float):
        return f"{tree!r}D"
    return f"CASE WHEN {names[tree[0]]} <= {tree[1]!r}D THEN {as_sql(tree[2], names)} ELSE {as_sql(tree[3], names)} END"


def judge(pages: DataFrame, labelled: DataFrame, sample: int = SAMPLE, rules=RULES) -> DataFrame:
    """``labelled`` has page_id, url and blocked (0 or 1). Gives page_id, host, path, rule, verdict, block_margin."""
    lhost, lpath = parts(F.col("url"))
    known = (
        labelled.select("page_id", "url", lhost.alias("host"), lpath.alias("path"), F.col("blocked").cast("double").alias("blocked"))
        .where("blocked is not null")
    )
    seen = sampled(known, F.struct("page_id", "url"), sample)
    # Suffix statistics, bounded by the sample.
    rows = seen.select(F.substring_index("host", ".", -1).alias("suffix"), "blocked", *[c.alias(f"f{i}") for i, c in enumerate(features(F.col("url"), F.col("host"), F.col("path"), {}, 0.0))]).collect()
    y = np.array([r.blocked for r in rows])
    prior = float((y.sum() + 1) / (len(y) + 2))
    count: dict[str, list[float]] = {}
    for r in rows:
        pair = count.setdefault(r.suffix, [0.0, 0.0])
        pair[0] += r.blocked
        pair[1] += 1
    rates = {s: (b + 5 * prior) / (n + 5) for s, (b, n) in sorted(count.items())}
    x = np.array([[*r[2:-1], rates[r.suffix]] for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    base, trees = boost(x, y)
    host, path = parts(F.col("url"))
    names = [f"_f_{n}" for n in FEATURES]
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    known = split.select("page_id", "host", "path", *[c.alias(n) for n, c in zip(names, features(F.col("url"), F.col("host"), F.col("path"), rates, prior), strict=True)])
    margin = F.expr(" + ".join([f"{base!r}D", *[f"{RATE!r}D * ({as_sql(t, names)})" for t in trees]]))
    rule, verdict = match(F.col("host"), F.col("path"), rules)
    model = F.when(F.col("block_margin") > 0, "block").otherwise("allow")
    return known.withColumn("block_margin", margin).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, model).alias("verdict"), "block_margin")


def op9_url_boosting(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = parts(F.col("url"))
    _, verdict = match(host, path)
    labelled = pages.select("page_id", "url", verdict.alias("v")).where("v is not null").select("page_id", "url", (F.col("v") == "block").cast("int").alias("blocked"))
    return judge(pages, labelled)
