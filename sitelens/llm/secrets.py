"""Secret scan: a random forest removes false positives among candidate strings.

Candidates are runs of key characters of ``LEAST`` or more. The forest sees their length, how
usual their character transitions are, how much of them words of the dictionary cover, whether
their path is one of tests or examples, and the words beside them. It is trained from
labelled findings (candidate, before, path, label); ``synthetic_findings`` makes a fixed set
where a user has none. Transitions and dictionary come from the findings labelled false and from
the words of all whole texts, counted by Spark; a word counts that stands there ``OFTEN`` times, and as often in every
``A_SHARE`` texts. So the dictionary grows with the length of texts, not with their number.

Nulls and empty texts have no candidates. Texts of any length are scanned whole. Repeated rows are
scanned alike, an empty table gives no rows. The path is the column ``source``, null for none.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import finished_shuffles_go, memory_goes_back, table

LEAST, TREES, TREE_DEPTH, THRESHOLD, MASK = 16, 40, 7, 0.5, "<SECRET>"
A_SHARE, OFTEN, LONGEST = 1000, 3, 16
#: A candidate may start after '=' (KEY=value); a '=' that a value follows is no padding.
_CANDIDATE = regex.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{%d,}(?:={1,2}(?![A-Za-z0-9_+/=-]))?" % LEAST)
_PIECE = regex.compile(r"[A-Za-z]{3,}")
_KEYS = regex.compile(r"(?i)\b(?:token|secret|passw(?:or)?d|pwd|api|key|auth|bearer|credential|access)\b|_key|_token|secret_")
_TESTS = regex.compile(r"(?i)test|example|sample|mock|fixture|docs?\b")


@dataclass(frozen=True)
class Finding:
    candidate: str
    before: str = ""
    path: str = ""
    secret: int = 0


def synthetic_findings(n: int = 1500, seed: int = 11) -> list[Finding]:
    """Labelled findings of the usual kinds, half of them secrets."""
    rng = np.random.default_rng(seed)
    syllables = "the er ing on an re ha at en nd st es or ti ed is it al ar le eau oi ment que ción la de ra el un ge sch ung ver".split()
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]

    onsets, ends = "b bl br c ch cl d dr f fl g gr h k l m n p pf pl qu r s sch sh st t th tr tz v w wh z".split(), "a e i o u ai au ea ei ie oi ou an en in on er es nt ng ble".split()

    def word() -> str:
        if rng.random() < 0.5:
            return "".join(str(rng.choice(onsets)) + str(rng.choice(ends)) for _ in range(rng.integers(2, 4)))
        return "".join(rng.choice(syllables, rng.integers(2, 5))).encode("ascii", "ignore").decode()

    def text(k: int) -> str:
        return " ".join(word() for _ in range(k))

    out = []
    for i in range(n):
        path = str(rng.choice(["src/main", "config", "src0", "tests/unit", "docs/example", ""]))
        if i % 2:
            letters = alphabets[rng.integers(len(alphabets))]
            body = "".join(rng.choice(list(letters), rng.integers(20, 65)))
            body = str(rng.choice(["", "", "", "AKIA", "ghp_", "sk-"])) + body
            hint = str(rng.choice(["token = \"", "secret: ", "password=", "api_key = '", "key: ", "Authorization: Bearer "]))
            out.append(Finding(body, f"{text(3)} {hint}" if rng.random() < 0.85 else text(4), path, 1))
            continue
        kind = rng.integers(9)
        body = [
            lambda: "".join(word() for _ in range(4)),
            lambda: "_".join(word() for _ in range(4)),
            lambda: "/".join(word() for _ in range(4)),
            lambda: "-".join(word() for _ in range(4)).upper(),
            lambda: "".join(rng.choice(list("0123456789"), rng.integers(16, 20))),
            lambda: "".join(word() for _ in range(3)).capitalize(),
            lambda: "".join(word() for _ in range(3)).upper(),
            lambda: "".join(str(rng.choice(onsets)) for _ in range(12)),
            lambda: str(rng.choice(list("x0-*=_a"))) * int(rng.integers(16, 40)),
        ][kind]()
        hint = str(rng.choice(["token = ", "key: ", "password="])) if rng.random() < 0.15 else ""
        out.append(Finding(body, f"{text(4)} {hint}", path, 0))
    return [f for f in out if len(f.candidate) >= LEAST]


@dataclass
class Forest:
    trees: list = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = TREE_DEPTH, seed: int = 5) -> Forest:
        rng = np.random.default_rng(seed)

        def grow(rows: np.ndarray, left: int):
            mean = float(y[rows].mean())
            if not left or len(rows) < 6 or mean in (0.0, 1.0):
                return mean
            best = (0.0, None, None)
            for f in rng.permutation(x.shape[1])[: int(np.ceil(np.sqrt(x.shape[1])))]:
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, s = x[order, f], y[order].cumsum()
                at = np.flatnonzero(v[1:] > v[:-1])
                if len(at):
                    k, n = at + 1.0, float(len(order))
                    gain = s[at] ** 2 / k + (s[-1] - s[at]) ** 2 / (n - k) - s[-1] ** 2 / n
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (gain[i], int(f), float((v[at[i]] + v[at[i] + 1]) / 2))
            if best[1] is None:
                return mean
            low = x[rows, best[1]] <= best[2]
            return best[1], best[2], grow(rows[low], left - 1), grow(rows[~low], left - 1)

        return cls([grow(rng.integers(0, len(y), len(y)), depth) for _ in range(trees)])

    def predict(self, x: np.ndarray) -> np.ndarray:
        def walk(tree, rows, out):
            if isinstance(tree, float):
                out[rows] += tree
            elif len(rows):
                low = x[rows, tree[0]] <= tree[1]
                walk(tree[2], rows[low], out)
                walk(tree[3], rows[~low], out)

        out = np.zeros(len(x))
        for tree in self.trees:
            walk(tree, np.arange(len(x)), out)
        return out / max(1, len(self.trees))


class Scanner:
    """Features and forest, trained from labelled findings."""

    def __init__(self, findings: list[Finding], texts: list[str] = (), usual: set[str] | None = None):
        """The dictionary is ``usual`` where that is given, else what stands often in ``texts``."""
        plain = [f for f in findings if not f.secret]
        seen = Counter(w for t in texts for w in _PIECE.findall(t.lower()) if len(w) <= LONGEST)
        self.dictionary = {w for w, n in seen.items() if n >= OFTEN} if usual is None else usual
        self.pairs = np.ones((128, 128))
        self.words: set[str] = set()
        for f in plain:
            for text in (f.candidate, f.before):
                b = np.frombuffer(text.lower().encode("ascii", "ignore"), np.uint8)
                np.add.at(self.pairs, (b[:-1], b[1:]), 1)
                self.words.update(w[:n] for w in _PIECE.findall(text.lower()) for n in (3, 4, 5))
        for w in sorted(self.dictionary):
            b = np.frombuffer(w.encode("ascii"), np.uint8)
            np.add.at(self.pairs, (b[:-1], b[1:]), 1)
        self.pairs = np.log(self.pairs / self.pairs.sum(1, keepdims=True))
        x = self.features([(f.candidate, f.before, f.path) for f in findings])
        self.forest = Forest.fit(x, np.array([f.secret for f in findings], float))

    def covered(self, text: str) -> float:
        low, at, total = text.lower(), 0, 0
        while at < len(low):
            most = min(LONGEST, len(low) - at)
            n = next((n for n in range(most, 2, -1) if low[at : at + n] in (self.dictionary if n > 5 else self.words)), 0)
            total += n
            at += n or 1
        return total / len(low)

    def features(self, rows: list[tuple[str, str, str]]) -> np.ndarray:
        out = np.zeros((len(rows), 10))
        for i, (text, before, path) in enumerate(rows):
            b = np.frombuffer(text.lower().encode("ascii", "ignore"), np.uint8)
            share = np.bincount(b, minlength=128) / len(b)
            share = share[share > 0]
            out[i] = (
                len(text), self.pairs[b[:-1], b[1:]].mean(), self.covered(text), -(share * np.log2(share)).sum(), sum(c.isdigit() for c in text) / len(text),
                sum(c.isupper() for c in text) / len(text), sum(c in "_-/+" for c in text) / len(text), bool(_KEYS.search(before)), before.rstrip(" \"'").endswith(("=", ":")), bool(_TESTS.search(path)),
            )
        return out

    def find(self, text: str, path: str = "") -> list[tuple[int, int, str, float]]:
        """Start, end, candidate and probability of each candidate."""
        spots = [(m.start(), m.end(), m.group()) for m in _CANDIDATE.finditer(text)]
        if not spots:
            return []
        p = self.forest.predict(self.features([(c, text[max(0, a - 40) : a], path) for a, _, c in spots]))
        return [(*s, float(q)) for s, q in zip(spots, p, strict=True)]

    def redact(self, text: str, path: str = "", threshold: float = THRESHOLD) -> tuple[str, int, int]:
        """The text without its secrets, the number of candidates and of secrets."""
        found = self.find(text, path)
        gone = [f for f in found if f[3] >= threshold]
        out, at = [], 0
        for a, b, *_ in gone:
            out += [text[at:a], MASK]
            at = b
        return "".join([*out, text[at:]]), len(found), len(gone)


def usual_words(docs: DataFrame) -> set[str]:
    """Words of three to ``LONGEST`` letters that are usual in all whole texts; at most texts' mean number of words times A_SHARE / OFTEN."""
    with finished_shuffles_go(docs.sparkSession):
        texts = docs.where("text IS NOT NULL").count()
        least = max(OFTEN, math.ceil(OFTEN * texts / A_SHARE))
        pieces = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where(F.char_length("w").between(3, LONGEST))
        return {r.w for r in pieces.groupBy("w").count().where(F.col("count") >= least).select("w").collect()}


def scan(docs: DataFrame, findings: list[Finding] | None = None, name: str = "scan") -> DataFrame:
    """``docs`` with a column of the redacted text, n_candidates and n_secrets; null stays null."""
    scanner = Scanner(synthetic_findings() if findings is None else findings, usual=usual_words(docs))
    shared = docs.sparkSession.sparkContext.broadcast(scanner)

    @F.pandas_udf("text string, n_candidates bigint, n_secrets bigint")
    def of(texts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        rows = [shared.value.redact(t, p) for t, p in zip(texts, paths, strict=True)]
        memory_goes_back()
        return pd.DataFrame(rows, columns=["text", "n_candidates", "n_secrets"])

    path = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    return docs.withColumn(name, of(F.coalesce("text", F.lit("")), path))


def op4_secret_forest(spark, sf_dir):
    scanned = scan(table(spark, sf_dir, "documents"))
    return scanned.select(F.col("doc_id").cast("bigint").alias("doc_id"), "scan.n_candidates", "scan.n_secrets", F.sha2(F.col("scan.text"), 256).alias("redacted_sha256"))
