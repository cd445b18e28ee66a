"""Spelling variants: a trie self-join with active-node sets over the vocabulary of all texts.

Occurrences are counted by Spark. Near words differ in one place, so all but one segment of the two is
equal: every word goes to the groups of its segments, keyed by what lies before and after the segment.
The first groups are those of equal first halves, prefix partitions of the vocabulary's trie, and of
equal last halves, the same for the trie read backwards. A group above ``LIMIT`` characters is dealt
out again by the halves of its segment, until it is small or its segment is one character, when it has
at most one word for each letter; so no task holds a group that grows with the data.

Inside a group the segments form a trie that is walked level by level. At each level there are the
active pairs of nodes: equal prefixes, prefixes with one other letter, prefixes with one letter more.
The next level's come from these by equal letters, or by the one step that a pair of equal prefixes
may still take. Pairs of last nodes are the near words, each pair once.

A null text has no words; a null doc_id is written as nothing before the colon. Repeated rows count
each. Words of any length take part. Ties between forms go to the smaller word in code-point order.
An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import Scratch, table

RUN = r"([A-Za-zÀ-ÿ]+)"
EVERY, LEAST_LENGTH, LEAST_COUNT, TIMES = 97, 5, 3, 2
#: Characters of all segments of a group above which it is dealt out again.
LIMIT = 8192
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GROUP = ["base", "at", "to", "rest"]
_PAIRS = "word string, near string, near_n bigint"


def lowered(run: Column) -> Column:
    return F.translate(run, _UPPER, _LOWER)


def written(doc_id: Column, run: Column, every: int = EVERY) -> Column:
    """The run as it counts: one of ``every``, by a hash of document and run, lacks a letter."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    place = (h % F.char_length(run)).cast("int")
    short = F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.char_length(run)))
    return F.when(h % every == 0, short).otherwise(run)


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: how often each word occurs in all texts."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(1))).alias("run"))
    words = runs.select("doc_id", lowered(F.col("run")).alias("run")).select(written(F.col("doc_id"), F.col("run")).alias("word"))
    counted = words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


def _placed(words: DataFrame, at: Column, to: Column) -> DataFrame:
    """Rows with their segment [at, to) of ``base`` letters and all that is outside; a long word has one letter more in it."""
    end = to + F.col("long").cast("int")
    rest = F.concat(F.substring("word", F.lit(1), at), F.lit("|"), F.substring("word", end + 1, F.char_length("word")))
    return words.select("word", "n", "long", "base", at.alias("at"), to.alias("to"), rest.alias("rest"))


def _halves(rows: DataFrame) -> DataFrame:
    middle = F.col("at") + F.floor((F.col("to") - F.col("at")) / 2).cast("int")
    cut = F.explode(F.array(F.struct(F.col("at").alias("at"), middle.alias("to")), F.struct(middle.alias("at"), F.col("to").alias("to"))))
    dealt = rows.select("word", "n", "long", "base", cut.alias("cut"))
    return _placed(dealt, F.col("cut.at"), F.col("cut.to"))


def grouped(vocab: DataFrame, scratch: Scratch, limit: int = LIMIT) -> DataFrame:
    """Rows (word, n, long, base, at, to, rest) of groups that are small or whose segment is one letter."""
    size = F.char_length("word")
    kinds = F.explode(F.array(F.struct(F.lit(False).alias("long"), size.alias("base")), F.struct(F.lit(True).alias("long"), (size - 1).alias("base"))))
    rows = vocab.select("word", "n", kinds.alias("kind")).select("word", "n", "kind.long", "kind.base").where("base > 0")
    rows = _halves(rows.withColumns({"at": F.lit(0), "to": F.col("base")}))
    small = []
    while True:
        weight = F.sum((F.col("to") - F.col("at")).cast("bigint"))
        large = scratch.cut(rows.where(F.col("to") - F.col("at") > 1).groupBy(*_GROUP).agg(weight.alias("weight")).where(F.col("weight") > limit).select(*_GROUP))
        if large.isEmpty():
            scratch.drop(large)
            break
        small.append(rows.join(large, _GROUP, "left_anti"))
        rows = _halves(rows.join(large, _GROUP, "left_semi"))
    for part in small:
        rows = rows.unionByName(part)
    return rows


class Trie:
    """Nodes of sorted segments of equal width, level by level, below the roots of their groups."""

    def __init__(self, letters: np.ndarray, root: np.ndarray, roots: int):
        """``letters``: rows x width; ``root``: each row's group. Of each level: key (parent and letter), parent, letter, first child of each parent."""
        rows, width = letters.shape
        self.levels = []
        node, parents = root, roots
        start = np.ones(rows, bool)
        start[1:] = root[1:] != root[:-1]
        for d in range(width):
            column = letters[:, d]
            start = start.copy()
            start[1:] |= column[1:] != column[:-1]
            parent, letter = node[start], column[start].astype(np.int64)
            self.levels.append((parent * 256 + letter, parent, letter, np.searchsorted(parent, np.arange(parents + 1))))
            node, parents = np.cumsum(start) - 1, len(parent)

    def children(self, d: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into ``nodes`` and child, for every child of nodes of depth ``d``."""
        first = self.levels[d][3]
        many = first[nodes + 1] - first[nodes]
        which = np.repeat(np.arange(len(nodes)), many)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        return which, first[nodes][which] + inside

    def siblings(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children of one node of depth ``d``, the smaller first."""
        _, parent, _, first = self.levels[d]
        node = np.arange(len(parent))
        many = first[parent + 1] - node - 1
        left = np.repeat(node, many)
        return left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)


def _together(one: Trie, d: int, u: np.ndarray, two: Trie, e: int, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs (u of depth d, v of depth e): pairs of their children by one letter, and which pair each came from."""
    which, child = one.children(d, u)
    key = two.levels[e][0]
    want = v[which] * 256 + one.levels[d][2][child]
    at = np.searchsorted(key, want)
    met = at < len(key)
    met[met] = key[at[met]] == want[met]
    return child[met], at[met], which[met]


def near_rows(shorts: np.ndarray, short_root: np.ndarray, longs: np.ndarray, long_root: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of ``shorts`` with one other letter, and (short, long) pairs with one letter more.

    Rows are sorted by group and letters; ``last`` says of each group whether its segment ends the word,
    the only one where a letter after the whole segment counts, as the next segment's group has it else.
    """
    width, none = shorts.shape[1], np.empty(0, np.int64)
    s, more = Trie(shorts, short_root, len(last)), Trie(longs, long_root, len(last))
    changed = (none, none)
    equal = (np.arange(len(last)), np.arange(len(last)))
    added = (none, none)
    for d in range(width + 1):
        which, child = more.children(d, equal[1])
        fresh = equal[0][which], child
        if d == width:
            break
        u, v, _ = _together(s, d, changed[0], s, d, changed[1])
        changed = tuple(np.concatenate(p) for p in zip((u, v), s.siblings(d), strict=True))
        u, v, _ = _together(s, d, added[0], more, d + 1, added[1])
        # The added letter once more would be the letter added one place later.
        fu, fv, source = _together(s, d, fresh[0], more, d + 1, fresh[1])
        other = s.levels[d][2][fu] != more.levels[d][2][fresh[1]][source]
        added = np.concatenate([u, fu[other]]), np.concatenate([v, fv[other]])
        equal = _together(s, d, equal[0], more, d, equal[1])[:2]
    ends = last[short_root[fresh[0]]] if len(fresh[0]) else np.empty(0, bool)
    return *changed, np.concatenate([added[0], fresh[0][ends]]), np.concatenate([added[1], fresh[1][ends]])


def _near_words(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """``rows`` of whole groups, sorted by group, kind and word."""
    new = np.ones(len(rows), bool)
    new[1:] = np.logical_or.reduce([rows[c].to_numpy()[1:] != rows[c].to_numpy()[:-1] for c in _GROUP])
    group, long = np.cumsum(new) - 1, rows.long.to_numpy(bool)
    short_n, long_n = (np.bincount(group[k], minlength=group[-1] + 1) for k in (~long, long))
    may = ((short_n >= 2) | ((short_n >= 1) & (long_n >= 1)))[group]
    rows, group, long = rows[may], group[may], long[may]
    width = (rows.to - rows["at"]).to_numpy()
    for w in np.unique(width):
        mine = width == w
        part, kind = rows[mine], long[mine]
        ids, root = np.unique(group[mine], return_inverse=True)
        last = np.zeros(len(ids), bool)
        last[root] = (part.to == part.base).to_numpy()
        word, n, at = part.word.to_numpy(), part.n.to_numpy(), part["at"].to_numpy()

        def letters(which: np.ndarray, size: int) -> np.ndarray:
            # All letters are below U+0100.
            cut = "".join([x[a : a + size] for x, a in zip(word[which], at[which], strict=True)])
            return np.frombuffer(cut.encode("latin-1"), np.uint8).reshape(-1, size)

        a, b, c, d = near_rows(letters(~kind, w), root[~kind], letters(kind, w + 1), root[kind], last)
        shorts, short_n, longs, long_n = word[~kind], n[~kind], word[kind], n[kind]
        yield pd.DataFrame({
            "word": np.concatenate([shorts[a], shorts[b], shorts[c], longs[d]]), "near": np.concatenate([shorts[b], shorts[a], longs[d], shorts[c]]),
            "near_n": np.concatenate([short_n[b], short_n[a], long_n[d], short_n[c]]),
        })


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Groups may reach over batches; the last of a batch waits for the next one."""
    waiting: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        values = [batch[c].to_numpy() for c in _GROUP]
        other = np.flatnonzero(np.logical_or.reduce([v != v[-1] for v in values]))
        whole = other[-1] + 1 if len(other) else 0
        if waiting and any(waiting[-1][c].iloc[-1] != v[0] for c, v in zip(_GROUP, values, strict=True)) or whole:
            yield from _near_words(pd.concat([*waiting, batch.iloc[:whole]], ignore_index=True))
            waiting = []
        waiting.append(batch.iloc[whole:])
    if waiting:
        yield from _near_words(pd.concat(waiting, ignore_index=True))


def near_pairs(vocab: DataFrame, scratch: Scratch, limit: int = LIMIT) -> DataFrame:
    """word, near, near_n: every ordered pair of words that differ by one letter, once."""
    rows = grouped(vocab, scratch, limit)
    return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "long", "word").mapInPandas(_walk, _PAIRS)


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``forms`` (word, form) to (word, root), the last word of the chain; each round doubles the steps taken.

    Every form is more frequent than its word, so chains end.
    """
    at = scratch.cut(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not at.where("moved").isEmpty():
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("far"))
        new = scratch.cut(at.drop("moved").join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        scratch.drop(at)
        at = new
    return at.select("word", "root")


def variants(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word of ``docs`` (doc_id, text)."""
    scratch = Scratch(docs.sparkSession)
    vocab = scratch.cut(vocabulary(docs.select("doc_id", "text")))
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    near = near_pairs(vocab, scratch, limit).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    fits = F.col("best.near_n") >= TIMES * F.col("n")
    judged = scratch.cut(vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, F.col("best.near_n")).alias("form_n"),
    ))
    chains = roots(judged.where("form IS NOT NULL"), scratch)
    return judged.join(chains, "word", "left").withColumn("root", F.coalesce("root", "word"))


#: The polynomial is that of the usual CRC-32, low bit first.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_BYTES = "flatten(list_transform(string_split({0}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)]::BIGINT[] END))"
_CRC = f"xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"
SQL = f"""WITH RECURSIVE r AS (SELECT doc_id, translate(w, '{_UPPER}', '{_LOWER}') AS w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY ALL),
 h AS (SELECT w, k, {_CRC.format("coalesce(doc_id::VARCHAR, '') || ':' || w")} AS h FROM r, (SELECT {_CRC_TABLE} AS crc)),
 v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % {EVERY} = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w) + 2)::INT) ELSE w END AS word, k FROM h) WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
 less AS MATERIALIZED (SELECT word, n, i, left(word, i) AS head, substr(word, i + 2) AS tail FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM v)),
 shorter AS (SELECT DISTINCT l.word AS a, l.n AS an, v.word AS b, v.n AS bn FROM less l JOIN v ON v.word = l.head || l.tail),
 near AS MATERIALIZED (SELECT a.word AS word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word UNION ALL SELECT a, b, bn FROM shorter UNION ALL SELECT b, a, an FROM shorter),
 best AS (SELECT word, count(*) AS n_near, arg_max({{'w': near, 'n': near_n}}, (near_n, -place)) AS b FROM (SELECT *, row_number() OVER (ORDER BY near COLLATE "C") AS place FROM near) GROUP BY word),
 judged AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= {TIMES} * v.n THEN b.w END AS form, CASE WHEN b.n >= {TIMES} * v.n THEN b.n END AS form_n FROM v LEFT JOIN best USING (word)),
 chain AS (SELECT word, word AS at FROM judged UNION ALL SELECT c.word, j.form FROM chain c JOIN judged j ON j.word = c.at WHERE j.form IS NOT NULL)
 SELECT j.word, j.form, c.at AS root, j.n, j.n_near, j.form_n FROM judged j JOIN chain c USING (word) JOIN judged e ON e.word = c.at WHERE e.form IS NULL"""


def op11_trie_variants(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return variants(docs).select("word", "form", "root", "n", "n_near", "form_n")
