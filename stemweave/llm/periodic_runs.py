"""Periodic runs of the words of a text: maximal stretches that repeat with some smallest period.

Every run has a Lyndon root: the longest Lyndon word that begins at some place inside it, in the alphabet's order or in
the reversed one.  So the candidates are, for each place and either order, the way to the next smaller suffix, at most
two a word.  Ukkonen suffix trees of the sequence and of its reversal are walked once each: the order of the leaves gives the
next smaller suffixes, and the least depths between leaves of the Euler tour, in a sparse table, answer any longest common
extension (the depth of the lowest common ancestor of two leaves) in constant time.  A candidate is extended both ways by one such
query in each tree, all candidates of a stretch at once.

A screen comes first, so that trees are built only where a run can be: in a run of at least ``m`` words and at least three periods, every
``m // 3`` consecutive words occur twice in the text.  A run lies whole in a maximal stretch of such places, and nothing outside the stretch
bears on it; stretches shorter than ``m`` hold none.  Of most texts nothing is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import EXACT, free, mix, release, slices, table, text_buffers, word_hashes

RUN = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())])


# --------------------------------------------------------------------------- suffix trees


class SuffixTree:
    """The suffix tree of a list of numbers from 1 on, by Ukkonen's construction; 0 is put behind them as the end.

    Nodes below ``leaves`` are leaves (leaf i is the suffix at i), the others inner ones; the first inner one is the root.
    ``begin`` is where the label of a node's edge begins, ``children`` maps the first number of an edge to its node.
    """

    def __init__(self, numbers: list[int]):
        text = [*numbers, 0]
        n = self.leaves = len(text)
        self.text = text
        children: list[dict[int, int]] = [{}]
        begin = list(range(n)) + [0]
        stop = [n] * n + [0]  # labels of leaves grow to the end of the text by themselves
        link = [0]
        node, edge, length, pending = n, 0, 0, 0  # the active point, and the suffixes not yet in the tree
        for i, c in enumerate(text):
            pending += 1
            waiting = 0  # the inner node made last, that has no link yet
            while pending:
                if not length:
                    edge = i
                inside = children[node - n]
                first = text[edge]
                to = inside.get(first)
                if to is None:
                    leaf = i - pending + 1
                    begin[leaf] = i
                    inside[first] = leaf
                    if waiting:
                        link[waiting - n] = node
                        waiting = 0
                else:
                    at = begin[to]
                    label = stop[to] - at if to >= n else i + 1 - at
                    if length >= label:  # down over a whole edge
                        edge += label
                        length -= label
                        node = to
                        continue
                    if text[at + length] == c:
                        length += 1
                        if waiting:
                            link[waiting - n] = node
                        break
                    leaf, fork = i - pending + 1, n + len(children)
                    begin.append(at)
                    stop.append(at + length)
                    begin[leaf] = i
                    begin[to] = at + length
                    inside[first] = fork
                    children.append({c: leaf, text[at + length]: to})
                    link.append(n)
                    if waiting:
                        link[waiting - n] = fork
                    waiting = fork
                pending -= 1
                if node == n:
                    if length:
                        length -= 1
                        edge = i - pending + 1
                else:
                    node = link[node - n] or n
        self.begin, self.stop, self.children = begin, stop, children

    def tour(self) -> tuple[np.ndarray, np.ndarray]:
        """The leaves in the order of the Euler tour (children by their first number), and for each the least depth met since the leaf before."""
        n, begin, stop, children = self.leaves, self.begin, self.stop, self.children
        order, least = [], []
        stack = [(n, 0)]
        low = 0
        while stack:
            node, depth = stack.pop()
            if node < 0:  # back at the parent
                if depth < low:
                    low = depth
            elif node < n:
                order.append(node)
                least.append(low)
                low = n
            else:
                inside = children[node - n]
                for k, c in enumerate(sorted(inside, reverse=True)):
                    to = inside[c]
                    if k:
                        stack.append((-1, depth))
                    stack.append((to, depth + stop[to] - begin[to]))
        return np.array(order, np.int64), np.array(least, np.int64)

    def leaves_reversed(self) -> np.ndarray:
        """The leaves with the numbers in reversed order, and the end still the smallest."""
        n, children = self.leaves, self.children
        order, stack = [], [n]
        while stack:
            node = stack.pop()
            if node < n:
                order.append(node)
            else:
                inside = children[node - n]
                found = [inside[c] for c in sorted(inside) if c]
                stack += found + ([inside[0]] if 0 in inside else [])
        return np.array(order, np.int64)


class Extensions:
    """Longest common extensions of the suffixes of a sequence: range minima over the Euler tour between two leaves."""

    def __init__(self, order: np.ndarray, least: np.ndarray):
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.rows = [least.astype(np.int32)]
        while 2 << (len(self.rows) - 1) <= len(least):
            last, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers the suffixes at ``a`` and at ``b`` (another place each) have in common from their beginning."""
        x, y = self.rank[a], self.rank[b]
        x, y = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp((y - x).astype(float))[1] - 1
        out = np.empty(len(x), np.int64)
        for k in np.unique(level):
            m = level == k
            row = self.rows[k]
            out[m] = np.minimum(row[x[m]], row[y[m] - (1 << k)])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller rank; the last place has none, and itself stands for it."""
    ranks = rank.tolist()
    out = [len(ranks) - 1] * len(ranks)
    stack: list[int] = []
    for i, r in enumerate(ranks):
        while stack and ranks[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def sequence_runs(numbers: np.ndarray, least_words: int, exponent: int) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of at least ``least_words`` numbers and ``exponent`` (two or more) periods, by start and period.

    ``numbers`` are from 1 on.
    """
    n = len(numbers)
    forward = SuffixTree(numbers.tolist())
    order, least = forward.tour()
    right = Extensions(order, least)
    other = np.empty(n + 1, np.int64)
    other[forward.leaves_reversed()] = np.arange(n + 1)
    del forward
    at = np.arange(n)
    pairs = np.unique(np.concatenate([at * (n + 1) + next_smaller(rank)[:n] for rank in (right.rank, other)]))
    i, j = pairs // (n + 1), pairs % (n + 1)
    fits = (j - i) * exponent <= n
    i, j = i[fits], j[fits]
    period, after = j - i, right(i, j)
    left = Extensions(*SuffixTree(numbers[::-1].tolist()).tour())
    before = left(n - i, n - j)  # the reversal's suffixes that begin before i and before j
    length = before + period + after
    good = (length >= least_words) & (length >= exponent * period)
    return sorted(set(zip((i - before)[good].tolist(), length[good].tolist(), period[good].tolist())), key=lambda r: (r[0], r[2]))


# --------------------------------------------------------------------------- texts


def _repeating(h: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Which words belong to ``width`` consecutive words of their text that occur twice in it; texts begin at the words ``first``."""
    n = len(h)
    out = np.zeros(n, bool)
    if n < width:
        return out
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    gram = mix(text.astype(np.uint64))[: n - width + 1]
    for k in range(width):
        gram = mix(gram * np.uint64(0x9E3779B97F4A7C15) + h[k : n - width + 1 + k])
    inside = np.flatnonzero(text[: n - width + 1] == text[width - 1 :])
    order = np.argsort(gram[inside])
    sorted_ = gram[inside][order]
    same = sorted_[1:] == sorted_[:-1]
    twice = np.zeros(len(inside), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    ends = np.zeros(n + 1, np.int64)
    np.add.at(ends, inside[twice], 1)
    np.add.at(ends, inside[twice] + width, -1)
    return np.cumsum(ends[:-1]) > 0


def text_runs(h: np.ndarray, first: np.ndarray, least_words: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, whose words have the hashes ``h``."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in first[1:]]
    marked = _repeating(h, first, max(1, least_words // 3))
    if not marked.any():
        return out
    edge = np.zeros(len(h) + 1, bool)
    edge[first] = True
    before = np.concatenate(([False], marked[:-1]))
    starts = np.flatnonzero(marked & (~before | edge[:-1]))
    after = np.concatenate((marked[1:], [False]))
    stops = np.flatnonzero(marked & (~after | edge[1:])) + 1
    long = stops - starts >= least_words
    for a, b in zip(starts[long].tolist(), stops[long].tolist()):
        t = int(np.searchsorted(first, a, "right")) - 1
        numbers = np.unique(h[a:b], return_inverse=True)[1] + 1
        out[t] += [(a - int(first[t]) + s, length, p) for s, length, p in sequence_runs(numbers, least_words, exponent)]
    return out


def collapse_runs(docs: DataFrame, text_col: str = "text", least_words: int = 24, exponent: int = 3) -> DataFrame:
    """``docs`` with its columns, plus ``n_words``, ``runs`` and ``collapsed``.

    Words are what ASCII white space separates.  ``runs`` holds ``(start, length, period)`` of every run of at least ``least_words`` words and
    ``exponent`` periods (two or more, and three at least for the screen), by start, then period; ``collapsed`` the words that no run contains after its first
    period, joined by one blank.  A null or blank text has no words, no runs and an empty ``collapsed``.  Every row stands for itself, so
    rows with equal or null ids need no rule.  Columns of ``docs`` that have the names of the new ones stay, and the new ones
    get underscores behind theirs.  A text is searched by one task, with about 1 kB for each word of its repeating stretches.
    """
    if exponent < 3 or least_words < 3:
        raise ValueError("the screen needs runs of three periods and three words at least")
    names = docs.columns
    text = names.index(text_col)
    made = [free(n, names) for n in ("n_words", "runs", "collapsed")]

    def run(batches):
        for batch in batches:
            for part in slices(batch, column=text):
                buf, off = text_buffers(part.column(text))
                h, start, end, first = word_hashes(buf, off, letters=EXACT)
                found = text_runs(h, first, least_words, exponent)
                kept = []
                for t, runs in enumerate(found):
                    if not runs:
                        kept.append(b" ".join(buf[off[t] : off[t + 1]].tobytes().split()))
                        continue
                    a, b = int(first[t]), int(first[t + 1])
                    drop = np.zeros(b - a + 1, np.int64)
                    for s, length, p in runs:
                        drop[s + p] += 1
                        drop[s + length] -= 1
                    keep = np.flatnonzero(np.cumsum(drop[:-1]) == 0) + a
                    kept.append(b" ".join(buf[x:y].tobytes() for x, y in zip(start[keep].tolist(), end[keep].tolist())))
                flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
                offsets = np.concatenate(([0], np.cumsum([len(r) for r in found])))
                structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                new = [pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*names, *made])
            release()

    schema = StructType([*docs.schema.fields, *[StructField(n, k) for n, k in zip(made, (LongType(), ArrayType(RUN), StringType()))]])
    rows = docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string")) if docs.schema[text_col].dataType != StringType() else docs
    return rows.mapInArrow(run, StructType([rows.schema[f.name] if f.name in names else f for f in schema.fields]))


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` in which the words of one text of ten repeat from some place on; place and period follow from the id and the number of words."""
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def planted(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), F.transform(F.sequence(a, n - 1), lambda i: F.get(w, (a + (i - a) % p).cast("int")))), " ")

    changed = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(F.col(text_col))), F.lit(0))
    return docs.withColumn(text_col, F.when(h % 10 == 0, changed).otherwise(F.col(text_col)))


def strongest(runs: Column) -> Column:
    """The run with the greatest length over period, of equal ones the first by start, then period; null where there is none."""

    def better(best, r):
        mine, its = r["length"] * best["period"], best["length"] * r["period"]
        return F.when(best.isNull() | (mine > its), r).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def op13_periodic_runs(spark, sf_dir):
    docs = with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = collapse_runs(docs).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
