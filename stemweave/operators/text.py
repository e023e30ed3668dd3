"""Text operators: segmentation against a dictionary, corpus search, fuzzy matching, attestations, alignment."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fold_surface
from .graph import stored


# ------------------------------------------------------------------------------ segmentation


def build_trie(surfaces) -> dict:
    """Character trie of lower-cased, dash-less surfaces; ``""`` marks an end.  Empty surfaces are skipped."""
    root: dict = {}
    for s in surfaces:
        node = root
        s = s.lower().replace("-", "")
        for c in s:
            node = node.setdefault(c, {})
        if s:
            node[""] = s
    return root


def trie_starts(word: str, trie: dict) -> list[list[str]]:
    """The surfaces that begin at each place of a word."""
    out = []
    for i in range(len(word)):
        node, found = trie, []
        for j in range(i, len(word)):
            node = node.get(word[j])
            if node is None:
                break
            if "" in node:
                found.append(node[""])
        out.append(found)
    return out


def segmentations(word: str, starts: list[list[str]]):
    """Every parse of a word into surfaces and skipped characters (runs merged and bracketed), one after the other."""

    def rest(i, bracketed):
        if i == len(word):
            yield []
            return
        for s in starts[i]:
            for t in rest(i + len(s), False):
                yield [s, *t]
        if not bracketed:
            for j in range(i + 1, len(word) + 1):
                for t in rest(j, True):
                    yield [f"({word[i:j]})", *t]

    return rest(0, False)


def count_segmentations(word: str, starts: list[list[str]]) -> int:
    """How many parses ``segmentations`` gives, without going through them."""
    ways = [0] * len(word) + [1]
    for i in range(len(word) - 1, -1, -1):
        ways[i] = ways[i + 1] + sum(ways[i + len(s)] for s in starts[i])
    return ways[0]


class BestParses:
    """The parses of a word with the fewest unaccounted characters, then the fewest surfaces.

    A glue string between two surfaces is consumed at no cost and written ``+s+``.
    """

    def __init__(self, word: str, starts: list[list[str]], glue: tuple[str, ...] = ()):
        self.word, self.starts, self.glue = word, starts, tuple(g for g in glue if g)
        n, never = len(word), (1 << 60, 0)
        # least cost from each place: of a parse that begins with a surface, and of any; behind a surface, glue may come first
        self.surface, self.any, self.behind = [never] * (n + 1), [never] * n + [(0, 0)], [never] * n + [(0, 0)]
        for i in range(n - 1, -1, -1):
            self.surface[i] = min((self._add((0, 1), self.behind[i + len(s)]) for s in starts[i]), default=never)
            self.any[i] = min(self.surface[i], self._add((1, 0), self.any[i + 1]))
            glued = (self.surface[i + len(g)] for g in self.glue if word.startswith(g, i) and i + len(g) < n)
            self.behind[i] = min([self.any[i], *glued])

    @staticmethod
    def _add(x, y):
        return x[0] + y[0], x[1] + y[1]

    @property
    def cost(self) -> tuple[int, int]:
        return self.any[0]

    def _steps(self, i: int, left: tuple[int, int], kind: str):
        """(token, place, cost left, kind of place) of every first token of the parses of cost ``left`` from ``i``."""
        for s in self.starts[i]:
            j = i + len(s)
            if self._add((0, 1), self.behind[j]) == left:
                yield s, j, self.behind[j], "behind"
        if kind == "behind":
            for g in self.glue:
                j = i + len(g)
                if self.word.startswith(g, i) and j < len(self.word) and self.surface[j] == left:
                    yield f"+{g}+", j, left, "surface"
        if kind in ("any", "behind"):
            for j in range(i + 1, len(self.word) + 1):  # a bracket ends at a surface or at the end of the word
                after = self.surface[j] if j < len(self.word) else (0, 0)
                if self._add((j - i, 0), after) == left:
                    yield f"({self.word[i:j]})", j, after, "surface"

    def all(self):
        """All tied parses, one after the other, in the order that ``first`` prefers."""

        def rest(i, left, kind):
            if i == len(self.word):
                yield []
                return
            steps = sorted(self._steps(i, left, kind), key=(lambda x: (self._rank(x[0]), x[0])) if i == 0 else (lambda x: x[0]))
            for token, j, after, then in steps:
                for t in rest(j, after, then):
                    yield [token, *t]

        return rest(0, self.any[0], "any")

    @staticmethod
    def _rank(token: str) -> int:
        return 1 if token[0] in "(+" else -len(token)

    def first(self) -> list[str]:
        """The tied parse with the longest first surface; of several the first in order of their tokens."""
        return next(self.all())


def best_segmentations(word: str, trie: dict, glue: tuple[str, ...] = ()) -> list[list[str]]:
    """All tied best parses of one word with a trie, the preferred one first."""
    word = word.lower()
    return list(BestParses(word, trie_starts(word, trie), glue).all())


def dictionary_matches(words: DataFrame, word: str, dictionary: DataFrame, entry: str) -> DataFrame:
    """``(word, matches)``: each distinct lower-cased word with the entries that it holds, as ``(at, surface)`` from 0.

    Words are cut into their substrings of the lengths that entries have, and both meet by equality, so the dictionary may be of
    any size.  Entries are lower-cased and lose their dashes; empty ones match nothing.
    """
    w = words.select(F.lower(word).alias("word")).where("word <> ''").distinct()
    d = dictionary.select(F.replace(F.lower(entry), F.lit("-"), F.lit("")).alias("surface")).where("surface <> ''").distinct()
    sizes = d.select(F.length("surface").alias("k")).distinct()
    sizes = F.broadcast(sizes) if sizes.count() <= 1000 else sizes
    cut = w.join(sizes, F.length("word") >= F.col("k")).select("word", "k", F.explode(F.sequence(F.lit(1), F.length("word") - F.col("k") + 1)).alias("i"))
    hit = cut.select("word", (F.col("i") - 1).alias("at"), F.expr("substring(word, i, k)").alias("surface")).join(d, "surface")
    found = hit.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("at", "surface"))).alias("matches"))
    return w.join(found, "word", "left")


def _starts_of(word: str, matches) -> list[list[str]]:
    out: list[list[str]] = [[] for _ in word]
    for m in [] if matches is None else matches:
        out[m["at"]].append(m["surface"])
    return out


BATCH = 10_000


def segment(words: DataFrame, word: str, dictionary: DataFrame, entry: str, glue: tuple[str, ...] = (), all_ties: bool = False) -> DataFrame:
    """``(word, parse, unaccounted, morphemes)``: the best parse of each distinct word, or every tied one.

    A null or empty word has no parse.  Tied parses are made and sent in batches, however many there are.
    """

    def run(frames):
        for pdf in frames:
            rows = []
            for w, matches in zip(pdf["word"], pdf["matches"]):
                best = BestParses(w, _starts_of(w, matches), glue)
                for p in best.all() if all_ties else [best.first()]:
                    rows.append((w, " ".join(p), *best.cost))
                    if len(rows) == BATCH:
                        yield pd.DataFrame(rows, columns=["word", "parse", "unaccounted", "morphemes"])
                        rows = []
            yield pd.DataFrame(rows, columns=["word", "parse", "unaccounted", "morphemes"])

    return dictionary_matches(words, word, dictionary, entry).mapInPandas(run, "word string, parse string, unaccounted long, morphemes long")


def parse_counts(words: DataFrame, word: str, dictionary: DataFrame, entry: str) -> DataFrame:
    """``(word, parses)``: how many parses each distinct word has, skipped characters included."""

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame([(w, count_segmentations(w, _starts_of(w, m))) for w, m in zip(pdf["word"], pdf["matches"])], columns=["word", "parses"])

    return dictionary_matches(words, word, dictionary, entry).mapInPandas(run, "word string, parses long")


def split_point_segment(words: DataFrame, word: str, dictionary: DataFrame, entry: str) -> DataFrame:
    """``(word, head, tail)``: two-part parses of each distinct word, the longest head first, as two equality joins."""
    w = words.select(F.col(word).alias("word")).where("length(word) > 1").distinct()
    cut = w.select("word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k")).select("word", F.expr("substring(word, 1, k)").alias("head"), F.expr("substring(word, k + 1)").alias("tail"))
    d = dictionary.select(F.col(entry).alias("e")).distinct()
    both = cut.join(d.select(F.col("e").alias("head")), "head").join(d.select(F.col("e").alias("tail")), "tail")
    return both.groupBy("word").agg(F.max_by(F.struct("head", "tail"), F.length("head")).alias("p")).select("word", "p.head", "p.tail")


def position_label(ordinal: Column, size: Column, sole: str = "bare") -> Column:
    """The position of part ``ordinal`` (from 1) of ``size``: sole, pre, post or inner."""
    return F.when(size == 1, sole).when(ordinal == 1, "pre").when(ordinal == size, "post").otherwise("inner")


# ------------------------------------------------------------------------------ corpus search


def corpus_counts(docs: DataFrame, ident: str, text: str, forms: DataFrame, form: str, least: int = 4) -> DataFrame:
    """``(form, doc, n)``: whole-word occurrences of each form of ``least`` letters or more; a tokenise-and-join, not a scan per form."""
    words = docs.select(F.col(ident).alias("doc"), F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("form"))
    wanted = forms.select(F.lower(form).alias("form")).where(F.length("form") >= least).distinct()
    return words.join(wanted, "form", "left_semi").groupBy("form", "doc").agg(F.count("*").alias("n"))


def snippet(text: Column, needle: Column, radius: int) -> Column:
    """The text around the first hit; null where there is none."""
    at = F.instr(text, needle)
    return F.when(at > 0, F.substring(text, F.greatest(at - radius, F.lit(1)), F.length(needle) + radius + F.least(at - 1, F.lit(radius))))


def deletion_neighbours(c: Column) -> Column:
    """A word and all its forms with one letter deleted: two words within distance one share an entry."""
    cut = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    return F.array_distinct(F.concat(F.array(c), cut))


def fuzzy_pairs(vocab: DataFrame, word: str, canon: DataFrame, form: str, least: int = 5) -> DataFrame:
    """``(word, form)`` within edit distance one, ``word`` no canonical form itself: candidates share a deletion
    neighbour, so the join is an equality."""
    v = vocab.select(F.col(word).alias("word")).where(F.length("word") >= least).distinct()
    c = canon.select(F.col(form).alias("form")).where(F.length("form") >= least).distinct()
    near = c.select(F.explode(F.sequence(F.length("form") - 1, F.length("form") + 1)).alias("_n")).distinct()
    v = v.join(F.broadcast(near) if near.count() <= 1000 else near, F.length("word") == F.col("_n"), "left_semi")
    v = v.join(c.withColumnRenamed("form", "word"), "word", "left_anti")
    left, right = v.withColumn("k", F.explode(deletion_neighbours(F.col("word")))), c.withColumn("k", F.explode(deletion_neighbours(F.col("form"))))
    return left.join(right, "k").where(F.levenshtein("word", "form") <= 1).select("word", "form").distinct()


def _places():
    """Where each word of a text begins, by the lengths of what is before and between the words and of the words."""

    @F.pandas_udf("array<int>")
    def places(gaps: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([None if n is None or g is None else np.cumsum(g[: len(n)] + n) - n for g, n in zip(gaps, lengths)])

    return places


def anchored_search(docs: DataFrame, ident: str, text: str, entities: DataFrame, canon: DataFrame, form: str, least: int = 5, window: int = 100, radius: int = 40) -> DataFrame:
    """``(entity, doc, matched, count, snippet)``: for each of ``entities(entity, form, glosses)`` and document the first word (in order) that is one edit from the form, is no form of
    ``canon`` itself, and has one of the glosses within ``window`` characters of where it first stands.

    Words are runs of letters in lower case, forms are compared likewise, and both have ``least`` letters or more.  ``count`` is how often the word stands in the document, ``snippet`` the
    text around its first place, ``radius`` characters each way.  Words keep their places through the lengths of what is between them, so each document's text is met once, by its id, with the words that
    may match; ids are unique.  A null or empty gloss is none, and an entity without a gloss has no match.
    """
    low = F.lower(text)
    word = r"\p{L}+"
    pieces = docs.select(F.col(ident).alias("doc"), F.transform(F.split(low, word), lambda x: F.length(x)).alias("_gaps"), F.regexp_extract_all(low, F.lit(f"({word})"), F.lit(1)).alias("_words"))
    at = _places()("_gaps", F.transform("_words", lambda w: F.length(w)))
    words = F.filter(F.arrays_zip("_words", at.alias("_at")), lambda x: F.length(x["_words"]) >= least)
    rows = pieces.select("doc", F.explode(words).alias("x")).select("doc", F.col("x._words").alias("word"), F.col("x._at").alias("at"))
    seen = stored(rows.groupBy("doc", "word").agg(F.min("at").alias("at"), F.count("*").alias("count")))
    pairs = fuzzy_pairs(seen, "word", entities.select(F.lower("form").alias("form")), "form", least)
    other = canon.select(F.lower(form).alias("word")).distinct()
    pairs = stored(pairs.join(other, "word", "left_anti"))
    wanted = entities.select("entity", F.lower("form").alias("form"), F.filter(F.transform("glosses", lambda g: F.lower(g)), lambda g: g != "").alias("glosses")).where("size(glosses) > 0").join(pairs, "form")
    cut = lambda n: F.expr(f"substring(_t, greatest(at - {n}, 0) + 1, least(at, {n}) + length(word) + {n})")
    near = seen.join(pairs.select("word").distinct(), "word", "left_semi").groupBy("doc").agg(F.collect_list(F.struct("word", "at", "count")).alias("_h"))
    texts = docs.select(F.col(ident).alias("doc"), low.alias("_t")).join(near, "doc").select("doc", "_t", F.explode("_h").alias("h")).select("doc", "_t", "h.*")
    around = texts.select("doc", "word", "count", cut(window).alias("_w"), cut(radius).alias("snippet"))
    hits = around.join(wanted, "word").where(F.exists("glosses", lambda g: F.contains(F.col("_w"), g)))
    first = hits.groupBy("entity", "doc").agg(F.min(F.struct("word", "count", "snippet")).alias("m"))
    return first.select("entity", "doc", F.col("m.word").alias("matched"), "m.count", F.trim("m.snippet").alias("snippet"))


def ambiguous_matches(matches: DataFrame, source: str, form: str, entity: str) -> DataFrame:
    """``(source, form)`` groups with several plausible entities."""
    return matches.groupBy(source, form).agg(F.array_sort(F.collect_set(entity)).alias("entities")).where("size(entities) > 1")


def year_attestations(docs: DataFrame, ident: str, text: str, low: int, high: int, pattern: str = r"([A-Za-z]+) (\d{3,4})\b") -> DataFrame:
    """``(form, doc, year)``: the earliest plausible year behind each form in each document."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("f"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("y"))
    x = docs.select(F.col(ident).alias("doc"), F.explode(pairs).alias("p")).select("doc", F.lower("p.f").alias("form"), F.col("p.y").cast("int").alias("year"))
    return x.where(F.col("year").between(low, high)).groupBy("form", "doc").agg(F.min("year").alias("year"))


def refill_quote(quote: Column, body: Column, tail: int = 80, window: int = 200) -> Column:
    """A truncated quote extended by what follows its tail in the body; null where the tail is not found."""
    end = F.right(quote, F.lit(tail))
    at = F.instr(body, end)
    return F.when(at > 0, F.concat(quote, F.substring(body, at + F.length(end), F.lit(window))))


SMALL_ROWS, SMALL_BYTES = 500_000, 64 << 20


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table of plain columns that is already written, if its counted rows and bytes are few; else leave the join to Spark."""
    width = sum((F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) + 8 if kind == "string" else F.lit(8) for c, kind in df.dtypes), F.lit(0))
    n, size = df.agg(F.count("*"), F.sum(width.cast("long"))).first()
    return F.broadcast(df) if n <= SMALL_ROWS and (size or 0) <= SMALL_BYTES else df


def containing(docs: DataFrame, ident: str, text: str, quotes: DataFrame, quote_id: str, quote: str) -> DataFrame:
    """``(quote_id, ident)``: every text that contains a quote, each pair once.

    The inner words of a quote are whole words of any text that contains it.  Its rarest one finds the texts, and
    containment is tested exactly; a quote without an inner word is tested against every text.
    """
    words = lambda c: F.split(c, r"\s+")
    q = quotes.select(F.col(quote_id).alias("_q"), F.col(quote).alias("_quote")).where("_quote is not null").distinct()
    d = docs.select(F.col(ident).alias("_d"), F.col(text).alias("_text")).where("_text is not null")
    inner = q.withColumn("_w", F.explode_outer(F.expr("slice(split(_quote, '\\\\s+'), 2, greatest(size(split(_quote, '\\\\s+')) - 2, 0))")))
    asked = _small(stored(inner.where("_w is not null").select("_w").distinct()))
    often = d.select(F.explode(F.array_distinct(words("_text"))).alias("_w")).join(asked, "_w", "left_semi").groupBy("_w").agg(F.count("*").alias("_n"))
    # a word that no text has is the rarest of all: its quote is in no text
    ranked = inner.where("_w is not null").join(often, "_w", "left").groupBy("_q", "_quote").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_w").alias("w"))).alias("_x"))
    anchors = _small(stored(ranked.select("_q", "_quote", F.col("_x.w").alias("_w"))))
    at = d.select("_d", F.explode(F.array_distinct(words("_text"))).alias("_w")).join(anchors.select("_q", "_w"), "_w").select("_d", "_q").distinct()
    found = d.join(_small(stored(at)), "_d").join(anchors.select("_q", "_quote"), "_q").where(F.contains("_text", "_quote")).select("_q", "_d")
    short = inner.where("_w is null").select("_q", "_quote").distinct()
    found = found.unionByName(d.join(short, F.contains("_text", "_quote")).select("_q", "_d"))
    return found.distinct().select(F.col("_q").alias(quote_id), F.col("_d").alias(ident))


def pack_paragraphs(text: Column, target: int = 20_000) -> Column:
    """Chunks of whole paragraphs of about ``target`` characters; an oversize paragraph is a chunk of its own.

    One pass over the paragraphs' lengths notes where chunks begin; the texts are joined once.
    """
    paragraphs = F.filter(F.split(text, r"\n[ \t]*\n"), lambda p: F.trim(p) != "")
    state = "struct<heads:array<int>,used:int,i:int>"

    def step(acc, n):
        fits = (F.size(acc["heads"]) > 0) & (acc["used"] + n + 2 <= target)
        heads = F.when(fits, acc["heads"]).otherwise(F.concat(acc["heads"], F.array(acc["i"])))
        return F.struct(heads.alias("heads"), F.when(fits, acc["used"] + n + 2).otherwise(n).alias("used"), (acc["i"] + 1).alias("i")).cast(state)

    def chunks(p):
        start = F.struct(F.array().cast("array<int>").alias("heads"), F.lit(0).alias("used"), F.lit(0).alias("i")).cast(state)
        heads = F.aggregate(F.transform(p, lambda x: F.length(x)), start, step)["heads"]
        joined = lambda h: F.transform(h, lambda a, k: F.array_join(F.slice(p, a + 1, F.coalesce(F.get(h, k + 1), F.size(p)) - a), "\n\n"))
        return F.get(F.transform(F.array(heads), joined), F.lit(0))

    return F.get(F.transform(F.array(paragraphs), chunks), F.lit(0))


# ------------------------------------------------------------------------------ alignment and rules


def ocr_clusters(df: DataFrame, ident: str, language: str, form: str) -> DataFrame:
    """``(id, winner)``: the lowest id of each (language, folded form)."""
    return df.select(ident, F.min(ident).over(Window.partitionBy(language, fold_surface(F.col(form)))).alias("winner"))


def lemma_candidates(df: DataFrame, ident: str, language: str, form: str, rules: list[tuple[str, str]], mutations: list[tuple[str, str]] = ()) -> DataFrame:
    """``(id, lemma_id, rule)``: the first rule whose result is a form of the same language: suffix rules (ending, replacement) in their order, then mutations (beginning, replacement) in theirs.

    A rule takes no form whole; ``rule`` counts from 0 through both lists.
    """
    steps = [(a, b, True) for a, b in rules] + [(a, b, False) for a, b in mutations]
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(end).alias("end")) for i, (a, b, end) in enumerate(steps)])
    fits = F.when(F.col("r.end"), F.endswith(form, F.col("r.a"))).otherwise(F.startswith(form, F.col("r.a")))
    tries = df.select(ident, language, form, F.explode(table).alias("r")).where(fits & (F.length(form) > F.length("r.a")))
    changed = F.when(F.col("r.end"), F.concat(F.expr(f"substring({form}, 1, length({form}) - length(r.a))"), F.col("r.b"))).otherwise(F.concat(F.col("r.b"), F.expr(f"substring({form}, length(r.a) + 1)")))
    tries = tries.select(ident, language, F.col("r.i").alias("rule"), changed.alias("_f"))
    known = df.groupBy(F.col(language).alias("_l"), F.col(form).alias("_f")).agg(F.min(ident).alias("lemma_id"))
    hit = tries.join(known, (tries[language] == known["_l"]) & (tries["_f"] == known["_f"])).where(F.col(ident) != F.col("lemma_id"))
    return hit.groupBy(ident).agg(F.min_by(F.struct("lemma_id", "rule"), "rule").alias("x")).select(ident, "x.lemma_id", "x.rule")


def suffix_anchor(names: DataFrame, name: str, suffixes: DataFrame, suffix: str, least: int = 2) -> DataFrame:
    """``(name, stem, suffix)``: the longest known suffix that leaves a stem; joined on each name's own endings."""
    n = names.select(F.col(name).alias("name")).where(F.length("name") >= 2 * least).distinct()
    ends = n.select("name", F.explode(F.sequence(F.lit(least), F.length("name") - least)).alias("k")).select("name", F.expr("right(name, k)").alias("suffix"))
    hit = ends.join(suffixes.select(F.col(suffix).alias("suffix")).distinct(), "suffix").groupBy("name").agg(F.max_by("suffix", F.length("suffix")).alias("suffix"))
    return hit.select("name", F.expr("left(name, length(name) - length(suffix))").alias("stem"), "suffix")


def longest_common_run(a: Column, b: Column) -> Column:
    """The length of the longest common substring of two strings; 0 where one is empty.

    A common run of k characters holds common runs of all shorter lengths, so the length is found by bisection.
    """
    grams = lambda s, k: F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substring(s, i, k))
    fits = lambda k: (k <= F.least(F.length(a), F.length(b))) & F.arrays_overlap(grams(a, F.least(k, F.length(a))), grams(b, F.least(k, F.length(b))))
    steps = F.array(*[F.lit(1 << s) for s in range(20, -1, -1)])
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.aggregate(steps, F.lit(0), lambda n, s: F.when(fits(n + s), n + s).otherwise(n))).otherwise(F.lit(0))


def residual_span(name: str, anchors: list[list[str]], least: int = 2) -> str | None:
    """What is left of a name when every anchor, in any order and by any of its spellings, tiles its head or its tail.

    The shortest rest of ``least`` letters or more counts, since a short spelling leaves a letter of its anchor over; None where there is
    none, or several of that length.
    """

    def reach(head: bool) -> set[tuple[frozenset, int]]:
        seen = {(frozenset(), 0)}
        todo = list(seen)
        while todo:
            used, n = todo.pop()
            for i, forms in enumerate(anchors):
                for f in forms if i not in used else ():
                    fits = name.startswith(f, n) if head else name.endswith(f, 0, len(name) - n)
                    new = (used | {i}, n + len(f))
                    if f and fits and new not in seen:
                        seen.add(new)
                        todo.append(new)
        return seen

    tails: dict[frozenset, set[int]] = {}
    for used, n in reach(False):
        tails.setdefault(used, set()).add(n)
    every = frozenset(range(len(anchors)))
    rests = {name[p : len(name) - n] for used, p in reach(True) for n in tails.get(every - used, ()) if len(name) - p - n >= least}
    rests = {r for r in rests if r.isalpha()}
    short = [r for r in rests if len(r) == min(map(len, rests))]
    return short[0] if len(short) == 1 else None


def residual_alignment(name: str, parts: list[list[str]], least: int = 2) -> tuple[int, str] | None:
    """The one part (its index, and the span it must have) whose known spellings do not fit, where the others tile the rest
    of the name; None unless exactly one part can be it and its span is new."""
    found = [(i, span) for i in range(len(parts)) if (span := residual_span(name, parts[:i] + parts[i + 1 :], least)) and span not in parts[i]]
    return found[0] if len(parts) > 1 and len(found) == 1 else None


def implied_surfaces(parts: DataFrame, keys: list[str], ordinal: str, part: str, known: DataFrame, form: str, least: int = 2) -> DataFrame:
    """``(part, span, support)``: spellings that names imply for a part that none of its known ones fits, as often as ``least`` names.

    ``parts`` has a row for each part of a name (the last of ``keys`` is the name), ``known(part, form)`` the spellings.
    """
    name = keys[-1]
    spelled = parts.join(known.select(F.col(part), F.col(form).alias("_f")), part, "left").where(F.col("_f").isNull() | F.contains(name, F.col("_f")))
    spelled = parts.select(*keys, ordinal, part).distinct().join(spelled.groupBy(*keys, ordinal, part).agg(F.collect_set("_f").alias("forms")), [*keys, ordinal, part], "left")
    lists = spelled.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(ordinal).alias("i"), F.col(part).alias("p"), F.coalesce("forms", F.array().cast("array<string>")).alias("f")))).alias("x"))

    def run(frames):
        for pdf in frames:
            rows = []
            for n, x in zip(pdf["name"], pdf["x"]):
                hit = residual_alignment(n, [list(e["f"]) for e in x])
                if hit:
                    rows.append((x[hit[0]]["p"], hit[1]))
            yield pd.DataFrame(rows, columns=["part", "span"])

    kind = parts.schema[part].dataType.simpleString()
    return lists.select(F.col(name).alias("name"), "x").mapInPandas(run, f"part {kind}, span string").groupBy("part", "span").agg(F.count("*").alias("support")).where(F.col("support") >= least)


def sound_changes(form: str, rules: list[tuple[str, str, float]], floor: float = 1e-6) -> list[tuple[str, float]]:
    """Candidates (form, mass) after ordered rewrites (pattern, replacement, weight); a weight below one branches.

    Equal candidates are added up and masses below ``floor`` dropped; the heaviest comes first, ties in order of the form.
    """
    import re

    state = {form: 1.0}
    for pattern, to, weight in rules:
        new: dict[str, float] = {}
        for f, mass in state.items():
            changed = re.sub(pattern, to, f)
            for g, m in ((changed, mass * weight), (f, mass * (1 - weight))) if changed != f else ((f, mass),):
                if m >= floor:
                    new[g] = new.get(g, 0.0) + m
        state = new
    return sorted(state.items(), key=lambda x: (-x[1], x[0]))


def sound_change_table(forms: DataFrame, form: str, eras: dict[str, list[tuple[str, str, float]]], out: str = "form") -> DataFrame:
    """``(form, era, candidate, mass)`` of each distinct form under the ordered rules of each era."""

    def run(frames):
        for pdf in frames:
            rows = [(f, era, g, m) for f in pdf["form"] for era, rules in eras.items() for g, m in sound_changes(f, rules)]
            yield pd.DataFrame(rows, columns=["form", "era", "candidate", "mass"])

    distinct = forms.select(F.col(form).alias("form")).where("form is not null").distinct()
    return distinct.mapInPandas(run, "form string, era string, candidate string, mass double").withColumnRenamed("form", out)


def sound_change_origins(attested: DataFrame, spelling: str, forms: DataFrame, form: str, rules: list[tuple[str, str, float]]) -> DataFrame:
    """``(spelling, origin, mass)``: the rules read backwards over a vocabulary.  A rule that drops or merges letters has no inverse
    of its own, so every form is changed once and attested spellings meet the changed forms by equality."""
    changed = sound_change_table(forms, form, {"": rules}, "origin").select("origin", F.col("candidate").alias(spelling), "mass")
    return attested.select(spelling).distinct().join(changed, spelling).select(spelling, "origin", "mass")


def transliterate(text: str, table: dict[str, str]) -> str:
    """Longest-match-first mapping; characters without a mapping stay."""
    keys = sorted(table, key=len, reverse=True)
    out, i = [], 0
    while i < len(text):
        k = next((k for k in keys if text.startswith(k, i)), None)
        out.append(table[k] if k else text[i])
        i += len(k) if k else 1
    return "".join(out)


def mapped(df: DataFrame, column: str, table: dict[str, str], out: str) -> DataFrame:
    """``df`` with ``out``: the column's text through a table, longest match first; characters without an entry stay, nulls too."""
    import re

    keys = sorted((k for k in table if k), key=len, reverse=True)
    pattern = re.compile("|".join(map(re.escape, keys)) or r"(?!)")

    @F.pandas_udf("string")
    def replaced(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else pattern.sub(lambda m: table[m[0]], x))

    return df.withColumn(out, replaced(F.col(column)))


def mapped_by_language(words: DataFrame, word: str, language: str, table: DataFrame) -> DataFrame:
    """``(word, language, mapped)`` of each distinct word by the ``table(language, key, value)`` of its own language, longest keys first; characters without a key stay, as do all of a language without a table.

    Of several values of a key the least counts, empty keys none.  A table is the rows of one language, joined to its words.
    """
    keys = table.where("key <> ''").groupBy("language", "key").agg(F.min("value").alias("value")).groupBy(F.col("language").alias("_l")).agg(F.collect_list(F.struct("key", "value")).alias("_t"))
    asked = words.select(F.col(word).alias("word"), F.col(language).alias("language")).where("word is not null").distinct().join(keys, F.col("language") == F.col("_l"), "left")

    def run(frames):
        import re

        patterns: dict = {}
        for pdf in frames:
            out = []
            for w, lang, t in zip(pdf["word"], pdf["language"], pdf["_t"]):
                if t is None:
                    out.append(w)
                    continue
                if lang not in patterns:
                    rows = {e["key"]: e["value"] for e in t}
                    patterns[lang] = re.compile("|".join(map(re.escape, sorted(rows, key=len, reverse=True)))), rows
                pattern, rows = patterns[lang]
                out.append(pattern.sub(lambda m: rows[m[0]], w))
            yield pd.DataFrame({"word": pdf["word"], "language": pdf["language"], "mapped": out})

    return asked.select("word", "language", "_t").mapInPandas(run, "word string, language string, mapped string")


def sound_coverage(df: DataFrame, language: str, ipa: str, bundled: Column) -> DataFrame:
    """Per language: eligible words and those with a pronunciation, in all and in the bundle, and the rate over all."""
    return df.groupBy(language).agg(
        F.count("*").alias("eligible"), F.count(ipa).alias("lexicon"), F.count_if(bundled).alias("bundle_eligible"), F.count_if(bundled & F.col(ipa).isNotNull()).alias("bundle"), (F.count(ipa) / F.count("*")).alias("rate")
    )


def canonical_lookup(asks: DataFrame, name: str, region: str, places: DataFrame, decompositions: DataFrame, heuristic: Column) -> DataFrame:
    """``asks`` with ``signature`` and ``source``: the canonical decomposition of the place, else the heuristic one (no source).

    With a region the place of that region comes first, then one without a region, never one of another; without, any.
    Of several the lowest id counts.  ``places(id, name, region)``, canonical ``decompositions(id, place, signature, source)``.
    """
    p = places.select(F.col("name").alias("_n"), F.col("region").alias("_r"), F.col("id").alias("_p"))
    # the lowest id of a name, with each region and over all: few rows for one ask, however many places share a name
    by_region = p.groupBy("_n", "_r").agg(F.min("_p").alias("_p"))
    exact = by_region.where("_r is not null").select(F.col("_n"), F.col("_r"), F.col("_p").alias("_exact"))
    plain = by_region.where("_r is null").select(F.col("_n").alias("_n2"), F.col("_p").alias("_plain"))
    any_ = p.groupBy(F.col("_n").alias("_n3")).agg(F.min("_p").alias("_any"))
    j = asks.join(exact, (F.col(name) == F.col("_n")) & (F.col(region) == F.col("_r")), "left").join(plain, F.col(name) == F.col("_n2"), "left").join(any_, F.col(name) == F.col("_n3"), "left")
    j = j.withColumn("_place", F.when(F.col(region).isNull(), F.col("_any")).otherwise(F.coalesce("_exact", "_plain")))
    first = decompositions.groupBy(F.col("place").alias("_place")).agg(F.min(F.struct("id", "signature", "source")).alias("_d"))
    return j.join(first, "_place", "left").select(*asks.columns, F.coalesce("_d.signature", heuristic).alias("signature"), F.col("_d.source").alias("source"))


def spelling_vector(c: Column) -> dict[str, Column]:
    """Rates of letter classes and final-letter flags of a spelled form; all 0 for a form without letters."""
    s = fold_surface(c)
    n = F.greatest(F.length(s), F.lit(1))
    rate = lambda chars: F.length(F.regexp_replace(s, f"[^{chars}]", "")) / n
    classes = {"vowel": "aeiouy", "stop": "pbtdkgcq", "nasal": "mn", "liquid": "lr", "fricative": "fvszh", "glide": "wj", "front": "eiy", "back": "aou"}
    out = {f"{k}_rate": rate(v) for k, v in classes.items()}
    out["ends_vowel"] = F.when(s.rlike("[aeiouy]$"), 1.0).otherwise(0.0)
    out["ends_stop"] = F.when(s.rlike("[pbtdkgcq]$"), 1.0).otherwise(0.0)
    out["cluster_density"] = (F.length(s) - F.length(F.regexp_replace(s, "[^aeiouy]{2,}", ""))) / n
    return out


def whole_name_parses(names: DataFrame, name: str, dictionary: DataFrame, entry: str, glue: tuple[str, ...] = ()) -> DataFrame:
    """``(name, parse, unaccounted, morphemes)``: names split at blanks, each distinct word parsed once, the best parses
    joined in order of the words."""
    words = names.select(F.col(name).alias("name")).where("name <> ''").distinct().select("name", F.posexplode(F.split(F.lower("name"), " +")).alias("i", "word")).where("word <> ''")
    best = words.join(segment(words, "word", dictionary, entry, glue), "word")
    g = best.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("i", "parse"))).alias("p"), F.sum("unaccounted").alias("unaccounted"), F.sum("morphemes").alias("morphemes"))
    return g.select("name", F.array_join(F.transform("p", lambda x: x["parse"]), " / ").alias("parse"), "unaccounted", "morphemes")


def canonical_parse(candidates: DataFrame, place: str, signature: str, scholar: str, unaccounted: str, morphemes: str) -> DataFrame:
    """Per place the canonical candidate and the rule that picked it: a scholar's match (several are a disagreement), the only
    candidate that accounts for every character, else the fewest morphemes (ties in order of the signature)."""
    full = F.col(unaccounted) == 0
    g = candidates.groupBy(place).agg(
        F.count_if(scholar).alias("ns"), F.count_if(full).alias("nf"), F.min(F.when(F.col(scholar), F.col(signature))).alias("s"),
        F.min(F.when(full, F.col(signature))).alias("f"), F.min(F.when(full, F.struct(F.col(morphemes).alias("m"), F.col(signature).alias("g")))).alias("b"),
    )
    rule = F.when(F.col("ns") > 1, "scholar-disagreement").when(F.col("ns") == 1, "scholar").when(F.col("nf") == 1, "unique").when(F.col("nf") > 1, "fewest").otherwise("none")
    pick = F.when(F.col("ns") >= 1, F.col("s")).when(F.col("nf") == 1, F.col("f")).when(F.col("nf") > 1, F.col("b.g"))
    return g.select(place, pick.alias("canonical"), rule.alias("rule"))


def page_of(quotes: DataFrame, headers: DataFrame, doc: str, offset: str, at: str, page: str) -> DataFrame:
    """``quotes`` with the page of the last header at or before each offset (null where there is none)."""
    from .joins import asof_join

    return asof_join(quotes, headers, doc, offset, at, {page: page})


def header_offsets(docs: DataFrame, ident: str, text: str, patterns: list[str]) -> DataFrame:
    """``(doc, at, page)``: page headers by the pattern that finds most in each document (the first one on a tie); the first
    group of a pattern is the page number, ``at`` the place where it begins (from 0).  Only the lengths of pieces are shuffled."""
    counts = F.array(*[F.regexp_count(text, F.lit(p)) for p in patterns])
    best = docs.select(F.col(ident).alias("doc"), F.col(text).alias("_t"), counts.alias("_c")).withColumn("_p", F.array_position("_c", F.array_max("_c"))).where("array_max(_c) > 0")
    chosen = lambda body: F.coalesce(*[F.when(F.col("_p") == i, body(p)) for i, p in enumerate(patterns, 1)])
    pieces = chosen(lambda p: F.transform(F.split("_t", p), lambda x: F.length(x)))
    heads = chosen(lambda p: F.arrays_zip(F.transform(F.regexp_extract_all("_t", F.lit(p), F.lit(0)), lambda x: F.length(x)).alias("n"), F.regexp_extract_all("_t", F.lit(p), F.lit(1)).alias("page")))
    rows = best.select("doc", pieces.alias("s"), heads.alias("m")).select("doc", "s", F.posexplode("m").alias("k", "m")).select("doc", "k", F.get("s", F.col("k")).alias("gap"), "m.n", "m.page")
    order = Window.partitionBy("doc").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("doc", (F.sum(F.col("gap") + F.col("n")).over(order) - F.col("n")).alias("at"), F.col("page").try_cast("int").alias("page"))


def occurrences_by_position(words: DataFrame, word: str, forms: DataFrame, form: str, least: int = 2) -> DataFrame:
    """``(form, position, n)``: overlapping occurrences of each form in words as bare, pre, post or inner.  Words are cut into
    their substrings once and joined on equality."""
    w = words.select(F.col(word).alias("w")).where(F.length("w") >= least)
    f = forms.select(F.col(form).alias("form")).where(F.length("form") >= least).distinct()
    lens = f.select(F.length("form").alias("k")).distinct()
    lens = F.broadcast(lens) if lens.count() <= 1000 else lens
    cut = w.join(lens, F.length("w") >= F.col("k")).select("w", "k", F.explode(F.sequence(F.lit(1), F.length("w") - F.col("k") + 1)).alias("i"))
    cut = cut.select("w", "k", "i", F.expr("substring(w, i, k)").alias("form"))
    pos = F.when(F.col("k") == F.length("w"), "bare").when(F.col("i") == 1, "pre").when(F.col("i") + F.col("k") - 1 == F.length("w"), "post").otherwise("inner")
    return cut.join(f, "form", "left_semi").groupBy("form", pos.alias("position")).agg(F.count("*").alias("n"))
