"""Benchmark decontamination over a distributed positional inverted index.

The index has one posting ``(term, doc_id, h, pos)`` for every word of every text (``h`` tells rows that share a
document id apart, ``term`` is the word's 64-bit hash).  It is built once, without a shuffle, and stored in the shared
folder; it is sharded by document, and every list is read from all shards at once.  Any number of benchmarks can then be asked.

A phrase is found from its rarest terms: their posting lists, shifted by the terms' offsets in the phrase, are intersected by
``(document, start)``; the lists of the remaining terms are then intersected with what is left.  No text is read again.
Proximity intersects the lists of several terms within a span.  DataFrame functions alone are used.

A very common term is one key of a counting aggregation (with partial sums) and of a broadcast join whose small side is the
set of phrases, so no term's postings ever meet in one task; the later intersection is by document and position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free, materialize, small, table

#: runs of digits, a-z and characters beyond ASCII are words
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEEDS = 2
BLOCK = 16 << 20


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on (doc_id, h); a null id equals a null id."""
    b = b.withColumnsRenamed({"doc_id": "_id", "h": "_h"})
    return a.join(b, a["doc_id"].eqNullSafe(F.col("_id")) & (a["h"] == F.col("_h")), how).drop("_id", "_h")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _term(word: Column) -> Column:
    return F.xxhash64(word)


#: no word is empty: the hash of '' marks the end of a text, at its word count
END = "term = xxhash64('')"


def positional_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored postings ``(term, doc_id, h, pos)`` of every word, positions from 0, in order of the texts' words.

    A row's end (``END``) is posted once, at its word count, so rows without words are there as well.
    """
    lists = _rows(docs, id_col, text_col).select("doc_id", "h", F.posexplode(F.concat(words(F.col("text")), F.array(F.lit("")))).alias("pos", "word"))
    return materialize(lists.select(_term(F.col("word")).alias("term"), "doc_id", "h", "pos"), "postings", BLOCK)


def term_counts(index: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, freq)``: occurrences of every term of ``terms(term)`` in the indexed texts; 0 where there are none."""
    seen = index.join(small(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("freq"))
    return terms.join(seen, "term", "left").select("term", F.coalesce("freq", F.lit(0)).alias("freq"))


def phrase_windows(items: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows ``(window, terms, items)`` of ``width`` words; an item of fewer words, but not none, is one window."""
    w = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1)))
    each = w.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.expr(f"slice(w, s, {width})").alias("terms"))
    grouped = each.groupBy("terms").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return grouped.select(F.xxhash64("terms").alias("window"), "terms", "items")


def _ranked(index: DataFrame, spread: DataFrame) -> DataFrame:
    """``spread(..., word)`` with its ``term`` and how often the index has it."""
    spread = materialize(spread.withColumn("term", _term(F.col("word"))), "spread")
    freq = materialize(term_counts(index, materialize(spread.select("term").distinct(), "terms")), "freq")
    return spread.join(small(freq), "term")


def phrase_matches(index: DataFrame, windows: DataFrame) -> DataFrame:
    """``(doc_id, h, start, size, window)``: every exact occurrence of ``windows(window, terms)`` in the indexed texts."""
    ranked = _ranked(index, windows.select("window", F.posexplode("terms").alias("o", "word")))
    lists = ranked.groupBy("window").agg(F.sort_array(F.collect_list(F.struct("freq", "word", "o", "term"))).alias("r")).where("r[0].freq > 0")
    lists = materialize(lists.select("window", F.size("r").alias("size"), F.posexplode("r").alias("i", "x")).select("window", "size", "i", F.col("x.term").alias("term"), F.col("x.o").alias("o")), "lists")
    seeds = lists.where(F.col("i") < SEEDS).select("window", "size", "term", "o", F.expr("shiftleft(1, i)").alias("bit"), F.least(F.expr("shiftleft(1, size) - 1"), F.lit((1 << SEEDS) - 1)).alias("all"))
    shifted = index.join(small(materialize(seeds, "seeds")), "term").select("doc_id", "h", "window", "size", (F.col("pos") - F.col("o")).alias("start"), "bit", "all").where("start >= 0")
    met = shifted.groupBy("doc_id", "h", "window", "start").agg(F.bit_or("bit").alias("got"), F.max("all").alias("all"), F.max("size").alias("size")).where("got = `all`").drop("got", "all")
    met = materialize(met, "met")
    rest = materialize(lists.where(F.col("i") >= SEEDS).select("window", "term", "o"), "rest")
    # the other terms' lists, of the documents that are left alone
    asked = met.join(small(rest), "window").select("doc_id", "h", "window", "start", "size", (F.col("start") + F.col("o")).alias("pos"), "term")
    texts = materialize(met.where(F.col("size") > SEEDS).select("doc_id", "h").distinct(), "met_texts")
    have = _join(index.join(small(materialize(rest.select("term").distinct(), "rest_terms")), "term", "left_semi"), small(texts), "left_semi")
    have = have.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("pos").alias("_pos"), F.col("term").alias("_term"))
    both = asked.join(have, asked["doc_id"].eqNullSafe(F.col("_id")) & (asked["h"] == F.col("_h")) & (asked["pos"] == F.col("_pos")) & (asked["term"] == F.col("_term")))
    full = both.groupBy("doc_id", "h", "window", "start", "size").agg(F.countDistinct("pos").alias("n")).where(F.col("n") == F.col("size") - SEEDS)
    return full.select(*met.columns).unionByName(met.where(F.col("size") <= SEEDS)).select("doc_id", "h", "start", "size", "window")


def proximity_matches(index: DataFrame, queries: DataFrame, span: int) -> DataFrame:
    """``(doc_id, h, query_id, pos)``: occurrences of a query's rarest term with every other term of ``queries(query_id, terms)``
    at most ``span`` words away, in any order.  Terms are lower-cased words; repeated terms count once; of equally rare
    terms the first in order is the anchor; a query without terms matches nothing."""
    ranked = _ranked(index, queries.select("query_id", F.explode(F.array_distinct("terms")).alias("word"))).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("freq", "word", "term"))).alias("r"))
    ranked = materialize(ranked.where("r[0].freq > 0"), "ranked")
    anchors = materialize(ranked.select("query_id", F.col("r")[0]["term"].alias("term"), (F.size("r") - 1).alias("others")), "anchors")
    anchor = index.join(small(anchors), "term").select("doc_id", "h", "query_id", "others", F.col("pos").alias("at")).distinct()
    others = materialize(ranked.select("query_id", F.explode(F.expr("slice(r, 2, greatest(size(r) - 1, 1))")).alias("x")).select("query_id", F.col("x.term").alias("term")), "others")
    # only documents that hold the anchor are asked for the other terms
    texts = materialize(anchor.where("others > 0").select("doc_id", "h").distinct(), "anchored")
    rest = _join(index, small(texts), "left_semi").join(small(others), "term").withColumnsRenamed({"doc_id": "_id", "h": "_h"})
    # positions are dealt into cells of the span's width, so that the join stays an equality
    cell = lambda c: F.floor(F.col(c) / max(span, 1))
    wide = anchor.where("others > 0").withColumn("cell", F.explode(F.array(cell("at") - 1, cell("at"), cell("at") + 1)))
    rest = rest.select("_id", "_h", F.col("query_id").alias("_q"), "term", "pos", cell("pos").alias("_cell"))
    met = wide.join(rest, wide["doc_id"].eqNullSafe(F.col("_id")) & (wide["h"] == F.col("_h")) & (wide["query_id"] == F.col("_q")) & (wide["cell"] == F.col("_cell"))).where(F.abs(F.col("pos") - F.col("at")) <= span)
    full = met.groupBy("doc_id", "h", "query_id", "at", "others").agg(F.countDistinct("term").alias("c")).where("c = others")
    return full.select("doc_id", "h", "query_id", F.col("at").alias("pos")).unionByName(anchor.where("others = 0").select("doc_id", "h", "query_id", F.col("at").alias("pos")))


def rare_terms(index: DataFrame, items: DataFrame, most: int = 3, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(query_id, terms)``: the ``most`` rarest words of each item that the indexed texts have at all, ties in order of the words."""
    each = items.select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(words(F.col(text_col)))).alias("word"))
    ranked = _ranked(index, each).where("freq > 0").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("freq", "word"))).alias("r"))
    return ranked.select("query_id", F.transform(F.slice("r", 1, most), lambda x: x["word"]).alias("terms"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, h, n_words, n_hit, n_items, items_sha256, contaminated)`` for each distinct (id, text) of ``docs``.

    ``n_hit`` counts the words inside any occurrence of a benchmark window, ``n_items`` the items that have one.
    Null and empty texts have no words; null or empty items have no windows; equal windows of several items
    count for each of them; an empty benchmark hits nothing.
    """
    windows = materialize(phrase_windows(benchmark, width), "windows")
    index = positional_index(docs, id_col, text_col)
    lengths = index.where(END).groupBy("doc_id", "h").agg(F.max("pos").cast("long").alias("n_words"))
    matches = phrase_matches(index, windows)
    named = materialize(matches.join(small(windows.select("window", "items")), "window"), "matches")
    spots = named.select("doc_id", "h", F.explode(F.expr("sequence(start, start + size - 1)")).alias("p")).groupBy("doc_id", "h").agg(F.countDistinct("p").alias("n_hit"))
    items = named.select("doc_id", "h", F.explode("items").alias("item")).groupBy("doc_id", "h").agg(F.array_sort(F.transform(F.collect_set("item"), lambda x: x.cast("string"))).alias("item_ids"))
    out = _join(lengths, _join(spots, items), "left").select("doc_id", "h", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    return out.select("doc_id", "h", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any benchmark window in their text."""
    i, h = free("_bad", docs.columns), free("_h", docs.columns)
    bad = contamination(docs, benchmark, width, id_col, text_col).where("contaminated").select(F.col("doc_id").alias(i), F.col("h").alias(h))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.join(small(materialize(bad, "contaminated")), F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(h)), "left_anti")


def op6_benchmark_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h")


def op6_benchmark_proximity(spark, sf_dir):
    """Documents where the three rarest words of a benchmark item stand within ten words of the rarest one."""
    index = positional_index(table(spark, sf_dir, "documents"))
    queries = materialize(rare_terms(index, table(spark, sf_dir, "benchmark")), "rare")
    found = proximity_matches(index, queries, 10)
    return found.groupBy("doc_id", F.col("query_id").alias("item_id")).agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("first_pos"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = {
    "op6_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s:s + 9], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
spot AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS t
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT DISTINCT doc_id, item_id, s, k FROM spot JOIN win USING (k, t)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(ids.n, 0) AS n_items,
  sha256(coalesce(ids.s, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)""",
    "op6_benchmark_proximity": f"""
WITH d AS (SELECT doc_id, unnest(range(0, len(w))) AS pos, unnest(w) AS t FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
f AS (SELECT t, count(*) AS freq FROM d GROUP BY 1),
b AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS t FROM benchmark),
q AS (SELECT item_id, t, row_number() OVER (PARTITION BY item_id ORDER BY freq, t) AS k FROM b JOIN f USING (t) QUALIFY k <= 3),
n AS (SELECT item_id, count(*) - 1 AS others FROM q GROUP BY 1),
p AS (SELECT item_id, k, doc_id, pos FROM d JOIN q USING (t)),
m AS (SELECT x.item_id, x.doc_id, x.pos, count(DISTINCT y.k) AS c
  FROM p x LEFT JOIN p y ON y.item_id = x.item_id AND y.doc_id = x.doc_id AND y.k > 1 AND abs(y.pos - x.pos) <= 10 WHERE x.k = 1 GROUP BY ALL)
SELECT doc_id, item_id, count(*) AS n, min(pos) AS first_pos FROM m JOIN n USING (item_id) WHERE c = others GROUP BY 1, 2"""
}
