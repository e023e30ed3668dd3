"""Generating names as table operations: structures drawn with retries, slots filled in turn, requests composed, era maps."""

from __future__ import annotations

from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .graph import stored, stored_few, stored_with
from .scoring import hashed_uniform, weighted_choice


def compose_requests(requests: DataFrame, ident: str, moods: str, knobs: dict[str, Column], effects: DataFrame) -> DataFrame:
    """``(ident, axis, weight)``: the register of each request.

    ``effects(mood, axis, weight)`` of all its moods and its own knobs (axis -> weight) are added up and held within -1 and 1;
    unknown moods count nothing, and axes that come to 0 are left out.
    """
    named = requests.select(ident, F.explode(F.array_distinct(moods)).alias("mood")).join(effects, "mood").select(ident, "axis", "weight")
    own = requests.select(ident, F.explode(F.create_map(*[x for k, v in knobs.items() for x in (F.lit(k), v.cast("double"))])).alias("axis", "weight")) if knobs else named.limit(0)
    total = named.unionByName(own).groupBy(ident, "axis").agg(F.sum("weight").alias("weight"))
    return total.select(ident, "axis", F.greatest(F.least("weight", F.lit(1.0)), F.lit(-1.0)).alias("weight")).where("weight <> 0")


def slot_pools(words: DataFrame, gate: str, slot: str, word: str, tag: str, weight: str) -> DataFrame:
    """``(gate, slot, word, tag, weight)``: the words that a gate lets into a slot, with positive weights."""
    # summed by tag as well first: the least of strings is sought in few rows, since it makes Spark sort
    each = words.where(F.col(weight) > 0).groupBy(gate, slot, word, tag).agg(F.sum(weight).alias(weight))
    return each.groupBy(gate, slot, word).agg(F.min(tag).alias(tag), F.sum(weight).alias(weight))


def fillable(structures: DataFrame, structure: str, slots: str, pools: DataFrame, gate: str, slot: str) -> DataFrame:
    """``(gate, structure)``: the structures of which a gate fills every slot."""
    need = structures.select(structure, F.explode(F.array_distinct(slots)).alias(slot), F.size(F.array_distinct(slots)).alias("_n"))
    return need.join(pools.select(gate, slot).distinct(), slot).groupBy(gate, structure, "_n").agg(F.count("*").alias("_c")).where("_c = _n").select(gate, structure)


def pick_structures(requests: DataFrame, ident: str, gate: str, structures: DataFrame, structure: str, weight: str, full: DataFrame, seed: int, tries: int = 5) -> DataFrame:
    """``(ident, gate, structure, permissive)``: a structure for each request, drawn by weight.

    A structure of which the gate can't fill every slot is excluded from the request's next draw, ``tries`` times at most;
    then one is drawn from all and filled as far as it goes (``permissive``).  Draws are repeatable digests of the request.
    Each round is one join of the requests that are left with the list of structures.
    """
    # one group: the shares of the structures; the round's draw is moved over the shares that are excluded
    order = Window.partitionBy("_g").orderBy(structure).rowsBetween(Window.unboundedPreceding, 0)
    shares = structures.where(F.col(weight) > 0).groupBy(structure).agg(F.sum(weight).cast("double").alias(weight)).withColumn("_g", F.lit(0))
    shares = shares.withColumn("_hi", F.sum(weight).over(order)).withColumn("_t", F.sum(weight).over(Window.partitionBy("_g")))
    shares = stored_few(shares.select("_g", structure, F.col(weight).alias("_w"), (F.col("_hi") - F.col(weight)).alias("_lo"), "_t"))
    total = shares.agg(F.max("_t")).first()[0] or 0.0
    ok = full.select(F.col(gate).alias("_gate"), F.col(structure).alias("_s"), F.lit(True).alias("_full"))
    state = requests.select(F.col(ident), F.col(gate), F.array().cast("array<struct<lo:double,w:double>>").alias("_out"))
    done = None

    def draw(rows, k, out):
        left = F.lit(total) - F.aggregate(out, F.lit(0.0), lambda n, x: n + x["w"])
        x = F.aggregate(F.array_sort(out), hashed_uniform(seed, F.col(ident), F.lit(k)) * left, lambda at, e: F.when(at >= e["lo"], at + e["w"]).otherwise(at))
        drawn = rows.withColumn("_left", left).withColumn("_u", x / F.lit(total or 1.0)).withColumn("_g", F.lit(0))
        chosen = weighted_choice(shares.select("_g", structure, "_w"), drawn, "_g", structure, "_w", "_u", few=True).withColumn("chosen", F.when(F.col("_left") > 0, F.col("chosen")))
        return chosen.join(shares.select(F.col(structure).alias("chosen"), "_lo", "_w"), "chosen", "left").drop("_u", "_g", "_left")

    rest = requests.select(ident, gate).limit(0)
    for k in range(tries):
        drawn = draw(state, k, F.col("_out")).join(ok, (F.col(gate) == F.col("_gate")) & (F.col("chosen") == F.col("_s")), "left")
        drawn, seen = stored_with(drawn.select(ident, gate, "chosen", "_out", "_lo", "_w", "_full"), F.count_if(F.col("_full").isNull()).alias("open"))
        found = drawn.where("_full").select(ident, gate, F.col("chosen").alias(structure), F.lit(False).alias("permissive"))
        done = found if done is None else done.unionByName(found)
        if not seen["open"]:
            return done
        # those that ran out of structures wait for the last draw
        rest = rest.unionByName(drawn.where("chosen is null").select(ident, gate))
        state = drawn.where("_full is null and chosen is not null").select(ident, gate, F.concat("_out", F.array(F.struct(F.col("_lo").alias("lo"), F.col("_w").alias("w")))).alias("_out"))
    rest = rest.unionByName(state.select(ident, gate))
    last = draw(rest, tries, F.array().cast("array<struct<lo:double,w:double>>")).where("chosen is not null")
    last = last.select(ident, gate, F.col("chosen").alias(structure), F.lit(True).alias("permissive"))
    return last if done is None else done.unionByName(last)


CELLS = 1024


def _cell(at: Column, total: Column) -> Column:
    return F.floor(at / total * CELLS)


def _dealt(spans: DataFrame, key: str) -> DataFrame:
    """``spans(key, _lo, _hi, _total, ...)`` dealt into cells of equal width, a cell more on both sides to make up for rounding; written, and broadcast if that makes few rows."""
    cells = F.sequence(F.greatest(_cell(F.col("_lo"), F.col("_total")) - 1, F.lit(0)), _cell(F.col("_hi"), F.col("_total")) + 1)
    return stored_few(spans.withColumn("_cell2", F.explode(cells)).withColumnRenamed(key, "_key2"))


def _located(points: DataFrame, dealt: DataFrame, key: str, at: str, total: str) -> DataFrame:
    """``points`` with the columns of the span of :func:`_dealt` that holds ``at``, out of ``total``; nulls where none does.

    Points meet spans by their cells too, so where they are shuffled the points of one key go to many tasks.
    """
    here = points.withColumn("_cell", _cell(F.col(at), F.col(total)))
    fits = (F.col(key) == F.col("_key2")) & (F.col("_cell") == F.col("_cell2")) & (F.col("_lo") <= F.col(at)) & (F.col(at) < F.col("_hi"))
    return here.join(dealt, fits, "left").drop("_cell", "_cell2", "_key2", "_lo", "_hi", "_total")


class Pools:
    """Words of slots laid out for draws, each pool in order of its words: ``plain(_pool, _lo, _hi, _total, _word, _tag)``, the words of one tag ``tagged`` (by ``_lane``, pool and tag)
    and ``leaning`` (by lane): where a draw lands if the tag's words weigh ``1 + cohesion`` times as much.

    A leaning lane holds the tag's own words and the stretches between them, each with the extra weight that lies before it, so a draw that lands in a stretch is a plain draw moved back
    by that.  All tables have the size of the pools.
    """

    def __init__(self, pools: DataFrame, gate: str, slot: str, word: str, tag: str, weight: str, cohesion: float):
        c = cohesion
        rows = pools.select(pool_key(F.col(gate), F.col(slot)).alias("_pool"), F.col(word).alias("_word"), F.col(tag).alias("_tag"), F.col(weight).cast("double").alias("_w"))
        along, whole = Window.partitionBy("_pool").orderBy("_word").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("_pool")
        plain = rows.withColumn("_hi", F.sum("_w").over(along)).withColumn("_total", F.sum("_w").over(whole)).withColumn("_lo", F.col("_hi") - F.col("_w"))
        lane, ordered = Window.partitionBy("_pool", "_tag"), Window.partitionBy("_pool", "_tag").orderBy("_word")
        mine = plain.withColumn("_t", F.sum("_w").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_tt", F.sum("_w").over(lane)).withColumn("_lane", lane_key(F.col("_pool"), F.col("_tag")))
        self.table = stored(mine)
        self.plain = self.table.select("_pool", "_lo", "_hi", "_total", "_word", "_tag")
        self.tagged = self.table.select("_lane", (F.col("_t") - F.col("_w")).alias("_lo"), F.col("_t").alias("_hi"), F.col("_tt").alias("_total"), "_word")
        self.totals = stored_few(self.table.select("_pool", F.col("_total").alias("_plain")).distinct())
        self.lanes = stored_few(self.table.select("_lane", F.col("_tt").alias("_of_tag")).distinct())
        up = self.table.withColumn("_end", F.col("_total") + c * F.col("_tt")).withColumn("_a", F.col("_lo") + c * (F.col("_t") - F.col("_w"))).withColumn("_b", F.col("_a") + (1 + c) * F.col("_w"))
        after = F.coalesce(F.lead("_a").over(ordered), F.col("_end"))
        steps = [F.struct(F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), F.col("_word").alias("_word"), F.lit(0.0).alias("_shift")), F.struct(F.col("_b").alias("_lo"), F.col("_next").alias("_hi"), F.lit(None).cast("string").alias("_word"), (c * F.col("_t")).alias("_shift"))]
        spans = up.withColumn("_next", after).select("_lane", F.col("_end").alias("_total"), F.explode(F.array(*steps)).alias("s")).select("_lane", "_total", "s.*")
        self.leaning = spans.where("_hi > _lo")
        self.cohesion = c

    @cached_property
    def _plain(self) -> DataFrame:
        return _dealt(self.plain, "_pool")

    @cached_property
    def _tagged(self) -> DataFrame:
        return _dealt(self.tagged, "_lane")

    @cached_property
    def _leaning(self) -> DataFrame:
        return _dealt(self.leaning, "_lane")

    def draw(self, asked: DataFrame, i: int, seed: int, ident: str) -> DataFrame:
        """``asked(_pool, _before, ...)`` with the ``chosen`` word and its ``_got`` tag; null where the pool is empty."""
        rows = asked.withColumn("_lane", lane_key(F.col("_pool"), F.col("_before"))).join(self.totals, "_pool", "left").join(self.lanes, "_lane", "left")
        rows = rows.withColumn("_all", F.col("_plain") + self.cohesion * F.coalesce("_of_tag", F.lit(0.0))).withColumn("_x", hashed_uniform(seed, F.col(ident), F.lit(i)) * F.col("_all"))
        leant = _located(rows, self._leaning, "_lane", "_x", "_all").withColumnRenamed("_word", "_own")
        leant = leant.withColumn("_x", F.when(F.col("_own").isNull(), F.col("_x") - F.coalesce("_shift", F.lit(0.0)))).drop("_shift", "_of_tag", "_all", "_lane")
        found = _located(leant, self._plain, "_pool", "_x", "_plain")
        return found.withColumn("chosen", F.coalesce("_own", "_word")).withColumn("_got", F.when(F.col("_own").isNotNull(), F.col("_before")).otherwise(F.col("_tag"))).drop("_own", "_word", "_tag", "_x", "_plain", "_pool")

    def draw_tagged(self, asked: DataFrame, u: Column) -> DataFrame:
        """``asked(_lane, ...)`` with a ``chosen`` word of the lane's tag, by weight."""
        rows = asked.join(self.lanes, "_lane").withColumn("_x", u * F.col("_of_tag"))
        return _located(rows, self._tagged, "_lane", "_x", "_of_tag").withColumnRenamed("_word", "chosen").drop("_x", "_of_tag")


def pool_key(gate: Column, slot: Column) -> Column:
    return F.concat_ws("\x1f", gate, slot)


def lane_key(pool: Column, tag: Column) -> Column:
    return F.concat_ws("\x1e", pool, tag)


def fill_slots(picks: DataFrame, ident: str, gate: str, slots: str, pools: DataFrame, slot: str, word: str, tag: str, weight: str, seed: int, cohesion: float = 1.0) -> DataFrame:
    """``(ident, parts)``: the words of each request's slots, filled in turn.

    A word that shares the tag of the word before it weighs ``1 + cohesion`` times as much (:class:`Pools`; no pool meets all tags).  A slot without words is left out;
    a request of which no slot is filled is dropped.
    """
    laid = Pools(pools, gate, slot, word, tag, weight, cohesion)
    state = picks.select(ident, gate, slots, F.lit("").alias("_before"), F.array().cast("array<string>").alias("parts"))
    most = picks.agg(F.max(F.size(slots))).first()[0] or 0
    for i in range(most):
        here = F.get(slots, F.lit(i))
        drawn = laid.draw(state.withColumn("_pool", F.when(here.isNotNull(), pool_key(F.col(gate), here))), i, seed, ident)
        state = drawn.select(ident, gate, slots, F.coalesce("_got", "_before").alias("_before"), F.when(F.col("chosen").isNull(), F.col("parts")).otherwise(F.concat("parts", F.array("chosen"))).alias("parts"))
    return stored(state.where("size(parts) > 0").select(ident, "parts"))  # several steps may read it


def reserve_slots(requests: DataFrame, ident: str, gate: str, slots: str, tag: str, moods: str, pools: DataFrame, slot: str, word_tag: str, seed: int) -> DataFrame:
    """``requests`` plus ``mood_slot``, ``tag_slot`` (from 0) and ``failed``: the slots that carry a mood's and a demanded tag's word.

    ``moods`` is an array of ``(tag, weight)``, ``tag`` a tag or null.  A slot is capable where its pool has a word with such a tag; one of the capable ones is drawn.  The tag takes
    another slot than the mood unless the mood's is the only capable one.  A mood without a capable slot goes without (soft); a tag without one fails the request's structure (hard).
    """
    have = pools.select(lane_key(pool_key(F.col(gate), F.col(slot)), F.col(word_tag)).alias("_lane")).distinct().withColumn("_has", F.lit(True))
    have = stored_few(have)
    each = requests.select(ident, gate, F.col(tag).alias("_tag"), F.col(moods).alias("_moods"), F.posexplode(slots).alias("_i", "_s"))
    pool = pool_key(F.col(gate), F.col("_s"))
    asked = each.select(ident, "_i", F.lit("tag").alias("_what"), lane_key(pool, F.col("_tag")).alias("_lane"), F.col("_tag").alias("_t")).where("_t is not null")
    asked = asked.unionByName(each.select(ident, "_i", F.lit("mood").alias("_what"), pool.alias("_p"), F.explode("_moods").alias("_m")).where("_m.weight > 0").select(ident, "_i", "_what", lane_key(F.col("_p"), F.col("_m.tag")).alias("_lane"), F.col("_m.tag").alias("_t")))
    can = asked.join(have, "_lane").groupBy(ident).agg(*[F.array_sort(F.collect_set(F.when(F.col("_what") == w, F.col("_i")))).alias(f"_{w}") for w in ("mood", "tag")])
    rows = requests.join(can, ident, "left")
    drawn = lambda a, what: F.get(a, F.floor(hashed_uniform(seed, F.col(ident), F.lit(what)) * F.size(a)).cast("int"))
    rows = rows.withColumn("mood_slot", F.when(F.size("_mood") > 0, drawn(F.col("_mood"), "mood")))
    other = F.filter("_tag", lambda i: F.col("mood_slot").isNull() | (i != F.col("mood_slot")))
    rows = rows.withColumn("_free", F.when(F.size(other) > 0, other).otherwise(F.col("_tag")))
    rows = rows.withColumn("tag_slot", F.when(F.col(tag).isNotNull() & (F.size("_free") > 0), drawn(F.col("_free"), "tag")))
    return rows.withColumn("failed", F.col(tag).isNotNull() & F.col("tag_slot").isNull()).drop("_mood", "_tag", "_free")


def fill_reserved(reserved: DataFrame, ident: str, gate: str, slots: str, tag: str, moods: str, pools: DataFrame, slot: str, word: str, word_tag: str, weight: str, seed: int, cohesion: float = 1.0) -> DataFrame:
    """``(ident, parts)`` of the requests of :func:`reserve_slots` that haven't failed, filled in turn as by :func:`fill_slots`, except in reserved slots.

    The tag's slot draws from words with the demanded tag alone; they are chosen before cohesion, which weighs them all alike.  In the mood's slot words with a tag of the mood are drawn
    by weight times the mood's weight for it, words with the tag before them leaning as ever, others not at all.
    """
    laid = Pools(pools, gate, slot, word, word_tag, weight, cohesion)
    keep = [ident, gate, slots, tag, moods, "mood_slot", "tag_slot"]
    state = reserved.where("not failed").select(*keep, F.lit("").alias("_before"), F.array().cast("array<string>").alias("parts"))
    most = reserved.agg(F.max(F.size(slots))).first()[0] or 0
    for i in range(most):
        here = F.get(slots, F.lit(i))
        rows = stored(state.withColumn("_pool", F.when(here.isNotNull(), pool_key(F.col(gate), here))))
        tagged, mooded = F.coalesce(F.col("tag_slot") == i, F.lit(False)), F.coalesce(F.col("mood_slot") == i, F.lit(False))
        free = laid.draw(rows.where(~tagged & ~mooded), i, seed, ident).select(*keep, "_before", "parts", "chosen", "_got")
        hard = laid.draw_tagged(rows.where(tagged).withColumn("_lane", lane_key(F.col("_pool"), F.col(tag))), hashed_uniform(seed, F.col(ident), F.lit(i)))
        hard = hard.select(*keep, "_before", "parts", "chosen", F.col(tag).alias("_got"))
        # the mood's tags that the pool has, each with the weight of all its words, laid end to end in order
        soft = rows.where(mooded & ~tagged)
        parts = soft.select(ident, "_pool", "_before", F.explode(moods).alias("_m")).where("_m.weight > 0").select(ident, "_before", F.col("_m.tag").alias("_t"), F.col("_m.weight").alias("_mw"), lane_key(F.col("_pool"), F.col("_m.tag")).alias("_lane")).join(laid.lanes, "_lane")
        share = F.col("_mw") * F.col("_of_tag") * F.when(F.col("_t") == F.col("_before"), 1 + cohesion).otherwise(1.0)
        along = Window.partitionBy(ident).orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
        parts = parts.withColumn("_hi", F.sum(share).over(along)).withColumn("_sum", F.sum(share).over(Window.partitionBy(ident)))
        got = parts.where(F.col("_hi") > hashed_uniform(seed, F.col(ident), F.lit(i)) * F.col("_sum")).groupBy(ident).agg(F.min(F.struct("_t", "_lane")).alias("_m"))
        soft = laid.draw_tagged(soft.join(got, ident).withColumn("_lane", F.col("_m._lane")), hashed_uniform(seed, F.col(ident), F.lit(i), F.lit("word"))).select(*keep, "_before", "parts", "chosen", F.col("_m._t").alias("_got"))
        drawn = free.unionByName(hard).unionByName(soft)
        state = drawn.select(*keep, F.coalesce("_got", "_before").alias("_before"), F.when(F.col("chosen").isNull(), F.col("parts")).otherwise(F.concat("parts", F.array("chosen"))).alias("parts"))
    return state.where("size(parts) > 0").select(ident, "parts")


PAGE = 16


def first_unused(used: DataFrame, ident: str, group: str, word: str, pool: DataFrame) -> DataFrame:
    """``(ident, word)``: the least word of ``pool(group, word)`` in any group that the request's rows of ``used(ident, group, word)`` are of, which it doesn't use itself; no row where all are used.

    A request that uses n words finds its word among the first n + 1 of each of its groups, or of no group, so no more are looked up.
    """
    words = pool.select(F.col(group).alias("_g"), F.col(word).alias("_w")).where("_g is not null and _w is not null").distinct()
    ranked = stored_few(words.withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy("_w"))))
    sizes = stored_few(ranked.groupBy("_g").agg(F.count("*").alias("_n")))
    each = used.groupBy(ident).agg(F.collect_set(word).alias("_used"), F.collect_set(group).alias("_groups"))
    asked = each.select(ident, "_used", F.explode("_groups").alias("_g")).join(sizes, "_g")
    tried = asked.select(ident, "_used", "_g", F.explode(F.sequence(F.lit(1), F.least(F.size("_used") + 1, F.col("_n")).cast("int"))).alias("_r")).join(ranked, ["_g", "_r"])
    return tried.where(~F.array_contains("_used", F.col("_w"))).groupBy(ident).agg(F.min("_w").alias(word))


def diversified(names: DataFrame, ident: str, slot: str, usage: str, position: str, senses: DataFrame) -> DataFrame:
    """``names(ident, slot, usage, position)`` plus ``final``: repeats within a name resolved one after the other, in order of the slots.

    ``senses(usage, rank, language, form, gloss, tag)`` are the readings of a usage; the least rank is its own.  A repeat takes the form of a reading that shares a gloss with its own and is
    in a language that neither its own readings of that gloss nor the first use brought; of several the least (rank, language).  Else it becomes another usage of the same
    position and its own language, one that shares its tag if there is one, that the name doesn't have yet; which one, a digest of the whole name says.  Else it stays.

    The pools of other usages are numbered once; a repeat looks up as many neighbours of its digest as its name has slots, which is enough whatever the name has already.
    """
    own = senses.groupBy("usage").agg(F.min(F.struct("rank", "language", "gloss", "tag")).alias("o")).select("usage", "o.*")
    placed = names.select(F.col(usage).alias("usage"), F.col(position).alias("_pos")).distinct().join(own, "usage")
    lane = lambda pos, lang, t: F.concat_ws("\x1f", pos, lang, t)
    members = placed.select("usage", F.explode(F.array(lane(F.col("_pos"), F.col("language"), F.lit("")), lane(F.col("_pos"), F.col("language"), F.concat(F.lit("t"), "tag")))).alias("_lane")).where("_lane is not null").distinct()
    by_name = Window.partitionBy("_lane")
    numbered = members.select("_lane", "usage", (F.row_number().over(by_name.orderBy("usage")) - 1).alias("_n"), F.count("*").over(by_name).alias("_size"))
    # a page: a usage of the lane and those behind it, round to the first again
    turned = numbered.select("_lane", "_size", "_n", "usage", F.explode(F.sequence(F.lit(0), F.least(F.col("_size"), F.lit(PAGE)).cast("int") - 1)).alias("_d")).withColumn("_n", F.pmod(F.col("_n") - F.col("_d"), F.col("_size")))
    pages = stored_few(turned.groupBy("_lane", "_size", "_n").agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "usage"))), lambda x: x["usage"]).alias("_page")))
    sizes = stored_few(pages.where("_n = 0").select("_lane", "_size"))

    # of the readings in one language only the first is ever taken
    other = senses.alias("s").join(own.alias("o"), "usage").where("s.gloss = o.gloss and s.language <> o.language").groupBy("usage", F.col("s.language").alias("language")).agg(F.min(F.struct("s.rank", "s.form")).alias("m"))
    first = F.transform(F.array_sort(F.collect_list(F.struct("m.rank", "language", "m.form"))), lambda x: F.struct(x["language"].alias("language"), x["form"].alias("form")))
    known = stored_few(own.join(other.groupBy("usage").agg(first.alias("syn")), "usage", "left").select("usage", "language", "tag", "syn"))

    # one row a name: what follows joins small tables to it and gathers by the same key, which shuffles nothing more
    row = F.struct(F.col(slot).alias("_slot"), F.col(usage).alias("usage"), F.col(position).alias("_pos"), F.struct(*names.columns).alias("_row"))
    whole = names.groupBy(F.col(ident).alias("_id")).agg(F.array_sort(F.collect_list(row)).alias("_p")).withColumn("_usages", F.transform("_p", lambda x: x["usage"]))
    once = lambda a: F.size(F.array_distinct(a)) == F.size(a)
    folds = F.transform("_usages", lambda u: F.lower(F.replace(u, F.lit("-"), F.lit(""))))
    whole = whole.select("_id", "_usages", (~once(folds)).alias("_twice"), F.when(~once(F.col("_usages")), F.array_join("_usages", "|")).alias("_name"), F.posexplode("_p").alias("_at", "x"))
    again = F.when(F.col("_name").isNotNull(), F.array_position("_usages", F.col("x.usage")) <= F.col("_at"))
    each = whole.select("_id", F.size("_usages").alias("_k"), "_twice", "_name", "_at", "x.*", again.alias("_again")).join(known, "usage", "left")
    # a usage that stands for the first time looks up nothing
    lanes = F.array(*[F.struct(F.lit(o).alias("o"), lane(F.col("_pos"), F.col("language"), t).alias("l")) for o, t in ((0, F.concat(F.lit("t"), "tag")), (1, F.lit("")))])
    u = F.when(F.col("_again"), hashed_uniform(0, F.col("_name"), F.col("_slot")))
    asked = each.select("_id", "_k", "_twice", "_at", u.alias("_u"), "usage", "language", "syn", "_row", F.explode_outer(F.when(F.col("_again") & F.col("language").isNotNull(), lanes)).alias("c"))
    asked = asked.withColumn("_lane", F.col("c.l")).join(sizes, "_lane", "left").withColumn("_most", F.least(F.col("_k") + 1, F.col("_size")).cast("int"))
    asked = asked.select("*", F.explode_outer(F.when(F.col("_most") > 0, F.sequence(F.lit(0), F.floor((F.col("_most") - 1) / PAGE).cast("int")))).alias("_j"))
    asked = asked.withColumn("_n", (F.floor(F.col("_u") * F.col("_size")) + F.col("_j") * PAGE) % F.col("_size")).join(pages.drop("_size"), ["_lane", "_n"], "left")
    head = F.coalesce((F.col("c.o") == 0) & (F.coalesce("_j", F.lit(0)) == 0), F.lit(True))
    about = F.struct("usage", "language", "syn")
    entry = F.struct("_at", F.col("c.o").alias("o"), "_j", F.when(head & F.col("_twice"), about).alias("about"), F.slice("_page", F.lit(1), F.least(F.lit(PAGE), F.col("_most") - F.col("_j") * PAGE)).alias("page"), F.when(head, F.col("_row")).alias("_row"))
    lists = asked.groupBy("_id").agg(F.first("_twice").alias("_twice"), F.array_sort(F.collect_list(entry)).alias("e"))
    rows = F.transform(F.filter("e", lambda x: x["_row"].isNotNull()), lambda x: x["_row"])
    lists = lists.select(rows.alias("_rows"), F.when(F.col("_twice"), F.transform("e", lambda x: F.struct(x["about"].alias("about"), x["page"].alias("page")))).alias("e"))

    def run(batches):
        for batch in batches:
            final = [e and _resolved(_slots(e)) for e in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(final, pa.list_(pa.string()))], ["_rows", "final"])

    out = lists.mapInArrow(run, StructType([lists.schema["_rows"], StructField("final", ArrayType(StringType()))]))
    flat = out.select(F.posexplode("_rows").alias("_at", "x"), "final").select("x.*", F.coalesce(F.get("final", F.col("_at")), F.col(f"x.{usage}")).alias("final"))
    return flat.where(F.col(ident).isNotNull() & F.col(slot).isNotNull())


def _slots(entries) -> list[dict]:
    """The slots of one name from its entries: the first of a slot says what it is, the others bring further pages of options."""
    out = []
    for e in entries:
        if e["about"] is not None:
            out.append(e["about"] | {"options": []})
        out[-1]["options"] += e["page"] or []
    return out


def _resolved(parts) -> list[str]:
    """The final usages of one name's slots, in order."""
    fold = lambda u: u.replace("-", "").lower()
    seen: dict[str, set[str]] = {}
    out = []
    for p in parts:
        usage, language = p["usage"], p["language"]
        mine = {language} if language else set()
        if fold(usage) not in seen:
            seen[fold(usage)] = mine
            out.append(usage)
            continue
        taken = seen[fold(usage)] | mine
        synonym = next((s for s in ([] if p["syn"] is None else p["syn"]) if s["language"] not in taken), None)
        other = next((o for o in ([] if p["options"] is None else p["options"]) if fold(o) not in seen), None)
        if synonym is not None:
            seen.setdefault(fold(synonym["form"]), set()).add(synonym["language"])
            out.append(synonym["form"])
        elif other is not None:
            seen[fold(other)] = set(mine)
            out.append(other)
        else:
            out.append(usage)
    return out


def rendered_names(parts: DataFrame, ident: str, slot: str, entity: str, usage: str, variants: DataFrame, inflections: DataFrame, grid: DataFrame, families: list[str], seed: int, variety: float, density: float) -> DataFrame:
    """``(ident, rendered)``: each name as JSON, its parts in order with usage, rendered form, label and a grid of the forms of its entity by family and stage.

    A part first draws for an inflection, with chance ``density``: one of ``inflections(entity, form, label)``, all alike; else for a variant, with chance ``variety``: one of
    ``variants(entity, form, weight)`` by weight; else it is rendered as its usage.  An entity without inflections or positive variants has no such draw.  ``grid(entity, family, stage, language, form, source)``
    gives families in the order of ``families``, then by name, stages by number, forms in order; what is empty is left out.  Draws are digests of name and slot.
    """
    e = F.col(entity)
    u = lambda what: hashed_uniform(seed, F.col(ident), F.col(slot), F.lit(what))
    base = parts.select(F.col(ident), F.col(slot), e.alias("_e"), F.col(usage).alias("usage"))
    base = base.withColumn("_ui", u("i1")).withColumn("_uv", u("v1")).withColumn("_inflect", u("i0") < density).withColumn("_vary", u("v0") < variety)
    forms = inflections.select(F.col("entity").alias("_e"), F.concat_ws("\x1f", "form", "label").alias("_f"), F.lit(1).alias("_w")).distinct()
    spelt = variants.groupBy(F.col("entity").alias("_e"), F.col("form").alias("_f")).agg(F.sum(F.when(F.col("weight") > 0, F.col("weight"))).alias("_w")).where("_w > 0")
    drawn = weighted_choice(forms, base, "_e", "_f", "_w", "_ui", few=True).withColumnRenamed("chosen", "_inf")
    drawn = weighted_choice(spelt, drawn, "_e", "_f", "_w", "_uv", few=True).withColumnRenamed("chosen", "_var")
    got = F.when(F.col("_inflect"), F.split("_inf", "\x1f"))
    shown = drawn.select(ident, slot, "_e", "usage", F.coalesce(F.get(got, F.lit(0)), F.when(F.col("_vary"), F.col("_var")), F.col("usage")).alias("rendered"), F.get(got, F.lit(1)).alias("label"))
    order = F.array(*map(F.lit, families)) if families else F.array().cast("array<string>")
    place = F.when(F.array_position(order, F.col("family")) > 0, F.array_position(order, F.col("family"))).otherwise(len(families) + 1)
    cells = grid.groupBy("entity", "family", "stage", "language").agg(F.array_sort(F.collect_set(F.struct("form", "source"))).alias("forms"))
    rows = cells.groupBy("entity", "family").agg(F.transform(F.array_sort(F.collect_list(F.struct("stage", "language", "forms"))), lambda x: F.struct(x["language"].alias("language"), x["forms"].alias("forms"))).alias("stages"))
    table = rows.groupBy(F.col("entity").alias("_e")).agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("k"), "family", "stages"))), lambda x: F.struct(x["family"].alias("family"), x["stages"].alias("stages"))).alias("grid"))
    # the parts of a name come together first, so the grids, which are many times as large, are met where they are shown and never shuffled
    every = shown.repartition(ident).join(stored_few(table), "_e", "left").groupBy(ident).agg(F.transform(F.array_sort(F.collect_list(F.struct(slot, "usage", "rendered", "label", "grid"))), lambda x: F.struct(x["usage"].alias("usage"), x["rendered"].alias("rendered"), x["label"].alias("label"), x["grid"].alias("grid"))).alias("parts"))
    name = F.array_join(F.transform("parts", lambda x: x["rendered"]), "")
    return every.select(ident, F.to_json(F.struct(name.alias("name"), "parts")).alias("rendered"))


def era_map(names: DataFrame, name: str, forms: DataFrame, form_of: str, at: str, form: str, eras: list[tuple[str, int]]) -> DataFrame:
    """``(name, era, rendered, attested)``: each distinct name through the strata, by its last form at or before each era;
    an era before its first form keeps the name as it is."""
    from .joins import asof_join

    stops = F.array(*[F.struct(F.lit(e).alias("era"), F.lit(y).alias("_y")) for e, y in eras])
    asks = names.select(F.col(name).alias("name")).where("name <> ''").distinct().select("name", F.explode(stops).alias("s")).select("name", "s.era", "s._y")
    got = asof_join(asks, forms.select(F.col(form_of).alias("name"), F.col(at).alias("_at"), F.col(form).alias("_f")), "name", "_y", "_at", {"_f": "_form"})
    return got.select("name", "era", F.coalesce("_form", "name").alias("rendered"), F.col("_form").isNotNull().alias("attested"))
