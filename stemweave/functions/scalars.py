"""Scalar functions: folding, tokens, years and eras, weighted sums, lookups, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: fixed values: Latin letters that no decomposition and no name of a base letter explains
SPECIAL = {"æ": "ae", "œ": "oe", "ß": "ss", "þ": "th", "ð": "d", "ƿ": "w", "ȝ": "y", "ŋ": "ng", "ı": "i", "ĸ": "k", "ſ": "s"}


def latin_letters() -> dict[str, str]:
    """What each lower-case Latin letter beyond a-z folds to: the letters of its compatibility decomposition without marks, those in ``SPECIAL`` spelt out, and of
    a letter "with" something (a stroke, a hook) the letter it is named by.  Other letters have no entry."""
    import sys
    import unicodedata

    def one(ch: str) -> str:
        if ch.isascii():
            return ch.lower() if ch.isalpha() else ""
        if ch.lower() in SPECIAL:
            return SPECIAL[ch.lower()]
        name = unicodedata.name(ch, "").split()
        return name[3].lower() if name[:3] == ["LATIN", "SMALL", "LETTER"] and len(name) > 4 and name[4] == "WITH" and len(name[3]) == 1 else ""

    out = {}
    for code in range(128, sys.maxunicode + 1):
        ch = chr(code)
        if "LATIN" in unicodedata.name(ch, "") and ch == ch.lower():
            to = SPECIAL.get(ch) or "".join(one(x) for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
            if to:
                out[ch] = to
    return out


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else, as a case-insensitive ASCII collation does."""
    return F.translate(c, UPPER, LOWER)


def fold_surface(c: Column) -> Column:
    """Lower case, Latin letters of all blocks by their base letters (ligatures spelt out), marks dropped, letters a-z only."""
    table = latin_letters()
    single = {k: v for k, v in table.items() if len(v) == 1}
    low = F.lower(c)
    out = F.translate(low, "".join(single), "".join(single.values()))
    for k, v in table.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    plain = F.when(low.rlike(r"[^\x00-\x7F]"), out).otherwise(low)
    return F.regexp_replace(plain, "[^a-z]+", "")


def consonant_skeleton(c: Column) -> Column:
    """The folded form without its vowels."""
    return F.regexp_replace(fold_surface(c), "[aeiouy]+", "")


def gloss_tokens(c: Column, stop: list[str], least: int = 3) -> Column:
    """Distinct lower-case letter runs of ``least`` characters or more that are no stop words."""
    words = F.split(F.lower(c), r"[^\p{L}]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(stop)))


def midpoint(start: Column, end: Column) -> Column:
    """The integer middle of a range."""
    return F.floor((start + end) / 2).cast("long")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def weighted_sum(features: dict[str, Column], weights: dict[str, float]) -> Column:
    """Sum of weight times feature, in [-1, 1]; features without a weight are ignored, nulls count 0."""
    total = F.lit(0.0)
    for name in sorted(features):
        if name in weights:
            total = total + F.coalesce(features[name], F.lit(0.0)) * weights[name]
    return clamp(total, -1.0, 1.0)


def dot(a: Column, b: Column) -> Column:
    """The dot product of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; null where one has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def map_lookup(values: dict, key: Column, default) -> Column:
    """The value of a literal map, or a default."""
    if not values:
        return F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(default))


def content_id(prefix: str, *cols: Column) -> Column:
    """A deterministic id from the contents of columns; a null differs from an empty string."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in cols]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16))


def confidence_score(c: Column) -> Column:
    """low, medium and high as numbers; numbers pass through; anything else is 0."""
    name = F.lower(c)
    return F.coalesce(F.when(name == "low", 0.3).when(name == "medium", 0.6).when(name == "high", 0.9), c.try_cast("double"), F.lit(0.0))  # fixed values
