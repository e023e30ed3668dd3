"""Toxicity: a sparse logistic classifier with a counterfactual penalty.

Features are the distinct words of a text and their first four and five bytes (for inflected and
compound forms), as 64-bit hashes.  In labelled texts that name a group of people, the identity
terms are swapped for others of their kind, and the squared change of the score is penalised, so
that a neutral mention of a group carries no weight of its own.  An L1 term keeps common words
at exactly zero, so the length of a text does not move its score.

The terms are those of English, German, French and Spanish.  Where no labelled text names a group there is
nothing to swap, and a term that the classifier never saw has no weight to begin with.

The classifier is fitted on the driver, from the feature hashes of a bounded sample of labelled
rows (``sample_rows``); scoring runs over all rows and whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_array, release, slices, table, text_buffers, word_hashes

#: terms within a row stand for groups of one kind, in one language, and are swapped for one another
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "citizens", "foreigners"),
    ("disabled", "deaf", "blind", "autistic"),
    ("old", "young", "elderly"),
    # German
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("weiblich", "männlich"),
    ("weibliche", "männliche"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("christlich", "muslimisch", "jüdisch", "hinduistisch", "buddhistisch", "atheistisch"),
    ("schwarze", "weiße", "asiatische", "afrikanische", "europäische"),
    ("schwule", "lesbische", "bisexuelle", "queere"),
    ("einwanderer", "flüchtlinge", "bürger", "ausländer"),
    ("behinderte", "gehörlose", "blinde", "autistische"),
    # French
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"),
    ("noirs", "blancs", "asiatiques", "africains", "européens"),
    ("gays", "lesbiennes", "bisexuels", "hétérosexuels"),
    ("immigrés", "réfugiés", "citoyens", "étrangers"),
    ("handicapés", "sourds", "aveugles", "autistes"),
    # Spanish
    ("mujeres", "hombres", "niñas", "niños"),
    ("mujer", "hombre"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos"),
    ("lesbianas", "bisexuales", "heterosexuales"),
    ("inmigrantes", "refugiados", "ciudadanos", "extranjeros"),
    ("discapacitados", "sordos", "ciegos", "autistas"),
)

_SEP = np.ones(256, bool)
_SEP[48:58] = _SEP[65:91] = _SEP[97:123] = _SEP[128:] = False


def _hash_words(terms) -> np.ndarray:
    buf, off = text_buffers(pa.array(list(terms)))
    return word_hashes(buf, off, _SEP)[0]


def _feature_rows(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, is_word) of every word and prefix of each text, not yet distinct."""
    buf, off = text_buffers(column)
    h, start, end, first = word_hashes(buf, off, _SEP)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    parts, rows = [h], [row]
    for k in (4, 5):
        long = end - start > k
        s = start[long]
        x = np.full(len(s), k, np.uint64)
        for i in range(k):  # a prefix is hashed apart from words
            b = buf[s + i].astype(np.uint64)
            b = np.where((b >= 65) & (b <= 90), b + 32, b)
            x = (x * np.uint64(0x100000001B3)) ^ (b + np.uint64(17)) * np.uint64(0x9E3779B97F4A7C15)
        parts.append(x)
        rows.append(row[long])
    return np.concatenate(rows), np.concatenate(parts), np.r_[np.ones(len(h), bool), np.zeros(sum(map(len, parts)) - len(h), bool)]


def _distinct(row: np.ndarray, feat: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.lexsort((feat, row))
    row, feat = row[order], feat[order]
    keep = np.r_[True, (row[1:] != row[:-1]) | (feat[1:] != feat[:-1])] if len(row) else np.zeros(0, bool)
    row, feat = row[keep], feat[keep]
    cut = np.searchsorted(row, np.arange(n + 1))
    return [feat[a:b] for a, b in zip(cut[:-1], cut[1:])]


def _swapped(feat: np.ndarray, words: np.ndarray, prefixes: dict[int, list[np.ndarray]], mate: dict[int, int]) -> np.ndarray:
    """The distinct features after every identity term is swapped for the next of its kind."""
    here = [int(w) for w in feat if int(w) in mate]
    if not here:
        return feat[:0]
    gone = np.unique(np.concatenate([prefixes[w][0] for w in here]))
    new = np.concatenate([prefixes[mate[w]][0] for w in here])
    return np.unique(np.concatenate((feat[~np.isin(feat, gone)], new)))


def _identity_tables(terms):
    feats: dict[int, list[np.ndarray]] = {}
    mate: dict[int, int] = {}
    for kind in terms:
        hashes = [int(x) for x in _hash_words(kind)]
        for term, h in zip(kind, hashes):
            feats[h] = [np.unique(_feature_rows(pa.array([term]))[1])]
        for i, h in enumerate(hashes):
            mate[h] = hashes[(i + 1) % len(hashes)]
    return feats, mate


def _sample_features(terms):
    feats, mate = _identity_tables(terms)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                row, feat, _ = _feature_rows(part.column(1))
                rows = _distinct(row, feat, part.num_rows)
                other = [_swapped(r, r, feats, mate) for r in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), list_array([r.view(np.int64) for r in rows]), list_array([o.view(np.int64) for o in other])], ["y", "x", "swapped"])
        release()

    return run


def objective(w: np.ndarray, b: float, y: np.ndarray, plain, changed, counterfactual: float) -> tuple[float, np.ndarray, float]:
    """The smooth part of what :func:`fit` minimises, and its gradient in ``w`` and ``b``.

    ``plain`` is (row, feature) of the texts, ``changed`` is (row, feature, +1 or -1) of the features that a text has
    before (+1) and after (-1) the swap of its identity terms.
    """
    (rx, fx), (rd, fd, sd), n = plain, changed, len(y)
    s = np.clip(np.bincount(rx, w[fx], minlength=n) + b, -30, 30)
    r = (1 / (1 + np.exp(-s)) - y) / n
    value, g = float(np.mean(np.logaddexp(0, s) - y * s)), np.bincount(fx, r[rx], minlength=len(w))
    if len(rd):
        d = np.bincount(rd, sd * w[fd], minlength=n)
        value += counterfactual * float(np.mean(d * d))
        g = g + counterfactual * 2 / n * np.bincount(fd, sd * d[rd], minlength=len(w))
    return value, g, float(r.sum())


def fit(labelled: DataFrame, label_col: str = "label", text_col: str = "text", terms=IDENTITY_TERMS, min_df: int = 3, counterfactual: float = 1.0, l1: float = 2e-4, steps: int = 80) -> dict:
    """Fit on the rows of ``labelled`` (a bounded table: its features come to the driver).

    Minimises mean log loss + ``counterfactual`` * mean squared score change under the swap + ``l1`` * |w|.
    Features that fewer than ``min_df`` of the texts have are left out, or fewer than a tenth of the texts where that is less (under 30 texts).
    With no rows the model gives 0.5 for everything; with one class it gives that class's smoothed rate.  ``rows`` and
    ``swapped_rows`` of the result tell how many rows it saw and how many of them name a group.
    """
    rows = labelled.select(F.col(label_col).cast("int").alias("y"), F.col(text_col).cast("string").alias("text")).where("y is not null")
    got = rows.mapInArrow(_sample_features(terms), "y int, x array<long>, swapped array<long>").toArrow()
    y = got.column("y").to_numpy().astype(np.float64)
    if not len(y):
        return {"features": np.zeros(0, np.uint64), "w": np.zeros(0), "b": 0.0, "rows": 0, "swapped_rows": 0}
    flat = lambda c: (c.combine_chunks().flatten().to_numpy().view(np.uint64), np.diff(c.combine_chunks().offsets.to_numpy()))
    x, nx = flat(got.column("x"))
    z, nz = flat(got.column("swapped"))
    names, df = np.unique(x, return_counts=True)
    keep = df >= min(min_df, max(1, len(y) // 10))
    names = names[keep]

    def indexed(values, sizes):
        at = np.minimum(np.searchsorted(names, values), max(len(names) - 1, 0))
        ok = names[at] == values if len(names) else np.zeros(len(values), bool)
        return np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[ok], at[ok].astype(np.int32)

    rx, fx = indexed(x, nx)
    del x
    has = np.flatnonzero(nz)
    rz, fz = indexed(z, nz)
    mine = np.isin(rx, has)
    rd, fd, sd = np.r_[rx[mine], rz], np.r_[fx[mine], fz], np.r_[np.ones(mine.sum()), -np.ones(len(rz))]
    n, m = len(y), len(names)
    told = {"rows": n, "swapped_rows": len(has)}
    positive = y.mean()
    b0 = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    if not m or positive in (0.0, 1.0):
        return {"features": names[:0], "w": np.zeros(0), "b": b0} | told
    # a diagonal bound on the curvature scales the steps
    scale = np.bincount(fx, minlength=m) / (4 * n) + counterfactual * 2 * np.bincount(fd, minlength=m) / n + 1e-4
    w, b, v, vb, t = np.zeros(m), b0, np.zeros(m), b0, 1.0
    lazy = 0.15  # rows share features, so the diagonal alone is too long a step
    for _ in range(steps):
        _, g, gb = objective(v, vb, y, (rx, fx), (rd, fd, sd), counterfactual)
        step = lazy / scale
        new = v - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        nb = vb - 2.0 * gb
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if g @ (new - w) > 0:  # restart the momentum when it points uphill
            t2, v, vb = 1.0, new, nb
        else:
            v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    live = w != 0
    return {"features": names[live], "w": w[live], "b": float(b)} | told


def _scores(model: dict, texts) -> np.ndarray:
    """The score of each text of an Arrow string column; nulls count as empty."""
    names, w = model["features"], model["w"]
    total = np.full(len(texts), model["b"])
    if len(names):
        row, feat, _ = _feature_rows(texts)
        i = np.minimum(np.searchsorted(names, feat), len(names) - 1)
        hit = names[i] == feat
        pair = np.unique(row[hit].astype(np.int64) * len(names) + i[hit])
        total += np.bincount(pair // len(names), w[pair % len(names)], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _score_rows(model: dict):
    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(_scores(model, part.column(part.num_columns - 1)))], [*part.schema.names[:-1], "score"])
        release()

    return run


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, h, score)`` for every row, ``h`` the hash of its text; null and empty texts get the score of no words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(_score_rows(model), f"doc_id {kind}, h long, score double")


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, sample_rows: int) -> DataFrame:
    """``(label, text)``: at most ``sample_rows`` labelled rows outside the held-out fold, chosen by hash.

    The fold is ``crc32(doc_id as text) mod 5 = 0``.  Rows without a label are left out; an id with several
    labels counts with each.
    """
    ids = labels.select("doc_id", F.col(label_col).alias("label")).where("label is not null and doc_id is not null")
    ids = ids.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)  # the bound of the broadcast below
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("label", "text")


def _predicted(docs: DataFrame, model: dict) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return score(docs, model).select("doc_id", "h", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = 10_000) -> DataFrame:
    """``(doc_id, h, held_out, score, predicted)`` for every row of ``docs``; see :func:`fit` and :func:`score`.

    The labels join by id; repeated rows are scored each; a null id is held out of nothing.
    """
    return _predicted(docs, fit(training_rows(docs, labels, "toxic", sample_rows)))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = 10_000) -> DataFrame:
    """The rows of ``docs`` that the classifier does not call toxic; all of them where there is no label to learn from.

    Rows are judged where they are, each by its own text, so rows that repeat an id may differ.
    """
    model = fit(training_rows(docs, labels, "toxic", sample_rows))
    if not model["rows"]:
        return docs
    text = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                yield part.filter(pa.array(_scores(model, part.column(text).cast(pa.string())) < 0.5))
        release()

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark, sf_dir):
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("h")
