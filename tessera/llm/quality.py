"""Robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

Each text gives five statistics, transformed towards symmetry (STATISTICS).  For each group of language and source,
the location and scatter of the half-and-more of its documents with the least scatter determinant are estimated
by concentration steps over all documents: distances under the present estimate are counted in fine logarithmic
bins with the sums that a covariance needs, so one map-side aggregation gives the next estimate, and no task ever
holds a group.  Two deterministic starts run side by side; the one with the smaller determinant is reweighted once,
and documents beyond the cutoff are rejected.  Groups of fewer than MIN_GROUP documents cannot carry an estimate of five
means and fifteen covariances, so they are pooled per language, then over all languages.

Defined results: a null text has no words, so it fails the base rules; null languages and sources are groups of their
own; documents that fail the base rules take no part in the estimates; if fewer than MIN_GROUP documents are left to
a pool, nothing in it is rejected; repeated rows are judged each, and of equal statistics all or none go; an empty table
gives no rows; columns but doc_id, text, lang and source are not read, whatever their names; a very long text is held
whole by one worker, with some 40 bytes for each of its words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, saved, small_batches, to_batch

#: Name and least standard deviation (so that a statistic which hardly varies rejects no one for a trifle).  With the
#: cutoff of six of them, the last rejects by itself from a third of repeated words on, where a source has none.
STATISTICS = [("log_words", 0.5), ("log_word_length", 0.08), ("symbol_root", 0.06), ("dup_line_root", 0.12), ("repeat_root", 0.1)]
D = len(STATISTICS)
#: Five documents for each statistic.
MIN_GROUP = 5 * D
#: Groups whose estimates (some 600 bytes each) are broadcast; more are joined otherwise.
BROADCAST = 50_000
SHARE = 0.75  # of a group's documents that the estimate rests on
STEPS = 6
#: A clean document goes with less than this probability, were the statistics normal.
ALPHA = 1e-6
SYMBOLS = b"#*$%&|<>"


def text_statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # at the six ASCII white spaces, as bytes know no others
    n = len(words)
    chars = len(text) - (len(data) - sum(map(len, words)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeat = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
        pair = w[:-1] * len(ids) + w[1:]
        if len(ids) > 1 << 20:
            pair = np.unique(pair, return_inverse=True)[1]
        three = pair[:-1] * len(ids) + w[2:]
        if len(np.unique(three)) < len(three):
            _, where, count = np.unique(three, return_inverse=True, return_counts=True)
            at = np.flatnonzero(count[where] > 1)
            hit = np.zeros(n, bool)
            hit[at] = hit[at + 1] = hit[at + 2] = True
            repeat = int(hit.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeat


BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def base_rules(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, lang, source, the statistics, base_failed, x (the transformed vector; null if failed), pair (of lang and
    source), and with ``whole`` the row itself as __row, so that rows need not be joined with their texts again."""
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in BASE.split(", ")]
    kinds = [("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), *[(n, pa.int64()) for n in names]]

    def work(batches):
        for b in batches:
            rows = [text_statistics(t) if t else (0,) * 5 for t in b.column(3).to_pylist()]
            made = dict(zip(names, np.array(rows, np.int64).reshape(-1, 5).T))
            columns = [b.column(k) if k in b.schema.names else pa.array(made[k], kind) for k, kind in kinds]
            yield pa.RecordBatch.from_arrays(columns + [b.column(i) for i in range(4, b.num_columns)], [k for k, _ in kinds] + ["__row"] * whole)

    row = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("__row")
    source = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), "text", *[row] * whole)
    schema = T.StructType.fromDDL(f"doc_id long, lang string, source string, {BASE}")
    out = source.mapInArrow(work, schema.add(source.schema["__row"]) if whole else schema)
    out = out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    x = F.array(F.log("n_words"), F.log(F.expr("word_chars / n_words")), F.sqrt(F.expr("n_symbols / n_words")), F.sqrt(F.expr("10 * n_dup_lines / n_words")), F.sqrt(F.expr("n_repeat_words / n_words")))
    return out.withColumn("x", F.when(~F.col("base_failed"), x)).withColumn("pair", F.to_json(F.struct("lang", "source")))


def chi2_cdf(x: float, k: int) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while abs(term) > 1e-16 * abs(total):
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return (lo + hi) / 2


def consistency(share: float) -> float:
    """What the covariance of the innermost share of a normal sample falls short by."""
    return share / chi2_cdf(chi2_quantile(share, D), D + 2)


def distance(x: Column, centre: Column, precision: Column) -> Column:
    gap = [x[i] - centre[i] for i in range(D)]
    terms = [gap[i] * gap[j] * precision[i * D + j] * (1 if i == j else 2) for i in range(D) for j in range(i, D)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return F.greatest(out, F.lit(0.0))


ESTIMATE = "group string, start int, n long, centre array<double>, precision array<double>, logdet double"
TRIANGLE = [(i, j) for i in range(D) for j in range(i, D)]


def moments() -> list[Column]:
    x = F.col("x")
    return [F.count("*").alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(D)], *[F.sum(x[i] * x[j]).alias(f"q{i}{j}") for i, j in TRIANGLE]]


def estimate(n: float, sums: np.ndarray, squares: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray, float]:
    centre = sums / n
    scatter = np.zeros((D, D))
    for (i, j), q in zip(TRIANGLE, squares):
        scatter[i, j] = scatter[j, i] = q / n - centre[i] * centre[j]
    # in no direction less than the least standard deviations, or a scatter of linked statistics would be singular
    floors = np.array([s for _, s in STATISTICS])
    value, axes = np.linalg.eigh(factor * scatter / np.outer(floors, floors))
    scatter = (axes * np.maximum(value, 1.0)) @ axes.T * np.outer(floors, floors)
    return centre, np.linalg.inv(scatter), float(np.linalg.slogdet(scatter)[1])


def meet(rows: DataFrame, table: DataFrame, key: str, size: str, n_rows: int, how: str = "inner") -> DataFrame:
    """rows with the table's columns; the table has one row for each key, which ``size`` rows have."""
    if table.count() <= BROADCAST:
        return rows.join(F.broadcast(table.drop(size)), key, how)
    return attach(rows, table, key, size, n_rows, how).drop(size)


def concentrate(vectors: tuple[DataFrame, int], present: DataFrame, sizes: DataFrame, share: float | None) -> DataFrame:
    """The next estimates: from the innermost share of each group, or, if None, from all within the 97.5 % ellipsoid."""
    each = present.groupBy("group").agg(F.collect_list(F.struct("start", "centre", "precision")).alias("starts"))  # two at most
    rows, n_rows = vectors
    met = meet(rows, saved(each.join(sizes, "group"), "present"), "group", "n", n_rows).select("group", "x", F.explode("starts").alias("s")).select("group", "x", "s.*")
    d2 = distance(F.col("x"), F.col("centre"), F.col("precision"))
    if share is None:
        met, at, factor = met.filter(d2 <= chi2_quantile(0.975, D)), F.lit(0), consistency(0.975)
    else:
        at, factor = F.floor(16 * F.log(d2 + 1e-6)).cast("int"), consistency(share)
    bins = met.groupBy("group", "start", at.alias("bin")).agg(*moments())

    def step(pdf):
        """At most some 700 bins of one group and start."""
        pdf = pdf.sort_values("bin")
        total = int(pdf["n"].sum())
        if share is not None:
            pdf = pdf[(pdf["n"].cumsum() - pdf["n"]) < max(share * total, 1)]
        n = int(pdf["n"].sum())
        centre, precision, logdet = estimate(n, pdf[[f"s{i}" for i in range(D)]].sum().to_numpy(), pdf[[f"q{i}{j}" for i, j in TRIANGLE]].sum().to_numpy(), factor)
        return type(pdf)({"group": [pdf["group"].iloc[0]], "start": [int(pdf["start"].iloc[0])], "n": [n], "centre": [centre.tolist()], "precision": [precision.ravel().tolist()], "logdet": [logdet]})

    return bins.groupBy("group", "start").applyInPandas(step, ESTIMATE)


def starts(vectors: tuple[DataFrame, int], sizes: DataFrame) -> DataFrame:
    """Medians with scaled median deviations, and with the covariance of spatial signs."""
    x = F.col("x")
    rows, n_rows = vectors
    middle = saved(rows.groupBy("group").agg(F.array(*[F.percentile_approx(x[i], 0.5, 2000) for i in range(D)]).alias("m")).join(sizes, "group"), "medians")
    gaps = meet(rows, middle, "group", "n", n_rows).select("group", "m", F.array(*[x[i] - F.col("m")[i] for i in range(D)]).alias("x"))
    floors = [s for _, s in STATISTICS]
    unit = F.sqrt(sum(((x[i] / floors[i]) ** 2 for i in range(D)), F.lit(1e-12)))
    spread = gaps.groupBy("group").agg(F.first("m").alias("m"), F.count("*").alias("n"), *[F.percentile_approx(F.abs(x[i]), 0.5, 2000).alias(f"d{i}") for i in range(D)], *[F.avg(x[i] * x[j] / unit / unit).alias(f"q{i}{j}") for i, j in TRIANGLE])

    def begin(pdf):
        r = pdf.iloc[0]
        scale = np.array([max(1.4826 * r[f"d{i}"], floors[i]) for i in range(D)])
        sign = np.zeros((D, D))
        for i, j in TRIANGLE:
            sign[i, j] = sign[j, i] = r[f"q{i}{j}"]
        sign *= (scale**2).sum() / max(np.trace(sign), 1e-12)
        both = [np.diag(scale**2), sign + np.diag(np.square(floors))]
        return type(pdf)({"group": [r["group"]] * 2, "start": [0, 1], "n": [int(r["n"])] * 2, "centre": [list(r["m"])] * 2, "precision": [np.linalg.inv(s).ravel().tolist() for s in both], "logdet": [float(np.linalg.slogdet(s)[1]) for s in both]})

    return spread.groupBy("group").applyInPandas(begin, ESTIMATE)


def grouped(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pair, group, rows of every pair that has documents past the base rules and a group; group, n."""
    sizes = saved(stats.filter("not base_failed").groupBy("pair", "lang").agg(F.count("*").alias("rows")), "group_sizes")
    small = F.col("rows") < MIN_GROUP
    pools = sizes.filter(small).groupBy("lang").agg(F.sum("rows").alias("in_lang")).withColumnRenamed("lang", "__lang")
    pool = F.when(F.col("in_lang") >= MIN_GROUP, F.to_json(F.struct("lang", F.lit(1).alias("pool")))).otherwise(F.lit("pool"))
    named = sizes.filter(small).join(pools, F.col("lang").eqNullSafe(F.col("__lang"))).select("pair", pool.alias("group"), "rows")
    named = saved(sizes.filter(~small).select("pair", F.col("pair").alias("group"), "rows").unionByName(named), "group_names")
    enough = saved(named.groupBy("group").agg(F.sum("rows").alias("n")).filter(F.col("n") >= MIN_GROUP), "groups")
    return saved(named.join(enough.select("group"), "group", "left_semi"), "named"), enough


def least_determinants(vectors: tuple[DataFrame, int], sizes: DataFrame) -> DataFrame:
    """The better of both starts of each group, after the concentration steps."""
    present = saved(starts(vectors, sizes), "starts")
    for _ in range(STEPS):
        present = saved(concentrate(vectors, present, sizes, SHARE), "step")
    return saved(present.groupBy("group").agg(F.min_by(F.struct(*present.columns), F.struct("logdet", "start")).alias("b")).select("b.*"), "best")


def judged(docs: DataFrame, alpha: float, whole: bool) -> DataFrame:
    stats = saved(base_rules(docs, whole), "statistics")
    names, sizes = grouped(stats)
    passed = stats.filter("not base_failed").select("pair", "x")
    n_rows = passed.count()
    vectors = saved(meet(passed, names, "pair", "rows", n_rows).select("group", "x"), "vectors"), n_rows
    final = concentrate(vectors, least_determinants(vectors, sizes), sizes, None).select("group", "centre", "precision")
    final = saved(names.join(final, "group").select("pair", "centre", "precision", "rows"), "final")
    met = meet(stats, final, "pair", "rows", stats.count(), "left")
    d2 = F.when(F.col("x").isNotNull() & F.col("centre").isNotNull(), distance(F.col("x"), F.col("centre"), F.col("precision")))
    kept = ~F.col("base_failed") & (F.coalesce(d2, F.lit(0.0)) <= chi2_quantile(1 - alpha, D))
    return met.withColumn("kept", kept).withColumn("distance", F.sqrt(d2))


def robust_outliers(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance, lang, source."""
    out = judged(docs, alpha, False)
    return out.select("doc_id", *[x.split()[0] for x in BASE.split(", ")], "base_failed", "kept", "distance", "lang", "source")


def drop_outliers(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The rows of docs that are kept, with all their columns; texts are not shuffled."""
    out = judged(docs, alpha, True).filter("kept")
    return out.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
