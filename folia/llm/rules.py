"""Quality rules: fixed base rules and robust multivariate outliers.

For each (lang, source) the vectors of transformed text statistics get a minimum-covariance-
determinant estimate of centre and scatter, and a text is rejected if its Mahalanobis distance
is beyond the cutoff. The estimate covers every row. It is begun twice, from medians and median
deviations (of exact histograms) and from the mean and scatter of all rows. Each concentration
step is one aggregation over all rows, in which rows are counted and summed up by distance bin;
the bins up to the one that completes the half-set (ties within a bin all count) give the next
centre and scatter. Steps go on until no determinant falls by over 1 %, and of a group's two
estimates the one of the lesser determinant stands. A group of fewer than ``LEAST`` rows takes
its language's estimate; if that has too few as well, the estimate over all rows of all
languages, however many. The column ``estimate`` says which it was.

Nothing of the size of the input reaches a task or the driver: a group, whatever share of the
rows it holds, is summed up in partial aggregates and arrives as at most ``BINS`` rows.

A null text has no words, null lang and source are groups like others (with the empty name).
Texts are taken whole, however long. Repeated rows get the same verdict; an empty table gives an
empty table. Columns of any other names are left alone.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.llm.common import forget, slices, stored, struct_array, struct_type, table, utf8

LEAST_WORDS, MOST_REPEATED = 50, 0.5
#: Share of a group that the estimate is drawn from, concentration steps at most, least rows of a group.
HALF, STEPS, LEAST = 0.75, 10, 20
#: Fall of a determinant, as a logarithm, below which it counts as settled.
SETTLED = 0.01
#: Normal quantile of the cutoff, in terms of chi-square.
QUANTILE = 5.0
#: The statistics, the end of their histograms, and the least deviation that counts as one.
STATISTICS = {"word_length": (8.0, 0.08), "symbols": (4.0, 0.07), "capitals": (1.0, 0.06), "marks": (4.0, 0.12)}
P, BINS = len(STATISTICS), 2048

SYMBOLS, CAPITALS, MARKS = "#*$%&|<>", bytes(range(65, 91)), b"!\"'()+,-./:;=?@[\\]^_`{}~"
SPACES = " \t\n\x0b\x0c\r"
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks"]


def text_stats(b: bytes) -> tuple[int, ...]:
    """The NAMES of a whole text."""
    text = b.decode("utf-8", "replace")
    words = b.split()  # bytes split at exactly the white space of the contract
    n = len(words)
    lines = [x for x in b.split(b"\n") if x.strip()]
    repeated = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            times, end = Counter(windows), 0
            for i, w in enumerate(windows):
                if times[w] > 1:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    return (
        n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated,
        len(b) - len(b.translate(None, CAPITALS)), len(b) - len(b.translate(None, MARKS)),
    )


@F.arrow_udf(struct_type(**dict.fromkeys(NAMES, T.LongType())))
def stats(texts: pa.Array) -> pa.Array:
    rows = [text_stats(b) for part in slices(texts) for b in part]
    return struct_array(NAMES, list(zip(*rows)) or [()] * len(NAMES), [pa.int64()] * len(NAMES))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < LEAST_WORDS) | (s["n_repeat_words"] * 100 > s["n_words"] * int(100 * MOST_REPEATED))


def vector(s: Column) -> list[Column]:
    """Transformed statistics, none below 0."""
    words = F.greatest(s["n_words"], F.lit(1)).cast("double")
    chars = F.greatest(s["word_chars"], F.lit(1)).cast("double")
    raw = [F.log(chars / words), F.sqrt(s["n_symbols"] / words), F.sqrt(s["n_capitals"] / chars), F.sqrt(s["n_marks"] / words)]
    return [F.greatest(v, F.lit(0.0)) for v in raw]


#: start: 0 from medians, 1 from means; det: logarithm of the scatter's determinant.
MODEL = "lang string, source string, start int, n long, mean array<double>, inverse array<double>, det double"


def _model(key: tuple, n: int, mean: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    cov = cov + np.diag([least * least for _, least in STATISTICS.values()])
    inverse, det = np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])
    return pd.DataFrame({"lang": [key[0]], "source": [key[1]], "start": [key[2]], "n": [n], "mean": [mean.tolist()], "inverse": [inverse.ravel().tolist()], "det": [det]})


def _middle(value: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(value, kind="stable")
    total = np.cumsum(n[order])
    return float(value[order][np.searchsorted(total, (total[-1] + 1) // 2)])


def _start(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    mean, spread = np.zeros(P), np.zeros(P)
    for d, (most, _) in enumerate(STATISTICS.values()):
        own = rows[rows["dim"] == d]
        value, n = (own["bin"].to_numpy() + 0.5) * most / BINS, own["n"].to_numpy()
        mean[d] = _middle(value, n)
        spread[d] = 1.4826 * _middle(np.abs(value - mean[d]), n)
    return _model((*key, 0), int(rows[rows["dim"] == 0]["n"].sum()), mean, np.diag(spread * spread))


def chi_square(quantile: float, p: int) -> float:
    """Wilson and Hilferty's value of chi-square with p degrees at a normal quantile."""
    return p * (1 - 2 / (9 * p) + quantile * math.sqrt(2 / (9 * p))) ** 3


def _chi_cdf(x: float, p: int) -> float:
    """Distribution function of chi-square by the series of the incomplete gamma function."""
    a, x = p / 2, x / 2
    term = total = 1 / a
    for k in range(1, 500):
        term *= x / (a + k)
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _consistency() -> float:
    """What a scatter of the HALF nearest rows is multiplied by to be one of all, if they are normal."""
    low, high = 1e-6, 100.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi_cdf(mid, P) < HALF else (low, mid)
    return HALF / _chi_cdf(low, P + 2)


CONSISTENCY = _consistency()


def _step(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("bin")
    n = rows["n"].to_numpy()
    total = int(n.sum())
    upto = int(np.searchsorted(np.cumsum(n), math.ceil(HALF * total))) + 1
    m = n[:upto].sum()
    mean = np.array([rows[f"s{i}"].to_numpy()[:upto].sum() for i in range(P)]) / m
    cov = np.empty((P, P))
    for i in range(P):
        for j in range(i, P):
            cov[i, j] = cov[j, i] = rows[f"s{i}_{j}"].to_numpy()[:upto].sum() / m - mean[i] * mean[j]
    cov *= CONSISTENCY
    values, vectors = np.linalg.eigh(cov)
    return _model(key, total, mean, (vectors * np.maximum(values, 0)) @ vectors.T)


def distance(x: list[Column], model: Column) -> Column:
    """Squared Mahalanobis distance."""
    away = [x[i] - model["mean"][i] for i in range(P)]
    parts = [away[i] * away[j] * model["inverse"][i * P + j] * (1.0 if i == j else 2.0) for i in range(P) for j in range(i, P)]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def _keys() -> tuple[Column, Column]:
    return F.coalesce(F.col("lang").cast("string"), F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit(""))


def fit(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(statistics of each row that passes the base rules, models of each (lang, source), of each lang, whose source is null, and of all, whose lang is null too)."""
    lang, source = _keys()
    rows = docs.select("doc_id", lang.alias("lang"), source.alias("source"), stats(utf8(text)).alias("s"))
    rows = stored(rows.select("doc_id", "lang", "source", "s.*"), "statistics")
    s = {n: F.col(n) for n in NAMES}
    good = rows.filter(~base_failed(s)).select("lang", "source", *[v.alias(f"x{i}") for i, v in enumerate(vector(s))])
    # Each row counts for its group, for its language and for all.
    none = F.lit(None).cast("string")
    keys = F.array(F.struct("lang", "source"), F.struct("lang", none.alias("source")), F.struct(none.alias("lang"), none.alias("source")))
    good = good.withColumn("k", F.explode(keys)).withColumns({"lang": F.col("k.lang"), "source": F.col("k.source")}).drop("k")
    x = [F.col(f"x{i}") for i in range(P)]
    cells = [F.struct(F.lit(i).alias("dim"), F.least(F.floor(x[i] * (BINS / most)), F.lit(BINS - 1)).cast("int").alias("bin")) for i, (most, _) in enumerate(STATISTICS.values())]
    counts = good.select("lang", "source", F.explode(F.array(*cells)).alias("c")).groupBy("lang", "source", "c.dim", "c.bin").agg(F.count("*").alias("n"))
    medians = counts.groupBy("lang", "source").applyInPandas(_start, MODEL)
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(P)] + [F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(P) for j in range(i, P)]
    of_all = good.groupBy("lang", "source").agg(F.count("*").alias("n"), *sums).withColumns({"start": F.lit(1), "bin": F.lit(0)})
    models = stored(medians.unionByName(of_all.groupBy("lang", "source", "start").applyInPandas(_step, MODEL)), "model")
    for k in range(STEPS):
        m = models.select(F.col("lang").alias("l"), F.col("source").alias("g"), "start", F.struct("mean", "inverse").alias("m"), F.col("det").alias("before"))
        same = F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("g"))
        bins = F.least(F.floor(F.log1p(distance(x, F.col("m"))) * 128), F.lit(BINS - 1)).cast("int").alias("bin")
        steps = good.join(m, same).groupBy("lang", "source", "start", bins).agg(F.count("*").alias("n"), *sums)
        before, models = models, stored(steps.groupBy("lang", "source", "start").applyInPandas(_step, MODEL), "model")
        fall = models.join(m.withColumnRenamed("start", "s"), same & (F.col("start") == F.col("s"))).agg(F.max(F.col("before") - F.col("det"))).first()[0]
        forget(before)
        if fall is None or k and fall < SETTLED:
            break
    least = models.groupBy("lang", "source").agg(F.min_by(F.struct("n", "mean", "inverse", "det"), F.struct("det", "start")).alias("m"))
    models = stored(least.select("lang", "source", "m.*"), "model")
    return rows, models


def verdicts(rows: DataFrame, models: DataFrame, s: Column | dict) -> DataFrame:
    """The rows, which have lang and source keys _lang and _source, with base_failed, distance and kept."""
    enough = models.filter(F.col("n") >= LEAST)
    of_group = enough.filter(F.col("source").isNotNull()).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.struct("mean", "inverse").alias("_own"))
    of_lang = enough.filter(F.col("lang").isNotNull() & F.col("source").isNull()).select(F.col("lang").alias("_lang"), F.struct("mean", "inverse").alias("_wide"))
    of_all = models.filter(F.col("lang").isNull()).select(F.struct("mean", "inverse").alias("_all"))
    rows = rows.join(of_group, ["_lang", "_source"], "left").join(of_lang, "_lang", "left").join(F.broadcast(of_all), F.lit(True), "left")
    d = distance(vector(s), F.coalesce(F.col("_own"), F.col("_wide"), F.col("_all")))
    used = F.when(F.col("_own").isNotNull(), "source").when(F.col("_wide").isNotNull(), "language").when(F.col("_all").isNotNull(), "all")
    failed = base_failed(s)
    return rows.select("*", failed.alias("base_failed"), used.alias("estimate"), d.alias("distance"), (~failed & F.coalesce(d <= chi_square(QUANTILE, P), F.lit(True))).alias("kept"))


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, the statistics, base_failed, the estimate used, distance and kept of each row."""
    rows, models = fit(docs, text)
    rows = rows.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    return verdicts(rows, models, {n: F.col(n) for n in NAMES}).select("doc_id", *NAMES, "base_failed", "estimate", "distance", "kept")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that are kept, with their own columns; texts stay where they are, only models move."""
    _, models = fit(docs, text)
    lang, source = _keys()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), lang.alias("_lang"), source.alias("_source"), stats(utf8(text)).alias("_s"))
    return verdicts(whole, models, F.col("_s")).filter("kept").select("_row.*")


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "estimate", "distance"
    )


def rules_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8_rules that don't hang on estimates."""
    s = {n: F.col(n) for n in NAMES}
    rows = table(spark, sf_dir, "documents").select("doc_id", stats(utf8()).alias("s")).select("doc_id", "s.*")
    return rows.select("doc_id", *NAMES[:5], base_failed(s).alias("base_failed"))


QUERIES = {"op8_rules": op8_rules, "rules_base_columns": rules_base_columns}
SQL: dict[str, str] = {}
