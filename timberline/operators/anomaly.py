"""Scores of windows, the robust threshold, predictions, metrics and what to look at.

The scorer is exchangeable; the one here is an interpolated bigram model of the training windows. It
keeps the contract of a perplexity, but its numbers aren't comparable to a neural model's.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.operators.corpus import tokens
from timberline.operators.ranks import median

ADD, MIX = 0.1, 0.5


class Scorer(Protocol):
    def fit(self, windows: DataFrame) -> Scorer: ...
    def score(self, windows: DataFrame) -> DataFrame:
        """``windows`` with ``ppl``, null where a window cannot be scored."""


def _bigrams(windows: DataFrame) -> DataFrame:
    """(window_id, at, prev, token): tokens with the one before, across lines; digits are one symbol."""
    words = tokens(F.regexp_replace("text", r"\d+", "0"))
    seq = F.concat(F.array(F.lit("<s>")), words)
    both = F.transform(words, lambda t, i: F.struct((i + 1).alias("at"), F.get(seq, i).alias("prev"), t.alias("token")))
    return windows.select("window_id", F.explode(both).alias("x")).select("window_id", "x.*")


class BigramScorer:
    """exp of the mean negative log-probability of a window's tokens, half bigram and half unigram."""

    def fit(self, windows: DataFrame) -> BigramScorer:
        grams = _bigrams(windows)
        self.bi = grams.groupBy("prev", "token").agg(F.count("*").alias("n_bi"))
        self.prev = self.bi.groupBy("prev").agg(F.sum("n_bi").alias("n_prev"))
        self.uni = self.bi.groupBy("token").agg(F.sum("n_bi").alias("n_uni"))
        self.total = self.uni.agg(F.struct(F.coalesce(F.sum("n_uni"), F.lit(0)).alias("n"), F.count("*").alias("v")).alias("s"))
        return self

    def score(self, windows: DataFrame) -> DataFrame:
        # each distinct pair is looked up once, however often it occurs
        grams = _bigrams(windows).groupBy("window_id", "prev", "token").agg(F.count("*").alias("times"))
        pairs = grams.select("prev", "token").distinct().join(self.bi, ["prev", "token"], "left").join(self.prev, "prev", "left").join(self.uni, "token", "left")
        s = self.total.scalar()
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        size = s["v"] + 1
        p = MIX * (zero("n_bi") + ADD) / (zero("n_prev") + ADD * size) + (1 - MIX) * (zero("n_uni") + ADD) / (s["n"] + ADD * size)
        scored = grams.join(pairs.select("prev", "token", F.log(p).alias("lp")), ["prev", "token"])
        per = scored.groupBy("window_id").agg((-F.sum(F.col("lp") * F.col("times")) / F.sum("times")).alias("loss"))
        return windows.join(per.select("window_id", F.exp("loss").alias("ppl")), "window_id", "left")


def threshold(scored: DataFrame, k: float = 3.0) -> DataFrame:
    """One row (median, mad, threshold) over the windows of label 0: median + k * MAD, interpolated; nulls
    without any. It reads ``scored`` several times."""
    benign = scored.filter((F.col("label") == 0) & F.col("ppl").isNotNull() & ~F.isnan("ppl")).select(F.col("ppl").cast("double").alias("ppl"))
    mid = median(benign, F.col("ppl"))
    mad = None if mid is None else median(benign, F.abs(F.col("ppl") - F.lit(mid)))
    return scored.sparkSession.createDataFrame([(mid, mad, None if mad is None else mid + k * mad)], "median double, mad double, threshold double")


def predicted(scored: DataFrame, limit: Column) -> DataFrame:
    """``scored`` with ``prediction``: 1 where ppl is strictly above the limit; never for null or NaN."""
    return scored.withColumn("prediction", F.when(F.col("ppl").isNotNull() & ~F.isnan("ppl") & (F.col("ppl") > limit), 1).otherwise(0))


def metrics(rows: DataFrame) -> DataFrame:
    """One row of tp, fp, fn, tn, precision, recall and f1; a ratio over nothing is 0."""
    hit, label = F.col("prediction") == 1, F.col("label") == 1
    agg = rows.agg(F.count_if(hit & label).alias("tp"), F.count_if(hit & ~label).alias("fp"), F.count_if(~hit & label).alias("fn"), F.count_if(~hit & ~label).alias("tn"))
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    out = agg.withColumn("precision", safe(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def audit(rows: DataFrame, kind: str, limit: Column | None = None, n: int = 10) -> DataFrame:
    """The ``n`` windows of the highest (top) or lowest (bottom) score, or nearest the limit (boundary)."""
    return _placed(rows, kind, limit).orderBy("_key", "window_id").limit(n).drop("_key")


def _placed(rows: DataFrame, kind: str, limit: Column | None) -> DataFrame:
    scored = rows.filter(F.col("ppl").isNotNull() & ~F.isnan("ppl"))
    key = {"top": lambda: -F.col("ppl"), "bottom": lambda: F.col("ppl"), "boundary": lambda: F.abs(F.col("ppl") - limit)}[kind]
    return scored.withColumn("_key", key())


def ranked_audit(rows: DataFrame, kind: str, limit: Column | None = None, n: int = 10) -> DataFrame:
    """The same with ``place``, from 1."""
    top = _placed(rows, kind, limit).orderBy("_key", "window_id").limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy("_key", "window_id"))).drop("_key")  # of n rows


class FixedThreshold:
    """Classifies lines as they come, by a scorer and a fixed limit."""

    def __init__(self, scorer: Scorer, limit: float = 21.5):
        self.scorer, self.limit = scorer, limit

    def classify(self, windows: DataFrame) -> DataFrame:
        return predicted(self.scorer.score(windows), F.lit(self.limit))

    @staticmethod
    def accuracy(rows: DataFrame) -> DataFrame:
        """Share of right predictions over all rows; an unscored one counts as wrong."""
        right = F.col("ppl").isNotNull() & ~F.isnan("ppl") & (F.col("prediction") == F.col("label"))
        return rows.agg(F.round(F.coalesce(F.avg(right.cast("double")), F.lit(0.0)), 6).alias("accuracy"))
