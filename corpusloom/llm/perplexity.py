"""Quality by perplexity under a Kneser-Ney model of trusted text, with thresholds by language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kneser_ney
from ._shared import written


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.99, min_calibration: int = 50) -> DataFrame:
    """doc_id, n_tokens, log10_prob, perplexity, stratum, threshold, kept for every row.

    Trusted text: documents labelled quality 1 (a label that stands repeated counts once), all of it at every size.  A hash of the id
    halves it: one half trains the model, every document of the other, which the model hasn't seen, counts for the threshold of its
    language, the smallest perplexity that a share ``quantile`` of them doesn't exceed.  Languages with fewer than ``min_calibration`` of
    them have no threshold and lose nothing.  A null language is a stratum of its own.  Texts that are null or have no word have
    perplexity of their end alone and are not kept.  Repeated rows are judged alike.

    Plan: texts whose hash says so, half of all, meet the labels in a hash join by id at every size, as labels grow with the table; the
    training half is written once and counted in shards as in ``kneser_ney.train``; one pass without a shuffle scores
    whole texts, workers map the model's files, so no memory grows with the model.  Thresholds are exact: held-out perplexities,
    numbers alone, are sorted by language."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("stratum"))
    good = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    trains = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (1 << 19)
    model = kneser_ney.train(written(src.filter(trains).select("doc_id", "text").join(good.hint("shuffle_hash"), "doc_id", "left_semi").select("text"), "trusted"))
    scored = kneser_ney.score(src, model, along=("stratum",)).select("doc_id", "n_tokens", F.round("score", 6).alias("log10_prob"), "stratum")
    known = written(scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("log10_prob") / F.col("n_tokens"))), "perplexity")
    held = known.filter("n_tokens > 1").filter(~trains).join(good, "doc_id", "left_semi")
    one = W.partitionBy("stratum")
    ranked = held.select("stratum", F.col("perplexity").alias("threshold"), F.row_number().over(one.orderBy("perplexity")).alias("rank"), F.count("*").over(one).alias("c"))
    limits = ranked.filter((F.col("c") >= min_calibration) & (F.col("rank") == F.greatest(F.lit(1), F.ceil(F.round(F.col("c") * quantile, 6))))).select("stratum", "threshold")
    out = known.join(limits, "stratum", "left")
    kept = (F.col("n_tokens") > 1) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "n_tokens", "log10_prob", "perplexity", "stratum", "threshold", kept.alias("kept"))
