"""From potential matches to trusted ones: one-to-one matching, scale gate, weighted bins."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ratios import scale_ratio

LEAST_MATCHES = 5
BATCH = 5
BINS = 10
#: Columns of a match.
MATCH = "image_id long, run_id long, quad_id long, cell_id string, pass int, subcell int, pos long, scale_ratio double, x double, y double, mid_ra double, mid_dec double"
_NAMES = [c.split()[0] for c in MATCH.split(", ")]


def _run():
    return Window.partitionBy("image_id", "run_id")


def _take(pairs: pd.DataFrame) -> pd.DataFrame:
    """Image quads in order of r0, in batches of five: each takes the first catalog quad that no
    earlier batch has taken. Within a batch two may take the same one."""
    pairs = pairs.sort_values(["quad_id", "offset_pos", "cell_id", "pass", "subcell", "pos"])
    keys = list(zip(pairs["quad_id"], pairs["cell_id"], pairs["pass"], pairs["subcell"], pairs["pos"], strict=True))
    used, kept = set(), []
    for _, batch in itertools.groupby(enumerate(keys), key=lambda r: r[1][0] // BATCH):
        taken = {}
        for at, (quad, *catalog) in batch:
            if quad not in taken and tuple(catalog) not in used:
                taken[quad] = tuple(catalog)
                kept.append(at)
        used.update(taken.values())
    return pairs.iloc[kept][_NAMES]


def one_to_one(potential: DataFrame, least: int = LEAST_MATCHES) -> DataFrame:
    """Matches of each run that has enough potential ones. The taking is sequential within a run;
    runs are independent and hold no more pairs than a picture has quads, times a few."""
    pairs = potential.filter((F.col("n_potential") >= least) & F.col("is_match"))
    pairs = pairs.select(
        "image_id", "run_id", "quad_id", "cell_id", "pass", "subcell", "pos", "offset_pos", scale_ratio("i_largest", "largest").alias("scale_ratio"),
        F.col("i_x").alias("x"), F.col("i_y").alias("y"), F.col("mid_ra").cast("double").alias("mid_ra"), F.col("mid_dec").cast("double").alias("mid_dec"),
    )
    return pairs.groupBy("image_id", "run_id").applyInPandas(_take, MATCH)


def scale_gate(matches: DataFrame, gate: Column, least: int = LEAST_MATCHES) -> DataFrame:
    """Runs with enough matches whose scale ratios have a median absolute deviation of at most ``gate``."""
    medians = matches.withColumns({"_n": F.count(F.lit(1)).over(_run()), "_median": F.median("scale_ratio").over(_run())})
    spread = medians.withColumn("_mad", F.median(F.abs(F.col("scale_ratio") - F.col("_median"))).over(_run()))
    return spread.filter((F.col("_n") >= least) & (F.col("_mad") <= gate)).drop("_n", "_median", "_mad")


def weighted_bins(matches: DataFrame, least: int = LEAST_MATCHES) -> DataFrame:
    """Matches nearer to the weighted mean scale ratio than the standard deviation around it. Each
    ratio weighs as much as its bin of ten has members. Equal ratios have no deviation, and as the
    bound is strict, none of them is kept, as in the original."""
    low, high = F.min("scale_ratio").over(_run()), F.max("scale_ratio").over(_run())
    binned = matches.withColumn("_bin", F.floor((F.col("scale_ratio") - low) / ((high - low) / BINS + 1e0)).cast("int"))
    weighed = binned.withColumn("_weight", F.count(F.lit(1)).over(Window.partitionBy("image_id", "run_id", "_bin")))
    mean = F.sum(F.col("_weight") * F.col("scale_ratio")).over(_run()) / F.sum("_weight").over(_run())
    near = weighed.withColumn("_off", F.col("scale_ratio") - mean)
    near = near.withColumn("_std", F.sqrt(F.avg(F.col("_off") * F.col("_off")).over(_run()))).filter(F.abs("_off") < F.col("_std"))
    kept = near.withColumn("_kept", F.count(F.lit(1)).over(_run())).filter(F.col("_kept") >= least)
    return kept.drop("_bin", "_weight", "_off", "_std", "_kept")
