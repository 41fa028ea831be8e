"""Gaussian kernel density on a grid, from binned points."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REACH = 8  #: kernel deviations beyond which a point adds less than 1e-13 of its peak
STRIPS = 8  #: parts of the grid that are evaluated apart


def axis(low: float, high: float, cells: int) -> np.ndarray:
    return np.linspace(low, high, cells)


def binned(df: DataFrame, by: str, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float], cells: int, bandwidth: float, fine: int, least: int) -> DataFrame:
    """by, total, kxx, kxy, kyy (kernel covariance), cx, cy, n: points of each group gathered in bins, with each bin's centre of gravity.

    A bin is a fine-th of the grid's step wide, or an eighth of a kernel deviation if that is less, but no narrower than a twentieth of the deviation or
    a two-thousandth of the range, and no bin lies farther from the grid than the kernel reaches; so a group has a bounded number of
    bins, however many points.  Groups of fewer than least points, or without spread, have none.
    """
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    points = df.where(px.isNotNull() & py.isNotNull() & ~F.isnan(px) & ~F.isnan(py) & (F.abs(px) < math.inf) & (F.abs(py) < math.inf)).select(F.col(by).alias("g"), px.alias("px"), py.alias("py"))
    square = bandwidth * bandwidth
    spread = points.groupBy("g").agg(F.count("*").alias("total"), *((f * square).alias(k) for k, f in (("kxx", F.var_samp("px")), ("kxy", F.covar_samp("px", "py")), ("kyy", F.var_samp("py")))))
    spread = spread.where((F.col("total") >= least) & (F.col("kxx") * F.col("kyy") - F.col("kxy") * F.col("kxy") > 0)).withColumnRenamed("g", "g2")
    found = points.join(spread, F.col("g").eqNullSafe(F.col("g2"))).drop("g2")
    keys, near = [], F.lit(True)
    for c, k, (low, high) in (("px", "kxx", x_range), ("py", "kyy", y_range)):
        step = F.greatest(F.least(F.lit((high - low) / (cells - 1) / fine), F.sqrt(k) / 8), F.sqrt(k) / 20, F.lit((high - low) / 2000))
        near = near & (F.col(c) > low - REACH * F.sqrt(k)) & (F.col(c) < high + REACH * F.sqrt(k))
        keys.append(F.floor((F.col(c) - low) / step).alias(f"b{c}"))
    return found.where(near).groupBy("g", "total", "kxx", "kxy", "kyy", *keys).agg(F.avg("px").alias("cx"), F.avg("py").alias("cy"), F.count("*").alias("n")).drop("bpx", "bpy")


def kernel_density(df: DataFrame, by: str, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float], cells: int = 120, bandwidth: float = 0.3, fine: int = 2, least: int = 51) -> DataFrame:
    """by, i, j, density: of groups of at least so many points, at cells x cells places of the two ranges.

    The kernel has the group's covariance times the bandwidth squared.  Evaluation works on bins (see binned), a strip of
    the grid at a time: no task holds points.
    """
    xs, ys = axis(*x_range, cells), axis(*y_range, cells)
    kind = df.schema[by].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        inverse = np.linalg.inv(np.array([[first.kxx, first.kxy], [first.kxy, first.kyy]]))
        norm = first.total * 2 * math.pi * math.sqrt(first.kxx * first.kyy - first.kxy**2)
        rows = range(int(first.strip), cells, STRIPS)
        cx, cy, n, out = frame.cx.to_numpy(), frame.cy.to_numpy(), frame.n.to_numpy("f8"), []
        dy = ys[:, None] - cy[None, :]
        for i in rows:
            dx = xs[i] - cx
            power = inverse[0, 0] * dx * dx + 2 * inverse[0, 1] * dx * dy + inverse[1, 1] * dy * dy
            out.append(np.exp(-0.5 * power) @ n / norm)
        i = np.repeat(np.array(rows, "i8"), cells)
        return pd.DataFrame({by: [first.g] * len(i), "i": i, "j": np.tile(np.arange(cells), len(rows)), "density": np.concatenate(out)})

    bins = binned(df, by, x, y, x_range, y_range, cells, bandwidth, fine, least)
    strips = bins.withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(min(STRIPS, cells) - 1))))  # bins, not points
    return strips.groupBy("g", "strip").applyInPandas(run, f"{by} {kind}, i long, j long, density double")
