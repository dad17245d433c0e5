"""Reconstruction error by a linear autoencoder, i.e. the top-k principal subspace.

Baldi and Hornik (1989): a linear autoencoder trained on squared error spans the leading principal
components, so training is one distributed covariance pass (Spark ML's PCA). Loadings are k x d numbers;
scoring is column arithmetic with literals, or one Arrow matrix product when there are many columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F, types as T

from logwarden.operators.stat import FLOOR, add_up


@dataclass(frozen=True)
class Subspace:
    """M07 parameters."""

    columns: list[str]
    mean: list[float]
    std: list[float]
    loadings: np.ndarray
    error_mean: float = 0.0
    error_std: float = 0.0
    error_max: float = 0.0


def _named(prefix: str, columns: list) -> dict[str, Column]:
    return {f"{prefix}{i}": c for i, c in enumerate(columns)}


def _scaled(df: DataFrame, s: Subspace) -> DataFrame:
    return df.withColumns(_named("_z", [(F.col(c) - F.lit(m)) / F.lit(d) for c, m, d in zip(s.columns, s.mean, s.std)]))


WIDE = 16


def _encoded(df: DataFrame, s: Subspace) -> DataFrame:
    """Standardized inputs, latent values and reconstructions, each in its own projection so that none is recomputed.

    Wide inputs use one Arrow matrix product instead of d x k column terms.
    """
    d, k = len(s.columns), len(s.loadings)
    if d > WIDE:
        mean, std, w = np.array(s.mean), np.array(s.std), s.loadings

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def product(frame: pd.DataFrame) -> pd.Series:
            z = (frame.to_numpy(dtype=float) - mean) / std
            latent = z @ w.T
            back = latent @ w
            return pd.Series(list(np.hstack([z, latent, back, ((z - back) ** 2).mean(axis=1, keepdims=True)])))

        out = df.withColumn("_m", product(F.struct(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(s.columns)])))
        at = lambda j: F.get("_m", F.lit(j))
        return out.withColumns({**_named("_z", [at(j) for j in range(d)]), **_named("_l", [at(d + i) for i in range(k)]),
                                **_named("_r", [at(d + k + j) for j in range(d)]), "_mse": at(2 * d + k)}).drop("_m")
    z = [F.col(f"_z{j}") for j in range(d)]
    out = _scaled(df, s).withColumns(_named("_l", [
        add_up([F.lit(float(w)) * z[j] for j, w in enumerate(row)]) for row in s.loadings]))
    latent = [F.col(f"_l{i}") for i in range(k)]
    out = out.withColumns(_named("_r", [
        add_up([F.lit(float(s.loadings[i][j])) * latent[i] for i in range(k)]) for j in range(d)]))
    return out.withColumn("_mse", add_up(_errors(s)) / d)


def _clean(df: DataFrame, s: Subspace) -> DataFrame:
    n, k = len(s.columns), len(s.loadings)
    return df.drop(*[f"_z{j}" for j in range(n)], *[f"_l{i}" for i in range(k)], *[f"_r{j}" for j in range(n)], "_mse")


def _errors(s: Subspace) -> list[Column]:
    return [(F.col(f"_z{j}") - F.col(f"_r{j}")) * (F.col(f"_z{j}") - F.col(f"_r{j}")) for j in range(len(s.columns))]


def fit_reconstruction(df: DataFrame, columns: list[str], k: int) -> Subspace:
    """Standardization, the top-k loadings and the training-error statistics; rows with nulls take no part."""
    full = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    if len(columns) > WIDE:
        rows = full.count()
        raw = VectorAssembler(inputCols=columns, outputCol="_x").transform(full).select("_x")
        scaler = StandardScaler(inputCol="_x", outputCol="_v", withMean=True, withStd=True).fit(raw)
        vectors = scaler.transform(raw).select("_v")
        mean = [float(m) for m in scaler.mean.toArray()]
        spread = scaler.std.toArray() * math.sqrt(max(rows - 1, 1) / max(rows, 1))
        std = [float(x) if x > FLOOR else 1.0 for x in spread]
    else:
        row = full.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
                       *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
        mean = [row[f"m{i}"] for i in range(len(columns))]
        std = [row[f"s{i}"] if row[f"s{i}"] > FLOOR else 1.0 for i in range(len(columns))]
        z = [f"_z{j}" for j in range(len(columns))]
        scaled = _scaled(full, Subspace(columns, mean, std, np.zeros((0, len(columns))))).select(*z)
        vectors = VectorAssembler(inputCols=z, outputCol="_v").transform(scaled).select("_v")
    pc = PCA(k=k, inputCol="_v", outputCol="_p").fit(vectors).pc.toArray().T
    # The sign of a component is arbitrary: make its largest loading positive.
    pc = pc * np.sign(pc[np.arange(k), np.abs(pc).argmax(axis=1)])[:, None]
    s = Subspace(columns, mean, std, pc)
    e = _encoded(full, s).agg(F.avg("_mse").alias("a"), F.stddev_pop("_mse").alias("d"), F.max("_mse").alias("m")).first()
    return Subspace(columns, mean, std, pc, e["a"], e["d"], e["m"])


def score_reconstruction(df: DataFrame, s: Subspace, name: str = "recon_score", mode: str = "sigmoid") -> DataFrame:
    """Sigmoid of the z-scored error, or (``mode='max'``) the error over the training maximum."""
    e = F.col("_mse")
    if mode == "max":
        value = e / F.lit(s.error_max) if s.error_max > 0 else e
    elif s.error_std > 0:
        value = 1 / (1 + F.exp(-(e - F.lit(s.error_mean)) / F.lit(s.error_std)))
    else:
        value = e / F.lit(s.error_max + 1e-10)
    return _clean(_encoded(df, s).withColumn(name, value), s)


def explain_reconstruction(df: DataFrame, s: Subspace, name: str = "explanation") -> DataFrame:
    """Map feature -> share of the squared error, uniform when there is none."""
    parts = _errors(s)
    total = add_up(parts)
    shares = F.array(*[F.when(total > 0, p / total).otherwise(F.lit(1.0 / len(parts))) for p in parts])
    value = F.map_from_arrays(F.array(*[F.lit(c) for c in s.columns]), shares)
    return _clean(_encoded(df, s).withColumn(name, value), s)


def project(df: DataFrame, s: Subspace, prefix: str = "latent_") -> DataFrame:
    """The encoded representation, one column per component."""
    k = len(s.loadings)
    return _clean(_encoded(df, s).withColumns({f"{prefix}{i}": F.col(f"_l{i}") for i in range(k)}), s)


def reconstruct(df: DataFrame, s: Subspace, prefix: str = "recon_") -> DataFrame:
    """Each feature as rebuilt from the subspace, on its original scale, beside the original."""
    out = _encoded(df, s).withColumns({
        f"{prefix}{c}": F.col(f"_r{j}") * F.lit(s.std[j]) + F.lit(s.mean[j]) for j, c in enumerate(s.columns)})
    return _clean(out, s)
