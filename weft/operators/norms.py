"""Norms as aggregations."""

from __future__ import annotations

from enum import Enum

import numpy as np
from pyspark.sql import functions as F

from weft.errors import EnumError, RankError
from weft.operators.blas import nrm2
from weft.tensor import LOCAL_CELLS, Tensor


class Norm(Enum):
    MAXABS = "M"
    ONE = "1"
    INFTY = "I"
    FROBENIUS = "F"
    TWO = "2"


def norm(which: Norm, t: Tensor) -> Tensor:
    """A scalar. Of vectors, ONE is the sum of moduli, INFTY the largest. TWO is the largest singular value."""
    if not isinstance(which, Norm):
        raise EnumError(f"{which!r} is no norm")
    if t.rank not in (1, 2):
        raise RankError(f"norms are of vectors and matrices, not of rank {t.rank}")
    size = t.kind.abs(F.col("v")).cast("double")
    zero = F.lit(0.0)
    if which is Norm.FROBENIUS or (which is Norm.TWO and t.rank == 1):
        return nrm2(t)
    if which is Norm.TWO:
        return _two(t)
    if which is Norm.MAXABS or (t.rank == 1 and which is Norm.INFTY):
        return Tensor(t.df.agg(F.coalesce(F.max(size), zero).alias("v")), ())
    if t.rank == 1:
        return Tensor(t.df.agg(F.coalesce(F.sum(size), zero).alias("v")), ())
    lines = t.df.groupBy("i1" if which is Norm.ONE else "i0").agg(F.sum(size).alias("s"))
    return Tensor(lines.agg(F.coalesce(F.max("s"), zero).alias("v")), ())


def vec_norm(t: Tensor) -> Tensor:
    """Root of the sum of squares, at any rank."""
    return nrm2(t)


def _two(t: Tensor) -> Tensor:
    """From the Gram matrix of the shorter side, if that fits one machine (the longer side may be of any length)."""
    from weft.functions.generators import filled
    from weft.operators.spectral import gram

    if min(t.dims) ** 2 > LOCAL_CELLS:
        raise RankError(f"the shorter side of {t.dims} is too long for an eigenvalue on one machine: use truncated_svd")
    values = np.linalg.eigvalsh(gram(t).to_numpy())
    return filled(t.spark, (), float(np.sqrt(max(values[-1], 0.0))) if len(values) else 0.0)
