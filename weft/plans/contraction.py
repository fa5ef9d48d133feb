"""Contractions as DataFrame plans: join on shared labels, project the product, sum by the output's labels.

What Catalyst does not do by itself happens here, where the plan is built: labels private to
one operand are summed away before the join; repeated labels become filters; an operand is
broadcast only if its dimensions prove that it is small; and without a previous output, none is read.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.errors import BadLogic, DimensionError
from weft.functions.scalars import Real, arithmetic, is_complex, widest
from weft.plans.labels import Algorithm, Contraction, Labels, cheapest_pair, column, difference, labels_of, parse, unique
from weft.tensor import Tensor, index_columns

#: Cells of an operand below which it is broadcast: at 24 bytes a row some 6 MB.
BROADCAST_CELLS = 250_000


def labelled(t: Tensor, labels: Labels, kind: Real, value: str, conjugate: bool = False, extra: Sequence[str] = ()) -> DataFrame:
    """Rows under label columns. A repeated label keeps the rows where its indices agree, once."""
    df, seen, columns = t.df, {}, []
    for k, x in enumerate(labels):
        if x in seen:
            df = df.where(F.col(f"i{k}") == F.col(seen[x]))
        else:
            seen[x] = f"i{k}"
            columns.append(F.col(f"i{k}").alias(column(x)))
    v = kind.lift(F.col("v"), t.dtype)
    return df.select(*extra, *columns, (kind.conj(v) if conjugate else v).alias(value))


def summed(df: DataFrame, labels: Labels, kept: Labels, kind: Real, value: str, extra: Sequence[str] = ()) -> DataFrame:
    """Labels that nobody else has are summed away."""
    if set(labels) == set(kept):
        return df
    return df.groupBy(*extra, *(column(x) for x in kept)).agg(kind.sum(F.col(value)).alias(value))


def _size(labels: Labels, dims: dict[str, int]) -> int:
    return prod((dims[x] for x in set(labels)), start=1)


def product(plan: Contraction, a: Tensor, b: Tensor, kind: Real, conj_a: bool, conj_b: bool, dims: dict[str, int], extra: Sequence[str] = ()) -> DataFrame:
    """Columns of the output's labels (each once), ``extra`` and p, the sum of products; no zero rows for what did not meet."""
    left = summed(labelled(a, plan.a, kind, "va", conj_a, extra), unique(plan.a), difference(plan.a, plan.private_a), kind, "va", extra)
    right = summed(labelled(b, plan.b, kind, "vb", conj_b, extra), unique(plan.b), difference(plan.b, plan.private_b), kind, "vb", extra)
    kept_a, kept_b = difference(plan.a, plan.private_a), difference(plan.b, plan.private_b)
    keys = [*extra, *(column(x) for x in plan.shared)]
    if not extra:
        if _size(kept_b, dims) <= BROADCAST_CELLS:
            right = F.broadcast(right)
        elif _size(kept_a, dims) <= BROADCAST_CELLS:
            left = F.broadcast(left)
    joined = left.join(right, keys) if keys else left.crossJoin(right)
    p = kind.mul(F.col("va"), F.col("vb"))
    targets = [column(x) for x in unique(plan.out) if x not in plan.only_out]
    # without links, every pair of rows is a cell of its own
    if plan.links:
        out = joined.groupBy(*extra, *targets).agg(kind.sum(p).alias("p"))
        if not targets and not extra:
            out = out.select(kind.or_zero(F.col("p")).alias("p"))
    elif not plan.out and not extra:
        out = joined.agg(kind.or_zero(kind.sum(p)).alias("p"))
    else:
        out = joined.select(*extra, *targets, p.alias("p"))
    for x in plan.only_out:
        out = out.crossJoin(F.broadcast(out.sparkSession.range(dims[x]).select(F.col("id").alias(column(x)))))
    return out


def combine(out: Labels, found: DataFrame, dims: Sequence[int], kind: Real, dtype: str, alpha, beta, previous: Tensor | None, extra: Sequence[str] = ()) -> DataFrame:
    """alpha times what was found, plus beta times the previous output. With beta zero, the previous output is not read."""
    names = index_columns(len(out))
    scaled = kind.mul(kind.lit(alpha), F.col("p")) if alpha != 1 else F.col("p")
    new = found.select(*extra, *(F.col(column(x)).alias(n) for x, n in zip(out, names, strict=True)), scaled.alias("p"))
    if not beta or previous is None:
        return new.select(*extra, *names, kind.narrow(F.col("p"), dtype).alias("v"))
    old = previous.df.select(*extra, *names, kind.mul(kind.lit(beta), kind.lift(F.col("v"), previous.dtype)).alias("o"))
    keys = [*extra, *names]
    both = new.join(old, keys, "full_outer") if keys else new.crossJoin(old.agg(F.first("o").alias("o")))
    return both.select(*keys, kind.narrow(kind.add(kind.or_zero(F.col("o")), kind.or_zero(F.col("p"))), dtype).alias("v"))


class Plan:
    """A contraction whose labels are analysed once and that runs on any tensors that fit them."""

    def __init__(self, out: str | Labels, a: str | Labels, b: str | Labels):
        self.labels = Contraction(labels_of(out) if out else (), labels_of(a) if a else (), labels_of(b) if b else ())

    @property
    def algorithm(self) -> Algorithm:
        return self.labels.algorithm

    def execute(self, a, b, previous=None, alpha=1.0, beta=0.0, conj_a: bool = False, conj_b: bool = False, dims: Sequence[int] | None = None, dtype: str | None = None):
        """``beta * previous + alpha * a b``. Lists of tensors give a list. ``dims``: of the output, needed if a label stands there only."""
        if isinstance(a, (list, tuple)):
            n = {len(x) for x in (a, b, previous) if isinstance(x, (list, tuple))}
            if len(n) > 1 or not isinstance(b, (list, tuple)):
                raise BadLogic("lists of different lengths")
            return [self.execute(x, y, z, alpha, beta, conj_a, conj_b, dims, dtype) for x, y, z in zip(a, b, previous or [None] * len(a), strict=True)]
        given = dims if dims is not None else (previous.dims if previous is not None else None)
        sizes = self.labels.dims(a.dims, b.dims, given)
        top = widest(a.dtype, b.dtype, *([previous.dtype] if previous is not None and beta else []))
        if isinstance(alpha, complex) and alpha.imag or isinstance(beta, complex) and beta.imag:
            top = widest(top, "complex128")
        dtype = dtype or (previous.dtype if previous is not None and not (is_complex(top) and not is_complex(previous.dtype)) else top)
        kind = arithmetic(top)
        found = product(self.labels, a, b, kind, conj_a, conj_b, sizes)
        shape = tuple(sizes[x] for x in self.labels.out)
        return Tensor(combine(self.labels.out, found, shape, kind, dtype, alpha, beta, previous), shape, dtype)


def compile_plan(out: str, a: str, b: str) -> Plan:
    return Plan(out, a, b)


def einsum(spec: str, *tensors: Tensor, previous: Tensor | None = None, alpha=1.0, beta=0.0, conj: Sequence[bool] = (), dims: Sequence[int] | None = None, blocked: bool = False) -> Tensor:
    """"ik,kj->ij" on one, two or more tensors. More than two are contracted in pairs, the pair that shrinks most first."""
    out, inputs = parse(spec)
    if len(inputs) != len(tensors):
        raise BadLogic(f"{len(inputs)} operands in {spec!r}, {len(tensors)} given")
    flags = list(conj) + [False] * (len(inputs) - len(conj))
    if len(inputs) == 1:
        return reduce_one(out, inputs[0], tensors[0], previous, alpha, beta, flags[0])
    terms = list(zip(inputs, tensors, flags, strict=True))
    sizes: dict[str, int] = {}
    for labels, t, _ in terms:
        for x, n in zip(labels, t.dims, strict=True):
            if sizes.setdefault(x, n) != n:
                raise DimensionError(f"label {x} has dimensions {sizes[x]} and {n}")
    while len(terms) > 2:
        i, j = cheapest_pair([t[0] for t in terms], out, sizes)
        rest = set(out).union(*(t[0] for k, t in enumerate(terms) if k not in (i, j)))
        kept = tuple(x for x in unique((*terms[i][0], *terms[j][0])) if x in rest)
        merged = Plan(kept, terms[i][0], terms[j][0]).execute(terms[i][1], terms[j][1], conj_a=terms[i][2], conj_b=terms[j][2])
        terms = [t for k, t in enumerate(terms) if k not in (i, j)] + [(kept, merged, False)]
    (la, ta, ca), (lb, tb, cb) = terms
    if blocked:
        from weft.plans.blocked import contract

        if beta or ca or cb:
            raise BadLogic("the blocked plan computes plain products")
        return contract(out, la, ta, lb, tb, alpha)
    return Plan(out, la, lb).execute(ta, tb, previous, alpha, beta, ca, cb, dims)


def reduce_one(out: Labels, labels: Labels, t: Tensor, previous: Tensor | None = None, alpha=1.0, beta=0.0, conj: bool = False) -> Tensor:
    """Diagonals, sums over labels that the output lacks, and reordering of one tensor."""
    kind = t.kind
    sizes = dict(zip(labels, t.dims, strict=True))
    if any(sizes[x] != n for x, n in zip(labels, t.dims, strict=True)):
        raise DimensionError(f"a repeated label of {labels} has two dimensions")
    kept = tuple(x for x in unique(labels) if x in out)
    df = summed(labelled(t, labels, kind, "p", conj), unique(labels), kept, kind, "p")
    if not kept:
        df = df.select(kind.or_zero(F.col("p")).alias("p")) if labels else df
    return Tensor(combine(out, df, (), kind, t.dtype, alpha, beta, previous), tuple(sizes[x] for x in out), t.dtype)


def batched(plan: Plan, a: Tensor, b: Tensor, alpha=1.0) -> Tensor:
    """One job for a batch of contractions: the first index of both tensors and of the result is the batch's number."""
    inner = Contraction(("batch_", *plan.labels.out), ("batch_", *plan.labels.a), ("batch_", *plan.labels.b))
    sizes = inner.dims(a.dims, b.dims)
    kind = arithmetic(a.dtype, b.dtype)
    found = product(inner, a, b, kind, False, False, sizes)
    if not inner.links and not plan.labels.out:
        found = found.groupBy(column("batch_")).agg(kind.sum(F.col("p")).alias("p"))
    shape = tuple(sizes[x] for x in inner.out)
    dtype = widest(a.dtype, b.dtype)
    return Tensor(combine(inner.out, found, shape, kind, dtype, alpha, 0, None), shape, dtype)


def sum_all(t: Tensor, f=None) -> Column:
    v = t.kind.lift(F.col("v"), t.dtype)
    return t.kind.or_zero(t.kind.sum(f(v) if f else v))
