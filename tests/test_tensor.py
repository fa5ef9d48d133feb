"""Tensor operators against numpy on small integers, so that sums are exact."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.errors import AccessDenied, BadLogic, CompatibilityError, DimensionError, EnumError, RankError, Uninitialized
from weft.functions import generators as g
from weft.operators import blas, elementwise as e, fft, norms, shape, solve, spectral
from weft.operators.decomposition import initialize_tucker, parafac, parafac_reconstruct, tucker_ho_oi, tucker_ho_svd, tucker_reconstruct, weighted_parafac
from weft.operators.structured import BlockTensor, TiledTensor, apply_view, contract
from weft.plans.contraction import Plan, batched, compile_plan, einsum
from weft.sources.disk import DiskTensor
from weft.sources.text import read_tensor
from weft.tensor import Tensor

DIMS = dict(zip("ijklmnabpqrsIQWXP", [3, 4, 2, 5, 3, 2, 3, 2, 3, 2, 4, 3, 2, 3, 2, 4, 3], strict=True))


def draw(*dims, seed=0, complex_=False):
    r = np.random.default_rng(seed + sum(dims))
    x = r.integers(-4, 5, dims).astype(float)
    return x + 1j * r.integers(-4, 5, dims) if complex_ else x


def tensor(spark, x):
    return Tensor.from_numpy(spark, x)


def same(t, x, **more):
    assert t.dims == np.shape(x)
    assert np.allclose(t.to_numpy(), x, **more)


PATTERNS = ["i,i->", "ij,ij->", "iajb,ibja->", "ij,ij->ij", "i,j->ij", "j,i->ij", "ij,k->kij", "ij,kl->ijkl", "ij,j->i", "ijk,jik->i", "ijkl,kl->ij", "kl,ikjl->ij", "ik,kj->ij", "ki,kj->ij", "jk,ki->ij", "ijk,jkl->il", "QaX,QX->aX", "ijk,jik->ik", "pqrs,sl->pqrl", "pqrs,rk->pqks", "iW,aW->iaW", "klab,ab->klab", "ii,jj->ij", "iij,jji->ij", "iji,jij->ij", "ij,jk->i", "ij,k->j", "iI,Ij->ij"]


@pytest.mark.parametrize("spec", PATTERNS)
def test_einsum(spark, spec):
    inputs, out = spec.split("->")
    a, b = inputs.split(",")
    repeated = any(len(set(x)) < len(x) for x in (a, b)) or spec in ("ijk,jik->i", "ijk,jik->ik")
    size = {x: 3 if repeated else DIMS[x] for x in a + b}
    x, y = draw(*(size[c] for c in a)), draw(*(size[c] for c in b), seed=1)
    same(einsum(spec, tensor(spark, x), tensor(spark, y)), np.einsum(spec, x, y))


def test_einsum_outputs(spark):
    x, y, c = draw(3, 3), draw(3, 3, seed=5), draw(3, 3, seed=9)
    a, b, old = (tensor(spark, v) for v in (x, y, c))
    same(Plan("ij", "ik", "kj").execute(a, b, old, alpha=0.5, beta=2.0), 2 * c + 0.5 * x @ y)
    nan = Tensor(old.df.withColumn("v", F.lit(float("nan"))), old.dims)
    same(Plan("ij", "ik", "kj").execute(a, b, nan, beta=0.0), x @ y)  # a previous output that does not count is not read
    same(einsum("ij,ji->ii", a, b), np.diag(np.einsum("ij,ji->i", x, y)))
    same(Plan("ii", "ij", "ji").execute(a, b, old, beta=2.0), 2 * c + np.diag(np.einsum("ij,ji->i", x, y)))
    same(einsum("ij,j->ik", a, tensor(spark, y[0]), dims=(3, 2)), np.repeat((x @ y[0])[:, None], 2, axis=1))
    assert Plan("", "i", "i").execute(tensor(spark, x[0]), tensor(spark, y[0]), g.filled(spark, (), 3.0), beta=2.0).item() == 6 + x[0] @ y[0]
    assert einsum("ij,ij->", g.zeros(spark, (3, 3)), a).item() == 0
    same(einsum("ij,jk,kl,l->i", a, b, old, tensor(spark, y[1])), x @ y @ c @ y[1])
    same(einsum("iij->j", tensor(spark, draw(3, 3, 2))), np.einsum("iij->j", draw(3, 3, 2)))
    with pytest.raises(DimensionError):
        einsum("ik,kj->ij", a, tensor(spark, draw(4, 3)))
    with pytest.raises(BadLogic):
        einsum("ij->i", a, b)
    same(compile_plan("ij", "ik", "kj").execute([a, b], [b, a])[1], y @ x)
    with pytest.raises(BadLogic):
        compile_plan("ij", "ik", "kj").execute([a, b], [b])


def test_complex(spark):
    x, y = draw(3, 4, complex_=True), draw(4, 2, seed=3, complex_=True)
    a, b = tensor(spark, x), tensor(spark, y)
    same(einsum("ik,kj->ij", a, b), x @ y)
    same(blas.gemm(2j, a, a, trans_b="c"), 2j * x @ x.conj().T)
    assert blas.true_dot(a, a).item() == (x.conj() * x).sum()
    assert blas.dot(a, a).item() == (x * x).sum()
    same(a + 1, x + 1)
    same(a * (1 + 2j), x * (1 + 2j))
    same(e.real(a), x.real)
    same(e.imag(a), x.imag)
    same(e.absolute(a), abs(x))
    same(a / (a + 20), x / (x + 20))
    same(a * tensor(spark, x.real), x * x.real)
    assert np.isclose(norms.norm(norms.Norm.FROBENIUS, a).item(), np.linalg.norm(x))
    assert blas.asum(a).item() == (abs(x.real) + abs(x.imag)).sum()
    with pytest.raises(CompatibilityError):
        a.cast("float64")


@pytest.mark.parametrize("spec", ["bik,bjk->bij", "kbi,jbk->jib", "bk,bjk->bj", "cbik,bckj->jcbi"])
def test_blocked_batches(spark, monkeypatch, spec):
    from weft.plans import blocked

    monkeypatch.setattr(blocked, "BLOCK_ROWS", 3)
    monkeypatch.setattr(blocked, "BLOCK_CELLS", 8)
    monkeypatch.setattr(blocked, "EMIT_ROWS", 5)
    sizes = dict(b=3, c=2, i=7, j=6, k=4)
    la, lb = spec.split("->")[0].split(",")
    draw = np.random.default_rng(8)
    x, y = (np.where(draw.random(d) < 0.4, draw.integers(-2, 3, d), 0.0) for d in ([sizes[c] for c in l] for l in (la, lb)))
    a, b = (tensor(spark, z) for z in (x, y))
    found, plain = einsum(spec, a, b, blocked=True), einsum(spec, a, b)
    same(found, np.einsum(spec, x, y))
    # the same rows, with zeros where products cancel; none where nothing meets
    assert sorted(map(tuple, found.df.collect())) == sorted(map(tuple, plain.df.collect()))
    plan = found.df._jdf.queryExecution().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan


def test_blocked_batches_of_odd_rows(spark):
    rows = [(0, 0, 0, float("inf")), (0, 0, 1, 1.0), (0, 1, 1, 2.0), (0, 1, 1, 3.0), (0, None, 1, 4.0), (1, 2, 0, float("nan")), (1, 3, 1, 1.0), (None, 4, 0, 1.0), (1, 3, 0, None)]
    t = Tensor.of(spark.createDataFrame(rows, "b int, i bigint, k int, v double"), ["b", "i", "k"], "v", (2, 5, 2))
    order = lambda e: sorted(map(str, (tuple(r) for r in e.df.collect())))
    assert order(einsum("bik,bjk->bij", t, t, blocked=True)) == order(einsum("bik,bjk->bij", t, t))
    none = t.with_rows(t.df.limit(0))
    assert einsum("bik,bjk->bij", none, t, blocked=True).df.count() == 0 == einsum("bik,bjk->bij", t, none, blocked=True).df.count()


def test_batched_and_blocked(spark):
    x, y = draw(3, 4, 2), draw(3, 2, 5, seed=2)
    same(batched(Plan("ij", "ik", "kj"), tensor(spark, x), tensor(spark, y)), np.einsum("bik,bkj->bij", x, y))
    same(batched(Plan("", "ij", "ij"), tensor(spark, x), tensor(spark, x)), np.einsum("bij,bij->b", x, x))
    from weft.plans.blocked import contract as tiles

    p, q = draw(7, 5), draw(5, 9, seed=4)
    same(tiles(("i", "j"), ("i", "k"), tensor(spark, p), ("k", "j"), tensor(spark, q), 2.0, side=3), 2 * p @ q)
    same(tiles(("j", "i", "l"), ("i", "k"), tensor(spark, p), ("k", "j", "l"), tensor(spark, draw(5, 3, 4)), side=2), np.einsum("ik,kjl->jil", p, draw(5, 3, 4)))
    same(einsum("ik,kj->ij", tensor(spark, p), tensor(spark, q), blocked=True), p @ q)


def test_elementwise(spark):
    x, y = draw(3, 4), draw(3, 4, seed=8)
    a, b = tensor(spark, x), tensor(spark, y)
    with np.errstate(all="ignore"):
        for f in (lambda p, q: p + q, lambda p, q: p - q, lambda p, q: p * q, lambda p, q: p / q, lambda p, q: p + 2, lambda p, q: 3 - p, lambda p, q: p * 2, lambda p, q: p / 4, lambda p, q: -p, lambda p, q: 1 / q, lambda p, q: p / 0):
            assert np.array_equal(f(a, b).to_numpy(), f(x, y), equal_nan=True)
    same(a + y, x + y)
    same(e.element_transform(a, lambda v: F.cos(v)), np.cos(x))
    same(e.element(lambda p, q: p * q + 1, a, b), x * y + 1)
    assert np.isclose(e.rmsd(a, b).item(), np.sqrt(((x - y) ** 2).mean()))
    i = tensor(spark, x.astype(np.int32))
    assert (i + i).dtype == "int32" and (i * 2).dtype == "int64" and np.array_equal((i * 2).to_numpy(), x * 2)
    same(i / 2, x / 2)
    same(blas.axpby(2.0, a, -1.0, b), 2 * x - y)
    with pytest.raises(DimensionError):
        a + tensor(spark, draw(4, 3))


def test_views(spark):
    x = draw(4, 5, 3)
    a = tensor(spark, x)
    same(a[1:3, :, 2], x[1:3, :, 2])
    same(a[-1], x[-1])
    same(a[1:-1], x[1:-1])
    assert a.item(3, -1, 0) == x[3, -1, 0]
    y = x.copy()
    y[1:3, 2] = 7
    same(a.assign((slice(1, 3), 2), 7.0), y)
    for bad in (lambda: a[4], lambda: a[-3:0], lambda: a[0:9], lambda: a[0, 0, 0, 0]):
        with pytest.raises(IndexError):
            bad()
    with pytest.raises(BadLogic):
        a[::2]
    same(shape.permute("kij", "ijk", a), x.transpose(2, 0, 1))
    old = draw(3, 4, 5, seed=1)
    same(shape.permute("kij", "ijk", a, tensor(spark, old), 0.5, 2.0), 2 * old + 0.5 * x.transpose(2, 0, 1))
    same(shape.reshape(a, 6, -1), x.reshape(6, -1))
    same(shape.reshape(a, 6, -1, order="F"), x.reshape(6, -1, order="F"))
    same(shape.unfold(a, 1), x.transpose(1, 0, 2).reshape(5, -1))
    same(shape.unfold(a, 1, "F"), x.transpose(1, 0, 2).reshape(5, -1, order="F"))
    same(shape.flatten(a), x.ravel())
    same(shape.tie_indices(tensor(spark, draw(3, 4, 3)), 0, 2), np.einsum("iji->ij", draw(3, 4, 3)))
    p, q = draw(3, 4), draw(2, 4, seed=6)
    same(shape.khatri_rao("ir", tensor(spark, p), "mr", tensor(spark, q)), np.einsum("ir,mr->imr", p, q).reshape(6, 4))
    same(shape.resize(a, 2, 6, 3), np.pad(x[:2], ((0, 0), (0, 1), (0, 0))))
    assert [tuple(r) for r in shape.enumerate_many(tensor(spark, p[0]), tensor(spark, p[:, 0])).orderBy("i0").collect()] == [(k, p[0, k], p[k, 0]) for k in range(3)]
    for bad in (lambda: shape.reshape(a, -1, -1), lambda: shape.permute("ii", "ij", a)):
        with pytest.raises((BadLogic, RankError)):
            bad()


def test_generators(spark):
    same(g.identity(spark, 3), np.eye(3))
    same(g.identity(spark, 2, 3), np.einsum("ij,jk->ijk", np.eye(2), np.eye(2)))
    same(g.incremented(spark, (2, 3, 4)), np.arange(24.0).reshape(2, 3, 4))
    same(g.incremented(spark, (2, 3), "complex128"), np.arange(6).reshape(2, 3) * (1 + 1j))
    same(g.arange(spark, 1.0, 2.0, 0.25), np.arange(1, 2, 0.25))
    same(g.diagonal(tensor(spark, draw(3))), np.diag(draw(3)))
    same(g.set_diagonal(tensor(spark, draw(3, 4)), 9.0), np.where(np.eye(3, 4) > 0, 9, draw(3, 4)))
    same(g.computed(spark, (3, 2), lambda i, j: i * 10 + j), [[0, 1], [10, 11], [20, 21]])
    with pytest.raises(BadLogic):
        g.arange(spark, 3, 1)
    r = g.random(spark, (200, 3), seed=4, normalize=True).to_numpy()
    assert np.allclose((r**2).sum(axis=0), 1) and abs(r.mean()) < 0.02
    z = g.random(spark, (500,), dtype="complex128").to_numpy()
    assert (abs(z) < 1).all() and abs((abs(z) ** 2).mean() - 0.5) < 0.06
    assert np.linalg.eigvalsh(g.random_definite(spark, 6).to_numpy()).min() > 0
    assert (abs(np.linalg.eigvalsh(g.random_semidefinite(spark, 6, zero=2).to_numpy())) < 1e-10).sum() == 2


def test_blas(spark):
    x, y, v, w = draw(3, 4), draw(4, 4, seed=2), draw(4), draw(3, seed=7)
    a, b = tensor(spark, x), tensor(spark, y)
    same(blas.gemm(2.0, a, b, 3.0, a), 2 * x @ y + 3 * x)
    same(blas.gemm(1.0, a, a, trans_a="t"), x.T @ x)
    same(blas.gemv(2.0, a, tensor(spark, v)), 2 * x @ v)
    same(blas.gemv(1.0, a, tensor(spark, w), trans="t"), x.T @ w)
    same(blas.ger(2.0, tensor(spark, w), tensor(spark, v), a), x + 2 * np.outer(w, v))
    same(blas.symm_gemm(b, a.T), x @ y @ x.T)
    same(blas.symm_gemm(b, a, "t"), x @ y @ x.T)
    same(blas.scale_row(1, 3.0, a), np.where(np.arange(3)[:, None] == 1, 3 * x, x))
    same(blas.scale_column(2, 3.0, a), np.where(np.arange(4) == 2, 3 * x, x))
    same(blas.direct_product(2.0, a, a, 1.0, a), 2 * x * x + x)
    assert blas.dot(a, a, a).item() == (x**3).sum()
    s, q = blas.sum_square(a)
    assert np.isclose(s.item() ** 2 * q.item(), (x**2).sum())
    for which, expected in ((norms.Norm.MAXABS, abs(x).max()), (norms.Norm.ONE, np.linalg.norm(x, 1)), (norms.Norm.INFTY, np.linalg.norm(x, np.inf)), (norms.Norm.FROBENIUS, np.linalg.norm(x)), (norms.Norm.TWO, np.linalg.norm(x, 2))):
        assert np.isclose(norms.norm(which, a).item(), expected)
    with pytest.raises(EnumError):
        norms.norm("1", a)
    with pytest.raises(RankError):
        norms.norm(norms.Norm.ONE, tensor(spark, draw(2, 2, 2)))


def test_norm_of_nothing(spark):
    z = g.zeros(spark, (3, 3))
    assert norms.norm(norms.Norm.ONE, z).item() == 0 and blas.sum_square(z)[1].item() == 0 and e.rmsd(z, z).item() == 0


def test_factorisations(spark):
    x = draw(5, 5) + 6 * np.eye(5)
    a = tensor(spark, x)
    s = tensor(spark, x + x.T)
    w, v = spectral.syev(s)
    same(blas.gemm(1.0, s, v), v.to_numpy() * w.to_numpy(), atol=1e-9)
    lam, left, right = spectral.geev(a)
    assert np.allclose(x @ right.to_numpy(), right.to_numpy() * lam.to_numpy())
    assert np.allclose(left.to_numpy().conj().T @ x, lam.to_numpy()[:, None] * left.to_numpy().conj().T)
    t, z = spectral.gees(a)
    assert np.allclose(z.to_numpy() @ t.to_numpy() @ z.to_numpy().conj().T, x)
    for m in (draw(4, 6), draw(6, 4), draw(4, 4, complex_=True)):
        u, d, vh = spectral.svd(tensor(spark, m), spectral.Vectors.SOME, spectral.Vectors.SOME)
        assert np.allclose(u.to_numpy() * d.to_numpy() @ vh.to_numpy(), m)
        q, r = spectral.qr(tensor(spark, m))
        assert np.allclose(q.to_numpy() @ r.to_numpy(), m) and np.allclose(q.to_numpy().conj().T @ q.to_numpy(), np.eye(m.shape[0]))
        l, p = spectral.gelqf(tensor(spark, m))
        assert np.allclose(l.to_numpy() @ p.to_numpy(), m)
    assert spectral.svd_nullspace(tensor(spark, np.outer(draw(3), [1, 2, 3, 4.0]))).dims == (4, 3)
    low = draw(30, 3) @ draw(3, 8, seed=1)
    u, d, vh = spectral.truncated_svd(tensor(spark, low), 3)
    assert np.allclose(u.to_numpy() * d.to_numpy() @ vh.to_numpy(), low)
    w2, v2 = spectral.truncated_syev(tensor(spark, low.T @ low), 2)
    assert np.allclose(w2.to_numpy(), np.linalg.eigvalsh(low.T @ low)[::-1][:2])
    f, swaps, info = solve.getrf(a)
    p, lo, up = solve.extract_plu(f, swaps)
    assert info == 0 and np.allclose(p.to_numpy() @ lo.to_numpy() @ up.to_numpy(), x)
    assert np.allclose(solve.getri(f, swaps).to_numpy(), np.linalg.inv(x))
    assert np.isclose(solve.det(a), np.linalg.det(x)) and solve.det(tensor(spark, np.ones((3, 3)))) == 0
    for rhs in (draw(5), draw(5, 3)):
        y, *_ = solve.gesv(a, tensor(spark, rhs))
        assert np.allclose(x @ y.to_numpy(), rhs)
    assert solve.gesv(tensor(spark, np.ones((3, 3))), tensor(spark, draw(3)))[0] is None
    with pytest.raises(ZeroDivisionError):
        solve.invert(tensor(spark, np.ones((3, 3))))
    assert np.allclose(solve.pseudoinverse(tensor(spark, low)).to_numpy(), np.linalg.pinv(low))
    root = solve.power(tensor(spark, x @ x.T), -0.5).to_numpy()
    assert np.allclose(root @ (x @ x.T) @ root, np.eye(5))
    y = solve.solve_continuous_lyapunov(a, tensor(spark, draw(5, 5, seed=3))).to_numpy()
    assert np.allclose(x @ y + y @ x.T, draw(5, 5, seed=3))
    y = solve.trsyl(a, tensor(spark, np.eye(2)), tensor(spark, draw(5, 2))).to_numpy()
    assert np.allclose(x @ y + y, draw(5, 2))
    with pytest.raises(DimensionError):
        solve.det(tensor(spark, draw(2, 3)))


def test_gram_route_for_long_matrices(spark, monkeypatch):
    monkeypatch.setattr(spectral, "LOCAL_CELLS", 100)
    m = draw(40, 4)
    u, d, vh = spectral.svd(tensor(spark, m), spectral.Vectors.SOME, spectral.Vectors.SOME)
    assert np.allclose(u.to_numpy() * d.to_numpy() @ vh.to_numpy(), m)
    u, d, vh = spectral.svd(tensor(spark, m.T), spectral.Vectors.SOME, spectral.Vectors.SOME)
    assert np.allclose(u.to_numpy() * d.to_numpy() @ vh.to_numpy(), m.T)
    q, r = spectral.qr(tensor(spark, m))
    assert np.allclose(q.to_numpy() @ r.to_numpy(), m) and np.allclose(q.to_numpy().T @ q.to_numpy(), np.eye(4))


def test_fft(spark):
    for n in (7, 8):
        x, z = draw(n), draw(n, complex_=True)
        same(fft.fft(tensor(spark, x)), np.fft.rfft(x))
        same(fft.fft(tensor(spark, z)), np.fft.fft(z))
        same(fft.ifft(tensor(spark, z)), n * np.fft.ifft(z))
        same(fft.ifft(fft.fft(tensor(spark, x)), n, real=True), n * x, atol=1e-9)
        same(fft.fftfreq(spark, n, 0.5), np.fft.fftfreq(n, 0.5))
    m = draw(3, 8)
    same(fft.fft_rows(tensor(spark, m)), np.fft.rfft(m))
    with pytest.raises(DimensionError):
        fft.fft(tensor(spark, draw(8)), result=3)


def test_decompositions(spark):
    r = np.random.default_rng(0)
    f = [r.standard_normal((n, 2)) for n in (4, 3, 5)]
    x = np.einsum("ir,jr,kr->ijk", *f)
    t = tensor(spark, x)
    same(parafac_reconstruct([tensor(spark, y) for y in f]), x)
    assert np.abs(parafac_reconstruct(parafac(t, 2, 12)).to_numpy() - x).max() < 0.1
    assert np.abs(parafac_reconstruct(weighted_parafac(t, tensor(spark, np.array([1.0, 2, 3, 4])), 2, 12)).to_numpy() - x).max() < 0.2
    core, factors = tucker_ho_svd(t, (2, 2, 2))
    same(tucker_reconstruct(core, factors), x, atol=1e-9)
    core, factors = tucker_ho_oi(t, (2, 2, 2), 2)
    same(tucker_reconstruct(core, factors), x, atol=1e-9)
    with pytest.raises(RankError):
        initialize_tucker(t, (2,))


def test_blocks_and_tiles(spark):
    x, y = draw(7, 7) + 8 * np.eye(7), draw(7, 7, seed=4)
    sizes = (4, 0, 1, 2)
    mask = np.kron(np.eye(1), np.zeros((7, 7)))
    at = 0
    for n in sizes:
        mask[at : at + n, at : at + n] = 1
        at += n
    a, b = (BlockTensor.of(tensor(spark, v), sizes, ("p", "q", "r", "s")) for v in (x, y))
    same(contract("ik,kj->ij", a, b).to_dense(), (x * mask) @ (y * mask))
    assert contract("ij,ij->", a, b).item() == (x * y * mask).sum()
    same(contract("ik,kj->ij", a, tensor(spark, y)), (x * mask) @ y)
    same(a.block("s"), x[5:, 5:])
    assert a.block_of(-1) == 3 and a.num_blocks == 4 and a.ranges[3] == (5, 7)
    same(a.add_number(2.0).tensor, (x + 2) * mask)
    same(a.invert().tensor, np.linalg.inv(x * mask) * mask)
    sym = BlockTensor.of(tensor(spark, x + x.T), sizes)
    w, v = sym.syev()
    vd = v.tensor.to_numpy()
    assert np.allclose(vd.T @ ((x + x.T) * mask) @ vd, np.diag(w.to_numpy()))
    assert np.allclose({r.blk: r.v for r in a.det().collect()}[0], np.linalg.det(x[:4, :4]))
    more = a.insert_block(0, tensor(spark, np.full((2, 2), 5.0)), "z")
    assert more.sizes == (2, *sizes) and (more.block(0).to_numpy() == 5).all() and np.allclose(more.block("s").to_numpy(), x[5:, 5:])
    with pytest.raises(BadLogic):
        contract("ik,kj->ij", a, BlockTensor.of(tensor(spark, y), (3, 4)))
    parts = ((3, 0, 4), (3, 0, 4))
    p = np.where((np.arange(7) < 3)[:, None] & (np.arange(7) < 3), x, 0)
    t, u = TiledTensor.of(tensor(spark, p), parts), apply_view(tensor(spark, y), *parts)
    assert t.num_filled() == 1 and t.has_tile(0, 0) and not t.has_tile(2, 2) and t.has_zero_size(1, 0) and t.grid_size == 9 and t.tile_of(3, 2) == (2, 0)
    out = contract("ik,kj->ij", t, u)
    assert isinstance(out, TiledTensor)
    same(out.to_dense(), p @ y)
    same((t + u).tensor, p + y)
    same(t.tile(0, 0), p[:3, :3])


def test_disk(spark, tmp_path):
    x = draw(4, 5)
    d = DiskTensor(spark, f"file://{tmp_path}", "a", (4, 5))
    assert not d.existed() and d.tensor().df.count() == 0
    d.write(tensor(spark, x))
    again = DiskTensor(spark, f"file://{tmp_path}", "a")
    assert again.existed() and again.dims == (4, 5)
    same(again.tensor(), x)
    same(again[1:3, 2], x[1:3, 2])
    again.write_view((slice(0, 2), slice(0, 5)), 3.0)
    y = x.copy()
    y[:2] = 3
    same(d.get_update(), y)
    d.put(d.get() * 2)
    same(again.tensor(), 2 * y)
    again.resize(2, 5)
    same(again.tensor(), 2 * y[:2])
    again.set_read_only()
    for bad in (lambda: again.write(tensor(spark, y[:2])), again.unlink):
        with pytest.raises(AccessDenied):
            bad()
    d.unlink()
    with pytest.raises(Uninitialized):
        DiskTensor(spark, f"file://{tmp_path}", "a")


def test_text(spark, tmp_path):
    (tmp_path / "m.dat").write_text("1 1 2.5\n  2 1 -1e-1\n2 2 4\n")
    same(read_tensor(spark, f"file://{tmp_path}/m.dat", (2, 2)), [[2.5, -0.1], [-0.1, 4]])
    (tmp_path / "t.dat").write_text("2 1 1 1 3.0\n")
    t = read_tensor(spark, f"file://{tmp_path}/t.dat", (2, 2, 2, 2)).to_numpy()
    assert t.sum() == 12 and t[0, 0, 1, 0] == 3


def test_stream(spark, tmp_path):
    from weft.streaming.contraction import contract_stream

    x, v = draw(6, 4), draw(4, seed=2)
    rows = tensor(spark, x).df
    rows.where("i0 < 3").write.parquet(f"{tmp_path}/in/a")
    rows.where("i0 >= 3").write.parquet(f"{tmp_path}/in/b")
    rows.where("i0 = 1").write.parquet(f"{tmp_path}/in/c")  # a change of cells that came before
    changes = spark.readStream.schema("i0 long, i1 long, v double").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in/*")
    q = contract_stream(changes, "ij", tensor(spark, v), "j", "i").writeStream.outputMode("complete").format("memory").queryName("sums").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.i0: r.v for r in spark.table("sums").collect()}
    whole = x.copy()
    whole[1] *= 2
    assert got == pytest.approx({k: y for k, y in enumerate(whole @ v) if np.any(x[k] * v)} | {k: got[k] for k in got if got[k] == 0})


def test_plan_pushes_filters_and_broadcasts_by_size(spark, tmp_path):
    tensor(spark, draw(30, 20)).df.write.parquet(f"{tmp_path}/t")
    t = Tensor(spark.read.parquet(f"{tmp_path}/t"), (30, 20))
    text = t[3:5].df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(i0), GreaterThanOrEqual(i0,3), LessThan(i0,5)]" in text
    small = einsum("ik,k->i", t, tensor(spark, draw(20))).df._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in small
    huge = Tensor(t.df, (10**9, 10**9))
    assert "rightHint=(strategy=broadcast)" not in einsum("ik,jk->ij", huge, huge).df._jdf.queryExecution().logical().toString()
