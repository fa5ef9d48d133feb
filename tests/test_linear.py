"""Factorisations, transforms, blocks, disk layers and streams where sizes pass the limits of one machine or of an expression."""

import numpy as np
import pytest

from weft.errors import BadLogic, TooLarge
from weft.functions import generators as g
from weft.operators import blas, decomposition, fft, solve, spectral, structured
from weft.operators.structured import BlockTensor, TiledTensor
from weft.plans.contraction import einsum
from weft.sources import tables
from weft.sources.disk import DiskTensor
from weft.tensor import Tensor


def tensor(spark, x):
    return Tensor.from_numpy(spark, x)


def _draw(*dims):
    return np.random.default_rng(sum(dims)).standard_normal(dims)


LONG = {"full": _draw(45, 4), "of rank one": np.outer(_draw(45), [1.0, 2, 3, 4]), "complex": _draw(45, 4) + 1j * _draw(4, 45).T}


@pytest.mark.parametrize("name", list(LONG))
def test_one_shape_at_every_size(spark, monkeypatch, name):
    x = LONG[name]
    found = []
    for cells in (spectral.LOCAL_CELLS, 100):
        monkeypatch.setattr(spectral, "LOCAL_CELLS", cells)
        q, r = spectral.qr(tensor(spark, x), full=False)
        assert q.dims == (45, 4) and r.dims == (4, 4)
        assert np.allclose(q.to_numpy() @ r.to_numpy(), x) and np.allclose(q.to_numpy().conj().T @ q.to_numpy(), np.eye(4))
        for y in (x, x.T):
            u, s, vh = spectral.svd(tensor(spark, y), spectral.Vectors.SOME, spectral.Vectors.SOME)
            assert np.allclose(u.to_numpy() * s.to_numpy() @ vh.to_numpy(), y)
            found.append((u.dims, s.dims, vh.dims))
    assert found[:2] == found[2:]
    with pytest.raises(TooLarge):
        spectral.svd(tensor(spark, x))  # all 45 vectors
    with pytest.raises(TooLarge):
        spectral.qr(tensor(spark, x), full=True)
    assert spectral.svd(tensor(spark, x), spectral.Vectors.SOME, spectral.Vectors.ALL)[2].dims == (4, 4)


def test_small_singular_values_of_a_long_matrix(spark, monkeypatch):
    x = np.linalg.qr(_draw(60, 3))[0] * [1.0, 1e-6, 1e-11]
    monkeypatch.setattr(spectral, "LOCAL_CELLS", 100)
    _, s, _ = spectral.svd(tensor(spark, x), spectral.Vectors.NONE, spectral.Vectors.NONE)
    assert np.allclose(s.to_numpy(), [1.0, 1e-6, 1e-11], rtol=1e-4, atol=0)


def _few_cells(monkeypatch):
    """A long side's factor goes to the driver, its square does not."""
    monkeypatch.setattr("weft.tensor.LOCAL_CELLS", 150)


@pytest.mark.parametrize("name", list(LONG))
def test_initial_factors_of_a_long_side(spark, monkeypatch, name):
    x = LONG[name]
    u, s, vh = np.linalg.svd(x, full_matrices=False)
    _few_cells(monkeypatch)
    first, second = decomposition.initialize_cp(tensor(spark, x), 3)
    assert first.shape == (45, 3) and second.shape == (4, 3)
    k = int((s > 1e-6).sum())
    for found, expected in ((first[:, :k], (u * s)[:, : min(k, 3)]), (second[:, :k], vh.T[:, : min(k, 3)])):
        length = np.linalg.norm(expected, axis=0)
        assert np.allclose(np.linalg.norm(found, axis=0), length) and np.allclose(np.abs((found.conj() * expected).sum(axis=0)), length**2)
    assert np.allclose(first[:, k:], 0, atol=1e-5)


def _product_of_three():
    return [np.abs(_draw(n)) + 0.5 for n in (45, 3, 2)]


@pytest.mark.parametrize("name", list(LONG))
def test_initial_tucker_factors_of_a_long_side(spark, monkeypatch, name):
    x = LONG[name]
    u = np.linalg.svd(x)[0]
    _few_cells(monkeypatch)
    first, second = decomposition.initialize_tucker(tensor(spark, x), (3, 4))
    assert np.allclose(first.conj().T @ first, np.eye(3)) and np.allclose(second.conj().T @ second, np.eye(4))
    k = min(3, np.linalg.matrix_rank(x))
    assert np.allclose(np.abs((first.conj() * u[:, :3]).sum(axis=0))[:k], 1)
    # more vectors than columns: the rest completes them
    more = decomposition.initialize_tucker(tensor(spark, x[:30]), (6, 1))[0]
    assert more.shape == (30, 6) and np.allclose(more.conj().T @ more, np.eye(6))


def _no_factor_on_the_driver(monkeypatch):
    """Not even a factor of a long side fits the driver."""
    monkeypatch.setattr("weft.tensor.LOCAL_CELLS", 100)
    monkeypatch.setattr(decomposition, "FACTOR_CELLS", 40)


@pytest.mark.parametrize("name", list(LONG))
def test_initial_factors_that_stay_in_spark(spark, monkeypatch, name):
    x = LONG[name]
    t = tensor(spark, x)
    with monkeypatch.context() as m:
        _no_factor_on_the_driver(m)
        first, second = decomposition.initialize_tucker(t, (3, 4), gathered=False)
        more = decomposition.initialize_tucker(t, (6, 1), gathered=False)[0]
        scaled = decomposition.initialize_cp(t, 3, gathered=False)[0]
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    k = int((s > 1e-6).sum())
    for q, n in ((first, 3), (second, 4), (more, 6)):
        q = q.to_numpy()
        assert q.shape[1] == n and np.allclose(q.conj().T @ q, np.eye(n), atol=1e-12)
        top = q[np.abs(q).argmax(axis=0), np.arange(n)]
        assert np.allclose(top.imag, 0) and (top.real > 0).all()
    for q in (first, more):
        q = q.to_numpy()[:, : min(k, 3)]
        assert np.allclose(np.abs((q.conj() * u[:, : q.shape[1]]).sum(axis=0)), 1)
    assert np.allclose(np.abs(scaled.to_numpy()), np.abs((u * s)[:, :3]), atol=1e-5)


def test_initial_tucker_factors_of_far_keys(spark):
    """Few rows whose numbers are as far apart as keys of a table: no array as long as the largest of them."""
    x, step = LONG["full"], 10**10
    t = tensor(spark, x)
    far = t.with_rows(t.df.selectExpr(f"i0 * {step} AS i0", "i1", "v"), (45 * step, 4))
    q = decomposition.initialize_tucker(far, (2, 1), gathered=False)[0]
    assert q.dims == (45 * step, 2)
    expected = decomposition.initialize_tucker(t, (2, 1))[0]
    assert np.allclose(q.with_rows(q.df.selectExpr(f"i0 div {step} AS i0", "i1", "v"), (45, 2)).to_numpy(), expected)


def test_parafac_of_a_long_first_index(spark, monkeypatch):
    a, b, c = _product_of_three()
    x = np.einsum("i,j,k->ijk", a, b, c)
    _few_cells(monkeypatch)
    factors = [f.to_numpy() for f in decomposition.parafac(tensor(spark, x), 1, 3)]
    assert [f.shape for f in factors] == [(45, 1), (3, 1), (2, 1)]
    assert np.allclose(np.einsum("iz,jz,kz->ijk", *factors), x)


def _far(t, step):
    """The first index's numbers as far apart as keys of a table can be."""
    return t.with_rows(t.df.withColumn("i0", t.df.i0 * step), (t.dims[0] * step, *t.dims[1:]))


def _near(t, step):
    return t.with_rows(t.df.selectExpr(f"i0 div {step} AS i0", *t.columns[1:], "v"), (t.dims[0] // step, *t.dims[1:])).to_numpy()


@pytest.mark.parametrize("rank", [1, 2])
def test_parafac_of_far_keys(spark, rank):
    x, step = np.einsum("iz,jz,kz->ijk", _draw(45, rank), _draw(3, rank), _draw(2, rank)), 10**10
    t = tensor(spark, x)
    first, *rest = decomposition.parafac(_far(t, step), rank, 3)
    assert first.dims == (45 * step, rank)
    expected = decomposition.parafac_reconstruct(decomposition.parafac(t, rank, 3)).to_numpy()
    assert np.allclose(np.einsum("iz,jz,kz->ijk", _near(first, step), *(f.to_numpy() for f in rest)), expected, atol=1e-6)


def test_weighted_parafac_of_a_long_first_index(spark, monkeypatch):
    a, b, c = _product_of_three()
    x = np.einsum("i,j,k->ijk", a, b, c)
    _few_cells(monkeypatch)
    factors = [f.to_numpy() for f in decomposition.weighted_parafac(tensor(spark, x), tensor(spark, np.arange(1.0, 46.0)), 1, 3)]
    assert [f.shape for f in factors] == [(45, 1), (3, 1), (2, 1)]
    assert np.allclose(np.einsum("iz,jz,kz->ijk", *factors), x)


def test_weighted_parafac_of_far_keys(spark):
    step = 10**10
    t, w = tensor(spark, np.einsum("i,j,k->ijk", *_product_of_three())), tensor(spark, np.arange(1.0, 46.0))
    first, *rest = decomposition.weighted_parafac(_far(t, step), _far(w, step), 1, 3)
    assert first.dims == (45 * step, 1)
    assert np.allclose(np.einsum("iz,jz,kz->ijk", _near(first, step), *(f.to_numpy() for f in rest)), t.to_numpy())
    for bad in (w.with_rows(w.df.where("i0 > 0")), w - 1.0):
        with pytest.raises(BadLogic):
            decomposition.weighted_parafac(_far(t, step), _far(bad, step), 1, 3)


def test_equations_with_dependent_eigenvectors(spark):
    x = np.array([[2.0, 1, 0], [0, 2, 1], [0, 0, 2]])
    a, c = tensor(spark, x), _draw(3, 3)
    y = solve.solve_continuous_lyapunov(a, tensor(spark, c)).to_numpy()
    assert np.allclose(x @ y + y @ x.T, c)
    b = _draw(60, 60)
    big = _draw(3, 60)
    y = solve.trsyl(a, tensor(spark, b), tensor(spark, big)).to_numpy()
    assert np.allclose(x @ y + y @ b, big)
    t, z = spectral.gees(a)
    assert np.allclose(z.to_numpy() @ t.to_numpy() @ z.to_numpy().conj().T, x)
    w, left, right = spectral.geev(tensor(spark, b))
    assert np.allclose(b @ right.to_numpy(), right.to_numpy() * w.to_numpy())
    assert np.allclose(left.to_numpy().conj().T @ b, w.to_numpy()[:, None] * left.to_numpy().conj().T)


@pytest.mark.parametrize("n", [2048, 2062, 2053, 6000])
def test_long_transforms(spark, n):
    """A power of two, twice a prime, a prime, a length of many factors."""
    x = _draw(n)
    assert np.allclose(fft.fft(tensor(spark, x)).to_numpy(), np.fft.rfft(x))
    z = x + 1j * _draw(n + 1)[1:]
    assert np.allclose(fft.ifft(tensor(spark, z)).to_numpy(), n * np.fft.ifft(z))
    text = fft.fft(tensor(spark, x)).df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in text and "Join Inner, true" not in text


def test_rows_that_pass_a_batch(spark, monkeypatch):
    monkeypatch.setattr(fft, "AT_ONCE", 16)
    m = _draw(9, 8)
    assert np.allclose(fft.fft_rows(tensor(spark, m)).to_numpy(), np.fft.rfft(m))


def test_many_blocks_and_tiles(spark):
    sizes = [1 + k % 3 for k in range(structured.FEW + 10)]
    n = sum(sizes)
    x = _draw(n, n) + 9 * np.eye(n)
    low = np.repeat(np.arange(len(sizes)), sizes)
    mask = low[:, None] == low
    a = BlockTensor.of(tensor(spark, x), sizes)
    assert np.allclose(a.to_dense().to_numpy(), x * mask)
    assert np.allclose(a.invert().tensor.to_numpy(), np.linalg.inv(x * mask))
    w, v = a.geev()
    assert np.allclose(x * mask @ v.tensor.to_numpy(), v.tensor.to_numpy() * w.to_numpy())
    t = structured.apply_view(tensor(spark, x * mask), sizes, sizes)
    assert sorted((r.t0, r.t1) for r in t.filled().collect()) == [(k, k) for k in range(len(sizes))]
    turned = structured.permute("ji", "ij", TiledTensor.of(tensor(spark, x[:, :5]), (sizes, (2, 3))))
    assert turned.parts == ((2, 3), tuple(sizes)) and np.allclose(turned.to_dense().to_numpy(), x[:, :5].T)


def test_disk_layers(spark, tmp_path, monkeypatch):
    x = np.arange(1.0, 21).reshape(4, 5)
    d = DiskTensor(spark, f"file://{tmp_path}", "a", (4, 5))
    d.write(tensor(spark, x))
    files = lambda: len(list(tmp_path.glob("a/v*/part-*")))
    before = files()
    d.write_view((slice(0, 2), 3), 0.5)
    assert files() > before
    stored = sum(spark.read.parquet(f"file://{tmp_path}/a/v1").count() for _ in (0,))
    assert stored == 2  # the window, not the tensor
    x[:2, 3] = 0.5
    d.add_view((1,), 1.0)
    x[1] += 1
    assert np.allclose(d.tensor().to_numpy(), x)
    monkeypatch.setattr(DiskTensor, "MOST_LAYERS", 3)
    d.write_view((3, 4), 9.0)
    x[3, 4] = 9
    assert np.allclose(d.tensor().to_numpy(), x) and len(d._meta()["layers"]) == 1
    d.resize(2, 5)
    d.resize(4, 5)
    assert np.allclose(d.tensor().to_numpy(), np.vstack([x[:2], np.zeros((2, 5))]))
    d.contract("ij,j->ij", d, g.arange(spark, 5), alpha=2.0, beta=1.0)
    assert np.allclose(d.tensor().to_numpy()[:2], x[:2] + 2 * x[:2] * np.arange(5))


def test_windows_and_iteration(spark):
    x = np.zeros(7)
    x[[1, 4]] = 2.0, 5.0
    t = tensor(spark, x)
    assert list(t) == list(x) and len(t) == 7 and list(reversed(list(t))) == list(x[::-1])
    assert [list(r) for r in tensor(spark, np.diag([1.0, 2]))] == [[1, 0], [0, 2]]
    assert np.allclose(t.add_to((slice(1, 3),), tensor(spark, np.ones(2))).to_numpy(), x + [0, 1, 1, 0, 0, 0, 0])


def test_distributions(spark):
    normal = g.random(spark, (20_000,), 3, distribution="normal").to_numpy()
    assert abs(normal.mean()) < 0.03 and abs(normal.std() - 1) < 0.03
    edge = g.random(spark, (500,), 4, "complex128", distribution="unit_circle").to_numpy()
    assert np.allclose(np.abs(edge), 1)
    disk = g.random(spark, (500,), 4, "complex128").to_numpy()
    assert (np.abs(disk) < 1).all() and np.abs(disk).min() < 0.2
    g.seed_random(9)
    assert np.allclose(g.random(spark, (5,)).to_numpy(), g.random(spark, (5,), 9).to_numpy())
    for bad in (("circle", "float64"), ("uniform", "complex128"), ("cauchy", "float64")):
        with pytest.raises(BadLogic):
            g.random(spark, (5,), 1, bad[1], distribution=bad[0])


def test_precise_dot(spark):
    x, y = np.array([1e16, 1.0, -1e16, 3.0]), np.array([1.0, 1e-3, 1.0, 1e-3])
    assert blas.precise_dot(tensor(spark, x), tensor(spark, y)).item() == 0.004
    assert blas.precise_dot(tensor(spark, np.zeros(3)), tensor(spark, np.zeros(3))).item() == 0.0


def test_stream_to_files(spark, tmp_path):
    from weft.streaming.contraction import contract_stream, keep, latest

    x, v = _draw(6, 4), _draw(4)
    rows = tensor(spark, x).df
    for k in range(3):
        rows.where(f"i1 % 3 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    changes = spark.readStream.schema("i0 long, i1 long, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    keep(contract_stream(changes, "ij", tensor(spark, v), "j", "i"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    found = {r.i0: r.v for r in latest(f"{tmp_path}/out", spark, ["i0"]).collect()}
    assert np.allclose([found[k] for k in range(6)], x @ v)


def test_bounds_come_from_footers(spark, tmp_path):
    tensor(spark, _draw(7, 3)).df.write.parquet(f"{tmp_path}/t.parquet")
    df = tables.maxima(spark, str(tmp_path), "t", "i0", "i1")
    assert "PushedAggregation: [MAX(i0), MAX(i1)]" in df._jdf.queryExecution().toString()
    assert tables.bounds(spark, str(tmp_path), "t", "i0", "i1") == [7, 3]
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")


def test_products_of_blocks_give_the_dense_result(spark):
    x, v = _draw(6, 6), _draw(6)
    t = structured.apply_view(tensor(spark, x), (2, 0, 4), (3, 3))
    y = structured.gemv(2.0, t, tensor(spark, v))
    assert isinstance(y, TiledTensor) and y.parts == ((2, 0, 4),) and np.allclose(y.to_dense().to_numpy(), 2 * x @ v)
    z = einsum("ij,ij->", tensor(spark, x), tensor(spark, x)).item()
    assert np.isclose(structured.true_dot(t, t).item(), z)
