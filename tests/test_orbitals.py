"""Closed-shell self-consistent fields and second-order corrections, end to end: text files of integrals, blocks, tiles, powers.

Integrals over contracted s functions on hydrogen atoms have closed forms, so the files are made here. The energy of two atoms
1.4 apart in this basis is a textbook number; four atoms in a row are compared with numpy.
"""

import math

import numpy as np
import pytest

from weft.operators import shape, solve, spectral, structured
from weft.plans.contraction import Plan, einsum
from weft.sources.text import read_tensor

#: Exponents and coefficients of the three Gaussians of a hydrogen atom (fixed values of the basis STO-3G).
EXPONENTS = (3.425250914, 0.6239137298, 0.1688554040)
COEFFICIENTS = (0.1543289673, 0.5353281423, 0.4446345422)


def _boys(t):
    return 1 - t / 3 if t < 1e-10 else 0.5 * math.sqrt(math.pi / t) * math.erf(math.sqrt(t))


def integrals(places):
    """Overlap, kinetic, nuclear attraction, repulsion; nuclear repulsion."""
    n = len(places)
    parts = [(e, c * (2 * e / math.pi) ** 0.75) for e, c in zip(EXPONENTS, COEFFICIENTS, strict=True)]
    s, t, v = (np.zeros((n, n)) for _ in range(3))
    pairs = {}
    for i in range(n):
        for j in range(n):
            r2 = (places[i] - places[j]) ** 2
            pairs[i, j] = []
            for a, ca in parts:
                for b, cb in parts:
                    p, mu = a + b, a * b / (a + b)
                    k, centre = ca * cb * math.exp(-mu * r2), (a * places[i] + b * places[j]) / (a + b)
                    pairs[i, j].append((p, k, centre))
                    overlap = k * (math.pi / p) ** 1.5
                    s[i, j] += overlap
                    t[i, j] += mu * (3 - 2 * mu * r2) * overlap
                    v[i, j] -= sum(2 * math.pi / p * k * _boys(p * (centre - z) ** 2) for z in places)
    tei = np.zeros((n,) * 4)
    for i, j, k, l in np.ndindex(tei.shape):
        tei[i, j, k, l] = sum(2 * math.pi**2.5 / (p * q * math.sqrt(p + q)) * kp * kq * _boys(p * q / (p + q) * (cp - cq) ** 2) for p, kp, cp in pairs[i, j] for q, kq, cq in pairs[k, l])
    return s, t, v, tei, sum(1 / abs(a - b) for k, a in enumerate(places) for b in places[:k])


def by_numpy(s, h, tei, occupied, nuclear):
    w, u = np.linalg.eigh(s)
    x = u * w**-0.5 @ u.T
    d = np.zeros_like(s)
    for _ in range(60):
        f = h + 2 * np.einsum("mnls,ls->mn", tei, d) - np.einsum("mlns,ls->mn", tei, d)
        e, c = np.linalg.eigh(x @ f @ x)
        c = x @ c
        d = c[:, :occupied] @ c[:, :occupied].T
    energy = np.sum(d * (h + f)) + nuclear
    mo = np.einsum("mnls,mp,nq,lr,st->pqrt", tei, c, c, c, c)
    o, v = slice(0, occupied), slice(occupied, None)
    iajb = mo[o, v, o, v]
    gaps = e[o, None, None, None] - e[None, v, None, None] + e[None, None, o, None] - e[None, None, None, v]
    return energy, energy + np.sum(iajb * (2 * iajb - iajb.transpose(0, 3, 2, 1)) / gaps)


def store(folder, name, x):
    """Indices from one, and only the first of the cells that symmetry makes equal."""
    def first(at):
        if len(at) == 2:
            return at[0] >= at[1]
        (i, j), (k, l) = at[:2], at[2:]
        return i >= j and k >= l and (i, j) >= (k, l)

    (folder / name).write_text("\n".join(" ".join(map(str, [*(k + 1 for k in at), repr(float(x[at]))])) for at in np.ndindex(x.shape) if first(at)))


def fields(spark, folder, n, occupied, nuclear, blocks=None):
    """The same equations on tensors; with ``blocks``, orbitals are found block by block and products are of tiles."""
    s, t, v = (read_tensor(spark, f"file://{folder}/{x}", (n, n)).cache() for x in "STV")
    tei = read_tensor(spark, f"file://{folder}/TEI", (n,) * 4).cache()
    h = (t + v).cache()
    if blocks:
        x = structured.BlockTensor.of(s, blocks).power(-0.5)
        tiled = structured.apply_view(tei, *[blocks] * 4)
    else:
        x = solve.power(s, -0.5)
    x_plain = (x.to_dense() if blocks else x).cache()
    d, f, energy, before = None, h, 0.0, None
    for _ in range(40):
        turned = (x_plain @ f @ x_plain).cache()
        if blocks:
            w, c = structured.BlockTensor.of(turned, blocks).syev()
            c = c.to_dense()
        else:
            w, c = spectral.syev(turned)
        values = w.to_numpy()
        order = np.argsort(values)
        c = type(c).from_numpy(spark, (x_plain @ c).to_numpy()[:, order])
        some = c[:, 0:occupied]
        d = type(c).from_numpy(spark, einsum("mi,ni->mn", some, some).to_numpy())
        if blocks:
            j = structured.contract("mnls,ls->mn", tiled, structured.apply_view(d, blocks, blocks)).to_dense()
        else:
            j = einsum("mnls,ls->mn", tei, d)
        k = Plan("mn", "mlns", "ls").execute(tei, d)
        f = type(c).from_numpy(spark, (h + j * 2.0 - k).to_numpy())
        energy = einsum("mn,mn->", d, h + f).item() + nuclear
        if before is not None and abs(energy - before) < 1e-13:
            break
        before = energy
    first = einsum("mnls,mp,nq->pqls", tei, some, c)
    mo = einsum("pqls,lr,st->pqrt", first, some, c)
    e = np.sort(values)
    iajb = mo[:, occupied:n, :, occupied:n].cache()
    swapped = shape.permute("ibja", "iajb", iajb)
    gaps = e[:occupied, None, None, None] - e[None, occupied:, None, None] + e[None, None, :occupied, None] - e[None, None, None, occupied:]
    part = (iajb * 2.0 - swapped) * type(c).from_numpy(spark, 1 / gaps)
    return energy, energy + einsum("iajb,iajb->", iajb, part).item()


def test_two_atoms(spark, tmp_path):
    s, t, v, tei, nuclear = integrals([0.0, 1.4])
    for name, x in zip(("S", "T", "V", "TEI"), (s, t, v, tei), strict=True):
        store(tmp_path, name, x)
    energy, second = fields(spark, tmp_path, 2, 1, nuclear)
    assert energy == pytest.approx(-1.1167, abs=1e-4)
    assert (energy, second) == pytest.approx(by_numpy(s, t + v, tei, 1, nuclear), abs=1e-9)


@pytest.mark.parametrize("blocks", [None, (2, 0, 2)])
def test_four_atoms(spark, tmp_path, blocks):
    """Orbitals that are even and odd under reflection do not mix: two blocks, and an empty one between them."""
    s, t, v, tei, nuclear = integrals([-2.7, -0.9, 0.9, 2.7])
    u = np.zeros((4, 4))
    for k, (a, b, sign) in enumerate([(0, 3, 1), (1, 2, 1), (0, 3, -1), (1, 2, -1)]):
        u[a, k], u[b, k] = 2**-0.5, sign * 2**-0.5
    s, t, v = (np.where(np.abs(u.T @ x @ u) > 1e-13, u.T @ x @ u, 0) for x in (s, t, v))
    tei = np.einsum("mnls,mp,nq,lr,st->pqrt", tei, u, u, u, u)
    for name, x in zip(("S", "T", "V", "TEI"), (s, t, v, tei), strict=True):
        store(tmp_path, name, x)
    assert fields(spark, tmp_path, 4, 2, nuclear, blocks) == pytest.approx(by_numpy(s, t + v, tei, 2, nuclear), abs=1e-8)
