"""Index labels: parsing, and what a contraction is, from its labels alone."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from enum import Enum

from weft.errors import BadLogic, DimensionError, RankError


class Algorithm(Enum):
    """The dense kernel that a contraction amounts to. All kinds are one relational plan here; the kind says whether a blocked plan pays."""

    GENERIC = "generic"
    DOT = "dot"
    DIRECT = "direct"
    GER = "ger"
    GEMV = "gemv"
    GEMM = "gemm"
    INDETERMINATE = "indeterminate"


Labels = tuple[str, ...]


def labels_of(spec: str | Iterable[str]) -> Labels:
    """"ij", "i,j", "mu nu" or any iterable of names. Names are case-sensitive."""
    if isinstance(spec, str):
        text = spec.replace(",", " ").split()
        names = tuple(text) if len(text) > 1 or "," in spec else tuple("".join(text))
    else:
        names = tuple(spec)
    if any(not isinstance(x, str) or not x or not x.replace("_", "a").isalnum() for x in names):
        raise BadLogic(f"not index labels: {spec!r}")
    return names


def parse(spec: str) -> tuple[Labels, list[Labels]]:
    """"ij <- ik ; kj" or "ik,kj->ij": output and inputs. The arrow form takes one letter per label."""
    if "<-" in spec:
        out, inputs = spec.split("<-")
        return labels_of(out.strip()), [labels_of(x.strip()) for x in inputs.split(";")]
    if "->" in spec:
        inputs, out = spec.split("->")
        return tuple(out.strip()), [tuple(x.strip()) for x in inputs.split(",")]
    raise BadLogic(f"no arrow in {spec!r}")


def column(label: str) -> str:
    """A column name for a label: Spark compares names without case, labels do not."""
    return "x_" + "".join(("u" if c.isupper() else "l") + c.lower() if c.isalpha() else c for c in label)


def unique(labels: Iterable[str]) -> Labels:
    return tuple(dict.fromkeys(labels))


def intersect(a: Sequence[str], b: Iterable[str]) -> Labels:
    other = set(b)
    return tuple(x for x in unique(a) if x in other)


def difference(a: Sequence[str], b: Iterable[str]) -> Labels:
    other = set(b)
    return tuple(x for x in unique(a) if x not in other)


def _together(labels: Labels, group: Sequence[str]) -> bool:
    """The group's labels stand next to each other."""
    if not group:
        return True
    at = sorted(labels.index(x) for x in group)
    return at[-1] - at[0] == len(at) - 1


def _order(labels: Labels, group: Iterable[str]) -> Labels:
    wanted = set(group)
    return tuple(x for x in labels if x in wanted)


def classify(out: Labels, a: Labels, b: Labels, conjugate: bool = False, mixed: bool = False) -> Algorithm:
    """From the labels alone; layouts of memory, which could veto a kernel elsewhere, do not exist in a relation."""
    if mixed or any(len(set(x)) < len(x) for x in (out, a, b)):
        return Algorithm.GENERIC
    if not out and a and a == b:
        return Algorithm.DOT
    if a == b == out and out and not conjugate:
        return Algorithm.DIRECT
    links = [x for x in a if x in b and x not in out]
    batch = [x for x in a if x in b and x in out]
    stray = [x for x in out if x not in a and x not in b] + [x for x in (*a, *b) if x not in out and x not in links]
    if batch or stray:
        return Algorithm.GENERIC
    of_a, of_b = _order(a, difference(a, links)), _order(b, difference(b, links))
    if not links:
        fits = _together(out, of_a) and _together(out, of_b) and _order(out, of_a) == of_a and _order(out, of_b) == of_b
        return Algorithm.GER if fits and of_a and of_b else Algorithm.GENERIC
    if _order(a, links) != _order(b, links) or not (_together(a, links) and _together(b, links)):
        return Algorithm.GENERIC
    tidy = all(_together(x, g) and _order(out, g) == g for x, g in ((a, of_a), (b, of_b), (out, of_a), (out, of_b)))
    if not tidy or not out:
        return Algorithm.GENERIC
    return Algorithm.GEMM if of_a and of_b else Algorithm.GEMV


@dataclass(frozen=True)
class Contraction:
    """Labels of ``out <- a * b`` and what follows from them."""

    out: Labels
    a: Labels
    b: Labels
    algorithm: Algorithm = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "algorithm", classify(self.out, self.a, self.b))

    @property
    def shared(self) -> Labels:
        return intersect(self.a, self.b)

    @property
    def links(self) -> Labels:
        return difference(self.shared, self.out)

    @property
    def private_a(self) -> Labels:
        return difference(self.a, (*self.b, *self.out))

    @property
    def private_b(self) -> Labels:
        return difference(self.b, (*self.a, *self.out))

    @property
    def only_out(self) -> Labels:
        return difference(self.out, (*self.a, *self.b))

    def dims(self, a: Sequence[int], b: Sequence[int], out: Sequence[int] | None = None) -> dict[str, int]:
        """Dimension of each label; every use of a label must agree."""
        found: dict[str, int] = {}
        for labels, dims in ((self.a, a), (self.b, b), (self.out, out)):
            if dims is None:
                continue
            if len(labels) != len(dims):
                raise RankError(f"{len(labels)} labels for {len(dims)} dimensions")
            for x, n in zip(labels, dims, strict=True):
                if found.setdefault(x, n) != n:
                    raise DimensionError(f"label {x} has dimensions {found[x]} and {n}")
        for x in self.only_out:
            if x not in found:
                raise DimensionError(f"label {x} stands in the output only: its dimension must be given")
        return found


def cheapest_pair(terms: Sequence[Labels], out: Labels, dims: dict[str, int]) -> tuple[int, int]:
    """Greedy path: the pair whose result is smallest against what it uses up."""
    best: tuple[tuple[float, float], tuple[int, int]] | None = None
    for i in range(len(terms)):
        for j in range(i + 1, len(terms)):
            rest = set(out).union(*(t for k, t in enumerate(terms) if k not in (i, j)))
            kept = [x for x in unique((*terms[i], *terms[j])) if x in rest]
            size = 1.0
            for x in kept:
                size *= dims[x]
            used = sum(float(_volume(terms[k], dims)) for k in (i, j))
            cost = (size - used, float(_volume((*terms[i], *terms[j]), dims)))  # of equal gains, the one with fewer products
            if best is None or cost < best[0]:
                best = (cost, (i, j))
    assert best
    return best[1]


def _volume(labels: Iterable[str], dims: dict[str, int]) -> int:
    n = 1
    for x in set(labels):
        n *= dims[x]
    return n
