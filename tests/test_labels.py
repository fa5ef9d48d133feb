import pytest

from weft.errors import BadLogic, DimensionError, RankError
from weft.plans.labels import Algorithm, Contraction, cheapest_pair, classify, column, labels_of, parse

CLASSES = {
    "DOT": ["i,i->", "ij,ij->", "ijab,ijab->"],
    "DIRECT": ["ij,ij->ij", "iajb,iajb->iajb", "P,P->P"],
    "GER": ["i,j->ij", "j,i->ij", "i,j->ji", "ij,k->ijk", "ij,k->kij", "ij,kl->ijkl", "kl,ij->ijkl"],
    "GEMV": ["ij,j->i", "iaX,ia->X", "ijkl,kl->ij", "kl,ijkl->ij"],
    "GEMM": ["ik,kj->ij", "ik,jk->ij", "ki,kj->ij", "kj,ki->ij", "jk,ik->ij", "ijk,jkl->il", "Qia,iaX->QX", "ijmq,klmq->ijkl", "pqrs,sl->pqrl", "iaW,PW->iaP", "mjkl,mi->ijkl"],
    "GENERIC": ["iajb,ibja->", "kl,ikjl->ij", "ijk,jik->i", "ijk,jik->ik", "pqrs,rk->pqks", "iW,aW->iaW", "QaX,QX->aX", "klab,ab->klab", "ii,jj->ij", "ijk,jik->ii", "ji,ij->ij", "Ir,Mr->IMr", "ijk,jik->il"],
}


@pytest.mark.parametrize("name,spec", [(n, s) for n, x in CLASSES.items() for s in x])
def test_classes(name, spec):
    out, (a, b) = parse(spec)
    assert classify(out, a, b) is Algorithm[name]


def test_mixed_or_conjugated():
    assert classify(("i",), ("i", "j"), ("j",), mixed=True) is Algorithm.GENERIC
    assert classify(("i",), ("i",), ("i",), conjugate=True) is Algorithm.GENERIC


def test_parsing():
    assert parse("ij <- ik ; kj") == (("i", "j"), [("i", "k"), ("k", "j")])
    assert labels_of("mu,nu") == ("mu", "nu") and labels_of("ij") == ("i", "j")
    assert column("i").lower() != column("I").lower()
    for bad in ("ij", "i!"):
        with pytest.raises(BadLogic):
            parse(bad) if bad == "ij" else labels_of(bad)


def test_dimensions():
    plan = Contraction(("i", "j"), ("i", "k"), ("k", "j"))
    assert plan.links == ("k",) and plan.dims((2, 3), (3, 4)) == {"i": 2, "k": 3, "j": 4}
    with pytest.raises(DimensionError):
        plan.dims((2, 3), (4, 4))
    with pytest.raises(RankError):
        plan.dims((2,), (4, 4))
    with pytest.raises(DimensionError):
        Contraction(("i", "z"), ("i",), ("i",)).dims((2,), (2,))


def test_path_takes_the_cheap_pair():
    assert cheapest_pair([("i", "j"), ("j", "k"), ("k",)], ("i",), {"i": 100, "j": 100, "k": 100}) == (1, 2)
