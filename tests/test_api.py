import pytest

from weft import api, config
from weft.errors import BadLogic


def test_surface(spark):
    for name in "einsum gemm syev geev gesv svd svd_dd svd_nullspace truncated_svd qr det norm parafac tucker_ho_oi khatri_rao fft DiskTensor BlockTensor".split():
        assert hasattr(api, name)
    with config.labeled_section(spark, "a section"):
        assert api.einsum("i,i->", *[api.arange(spark, 4)] * 2).item() == 14
    assert config.sections["a section"][1] == 1


def test_settings():
    s = config.Settings()
    s.set("x", 3)
    s.set("x", "three")
    assert s.get("x", int) == 3 and s.get("x") == "three" and s.get("y", float) == 0.0 and s.get("y", bool, True)
    assert config.memory("4MB") == 4 << 20 and config.memory("1.5 k") == 1536
    for bad in (lambda: s.set("x", []), lambda: config.memory("4 bits")):
        with pytest.raises(BadLogic):
            bad()
