"""The whole surface of tensor operations in one place: ``from weft.api import *``."""

from __future__ import annotations

from weft.config import Settings, labeled_section, settings
from weft.functions.generators import arange, computed, diagonal, diagonal_like, filled, identity, incremented, kronecker, like, random, random_definite, random_semidefinite, set_diagonal, shifted, zeros
from weft.functions.scalars import add_complex, is_complex, real_of as remove_complex
from weft.operators.blas import asum, axpby, axpy, direct_product, dot, gemm, gemv, ger, gerc, nrm2, rscl, scale, scale_column, scale_row, sum1, sum_square, symm_gemm, trace, true_dot, weight
from weft.operators.decomposition import initialize_cp, initialize_tucker, parafac, parafac_reconstruct, tucker_ho_oi, tucker_ho_svd, tucker_reconstruct, weight_tensor, weighted_parafac
from weft.operators.elementwise import absolute, conjugate, element, element_transform, imag, real, rmsd, to_complex
from weft.operators.fft import fft, fft_rows, fftfreq, ifft
from weft.operators.norms import Norm, norm, vec_norm
from weft.operators.shape import compile_permute, enumerate_many, flatten, khatri_rao, permute, reshape, resize, tie_indices, transpose, unfold
from weft.operators.solve import det, extract_plu, gesv, getrf, getri, invert, power, pseudoinverse, solve_continuous_lyapunov, trsyl
from weft.operators.spectral import Vectors, gees, geev, gelqf, geqrf, gram, heev, qr, sterf, svd, svd_dd, svd_nullspace, syev, truncated_svd, truncated_syev
from weft.operators.structured import BlockTensor, TiledTensor, apply_view, contract
from weft.plans.contraction import batched, compile_plan, einsum
from weft.plans.labels import Algorithm, classify
from weft.sources.disk import DiskTensor, create_disk_tensor, create_disk_tensor_like
from weft.sources.text import read_tensor, show
from weft.streaming.contraction import contract_stream
from weft.tensor import Tensor

create_tensor = zeros
create_zero_tensor = zeros
create_identity_tensor = identity
create_incremented_tensor = incremented
create_random_tensor = random
create_random_definite = random_definite
create_random_semidefinite = random_semidefinite
create_tensor_like = like

__all__ = [n for n in dir() if not n.startswith("_") and n != "annotations"]
