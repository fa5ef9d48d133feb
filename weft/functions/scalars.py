"""Arithmetic on value columns: real ones are doubles (or integers), complex ones are structs of two doubles.

Everything is a Column expression, so products and sums stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.errors import ComplexConversionError

#: Element types: Spark type of the value column, rank in promotion.
DTYPES = {"int32": ("int", 0), "int64": ("bigint", 1), "float32": ("float", 2), "float64": ("double", 3), "complex64": ("struct<re:double,im:double>", 4), "complex128": ("struct<re:double,im:double>", 5)}


def is_complex(dtype: str) -> bool:
    return dtype.startswith("complex")


def widest(*dtypes: str) -> str:
    return max(dtypes, key=lambda d: DTYPES[d][1])


def real_of(dtype: str) -> str:
    return {"complex64": "float32", "complex128": "float64"}.get(dtype, dtype)


def add_complex(dtype: str) -> str:
    return {"float32": "complex64"}.get(dtype, dtype if is_complex(dtype) else "complex128")


class Real:
    """Products and sums are made in double (integers in bigint) and narrowed at the end."""

    complex = False

    def __init__(self, integral: bool = False):
        self.wide = "bigint" if integral else "double"

    def lift(self, c: Column, dtype: str) -> Column:
        return c.cast(self.wide)

    def lit(self, x) -> Column:
        if isinstance(x, complex):
            if x.imag:
                raise ComplexConversionError("a complex factor on real tensors")
            x = x.real
        # an integral tensor scaled by a fraction is computed in double
        return F.lit(float(x)) if self.wide == "double" or float(x) != int(x) else F.lit(int(x)).cast("bigint")

    def zero(self) -> Column:
        return self.lit(0)

    def or_zero(self, c: Column) -> Column:
        return F.coalesce(c, self.zero())

    def mul(self, a: Column, b: Column) -> Column:
        return a * b

    def div(self, a: Column, b: Column) -> Column:
        """IEEE division: x / 0 is an infinity or NaN, as for the numbers themselves."""
        a, b = a.cast("double"), b.cast("double")
        nan = F.lit(float("nan"))
        sign = F.when(F.signum(b) == 0, F.when(b.cast("string") == "-0.0", -1.0).otherwise(1.0))
        return F.when(b != 0, F.try_divide(a, b)).otherwise(F.when((a == 0) | F.isnan(a), nan).otherwise(F.lit(float("inf")) * F.signum(a) * sign))

    def add(self, a: Column, b: Column) -> Column:
        return a + b

    def sub(self, a: Column, b: Column) -> Column:
        return a - b

    def neg(self, a: Column) -> Column:
        return -a

    def conj(self, a: Column) -> Column:
        return a

    def sum(self, a: Column) -> Column:
        return F.sum(a)

    def square(self, a: Column) -> Column:
        """|a| ** 2 as a double."""
        return a.cast("double") * a.cast("double")

    def abs(self, a: Column) -> Column:
        return F.abs(a)

    def nonzero(self, a: Column) -> Column:
        return a != 0

    def narrow(self, a: Column, dtype: str) -> Column:
        return a.cast(DTYPES[dtype][0])


class Complex(Real):
    complex = True

    @staticmethod
    def make(re: Column, im: Column) -> Column:
        return F.struct(re.alias("re"), im.alias("im"))

    @staticmethod
    def _parts(c: Column) -> tuple[Column, Column]:
        return c.getField("re"), c.getField("im")

    def lift(self, c: Column, dtype: str) -> Column:
        return c if is_complex(dtype) else self.make(c.cast("double"), F.lit(0.0))

    def lit(self, x) -> Column:
        z = complex(x)
        return self.make(F.lit(z.real), F.lit(z.imag))

    def mul(self, a: Column, b: Column) -> Column:
        (ar, ai), (br, bi) = self._parts(a), self._parts(b)
        return self.make(ar * br - ai * bi, ar * bi + ai * br)

    def div(self, a: Column, b: Column) -> Column:
        (br, bi), r = self._parts(b), Real()
        ar, ai = self._parts(self.mul(a, self.conj(b)))
        size = br * br + bi * bi
        return self.make(r.div(ar, size), r.div(ai, size))

    def add(self, a: Column, b: Column) -> Column:
        (ar, ai), (br, bi) = self._parts(a), self._parts(b)
        return self.make(ar + br, ai + bi)

    def sub(self, a: Column, b: Column) -> Column:
        return self.add(a, self.neg(b))

    def neg(self, a: Column) -> Column:
        re, im = self._parts(a)
        return self.make(-re, -im)

    def conj(self, a: Column) -> Column:
        re, im = self._parts(a)
        return self.make(re, -im)

    def sum(self, a: Column) -> Column:
        re, im = self._parts(a)
        # one sum of a struct has no null when there are rows; the caller maps no rows to zero
        return F.when(F.count(F.lit(1)) > 0, self.make(F.sum(re), F.sum(im)))

    def square(self, a: Column) -> Column:
        re, im = self._parts(a)
        return re * re + im * im

    def abs(self, a: Column) -> Column:
        return F.hypot(*self._parts(a))

    def nonzero(self, a: Column) -> Column:
        re, im = self._parts(a)
        return (re != 0) | (im != 0)

    def narrow(self, a: Column, dtype: str) -> Column:
        if not is_complex(dtype):
            raise ComplexConversionError(f"complex values do not fit {dtype}")
        return a


def arithmetic(*dtypes: str) -> Real:
    top = widest(*dtypes)
    return Complex() if is_complex(top) else Real(top.startswith("int"))
