"""The formula vocabulary.

A metric formula is a Python callable over :class:`Term` operands, for example
``lambda a, b: fx.round(a / b, 2)``. A ``Term`` wraps a Spark ``Column`` and
gives the operators their metric meaning: division and remainder by zero are
null, ``**`` is power, comparisons give conditions. Everything is built-in
Column work, so a formula stays inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tallyframe.functions.numeric import finite


class Term:
    """A numeric (or, for comparisons, boolean) operand of a formula."""

    __slots__ = ("column", "is_condition")
    __hash__ = None

    def __init__(self, column: Column, is_condition: bool = False):
        self.column = column
        self.is_condition = is_condition

    def __add__(self, other):
        return Term(_num(self) + _num(other))

    def __radd__(self, other):
        return Term(_num(other) + _num(self))

    def __sub__(self, other):
        return Term(_num(self) - _num(other))

    def __rsub__(self, other):
        return Term(_num(other) - _num(self))

    def __mul__(self, other):
        return Term(_num(self) * _num(other))

    def __rmul__(self, other):
        return Term(_num(other) * _num(self))

    def __truediv__(self, other):
        return Term(F.try_divide(_num(self), _num(other)))

    def __rtruediv__(self, other):
        return Term(F.try_divide(_num(other), _num(self)))

    def __mod__(self, other):
        return Term(F.try_mod(_num(self), _num(other)))

    def __rmod__(self, other):
        return Term(F.try_mod(_num(other), _num(self)))

    def __pow__(self, other):
        return Term(F.pow(_num(self), _num(other)))

    def __rpow__(self, other):
        return Term(F.pow(_num(other), _num(self)))

    def __neg__(self):
        return Term(-_num(self))

    def __pos__(self):
        return Term(_num(self))

    def __eq__(self, other):
        return Term(_raw(self) == _raw(other), True)

    def __ne__(self, other):
        return Term(_raw(self) != _raw(other), True)

    def __lt__(self, other):
        return Term(_num(self) < _num(other), True)

    def __le__(self, other):
        return Term(_num(self) <= _num(other), True)

    def __gt__(self, other):
        return Term(_num(self) > _num(other), True)

    def __ge__(self, other):
        return Term(_num(self) >= _num(other), True)

    def __and__(self, other):
        return Term(_cond(self) & _cond(other), True)

    def __or__(self, other):
        return Term(_cond(self) | _cond(other), True)

    def __invert__(self):
        return Term(~_cond(self), True)


def _raw(x) -> Column:
    if isinstance(x, Term):
        return x.column
    if isinstance(x, Column):
        return x
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return F.lit(x)
    return F.lit(float(x))


def _num(x) -> Column:
    c = _raw(x)
    if isinstance(x, bool) or (isinstance(x, Term) and x.is_condition):
        return c.cast("double")
    return c.cast("double") if x is None else c


def _cond(x) -> Column:
    if isinstance(x, bool) or (isinstance(x, Term) and x.is_condition):
        return _raw(x)
    return _num(x) != F.lit(0.0)


def result_column(x) -> Column:
    """The formula result as a metric value: a finite double, else null.

    A bare condition or text is no metric value and gives null; use ``if_`` to turn it into numbers.
    """
    if isinstance(x, (bool, str)) or x is None or (isinstance(x, Term) and x.is_condition):
        return F.lit(None).cast("double")
    return finite(_num(x).cast("double"))


class fx:
    """Functions a formula may call."""

    @staticmethod
    def add(*xs):
        return reduce(lambda a, b: _term(a) + b, xs)

    @staticmethod
    def subtract(a, b):
        return _term(a) - b

    @staticmethod
    def multiply(*xs):
        return reduce(lambda a, b: _term(a) * b, xs)

    @staticmethod
    def divide(a, b):
        return _term(a) / b

    @staticmethod
    def mod(a, b):
        return _term(a) % b

    @staticmethod
    def pow(a, b):
        return _term(a) ** b

    @staticmethod
    def equal(a, b):
        return _term(a) == b

    @staticmethod
    def unequal(a, b):
        return _term(a) != b

    @staticmethod
    def smaller(a, b):
        return _term(a) < b

    @staticmethod
    def smaller_eq(a, b):
        return _term(a) <= b

    @staticmethod
    def larger(a, b):
        return _term(a) > b

    @staticmethod
    def larger_eq(a, b):
        return _term(a) >= b

    @staticmethod
    def and_(a, b):
        return _term(a) & b

    @staticmethod
    def or_(a, b):
        return _term(a) | b

    @staticmethod
    def not_(a):
        return ~_term(a)

    @staticmethod
    def if_(condition, then, otherwise):
        return Term(F.when(_cond(condition), _num(then)).otherwise(_num(otherwise)))

    @staticmethod
    def sqrt(x):
        return Term(finite(F.sqrt(_num(x))))

    @staticmethod
    def abs(x):
        return Term(F.abs(_num(x)))

    @staticmethod
    def sign(x):
        return Term(F.signum(_num(x)))

    @staticmethod
    def round(x, digits: int = 0):
        return Term(F.round(_num(x), digits))

    @staticmethod
    def floor(x):
        return Term(F.floor(_num(x)).cast("double"))

    @staticmethod
    def ceil(x):
        return Term(F.ceil(_num(x)).cast("double"))

    @staticmethod
    def exp(x):
        return Term(F.exp(_num(x)))

    @staticmethod
    def log(x, base=None):
        natural = F.ln(_num(x))
        return Term(natural if base is None else F.try_divide(natural, F.ln(_num(base))))

    @staticmethod
    def log10(x):
        return Term(F.log10(_num(x)))

    @staticmethod
    def min(*xs):
        return Term(F.least(*map(_num, xs))) if len(xs) > 1 else Term(_num(xs[0]))

    @staticmethod
    def max(*xs):
        return Term(F.greatest(*map(_num, xs))) if len(xs) > 1 else Term(_num(xs[0]))

    @staticmethod
    def sin(x):
        return Term(F.sin(_num(x)))

    @staticmethod
    def cos(x):
        return Term(F.cos(_num(x)))

    @staticmethod
    def tan(x):
        return Term(F.tan(_num(x)))

    @staticmethod
    def asin(x):
        return Term(F.asin(_num(x)))

    @staticmethod
    def acos(x):
        return Term(F.acos(_num(x)))

    @staticmethod
    def atan(x):
        return Term(F.atan(_num(x)))

    @staticmethod
    def sum(*xs):
        return fx.add(*xs)

    @staticmethod
    def mean(*xs):
        return fx.add(*xs) / len(xs)

    @staticmethod
    def median(*xs):
        ordered = F.sort_array(F.array(*map(_num, xs)))
        low, high = (len(xs) - 1) // 2, len(xs) // 2
        return Term((ordered[low] + ordered[high]) / F.lit(2.0))


def _term(x) -> Term:
    return x if isinstance(x, Term) else Term(_num(x), isinstance(x, bool))
