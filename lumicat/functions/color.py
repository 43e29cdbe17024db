"""The colour formulas as Columns: each takes column names or SQL text and gives a Column or a tuple of them."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from . import formulas


def _column(f):
    @wraps(f)
    def wrapped(*args, **kwargs):
        out = f(*args, **kwargs)
        return tuple(F.expr(x) for x in out) if isinstance(out, tuple) else F.expr(out)

    return wrapped


_SCALARS = ("num", "inverse3", "product3")
for _name, _f in vars(formulas).copy().items():
    if callable(_f) and getattr(_f, "__module__", "") == formulas.__name__ and not _name.startswith("_") and _name not in _SCALARS:
        globals()[_name] = _column(_f)
inverse3, product3 = formulas.inverse3, formulas.product3
