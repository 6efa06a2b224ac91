"""Array-of-double column expressions.

Vectors are ``array<double>`` columns and every function here is a Spark
higher-order function, so the work stays inside whole-stage codegen. Weight
matrices are small literals supplied by the caller (bounded by the model
width, not by the data).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def zeros(n) -> Column:
    """``n`` zeros (n may be an int or a column)."""
    return F.array_repeat(F.lit(0.0), n if isinstance(n, Column) else F.lit(int(n)))


def as_double(v) -> Column:
    """P9 (accumulate in double): cast any numeric array to array<double>."""
    return _col(v).cast("array<double>")


def as_float(v) -> Column:
    """The reference's float32 tensors."""
    return _col(v).cast("array<float>")


def select_positions(v, indices: Sequence[int], k: int | None = None) -> Column:
    """Keep the given positions in the given order; if the vector is
    narrower than ``k`` the result is ``k`` zeros."""
    v = _col(v)
    k = len(indices) if k is None else k
    picked = F.array(*[F.get(v, int(i)) for i in indices])
    return F.when(F.size(v) >= k, picked).otherwise(zeros(k))


def select_positions_col(v, indices, k) -> Column:
    """P4 with the index list as a column (e.g. a scalar subquery)."""
    v = _col(v)
    picked = F.transform(_col(indices), lambda i: F.get(v, i))
    return F.when(F.size(v) >= k, picked).otherwise(zeros(k))


def standardise(v, mean, std, zero_std: str = "zero", width: int | None = None) -> Column:
    """(x - mean) / std elementwise. ``zero_std='zero'`` maps a zero std
    to 0.0 (Q12); ``'one'`` divides by 1 as a fitted population scaler does.
    Where all vectors have the known ``width``, each element is an expression of
    its own, which Spark compiles."""
    v, mean, std = _col(v), _col(mean), _col(std)
    if width is not None and zero_std == "one":
        at = lambda i: (F.get(v, i) - F.get(mean, i)) / F.when(F.get(std, i) == 0, F.lit(1.0)).otherwise(F.get(std, i))
        return F.when(v.isNotNull() & mean.isNotNull() & std.isNotNull(), F.array(*[at(i) for i in range(width)]))
    centred = F.zip_with(v, mean, lambda x, m: x - m)
    if zero_std == "one":
        return F.zip_with(centred, std, lambda c, s: c / F.when(s == 0, F.lit(1.0)).otherwise(s))
    return F.zip_with(centred, std, lambda c, s: F.coalesce(F.try_divide(c, F.when(s != 0, s)), F.lit(0.0)))


def densify(entries, width: int) -> Column:
    """X11: ``array<struct<ix,value>>`` (sparse row) → dense array of ``width``.

    Linear in ``width + nnz``: entries are sorted by index and each one emits
    the zeros of the gap before it plus its value; the pieces are flattened
    once and the tail is padded. (A map lookup per position would scan the
    map each time.)
    """
    def filled(es: Column) -> Column:
        prev_ix = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.get(es, k - 1).getField("ix"))
        pieces = F.transform(es, lambda e, k: F.concat(
            F.array_repeat(F.lit(0.0), e.getField("ix") - prev_ix(k) - 1), F.array(e.getField("value").cast("double"))))
        last = F.when(F.size(es) == 0, F.lit(-1)).otherwise(F.get(es, F.size(es) - 1).getField("ix"))
        return F.concat(F.flatten(pieces), F.array_repeat(F.lit(0.0), F.lit(width - 1) - last))

    # as a lambda's variable the sorted array is made once, not once per entry
    return F.get(F.transform(F.array(F.array_sort(_col(entries))), filled), 0)


def promote(v) -> Column:
    """One vector becomes a one-row sequence."""
    return F.array(_col(v))


def pad_rows(seq, max_len, width) -> Column:
    """Right-pad a sequence of vectors with zero rows up to ``max_len``."""
    seq = _col(seq)
    missing = F.greatest(_col(max_len) - F.size(seq), F.lit(0))
    return F.concat(seq, F.array_repeat(zeros(width), missing))


def padding_mask(length, max_len) -> Column:
    """True where position >= length; empty when max_len is 0."""
    length, max_len = _col(length), _col(max_len)
    return F.when(max_len <= 0, F.array().cast("array<boolean>")).otherwise(
        F.transform(F.sequence(F.lit(0), max_len - 1), lambda i: i >= length))


def positional_row(pos, dim: int) -> Column:
    """Sinusoidal encoding of one position, width ``dim``.

    Even index 2i: sin(p * f_i); odd index 2i+1: cos(p * f_i), with
    f_i = exp(-2i * ln(10000) / dim).
    """
    p = _col(pos).cast("double")
    scale = -math.log(10000.0) / dim
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda j: F.when(j % 2 == 0, F.sin(p * F.exp((j - j % 2).cast("double") * F.lit(scale))))
        .otherwise(F.cos(p * F.exp((j - j % 2).cast("double") * F.lit(scale)))))


def add(a, b) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x + y)


def dot(a, b) -> Column:
    """X25 building block: inner product of two equal-width vectors."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def project(v, weights: Sequence[Sequence[float]], bias: Sequence[float] | None = None) -> Column:
    """W v + b with a literal matrix W (rows = outputs)."""
    v = _col(v)
    rows = [dot(lit_vector(r), v) for r in weights]
    if bias is not None:
        rows = [r + F.lit(float(b)) for r, b in zip(rows, bias)]
    return F.array(*rows)


def concat(*vs) -> Column:
    """Join vectors end to end."""
    return F.concat(*[_col(v) for v in vs])


def affine(v, mean, var, gamma, beta, eps: float = 1e-5) -> Column:
    """Evaluation-mode per-dimension normalisation with supplied
    statistics: (x - mean) / sqrt(var + eps) * gamma + beta."""
    v = _col(v)
    inv = F.transform(lit_vector(var), lambda s: F.lit(1.0) / F.sqrt(s + F.lit(eps)))
    centred = F.zip_with(v, lit_vector(mean), lambda x, m: x - m)
    scaled = F.zip_with(centred, inv, lambda c, i: c * i)
    return F.zip_with(F.zip_with(scaled, lit_vector(gamma), lambda s, g: s * g),
                      lit_vector(beta), lambda s, b: s + b)


def vsum(v, width: int | None = None) -> Column:
    """The sum of the elements; of a known ``width`` as a compiled expression."""
    if width is not None:
        return sum((F.get(_col(v), i) for i in range(width)), F.lit(0.0))
    return F.aggregate(_col(v), F.lit(0.0), lambda acc, x: acc + x)


def vchecksum(v, width: int | None = None) -> Column:
    """The sum of the elements times their 1-based position."""
    if width is not None:
        return sum((F.get(_col(v), i) * F.lit(i + 1) for i in range(width)), F.lit(0.0))
    return vsum(F.transform(_col(v), lambda x, i: x * (i + 1)))


def vsumsq(v) -> Column:
    return F.aggregate(_col(v), F.lit(0.0), lambda acc, x: acc + x * x)
