"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


# --- recoding and keys -----------------------------------------------------


def recode(col: Column, mapping: dict[Any, Any], default: Any = None) -> Column:
    """Map levels explicitly; levels without an entry become `default` (null)."""
    out = None
    for old, new in mapping.items():
        out = F.when(col == F.lit(old), F.lit(new)) if out is None else out.when(
            col == F.lit(old), F.lit(new)
        )
    return out if default is None else out.otherwise(F.lit(default))


def relabel(col: Column, mapping: dict[Any, Any]) -> Column:
    """Replace some levels and keep the rest; null stays null."""
    return F.coalesce(recode(col, mapping), col)


def composite_key(parts: Sequence[Column], sep: str = ":") -> Column:
    """Join key parts with `sep`; a missing part is written as NA."""
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("NA")) for p in parts])


def split_key(col: Column, into: Sequence[str], sep: str) -> list[Column]:
    """Split a composite key on a literal separator into named parts."""
    quoted = "".join("\\" + ch if not ch.isalnum() and ch != "_" else ch for ch in sep)
    parts = F.split(col, quoted)
    return [F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(into)]


def level_rank(col: Column, levels: Sequence[Any]) -> Column:
    """Position of a level in the given order, from 1; unknown levels are null."""
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), col)
    return F.when(pos > 0, pos.cast("int"))


# --- aggregates with explicit null rules -----------------------------------


def total(col: Column) -> Column:
    """Sum in which a group of nulls counts as 0."""
    return F.coalesce(F.sum(col), F.lit(0.0))


def strict_mean(col: Column) -> Column:
    """Mean that is null as soon as one value is missing."""
    return F.when(F.count(col) == F.count(F.lit(1)), F.avg(col))


def standard_error(col: Column, n: str | int = "valid") -> Column:
    """sd / sqrt(n) with n = non-missing rows, all rows, or a fixed number."""
    if n == "valid":
        size = F.count(col)
    elif n == "rows":
        size = F.count(F.lit(1))
    else:
        size = F.lit(int(n))
    return F.stddev_samp(col) / F.sqrt(size.cast("double"))


def sqrt_scaled_error(col: Column) -> Column:
    """sd(y / sqrt(rows)) next to a strict mean: null if any value is missing."""
    rows = F.count(F.lit(1))
    return F.when(F.count(col) == rows, F.stddev_samp(col) / F.sqrt(rows.cast("double")))


# --- response curves -------------------------------------------------------


def polynomial(x: Column, coefs: Sequence[Column]) -> Column:
    """b0 + b1 x + b2 x^2 + ... in Horner form."""
    out = coefs[-1]
    for c in reversed(coefs[:-1]):
        out = out * x + c
    return out


def vertex(x: Column, a: Column, h: Column, k: Column) -> Column:
    return a * (x - h) * (x - h) + k


def lactin(x: Column, p: Column, tmax: Column, dt: Column, lam: Column | None = None) -> Column:
    rise = F.exp(p * x) - F.exp(p * tmax - (tmax - x) / dt)
    return rise if lam is None else rise + lam


def theta_logistic(x: Column, r: Column, k: Column, theta: Column) -> Column:
    return r * x * (1 - F.pow(x / k, theta))


def briere(x: Column, a: Column, t0: Column, tm: Column, m: Column | None = None) -> Column:
    """a x (x - t0) (tm - x)^(1/m), zero outside [t0, tm]; m = 2 when not given."""
    room = F.greatest(tm - x, F.lit(0.0))
    root = F.sqrt(room) if m is None else F.pow(room, 1 / m)
    return F.when((x > t0) & (x < tm), a * x * (x - t0) * root).otherwise(F.lit(0.0))


# --- small linear systems as expressions -----------------------------------


def solve_symmetric(
    s: dict[tuple[int, int], Column], r: Sequence[Column], tolerance: float = 1e-11
) -> list[Column]:
    """Solve a symmetric system of 1 to 3 unknowns by determinants.

    `s[(i, j)]`, i <= j, holds the matrix. When the determinant is within
    `tolerance` of zero relative to the product of the diagonal, the system is
    singular (too few distinct x) and the solution is null.
    """

    def a(i: int, j: int) -> Column:
        return s[(min(i, j), max(i, j))]

    def det(m: list[list[Column]]) -> Column:
        if len(m) == 1:
            return m[0][0]
        if len(m) == 2:
            return m[0][0] * m[1][1] - m[0][1] * m[1][0]
        return (
            m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
            - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
            + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
        )

    p = len(r)
    full = [[a(i, j) for j in range(p)] for i in range(p)]
    scale = full[0][0]
    for i in range(1, p):
        scale = scale * full[i][i]
    d = det(full)
    usable = F.when(d > F.lit(tolerance) * scale, d)
    out = []
    for k in range(p):
        m = [[r[i] if j == k else full[i][j] for j in range(p)] for i in range(p)]
        out.append(det(m) / usable)
    return out
