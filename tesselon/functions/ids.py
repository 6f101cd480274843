"""Identifiers of grid points and their block owners, as plain numbers and as columns.

Ids start at 1; in several dimensions the first runs fastest. A dimension of n
points in p blocks gives each n // p points, and the last n % p blocks one more.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F


def per_dim(value, dims: int) -> tuple:
    """One value for each dimension."""
    return tuple(value) if isinstance(value, (tuple, list)) else (value,) * dims


def whole(a: Column, b: int) -> Column:
    """Division of whole numbers without a detour over floating point."""
    return F.call_function("div", a, F.lit(b))


def local_range(part: int, parts: int, n: int, ghost: int = 0, periodic: bool = False) -> tuple[int, int]:
    """First and last coordinate of a block with its ghost layers; clamped unless periodic."""
    size, extra = divmod(n, parts)
    small = parts - extra
    first = (part - 1) * size + max(0, part - 1 - small) + 1
    last = first + size - 1 + (part > small)
    first, last = first - int(ghost), last + int(ghost)
    return (first, last) if periodic else (max(first, 1), min(last, n))


def block_start(part: Column, parts: int, n: int) -> Column:
    """``local_range(...)[0]`` without ghosts."""
    size, extra = divmod(n, parts)
    return (part - 1) * size + F.greatest(part - 1 - (parts - extra), F.lit(0)) + 1


def block_size(part: Column, parts: int, n: int) -> Column:
    size, extra = divmod(n, parts)
    return F.lit(size) + (part > parts - extra).cast("int")


def block_owner(coord: Column, parts: int, n: int) -> Column:
    """The block of a coordinate in 1..n."""
    size, extra = divmod(n, parts)
    small = (parts - extra) * size
    late = whole(coord - small - 1, size + 1) + (parts - extra) + 1
    if not small:
        return late.cast("int")
    early = whole(coord - 1, max(size, 1)) + 1
    return F.when(coord <= small, early).otherwise(late).cast("int")


def coordinates(gid: Column, shape: tuple[int, ...]) -> list[Column]:
    """The coordinates of an id."""
    found, stride = [], 1
    for n in shape:
        found.append(F.pmod(whole(gid - 1, stride) if stride > 1 else gid - 1, F.lit(n)).cast("long") + 1)
        stride *= n
    return found


def linear_id(coords: list[Column], shape: tuple[int, ...]) -> Column:
    """The id of coordinates."""
    out, stride = F.lit(1).cast("long"), 1
    for c, n in zip(coords, shape, strict=True):
        out = out + (c - 1) * stride
        stride *= n
    return out.cast("long")


def wrapped(coord: Column, n: int) -> Column:
    """A coordinate beyond the ends of a periodic dimension."""
    return F.pmod(coord - 1, F.lit(n)) + 1


def uniform_owner(gid: Column, shape: tuple[int, ...], parts: tuple[int, ...]) -> Column:
    """The part that owns an id under a uniform partition; 0 for ids below 1."""
    owners = [block_owner(c, p, n) for c, p, n in zip(coordinates(gid, shape), parts, shape, strict=True)]
    return F.when(gid < 1, F.lit(0)).otherwise(linear_id(owners, parts)).cast("int")


def near_cubic(parts: int) -> tuple[int, int, int]:
    """Three factors of ``parts`` whose box has the least surface.

    Powers of one prime come in descending order; otherwise the different
    factors come first, in ascending order, and 1 comes last.
    """
    divisors = [d for d in range(1, parts + 1) if parts % d == 0]
    boxes = [(x, y, parts // (x * y)) for x in divisors for y in divisors if x <= y and (parts // x) % y == 0 and parts // (x * y) >= y]
    best = min(boxes, key=lambda c: (c[0] * c[1] + c[1] * c[2] + c[0] * c[2], c))
    prime = next((d for d in divisors if d > 1), 1)
    rest = parts
    while prime > 1 and rest % prime == 0:
        rest //= prime
    if rest == 1:
        return tuple(sorted(best, reverse=True))
    different = sorted(set(best) - {1})
    repeated = list(best)
    for d in different:
        repeated.remove(d)
    return tuple(different + sorted(repeated, reverse=True))


def total(shape: tuple[int, ...]) -> int:
    return prod(shape)
