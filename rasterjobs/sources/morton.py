"""Morton order of pixels: a key that interleaves the bits of row and column, and windows as ranges of keys.

Pixels that lie together have keys that lie together, so files sorted by key prune a window on both axes: a page or row group
covers a compact block of cells, and a window is a few ranges of keys.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name of the key in pixel files; ranges of a window at most, more are merged over the smallest gaps.
ZKEY, RANGES = "zkey", 24


def _mask(block: int) -> int:
    """Blocks of ``block`` ones, as many zeros between them, in 64 bits."""
    return sum(((1 << block) - 1) << at for at in range(0, 64, 2 * block))


def _spread(x: Column) -> Column:
    """The low 31 bits of ``x`` at the even places of a long."""
    x = x.cast("long")
    for block in (16, 8, 4, 2, 1):
        x = x.bitwiseOR(F.shiftleft(x, block)).bitwiseAND(F.lit(_mask(block)))
    return x


def morton(row: Column, col: Column) -> Column:
    """The key of a cell with row and column from 0 to 2^31 - 1; rows have the odd places."""
    return F.shiftleft(_spread(row), 1).bitwiseOR(_spread(col))


def number(row: int, col: int) -> int:
    """:func:`morton` of one cell."""
    return sum((row >> i & 1) << 2 * i + 1 | (col >> i & 1) << 2 * i for i in range(31))


def window_ranges(r0: int, r1: int, c0: int, c1: int, most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of keys (first, last) that together hold all cells of rows r0 .. r1 - 1 and columns c0 .. c1 - 1.

    Quadrants inside the window are ranges; those that cross its edge are split until they are a sixteenth of its shorter
    side, and then count whole. At most ``most`` ranges are left.
    """
    r0, c0 = max(r0, 0), max(c0, 0)
    if r1 <= r0 or c1 <= c0:
        return []
    side = 1
    while side < max(r1, c1):
        side *= 2
    fine, todo, found = max(1, min(r1 - r0, c1 - c0) // 16), [(0, 0, side)], []
    while todo:
        r, c, n = todo.pop()
        if r >= r1 or c >= c1 or r + n <= r0 or c + n <= c0:
            continue
        if n <= fine or (r >= r0 and c >= c0 and r + n <= r1 and c + n <= c1):
            first = number(r, c)
            found.append((first, first + n * n - 1))
        else:
            todo += [(r + i, c + j, n // 2) for i in (0, n // 2) for j in (0, n // 2)]
    found.sort()
    gaps = sorted((b[0] - a[1] - 1 for a, b in zip(found, found[1:], strict=False)), reverse=True)
    least = max(1, gaps[most - 1] + 1) if len(gaps) >= most else 1  # smaller gaps are merged
    out = [found[0]]
    for a, b in found[1:]:
        if a - out[-1][1] - 1 < least:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def inside(r0: int, r1: int, c0: int, c1: int, key: str = ZKEY) -> Column:
    """Whether a cell's key lies in the window's ranges."""
    out = F.lit(False)
    for a, b in window_ranges(r0, r1, c0, c1):
        out = out | ((F.col(key) >= a) & (F.col(key) <= b))
    return out
