"""Lengths of names that may be partners, and bands of lengths."""

from __future__ import annotations

import math

HAIR = 1e-9  # bounds are a hair wider, so that rounding loses nothing


def reach(length: int, cut: float) -> tuple[int, int]:
    """Shortest and longest partner of a name of ``length`` at the cut."""
    wide = (2 - cut) / cut
    return max(1, math.ceil(length / wide - HAIR)), math.floor(length * wide + HAIR)


def band(length: int) -> int:
    """Length bands a quarter apart: 96 of them cover every possible text."""
    return int(math.log(length) / math.log(1.25) + HAIR)


def first_of(band_: int) -> int:
    """The shortest length of a band."""
    length = max(1, math.ceil(1.25**band_ - 1))
    while band(length) < band_:
        length += 1
    return length
