"""Kernels of the weighted resamplers, as SQL expressions of a DOUBLE."""

from __future__ import annotations

import math

PI = f"{math.pi!r}e0"


def bilinear(x: str) -> str:
    return f"greatest(0e0, 1e0 - abs({x}))"


def bicubic(x: str) -> str:
    """The cubic convolution kernel with a = -0.5."""
    a = f"abs({x})"
    inner = f"((1.5e0*{a} - 2.5e0)*{a}*{a} + 1e0)"
    outer = f"(((({a} - 5e0)*{a} + 8e0)*{a} - 4e0)*-0.5e0)"
    return f"CASE WHEN {a} < 1e0 THEN {inner} WHEN {a} < 2e0 THEN {outer} ELSE 0e0 END"


def sinc(x: str) -> str:
    return f"CASE WHEN {x} = 0e0 THEN 1e0 ELSE sin({PI}*{x})/nullif({PI}*{x}, 0e0) END"


def lanczos(x: str) -> str:
    return f"CASE WHEN abs({x}) <= 3e0 THEN ({sinc(x)})*({sinc(f'({x}/3e0)')}) ELSE 0e0 END"


KERNELS = {"bilinear": bilinear, "bicubic": bicubic, "lanczos": lanczos}
