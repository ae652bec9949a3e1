"""The projections of ``functions.projections`` on numpy arrays, for the kernels that work on whole tiles.

Systems with an ellipsoid take the forms of ``functions.ellipsoid`` where there are any.

Written apart from the SQL forms, which state the same in another way: the tests and the queries'
SQL hold one against the other.  Points outside a projection's domain are NaN.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from . import ellipsoid
from .projections import Srs, parse

Arrays = tuple[np.ndarray, np.ndarray]
HALF_PI = math.pi / 2


def _asin(x: np.ndarray) -> np.ndarray:
    """Rounding may exceed 1 by a little; anything more is outside."""
    return np.arcsin(np.where(np.abs(x) <= 1 + 1e-10, np.clip(x, -1, 1), np.nan))


def wrap(lam: np.ndarray) -> np.ndarray:
    """Longitudes beyond half a turn, brought back."""
    return np.where(np.abs(lam) > math.pi + 1e-9, lam - 2 * math.pi * np.floor((lam + math.pi) / (2 * math.pi)), lam)


def _newton(f: Callable, slope: Callable, t: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """The auxiliary angle of a pseudocylindrical projection; at the poles it is the latitude."""
    for _ in range(30):
        with np.errstate(all="ignore"):
            t = t - f(t) / slope(t)
    return np.where(np.abs(phi) > 1.57079, phi, t)


def _cos_ts(s: Srs) -> float:
    return math.cos(math.radians(s.lat_ts))


def _sinu(s: Srs, lam, phi) -> Arrays:
    return lam * np.cos(phi), phi


def _sinu_inverse(s: Srs, x, y) -> Arrays:
    c = np.cos(y)
    return np.where(c == 0, np.nan, x / np.where(c == 0, 1, c)), y


def _cea(s: Srs, lam, phi) -> Arrays:
    return lam * _cos_ts(s), np.sin(phi) / _cos_ts(s)


def _cea_inverse(s: Srs, x, y) -> Arrays:
    return x / _cos_ts(s), _asin(y * _cos_ts(s))


def _merc(s: Srs, lam, phi) -> Arrays:
    near_pole = np.abs(phi) >= 1.5707
    return lam * _cos_ts(s), np.where(near_pole, np.nan, np.arctanh(np.sin(np.where(near_pole, 0, phi)))) * _cos_ts(s)


def _merc_inverse(s: Srs, x, y) -> Arrays:
    return x / _cos_ts(s), np.arctan(np.sinh(y / _cos_ts(s)))


def _mill(s: Srs, lam, phi) -> Arrays:
    return lam, 1.25 * np.arctanh(np.sin(0.8 * phi))


def _mill_inverse(s: Srs, x, y) -> Arrays:
    return x, 1.25 * np.arctan(np.sinh(0.8 * y))


def _gall(s: Srs, lam, phi) -> Arrays:
    return lam * math.sqrt(0.5), (1 + math.sqrt(0.5)) * np.tan(phi / 2)


def _gall_inverse(s: Srs, x, y) -> Arrays:
    return x * math.sqrt(2), 2 * np.arctan(y / (1 + math.sqrt(0.5)))


def _moll(s: Srs, lam, phi) -> Arrays:
    t = _newton(lambda t: 2 * t + np.sin(2 * t) - math.pi * np.sin(phi), lambda t: 2 + 2 * np.cos(2 * t), 0.9 * phi, phi)
    return 2 * math.sqrt(2) / math.pi * lam * np.cos(t), math.sqrt(2) * np.sin(t)


def _moll_inverse(s: Srs, x, y) -> Arrays:
    t = _asin(y / math.sqrt(2))
    c = np.cos(t)
    return math.pi * x / (2 * math.sqrt(2) * np.where(c == 0, np.nan, c)), _asin((2 * t + np.sin(2 * t)) / math.pi)


def _eck4(s: Srs, lam, phi) -> Arrays:
    t = _newton(lambda t: t + np.sin(t) * np.cos(t) + 2 * np.sin(t) - (2 + HALF_PI) * np.sin(phi), lambda t: 2 * np.cos(t) * (1 + np.cos(t)), phi / 2, phi)
    return 2 / math.sqrt(math.pi * (4 + math.pi)) * lam * (1 + np.cos(t)), 2 * math.sqrt(math.pi / (4 + math.pi)) * np.sin(t)


def _eck4_inverse(s: Srs, x, y) -> Arrays:
    t = _asin(y * math.sqrt((4 + math.pi) / math.pi) / 2)
    return x * math.sqrt(math.pi * (4 + math.pi)) / (2 * (1 + np.cos(t))), _asin((t + np.sin(t) * np.cos(t) + 2 * np.sin(t)) / (2 + HALF_PI))


def _eck6(s: Srs, lam, phi) -> Arrays:
    t = _newton(lambda t: t + np.sin(t) - (1 + HALF_PI) * np.sin(phi), lambda t: 1 + np.cos(t), 0.9 * phi, phi)
    return lam * (1 + np.cos(t)) / math.sqrt(2 + math.pi), 2 * t / math.sqrt(2 + math.pi)


def _eck6_inverse(s: Srs, x, y) -> Arrays:
    t = math.sqrt(2 + math.pi) * y / 2
    c = 1 + np.cos(t)
    return math.sqrt(2 + math.pi) * x / np.where(c == 0, np.nan, c), _asin((t + np.sin(t)) / (1 + HALF_PI))


def _polar(s: Srs, lam, phi) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unit vector of a point, turned so that the centre of the map is (1, 0, 0)."""
    p = math.radians(s.lat_0)
    a, b, c = np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)
    return math.cos(p) * a + math.sin(p) * c, b, math.cos(p) * c - math.sin(p) * a


def _from_polar(s: Srs, a, b, c) -> Arrays:
    p = math.radians(s.lat_0)
    return np.arctan2(b, math.cos(p) * a - math.sin(p) * c), _asin(math.sin(p) * a + math.cos(p) * c)


def _gnom(s: Srs, lam, phi) -> Arrays:
    a, b, c = _polar(s, lam, phi)
    a = np.where(a > 1e-9, a, np.nan)
    return b / a, c / a


def _gnom_inverse(s: Srs, x, y) -> Arrays:
    d = np.sqrt(1 + x * x + y * y)
    return _from_polar(s, 1 / d, x / d, y / d)


def _laea(s: Srs, lam, phi) -> Arrays:
    a, b, c = _polar(s, lam, phi)
    k = np.sqrt(2 / np.where(1 + a > 1e-9, 1 + a, np.nan))
    return k * b, k * c


def _laea_inverse(s: Srs, x, y) -> Arrays:
    q = (x * x + y * y) / 4
    k = np.sqrt(np.where(q <= 1, 1 - q, np.nan))
    return _from_polar(s, 1 - 2 * q, x * k, y * k)


def _cone(s: Srs) -> tuple[float, float, float]:
    one, two = math.sin(math.radians(s.lat_1)), math.sin(math.radians(s.lat_2))
    n = (one + two) / 2
    c = 1 + one * two
    return n, c, math.sqrt(c - 2 * n * math.sin(math.radians(s.lat_0))) / n


def _aea(s: Srs, lam, phi) -> Arrays:
    n, c, rho0 = _cone(s)
    rho = np.sqrt(np.maximum(0, c - 2 * n * np.sin(phi))) / n
    return rho * np.sin(n * lam), rho0 - rho * np.cos(n * lam)


def _aea_inverse(s: Srs, x, y) -> Arrays:
    n, c, rho0 = _cone(s)
    d, sign = rho0 - y, math.copysign(1, n)
    return np.arctan2(sign * x, sign * d) / n, _asin((c - n * n * (x * x + d * d)) / (2 * n))


def _vandg(s: Srs, lam, phi) -> Arrays:
    with np.errstate(all="ignore"):
        t = _asin(np.abs(phi) / HALF_PI)
        a = np.abs(math.pi / lam - lam / math.pi) / 2
        g = np.cos(t) / (np.sin(t) + np.cos(t) - 1)
        p = g * (2 / np.sin(t) - 1)
        q, pa = a * a + g, p * p + a * a
        x = np.sign(lam) * math.pi * (a * (g - p * p) + np.sqrt(np.maximum(0, (a * (g - p * p)) ** 2 - pa * (g * g - p * p)))) / pa
        y = np.sign(phi) * math.pi * (p * q - a * np.sqrt(np.maximum(0, (a * a + 1) * pa - q * q))) / pa
    middle = (lam == 0) | (np.abs(phi) > 1.5707963)
    flat = np.sign(phi) * math.pi * np.tan(t / 2)
    return np.where(phi == 0, lam, np.where(middle, 0, x)), np.where(phi == 0, 0, np.where(middle, flat, y))


def _vandg_inverse(s: Srs, x, y) -> Arrays:
    u, v = x / math.pi, y / math.pi
    d = u * u + v * v
    c1 = -np.abs(v) * (1 + d)
    c2 = c1 - 2 * v * v + u * u
    c3 = -2 * c1 + 1 + 2 * v * v + d * d
    w = v * v / c3 + (2 * (c2 / c3) ** 3 - 9 * c1 * c2 / (c3 * c3)) / 27
    a1 = (c1 - c2 * c2 / (3 * c3)) / c3
    m1 = 2 * np.sqrt(np.maximum(0, -a1 / 3))
    with np.errstate(all="ignore"):
        theta = np.arccos(np.clip(3 * w / (a1 * m1), -1, 1)) / 3
        lam = np.where(u == 0, 0, math.pi * (d - 1 + np.sqrt(1 + 2 * (u * u - v * v) + d * d)) / (2 * u))
    return lam, np.where(v == 0, 0, np.sign(v) * math.pi * (-m1 * np.cos(theta + math.pi / 3) - c2 / (3 * c3)))


FORWARD = {"sinu": _sinu, "cea": _cea, "merc": _merc, "mill": _mill, "gall": _gall, "moll": _moll, "eck4": _eck4, "eck6": _eck6, "gnom": _gnom, "laea": _laea, "aea": _aea, "vandg": _vandg}
INVERSE = {"sinu": _sinu_inverse, "cea": _cea_inverse, "merc": _merc_inverse, "mill": _mill_inverse, "gall": _gall_inverse, "moll": _moll_inverse, "eck4": _eck4_inverse, "eck6": _eck6_inverse, "gnom": _gnom_inverse, "laea": _laea_inverse, "aea": _aea_inverse, "vandg": _vandg_inverse}


def forward(srs: str | Srs, lam: np.ndarray, phi: np.ndarray) -> Arrays:
    """(x, y) of longitudes and latitudes in radians."""
    s = srs if isinstance(srs, Srs) else parse(srs)
    if s.proj == "longlat":
        return np.degrees(lam), np.degrees(phi)
    x, y = (ellipsoid.FORWARD if s.es else FORWARD)[s.proj](s, wrap(lam - math.radians(s.lon_0)) if s.lon_0 else lam, phi)
    return x * s.radius + s.x_0, y * s.radius + s.y_0


def inverse(srs: str | Srs, x: np.ndarray, y: np.ndarray) -> Arrays:
    """(longitude, latitude) of points, in radians."""
    s = srs if isinstance(srs, Srs) else parse(srs)
    if s.proj == "longlat":
        return np.radians(x), np.radians(y)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        lam, phi = (ellipsoid.INVERSE if s.es else INVERSE)[s.proj](s, (x - s.x_0) / s.radius, (y - s.y_0) / s.radius)
    return wrap(lam + math.radians(s.lon_0)) if s.lon_0 else lam, phi
