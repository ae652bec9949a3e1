"""Map projections of the sphere (Snyder, *Map Projections: A Working Manual*) as SQL expressions.

An expression is text that Spark and any SQL engine with the usual functions reads alike; points
outside a projection's domain give NULL.  Longitudes and latitudes are radians.  Only spherical
forms have expressions: ``forward`` and ``inverse`` raise ``EllipsoidNotSupported`` where the ellipsoid
matters.  ``functions.sphere`` takes both.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from ..model import EllipsoidNotSupported, ProjectionError

#: Radius of the sphere, in metres.
RADIUS = 6370997.0
PI = repr(math.pi)


@dataclass(frozen=True)
class Srs:
    proj: str
    radius: float = RADIUS
    lon_0: float = 0.0
    lat_0: float = 0.0
    lat_1: float = 29.5
    lat_2: float = 45.5
    lat_ts: float = 0.0
    x_0: float = 0.0
    y_0: float = 0.0
    #: Squared eccentricity; ``radius`` is the semi-major axis.  0 for a sphere, and for projections that are spherical only.
    es: float = 0.0


# EPSG codes that are read, by their proj strings.
EPSG = {
    "EPSG:4326": "+proj=longlat +ellps=WGS84", "EPSG:4269": "+proj=longlat +ellps=GRS80", "EPSG:4258": "+proj=longlat +ellps=GRS80", "EPSG:3857": "+proj=merc +R=6378137", "EPSG:3395": "+proj=merc +ellps=WGS84",
    "EPSG:6933": "+proj=cea +lat_ts=30 +ellps=WGS84", "EPSG:3035": "+proj=laea +lat_0=52 +lon_0=10 +x_0=4321000 +y_0=3210000 +ellps=GRS80", "EPSG:5070": "+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96 +ellps=GRS80",
    "EPSG:2163": "+proj=laea +lat_0=45 +lon_0=-100 +R=6370997", "EPSG:3408": "+proj=laea +lat_0=90 +R=6371228", "EPSG:6931": "+proj=laea +lat_0=90 +ellps=WGS84",
}
# Semi-major axis and inverse flattening (0: a sphere) of ellipsoids, and ellipsoids of datums that differ by no shift.
ELLIPSOIDS = {"WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101), "clrk66": (6378206.4, 294.9786982139), "intl": (6378388.0, 297.0), "bessel": (6377397.155, 299.1528128), "krass": (6378245.0, 298.3), "sphere": (RADIUS, 0.0)}
DATUMS = {"WGS84": "WGS84", "NAD83": "GRS80"}
#: Projections with an ellipsoidal form; others take the semi-major axis as the radius of a sphere, as proj does.
ELLIPSOIDAL = ("merc", "cea", "sinu", "aea", "laea")


#: Parameters that are read, and those that say nothing here.
KNOWN = ("proj", "lon_0", "lat_0", "lat_1", "lat_2", "lat_ts", "x_0", "y_0", "R", "a", "b", "ellps", "units", "to_meter", "pm", "datum", "rf", "f", "es", "towgs84", "k", "k_0")
IGNORED = ("no_defs", "type", "wktext", "over", "nadgrids")


def parse(text: str) -> Srs:
    """A proj4 string ("+proj=sinu +lon_0=10"), a bare projection name, a code of ``EPSG`` or well-known text.

    A bare "aea" has the parallels 29.5 and 45.5; without an ellipsoid or radius the sphere is meant.  Units other than
    metres, a prime meridian other than Greenwich's, a scale factor and unknown parameters raise an error, a datum
    that takes a shift ``EllipsoidNotSupported``.  Latitudes are kept as they are between ellipsoids.
    """
    if "[" in text:
        from .systems import from_wkt

        text = from_wkt(text)
    if text.strip().upper().startswith("EPSG:") and text.strip().upper() not in EPSG:
        raise ProjectionError(f"{text} is not known")
    text = EPSG.get(text.strip().upper(), text.strip())
    bare = not text.startswith("+")
    words = dict(w.lstrip("+").partition("=")[::2] for w in (f"+proj={text}" if bare else text).split() if w.startswith("+"))
    name = {"latlong": "longlat", "lonlat": "longlat"}.get(words.get("proj", ""), words.get("proj", ""))
    if name not in FORWARD:
        raise ProjectionError(f"projection {name!r} is not known")
    if unknown := set(words) - {*KNOWN, *IGNORED}:
        raise ProjectionError(f"{text}: unknown parameters {sorted(unknown)}")
    if words.get("units", "m") != "m" or float(words.get("to_meter") or 1) != 1 or words.get("pm", "0") not in ("0", "greenwich"):
        raise ProjectionError(f"{text}: units must be metres and longitudes count from Greenwich")
    if any(float(words.get(k) or 1) != 1 for k in ("k", "k_0")):
        raise ProjectionError(f"{text}: a scale factor is not read")
    if name == "aea" and not bare and not {"lat_1", "lat_2"} <= set(words):
        raise ProjectionError(f"{text}: the conic needs its parallels lat_1 and lat_2")
    if "datum" in words and words["datum"] not in DATUMS or any(float(x) for x in words.get("towgs84", "0").split(",")):
        raise EllipsoidNotSupported(f"{text}: shifts of a datum are not read")
    radius, es = _ellipsoid(text, words)
    number = {k: float(words[k]) for k in ("lon_0", "lat_0", "lat_1", "lat_2", "lat_ts", "x_0", "y_0") if words.get(k)}
    return Srs(name, radius, **number, es=es if name in (*ELLIPSOIDAL, "longlat") else 0.0)


def _ellipsoid(text: str, words: dict[str, str]) -> tuple[float, float]:
    """Semi-major axis and squared eccentricity; R makes a sphere of any."""
    if words.get("R"):
        return float(words["R"]), 0.0
    name = words.get("ellps") or DATUMS.get(words.get("datum", ""))
    if name and name not in ELLIPSOIDS:
        raise EllipsoidNotSupported(f"{text}: ellipsoid {name} is not known")
    a, rf = ELLIPSOIDS[name or "sphere"]
    if words.get("a"):
        a, rf = float(words["a"]), rf if name else 0.0
    f = 1 / rf if rf else 0.0
    if words.get("rf"):
        f = 1 / float(words["rf"])
    elif words.get("f"):
        f = float(words["f"])
    elif words.get("es"):
        return a, float(words["es"])
    elif words.get("b"):
        f = 1 - float(words["b"]) / a
    if not 0 <= f < 1:
        raise EllipsoidNotSupported(f"{text}: no flattened ellipsoid")
    return a, f * (2 - f)


def _wrapped(lam: str) -> str:
    """Longitudes beyond half a turn, brought back."""
    return f"(CASE WHEN abs({lam}) > {lit(math.pi + 1e-9)} THEN {lam} - {lit(2 * math.pi)}*floor(({lam} + {PI}e0)/{lit(2 * math.pi)}) ELSE {lam} END)"


def lit(x: float) -> str:
    """A DOUBLE literal; a plain decimal would be DECIMAL."""
    return f"({float(x)!r}e0)" if "e" not in repr(float(x)) else f"({float(x)!r})"


def _asin(x: str) -> str:
    """Rounding may exceed 1 by a little; anything more is outside."""
    return f"asin(CASE WHEN abs({x}) <= 1e0 THEN {x} WHEN abs({x}) <= 1.0000000001e0 THEN sign({x}) END)"


def _cone(s: Srs) -> tuple[float, float, float]:
    p1, p2, p0 = (math.radians(x) for x in (s.lat_1, s.lat_2, s.lat_0))
    n = (math.sin(p1) + math.sin(p2)) / 2
    c = math.cos(p1) ** 2 + 2 * n * math.sin(p1)
    return n, c, s.radius * math.sqrt(c - 2 * n * math.sin(p0)) / n


def _cos_c(s: Srs, lam: str, phi: str) -> str:
    p = math.radians(s.lat_0)
    return f"({lit(math.sin(p))}*sin({phi}) + {lit(math.cos(p))}*cos({phi})*cos({lam}))"


def _azimuthal(s: Srs, k: str, lam: str, phi: str) -> tuple[str, str]:
    p, r = math.radians(s.lat_0), lit(s.radius)
    return f"{r}*{k}*cos({phi})*sin({lam})", f"{r}*{k}*({lit(math.cos(p))}*sin({phi}) - {lit(math.sin(p))}*cos({phi})*cos({lam}))"


def _azimuthal_inverse(s: Srs, c: str, x: str, y: str) -> tuple[str, str]:
    p = math.radians(s.lat_0)
    sp, cp, rho = lit(math.sin(p)), lit(math.cos(p)), f"sqrt({x}*{x} + {y}*{y})"
    phi = f"CASE WHEN {rho} = 0e0 THEN {lit(p)} ELSE {_asin(f'(cos({c})*{sp} + {y}*sin({c})*{cp}/nullif({rho}, 0e0))')} END"
    return f"atan2({x}*sin({c}), {rho}*{cp}*cos({c}) - {y}*{sp}*sin({c}))", phi


def _vandg(s: Srs, lam: str, phi: str) -> tuple[str, str]:
    r = lit(s.radius)
    t = f"{_asin(f'abs(2e0*{phi}/{PI}e0)')}"
    a = f"(0.5e0*abs({PI}e0/nullif({lam}, 0e0) - {lam}/{PI}e0))"
    g = f"(cos({t})/nullif(sin({t}) + cos({t}) - 1e0, 0e0))"
    p = f"({g}*(2e0/nullif(sin({t}), 0e0) - 1e0))"
    q = f"({a}*{a} + {g})"
    inner = f"greatest(0e0, {a}*{a}*({g} - {p}*{p})*({g} - {p}*{p}) - ({p}*{p} + {a}*{a})*({g}*{g} - {p}*{p}))"
    x = f"sign({lam})*{PI}e0*{r}*({a}*({g} - {p}*{p}) + sqrt({inner}))/({p}*{p} + {a}*{a})"
    root = f"greatest(0e0, ({a}*{a} + 1e0)*({p}*{p} + {a}*{a}) - {q}*{q})"
    y = f"sign({phi})*{PI}e0*{r}*({p}*{q} - {a}*sqrt({root}))/({p}*{p} + {a}*{a})"
    flat = f"{PI}e0*{r}*tan({t}/2e0)"
    return (
        f"CASE WHEN {phi} = 0e0 THEN {r}*{lam} WHEN {lam} = 0e0 OR abs({phi}) > 1.5707963e0 THEN 0e0 ELSE {x} END",
        f"CASE WHEN {phi} = 0e0 THEN 0e0 WHEN {lam} = 0e0 OR abs({phi}) > 1.5707963e0 THEN sign({phi})*{flat} ELSE {y} END",
    )


def _vandg_inverse(s: Srs, x: str, y: str) -> tuple[str, str]:
    u, v = f"({x}/{lit(math.pi * s.radius)})", f"({y}/{lit(math.pi * s.radius)})"
    d = f"({u}*{u} + {v}*{v})"
    c1 = f"(-abs({v})*(1e0 + {d}))"
    c2 = f"({c1} - 2e0*{v}*{v} + {u}*{u})"
    c3 = f"(-2e0*{c1} + 1e0 + 2e0*{v}*{v} + {d}*{d})"
    w = f"({v}*{v}/{c3} + (2e0*{c2}*{c2}*{c2}/({c3}*{c3}*{c3}) - 9e0*{c1}*{c2}/({c3}*{c3}))/27e0)"
    a1 = f"(({c1} - {c2}*{c2}/(3e0*{c3}))/{c3})"
    m1 = f"(2e0*sqrt(greatest(0e0, -{a1}/3e0)))"
    ratio = f"(3e0*{w}/nullif({a1}*{m1}, 0e0))"
    theta = f"(acos(greatest(-1e0, least(1e0, {ratio})))/3e0)"
    phi = f"CASE WHEN {v} = 0e0 THEN 0e0 ELSE sign({v})*{PI}e0*(-{m1}*cos({theta} + {PI}e0/3e0) - {c2}/(3e0*{c3})) END"
    lam = f"CASE WHEN {u} = 0e0 THEN 0e0 ELSE {PI}e0*({d} - 1e0 + sqrt(1e0 + 2e0*({u}*{u} - {v}*{v}) + {d}*{d}))/(2e0*nullif({u}, 0e0)) END"
    return lam, phi


#: Newton steps for the parameter of three projections; see ``parameter``.
STEPS = {
    "moll": "(2*t + sin(2*t) - pi()*sin({p})) / (2 + 2*cos(2*t))",
    "eck4": "(t + sin(t)*cos(t) + 2*sin(t) - (2 + pi()/2)*sin({p})) / (2*cos(t)*(1 + cos(t)))",
    "eck6": "(t + sin(t) - (1 + pi()/2)*sin({p})) / (1 + cos(t))",
}


def parameter(proj: str, phi: str) -> str:
    """The auxiliary angle of a pseudocylindrical projection: Newton's rounds as a fold (Spark SQL)."""
    step = STEPS[proj].replace("{p}", f"({phi})")
    start = f"{phi}/2" if proj == "eck4" else f"{phi}*0.9e0"
    fold = f"aggregate(sequence(1, 30), CAST({start} AS DOUBLE), (t, i) -> t - {step})"
    return f"CASE WHEN abs({phi}) > 1.57079e0 THEN {phi} ELSE {fold} END"


def _cyl(fx: str, fy: str):
    return lambda s, lam, phi: (fx.format(r=lit(s.radius), lam=lam, phi=phi, ts=lit(math.cos(math.radians(s.lat_ts)))), fy.format(r=lit(s.radius), lam=lam, phi=phi, ts=lit(math.cos(math.radians(s.lat_ts)))))


def _inv(fn):
    return lambda s, x, y: fn(lit(s.radius), lit(math.cos(math.radians(s.lat_ts))), x, y)


def _aea(s: Srs, lam: str, phi: str) -> tuple[str, str]:
    n, c, rho0 = _cone(s)
    rho = f"({lit(s.radius / n)}*sqrt(greatest(0e0, {lit(c)} - {lit(2 * n)}*sin({phi}))))"
    return f"{rho}*sin({lit(n)}*{lam})", f"{lit(rho0)} - {rho}*cos({lit(n)}*{lam})"


def _aea_inverse(s: Srs, x: str, y: str) -> tuple[str, str]:
    n, c, rho0 = _cone(s)
    d = f"({lit(rho0)} - {y})"
    sine = f"(({lit(c)} - ({x}*{x} + {d}*{d})*{lit((n / s.radius) ** 2)})/{lit(2 * n)})"
    return f"atan2({lit(math.copysign(1, n))}*{x}, {lit(math.copysign(1, n))}*{d})/{lit(n)}", _asin(sine)


def _gnom(s: Srs, lam: str, phi: str) -> tuple[str, str]:
    c = _cos_c(s, lam, phi)
    return _azimuthal(s, f"(1e0/CASE WHEN {c} > 1e-9 THEN {c} END)", lam, phi)


def _laea(s: Srs, lam: str, phi: str) -> tuple[str, str]:
    c = _cos_c(s, lam, phi)
    return _azimuthal(s, f"sqrt(2e0/CASE WHEN 1e0 + {c} > 1e-9 THEN 1e0 + {c} END)", lam, phi)


FORWARD = {
    "longlat": lambda s, lam, phi: (f"({lam}*180e0/{PI}e0)", f"({phi}*180e0/{PI}e0)"),
    "sinu": _cyl("{r}*{lam}*cos({phi})", "{r}*{phi}"),
    "cea": _cyl("{r}*{lam}*{ts}", "{r}*sin({phi})/{ts}"),
    "merc": _cyl("{r}*{lam}*{ts}", "{r}*{ts}*ln(CASE WHEN abs({phi}) < 1.5707e0 THEN tan(" + PI + "e0/4e0 + {phi}/2e0) END)"),
    "mill": _cyl("{r}*{lam}", "1.25e0*{r}*ln(tan(" + PI + "e0/4e0 + 0.4e0*{phi}))"),
    "gall": _cyl("{r}*{lam}/sqrt(2e0)", "{r}*(1e0 + sqrt(2e0)/2e0)*tan({phi}/2e0)"),
    "aea": _aea,
    "gnom": _gnom,
    "laea": _laea,
    "vandg": _vandg,
    "moll": lambda s, lam, phi: (f"{lit(s.radius * 2 * math.sqrt(2) / math.pi)}*{lam}*cos({parameter('moll', phi)})", f"{lit(s.radius * math.sqrt(2))}*sin({parameter('moll', phi)})"),
    "eck4": lambda s, lam, phi: (f"{lit(2 * s.radius / math.sqrt(math.pi * (4 + math.pi)))}*{lam}*(1e0 + cos({parameter('eck4', phi)}))", f"{lit(2 * s.radius * math.sqrt(math.pi / (4 + math.pi)))}*sin({parameter('eck4', phi)})"),
    "eck6": lambda s, lam, phi: (f"{lit(s.radius / math.sqrt(2 + math.pi))}*{lam}*(1e0 + cos({parameter('eck6', phi)}))", f"{lit(2 * s.radius / math.sqrt(2 + math.pi))}*{parameter('eck6', phi)}"),
}


def _moll_inverse(s: Srs, x: str, y: str) -> tuple[str, str]:
    t = _asin(f"({y}/{lit(math.sqrt(2) * s.radius)})")
    return f"({x}*{lit(math.pi / (2 * math.sqrt(2) * s.radius))}/nullif(cos({t}), 0e0))", _asin(f"((2e0*{t} + sin(2e0*{t}))/{PI}e0)")


def _eck4_inverse(s: Srs, x: str, y: str) -> tuple[str, str]:
    t = _asin(f"({y}*{lit(math.sqrt((4 + math.pi) / math.pi) / (2 * s.radius))})")
    return f"({x}*{lit(math.sqrt(math.pi * (4 + math.pi)) / (2 * s.radius))}/(1e0 + cos({t})))", _asin(f"(({t} + sin({t})*cos({t}) + 2e0*sin({t}))/{lit(2 + math.pi / 2)})")


def _eck6_inverse(s: Srs, x: str, y: str) -> tuple[str, str]:
    t = f"({y}*{lit(math.sqrt(2 + math.pi) / (2 * s.radius))})"
    return f"({x}*{lit(math.sqrt(2 + math.pi) / s.radius)}/nullif(1e0 + cos({t}), 0e0))", _asin(f"(({t} + sin({t}))/{lit(1 + math.pi / 2)})")


INVERSE = {
    "longlat": lambda s, x, y: (f"({x}*{PI}e0/180e0)", f"({y}*{PI}e0/180e0)"),
    "sinu": _inv(lambda r, ts, x, y: (f"({x}/nullif({r}*cos({y}/{r}), 0e0))", f"({y}/{r})")),
    "cea": _inv(lambda r, ts, x, y: (f"({x}/({r}*{ts}))", _asin(f"({y}*{ts}/{r})"))),
    "merc": _inv(lambda r, ts, x, y: (f"({x}/({r}*{ts}))", f"(2e0*atan(exp({y}/({r}*{ts}))) - {PI}e0/2e0)")),
    "mill": _inv(lambda r, ts, x, y: (f"({x}/{r})", f"(2.5e0*(atan(exp(0.8e0*{y}/{r})) - {PI}e0/4e0))")),
    "gall": _inv(lambda r, ts, x, y: (f"(sqrt(2e0)*{x}/{r})", f"(2e0*atan({y}/({r}*(1e0 + sqrt(2e0)/2e0))))")),
    "aea": _aea_inverse,
    "gnom": lambda s, x, y: _azimuthal_inverse(s, f"atan(sqrt({x}*{x} + {y}*{y})/{lit(s.radius)})", x, y),
    "laea": lambda s, x, y: _azimuthal_inverse(s, f"(2e0*{_asin(f'(sqrt({x}*{x} + {y}*{y})/{lit(2 * s.radius)})')})", x, y),
    "vandg": _vandg_inverse,
    "moll": _moll_inverse,
    "eck4": _eck4_inverse,
    "eck6": _eck6_inverse,
}


def _spherical(srs: str | Srs) -> Srs:
    s = srs if isinstance(srs, Srs) else parse(srs)
    if s.es and s.proj in ELLIPSOIDAL:
        raise EllipsoidNotSupported(f"{srs}: the expressions are of the sphere")
    return s


def forward(srs: str | Srs, lam: str, phi: str) -> tuple[str, str]:
    """(x, y) of longitude and latitude."""
    s = _spherical(srs)
    if s.proj == "longlat":
        return FORWARD["longlat"](s, lam, phi)
    x, y = FORWARD[s.proj](s, _wrapped(f"({lam} - {lit(math.radians(s.lon_0))})") if s.lon_0 else lam, phi)
    return (f"({x} + {lit(s.x_0)})" if s.x_0 else f"({x})"), (f"({y} + {lit(s.y_0)})" if s.y_0 else f"({y})")


def inverse(srs: str | Srs, x: str, y: str) -> tuple[str, str]:
    """(longitude, latitude) of a point; with a central meridian, longitudes are wrapped."""
    s = _spherical(srs)
    lam, phi = INVERSE[s.proj](s, f"({x} - {lit(s.x_0)})" if s.x_0 else x, f"({y} - {lit(s.y_0)})" if s.y_0 else y)
    if s.lon_0 and s.proj != "longlat":
        lam = _wrapped(f"({lam} + {lit(math.radians(s.lon_0))})")
    return f"({lam})", f"({phi})"
