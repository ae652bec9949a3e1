"""Reference systems in other notations: well-known text, and the geographic keys of TIFF files.

Both are read into the proj strings that ``projections.parse`` takes, with the ellipsoid stated, so that all
notations of a system give the same grid; keys are also written.  What has no counterpart here raises.
"""

from __future__ import annotations

import math
import re

from ..model import ProjectionError

Node = tuple[str, list]  # a keyword and its arguments: text, numbers and nodes
TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|([A-Za-z_][A-Za-z_0-9]*)|([\[\]\(\),]))')

# Names of projections and parameters in well-known text, lower case, by proj's.
METHODS = {
    "albers_conic_equal_area": "aea", "albers": "aea", "cylindrical_equal_area": "cea", "eckert_iv": "eck4", "eckert_vi": "eck6", "gall_stereographic": "gall", "gnomonic": "gnom",
    "lambert_azimuthal_equal_area": "laea", "mercator_1sp": "merc", "mercator_2sp": "merc", "mercator": "merc", "mercator_auxiliary_sphere": "merc", "miller_cylindrical": "mill", "mollweide": "moll", "sinusoidal": "sinu", "vandergrinten": "vandg", "van_der_grinten_i": "vandg",
}
PARAMETERS = {
    "central_meridian": "lon_0", "longitude_of_center": "lon_0", "longitude_of_origin": "lon_0", "latitude_of_origin": "lat_0", "latitude_of_center": "lat_0", "standard_parallel_1": "lat_1", "standard_parallel_2": "lat_2",
    "false_easting": "x_0", "false_northing": "y_0", "scale_factor": "k_0", "auxiliary_sphere_type": "sphere",
}
# Keys, codes of projections, and keys of parameters of the file form.
MODEL, RASTER, CITATION, GEOGRAPHIC, GEO_CITATION, DATUM, MERIDIAN, ANGULAR, ELLIPSOID, MAJOR, MINOR, FLATTENING = 1024, 1025, 1026, 2048, 2049, 2050, 2051, 2054, 2056, 2057, 2058, 2059
PROJECTED, PROJECTED_CITATION, PROJECTION, METHOD, LINEAR = 3072, 3073, 3074, 3075, 3076
CODES = {7: "merc", 10: "laea", 11: "aea", 19: "gnom", 20: "mill", 24: "sinu", 25: "vandg", 28: "cea"}
KEY_PARAMETERS = {3078: "lat_1", 3079: "lat_2", 3080: "lon_0", 3081: "lat_0", 3082: "x_0", 3083: "y_0", 3084: "lon_0", 3085: "lat_0", 3086: "x_0", 3087: "y_0", 3088: "lon_0", 3089: "lat_0", 3092: "k_0"}
OWN = 32767  # "user-defined"
DEGREE, METRE, AREA_CELLS, POINT_CELLS = 9102, 9001, 1, 2
DOUBLES, TEXT = 34736, 34737


def read_wkt(text: str) -> Node:
    """The tree of a well-known text."""
    at, stack, root = 0, [], None
    while at < len(text.rstrip()):
        m = TOKEN.match(text, at)
        if not m:
            raise ProjectionError(f"well-known text: {text[at : at + 20]!r} is not understood")
        at = m.end()
        quoted, number, word, mark = m.groups()
        if word is not None:
            node = (word.upper(), [])
            if stack:
                stack[-1][1].append(node)
            elif root is None:
                root = node
            else:
                raise ProjectionError("well-known text: more than one system")
            last = node
        elif mark in ("[", "("):
            stack.append(last)
        elif mark in ("]", ")"):
            if not stack:
                raise ProjectionError("well-known text: a bracket too many")
            stack.pop()
        elif mark is None:
            if not stack:
                raise ProjectionError("well-known text: a value stands alone")
            stack[-1][1].append(quoted if quoted is not None else float(number))
    if root is None or stack:
        raise ProjectionError("well-known text: it ends too early")
    return root


def _only(node: Node, known: tuple[str, ...]) -> dict[str, list[Node]]:
    found: dict[str, list[Node]] = {}
    for child in node[1]:
        if isinstance(child, tuple):
            if child[0] not in known:
                raise ProjectionError(f"well-known text: {child[0]} in {node[0]} is not read")
            found.setdefault(child[0], []).append(child)
    return found


def _one(parts: dict[str, list[Node]], name: str, of: str) -> Node:
    if len(parts.get(name, [])) != 1:
        raise ProjectionError(f"well-known text: {of} needs one {name}")
    return parts[name][0]


def _number(node: Node, k: int) -> float:
    values = [v for v in node[1] if not isinstance(v, tuple)]
    if len(values) <= k or not isinstance(values[k], float):
        raise ProjectionError(f"well-known text: {node[0]} needs a number")
    return values[k]


def _ellipsoid(major: float, flattening: float) -> str:
    return f"+a={major!r} +rf={flattening!r}" if flattening else f"+R={major!r}"


def _geographic(node: Node) -> str:
    parts = _only(node, ("DATUM", "PRIMEM", "UNIT", "AXIS", "AUTHORITY"))
    datum = _only(_one(parts, "DATUM", "GEOGCS"), ("SPHEROID", "ELLIPSOID", "TOWGS84", "AUTHORITY"))
    if any(v for shift in datum.get("TOWGS84", []) for v in shift[1]):
        raise ProjectionError("well-known text: shifts of a datum are not read")
    ball = _one(datum, "SPHEROID" if "SPHEROID" in datum else "ELLIPSOID", "DATUM")
    _only(ball, ("AUTHORITY",))
    if "PRIMEM" in parts and _number(parts["PRIMEM"][0], 1) != 0:
        raise ProjectionError("well-known text: longitudes must count from Greenwich")
    if "UNIT" in parts and abs(_number(parts["UNIT"][0], 1) - math.pi / 180) > 1e-12:
        raise ProjectionError("well-known text: angles must be in degrees")
    return _ellipsoid(_number(ball, 1), _number(ball, 2))


def from_wkt(text: str) -> str:
    """The proj string of a PROJCS or GEOGCS; unknown nodes, projections, parameters and units raise."""
    root = read_wkt(text)
    if root[0] == "GEOGCS":
        return f"+proj=longlat {_geographic(root)}"
    if root[0] != "PROJCS":
        raise ProjectionError(f"well-known text: {root[0]} is not read")
    parts = _only(root, ("GEOGCS", "PROJECTION", "PARAMETER", "UNIT", "AXIS", "AUTHORITY"))
    method = str(_one(parts, "PROJECTION", "PROJCS")[1][0]).lower()
    if method not in METHODS:
        raise ProjectionError(f"well-known text: projection {method} is not known")
    if "UNIT" in parts and _number(parts["UNIT"][0], 1) != 1:
        raise ProjectionError("well-known text: lengths must be in metres")
    values = {}
    for p in parts.get("PARAMETER", []):
        name = str(p[1][0]).lower()
        if name not in PARAMETERS:
            raise ProjectionError(f"well-known text: parameter {name} is not known")
        values[PARAMETERS[name]] = _number(p, 1)
    ball = _geographic(_one(parts, "GEOGCS", "PROJCS"))
    if method == "mercator_auxiliary_sphere":
        if values.pop("sphere", 0.0) != 0:
            raise ProjectionError("well-known text: this auxiliary sphere is not read")
        ball = f"+R={ball.split()[0].partition('=')[2]}"
    return _string(METHODS[method], values, ball)


def _string(proj: str, values: dict[str, float], ball: str) -> str:
    """A proj string; what one standard parallel means depends on the projection."""
    values = dict(values)
    scale = values.pop("k_0", 1.0)
    if scale != 1:
        raise ProjectionError(f"{proj}: a scale factor of {scale} is not read")
    if proj in ("merc", "cea") and "lat_1" in values:
        values["lat_ts"] = values.pop("lat_1")
    allowed = {"lon_0", "x_0", "y_0"} | {"merc": {"lat_ts", "lat_0"}, "cea": {"lat_ts", "lat_0"}, "aea": {"lat_0", "lat_1", "lat_2"}, "laea": {"lat_0"}, "gnom": {"lat_0"}}.get(proj, set())
    if proj in ("merc", "cea") and values.pop("lat_0", 0.0) != 0:
        raise ProjectionError(f"{proj}: the origin must be on the equator")
    if other := {k for k, v in values.items() if k not in allowed and v != 0}:
        raise ProjectionError(f"{proj}: parameters {sorted(other)} are not read")
    numbers = " ".join(f"+{k}={v!r}" for k, v in sorted(values.items()) if k in allowed)
    return " ".join(x for x in (f"+proj={proj}", numbers, ball) if x)


def from_keys(directory: tuple[int, ...], doubles: tuple[float, ...] = (), text: str = "") -> str:
    """The system of a key directory: an EPSG code, or a proj string of user-defined keys; "" if it names none."""
    keys: dict[int, float | str] = {}
    for k in range(4, 4 * (directory[3] + 1) if len(directory) > 3 else 0, 4):
        key, place, count, value = directory[k : k + 4]
        if place == DOUBLES:
            keys[key] = doubles[value]
        elif place == TEXT:
            keys[key] = text[value : value + count].rstrip("|\0")
        else:
            keys[key] = value
    model = keys.get(MODEL, 0)
    if not model or model == OWN:
        return ""
    code = keys.get(PROJECTED) if model == 1 else keys.get(GEOGRAPHIC)
    if model not in (1, 2):
        raise ProjectionError(f"keys: model type {model} is not read")
    if code and code != OWN:
        return f"EPSG:{int(code)}"
    if keys.get(MERIDIAN, 8901) != 8901 or keys.get(2061, 0) != 0:
        raise ProjectionError("keys: longitudes must count from Greenwich")
    if keys.get(ANGULAR, DEGREE) != DEGREE or keys.get(LINEAR, METRE) != METRE:
        raise ProjectionError("keys: units must be metres and degrees")
    ball = _ball(keys)
    if model == 2:
        return f"+proj=longlat {ball}"
    cited = str(keys.get(CITATION, ""))
    if METHOD not in keys and cited.startswith("+proj="):
        return cited
    if keys.get(METHOD) not in CODES:
        raise ProjectionError(f"keys: projection {keys.get(METHOD)} is not known")
    known = {MODEL, RASTER, CITATION, GEOGRAPHIC, GEO_CITATION, DATUM, MERIDIAN, 2061, ANGULAR, ELLIPSOID, MAJOR, MINOR, FLATTENING, PROJECTED, PROJECTED_CITATION, PROJECTION, METHOD, LINEAR}
    if other := {k for k in keys if k not in known and k not in KEY_PARAMETERS and k >= 3074}:
        raise ProjectionError(f"keys: {sorted(other)} are not known")
    return _string(CODES[int(keys[METHOD])], {name: float(keys[k]) for k, name in KEY_PARAMETERS.items() if k in keys}, ball)


# Codes of ellipsoids and geographic systems and their axes and inverse flattenings.
ELLIPSOIDS = {7030: (6378137.0, 298.257223563), 7019: (6378137.0, 298.257222101), 7008: (6378206.4, 294.9786982139), 7022: (6378388.0, 297.0), 7004: (6377397.155, 299.1528128), 7024: (6378245.0, 298.3)}
GEOGRAPHICS = {4326: 7030, 4269: 7019, 4258: 7019}


def _ball(keys: dict) -> str:
    if MAJOR in keys:
        major = float(keys[MAJOR])
        minor = float(keys.get(MINOR, major))
        flattening = float(keys.get(FLATTENING, major / (major - minor) if minor != major else 0))
        return _ellipsoid(major, flattening)
    code = keys.get(ELLIPSOID) or GEOGRAPHICS.get(int(keys.get(GEOGRAPHIC, 0)))
    if code not in ELLIPSOIDS:
        raise ProjectionError("keys: the ellipsoid is not stated")
    return _ellipsoid(*ELLIPSOIDS[int(code)])


def to_keys(srs: str) -> tuple[tuple[int, ...], tuple[float, ...], bytes]:
    """(directory, doubles, text) that state a system, its proj string cited in the text.

    Projections without a code of their own are cited only, with the ellipsoid in the keys.
    """
    from .projections import parse

    s = parse(srs)
    cited = srs.encode() + b"|"
    numbers = [s.radius]
    entries = [(MODEL, 0, 1, 2 if s.proj == "longlat" else 1), (RASTER, 0, 1, AREA_CELLS), (CITATION, TEXT, len(cited), 0)]
    if srs.strip().upper().startswith("EPSG:"):
        entries.append((GEOGRAPHIC if s.proj == "longlat" else PROJECTED, 0, 1, int(srs.strip()[5:])))
        return _directory(entries, [], cited)
    entries += [(GEOGRAPHIC, 0, 1, OWN), (ANGULAR, 0, 1, DEGREE), (ELLIPSOID, 0, 1, OWN), (MAJOR, DOUBLES, 1, 0)]
    if s.es:
        numbers.append(1 / (1 - math.sqrt(1 - s.es)))
        entries.append((FLATTENING, DOUBLES, 1, 1))
    else:
        numbers.append(s.radius)
        entries.append((MINOR, DOUBLES, 1, 1))
    if s.proj != "longlat":
        entries += [(PROJECTED, 0, 1, OWN), (PROJECTION, 0, 1, OWN), (LINEAR, 0, 1, METRE)]
        code = next((c for c, name in CODES.items() if name == s.proj), None)
        if code:
            entries.append((METHOD, 0, 1, code))
            centred = s.proj in ("laea", "gnom")
            values = {3088 if centred else 3080: s.lon_0, 3089 if centred else 3081: s.lat_0, 3082: s.x_0, 3083: s.y_0}
            if s.proj in ("merc", "cea"):
                values[3078] = s.lat_ts
            if s.proj == "aea":
                values |= {3078: s.lat_1, 3079: s.lat_2}
            for key, v in values.items():
                entries.append((key, DOUBLES, 1, len(numbers)))
                numbers.append(v)
    return _directory(entries, numbers, cited)


def _directory(entries: list[tuple[int, int, int, int]], numbers: list[float], cited: bytes) -> tuple[tuple[int, ...], tuple[float, ...], bytes]:
    entries.sort()
    return (1, 1, 0, len(entries), *(v for e in entries for v in e)), tuple(numbers), cited + b"\0"
