"""Queries over points on the ellipsoid, and the SQL that states them in forms of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import geometry as geo

# WGS 84: semi-major axis, squared eccentricity and eccentricity.
A, ES = 6378137.0, (2 - 1 / 298.257223563) / 298.257223563
E = ES**0.5
SYSTEMS = {
    "merc": "+proj=merc +lat_ts=20 +lon_0=10 +ellps=WGS84", "cea": "EPSG:6933", "sinu": "+proj=sinu +lon_0=-30 +datum=WGS84",
    "aea": "+proj=aea +lat_1=20 +lat_2=50 +lat_0=10 +lon_0=15 +ellps=WGS84", "laea": "+proj=laea +lat_0=40 +lon_0=-20 +ellps=WGS84",
}
POINTS = "SELECT c_custkey AS id, radians((c_custkey*37 % 1600)/10e0 - 80e0) AS lam, radians((c_custkey*53 % 1600)/10e0 - 80e0) AS phi FROM customer"


def _points(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey AS id", "radians((c_custkey*37 % 1600)/10e0 - 80e0) AS lam", "radians((c_custkey*53 % 1600)/10e0 - 80e0) AS phi")


def _plane(s: SparkSession, d: str) -> DataFrame:
    """Points within some thousand kilometres of the origin."""
    return s.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey AS id", "(c_custkey*37 % 4000)*1e3 - 2e6 AS x", "(c_custkey*53 % 4000)*1e3 - 2e6 AS y")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name, srs in SYSTEMS.items():
        q[f"proj_{name}_wgs84_fwd"] = lambda s, d, srs=srs: geo.transform_points(_points(s, d), srs, "lam", "phi", ("x", "y")).selectExpr("id", "round(x, 3) + 0e0 AS x", "round(y, 3) + 0e0 AS y")
        q[f"proj_{name}_wgs84_inv"] = lambda s, d, srs=srs: geo.transform_points(_plane(s, d), srs, "x", "y", ("lam", "phi"), back=True).selectExpr("id", "round(degrees(lam), 9) AS lon", "round(degrees(phi), 9) AS lat")
    return q


def _q(phi: str) -> str:
    """The authalic function with logarithms, as printed."""
    return f"({1 - ES!r}*(sin({phi})/(1 - {ES!r}*sin({phi})*sin({phi})) - {1 / (2 * E)!r}*ln((1 - {E!r}*sin({phi}))/(1 + {E!r}*sin({phi})))))"


def _m(phi: str) -> str:
    return f"(cos({phi})/sqrt(1 - {ES!r}*sin({phi})*sin({phi})))"


def _arc(phi: str) -> str:
    """Length of the meridian, by powers of the eccentricity."""
    e = ES
    c = (1 - e / 4 - 3 * e**2 / 64 - 5 * e**3 / 256 - 175 * e**4 / 16384, 3 * e / 8 + 3 * e**2 / 32 + 45 * e**3 / 1024 + 105 * e**4 / 4096, 15 * e**2 / 256 + 45 * e**3 / 1024 + 525 * e**4 / 16384, 35 * e**3 / 3072 + 175 * e**4 / 12288, 315 * e**4 / 131072)
    return f"({c[0]!r}*{phi} - {c[1]!r}*sin(2*{phi}) + {c[2]!r}*sin(4*{phi}) - {c[3]!r}*sin(6*{phi}) + {c[4]!r}*sin(8*{phi}))"


def _simpson(phi: str, n: int = 512) -> str:
    """The same as an integral, by Simpson's rule."""
    weight = f"CASE WHEN i IN (0, {n}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"({phi}/{3 * n}e0*list_sum(list_transform(range(0, {n + 1}), lambda i: {weight}*{1 - ES!r}/pow(1 - {ES!r}*pow(sin({phi}*i/{n}e0), 2), 1.5e0))))"


CONE = f"SELECT *, (m1*m1 - m2*m2)/(q2 - q1) AS n FROM (SELECT {_m('radians(20e0)')} AS m1, {_m('radians(50e0)')} AS m2, {_q('radians(20e0)')} AS q1, {_q('radians(50e0)')} AS q2, {_q('radians(10e0)')} AS q0) c"
CONE = f"SELECT *, m1*m1 + n*q1 AS c, sqrt(m1*m1 + n*q1 - n*q0)/n AS rho0 FROM ({CONE}) d"
CENTRE = f"SELECT qp, asin(q1/qp) AS b1, sqrt(qp/2) AS rq, {_m('radians(40e0)')}/(sqrt(qp/2)*cos(asin(q1/qp))) AS dd FROM (SELECT {_q('(pi()/2)')} AS qp, {_q('radians(40e0)')} AS q1) c"


def _latitude(sql: str, start: str, step: str, rounds: int = 12) -> str:
    """Rounds of ``step``, of phi, on the rows of a query, from ``start`` on."""
    sql = f"SELECT *, {start} AS phi FROM ({sql}) n"
    for _ in range(rounds):
        sql = f"SELECT * REPLACE ({step} AS phi) FROM ({sql}) n"
    return sql


# Newton's step for the latitude of q, and the iteration for the latitude of a conformal one.
FROM_Q = f"phi + (1 - {ES!r}*sin(phi)*sin(phi))*(1 - {ES!r}*sin(phi)*sin(phi))/(2*cos(phi))*(q/{1 - ES!r} - sin(phi)/(1 - {ES!r}*sin(phi)*sin(phi)) + {1 / (2 * E)!r}*ln((1 - {E!r}*sin(phi))/(1 + {E!r}*sin(phi))))"
FROM_T = f"pi()/2 - 2*atan(t*pow((1 - {E!r}*sin(phi))/(1 + {E!r}*sin(phi)), {E / 2!r}))"
FROM_ARC = f"phi - ({_arc('phi')} - m)*pow(1 - {ES!r}*sin(phi)*sin(phi), 1.5e0)/{1 - ES!r}"


def oracle_sql() -> dict[str, str]:
    k0, k6 = _m("radians(20e0)"), _m("radians(30e0)")
    out = lambda x, y, of: f"SELECT id, round({A!r}*{x}, 3) + 0e0 AS x, round({A!r}*{y}, 3) + 0e0 AS y FROM ({of}) p"
    turn = lambda lam0, plus="": f"SELECT *, lam - radians({lam0}e0) AS l{plus} FROM ({POINTS}) p"
    iso = f"ln(tan(pi()/4 + phi/2)*pow((1 - {E!r}*sin(phi))/(1 + {E!r}*sin(phi)), {E / 2!r}))"
    rho = f"(sqrt(c - n*{_q('phi')})/n)"
    away = "sqrt(2/(1 + sin(b1)*sin(b) + cos(b1)*cos(b)*cos(l)))"
    q = {
        "proj_merc_wgs84_fwd": out(f"{k0}*l", f"{k0}*{iso}", turn(10)),
        "proj_cea_wgs84_fwd": out(f"{k6}*l", f"{_q('phi')}/(2*{k6})", turn(0)),
        "proj_sinu_wgs84_fwd": out(f"l*{_m('phi')}", _simpson("phi"), turn(-30)),
        "proj_aea_wgs84_fwd": out(f"{rho}*sin(n*l)", f"(rho0 - {rho}*cos(n*l))", f"SELECT * FROM ({turn(15)}) t, ({CONE}) c"),
        "proj_laea_wgs84_fwd": out(f"rq*dd*{away}*cos(b)*sin(l)", f"rq/dd*{away}*(cos(b1)*sin(b) - sin(b1)*cos(b)*cos(l))", f"SELECT *, asin({_q('phi')}/qp) AS b FROM ({turn(-20)}) t, ({CENTRE}) c"),
    }
    plane = f"SELECT c_custkey AS id, ((c_custkey*37 % 4000)*1e3 - 2e6)/{A!r} AS x, ((c_custkey*53 % 4000)*1e3 - 2e6)/{A!r} AS y FROM customer"
    back = lambda lam, lam0, of: f"SELECT id, round(degrees({lam}) + {lam0}e0, 9) AS lon, round(degrees(phi), 9) AS lat FROM ({of}) p"
    q["proj_merc_wgs84_inv"] = back(f"x/{k0}", 10, _latitude(f"SELECT *, exp(-y/{k0}) AS t FROM ({plane}) p", "pi()/2 - 2*atan(t)", FROM_T))
    q["proj_cea_wgs84_inv"] = back(f"x/{k6}", 0, _latitude(f"SELECT *, 2*y*{k6} AS q FROM ({plane}) p", "asin(q/2)", FROM_Q))
    q["proj_sinu_wgs84_inv"] = back(f"x/{_m('phi')}", -30, _latitude(f"SELECT *, y AS m FROM ({plane}) p", "m", FROM_ARC))
    cone = f"SELECT *, (c - (x*x + (rho0 - y)*(rho0 - y))*n*n)/n AS q FROM ({plane}) p, ({CONE}) c"
    q["proj_aea_wgs84_inv"] = back("atan2(x, rho0 - y)/n", 15, _latitude(cone, "asin(q/2)", FROM_Q))
    ball = f"SELECT *, x/(dd*rq) AS u, y*dd/rq AS v FROM ({plane}) p, ({CENTRE}) c"
    ball = f"SELECT *, sqrt(u*u + v*v) AS rho, 2*asin(sqrt(u*u + v*v)/2) AS ce FROM ({ball}) p"
    ball = f"SELECT *, (cos(ce)*sin(b1) + CASE WHEN rho = 0 THEN 0 ELSE v*sin(ce)*cos(b1)/rho END)*qp AS q FROM ({ball}) p"
    q["proj_laea_wgs84_inv"] = back("atan2(u*sin(ce), rho*cos(b1)*cos(ce) - v*sin(b1)*sin(ce))", -20, _latitude(ball, "asin(q/2)", FROM_Q))
    return q
