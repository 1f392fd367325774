"""SQL texts of the checks for grid projections: the iterative form, independent of the columns."""

from __future__ import annotations

_A, _B, _F0 = "6377563.396", "6356256.909", "0.9996012717"
_E2 = f"(1 - ({_B} / {_A}) ^ 2)"
_N = f"(({_A} - {_B}) / ({_A} + {_B}))"
_WA, _WB = "6378137.0", "6356752.314245"


def _arc(phi: str) -> str:
    d, s = f"({phi} - radians(49.0))", f"({phi} + radians(49.0))"
    return (
        f"({_B} * {_F0} * ((1 + {_N} + 1.25 * {_N} ^ 2 + 1.25 * {_N} ^ 3) * {d}"
        f" - (3 * {_N} + 3 * {_N} ^ 2 + 2.625 * {_N} ^ 3) * sin({d}) * cos({s})"
        f" + 1.875 * ({_N} ^ 2 + {_N} ^ 3) * sin(2 * {d}) * cos(2 * {s})"
        f" - 35 / 24.0 * {_N} ^ 3 * sin(3 * {d}) * cos(3 * {s})))"
    )


def _double(text: str) -> str:
    """Number literals as DOUBLE, so that no step is computed in decimals."""
    import re

    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"CAST(\1 AS DOUBLE)", text)


def _geodetic(src: str, out: str, a: str, b: str, rounds: int = 6) -> list[str]:
    e2 = f"(1 - ({b} / {a}) ^ 2)"
    steps = [f"{out}_0 AS (SELECT *, atan2(hz, sqrt(hx * hx + hy * hy) * (1 - {e2})) AS gphi FROM {src})"]
    for k in range(1, rounds + 1):
        nu = f"({a} / sqrt(1 - {e2} * sin(gphi) ^ 2))"
        steps.append(
            f"{out}_{k} AS (SELECT * REPLACE (atan2(hz + {e2} * {nu} * sin(gphi), sqrt(hx * hx + hy * hy)) AS gphi) FROM {out}_{k - 1})"
        )
    steps.append(f"{out} AS (SELECT *, atan2(hy, hx) AS glam FROM {out}_{rounds})")
    return steps


def bng_to_wgs84(src: str, out: str, e: str = "e", n: str = "n") -> str:
    """CTEs that add lat and lon (degrees) to `src` as `out`."""
    steps = [f"{out}_p0 AS (SELECT *, ({n} + 100000) / ({_A} * {_F0}) + radians(49.0) AS phi FROM {src})"]
    for k in range(1, 9):
        steps.append(
            f"{out}_p{k} AS (SELECT * REPLACE (phi + ({n} + 100000 - {_arc('phi')}) / ({_A} * {_F0}) AS phi) FROM {out}_p{k - 1})"
        )
    steps.append(
        f"{out}_t AS (SELECT *, tan(phi) AS t, {_A} * {_F0} / sqrt(1 - {_E2} * sin(phi) ^ 2) AS nu,"
        f" {_A} * {_F0} * (1 - {_E2}) / (1 - {_E2} * sin(phi) ^ 2) ^ 1.5 AS rho, {e} - 400000 AS d FROM {out}_p8)"
    )
    steps.append(
        f"{out}_o AS (SELECT *, phi - t / (2 * rho * nu) * d ^ 2"
        " + t / (24 * rho * nu ^ 3) * (5 + 3 * t ^ 2 + (nu / rho - 1) - 9 * t ^ 2 * (nu / rho - 1)) * d ^ 4"
        " - t / (720 * rho * nu ^ 5) * (61 + 90 * t ^ 2 + 45 * t ^ 4) * d ^ 6 AS la,"
        " radians(-2.0) + (d / nu - (nu / rho + 2 * t ^ 2) / (6 * nu ^ 3) * d ^ 3"
        " + (5 + 28 * t ^ 2 + 24 * t ^ 4) / (120 * nu ^ 5) * d ^ 5"
        " - (61 + 662 * t ^ 2 + 1320 * t ^ 4 + 720 * t ^ 6) / (5040 * nu ^ 7) * d ^ 7) / cos(phi) AS lo"
        f" FROM {out}_t)"
    )
    nu = f"({_A} / sqrt(1 - {_E2} * sin(la) ^ 2))"
    steps.append(
        f"{out}_c AS (SELECT *, {nu} * cos(la) * cos(lo) AS cx, {nu} * cos(la) * sin(lo) AS cy,"
        f" {nu} * (1 - {_E2}) * sin(la) AS cz FROM {out}_o)"
    )
    k = "(1 - 20.4894 / 1000000.0)"
    rx, ry, rz = (f"radians({r} / 3600.0)" for r in ("0.1502", "0.2470", "0.8421"))
    steps.append(
        f"{out}_h AS (SELECT *, 446.448 + {k} * cx - {rz} * cy + {ry} * cz AS hx,"
        f" -125.157 + {rz} * cx + {k} * cy - {rx} * cz AS hy, 542.060 - {ry} * cx + {rx} * cy + {k} * cz AS hz FROM {out}_c)"
    )
    steps += _geodetic(f"{out}_h", f"{out}_g", _WA, _WB)
    steps.append(f"{out} AS (SELECT *, degrees(gphi) AS lat, degrees(glam) AS lon FROM {out}_g)")
    return _double(",\n".join(steps))


def haversine_km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"(2 * CAST(6371.0 AS DOUBLE) * asin(least(1, sqrt(sin(radians({lat2} - {lat1}) / 2) ^ 2"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lon2} - {lon1}) / 2) ^ 2))))"
    )
