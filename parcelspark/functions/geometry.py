"""Closed-form geometry as column expressions. A ring is ARRAY<ARRAY<DOUBLE>>, a polygon an array of rings, outer first."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6371008.8
#: UTM zone 28 north on the WGS84 ellipsoid.
AXIS, FLATTENING, SCALE, FALSE_EAST, CENTRAL = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, -15.0


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A closed ring, counter-clockwise."""
    return F.array(*[F.array(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])


def _pairs(ring: Column, term) -> Column:
    """The sum of term(vertex, next vertex) along a ring, in coordinates relative to its first vertex, which keeps sums exact at UTM magnitudes."""
    x, y = F.get(F.get(ring, F.lit(0)), F.lit(0)), F.get(F.get(ring, F.lit(0)), F.lit(1))
    local = F.transform(ring, lambda p: F.array(F.get(p, F.lit(0)) - x, F.get(p, F.lit(1)) - y))
    n = F.size(ring)
    both = F.zip_with(F.slice(local, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(local, F.lit(2), F.greatest(n - 1, F.lit(0))), term)
    return F.when(n >= 2, F.aggregate(both, F.lit(0.0), lambda acc, v: acc + v)).otherwise(F.lit(0.0))


def ring_area(ring: Column) -> Column:
    """Shoelace; no closing edge is added."""
    return F.abs(_pairs(ring, lambda a, b: F.get(a, F.lit(0)) * F.get(b, F.lit(1)) - F.get(b, F.lit(0)) * F.get(a, F.lit(1)))) / 2


def polygon_area(rings: Column) -> Column:
    """Outer ring less holes, not below 0."""
    holes = F.aggregate(F.transform(F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))), ring_area), F.lit(0.0), lambda acc, v: acc + v)
    return F.greatest(F.lit(0.0), ring_area(F.get(rings, F.lit(0))) - F.when(F.size(rings) > 1, holes).otherwise(0.0))


def bbox(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda p: F.get(p, F.lit(0))), F.transform(ring, lambda p: F.get(p, F.lit(1)))
    return {"min_x": F.array_min(xs), "min_y": F.array_min(ys), "max_x": F.array_max(xs), "max_y": F.array_max(ys)}


def mean_vertex(ring: Column) -> tuple[Column, Column]:
    """The mean of all vertices, the closing one too."""
    x = F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + F.get(p, F.lit(0)))
    y = F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + F.get(p, F.lit(1)))
    return x / F.size(ring), y / F.size(ring)


def aspect_ratio(w: Column, h: Column) -> Column:
    return F.when((w > 0) & (h > 0), F.greatest(w / h, h / w)).otherwise(0.0)


def is_sliver(area: Column, w: Column, h: Column, x: Column) -> Column:
    """Less than 1 m2 (or 1e-10 square degrees, where x is a longitude), or over 50 times as long as wide."""
    return (area < F.when(F.abs(x) > 180, 1.0).otherwise(1e-10)) | (aspect_ratio(w, h) > 50)


def is_valid_geometry(geom_type: Column, ring: Column) -> Column:
    """A geometry is there, and a polygon's outer ring has 4 vertices."""
    return geom_type.isNotNull() & ring.isNotNull() & ((geom_type != "Polygon") | (F.size(ring) >= 4))


def closed_ring(ring: Column, snap: float = 0.05) -> Column:
    """The ring closed exactly where its ends are within ``snap``; null where they are apart or it has too few vertices."""
    a, b = F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)
    gap = F.sqrt(F.pow(F.get(a, F.lit(0)) - F.get(b, F.lit(0)), 2) + F.pow(F.get(a, F.lit(1)) - F.get(b, F.lit(1)), 2))
    whole = F.concat(F.slice(ring, F.lit(1), F.size(ring) - 1), F.array(a))
    return F.when((F.size(ring) >= 4) & (gap <= snap), whole)


def fingerprint(ring: Column) -> Column:
    """sha256 of the coordinates in whole millimetres."""
    mm = F.transform(ring, lambda p: F.transform(p, lambda v: F.floor(v * 1000 + 0.5)))
    return F.sha2(F.to_json(mm), 256)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.pow(F.sin(dlon / 2), 2) * F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
    return 2 * EARTH_RADIUS * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def spherical_box_area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Square metres of a box of longitudes and latitudes on the sphere."""
    return EARTH_RADIUS**2 * F.abs(F.radians(x1 - x0)) * F.abs(F.sin(F.radians(y1)) - F.sin(F.radians(y0)))


def series() -> tuple[float, list[float], list[float]]:
    """(rectifying radius, coefficients of the inverse Krueger series, those from conformal to geodetic latitude) to the fourth order in the third flattening."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 / 1440 * n**4, 17 / 480 * n**3 - 37 / 840 * n**4, 4397 / 161280 * n**4]
    delta = [2 * n - 2 / 3 * n**2 - 2 * n**3 + 116 / 45 * n**4, 7 / 3 * n**2 - 8 / 5 * n**3 - 227 / 45 * n**4, 56 / 15 * n**3 - 136 / 35 * n**4, 4279 / 630 * n**4]
    return radius, beta, delta


def let(use, *values: Column) -> Column:
    """use(values), with each value worked out once however often ``use`` refers to it: an expression that is repeated doubles at every step."""
    row = F.struct(*[v.alias(f"v{k}") for k, v in enumerate(values)])
    return F.get(F.transform(F.array(row), lambda s: use(*[s[f"v{k}"] for k in range(len(values))])), F.lit(0))


def to_wgs84(x: Column, y: Column) -> tuple[Column, Column]:
    """(longitude, latitude) of UTM 28 north; a point that already is one in degrees stays."""
    radius, beta, delta = series()

    def conformal(xi: Column, eta: Column) -> Column:
        xp, ep = xi, eta
        for k, b in enumerate(beta, 1):
            xp = xp - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
            ep = ep - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        return let(geodetic, xp, ep)

    def geodetic(xp: Column, ep: Column) -> Column:
        lon = F.lit(math.radians(CENTRAL)) + F.atan2(F.sinh(ep), F.cos(xp))
        return let(lambda lon, chi: F.struct(F.degrees(lon).alias("lon"), F.degrees(sum((d * F.sin(2 * k * chi) for k, d in enumerate(delta, 1)), chi)).alias("lat")), lon, F.asin(F.sin(xp) / F.cosh(ep)))

    at = let(conformal, y / (SCALE * radius), (x - FALSE_EAST) / (SCALE * radius))
    metres = (F.abs(x) > 180) | (F.abs(y) > 90)
    return F.when(metres, at["lon"]).otherwise(x), F.when(metres, at["lat"]).otherwise(y)


def to_utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(x, y) of UTM 28 north in metres; a point that is in metres already stays."""
    n = FLATTENING / (2 - FLATTENING)
    alpha = [n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4, 61 / 240 * n**3 - 103 / 140 * n**4, 49561 / 161280 * n**4]
    e, radius = 2 * math.sqrt(n) / (1 + n), series()[0]

    def projected(xi: Column, eta: Column) -> Column:
        north, east = xi, eta
        for k, a in enumerate(alpha, 1):
            north = north + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
            east = east + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        return F.struct((FALSE_EAST + SCALE * radius * east).alias("x"), (SCALE * radius * north).alias("y"))

    spherical = lambda t, turn: let(projected, F.atan2(t, F.cos(turn)), F.asinh(F.sin(turn) / F.sqrt(t * t + F.cos(turn) * F.cos(turn))))
    at = let(lambda s, turn: let(spherical, F.sinh(F.atanh(s) - e * F.atanh(e * s)), turn), F.sin(F.radians(lat)), F.radians(lon - CENTRAL))
    degrees = (F.abs(lon) <= 180) & (F.abs(lat) <= 90)
    return F.when(degrees, at["x"]).otherwise(lon), F.when(degrees, at["y"]).otherwise(lat)


def parts_to_utm(parts: Column) -> Column:
    """A geometry of longitudes and latitudes in metres, vertex by vertex."""
    point = lambda p: F.array(*to_utm(F.get(p, F.lit(0)), F.get(p, F.lit(1))))
    return F.transform(parts, lambda g: F.transform(g, lambda r: F.transform(r, point)))


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on the ellipsoid between two points that are near each other: by the radii of curvature at their mean latitude, which is right to a millimetre within ten kilometres."""
    e2 = FLATTENING * (2 - FLATTENING)
    length = lambda north, east: F.sqrt(north * north + east * east)
    curved = lambda w, cosine, down, across: let(length, AXIS * (1 - e2) / (w * F.sqrt(w)) * down, AXIS / F.sqrt(w) * cosine * across)
    between = lambda middle, down, across: let(curved, 1 - e2 * F.sin(middle) * F.sin(middle), F.cos(middle), down, across)
    return let(lambda a, b, c, d: let(between, F.radians((b + d) / 2), F.radians(d - b), F.radians(c - a)), lon1, lat1, lon2, lat2)


def nearest_on(x: Column, y: Column, rings: Column) -> Column:
    """A struct of d, px, py: the nearest point of the outlines, and how far it is."""
    g = lambda p, k: F.get(p, F.lit(k))

    def foot(s: Column) -> Column:
        dx, dy = g(s["b"], 0) - g(s["a"], 0), g(s["b"], 1) - g(s["a"], 1)
        long = dx * dx + dy * dy
        t = F.when(long > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - g(s["a"], 0)) * dx + (y - g(s["a"], 1)) * dy) / long))).otherwise(0.0)
        px, py = g(s["a"], 0) + t * dx, g(s["a"], 1) + t * dy
        return F.struct(F.sqrt((px - x) * (px - x) + (py - y) * (py - y)).alias("d"), px.alias("px"), py.alias("py"))

    return F.array_min(F.flatten(F.transform(rings, lambda r: F.transform(edges_of(r), foot))))


def edges_of(ring: Column) -> Column:
    """Structs of a vertex and the next."""
    n = F.size(ring)
    return F.zip_with(F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def on_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies on an edge."""
    g = lambda p, k: F.get(p, F.lit(k))
    cross = lambda s: (g(s["b"], 0) - g(s["a"], 0)) * (y - g(s["a"], 1)) - (g(s["b"], 1) - g(s["a"], 1)) * (x - g(s["a"], 0))
    return F.exists(edges_of(ring), lambda s: (cross(s) == 0) & x.between(F.least(g(s["a"], 0), g(s["b"], 0)), F.greatest(g(s["a"], 0), g(s["b"], 0))) & y.between(F.least(g(s["a"], 1), g(s["b"], 1)), F.greatest(g(s["a"], 1), g(s["b"], 1))))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting by an expression; points on the boundary count as inside."""
    g = lambda p, k: F.get(p, F.lit(k))
    crosses = lambda s: ((g(s["a"], 1) > y) != (g(s["b"], 1) > y)) & (x < (g(s["b"], 0) - g(s["a"], 0)) * (y - g(s["a"], 1)) / (g(s["b"], 1) - g(s["a"], 1)) + g(s["a"], 0))
    return on_ring(x, y, ring) | (F.size(F.filter(edges_of(ring), crosses)) % 2 == 1)


def distance_to_ring(x: Column, y: Column, ring: Column) -> Column:
    """The distance of a point from the nearest edge; null without edges."""
    g = lambda p, k: F.get(p, F.lit(k))

    def to_edge(s: Column) -> Column:
        dx, dy = g(s["b"], 0) - g(s["a"], 0), g(s["b"], 1) - g(s["a"], 1)
        long = dx * dx + dy * dy
        t = F.when(long > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - g(s["a"], 0)) * dx + (y - g(s["a"], 1)) * dy) / long))).otherwise(0.0)
        u, v = g(s["a"], 0) + t * dx - x, g(s["a"], 1) + t * dy - y
        return F.sqrt(u * u + v * v)

    return F.array_min(F.transform(edges_of(ring), to_edge))


def shared_length(ring: Column, other: Column, tolerance: float) -> Column:
    """The length of a ring's edges that run within the tolerance of an edge of the other ring: for each edge, the longest stretch of it beside one edge whose ends are that close to its line."""
    g = lambda p, k: F.get(p, F.lit(k))

    def beside(s: Column, o: Column) -> Column:
        dx, dy = g(s["b"], 0) - g(s["a"], 0), g(s["b"], 1) - g(s["a"], 1)
        long = F.sqrt(dx * dx + dy * dy)
        along = lambda p: ((g(p, 0) - g(s["a"], 0)) * dx + (g(p, 1) - g(s["a"], 1)) * dy) / long
        off = lambda p: F.abs((g(p, 0) - g(s["a"], 0)) * dy - (g(p, 1) - g(s["a"], 1)) * dx) / long
        stretch = F.least(long, F.greatest(along(o["a"]), along(o["b"]))) - F.greatest(F.lit(0.0), F.least(along(o["a"]), along(o["b"])))
        return F.when((long > 0) & (off(o["a"]) <= tolerance) & (off(o["b"]) <= tolerance), F.greatest(F.lit(0.0), stretch)).otherwise(0.0)

    each = F.transform(edges_of(ring), lambda s: F.coalesce(F.array_max(F.transform(edges_of(other), lambda o: beside(s, o))), F.lit(0.0)))
    return F.aggregate(each, F.lit(0.0), lambda acc, v: acc + v)


def crosses_itself(ring: Column) -> Column:
    """Whether two edges of a ring cross between their ends."""
    return F.exists(edges_of(ring), lambda s: F.exists(edges_of(ring), lambda o: _cross(s, o)))


def _cross(s: Column, o: Column) -> Column:
    """Whether two edges cross at inner points of both."""
    g = lambda p, k: F.get(p, F.lit(k))
    side = lambda e, p: (g(e["b"], 0) - g(e["a"], 0)) * (g(p, 1) - g(e["a"], 1)) - (g(e["b"], 1) - g(e["a"], 1)) * (g(p, 0) - g(e["a"], 0))
    return (side(s, o["a"]) * side(s, o["b"]) < 0) & (side(o, s["a"]) * side(o, s["b"]) < 0)


def touches(rings: Column, others: Column) -> Column:
    """Whether a vertex of one outline lies on an edge of the other, or two edges cross."""
    g = lambda p, k: F.get(p, F.lit(k))
    on = lambda a, b: F.exists(a, lambda r: F.exists(r, lambda p: F.exists(b, lambda o: on_ring(g(p, 0), g(p, 1), o))))
    crossing = F.exists(rings, lambda r: F.exists(others, lambda o: F.exists(edges_of(r), lambda s: F.exists(edges_of(o), lambda e: _cross(s, e)))))
    return on(rings, others) | on(others, rings) | crossing


def open_mean(ring: Column) -> tuple[Column, Column]:
    """The mean of the vertices, the closing one left out."""
    n = F.size(ring)
    closed = (n > 1) & (F.get(ring, F.lit(0)) == F.get(ring, n - 1))
    return mean_vertex(F.when(closed, F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(1)))).otherwise(ring))


def spherical_ring_area(ring: Column) -> Column:
    """Square metres inside a ring of longitudes and latitudes on the sphere."""
    g = lambda p, k: F.radians(F.get(p, F.lit(k)))
    total = F.aggregate(edges_of(ring), F.lit(0.0), lambda acc, s: acc + (g(s["b"], 0) - g(s["a"], 0)) * (F.sin(g(s["a"], 1)) + F.sin(g(s["b"], 1))))
    return F.abs(total) * EARTH_RADIUS**2 / 2


def ring_length(ring: Column) -> Column:
    """The length of a line or outline in the plane."""
    g = lambda p, k: F.get(p, F.lit(k))
    return F.aggregate(edges_of(ring), F.lit(0.0), lambda acc, s: acc + F.sqrt(F.pow(g(s["b"], 0) - g(s["a"], 0), 2) + F.pow(g(s["b"], 1) - g(s["a"], 1), 2)))


def point_on(ring: Column) -> tuple[Column, Column]:
    """A point of a ring: its mean vertex where that lies inside, else its first vertex."""
    # The ring and its mean are worked out once, not for each edge that the point is held against.
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    corner = lambda r, k: F.get(F.get(r, F.lit(0)), F.lit(k))
    point = let(lambda r: let(lambda x, y: F.when(point_in_ring(x, y, r), pair(x, y)).otherwise(pair(corner(r, 0), corner(r, 1))), *open_mean(r)), ring)
    return point["x"], point["y"]


def affine(x: Column, y: Column, scale_x: Column, scale_y: Column, degrees: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """Scaled, turned, moved."""
    a, u, v = F.radians(degrees), x * scale_x, y * scale_y
    return u * F.cos(a) - v * F.sin(a) + dx, u * F.sin(a) + v * F.cos(a) + dy


def wkt(rings: Column) -> Column:
    """A polygon as text; whole numbers are written without a fraction."""
    number = lambda v: F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("string"))
    point = lambda p: F.concat_ws(" ", number(F.get(p, F.lit(0))), number(F.get(p, F.lit(1))))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, point), ","), F.lit(")"))
    return F.concat(F.lit("POLYGON("), F.array_join(F.transform(rings, ring), ","), F.lit(")"))
