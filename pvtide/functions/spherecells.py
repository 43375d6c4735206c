"""Hexagonal cells on the sphere with parents, as Column math.

The sphere is divided among the 20 faces of an icosahedron, turned so that
one face's centre lies in Great Britain. A point belongs to the face of the
nearest centre; around that centre the sphere is mapped to a plane by the
azimuthal equal-area projection and the plane is tiled with hexagons. So all
cells of a resolution have the same area, except those cut by the border
between two faces.

A resolution's hexagons have a seventh of the area of the one above, and its
tiling is turned by 19.1 degrees against that, so that every centre of the
coarser tiling is one of the finer. A cell's children are the hexagon around
its own centre and the six next to it; a cell's parent is found in whole
numbers and is one of its face. So counts roll up exactly. A cell is one
``bigint``: resolution, face and axial coordinates.

These are not the ids of the reference's plugin (that codec is a per-row
library), but at equal resolution cells of the same mean area.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean radius of the earth, mean area of a cell at resolution 5
# (edges of about 9.9 km), and the centre of face 0.
EARTH_KM = 6371.0072
AREA_5_KM2 = 252.9
CENTRE = (54.5, -3.0)
MAX_RESOLUTION = 15
_HALF = 1 << 25  # axial coordinates are stored from 0 on


def _cross(a, b):
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def _dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def _unit(a):
    size = math.sqrt(_dot(a, a))
    return tuple(x / size for x in a)


def _direction(lat: float, lon: float):
    lat, lon = math.radians(lat), math.radians(lon)
    return (math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat))


def _faces() -> list[tuple]:
    """(centre, two directions that span its plane) of each face."""
    golden = (1 + math.sqrt(5)) / 2
    corners = [_unit(v) for s in (1, -1) for t in (golden, -golden) for v in ((0, s, t), (s, t, 0), (t, 0, s))]
    edge = max(_dot(a, b) for a, b in combinations(corners, 2))
    near = lambda a, b: _dot(a, b) > edge - 1e-9
    sides = [c for c in combinations(corners, 3) if all(near(a, b) for a, b in combinations(c, 2))]
    centres = [_unit(tuple(map(sum, zip(*c, strict=True)))) for c in sides]

    def frame(c, towards):
        x = _unit(tuple(t - _dot(towards, c) * v for t, v in zip(towards, c, strict=True)))
        return (x, _cross(c, x), c)

    # The turn that takes the first face's centre to CENTRE, a corner of it to the north.
    old, new = frame(centres[0], sides[0][0]), frame(_direction(*CENTRE), (0.0, 0.0, 1.0))
    turn = lambda p: tuple(sum(_dot(p, o) * n[i] for o, n in zip(old, new, strict=True)) for i in range(3))
    out = []
    for centre, side in zip(centres, sides, strict=True):
        x, y, c = frame(turn(centre), turn(side[0]))
        out.append((c, x, y))
    return out


FACES = _faces()


def edge_of(resolution: int) -> float:
    """Edge of a resolution's hexagons, in radii of the sphere."""
    if not 0 <= resolution <= MAX_RESOLUTION:
        raise ValueError(f"resolution must be 0 to {MAX_RESOLUTION}")
    area = AREA_5_KM2 * 7.0 ** (5 - resolution) / EARTH_KM ** 2
    return math.sqrt(area * 2 / (3 * math.sqrt(3)))


def turn_of(resolution: int) -> tuple[float, float]:
    """Cosine and sine of the angle by which a resolution's tiling is turned."""
    angle = -resolution * math.atan2(math.sqrt(3) / 2, 2.5)
    return math.cos(angle), math.sin(angle)


def _col(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _face_table() -> Column:
    """The faces as an array of structs: number, centre c, directions a and b."""
    return F.array(*[F.struct(F.lit(i).alias("f"), *[F.lit(v).alias(f"{name}{k}") for name, part in zip("cab", face, strict=True)
                                                     for k, v in enumerate(part)]) for i, face in enumerate(FACES)])


def _times(p: Column, t: Column, part: str) -> Column:
    return p["x"] * t[f"{part}0"] + p["y"] * t[f"{part}1"] + p["z"] * t[f"{part}2"]


def _rounded(axial: Column) -> Column:
    """The whole axial coordinates (q, r) nearest to fractional ones."""
    def whole(c: Column) -> Column:
        parts = (c["q"], c["r"], -c["q"] - c["r"])
        near = [F.floor(v + 0.5) for v in parts]
        return F.struct(*[v.alias(n) for n, v in zip("qrs", near, strict=True)],
                        *[F.abs(w - v).alias(n) for n, w, v in zip("abc", near, parts, strict=True)])

    def chosen(w: Column) -> Column:
        # The coordinate that is furthest from its integer follows from the other two.
        q_last = (w["a"] > w["b"]) & (w["a"] > w["c"])
        r_last = ~q_last & (w["b"] > w["c"])
        return F.struct(F.when(q_last, -w["r"] - w["s"]).otherwise(w["q"]).alias("q"),
                        F.when(r_last, -w["q"] - w["s"]).otherwise(w["r"]).alias("r"))

    return _let(axial, lambda c: _let(whole(c), chosen))


def _hexagon(at: Column, resolution: int) -> Column:
    """Axial coordinates of the hexagon that holds a point (x, y) of the plane."""
    edge, (cos, sin) = edge_of(resolution), turn_of(resolution)
    x, y = at["x"] * cos + at["y"] * sin, at["y"] * cos - at["x"] * sin
    return _rounded(F.struct(((x * math.sqrt(3.0) - y) / 3.0 / edge).alias("q"), (y * (2.0 / 3.0) / edge).alias("r")))


def _packed(resolution: Column | int, face: Column, q: Column, r: Column) -> Column:
    head = (F.lit(resolution) if isinstance(resolution, int) else resolution) * 20 + face
    return ((head.cast("bigint") * (2 * _HALF) + (q + _HALF)) * (2 * _HALF) + (r + _HALF)).cast("bigint")


def sphere_cell(lat, lon, resolution: int = 5) -> Column:
    """The cell of a place. Null if a coordinate is null or not finite, or
    the latitude is beyond the poles; any longitude will do."""
    edge_of(resolution)  # refuses resolutions that there are not
    lat, lon = _col(lat), _col(lon)
    phi, lam = F.radians(lat), F.radians(lon)
    place = F.struct((F.cos(phi) * F.cos(lam)).alias("x"), (F.cos(phi) * F.sin(lam)).alias("y"), F.sin(phi).alias("z"))

    def on_face(p: Column) -> Column:
        nearest = F.array_max(F.transform(_face_table(), lambda t: F.struct(_times(p, t, "c").alias("d"), t.alias("t"))))
        return _let(nearest, lambda n: _let(_mapped(p, n), lambda at: _let(
            _hexagon(at, resolution), lambda h: _packed(resolution, n["t"]["f"], h["q"], h["r"]))))

    def _mapped(p: Column, n: Column) -> Column:
        stretch = F.sqrt(2.0 / (1.0 + n["d"]))  # equal area
        return F.struct((_times(p, n["t"], "a") * stretch).alias("x"), (_times(p, n["t"], "b") * stretch).alias("y"))

    known = lat.between(-90.0, 90.0) & (F.abs(lon) < 1e9)
    return F.when(known, _let(place, on_face))


def cell_parts(cell) -> tuple[Column, Column, Column, Column]:
    """Resolution, face and axial coordinates of a cell."""
    cell = F.col(cell) if isinstance(cell, str) else cell
    size = F.lit(2 * _HALF).cast("bigint")
    q, r = F.pmod(F.shiftright(cell, 26), size) - _HALF, F.pmod(cell, size) - _HALF
    head = F.shiftright(cell, 52)
    return F.floor(head / 20).cast("int"), F.pmod(head, F.lit(20)).cast("int"), q, r


def _plane(cell: Column) -> Column:
    """Face f and the centre (x, y) in the face's plane."""
    v, f, q, r = cell_parts(cell)
    sizes = F.array(*[F.struct(F.lit(edge_of(i)).alias("e"), *[F.lit(c).alias(n) for n, c in zip("cs", turn_of(i), strict=True)])
                      for i in range(MAX_RESOLUTION + 1)])

    def turned(t: Column) -> Column:
        x, y = (q + r / 2.0) * math.sqrt(3.0) * t["e"], r * 1.5 * t["e"]
        return F.struct(f.alias("f"), (x * t["c"] - y * t["s"]).alias("x"), (x * t["s"] + y * t["c"]).alias("y"))

    return _let(F.element_at(sizes, v + 1), turned)


def cell_parent(cell, resolution: int) -> Column:
    """The ancestor of a cell at a coarser resolution; null if it is not
    coarser. With w for the sixth root of unity, the centres of a tiling are
    the numbers q + r w, and those of the one above are their multiples by
    2 + w: dividing by it and rounding gives the parent."""
    cell = F.col(cell) if isinstance(cell, str) else cell
    levels = F.sequence(F.lit(MAX_RESOLUTION - 1), F.lit(resolution), F.lit(-1))

    def step(own: Column, level: Column) -> Column:
        v, f, q, r = cell_parts(own)
        quotient = F.struct(((q * 3 + r) / 7.0).alias("q"), ((r * 2 - q) / 7.0).alias("r"))
        return F.when(v == level + 1, _let(_rounded(quotient), lambda h: _packed(level, f, h["q"], h["r"]))).otherwise(own)

    return F.when(cell_parts(cell)[0] > resolution, F.aggregate(levels, cell, step))


def cell_centre(cell) -> tuple[Column, Column]:
    """Latitude and longitude of a cell's centre."""
    cell = F.col(cell) if isinstance(cell, str) else cell

    def place(at: Column) -> Column:
        t = F.element_at(_face_table(), at["f"] + 1)
        squared = at["x"] * at["x"] + at["y"] * at["y"]
        along, across = 1.0 - squared / 2.0, F.sqrt(1.0 - squared / 4.0)
        return F.struct(*[(t[f"c{k}"] * along + (t[f"a{k}"] * at["x"] + t[f"b{k}"] * at["y"]) * across).alias(n)
                          for k, n in enumerate("xyz")])

    found = _let(_plane(cell), lambda at: _let(place(at), lambda p: F.struct(
        F.degrees(F.asin(F.least(F.greatest(p["z"], F.lit(-1.0)), F.lit(1.0)))).alias("lat"),
        F.degrees(F.atan2(p["y"], p["x"])).alias("lon"))))
    return found["lat"], found["lon"]
