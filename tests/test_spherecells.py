import math
import random

from pyspark.sql import functions as F

from pvtide.functions import spherecells as sc


def direction(lat, lon):
    return sc._direction(lat, lon)


def brute_cell(lat, lon, resolution):
    """Face of the nearest centre, then the nearest hexagon centre among all near ones."""
    p = direction(lat, lon)
    face = max(range(20), key=lambda f: sc._dot(p, sc.FACES[f][0]))
    c, a, b = sc.FACES[face]
    stretch = math.sqrt(2 / (1 + sc._dot(p, c)))
    x, y, edge = sc._dot(p, a) * stretch, sc._dot(p, b) * stretch, sc.edge_of(resolution)
    cos, sin = sc.turn_of(resolution)
    x, y = x * cos + y * sin, y * cos - x * sin
    r0 = round(y / (1.5 * edge))
    best = min(((math.hypot(x - math.sqrt(3) * edge * (q + r / 2), y - 1.5 * edge * r), q, r)
                for r in range(r0 - 2, r0 + 3) for q0 in [round(x / (math.sqrt(3) * edge) - r / 2)] for q in range(q0 - 2, q0 + 3)))
    return face, best[1], best[2]


def places(n, seed=1, box=None):
    rng = random.Random(seed)
    if box:
        (south, north), (west, east) = box
        low, high = math.sin(math.radians(south)), math.sin(math.radians(north))
        return [(math.degrees(math.asin(rng.uniform(low, high))), rng.uniform(west, east)) for _ in range(n)]
    return [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "i int, lat double, lon double")


def test_icosahedron():
    assert len(sc.FACES) == 20
    for c, a, b in sc.FACES:
        assert all(abs(sc._dot(u, u) - 1) < 1e-12 for u in (c, a, b)) and abs(sc._dot(a, b)) + abs(sc._dot(a, c)) + abs(sc._dot(b, c)) < 1e-12
        nearest = sorted(sc._dot(c, other[0]) for other in sc.FACES)[-4:-1]
        assert max(nearest) - min(nearest) < 1e-9  # three neighbours, all as far
    assert max(abs(u - v) for u, v in zip(sc.FACES[0][0], direction(*sc.CENTRE), strict=True)) < 1e-12


def test_cells_equal_brute_force_all_over_the_sphere(spark):
    rows = places(400) + [(90, 0), (-90, 17), (0, 180), (0, -180), sc.CENTRE, (51.5, -0.1)]
    for resolution in (0, 3, 5, 9):
        cell = sc.sphere_cell("lat", "lon", resolution)
        got = frame(spark, rows).select("i", *[p.alias(n) for p, n in zip(sc.cell_parts(cell), "vfqr", strict=True)]).collect()
        for row in got:
            assert (row.v, (row.f, row.q, row.r)) == (resolution, brute_cell(*rows[row.i], resolution)), rows[row.i]


def test_centres_lie_in_their_cells_and_near_the_places(spark):
    rows = places(300, 2, ((49.9, 60.9), (-8, 2)))
    cell = sc.sphere_cell("lat", "lon", 5)
    lat, lon = sc.cell_centre("cell")
    got = frame(spark, rows).withColumn("cell", cell).select("i", "cell", lat.alias("lat"), lon.alias("lon"))
    got = got.withColumn("again", sc.sphere_cell("lat", "lon", 5)).collect()
    for row in got:
        assert row.again == row.cell
        far = math.acos(min(1, sc._dot(direction(row.lat, row.lon), direction(*rows[row.i])))) * sc.EARTH_KM
        assert far < 1.05 * sc.edge_of(5) * sc.EARTH_KM


def test_areas_are_equal_over_the_country(spark):
    """The projection's area scale is 1 everywhere; and cells that lie well
    inside a box hold about the same number of evenly spread places."""
    c, a, b = sc.FACES[0]

    def plane(lat, lon):
        p = direction(lat, lon)
        stretch = math.sqrt(2 / (1 + sc._dot(p, c)))
        return sc._dot(p, a) * stretch, sc._dot(p, b) * stretch

    step = 1e-5
    for lat, lon in places(200, 3, ((49.9, 60.9), (-8, 2))):
        (x0, y0), (x1, y1), (x2, y2) = plane(lat, lon), plane(lat + step, lon), plane(lat, lon + step)
        area = abs((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)) / (math.radians(step) ** 2 * math.cos(math.radians(lat)))
        assert abs(area - 1) < 1e-4
    df = spark.range(400_000).select(
        F.degrees(F.asin(F.rand(1) * (math.sin(math.radians(58)) - math.sin(math.radians(51))) + math.sin(math.radians(51)))).alias("lat"),
        (F.rand(2) * 7 - 6).alias("lon"))
    counts = df.groupBy(sc.sphere_cell("lat", "lon", 4).alias("cell")).count()
    lat, lon = sc.cell_centre("cell")
    inside = counts.select("count", lat.alias("lat"), lon.alias("lon")).filter("lat between 51.6 and 57.4 and lon between -5 and 0").collect()
    sizes = [r["count"] for r in inside]
    assert len(sizes) > 60 and max(sizes) < 1.15 * sum(sizes) / len(sizes) and min(sizes) > 0.85 * sum(sizes) / len(sizes)


def test_parents_nest(spark):
    df = frame(spark, places(4000, 5, ((50, 59), (-7, 2)))).withColumn("c7", sc.sphere_cell("lat", "lon", 7))
    df = df.withColumn("p6", sc.cell_parent("c7", 6)).withColumn("p5", sc.cell_parent("c7", 5)).withColumn("p4", sc.cell_parent("c7", 4))
    assert df.filter(sc.cell_parent("p6", 5) != F.col("p5")).count() == 0
    assert df.filter(sc.cell_parent("p5", 4) != F.col("p4")).count() == 0
    assert df.select(sc.cell_parts("p4")[0]).distinct().collect() == [(4,)]
    assert df.groupBy("p4").count().agg(F.sum("count")).first()[0] == 4000
    # Mostly the ancestor is the place's own cell; near its edge it may lie next door.
    assert df.filter(sc.sphere_cell("lat", "lon", 4) == F.col("p4")).count() > 0.7 * 4000
    # The children of a cell: the one around its centre and the six next to it.
    grid = spark.range(-12, 13).select(F.col("id").alias("q")).crossJoin(spark.range(-12, 13).select(F.col("id").alias("r")))
    cells = grid.select(sc._packed(6, F.lit(3), F.col("q"), F.col("r")).alias("cell")).withColumn("p", sc.cell_parent("cell", 5))
    spots = [("cell", "c"), ("p", "d")]
    for column, tag in spots:
        lat, lon = sc.cell_centre(column)
        cells = cells.withColumns({f"{tag}lat": lat, f"{tag}lon": lon})
    far = []
    for row in cells.collect():
        cosine = sc._dot(direction(row.clat, row.clon), direction(row.dlat, row.dlon))
        far.append(math.acos(min(1.0, cosine)) / (math.sqrt(3) * sc.edge_of(6)))
    assert all(d < 1e-3 or abs(d - 1) < 0.02 for d in far) and 0.1 < sum(d < 1e-3 for d in far) / len(far) < 0.2
    full = cells.groupBy("p").count().filter((F.abs(sc.cell_parts("p")[2]) <= 2) & (F.abs(sc.cell_parts("p")[3]) <= 2)).collect()
    assert len(full) == 25 and {r["count"] for r in full} == {7}
    assert df.select(sc.cell_parent("c7", 7), sc.cell_parent("c7", 9)).distinct().collect() == [(None, None)]


def test_unknown_places_have_no_cell(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, None), (math.nan, 1.0), (1.0, math.inf), (91.0, 0.0), (50.0, 361.0)], "lat double, lon double")
    got = [r[0] for r in df.select(sc.sphere_cell("lat", "lon", 5)).collect()]
    assert got[:5] == [None] * 5 and got[5] is not None
