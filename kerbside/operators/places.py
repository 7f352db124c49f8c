"""Nearest places: a fixed set of markers or road pieces against many positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.geo import haversine_m, local_metres, segment_distance

#: Degrees of a grid cell for place searches.
CELL_DEG = 0.01
#: Fixed value: fewer metres than a degree of latitude has anywhere.
LEAST_DEGREE_M = 110_000.0
#: Degrees of a small cell; twice the way from its middle to a corner, 78.7 m at most, and some for rounding.
SMALL_CELL_DEG, SMALL_CELL_SLACK_M = 0.001, 160.0


def around(within_m: float, lat: Column) -> Column:
    """Steps of cells that a distance reaches, in longitude at a latitude (in latitude at 0)."""
    reach = F.ceil(F.lit(within_m / (CELL_DEG * LEAST_DEGREE_M)) / F.greatest(F.cos(F.radians(lat)), F.lit(0.01))).cast("int")
    return F.sequence(-reach, reach)


def nearest_marker(positions: DataFrame, markers: DataFrame, key: str, within_m: float = 500.0) -> DataFrame:
    """Each position with its nearest marker (ties: the least km) and distance; null beyond within_m.

    Markers are dealt to every grid cell that their circle touches, so a position only meets those near it.
    """
    step = CELL_DEG
    cells = markers.select("*", F.floor(F.col("mlat") / step).alias("_i"), F.floor(F.col("mlon") / step).alias("_j"))
    cells = cells.withColumn("_di", F.explode(around(within_m, F.lit(0.0)))).withColumn("_dj", F.explode(around(within_m, F.abs("mlat") + step)))
    cells = cells.select("marker", "km", "mlat", "mlon", (F.col("_i") + F.col("_di")).alias("_i"), (F.col("_j") + F.col("_dj")).alias("_j"))
    at = positions.withColumns({"_i": F.floor(F.col("lat") / step), "_j": F.floor(F.col("lon") / step)})
    far = haversine_m(F.col("lat"), F.col("lon"), F.col("mlat"), F.col("mlon"))
    best = at.join(cells, ["_i", "_j"]).withColumn("distance", far).where(F.col("distance") <= within_m).groupBy(key).agg(F.min(F.struct("distance", "km", "marker")).alias("b"))
    return positions.join(best, key, "left").select(*positions.columns, "b.marker", "b.km", "b.distance")


def match_road(positions: DataFrame, vertices: DataFrame, key: str, within_m: float = 400.0) -> DataFrame:
    """Each position with the nearest road of vertices (road, ord, lat, lon), or null beyond within_m.

    Road pieces are cut to lengths of a grid cell and dealt to the cells that they reach, so a position
    only meets those near it.
    """
    o = Window.partitionBy("road").orderBy("ord")
    pieces = vertices.select("road", "ord", F.col("lat").alias("alat"), F.col("lon").alias("alon"), F.lead("lat").over(o).alias("blat"), F.lead("lon").over(o).alias("blon")).where("blat IS NOT NULL")
    dlat, dlon = F.col("blat") - F.col("alat"), F.col("blon") - F.col("alon")
    parts = F.greatest(F.ceil(F.greatest(F.abs(dlat), F.abs(dlon)) / CELL_DEG), F.lit(1)).cast("int")
    cut = pieces.withColumn("_n", parts).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    middle = lambda a, d: F.col(a) + d * (F.col("_k") + 0.5) / F.col("_n")
    cut = cut.withColumns({"_i": F.floor(middle("alat", dlat) / CELL_DEG), "_j": F.floor(middle("alon", dlon) / CELL_DEG)})
    # Half a part reaches half a cell beyond its middle's cell, so each side has one step more.
    wide = within_m + CELL_DEG * LEAST_DEGREE_M
    cut = cut.withColumn("_di", F.explode(around(wide, F.lit(0.0)))).withColumn("_dj", F.explode(around(wide, F.abs("alat") + CELL_DEG)))
    cells = cut.select("road", "ord", "alat", "alon", "blat", "blon", (F.col("_i") + F.col("_di")).alias("_i"), (F.col("_j") + F.col("_dj")).alias("_j")).distinct()
    ax, ay = local_metres(F.col("alat"), F.col("alon"), F.col("lat"), F.col("lon"))
    bx, by = local_metres(F.col("blat"), F.col("blon"), F.col("lat"), F.col("lon"))
    d = segment_distance(F.lit(0.0), F.lit(0.0), ax, ay, bx, by)
    at = positions.withColumns({"_i": F.floor(F.col("lat") / CELL_DEG), "_j": F.floor(F.col("lon") / CELL_DEG)})
    near = at.join(cells, ["_i", "_j"]).withColumn("distance", d).where(F.col("distance") <= within_m)
    # Of roads that are equally far to a micrometre the first by name counts.
    best = near.groupBy(key).agg(F.min(F.struct(F.round("distance", 6).alias("distance"), "road", "ord")).alias("b"))
    return positions.join(best, key, "left").select(*positions.columns, "b.road", "b.distance")


def nearest_of_all(positions: DataFrame, markers: DataFrame) -> DataFrame:
    """Each position's nearest marker however far, the lowest km of equals. Markers (marker, km, mlat, mlon) are
    a road's posts: they travel as one array, from which each small cell of the map that has positions takes those
    that can be nearest to a place in it; a position is measured against these only."""
    listed = markers.agg(F.array_sort(F.collect_list(F.struct("km", "marker", "mlat", "mlon"))).alias("_m"))
    away = lambda m: F.struct(F.round(haversine_m(F.col("lat"), F.col("lon"), m["mlat"], m["mlon"]), 6).alias("distance"), m["km"].alias("km"), m["marker"].alias("marker"))
    there = F.col("lat").between(-1000, 1000) & F.col("lon").between(-1000, 1000)  # neither null nor NaN
    at = positions.withColumns({f"_{c}": F.when(there, F.floor(F.col(c) / SMALL_CELL_DEG)) for c in ("lat", "lon")})
    cells = at.select("_lat", "_lon").dropna().distinct().crossJoin(F.broadcast(listed))  # by one row
    off = lambda m: haversine_m((F.col("_lat") + 0.5) * SMALL_CELL_DEG, (F.col("_lon") + 0.5) * SMALL_CELL_DEG, m["mlat"], m["mlon"])
    # A marker without a place has no distance; it stays, as the least of all.
    cells = cells.withColumn("_off", F.transform("_m", off)).withColumn("_most", F.array_min("_off") + SMALL_CELL_SLACK_M)
    near = F.filter("_m", lambda m, k: F.coalesce(F.get("_off", k) <= F.col("_most"), F.lit(True)))
    found = at.join(cells.select("_lat", "_lon", near.alias("_near")), ["_lat", "_lon"], "left").crossJoin(F.broadcast(listed))  # by one row
    found = found.withColumn("_n", F.array_min(F.transform(F.coalesce("_near", "_m"), away)))
    return found.select(*positions.columns, "_n.marker", "_n.km", "_n.distance")


def sampled_road(anchors: DataFrame, steps_a_km: int = 10) -> DataFrame:
    """Places (km, lat, lon) along a road, steps_a_km for each km, on straight lines between its anchors (km, lat,
    lon). Anchors are one road's, some few."""
    o = Window.orderBy("km")
    line = anchors.select("km", "lat", "lon", *(F.lead(c).over(o).alias(f"{c}_b") for c in ("km", "lat", "lon"))).where("km_b > km")
    k = F.explode(F.sequence(F.ceil(F.col("km") * steps_a_km), F.floor(F.col("km_b") * steps_a_km)))
    at = line.withColumn("_k", k).withColumn("_t", (F.col("_k") / steps_a_km - F.col("km")) / (F.col("km_b") - F.col("km")))
    spots = at.select((F.col("_k") / steps_a_km).alias("km"), *((F.col(c) + F.col("_t") * (F.col(f"{c}_b") - F.col(c))).alias(c) for c in ("lat", "lon")))
    return spots.groupBy("km").agg(F.min_by("lat", F.struct("lat", "lon")).alias("lat"), F.min_by("lon", F.struct("lat", "lon")).alias("lon"))


def described(positions: DataFrame, anchors: DataFrame, road: str, on_road_km: float = 0.5) -> DataFrame:
    """Positions with the nearest sampled place of a road, the lowest km of equals: its km and how far, and a label
    that names the road within on_road_km, else the position itself. A position without a place has no label."""
    posts = sampled_road(anchors).select(F.lit(road).alias("marker"), "km", F.col("lat").alias("mlat"), F.col("lon").alias("mlon"))
    at = nearest_of_all(positions, posts).withColumn("distance_km", F.col("distance") / 1000).drop("marker", "distance")
    on = F.coalesce(F.col("distance_km") <= on_road_km, F.lit(False))
    half = lambda c, plus, minus: F.concat(F.format_string("%.4f° ", F.abs(F.col(c))), F.when(F.col(c) < 0, minus).otherwise(plus))
    label = F.when(on, F.concat(F.lit(f"{road} · KM "), F.format_string("%.1f", F.col("km").cast("double")))).otherwise(F.concat_ws(" · ", half("lat", "N", "S"), half("lon", "E", "W")))
    there = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return at.withColumns({"label": F.when(there, label), "on_road": there & on, "km": F.when(there & on, F.col("km")), "distance_km": F.when(there, F.col("distance_km"))})


#: Keys of one place that travel in one row.
KEYS_IN_ROW = 500


def neighbour_pairs(places: DataFrame, key: str, within_m: float = 1500.0, km_apart: float = 4.5, road: str | None = None, digits: int | None = None) -> DataFrame:
    """Pairs of places (key, km, lat, lon, and their road where one is named) near each other along the road
    and on the map; distances are rounded to `digits` if there are any.

    Spots meet by road, km cell and a cell of the map at least as wide as the reach (up to 89 degrees of
    latitude), so of each only those of nine map cells in three km cells are looked at. Keys that share a spot
    share its distances: their pairs are made last, from parts of KEYS_IN_ROW keys or so that are dealt evenly.
    """
    south = within_m / 111_000.0  # no degree of latitude is shorter
    names = ["km", "lat", "lon"]
    spot = ["_road", *names]

    def columns_of(band: Column) -> Column:
        """Cells round the globe in a band, by the narrowest degree of longitude there or in the next ones."""
        return F.greatest(F.lit(1), F.floor(360 / south * F.greatest(F.lit(0.01), F.cos(F.radians((F.abs(band) + 2) * south)))))

    given = places.select(F.col(key).alias("_key"), (F.col(road) if road else F.lit(0)).alias("_road"), *names).dropna()
    spots = given.groupBy(*spot).agg(F.count("*").alias("_n"))
    part = F.pmod(F.xxhash64("_key"), F.ceil(F.col("_n") / KEYS_IN_ROW)).alias("_part")
    held = given.join(spots, spot).groupBy(*spot, part).agg(F.collect_list("_key").alias("_keys"))

    east = lambda band: F.floor((F.col("lon") + 180) / 360 * columns_of(band))
    base = spots.select(*spot, F.floor(F.col("km") / km_apart).alias("_along"), F.floor(F.col("lat") / south).alias("_band"))
    about = lambda c: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: c + k)
    b = base.select("_road", *(F.col(c).alias(f"{c}_b") for c in names), "_along", "_band", F.pmod(east(F.col("_band")), columns_of(F.col("_band"))).alias("_east"))
    a = base.withColumn("_along", F.explode(about(F.col("_along")))).withColumn("_band", F.explode(about(F.col("_band"))))
    beside = F.array_distinct(F.transform(about(east(F.col("_band"))), lambda k: F.pmod(k, columns_of(F.col("_band")))))
    a = a.select("_road", *(F.col(c).alias(f"{c}_a") for c in names), "_along", "_band", F.explode(beside).alias("_east"))
    ends = [F.struct(*(f"{c}_{e}" for c in names)) for e in "ab"]
    far = haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))  # the same both ways
    near = a.join(b, ["_road", "_along", "_band", "_east"]).where((ends[0] <= ends[1]) & (F.abs(F.col("km_a") - F.col("km_b")) <= km_apart)).withColumn("distance", far).where(F.col("distance") <= within_m)
    near = near.withColumns({"distance": F.round("distance", digits) if digits is not None else F.col("distance"), "_same": ends[0] == ends[1]}).drop("_along", "_band", "_east")

    keys_of = lambda e: held.select("_road", *(F.col(c).alias(f"{c}_{e}") for c in names), F.col("_part").alias(f"_part_{e}"), F.col("_keys").alias(f"_keys_{e}"))
    both = near.join(keys_of("a"), ["_road", *(f"{c}_a" for c in names)]).join(keys_of("b"), ["_road", *(f"{c}_b" for c in names)])
    # Rows are few beside the pairs that they stand for, so they are dealt over as many tasks as a shuffle has.
    tasks = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.select("_same", "distance", "_keys_a", "_keys_b").repartition(tasks, F.xxhash64("_keys_a", "_keys_b"))
    # Generated code holds all rows that it makes of one row, and both explodes would be one piece of it. It has no
    # lambdas, so this one makes a row for each key of a, of which the next explode makes KEYS_IN_ROW pairs or so.
    first = dealt.select("_same", "distance", "_keys_b", F.explode(F.transform("_keys_a", lambda x: x)).alias("_x"))
    pairs = first.select("_same", "distance", "_x", F.explode("_keys_b").alias("_y"))
    return pairs.where((F.col("_x") < F.col("_y")) | (~F.col("_same") & (F.col("_y") < F.col("_x")))).select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "distance")
