"""Interpolation and superposition over point sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundswell import schema as S
from groundswell.functions.columns import expected_pressure_kpa, mogi_uplift_m, ramp_colour
from groundswell.plans.shared import materialize, parallelism

BLOCK = 4096
SALTS = 16
PACKED = 1024  # spots of a tile that are packed into one row
MAX_DEPTH = 24  # cuts of a tile; the last cells are 2**-24 of it


def _tile(coord: Column | str, size: float) -> Column:
    return F.floor((F.col(coord) if isinstance(coord, str) else coord) / F.lit(size))


def _d2(p: Column) -> Column:
    dx, dy = p["x"] - F.col("x"), p["y"] - F.col("y")
    return dx * dx + dy * dy


def _copies(points: DataFrame, size: float) -> DataFrame:
    """Each point in its own tile and the eight around it (`tx, ty`)."""
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return (
        points.select("*", F.explode(around).alias("_dx"))
        .select("*", F.explode(around).alias("_dy"))
        .withColumns({"tx": _tile("x", size) + F.col("_dx"), "ty": _tile("y", size) + F.col("_dy")})
        .drop("_dx", "_dy")
    )


def idw_interpolate(
    survey: DataFrame, places: DataFrame, power: float = S.IDW_POWER, radius: float = S.IDW_RADIUS_M
) -> DataFrame:
    """Inverse-distance mean of the survey within `radius` of each distinct place (`site_id, x, y, …`).

    A point that coincides with the place gives its value (the first surveyed
    wins); without any point in reach `uplift` is null.

    Survey cells are copied into the tiles around them, so a place needs one
    equi-join on its own tile.  At most one cell per square metre bounds what a place
    meets, and the pairs are summed up in the stage that makes them.  The tile stays
    in the grouping key: a shuffled join needs no second shuffle.
    """
    cells = _copies(survey.select("site_id", "x", "y", "uplift", "first_seq"), radius).withColumnsRenamed({"x": "px", "y": "py"})
    tiled = places.withColumns({"tx": _tile("x", radius), "ty": _tile("y", radius)})
    dx, dy = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    d2 = dx * dx + dy * dy
    q, c = tiled.alias("q"), cells.alias("c")
    same = (F.col("q.site_id") == F.col("c.site_id")) & (F.col("q.tx") == F.col("c.tx")) & (F.col("q.ty") == F.col("c.ty"))
    near = q.join(c, same & (d2 <= radius * radius), "left").select(
        "q.*", "c.uplift", "c.first_seq", d2.alias("d2"), (d2 < S.IDW_HIT_D2).alias("hit")
    )
    weight = F.when(~F.col("hit"), 1.0 / (F.col("d2") if power == 2 else F.pow("d2", F.lit(power / 2))))
    sums = near.groupBy(*tiled.columns).agg(
        F.min_by(F.when(F.col("hit"), F.col("uplift")), F.when(F.col("hit"), F.col("first_seq"))).alias("_hit"),
        F.sum(weight * F.col("uplift")).alias("_num"),
        F.sum(weight).alias("_den"),
    )
    return sums.select(*places.columns, F.coalesce("_hit", F.col("_num") / F.col("_den")).alias("uplift"))


def grid_cells(bounds: DataFrame, cell_m: int = 1) -> DataFrame:
    """The cells (`site_id, x0, y0` and centre `x, y`) that cover each site's bounds.

    Columns of cells are spread over the cluster before they are filled, so a wide
    site is not one task's work.
    """

    def steps(low: str, high: str) -> Column:
        # From floor(low), in steps, while strictly below high.
        n = F.ceil((F.col(high) - F.floor(low)) / F.lit(cell_m))
        return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.floor(low) + i * cell_m)

    columns = bounds.select("*", F.explode(steps("min_x", "max_x")).alias("x0"))
    # A number of its own, because these few bytes stand for much work.
    columns = columns.repartition(parallelism(bounds.sparkSession), "site_id", "x0")
    cells = columns.select("site_id", "x0", F.explode(steps("min_y", "max_y")).alias("y0"))
    half = cell_m / 2
    return cells.select("site_id", "x0", "y0", (F.col("x0") + half).alias("x"), (F.col("y0") + half).alias("y"))


def cells_in_reach(survey: DataFrame, bounds: DataFrame, radius: float = S.IDW_RADIUS_M) -> DataFrame:
    """The one-metre cells inside the site's bounds whose centre lies in a tile next to a reading's.

    Their number follows the survey, not the area that an outlier spans.
    """
    tiles = _copies(survey.select("site_id", "x", "y"), radius).select("site_id", "tx", "ty").distinct()
    # A number of its own, because these few bytes stand for much work.
    tiles = tiles.repartition(parallelism(survey.sparkSession), "site_id", "tx", "ty")

    def steps(tile: str) -> Column:
        # Cells whose centre is in the tile.
        return F.sequence(F.ceil(F.col(tile) * radius - 0.5), F.ceil((F.col(tile) + 1) * radius - 0.5) - 1)

    cells = tiles.select("site_id", "ty", F.explode(steps("tx")).alias("x0")).select("site_id", "x0", F.explode(steps("ty")).alias("y0"))
    # x0 >= floor(min_x), without taking the floor of a far bound.
    inside = [(F.col(c) > F.col(low) - 1) & (F.col(c) < F.col(high)) for c, low, high in (("x0", "min_x", "max_x"), ("y0", "min_y", "max_y"))]
    cells = cells.join(bounds, "site_id").where(inside[0] & inside[1])
    return cells.select("site_id", "x0", "y0", (F.col("x0") + 0.5).alias("x"), (F.col("y0") + 0.5).alias("y"))


def uplift_grid(survey: DataFrame, bounds: DataFrame, scale: DataFrame, dark: bool = False) -> DataFrame:
    """Interpolated uplift and colour of every cell in reach of a reading.

    Readings beyond 2**52 m have no cells: one-metre centres cannot be told apart there.
    """
    survey = survey.where((F.abs("x") < 2.0**52) & (F.abs("y") < 2.0**52))
    cells = idw_interpolate(survey, cells_in_reach(survey, bounds)).where(F.col("uplift").isNotNull())
    return cells.join(scale, "site_id").select(
        "site_id", "x0", "y0", "uplift", ramp_colour(F.col("uplift") / F.col("max_uplift"), dark).alias("colour")
    )


def nearest_robot(latest: DataFrame, queries: DataFrame, limit: float = S.PICK_LIMIT_M) -> DataFrame:
    """Nearest robot closer than `limit`, or null; of equal distances the lowest id.

    Robots on one spot count as their lowest id.  The robots around a tile are packed
    into one row, so a query meets one row and no pairs are made.

    A tile with more than PACKED spots is cut into quarters until none is, and its neighbours see its cells instead
    of its spots.  A query keeps the cells that may hold its nearest robot: those no farther than the least distance within
    which some cell surely has one.  Only those cells' quarters, and at last their spots, are looked at.
    """
    spots = latest.groupBy("site_id", F.col("x_m").alias("x"), F.col("y_m").alias("y")).agg(F.min("robot_id").alias("robot_id"))
    crowded = spots.groupBy("site_id", _tile("x", limit).alias("tx"), _tile("y", limit).alias("ty")).agg(F.count("*").alias("n"))
    crowded = crowded.where(F.col("n") > PACKED).select("site_id", "tx", "ty")
    if crowded.isEmpty():
        return _with_nearest(queries, _packed_spots(spots, limit), limit)
    crowded = materialize(crowded, "crowded-tiles")
    own = ["site_id", "tx", "ty"]
    tiled = spots.withColumns({"tx": _tile("x", limit), "ty": _tile("y", limit)})
    sparse = tiled.join(crowded, own, "left_anti").drop("tx", "ty")
    dense = materialize(tiled.join(crowded, own, "left_semi").drop("tx", "ty"), "crowded-spots")
    key = fresh_name(queries, "_query")
    asked = materialize(queries.select("*", F.monotonically_increasing_id().alias(key)), "queries")  # written, so the numbers stay
    first = materialize(_with_nearest(asked, _packed_spots(sparse, limit), limit), "nearest-of-sparse")
    found = _best_first(first.select(key, "site_id", "x", "y", "distance_m"), dense, key, limit)
    both = first.join(found, key, "left")
    closer = F.col("_d").isNotNull() & (
        F.col("distance_m").isNull() | (F.struct("_d", "_robot") < F.struct("distance_m", "robot_id"))
    )
    pick = lambda new, old: F.when(closer, F.col(new)).otherwise(F.col(old)).alias(old)
    return both.select(*queries.columns, pick("_robot", "robot_id"), pick("_d", "distance_m"))


def fresh_name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def _packed_spots(spots: DataFrame, limit: float) -> DataFrame:
    return _copies(spots, limit).groupBy("site_id", "tx", "ty").agg(F.collect_list(F.struct("robot_id", "x", "y")).alias("near"))


def _with_nearest(queries: DataFrame, near: DataFrame, limit: float) -> DataFrame:
    tiled = queries.withColumns({"tx": _tile("x", limit), "ty": _tile("y", limit)})
    ranked = F.transform("near", lambda p: F.struct(F.sqrt(_d2(p)).alias("d"), p["robot_id"].alias("robot_id")))
    best = F.array_min(F.filter(ranked, lambda p: p["d"] < limit))
    return tiled.join(near, ["site_id", "tx", "ty"], "left").withColumn("_best", best).select(
        *queries.columns, F.col("_best.robot_id").alias("robot_id"), F.col("_best.d").alias("distance_m")
    )


def _best_first(asked: DataFrame, dense: DataFrame, key: str, limit: float) -> DataFrame:
    """`(key, _d, _robot)`: the nearest of the crowded spots closer than `limit` and than what the query already has."""
    cell = ["site_id", "cx", "cy"]

    def cells(size: float) -> DataFrame:
        return dense.groupBy("site_id", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")).agg(F.count("*").alias("n"))

    def bounds(size: float) -> tuple[Column, Column]:
        """Least and largest distance from the query to a point of the cell."""
        gaps, reach = [], []
        for at, c in (("x", "cx"), ("y", "cy")):
            low, high = F.col(c) * size, (F.col(c) + 1) * size
            gaps.append(F.greatest(low - F.col(at), F.col(at) - high, F.lit(0.0)))
            reach.append(F.greatest(F.abs(F.col(at) - low), F.abs(F.col(at) - high)))
        return (F.sqrt(g[0] * g[0] + g[1] * g[1]) for g in (gaps, reach))

    size, steps = limit, F.array(*[F.lit(k) for k in (-1, 0, 1)])
    asks = asked.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    asks = asks.withColumn("cx", F.floor(F.col("x") / size) + F.col("_dx")).withColumn("cy", F.floor(F.col("y") / size) + F.col("_dy"))
    asks = asks.drop("_dx", "_dy")
    ready = None
    for _ in range(MAX_DEPTH):
        near, far = bounds(size)
        level = asks.join(cells(size), cell).withColumns({"_near": near, "_far": far})
        least = level.groupBy(key).agg(F.min("_far").alias("_within"))
        slack = 1e-9 * limit
        level = level.join(least, key).where(F.col("_near") <= F.least("_within", F.coalesce("distance_m", F.lit(limit))) + slack)
        level = materialize(level.select(*asked.columns, "cx", "cy", "n"), "candidate-cells")
        small = level.where(F.col("n") <= PACKED).withColumn("size", F.lit(size)).drop("n")
        ready = small if ready is None else ready.unionByName(small)
        large = level.where(F.col("n") > PACKED).drop("n")
        if large.isEmpty():
            break
        half = F.array(F.lit(0), F.lit(1))
        asks = large.withColumn("_dx", F.explode(half)).withColumn("_dy", F.explode(half))
        asks = asks.withColumns({"cx": F.col("cx") * 2 + F.col("_dx"), "cy": F.col("cy") * 2 + F.col("_dy")}).drop("_dx", "_dy")
        size /= 2
    else:  # spots that no cut tells apart are looked at one by one
        ready = ready.unionByName(large.withColumn("size", F.lit(2 * size)))
    # Each size's spots under their own cells; a query meets PACKED spots of a cell at most.
    sizes = [r["size"] for r in ready.select("size").distinct().collect()]  # at most MAX_DEPTH
    spots = None
    for s in sizes:
        part = dense.withColumns({"size": F.lit(s), "cx": F.floor(F.col("x") / s), "cy": F.floor(F.col("y") / s)})
        part = part.select("site_id", "size", "cx", "cy", F.struct("robot_id", "x", "y").alias("p"))
        spots = part if spots is None else spots.unionByName(part)
    pairs = ready.join(spots, ["site_id", "size", "cx", "cy"]).withColumn("_d", F.sqrt(_d2(F.col("p"))))
    best = pairs.where(F.col("_d") < limit).groupBy(key).agg(F.min(F.struct("_d", F.col("p.robot_id").alias("_robot"))).alias("b"))
    return best.select(key, "b._d", "b._robot")


def uplift_field(points: DataFrame, injections: DataFrame) -> DataFrame:
    """Surface uplift in mm at each distinct point (`site_id, x, y, …`) from all injections of its site.

    There is no cut-off radius: every source counts at every point.  Lift is linear
    in volume, so injections into one place and depth add up first.  The remaining
    sources of a site are packed into blocks of about BLOCK; a point meets one row per
    block, and the sum over a block runs inside an expression, so no pairs are made.
    Points are salted against one site holding most of them.
    """
    sources = injections.groupBy("site_id", "x", "y", "depth_m").agg(F.sum("volume_m3").alias("volume_m3"))
    sizes = sources.groupBy("site_id").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
    blocks = (
        sources.join(sizes, "site_id")
        .groupBy("site_id", F.pmod(F.xxhash64("x", "y", "depth_m"), F.col("blocks")).alias("block"))
        .agg(F.collect_list(F.struct("x", "y", "depth_m", "volume_m3")).alias("sources"))
        .select("site_id", "sources", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )

    def lift(acc: Column, p: Column) -> Column:
        return acc + mogi_uplift_m(p["volume_m3"] * S.VOLUME_EFFICIENCY, p["depth_m"], _d2(p))

    places = points.columns
    spread = points.repartition(parallelism(points.sparkSession), "site_id", "x", "y")
    salted = spread.withColumn("salt", F.pmod(F.xxhash64("x", "y"), F.lit(SALTS)).cast("int"))
    part = F.aggregate("sources", F.lit(0.0), lift)
    return (
        salted.join(blocks, ["site_id", "salt"], "left")
        .withColumn("part", F.coalesce(part, F.lit(0.0)))
        .groupBy(*places)
        .agg((F.sum("part") * 1000.0 + 0.0).alias("uplift_mm"))
    )


def all_injections(wells: DataFrame) -> DataFrame:
    """Completed wells and those in progress that have taken any volume, in cubic metres."""
    active = (F.col("status") == "active") & (F.col("injected_l") > 0)
    used = wells.where((F.col("status") == "completed") | active)
    return used.select("site_id", "x", "y", "depth_m", (F.col("injected_l") / 1000.0).alias("volume_m3"))


def injected_volume(wells: DataFrame) -> DataFrame:
    """Per site: volume in the ground, wells done and wells planned."""
    return wells.groupBy("site_id").agg(
        (F.sum("injected_l") / 1000.0).alias("total_m3"),
        F.count_if(F.col("status") == "completed").alias("wells_done"),
        F.count("*").alias("wells_total"),
    )


def pressure_residual(df: DataFrame, filled: Column) -> DataFrame:
    """Measured pressure against the pressure the model expects, per sample."""
    expected = expected_pressure_kpa("depth_m", "flow_rate_lpm", filled)
    return df.select(
        "seq", "robot_id", "ts", expected.alias("expected_kpa"), (F.col("injection_pressure_kpa") - expected).alias("residual_kpa")
    )
