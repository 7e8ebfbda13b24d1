"""Variable-density sampling of grid cells, masks as text, thinning and filling."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.scratch import materialize


def uniform(seed: int, *keys: str) -> Column:
    """A repeatable number in (0, 1) for each key."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1))


def density(cells: DataFrame, x: str, y: str, centre: tuple[float, float], core: float, radius: float, power: float = 2.0, kind: str = "ellipse", given: str | None = None) -> DataFrame:
    """Adds density: distance to the centre over the largest; -1 where fully sampled, -2 outside.

    kind: ellipse (core block inside, nothing beyond radius), block (core block, no outside), point (only the cells
    nearest to the centre are fully sampled), none (distances only), given (a column of densities, core block applied).
    """
    dx, dy = F.abs(F.col(x) - centre[0]), F.abs(F.col(y) - centre[1])
    d = F.pow(F.pow(dx, F.lit(power)) + F.pow(dy, F.lit(power)), F.lit(1 / power))
    top = cells.agg(F.max(d).alias("_top"), F.min(d).alias("_low"))  # one row
    inside = (dx < core) & (dy < core)
    scaled = d / F.col("_top")
    value = {
        "ellipse": F.when(inside, -1.0).when(d > radius, -2.0).otherwise(scaled),
        "block": F.when(inside, -1.0).otherwise(scaled),
        "point": F.when(d <= F.col("_low"), -1.0).otherwise(scaled),
        "none": scaled,
        "given": F.when(inside, -1.0).otherwise(F.col(given or x).cast("double")),
    }[kind]
    return cells.crossJoin(F.broadcast(top)).withColumn("density", value).drop("_top", "_low")


def weighted_sample(cells: DataFrame, keys: list[str], density_col: str, n: int, seed: int, phase: str | None = None) -> DataFrame:
    """The core and, up to n cells, others drawn without replacement with weight (1 - density)³; independent per phase."""
    key = -F.log(uniform(seed, *keys, *([phase] if phase else []))) / F.pow(1 - F.col(density_col), F.lit(3.0))
    ranked = cells.where(F.col(density_col) != -2).withColumn("_k", F.when(F.col(density_col) == -1, F.lit(-1.0)).when(F.col(density_col) >= 1, F.lit(float("inf"))).otherwise(key))
    if phase is None:
        return ranked.orderBy("_k", *keys).limit(n).drop("_k")
    w = Window.partitionBy(phase).orderBy("_k", *keys)
    return ranked.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_k", "_r")


def jittered_rect(cells: DataFrame, x: str, y: str, centre: tuple[float, float], tolerance: float, jitter: float, seed: int) -> DataFrame:
    """Cells whose jittered distance stays below tolerance on both axes; the centre always stays."""
    tests = [F.abs(F.col(c) - m) + jitter * uniform(seed + i, x, y) < tolerance for i, (c, m) in enumerate(((x, centre[0]), (y, centre[1])))]
    middle = (F.abs(F.col(x) - centre[0]) < 1) & (F.abs(F.col(y) - centre[1]) < 1)
    return cells.where((tests[0] & tests[1]) | middle)


def separable_sample(cells: DataFrame, x: str, y: str, extent: float, n: int, core_share: float, seed: int) -> DataFrame:
    """n cells: the nearest core_share of them to the centre, the rest drawn with weights (1 - |d|)² on both axes."""
    dx, dy = (F.abs(2 * F.col(c) / extent - 1) for c in (x, y))
    near = cells.withColumn("_d", dx * dx + dy * dy).orderBy("_d", x, y).limit(round(n * core_share)).select(x, y, F.lit(-1.0).alias("_c"))
    weight = F.pow(F.greatest(1 - dx, F.lit(1e-6)), F.lit(2.0)) * F.pow(F.greatest(1 - dy, F.lit(1e-6)), F.lit(2.0))
    return cells.join(near, [x, y], "left").withColumn("_k", F.coalesce("_c", -F.log(uniform(seed, x, y)) / weight)).orderBy("_k", x, y).limit(n).drop("_k", "_c")


def poisson_disc(cells: DataFrame, x: str, y: str, radius: str, seed: int, rounds: int = 60) -> DataFrame:
    """A maximal set of cells no two of which are nearer than the larger of their radii.

    Rounds: a cell that has the least random priority among its open neighbours stays, its neighbours go. Neighbours meet by
    grid cells of the largest radius.
    """
    width = cells.agg(F.max(radius)).first()[0] or 1.0
    rows = materialize(cells.select(x, y, radius, F.xxhash64(F.lit(seed), x, y).alias("p"), F.lit(None).cast("boolean").alias("kept")), "disc")
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    for _ in range(rounds):
        live = rows.where("kept is null")
        if live.isEmpty():
            return rows.where("kept").select(x, y, radius)
        at = [F.floor(F.col(c) / width) for c in (x, y)]
        own = live.select(F.col(x).alias("ax"), F.col(y).alias("ay"), F.col(radius).alias("ar"), F.col("p").alias("ap"), at[0].alias("i"), at[1].alias("j"))
        sent = live.withColumn("s", F.explode(around)).select(F.col(x).alias("bx"), F.col(y).alias("by"), F.col(radius).alias("br"), F.col("p").alias("bp"), (at[0] + F.col("s.i")).alias("i"), (at[1] + F.col("s.j")).alias("j"))
        d2 = F.pow(F.col("ax") - F.col("bx"), F.lit(2)) + F.pow(F.col("ay") - F.col("by"), F.lit(2))
        pairs = own.join(sent, ["i", "j"]).where((d2 < F.pow(F.greatest("ar", "br"), F.lit(2))) & ((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by"))))
        pairs = materialize(pairs.select("ax", "ay", "ap", "bx", "by", "bp"), "near")
        beaten = pairs.where(F.struct("bp", "bx", "by") < F.struct("ap", "ax", "ay")).select(F.col("ax").alias("_x"), F.col("ay").alias("_y")).distinct()
        winners = live.join(beaten, (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y")), "left_anti").select(F.col(x).alias("wx"), F.col(y).alias("wy"))
        losers = pairs.join(winners, (F.col("bx") == F.col("wx")) & (F.col("by") == F.col("wy")), "left_semi").select(F.col("ax").alias("lx"), F.col("ay").alias("ly")).distinct().withColumn("_l", F.lit(True))
        rows = rows.join(winners.withColumn("_w", F.lit(True)), (F.col(x) == F.col("wx")) & (F.col(y) == F.col("wy")), "left").join(losers, (F.col(x) == F.col("lx")) & (F.col(y) == F.col("ly")), "left")
        rows = materialize(rows.select(x, y, radius, "p", F.coalesce("kept", F.when(F.col("_w"), True).when(F.col("_l"), False)).alias("kept")), "disc")
    raise RuntimeError("thinning isn't settled")


def partial_fourier(df: DataFrame, axis: str, size: int, share: float) -> DataFrame:
    return df.where(F.col(axis) < size * share)


def acceleration(mask: DataFrame, bit: str) -> DataFrame:
    """Cells over sampled cells, one row."""
    return mask.agg((F.count("*") / F.sum(bit)).alias("acceleration"))


def calibration_box(mask: DataFrame, x: str, y: str, bit: str, width: int, height: int, outliers: float = 0.0) -> DataFrame:
    """(low_x, high_x, low_y, high_y): the largest centred box that is sampled but for a share of outliers; a negative share gives the full extent.

    Both axes grow by one cell in turn until that fails; each test reads one aggregate of the mask by distance from the
    centre, which the driver holds: (width / 2) times (height / 2) counts, of 16 million at most.
    """
    if outliers < 0:
        return mask.sparkSession.createDataFrame([(0, width - 1, 0, height - 1)], "low_x int, high_x int, low_y int, high_y int")
    if width * height > 64_000_000:
        raise ValueError("the grid is too large for one driver")
    ring = mask.where(F.col(bit) == 1).select(F.greatest(F.ceil(F.abs(F.col(x) - (width - 1) / 2) + 0.5), F.lit(1)).cast("int").alias("i"), F.greatest(F.ceil(F.abs(F.col(y) - (height - 1) / 2) + 0.5), F.lit(1)).cast("int").alias("j")).groupBy("i", "j").agg(F.count("*").alias("n"))
    counts = np.zeros((width + 2, height + 2))
    for r in ring.collect():  # a quarter of the grid
        counts[r["i"], r["j"]] += r["n"]
    inside = counts.cumsum(0).cumsum(1)
    i = j = 0
    grow = [True, True]
    while any(grow):
        for axis in (0, 1):
            a, b = i + (axis == 0), j + (axis == 1)
            if grow[axis] and 2 * a <= width and 2 * b <= height and (min(a, b) == 0 or inside[a, b] >= (1 - outliers) * 4 * a * b):
                i, j = a, b
            else:
                grow[axis] = False
    return mask.sparkSession.createDataFrame([(width // 2 - i, width // 2 + i - 1, height // 2 - j, height // 2 + j - 1)], "low_x int, high_x int, low_y int, high_y int")


def mask_text(mask: DataFrame, row: str, col: str, bit: str) -> DataFrame:
    """(row, line): one line of x and - per row."""
    cells = F.array_sort(F.collect_list(F.struct(F.col(col).alias("c"), F.when(F.col(bit) == 1, "x").otherwise("-").alias("s"))))
    return mask.groupBy(F.col(row).alias("row")).agg(F.array_join(F.transform(cells, lambda c: c["s"]), "").alias("line"))


def mask_rows(lines: DataFrame) -> DataFrame:
    """(row, col, bit) of lines of -, x, *, O and 0; any other character raises."""
    cells = lines.select("row", F.posexplode(F.split("line", "")).alias("col", "s")).where("s <> ''")
    bit = F.when(F.col("s") == "-", 0).when(F.col("s").isin("x", "*", "O", "0"), 1).otherwise(F.raise_error(F.concat(F.lit("unknown mask character "), F.col("s"))).cast("int"))
    return cells.select("row", "col", bit.alias("bit"))


def inpaint(grid: DataFrame, x: str, y: str, value: str, rounds: int = 100) -> DataFrame:
    """Fills missing cells by weighted means of known neighbours, round by round, until none that can be reached is missing."""
    from .grid import neighbours_2d

    rows = materialize(grid.select(x, y, value), "grid")
    for _ in range(rounds):
        missing = rows.where(F.col(value).isNull()).select(x, y)
        known = neighbours_2d(rows.where(F.col(value).isNotNull()), x, y)
        weight = 1 / F.sqrt((F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).cast("double"))
        fill = known.join(missing, [x, y], "left_semi").groupBy(x, y).agg((F.sum(weight * F.col(value)) / F.sum(weight)).alias("_f"))
        if missing.isEmpty() or fill.isEmpty():
            return rows
        rows = materialize(rows.join(fill, [x, y], "left").select(x, y, F.coalesce(value, "_f").alias(value)), "grid")
    raise RuntimeError("cells are still missing")


def merge_by_information(counts: DataFrame, cls: str, feature: str, n: str, most: int = 2_000) -> DataFrame:
    """(node, parent, loss): merges the two feature values that lose the least information about the class, until one is left.

    Each merge depends on those before it, so they run on the driver, over the contingency table of at most `most` feature
    values (more raise); counting is Spark's. Ties go to smaller nodes.
    """
    if counts.select(feature).distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} values of {feature}")
    table = counts.groupBy(feature).pivot(cls).agg(F.sum(n)).na.fill(0).orderBy(feature).collect()  # at most `most` rows
    names = [str(r[0]) for r in table]
    p = np.array([[float(v) for v in r[1:]] for r in table])
    p /= p.sum()
    nodes, out = {name: row for name, row in zip(names, p, strict=True)}, []
    ratio = p.sum(0)

    def information(v: np.ndarray) -> float:
        total = v.sum()
        good = v > 0
        return float((v[good] * np.log2(v[good] / (total * ratio[good]))).sum()) if total > 0 else 0.0

    own = {name: information(row) for name, row in nodes.items()}

    def pair(a: str, b: str) -> tuple[float, str, str]:
        return round(own[a] + own[b] - information(nodes[a] + nodes[b]), 12), a, b

    heap = [pair(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    heapq.heapify(heap)
    while len(nodes) > 1:
        loss, a, b = heapq.heappop(heap)
        if a not in nodes or b not in nodes:
            continue
        parent = f"node{len(out) // 2:04d}"
        merged = nodes.pop(a) + nodes.pop(b)
        own[parent] = information(merged)
        others = list(nodes)
        nodes[parent] = merged
        for other in others:
            heapq.heappush(heap, pair(other, parent))
        out += [(a, parent, loss), (b, parent, loss)]
    return counts.sparkSession.createDataFrame(out or [(names[0], names[0], 0.0)] if names else [], "node string, parent string, loss double")
