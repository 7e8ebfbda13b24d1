"""Similarity of two measurements of the same keys.

Values are joined on their keys, rescaled to [0, G - 1], and reduced in one aggregation; entropy measures use the joint
histogram, whose G² cells are all that later steps see.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.prefix import global_row_number, prefix_scan
from tessera.plans.scratch import materialize

MOMENTS = ("mse", "nmse", "rmse", "nrmse", "psnr", "zcc", "cc", "tam", "mr", "ssd", "sad", "zsad", "lsad", "agree", "shd", "snr", "psnr3d")
ENTROPIES = ("smi", "snmi", "efinfo", "rmi", "rnmi", "tmi", "tnmi", "ejp")


def rescaled(pairs: DataFrame, a: str, b: str, levels: int = 256) -> DataFrame:
    """Both columns on [0, levels - 1] by their own range."""
    ends = pairs.agg(*(f(c).alias(f"_{n}{c}") for c in (a, b) for n, f in (("lo", F.min), ("hi", F.max))))  # one row

    def scale(c: str) -> Column:
        return F.when(F.col(f"_hi{c}") > F.col(f"_lo{c}"), (F.col(c) - F.col(f"_lo{c}")) / (F.col(f"_hi{c}") - F.col(f"_lo{c}")) * (levels - 1)).otherwise(0.0)

    return pairs.crossJoin(F.broadcast(ends)).withColumns({a: scale(a), b: scale(b)}).select(*pairs.columns)


def moments(pairs: DataFrame, a: str = "a", b: str = "b", levels: int = 256, by: list[str] | None = None) -> DataFrame:
    """All moment measures, one row (or one per group); b is the reference."""
    x, y = F.col(a), F.col(b)
    means = pairs.groupBy(*(by or [])).agg(F.avg(a).alias("_ma"), F.avg(b).alias("_mb"))  # one row per group
    joined = pairs.join(means, by) if by else pairs.crossJoin(F.broadcast(means))
    d, n = x - y, F.count("*")
    mse, sq = F.avg(d * d), F.sum(d * d)
    return joined.groupBy(*(by or [])).agg(
        mse.alias("mse"), (sq / F.sum(y * y)).alias("nmse"), F.sqrt(mse).alias("rmse"), (F.sqrt(mse) / (F.max(F.abs(x)) - F.min(F.abs(x)))).alias("nrmse"),
        (10 * F.log10(F.lit(float(levels * levels)) / mse)).alias("psnr"), (F.sum(x * y) / F.sqrt(F.sum(x * x) * F.sum(y * y))).alias("zcc"), F.corr(a, b).alias("cc"),
        (F.sum(x * y) / (sq + F.sum(x * y))).alias("tam"), F.avg(F.least(x, y)).alias("mr"), (F.sqrt(sq) / n).alias("ssd"), F.avg(F.abs(d)).alias("sad"),
        F.avg(F.abs(d - F.col("_ma") + F.col("_mb"))).alias("zsad"), F.avg(F.abs(x - F.col("_ma") / F.col("_mb") * y)).alias("lsad"),
        F.avg((x == y).cast("int")).alias("agree"), F.avg((x != y).cast("int")).alias("shd"),
        F.when(mse == 0, float("inf")).otherwise(10 * F.log10(F.var_pop(b) / mse)).alias("snr"), (20 * F.log10(F.max(F.abs(y)) / F.sqrt(mse))).alias("psnr3d"),
    )


def medians(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """msd (median squared difference over n), mad (median difference over n) and nssd (of z-scores), one row.

    A median is the mean of the one or two middle rows by a prefix scan, so no task holds all distinct values.
    """
    pairs = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    z = pairs.agg(F.avg(a).alias("_ma"), F.stddev(a).alias("_sa"), F.avg(b).alias("_mb"), F.stddev(b).alias("_sb"), F.count("*").alias("_n"))  # one row
    d = F.col(a) - F.col(b)
    dz = (F.col(a) - F.col("_ma")) / F.col("_sa") - (F.col(b) - F.col("_mb")) / F.col("_sb")
    out = pairs.crossJoin(F.broadcast(z)).agg((F.sqrt(F.sum(dz * dz)) / F.count("*")).alias("nssd"))
    middle = (F.col("_rank") >= F.floor((F.col("_n") + 1) / 2)) & (F.col("_rank") <= F.ceil((F.col("_n") + 1) / 2))
    for name, value in (("msd", d * d), ("mad", d)):
        ranked = global_row_number(pairs.select(value.alias("_v")), [F.asc("_v")], "_rank").crossJoin(F.broadcast(z.select("_n")))
        out = out.crossJoin(ranked.where(middle).agg((F.avg("_v") / F.max("_n")).alias(name)))
    return out.select("msd", "mad", "nssd")


def entropies(joint: DataFrame, r: float = 0.5, q: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Entropy measures of a joint histogram (a, b, n), one row, or one per group."""
    by = by or []
    total = joint.groupBy(*by).agg(F.sum("n").alias("_t"))

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, by) if by else left.crossJoin(F.broadcast(right))  # single rows

    def of(counts: DataFrame, name: str) -> DataFrame:
        p = F.col("n") / F.col("_t")
        return beside(counts, total).groupBy(*by).agg((-F.sum(p * F.log2(p))).alias(f"h{name}"), F.sum(F.pow(p, F.lit(r))).alias(f"r{name}"), F.sum(F.pow(p, F.lit(q))).alias(f"q{name}"), F.sum(p * p).alias(f"e{name}"))

    margins = {c: of(joint.groupBy(*by, c).agg(F.sum("n").alias("n")), c) for c in ("a", "b")}
    one = beside(beside(of(joint, "ab"), margins["a"]), margins["b"])

    def renyi(name: str) -> Column:
        return F.log2(F.col(f"r{name}")) / (1 - r)

    def tsallis(name: str) -> Column:
        return (1 - F.col(f"q{name}")) / (q - 1)

    h = {k: F.col(f"h{k}") for k in ("a", "b", "ab")}
    return one.select(
        *by, (h["a"] + h["b"] - h["ab"]).alias("smi"), ((h["a"] + h["b"]) / h["ab"]).alias("snmi"), (2 * h["ab"] - h["a"] - h["b"]).alias("efinfo"),
        (renyi("a") + renyi("b") - renyi("ab")).alias("rmi"), ((renyi("a") + renyi("b")) / renyi("ab")).alias("rnmi"),
        (tsallis("a") + tsallis("b") - tsallis("ab")).alias("tmi"), ((tsallis("a") + tsallis("b")) / tsallis("ab")).alias("tnmi"), F.col("eab").alias("ejp"),
    )


def f_information(joint: DataFrame, alpha: float = 0.5) -> DataFrame:
    """I, M and chi divergences of the joint histogram from the product of its marginals, one row."""
    total = joint.agg(F.sum("n").alias("_t"))  # one row
    pa = joint.groupBy("a").agg(F.sum("n").alias("na"))
    pb = joint.groupBy("b").agg(F.sum("n").alias("nb"))
    cells = pa.crossJoin(pb).join(joint, ["a", "b"], "left").crossJoin(F.broadcast(total))  # levels² cells
    p, m = F.coalesce("n", F.lit(0)) / F.col("_t"), F.col("na") * F.col("nb") / (F.col("_t") * F.col("_t"))
    ratio = F.pow(p, F.lit(alpha)) / F.pow(m, F.lit(alpha - 1))
    chi = F.pow(F.abs(p - m), F.lit(1 / alpha)) / F.pow(m, F.lit(1 / alpha - 1))
    return cells.agg(((F.sum(ratio) - 1) / (alpha * (alpha - 1))).alias("i_alpha"), F.sum(F.pow(F.abs(F.pow(p, F.lit(alpha)) - F.pow(m, F.lit(alpha))), F.lit(1 / alpha))).alias("m_alpha"), F.sum(chi).alias("chi_alpha"))


def spearman(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rank correlation with mid-ranks, over distinct pairs with their number, so that a frequent value meets its rank once a partner."""
    joint = materialize(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n")), "joint")
    middle = (joint.agg(F.sum("n")).first()[0] or 0) / 2 + 0.5  # mean of all ranks
    ranked = joint
    for c in ("a", "b"):
        counts = prefix_scan(joint.groupBy(F.col(c).alias("_v")).agg(F.sum("n").alias("_n")), [F.asc("_v")], {"_through": "_n"})
        ranked = ranked.join(counts.select(F.col("_v").alias(c), (F.col("_through") - (F.col("_n") - 1) / 2 - middle).alias(f"_r{c}")), c)
    x, y, n = F.col("_ra"), F.col("_rb"), F.col("n")
    return ranked.agg((F.sum(n * x * y) / F.sqrt(F.sum(n * x * x) * F.sum(n * y * y))).alias("spr"))


def kendall(joint: DataFrame) -> DataFrame:
    """Tau-b from a contingency table (a, b, n): concordant and discordant pairs by prefix sums over its cells."""
    from tessera.operators.grid import integral

    rows, cols = joint.select("a").distinct(), joint.select("b").distinct()
    dense = rows.crossJoin(cols).join(joint, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))  # levels² cells
    from pyspark.sql import Window

    s = integral(dense, "a", "b", "n").withColumn("line", F.sum("n").over(Window.partitionBy("a").orderBy("b"))).withColumn("column", F.sum("n").over(Window.partitionBy("b").orderBy("a")))
    whole_b = F.sum("n").over(Window.partitionBy("b"))
    s = s.withColumns({"below": F.col("integral") - F.col("line") - F.col("column") + F.col("n"), "end": F.max("integral").over(Window.partitionBy("a")), "full": F.sum("n").over(Window.partitionBy("a")), "rb": whole_b})
    # smaller a, larger b: all of smaller a, less what is at or below b there
    s = s.withColumn("above", (F.col("end") - F.col("full")) - (F.col("integral") - F.col("line")))
    pairs = s.agg(F.sum(F.col("n") * F.col("below")).cast("double").alias("c"), F.sum(F.col("n") * F.col("above")).cast("double").alias("d"), F.sum("n").cast("double").alias("t"))

    def ties(x: str) -> DataFrame:
        return joint.groupBy(x).agg(F.sum("n").cast("double").alias("m")).agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias(f"t{x}"))

    one = pairs.crossJoin(ties("a")).crossJoin(ties("b"))  # single rows
    n0 = F.col("t") * (F.col("t") - 1) / 2
    return one.select(((F.col("c") - F.col("d")) / F.sqrt((n0 - F.col("ta")) * (n0 - F.col("tb")))).alias("ket"))


def zero_crossings(pairs: DataFrame, key: str, a: str = "a", b: str = "b") -> DataFrame:
    """Sign changes of a - b along the key (zca), and their number by that of the rows (zcr); exact across partitions."""
    numbered = materialize(global_row_number(pairs.select(key, (F.col(a) - F.col(b)).alias("d")), [F.asc(key)], "i"), "numbered")
    joined = numbered.alias("x").join(numbered.select((F.col("i") + 1).alias("i"), F.col("d").alias("e")), "i", "left")
    crossed = F.count_if(F.col("d") * F.col("e") < 0)
    return joined.agg(crossed.alias("zca"), F.try_divide(crossed, F.count("*")).alias("zcr"))


def ssim(pairs: DataFrame, row: str, col: str, a: str = "a", b: str = "b", levels: int = 255, size: int = 11, sigma: float = 1.5, by: list[str] | None = None) -> DataFrame:
    """Mean structural similarity over the area where the Gaussian window fits, one row, or one per group: weighted moments go along columns, then along rows."""
    import math

    half = size // 2
    raw = {i: math.exp(-i * i / (2 * sigma * sigma)) for i in range(-half, half + 1)}
    total = sum(raw.values())
    taps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(v / total).alias("w")) for i, v in raw.items()))
    # the window is a product, so each cell goes to its column's neighbours first and their sums to the rows'
    x, y, w = F.col(a), F.col(b), F.col("_t.w")
    sums = ("mx", "my", "xx", "yy", "xy")
    by = by or []
    across = pairs.withColumn("_t", F.explode(taps)).groupBy(*by, F.col(row).alias("r0"), (F.col(col) + F.col("_t.i")).alias("c")).agg(F.count("*").alias("k0"), *(F.sum(w * v).alias(n) for n, v in zip(sums, (x, y, x * x, y * y, x * y), strict=True)))
    m = across.withColumn("_t", F.explode(taps)).groupBy(*by, (F.col("r0") + F.col("_t.i")).alias("r"), "c").agg(F.sum("k0").alias("k"), *(F.sum(w * F.col(n)).alias(n) for n in sums)).where(F.col("k") == size * size)
    c1, c2 = (0.01 * levels) ** 2, (0.03 * levels) ** 2
    mx, my = F.col("mx"), F.col("my")
    value = ((2 * mx * my + c1) * (2 * (F.col("xy") - mx * my) + c2)) / ((mx * mx + my * my + c1) * (F.col("xx") - mx * mx + F.col("yy") - my * my + c2))
    return m.groupBy(*by).agg(F.avg(value).alias("mssim"), F.count("*").alias("windows"))


def edges(image: DataFrame, value: str) -> DataFrame:
    """(row, col) of the edge cells of a dense image (row, col from 0, value): Sobel gradients with replicated borders, whose
    square is above four times its mean and which is the largest along the axis of the larger component (rising to it or
    level on the side of smaller keys, falling on the other)."""
    from tessera.operators.grid import neighbours_2d

    ends = image.agg(F.max("row").alias("_r"), F.max("col").alias("_c"))  # one row
    sides = image.crossJoin(F.broadcast(ends))
    # each border cell also stands in the frame outside, so that every cell has nine neighbours
    out = F.array(F.lit(0), F.when(F.col("row") == 0, -1), F.when(F.col("row") == F.col("_r"), 1)), F.array(F.lit(0), F.when(F.col("col") == 0, -1), F.when(F.col("col") == F.col("_c"), 1))
    framed = sides.withColumn("_i", F.explode(out[0])).withColumn("_j", F.explode(out[1])).where("_i IS NOT NULL AND _j IS NOT NULL")
    framed = framed.select((F.col("row") + F.col("_i")).alias("row"), (F.col("col") + F.col("_j")).alias("col"), F.col(value).alias("v"))
    near = neighbours_2d(framed, "row", "col")
    gx = F.sum(F.col("dc") * (F.lit(2) - F.abs("dr")) * F.col("v")) / 8
    gy = F.sum(F.col("dr") * (F.lit(2) - F.abs("dc")) * F.col("v")) / 8
    g = near.groupBy("row", "col").agg(F.abs(gx).alias("gx"), F.abs(gy).alias("gy")).join(image.select("row", "col"), ["row", "col"], "left_semi")
    g = materialize(g.withColumn("g", F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")), "gradients")
    cut = g.agg((4 * F.avg("g")).alias("cut"))  # one row
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, -1), (0, 1), (-1, 0), (1, 0))))
    sent = g.select("row", "col", "g", F.explode(steps).alias("s")).select((F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"), "s", "g")
    side = {n: F.max(F.when((F.col("s.i") == i) & (F.col("s.j") == j), F.col("g"))).alias(n) for n, i, j in (("left", 0, 1), ("right", 0, -1), ("up", 1, 0), ("down", -1, 0))}
    around = sent.groupBy("row", "col").agg(*side.values())
    met = g.join(around, ["row", "col"], "left").crossJoin(F.broadcast(cut)).withColumns({n: F.coalesce(n, "g") for n in side})
    slack = 2.220446049250313e-14
    peak = ((F.col("gx") >= F.col("gy") - slack) & (F.col("left") <= F.col("g")) & (F.col("g") > F.col("right"))) | ((F.col("gy") >= F.col("gx") - slack) & (F.col("up") <= F.col("g")) & (F.col("g") > F.col("down")))
    return met.where((F.col("g") > F.col("cut")) & peak).select("row", "col")


def gradient_entropy(pairs: DataFrame, row: str, col: str, a: str = "a", b: str = "b") -> DataFrame:
    """Half the entropies of both images' edges by the entropy of their absolute difference's edges, one row (gre).

    The images are dense from 0 to their largest keys, absent cells being 0. Edge cells share their mass evenly, so an
    entropy is the binary logarithm of their number. Null if the difference has fewer than two edge cells.
    """
    from tessera.operators.grid import dense_cells

    dense = materialize(dense_cells(pairs.select(F.col(row).alias("row"), F.col(col).alias("col"), F.col(a).alias("a"), F.col(b).alias("b")), "row", "col", ["a", "b"]), "image")
    images = {"ha": F.col("a"), "hb": F.col("b"), "hab": F.abs(F.col("a") - F.col("b"))}
    one = None
    for name, image in images.items():
        h = edges(dense.select("row", "col", image.alias("v")), "v").agg(F.log2(F.count("*").cast("double")).alias(name))
        one = h if one is None else one.crossJoin(h)  # single rows
    return one.select(F.try_divide(F.lit(0.5) * (F.coalesce("ha", F.lit(0.0)) + F.coalesce("hb", F.lit(0.0))), F.col("hab")).alias("gre"))


def cropped_psnr(pairs: DataFrame, row: str, col: str, border: int, a: str = "a", b: str = "b", peak: float = 255.0, by: list[str] | None = None) -> DataFrame:
    """PSNR without a border of cells, per group."""
    ends = pairs.agg(F.min(row).alias("_r0"), F.max(row).alias("_r1"), F.min(col).alias("_c0"), F.max(col).alias("_c1"))  # one row
    inner = pairs.crossJoin(F.broadcast(ends)).where((F.col(row) >= F.col("_r0") + border) & (F.col(row) <= F.col("_r1") - border) & (F.col(col) >= F.col("_c0") + border) & (F.col(col) <= F.col("_c1") - border))
    d = F.col(a) - F.col(b)
    return inner.groupBy(*(by or [])).agg((10 * F.log10(F.lit(peak * peak) / F.avg(d * d))).alias("csnr"))


def besov(df: DataFrame, axes: list[str], value: str, levels: int = 3, p: float = 1.0, beta: float = 4 / 9, gamma: float = 4.0) -> DataFrame:
    """Besov norm of a 1-, 2- or 3-D image (keys from 0, absent cells 0), one row.

    Each level halves every axis by the Haar wavelet; all its detail coefficients d give s = (sum of |d|^beta)^(1/beta), the
    last level's approximation counts as one level more; the norm is the gamma-norm of 2^(-level(p + 1/2 - 1/beta)) s.
    """
    low = df.select(*(F.col(k).cast("long").alias(f"k{i}") for i, k in enumerate(axes)), F.col(value).cast("double").alias("v"))
    keys, bands = [f"k{i}" for i in range(len(axes))], range(1 << len(axes))
    scale = 2.0 ** (-len(axes) / 2)

    def sign(band: int):
        out = F.lit(scale)
        for i, k in enumerate(keys):
            if band >> i & 1:
                out = out * (1 - 2 * (F.col(k) % 2))
        return out

    def part(level: int, mass):
        return (F.pow(F.coalesce(mass, F.lit(0.0)), F.lit(1 / beta)) * 2.0 ** (-level * (p + 0.5 - 1 / beta))).alias("s")

    parts = []
    for level in range(1, levels + 1):
        halves = low.groupBy(*(F.shiftright(k, 1).alias(k) for k in keys)).agg(*(F.sum(sign(band) * F.col("v")).alias(f"d{band}") for band in bands))
        halves = materialize(halves, "level")
        parts.append(halves.agg(part(level, F.sum(sum((F.pow(F.abs(f"d{band}"), F.lit(beta)) for band in bands if band), F.lit(0.0))))))
        low = halves.select(*keys, F.col("d0").alias("v"))
    parts.append(low.agg(part(levels + 1, F.sum(F.pow(F.abs("v"), F.lit(beta))))))
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return every.agg(F.pow(F.sum(F.pow("s", F.lit(gamma))), F.lit(1 / gamma)).alias("besov"))
