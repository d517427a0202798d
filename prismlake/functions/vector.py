"""Vector, grid and box functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Boxes that overlap more than this are one; a match needs this cosine.
OVERLAP, MATCH = 0.3, 0.363


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter of both, in double precision."""
    n = F.least(F.size(a), F.size(b))
    part = lambda v: F.slice(v, F.lit(1), n)
    return F.aggregate(F.zip_with(part(a), part(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """v as a vector of length 1; a zero vector stays."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))


def average_hash(pixels: Column) -> Column:
    """Bit i is set if pixel i is at least the mean of the up to 64 whole-number pixels."""
    zero = F.lit(0).cast("long")
    with_sum = F.transform(F.array(F.struct(pixels.alias("px"), F.aggregate(pixels, zero, lambda s, x: s + x).alias("total"))), lambda g: F.aggregate(
        F.transform(g["px"], lambda p, i: F.when(p * F.size(g["px"]) >= g["total"], F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(zero)),
        zero, lambda a, b: a.bitwiseOR(b)))
    return F.element_at(with_sum, 1)  # the total is worked out once a row, not once a pixel


def laplacian_variance(pixels: Column, width: int, height: int) -> Column:
    """Population variance of the 4-neighbour Laplacian over the inside of a grid; whole pixels, row by row; 0 if under 3 wide or high."""
    if width < 3 or height < 3:
        return F.lit(0.0)
    at = [r * width + c for r in range(1, height - 1) for c in range(1, width - 1)]
    px = lambda i: F.element_at(pixels, i.cast("int"))
    lap = F.transform(F.array(*(F.lit(i + 1) for i in at)), lambda i: px(i - 1) + px(i + 1) + px(i - width) + px(i + width) - px(i) * 4)
    n = len(at)
    square = F.aggregate(lap, F.lit(0).cast("long"), lambda s, x: s + x * x)
    total = F.aggregate(lap, F.lit(0).cast("long"), lambda s, x: s + x)
    return (square * n - total * total).cast("double") / float(n * n)


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes (structs x, y, w, h); negative sizes count as 0, and so does an empty union."""
    w, h = (lambda p: F.greatest(p["w"], F.lit(0.0))), (lambda p: F.greatest(p["h"], F.lit(0.0)))
    across = F.greatest(F.least(a["x"] + w(a), b["x"] + w(b)) - F.greatest(a["x"], b["x"]), F.lit(0.0))
    down = F.greatest(F.least(a["y"] + h(a), b["y"] + h(b)) - F.greatest(a["y"], b["y"]), F.lit(0.0))
    both = across * down
    union = w(a) * h(a) + w(b) * h(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def keep_best(boxes: Column, overlap: float = OVERLAP) -> Column:
    """Greedy choice from boxes (structs score, x, y, w, h): best score first, none that overlaps a kept one by more; NaN scores go first out."""
    usable = F.filter(boxes, lambda d: ~F.isnan(d["score"]))
    ordered = F.array_sort(usable, lambda p, q: F.when(p["score"] > q["score"], -1).when(p["score"] < q["score"], 1).otherwise(0))
    none = F.slice(ordered, 1, 0)
    return F.aggregate(ordered, none, lambda kept, d: F.when(F.exists(kept, lambda k: iou(k, d) > overlap), kept).otherwise(F.concat(kept, F.array(d))))


def similarity_transform(source: Column, target: Column) -> Column:
    """a, b, tx, ty of the least-squares map u = a x - b y + tx, v = b x + a y + ty between arrays of (x, y) structs.

    Points that all coincide give no rotation or scale (a = b = 0) and the shift to the target's centre.
    """
    n = F.size(source)
    mean = lambda pts, k: F.aggregate(pts, F.lit(0.0), lambda s, p: s + p[k]) / n
    cx, cy, cu, cv = mean(source, "x"), mean(source, "y"), mean(target, "x"), mean(target, "y")
    zero = F.struct(*(F.lit(0.0).alias(k) for k in "pqs"))
    both = F.zip_with(source, target, lambda s, t: F.struct((s["x"] - cx).alias("x"), (s["y"] - cy).alias("y"), (t["x"] - cu).alias("u"), (t["y"] - cv).alias("v")))
    sums = F.aggregate(both, zero, lambda z, r: F.struct((z["p"] + r["x"] * r["u"] + r["y"] * r["v"]).alias("p"), (z["q"] + r["x"] * r["v"] - r["y"] * r["u"]).alias("q"), (z["s"] + r["x"] * r["x"] + r["y"] * r["y"]).alias("s")))
    a = F.when(sums["s"] > 1e-12, sums["p"] / sums["s"]).otherwise(F.lit(0.0))
    b = F.when(sums["s"] > 1e-12, sums["q"] / sums["s"]).otherwise(F.lit(0.0))
    return F.struct(a.alias("a"), b.alias("b"), (cu - a * cx + b * cy).alias("tx"), (cv - b * cx - a * cy).alias("ty"))
