"""Column functions over boxes: structs of x0, y0, x1, y1 (doubles). An invalid box is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Normalised, so x0 <= x1 and y0 <= y1; null if a coordinate is."""
    whole = F.when(
        x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull(),
        F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1")),
    )
    return whole.cast(BOX)


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), width(b)) * F.greatest(F.lit(0.0), height(b))


def overlap(a: Column, b: Column) -> Column:
    """Area of the intersection."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def overlap_share(a: Column, b: Column) -> Column:
    """Share of a's area within b; 0 for an empty box."""
    return F.when(area(a) > 0, overlap(a, b) / area(a)).otherwise(0.0)


def distance(a: Column, b: Column) -> Column:
    """0 if they touch, infinite if one is missing."""
    dx = F.greatest(a["x0"] - b["x1"], b["x0"] - a["x1"], F.lit(0.0))
    dy = F.greatest(a["y0"] - b["y1"], b["y0"] - a["y1"], F.lit(0.0))
    return F.when(a.isNull() | b.isNull(), F.lit(float("inf"))).otherwise(F.sqrt(dx * dx + dy * dy))


def touches(a: Column, b: Column, grow: float = 0.0) -> Column:
    """Whether the boxes, one grown by `grow` on all sides, meet (edges count)."""
    return (a["x0"] - grow <= b["x1"]) & (a["x1"] + grow >= b["x0"]) & (a["y0"] - grow <= b["y1"]) & (a["y1"] + grow >= b["y0"])


def centre(b: Column) -> tuple[Column, Column]:
    return (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2


def centre_in(a: Column, b: Column, slack: float = 0.0) -> Column:
    x, y = centre(a)
    return x.between(b["x0"] - slack, b["x1"] + slack) & y.between(b["y0"], b["y1"])


def meaningful(b: Column, page_area: Column) -> Column:
    """An image worth keeping: 8 x 8 at least, and 100 or 0.025 % of the page."""
    return (width(b) >= 8) & (height(b) >= 8) & (area(b) >= F.greatest(F.lit(100.0), page_area * 0.00025))


def covers_page(b: Column, page_width: Column, page_height: Column) -> Column:
    return area(b) >= 0.8 * page_width * page_height


def retained_covers_page(b: Column, page_width: Column, page_height: Column) -> Column:
    return (width(b) >= 0.82 * page_width) & (height(b) >= 0.78 * page_height)


def rounded_key(b: Column) -> Column:
    """Rounded x0, y0, y1 (half to even): equal for blocks at one place of many pages."""
    return F.concat_ws(":", *[F.bround(b[k], 0).cast("long").cast("string") for k in ("x0", "y0", "y1")])


def effective_dpi(pixels: Column, points: Column) -> Column:
    return F.when(points > 0, pixels * 72.0 / points)


def fit_scale(w: Column, h: Column, most_w: Column, most_h: Column) -> Column:
    """Scale that fits a frame and never enlarges."""
    return F.least(F.lit(1.0), most_w / w, most_h / h)


def image_area_ratio(areas: Column, page_area: Column) -> Column:
    total = F.aggregate(areas, F.lit(0.0), lambda s, x: s + x)
    return F.when(page_area > 0, F.least(total / page_area, F.lit(1.0))).otherwise(0.0)


def contrast(v: Column) -> Column:
    """Population standard deviation of a numeric array."""
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
    # through an array of one, so that the mean is worked out once and not for each value
    spread = F.transform(F.array(mean), lambda m: F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)))
    return F.sqrt(F.get(spread, F.lit(0)) / n)


def mean_abs_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)
