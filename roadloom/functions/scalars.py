"""Column expressions: parsing, time bins, geography, traffic measures, densities. All of it stays in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radii (m), metres a degree, and the coefficients of the local-to-WGS84 polynomials,
#: for the features 1, u, v, u^2, uv, v^2.
RADIUS_EQUIRECTANGULAR, RADIUS_HAVERSINE = 6371008.8, 6371000.0
METRES_LON, METRES_LAT = 111320.0, 110540.0
LOCAL_ORIGIN, LOCAL_SCALE = (514717.3157977706, 291482.63714945794), 10000.0
LON_COEFFICIENTS = (116.52269041899139, 0.11674355596300813, 0.0002240372945873046, -6.601902629810713e-07, 0.00015207751767337745, 5.792739454636199e-07)
LAT_COEFFICIENTS = (39.78920600957576, -0.00017282817403346755, 0.09006307780008098, -5.8705286307285146e-05, -7.273031568614425e-07, -6.919121057481031e-07)
GCJ_A, GCJ_EE = 6378245.0, 0.00669342162296594323
GCJ_LON, GCJ_LAT = (72.004, 137.8347), (0.8293, 55.8271)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Parsing

def to_num(c) -> Column:
    """Number of a text, null where it is none; NaN is null."""
    v = F.trim(col(c).cast("string")).try_cast("double")
    return F.when(~F.isnan(v), v)


def to_int(c) -> Column:
    """Integer part of a number's text: '12.7' gives 12."""
    v = to_num(c)
    return F.when(F.abs(v) < 9.2e18, v.cast("bigint"))


def split_numbers(c, whole: bool = False, strict: bool = False) -> Column:
    """Numbers of a ';'-separated text. Bad tokens are left out, which shifts later ones; `strict` makes such a text null."""
    tokens = F.filter(F.transform(F.split(F.regexp_replace(col(c), "[\"']", ""), ";"), lambda t: F.trim(t)), lambda t: t != "")
    parse = (lambda t: to_int(t)) if whole else (lambda t: t.try_cast("double"))
    values = F.filter(F.transform(tokens, parse), lambda v: v.isNotNull())
    return F.when(F.size(values) == F.size(tokens), values) if strict else values


def fold_fields(fields, wanted: int = 18, name_at: int = 13, tail: int = 4) -> Column:
    """A row of split fields brought to `wanted`: padded with '', or with its surplus folded into the name field."""
    f = col(fields)
    n = F.size(f)
    name = F.array_join(F.filter(F.slice(f, name_at + 1, F.greatest(n - tail - name_at, F.lit(1))), lambda x: F.trim(x) != ""), " ")
    padded = F.concat(f, F.array_repeat(F.lit(""), F.greatest(F.lit(wanted) - n, F.lit(0))))
    folded = F.concat(F.slice(f, 1, name_at), F.array(name), F.slice(f, n - tail + 1, tail))
    return F.when(n <= wanted, padded).otherwise(folded)


def route_numbers(*cs) -> Column:
    """Distinct numbers of one to three digits, not part of longer ones, in any of the texts; sorted."""
    joined = F.concat_ws(" ", *(F.coalesce(col(c), F.lit("")) for c in cs))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(joined, F.lit(r"(?<!\d)(\d{1,3})(?!\d)"), 1)))


def parse_list(c) -> Column:
    """Trimmed non-empty parts of a text split at ASCII or full-width commas."""
    return F.filter(F.transform(F.split(col(c), "[,，]"), lambda x: F.trim(x)), lambda x: x != "")


def slug(c) -> Column:
    """A name safe for files: runs of other characters become one underscore."""
    s = F.regexp_replace(F.trim(col(c)), r"[^0-9A-Za-z._-]+", "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.when(s == "", "run").otherwise(s)


# Time bins

def entry_bin(t, width: float = 5.0, horizon: float = 1440.0) -> Column:
    """Bin of an entry minute; null outside [0, horizon)."""
    t = col(t)
    return F.when((t >= 0) & (t < horizon), F.floor(t / width).cast("int"))


def occupancy_bins(enter, leave, width: float = 5.0, horizon: float = 1440.0, clip: bool = True) -> Column:
    """All bins that the half-open stay [enter, leave) overlaps; a stay of no length is in one bin."""
    a, b = col(enter), col(leave)
    none = F.array().cast("array<int>")
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    start, end = F.greatest(a, F.lit(0.0)), F.least(b, F.lit(horizon)) if clip else b
    first, last = F.floor(start / width).cast("int"), F.floor((end - 1e-9) / width).cast("int")
    return (
        F.when(~ok(a) | ~ok(b), none).when((a < 0) & (b < 0), none).when((b < a) | (end < start), none)
        .when(F.abs(end - start) <= 1e-9, F.when(start >= horizon, none).otherwise(F.array(first)))
        .when(last < first, none).otherwise(F.sequence(first, last))
    )


def slot_of(hhmm, minutes: int = 5) -> Column:
    """Slot of the day of a text HH:MM."""
    p = F.split(col(hhmm), ":")
    return F.floor((p[0].cast("int") * 60 + p[1].cast("int")) / minutes).cast("int")


def bin_label(k, width: int) -> Column:
    at = lambda m: F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), (m % 60).cast("int"))
    return F.concat(at(col(k) * width), F.lit("-"), at((col(k) + 1) * width))


# Geography

def local_to_wgs84(x, y) -> tuple[Column, Column]:
    u, v = ((col(c) - o) / LOCAL_SCALE for c, o in zip((x, y), LOCAL_ORIGIN, strict=True))
    features = (F.lit(1.0), u, v, u * u, u * v, v * v)
    poly = lambda k: sum((f * c for f, c in zip(features[1:], k[1:], strict=True)), features[0] * k[0])
    return poly(LON_COEFFICIENTS), poly(LAT_COEFFICIENTS)


def wgs84_to_gcj02(lon, lat) -> tuple[Column, Column]:
    """Shifted coordinates inside the guard rectangle, unchanged outside."""
    lon, lat = col(lon), col(lat)
    x, y, pi = lon - 105.0, lat - 35.0, math.pi
    wave = lambda v, *terms: sum((F.sin(v * (k * pi)) * a for a, k in terms), F.lit(0.0)) * (2 / 3)
    ripple = wave(x, (20, 6), (20, 2))
    dlat = -100 + 2 * x + 3 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * F.sqrt(F.abs(x)) + ripple + wave(y, (20, 1), (40, 1 / 3)) + wave(y, (160, 1 / 12), (320, 1 / 30))
    dlon = 300 + x + 2 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * F.sqrt(F.abs(x)) + ripple + wave(x, (20, 1), (40, 1 / 3)) + wave(x, (150, 1 / 12), (300, 1 / 30))
    phi = F.radians(lat)
    g = 1 - GCJ_EE * F.sin(phi) * F.sin(phi)
    out_lat = lat + dlat * 180.0 / ((GCJ_A * (1 - GCJ_EE)) / (g * F.sqrt(g)) * pi)
    out_lon = lon + dlon * 180.0 / (GCJ_A / F.sqrt(g) * F.cos(phi) * pi)
    inside = lon.between(*GCJ_LON) & lat.between(*GCJ_LAT)
    return F.when(inside, out_lon).otherwise(lon), F.when(inside, out_lat).otherwise(lat)


def project(lon, lat, lon0, lat0) -> tuple[Column, Column]:
    """Equirectangular metres from an origin."""
    return F.radians(col(lon) - lon0) * F.cos(F.radians(F.lit(lat0))) * RADIUS_EQUIRECTANGULAR, F.radians(col(lat) - lat0) * RADIUS_EQUIRECTANGULAR


def planar(lon, lat, lat0) -> tuple[Column, Column]:
    """Metres by the length of a degree at latitude lat0."""
    return col(lon) * F.cos(F.radians(col(lat0) if isinstance(lat0, str) else F.lit(lat0))) * METRES_LON, col(lat) * METRES_LAT


def haversine(lon1, lat1, lon2, lat2) -> Column:
    a1, a2 = F.radians(col(lat1)), F.radians(col(lat2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians(col(lon2) - col(lon1)) / 2), 2)
    return 2 * RADIUS_HAVERSINE * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def on_segment(px, py, ax, ay, bx, by) -> Column:
    """struct(dist, t, x, y) of the point of a segment that is nearest to p; a segment of no length is its start."""
    px, py, ax, ay, bx, by = map(col, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    d2 = dx * dx + dy * dy
    t = F.when(d2 <= 1e-12, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((px - ax) * dx + (py - ay) * dy, d2))))
    x, y = ax + t * dx, ay + t * dy
    return F.struct(F.hypot(px - x, py - y).alias("dist"), t.alias("t"), x.alias("x"), y.alias("y"))


def aside(ax, ay, bx, by, offset: float = 0.06) -> tuple[Column, Column]:
    """Perpendicular offset of an edge for drawing; an edge of no length counts as length 1."""
    dx, dy = col(bx) - col(ax), col(by) - col(ay)
    length = F.hypot(dx, dy)
    length = F.when(length == 0, 1.0).otherwise(length)
    return -dy / length * offset, dx / length * offset


# Traffic measures

def safe_divide(num, den) -> Column:
    return F.try_divide(col(num), col(den))


def flow_measures(x, length, lanes, jam, lane_capacity, capacity, bin_minutes: int = 5) -> dict[str, Column]:
    """density, storage, congestion, rate, capacity_ratio and saturation of an edge's count, with floors on what divides."""
    x, n = col(x), F.greatest(col(lanes), F.lit(1.0))
    at_least = lambda c, v: F.greatest(F.coalesce(col(c), F.lit(v)), F.lit(v))
    size = at_least(length, 1e-6) * n
    storage = size * at_least(jam, 1e-6)
    rate = x * (60.0 / bin_minutes)
    return {"density": x / size, "storage": storage, "congestion": x / storage, "rate": rate, "capacity_ratio": rate / at_least(lane_capacity, 1e-6), "saturation": x / at_least(capacity, 1.0)}


def congestion(speed, free_speed, volume, volume_p95) -> Column:
    """Slowdown weighed by log volume, both within [0, 1]; an undefined part is 0."""
    unit = lambda v: F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), F.lit(0.0))
    slow = unit(1 - F.try_divide(col(speed), col(free_speed)))
    weight = unit(F.try_divide(F.log1p(col(volume)), F.log1p(F.greatest(F.lit(1.0), col(volume_p95)))))
    return unit(slow * weight)


def compact(v, digits: int = 3) -> Column:
    """Text of a value: whole numbers without a point, others rounded half to even."""
    v = col(v)
    return F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(F.bround(v, digits).cast("string"))


# The column behind each metric of a map.
METRIC_COLUMNS = {"xijt": "x_ijt", "density": "density_veh_per_km_lane", "congestion": "congestion_index", "saturation": "xijt_saturation"}


def metric_value(metric: str) -> Column:
    """The value of a metric in a row of flow measures, 0 where it is none."""
    if metric not in METRIC_COLUMNS:
        raise ValueError(f"no metric {metric}; there are {', '.join(METRIC_COLUMNS)}")
    v = F.col(METRIC_COLUMNS[metric]).cast("double")
    return F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v)


def metric_text(metric: str, value: Column | None = None) -> Column:
    """How a metric's value stands in a payload: congestion with four digits, all others as compact numbers."""
    v = metric_value(metric) if value is None else value
    return F.bround(v, 4).cast("string") if metric == "congestion" else compact(v)


def color_class(v, breaks) -> Column:
    """How many breaks a value exceeds."""
    return F.aggregate(F.transform(col(breaks), lambda b: (col(v) > b).cast("int")), F.lit(0), lambda a, x: a + x)


# Series and densities

def season(t, steps_day: int = 48, harmonics: int = 2) -> Column:
    """array(sin1, cos1, sin2, cos2, ...) of the time of day of step t, counted from 1."""
    phase = 2 * math.pi * F.pmod(col(t) - 1, F.lit(steps_day)) / steps_day
    return F.array(*(f(phase * j) for j in range(1, harmonics + 1) for f in (F.sin, F.cos)))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def lag_input(y, center: float = math.log(8), scale: float = 2.0) -> Column:
    return (F.log1p(col(y)) - center) / scale


def ln_factorial(y) -> Column:
    """ln(y!), exact for small y, by Stirling's series beyond 15."""
    y = col(y).cast("double")
    z = F.greatest(y, F.lit(15.0))
    far = z * F.ln(z) - z + 0.5 * F.ln(2 * math.pi * z) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, 5))
    return F.when(y <= 15, F.ln(F.factorial(F.least(y, F.lit(15.0)).cast("int")).cast("double"))).otherwise(far)


def poisson_logpmf(y, rate) -> Column:
    return col(y) * F.ln(col(rate)) - col(rate) - ln_factorial(y)


def gaussian_logpdf(x, mean, sd) -> Column:
    z = (col(x) - col(mean)) / col(sd)
    return -0.5 * z * z - F.ln(col(sd)) - 0.5 * math.log(2 * math.pi)


def half_cauchy_logpdf(x, scale) -> Column:
    """Minus infinity at and below 0."""
    r = F.try_divide(col(x), col(scale))
    return F.when(col(x) > 0, math.log(2 / math.pi) - F.ln(col(scale)) - F.log1p(r * r)).otherwise(F.lit(float("-inf")))
