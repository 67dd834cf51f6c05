"""Motion of features and of whole tiles by cross-correlation of pixel sets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftfield.functions import geo
from driftfield.operators import stats
from driftfield.operators.ranking import exact_quantile
from driftfield.operators.tiles import Wrap
from driftfield.workspace import Workspace

MAX_BOX = 1 << 20
#: Significant digits kept of the largest value a correlation can have; what lies below is the transform's own error.
DIGITS = 10


def _pow2(n: int) -> int:
    return 1 << max(int(n - 1).bit_length(), 0)


def correlate(
    rows: DataFrame,
    keys: Sequence[str],
    left: Sequence[str],
    right: Sequence[str],
    products: Sequence[tuple[str, str, str]],
    ws: Workspace,
    centred: bool = False,
    max_box: int = MAX_BOX,
) -> DataFrame:
    """Cross-correlations of two pixel sets per group, for every displacement.

    ``rows`` hold keys, side (0 earlier, 1 later), y, x and value columns; each
    product (a, b, out) gives ``out(dy, dx) = sum a(p) b(p + d)``.  ``centred``
    limits displacements to half the bounding box.  Result: keys, height, width,
    dy, dx and the products.

    Groups whose bounding box is small are transformed in one piece.  Larger ones
    take the same transform in three shuffles, by rows, by columns and by rows
    again, so no task ever holds more than one line of the box.
    """
    keys = list(keys)
    box = ws.write(
        rows.groupBy(*keys).agg(
            F.min("y").alias("_y0"), F.min("x").alias("_x0"),
            (F.max("y") - F.min("y") + 1).alias("height"), (F.max("x") - F.min("x") + 1).alias("width"),
            *[_steps(a, b).alias(f"_q_{out}") for a, b, out in products],
        ),
        "boxes",
    )
    small = F.col("height").cast("long") * F.col("width") <= max_box
    fields = {f.name: f for f in rows.schema.fields}
    schema = T.StructType(
        [fields[k] for k in keys]
        + [T.StructField(n, T.IntegerType()) for n in ("height", "width", "dy", "dx")]
        + [T.StructField(out, T.DoubleType()) for _, _, out in products]
    )
    lefts, rights = list(left), list(right)

    def span(n: int) -> np.ndarray:
        return np.arange(n // 2 - n + 1, n // 2 + 1) if centred else np.arange(1 - n, n)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["height"].iat[0]), int(pdf["width"].iat[0])
        size = (_pow2(2 * h - 1), _pow2(2 * w - 1))
        y = (pdf["y"] - pdf["_y0"]).to_numpy()
        x = (pdf["x"] - pdf["_x0"]).to_numpy()
        late = pdf["side"].to_numpy() == 1

        def spectrum(col: str, rows_: np.ndarray) -> np.ndarray:
            a = np.zeros((h, w))
            a[y[rows_], x[rows_]] = pdf[col].to_numpy(float)[rows_]
            return np.fft.rfft2(a, size)

        fa = {c: spectrum(c, ~late) for c in lefts}
        fb = {c: spectrum(c, late) for c in rights}
        dy, dx = span(h), span(w)
        out = {"height": h, "width": w, "dy": np.repeat(dy, len(dx)), "dx": np.tile(dx, len(dy))}
        for a, b, name in products:
            full = np.fft.irfft2(np.conj(fa[a]) * fb[b], size)
            q = float(pdf[f"_q_{name}"].iat[0])
            out[name] = np.rint(full[np.ix_(dy % size[0], dx % size[1])].ravel() * q) / q
        frame = pd.DataFrame(out)
        for k in keys:
            frame[k] = pdf[k].iat[0]
        return frame[[f.name for f in schema.fields]]

    used = rows.select(*keys, "side", "y", "x", *dict.fromkeys([*lefts, *rights]))
    direct = used.join(box.where(small), keys).groupBy(*keys).applyInPandas(whole, schema)
    out = direct
    if not box.where(~small).isEmpty():
        wide = used.join(box.where(~small), keys)
        lines = _by_lines(wide, keys, lefts, rights, products, schema, span)
        lines = lines.join(box.select(*keys, *[f"_q_{n}" for _, _, n in products]), keys)
        for _, _, name in products:
            lines = lines.withColumn(name, F.rint(F.col(name) * F.col(f"_q_{name}")) / F.col(f"_q_{name}"))
        out = direct.unionByName(lines.select(*schema.names))
    return out


def _steps(a: str, b: str):
    """Power of ten that keeps DIGITS digits of the bound sqrt(sum a^2 sum b^2) on a correlation of a and b."""

    def power(c: str, side: int):
        return F.sum(F.when(F.col("side") == side, F.col(c).cast("double") * F.col(c)))

    bound = F.sqrt(F.coalesce(power(a, 0), F.lit(0.0)) * F.coalesce(power(b, 1), F.lit(0.0)))
    return F.pow(F.lit(10.0), DIGITS - F.ceil(F.log10(F.greatest(bound, F.lit(1e-200)))))


def _by_lines(wide: DataFrame, keys, lefts, rights, products, schema, span) -> DataFrame:
    """The two-dimensional transform as row, column and row steps."""
    fields = {f.name: f for f in wide.schema.fields}
    num = T.DoubleType()

    def make(*cols: tuple[str, T.DataType]) -> T.StructType:
        base = [fields[k] for k in keys] + [T.StructField(n, T.IntegerType()) for n in ("height", "width")]
        return T.StructType(base + [T.StructField(n, t) for n, t in cols])

    names = list(dict.fromkeys([*lefts, *rights]))

    def head(pdf: pd.DataFrame) -> dict:
        return {k: pdf[k].iat[0] for k in [*keys, "height", "width"]}

    def along_x(pdf: pd.DataFrame) -> pd.DataFrame:
        w = int(pdf["width"].iat[0])
        n = _pow2(2 * w - 1)
        out = {**head(pdf), "side": int(pdf["side"].iat[0]), "_row": int(pdf["_row"].iat[0]), "_k": np.arange(n // 2 + 1)}
        for c in names:
            line = np.zeros(w)
            line[(pdf["x"] - pdf["_x0"]).to_numpy()] = pdf[c].to_numpy(float)
            f = np.fft.rfft(line, n)
            out[f"{c}_re"], out[f"{c}_im"] = f.real, f.imag
        return pd.DataFrame(out)

    parts = [(f"{c}_{p}", num) for c in names for p in ("re", "im")]
    int_t = T.IntegerType()
    s1 = make(("side", int_t), ("_row", int_t), ("_k", int_t), *parts)
    step1 = (
        wide.withColumn("_row", F.col("y") - F.col("_y0"))
        .groupBy(*keys, "side", "_row")
        .applyInPandas(lambda pdf: along_x(pdf)[[f.name for f in s1.fields]], s1)
    )

    def along_y(pdf: pd.DataFrame) -> pd.DataFrame:
        h = int(pdf["height"].iat[0])
        n = _pow2(2 * h - 1)
        late = pdf["side"].to_numpy() == 1
        row = pdf["_row"].to_numpy()

        def line(c: str, mine: np.ndarray) -> np.ndarray:
            a = np.zeros(h, dtype=complex)
            a[row[mine]] = pdf[f"{c}_re"].to_numpy()[mine] + 1j * pdf[f"{c}_im"].to_numpy()[mine]
            return np.fft.fft(a, n)

        dy = span(h)
        out = {**head(pdf), "_k": int(pdf["_k"].iat[0]), "dy": dy}
        for a, b, name in products:
            back = np.fft.ifft(np.conj(line(a, ~late)) * line(b, late), n)[dy % n]
            out[f"{name}_re"], out[f"{name}_im"] = back.real, back.imag
        return pd.DataFrame(out)

    s2 = make(("_k", int_t), ("dy", int_t), *[(f"{o}_{p}", num) for _, _, o in products for p in ("re", "im")])
    step2 = step1.groupBy(*keys, "_k").applyInPandas(lambda pdf: along_y(pdf)[[f.name for f in s2.fields]], s2)

    def back_x(pdf: pd.DataFrame) -> pd.DataFrame:
        w = int(pdf["width"].iat[0])
        n = _pow2(2 * w - 1)
        dx = span(w)
        out = {**head(pdf), "dy": int(pdf["dy"].iat[0]), "dx": dx}
        k = pdf["_k"].to_numpy()
        for _, _, name in products:
            f = np.zeros(n // 2 + 1, dtype=complex)
            f[k] = pdf[f"{name}_re"].to_numpy() + 1j * pdf[f"{name}_im"].to_numpy()
            out[name] = np.fft.irfft(f, n)[dx % n]
        return pd.DataFrame(out)[[f.name for f in schema.fields]]

    return step2.groupBy(*keys, "dy").applyInPandas(back_x, schema)


def feature_motion(
    pixels: DataFrame,
    pairs: DataFrame,
    ws: Workspace,
    min_npix: int,
    pixel_km: float,
    quantile: float = 0.995,
    max_box: int = MAX_BOX,
    wrap: Wrap | None = None,
) -> DataFrame:
    """Displacement of each tracked feature between paired frames.

    ``pixels``: track_id, frame_id, y, x, value.  The displacement is the mean
    position of the correlation cells above the quantile.  A feature that lies across a
    periodic edge in either frame is put into one piece first.  Result: track_id,
    frame_id, move_y, move_x, movement_distance(_x, _y), movement_theta, movement_speed.
    """
    keys = ["track_id", "frame_id"]
    steps = pairs.select("frame_id", "next_frame", "dt_h")
    cols = ["y", "x", F.col("value").cast("double").alias("value")]
    early = pixels.join(steps.select("frame_id"), "frame_id").select(*keys, F.lit(0).alias("side"), *cols)
    late = pixels.join(
        steps.select(F.col("next_frame").alias("frame_id"), F.col("frame_id").alias("_ref")), "frame_id"
    ).select("track_id", F.col("_ref").alias("frame_id"), F.lit(1).alias("side"), *cols)
    both = early.unionByName(late)
    sized = both.groupBy(*keys).agg(
        F.sum(F.lit(1) - F.col("side")).alias("_n0"), F.sum("side").alias("_n1")
    ).where((F.least("_n0", "_n1") >= min_npix) & (F.least("_n0", "_n1") > 0))
    rows = both.join(sized.select(*keys), keys)
    if wrap is not None:
        rows = stats.unrolled(rows, keys, wrap).drop("_shift_y", "_shift_x")
    rows = ws.write(rows, "motion_pixels")
    corr = ws.write(
        correlate(rows, keys, ["value"], ["value"], [("value", "value", "c")], ws, centred=True, max_box=max_box),
        "correlation",
    )
    limit = exact_quantile(corr, keys, "c", quantile, "_q")
    best = corr.join(limit, keys).where(F.col("c") > F.col("_q")).groupBy(*keys).agg(
        F.avg(F.floor(F.col("height") / 2) - F.col("dy")).alias("_sy"),
        F.avg(F.floor(F.col("width") / 2) - F.col("dx")).alias("_sx"),
        F.first("height").alias("_h"), F.first("width").alias("_w"),
    )
    moved = best.select(
        *keys,
        (F.floor(F.col("_h") / 2) - F.rint("_sy")).alias("move_y"),
        (F.floor(F.col("_w") / 2) - F.rint("_sx")).alias("move_x"),
    ).join(steps.select("frame_id", "dt_h"), "frame_id")
    v = geo.movement_vector("move_x", "move_y", F.col("dt_h") * 3600.0)
    return moved.select(
        *keys, "move_y", "move_x",
        (v["magnitude"] * pixel_km).alias("movement_distance"),
        (F.col("move_x") * pixel_km).alias("movement_distance_x"),
        (F.col("move_y") * pixel_km).alias("movement_distance_y"),
        v["heading"].alias("movement_theta"),
        (v["speed"] * pixel_km * 1000.0).alias("movement_speed"),
    )


def quadratic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Interpolating quadratic B-spline with mid-point knots; NaN outside the data."""
    n = len(x)
    inner = (x[1:] + x[:-1])[1:-1] / 2.0
    t = np.concatenate([[x[0]] * 3, inner, [x[-1]] * 3])

    def basis(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.clip(np.searchsorted(t, p, side="right") - 1, 2, n - 1)

        def ratio(a, b):
            return np.divide(a, b, out=np.zeros_like(a), where=b != 0)

        l1 = ratio(t[i + 1] - p, t[i + 1] - t[i])
        r1 = 1.0 - l1
        b0 = ratio(t[i + 1] - p, t[i + 1] - t[i - 1]) * l1
        b2 = ratio(p - t[i], t[i + 2] - t[i]) * r1
        return i, np.stack([b0, 1.0 - b0 - b2, b2], axis=1)

    i, b = basis(x.astype(float))
    lower, diag, upper = np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(3):
        col = i - 2 + k
        for offset, band in ((-1, lower), (0, diag), (1, upper)):
            hit = col - np.arange(n) == offset
            band[hit] += b[hit, k]
    rhs = y.astype(float).copy()
    for r in range(1, n):
        f = lower[r] / diag[r - 1]
        diag[r] -= f * upper[r - 1]
        rhs[r] -= f * rhs[r - 1]
    c = np.zeros(n)
    c[-1] = rhs[-1] / diag[-1]
    for r in range(n - 2, -1, -1):
        c[r] = (rhs[r] - upper[r] * c[r + 1]) / diag[r]
    out = np.full(len(at), np.nan)
    ok = (at >= x[0]) & (at <= x[-1])
    if ok.any():
        j, w = basis(at[ok].astype(float))
        out[ok] = (w * c[j[:, None] - 2 + np.arange(3)]).sum(axis=1)
    return out


MOVES = ["movement_distance", "movement_speed", "movement_theta", "movement_distance_x", "movement_distance_y"]


def filter_speed(moves: DataFrame, max_speed: float) -> DataFrame:
    """Replace movements faster than the limit by a quadratic interpolation in time.

    ``moves``: track_id, time_idx and the movement columns.  Tracks with fewer
    than three acceptable speeds become NULL.  A track holds at most one row per
    frame, which bounds the group.
    """
    schema = moves.select("track_id", "time_idx", *MOVES).schema

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time_idx").reset_index(drop=True)
        t = pdf["time_idx"].to_numpy(float)
        speed = pdf["movement_speed"].to_numpy(float)
        known = np.isfinite(speed)
        good = known & (np.where(known, speed, np.inf) < max_speed)
        if good.sum() < 3:
            pdf[MOVES] = np.nan
            return pdf
        dist = pdf["movement_distance"].to_numpy(float)
        theta = np.radians(pdf["movement_theta"].to_numpy(float))
        new_dist = quadratic_spline(t[good], dist[good], t[known])
        new_speed = quadratic_spline(t[good], speed[good], t[known])
        pdf.loc[known, "movement_distance"] = new_dist
        pdf.loc[known, "movement_speed"] = new_speed
        pdf.loc[known, "movement_distance_x"] = np.nan_to_num(new_dist * np.sin(theta[known]))
        pdf.loc[known, "movement_distance_y"] = np.nan_to_num(new_dist * np.cos(theta[known]))
        return pdf

    out = moves.select("track_id", "time_idx", *MOVES).groupBy("track_id").applyInPandas(kernel, schema)
    return out.withColumns({c: F.nanvl(c, F.lit(None)) for c in MOVES})


def tile_advection(
    pixels: DataFrame,
    pairs: DataFrame,
    ws: Workspace,
    shape: tuple[int, int],
    tiles: tuple[int, int],
    buffer: int,
    threshold: float,
    dx_km: float,
    dy_km: float,
    step_s: float,
    max_speed: float,
    min_cells: int = 10,
    overlap: float = 0.7,
    below: bool = False,
    max_box: int = MAX_BOX,
) -> DataFrame:
    """Motion of the field in each domain tile by masked normalised correlation.

    Only pixels beyond the threshold take part.  Displacements that share too few
    pixels do not count; too small tiles and too fast motions give 0.
    Result: frame_id, tile_y, tile_x, y, x (grid cells per step).
    """
    ny, nx = shape
    ty, tx = tiles
    rows_per, cols_per = ny // ty, nx // tx
    cells = max(rows_per - 2 * buffer, 0) * max(cols_per - 2 * buffer, 0)
    value = F.col("value").cast("double")
    keep = value < threshold if below else value > threshold
    tile_y, tile_x = F.floor(F.col("y") / rows_per).cast("int"), F.floor(F.col("x") / cols_per).cast("int")
    inside = (
        (F.col("y") % rows_per).between(buffer, rows_per - buffer - 1)
        & (F.col("x") % cols_per).between(buffer, cols_per - buffer - 1)
        & (F.col("tile_y") < ty) & (F.col("tile_x") < tx)
    )
    px = pixels.where(keep).withColumns({"tile_y": tile_y, "tile_x": tile_x}).where(inside).select(
        "frame_id", "tile_y", "tile_x", "y", "x",
        value.alias("f"), (value * value).alias("f2"), F.lit(1.0).alias("m"),
    )
    keys = ["frame_id", "tile_y", "tile_x"]
    steps = pairs.select("frame_id", "next_frame")
    early = px.join(steps.select("frame_id"), "frame_id").withColumn("side", F.lit(0))
    late = px.join(steps.select(F.col("next_frame").alias("frame_id"), F.col("frame_id").alias("_r")), "frame_id").drop(
        "frame_id"
    ).withColumnRenamed("_r", "frame_id").withColumn("side", F.lit(1))
    cols = [*keys, "side", "y", "x", "f", "f2", "m"]
    products = [("m", "m", "n"), ("f", "m", "s1"), ("m", "f", "s2"), ("f2", "m", "q1"), ("m", "f2", "q2"), ("f", "f", "p")]
    names = ["f", "f2", "m"]
    both = ws.write(early.select(*cols).unionByName(late.select(*cols)), "advection_pixels")
    c = correlate(both, keys, names, names, products, ws, max_box=max_box)
    n = F.greatest(F.round("n"), F.lit(1e-12))
    top = F.col("p") - F.col("s1") * F.col("s2") / n
    d1 = F.greatest(F.col("q1") - F.col("s1") * F.col("s1") / n, F.lit(0.0))
    d2 = F.greatest(F.col("q2") - F.col("s2") * F.col("s2") / n, F.lit(0.0))
    c = ws.write(
        c.select(*keys, "dy", "dx", F.round("n").alias("n"), top.alias("top"), F.sqrt(d1 * d2).alias("den")), "ncc"
    )
    limits = c.groupBy(*keys).agg(F.max("n").alias("_n"), F.max("den").alias("_den"))
    usable = (F.col("n") >= F.col("_n") * overlap) & (F.col("den") > F.greatest(F.col("_den") * 1e-9, F.lit(1e-6)))
    score = F.when(usable, F.greatest(F.least(F.col("top") / F.col("den"), F.lit(1.0)), F.lit(-1.0))).otherwise(0.0)
    scored = c.join(limits, keys).withColumn("_score", score)
    peak = scored.groupBy(*keys).agg(F.max("_score").alias("_best"))
    near = F.abs(F.col("_score") - F.col("_best")) <= F.abs("_best") * 1e-5 + 1e-8
    found = scored.join(peak, keys).where(near).groupBy(*keys).agg(F.avg("dy").alias("y"), F.avg("dx").alias("x"))
    speed = geo.advection_vector("x", "y", F.lit(float(step_s)), dx_km, dy_km)["speed"]
    ok = (speed <= max_speed) & F.lit(cells >= min_cells)
    return found.select(*keys, *[F.when(ok, F.col(a)).otherwise(0.0).alias(a) for a in ("y", "x")])


def running_median(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], length: int) -> DataFrame:
    """Median over ``length`` steps along ``order``; steps beyond the ends count as zero."""
    half = length // 2
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)
    out = {}
    for c in columns:
        seen = F.collect_list(F.col(c).cast("double")).over(w)
        padded = F.concat(seen, F.array_repeat(F.lit(0.0), F.lit(length) - F.size(seen)))
        out[c] = F.element_at(F.sort_array(padded), half + 1)
    return df.withColumns(out)


def smooth_advection(moves: DataFrame, dx_km: float, dy_km: float, step_s: float, length: int) -> DataFrame:
    """Temporal median of distance and direction, turned back into whole grid steps."""
    x, y = F.col("x"), F.col("y")
    mag = F.sqrt(x * x * dx_km * dx_km + y * y * dy_km * dy_km)
    rows = moves.withColumns(
        {
            "magnitude": mag,
            "speed": mag * 1000.0 / step_s,
            "direction": F.lit(90.0) - F.degrees(F.atan2(y, x)),
        }
    )
    med = running_median(rows, ["tile_y", "tile_x"], "frame_id", ["magnitude", "speed", "direction"], length)
    turn = F.radians(F.lit(90.0) - F.col("direction"))
    return med.withColumns(
        {
            "x": F.rint(F.col("magnitude") * F.cos(turn) / dx_km),
            "y": F.rint(F.col("magnitude") * F.sin(turn) / dy_km),
        }
    )
