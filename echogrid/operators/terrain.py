"""Elevation models and spline georeferencing, as NumPy kernels in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.elevation import HIGHEST, LOWEST, Elevation, tiles
from .geo import ALPHA, RECTIFYING, WGS84_A, WGS84_E2, WGS84_F, resampled

Affine = tuple[float, float, float, float, float, float]


def bilinear(heights: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Heights at pixel-centre coordinates; a missing neighbour counts only if it has weight, and then is an error."""
    r, c = row - 0.5, col - 0.5
    if (r < 0).any() or (c < 0).any() or (r > heights.shape[0] - 1).any() or (c > heights.shape[1] - 1).any():
        raise ValueError("outside the elevation model")
    r0, c0 = np.minimum(r.astype(int), heights.shape[0] - 2), np.minimum(c.astype(int), heights.shape[1] - 2)
    out = np.zeros(len(r))
    for dr in (0, 1):
        for dc in (0, 1):
            w = np.abs(1 - dr - (r - r0)) * np.abs(1 - dc - (c - c0))
            h = heights[r0 + dr, c0 + dc]
            if (~np.isfinite(h) & (w > 0)).any():
                raise ValueError("a height is missing")
            out += np.where(w > 0, w * np.where(np.isfinite(h), h, 0), 0)
    if ((out < LOWEST) | (out > HIGHEST)).any():
        raise ValueError("heights are no terrain's")
    return out


def utm(lon: np.ndarray, lat: np.ndarray, epsg: int) -> tuple[np.ndarray, np.ndarray]:
    """Easting and northing in a UTM zone, as geo.to_utm has them for columns."""
    phi, lam = np.deg2rad(lat), np.deg2rad((lon - ((epsg % 100) * 6 - 183) + 180) % 360 - 180)
    e = WGS84_E2**0.5
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    north, east = xi.copy(), eta.copy()
    for j, a in enumerate(ALPHA, 1):
        north += a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        east += a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    return 500_000 + 0.9996 * RECTIFYING * east, (10_000_000 if epsg >= 32700 else 0) + 0.9996 * RECTIFYING * north


def cells(lon: np.ndarray, lat: np.ndarray, affine: Affine, epsg: int = 4326) -> tuple[np.ndarray, np.ndarray]:
    """Row and column (centres at halves) of places in a model with this affine map, whose coordinates are degrees or those of a UTM zone."""
    zone = 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760
    x, y = utm(lon, lat, epsg) if zone else (lon, lat)
    dx, dy, det = x - affine[2], y - affine[5], affine[0] * affine[4] - affine[1] * affine[3]
    return (affine[0] * dy - affine[3] * dx) / det, (affine[4] * dx - affine[1] * dy) / det


def world(x: np.ndarray, y: np.ndarray, z: np.ndarray, origin: tuple[float, float, float, float]) -> np.ndarray:
    """Longitude, latitude and ellipsoid height (n x 3) of scene points; origin is latitude, longitude, height and the heading of x."""
    phi, lam, _, heading = (np.deg2rad(v) for v in origin)
    turn = np.array([[np.sin(heading), -np.cos(heading), 0], [np.cos(heading), np.sin(heading), 0], [0, 0, 1]])
    basis = np.array([[-np.sin(lam), -np.sin(phi) * np.cos(lam), np.cos(phi) * np.cos(lam)], [np.cos(lam), -np.sin(phi) * np.sin(lam), np.cos(phi) * np.sin(lam)], [0, np.cos(phi), np.sin(phi)]])
    across = WGS84_A / np.sqrt(1 - WGS84_E2 * np.sin(phi) ** 2)
    centre = basis[:, 2] * (across + origin[2]) - np.array([0, 0, WGS84_E2 * across * np.sin(phi)])
    ex, ey, ez = (np.stack([x, y, z], 1) @ turn.T @ basis.T + centre).T
    p, b = np.hypot(ex, ey), WGS84_A * (1 - WGS84_F)
    theta = np.arctan2(ez * WGS84_A, p * b)
    lat = np.arctan2(ez + WGS84_E2 / (1 - WGS84_E2) * b * np.sin(theta) ** 3, p - WGS84_E2 * WGS84_A * np.cos(theta) ** 3)
    own = WGS84_A / np.sqrt(1 - WGS84_E2 * np.sin(lat) ** 2)
    return np.stack([np.rad2deg(np.arctan2(ey, ex)), np.rad2deg(lat), p * np.cos(lat) + ez * np.sin(lat) - WGS84_A**2 / own], 1)


def surface(points: DataFrame, heights: np.ndarray, affine: Affine, origin: tuple[float, float, float, float], rounds: int = 12, close: float = 1e-4, epsg: int = 4326) -> DataFrame:
    """points (x, y, z in a scene, z being a first guess) with z on an elevation model of ellipsoid heights.

    The affine map gives coordinates of a place (col, row) in the model: degrees,
    or those of the UTM zone that epsg names. A point is moved by what the
    model's height at its place differs from its own, until it is within 0.1 mm;
    a batch that does not get there is an error, and so is a missing height. The
    window of the model is broadcast, as it is cut to the scene; for models of
    any size there is surface_by_tiles.
    """
    shared = points.sparkSession.sparkContext.broadcast(np.asarray(heights))
    at = [points.columns.index(c) for c in "xyz"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, z = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in at)
            for _ in range(rounds):
                place = world(x, y, z, origin)
                off = bilinear(shared.value, *cells(place[:, 0], place[:, 1], affine, epsg)) - place[:, 2]
                if not len(off) or np.abs(off).max() <= close:
                    break
                z = z + off
            else:
                raise ValueError("the surface was not met")
            columns = [pa.array(z) if k == at[2] else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return points.withColumn("z", F.col("z").cast("double")).mapInArrow(run, points.withColumn("z", F.col("z").cast("double")).schema)


def surface_by_tiles(points: DataFrame, model: Elevation, origin: tuple[float, float, float, float], size: int = 256, most: int = 100_000, rounds: int = 12, close: float = 1e-4) -> DataFrame:
    """surface() on a whole elevation model, whatever its size: nothing of it is broadcast or cut.

    Points go to the tile of the model below them; a tile with more than `most`
    points is held by several tasks. A task moves its points on their tile until
    they are within 0.1 mm; what leaves the tile on the way is sent on to the next
    one, in rounds, which are few as points hardly move sideways. A point that
    needs more than `rounds` steps, lies outside the model or meets a missing
    height is an error.
    """
    spark = points.sparkSession
    own = [c for c in points.columns if c != "z"]
    state = T.StructType([*(points.schema[c] for c in own), *T.StructType.fromDDL("z double, _step int, _done boolean, _tile_row int, _tile_col int").fields])
    names, xy = state.fieldNames(), [own.index(c) for c in "xy"]
    grid = tiles(spark, model.path, size)

    def below(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, ...]:
        place = world(x, y, z, origin)
        row, col = cells(place[:, 0], place[:, 1], model.affine, model.epsg)
        r, c = row - 0.5, col - 0.5
        slack = 1e-8
        if not (np.isfinite(r) & np.isfinite(c) & (r >= -slack) & (c >= -slack) & (r <= model.rows - 1 + slack) & (c <= model.cols - 1 + slack)).all():
            raise ValueError("outside the elevation model")
        r, c = np.clip(r, 0, model.rows - 1), np.clip(c, 0, model.cols - 1)
        # the last row and column of cells belong to the neighbours before them
        cell_r, cell_c = np.minimum(r.astype(int), model.rows - 2), np.minimum(c.astype(int), model.cols - 2)
        return r, c, cell_r // size, cell_c // size, place[:, 2]

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, z = (batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False).astype(float) for c in "xyz")
            n = len(x)
            _, _, i, j, _ = below(x, y, z)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in own), pa.array(z), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, bool)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))], names)

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, at = None, None
        for whole in batches:
            for batch, key in _tile_runs(whole):
                if key != at:
                    tile, at = None, key
                side = batch.column(batch.schema.names.index("_side")).to_numpy()
                if side[0] == 0:
                    tile = np.frombuffer(batch.column(batch.schema.names.index("heights"))[0].as_py(), float).reshape(size + 1, size + 1)
                    batch = batch.slice(1)
                    if not batch.num_rows:
                        continue
                columns = {c: batch.column(batch.schema.names.index(c)) for c in names}
                x, y, z = (columns[c].to_numpy(zero_copy_only=False).astype(float) for c in "xyz")
                step, done = columns["_step"].to_numpy().copy(), np.zeros(len(x), bool)
                tile_row, tile_col, live = np.full(len(x), key[0], np.int32), np.full(len(x), key[1], np.int32), np.arange(len(x))
                while len(live):
                    r, c, i, j, up = below(x[live], y[live], z[live])
                    tile_row[live], tile_col[live] = i, j
                    here = (i == key[0]) & (j == key[1])
                    live, r, c, up = live[here], r[here], c[here], up[here]
                    off = bilinear(tile, r - key[0] * size + 0.5, c - key[1] * size + 0.5) - up
                    near = np.abs(off) <= close
                    done[live[near]] = True
                    live, off = live[~near], off[~near]
                    z[live] += off
                    step[live] += 1
                    if (step[live] >= rounds).any():
                        raise ValueError("the surface was not met")
                columns |= {"z": pa.array(z), "_step": pa.array(step), "_done": pa.array(done), "_tile_row": pa.array(tile_row), "_tile_col": pa.array(tile_col)}
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    def kept(df: DataFrame) -> DataFrame:
        return df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.persist()

    open_points = points.mapInArrow(begun, state)
    found = None
    for _ in range(rounds):
        held = open_points.groupBy("_tile_row", "_tile_col").agg(F.ceil(F.count("*") / most).cast("int").alias("_parts"))
        held = kept(held)
        tile = grid.join(held, (grid["tile_row"] == held["_tile_row"]) & (grid["tile_col"] == held["_tile_col"])).select("_tile_row", "_tile_col", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.lit(0).alias("_side"), "heights")
        dealt = open_points.join(F.broadcast(held) if held.count() <= 100_000 else held, ["_tile_row", "_tile_col"]).withColumn("_part", F.pmod(F.xxhash64(*own), F.col("_parts")).cast("int")).withColumn("_side", F.lit(1)).drop("_parts")
        both = tile.unionByName(dealt, allowMissingColumns=True).repartition("_tile_row", "_tile_col", "_part").sortWithinPartitions("_tile_row", "_tile_col", "_part", "_side")
        result = kept(both.mapInArrow(moved, state))
        done = result.where("_done")
        found = done if found is None else found.unionByName(done)
        open_points = result.where("not _done")
        if open_points.limit(1).count() == 0:
            return found.select(*points.columns)
    raise ValueError("the surface was not met")


def _tile_runs(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, tuple[int, int]]]:
    """Runs of rows of one tile and part, the tile's own row first if it is among them."""
    key = [batch.column(batch.schema.names.index(c)).to_numpy() for c in ("_tile_row", "_tile_col", "_part")]
    side = batch.column(batch.schema.names.index("_side")).to_numpy()
    cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0) | (side[1:] < side[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if a < b:
            yield batch.slice(a, b - a), (int(key[0][a]), int(key[1][a]))


class Spline:
    """Thin-plate spline through knots (n x 2) with values (n x k): its values at points, and their derivatives."""

    def __init__(self, knots: np.ndarray, values: np.ndarray):
        if len(knots) < 3:
            raise ValueError("a spline needs three knots or more")
        n, self.knots = len(knots), knots
        system = np.zeros((n + 3, n + 3))
        system[:n, :n] = self._kernel(self._squares(knots))
        system[:n, n], system[:n, n + 1 :] = 1, knots
        system[n:, :n] = system[:n, n:].T
        self.weights = np.linalg.solve(system, np.vstack([values, np.zeros((3, values.shape[1]))]))

    def _squares(self, p: np.ndarray) -> np.ndarray:
        return ((p[:, None, :] - self.knots[None, :, :]) ** 2).sum(2)

    @staticmethod
    def _kernel(d2: np.ndarray) -> np.ndarray:
        return np.where(d2 > 0, d2 * np.log(np.maximum(d2, 1e-300)), 0)

    def __call__(self, p: np.ndarray) -> np.ndarray:
        n = len(self.knots)
        return self._kernel(self._squares(p)) @ self.weights[:n] + self.weights[n] + p @ self.weights[n + 1 :]

    def slopes(self, p: np.ndarray) -> np.ndarray:
        """Derivatives (points x 2 x k) along both axes."""
        n, d2 = len(self.knots), self._squares(p)
        rate = np.where(d2 > 0, 2 * (np.log(np.maximum(d2, 1e-300)) + 1), 0)
        return np.stack([(rate * (p[:, None, a] - self.knots[None, :, a])) @ self.weights[:n] + self.weights[n + 1 + a] for a in (0, 1)], 1)


class ControlMap:
    """Pixels (row, col from 0 at the first centre) of an image with control points on a projected plane, and the way back."""

    def __init__(self, control: list[tuple[float, float, float, float]], rows: int, cols: int, epsg: int | None = None, cells: int = 64):
        c = np.array(control, float)
        if len(c) < 4:
            raise ValueError("four control points are needed")
        self.rows, self.cols = rows, cols
        self.epsg = epsg or _zone(*Spline(c[:, :2], _level(c[:, 2:]))(np.array([[rows / 2, cols / 2]]))[0])
        self.to_plane = Spline(c[:, :2] - 0.5, np.stack(utm(c[:, 2], c[:, 3], self.epsg), 1))
        # a lattice of source pixels, whose cells tell where the way back begins
        self.axes = [np.linspace(0, n - 1, min(n, cells + 1)) for n in (rows, cols)]
        at = np.stack(np.meshgrid(*self.axes, indexing="ij"), 2)
        self.lattice = self.to_plane(at.reshape(-1, 2)).reshape(at.shape)
        corners = np.stack([self.lattice[i : i + at.shape[0] - 1, j : j + at.shape[1] - 1] for i in (0, 1) for j in (0, 1)])
        low, high = corners.min(0).reshape(-1, 2), corners.max(0).reshape(-1, 2)
        # a cell's image is curved: its box grows by a share of its size
        self.low, self.high = low - 0.25 * (high - low), high + 0.25 * (high - low)

    def extent(self) -> tuple[np.ndarray, np.ndarray]:
        """The box of the image's outline on the plane, pixels' outer edges included."""
        r, c = (np.linspace(-0.5, n - 0.5, 257) for n in (self.rows, self.cols))
        edge = np.concatenate([np.stack([r, np.full_like(r, k)], 1) for k in (c[0], c[-1])] + [np.stack([np.full_like(c, k), c], 1) for k in (r[0], r[-1])])
        found = self.to_plane(edge)
        return found.min(0), found.max(0)

    def back(self, plane: np.ndarray, steps: int = 30, close: float = 1e-6) -> np.ndarray:
        """Source pixels of points of the plane (n x 2); NaN for what no pixel of the image maps to.

        Each cell of the lattice whose box holds a point is a place to begin
        Newton's steps; of the ends inside the image the one next to its cell
        counts.
        """
        out, best = np.full(plane.shape, np.nan), np.full(len(plane), np.inf)
        near = np.flatnonzero(((self.high >= plane.min(0)) & (self.low <= plane.max(0))).all(1)) if len(plane) else []
        width = len(self.axes[1]) - 1
        for cell in near:
            held = np.flatnonzero(((plane >= self.low[cell]) & (plane <= self.high[cell])).all(1))
            if not len(held):
                continue
            i, j = divmod(int(cell), width)
            centre = np.array([(self.axes[0][i] + self.axes[0][i + 1]) / 2, (self.axes[1][j] + self.axes[1][j + 1]) / 2])
            at = np.tile(centre, (len(held), 1))
            done, live = np.zeros(len(held), bool), np.arange(len(held))
            for _ in range(steps):
                slope = self.to_plane.slopes(at[live])
                det = slope[:, 0, 0] * slope[:, 1, 1] - slope[:, 0, 1] * slope[:, 1, 0]
                off = plane[held[live]] - self.to_plane(at[live])
                with np.errstate(divide="ignore", invalid="ignore"):
                    move = np.stack([off[:, 0] * slope[:, 1, 1] - off[:, 1] * slope[:, 1, 0], off[:, 1] * slope[:, 0, 0] - off[:, 0] * slope[:, 0, 1]], 1) / det[:, None]
                sound = np.isfinite(move).all(1) & (np.abs(move).max(1) < 4 * max(self.rows, self.cols))
                live, move = live[sound], move[sound]
                at[live] += move
                small = np.abs(move).max(1) < close
                done[live[small]] = True
                live = live[~small]
                if not len(live):
                    break
            inside = done & (at >= -1e-6).all(1) & (at <= np.array([self.rows - 1, self.cols - 1]) + 1e-6).all(1)
            far = np.abs(at - centre).max(1)
            nearer = np.flatnonzero(inside & (far < best[held]))
            out[held[nearer]], best[held[nearer]] = at[nearer], far[nearer]
        return np.clip(out, 0, [self.rows - 1, self.cols - 1])


def _level(lonlat: np.ndarray) -> np.ndarray:
    """Longitudes and latitudes without a jump at the date line."""
    return np.stack([lonlat[0, 0] + (lonlat[:, 0] - lonlat[0, 0] + 180) % 360 - 180, lonlat[:, 1]], 1)


def _zone(lon: float, lat: float) -> int:
    if not -80 <= lat <= 84:
        raise ValueError("name a UTM zone outside the latitudes of UTM")
    lon = (lon + 180) % 360 - 180
    return (32600 if lat >= 0 else 32700) + min(60, int((lon + 180) // 6) + 1)


def geocode_control(image: DataFrame, control: list[tuple[float, float, float, float]], rows: int, cols: int, pixel_m: float, epsg: int | None = None, tile: int = 128) -> tuple[DataFrame, dict[str, float]]:
    """A magnitude image (row, col, value) with control points (row, col, lon, lat at pixel centres plus a half) on the
    north-up grid of its UTM zone, as geo.geocode has it for affine images.

    A thin-plate spline takes pixels to the plane. Each task turns tiles of
    output pixels back through it: cells of a coarse lattice tell where to
    begin, Newton's steps end within 1e-6 of a pixel. The spline (bounded by
    the control points) is all that a task needs besides its tile; one shuffle
    brings source values to output pixels.
    """
    if not np.isfinite(pixel_m) or pixel_m <= 0:
        raise ValueError("the resolution must be positive metres")
    spark = image.sparkSession
    way = ControlMap(control, rows, cols, epsg)
    low, high = way.extent()
    width, height = (int(np.ceil((high[k] - low[k]) / pixel_m)) for k in (0, 1))
    across, down = -(-width // tile), -(-height // tile)
    shared = spark.sparkContext.broadcast(way)

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        way = shared.value
        for batch in batches:
            for n in batch.column(0).to_pylist():
                i, j = divmod(n, across)
                r, c = (x.ravel() for x in np.mgrid[i * tile : min(height, (i + 1) * tile), j * tile : min(width, (j + 1) * tile)])
                at = way.back(np.stack([low[0] + (c + 0.5) * pixel_m, high[1] - (r + 0.5) * pixel_m], 1))
                met = np.isfinite(at[:, 0])
                r, c, at = r[met], c[met], at[met]
                first = np.minimum(at.astype(int), [rows - 2, cols - 2])
                share = at - first
                for di in (0, 1):
                    for dj in (0, 1):
                        w = np.abs(1 - di - share[:, 0]) * np.abs(1 - dj - share[:, 1])
                        keep = w > 0
                        yield pa.RecordBatch.from_arrays([pa.array(x[keep], kind) for x, kind in ((r, pa.int32()), (c, pa.int32()), (w, pa.float64()), (first[:, 0] + di, pa.int32()), (first[:, 1] + dj, pa.int32()))], ["to_row", "to_col", "w", "row", "col"])

    asked = spark.range(across * down).mapInArrow(turned, "to_row int, to_col int, w double, row int, col int")
    return resampled(image, asked), {"epsg": way.epsg, "left": float(low[0]), "top": float(high[1]), "pixel_m": pixel_m, "rows": height, "cols": width}


def georeference(pixels: DataFrame, control: list[tuple[float, float, float, float]]) -> DataFrame:
    """pixels with lon and lat from ground control points (row, col, lon, lat) by a thin-plate spline, at pixel centres."""
    c = np.array(control, float)
    if len(c) < 4:
        raise ValueError("four control points are needed")
    at = Spline(c[:, :2], _level(c[:, 2:]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = at(batch[["row", "col"]].to_numpy(float) + 0.5)
            yield batch.assign(lon=(found[:, 0] + 180) % 360 - 180, lat=found[:, 1])

    fields = ", ".join(f"`{n}` {t}" for n, t in pixels.dtypes)
    return pixels.mapInPandas(run, f"{fields}, lon double, lat double")
