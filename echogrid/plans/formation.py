"""From a folder of phase histories or an archive of raw echoes to a checked, published image set with its report."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import geo, imaging, signal, terrain
from ..operators.signal import C
from ..sources import archives, elevation, files, products


@dataclass(frozen=True)
class Scene:
    """What is to be formed, and how; the origin (latitude, longitude, height, heading of x) and an elevation model are optional."""

    width_m: float = 100.0
    pixels: int = 256
    z_m: float = 0.0
    window: str = ""
    azimuth_window: str = "hann"
    upsample: int = 32
    method: str = "linear"
    half_width: int = 8
    dynamic_range_db: float = 50.0
    origin: tuple[float, float, float, float] | None = None
    model: str | None = None
    focus_point: tuple[float, float, float] | None = None
    first_azimuth: int = 1
    last_azimuth: int = 4
    passage: int = 1
    polarisation: str = "HH"

    def checked(self) -> Scene:
        if not 2 <= self.pixels <= 4096 or not np.isfinite(self.width_m) or self.width_m <= 0:
            raise ValueError("2 to 4096 pixels and a positive width are needed")
        if self.model is not None and self.origin is None:
            raise ValueError("an elevation model needs the scene's origin")
        return self

    @property
    def grid(self) -> imaging.Grid:
        half = self.width_m / 2
        return imaging.Grid((-half, half, self.pixels), (-half, half, self.pixels), self.z_m)


def _numbered(pulses: DataFrame) -> DataFrame:
    """Pulses of several files in the order of (azimuth, nth), numbered within each file and from file to file."""
    counts = pulses.groupBy("azimuth").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("azimuth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("azimuth").alias("_of"), before.alias("_start"))
    return pulses.join(F.broadcast(starts), F.col("azimuth") == F.col("_of")).withColumn("pulse", F.col("_start") + F.col("nth")).drop("_of", "_start")


def _history(spark: SparkSession, source: str, s: Scene, report: dict[str, Any]) -> tuple[DataFrame, dict[str, float], DataFrame, np.ndarray]:
    pulses = _numbered(archives.phase_histories(spark, source, s.first_azimuth, s.last_azimuth, s.passage, s.polarisation))
    frequency = np.array(pulses.select("frequency_hz").first()[0])
    pulses = pulses.select("pulse", "re", "im", "x", "y", "z", "r0")
    report["additional_autofocus"] = {"status": "not applied"}
    if s.focus_point is not None:
        focused = signal.focus_pulses(pulses, frequency, s.focus_point)
        errors = focused.agg(F.min("phase_error").alias("least_phase_error_rad"), F.max("phase_error").alias("most_phase_error_rad"), F.min("coherence").alias("least_coherence")).first()
        report["additional_autofocus"] = {"status": "constant phase correction to a reference point", "point_m": list(s.focus_point), **errors.asDict()}
        pulses = focused.drop("phase_error", "coherence")
    _, step, error = signal.axis_fit(frequency)
    band = float(frequency.max() - frequency.min())
    report |= {"range_window": s.window or "hann", "range_upsample": s.upsample, "frequency_step_hz": step, "frequency_grid_max_fit_error_hz": error, "bandwidth_hz": band, "nominal_c_over_2B_m": C / (2 * band), "range_compression": "IFFT of frequency-domain phase history"}
    profiles, meta = signal.compress_phase_history(pulses, frequency, s.upsample, s.window or "hann", s.azimuth_window)
    return profiles, meta, pulses, frequency


def _echoes(spark: SparkSession, source: str, s: Scene, report: dict[str, Any]) -> tuple[DataFrame, dict[str, float]]:
    pulses = archives.raw_echoes(spark, source)
    one = pulses.select("sampling_rate_hz", "carrier_hz", "replica_re", "replica_im").first()
    replica = np.array(one["replica_re"]) + 1j * np.array(one["replica_im"])
    profiles = signal.compress_raw_echo(pulses.select("pulse", "re", "im", "receive_start_s", "x", "y", "z"), replica, one["sampling_rate_hz"], s.window or "none")
    # a pulse's own first range becomes its reference range; the phase of that range is put into its samples
    wave = 4 * np.pi * one["carrier_hz"] / C
    turn = F.col("range_start_m") * wave
    both = {"re": F.zip_with("re", "im", lambda a, b: a * F.cos(turn) - b * F.sin(turn)), "im": F.zip_with("re", "im", lambda a, b: a * F.sin(turn) + b * F.cos(turn))}
    turned = profiles.select("pulse", *[c.alias(n) for n, c in both.items()], "x", "y", "z", F.col("range_start_m").alias("r0"))
    report |= {"range_window": s.window or "supplied replica; no additional taper", "range_compression": "linear matched filter using the supplied replica"}
    meta = {"range_start_m": 0.0, "range_step_m": C / 2 / one["sampling_rate_hz"], "carrier_hz": one["carrier_hz"]}
    return signal.aperture_weights(turned, s.azimuth_window), meta


def form_scene(spark: SparkSession, source: str, target: str, scene: Scene = Scene()) -> dict[str, Any]:
    """Forms one image and publishes `target`: image (complex pixels, raster, preview), frame, profiles and report.json.

    A source that ends in .npz is an archive of raw echoes, anything else a
    folder of phase histories; these are held against the direct sum, and an
    image that differs by more than one percent, or has no signal, is an error.
    The folder appears whole or not at all. Returns the report.
    """
    s = scene.checked()
    if files.exists(target):
        raise FileExistsError(target)
    raw = source.endswith(".npz")
    sources = [r.asDict() for r in archives.provenance(spark, source).orderBy("path").collect()] if raw else archives.provenance(spark, source).count()
    report: dict[str, Any] = {"input_stage": "raw_echo" if raw else "phase_history", "scene": {k: v for k, v in asdict(s).items() if v is not None}, "sources": sources}
    if raw:
        (profiles, meta), pulses, frequency = _echoes(spark, source, s, report), None, None
    else:
        profiles, meta, pulses, frequency = _history(spark, source, s, report)
    grid = s.grid
    with files.published(target) as work:
        profiles.write.parquet(f"{work}/profiles")
        profiles = spark.read.schema(profiles.schema).parquet(f"{work}/profiles")
        if s.model is not None:
            model = elevation.layout(s.model)
            points = terrain.surface_by_tiles(grid.frame(spark), model, s.origin)
            formed = imaging.backproject_points(points, profiles, meta, s.azimuth_window, s.method, s.half_width)
            report["terrain"] = {"source": s.model, "height_reference": "WGS84 ellipsoid metres"} | points.agg(F.min("z").alias("local_z_min_m"), F.max("z").alias("local_z_max_m")).first().asDict()
        else:
            formed = imaging.backproject(grid, profiles, meta, s.azimuth_window, s.method, s.half_width)
        formed.write.parquet(f"{work}/pixels")
        image = spark.read.schema(formed.schema).parquet(f"{work}/pixels")
        if not image.agg(F.bool_or((F.col("re") != 0) | (F.col("im") != 0))).first()[0]:
            raise ValueError("the image has no signal")
        if pulses is not None and s.model is None:
            error = imaging.self_check(image, grid, pulses, frequency, s.window or "hann", s.azimuth_window)
            report["validation"] = {"direct_sum_relative_l2_error": error, "limit": 0.01, "scope": "numerical consistency, not external scene ground truth"}
        products.write_image_set(image, f"{work}/image", s.pixels, s.pixels, s.dynamic_range_db)
        magnitude = image.select("row", "col", F.hypot("re", "im").alias("value"))
        where = None
        if s.origin is not None:
            lat, lon, height, heading = s.origin

            def place(at: DataFrame) -> DataFrame:
                step = s.width_m / (s.pixels - 1)
                found = geo.scene_to_geodetic(F.col("col") * step - s.width_m / 2, F.col("row") * step - s.width_m / 2, F.lit(s.z_m), lat, lon, height, heading)
                return at.withColumns({"lon": found[0], "lat": found[1]})

            where = geo.frame_geolocation(spark, place, s.pixels, s.pixels)
            report["geolocation_error_m"] = where["interpolation_error_m"]
        products.write_frame(magnitude, work, s.pixels, s.pixels, "backprojected_magnitude" if where else "scene_local_magnitude", files.uri(source).rstrip("/").rpartition("/")[2], where)
        report |= {"image_shape": [s.pixels, s.pixels], "pulses": profiles.count(), "pixel_spacing_m": s.width_m / (s.pixels - 1), "azimuth_compression": "coherent geometric backprojection with complex interpolation", "amplitude_calibration": "uncalibrated", "terrain_correction": "elevation model used in image-formation geometry" if s.model else "not applied"}
        products.write_json(f"{work}/report.json", report)
    return report
