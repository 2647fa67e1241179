"""Configurations with defaults, key=value files, chips, and the format of an input."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields, is_dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


@dataclass(frozen=True)
class Filter:
    window_coef: float = 0.0
    window_broadening: float = 0.0
    scaling_method: str = ""


@dataclass(frozen=True)
class Operator:
    """What a run of the older image forming is told; names in files are in camel case."""

    output_debug_rpf: bool = False
    allow_synthetic_input: bool = False
    rpf_base_file_name: str = ""
    input_file_path: str = ""
    input_file_name: str = ""
    input_num_files: int = 0
    replica_selection: str = ""
    pulse_replica_file_name: str = ""
    first_range_line: int = 1
    num_lines_to_process: int = 0
    output_projection: str = ""
    n_pix_x: int = 0
    n_pix_y: int = 0
    image_offset_spec: str = ""
    image_offset: list = field(default_factory=list)
    collapse_factor: int = 1
    ap_overlap_frac: float = 0.0
    max_num_frames: int = 0
    apply_auto_focus: bool = True
    apply_frame_registration: bool = True
    azm_res_selection: str = ""
    azimuth_collapse_factor: float = 1.0
    azimuth_res: float = 0.0
    pix_spacing_selection: str = ""
    pixel_spacing: float = 0.0
    output_tiff_frames: str = ""
    tile_selection: str = ""
    num_tiles_y: int = 1
    num_tiles_x: int = 1
    use_gpu: bool = False
    fast_mode: bool = False


@dataclass(frozen=True)
class Quad:
    min_sub_image_size: int = 32
    az_over_samp_fact: float = 1.0
    n_extra_rng_samps: int = 0
    n_rng_taper: int = 0
    n_azm_taper: int = 0
    n_pad_az_fft_each_end: int = 0


@dataclass(frozen=True)
class Registration:
    alpha_accum: float = 0.0
    pre_shift_image_grid: bool = False
    regis_search_size: int = 0
    margin_blanking: int = 0
    chip_size: int = 0
    mag_factor: int = 0
    accum_pow: float = 0.0
    det_pow: float = 0.0


@dataclass(frozen=True)
class Autofocus:
    selection_method: str = ""
    min_metric_delta: float = 0.0
    max_points: int = 16
    max_frames: int = 0


@dataclass(frozen=True)
class Scaling:
    lower_percentile: float = 0.0
    upper_percentile: float = 1.0
    output_scaling_factor: float = 1.0


@dataclass(frozen=True)
class Secondary:
    """Parameters of the single steps."""

    algorithm_selection: str = ""
    rng_filter_params: Filter = Filter()
    azm_filter_params: Filter = Filter()
    quad_params: Quad = Quad()
    frame_registration_params: Registration = Registration()
    autofocus_params: Autofocus = Autofocus()
    image_scaling: Scaling = Scaling()
    rg_comp_mode: str = ""
    block_size_in_bytes: int = 0
    n_extra_rng_samps: int = 0
    tile_overlap: int = 0
    edge_taper_pixels: int = 0
    apply_iq_cal_correction: bool = False
    apply_agc_correction: bool = False
    apply_stc_correction: bool = False


@dataclass(frozen=True)
class Analysis:
    """What a chip's analysis is told; zp_alpha and the sidelobe method are carried into the report and change nothing."""

    report_path: str = "pta_report.txt"
    report_format: str = "json"
    chip_path: str = ""
    chip_data: list = field(default_factory=list)
    chip_rows: int = 0
    chip_cols: int = 0
    max_peaks: int = 10
    min_separation: int = 0
    histogram_bins: int = 0
    fft_size: int = 0
    mag_factor: int = 1
    zp_alpha: float = 0.0
    power_detection: str = ""
    side_lobe_method: str = ""
    analyze2_d: bool = False
    use_iqa: bool = False
    use_iqa2_d: bool = False


def camel(name: str) -> str:
    return re.sub(r"_([a-z0-9])", lambda m: m[1].upper(), name)


def filled(base, given: dict):
    """base with the values of a JSON object, by camel-case name; unknown names are left, and nested objects filled likewise."""
    changes = {}
    for f in fields(base):
        if (name := camel(f.name)) in given:
            own = getattr(base, f.name)
            value = given[name]
            if is_dataclass(own):
                value = filled(own, value) if isinstance(value, dict) else own
            elif isinstance(own, bool) != isinstance(value, bool) or (isinstance(own, str) != isinstance(value, str)):
                raise ValueError(f"{name} has the wrong type")
            changes[f.name] = value
    return replace(base, **changes)


def load(path: str, base):
    """A JSON file over base's defaults; base itself where there is no file or no object in it."""
    if not files.exists(path):
        return base
    with files.opened(path) as f:
        given = json.loads(f.read().decode())
    return filled(base, given) if isinstance(given, dict) else base


def key_values(text: str) -> dict[str, str]:
    """key=value lines, keys in lower case; # and % begin a comment, lines without = are left."""
    cut = (re.split(r"[#%]", line, maxsplit=1)[0].split("=", 1) for line in text.splitlines())
    return {k.strip().lower(): v.strip() for k, v in (pair for pair in cut if len(pair) == 2) if k.strip()}


def numbers(text: str) -> list[float]:
    """Numbers parted by commas or, where there is none, by blanks, up to the first that is none; a comma's empty part is left out."""
    out = []
    for part in text.split(",") if "," in text else text.split():
        found = re.match(r"\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", part)
        if found:
            out.append(float(found[1]))
        elif "," not in text:
            break
    return out


def _typed(own, text: str):
    """Text as a value of own's type; own where it is none."""
    if isinstance(own, bool):
        return {"1": True, "true": True, "yes": True, "0": False, "false": False, "no": False}.get(text, own)
    if isinstance(own, list):
        return numbers(text)
    if isinstance(own, str):
        return text
    found = re.match(r"[+-]?\d+" if isinstance(own, int) else r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text)
    return type(own)(found[0]) if found else own


def load_analysis(path: str) -> Analysis:
    """An analysis from JSON, or from key=value lines where the path ends in .prs or the text is no JSON."""
    with files.opened(path) as f:
        text = f.read().decode()
    if not path.endswith(".prs"):
        try:
            given = json.loads(text)
            data = given.get("chipData")
            if isinstance(data, list) and data and isinstance(data[0], list):
                given |= {"chipRows": len(data), "chipCols": len(data[0]), "chipData": [x for row in data for x in row]}
            return filled(Analysis(), given)
        except json.JSONDecodeError:
            pass
    pairs = key_values(text)
    base = Analysis()
    return replace(base, **{f.name: _typed(getattr(base, f.name), pairs[k]) for f in fields(base) if (k := camel(f.name).lower()) in pairs})


def chip_frame(spark: SparkSession, config: Analysis) -> DataFrame:
    """The chip of an analysis as (row, col, value): its own data, else its file's; one row where no size fits."""
    data = config.chip_data
    if not data and config.chip_path and files.exists(config.chip_path):
        with files.opened(config.chip_path) as f:
            data = numbers(f.read().decode().replace(",", " "))
    rows, cols = config.chip_rows, config.chip_cols
    if not (rows > 0 and cols > 0 and rows * cols <= len(data)):
        rows, cols = (1, len(data)) if data else (0, 0)
    return spark.createDataFrame([(k // cols, k % cols, float(data[k])) for k in range(rows * cols)], "row int, col int, value double")


def input_format(spark: SparkSession, path: str) -> str:
    """`phase_history`, `focused_image` or `raw_echo` by the names under path; nothing or both is an error."""
    names = files.listed(spark, path, recursive=True).select(F.lower("name").alias("name"))
    marks = {"focused_image": F.col("name").endswith(".ntf"), "phase_history": F.col("name").rlike(r"^data_3dsar_.*\.mat$"), "raw_echo": F.col("name").endswith(".npz")}
    found = names.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in marks.items()]).first().asDict()
    kinds = [n for n, seen in found.items() if seen]
    if len(kinds) != 1:
        raise ValueError(f"the input's format is not clear: {kinds or 'nothing is known here'}")
    return kinds[0]
