"""Commands: python -m echogrid {form,ingest,convert,compare,analyze,validate,query} ..."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from pyspark.sql import functions as F

from .operators import chain, measure
from .plans import formation, queries
from .session import session
from .sources import binary, configs, frames, products, tape


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="echogrid", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *arguments: str) -> argparse.ArgumentParser:
        one = commands.add_parser(name, help=text)
        for a in arguments:
            one.add_argument(a)
        return one

    one = command("form", "an image set with its report from phase histories (a folder) or raw echoes (.npz)", "source", "target")
    for f in dataclasses.fields(formation.Scene):
        several = {"origin": 4, "focus_point": 3}.get(f.name)
        kind = float if several else type(f.default) if f.default is not None else str
        one.add_argument(f"--{f.name.replace('_', '-')}", type=kind, default=f.default, **({"nargs": several} if several else {}))
    one = command("ingest", "a tape as .dat, .vts, .hdr and .ssp", "tape", "prefix")
    one.add_argument("--complex", action="store_true", help="complex floats instead of signed bytes")
    one.add_argument("--best-effort", action="store_true", help="go on behind a record without its sync word")
    command("convert", "a tape as a product of magnitudes", "tape", "product")
    one = command("compare", "two rasters: 0 if they agree, 1 if not, 2 if they can't be compared", "first", "second")
    one.add_argument("--atol", type=float, default=0.0)
    one.add_argument("--rtol", type=float, default=0.0)
    command("analyze", "a chip's report, as its configuration says", "config")
    one = command("validate", "a report on all scans, or frames, under a folder; 1 if one is not valid", "path")
    one.add_argument("--report")
    command("query", "one registered query over a folder of tables", "name", "tables")
    return top


def main(arguments: list[str] | None = None) -> int:
    a = _parser().parse_args(arguments)
    spark = session(f"echogrid-{a.command}")
    if a.command == "form":
        given = {f.name: getattr(a, f.name) for f in dataclasses.fields(formation.Scene)}
        scene = formation.Scene(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
        print(json.dumps(formation.form_scene(spark, a.source, a.target, scene), indent=2))
        return 0
    if a.command == "ingest":
        return 0 if tape.ingest(spark, a.tape, a.prefix, a.complex, not a.best_effort) else 1
    if a.command == "convert":
        tape.to_product(spark, a.tape, a.product)
    elif a.command == "compare":
        images = [binary.read(spark, "floatraster", p).select("row", F.posexplode("value").alias("col", "value")) for p in (a.first, a.second)]
        found = measure.compare_images(*images, a.atol, a.rtol).first().asDict()
        print(json.dumps(found))
        return 2 if found["unmatched"] or not found["pixels"] else int(found["failures"] > 0)
    elif a.command == "analyze":
        config = configs.load_analysis(a.config)
        form = config.report_format if config.report_format in ("json", "text") else "text"
        products.write_report(config.report_path, chain.chip_report(spark, configs.chip_frame(spark, config), config), form)
    elif a.command == "validate":
        found = [r.asDict() for r in frames.validated(frames.discovered(spark, a.path)).orderBy("path", "stage").collect()]
        if a.report:
            products.write_json(a.report, found)
        else:
            print(json.dumps(found, indent=2))
        return int(not found or not all(r["valid"] for r in found))
    else:
        queries.queries()[a.name](spark, a.tables).show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
