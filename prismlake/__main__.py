"""Command line of the media index: python -m prismlake --folder PHOTOS --out FOLDER."""

from __future__ import annotations

import argparse
import logging

from prismlake.operators import geocode
from prismlake.operators.dedup import THRESHOLD
from prismlake.operators.resume import ROWS
from prismlake.plans import config
from prismlake.plans.engine import MediaIndex
from prismlake.sources.tools import Tools


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="prismlake", description=__doc__)
    p.add_argument("--print-config-example", action="store_true", help="print a settings file and end")
    p.add_argument("--folder", help="folder of the media files, which all executors see")
    p.add_argument("--out", default=".", help="folder of the index files")
    p.add_argument("--stem", default="index", help="name of the index files before their number")
    p.add_argument("--exclude", default="", help="names of folders to leave out, comma list")
    p.add_argument("--resume", action="store_true", help="index only files that the index hasn't, and go on behind it")
    p.add_argument("--rotate-rows", type=int, default=ROWS, help="rows of an index file, 0 for one file")
    p.add_argument("--dedup-threshold", type=int, default=THRESHOLD, help="bits of alike pictures that may differ")
    p.add_argument("--no-dedup", action="store_true")
    p.add_argument("--models-dir", help="folder of the face models")
    p.add_argument("--reference", help="folder with a sub-folder of photos for each person")
    p.add_argument("--tools-dir", help="folder with programs for videos and HEIC pictures")
    p.add_argument("--geocoder", help="address of a reverse geocoder; off without")
    p.add_argument("--geocoder-agent", default="prismlake", help="how to sign requests to it")
    p.add_argument("--cells", help="table of places that is kept between runs")
    p.add_argument("--no-vision", action="store_true", help="never send pictures")
    p.add_argument("--config", help="settings file of the service that describes pictures")
    p.add_argument("--legacy-config", help="settings file with names that end in 2")
    for name in ("provider", "endpoint", "model"):
        p.add_argument(f"--{name}", default="")
    p.add_argument("--max-tokens", type=int, default=0)
    p.add_argument("--ollama", default="", help="address of a service with that protocol")
    p.add_argument("--ollama-model", default="")
    p.add_argument("--tasks", type=int, default=4, help="calls of the service at once")
    return p


def index_of(args: argparse.Namespace) -> MediaIndex:
    """The run that the arguments ask for. A key is read from the environment or a settings file only."""
    if args.ollama:
        service = config.VisionConfig("ollama", args.ollama, args.ollama_model)
    else:
        service = config.resolve(config.VisionConfig(args.provider, args.endpoint, args.model, "", args.max_tokens), args.config, args.legacy_config)
    return MediaIndex(
        args.folder, args.out, args.stem, args.exclude, args.resume, None if args.no_dedup else args.dedup_threshold, args.rotate_rows, fetch=geocode.service(args.geocoder, args.geocoder_agent) if args.geocoder else None,
        cells=args.cells, tools=Tools.found(args.tools_dir), models=args.models_dir, people=args.reference, vision=None if args.no_vision else service, ollama=bool(args.ollama), tasks=args.tasks,
    )


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.print_config_example:
        print(config.EXAMPLE, end="")
        return 0
    if not args.folder:
        parser().error("--folder is needed")
    from pyspark.sql import SparkSession

    from prismlake.plans.shipping import ship

    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("prismlake").getOrCreate()
    ship(spark)
    index = index_of(args)
    for path in index.build(spark):
        print(path)
    print(", ".join(f"{k} {n}" for k, n in index.counts.items()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
