"""Look into container files and export their frames.

    python -m cadenza info FILE
    python -m cadenza export FILE FOLDER [--fmt png]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cadenza.operators import codec
from cadenza.session import ship
from cadenza.sources import container, export


def session() -> SparkSession:
    spark = SparkSession.builder.appName("cadenza").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    ship(spark)
    return spark


def info(path: str) -> list[str]:
    """A line for each fact of the containers at path."""
    out = []
    of = container.describe(container.files(session(), path))
    for r in of.orderBy("path").toLocalIterator():
        out += [
            r["path"], f"  resolution {r['width']} x {r['height']}", f"  fps        {r['fps']:g}", f"  frames     {r['frames']}", f"  duration   {r['seconds']:.1f} s",
            f"  bytes      {r['bytes']}", f"  raw bytes  {r['raw_bytes']}", f"  ratio      {r['ratio']:.1f}", f"  cycles     {r['n_cycles']}",
        ]
    return out


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="cadenza", description="Look into container files and export their frames.")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("info", help="what a container, or each of a folder, says of itself")
    one.add_argument("file")
    two = commands.add_parser("export", help="write a container's frames as files")
    two.add_argument("file")
    two.add_argument("output")
    two.add_argument("--fmt", choices=["auto", "png", "jpeg", "mp4"], default="auto")
    got = parser.parse_args(arguments)
    if got.command == "info":
        print("\n".join(info(got.file)))
        return
    frames = codec.decode(container.files(session(), got.file), key="path")
    many = frames.select("path").distinct().limit(2).count() > 1

    def show(k: int, total: int) -> None:
        if k + 1 == total or k % 100 == 0:
            print(f"{k + 1} of {total} frames", flush=True)

    n = export.export(frames.withColumn("name", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)), got.output, got.fmt, key="name" if many else None, on_progress=show)
    print(f"{n} files below {got.output}")


if __name__ == "__main__":
    main()
