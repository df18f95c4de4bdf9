"""python -m orbweave MODE [--settings FILE] [--images PATH] [--reference FILE] [--resume] [section.key=value ...]

Modes: toml prints the settings; run reconstructs the images of a Parquet table (image_id, data); evaluate compares two MRC
volumes (--images and --reference): alignment, correlation and resolution.
"""

from __future__ import annotations

import argparse

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import evaluation
from .plans import reconstruct
from .plans.settings import load
from .sources import mrc
from .sources import tables


def volume(spark: SparkSession, path: str) -> np.ndarray:
    r = mrc.read_volumes(spark, path).first()
    return np.array(r["data"]).reshape(r["side"])


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="orbweave", description=__doc__)
    p.add_argument("mode", choices=["toml", "run", "evaluate"])
    p.add_argument("--settings")
    p.add_argument("--images")
    p.add_argument("--reference")
    p.add_argument("--resume", action="store_true")
    p.add_argument("overrides", nargs="*")
    a = p.parse_args(argv)
    s = load(a.settings, a.overrides)
    if a.mode == "toml":
        print(s.as_toml(), end="")
        return
    spark = SparkSession.builder.appName("orbweave").getOrCreate()
    reference = volume(spark, a.reference) if a.reference else None
    if a.mode == "run":
        images = spark.read.parquet(a.images)
        images = reconstruct.reduced(tables.range_scan(images, 0, s.n_images) if s.n_images else images, s)
        state = reconstruct.run(spark, images, tables.detector(spark, *s.reduced_det_shape[1:]), s, reference, a.resume)
        reconstruct.write_outputs(spark, s.out, state)
        print(f"generation {state.generation}, cc {state.cc:.4f}, converged {state.converged}")
        return
    moved, cc, _ = evaluation.align(spark, volume(spark, a.images), reference)
    flat = spark.createDataFrame([(i, [float(x) for x in v.ravel()]) for i, v in enumerate((moved, reference))], "vol_id long, data array<double>")
    f = evaluation.fourier(flat)
    pair = [f.where(F.col("vol_id") == n).select(F.lit(0).alias("pair"), F.col("re").alias(f"re{n + 1}"), F.col("im").alias(f"im{n + 1}")) for n in (0, 1)]
    curve = evaluation.shell_correlation(pair[0].join(pair[1], "pair"), reference.shape[0], 1.0, 0.1)
    print(f"cc {cc:.4f}, resolution {evaluation.resolution(curve).first()['resolution']:.3f}")


if __name__ == "__main__":
    main()
