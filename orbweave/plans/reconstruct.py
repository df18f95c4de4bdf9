"""The generations of a reconstruction: match, solve, phase, evaluate.

A generation is a few Spark jobs over the images (match and merge are two maps in one stage, so no image is shuffled; grids are
summed by key) and jobs over volumes of a fixed size. Each generation's result is a table under ``settings.out``, from which a run goes on where it was broken off.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detector, evaluation, matching, merging, phasing
from ..sources import mrc
from ..sources.tables import pixels, scratch
from .settings import Settings


@dataclass
class State:
    generation: int
    ac: np.ndarray
    support: np.ndarray
    rho: np.ndarray
    cc: float = 0.0
    converged: bool = False


def checkpoint_path(out: str, generation: int, tag: str = "") -> str:
    return f"{out.rstrip('/')}/generation_{generation}{'_' + tag if tag else ''}"


def save(spark: SparkSession, out: str, state: State, tag: str = "") -> None:
    flat = lambda v: [float(x) for x in np.asarray(v, dtype=float).ravel()]
    row = (state.generation, state.ac.shape[0], flat(state.ac), flat(state.support), flat(state.rho), state.cc, state.converged)
    schema = "generation int, side int, ac array<double>, support array<double>, rho array<double>, cc double, converged boolean"
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(checkpoint_path(out, state.generation, tag))


def load(spark: SparkSession, out: str, generation: int, tag: str = "") -> State:
    r = spark.read.parquet(checkpoint_path(out, generation, tag)).first()
    cube = lambda v: np.array(v).reshape((r["side"],) * 3)
    return State(r["generation"], cube(r["ac"]), cube(r["support"]) > 0, cube(r["rho"]), r["cc"], r["converged"])


def write_outputs(spark: SparkSession, out: str, state: State, voxel: float = 1.0) -> None:
    """Density, autocorrelation, its square and the intensity of a generation as MRC files, centred."""
    volumes = {
        "rho": np.fft.fftshift(state.rho),
        "ac": state.ac,
        "ac_squared": state.ac**2,
        "intensity": np.fft.fftshift(np.abs(np.fft.fftn(np.fft.ifftshift(state.ac)))),
    }
    for name, vol in volumes.items():
        mrc.write_volume(spark, f"{out.rstrip('/')}/{name}_{state.generation}.mrc", vol, voxel)


def saved_generations(spark: SparkSession, out: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(out)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
    found = [n.removeprefix("generation_") for n in names if n.startswith("generation_")]
    done = [int(x) for x in found if x.isdigit()]
    return sorted(g for g in done if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{checkpoint_path(out, g)}/_SUCCESS")))


def reduced(images: DataFrame, s: Settings) -> DataFrame:
    """Images clipped and binned as the settings say, wide again."""
    if not s.n_clipping and not s.n_binning:
        return images
    panels, rows, cols = s.det_shape
    px = pixels(images, rows, cols)
    if s.n_clipping:
        px = detector.clip(px, s.n_clipping, rows, cols, panels)
    if s.n_binning:
        px = detector.bin_pixels(px, s.n_binning, "mean")
    every = F.array_sort(F.collect_list(F.struct("panel", "r", "c", "v")))  # one image's pixels
    return px.groupBy("image_id").agg(F.transform(every, lambda x: x["v"]).alias("data"))


def positions(det: DataFrame, oversampling: float) -> np.ndarray:
    """3 x pixels, in radians; the detector has a fixed size."""
    rows = det.orderBy("panel", "r", "c").select("qx", "qy", "qz").collect()
    q = np.array([list(r) for r in rows]).T
    return q * math.pi / (np.sqrt((q * q).sum(0)).max() * oversampling)


def random_orientations(images: DataFrame, seed: int) -> DataFrame:
    """images with q: a rotation drawn from a hash of the image's id, the same each time."""
    from ..functions.quaternion import uniform

    u = [(F.pmod(F.xxhash64("image_id", F.lit(seed), F.lit(i)), F.lit(1 << 52)) / float(1 << 52)) for i in range(3)]
    return images.withColumn("q", F.array(*uniform(tuple(u))))


def _winner(solved: DataFrame, first: bool) -> np.ndarray:
    best = (merging.select_first if first else merging.select_corner)(solved.drop("data")).first()["member"]
    return np.array(solved.where(F.col("member") == best).first()["data"])


def generation(spark: SparkSession, images: DataFrame, det: DataFrame, s: Settings, last: State | None, reference: np.ndarray | None, scratch: str) -> State:
    """One generation. images: image_id, data."""
    n, at = s.m, positions(det, s.oversampling)
    number = 0 if last is None else last.generation + 1
    if last is None:
        oriented = random_orientations(images, s.seed)
    else:
        oriented = matching.match_model(images, last.ac, evaluation.uniform_rotations(s.n_orientations), at, s.match_scale, s.match_batch)
    grids = merging.normal_grids(oriented.withColumn("member", F.lit(0)), at, n)
    grids.write.mode("overwrite").parquet(f"{scratch}/grids_{number}")
    grids = spark.read.parquet(f"{scratch}/grids_{number}")
    values = images.count() * at.shape[1]
    lambdas = merging.lambda_grid(spark, s.members, max(1, values), n)
    solved = merging.solve(grids, lambdas, n, None if last is None else last.ac, s.oversampling, s.solve_steps)
    solved.write.mode("overwrite").parquet(f"{scratch}/solved_{number}")
    ac = _winner(spark.read.parquet(f"{scratch}/solved_{number}"), last is None).reshape(n, n, n)
    runs = phasing.ensemble(spark, ac, s.members, s, None if last is None else last.support, None if last is None else last.rho, s.seed)
    runs.write.mode("overwrite").parquet(f"{scratch}/phased_{number}")
    runs = spark.read.parquet(f"{scratch}/phased_{number}")
    best = runs.orderBy("skew", "member").first()
    cube = lambda v: np.array(v).reshape(n, n, n)
    state = State(number, cube(best["ac"]), cube(best["support"]) > 0, cube(best["rho"]))
    if reference is not None:
        _, state.cc, _ = evaluation.align(spark, np.fft.fftshift(state.rho), reference, coarse=60, best=1, fine=12, rounds=3, seed=s.seed)
        history = [(number - 1, 0.0 if last is None else last.cc), (number, state.cc)]
        judged = evaluation.convergence(spark.createDataFrame(history, "generation int, cc double"), s.min_cc, s.min_change_cc, s.absolute_change)
        state.converged = judged.where(F.col("generation") == number).first()["converged"]
    return state


def run(spark: SparkSession, images: DataFrame, det: DataFrame, s: Settings, reference: np.ndarray | None = None, resume: bool = False) -> State:
    """All generations, or as many as it takes to converge. Raises if convergence is asked for and not met."""
    if s.check_convergence and reference is None:
        raise ValueError("convergence is judged against a reference density; none is given")
    out = s.out or scratch(spark)
    last = None
    if resume and (found := saved_generations(spark, out)):
        last = load(spark, out, found[-1])
    while (last is None or last.generation + 1 < s.n_generations) and not (last and s.check_convergence and last.converged):
        last = generation(spark, images, det, s, last, reference, f"{out}/scratch")
        save(spark, out, last)
    if s.check_convergence and not last.converged:
        raise RuntimeError(f"not converged after {last.generation + 1} generations: cc {last.cc:.3f}")
    return last
