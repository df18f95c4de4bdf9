"""A reconstruction over a growing set of images."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..streaming.generations import run_stream, stored
from . import reconstruct
from .settings import Settings


def run(
    spark: SparkSession, source: DataFrame, det: DataFrame, s: Settings, size: int, cap: int | None = None, warm_start: bool = True,
    per_round: int = 1, reference: np.ndarray | None = None,
) -> reconstruct.State | None:
    """A round each time another ``size`` images are in, over all images so far, up to ``cap``; past it, each further image triggers one.

    With a warm start a round goes on from the last density for ``per_round`` generations; without it every round begins anew
    from random orientations. After the source has ended, generations go on over the same images until ``n_generations``, or
    until the density has converged.

    Started again with the same ``s.out``, it goes on after the last generation that ended: images, rounds and densities are read
    from there.
    """
    state: dict = {"last": None, "n": 0}
    if warm_start and (found := reconstruct.saved_generations(spark, s.out)):
        state["last"], state["n"] = reconstruct.load(spark, s.out, found[-1]), found[-1] + 1

    def over() -> bool:
        return state["n"] >= s.n_generations or bool(s.check_convergence and state["last"] and state["last"].converged)

    def generations(images: DataFrame, upto: int) -> bool:
        last = state["last"] if warm_start else None
        while state["n"] < upto and not over():
            last = reconstruct.generation(spark, images, det, s, last, reference, f"{s.out}/scratch")
            reconstruct.save(spark, s.out, last)
            state["last"], state["n"] = last, state["n"] + 1
        return over()

    def full(k: int, images: DataFrame) -> bool:
        if not warm_start:
            state["n"] = k * per_round
        return generations(images, (k + 1) * per_round)

    rounds = -(-s.n_generations // per_round)
    run_stream(spark, source, f"{s.out}/store", f"{s.out}/stream", size, full, cap, rounds)
    images = stored(spark, f"{s.out}/store", cap)
    while images is not None and not over():
        generations(images, state["n"] + 1 if warm_start else s.n_generations)
    return state["last"]
