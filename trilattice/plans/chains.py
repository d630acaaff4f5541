"""Composed runs: measure, clean, measure again, and choice among candidate results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilattice.model import Mesh
from trilattice.operators import gate
from trilattice.operators import repair as R
from trilattice.operators.topology import MESH
from trilattice.session import stored


@dataclass
class Recipe:
    """A name and the phases to run, in this order, each optional."""

    name: str
    keep_touching_open: bool = True
    least_component: int = 1
    trim_rounds: int = 10
    weld_radius: float = 0.0
    swap_passes: int = 20
    smooth_rounds: int = 0
    limits: dict = field(default_factory=dict)


def cut(mesh: Mesh) -> Mesh:
    """The mesh as tables of the shared folder, so that a long chain of phases never grows its plan."""
    return Mesh(stored(mesh.nodes, "nodes"), stored(mesh.elements, "elements"), stored(mesh.boundary, "boundary"))


def clean(mesh: Mesh, recipe: Recipe) -> Mesh:
    """The phases of a recipe: components, dead ends, welding, flips, smoothing, compaction."""
    mesh = cut(R.keep_components(mesh, recipe.keep_touching_open, recipe.least_component))
    if recipe.trim_rounds:
        mesh = R.trim_dead_ends(mesh, recipe.trim_rounds)
    if recipe.weld_radius > 0:
        mesh = cut(R.weld(mesh, recipe.weld_radius))
    if recipe.swap_passes:
        mesh, _ = R.swap_until_stable(mesh, recipe.swap_passes)
    if recipe.smooth_rounds:
        mesh = R.smooth(mesh, recipe.smooth_rounds)
    return cut(R.compact(mesh))


def compare(before: Mesh, after: Mesh) -> DataFrame:
    """(mesh_id, metric, before, after, delta) of the fifteen metrics."""

    def long(mesh: Mesh, name: str) -> DataFrame:
        m = gate.metrics(mesh)
        pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(name)) for c in m.columns if c != MESH))
        return m.select(MESH, F.inline(pairs))

    return long(before, "before").join(long(after, "after"), [MESH, "metric"], "full").withColumn("delta", F.col("after") - F.col("before"))


def choose(candidates: dict[str, Mesh], limits: dict | None = None) -> str:
    """The candidate with the best mean alpha among those that pass the gate, the last if none does; NaN ranks lowest and ties go to the earlier."""
    best, found = None, list(candidates)[-1]
    for name, mesh in candidates.items():
        passed = gate.verdict(gate.report(mesh, limits)).where("not passed").isEmpty()
        alpha = gate.metrics(mesh).agg(F.avg(F.when(F.isnan("alpha_mean"), F.lit(-1.0)).otherwise(F.col("alpha_mean")))).first()[0]
        if passed and (best is None or alpha > best):
            best, found = alpha, name
    return found
