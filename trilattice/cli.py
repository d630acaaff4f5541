"""Commands over mesh files: check, quality, qa, clean, combine and export.

Exit codes: 0 fine, 1 something flagged, failed or refused, 2 a bad input.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilattice.model import Mesh
from trilattice.operators import detect, gate, repair, topology
from trilattice.plans import chains
from trilattice.session import local_session
from trilattice.sources import mesh_text, model_files


def _limits(pairs: list[str]) -> dict[str, float]:
    return {k: float(v) for k, v in (p.split("=", 1) for p in pairs)}


def _print(df: DataFrame) -> None:
    for r in df.toLocalIterator():
        print("\t".join(f"{c}={r[c]}" for c in df.columns))


def check(spark, a) -> int:
    """Counts of each detector; 1 if any flags anything."""
    mesh = mesh_text.read_mesh_text(spark, a.mesh[0])
    labels = topology.element_components(mesh.elements)
    found = {"disjoint": detect.disjoint(labels), "dead_end": detect.dead_ends(mesh), "thin": detect.thin(mesh), "thin_chain": detect.thin_chains(mesh, a.chain), "overconnected": detect.overconnected(mesh, a.cap), "unreachable": detect.unreachable(mesh, labels)}
    counts = {k: v.count() for k, v in found.items()}
    print("\n".join(f"{k}\t{n}" for k, n in counts.items()))
    return int(any(counts.values()))


def quality(spark, a) -> int:
    """The fifteen metrics of each mesh; the limits judge the last."""
    for path in a.mesh:
        metrics = gate.metrics(mesh_text.read_mesh_text(spark, path, path))
        _print(metrics)
    judged = gate.thresholds(metrics, _limits(a.least), _limits(a.most))
    _print(judged)
    return int(not judged.where("not passed").isEmpty())


def qa(spark, a) -> int:
    """The gate; 1 if the mesh fails."""
    report = gate.report(mesh_text.read_mesh_text(spark, a.mesh[0]), _limits(a.limit))
    _print(report)
    return int(not report.where("not passed").isEmpty())


def clean(spark, a) -> int:
    """Runs the phases and writes the mesh."""
    recipe = chains.Recipe("clean", a.keep_open, a.least, a.trim, a.weld, a.swaps, a.smooth)
    mesh_text.write_mesh_text(chains.clean(mesh_text.read_mesh_text(spark, a.mesh[0]), recipe), a.out)
    return 0


def combine(spark, a) -> int:
    """Two or more meshes side by side in one file."""
    if len(a.mesh) < 2:
        raise ValueError("at least two meshes are combined")
    all_ = [mesh_text.read_mesh_text(spark, p, f"{i:06d}") for i, p in enumerate(a.mesh)]
    union = all_[0]
    for m in all_[1:]:
        union = Mesh(union.nodes.unionByName(m.nodes), union.elements.unionByName(m.elements), union.boundary.unionByName(m.boundary))
    mesh_text.write_mesh_text(repair.combine(union), a.out)
    return 0


def export(spark, a) -> int:
    """The model's files; 1 if the mesh is refused."""
    mesh = mesh_text.read_mesh_text(spark, a.mesh[0])
    try:
        made = model_files.export_case(mesh, a.out, a.name, a.open_type, mesh.nodes.select("node_id", F.col("y").alias("cor")) if a.coriolis else None)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    print("\n".join(f"{k}\t{p}" for k, p in made.items()))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trilattice", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(f, *options) -> None:
        c = sub.add_parser(f.__name__, help=f.__doc__)
        c.add_argument("mesh", nargs="+")
        for name, kind, default in options:
            if kind is list:
                c.add_argument(f"--{name}", nargs="*", default=[])
            elif kind is bool:
                c.add_argument(f"--{name}", action="store_true")
            else:
                c.add_argument(f"--{name}", type=kind, default=default)
        c.set_defaults(run=f)

    command(check, ("chain", int, 3), ("cap", int, 8))
    command(quality, ("least", list, None), ("most", list, None))
    command(qa, ("limit", list, None))
    command(clean, ("out", str, "clean.14"), ("keep_open", bool, None), ("least", int, 1), ("trim", int, 10), ("weld", float, 0.0), ("swaps", int, 20), ("smooth", int, 0))
    command(combine, ("out", str, "combined.14"))
    command(export, ("out", str, "."), ("name", str, "case"), ("open_type", int, 1), ("coriolis", bool, None))
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(spark or local_session(), args)
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
