"""Meshes that arrive over time: the gate over each micro-batch of complete meshes.

The batch operators are used as they are. A micro-batch holds whole meshes, as a writer drops a mesh's element file last;
nodes and boundaries are read beside it as tables that exist by then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from trilattice.model import ELEMENTS, Mesh
from trilattice.operators import gate


def watch(spark: SparkSession, elements_path: str, nodes: Callable[[], DataFrame], boundary: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Runs the gate on the meshes of each batch of new element files and hands its report to `sink(report, batch_id)`.

    The batch id makes the sink idempotent after a restart: a batch that was handed over and not committed comes again
    under the same id.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        ids = batch.select("mesh_id").distinct()
        mesh = Mesh(nodes().join(ids, "mesh_id", "left_semi"), batch, boundary().join(ids, "mesh_id", "left_semi"))
        sink(gate.report(mesh), batch_id)

    stream = spark.readStream.schema(ELEMENTS).parquet(elements_path)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
