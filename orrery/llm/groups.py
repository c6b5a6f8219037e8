"""Groups of documents as rows of a table: what one call of a numpy kernel works on, the same in every pass.

A task packs the rows it reads, in their order, into groups of at most ``most`` text bytes (a longer text alone)
and writes them to the shared folder.  No key decides the group, so neither a hot source nor copies, not even
repeated rows, meet in one task; and since the groups are written, later passes see the same ones however often
they are run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from orrery.llm import textblocks as tb
from orrery.llm.runtime import arrow_limits, table

_OPTIONS = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))


def to_blob(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=_OPTIONS) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def from_blob(blob: bytes | pa.Buffer) -> pa.Table:
    with pa.ipc.open_stream(blob) as stream:
        return stream.read_all().combine_chunks()


def _pack(most: int, extra: Callable[[pa.Table], bytes] | None, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, size, nth = TaskContext.get().partitionId(), [], 0, 0

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            own = [pa.array([task << 36 | nth], pa.int64()), pa.array([to_blob(rows)], pa.binary())]
            if extra is not None:
                own.append(pa.array([extra(rows)], pa.binary()))
            return pa.record_batch(own, ["grp", "rows", "more"][: len(own)])

        for block in (x for batch in batches for x in tb.blocks(batch, column, most)):
            n = block.column(column).nbytes
            if held and size + n > most:
                yield flush()
                held, size, nth = [], 0, nth + 1
            held.append(block)
            size += n
        if held:
            yield flush()

    return run


def packed(docs: DataFrame, most: int, extra: Callable[[pa.Table], bytes] | None = None, column: str = "text") -> DataFrame:
    """grp and rows (a blob with all columns of ``docs``) of every group; with ``extra``, also ``more``: its result for the rows."""
    arrow_limits(docs.sparkSession)
    return table(docs.mapInArrow(_pack(most, extra, column), "grp long, rows binary" + ", more binary" * (extra is not None)), "groups")
