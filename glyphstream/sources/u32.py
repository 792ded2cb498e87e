"""A data source of token streams: files of little-endian unsigned 32-bit ids, read by ranges and written a file a task.

Register with spark.dataSource.register(U32Source); then spark.read.format("u32").load(path) gives (pos, id), pos counting over the
files by name, and in_order(df).write.format("u32").mode("append").save(path) writes a file of the id column for each task, in task order.
Rows must ascend by pos within a task, and do by in_order across tasks; a later append comes after all earlier ones.
Paths must be mounted alike on the driver and executors; a URI of another store is an error.
"""

from __future__ import annotations

import glob
import os

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "pos bigint, id bigint"
WIDTH = 4


def local(path: str) -> str:
    found = path.removeprefix("file://").removeprefix("file:")
    if "://" in found:
        raise ValueError(f"{path}: this source reads and writes mounted paths only")
    return found


def in_order(df):
    """df (pos, id) dealt to tasks by ranges of pos and sorted within them."""
    return df.select("pos", "id").repartitionByRange("pos").sortWithinPartitions("pos")


class Range(InputPartition):
    def __init__(self, path: str, offset: int, count: int, pos: int):
        self.path, self.offset, self.count, self.pos = path, offset, count, pos


class Reader(DataSourceReader):
    def __init__(self, options):
        path = local(options["path"])
        self.files = [path] if os.path.isfile(path) else sorted(glob.glob(f"{path}/*.u32"))
        self.step = int(options.get("ids_per_partition", 1 << 24))
        self.batch = int(options.get("ids_per_batch", 1 << 16))

    def partitions(self):
        out, pos = [], 0
        for f in self.files:
            size = os.path.getsize(f)
            if size % WIDTH:
                raise ValueError(f"{f} is not whole ids: {size} bytes")
            for lo in range(0, size // WIDTH, self.step):
                count = min(self.step, size // WIDTH - lo)
                out.append(Range(f, lo * WIDTH, count, pos))
                pos += count
        return out or [Range("", 0, 0, 0)]

    def read(self, partition):
        import numpy as np
        import pyarrow as pa

        for lo in range(0, partition.count, self.batch):
            n = min(self.batch, partition.count - lo)
            ids = np.fromfile(partition.path, "<u4", n, offset=partition.offset + lo * WIDTH)
            first = partition.pos + lo
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), pa.array(ids.astype(np.int64))], ["pos", "id"])


class Written(WriterCommitMessage):
    def __init__(self, temporary: str, final: str):
        self.temporary, self.final = temporary, final


class Writer(DataSourceArrowWriter):
    """Tasks write hidden files; only those of the attempts that count get their names, so a lost executor leaves no second copy."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = local(options["path"]), overwrite

    def write(self, iterator):
        import uuid

        import numpy as np
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        name, last = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.u32", None
        at = f"{self.path}/.{name}"
        with open(at, "wb") as f:
            for b in iterator:
                pos = np.asarray(b.column(b.schema.get_field_index("pos")))
                if len(pos):
                    if (np.diff(pos) <= 0).any() or last is not None and pos[0] <= last:
                        raise ValueError("rows must ascend by pos within a task: write in_order(df)")
                    last = pos[-1]
                ids = np.asarray(b.column(b.schema.get_field_index("id")))
                if ids.dtype.kind not in "iu" or len(ids) and (ids.min() < 0 or ids.max() >= 1 << 32):
                    raise ValueError("ids must be whole numbers below 2 ** 32, without nulls")
                f.write(ids.astype("<u4").tobytes())
        return Written(at, name)

    def commit(self, messages):
        old = glob.glob(f"{self.path}/*.u32") if self.overwrite else []
        before = glob.glob(f"{self.path}/*.u32")
        number = 1 + max((int(os.path.basename(f).split("-")[1]) for f in before), default=-1)  # appends stay in order
        for m in messages:
            os.replace(m.temporary, f"{self.path}/part-{number:06d}-{m.final}")
        for f in old:
            os.remove(f)

    def abort(self, messages):
        for m in messages:
            if m and os.path.exists(m.temporary):
                os.remove(m.temporary)


class U32Source(DataSource):
    @classmethod
    def name(cls):
        return "u32"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options, overwrite)
