"""Ordered shards: a keyed, ordered table cut into rows that each hold a bounded stretch of one key.

A window over a key puts all rows of the key into one task. Here the rows are range-partitioned by key
and order, so a key with a third of all rows is spread like any other, and each sorted partition is cut
into shards of at most ``rows_per_shard`` rows, stored as arrays in one row. What must cross a shard's
border (last values, run lengths, neighbours) is computed by windows over the shards' short summaries.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_SHARD = 20_000


def pack(df: DataFrame, key: str, cut: str, order: list[str], arrays: list[str], rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Shards of df: ``key``, ``shard``, ``first`` and ``last`` (of ``cut``), ``n``, ``more`` and each of ``arrays`` as an array.

    shard is a number of its own for each shard, and orders the shards of a key. key is a string column, cut a long;
    rows of equal (key, cut) stay in one shard up to 8 times rows_per_shard of them. Beyond that they are in several, of
    which all but the last hold nothing else and have ``more``: first and last don't tell such shards apart. Rows are ordered by cut, then by ``order``. key and cut must not be null.
    arrays are long or double columns; a null in a double column becomes NaN.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for c in arrays:
        if not isinstance(kinds[c], T.LongType | T.DoubleType):
            raise TypeError(f"{c}: shards hold long and double columns")
    names = list(dict.fromkeys([key, cut, *order, *arrays]))
    rows = df.select([F.coalesce(F.col(c), F.lit(float("nan"))).alias(c) if isinstance(kinds[c], T.DoubleType) else F.col(c) for c in names])
    rows = rows.repartitionByRange(F.col(key), F.col(cut)).sortWithinPartitions(key, cut, *order)
    out = T.StructType(
        [T.StructField(key, T.StringType()), T.StructField("shard", T.LongType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("n", T.LongType()), T.StructField("more", T.BooleanType())]
        + [T.StructField(c, T.ArrayType(kinds[c], False)) for c in arrays]
    )
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()] + [pa.list_(pa.int64() if isinstance(kinds[c], T.LongType) else pa.float64()) for c in arrays]
    schema = pa.schema(list(zip(out.fieldNames(), types, strict=True)))

    def emit(name: str, shard: int, cuts: np.ndarray, more: bool, cols: list[np.ndarray]) -> pa.RecordBatch:
        values = [pa.array([name], pa.string()), pa.array([shard]), pa.array([int(cuts[0])]), pa.array([int(cuts[-1])]), pa.array([len(cuts)]), pa.array([more])]
        values += [pa.ListArray.from_arrays(pa.array([0, len(cuts)], pa.int32()), pa.array(c)) for c in cols]
        return pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, size = None, [], 0
        # Partitions are in order, and so are a partition's shards.
        shard = TaskContext.get().partitionId() << 40

        def flush(all_of_it: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, shard
            cuts = np.concatenate([h[0] for h in held])
            cols = [np.concatenate([h[1][k] for h in held]) for k in range(len(arrays))]
            at = 0
            while len(cuts) - at > rows_per_shard or (all_of_it and at < len(cuts)):
                end = min(at + rows_per_shard, len(cuts))
                if end < len(cuts):
                    # Not between rows of equal cut.
                    own = cuts[at:]
                    size_here = int(np.searchsorted(own, cuts[end], "left")) or int(np.searchsorted(own, own[0], "right"))
                    end = at + min(size_here, 8 * rows_per_shard)
                elif not all_of_it:
                    break
                if end == len(cuts) and not all_of_it:
                    break
                yield emit(name, shard, cuts[at:end], end < len(cuts) and bool(cuts[end] == cuts[end - 1]), [c[at:end] for c in cols])
                at, shard = end, shard + 1
            held, size = ([(cuts[at:], [c[at:] for c in cols])], len(cuts) - at) if at < len(cuts) else ([], 0)

        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).dictionary_encode() if not pa.types.is_dictionary(b.column(0).type) else b.column(0)
            codes = keys.indices.to_numpy(zero_copy_only=False)
            edges = [0, *(np.nonzero(np.diff(codes))[0] + 1).tolist(), len(codes)]
            cuts = b.column(names.index(cut)).to_numpy(zero_copy_only=False)
            cols = [b.column(names.index(c)).to_numpy(zero_copy_only=False) for c in arrays]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                k = keys.dictionary[int(codes[lo])].as_py()
                if k != name and held:
                    yield from flush(True)
                name = k
                held.append((cuts[lo:hi], [c[lo:hi] for c in cols]))
                size += hi - lo
                if size > 4 * rows_per_shard:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return rows.mapInArrow(run, out)


def along(key: str) -> Window:
    """The shards of a key in order."""
    return Window.partitionBy(key).orderBy("shard")
