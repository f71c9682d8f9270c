"""Row-wise work in Arrow batches."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows worked on at a time, which bounds what a task holds beside its batch.
SLICE = 512


def map_batches(df: DataFrame, schema: str | StructType, make) -> DataFrame:
    """Map slices of rows. make() runs once a task and returns a function from a dict of
    Arrow columns to a dict of columns (lists or arrays) named in schema."""
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches):
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = work({n: part.column(i) for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
                     for f, c in ((f, made[f.name]) for f in arrow)], schema=arrow)

    return df.mapInArrow(run, kind)


def texts(column: pa.Array) -> list[str]:
    """The texts of a column; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def map_groups(df: DataFrame, keys: list[str], order: list[str], schema: str, work) -> DataFrame:
    """Map groups of rows with equal keys, one after another in a partition sorted by them.

    work(dict of column lists) returns a list of tuples. A group must be of bounded size.
    """
    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches):
        held, key, out = None, None, []

        def made():
            cols = list(zip(*out)) or [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE).to_pydict()
                names = list(part)
                ids = list(zip(*(part[k] for k in keys)))
                start = 0
                for i in range(1, len(ids) + 1):
                    if i < len(ids) and ids[i] == ids[start]:
                        continue
                    if held is not None and ids[start] == key:
                        for n in names:
                            held[n] += part[n][start:i]
                    else:
                        if held is not None:
                            out += work(held)
                        held, key = {n: part[n][start:i] for n in names}, ids[start]
                    start = i
                if len(out) > 4096:
                    yield made()
                    out = []
        if held is not None:
            out += work(held)
        yield made()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, kind)
