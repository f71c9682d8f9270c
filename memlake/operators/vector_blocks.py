"""Shared plumbing of the vector operators: bounded broadcasts, cells and tiles."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from memlake.functions import kernels

# A matrix is broadcast only below this size; larger sides are tiled.
BROADCAST_BYTES = 64 << 20
# Rows per side of one tile, and per part admitted in one task.
TILE_ROWS = 4096
# A cell is cut into so many parts a side before its tiles grow beyond their rows, and a side of a
# grown tile takes so many bytes at most. Rows are sent once for each part of the other side.
TILE_PARTS = 6
TILE_BYTES = 32 << 20
# Rows a cell should hold, and the most cells; the anchors of all cells are broadcast.
CELL_ROWS = 50_000
MAX_CELLS = 256
# Coordinates of a sketch, at least, and one for so many dimensions.
PIVOTS, PIVOT_DIMS = 16, 16


def schema_of(df: DataFrame, ddl: str):
    """DDL with `id` placeholders resolved -> (Spark schema, Arrow schema)."""
    spark_schema = _parse_datatype_string(ddl)
    return spark_schema, to_arrow_schema(spark_schema)


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def size_and_dim(df: DataFrame, column: str = "embedding") -> tuple[int, int]:
    row = df.agg(F.count("*"), F.max(F.size(column))).first()
    return row[0], row[1] or 0


def fetch(df: DataFrame) -> pa.Table:
    """A part whose size the caller has bounded, as one Arrow table."""
    return df.toArrow()


def share(df: DataFrame, payload: dict):
    return df.sparkSession.sparkContext.broadcast(payload)


def pick_anchors(df: DataFrame, n: int, dim: int, cells: int | None) -> np.ndarray:
    """A bounded number of vectors spread over the data by a hash of their id."""
    cells = cells or min(MAX_CELLS, max(1, -(-n // CELL_ROWS)))
    picked = fetch(df.select("embedding").orderBy(F.xxhash64("id"), "id").limit(cells))
    rows, usable = kernels.unit_rows(picked.column("embedding"), dim)
    return np.unique(rows[usable], axis=0).reshape(-1, dim)


def pick_pivots(anchors: np.ndarray) -> np.ndarray:
    """Orthonormal directions: of the anchors, then of a fixed draw where those are too few."""
    dim = anchors.shape[1]
    count = max(PIVOTS, dim // PIVOT_DIMS)
    fill = np.random.default_rng(5).standard_normal((min(count, dim), dim))
    basis, _ = np.linalg.qr(np.concatenate([anchors[:count], fill])[:max(dim, 1)].T)
    return basis.T[:count]


def tiles(homes: DataFrame, probes: DataFrame, tile_rows: int, row_bytes: int | None = None):
    """Split every cell into tiles of bounded size; each home row meets each probe once.

    Tiles of `tile_rows` a side are as many as the square of a cell's rows, and so are the copies
    that are sent. With `row_bytes` the tiles of a crowded cell grow first, up to `TILE_BYTES` a
    side; only then a crowded cell gets more tiles, not larger ones.
    """
    most = tile_rows if row_bytes is None else max(tile_rows, TILE_BYTES // max(1, row_bytes))

    def chunked(side: DataFrame, mine: str, other: str) -> DataFrame:
        own = F.pmod(F.xxhash64("id", F.lit(7)), F.col(mine))
        repeat = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1))
        return side.join(plan, "cell").withColumn(f"{mine}_no", own).withColumn(
            f"{other}_no", repeat
        ).drop(mine, other)

    def chunks(side: DataFrame, name: str) -> DataFrame:
        rows = F.count(F.lit(1))
        part = F.greatest(F.lit(tile_rows), F.least(F.ceil(rows / TILE_PARTS), F.lit(most)))
        return side.groupBy("cell").agg(F.ceil(rows / part).alias(name))

    plan = chunks(homes, "h").join(chunks(probes, "p"), "cell")
    keys = ["cell", "h_no", "p_no"]
    return chunked(homes, "h", "p").groupBy(*keys), chunked(probes, "p", "h").groupBy(*keys)


def tile_join(
    homes: DataFrame, probes: DataFrame, kernel, schema, tile_rows: int, row_bytes: int | None = None
) -> DataFrame:
    # Both sides may come from one frame; fresh names keep their columns apart.
    probes = probes.select(*[F.col(c).alias(c) for c in probes.columns])
    left, right = tiles(homes, probes, tile_rows, row_bytes)
    payload_l = [c for c in homes.columns if c != "cell"]
    payload_r = [c for c in probes.columns if c != "cell"]

    def run(left_table, right_table):
        return kernel(left_table.select(payload_l), right_table.select(payload_r))

    return left.cogroup(right).applyInArrow(run, schema)
