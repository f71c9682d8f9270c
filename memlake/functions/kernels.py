"""NumPy work inside Arrow tasks: similarity blocks, local top-k, first blockers.

Spark partitions, shuffles and merges; each function here sees one Arrow batch or one
bounded tile. The module is pickled by value, so executors need no copy of the package.
"""

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Similarities are compared and ranked at this many decimals, so that equal vectors tie
# however a matrix product orders its sums.
DECIMALS = 12
# Score cells held at once by one task.
BLOCK_CELLS = 4_000_000
# Rows a side of a block of single-precision scores.
BLOCK_ROWS = 1024
_NO_VECTOR = -2.0
# Wider than the rounding of an angle.
_ANGLE_SLACK = 1e-6
# Nearest anchors whose planes bound which cells a row visits.
PLANES = 8
# Wider than the rounding of sketches, which are kept as floats.
_SKETCH_SLACK = 1e-5
# Wider than any rounding; what falls inside it is rounded and compared again.
_SLACK = 1e-9
# Wider than the rounding of a product of unit vectors in single precision, for each dimension.
_FLOAT_SLACK = 2e-7


def unit_rows(column, dim):
    """Arrow list column -> (unit rows, usable mask). Null, zero and non-finite vectors, and ones
    whose squared length overflows, are unusable; their rows are zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    present = lengths >= 0
    if np.any(lengths[present] != dim):
        raise ValueError(f"different vector dimensions: expected {dim}")
    out = np.zeros((n, dim))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[present] = flat.astype(np.float64, copy=False).reshape(-1, dim)
    with np.errstate(over="ignore", invalid="ignore"):
        norms = np.sqrt(np.einsum("ij,ij->i", out, out))
    usable = present & (norms > 0) & np.isfinite(norms)
    out[~usable] = 0
    out[usable] /= norms[usable, None]
    return out, usable


def unit_vector(vector):
    v = np.asarray(vector, dtype=np.float64)
    norm = np.sqrt(v @ v)
    return v / norm if norm > 0 and np.isfinite(norm) else None


def _blocks(rows, others):
    """Ranges (lo, hi, first, last) of a product of so many rows by so many others, in blocks that stay
    small whatever the sides are."""
    for lo in range(0, rows, BLOCK_ROWS):
        for first in range(0, others, BLOCK_ROWS):
            yield lo, min(rows, lo + BLOCK_ROWS), first, min(others, first + BLOCK_ROWS)


def _pairs(mask):
    """Row and column of what is set; much faster than nonzero where that is little."""
    at = np.flatnonzero(mask)
    return at // mask.shape[1], at % mask.shape[1]


def above(rows, others, threshold):
    """Mask of the pairs whose rounded similarity exceeds the threshold."""
    block = rows @ others.T
    hit = block > threshold - _SLACK
    near = np.nonzero(hit)
    hit[near] = np.round(block[near], DECIMALS) > threshold
    return hit


def sortable(column):
    """Id column as a NumPy array that lexsort accepts, in the order Spark gives it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def micros(column):
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def similarity_to(vector):
    """Scalar Arrow function: cosine similarity of each row to one vector."""
    query = unit_vector(vector)
    dim = len(vector)

    def score(column: pa.Array) -> pa.Array:
        rows, usable = unit_rows(column, dim)
        if query is None:
            return pa.nulls(len(column), pa.float64())
        return pa.array(np.round(rows @ query, DECIMALS), mask=~usable)

    return score


def _best(query, score, ident, limits):
    """Keep the first limits[q] of each query by score, then id."""
    order = np.lexsort((ident, -score, query))
    query, score, ident = query[order], score[order], ident[order]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    keep = rank < limits[query]
    return query[keep], score[keep], ident[keep]


def _exact(asks, rows, query, row):
    """Similarities of single pairs, as they are compared and ranked."""
    out = np.empty(len(query))
    for lo in range(0, len(query), 1 << 15):
        part = slice(lo, lo + (1 << 15))
        out[part] = np.einsum("ij,ij->i", asks[query[part]], rows[row[part]])
    return np.round(out, DECIMALS)


class _Bests:
    """The best rows of each of some queries, among all rows that have been met.

    Blocks of scores in single precision are compared with what a query's last kept row has
    reached; only pairs that may be better are scored exactly, filtered and kept.
    """

    def __init__(self, asks, asked, limits, ask, floor=None):
        self.asks, self.asked, self.limits, self.ask = asks, asked, limits, ask
        self.single = asks.astype(np.float32)
        self.k = int(limits.max()) if len(limits) else 0
        self.least = np.full(len(asks), -np.inf) if floor is None else floor.astype(np.float64)
        self.slack = _FLOAT_SLACK * (8 + asks.shape[1])
        self.parts = []  # by range of queries: query, score, id

    def meet(self, batch, names, rows, usable, complete):
        seen = _Seen(batch, names, self.ask)
        ident, single = sortable(batch.column("id")), rows.astype(np.float32).T.copy()
        gaps = None if usable.all() else ~usable
        parts = []
        for no, lo in enumerate(range(0, len(self.asks), BLOCK_ROWS)):
            hi = min(len(self.asks), lo + BLOCK_ROWS)
            held = self.parts[no] if self.parts else None
            new, count = [] if held is None else [held], 0
            for first in range(0, len(rows), BLOCK_ROWS):
                last = min(len(rows), first + BLOCK_ROWS)
                block = self.single[lo:hi] @ single[:, first:last]
                dumb = ~self.asked[lo:hi]
                if gaps is not None:
                    block[:, gaps[first:last]] = _NO_VECTOR if complete else -np.inf
                if dumb.any():
                    block[dumb] = _NO_VECTOR if complete else -np.inf
                found = self._likely(block, lo, first, seen)
                query, row = found[0] + lo, found[1] + first
                score = _exact(self.asks, rows, query, row)
                score[~(usable[row] & self.asked[query])] = _NO_VECTOR
                new.append((query, score, ident[row]))
                count += len(query)
                if count > 4 * self.k * (hi - lo):
                    new, count = [self._merged(new)], 0
            parts.append(self._merged(new))
        self.parts = parts

    def _likely(self, block, lo, first, seen):
        """Pairs of a block that may be among the best, filtered; ties included."""
        least = self.least[lo : lo + len(block)]
        fresh = np.flatnonzero(least == -np.inf)
        edge = (least - self.slack).astype(np.float32)
        edge[fresh] = np.inf
        query, row = _pairs(block >= edge[:, None])
        ok = seen.pairs(query + lo, row + first)
        query, row = query[ok], row[ok]
        if len(fresh):
            # no floor yet: the k best of this block, which is a floor from now on
            mine = block[fresh]
            ok = seen.dense(fresh + lo, slice(first, first + block.shape[1])) & (mine > -np.inf)
            if mine.shape[1] > self.k:
                mine[~ok] = -np.inf
                last = np.partition(mine, mine.shape[1] - self.k, axis=1)[:, mine.shape[1] - self.k]
                ok &= mine >= (last - 2 * self.slack)[:, None]
                full = last > -np.inf
                self.least[lo + fresh[full]] = last[full] - self.slack
            some, other = _pairs(ok)
            query, row = np.concatenate((query, fresh[some])), np.concatenate((row, other))
        return query, row

    def _merged(self, new):
        query, score, ident = _best(*(np.concatenate(p) for p in zip(*new)), self.limits)
        if len(query):
            starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
            count = np.diff(np.r_[starts, len(query)])
            full = count >= self.limits[query[starts]]
            who = query[starts[full]]
            self.least[who] = np.maximum(self.least[who], score[starts[full] + count[full] - 1])
        return query, score, ident

    def found(self):
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        return tuple(np.concatenate(p) for p in zip(*self.parts))


def filters_of(table):
    """What each query of an Arrow table may see: entry_type, project, until, exclude."""
    ask = {name: table.column(name).to_pylist() for name in ("entry_type", "project") if name in table.column_names}
    if "visible_until" in table.column_names:
        until = table.column("visible_until").combine_chunks().cast(pa.int64())
        ask["until"] = until.fill_null(np.iinfo(np.int64).max).to_numpy()
    if "exclude_id" in table.column_names:
        exclude = table.column("exclude_id").combine_chunks()
        missing = "" if pa.types.is_string(exclude.type) else np.iinfo(np.int64).min
        ask["exclude"] = sortable(exclude.fill_null(missing))
    return ask


class _Seen:
    """Which rows of an Arrow batch each query may see, for a block of pairs or for single ones."""

    def __init__(self, batch, names, ask):
        self.tests = []  # (row values, query values, comparison)
        if "entry_type" in names:
            kinds = {kind: no for no, kind in enumerate(sorted({k for k in ask["entry_type"] if k}))}
            rows = np.array([kinds.get(k, -1) for k in batch.column("entry_type").to_pylist()])
            asked = np.array([kinds[k] if k else -2 for k in ask["entry_type"]])
            self.tests.append((rows, asked, lambda row, query: (row == query) | (query == -2)))
        if "projects" in names:
            known = {p: no for no, p in enumerate(sorted({p for p in ask["project"] if p}))}
            tags = batch.column("projects")
            owner = np.repeat(np.arange(batch.num_rows), tags.value_lengths().fill_null(0).to_numpy())
            flat = np.array([known.get(t, -1) for t in tags.flatten().to_pylist()], dtype=np.int64)
            has = np.zeros((len(known) + 1, batch.num_rows), dtype=bool)
            has[flat[flat >= 0], owner[flat >= 0]] = True
            has[-1] = True  # no project asked for
            asked = np.array([known[p] if p else len(known) for p in ask["project"]], dtype=np.int64)
            self.tests.append((np.arange(batch.num_rows), asked, lambda row, query: has[query, row]))
        if "created_at" in names:
            self.tests.append((micros(batch.column("created_at")), ask["until"], lambda row, query: row <= query))
        if ask.get("exclude") is not None:
            self.tests.append((sortable(batch.column("id")), ask["exclude"], lambda row, query: row != query))

    def dense(self, queries, rows):
        """Queries down, a range of rows across."""
        ok = np.ones((len(queries), rows.stop - rows.start), dtype=bool)
        for row, query, test in self.tests:
            ok &= test(row[None, rows], query[queries][:, None])
        return ok

    def pairs(self, queries, rows):
        ok = np.ones(len(queries), dtype=bool)
        for row, query, test in self.tests:
            ok &= test(row[rows], query[queries])
        return ok


def scan_top_k(shared, schema):
    """mapInArrow: per partition, the best rows of each broadcast query."""

    def run(batches):
        ask = shared.value
        matrix, limits = ask["matrix"], ask["limits"]
        best = _Bests(matrix, ask["usable"], limits, ask)
        for batch in batches:
            if not batch.num_rows or best.k <= 0:
                continue
            rows, usable = unit_rows(batch.column("embedding"), matrix.shape[1])
            best.meet(batch, batch.schema.names, rows, usable, True)
        query, val, ident = best.found()
        if len(query):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ask["query_id"][query], schema.field(0).type),
                    pa.array(ident, schema.field(1).type),
                    pa.array(val, mask=val <= _NO_VECTOR),
                    pa.array(limits[query], pa.int32()),
                ],
                schema=schema,
            )

    return run


def scan_matches(shared, threshold, schema):
    """mapInArrow: ids of broadcast vectors that some row of the partition resembles."""

    def run(batches):
        ask = shared.value
        matrix = ask["matrix"]
        open_ = np.arange(len(matrix))
        for batch in batches:
            if not batch.num_rows or not len(open_):
                continue
            rows, usable = unit_rows(batch.column("embedding"), matrix.shape[1])
            rows = rows[usable]
            step = max(1, BLOCK_CELLS // max(1, len(rows)))
            found = np.zeros(len(open_), dtype=bool)
            for lo in range(0, len(open_), step):
                part = open_[lo : lo + step]
                found[lo : lo + step] = above(rows, matrix[part], threshold).any(axis=0)
            if found.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ask["id"][open_[found]], schema.field(0).type)], schema=schema
                )
                open_ = open_[~found]

    return run


def scan_unlike(shared, threshold):
    """mapInArrow: the rows that resemble none of the broadcast vectors."""

    def run(batches):
        matrix = shared.value["matrix"]
        for batch in batches:
            rows, usable = unit_rows(batch.column("embedding"), matrix.shape[1])
            keep = np.ones(batch.num_rows, dtype=bool)
            open_ = np.flatnonzero(usable)
            step = max(1, BLOCK_CELLS // max(1, batch.num_rows))
            for lo in range(0, len(matrix), step):
                near = above(rows[open_], matrix[lo : lo + step], threshold).any(axis=1)
                keep[open_[near]] = False
                open_ = open_[~near]
            yield batch.filter(pa.array(keep))

    return run


def nearest_cells(anchors, pivots, chord, schema):
    """mapInArrow: each row's sketch instead of its vector, its own cell, and every cell that may
    hold a partner of it.

    A row belongs to the cell of its nearest anchor. A partner y of x is at most `chord` away, and
    where y is nearer to anchor c than to k, it lies on c's side of the plane between them. So x
    is at most `chord` beyond that plane, whichever k is taken: (x.k - x.c) <= |k - c| * chord. Of
    all k the ones nearest to x say most. A sketch is a row's coordinates along orthonormal
    pivots; sketches are never farther apart than their rows.
    """

    def run(batches):
        apart = np.sqrt(np.maximum(0, 2 - 2 * anchors @ anchors.T)) * chord + _SLACK
        names = [n for n in schema.names if n not in ("sketch", "cell", "home")]
        for batch in batches:
            rows, usable = unit_rows(batch.column("embedding"), anchors.shape[1])
            dots = rows @ anchors.T
            home = dots.argmax(axis=1)
            reach = np.ones(dots.shape, dtype=bool)
            for k in np.argsort(-dots, axis=1, kind="stable")[:, :PLANES].T:
                reach &= dots[np.arange(len(k)), k][:, None] - dots <= apart[k]
            reach[np.arange(len(home)), home] = True
            reach[~usable] = False
            row, cell = np.nonzero(reach)
            sketch = (rows @ pivots.T).astype(np.float32)[row]
            flat = pa.ListArray.from_arrays(
                pa.array(np.arange(len(row) + 1, dtype=np.int32) * pivots.shape[0]), pa.array(sketch.ravel())
            )
            keep = pa.array(row)
            columns = [batch.column(name).take(keep) for name in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, flat.cast(schema.field("sketch").type), pa.array(cell, pa.int64()), pa.array(home[row] == cell)],
                schema=schema,
            )

    return run


def tile_near(chord, schema):
    """Cogrouped tile: the ids of home rows and of probes that have a partner by their sketches.

    With positions, only pairs whose home is not later than the probe count. No pair leaves.
    """

    def sketches(table):
        column = table.column("sketch").combine_chunks()
        return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)

    def run(homes, probes):
        if not homes.num_rows or not probes.num_rows:
            return schema.empty_table()
        left, right = sketches(homes), sketches(probes)
        l_id, r_id = sortable(homes.column("id")), sortable(probes.column("id"))
        ordered = "position" in homes.column_names
        if ordered:
            l_ts, r_ts = homes.column("position").to_numpy(), probes.column("position").to_numpy()
        # one product gives l.l - 2 r.l for a block of pairs
        l_sq, r_sq = (left**2).sum(axis=1), (right**2).sum(axis=1)
        left = np.hstack([left, l_sq[:, None]]).astype(np.float32).T.copy()
        right = np.hstack([-2 * right, np.ones((len(right), 1))]).astype(np.float32)
        most = (chord * chord + _SKETCH_SLACK + 2 * _FLOAT_SLACK * right.shape[1] - r_sq).astype(np.float32)
        near_home, near_probe = np.zeros(len(l_id), dtype=bool), np.zeros(len(r_id), dtype=bool)
        for lo, hi, first, last in _blocks(len(r_id), len(l_id)):
            close = right[lo:hi] @ left[:, first:last] <= most[lo:hi, None]
            probe, home = _pairs(close)
            probe, home = probe + lo, home + first
            if ordered:  # a row is no partner of itself
                other = (l_ts[home] <= r_ts[probe]) & (r_id[probe] != l_id[home])
                probe, home = probe[other], home[other]
            near_probe[probe] = True
            near_home[home] = True
        at = homes.column("at")[0].as_py()
        parts = [
            (table.column("id").filter(pa.array(near)), is_home)
            for table, near, is_home in ((homes, near_home, True), (probes, near_probe, False))
        ]
        return pa.concat_tables(
            pa.table([pa.array([at] * len(ids), pa.int64()), ids, pa.array([is_home] * len(ids), pa.bool_())], schema=schema)
            for ids, is_home in parts
        )

    return run


def band_cells(bands, bits, dim, seed, schema):
    """mapInArrow: one cell per band of sign bits of seeded random projections."""

    def run(batches):
        planes = np.random.default_rng(seed).standard_normal((dim, bands * bits))
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            rows, usable = unit_rows(batch.column("embedding"), dim)
            keep = np.flatnonzero(usable)
            sign = (rows[keep] @ planes > 0).reshape(len(keep), bands, bits)
            code = sign @ weights + (np.arange(bands, dtype=np.int64) << bits)
            index = pa.array(np.repeat(keep, bands))
            columns = [batch.column(name).take(index) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(code.ravel(), pa.int64()), pa.array(np.ones(code.size, bool))],
                schema=schema,
            )

    return run


def nearest_lists(centroids, probes, schema, ids=None):
    """mapInArrow: the `probes` nearest centroids of each row, nearest first; of equally near ones,
    compared as similarities are, the first."""
    ids = np.arange(len(centroids)) if ids is None else np.asarray(ids)

    def run(batches):
        for batch in batches:
            rows, usable = unit_rows(batch.column("embedding"), centroids.shape[1])
            order = np.argsort(-np.round(rows @ centroids.T, DECIMALS), axis=1, kind="stable")[:, :probes]
            order = ids[order[usable]]
            index = pa.array(np.repeat(np.flatnonzero(usable), order.shape[1]))
            columns = [batch.column(name).take(index) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(order.ravel(), pa.int32())], schema=schema
            )

    return run


def farthest_rows(known, schema):
    """mapInArrow: per list, the row least like the list's known vector, its id the least of equals."""

    def run(batches):
        best = {}
        for batch in batches:
            lists = batch.column("list_id").to_numpy()
            ids = sortable(batch.column("id"))
            rows, _ = unit_rows(batch.column("embedding"), len(next(iter(known.values()))))
            for i in np.unique(lists):
                mine = np.flatnonzero(lists == i)
                alike = np.round(rows[mine] @ known[int(i)], DECIMALS)
                first = mine[np.lexsort((ids[mine], alike))[0]]
                found = (alike.min(), ids[first], rows[first])
                if int(i) not in best or found[:2] < best[int(i)][:2]:
                    best[int(i)] = found
        if best:
            similarity, ident, unit = zip(*best.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(best), pa.int32()), pa.array(similarity, pa.float64()),
                 pa.array(np.array(ident), schema.field("id").type), pa.array([u.tolist() for u in unit], schema.field("unit").type)],
                schema=schema,
            )

    return run


def nearer_child(child, made, first, schema):
    """mapInArrow: list_id becomes the nearer one of the two lists that take the list's place."""

    def run(batches):
        for batch in batches:
            rows, _ = unit_rows(batch.column("embedding"), made.shape[1])
            left = np.array([child[int(i)] for i in batch.column("list_id").to_numpy()], dtype=np.int64)
            one = np.einsum("ij,ij->i", rows, made[left - first])
            two = np.einsum("ij,ij->i", rows, made[left - first + 1])
            now = left + (np.round(two, DECIMALS) > np.round(one, DECIMALS))
            columns = [
                pa.array(now, pa.int32()) if name == "list_id" else batch.column(name) for name in batch.schema.names
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def unit_sums(dim, schema):
    """mapInArrow: per list, the sum of the unit vectors of a partition."""

    def run(batches):
        sums = {}
        for batch in batches:
            lists = batch.column("list_id").to_numpy()
            rows, _ = unit_rows(batch.column("embedding"), dim)
            for i in np.unique(lists):
                sums[int(i)] = sums.get(int(i), 0) + rows[lists == i].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([t.tolist() for t in sums.values()], schema.field("total").type)],
                schema=schema,
            )

    return run


def tile_matches(threshold, dim, schema):
    """Cogrouped tile: probe ids that resemble a home row."""

    def run(homes, probes):
        if not homes.num_rows or not probes.num_rows:
            return schema.empty_table()
        left, _ = unit_rows(homes.column("embedding"), dim)
        right, _ = unit_rows(probes.column("embedding"), dim)
        hit = np.zeros(len(right), dtype=bool)
        step = max(1, BLOCK_CELLS // len(left))
        for lo in range(0, len(right), step):
            hit[lo : lo + step] = above(right[lo : lo + step], left, threshold).any(axis=1)
        return pa.table([probes.column("id").filter(pa.array(hit))], schema=schema)

    return run


def _places(ts, ident, asked_ts, asked_id, after):
    """Where each asked (ts, id) falls in the sorted rows: before its equal, or after it."""
    n = len(ts)
    tie = np.r_[np.full(n, 1), np.full(len(asked_ts), 2 if after else 0)]
    order = np.lexsort((tie, np.concatenate((ident, asked_id)), np.concatenate((ts, asked_ts))))
    seen = np.cumsum(order < n)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = seen
    return place[n:]


def tile_blockers(threshold, dim, schema):
    """Cogrouped tile: for each probe the earliest similar earlier home row, and their number.

    Rows are ordered by (position, id). A probe only looks after its floor.
    """

    def run(homes, probes):
        if not homes.num_rows or not probes.num_rows:
            return schema.empty_table()
        left, _ = unit_rows(homes.column("embedding"), dim)
        right, _ = unit_rows(probes.column("embedding"), dim)
        l_id, l_ts = sortable(homes.column("id")), homes.column("position").to_numpy()
        order = np.lexsort((l_id, l_ts))
        left, l_id, l_ts = left[order], l_id[order], l_ts[order]
        # The homes a probe may look at are a range of that order.
        stop = _places(l_ts, l_id, probes.column("position").to_numpy(), sortable(probes.column("id")), False)
        start = _places(
            l_ts, l_id, probes.column("floor_position").to_numpy(), sortable(probes.column("floor_id")), True
        )
        out_probe, out_block, out_count = [], [], []
        step = max(1, BLOCK_CELLS // len(left))
        for lo in range(0, len(right), step):
            probe, home = np.nonzero(above(right[lo : lo + step], left, threshold))
            inside = (home >= start[probe + lo]) & (home < stop[probe + lo])
            probe, first, count = np.unique(probe[inside] + lo, return_index=True, return_counts=True)
            out_probe.append(probe)
            out_block.append(home[inside][first])
            out_count.append(count)
        probe, block = np.concatenate(out_probe), np.concatenate(out_block)
        return pa.table(
            [
                probes.column("id").take(pa.array(probe)),
                pa.array(l_ts[block], pa.int64()),
                pa.array(l_id[block], schema.field(2).type),
                pa.array(np.concatenate(out_count), pa.int64()),
            ],
            schema=schema,
        )

    return run


def home_cells(anchors, dim, schema):
    """mapInArrow: rows with the cell of their nearest anchor and the angle to it; -1 and null for
    rows without a usable vector."""

    def run(batches):
        for batch in batches:
            rows, usable = unit_rows(batch.column("embedding"), dim)
            dots = rows @ anchors.T
            cell = np.where(usable, dots.argmax(axis=1), -1) if len(anchors) else np.full(len(rows), -1)
            angle = np.arccos(np.clip(dots.max(axis=1), -1, 1)) if len(anchors) else np.zeros(len(rows))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int64()), pa.array(angle, mask=cell < 0)], schema=schema
            )

    return run


def next_cells(anchors, rings, dim, first, last, schema):
    """mapInArrow: queries with those of their cells, from the `first` to before the `last` in order
    of what a cell can hold at best, that may still hold one of their best rows.

    `rings` has the least and greatest angle to its anchor of each cell's rows, NaN without rows. A row
    whose angle to the anchor differs from the query's by so much is at least as far from the query.
    """

    def run(batches):
        for batch in batches:
            rows, usable = unit_rows(batch.column("embedding"), dim)
            angle = np.arccos(np.clip(rows @ anchors.T, -1, 1))
            least = np.maximum(0, np.maximum(angle - rings[:, 1], rings[:, 0] - angle) - _ANGLE_SLACK)
            bound = np.where(np.isnan(least), -np.inf, np.cos(least))
            bound[~usable] = np.where(np.isnan(rings[:, 0]), -np.inf, _NO_VECTOR)
            bound = np.hstack([bound, np.full((len(rows), 1), _NO_VECTOR)])  # rows without a vector
            order = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
            floor = batch.column("floor").fill_null(-np.inf).to_numpy(zero_copy_only=False)
            value = np.take_along_axis(bound, order, 1)
            row, at = np.nonzero((value >= floor[:, None] - _SLACK) & (value > -np.inf))
            cell = order[row, at]
            keep = pa.array(row)
            columns = [batch.column(name).take(keep) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.where(cell == len(anchors), -1, cell), pa.int64())], schema=schema
            )

    return run


def tile_top_k(dim, schema, complete=False):
    """Cogrouped tile: the best home rows of each probing query, and none below its floor.

    With `complete`, rows or queries without a usable vector count too, behind all others and with
    a null score.
    """

    def run(homes, probes):
        if not homes.num_rows or not probes.num_rows:
            return schema.empty_table()
        rows, usable = unit_rows(homes.column("embedding"), dim)
        asks, asked = unit_rows(probes.column("embedding"), dim)
        limits = probes.column("limit").to_numpy().astype(np.int64)
        query_id = probes.column("query_id").combine_chunks()
        floor = None
        if "floor" in probes.column_names:
            floor = probes.column("floor").combine_chunks().fill_null(-np.inf).to_numpy()
        ask = filters_of(probes)
        best = _Bests(asks, asked, limits, ask, floor)
        if best.k <= 0:
            return schema.empty_table()
        batch = homes.combine_chunks().to_batches()[0]
        pairs = (("entry_type", "entry_type"), ("projects", "project"), ("created_at", "until"))
        names = [column for column, asked_by in pairs if asked_by in ask and column in batch.schema.names]
        best.meet(batch, names, rows, usable, complete)
        query, val, ident = best.found()
        return pa.table(
            [
                query_id.take(pa.array(query)),
                pa.array(ident, schema.field(1).type),
                pa.array(val, mask=val <= _NO_VECTOR),
                pa.array(limits[query], pa.int32()),
            ],
            schema=schema,
        )

    return run


def greedy_block(threshold, dim, schema):
    """One bounded block in order: a row is admitted unless an admitted earlier row resembles it."""

    def run(table):
        rows, _ = unit_rows(table.column("embedding"), dim)
        order = np.lexsort((sortable(table.column("id")), table.column("position").to_numpy()))
        rows = rows[order]
        open_ = np.ones(len(rows), dtype=bool)
        kept = np.zeros(len(rows), dtype=bool)
        for lo in range(0, len(rows), 256):
            block = lo + np.flatnonzero(open_[lo : lo + 256])
            near = above(rows[block], rows[lo:], threshold)
            for i, row in zip(block, near):
                if open_[i]:
                    kept[i] = True
                    open_[lo:] &= ~row
        return pa.table(
            [table.column("id").take(pa.array(order)), pa.array(kept)], schema=schema
        )

    return run


def dictionary_finds(shared, kinds, no_cue):
    """Scalar Arrow function over spaced texts: rank of the first cue, sorted terms of each kind.

    The automaton is built once a Python worker, beside the broadcast terms.
    """

    def built():
        import ahocorasick

        held = shared.value
        if "automaton" not in held:
            runs = {}
            for kind, term, run in held["terms"]:
                runs.setdefault(run, []).append((kinds.index(kind), term))
            for rank, run in held["cues"]:
                runs.setdefault(run, []).append((-1, rank))
            automaton = ahocorasick.Automaton()
            for no, run in enumerate(runs):
                automaton.add_word(f" {run} ", no)
            automaton.make_automaton()
            held["automaton"], held["finds"] = automaton, list(runs.values())
        return held["automaton"], held["finds"]

    def find(column: pa.Array) -> pa.Array:
        automaton, finds = built()
        cues, lists = [], [[] for _ in kinds]
        for text in column.to_pylist():
            cue, found = no_cue, [set() for _ in kinds]
            for no in {no for _, no in automaton.iter(text or "")}:
                for kind, what in finds[no]:
                    if kind < 0:
                        cue = min(cue, what)
                    else:
                        found[kind].add(what)
            cues.append(cue)
            for out, mine in zip(lists, found):
                out.append(sorted(mine))
        return pa.StructArray.from_arrays(
            [pa.array(cues, pa.int32()), *[pa.array(x, pa.list_(pa.string())) for x in lists]], ["cue", *kinds]
        )

    return find


def bucket_counts(dim):
    """Scalar Arrow function: words of each row -> unit-length count vector.

    A word's bucket is the first 28 bits of its md5, modulo the dimension; each distinct
    word of a batch is hashed once.
    """

    def count(column: pa.Array) -> pa.Array:
        n = len(column)
        lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(n), lengths)
        coded = column.flatten().dictionary_encode()
        buckets = np.array(
            [int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % dim for w in coded.dictionary.to_pylist()],
            dtype=np.int64,
        )
        cells = owner * dim + buckets[coded.indices.to_numpy()]
        counts = np.bincount(cells, minlength=n * dim).reshape(n, dim).astype(float)
        norms = np.sqrt((counts**2).sum(axis=1))
        counts[norms > 0] /= norms[norms > 0, None]
        return pa.ListArray.from_arrays(
            pa.array(np.arange(n + 1, dtype=np.int32) * dim),
            pa.array(counts.ravel().astype(np.float32)),
            mask=pa.array(norms == 0),
        )

    return count
