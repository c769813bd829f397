"""Block distance kernels that run inside Spark tasks.

A block is a batch of vectors as numpy arrays. ``screen`` gives cheap ranks
of every base row for every query with a bound on their error, ``exact`` gives
full-precision distances of chosen pairs. ``nearest_in_block`` screens, keeps all
pairs that could still be among the k nearest, and measures only those.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Pairs screened at once and pairs measured at once: they bound a task's memory.
SCREEN_PAIRS = 1 << 21
EXACT_CELLS = 1 << 22
FLOAT_MAX = 3.4028234663852886e38
# Squared lengths between these keep their products within a float.
FLOAT_SAFE = (1e-18, 1e30)
# Dimensions whose whole-number differences add up within 16 bits, the steps of each, and the pairs of a tile that stays in a cache.
TILE_DIMS, TILE_STEPS, TILE_QUERIES, TILE_ROWS = 64, 1023, 16, 8192
# Up to this many dimensions, boxes around neighbouring queries rule rows out.
BOX_DIMS, BOX_QUERIES = 16, 256
# Numbers of a sparse block laid out densely, and how many dense products cost as much as one sparse one.
DENSE_CELLS, DENSE_FACTOR = 1 << 24, 64
# Rows of a group whose best rank stands for it where the k-th best is bounded, and how many groups there are at least for each of the k.
GROUP_ROWS, GROUPS_PER_ROW = 64, 8


@dataclass(frozen=True)
class Metric:
    """How a distance is ranked, indexed and trained.

    ``skip_zero``: an index leaves zero-norm rows out. ``train``: the k-means
    distance (None: the metric has no inverted-list index).
    """

    name: str
    kind: str
    skip_zero: bool = False
    train: str | None = None


METRICS = {m.name: m for m in [
    Metric("l2", "dense", train="l2"),
    Metric("ip", "dense", train="spherical"),
    Metric("cosine", "dense", skip_zero=True, train="spherical"),
    Metric("l1", "dense"),
    Metric("hamming", "bit", train="hamming"),
    Metric("jaccard", "bit"),
    Metric("sparse_l2", "sparse"),
    Metric("sparse_ip", "sparse"),
    Metric("sparse_cosine", "sparse", skip_zero=True),
    Metric("sparse_l1", "sparse"),
]}


def metric_of(name) -> Metric:
    if isinstance(name, Metric):
        return name
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; one of {', '.join(METRICS)}")
    return METRICS[name]


def flat_list(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of an Arrow list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return offsets - offsets[0], values[offsets[0]:offsets[-1]]


def _cosine(ip, na, nb):
    with np.errstate(all="ignore"):
        ratio = ip / np.sqrt(na * nb)
        return np.where((na == 0) | (nb == 0), np.nan, 1 - np.clip(ratio, -1, 1))


def _float_range(x):
    """Magnitudes a float cannot hold become infinite."""
    return np.where(np.abs(x) > FLOAT_MAX, np.copysign(np.inf, x), x)


def _rough_l1(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L1 distances of every query to every row from whole numbers, and per query by how much they may be off.

    Every dimension is cut into equal steps; what rounding to them moves is added up per row, so the bound is a sum of real
    differences. Small whole numbers are subtracted and added several times faster than floats.
    """
    (n, dim), m = x.shape, len(q)
    if not n or not m or not dim:
        return np.zeros((m, n), np.float32), np.zeros(m)
    plain, plain_q = (np.isfinite(v).all(axis=1) for v in (x, q))
    if not plain.all() or not plain_q.all():
        out, slack = np.empty((m, n), np.float32), np.zeros(m)
        out[np.ix_(plain_q, plain)], slack[plain_q] = _rough_l1(x[plain], q[plain_q])
        for i in np.flatnonzero(~plain_q):
            out[i] = np.abs(x - q[i]).sum(axis=1)
        for i in np.flatnonzero(~plain):
            out[:, i] = np.abs(x[i] - q).sum(axis=1)
        return out, slack
    low = np.minimum(x.min(axis=0), q.min(axis=0))
    step = float((np.maximum(x.max(axis=0), q.max(axis=0)) - low).max()) / TILE_STEPS or 1.0
    codes = [np.rint((v - low) / step) for v in (x, q)]
    off_x, off_q = (np.abs(low + c * step - v).sum(axis=1) for c, v in zip(codes, (x, q)))
    rows, asked = np.ascontiguousarray(codes[0].T.astype(np.int16)), np.ascontiguousarray(codes[1].T.astype(np.int16))
    out = np.zeros((m, n), np.float32)
    for a in range(0, m, TILE_QUERIES):
        for b in range(0, n, TILE_ROWS):
            some, few = rows[:, b:b + TILE_ROWS], asked[:, a:a + TILE_QUERIES]
            gap = np.empty((few.shape[1], some.shape[1]), np.int16)
            for first in range(0, dim, TILE_DIMS):
                total = np.zeros(gap.shape, np.uint16)
                for j in range(first, min(dim, first + TILE_DIMS)):
                    np.subtract(some[j], few[j][:, None], out=gap)
                    np.absolute(gap, out=gap)
                    np.add(total, gap.view(np.uint16), out=total)
                out[a:a + TILE_QUERIES, b:b + TILE_ROWS] += total
    with np.errstate(over="ignore"):
        out *= np.float32(step)
    # floats round the sums, doubles the offsets
    return out, off_q + off_x.max() + dim * (1e-6 * TILE_STEPS * step + 1e-14 * np.abs(low).max()) + 1e-40


class DenseBlock:
    def __init__(self, data: np.ndarray):
        self.data = data
        self._norms = self._units = self._floats = None

    @classmethod
    def from_arrow(cls, column) -> DenseBlock:
        offsets, values = flat_list(column)
        sizes = np.diff(offsets)
        dim = int(sizes[0]) if len(sizes) else 0
        if len(sizes) and (sizes != dim).any():
            other = int(sizes[sizes != dim][0])
            raise ValueError(f"different vector dimensions {dim} and {other}")
        return cls(values.astype(np.float64).reshape(len(sizes), dim))

    def __len__(self):
        return len(self.data)

    def take(self, rows) -> DenseBlock:
        return DenseBlock(self.data[rows])

    @property
    def norms(self) -> np.ndarray:
        if self._norms is None:
            self._norms = np.einsum("ij,ij->i", self.data, self.data)
        return self._norms

    def check(self, other: DenseBlock):
        if len(self) and len(other) and self.data.shape[1] != other.data.shape[1]:
            raise ValueError(f"different vector dimensions {self.data.shape[1]} and {other.data.shape[1]}")

    @property
    def units(self) -> np.ndarray:
        """Rows of length 1; rows without a direction stay zero."""
        if self._units is None:
            length = np.sqrt(_float_range(self.norms))[:, None]
            self._units = np.divide(self.data, length, out=np.zeros_like(self.data),
                                    where=(length > 0) & np.isfinite(length))
        return self._units

    def floats(self, metric: Metric) -> np.ndarray:
        """Rows as floats, as they enter a rough product: unit vectors for cosine, squared norms beside them for L2."""
        if self._floats is None or self._floats[0] != metric.name:
            rows = self.units if metric.name == "cosine" else self.data
            rows = np.concatenate([rows, self.norms[:, None]], axis=1) if metric.name == "l2" else rows
            self._floats = metric.name, rows.astype(np.float32)
        return self._floats[1]

    def screen(self, metric: Metric, queries: DenseBlock, coarse: bool = False):
        """Rough ranks less a constant per query: ``rough, slack, constant``.

        One matrix product gives them whole; for L2 the squared norm of a row is a
        further column of the matrix, and that of the query is the constant. A ``coarse``
        screen multiplies floats where their range allows, with the slack of floats.
        """
        q, x = queries.data, self.data
        zero = np.zeros(len(q))
        if metric.name == "l1":
            return *_rough_l1(x, q), zero
        largest = queries.norms.max(initial=0.0) + self.norms.max(initial=0.0)
        coarse = coarse and FLOAT_SAFE[0] < largest < FLOAT_SAFE[1]
        unit = 4 * (x.shape[1] + 4) * np.finfo(np.float32 if coarse else np.float64).eps
        slack = unit * (queries.norms + self.norms.max(initial=0.0))
        if metric.name == "l2":
            if coarse:
                left = np.concatenate([-2 * q, np.ones((len(q), 1))], axis=1).astype(np.float32)
                return left @ self.floats(metric).T, slack, queries.norms
            left = np.concatenate([-2 * q, np.ones((len(q), 1))], axis=1)
            right = np.concatenate([x, self.norms[:, None]], axis=1)
            return left @ right.T, slack, queries.norms
        if metric.name == "ip":
            return (-q.astype(np.float32) @ self.floats(metric).T if coarse else -q @ x.T), slack, zero
        rough = -queries.floats(metric) @ self.floats(metric).T if coarse else -queries.units @ self.units.T
        aimless, aimless_q = (~((b.norms > 0) & (b.norms <= FLOAT_MAX)) for b in (self, queries))
        if aimless.any():
            rough[:, aimless] = np.inf
        if aimless_q.any():
            rough[aimless_q] = np.inf
        return rough, np.full(len(q), unit), np.ones(len(q))

    def near_box(self, metric: Metric, queries: DenseBlock, limit) -> np.ndarray:
        """Which rows are no farther than ``limit`` from the box around the queries; none of the others can matter to any of them."""
        gap = np.maximum(np.maximum(queries.data.min(axis=0) - self.data, self.data - queries.data.max(axis=0)), 0)
        least = np.einsum("ij,ij->i", gap, gap) if metric.name == "l2" else gap.sum(axis=1)
        # NaN stays in
        return ~(least * (1 - 1e-9) > limit)

    def boxed(self, metric: Metric) -> bool:
        return metric.name in ("l1", "l2") and self.data.shape[1] <= BOX_DIMS

    def exact(self, metric: Metric, rows, queries: DenseBlock, qrows):
        """Ranking distances of the pairs ``(rows[i], qrows[i])``."""
        out = np.empty(len(rows))
        step = max(1, EXACT_CELLS // (4 * max(1, self.data.shape[1])))
        for start in range(0, len(rows), step):
            cut = slice(start, start + step)
            x, q = self.data[rows[cut]], queries.data[qrows[cut]]
            if metric.name == "l2":
                out[cut] = _float_range(((x - q) ** 2).sum(axis=1))
            elif metric.name == "l1":
                out[cut] = _float_range(np.abs(x - q).sum(axis=1))
            elif metric.name == "ip":
                out[cut] = -_float_range((x * q).sum(axis=1))
            else:
                out[cut] = _cosine(_float_range((x * q).sum(axis=1)),
                                   _float_range((x * x).sum(axis=1)), _float_range((q * q).sum(axis=1)))
        return out


class BitBlock:
    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        self.words, self.lengths = words, lengths

    @classmethod
    def from_arrow(cls, column) -> BitBlock:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        lengths, words = column.flatten()
        lengths = lengths.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(lengths) and (lengths != lengths[0]).any():
            other = int(lengths[lengths != lengths[0]][0])
            raise ValueError(f"different bit lengths {int(lengths[0])} and {other}")
        _, values = flat_list(words)
        width = len(values) // len(lengths) if len(lengths) else 0
        return cls(values.astype(np.int64).view(np.uint64).reshape(len(lengths), width), lengths)

    def __len__(self):
        return len(self.words)

    def take(self, rows) -> BitBlock:
        return BitBlock(self.words[rows], self.lengths[rows])

    def check(self, other: BitBlock):
        if len(self) and len(other) and self.lengths[0] != other.lengths[0]:
            raise ValueError(f"different bit lengths {int(self.lengths[0])} and {int(other.lengths[0])}")

    def _distance(self, metric, shared_shape, pick):
        if metric.name == "hamming":
            total = np.zeros(shared_shape)
            for w in range(self.words.shape[1]):
                a, b = pick(w)
                total += np.bitwise_count(a ^ b)
            return total
        both, either = np.zeros(shared_shape), np.zeros(shared_shape)
        for w in range(self.words.shape[1]):
            a, b = pick(w)
            both += np.bitwise_count(a & b)
            either += np.bitwise_count(a | b)
        return np.where(both == 0, 1.0, 1 - both / np.maximum(either, 1))

    def boxed(self, metric: Metric) -> bool:
        return False

    def _hamming(self, queries: BitBlock) -> np.ndarray:
        """Distances as small whole numbers, one vector of the shorter side at a time, so that what lies between the steps stays in a cache."""
        few, many = (queries, self) if len(queries) <= len(self) else (self, queries)
        most = 64 * few.words.shape[1]
        out = np.zeros((len(few), len(many)), np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)
        words, gap = np.ascontiguousarray(many.words.T), np.empty(len(many), np.uint64)
        for total, one in zip(out, few.words):
            for mine, theirs in zip(words, one):
                total += np.bitwise_count(np.bitwise_xor(mine, theirs, out=gap))
        return out if few is queries else np.ascontiguousarray(out.T)

    def screen(self, metric: Metric, queries: BitBlock, coarse: bool = False):
        shape = (len(queries), len(self))
        zero = np.zeros(len(queries))
        if metric.name == "hamming":
            return self._hamming(queries), zero, zero
        return (self._distance(metric, shape, lambda w: (queries.words[:, w, None], self.words[None, :, w])), zero, zero)

    def exact(self, metric: Metric, rows, queries: BitBlock, qrows):
        return self._distance(metric, (len(rows),), lambda w: (self.words[rows, w], queries.words[qrows, w]))


class SparseBlock:
    """Rows as offsets into sorted indices and their values."""

    def __init__(self, dims, offsets, indices, values):
        self.dims, self.offsets, self.indices, self.values = dims, offsets, indices, values
        self._norms = self._dense = None

    @classmethod
    def from_arrow(cls, column) -> SparseBlock:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        dims, indices, values = column.flatten()
        dims = dims.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(dims) and (dims != dims[0]).any():
            raise ValueError(f"different sparsevec dimensions {int(dims[0])} and {int(dims[dims != dims[0]][0])}")
        offsets, idx = flat_list(indices)
        _, val = flat_list(values)
        return cls(dims, offsets.astype(np.int64), idx.astype(np.int64), val.astype(np.float64))

    def __len__(self):
        return len(self.dims)

    @property
    def row_of(self):
        return np.repeat(np.arange(len(self)), np.diff(self.offsets))

    def _positions(self, rows):
        sizes = np.diff(self.offsets)[rows]
        starts = self.offsets[:-1][rows]
        owner = np.repeat(np.arange(len(rows)), sizes)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return owner, starts[owner] + inner, sizes

    def take(self, rows) -> SparseBlock:
        rows = np.asarray(rows)
        _, at, sizes = self._positions(rows)
        return SparseBlock(self.dims[rows], np.concatenate([[0], np.cumsum(sizes)]), self.indices[at], self.values[at])

    def check(self, other: SparseBlock):
        if len(self) and len(other) and self.dims[0] != other.dims[0]:
            raise ValueError(f"different sparsevec dimensions {int(self.dims[0])} and {int(other.dims[0])}")

    def row_sum(self, values) -> np.ndarray:
        return np.bincount(self.row_of, weights=values, minlength=len(self))

    @property
    def norms(self):
        if self._norms is None:
            self._norms = self.row_sum(self.values ** 2)
        return self._norms

    def _shared(self, queries: SparseBlock, term) -> np.ndarray:
        """Sum ``term`` over the indices a row and a query share."""
        out = np.zeros((len(queries), len(self)))
        order = np.argsort(queries.indices, kind="stable")
        q_idx, q_row, q_val = queries.indices[order], queries.row_of[order], queries.values[order]
        low = np.searchsorted(q_idx, self.indices, "left")
        count = np.searchsorted(q_idx, self.indices, "right") - low
        mine = self.row_of
        ends = np.cumsum(count)
        start = 0
        while start < len(count):
            base = ends[start] - count[start]
            stop = max(start + 1, int(np.searchsorted(ends, base + EXACT_CELLS, "right")))
            part = np.arange(start, stop)
            entry = np.repeat(part, count[part])
            inner = np.arange(len(entry)) - np.repeat(ends[part] - count[part] - base, count[part])
            at = low[entry] + inner
            cell = q_row[at] * len(self) + mine[entry]
            out += np.bincount(cell, weights=term(self.values[entry], q_val[at]), minlength=out.size).reshape(out.shape)
            start = stop
        return out

    def boxed(self, metric: Metric) -> bool:
        return False

    def _columns(self, columns) -> np.ndarray:
        """The values at ascending ``columns``, laid out densely."""
        at = np.minimum(np.searchsorted(columns, self.indices), max(0, len(columns) - 1))
        held = columns[at] == self.indices if len(columns) else np.zeros(len(at), bool)
        cell = self.row_of[held] * len(columns) + at[held]
        return np.bincount(cell, weights=self.values[held], minlength=len(self) * len(columns)).reshape(len(self), len(columns))

    def _laid_out(self, queries: SparseBlock) -> tuple[DenseBlock, DenseBlock] | None:
        """Rows and queries at the indices that rows use, where these are few enough for that to be the cheaper way."""
        if self._dense is None:
            columns, count = np.unique(self.indices, return_counts=True)
            fits = len(self) * len(columns) <= DENSE_CELLS
            self._dense = columns, count, DenseBlock(self._columns(columns)) if fits else None
        columns, count, block = self._dense
        if block is None or len(queries) * len(columns) > DENSE_CELLS:
            return None
        asked = queries._columns(columns)
        pairs = float(count.astype(np.float64) @ np.count_nonzero(asked, axis=0))
        return (block, DenseBlock(asked)) if len(self) * len(queries) * len(columns) <= DENSE_FACTOR * pairs else None

    def screen(self, metric: Metric, queries: SparseBlock, coarse: bool = False):
        unit, zero = 1e-12, np.zeros(len(queries))
        dense = self._laid_out(queries) if coarse else None
        if metric.name == "sparse_l1":
            mine, theirs = self.row_sum(np.abs(self.values)), queries.row_sum(np.abs(queries.values))
            slack = unit * (theirs + mine.max(initial=0.0))
            if dense:
                # what lies at indices of one side only counts whole
                rest, rest_q = (np.maximum(total - np.abs(d.data).sum(axis=1), 0) for total, d in zip((mine, theirs), dense))
                out, off, _ = dense[0].screen(METRICS["l1"], dense[1])
                out += rest[None, :].astype(np.float32)
                return out, slack + off + 1e-6 * (theirs + mine.max(initial=0.0)), rest_q
            out = mine[None, :] + self._shared(queries, lambda x, q: np.abs(x - q) - np.abs(x) - np.abs(q))
            return out, slack, theirs
        largest = queries.norms.max(initial=0.0) + self.norms.max(initial=0.0)
        if dense and FLOAT_SAFE[0] < largest < FLOAT_SAFE[1]:
            base, asked = dense
            # lengths count all indices, also those of one side only
            base._norms, asked._norms = self.norms, queries.norms
            return base.screen(METRICS[metric.name.removeprefix("sparse_")], asked, True)
        ip = self._shared(queries, lambda x, q: x * q)
        slack = unit * (queries.norms + self.norms.max(initial=0.0))
        if metric.name == "sparse_l2":
            return self.norms[None, :] - 2 * ip, slack, queries.norms
        if metric.name == "sparse_ip":
            return -ip, slack, zero
        rough = _cosine(_float_range(ip), _float_range(queries.norms)[:, None], _float_range(self.norms)[None, :])
        return np.where(np.isnan(rough), np.inf, rough), np.full(len(queries), unit), zero

    def exact(self, metric: Metric, rows, queries: SparseBlock, qrows):
        out = np.empty(len(rows))
        dense = self._laid_out(queries)
        if dense and np.count_nonzero(np.isin(queries.indices, self._dense[0], invert=True)) == 0:
            step = max(1, EXACT_CELLS // (4 * max(1, len(self._dense[0]))))
            for start in range(0, len(rows), step):
                cut = slice(start, start + step)
                out[cut] = _summed(metric, dense[0].data[rows[cut]].T, dense[1].data[qrows[cut]].T)
            return out
        width = max(1.0, len(self.values) / max(1, len(self)) + len(queries.values) / max(1, len(queries)))
        step = max(1, int(EXACT_CELLS / width))
        for start in range(0, len(rows), step):
            cut = slice(start, start + step)
            out[cut] = self._exact_part(metric, rows[cut], queries, qrows[cut])
        return out

    def _exact_part(self, metric, rows, queries, qrows):
        n = len(rows)
        x, q = self.take(rows), queries.take(qrows)
        pair = np.concatenate([x.row_of, q.row_of])
        index = np.concatenate([x.indices, q.indices])
        xv = np.concatenate([x.values, np.zeros(len(q.values))])
        qv = np.concatenate([np.zeros(len(x.values)), q.values])
        order = np.lexsort((index, pair))
        pair, index, xv, qv = pair[order], index[order], xv[order], qv[order]
        if len(pair) == 0:
            merged_pair, xv, qv = pair, xv, qv
        else:
            first = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (index[1:] != index[:-1])])
            merged_pair, xv, qv = pair[first], np.add.reduceat(xv, first), np.add.reduceat(qv, first)

        return _of_sums(metric, xv, qv, lambda values: np.bincount(merged_pair, weights=values, minlength=n))


def _of_sums(metric: Metric, x, q, added):
    """Ranking distances from the numbers of both sides at the same indices, which ``added`` adds up per pair."""
    def total(values):
        return _float_range(added(values))

    if metric.name == "sparse_l2":
        return total((x - q) ** 2)
    if metric.name == "sparse_l1":
        return total(np.abs(x - q))
    if metric.name == "sparse_ip":
        return -total(x * q)
    return _cosine(total(x * q), total(x * x), total(q * q))


def _summed(metric: Metric, x, q):
    """Of columns of pairs laid out densely; added index by index as the sparse way does, so that both give the same to the last bit."""
    def added(values):
        out = np.zeros(values.shape[1])
        for part in values:
            out += part
        return out

    return _of_sums(metric, np.ascontiguousarray(x), np.ascontiguousarray(q), added)


BLOCKS = {"dense": DenseBlock, "bit": BitBlock, "sparse": SparseBlock}


def block_from_arrow(metric: Metric, column):
    return BLOCKS[metric.kind].from_arrow(column)


def to_distance(metric: Metric, rank: np.ndarray) -> np.ndarray:
    return np.sqrt(rank) if metric.name.endswith("l2") else rank


def id_codes(ids) -> np.ndarray:
    """Ids as numbers in the order of the ids, for breaking ties."""
    values = ids.to_numpy(zero_copy_only=False)
    if values.dtype.kind in "iu":
        return values
    return np.unique(values, return_inverse=True)[1]


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the true cells; the flat search is much faster than one by axis, and by eight cells at once where few are true."""
    flat = mask.reshape(-1)
    whole = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:whole].view(np.uint64))
    if len(eights) * 8 > len(flat) // 4:
        return np.divmod(np.flatnonzero(flat), mask.shape[1] or 1)
    cells = np.concatenate([(eights[:, None] * 8 + np.arange(8)).ravel(), np.arange(whole, len(flat))])
    return np.divmod(cells[flat[cells]], mask.shape[1] or 1)


def in_boxes(data: np.ndarray, size: int) -> np.ndarray:
    """An order of the rows in which any ``size`` that follow each other lie near each other: halved at the median, widest side first."""
    done, waiting = [], [np.arange(len(data))]
    while waiting:
        rows = waiting.pop()
        spread = np.ptp(data[rows], axis=0) if len(rows) > size else None
        if spread is None or not spread.size or not spread.max() > 0:
            done.append(rows)
            continue
        rows = rows[np.argsort(data[rows, spread.argmax()], kind="stable")]
        waiting += [rows[len(rows) // 2:], rows[:len(rows) // 2]]
    return np.concatenate(done)


def _at_most(rough: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ranks up to ``top`` per query; for float ranks that is rounded up, for whole ones down."""
    if rough.dtype.kind == "u":
        some = np.flatnonzero(top >= 0)
        whole = np.minimum(np.floor(top[some]), np.iinfo(rough.dtype).max).astype(rough.dtype)
        query, row = _places((rough if len(some) == len(rough) else rough[some]) <= whole[:, None])
        return some[query], row
    if rough.dtype == np.float32:
        with np.errstate(over="ignore"):
            top = np.nextafter(top.astype(np.float32), np.float32(np.inf))
    return _places(rough <= top[:, None])


def _kth_or_above(rough: np.ndarray, k: int) -> np.ndarray:
    """Per query its k-th best rank, or one a little above: the k-th best of the best ranks of groups of rows, of which each has its own row."""
    m, n = rough.shape
    size = min(GROUP_ROWS, n // (GROUPS_PER_ROW * k))
    if size < 2:
        return np.partition(rough, k - 1, axis=1)[:, k - 1]
    best = rough[:, :n // size * size].reshape(m, size, n // size).min(axis=1)
    out = np.partition(best, k - 1, axis=1)[:, k - 1].astype(np.float64)
    # NaN is no bound, and infinity none that leaves rows out
    lost = ~np.isfinite(out)
    if lost.any():
        out[lost] = np.partition(rough[lost], k - 1, axis=1)[:, k - 1]
    return out


def nearest_in_block(metric: Metric, base, codes, queries, k: int, limit=None):
    """Pairs ``(row, query, rank)`` holding, per query, its k nearest rows of the block, nearest first.

    ``limit`` is a ranking distance per query beyond which rows cannot matter any
    more. NaN distances rank after all numbers. Ties are broken by ``codes``. In few
    dimensions, rows too far from a box around the queries are not compared with them.
    """
    base.check(queries)
    whole, m, parts = base, len(queries), []
    boxed = limit is not None and base.boxed(metric)
    if boxed and len(base) and m:
        near = np.flatnonzero(base.near_box(metric, queries, limit.max()))
        base, codes = (base, codes) if len(near) == len(base) else (base.take(near), codes[near])
    else:
        near = None
    step = max(1, SCREEN_PAIRS // max(1, len(base)))
    if boxed and m * len(base) > SCREEN_PAIRS:
        step = min(step, BOX_QUERIES)
    for start in range(0, m, step):
        sub = queries if step >= m else queries.take(np.arange(start, min(m, start + step)))
        most = None if limit is None else limit[start:start + len(sub)]
        if boxed and step < m:
            here = np.flatnonzero(base.near_box(metric, sub, most.max()))
            row, qrow, rank = _nearest_of(metric, base if len(here) == len(base) else base.take(here), codes[here], sub, k, most)
            row = here[row]
        else:
            row, qrow, rank = _nearest_of(metric, base, codes, sub, k, most)
        parts.append((row, qrow + start, rank))
    if not parts:
        empty = np.empty(0, np.int64)
        return empty, empty, np.empty(0)
    row, query, rank = (np.concatenate(p) for p in zip(*parts))
    return (row if base is whole else near[row]), query, rank


def _nearest_of(metric: Metric, base, codes, queries, k: int, limit):
    rough, slack, constant = base.screen(metric, queries, True)
    n = len(base)
    cut = np.full(len(queries), np.inf) if limit is None else limit - constant
    open_ended = np.isinf(cut)
    if n > k and open_ended.any():
        # the k-th best of the block bounds what is wanted of it
        cut = cut.copy()
        cut[open_ended] = _kth_or_above(rough if open_ended.all() else rough[open_ended], k)
    far = np.abs(cut) + np.abs(constant) > FLOAT_MAX / 8  # ranks this large become infinite and tie
    qrow, row = _at_most(rough, np.where(far, np.inf, cut + 2 * slack))
    rank = base.exact(metric, row, queries, qrow)
    keep = first_k(qrow, rank, codes[row], k)
    return row[keep], qrow[keep], rank[keep]


def first_k(group, rank, codes, k: int) -> np.ndarray:
    """Positions of the k first members of each group, by rank (NaN last), then code."""
    order = np.lexsort((codes, rank, group))
    g = group[order]
    if len(g) == 0:
        return order
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    sizes = np.diff(np.r_[starts, len(g)])
    place = np.arange(len(g)) - np.repeat(starts, sizes)
    return order[place < k]


def within_block(metric: Metric, base, queries, low, high):
    """Pairs whose distance lies between ``low`` and ``high``, neither included."""
    base.check(queries)
    n, m = len(base), len(queries)
    parts = []
    step = max(1, SCREEN_PAIRS // max(1, n))
    for start in range(0, m, step):
        sub = queries.take(np.arange(start, min(m, start + step)))
        rough, slack, constant = base.screen(metric, sub, True)
        top, bottom = _rank_of(metric, high), _rank_of(metric, low)
        qrow, row = _at_most(rough, top - constant + 2 * slack)
        if np.isfinite(bottom):
            far = rough[qrow, row] >= (bottom - constant - 2 * slack)[qrow]
            qrow, row = qrow[far], row[far]
        dist = to_distance(metric, base.exact(metric, row, sub, qrow))
        keep = (dist < high) & (dist > low)
        parts.append((row[keep], qrow[keep] + start, dist[keep]))
    if not parts:
        empty = np.empty(0, np.int64)
        return empty, empty, np.empty(0)
    return tuple(np.concatenate(p) for p in zip(*parts))


def within_limit(metric: Metric, base, queries, limit):
    """``row, query, distance`` of all pairs whose ranking distance is at most ``limit`` of the query, and perhaps some beyond.

    The caller bounds how many pairs are screened. An infinite limit lets all rows in.
    """
    base.check(queries)
    rough, slack, constant = base.screen(metric, queries, True)
    cut = limit - constant
    far = np.abs(cut) + np.abs(constant) > FLOAT_MAX / 8  # as for the nearest: ranks this large become infinite
    query, row = _at_most(rough, np.where(far, np.inf, cut + 2 * slack))
    if far.any():
        # NaN is in no comparison
        query, row = (np.concatenate(p) for p in zip((query, row), _places(np.isnan(rough) & far[:, None])))
    return row, query, to_distance(metric, base.exact(metric, row, queries, query))


def _rank_of(metric: Metric, distance: float) -> float:
    """The ranking value of a distance; below zero no L2 rank exists."""
    if not metric.name.endswith("l2") or not np.isfinite(distance):
        return distance
    return distance * distance if distance >= 0 else -np.inf


def nearest_center(train: str, rows: DenseBlock, centers: DenseBlock) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre per row, the lower id on a tie, and the ranking distance to it.

    For bits, rows and centres hold 0 and 1: their squared L2 distance is Hamming's.
    """
    metric = METRICS["ip" if train == "spherical" else "l2"]
    best, rank = np.empty(len(rows), np.int64), np.empty(len(rows))
    step = max(1, SCREEN_PAIRS // max(1, len(centers)))
    for start in range(0, len(rows), step):
        part = rows.take(np.arange(start, min(len(rows), start + step)))
        rough, slack, _ = centers.screen(metric, part)
        row, center = _places(rough <= (rough.min(axis=1) + 2 * slack)[:, None])
        exact = centers.exact(metric, center, part, row)
        keep = first_k(row, exact, center, 1)
        best[start:start + len(part)], rank[start:start + len(part)] = center[keep], exact[keep]
    return best, rank
