"""Forests and boosted trees over rows that stay in their tasks.

Plan. A model is one job of as many tasks as there are cores. Each task keeps its rows as one
byte a feature (32 bins at exact quantiles of all rows). Level by level the tasks count
what falls into the bins of each node; the first task adds the counts up, over
sockets between the tasks, and tells the others the splits. Counts are whole
numbers, so a model depends on the rows and the seed, not on how rows are dealt to tasks.
"""

from __future__ import annotations

import pickle
import secrets
import socket
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship

BINS = 32
#: Codes of a bin and a class; rows counted at once, so that their packed sums are exact; sums of gradients and of curvatures are in units of these.
CODES, CHUNK, G_UNIT, H_UNIT = 2 * BINS, 1 << 16, 1 << 17, 1 << 30
TREES_AT_ONCE = 20
#: A leaf's value is a whole number of these, so that sums are exact and equal rows have equal sums.
VALUE_UNIT = 2.0**40


class Tasks:
    """Sums, messages and lists between the tasks of a barrier stage, by way of the first one."""

    def __init__(self):
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        self.rank, tasks = context.partitionId(), context.getTaskInfos()
        self.peers: list[socket.socket] = []
        if self.rank == 0:
            server = socket.create_server(("", 0), backlog=len(tasks))
            server.settimeout(600)
        said = context.allGather(f"{server.getsockname()[1]} {secrets.token_hex(16)}" if self.rank == 0 else "")
        port, token = said[0].split()
        if self.rank == 0:
            at: dict[int, socket.socket] = {}
            while len(at) < len(tasks) - 1:
                peer, _ = server.accept()
                self._ready(peer)
                if secrets.compare_digest(self._exactly(peer, 32), token.encode()):
                    at[struct.unpack("<q", self._exactly(peer, 8))[0]] = peer
                else:
                    peer.close()
            server.close()
            self.peers = [at[k] for k in sorted(at)]
        else:
            peer = socket.create_connection((tasks[0].address.rpartition(":")[0], int(port)), timeout=600)
            self._ready(peer)
            peer.sendall(token.encode() + struct.pack("<q", self.rank))
            self.peers = [peer]

    @staticmethod
    def _ready(peer: socket.socket) -> None:
        peer.settimeout(None)
        peer.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    @staticmethod
    def _exactly(peer: socket.socket, n: int) -> bytearray:
        data = bytearray(n)
        view, got = memoryview(data), 0
        while got < n:
            more = peer.recv_into(view[got:])
            if not more:
                raise ConnectionError("another task of this stage ended")
            got += more
        return data

    def _send(self, peer: socket.socket, data: bytes) -> None:
        peer.sendall(struct.pack("<q", len(data)))
        peer.sendall(data)

    def _receive(self, peer: socket.socket) -> bytearray:
        return self._exactly(peer, struct.unpack("<q", self._exactly(peer, 8))[0])

    def gather(self, a: np.ndarray):
        """The arrays of all tasks, one after the other, in the first task; nothing in the others."""
        if self.rank:
            self._send(self.peers[0], np.ascontiguousarray(a).data.cast("B"))
            return
        yield a
        for peer in self.peers:
            yield np.frombuffer(self._receive(peer), a.dtype)

    def sum(self, a: np.ndarray) -> np.ndarray | None:
        """The sum over all tasks in the first task, None in the others."""
        total = None
        for x in self.gather(a):
            total = x.copy() if total is None else np.add(total, x.reshape(a.shape), out=total)
        return total

    def share(self, what=None):
        """What the first task gives, in all tasks."""
        if self.rank:
            return pickle.loads(self._receive(self.peers[0]))
        data = pickle.dumps(what, 5)
        for peer in self.peers:
            self._send(peer, data)
        return what

    def total(self, a: np.ndarray) -> np.ndarray:
        """The sum over all tasks, in all tasks."""
        return self.share(self.sum(a))


def ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers of the same order."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _as_doubles(k: np.ndarray) -> np.ndarray:
    return np.where(k >> np.uint64(63), k & np.uint64((1 << 63) - 1), ~k).view(np.float64)


def thresholds(tasks: Tasks, columns: list[np.ndarray]) -> list[np.ndarray]:
    """For each column the values at which its bins end: all but the greatest if there are at most 32, else exact quantiles.

    Quantiles of all tasks' rows are found by halving, a bit of the number at a time.
    """
    keys = [np.sort(ordered(c)) for c in columns]
    few = [np.unique(k)[: BINS + 1] for k in keys]
    seen: list[np.ndarray] = [np.empty(0, np.uint64) for _ in few]
    for part in tasks.gather(np.concatenate([np.array([len(u) for u in few], np.uint64), *few])):
        lengths, at = part[: len(few)].astype(int), len(few)
        for i, n in enumerate(lengths):
            seen[i], at = np.union1d(seen[i], part[at : at + n]), at + n
    n = tasks.total(np.array([len(keys[0])], np.int64))[0]
    rank = np.tile(-(-np.arange(1, BINS) * n // BINS), (len(keys), 1))
    low = np.zeros(rank.shape, np.uint64)
    for bit in range(63, -1, -1):  # the greatest number that fewer than rank values are below
        trial = low | np.uint64(1 << bit)
        below = tasks.total(np.array([np.searchsorted(k, t, "left") for k, t in zip(keys, trial)], np.int64))
        low = np.where(below < rank, trial, low)
    return tasks.share([_as_doubles(s[:-1] if len(s) <= BINS else np.unique(q)) for s, q in zip(seen, low)])


def binned(columns: list[np.ndarray], ends: list[np.ndarray]) -> np.ndarray:
    """(features, rows) of bins; a value belongs to the first bin that ends at it or after it."""
    return np.array([np.searchsorted(e, c + 0.0, "left") for c, e in zip(columns, ends)], np.uint8)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, well mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bounds of a uniform 64-bit number for each count of a Poisson variable of mean 1.
_POISSON = np.array([min(x * 2.0**64, 2.0**64 - 2048) for x in np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, k + 1)) for k in range(16)])]).astype(np.uint64)


class Grown:
    """Trees as arrays over the nodes of all: feature and bin (greater goes to left + 1), left child, value; a leaf leads to itself."""

    def __init__(self, ends: list[np.ndarray], depth: int, start: float | None):
        self.ends, self.depth, self.start = ends, depth, start  # start: of a sum of values, which are log odds; None: values are averaged
        self.trees: list[tuple[np.ndarray, ...]] = []
        self.gain = np.zeros(len(ends))

    @property
    def featureImportances(self) -> np.ndarray:
        return self.gain / (self.gain.sum() or 1.0)

    def probability(self, total: np.ndarray) -> np.ndarray:
        total = total / VALUE_UNIT
        return total / max(1, len(self.trees)) if self.start is None else 1.0 / (1.0 + np.exp(-(self.start + total)))

    def bins(self, columns: list[np.ndarray]) -> np.ndarray:
        return binned(columns, self.ends)

    def _walk(self, tree, flat: np.ndarray, base: np.ndarray, moved: int = -1, dealt: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row that begins at base; ``dealt`` has the bins of the feature ``moved``."""
        feature, at, left = tree[:3]
        node = np.zeros(len(base), np.int32)
        for _ in range(self.depth):
            f = feature.take(node, mode="clip")
            bin_ = flat.take(base + f, mode="clip")
            if dealt is not None:
                bin_ = np.where(f == moved, dealt, bin_)
            node = left.take(node, mode="clip") + (bin_ > at.take(node, mode="clip"))
        return node

    def totals(self, codes: np.ndarray) -> np.ndarray:
        """The sum of the trees' values for codes (rows, features)."""
        n, flat = len(codes), codes.ravel()
        out = np.zeros(n, np.int64)
        for i in range(0, n, CHUNK):
            base = np.arange(i, min(i + CHUNK, n), dtype=np.int32 if codes.size < 2**31 else np.int64) * codes.shape[1]
            for tree in self.trees:
                out[i : i + CHUNK] += tree[3].take(self._walk(tree, flat, base), mode="clip")
        return out

    def totals_dealt(self, codes: np.ndarray, dealt: np.ndarray, names: list[int], repeats: int) -> tuple[np.ndarray, np.ndarray]:
        """The sum for codes, and for each place of dealt (places, rows), of ``repeats`` of each feature, with that feature's bins from there.

        A tree is walked again only for the rows on whose way it asks for the feature.
        """
        n, flat = len(codes), codes.ravel()
        whole, out = np.zeros(n, np.int64), np.zeros((len(names) * repeats, n), np.int64)
        for i in range(0, n, CHUNK // 4):
            own = slice(i, min(i + CHUNK // 4, n))
            base = np.arange(own.start, own.stop, dtype=np.int64) * codes.shape[1]
            for tree in self.trees:
                leaf = self._walk(tree, flat, base)
                value = tree[3].take(leaf)
                whole[own] += value
                asked = tree[4].take(leaf)
                for k, f in enumerate(names):
                    rows = np.flatnonzero(asked >> np.int64(f) & 1)
                    if len(rows):
                        places = slice(k * repeats, (k + 1) * repeats)
                        there = self._walk(tree, flat, np.tile(base[rows], repeats), f, dealt[places, own][:, rows].ravel())
                        change = tree[3].take(there).reshape(repeats, -1) - value[rows]
                        for r in range(repeats):
                            out[k * repeats + r, own.start + rows] += change[r]
        return whole, out + whole

    def add(self, feature: list, at: list, left: list, value: list) -> None:
        """A tree; nodes without a split have the feature -1."""
        f = np.array(feature, np.int16)
        leaf = f < 0
        left = np.where(leaf, np.arange(len(f)), np.array(left, np.int32)).astype(np.int32)
        asked = np.zeros(len(f), np.int64)
        for i in np.flatnonzero(~leaf):  # parents come before their children
            asked[left[i]] = asked[left[i] + 1] = asked[i] | 1 << int(f[i])
        self.trees.append((np.where(leaf, 0, f).astype(np.int32), np.where(leaf, 255, np.array(at, np.int64)).astype(np.uint8), left, np.rint(np.array(value) * VALUE_UNIT).astype(np.int64), asked))


def _best(square, n: np.ndarray, s: np.ndarray, weigh: np.ndarray):
    """Of histograms (nodes, features, bins, classes) of counts and sums: per node the place of the best split, its gain, counts and sums left of it and of all."""
    n_left, s_left = n.cumsum(2), s.cumsum(2)
    n_all, s_all = n_left[:, :, -1:, :], s_left[:, :, -1:, :]
    gain = square(n_left * weigh, s_left * weigh) + square((n_all - n_left) * weigh, (s_all - s_left) * weigh) - square(n_all * weigh, s_all * weigh)
    some = n_left.sum(3)
    gain = np.where((some > 0) & (some < n_all.sum(3)), gain, -1.0).reshape(len(n), -1)
    best = gain.argmax(1)
    rows = np.arange(len(n))
    flat = lambda x: x.reshape(len(n), -1, 2)[rows, best]
    return best, gain[rows, best], flat(n_left), flat(s_left), n_all[:, 0, 0], s_all[:, 0, 0]


def _gini(n: np.ndarray, s: np.ndarray) -> np.ndarray:
    w = n.sum(-1)
    return np.divide((n * n).sum(-1), w, out=np.zeros(w.shape), where=w > 0)


def _variance(n: np.ndarray, s: np.ndarray) -> np.ndarray:
    w, g = n.sum(-1), s[..., 1] - s[..., 0]
    return np.divide(g * g, w, out=np.zeros(w.shape), where=w > 0)


LEAST_GAIN = 1e-9


def forest(tasks: Tasks, codes: np.ndarray, keys: np.ndarray, ends: list[np.ndarray], weigh: np.ndarray, trees: int, depth: int, seed: int) -> Grown:
    """Trees on Poisson resamples, of a root's number of features drawn for each node, split by Gini impurity.

    codes (features, rows) are twice the bin and the class; a row's resamples follow its key.
    """
    width, flat = len(codes), np.ascontiguousarray(codes.T).ravel()
    k, out = int(np.ceil(np.sqrt(width))), Grown(ends, depth, None)
    place = np.int32 if len(flat) < 2**31 else np.int64
    for first in range(0, trees, TREES_AT_ONCE):
        numbers = range(first, min(first + TREES_AT_ONCE, trees))
        rows, weights, nodes = [], [], []
        for t in numbers:
            salt = np.uint64((seed * 1_000_003 + t) * 0x9E3779B97F4A7C15 % 2**64)
            w = np.searchsorted(_POISSON, _mixed(keys ^ _mixed(np.array([salt]))), "left")
            own = np.flatnonzero(w)
            rows.append(own.astype(place) * width)
            weights.append(w[own].astype(np.float64))
            nodes.append(np.zeros(len(own), np.int32))
        alive = [1] * len(numbers)
        built = [([-1], [0], [0], [0.0]) for _ in numbers]  # of the first task: feature, bin, left, value
        ids = [np.zeros(1, np.int64) for _ in numbers]
        for level in range(depth):
            if not any(alive):
                break
            asked = [np.argsort(np.random.default_rng([seed, t, level]).random((m, width)), 1)[:, :k].astype(place) for t, m in zip(numbers, alive)]
            counts = np.empty((sum(alive), k, CODES), np.int32)
            end = 0
            for i, m in enumerate(alive):
                start, end = end, end + m
                for j in range(k if m else 0):
                    code = flat.take(rows[i] + asked[i][:, j].take(nodes[i]), mode="clip")
                    counts[start:end, j] = np.bincount(nodes[i] * CODES + code, weights[i], m * CODES).reshape(m, CODES)
            total = tasks.sum(counts)
            told = None
            if total is not None:
                told, end = [], 0
                for i, m in enumerate(alive):
                    start, end = end, end + m
                    told.append(_grow(out, built[i], ids[i], asked[i], total[start:end].reshape(m, k, BINS, 2).astype(np.float64), weigh, level + 1 < depth) if m else None)
            told = tasks.share(told)
            for i, split in enumerate(told):
                if split is None:
                    continue
                feature, at, there, ids[i] = split
                f = feature.take(nodes[i])
                right = (flat.take(rows[i] + np.maximum(f, 0), mode="clip") >> 1) > at.take(nodes[i])
                node = there.take(2 * nodes[i] + right)
                on = np.flatnonzero(node >= 0)
                rows[i], weights[i], nodes[i], alive[i] = rows[i][on], weights[i][on], node[on], len(ids[i])
        if tasks.rank == 0:
            for b in built:
                out.add(*b)
    return out


def _grow(out: Grown, built, ids: np.ndarray, asked: np.ndarray, n: np.ndarray, weigh: np.ndarray, deeper: bool):
    """Split a level's nodes: each node's feature and bin, the place of its two children in the next level (-1: none), and the ids of those."""
    best, gain, left, _, whole, _ = _best(_gini, n, n, weigh)
    k, bin_ = np.divmod(best, BINS)
    split = gain > LEAST_GAIN
    feature = np.where(split, asked[np.arange(len(n)), k], -1).astype(np.int32)
    features, at, lefts, values = built
    there, following = np.full(2 * len(n), -1, np.int32), []
    sides = np.stack([left, whole - left], 1)
    share = lambda c: c[..., 1] * weigh[1] / np.maximum((c * weigh).sum(-1), 1e-300)
    mixed, shares = (deeper & (sides.min(2) > 0)).tolist(), share(sides).tolist()
    if len(values) == 1:
        values[0] = float(share(whole[0]))
    np.add.at(out.gain, feature[split], gain[split])
    for x in np.flatnonzero(split).tolist():
        node = int(ids[x])
        features[node], at[node], lefts[node] = int(feature[x]), int(bin_[x]), len(features)
        for side in (0, 1):
            if mixed[x][side]:
                there[2 * x + side] = len(following)
                following.append(len(features))
            for column, v in zip(built, (-1, 0, 0, shares[x][side])):
                column.append(v)
    return feature, bin_.astype(np.uint8), there, np.array(following, np.int64)


def boosted(tasks: Tasks, codes: np.ndarray, ends: list[np.ndarray], weigh: np.ndarray, start: float, rounds: int, depth: int, step: float) -> Grown:
    """Rounds of trees on the gradients of the log loss, split by their variance; a leaf's value is a Newton step.

    Of two children only the one with fewer rows is counted, the other one is the rest of its parent.
    """
    width, n = codes.shape
    y, out = (codes[0] & 1).astype(np.int64), Grown(ends, depth, start)
    score, parts = np.full(n, start), [slice(i, min(i + CHUNK, n)) for i in range(0, n, CHUNK)]
    rowwise, base = np.ascontiguousarray(codes.T).ravel(), np.arange(n, dtype=np.int64) * width
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-score))
        packed = np.rint(np.where(y == 1, 1.0 - p, p) * G_UNIT) + 2.0**34
        node, counted, m = np.zeros(n, np.int64), np.zeros(1, np.int64), 1  # place of the node in its level, place of its counts
        built, ids, parents = ([-1], [0], [0], [0.0]), [0], None
        leaf = np.zeros(n, np.int64)
        for level in range(depth):
            counts = np.zeros((2, m, width, CODES), np.int64)
            for part in parts:
                slot = counted.take(node[part])
                rows = None if level == 0 else np.flatnonzero(slot >= 0)
                where = None if level == 0 else slot[rows] * CODES
                weight = packed[part] if rows is None else packed[part][rows]
                for f in range(width):
                    code = codes[f, part]
                    got = np.bincount(code if rows is None else where + code.take(rows), weight, m * CODES)
                    number = np.floor(got / 2.0**34)
                    counts[0, :, f] += number.astype(np.int64).reshape(m, CODES)
                    counts[1, :, f] += (got - number * 2.0**34).astype(np.int64).reshape(m, CODES)
            total, told = tasks.sum(counts), None
            if total is not None:
                h = total.reshape(2, m, width, BINS, 2).astype(np.float64)
                if parents is not None:
                    level_h = np.empty((2, len(ids), width, BINS, 2))
                    for x in range(len(ids) // 2):
                        small = 0 if counted[2 * x] >= 0 else 1
                        level_h[:, 2 * x + small] = h[:, x]
                        level_h[:, 2 * x + 1 - small] = parents[:, x] - h[:, x]
                    h = level_h
                best, gain, left, _, whole, _ = _best(_variance, h[0], h[1] / G_UNIT, weigh)
                feature, bin_ = np.divmod(best, BINS)
                split = gain > LEAST_GAIN
                feature = np.where(split, feature, -1)
                there, places, following = np.full(2 * len(ids), -1, np.int64), np.full(2 * len(ids), -1, np.int64), []
                slots: list[int] = []
                for x in np.flatnonzero(split):
                    out.gain[feature[x]] += gain[x]
                    built[0][ids[x]], built[1][ids[x]], built[2][ids[x]] = int(feature[x]), int(bin_[x]), len(built[0])
                    small = int(left[x].sum() > whole[x].sum() / 2)
                    for side in (0, 1):
                        places[2 * x + side] = len(built[0])
                        there[2 * x + side] = len(following)
                        slots.append(len(following) // 2 if side == small else -1)
                        following.append(len(built[0]))
                        for column, v in zip(built, (-1, 0, 0, 0.0)):
                            column.append(v)
                told, parents, ids = (feature, bin_.astype(np.uint8), there, places, np.array(slots, np.int64)), h[:, split], following
            feature, bin_, there, places, counted = tasks.share(told)
            if not len(counted):
                break
            # Rows of nodes without a split stay at a place after all others, which is not counted.
            f, after = np.append(feature, -1).take(node), len(counted)
            right = (rowwise.take(base + np.maximum(f, 0), mode="clip") >> 1) > np.append(bin_, 255).take(node)
            on = f >= 0
            child = np.minimum(2 * node + right, len(there) - 1)
            leaf = np.where(on, places.take(child), leaf)
            node = np.where(on, there.take(child), after)
            counted = np.append(counted, -1)
            m = len(counted) // 2
        size = tasks.share(len(built[0]))
        sums = np.array([np.bincount(2 * leaf + y, x, 2 * size) for x in (packed - 2.0**34, np.rint(p * (1.0 - p) * H_UNIT))])
        sums, values = tasks.sum(sums), None
        if sums is not None:
            g, h = sums.reshape(2, size, 2) * weigh
            values = np.rint(step * ((g[:, 1] - g[:, 0]) / G_UNIT) / np.maximum(h.sum(1) / H_UNIT, 1e-9) * VALUE_UNIT) / VALUE_UNIT
            built[3][:] = values.tolist()
            out.add(*built)
        score += tasks.share(values).take(leaf)
    return out


def filled(batches, features: list[str], fill: dict[str, float]) -> list[np.ndarray]:
    """A column of doubles for each feature, with the median where a value is missing or no number."""
    out = []
    for c in features:
        x = np.concatenate([np.empty(0), *[b.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for b in batches]])
        x[np.isnan(x)] = fill[c]
        out.append(x)
    return out


def in_tasks(rows: DataFrame, function, schema: str, *by) -> DataFrame:
    """``function(tasks, batches)`` in as many tasks as there are cores, all at once; rows are dealt out by hash of ``by``."""
    ship(rows.sparkSession)

    def run(batches):
        return function(Tasks(), [b for b in batches if b.num_rows])

    return rows.repartition(max(1, rows.sparkSession.sparkContext.defaultParallelism), *by).mapInArrow(run, schema, barrier=True)


class _Learner:
    def fit(self, rows: DataFrame, features: list[str], fill: dict[str, float]) -> Grown:
        """The model of rows (label 0 or 1, features); classes weigh as much as each other if balanced."""
        import pyarrow as pa

        grow, balanced = self._grow, self.balanced

        def train(tasks, batches):
            columns = filled(batches, features, fill)
            y = np.concatenate([np.empty(0, np.uint8), *[b.column("label").to_numpy(zero_copy_only=False).astype(np.uint8) for b in batches]])
            keys = np.concatenate([np.empty(0, np.uint64), *[b.column("_key").to_numpy().view(np.uint64) for b in batches]])
            batches.clear()
            ends = thresholds(tasks, columns)
            codes = 2 * binned(columns, ends) + y
            columns.clear()
            each = tasks.total(np.bincount(y, minlength=2)[:2].astype(np.int64)).astype(np.float64)
            weigh = np.where(each > 0, each.sum() / (2.0 * np.maximum(each, 1.0)), 1.0) if balanced else np.ones(2)
            model = grow(tasks, codes, keys, ends, weigh, each)
            if tasks.rank == 0:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model, 5)], pa.binary())], ["model"])

        given = rows.select("label", *features, F.xxhash64(F.lit(self.seed), *rows.columns).alias("_key"))
        return pickle.loads(in_tasks(given, train, "model binary", "_key").collect()[0]["model"])


class RandomForestClassifier(_Learner):
    def __init__(self, numTrees: int, maxDepth: int = 10, seed: int = 42, balanced: bool = True):
        self.trees, self.depth, self.seed, self.balanced = numTrees, maxDepth, seed, balanced

    def _grow(self, tasks, codes, keys, ends, weigh, each) -> Grown:
        return forest(tasks, codes, keys, ends, weigh, self.trees, self.depth, self.seed)


class GBTClassifier(_Learner):
    def __init__(self, maxIter: int, maxDepth: int = 5, stepSize: float = 0.1, seed: int = 42, balanced: bool = True):
        self.rounds, self.depth, self.step, self.seed, self.balanced = maxIter, maxDepth, stepSize, seed, balanced

    def _grow(self, tasks, codes, keys, ends, weigh, each) -> Grown:
        w = each * weigh
        start = float(np.log(max(w[1], 1e-9) / max(w[0], 1e-9)))
        return boosted(tasks, codes, ends, weigh, start, self.rounds, self.depth, self.step)


def scored(model: Grown, rows: DataFrame, features: list[str], fill: dict[str, float]) -> DataFrame:
    """Add probability to rows."""
    import pyarrow as pa
    from pyspark.sql.types import DoubleType

    ship(rows.sparkSession)

    def run(batches):
        for b in batches:
            codes = np.ascontiguousarray(model.bins(filled([b], features, fill)).T)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.probability(model.totals(codes)))], [*b.schema.names, "probability"])

    return rows.mapInArrow(run, rows.drop("probability").schema.add("probability", DoubleType()))


def average_precision(p: np.ndarray, label: np.ndarray) -> float | None:
    """Exact, ties shared; None where there is one class."""
    order = np.argsort(-p, kind="stable")
    p, pos = p[order], (label[order] == 1).astype(np.int64)
    last = np.flatnonzero(np.append(p[1:] != p[:-1], True)) if len(p) else np.empty(0, np.int64)
    tp = np.cumsum(pos)[last]
    if not len(tp) or not 0 < tp[-1] < len(p):
        return None
    return float((np.diff(tp, prepend=0) * tp / (last + 1)).sum() / tp[-1])
