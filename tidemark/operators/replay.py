"""The lists that each time of one repository sees, from its own rows in memory: what ``prefix`` says by joins.

Plan. A repository's commits, references and times are numbers in numpy. Its times are taken a
block at a time: only what was in a list when the block began, or is touched in it and ends it
before the list's last, can be in a list in it. The totals of these few, a row for each
time, give all lists of the block at once. Pairs of files are made for some hundred
thousand at a time; where they are too many to be counted together, a first pass over
shares of the sources finds those that ever are in a list, and only these are counted.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Times of a block, pairs of files made at once, and pairs whose totals are held at once.
BLOCK, MADE, HELD = 32, 400_000, 8_000_000
EVER = -(2**62)
COMMIT, CHANGE, EDGE, TIME = range(4)
INPUT = "repo string, kind tinyint, ts bigint, sha string, path string, fix boolean, files array<string>"  # a change is a commit's files, each as often as it names it
SCHEMA = "repo string, t bigint, path string, recent_change_sequence_count bigint, propagation_frequency bigint, followup_frequency bigint, historical_rework_frequency bigint"
SPANS = SCHEMA.replace(" t bigint", " t array<bigint>")  # the times at which a file's frequencies are these
OUTPUT = pa.schema([(c.split()[0], {"string": pa.string(), "bigint": pa.int64()}.get(c.split()[1], pa.list_(pa.int64()))) for c in SPANS.split(", ")])


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges lo to hi one after another, and the range that each is of."""
    n = np.maximum(hi - lo, 0)
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) + (lo - np.cumsum(n) + n)[of], of


def _codes(values: pa.Array, names: pa.Array) -> np.ndarray:
    return pc.index_in(values, value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)


def _sorted_names(*arrays: pa.Array) -> pa.Array:
    every = pa.concat_arrays([a.unique() for a in arrays]).unique()
    return every.take(pc.sort_indices(every))


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key stands among sorted keys, and whether it is there."""
    at = np.searchsorted(keys, wanted)
    if not len(keys):
        return at, np.zeros(len(wanted), bool)
    return at, keys[np.minimum(at, len(keys) - 1)] == wanted


def _in_lists(totals: np.ndarray, k: int) -> np.ndarray:
    """Which columns are among the k largest of each row; of equal ones the earlier columns, of zeros none."""
    n = totals.shape[1]
    mask = totals > 0
    if n > k:
        order = totals * n + np.arange(n - 1, -1, -1)
        kth = np.partition(order, n - k, axis=1)[:, n - k]
        mask &= order >= kth[:, None]
    return mask


class _Best:
    """The k pairs of the largest totals, of equal ones those of smaller keys, as the times go on."""

    def __init__(self, k: int):
        self.k, self.keys, self.totals = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ahead(self, keys: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Which of the pairs are not behind the whole list."""
        if len(self.keys) < self.k:
            return totals > 0
        least = self.totals.min()
        return (totals > least) | (totals == least) & (keys <= self.keys[self.totals == least].max())

    def become(self, keys: np.ndarray, totals: np.ndarray) -> None:
        """keys are sorted and hold all that can be in the list."""
        mask = _in_lists(totals[None, :], self.k)[0]
        self.keys, self.totals = keys[mask], totals[mask]


class _Quickest:
    """The k first events by their key, as the times go on, and how often each file is in them."""

    def __init__(self, k: int):
        self.k, self.held, self.count = k, [], {}
        self.paths, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def latest(self, most: int) -> int:
        """The longest delay that can still come into the list."""
        return most if len(self.held) < self.k else min(most, self.held[-1][0])

    def take(self, events: list[tuple], rows: list[int], files) -> list[tuple[int, int, int]]:
        """Take events in order of time; (row, file, +1 or -1) for each file that comes or goes."""
        moved = []
        for key, row in zip(events, rows):
            if len(self.held) == self.k:
                if key >= self.held[-1]:
                    continue
                moved += [(row, f, -1) for f in files(self.held.pop())]
            insort(self.held, key)
            moved += [(row, f, 1) for f in files(key)]
        return moved

    def settle(self, moved: list[tuple[int, int, int]]) -> None:
        if moved:
            for _, f, n in moved:
                self.count[f] = self.count.get(f, 0) + n
            self.count = {f: n for f, n in self.count.items() if n}
            self.paths, self.counts = np.array(list(self.count), np.int64), np.array(list(self.count.values()), np.int64)


class Replay:
    """One repository's rows (INPUT) as numbers: files and shas by their order as text, times by their place."""

    def __init__(self, rows: pa.Table, pairs_k: int, k: int, window: int, again: int):
        self.pairs_k, self.k, self.window, self.again = pairs_k, k, window, again
        kind = rows.column("kind").to_numpy()
        part = lambda which, *names: [rows.filter(pa.array(kind == which)).column(c).combine_chunks() for c in names]
        (times,) = part(TIME, "ts")
        self.times = np.unique(times.to_numpy())
        ts, sha, fix, files = part(COMMIT, "ts", "sha", "fix", "files")
        source, target = part(EDGE, "sha", "path")
        c_ts, c_files = part(CHANGE, "ts", "files")
        self.names = _sorted_names(files.flatten(), source, target, c_files.flatten())
        self.n = max(len(self.names), 1)
        self._commits(ts.to_numpy(), _codes(sha, _sorted_names(sha)), fix.to_numpy(zero_copy_only=False).astype(bool), files)
        c_of = np.repeat(np.arange(len(c_ts)), pc.list_value_length(c_files).to_numpy())
        self._steady(c_ts.to_numpy()[c_of], c_of, _codes(c_files.flatten(), self.names), _codes(source, self.names), _codes(target, self.names), pc.starts_with(target, "$").to_numpy(zero_copy_only=False).astype(bool))

    def seen(self, at: np.ndarray) -> np.ndarray:
        """The first of the times that sees what happened at a time."""
        return np.searchsorted(self.times, at, side="right")

    def _commits(self, ts, sha, fix, files) -> None:
        order = np.lexsort((sha, ts))
        self.ts, self.sha, self.fix = ts[order], sha[order], fix[order]
        self.from_ = self.seen(self.ts)
        listed = files.take(pa.array(order))
        self.sizes = pc.list_value_length(listed).to_numpy().astype(np.int64)
        self.off = np.concatenate([[0], np.cumsum(self.sizes)])
        self.files = _codes(listed.flatten(), self.names)
        self.owner = np.repeat(np.arange(len(self.ts)), self.sizes)

    def _steady(self, at, commit, path, source, target, unresolved) -> None:
        """Co-changes and references: when the times see them, and since when files are linked."""
        order = np.lexsort((path, commit))
        at, commit, path = at[order], commit[order], path[order]
        last = np.searchsorted(commit, commit, side="right")
        b, a = _ranges(np.arange(1, len(commit) + 1), last)
        key, since = path[a] * self.n + path[b], at[a]  # the places of a commit are sorted by name
        real = (source != target) & ~unresolved
        always = source[real] * self.n + target[real]
        self.pairs, self.which = np.unique(np.concatenate([always, key]), return_inverse=True)
        self.now = np.bincount(self.which[: len(always)], minlength=len(self.pairs)).astype(np.int64)
        self.which = self.which[len(always) :]
        from_ = self.seen(since)
        order = np.argsort(from_, kind="stable")
        self.which, self.which_from = self.which[order], from_[order]
        both = np.concatenate([key, path[b] * self.n + path[a], source * self.n + target, target * self.n + source])
        when = np.concatenate([since, since, np.full(2 * len(source), EVER)])
        order = np.lexsort((when, both))
        both, when = both[order], when[order]
        first = np.ones(len(both), bool)
        first[1:] = both[1:] != both[:-1]
        self.linked, self.since = both[first], when[first]

    # -- pairs of files, some at a time

    def pairs_made(self) -> int:
        lo = np.searchsorted(self.ts, self.ts - self.window)
        return int(((self.off[:-1] - self.off[lo]) * self.sizes).sum())

    def portions(self) -> Iterator[tuple[int, int]]:
        """Spans of times whose commits make few enough pairs of files together."""
        lo = np.searchsorted(self.ts, self.ts - self.again)
        made = np.bincount(self.from_, ((self.off[:-1] - self.off[lo]) * self.sizes).astype(float), minlength=len(self.times) + 1)[: len(self.times)]
        start, held = 0, 0.0
        for i, n in enumerate(made):
            if held and held + n > MADE:
                yield start, i
                start, held = i, 0.0
            held += n
        if start < len(self.times):
            yield start, len(self.times)

    def _later(self, first: int, last: int) -> np.ndarray:
        """Commits that the times of a span are the first to see."""
        return np.arange(np.searchsorted(self.from_, first), np.searchsorted(self.from_, last))

    def temporal(self, first: int, last: int, share: np.ndarray | None = None, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(key, first time that sees it) of each two files of commits in the window, in order of time; share are places of sources."""
        r = self._later(first, last)
        lo, hi = self.off[np.searchsorted(self.ts, self.ts[r] - self.window)], self.off[r]
        if share is not None:
            lo, hi = np.searchsorted(share, lo), np.searchsorted(share, hi)
        q, of = _ranges(self.off[r], self.off[r + 1])
        p, to = _ranges(lo[of], hi[of])
        a, b = self.files[p if share is None else share[p]], self.files[q][to]
        key, from_ = a * self.n + b, self.from_[r][of][to]
        keep = a != b
        if wanted is not None:
            keep &= _found(wanted, key)[1]
        return key[keep], from_[keep]

    def near(self, first: int, last: int, most_follow: int, most_again: int) -> tuple[list, list]:
        """Follow-ups (from, delay, l, r) and reworks (from, delay, file, l, r) of later commits seen first by a span; delays up to a most."""
        r = self._later(first, last)
        start = np.searchsorted(self.ts, self.ts[r] - max(most_follow, most_again))
        l, of = _ranges(start, r)  # noqa: E741
        j = r[of]
        delay, never = self.ts[j] - self.ts[l], len(self.times)
        base = np.cumsum(r - start) - (r - start)
        q, o = _ranges(self.off[r], self.off[r + 1])
        p, to = _ranges(self.off[start][o], self.off[r][o])
        pair = base[o][to] + self.owner[p] - start[o][to]
        a, b = self.files[p], self.files[q][to]
        same = a == b
        shared = np.zeros(len(l), bool)
        shared[pair[same]] = True
        late = np.full(len(l), 2**62)
        ask = ~shared[pair] & ((delay[pair] <= most_follow) | self.fix[j][pair])
        at, there = _found(self.linked, a[ask] * self.n + b[ask])
        np.minimum.at(late, pair[ask][there], self.since[at[there]])
        linked = late < 2**62
        later = np.where(linked, self.seen(np.maximum(self.ts[j], late)), never)
        from_ = np.where(shared | self.fix[j], self.from_[j], later)
        f = (from_ < never) & (delay <= most_follow)
        w, x = same & (delay[pair] <= most_again), ~shared & self.fix[j] & (later < never) & (delay <= most_again)
        u = pair[w]
        again = [np.concatenate(c) for c in ((self.from_[j[u]], later[x]), (delay[u], delay[x]), (a[w], self.files[self.off[j[x]]]), (l[u], l[x]), (j[u], j[x]))]
        return [from_[f], delay[f], l[f], j[f]], again

    # -- the lists

    def _columns(self, best: _Best, keys: np.ndarray, now: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys that can be in the list while these events come in, sorted; now is moved on by the events."""
        touched, of = np.unique(which, return_inverse=True)
        now[touched] += np.bincount(of, minlength=len(touched))
        ahead = touched[best.ahead(keys[touched], now[touched])]
        return np.union1d(keys[ahead], best.keys)

    def _rows(self, columns: np.ndarray, end: np.ndarray, keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Totals of the columns at each of n times: what they are at the end, less the events after each."""
        at, there = _found(columns, keys)
        grown = np.zeros((n, len(columns)), np.int64)
        np.add.at(grown, (rows[there], at[there]), 1)
        total = np.cumsum(grown, axis=0)
        return total + (end - total[-1])

    def walk(self, share: np.ndarray | None = None, wanted: np.ndarray | None = None) -> Iterator[tuple]:
        """(first time, columns, totals by time, which are in the list) of the temporal pairs, a block at a time."""
        best, held, count = _Best(self.pairs_k), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for first, last in self.portions():
            key, from_ = self.temporal(first, last, share, wanted)
            keys, which = np.unique(key, return_inverse=True)
            at, there = _found(held, keys)
            now = np.zeros(len(keys), np.int64)
            now[there] = count[at[there]]
            for b in range(first, last, BLOCK):
                n = min(BLOCK, last - b)
                s = slice(*np.searchsorted(from_, [b, b + n]))
                columns = self._columns(best, keys, now, which[s])
                end = np.zeros(len(columns), np.int64)
                end[np.searchsorted(columns, best.keys)] = best.totals
                c, own = _found(keys, columns)
                end[own] = now[c[own]]
                totals = self._rows(columns, end, key[s], from_[s] - b, n)
                best.become(columns, totals[-1])
                yield b, n, columns, totals, _in_lists(totals, self.pairs_k)
            count[at[there]] = now[there]
            held, count = np.insert(held, at[~there], keys[~there]), np.insert(count, at[~there], now[~there])

    def relevant(self) -> np.ndarray | None:
        """The temporal pairs that ever are in a list, if there are too many to be counted together."""
        shares = -(-self.pairs_made() // HELD)
        if shares <= 1:
            return None
        found = []
        for i in range(shares):
            for _, _, columns, _, mask in self.walk(np.flatnonzero(self.files % shares == i)):
                found.append(columns[mask.any(axis=0)])
            found = [np.unique(np.concatenate(found))]
        return found[0]

    def lists(self) -> Iterator[tuple[np.ndarray, ...]]:
        """(times' places, where spans of them begin, file and four frequencies of each span) of all files of the lists, a block at a time."""
        if not len(self.times):
            return
        follow, rework, strong = _Quickest(self.k), _Quickest(self.k), _Best(self.k)
        strong.become(self.pairs, self.now)
        ends = [(s, e) for s, e in self.portions()]
        waits: list[list] = [[], []]
        events: list = []
        turn = iter(ends)
        upto = 0
        files, off = self.files.tolist(), self.off.tolist()
        files_of = lambda e: {f for i in e[3:5] for f in files[off[i] : off[i + 1]]}
        for b, n, columns, totals, mask in self.walk(wanted=self.relevant()):
            if b >= upto:
                first, upto = next(turn)
                most = (follow.latest(self.window), rework.latest(self.again))
                for k, (new, longest) in enumerate(zip(self.near(first, upto, *most), most)):
                    every = [np.concatenate([x, y]) for x, y in zip(waits[k], new)] if waits[k] else new
                    every = [x[every[1] <= longest] for x in every]
                    order = np.argsort(every[0], kind="stable")
                    cut_ = int(np.searchsorted(every[0][order], upto))
                    waits[k] = [x[order[cut_:]] for x in every]
                    every = [x[order[:cut_]] for x in every]
                    events[k : k + 1] = [every]
            f = events[0]
            s = self._span(f, b, n, follow.latest(self.window))
            moved_f = follow.take(list(zip(f[1][s].tolist(), self.sha[f[2][s]].tolist(), self.sha[f[3][s]].tolist(), f[2][s].tolist(), f[3][s].tolist())), (f[0][s] - b).tolist(), files_of)
            w = events[1]
            s = self._span(w, b, n, rework.latest(self.again))
            moved_w = rework.take(list(zip(w[1][s].tolist(), w[2][s].tolist(), self.sha[w[3][s]].tolist(), self.sha[w[4][s]].tolist())), (w[0][s] - b).tolist(), lambda e: (e[1],))
            yield self._block(b, n, columns, totals, mask, strong, (follow, moved_f), (rework, moved_w))

    @staticmethod
    def _span(events: list, b: int, n: int, longest: int) -> np.ndarray:
        s, e = np.searchsorted(events[0], [b, b + n])
        return s + np.flatnonzero(events[1][s:e] <= longest)

    def _block(self, b, n, columns, totals, mask, strong, *quick) -> tuple[np.ndarray, ...]:
        s = slice(*np.searchsorted(self.which_from, [b, b + n]))
        which = self.which[s]
        every = np.union1d(self._columns(strong, self.pairs, self.now, which), columns)
        at, there = _found(self.pairs, every)
        end = np.zeros(len(every), np.int64)
        end[there] = self.now[at[there]]
        strength = self._rows(every, end, self.pairs[which], self.which_from[s] - b, n)
        strong.become(every, strength[-1])
        strength[:, np.searchsorted(every, columns)] += np.where(mask, totals, 0)
        strongest = _in_lists(strength, self.k)
        row_t, col_t = np.nonzero(mask)
        row_s, col_s = np.nonzero(strongest)
        ends_t, ends_s = np.divmod(columns, self.n), np.divmod(every, self.n)
        moved = [np.array(m, np.int64).reshape(-1, 3) for _, m in quick]
        met = [e[m.any(axis=0)] for ends, m in ((ends_t, mask), (ends_s, strongest)) for e in ends]
        paths = np.unique(np.concatenate([*met, *[q.paths for q, _ in quick], *[m[:, 1] for m in moved]]))
        m = len(paths)
        find = lambda path: np.searchsorted(paths, path)
        of_pairs, of_strong = np.zeros(n * m, np.int64), np.zeros(n * m, np.int64)
        listed = np.zeros(n * m, bool)
        for ends in ends_t:
            listed[row_t * m + find(ends)[col_t]] = True
        np.add.at(of_pairs, row_t * m + find(ends_t[0])[col_t], totals[row_t, col_t])
        for ends in ends_s:
            np.add.at(of_strong, row_s * m + find(ends)[col_s], strength[row_s, col_s])
        often = []
        for (q, gone), change in zip(quick, moved):
            d = np.zeros((n, m), np.int64)
            d[0, find(q.paths)] = q.counts
            np.add.at(d.reshape(-1), change[:, 0] * m + find(change[:, 1]), change[:, 2])
            often.append(np.cumsum(d, axis=0))
            q.settle(gone)
        values = np.stack([of_pairs.reshape(n, m), of_strong.reshape(n, m), *often])
        there = listed.reshape(n, m) | (values[1:] > 0).any(axis=0)
        other = there.copy()
        other[1:] &= ~there[:-1] | (values[:, 1:] != values[:, :-1]).any(axis=0)
        path, row = np.nonzero(there.T)
        start = np.flatnonzero(other.T[path, row])
        return b + row, start, paths[path[start]], *values[:, row[start], path[start]]


def replayed(pairs_k: int, k: int, window: int, again: int, rows_out: int = 60_000):
    """A function of a repository's rows, for ``applyInArrow``; its rows are SPANS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        repo, replay = rows.column("repo")[0], Replay(rows, pairs_k, k, window, again)
        del rows
        held, n = [], 0

        def out() -> pa.RecordBatch:
            begin = np.cumsum([0, *[len(h[0]) for h in held]])
            t, start, path, *values = (np.concatenate(c) for c in zip(*held))
            start += np.repeat(begin[:-1], [len(h[1]) for h in held])
            times = pa.ListArray.from_arrays(pa.array(np.append(start, len(t)), pa.int32()), pa.array(replay.times[t]))
            return pa.RecordBatch.from_arrays([pa.repeat(repo, len(path)), times, replay.names.take(pa.array(path)), *map(pa.array, values)], schema=OUTPUT)

        for block in replay.lists():
            held.append(block)
            n += len(block[0])
            if n >= rows_out:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return run
