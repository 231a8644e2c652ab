import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_dataset_rows import moved
from tests.test_history import EDGES, SCHEMA, commit
from tidemark.operators import history, prefix, replay
from tidemark.session import cut
from tidemark.sources.history import changes, commit_files, latest_commits


def history_of(spark, repos, seed):
    """Commits of equal times, files named twice, fixes and references of repositories (name, commits, seconds, files)."""
    rng, rows, edges = random.Random(seed), [], []
    for repo, n, secs, files in repos:
        names = [f"d{i % 3}/{'é' if i % 5 == 4 else 'f'}{i:03}" for i in range(files)]
        some = lambda k: [names[min(int(rng.expovariate(4 / files)), files - 1)] for _ in range(k)]  # noqa: B023, E731
        times = [rng.randrange(secs) for _ in range(n)]
        for i in range(n):
            ts = None if rng.random() < 0.02 else rng.choice(times[: i + 1]) if rng.random() < 0.2 else times[i]
            rows.append((repo, *commit(f"{rng.randrange(16**8):08x}{i:04}", ts, some(rng.choice([0, 1, 2, 3, 5])), rng.choice(["m", "fix it", "Revert it"]))[1:]))
        edges += [(repo, *rng.choice([some(2), some(2), some(1) * 2, [*some(1), "$x"]])) for _ in range(files)]
    c = cut(latest_commits(spark.createDataFrame(rows, SCHEMA)))
    ch = cut(changes(c))
    times = ch.where("ts is not null").select("repo", F.col("ts").alias("t")).distinct()
    return cut(commit_files(c)), ch, cut(spark.createDataFrame(edges, EDGES)), cut(times.unionByName(spark.createDataFrame([("none", 5), (repos[0][0], 90 * history.WEEK)], "repo string, t bigint")))


REPOS = [("a", 260, 6 * history.WEEK, 24), ("b", 60, 40 * history.WEEK, 9), ("c", 1, 10, 3)]


def told(df):
    return sorted(tuple(r[c] for c in replay.OUTPUT.names) for r in df.collect())


def test_replayed_like_joins(spark, monkeypatch):
    given = history_of(spark, REPOS, 1)
    want = told(prefix.joined_features(*given))
    assert len(want) > 3000 and min(max(r[i] for r in want) for i in range(3, 7)) > 5
    assert told(prefix.temporal_features(*given)) == want
    rows = prefix._rows(*given)
    sizes = {r["repo"] for r in prefix._large(rows, (50_000, 2**22, 2**22)).collect()}
    assert sizes == {"a"}
    assert told(prefix.temporal_features(*given, most=(50_000, 2**22, 2**22))) == want
    table = rows.toArrow()
    for block, made, held in ((1, 1, 2**40), (7, 300, 2**40), (64, 10**6, 2000)):  # few or many at a time; several shares of sources
        monkeypatch.setattr(replay, "BLOCK", block)
        monkeypatch.setattr(replay, "MADE", made)
        monkeypatch.setattr(replay, "HELD", held)
        got = []
        for repo in ("a", "b", "c", "none"):
            own = table.filter(pa.compute.equal(table.column("repo"), repo))
            for batch in replay.replayed(50, 100, history.WEEK, history.TWO_WEEKS)(iter(own.to_batches())):
                got += [(r, t, *v) for r, ts, *v in zip(*(batch.column(c).to_pylist() for c in replay.OUTPUT.names)) for t in ts]
        assert sorted(got) == want, (block, made, held)


@pytest.mark.parametrize("repos", [[("one", 600, 2 * history.WEEK, 60)]])
def test_pairs_of_files_are_not_moved(spark, repos):
    given = history_of(spark, repos, 2)
    _, records = moved(spark, lambda: prefix.temporal_features(*given).write.format("noop").mode("overwrite").save())
    changed = given[1].count()
    assert records < 10 * changed, (records, changed)
