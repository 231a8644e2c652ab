import datetime as dt
import random

from tidemark.operators.wide import column_names, wide_features

EVENTS = "activity_id bigint, repo string, file_path string, event_kind string, churn bigint, happened_at timestamp, received_at timestamp, kind string, _k int"
KINDS = "kind_id int, kind string, family string"
T0 = dt.datetime(2024, 1, 1)


def at(h):
    return None if h is None else T0 + dt.timedelta(hours=h)


def brute(events, kinds, as_of):
    names = {k.strip().lower(): p for k, p in zip(kinds, column_names([k.strip().lower() for k in kinds]))}
    once, rest = {}, []
    for e in events:
        key = (dt.datetime.max if e[6] is None else e[6],)
        if e[0] is None:
            rest.append(e)
        elif e[0] not in once or key < once[e[0]][0]:
            once[e[0]] = (key, e)
    out = {}
    for e in [x for _, x in once.values()] + rest:
        row = out.setdefault((e[1], e[2]), {p: [0, None, 0] for p in names.values()})
        p = names.get((e[3] or "").strip().lower())
        if p:
            row[p][0] += 1
            row[p][1] = max([x for x in (row[p][1], e[5]) if x is not None], default=None)
            row[p][2] += e[4] if e[4] is not None and e[4] >= 0 else 0
    return {k: {p: (n, t, None if t is None else int((as_of - t).total_seconds() // 1), c) for p, (n, t, c) in v.items()} for k, v in out.items()}


def run(spark, events, kinds, **kw):
    df = wide_features(spark.createDataFrame(events, EVENTS), spark.createDataFrame([(i, k, "f") for i, k in enumerate(kinds)], KINDS), ["repo", "file_path"], **kw)
    prefixes = [c[: -len("_count")] for c in df.columns if c.endswith("_count")]
    return {(r["repo"], r["file_path"]): {p: (r[f"{p}_count"], r[f"{p}_last_at"], r[f"{p}_secs_since"], r[f"{p}_churn"]) for p in prefixes} for r in df.collect()}


def test_like_brute_force(spark):
    rng = random.Random(4)
    kinds = ["a.open", "a.close", "b-x"]
    events = []
    for i in range(600):
        e = (i, f"r{rng.randrange(2)}", f"p{min(int(rng.expovariate(0.4)), 30)}", rng.choice(["a.open", " A.OPEN", "a.close ", "B-x", "other", None]), rng.choice([None, -1, 0, 5]), at(rng.choice([None, rng.randrange(500)])), at(600 + i), "clash", 1)
        events += [e] + [(*e[:6], at(2000 + i), *e[7:])] * rng.randrange(3)
    as_of = max(e[6] for e in events)
    assert run(spark, events, kinds, rows_out=7) == brute(events, kinds, as_of)


def test_nulls_and_nothing(spark):
    events = [(None, "r", "p", "k", 1, at(1), at(2), "", 0), (None, "r", "p", "k", 1, at(1), at(2), "", 0), (1, None, "p", "K ", 2, at(3), None, "", 0), (2, "r", None, "x", None, None, None, "", 0), (3, "r", "p" * 50_000, "k", 3, at(9), at(9), "", 0)]
    got = run(spark, events, ["k", "K"])
    assert got["r", "p"]["k"][0] == 2 and got["r", "p"]["k"][3] == 2 and got[None, "p"]["k"][:2] == (1, at(3)) and got["r", None]["k"] == (0, None, None, 0) and got["r", "p" * 50_000]["k"][2] == 0
    assert run(spark, events[:0], ["k"]) == {} and list(run(spark, events[:1], [])) == [("r", "p")]


def test_names():
    assert column_names(["a.b", "A-B", "", "a b"]) == ["a_b", "a_b_2", "kind", "a_b_3"]
