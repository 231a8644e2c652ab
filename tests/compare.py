"""A Spark query beside its SQL on the smallest tables."""

import glob
import os

import duckdb

FOLDER = "/root/testdata/sf0.001"


def database():
    db = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        db.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    db.sql("set timezone = 'UTC'")
    return db


def assert_same(df, sql, at):
    df.write.mode("overwrite").parquet(str(at))
    db = database()
    db.sql(f"create view got as select * from read_parquet('{at}/*.parquet')")
    db.sql(f"create table want as {sql}")
    columns = lambda t: sorted(r[0] for r in db.sql(f"describe {t}").fetchall())
    assert columns("got") == columns("want")
    names = ", ".join(f'"{c}"' for c in columns("want"))
    more = db.sql(f"select {names} from got except all select {names} from want limit 3").fetchall()
    less = db.sql(f"select {names} from want except all select {names} from got limit 3").fetchall()
    assert not more and not less, (more, less)
