"""Folds over events against plain loops."""

import duckdb

from lingsmith.plans import QUERIES

SF = "/root/testdata/sf0.001"


def events():
    rows = duckdb.sql(f"select user_id, event_id, event_type, epoch_us(ts) from '{SF}/events.parquet' order by user_id, ts, event_id").fetchall()
    by = {}
    for u, *r in rows:
        by.setdefault(u, []).append(r)
    return by


def test_tails(spark):
    want = []
    for u, rows in events().items():
        open_ = None
        for e, kind, _ in rows:
            if kind == "purchase":
                open_ = [u, e, "", False]
                want.append(open_)
            elif open_ and not open_[3]:
                if kind == "error":
                    open_[3] = open_[2] == ""
                    open_[2] = open_[2][:-1]
                else:
                    open_[2] += kind[0]
    got = QUERIES["m18_pending_tails"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_parts(spark):
    want = []
    for u, rows in events().items():
        n, began, last = 0, None, None
        for e, _, at in rows:
            at /= 1e6
            if last is None or at - last >= 36_000 or at - last >= 2400 and last - began >= 7200 or at - began >= 86_400:
                want.append([u, n, e, 0])
                n, began = n + 1, at
            last = at
            want[-1][3] += 1
    assert sorted(map(tuple, QUERIES["m08_dictation_parts"](spark, SF).collect())) == sorted(map(tuple, want))
