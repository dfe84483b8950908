"""Queries read whole tables: steps of all users against plain Python, and counts of rows."""

from collections import defaultdict

from specgraph.plans import catalog
from specgraph.plans.fixtures import load

#: sf0.001 has no user above 20.
SF = "/root/testdata/sf0.01"


def test_steps_of_all_users(spark):
    users = defaultdict(list)
    for r in load(spark, SF, "events").collect():
        users[r.user_id].append((r.ts, r.event_id, r.event_type))
    want = {(str(u), k, a[2], b[2]) for u, e in users.items() if u is not None for x in [sorted(e)] for k, (a, b) in enumerate(zip(x, x[1:]))}
    rows = catalog.QUERIES["jn22_step_nodes"](spark, SF).collect()
    assert len(rows) == len(want) and {(r.tc_id, r.pos, r.src_id[2:], r.dst_id[2:]) for r in rows} == want
    assert len({w[0] for w in want}) > 20
    valid = sum(a < b for _, _, a, b in want)  # each forward edge stands in the graph
    got = catalog.QUERIES["agg17_path_validity"](spark, SF).first()
    assert (got.checked, got.valid) == (len(want), valid) and abs(got.pct - 100 * valid / len(want)) <= 0.0501


def test_edges_are_whole(spark):
    assert load(spark, SF, "raw_edges").filter("ord < 9000000000").count() == load(spark, SF, "lineitem").count()
