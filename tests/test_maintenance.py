"""Snapshot changes, deliveries, nested records, rolling totals: defined cases and brute force."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from lakesift.operators import delivery, snapshots
from lakesift.operators.delivery import SeenState, dedup_deliveries, dropped_deliveries
from lakesift.operators.finding_tables import child_records, nested_findings
from lakesift.operators.inlining import analyse, tables
from lakesift.operators.rolling import ScanTotals, advance, averages, load_by_last_day, scan_state
from lakesift.operators.snapshots import finding_changes, snapshot_changes
from lakesift.operators.versions import LostRaceError
from lakesift.plans import maintenance as registry
from lakesift.runtime import fresh_path, materialise, workspace

SNAP = "project_name string, snapshot_no int, loaded_at timestamp, file string, pii_type string, code_snippet_norm string, sink_kind string, severity string, line int, extra string"


def snap(spark, rows):
    t = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(p, n, t + dt.timedelta(hours=h), f, "email", s, k, sev, line, "x") for p, n, h, f, s, k, sev, line in rows], SNAP)


def kinds(df):
    return sorted((r.project_name, r.snapshot_no, r.change_kind, r.file, r.sink_kind) for r in df.collect())


def test_changes_canonical_and_repeated(spark):
    rows = [
        ("p", 1, 0, "a\\b.py", "x  = 1 ", None, "High", 3),
        ("p", 1, 1, "a/b.py", "x = 1", "", "high", 3),
        ("p", 4, 2, "a/b.py", "x\t= 1", "", "HIGH", 3),
        ("p", 4, 2, "c.py", "y", "database", "low", 1),
        ("p", 5, 3, "c.py", "y", "database", "low", 2),
    ]
    assert kinds(finding_changes(snap(spark, rows))) == [("p", 4, "added", "c.py", "database"), ("p", 5, "changed", "c.py", "database"), ("p", 5, "removed", "a/b.py", "")]


def test_changes_nulls_ties_empty(spark):
    rows = [("p", 1, 0, None, None, None, None, None), ("p", 2, 1, None, None, None, None, 1), (None, 1, 0, "a", "s", "", "low", 1), ("p", None, 0, "a", "s", "", "low", 1)]
    assert kinds(finding_changes(snap(spark, rows))) == [("p", 2, "changed", None, "")]
    tie = [("p", 1, 0, "a", "s", "", "low", 1), ("p", 2, 5, "a", "s", "", "low", 1), ("p", 2, 9, "a", "s", "", "low", 7), ("p", 2, 7, "a", "s", "", "low", 3)]
    got = finding_changes(snap(spark, tie)).select("new_line").collect()
    assert [r.new_line for r in got] == [7]  # the row loaded last holds
    assert finding_changes(snap(spark, [])).count() == 0
    long = [("p", 1, 0, "a", "s " * 100_000, "", "low", 1), ("p", 2, 0, "a", "s " * 100_000 + "t", "", "low", 1)]
    assert finding_changes(snap(spark, long)).count() == 2


def test_changes_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"p{rng.randint(0, 2)}", rng.choice([1, 2, 5, 6]), 0, f"f{rng.randint(0, 9)}", "s", "", rng.choice(["low", "Low", "high"]), rng.randint(1, 2)) for _ in range(150)]
    once = {}
    for p, n, _, f, _, _, sev, line in rows:
        k = (p, n, f)
        once[k] = max(once.get(k, ("", 0)), (sev.lower(), line))
    want = []
    for p in {k[0] for k in once}:
        ns = sorted({k[1] for k in once if k[0] == p})
        for a, b in zip(ns, ns[1:], strict=False):
            fa, fb = ({k[2] for k in once if k[:2] == (p, n)} for n in (a, b))
            want += [(p, b, "added", f, "") for f in fb - fa] + [(p, b, "removed", f, "") for f in fa - fb]
            want += [(p, b, "changed", f, "") for f in fa & fb if once[p, a, f] != once[p, b, f]]
    assert kinds(finding_changes(snap(spark, rows))) == sorted(want)
    salted = snapshot_changes(snap(spark, rows), "project_name", "snapshot_no", snapshots.fingerprint_key(), {"severity": F.lower("severity"), "line": F.col("line")}, "loaded_at", listed=0)
    assert kinds(salted) == sorted(want)


@pytest.mark.parametrize("listed", [0, 1000])
def test_changes_shuffle_rows_by_key_hash_only(spark, monkeypatch, listed):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = snapshot_changes(snap(spark, [("p", 1, 0, "a", "s", "", "low", 1)]), "project_name", "snapshot_no", snapshots.fingerprint_key(), {"line": F.col("line")}, listed=listed)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert exchanges and all("_k#" in x or "_salt#" in x for x in exchanges)


def test_changes_never_broadcast_a_long_list(spark):
    rows = [(f"p{i}", n, 0, "a", "s", "", "low", n) for i in range(50) for n in (1, 2)]
    df = snapshot_changes(snap(spark, rows), "project_name", "snapshot_no", snapshots.fingerprint_key(), {"line": F.col("line")}, listed=0)
    assert df.where("change_kind = 'changed'").count() == 50
    joins = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Join " in x and "_salt#" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


@pytest.mark.parametrize("listed", [0, 1000])
def test_changes_of_large_snapshots_and_gaps(spark, listed):
    rng = random.Random(8)
    low, high = -(2**63), 2**63 - 1
    rows = [(rng.choice(["p", "p", "q"]), rng.choice([low, 1, 2, 3, 7, 9, high]), 0, f"f{rng.randint(0, 5)}", "s", "", "low", rng.randint(1, 2)) for _ in range(300)]
    schema = SNAP.replace("snapshot_no int", "snapshot_no bigint")
    t = dt.datetime(2025, 1, 1)
    df = spark.createDataFrame([(p, n, t, f, "email", s, k, sev, line, "x") for p, n, _, f, s, k, sev, line in rows], schema)
    held = {}
    for p, n, _, f, _, _, _, line in rows:
        now = held.setdefault(p, {}).setdefault(n, {})
        now[f] = max(line, now.get(f, 0))
    want = []
    for p, by_no in held.items():
        numbers = sorted(by_no)
        for before, n in zip(numbers, numbers[1:], strict=False):
            for f in by_no[before].keys() | by_no[n].keys():
                old, now = by_no[before].get(f), by_no[n].get(f)
                if old != now:
                    want.append((p, n, "added" if old is None else "removed" if now is None else "changed", f, old, now))
    got = snapshot_changes(df, "project_name", "snapshot_no", snapshots.fingerprint_key(), {"line": F.col("line")}, "loaded_at", listed=listed, part=2)
    key = ("project_name", "snapshot_no", "change_kind", "file", "old_line", "new_line")
    assert sorted(map(str, got.select(*key).collect())) == sorted(str(Row(**dict(zip(key, x, strict=True)))) for x in want)


def test_generic_changes_with_other_names(spark):
    df = spark.createDataFrame([("g", 1, 1, "a"), ("g", 2, 1, "b"), ("g", 2, 2, "c")], "_g string, n int, id int, v string")
    got = snapshot_changes(df, "_g", "n", {"id": F.col("id")}, {"v": F.col("v")}).select("change_kind", "id", "old_v", "new_v").collect()
    assert sorted(map(tuple, got), key=str) == [("added", 2, None, "c"), ("changed", 1, "a", "b")]


MSG = "delivery_no bigint, id string, event_type string, _c_id string"


def state(spark, shards=4):
    return SeenState(spark, fresh_path(spark, "test-seen"), shards)


def test_deliveries_one_copy(spark):
    rows = [(5, "e1", "a", "x"), (2, " e1", "b", "x"), (9, "e1\n", None, "x"), (1, "E1", "a", "x"), (3, None, "a", "x"), (4, None, "a", "x"), (7, "", "a", "x"), (8, "", "a", "x")]
    df = spark.createDataFrame(rows, MSG)
    s = state(spark)
    kept, dropped = dedup_deliveries(df, "id", "delivery_no", s)
    assert sorted(r.delivery_no for r in kept.collect()) == [1, 2, 3, 4, 7]
    assert sorted(r.delivery_no for r in dropped.collect()) == [5, 8, 9]
    kept2, dropped2 = dedup_deliveries(spark.createDataFrame([(1, "e1", "z", "x"), (1, "new", "z", "x")], MSG), "id", "delivery_no", s)
    assert [r.id for r in kept2.collect()] == ["new"] and [r.id for r in dropped2.collect()] == ["e1"]
    assert s.version() == 2 and s.stored("dict").count() == 4


def test_deliveries_ties_nulls_empty(spark):
    rows = [(1, "a", "x", "q"), (1, "a", "y", "q"), (None, "b", "x", "q"), (None, "b", "x", "q"), (None, "a", "x", "q")]
    kept, _ = dedup_deliveries(spark.createDataFrame(rows, MSG), "id", "delivery_no", state(spark))
    assert sorted(r.id for r in kept.collect()) == ["a", "b"]
    empty = spark.createDataFrame([], MSG)
    kept, dropped = dedup_deliveries(empty, "id", "delivery_no", state(spark))
    assert kept.count() == 0 and dropped.count() == 0


def test_deliveries_batches_equal_one_load(spark):
    rng = random.Random(1)
    rows = [(i, f"id{rng.randint(0, 300)}" if rng.random() < 0.7 else "hot", "t", "x") for i in range(900)]
    whole = {r.delivery_no for r in dropped_deliveries(spark.createDataFrame(rows, MSG), "id", "delivery_no", state(spark)).collect()}
    s, parts = state(spark), set()
    for a in range(0, 900, 300):
        parts |= {r.delivery_no for r in dropped_deliveries(spark.createDataFrame(rows[a : a + 300], MSG), "id", "delivery_no", s).collect()}
    assert whole == parts
    codes = s.stored("dict")
    assert codes.select("shard", "code").distinct().count() == codes.count() == codes.select("id").distinct().count()
    assert s.stored("bits").select(F.sum(F.bitmap_count("bits"))).first()[0] == codes.count()


def delivered(spark, *rows):
    return spark.createDataFrame([(n, i, "t", "q") for n, i in rows], MSG)


@pytest.mark.parametrize("step", ["write", "commit", "publish"])
def test_deliveries_survive_a_lost_job(spark, monkeypatch, step):
    s = state(spark)
    first = delivered(spark, (1, "a"), (2, "a"), (3, "b"))
    with monkeypatch.context() as m:
        whole = getattr(SeenState, step)

        def lost(self, *args, **kw):
            if step == "write":  # what a version consists of is written, but for the last part
                if args[2] == "dict":
                    raise RuntimeError("lost")
                return whole(self, *args, **kw)
            raise RuntimeError("lost")

        m.setattr(SeenState, step, lost)
        with pytest.raises(RuntimeError, match="lost"):
            dedup_deliveries(first, "id", "delivery_no", s, "b1")
    assert s.version() == 0 and s.stored("dict").count() == 0
    kept, dropped = dedup_deliveries(first, "id", "delivery_no", s, "b1")
    assert sorted(r.delivery_no for r in kept.collect()) == [1, 3] and [r.delivery_no for r in dropped.collect()] == [2] and s.version() == 1


def test_deliveries_of_a_batch_run_again(spark, monkeypatch):
    s = state(spark)
    first, second = delivered(spark, (1, "a"), (2, "a")), delivered(spark, (3, "a"), (4, "c"))
    with monkeypatch.context() as m:  # the job ends between pointer and marker
        m.setattr(SeenState, "committed", lambda self, batch: None)
        dedup_deliveries(first, "id", "delivery_no", s, "b1")
    for _ in range(2):
        assert [r.delivery_no for r in dedup_deliveries(first, "id", "delivery_no", s, "b1")[0].collect()] == [1]
    assert [r.delivery_no for r in dedup_deliveries(second, "id", "delivery_no", s, "b2")[0].collect()] == [4]
    assert [r.delivery_no for r in dedup_deliveries(first, "id", "delivery_no", s, "b1")[0].collect()] == [1]
    assert s.version() == 2


def test_deliveries_of_two_writers(spark, monkeypatch):
    one, two = state(spark), None
    two = SeenState(spark, one.path, one.shards)
    publish = SeenState.publish

    def late(self, n, manifest):  # the other writer commits first
        monkeypatch.setattr(SeenState, "publish", publish)
        dedup_deliveries(delivered(spark, (5, "x")), "id", "delivery_no", two)
        publish(self, n, manifest)

    monkeypatch.setattr(SeenState, "publish", late)
    with pytest.raises(LostRaceError):
        dedup_deliveries(delivered(spark, (1, "a")), "id", "delivery_no", one)
    assert [r.id for r in one.stored("dict").collect()] == ["x"] and one.version() == 1
    kept, _ = dedup_deliveries(delivered(spark, (1, "a"), (6, "x")), "id", "delivery_no", one)
    assert [r.id for r in kept.collect()] == ["a"]


def test_deliveries_numbered_in_groups_and_compacted(spark, monkeypatch):
    monkeypatch.setattr(delivery, "GROUP_ROWS", 5)
    monkeypatch.setattr(delivery, "COMPACT_AFTER", 2)
    s = state(spark, 2)
    for k in range(4):
        dedup_deliveries(delivered(spark, *[(i, f"id{i}") for i in range(k * 30, k * 30 + 60)]), "id", "delivery_no", s)
    codes = s.stored("dict")
    assert codes.count() == 150 == codes.select("id").distinct().count() == codes.select("shard", "code").distinct().count()
    assert sum(r.n for r in codes.groupBy("shard").agg((F.max("code") + 1).alias("n")).collect()) == 150  # no number is left out
    assert len(s.manifest()["dicts"]) == 2


def test_registered_deliveries_meet_stored_bits(spark, sf, monkeypatch):
    seen = []
    commit = SeenState.commit
    monkeypatch.setattr(SeenState, "commit", lambda self, *a: (seen.append(self.stored("bits").count()), commit(self, *a))[1])
    registry.QUERIES["p2_found"](spark, sf)
    assert len(seen) == 2 and seen[0] == 0 and seen[1] > 0


JSON = "id string, data_flow string, framework_mappings string, pos int"


def children(spark, rows):
    return sorted(((r.finding_id, r.child, r.pos, r.item) for r in child_records(spark.createDataFrame(rows, JSON), "t").collect()), key=str)


def test_children_of_json(spark):
    node = '{"kind":"user_input","location":{"file":"a"}}'
    rows = [
        ("1", '{"source":"user_input","sink":{"kind":null},"path":[null,{"file":"f1"},"f2"]}', '{"article":"A"}', 1),
        ("2", f'[{{"source":{node},"path":{{"file":"p"}}}}]', '[null,{"article":"B"},{"title":"no article"},3]', 1),
        ("3", '"{\\"source\\":\\"x\\"}"', '"[{\\"article\\":\\"C\\"}]"', 1),
        ("4", '{"source":"user_input"', "[{\"article\":\"D\"}", 1),
        ("5", '{"source":"a"} trailing', '[{"article":"E"}] x', 1),
        ("6", None, "", 1),
        ("7", "null", "[]", 1),
        ("8", f"[{{\"source\":{node}}},{{\"source\":{node}}}]", "12", 1),
        ("9", "{'source':'x'}", "[]", 1),
    ]
    assert children(spark, rows) == sorted(
        [
            ("1", "flow_source", 0, "user_input"), ("1", "flow_sink", 0, None), ("1", "flow_path", 1, "f1"), ("1", "flow_path", 2, "f2"), ("1", "mapping", 0, "A"),
            ("2", "flow_source", 0, "user_input"), ("2", "flow_path", 0, "p"), ("2", "mapping", 1, "B"), ("2", "mapping", 2, None),
            ("3", "flow_source", 0, "x"), ("3", "mapping", 0, "C"),
        ],
        key=str,
    )


def test_children_however_wrapped(spark):
    import json

    flow = '{"source":"a","path":"[slug].tsx"}'
    for _ in range(7):
        flow = json.dumps(flow)
    rows = [
        ("1", flow, None, 1), ("2", '{"path":"{id}.ts","sink":"{x"}', None, 1), ("3", '{"path":["[a].ts","{b}",{"file":null},{}]}', None, 1), ("4", json.dumps('"'), None, 1), ("5", '{"path":"[1].tsx"}', None, 1),
        ("6", '{"path":"[id]"}', None, 1),
    ]
    assert children(spark, rows) == sorted(
        [("1", "flow_source", 0, "a"), ("1", "flow_path", 0, "[slug].tsx"), ("2", "flow_path", 0, "{id}.ts"), ("2", "flow_sink", 0, "{x"), ("3", "flow_path", 0, "[a].ts"), ("3", "flow_path", 1, "{b}"),
         ("3", "flow_path", 2, None), ("3", "flow_path", 3, None), ("5", "flow_path", 0, "[1].tsx"), ("6", "flow_path", 0, "[id]")],
        key=str,
    )


def test_children_repeats_empty_and_long(spark):
    rows = [("1", '{"source":"a"}', None, 1), ("1", '{"source":"a"}', None, 1)]
    assert children(spark, rows) == [("1", "flow_source", 0, "a")]
    assert children(spark, []) == []
    many = "[" + ",".join('{"article":"%d"}' % i for i in range(20_000)) + "]"
    assert len(children(spark, [("1", None, many, 1)])) == 20_000


def test_tables_of_structures_link_up(spark, sf):
    nested = nested_findings(spark.read.parquet(f"{sf}/findings.parquet"))
    graph = analyse(nested.schema, ["data_flow", "framework_mappings"], {"source": "flow_end", "framework_mappings": "mapping"})
    assert sorted(graph.own.values()) == ["flow_end", "location", "mapping"]
    out = tables(nested, "id", ["data_flow", "framework_mappings"], {"source": "flow_end", "framework_mappings": "mapping"})
    ends, places = out["flow_end"], out["location"]
    held = places.where("parent_table = 'flow_end'")
    assert held.join(ends.select("root_id", F.col("node").alias("parent")), ["root_id", "parent"], "left_anti").count() == 0
    assert places.select("root_id", "node").distinct().count() == places.count()
    rebuilt = nested.select(F.sum(F.coalesce(F.size(F.filter("data_flow.path", lambda p: p.isNotNull())), F.lit(0)))).first()[0]
    assert places.where("role like '%path'").count() == rebuilt


def test_tables_of_nested_arrays(spark):
    df = spark.createDataFrame([Row(k=1, a=[Row(x=1, b=[Row(y="p"), None]), None, Row(x=2, b=[])], tags=["t", None])], "k int, a array<struct<x:int,b:array<struct<y:string>>>>, tags array<string>")
    out = tables(df, "k", ["a", "tags"])
    assert [(r.node, r.pos, r.x) for r in out["a"].orderBy("pos").collect()] == [("a[0]", 0, 1), ("a[2]", 2, 2)]
    assert [(r.parent, r.node, r.y) for r in out["b"].collect()] == [("a[0]", "a[0].b[0]", "p")]
    assert [(r.pos, r.value) for r in out["tags"].collect()] == [(0, "t")]


SCAN = "id string, team_id string, created_at timestamp_ntz, received_at timestamp_ntz, findings_count int, critical_count int, day string"


def scans(spark, rows):
    d = dt.datetime(2025, 3, 1, 23, 59)
    return spark.createDataFrame([(i, t, None if a is None else d + dt.timedelta(days=a), d + dt.timedelta(days=a or 0, hours=r), f, c, "x") for i, t, a, r, f, c in rows], SCAN)


def totals(df):
    return {(r.entity, r.day.isoformat()): (r.findings_7d, r.critical_7d, r.findings_30d, r.critical_30d) for r in df.collect()}


def brute(rows):
    once = {}
    for i, t, a, r, f, c in sorted(rows, key=lambda x: x[3]):
        once.setdefault(i if i is not None else object(), (t, a, f or 0, c or 0))
    daily = defaultdict(lambda: [0, 0])
    for t, a, f, c in once.values():
        if t is not None and a is not None:
            daily[t, a][0] += f
            daily[t, a][1] += c
    out = {}
    for t in {k[0] for k in daily}:
        days = [k[1] for k in daily if k[0] == t]
        for d in range(min(days), max(days) + 1):
            s = [[sum(daily[t, x][j] for x in range(d - p + 1, d + 1) if (t, x) in daily) for j in (0, 1)] for p in (7, 30)]
            out[t, (dt.date(2025, 3, 1) + dt.timedelta(days=d)).isoformat()] = (*s[0], *s[1])
    return out


def test_rolling_nulls_ties_and_gaps(spark):
    rows = [("a", "t", 0, 0, 5, None), ("a", "t", 0, 3, 5, None), ("b", "t", 40, 0, None, 2), ("c", None, 1, 0, 9, 9), ("d", "t", None, 0, 9, 9), (None, "u", 1, 0, 1, 1), (None, "u", 1, 0, 1, 1)]
    got = totals(scan_state(scans(spark, rows)))
    assert got == brute(rows)
    assert len(got) == 42
    assert scan_state(scans(spark, [])).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 3), st.integers(0, 9)), min_size=1, max_size=25), st.integers(0, 60))
def test_rolling_versions_equal_one_load(spark, rows, cut):
    full = [(str(n), f"t{t % 2}", a, 0, f, t) for n, (a, t, f) in enumerate(rows)]
    early, late = [r for r in full if r[2] <= cut], [r for r in full if r[2] > cut]
    late, early = late + early[::3], [r for n, r in enumerate(early) if n % 3]  # a third of the early ones come late
    one = scan_state(scans(spark, early))
    both = scan_state(scans(spark, late), one)
    assert totals(both) == brute(full)


def test_rolling_redelivered_scans_count_once_across_batches(spark):
    day, later = dt.datetime(2025, 1, 5, 8), dt.datetime(2025, 1, 9, 8)
    schema = "id string, team_id string, created_at timestamp_ntz, received_at timestamp_ntz, findings_count int, critical_count int"
    early = [("1", "a", day, day, 5, 1), ("2", "b", day, day, 3, 0)]
    late = [("1", "a", day, later, 5, 1), ("3", "a", dt.datetime(2025, 1, 3, 8), later, 2, 2), ("2", "b", day, None, 3, 0), (None, "b", later, later, 1, 1)]
    whole = totals(scan_state(spark.createDataFrame(early + late, schema)))
    state = ScanTotals(spark, fresh_path(spark, "test-totals"))
    for batch in (early, late, early):
        state.load(spark.createDataFrame(batch, schema))
    assert state.version() == 3 and totals(state.totals()) == whole
    split = ScanTotals(spark, fresh_path(spark, "test-totals"))
    assert totals(load_by_last_day(spark.createDataFrame(early + late, schema), split)) == whole and split.version() == 2
    assert load_by_last_day(spark.createDataFrame([], schema), ScanTotals(spark, fresh_path(spark, "test-totals"))).count() == 0


def test_rolling_versions_write_only_what_changes(spark):
    schema = "id string, team_id string, created_at timestamp_ntz, received_at timestamp_ntz, findings_count int, critical_count int"

    def rows(*days):
        return [(f"{t}{d}", t, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), dt.datetime(2025, 1, 1), d % 7 + 1, 1) for t, d in days]

    state, so_far = ScanTotals(spark, fresh_path(spark, "test-totals")), []
    batches = [[("a", 3), ("a", 200), ("b", 90)], [("a", 201), ("b", 91)], [("b", 400), ("c", 250), ("a", 150)], [], [("a", 0)]]
    for n, days in enumerate(batches):
        new = rows(*days)
        so_far += new
        state.load(spark.createDataFrame(new, schema), f"batch {n}")
        if n < 2:
            state.load(spark.createDataFrame(new, schema), f"batch {n}")  # run again
        assert state.version() == n + 1
        assert totals(state.totals()) == totals(scan_state(spark.createDataFrame(so_far, schema)))
    one, two = state.manifest(1)["blocks"], state.manifest(2)["blocks"]
    kept = {b for b in one if one[b] == two[b]}
    assert kept and max(map(int, kept)) < (dt.date(2024, 1, 1) - dt.date(1970, 1, 1)).days // 32 + 3 and len(two) > len(kept)


def test_rolling_survives_a_lost_job(spark, monkeypatch):
    schema = "id string, team_id string, created_at timestamp_ntz, received_at timestamp_ntz, findings_count int, critical_count int"
    day = dt.datetime(2025, 1, 5, 8)
    batch = spark.createDataFrame([("1", "a", day, day, 5, 1)], schema)
    state = ScanTotals(spark, fresh_path(spark, "test-totals"))
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(ScanTotals, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        state.load(batch, "b")
    assert state.totals() is None
    state.load(batch, "b")
    assert [r.findings_7d for r in state.totals().collect()] == [5]


def test_workspace_leaves_nothing(spark):
    import os

    with workspace(spark) as path:
        assert materialise(spark.range(3), "test").count() == 3
        local = path.replace("file:", "")
        assert os.path.isdir(local)
    assert not os.path.exists(local)


def test_registered_totals_go_through_versions(spark, sf, monkeypatch):
    seen = []
    load = ScanTotals.load
    monkeypatch.setattr(ScanTotals, "load", lambda self, *rows: (seen.append(self), load(self, *rows))[1])
    registry.QUERIES["p6_found"](spark, sf)
    assert len(seen) == 2 and seen[0].version() == 2


def test_rolling_corrections_and_averages(spark):
    day = "entity string, day date, n bigint"
    first = advance(None, spark.createDataFrame([("a", dt.date(2025, 1, 1), 7), ("a", dt.date(2025, 1, 9), 7)], day), ["n"], [7])
    second = advance(first, spark.createDataFrame([("a", dt.date(2025, 1, 1), -7)], day), ["n"], [7])
    assert [r.n_7d for r in second.orderBy("day").collect()] == [0] * 8 + [7]
    assert averages(second, ["n"], [7]).where("day = '2025-01-09'").first().n_avg_7d == pytest.approx(1.0)
