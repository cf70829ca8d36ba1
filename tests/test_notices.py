import random
from datetime import datetime

import pytest

from fixturelake.operators import notices
from fixturelake.plans import lifecycle

NOW = datetime(2025, 11, 1, 12)
CREWS = ["referees", "table_officials", "medics", "statisticians", "observers", "commissioners"]
FIELDS = ["match_name", "date_text", "time_text", "venue", "league_type", "category", "sub_category", *CREWS]
STATE = "struct<" + ",".join(f"{f}:{'array<string>' if f in CREWS else 'string'}" for f in FIELDS) + ">"


def state(**k):
    base = {"match_name": "A - B", "date_text": "07.09.2099", "time_text": "16:00", "venue": "Hall"} | k
    return tuple(base.get(f) for f in FIELDS)


def events(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"user_id long, event_id long, content_key string, {extra}state {STATE}")


def plan(spark, assigned=(), cancelled=(), shifted=(), waiting=()):
    out = lifecycle.plan_notices(events(spark, list(assigned)), events(spark, list(cancelled)), events(spark, list(shifted), f"old {STATE}, "), events(spark, list(waiting)), NOW)
    return sorted((r.user_id, r.kind, tuple(r.lines)) for r in out["planned"].collect()), sorted(r.event_id for r in out["consumed"].collect())


OLD, NEW = state(referees=["ALİ", "CAN"], observers=["G1"]), state(referees=["DENİZ", "CAN"], observers=["G1"])
TOLD = ("🔁 Baş Hakem: ALİ yerine DENİZ geldi",)


def test_who_stays_is_told_of_a_replacement(spark):
    got, _ = plan(spark, [(3, 1, "ck1", NEW)], [(1, 1, "ck1", OLD)], [(2, 1, "ck1", OLD, NEW), (4, 2, "ck1", OLD, NEW)])
    assert got == [(1, "CANCELLED", ()), (2, "UPDATED", TOLD), (3, "ASSIGNED", ()), (4, "UPDATED", TOLD)]


def test_a_first_filling_tells_only_who_is_new(spark):
    old, new = state(referees=["ALİ", "CAN"]), state(referees=["ALİ", "CAN"], observers=["G1"])
    assert plan(spark, [(9, 1, "ck1", new)], [], [(1, 1, "ck1", old, new)])[0] == [(9, "ASSIGNED", ())]


def test_nothing_changed_tells_nobody(spark):
    assert plan(spark, [(5, 1, "ck1", OLD)], [(5, 1, "ck1", OLD)])[0] == []


def test_a_kept_assignment_uses_up_its_new_one(spark):
    assert plan(spark, [(2, 7, "ck1", NEW)], [], [(2, 1, "ck1", OLD, NEW)])[0] == [(2, "UPDATED", TOLD)]


def test_pairs_by_fixture_by_day_and_with_waiting_ones(spark):
    moved, other = state(date_text="08.09.2099"), state(match_name="C - D")
    got, used = plan(
        spark, [(1, 1, "k2", moved), (2, 2, "k3", other), (3, 3, "k4", moved), (4, 4, "k9", state(match_name="Q - R", date_text="01.01.2098"))], [(1, 1, "k1", OLD), (2, 2, "k1", OLD)], [], [(3, 50, "k1", OLD), (4, 51, "k1", OLD), (6, 52, "k1", OLD)],
    )
    assert [(u, k) for u, k, _ in got] == [(1, "UPDATED"), (2, "CHANGED"), (3, "UPDATED"), (4, "ASSIGNED")] and used == [50]


def test_begun_fixtures_and_empty_runs_tell_nobody(spark):
    past = state(date_text="01.10.2025")
    assert plan(spark, [(1, 1, "k", past)], [(2, 1, "k", past)], [(3, 1, "k", past, past)]) == ([], [])
    assert plan(spark) == ([], [])


def brute(rows):
    out = []
    for u in {r[0] for r in rows}:
        free = sorted((r for r in rows if r[0] == u and r[1] == "assign"), key=lambda r: r[2])
        for c in sorted((r for r in rows if r[0] == u and r[1] == "cancel"), key=lambda r: (r[6], r[2])):
            near = [a for a in free if c[3] is not None and a[3] == c[3] or c[4] is not None and a[4] == c[4]]
            day = [a for a in free if c[5] is not None and a[5] == c[5]]
            if near or day:
                a = (near or day)[0]
                free.remove(a)
                out.append((u, "UPDATED" if near else "CHANGED", a[2], c[2]))
            elif not c[6]:
                out.append((u, "CANCELLED", c[2], None))
        out += [(u, "ASSIGNED", a[2], None) for a in free]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_pairing_against_brute_force(spark, seed):
    r = random.Random(seed)
    pick = lambda *x: r.choice([*x, None])
    rows = [(r.choice([1, 1, 1, 2, 3]), r.choice(["assign", "cancel"]), i, pick("k1", "k2", "k3"), pick("f1", "f2"), pick("d1", "d2"), r.random() < 0.2) for i in range(300)]
    df = spark.createDataFrame(rows, "user_id long, side string, event_id long, content_key string, fixture string, day string, queued boolean").repartition(5)
    got = [(x.user_id, x.kind, x.event_id, x.other_id) for x in notices.pair_events(df).collect()]
    assert sorted(got, key=repr) == brute([(*x[:6], x[6] and x[1] == "cancel") for x in rows])


QUEUE = f"id long, user_id long, kind string, content_key string, old_content_key string, state {STATE}, old {STATE}, status string, due_at timestamp_ntz, attempt int, drop_reason string"
T0 = datetime(2025, 11, 1)
ROWS = "id long, content_key string, cancelled_at timestamp_ntz, " + ", ".join(f"{f} {'array<string>' if f in CREWS else 'string'}" for f in FIELDS)


def test_a_run_is_queued_and_flushed(spark):
    wait = [(1, 3, "CANCELLED", "k1", None, OLD, None, "PENDING", T0, 0, None), (2, 8, "UPDATED", "ck1", None, NEW, OLD, "PENDING", T0, 0, None), (3, 9, "UPDATED", "ck1", None, NEW, NEW, "PENDING", T0, 0, None), (4, 7, "CANCELLED", "k7", None, OLD, None, "PENDING", T0, 5, None),
            (5, 6, "CHANGED", "k6", "k5", NEW, OLD, "PENDING", T0, 0, None), (6, 1, "CANCELLED", "ck1", None, OLD, None, "PENDING", T0, 0, None)]
    queue = spark.createDataFrame(wait, QUEUE)
    run = {"assigned": events(spark, [(3, 1, "k2", state(date_text="08.09.2099")), (5, 2, "ck1", NEW)]), "cancelled": events(spark, [(1, 1, "ck1", OLD)]), "shifted": events(spark, [(2, 1, "ck1", OLD, NEW)], f"old {STATE}, ")}
    out = lifecycle.reconcile(run, queue, NOW)
    assert [(r.user_id, r.content_key) for r in out["immediate"].collect()] == [(5, "ck1")]
    got = {r.id: (r.user_id, r.kind, r.status) for r in out["queue"].collect()}
    assert got[1] == (3, "CANCELLED", "DROPPED") and sorted(v for k, v in got.items() if k > 6) == [(2, "UPDATED", "PENDING"), (3, "UPDATED", "PENDING")]
    assert lifecycle.reconcile(run, queue, NOW, bootstrap=True)["queue"].count() == 6
    rows = spark.createDataFrame([(1, "ck1", None, *NEW), (2, "k9", None, *OLD)], ROWS)
    on = spark.createDataFrame([(8, 1), (9, 1), (1, 1)], "user_id long, match_id long")
    flushed = lifecycle.flush(queue, on, rows, NOW)
    done = {r.id: (r.action, r.send_as, tuple(r.lines)) for r in flushed.collect()}
    # a replaced referee is told, though day, time and hall are the same; the same state twice is not; who is back isn't cancelled; a lost change cancels the old fixture
    assert done == {1: ("send", "CANCELLED", ()), 2: ("send", "UPDATED", TOLD), 3: ("drop", None, ()), 4: ("send", "CANCELLED", ()), 5: ("send", "CANCELLED", ()), 6: ("drop", None, ())}
    assert {r.id: r.content_key for r in flushed.collect()}[5] == "k5"
    results = spark.createDataFrame([(1, 3, False, "messaging/quota-exceeded"), (2, 8, True, None), (4, 7, False, None), (5, 6, False, "x")], "id long, user_id long, success boolean, code string")
    end = {r.id: (r.status, r.attempt, r.due_at.minute, r.drop_reason is not None) for r in lifecycle.settle(queue, flushed, results, NOW).collect()}
    assert end == {1: ("PENDING", 1, 1, False), 2: ("SENT", 1, 0, False), 3: ("DROPPED", 0, 0, True), 4: ("FAILED", 6, 0, True), 5: ("SENT", 1, 0, False), 6: ("DROPPED", 0, 0, True)}
