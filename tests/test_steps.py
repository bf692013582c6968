"""Step-log rules against a plain replay of the log, with one session holding most rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from mendframe import constants as K
from mendframe.functions import parsing as P
from mendframe.operators import replay
from mendframe.operators import steps as L
from mendframe.operators.scan import Running, as_of, count, moving_average, range_chunks, scan, step_chunk, top_rows

ACTIONS = ["query_cleaner", "query_analyst", "apply", "rollback", "apply"]


def make_log(seed, sessions=6, hot=120):
    rng = random.Random(seed)
    rows, recs = [], []
    for s in range(sessions):
        issued = []
        acc = 0.5
        for step in range(1, (hot if s == 0 else rng.randint(1, 25)) + 1):
            action = rng.choice(ACTIONS) if rng.random() < 0.8 else "query_cleaner"
            n = rng.randint(0, 3) if action.startswith("query") else 0
            rec = None
            if action == "apply":
                rec = rng.choice([None, "bogus", *issued[-3:]])
            new = round(rng.random(), 3) if action == "apply" else acc
            cost = {"query_cleaner": 1, "query_analyst": 2, "rollback": 1, "apply": 0}[action]
            rows.append((s, step, action, rec, cost, n, acc, new, 0.1, 0.1, 0.3, 0.3, 0.9))
            for j in range(n):
                recs.append((s, f"{s}_{step}_{j}", step, action[6:], j + 1))
                issued.append(f"{s}_{step}_{j}")
            acc = new
    return rows, recs


@pytest.fixture(scope="module", params=[1, 2])
def log(spark, request):
    rows, recs = make_log(request.param)
    steps = spark.createDataFrame(
        rows,
        "session_id bigint, step bigint, action string, rec_id string, cost int, n_recs int,"
        " accuracy_before double, accuracy_after double, missing_before double,"
        " missing_after double, balance_before double, balance_after double, target_accuracy double",
    )
    table = spark.createDataFrame(
        recs, "session_id bigint, rec_id string, step bigint, agent string, priority int"
    )
    return rows, recs, steps, table


COSTS = {"query_cleaner": 1, "query_augmenter": 1, "query_balancer": 1, "query_validator": 2, "query_analyst": 2}


def replay_rules(rows, recs, budget=12):
    """Step by step, with everything remembered: outcome, budget before and after, run, rule, end."""
    ids = {}
    for s, r, step, *_ in recs:
        ids.setdefault((s, step), []).append(r)
    out, state = {}, {}
    for s, step, action, rec, *rest in rows:
        st = state.setdefault(s, {"left": budget, "hist": [], "issued": [], "applied": [], "stack": [], "undone": 0, "done": False})
        left, rule, run = st["left"], None, 0
        reached = rest[3] is not None and rest[3] >= rest[8]
        if st["done"]:
            out[s, step] = ("after_end", left, left, 0, None, False)
            continue
        if action == "rollback":
            if st["undone"] == 3 or not st["stack"]:
                out[s, step] = ("refused", left, left, 0, None, False)
                continue
            st["stack"].pop()
            st["undone"] += 1
            outcome, cost = "undone", 1
        else:
            st["hist"].append(action)
            for a in reversed(st["hist"]):
                if a != action:
                    break
                run += 1
            if len(st["hist"]) >= 3 and len(set(st["hist"][-3:])) == 1 and action != "apply":
                rule = "action_spam"
            elif action in ("query_validator", "query_analyst") and left < 3:
                rule = "low_budget_expensive_query"
            elif action == "apply" and not rec:
                rule = "missing_rec_id"
            elif action == "apply" and rec in st["applied"]:
                rule = "duplicate_apply"
            elif action == "apply" and rec not in st["issued"]:
                rule = "invalid_rec_id"
            outcome, cost = ("blocked", 1) if rule else ("executed", COSTS.get(action, 0))
            if outcome == "executed" and action == "apply":
                st["applied"].append(rec)
                st["stack"] = [*st["stack"], 1][-3:]
            elif outcome == "executed":
                st["issued"] += ids.get((s, step), [])
        st["left"] = max(0, left - cost)
        st["done"] = st["left"] <= 0 or (outcome == "executed" and action == "apply" and reached)
        out[s, step] = (outcome, left, st["left"], run, rule, st["done"])
    return out


def told(df):
    names = ("outcome", "budget_before", "budget_remaining", "streak", "rule", "ends_session")
    return {(r["session_id"], r["step"]): tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize("budget", [12, 40, 300])
def test_rule_audit_matches_a_replay(log, budget):
    rows, recs, steps, table = log
    assert told(L.rule_audit(steps.repartition(5), table, budget)) == replay_rules(rows, recs, budget)


STEPS = (
    "session_id bigint, step bigint, action string, rec_id string, cost int, n_recs int,"
    " accuracy_before double, accuracy_after double, missing_before double,"
    " missing_after double, balance_before double, balance_after double, target_accuracy double"
)
RECS = "session_id bigint, rec_id string, step bigint, agent string, priority int"


def session(spark, actions, recs=()):
    """One session of (action, rec_id, accuracy_after), with recommendations (rec_id, step)."""
    rows = [(1, i + 1, a, r, 0, 0, 0.5, acc, 0.1, 0.1, 0.3, 0.3, 0.9) for i, (a, r, acc) in enumerate(actions)]
    table = [(1, r, step, "cleaner", 1) for r, step in recs]
    return spark.createDataFrame(rows, STEPS), spark.createDataFrame(table, RECS)


def test_blocked_queries_hand_nothing_out(spark):
    steps, recs = session(
        spark, [("query_cleaner", None, 0.5)] * 3 + [("apply", "x", 0.6)], [("w", 1), ("x", 3)]
    )
    audited = L.rule_audit(steps, recs)
    got = told(audited)
    assert [got[1, i][0] for i in range(1, 5)] == ["executed", "executed", "blocked", "blocked"]
    assert got[1, 3][4] == "action_spam" and got[1, 4][4] == "invalid_rec_id"
    assert [got[1, i][2] for i in range(1, 5)] == [11, 10, 9, 8]  # a blocked step costs 1, whatever it is
    assert [r["rec_id"] for r in L.pending_recs(audited, recs).collect()] == ["w"]


def test_blocked_and_refused_steps_have_their_own_price(spark):
    steps, recs = session(
        spark,
        [("query_validator", None, 0.5)] * 3 + [("rollback", None, 0.5)] * 30 + [("apply", None, 0.5), ("query_cleaner", None, 0.5)],
    )
    got = told(L.rule_audit(steps, recs))
    assert [got[1, i][2] for i in (1, 2, 3)] == [10, 8, 7]
    assert {got[1, i][:3] for i in range(4, 34)} == {("refused", 7, 7)}
    assert got[1, 34][:3] == ("blocked", 7, 6) and got[1, 35][:3] == ("executed", 6, 5)


def test_nothing_counts_after_the_end(spark):
    steps, recs = session(
        spark,
        [("query_cleaner", None, 0.5), ("apply", "a", 0.95), ("query_analyst", None, 0.95), ("apply", "b", 0.2), ("rollback", None, 0.5)],
        [("a", 1), ("b", 1)],
    )
    audited = L.rule_audit(steps, recs)
    assert [told(audited)[1, i][0] for i in range(1, 6)] == ["executed", "executed", *["after_end"] * 3]
    scored = {r["step"]: (r["reward"], r["in_history"]) for r in L.score_steps(audited).collect()}
    assert all(scored[i] == (None, False) for i in (3, 4, 5)) and scored[2][1]
    row = L.episode_summary(L.score_steps(audited)).first()
    assert (row["n_steps"], row["n_rewards"], row["last_accuracy"], row["success"]) == (2, 2, 0.95, True)


def test_steps_after_the_end_are_not_walked(spark, monkeypatch):
    walked = replay._step

    def strict(s, x, streak):
        return F.when(s["done"], F.raise_error(F.lit("a step after the end was walked"))).otherwise(walked(s, x, streak))

    monkeypatch.setattr(replay, "_step", strict)
    kinds = ["query_cleaner", "query_augmenter"] * 2 + ["rollback"] * 2
    steps = spark.createDataFrame([(1, i + 1, a, None, 0.5, 0.9) for i, a in enumerate(kinds)], "session_id bigint, step bigint, action string, rec_id string, accuracy_after double, target_accuracy double")
    recs = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 1, 2)], "session_id bigint, rec_id string, step bigint, priority int")
    found = L.rule_audit(steps, recs, budget=2).orderBy("step").collect()
    assert [r["outcome"] for r in found] == ["executed"] * 2 + ["after_end"] * 4
    assert [r["budget_before"] for r in found] == [2, 1, 0, 0, 0, 0]
    assert [(r["rule"], r["charged"], r["budget_remaining"], r["streak"], r["ends_session"]) for r in found[2:]] == [(None, 0, 0, 0, False)] * 4


def test_as_of_reads_its_tables_once(spark):
    met = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def seen(step):
        met.add(1)
        return step

    steps = spark.range(40).select((F.col("id") % 4).alias("session_id"), F.floor(F.col("id") / 4).alias("at"))
    left = steps.select("session_id", seen("at").alias("step"))
    right = steps.where("at % 3 = 1").select("session_id", F.col("at").alias("step"), (F.col("at") * 10).alias("told"))
    found = as_of(left, right, ["session_id"], "step", ["told"], rows=7).collect()
    assert met.value == 40
    assert sorted(map(tuple, found)) == sorted((s, t, None if t < 1 else (t - 1) // 3 * 30 + 10) for s in range(4) for t in range(10))


def test_a_blocked_apply_uses_nothing_up(spark):
    steps, recs = session(
        spark, [("apply", "a", 0.6), ("query_cleaner", None, 0.6), ("rollback", None, 0.6)], [("a", 2)]
    )
    audited = L.rule_audit(steps, recs)
    assert [told(audited)[1, i][0] for i in (1, 2, 3)] == ["blocked", "executed", "refused"]
    assert [r["rec_id"] for r in L.pending_recs(audited, recs).collect()] == ["a"]
    state = L.session_state(audited).first()
    assert (state["accuracy_after"], state["budget_remaining"], state["asked_cleaner"]) == (0.5, 10, True)


def replay_rollbacks(rows):
    state = {}
    for s, step, action, *_ in rows:
        st = state.setdefault(s, {"n": 0, "cur": 0, "stack": [], "done": 0, "refused": 0})
        if action == "apply":
            st["stack"] = [*st["stack"], st["cur"]][-3:]
            st["n"] += 1
            st["cur"] = st["n"]
        elif action == "rollback":
            if st["done"] < 3 and st["stack"]:
                st["cur"] = st["stack"].pop()
                st["done"] += 1
            else:
                st["refused"] += 1
    return {s: (st["n"], st["done"], st["refused"], st["cur"]) for s, st in state.items()}


def test_rollback_state_matches_a_replay(log):
    rows, _, steps, _ = log
    got = {
        r["session_id"]: (r["n_applies"], r["n_restored"], r["n_refused"], r["current_version"])
        for r in L.rollback_state(steps).collect()
    }
    assert got == replay_rollbacks(rows)


def test_rollbacks_that_drain_the_stack(spark):
    sessions = {
        1: ["rollback", "apply", "rollback", "rollback", "apply", "rollback", "apply", "rollback", "rollback"],
        2: ["apply"] * 5 + ["rollback"] * 5,
        3: ["apply", "apply", "rollback", "apply", "rollback", "rollback", "apply"],
        4: ["query_cleaner"],
        5: ["apply", "apply", "apply", "rollback", "rollback", "apply", "rollback"],
    }
    rows = [(s, i + 1, a) for s, actions in sessions.items() for i, a in enumerate(actions)]
    df = spark.createDataFrame(rows, "session_id bigint, step bigint, action string")
    got = {
        r["session_id"]: (r["n_applies"], r["n_restored"], r["n_refused"], r["current_version"])
        for r in L.rollback_state(df).collect()
    }
    assert got == replay_rollbacks(rows)


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_scans_do_not_depend_on_the_chunk(log, chunk):
    rows, _, steps, _ = log
    scanned = scan(
        steps.repartition(5),
        ["session_id"],
        ["step"],
        step_chunk(rows=chunk),
        total=Running("sum", F.col("cost"), through=False),
        top=Running("max", F.col("accuracy_after")),
        seen=Running("last", F.col("rec_id"), through=False),
        first=Running("first", F.col("rec_id")),
        run=Running("run", F.when(F.col("action") != "rollback", F.col("action"))),
    )
    got = {
        (r["session_id"], r["step"]): (r["total"], r["top"], r["seen"], r["first"], r["run"])
        for r in scanned.collect()
    }
    state, want = {}, {}
    for s, step, action, rec, cost, _, _, after, *_ in rows:
        st = state.setdefault(s, {"total": 0, "top": after, "seen": None, "first": None, "last": None, "run": 0})
        st["top"] = max(st["top"], after)
        st["first"] = st["first"] or rec
        run = 0
        if action != "rollback":
            st["run"] = run = st["run"] + 1 if action == st["last"] else 1
            st["last"] = action
        want[s, step] = (st["total"], st["top"], st["seen"], st["first"], run)
        st["total"] += cost
        st["seen"] = rec or st["seen"]
    assert got == want


def test_done_after_budget_or_target(spark):
    """A query that meets the target does not end a session; an apply that does, or no budget, ends it."""
    steps, recs = session(
        spark, [("query_cleaner", None, 0.99), ("apply", "a", 0.95), ("query_cleaner", None, 0.2)], [("a", 1)]
    )
    flags = {r["step"]: (r["ends_session"], r["after_end"]) for r in L.done_flags(L.rule_audit(steps, recs)).collect()}
    assert flags == {1: (False, False), 2: (True, False), 3: (False, True)}
    spent = L.done_flags(L.rule_audit(steps, recs, budget=1))
    assert {r["step"]: (r["ends_session"], r["after_end"]) for r in spent.collect()} == {
        1: (True, False), 2: (False, True), 3: (False, True),
    }


def test_reward_by_hand(spark):
    """One query and one apply, worked by hand from the weights."""
    rows = [
        (1, 1, "query_cleaner", None, 2, 11, 0.6, 0.6, 0.1, 0.1, 0.3, 0.3),
        (1, 2, "apply", "r", 0, 11, 0.6, 0.7, 0.1, 0.0, 0.3, 0.3),
        (1, 3, "apply", "r", 0, 2, 0.7, 0.7, 0.1, 0.1, 0.3, 0.3),
        (1, 4, "rollback", None, 0, 2, 0.7, 0.6, 0.1, 0.1, 0.3, 0.3),
    ]
    df = spark.createDataFrame(
        rows,
        "session_id bigint, step bigint, action string, rec_id string, n_recs int,"
        " budget_remaining bigint, accuracy_before double, accuracy_after double,"
        " missing_before double, missing_after double, balance_before double, balance_after double",
    ).withColumns(
        {"target_accuracy": F.lit(0.8), "outcome": F.when(F.col("action") == "rollback", "undone").otherwise("executed")}
    )
    got = {r["step"]: r["reward"] for r in L.score_steps(df).collect()}
    query = 0.15 * 0.999 + 0.35 * 0.55 + 0.2 * 0.45 + 0.15 * (0.5 + 11 / 12 * 0.3) + 0.15 * 0.35
    apply = (
        0.15 * 0.999 + 0.35 * (0.5 + 0.5 * 0.49) + 0.2 * 0.6 + 0.15 * (0.5 + 11 / 12 * 0.49)
        + 0.15 * (0.5 + 0.7 / 0.8 * 0.4)
    )
    idle = 0.15 * 0.999 + 0.35 * 0.5 + 0.2 * 0.5 + 0.15 * 0.1 + 0.15 * 0.1
    assert got[1] == round(query, 4) and got[2] == round(apply, 4) and got[3] == round(idle, 4)
    assert got[4] == K.ROLLBACK_REWARD
    assert L.reward_range_violations(L.score_steps(df)).first()["n_violations"] == 0


def test_next_action_follows_the_plan(spark):
    rows = [
        (1, 1, "rollback", 12, 0.2, 0.4), (2, 1, "query_analyst", 10, 0.2, 0.4),
        (3, 1, "query_analyst", 10, 0.01, 0.4), (4, 1, "query_analyst", 10, 0.01, 0.5),
        (5, 1, "query_cleaner", 10, 0.2, 0.5), (6, 1, "query_augmenter", 0, 0.2, 0.2),
    ]
    df = spark.createDataFrame(
        rows,
        "session_id bigint, step bigint, action string, budget_remaining bigint, missing_after double,"
        " balance_after double",
    ).withColumns(
        {
            "rec_id": F.lit(None).cast("string"), "outcome": F.lit("executed"), "target_accuracy": F.lit(0.9),
            "accuracy_before": F.lit(0.5), "accuracy_after": F.lit(0.5),
            "missing_before": F.col("missing_after"), "balance_before": F.col("balance_after"),
        }
    )
    recs = spark.createDataFrame(
        [(5, "b", 1, "cleaner", 2), (5, "a", 1, "cleaner", 1)],
        "session_id bigint, rec_id string, step bigint, agent string, priority int",
    )
    got = {r["session_id"]: (r["next_action"], r["rec_id"]) for r in L.next_action(df, recs).collect()}
    assert got == {
        1: ("query_analyst", None), 2: ("query_cleaner", None), 3: ("query_balancer", None),
        4: ("query_augmenter", None), 5: ("apply", "a"), 6: ("stop", None),
    }


def test_top_rows_and_moving_average(spark):
    df = spark.range(50).select(F.lit(1).alias("session_id"), F.col("id").alias("step"), (F.col("id") % 7).alias("v"))
    last = top_rows(df, ["session_id"], [F.col("step").desc()], 5, step_chunk(rows=4))
    assert sorted(r["step"] for r in last.collect()) == [45, 46, 47, 48, 49]
    got = {r["step"]: r["moving_avg"] for r in moving_average(df, "step", "v", 5, chunk_rows=8).collect()}
    assert sorted(got) == list(range(4, 50))
    assert all(got[i] == pytest.approx(sum((j % 7) for j in range(i - 4, i + 1)) / 5) for i in got)


@pytest.mark.parametrize("chunk", [1, 2, 100])
def test_moving_average_over_gaps(spark, chunk):
    places = [2, 3, 4, 5, 6, 7, 9, 30, -4]
    df = spark.createDataFrame([(p, float(p)) for p in places], "at bigint, v double").repartition(3)
    got = {r["at"]: r["moving_avg"] for r in moving_average(df, "at", "v", 5, chunk_rows=chunk).collect()}
    ordered = sorted(places)
    assert got == {p: pytest.approx(sum(ordered[i - 4 : i + 1]) / 5) for i, p in enumerate(ordered) if i >= 4}


def test_rejects(spark):
    df = spark.createDataFrame(
        [("apply", 1, "easy"), ("fly", None, None), (None, None, None), ("rollback", 4, None), ("apply", 0, "odd")],
        "action string, target_class int, difficulty string",
    )
    valid, rejected = L.split_valid(df)
    assert valid.count() == 1
    assert sorted(r["reject_reason"] for r in rejected.collect()) == [
        "target_class must be 0 or 1", "unknown action", "unknown action", "unknown difficulty",
    ]


def test_parsing_of_responses(spark):
    texts = [
        '{"action": "apply", "rec_id": "x"}', " {\"action\": \"query_cleaner\"} ", "some words",
        '{"agent": "cleaner"}', 'see {"agent":\n "balancer"} ok', '[1, 2]', '"action"', '{"a": {"agent": "x"}}',
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", P.strict_action(F.col("t")).alias("s"), P.lenient_agent(F.col("t")).alias("l")).orderBy("i").collect()
    assert [r["s"] for r in rows] == [
        "apply", "query_cleaner", *["query_analyst"] * 6,
    ]
    assert [r["l"] for r in rows] == [
        "__invalid__", "__invalid__", "__invalid__", "cleaner", "balancer", "__invalid__", "__invalid__", "__invalid__",
    ]


@pytest.mark.parametrize("rows", [7, 50, 10_000])
def test_ranges_cut_a_busy_session(spark, rows):
    """One session with nine rows of ten, all in one day, in ranges of bounded size."""
    made = [(0 if i % 10 else i, i // 3, i) for i in range(600)]  # several events at one time
    df = spark.createDataFrame(made, "session_id bigint, ts bigint, event_id bigint").repartition(4)
    ranged = range_chunks(df, ["session_id", "ts", "event_id"], rows)
    sizes = [r["count"] for r in ranged.groupBy("_part").count().collect()]
    assert len(sizes) == -(-600 // rows) or max(sizes) <= 3 * rows
    steps = scan(ranged, ["session_id"], ["ts", "event_id"], F.col("_part"), step=count())
    got = {r["event_id"]: r["step"] for r in steps.collect()}
    want, seen = {}, {}
    for s, _, e in sorted(made):
        want[e] = seen[s] = seen.get(s, 0) + 1
    assert got == want
