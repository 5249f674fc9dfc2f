import random

import pytest

from sheafline.operators import planning
from sheafline.operators.items import COSTS, WORK

METHODS = dict(WORK.values())


def rows(seed, n, acyclic=True):
    r = random.Random(seed)
    out = []
    for p in range(1, n + 1):
        kind = r.choice(list(METHODS))
        deps = sorted({r.randrange(1, p) for _ in range(r.randrange(3))} if p > 1 else set())
        if not acyclic and r.random() < 0.2:
            deps.append(r.randint(1, n + 1))
        tried = [m for m in METHODS[kind] if r.random() < 0.15]
        left = [m for m in METHODS[kind] if m not in tried]
        best = min(({"cost": COSTS[m], "method": m} for m in left), key=lambda b: (b["cost"], b["method"]), default=None)
        out.append({"pos": p, "deps": deps, "selected": r.random() < 0.3, "satisfied": False, "lifecycle": r.choice(["queued", "processing"]), "best": best, "methods": METHODS[kind], "tried": tried})
    for x in out:
        x["lifecycle"] = out[0]["lifecycle"]
    return out


def closed(rs):
    want = {r["pos"] for r in rs if r["selected"]} or {r["pos"] for r in rs if not r["satisfied"]}
    while True:
        more = want | {d for r in rs if r["pos"] in want for d in r["deps"] if d <= len(rs)}
        if more == want:
            return sorted(want)
        want = more


def reaches(rs):
    """Positions that reach themselves, by matrix closure."""
    n = len(rs)
    hop = {r["pos"]: {d for d in r["deps"] if d <= n} for r in rs}
    far = {p: set(ds) for p, ds in hop.items()}
    for _ in range(n):
        far = {p: ds | {e for d in ds for e in hop[d]} for p, ds in far.items()}
    return sorted(p for p, ds in far.items() if p in ds)


@pytest.mark.parametrize("seed", range(60))
def test_closure_and_cycles(seed):
    rs = rows(seed, 1 + seed % 13, acyclic=False)
    assert planning.closure_of(rs) == closed(rs)
    assert planning.on_cycles(rs) == reaches(rs)


@pytest.mark.parametrize("seed", range(60))
def test_plan_takes_the_first_ready_step(seed):
    rs = rows(seed, 1 + seed % 17)
    want = closed(rs)
    by = {r["pos"]: r for r in rs}
    steps = planning.plan(rs)
    if any(by[p]["best"] is None for p in want):
        assert steps[0]["action"] == "no-method"
        return
    done, order = set(), []
    while len(done) < len(want):
        p = min(p for p in want if p not in done and set(by[p]["deps"]) <= done)
        done.add(p)
        order.append(p)
    assert [s["pos"] for s in steps if s["pos"]] == order
    assert [s["step"] for s in steps] == list(range(len(steps)))
    assert steps[-1]["action"] == "complete-job" and (steps[0]["action"] == "start-job") == (rs[0]["lifecycle"] == "queued")
    ready = [{**r, "wanted": r["pos"] in want} for r in rs]
    assert planning.execute(ready, steps) == {"status": "completed", "failed_step": None, "reason": None, "succeeded": len(order), "artifacts": len({by[p]["best"]["method"] for p in order})}
    assert planning.execute(ready, steps, frozenset(COSTS), dry=True)["status"] == "dry-run-completed"


def job(**changes):
    base = {"pos": 1, "deps": [], "selected": True, "satisfied": False, "lifecycle": "queued", "wanted": True, "methods": ["a", "b"], "tried": []}
    return [{**base, **changes}]


START, RUN, END = {"step": 0, "action": "start-job", "pos": None, "method": None}, {"step": 1, "action": "execute-obligation", "pos": 1, "method": "a"}, {"step": 2, "action": "complete-job", "pos": None, "method": None}


@pytest.mark.parametrize(
    ("obligation", "steps", "fails", "status", "reason", "step"),
    [
        (job(), [START, RUN, END], (), "completed", None, None),
        (job(), [START, RUN, END], ("a",), "replan-required", "failed", 1),
        (job(tried=["b"]), [START, RUN, END], ("a",), "failed", "failed", 1),
        (job(tried=["a"]), [START, RUN, END], (), "failed", "tried", 1),
        (job(methods=["b"]), [START, RUN, END], (), "failed", "inadmissible", 1),
        (job(satisfied=True), [START, RUN, END], (), "failed", "already", 1),
        (job(wanted=False), [START, RUN, END], (), "failed", "unselected", 1),
        (job(deps=[2]), [START, RUN, END], (), "failed", "dependency", 1),
        (job(), [RUN, END], (), "failed", "not-processing", 1),
        (job(lifecycle="processing"), [START, RUN, END], (), "failed", "start-state", 0),
        (job(), [START, END], (), "failed", "incomplete", 2),
        (job(), [START, {**RUN, "pos": 7}, END], (), "failed", "unknown", 1),
    ],
)
def test_execution_rules(obligation, steps, fails, status, reason, step):
    got = planning.execute(obligation, steps, frozenset(fails))
    assert (got["status"], got["reason"], got["failed_step"]) == (status, reason, step)


def test_cycle_has_no_plan():
    two = [{"pos": p, "deps": [3 - p], "selected": True, "satisfied": False, "lifecycle": "queued", "best": {"cost": 1, "method": "a"}} for p in (1, 2)]
    assert planning.plan(two)[0]["action"] == "no-order"
    two[0].update(satisfied=True)
    assert planning.plan(two)[0]["action"] == "inconsistent"
