"""Mixing by the cube method, conversation repair and hard-negative mining."""
import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from termflow.llm import hard_negatives, source_mix, turn_repair

DOCS = "doc_id long, text string, source string, taken string, block string"


def plain_targets(sizes, weights, repeats):
    """Targets by sharing the excess again and again; sources in the order given."""
    whole, full = sum(sizes), set()
    while True:
        rest = whole - sum(repeats * sizes[i] for i in full)
        shared = sum(weights[i % len(weights)] for i in range(len(sizes)) if i not in full)
        out = [repeats * s if i in full else rest * weights[i % len(weights)] / shared for i, s in enumerate(sizes)]
        more = {i for i, s in enumerate(sizes) if i not in full and out[i] > repeats * s}
        if not more:
            return out
        full |= more


def test_flight_keeps_both_totals():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(0, 60)
        p = [rng.choice([rng.random(), 0.0, 1.0, 0.5]) for _ in range(n)]
        sizes = sorted((rng.choice([0, 1, 5, 5, rng.randrange(1, 10 ** rng.randrange(1, 6))]) for _ in range(n)), reverse=True)
        out = source_mix.flight(p, sizes, rng.random, False)
        assert sum(0 < x < 1 for x in out) <= 2
        assert math.isclose(sum(out), sum(p), abs_tol=1e-6)
        assert math.isclose(sum(a * s for a, s in zip(out, sizes)), sum(a * s for a, s in zip(p, sizes)), rel_tol=1e-6, abs_tol=1e-3)
        landed = source_mix.flight(p, sizes, rng.random, True)
        assert all(x in (0.0, 1.0) for x in landed)
        assert abs(sum(a * s for a, s in zip(landed, sizes)) - sum(a * s for a, s in zip(p, sizes))) <= max(sizes, default=0) + 1e-3


def test_flight_keeps_fractions():
    p, sizes = [0.2, 0.7, 0.5, 0.9, 0.4, 0.3], [90, 40, 40, 7, 3, 0]
    draw = np.random.default_rng(5).random
    mean = np.mean([source_mix.flight(p, sizes, draw, True) for _ in range(6000)], axis=0)
    assert np.abs(mean - p).max() < 0.03


def mixed(spark, rows, **kw):
    out = source_mix.mix(spark.createDataFrame(rows, DOCS), **kw)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"]
    return out.collect()


def test_mix_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "BLOCK", 20)
    rng = random.Random(1)
    names = ["b", "a", None, "", "\U0001F600", "￮", "tiny"]
    rows = [(i, "w " * rng.randrange(0, 80), names[min(6, int(rng.expovariate(0.9)))], "x", "y") for i in range(3000)]
    rows += [(9000 + i, "one two three", "hot", None, None) for i in range(2500)]
    rows += [(None, "same words here", "hot", None, None)] * 300 + [(7, "again", "a", None, None)] * 50
    rows += [(9999, None, "none", None, None), (9998, " \t\x0b", "none", None, None)]
    got = mixed(spark, rows)
    assert len(got) == len(rows)
    order = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    want = dict(zip(order, plain_targets([sizes[s] for s in order], source_mix.WEIGHTS, 3)))
    assert math.isclose(sum(want.values()), sum(sizes.values()))
    of = {s: name for name, s in sizes.items()}
    assert len(of) == len(sizes)
    taken = Counter()
    for r in got:
        assert math.isclose(r.target, want[of[r.source_size]], rel_tol=1e-12) and 0 <= r.taken <= 3 * r["size"]
        assert r.taken % max(1, r["size"]) == 0
        taken[of[r.source_size]] += r.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= 80
    again = mixed(spark, random.Random(2).sample(rows, len(rows)))
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_targets_of_very_large_sources(spark):
    sizes = [10 ** 15, 4, 10 ** 9, 3 * 10 ** 14, 0] * 12
    rows = spark.createDataFrame([(False, f"s{i:03d}", n) for i, n in enumerate(sizes)], "missing boolean, source string, source_size long")
    got = [r.target for r in source_mix.targets(rows, (5 * 10 ** 4, 2, 1)).orderBy("source").collect()]
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(got, plain_targets(sizes, (5 * 10 ** 4, 2, 1), 3), strict=True))


def test_mix_edges(spark):
    assert mixed(spark, []) == []
    assert [tuple(r) for r in mixed(spark, [(1, None, None, None, None)])] == [(1, 0, 0, 0.0, 0)]
    assert [tuple(r) for r in mixed(spark, [(1, "a b", "s", None, None)])] == [(1, 2, 2, 2.0, 2)]
    # The first source may be taken three times only; the other one gets the rest.
    got = {tuple(r)[0]: r for r in mixed(spark, [(1, "a", "a", None, None), (2, "b " * 99, "b", None, None)])}
    assert (got[1].target, got[1].taken, got[2].target) == (3.0, 3, 97.0)


def plain_repair(rows):
    """(cost, audit, edits) over all sequences of edits with at most two inserted turns in a row."""
    best = None

    def go(i, state, cost, audit, made, inserted):
        nonlocal best
        if cost > (best[0] if best else 3 * len(rows) + 4):
            return
        if i == len(rows):
            if state in ("", "a") and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, made)
        else:
            role, text, must_go, cut = rows[i]
            go(i + 1, state, cost + 3, audit + "D", made, 0)
            if not must_go:
                to = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state].get(role[:1])
                if to:
                    go(i + 1, to, cost + cut, audit + "K", [*made, f"{role}:{text}"], 0)
                to = "a" if state == "u" else "u"
                go(i + 1, to, cost + 2 + cut, audit + "R", [*made, f"{'assistant' if to == 'a' else 'user'}:{text}"], 0)
        if inserted < 2:
            to = "a" if state == "u" else "u"
            go(i, to, cost + 2, audit + "I", [*made, f"{'assistant' if to == 'a' else 'user'}:"], inserted + 1)
    go(0, "", 0, "", [], 0)
    return best


def test_survivors_match_brute_force():
    rng = random.Random(11)
    for _ in range(1500):
        rows = [(rng.choice(["user", "assistant", "system", "x", "", "user", "assistant"]), str(i), rng.random() < 0.2, int(rng.random() < 0.2))
                for i in range(rng.randrange(0, 7))]
        s, edits = turn_repair.Survivors(), []
        for r in rows:
            s.take((0, r[0], r[1]), r[0], r[2], bool(r[3]))
            edits += s.settled()
        edits += s.finish()
        made = [f"{n.role}:{n.row[2] if n.row else ''}" for n in edits if n.role is not None]
        assert (s.cost, "".join(n.edit for n in edits), made) == plain_repair(rows)


def test_survivors_stay_few():
    rng = random.Random(4)
    s, given, most = turn_repair.Survivors(), 0, 0
    for i in range(30_000):
        odd = rng.random()
        s.take((i,), "system" if odd < 0.05 else ("user", "assistant")[i % 2], odd > 0.95, 0.5 < odd < 0.6)
        given += sum(1 for _ in s.settled())
        most = max(most, s.unresolved())
    assert most < 60 and given > 29_000


def plain_conversation(rows):
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (
        r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()))
    seen, judged, counts, before, illegal = set(), [], Counter(), None, 0
    for t, role, text in rows:
        end = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
        seen.add((role, text))
        counts[fault] += 1
        judged.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
        illegal += before is not None and before[:1] + role[:1] not in ("su", "ua", "au")
        before = role
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, made = plain_repair(judged)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"],
            illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())


def test_repairs_match_brute_force(spark):
    rng = random.Random(8)
    rows, plain = [], defaultdict(list)
    for c in [*range(150), None]:
        for _ in range(rng.randrange(1, 7)):
            row = (rng.choice([None, 1, 1, 2, 3, 9]), rng.choice([None, "", "user", "assistant", "system", "user"]),
                   rng.choice([None, "", " \x0b", "a.", "b!", "c", "d?\n", "é ", "x.  "]))
            dropped = rng.random() < 0.2
            rows.append((c, *row, dropped, "extra"))
            plain[c] += [] if dropped else [row]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, dropped boolean, digest string")
    got = {r.conv_id: tuple(r)[1:] for r in turn_repair.repairs(table).collect()}
    assert got == {c: plain_conversation(x) for c, x in plain.items()}
    edits = defaultdict(list)
    for r in turn_repair.repaired(table).collect():
        edits[r.conv_id].append(r)
    for c, row in got.items():
        mine = sorted(edits[c], key=lambda r: r.place)
        assert "".join(r.edit for r in mine) == row[6]
        made = "\n".join(f"{r.role}:{r.text}" for r in mine if r.role is not None)
        assert hashlib.sha256(made.encode()).hexdigest() == row[7]
    assert turn_repair.repairs(table.where("false")).collect() == []


def test_one_long_conversation(spark):
    table = spark.range(40_000).selectExpr(
        "1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('turn ', id, '.') text")
    row = turn_repair.repairs(table).first()
    assert (row.cost, row.audit) == (0, "K" * 40_000)
    whole = "\n".join(f"{('user', 'assistant')[i % 2]}:turn {i}." for i in range(40_000))
    assert row.repaired_sha256 == hashlib.sha256(whole.encode()).hexdigest()


def plain_mining(rows, every, k, m, window):
    usable = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable[i] = min(usable.get(i, (label, list(v))), (label, list(v)))
    whole = {i: (label, [math.floor(256 * float(x)) for x in v]) for i, (label, v) in usable.items()}
    out = []
    for a, (label, v) in whole.items():
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, l == label) for i, (l, w) in whole.items() if i != a and len(w) == len(v)]
        scored.sort()
        for p, pos, _ in [s for s in scored if s[2]][:k]:
            hits = [s for s in scored if not s[2] and window[0] * -p <= 100 * -s[0] <= window[1] * -p][:m]
            out += [(a, pos, r + 1, i, -p, -n) for r, (n, i, _) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_mining_matches_brute_force(spark, monkeypatch, seed):
    for name, n in (("TILE", 60), ("QUERIES", 7), ("LEAF", 4), ("FANOUT", 3), ("TOGETHER", 5)):
        monkeypatch.setattr(hard_negatives, name, n)
    rng = random.Random(seed)
    few = [[rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(3)] for _ in range(12)]
    rows = []
    for i in range(400):
        v = rng.choice([rng.choice(few), [rng.uniform(-1, 1) for _ in range(3)], [rng.uniform(0, 2) for _ in range(4)]])
        rows.append((i, v, rng.randrange(3)))
    rows += [(1000 + i, [0.5, 0.5, 0.5], 0) for i in range(120)] + [(2000, [], 0), (2010, [], 1), (2020, [], 0)]
    rows += [(3000, None, 1), (3001, [None, 0.1, 0.2], 1), (3002, [float("nan"), 0.1, 0.2], 1), (3003, [float("inf"), 1.0, 1.0], 2),
             (3004, [0.1, 0.2, 0.3], None), (None, [0.1, 0.2, 0.3], 1), (10, [0.3, 0.3, 0.3], 2), (20, [0.1] * 3, 0), (20, [0.1] * 3, 0)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, tile string")
    got = hard_negatives.mine(table, anchor_every=10)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain_mining(rows, 10, 5, 3, hard_negatives.WINDOW)


def test_mining_edges(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert hard_negatives.mine(spark.createDataFrame([], kind)).collect() == []
    assert hard_negatives.mine(spark.createDataFrame([(0, [1.0], 1)], kind)).collect() == []
    large = [(0, [1e6, 3e6], 1), (1, [1e6, 2e6], 1), (2, [1e6, 1e6], 0), (3, [-1e6, 1e6], 0)]
    assert sorted(map(tuple, hard_negatives.mine(spark.createDataFrame(large, kind)).collect())) == plain_mining(large, 50, 5, 3, hard_negatives.WINDOW)


def test_boxes_prune(monkeypatch):
    """Of well separated vectors, most leaves are never opened."""
    opened = []
    product = hard_negatives._product
    monkeypatch.setattr(hard_negatives, "_product", lambda a, b, n: opened.append(len(b)) or product(a, b, n))
    rng = np.random.default_rng(0)
    v = np.floor(rng.uniform(-1000, 1000, (4096, 3))).astype(np.int64)
    labels = rng.integers(0, 2, 4096)
    tree = hard_negatives.Tree(v, labels)
    best, found = hard_negatives.search(tree, v, labels, np.arange(4096), v[:1], labels[:1], np.array([hard_negatives.LEAST]),
                                        np.array([hard_negatives.MOST]), 6, True)
    scores = (v @ v[0]) * (labels == labels[0]) - (labels != labels[0]) * 10 ** 12
    assert best[0].tolist() == sorted(scores.tolist(), reverse=True)[:6]
    assert sum(opened) < 1024
