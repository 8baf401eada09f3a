"""Embedding near-duplicates and chat formatting."""

from __future__ import annotations

import json

import numpy as np
import pytest

from sutrapath.llm import chat_format, embedding_dedup

VECTORS = "vec_id long, embedding array<float>, label int, vector string, n_links int"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, lab, "clash", 9) for i, e, lab in rows], VECTORS)


def brute(rows, threshold=0.93):
    ids, n = [r[0] for r in rows], len(rows)
    near = np.zeros((n, n), dtype=bool)
    for a in range(n):
        for b in range(n):
            x, y = rows[a], rows[b]
            if a != b and x[2] is not None and x[2] == y[2] and x[1] and y[1] and len(x[1]) == len(y[1]) and None not in x[1] and None not in y[1]:
                u, v = np.array(x[1], dtype=np.float32).astype(float), np.array(y[1], dtype=np.float32).astype(float)
                if np.isfinite(u).all() and np.isfinite(v).all() and u.any() and v.any():
                    near[a, b] = u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= threshold
    label = list(ids)
    for _ in range(n):
        label = [min([label[a], *(label[b] for b in np.flatnonzero(near[a]))]) for a in range(n)]
    return {i: (int(near[k].sum()), label[k], label[k] == i) for k, i in enumerate(ids)}


def planted(seed=0, n=400, dim=32):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dim).tolist(), int(i % 3)) for i in range(n)]
    for k in range(20):  # pairs
        x = np.array(rows[k][1])
        rows.append((len(rows), (x + rng.normal(size=dim) * 0.05).tolist(), rows[k][2]))
    for _ in range(60):  # a dense group, larger than a neighbour list
        x = np.array(rows[30][1])
        rows.append((len(rows), (x + rng.normal(size=dim) * 0.08).tolist(), rows[30][2]))
    for _ in range(30):  # exact copies
        rows.append((len(rows), rows[40][1], rows[40][2]))
    return rows


def test_finds_all_links(spark):
    rows = planted()
    got = embedding_dedup.deduplicate(frame(spark, rows)).collect()
    want = brute(rows)
    mine = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert len(got) == len(rows) and got[0]["audited_recall"] >= 0.9
    found, true = sum(v[0] for v in mine.values()), sum(v[0] for v in want.values())
    assert all(mine[i][0] <= want[i][0] for i in want) and found >= 0.9 * true
    assert sum(mine[i] == want[i] for i in want) >= 0.97 * len(want)


def truth(x, labels, threshold=0.93):
    """Links of each row, and the least row that it is connected to."""
    x = np.array(x, dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= threshold) & (np.array(labels)[:, None] == np.array(labels)) & ~np.eye(len(x), dtype=bool)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.minimum(label, np.where(near, label, len(x)).min(axis=1))
    return near.sum(axis=1), label


def tight_in_wide(seed=1, dim=64, groups=6, copies=50, others=300):
    """Tight groups of more copies than any list holds, all linked with one another, beside vectors without links."""
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    mid = unit(unit(rng.normal(size=dim)) + 0.2 * unit(rng.normal(size=(groups, dim))))
    return np.concatenate([unit(np.repeat(mid, copies, axis=0) + 0.01 * unit(rng.normal(size=(groups * copies, dim)))), unit(rng.normal(size=(others, dim)))])


@pytest.mark.parametrize("tries", [1, 0])  # 0: no graph at all, labels are compared as a whole
def test_tight_groups_in_a_wide_one(spark, tries):
    x = tight_in_wide()
    got = embedding_dedup.deduplicate(frame(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)]), tries=tries).collect()
    links, label = truth(x, [1] * len(x))
    assert links[0] == 299
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (links[i], label[i], label[i] == i) for i in range(len(x))}
    assert got[0]["audited_recall"] == 1.0


@pytest.mark.parametrize("size", [300, 2600])
def test_one_large_group(spark, size):
    """Groups that no list holds and that take several blocks: every link of theirs is counted."""
    x = tight_in_wide(seed=3, dim=16, groups=1, copies=size, others=200)
    got = embedding_dedup.deduplicate(frame(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)])).collect()
    links, label = truth(x, [1] * len(x))
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (links[i], label[i]) for i in range(len(x))}


def test_audit_sees_small_groups_beside_a_large_one(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 32)), 300, axis=0), np.repeat(rng.normal(size=(100, 32)), 3, axis=0)])
    x += 1e-4 * rng.normal(size=x.shape)
    links, _ = truth(x, [1] * len(x))
    assert links[0] == 299 and links[300] == 2
    nodes = spark.createDataFrame([(i, 1, 1, v.tolist()) for i, v in enumerate(x)], "v long, part long, weight long, vector array<double>")
    counts = lambda kept: spark.createDataFrame([(i, int(n)) for i, n in enumerate(links) if kept(i)], "v long, linked long")
    assert embedding_dedup.audit(nodes, counts(lambda i: True), 0.93) == 1.0
    assert embedding_dedup.audit(nodes, counts(lambda i: i < 300), 0.93) < 0.5  # every link of the small groups is lost


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [1.0, None], 1), (9, [], 1), (10, [1.0, 0.0], None), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.1], 1), (13, [-1.0, 0.0], 1)]
    got = embedding_dedup.deduplicate(frame(spark, [*rows, (None, [1.0, 0.0], 1)])).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is not None} == brute(rows)
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is None] == [(0, None, False)]
    assert embedding_dedup.deduplicate(frame(spark, [])).count() == 0


def test_tool_calls(spark):
    call = lambda *calls: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})
    answer = lambda i: json.dumps({"tool_call_id": i, "content": "ok"})
    rows = [
        (1, 0, "user", "hello"),
        (1, 1, "assistant", call(("a", "add", {"y": 2, "x": 1}), ("b", "add", {"x": "no", "y": 2}))),
        (1, 2, "tool", answer("a")),
        (1, 3, "tool", answer("zz")),
        (2, 5, "assistant", call(("a", "free", {"n": {"d": 1, "c": [2, {"z": 0, "a": 1}]}}))),
        (2, 4, "tool", answer("a")),
        (3, 0, "assistant", '{"broken'),
        (None, None, None, None),
    ]
    schemas = {"add": {"type": "object", "properties": {"x": {"type": "integer"}, "y": {"type": "integer"}}, "required": ["x"], "additionalProperties": False}}
    got = chat_format.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schemas).collect()
    by = {(r["conv_id"], r["kind"], r["call_id"]): r for r in got}
    assert len(got) == 9
    assert by[(1, "call", "a")]["linked"] and by[(1, "call", "a")]["valid"] and not by[(1, "call", "b")]["linked"] and not by[(1, "call", "b")]["valid"]
    assert by[(1, "result", "a")]["linked"] and not by[(1, "result", "zz")]["linked"]
    early, late = by[(2, "result", "a")], by[(2, "call", "a")]
    assert (early["order_turn"], early["order_level"]) > (late["order_turn"], late["order_level"])
    same = sorted((r["order_turn"], r["order_level"], r["order_item"], r["call_id"]) for r in got if r["conv_id"] == 1 and r["turn"] == 1)
    assert same == [(1, 0, 0, "a"), (1, 0, 1, "b")]
    assert '"arguments":{"n":{"c":[2,{"a":1,"z":0}],"d":1}}' in late["json"]
    assert all(list(json.loads(r["json"])) == sorted(json.loads(r["json"])) for r in got)


def in_order(rows):
    """Calls and results of one conversation, by definition: (turn, level, cyclic) of each identifier's call and result."""
    calls, results = {}, {}
    for turn, kind, call_id, after in rows:
        if kind == "call":
            at, needs = calls.get(call_id, (turn, set()))
            calls[call_id] = (min(at, turn), needs | set(after))
        else:
            results[call_id] = min(results.get(call_id, turn), turn)
    found = {}

    def settle(i, path):
        if i in found:
            return found[i]
        if i in path:
            return None
        needs = [settle(n, path | {i}) for n in calls[i][1] if n in calls]
        if None in needs:
            return None
        level = 1 + max(n[1] for n in needs) if needs else 0
        at = max([calls[i][0], *(n[2] for n in needs)])
        found[i] = (at, level, max(at, results.get(i, at)))
        return found[i]

    out = {}
    for i in calls:
        done = settle(i, frozenset())
        out[i] = (done[0], 2 * done[1], False) if done else (calls[i][0], 0, True)
    return out


def test_topological_order(spark):
    """Chains, ties, shared identifiers, early results and cycles, against the definition; every dependency is kept."""
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for conv in range(40):
        ids, mine = [f"c{k}" for k in range(int(rng.integers(1, 9)))], []
        for turn in range(12):
            if rng.random() < 0.6:
                some = [(str(rng.choice(ids)), [str(x) for x in rng.choice([*ids, "unknown"], int(rng.integers(0, 3)))] if rng.random() < 0.5 else []) for _ in range(int(rng.integers(1, 4)))]
                rows.append((conv, turn, "assistant", json.dumps({"tool_calls": [{"id": i, "name": "t", "arguments": {}, "after": a} for i, a in some]})))
                mine += [(turn, "call", i, a) for i, a in some]
            else:
                i = str(rng.choice(ids))
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": i, "content": turn})))
                mine.append((turn, "result", i, []))
        want |= {(conv, i): v for i, v in in_order(mine).items()}
    got = chat_format.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert any(v[2] for v in want.values()) and any(v[1] >= 4 for v in want.values())
    call = {}
    for r in got:
        if r["kind"] == "call":
            at, level, cyclic = want[r["conv_id"], r["call_id"]]
            assert (r["order_turn"], r["order_level"], r["cyclic"]) == (r["turn"] if cyclic else max(r["turn"], at), level, cyclic)
            key = (r["order_turn"], r["order_level"])
            call[r["conv_id"], r["call_id"]] = min(call.get((r["conv_id"], r["call_id"]), key), key)
    for r in got:
        if r["kind"] == "result" and r["linked"]:
            assert (r["order_turn"], r["order_level"]) > call[r["conv_id"], r["call_id"]]


def test_long_chain(spark):
    rows = [(1, 20 - k, "assistant", json.dumps({"tool_calls": [{"id": f"c{k}", "name": "t", "arguments": {}, "after": [f"c{k - 1}"] if k else []}]})) for k in range(9)]
    got = chat_format.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [r["call_id"] for r in sorted(got, key=lambda r: (r["order_turn"], r["order_level"]))] == [f"c{k}" for k in range(9)]


@pytest.mark.parametrize("shape", ["chain", "ladder", "cycle behind", "two before"])
def test_rounds_of_long_conversations(spark, shape, monkeypatch):
    """Chains and what comes together again take few rounds; results equal the definition."""
    n, needs = 200, {}
    for k in range(n):
        if shape == "ladder":  # c3m+3 after both of c3m+1 and c3m+2, which are after c3m
            needs[k] = [k - k % 3 - (0 if k % 3 else 1), *([k - 2] if k % 3 == 0 else [])] if k else []
        else:
            needs[k] = [k - 1] if k else []
        if shape == "two before" and 1 < k < 12:
            needs[k] = [k - 1, k - 2]
    if shape == "cycle behind":
        needs[101] = [100, 107]
    rng = np.random.default_rng(8)
    mine = [(int(rng.integers(0, 400)), "call", f"c{k}", [f"c{x}" for x in needs[k] if x >= 0]) for k in range(n)] + [(int(rng.integers(0, 400)), "result", f"c{k}", []) for k in range(0, n, 3)]
    text = lambda kind, i, a: json.dumps({"tool_calls": [{"id": i, "name": "t", "arguments": {}, "after": a}]} if kind == "call" else {"tool_call_id": i})
    rows = [(1, t, "assistant" if kind == "call" else "tool", text(kind, i, a)) for t, kind, i, a in mine]
    rounds, real = [], chat_format.stored
    monkeypatch.setattr(chat_format, "stored", lambda df, name, **more: rounds.append(name) or real(df, name, **more))
    got = chat_format.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = in_order(mine)
    assert {r["call_id"]: (r["order_turn"], r["order_level"], r["cyclic"]) for r in got if r["kind"] == "call"} == want
    assert sum(v[2] for v in want.values()) == (99 if shape == "cycle behind" else 0)
    assert rounds.count("chat-settled") <= (18 if shape == "two before" else 12)


@pytest.mark.parametrize(
    ("arguments", "valid"),
    [
        ('{"q": "x", "n": 3, "tags": ["a", "b"], "where": {"lat": 1.5, "on": true}}', True),
        ('{"q": "x"}', True),
        ('{"q": "x", "n": 3.5}', False),
        ('{"q": "x", "n": "3"}', False),
        ('{"q": "z"}', False),
        ('{"n": 1}', False),
        ('{"q": "x", "tags": ["a", 1]}', False),
        ('{"q": "x", "tags": []}', True),
        ('{"q": "x", "tags": "a"}', False),
        ('{"q": "x", "where": {"lat": "1"}}', False),
        ('{"q": "x", "where": {"on": true}}', False),
        ('{"q": "x", "where": {"lat": 2, "other": 1}}', False),
        ('{"q": "x", "more": 1}', False),
        ('{"q": "x", "n": null}', False),
        ('{"q": null}', True),
        ('["q"]', False),
        ("{", False),
        (None, False),
    ],
)
def test_nested_schemas(spark, arguments, valid):
    from pyspark.sql import functions as F

    where = {"type": "object", "properties": {"lat": {"type": "number"}, "on": {"type": "boolean"}}, "required": ["lat"], "additionalProperties": False}
    schema = {"type": "object", "properties": {"q": {"enum": ["x", "y", None]}, "n": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}}, "where": where}, "required": ["q"], "additionalProperties": False}
    row = spark.createDataFrame([("t", arguments)], "name string, a string")
    assert row.select(chat_format.valid_arguments(F.col("name"), F.col("a"), {"t": schema}).alias("v")).first()["v"] is valid


def test_calls_behind_white_space(spark):
    rows = [(1, 0, "assistant", ' \n{"tool_calls": [{"id": "a", "name": "t", "arguments": {}}]}'), (1, 1, "tool", '\t{"tool_call_id": "a", "content": 1}'), (1, 2, "assistant", "no { call")]
    got = chat_format.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r["turn"], r["kind"], r["call_id"], r["linked"]) for r in got) == [(0, "call", "a", True), (1, "result", "a", True), (2, "message", None, False)]


def test_turns(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "r"), (1, 1, "assistant", "r"), (1, 2, "user", None), (2, 0, "system", ""), (2, 1, "user", "")]
    got = chat_format.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), turns=True).collect()
    assert sorted((r["conv_id"], r["turn"], r["kind"], r["linked"], r["valid"]) for r in got) == [(1, 0, "call", True, True), (1, 1, "result", True, True), (1, 1, "result", True, True), (1, 2, "call", False, False), (2, 0, "message", False, True), (2, 1, "call", False, True)]
    assert chat_format.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), turns=True).count() == 0


@pytest.mark.parametrize(("text", "value"), [('{"b": 1, "a": [true, null]}', '{"a":[true,null],"b":1}'), ("{", None), (None, None)])
def test_canonical(spark, text, value):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "t string").select(chat_format.canonical(F.col("t")).alias("x")).first()["x"] == value
