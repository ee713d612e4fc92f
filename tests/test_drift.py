"""Problem 2: edit scripts, late files, torn lines."""

import json
import random
from datetime import datetime, timedelta
from itertools import permutations

from factspan.operators import drift as D

LINES = "line_id long, series string, file_name string, file_date timestamp, line_no int, payload string, loaded_at timestamp, extra string"
T0 = datetime(2026, 1, 1)


def lines(spark, files):
    rows = []
    for name, day, payloads in files:
        for n, p in enumerate(payloads):
            rows.append((len(rows), name[0], name, T0 + timedelta(days=day), n, p if isinstance(p, (str, type(None))) else json.dumps(p), T0, "x"))
    return spark.createDataFrame(rows, LINES)


def item(**electrolyte):
    return {"type": "ECSA", "value": 1.5, "condition": {"temperature_C": 25, "electrolyte": electrolyte or None}}


def test_changes(spark):
    a = [item(formula="KOH", concentration=0.1), item(formula="H2SO4", concentration=0.5)]
    files = [
        ("s1", 0, [*a, None, '{"torn']),
        ("s3", 2, [item(salt=["KOH"], concentration=0.1)]),  # arrives before s2
        ("s2", 1, [item(salt="KOH", concentration=0.1, flow=3), a[0] and item(salt="H2SO4")]),
        ("t1", 0, [item(formula="KOH")]),
        ("t2", 1, [item(formula="KOH"), "[1]"]),
        ("t3", 2, [{"type": "ECSA", "value": "1.5", "condition": {"temperature_C": 25, "medium": {"formula": "KOH"}}}]),
    ]
    got = {tuple(r) for r in D.found(lines(spark, files)).collect()}
    e = "condition.electrolyte"
    assert got == {
        ("s2", "renamed", f"{e}.formula", f"{e}.salt"), ("s2", "added", "", f"{e}.flow"), ("s3", "retyped", f"{e}.salt", f"{e}.salt"), ("s3", "removed", f"{e}.flow", ""),
        ("t3", "renamed", e, "condition.medium"), ("t3", "retyped", "value", "value"),
    }


def test_table_is_whole_and_consistent(spark):
    files = [("s1", 0, [item(formula="KOH", concentration=0.1)] * 2), ("s2", 1, [item(salt="KOH", concentration="0.1 M", flow=3), "torn{"])]
    got = {r.line_id: r for r in D.consistent_table(lines(spark, files)).collect()}
    assert set(got) == {0, 1, 2} and {r.formula for r in got.values()} == {"KOH"} and {r.concentration for r in got.values()} == {0.1}
    assert json.loads(got[2].extra) == {"condition.electrolyte.flow": "3"}


def test_empty(spark):
    assert D.found(lines(spark, []).limit(0)).count() == 0


def test_a_move_is_one_operation():
    old = {"a": (8, {1, 2}), "a.x": (1, {5}), "b": (8, {9})}
    new = {"a": (8, {1}), "b": (8, {9, 5}), "b.x": (1, {5})}
    assert D.edit_script(old, new) == [("moved", "a.x", "b.x", 1.0)]


def test_moves_are_removed_and_added_in_the_report(spark):
    files = [("s1", 0, [{"a": {"ph": 7, "k": 1}, "b": {"z": "u"}}]), ("s2", 1, [{"a": {"k": 1}, "b": {"z": "u", "ph": 7}}])]
    got = lines(spark, files)
    assert [tuple(r)[3:6] for r in D.edit_scripts(got).collect()] == [("moved", "a.ph", "b.ph")]
    assert {tuple(r) for r in D.found(got).collect()} == {("s2", "removed", "a.ph", ""), ("s2", "added", "", "b.ph")}


def test_assignment_is_cheapest():
    old = {"a": (2, {1, 2, 3}), "b": (2, {1, 2})}
    new = {"c": (2, {1, 2}), "d": (2, {3, 1, 2})}
    got = {c[:3] for c in D.edit_script(old, new)}
    assert {c[0] for c in got} == {"renamed"} and len(got) == 2


def test_every_component_is_kept(spark):
    one, two = {"formula": "KOH", "concentration": 0.1}, {"formula": "K2HPO4", "concentration": 0.5, "flow": 3}
    mixed = [item(), item(), item(formula="KOH"), item(formula=["KOH", "LiOH"])]
    mixed[0]["condition"]["electrolyte"] = [two, one]
    mixed[1]["condition"]["electrolyte"] = [one, {"formula": "A"}, two]
    got = {r.line_id: r for r in D.consistent_table(lines(spark, [("s1", 0, mixed)])).collect()}
    parts = {k: [(c.formula, c.concentration) for c in r.components] for k, r in got.items()}
    assert parts == {0: [("K2HPO4", 0.5), ("KOH", 0.1)], 1: [("KOH", 0.1), ("A", None), ("K2HPO4", 0.5)], 2: [("KOH", None)], 3: [("KOH", None), ("LiOH", None)]}
    assert (got[0].formula, got[0].concentration) == ("K2HPO4", 0.5) and (got[1].formula, got[1].concentration) == ("KOH", 0.1)
    assert json.loads(got[0].extra) == {"condition.electrolyte.flow": "3"} and json.loads(got[1].extra) == {"condition.electrolyte.flow[2]": "3"}


def test_two_members_of_one_common_name_are_both_kept():
    row = D.into_row({"unit_label": "V", "unit": "mV", "label": "A", "notes": [{"t": "a"}, {"t": "b"}]}, lambda p: {"unit": "unit_label", "label": "unit_label"}.get(p, p))
    assert row[2] == "V" and json.loads(row[-1]) == {"unit": "mV", "label": "A", "notes.t": "a", "notes.t[1]": "b"}


def test_projections_are_of_their_series_and_path(spark):
    names = ["formula", "salt", "salt_b", "salt_c", "salt_d", "salt_e"]
    long = [(f"s{k}", k, [item(**{n: "KOH", "concentration": 0.1})]) for k, n in enumerate(names)]
    late = [("u0", 0, [item(x="KOH")]), ("u1", 1, [item(y="KOH")]), ("u2", 2, [item(formula="KOH")])]
    other = [("t0", 0, [{"type": "a", "salt": "NaCl", "condition": {"electrolyte": {"salt": "x", "formula": "HCl"}}}])]
    other += [("v0", 0, [{"type": "a", "salt": "NaCl", "condition": {"electrolyte": {"salt_b": "KOH"}}}])]
    moved = [("m0", 0, [{"type": "a", "condition": {"temperature_C": 25}}]), ("m1", 1, [{"type": "a", "temperature_C": 25, "condition": {"z": 1}}])]
    got = {r.file_name: r for r in D.consistent_table(lines(spark, [*long, *late, *other, *moved])).collect()}
    assert {got[f"s{k}"].formula for k in range(6)} == {got[f"u{k}"].formula for k in range(3)} == {"KOH"}
    assert got["v0"].formula == "KOH" and json.loads(got["v0"].extra) == {"salt": "NaCl"}  # as all other series have it
    assert got["t0"].formula == "HCl" and json.loads(got["t0"].extra) == {"salt": "NaCl", "condition.electrolyte.salt": "x"}
    assert got["m0"].temperature_c == got["m1"].temperature_c == 25


def test_renames_compose():
    f = D.compose({}, [("condition.medium", "condition.electrolyte")])
    assert D.common_path(f, {}, "condition.electrolyte.formula") == "condition.electrolyte.formula"
    f = D.compose({"condition.electrolyte.salt": "condition.electrolyte.formula"}, [("condition.electrolyte", "condition.medium")])
    assert D.common_path(f, {}, "condition.medium.salt") == "condition.electrolyte.formula" and D.common_path(f, {}, "condition.medium.x") == "condition.electrolyte.x"
    assert D.compose({"a": "value", "b": "type"}, [("a", "b"), ("b", "a")]) == {"a": "type", "b": "value"}
    assert D.compose({}, [("unit_label", "type")]) == {"type": "type"}


def test_renames_between_files_of_unequal_size(spark):
    small = [{"type": "a", "p": f"v{i}", "n": f"x{i}"} for i in range(10)]
    large = [{"type": "a", "q": f"v{i}", "m": f"y{i}"} for i in range(1000)]
    got = {tuple(r) for r in D.found(lines(spark, [("s1", 0, small), ("s2", 1, large), ("s3", 2, small[:5])])).collect()}
    assert got == {
        ("s2", "renamed", "p", "q"), ("s2", "removed", "n", ""), ("s2", "added", "", "m"),
        ("s3", "renamed", "q", "p"), ("s3", "removed", "m", ""), ("s3", "added", "", "n"),
    }


def test_assignment_is_cheapest_at_any_size():
    a, b = [f"a{i}" for i in range(8)], [f"b{i}" for i in range(8)]
    gain = {(x, y): 1.8 for x, y in zip(a, b)} | {(x, y): 1.9 for x, y in zip(a, b[1:])}
    assert D._assign(gain) == list(zip(a, b))  # by falling gain: seven pairs, a7 and b0 left over
    rnd = random.Random(5)
    for _ in range(40):
        n, m = rnd.randint(1, 5), rnd.randint(1, 5)
        gain = {(x, y): g for x in a[:n] for y in b[:m] if (g := rnd.choice([0.0, 0.6, 1.5, 1.6, 1.75, 2.0]))}
        value = lambda ps: sum(gain.get(p, 0.0) for p in ps)  # noqa: B023, E731
        best = max(value(zip(xs, ys)) for xs in [a[:n]] for ys in permutations([*b[:m], *[""] * n], n))
        got = D._assign(gain)
        assert abs(value(got) - best) < 1e-9 and len({x for x, _ in got}) == len({y for _, y in got}) == len(got)
