"""Problem 5: Dewey labels and flat tables against a plain walk."""

import json
import random

from factspan.operators import nested as N

CELLS = "cell_id long, payload string, extra string"


def cells(spark, payloads):
    return spark.createDataFrame([(i, p if isinstance(p, (str, type(None))) else json.dumps(p), "x") for i, p in payloads], CELLS)


def many(x):
    return [] if x is None else x if isinstance(x, list) else [x]


def brute(payloads):
    out = set()
    for cell, p in payloads:
        try:
            p = json.loads(p) if isinstance(p, str) else p
        except ValueError:
            continue
        for i, item in enumerate(many((p or {}).get("items"))):
            if not isinstance(item, dict):
                continue
            for k, e in enumerate(many((item.get("condition") or {}).get("electrolyte"))):
                if isinstance(e, dict):
                    c = e.get("concentration")
                    out.add((cell, i, -1, "electrolyte", k, e.get("formula") or "", -1 if c is None else round(float(c) * 1e6)))
            for v, ev in enumerate(many(item.get("evidence"))):
                paper = (ev or {}).get("paper") or {}
                if paper.get("doi") is not None:
                    out.add((cell, i, v, "doi", 0, paper["doi"], -1))
                for k, a in enumerate(many(paper.get("authors"))):
                    name = " ".join(filter(None, (a.get("given"), a.get("family")))) if isinstance(a, dict) else a
                    if name:
                        out.add((cell, i, v, "author", k, name, -1))
    return out


def test_random_cells(spark):
    r = random.Random(3)
    el = lambda: r.choice([None, {"formula": "KOH", "concentration": 0.1}, {"concentration": "0.5"}, {"formula": None}, {}])
    au = lambda: r.choice(["Ada B", {"given": "Ada", "family": "B"}, {"family": "B", "given": None}, None])
    lst = lambda f: r.choice([f(), [f() for _ in range(r.randint(0, 3))]])
    ev = lambda: r.choice([{"page": 1}, {"paper": None}, {"paper": {"doi": r.choice([None, "10/x"]), "authors": lst(au)}}])
    item = lambda: r.choice([7, "no table", None, {"evidence": lst(ev), "condition": r.choice([None, {}, {"electrolyte": lst(el)}])}])
    data = [(i, {"schema": 1, "items": r.choice([None, lst(item), lst(item)])}) for i in range(200)]
    data += [(5, dict(data[5][1])), (900, "{torn"), (901, None), (902, "")]
    got = [tuple(x) for x in N.found(cells(spark, data)).select("cell_id", "item_no", "evidence_no", "child", "child_no", "val", "amount").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data[:-3])


def test_parents_by_truncation(spark):
    from pyspark.sql import functions as F

    n = N.nodes(cells(spark, [(1, {"items": [{"a": [1, {"b": 2}]}]})]), "cell_id", "payload")
    rows = {r.label: r for r in n.select("label", N.parent(F.col("label")).alias("up"), "path", "kind", "val").collect()}
    assert all(r.up == "" or r.up in rows for r in rows.values())
    assert rows["0.0.0.1.0"].path == "items.a.b" and rows["0.0.0.1.0"].val == "2"


def test_long_payload(spark):
    big = {"items": [{"condition": {"electrolyte": [{"formula": "x" * 10}] * 2000}}]}
    assert N.found(cells(spark, [(1, big)])).count() == 2000
