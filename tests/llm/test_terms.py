"""Problem 3: plain forms, distances, mapping and misses."""

import random

import pytest

from factspan.llm import terms as S

VOCAB = [(1, "electrolyte_family", "acid", ""), (2, "electrolyte_family", "alkaline", ""), (3, "electrolyte_family", "neutral", ""), (10, "cell_type", "H-type cell", ""), (11, "cell_type", "beaker cell", ""), (12, "cell_type", "three-electrode half-cell", ""), (20, "cell_type_family", "stack", ""), (21, "cell_type_family", "RDE", "")]


def mapped(spark, entries):
    f = spark.createDataFrame([(i, (e if k == "cell_type" else None, e if k == "cell_type_family" else None, e if k == "electrolyte_family" else None), "x") for i, (k, e) in enumerate(entries)], "fact_id long, condition struct<cell_type:string,cell_type_family:string,electrolyte_family:string>, extra string")
    v = spark.createDataFrame(VOCAB, "term_id int, field string, term string, gloss string")
    return {r.fact_id: r.term_id for r in S.found(f, v).collect()}, f, v


CASES = [
    ("electrolyte_family", "acid", None), ("electrolyte_family", "Acid", 1), ("electrolyte_family", " acid;", 1), ("electrolyte_family", "ácido", 1), ("electrolyte_family", "acdi", 1),
    ("electrolyte_family", "sauer", 1), ("electrolyte_family", "alkakine", 2), ("electrolyte_family", "KOH / alkaline", 2), ("electrolyte_family", "molten salt", 0), ("electrolyte_family", "n/a", 0),
    ("electrolyte_family", "?", 0), ("electrolyte_family", " ", None), ("electrolyte_family", None, None), ("electrolyte_family", "", None),
    ("cell_type", "home-built H-type cell", 10), ("cell_type", "25 cm2 beaker_cell [SI]", 11), ("cell_type", "BEAKER CELL (home-made)", 11), ("cell_type", "beekar cell, 60 C", 11), ("cell_type", "H-Zelle #2", 10),
    ("cell_type", "custom", 0), ("cell_type", "coin cell", 0), ("cell_type", "Dreielektroden-Halbzelle", 12), ("cell_type_family", "Zellstapel", 20), ("cell_type_family", "R.D.E.", 21), ("cell_type", "x" * 20_000, 0),
]


def test_cases(spark):
    got, f, v = mapped(spark, [c[:2] for c in CASES])
    assert got == {i: c[2] for i, c in enumerate(CASES) if c[2] is not None}
    assert {r.entry for r in S.misses(f, v).collect()} == {c[1] for c in CASES if c[2] == 0}


def test_empty(spark):
    assert mapped(spark, [])[0] == {}


def test_deletes_meet_within_two_edits():
    r = random.Random(1)
    word = "rotating disk electrode"
    for _ in range(300):
        w = list(word)
        for _ in range(2):
            i = r.randrange(len(w))
            k = r.choice("dsit")
            if k == "d":
                del w[i]
            elif k == "s":
                w[i] = r.choice("abc")
            elif k == "i":
                w.insert(i, r.choice("abc"))
            elif i + 1 < len(w):
                w[i], w[i + 1] = w[i + 1], w[i]
        assert S.deletes("".join(w), 2) & S.deletes(word, 2)
        assert S.distance("".join(w), word) <= 2.2


@pytest.mark.parametrize("a,b,d", [("stack", "stack", 0), ("stakc", "stack", 0.8), ("staack", "stack", 0.8), ("stck", "stack", 1.0), ("xtack", "stack", 1.2), ("nteral", "neutral", 1.8)])
def test_distance(a, b, d):
    assert S.distance(a, b) == pytest.approx(d)


def test_names_are_an_input(spark):
    v = spark.createDataFrame([(1, "cell_type", "scanning droplet flow cell", "SDFC, coupled"), (2, "cell_type", "beaker cell", "one open vessel")], "term_id int, field string, term string, gloss string")
    e = spark.createDataFrame([("cell_type", x) for x in ("SDF", "sdfc cell", "Topf", "Toph", "beaker", "weg")], "field string, entry string")
    names = spark.createDataFrame([("beaker cell", "topf"), (None, "weg")], "term string, name string")
    got = {r.entry: r.term_id for r in S.term_mapping(e, v, names).collect()}
    assert got == {"SDF": 1, "sdfc cell": 1, "Topf": 2, "Toph": 2, "beaker": 0, "weg": 0}
