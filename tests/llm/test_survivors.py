"""Problem 1 against a plain search for the best row of each group."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from factspan.llm import survivors as S

FACTS = "fact_id long, sha string, parser string, model string, type string, value double, confidence double, extracted_at timestamp, evidence struct<page:int,bbox_x0:double,bbox_y0:double,bbox_x1:double,bbox_y1:double>, extra string, _layer int"
ROWS = "row_id long, source_file string, paper_sha8 string, parser string, label string, model_id string, mode string, prompt_hash string, recorded_at timestamp"
T0 = datetime(2026, 1, 1)


def facts(spark, rows):
    return spark.createDataFrame([(i, s, p, "m", t, v, c, at, None if b is None else (pg, *b), "x", 1) for i, s, p, t, v, c, at, pg, b in rows], FACTS)


def test_facts_against_brute_force(spark):
    r = random.Random(5)
    rows, i = [], 0
    for g in range(150):
        x, y = r.uniform(0, 500), g * 40.0
        for _ in range(r.choice([1, 2, 2, 5, 40])):
            i += 1
            box = tuple(c + r.uniform(-0.7, 0.7) for c in (x, y, x + 50, y + 10))
            v = r.choice([None, float("nan"), -999.0, 999999.0, 1.0, 2.0, 3.0])
            rows.append((i, r.choice(["AB", "ab"]), "p", "ECSA", v, r.choice([None, 0.1, 0.5, 0.5]), T0 + timedelta(hours=r.randint(0, 3)), 1, box))
    rows += [(9001, "ab", "p", "ECSA", 1.0, 0.5, T0, 1, None), (9002, None, "p", "ECSA", 1.0, 0.5, T0, 1, (0.0, 0.0, 1.0, 1.0))]
    got = {(x.first_id, x.best_id) for x in S.found(facts(spark, rows), spark.createDataFrame([], ROWS)).collect()}
    want, groups = set(), {}
    for row in rows[:-2]:
        for key in groups:
            if all(abs(a - b) < 1.5 for a, b in zip(key, row[8])):
                groups[key].append(row)
                break
        else:
            groups[row[8]] = [row]
    for g in groups.values():
        ok = [x for x in g if x[4] in (1.0, 2.0, 3.0)]
        if len(g) > 1 and ok:
            want.add((min(x[0] for x in g), min(ok, key=lambda x: (-(x[5] if x[5] is not None else -1), -x[6].timestamp(), x[0]))[0]))
    assert got == want


def test_exports(spark):
    rows = [
        (1, "llm_matrix_dots_2026-01-01.csv", "AB12", "n/a", "Dune Flash", "m1", "raw", "h", T0),
        (2, "llm_matrix_dots_2026-02-01.csv", " ab12", "dots", "dune_flash", None, "raw", "H", T0 + timedelta(1)),
        (3, "llm_matrix_dots_2026-03-01.csv", "ab12", " ", "dune-flash", "?", "Raw", "h", T0 + timedelta(2)),
        (4, "llm_matrix_paddle_2026-03-01.csv", "ab12", "paddle", "dune-flash", "m", "raw", "h", T0),
        (5, "llm_matrix_dots_2026-01-01.csv", "cd", None, "x", None, "raw", "h", T0),
        (6, "llm_matrix_dots_2026-01-01.csv", "cd", "-", "x", None, "raw", "h", T0),
    ]
    got = {tuple(x) for x in S.found(spark.createDataFrame([], FACTS), spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {("matrix_rows", 1, "parser", 2), ("matrix_rows", 1, "model_id", 1)}


def test_layers_fill_nulls(spark):
    d = spark.createDataFrame([(1, "k", None, "b1", 0.9, 9), (2, "k", "a2", None, 0.5, 5), (3, "k", "a3", "b3", 0.4, 1), (4, "k", "a4", "b4", 0.3, 0)], "i long, k string, a string, b string, t double, r int")
    present = {"a": F.col("a").isNotNull(), "b": F.col("b").isNotNull()}
    rec = F.timestamp_seconds("r")
    thin = S.skyline(d, ["k"], "i", present, F.col("t"), rec, layers=2)
    out = S.resolve(thin, ["k"], {"a": F.col("a"), "b": F.col("b")}, layers=2).collect()[0]
    assert (out.n_rows, out.first_id, out.best_id, out.a, out.a_id, out.b, out.b_id) == (4, 1, 1, "a2", 2, "b1", 1)


def test_hot_group(spark):
    d = spark.range(20_000).select(F.col("id").alias("i"), F.lit("k").alias("k"), (F.col("id") % 97 / 97).alias("t"), F.timestamp_seconds(F.col("id") % 89).alias("r"))
    thin = S.skyline(d, ["k"], "i", {"a": F.lit(True)}, F.col("t"), F.col("r"))
    assert thin.count() < 200
    out = S.resolve(thin, ["k"], {"a": F.col("i")}).collect()[0]
    best = d.orderBy(F.desc("t"), F.desc("r"), "i").first()
    assert out.n_rows == 20_000 and out.best_id == best.i


def test_boxes_are_grouped_by_links_to_the_end(spark):
    """Corners that no cut along one coordinate parts, a chain of many links, and plain pairs."""
    r = random.Random(9)
    places = [(0, 0), (2, 0), (1, 2), (4, 1), (3, 4)] + [(100 + k * 1.2, 50 - k * 1.1) for k in range(40)] + [(300 + r.uniform(0, 12), 300 + r.uniform(0, 12)) for _ in range(60)]
    rows = [(i + 1, "ab", "p", "ECSA", 1.0, 0.5, T0, 1, (float(x), float(y), 5.0, 5.0)) for i, (x, y) in enumerate(places)]
    group = list(range(len(places)))
    for _ in places:
        for a, p in enumerate(places):
            for b, q in enumerate(places):
                if all(abs(x - y) < 1.5 for x, y in zip(p, q)):
                    group[a] = group[b] = min(group[a], group[b])
    want = sorted(group.count(g) for g in set(group))
    got = sorted(x.n_rows for x in S.fact_survivors(facts(spark, rows)).collect())
    assert got == want and 40 in want


def test_exports_without_a_key_are_no_duplicates(spark):
    rows = [(i, "llm_matrix_dots_2026-01-01.csv", p, "dots", label, "m1", "raw", "h", T0) for i, (p, label) in enumerate([(None, "x"), (None, "x"), ("ab", None), ("ab", None), ("ab", "x"), ("ab", "x")])]
    out = S.export_survivors(spark.createDataFrame(rows, ROWS)).collect()
    assert sorted(x.n_rows for x in out) == [1, 1, 1, 1, 2]
