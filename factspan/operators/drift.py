"""Schemas that drift between files (problem 2).

Each file's schema is a tree of member names. Trees of consecutive files of a series are compared by a top-down tree
edit distance whose operations are add, delete, rename, retype and move; the cheapest script is the report, and
scripts compile into projections that bring every line into one table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from factspan.session import staged

STRING, NUMBER, BOOLEAN, OBJECT, ARRAY = 1, 2, 4, 8, 16
#: Distinct values of a member that are kept with its schema: those with the smallest hashes. Members with fewer are
#: compared by these, others by all of their content (_exact_likeness).
SKETCH = 64
#: Share of common content from which a member counts as going on under another name.
SAME_CONTENT = 0.5
FILE = ["series", "file_date", "file_name"]
_FILE = "series string, file_date timestamp, file_name string"
#: Members of the common schema that get a column of their own.
COMMON = [
    "type", "value", "unit_label", "condition.current_density", "condition.temperature_C",
    "condition.electrolyte.formula", "condition.electrolyte.concentration", "condition.electrolyte.electrolyte_ph",
]
#: Where the members of a component stand.
COMPONENT = "condition.electrolyte."
_LEADING = re.compile(r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")


def kind_of(v: object) -> int:
    if v is None:
        return 0
    if isinstance(v, bool):
        return BOOLEAN
    if isinstance(v, (int, float)):
        return NUMBER
    if isinstance(v, str):
        return STRING
    return OBJECT if isinstance(v, dict) else ARRAY


def readable(payload: object) -> dict | None:
    """The JSON object of a line; None for torn lines, other JSON values and nulls."""
    if not isinstance(payload, str):
        return None
    try:
        v = json.loads(payload)
    except ValueError:
        return None
    return v if isinstance(v, dict) else None


def _mark(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def _texts(v: object) -> str:
    k = kind_of(v)
    return f"{k}:{float(v) if k == NUMBER else v}"


class Observer:
    """Kinds and content of the members of files; a small helper that tasks run on each line.

    A member's content is what stands at and below it: values with their paths from it, and the names below it. Marks
    of values are kept by path and value, as the same ones come again and again.
    """

    KEPT = 200_000

    def __init__(self) -> None:
        self.known: dict[tuple, list[int]] = {}

    def line(self, v: dict, into: dict[str, list], done: set) -> None:
        """Adds a line to the members (path to [kinds, marks]) of its file. done: what the file has had before."""
        if len(self.known) > self.KEPT:
            self.known = {}
        for k, x in v.items():
            self.member(x, k, [k], into, done)

    def member(self, v: object, path: str, above: list[str], into: dict[str, list], done: set) -> None:
        cls = v.__class__
        if cls is not dict and cls is not list:
            key = (path, cls, v)
            if key in done:  # adds nothing again
                return
            done.add(key)
        seen = into.get(path)
        if seen is None:
            seen = into[path] = [0, set()]
            for a in above[:-1]:
                into[a][1].add(_mark(path[len(a) :]))
        if cls is dict:
            seen[0] |= OBJECT
            for k, x in v.items():
                p = f"{path}.{k}"
                self.member(x, p, [*above, p], into, done)
        elif cls is list:  # elements belong to the list's own path
            seen[0] |= ARRAY
            for x in v:
                if x.__class__ is dict:
                    for k, y in x.items():
                        p = f"{path}.{k}"
                        self.member(y, p, [*above, p], into, done)
                elif x is not None:
                    seen[1].add(_mark(_texts(x)))
        elif v is not None:
            seen[0] |= kind_of(v)
            marks = self.known.get(key)
            if marks is None:
                text = _texts(v)
                marks = self.known[key] = [_mark(text if a == path else f"{path[len(a) :]}={text}") for a in above]
            for a, m in zip(above, marks):
                into[a][1].add(m)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files: dict[tuple, tuple[dict[str, list], set]] = {}
    observer = Observer()
    for b in batches:
        for s, d, f, p in zip(b.column(0).to_pylist(), b.column(1).cast(pa.int64()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            v = readable(p)
            if v is not None and f is not None:
                own, done = files.setdefault((s, d, f), ({}, set()))
                observer.line(v, own, done)
                if len(done) > 16 * SKETCH:  # forgetting only costs time
                    done.clear()
                    for seen in own.values():
                        if len(seen[1]) > 4 * SKETCH:
                            seen[1] = set(sorted(seen[1])[:SKETCH])
        if len(files) > 2000:
            yield _rows(files)
            files = {}
    yield _rows(files)


def _rows(files: dict[tuple, tuple[dict[str, list], set]]) -> pa.RecordBatch:
    of = [key for key, (own, _) in files.items() for _ in own]
    members = [(p, k, sorted(c)[:SKETCH]) for own, _ in files.values() for p, (k, c) in own.items()]
    ends = pa.array([0, *accumulate(len(m[2]) for m in members)], pa.int32())
    content = pa.ListArray.from_arrays(ends, pa.array([x for m in members for x in m[2]], pa.int64()))
    date = pa.array([k[1] for k in of], pa.int64()).cast(pa.timestamp("us", tz="UTC"))
    columns = [pa.array([k[0] for k in of], pa.string()), date, pa.array([k[2] for k in of], pa.string()), pa.array([m[0] for m in members], pa.string()), pa.array([m[1] for m in members], pa.int32()), content]
    return pa.RecordBatch.from_arrays(columns, [*FILE, "path", "kinds", "content"])


_PARTIAL = "series string, file_date timestamp, file_name string, path string, kinds int, content array<long>"


def member_schemas(lines: DataFrame) -> DataFrame:
    """series, file_date, file_name, path, kinds (bit set), content (sketch): each member of each file.

    Counted inside each partition first; what is shuffled is one row per partition, file and member, so a file with a
    third of all lines costs no more than any other. Torn lines, lines that are no objects and lines without a file
    name are left out; lines delivered twice change nothing.
    """
    part = lines.select("series", F.col("file_date").cast("timestamp").alias("file_date"), "file_name", "payload").mapInArrow(_partial, _PARTIAL)
    both = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("content")))), 1, SKETCH)
    return part.groupBy(*FILE, "path").agg(F.bit_or("kinds").alias("kinds"), both.alias("content"))


def file_schemas(lines: DataFrame) -> DataFrame:
    """series, file_date, file_name, members: one row per file with its whole schema (as many entries as members)."""
    m = member_schemas(lines)
    return m.groupBy(*FILE).agg(F.collect_list(F.struct("path", "kinds", "content")).alias("members"))


def _likeness(a: tuple[int, set], b: tuple[int, set]) -> float:
    if a[0] and b[0] and a[0] != b[0]:
        return 0.0
    if not a[1] or not b[1]:
        return 0.25 if not a[1] and not b[1] else 0.0
    return len(a[1] & b[1]) / min(len(a[1]), len(b[1]))


def _assign(gain: dict[tuple[str, str], float]) -> list[tuple[str, str]]:
    """The pairs of old and new names that save most in all, each name in one pair at most.

    gain: what a pair saves against a delete and an add. Exact for any number of names (Hungarian method).
    """
    rows, cols = sorted({p[0] for p in gain}), sorted({p[1] for p in gain})
    if len(rows) > len(cols):
        return sorted((x, y) for y, x in _assign({(y, x): g for (x, y), g in gain.items()}))
    n, m = len(rows), len(cols)
    u, v, row_of, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            used[j] = True
            at, delta, to = row_of[j], float("inf"), 0
            for k in range(1, m + 1):
                if not used[k]:
                    cost = -gain.get((rows[at - 1], cols[k - 1]), 0.0) - u[at] - v[k]
                    if cost < least[k]:
                        least[k], way[k] = cost, j
                    if least[k] < delta:
                        delta, to = least[k], k
            for k in range(m + 1):
                if used[k]:
                    u[row_of[k]] += delta
                    v[k] -= delta
                else:
                    least[k] -= delta
            j = to
            if not row_of[j]:
                break
        while j:
            row_of[j], j = row_of[way[j]], way[j]
    return sorted(p for k in range(1, m + 1) if row_of[k] and (p := (rows[row_of[k] - 1], cols[k - 1])) in gain)


def _unsure(old: dict[str, tuple[int, set]], new: dict[str, tuple[int, set]]) -> list[tuple[str, str]]:
    """(old path, new path) of what edit_script may compare and sketches cannot tell, one of them being full."""
    gone, come = [p for p in old if p not in new], [p for p in new if p not in old]
    by: dict[tuple[bool, str], list[str]] = {}
    for p in come:
        head, _, name = p.rpartition(".")
        by.setdefault((True, head), []).append(p)
        by.setdefault((False, name), []).append(p)
    out = set()
    for p in gone:
        head, _, name = p.rpartition(".")
        for q in {*by.get((True, head), ()), *by.get((False, name), ())}:
            (k, a), (m, b) = old[p], new[q]
            if (not k or not m or k == m) and a and b and max(len(a), len(b)) >= SKETCH:
                out.add((p, q))
    return sorted(out)


def edit_script(
    old: dict[str, tuple[int, set]], new: dict[str, tuple[int, set]], exact: dict[tuple[str, str], float] | None = None
) -> list[tuple[str, str, str, float]]:
    """(change, old path, new path, cost) of the cheapest script from one schema to the next.

    Children of equal names are matched; a different kind is a retype (1). What lies below a member that was itself
    changed is not looked at. Members that are gone and members that are new are then paired at the least cost in all:
    in one parent as a rename (1 - likeness of content), under one name in different parents as a move (2 - likeness),
    if their kind is the same and at least SAME_CONTENT of their content; what is left is removed and added (1 each).
    exact has the likeness of pairs whose content is known beyond its sketch.
    """

    def likeness(x: str, y: str) -> float:
        return exact[x, y] if exact and (x, y) in exact else _likeness(old[x], new[y])

    def children(tree: dict) -> dict[str, list[str]]:
        below: dict[str, list[str]] = {}
        for p in tree:
            below.setdefault(p.rpartition(".")[0], []).append(p.rpartition(".")[2])
        return below

    was, now, out = children(old), children(new), []

    def step(parent: str) -> None:
        a, b = set(was.get(parent, [])), set(now.get(parent, []))
        at = lambda n: f"{parent}.{n}" if parent else n
        for n in sorted(a & b):
            k, m = old[at(n)][0], new[at(n)][0]
            if k and m and k != m:
                out.append(("retyped", at(n), at(n), 1.0))
            else:
                step(at(n))
        gone.extend(at(n) for n in a - b)
        come.extend(at(n) for n in b - a)

    gone: list[str] = []
    come: list[str] = []
    step("")
    head, name = (lambda p: p.rpartition(".")[0]), (lambda p: p.rpartition(".")[2])
    by: dict[tuple[bool, str], list[str]] = {}
    for y in come:
        by.setdefault((True, head(y)), []).append(y)
        by.setdefault((False, name(y)), []).append(y)
    like = {(x, y): s for x in gone for y in {*by.get((True, head(x)), ()), *by.get((False, name(x)), ())} if (s := likeness(x, y)) >= SAME_CONTENT}
    # a rename saves 1 + likeness, a move likeness; of equal savings a rename goes first
    pairs = _assign({(x, y): 1 + s if head(x) == head(y) else 0.99 * s for (x, y), s in like.items()})
    for x, y in pairs:
        out.append(("renamed", x, y, 1 - like[x, y]) if head(x) == head(y) else ("moved", x, y, 2 - like[x, y]))
    out.extend(("removed", x, "", 1.0) for x in sorted(set(gone) - {x for x, _ in pairs}))
    out.extend(("added", "", y, 1.0) for y in sorted(set(come) - {y for _, y in pairs}))
    return out


_SCRIPT = T.ArrayType(
    T.StructType(
        [T.StructField(n, t) for n, t in (("change", T.StringType()), ("old_path", T.StringType()), ("new_path", T.StringType()), ("cost", T.DoubleType()))]
    )
)


def _tree(members: object) -> dict[str, tuple[int, set]]:
    return {m["path"]: (m["kinds"], set(m["content"])) for m in members}


@F.pandas_udf(_SCRIPT)
def _scripts(old: pd.Series, new: pd.Series, exact: pd.Series) -> pd.Series:
    known = lambda xs: {(x["old_path"], x["new_path"]): x["likeness"] for x in xs} if xs is not None else None
    names = ("change", "old_path", "new_path", "cost")
    return pd.Series([[dict(zip(names, c)) for c in edit_script(_tree(a), _tree(b), known(x))] for a, b, x in zip(old, new, exact)])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("old_path", T.StringType()), T.StructField("new_path", T.StringType())])))
def _unsure_pairs(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([[{"old_path": p, "new_path": q} for p, q in _unsure(_tree(a), _tree(b))] for a, b in zip(old, new)])


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every distinct mark of the wanted members of a batch's lines."""
    observer = Observer()
    for b in batches:
        rows = set()
        for s, d, f, p, wanted in zip(b["series"], b["file_date"], b["file_name"], b["payload"], b["wanted"]):
            v = readable(p)
            if v is not None:
                own: dict[str, list] = {}
                observer.line(v, own, set())
                rows.update((s, d, f, w, m) for w in wanted if w in own for m in own[w][1])
        yield pd.DataFrame(list(rows), columns=[*FILE, "path", "mark"])


_EXACT = "array<struct<old_path: string, new_path: string, likeness: double>>"


def _exact_likeness(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """series, file_date, file_name, exact: likeness of each pair by all of its content, counted in Spark.

    Only the files of pairs are read again, and of them only the members concerned.
    """
    was = pairs.select("series", F.col("prev_date").alias("file_date"), F.col("prev_name").alias("file_name"), F.col("old_path").alias("path"))
    now = pairs.select(*FILE, F.col("new_path").alias("path"))
    wanted = was.unionByName(now).distinct().groupBy(*FILE).agg(F.collect_list("path").alias("wanted"))
    marks = lines.select(*FILE, "payload").join(wanted, FILE).mapInPandas(_contents, f"{_FILE}, path string, mark long").distinct()
    marks = staged(marks)
    key = [*FILE, "old_path", "new_path"]
    before = marks.select("series", F.col("file_date").alias("prev_date"), F.col("file_name").alias("prev_name"), F.col("path").alias("old_path"), "mark")
    a = pairs.join(before, ["series", "prev_date", "prev_name", "old_path"]).select(*key, "mark", F.lit(1).alias("side"))
    b = pairs.join(marks.withColumnRenamed("path", "new_path"), [*FILE, "new_path"]).select(*key, "mark", F.lit(2).alias("side"))
    each = a.unionByName(b).groupBy(*key, "mark").agg(F.bit_or("side").alias("side"))
    n = each.groupBy(*key).agg(F.expr("count_if(side = 3)").alias("common"), F.expr("count_if(side <> 2)").alias("x"), F.expr("count_if(side <> 1)").alias("y"))
    like = F.struct("old_path", "new_path", (F.col("common") / F.least("x", "y")).alias("likeness"))
    return n.groupBy(*FILE).agg(F.collect_list(like).alias("exact"))


def edit_scripts(lines: DataFrame, keep_schemas: DataFrame | None = None) -> DataFrame:
    """series, file_date, file_name, change, old_path, new_path, cost: each file against the one before it.

    Files of a series are ordered by date, then name, however late they arrive. Which file precedes which is found on
    the keys alone; the schemas are joined to it afterwards, so no series is gathered in one task with its content.
    Where a sketch is full, the members to be compared are read again and compared by all of their content.
    """
    s = keep_schemas if keep_schemas is not None else staged(file_schemas(lines))
    order = W.partitionBy("series").orderBy("file_date", "file_name")
    chain = s.select(*FILE).withColumn("prev_date", F.lag("file_date").over(order)).withColumn("prev_name", F.lag("file_name").over(order))
    chain = chain.where(F.col("prev_name").isNotNull())
    prev = s.select("series", F.col("file_date").alias("prev_date"), F.col("file_name").alias("prev_name"), F.col("members").alias("before"))
    both = chain.join(prev, ["series", "prev_date", "prev_name"]).join(s, FILE)
    full = F.exists("members", lambda m: F.size(m["content"]) >= SKETCH) | F.exists("before", lambda m: F.size(m["content"]) >= SKETCH)
    both = staged(_changed(both))
    pairs = both.where(full).select(*FILE, "prev_date", "prev_name", F.explode(_unsure_pairs("before", "members")).alias("p")).select("*", "p.*").drop("p")
    pairs = staged(pairs)
    if pairs.isEmpty():  # all content fits its sketch
        both = both.withColumn("exact", F.lit(None).cast(_EXACT))
    else:
        both = both.join(_exact_likeness(lines, pairs), FILE, "left")
    return both.select(*FILE, F.explode(_scripts("before", "members", "exact")).alias("c")).select(*FILE, "c.*")


def _changed(both: DataFrame) -> DataFrame:
    """Files with another schema than the one before, content left only with members that are gone or new."""
    shape = lambda c: F.array_sort(F.transform(c, lambda m: F.struct(m["path"].alias("path"), m["kinds"].alias("kinds"))))
    both = both.where(shape("before") != shape("members"))
    none = F.array().cast("array<long>")
    left = lambda c, other: F.transform(c, lambda m: F.struct(m["path"].alias("path"), m["kinds"].alias("kinds"), F.when(F.array_contains(F.col(other)["path"], m["path"]), none).otherwise(m["content"]).alias("content")))
    return both.withColumns({"before": left("before", "members"), "members": left("members", "before")})


def found(lines: DataFrame) -> DataFrame:
    """p2_found: added, removed, renamed and retyped members with the file that brought the change.

    The report knows no moves: a member that moved was removed in one place and added in another.
    """
    one = lambda change, old, new: F.struct(F.lit(change).alias("change"), old.alias("old_path"), new.alias("new_path"))
    old, new, none = F.col("old_path"), F.col("new_path"), F.lit("")
    both = F.when(F.col("change") == "moved", F.array(one("removed", old, none), one("added", none, new))).otherwise(F.array(F.struct("change", "old_path", "new_path")))
    return edit_scripts(lines).select("file_name", F.explode(both).alias("c")).select("file_name", "c.*")


def _leaves(v: dict) -> Iterator[tuple[str, tuple[int, ...], object]]:
    """(path, entry, value) of what is no object: entry holds the place in each list on the way, lists adding no name.

    Lists of objects are taken apart, lists of plain values come whole; null is nothing.
    """
    stack: list[tuple[str, tuple[int, ...], object]] = [("", (), v)]
    while stack:
        path, entry, x = stack.pop()
        if isinstance(x, dict) and x:
            stack.extend((f"{path}.{k}" if path else k, entry, y) for k, y in x.items())
        elif isinstance(x, list) and any(isinstance(y, dict) for y in x):
            stack.extend((path, (*entry, i), y) for i, y in enumerate(x))
        elif path and x is not None:
            yield path, entry, x


def _place(entry: tuple[int, ...]) -> tuple[int, ...]:
    """entry without zeros at its end: the first entry stands for the list."""
    while entry and not entry[-1]:
        entry = entry[:-1]
    return entry


def _text(x: object) -> str:
    return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def _number(text: str | None) -> float | None:
    m = _LEADING.search(text) if text is not None else None
    return float(m.group(0)) if m else None


def into_row(v: dict, common: Callable[[str], str]) -> tuple:
    """The columns of consistent_table for one line, common giving the common path of each path of its file.

    Nothing is left out: what finds its column taken, or stands in a further entry of a list, is in components or in
    extra, there with its place in the list ([1] is the second) and, if two members meet, under its own path.
    """
    taken: dict[tuple[str, tuple[int, ...]], tuple[str, str]] = {}
    rest: dict[str, str] = {}

    def keep(path: str, entry: tuple[int, ...], text: str) -> None:
        key = path + "".join(f"[{i}]" for i in entry)
        n = 1
        while (at := key if n == 1 else f"{key}#{n}") in rest:
            n += 1
        rest[at] = text

    spread, seen = [], set()
    for path, entry, x in _leaves(v):
        to = common(path)
        if to.startswith(COMPONENT):
            seen.add(_place(entry))
        many = enumerate(x) if isinstance(x, list) and to in COMMON else None
        spread.extend((to != path, path, to, (*entry, i), y) for i, y in many if y is not None) if many else spread.append((to != path, path, to, entry, x))
    for _, path, to, entry, x in sorted(spread, key=lambda r: r[:4]):
        entry = _place(entry)
        if to not in COMMON or (entry and not to.startswith(COMPONENT)):
            keep(path if (to, entry) in taken else to, entry, _text(x))
            taken.setdefault((to, entry), (path, ""))
        elif (to, entry) in taken:
            keep(path, entry, _text(x))
        else:
            taken[to, entry] = (path, _text(x))
    at = lambda p, entry=(): taken.get((p, entry), ("", None))[1]
    entries = sorted({e for p, e in taken if p in COMMON and p.startswith(COMPONENT)})
    part = lambda e: {
        "place": "".join(f"[{i}]" for i in e), "formula": at(COMPONENT + "formula", e), "concentration": _number(at(COMPONENT + "concentration", e)), "electrolyte_ph": _number(at(COMPONENT + "electrolyte_ph", e)),
    }
    first = part(min(seen, default=()))
    return (
        at("type"), _number(at("value")), at("unit_label"), _number(at("condition.current_density")), _number(at("condition.temperature_C")),
        first["formula"], first["concentration"], first["electrolyte_ph"], [part(e) for e in entries], json.dumps(dict(sorted(rest.items())), ensure_ascii=False, separators=(",", ":")),
    )


_COLUMNS = {
    "type": "string", "value": "double", "unit_label": "string", "current_density": "double", "temperature_c": "double", "formula": "string",
    "concentration": "double", "electrolyte_ph": "double", "components": "array<struct<place: string, formula: string, concentration: double, electrolyte_ph: double>>", "extra": "string",
}


def _table_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        which, rows = [], []
        for i, (payload, pairs) in enumerate(zip(b["payload"], b["names"])):
            v = readable(payload)
            if v is not None and any(True for _ in _leaves(v)):
                to = {p["path"]: p["common"] for p in pairs} if pairs is not None else {}
                which.append(i)
                rows.append(into_row(v, lambda p: to.get(p, p)))  # noqa: B023
        out = b[["line_id", *FILE]].iloc[which].reset_index(drop=True)
        for n, c in enumerate(_COLUMNS):
            out[c] = pd.Series([r[n] for r in rows], dtype=object)
        yield out


#: Members of the common schema and what holds them.
_COMMON_NODES = {p.rsplit(".", n)[0] for p in COMMON for n in range(p.count(".") + 1)}


def _rank(path: str) -> tuple[bool, int]:
    """How much a path tells of the common schema: whether it is a member, else how far it leads into it."""
    parts = path.split(".")
    return path in COMMON, sum(".".join(parts[: n + 1]) in _COMMON_NODES for n in range(len(parts)))


def _resolve(names: dict[str, str], path: str) -> str:
    """path with its longest beginning that names knows replaced."""
    head, tail = path, ""
    while head:
        if head in names:
            return names[head] + tail
        head, _, last = head.rpartition(".")
        tail = f".{last}{tail}"
    return path


def common_path(forward: dict[str, str], backward: dict[str, str], path: str) -> str:
    """The common path of a path of one file: itself, what it was before or what it becomes later, the nearest of these
    that is in the common schema; if none is, what leads furthest into it, the earliest name first."""
    if path in COMMON:
        return path
    return max(_resolve(forward, path), _resolve(backward, path), key=_rank)


def compose(names: dict[str, str], pairs: list[tuple[str, str]]) -> dict[str, str]:
    """names after the renames and moves (from, to) of one script: what each path went by best, seen from the other end.

    A member of the common schema keeps its own name; a removed member keeps what is known of its path, as optional
    members come and go. Members below a renamed one go with it.
    """
    once: dict[str, str] = {}
    for a, b in sorted(pairs):
        if a not in once and b not in once.values():
            once[a] = b
    out, arriving = {}, tuple(f"{b}." for b in once.values())
    moved = {}
    for path, name in names.items():
        to = _resolve(once, path)
        if to != path:
            moved[to] = name
        elif path not in once.values() and not path.startswith(arriving):  # else it is another member of that name, gone before
            out[path] = name
    out |= moved
    for a, b in once.items():
        out[b] = b if b in COMMON else max(_resolve(names, a), b, key=_rank)
    return out


_PAIRS = "array<struct<path: string, common: string>>"
_NAMES = f"{_FILE}, pairs {_PAIRS}, forward {_PAIRS}, backward {_PAIRS}"


def _walk(back: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Follows the scripts of each series through its files, which come in order (from the last if back)."""
    column = "backward" if back else "forward"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series: object = run  # no series yet; what is carried from batch to batch is the names of one file
        names: dict[str, str] = {}
        for b in batches:
            out = []
            for s, pairs in zip(b["series"], b["pairs"]):
                if s != series:
                    series, names = s, {}
                pairs = [(p["path"], p["common"]) for p in pairs] if pairs is not None else []
                if not back:
                    names = compose(names, pairs) if pairs else names
                out.append([{"path": p, "common": c} for p, c in names.items()])
                if back:
                    names = compose(names, [(y, x) for x, y in pairs]) if pairs else names
            yield b.assign(**{column: pd.Series(out, index=b.index, dtype=object)})[[*FILE, "pairs", "forward", "backward"]]

    return run


def _own_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tree = lambda ps: {p["path"]: p["common"] for p in ps}
    for b in batches:
        rows = []
        for s, d, f, ahead, back, paths in zip(b["series"], b["file_date"], b["file_name"], b["forward"], b["backward"], b["paths"]):
            before, later = tree(ahead), tree(back)
            rows.extend((s, d, f, p, common_path(before, later, p)) for p in paths)
        yield pd.DataFrame(rows, columns=[*FILE, "path", "own"])


def projections(lines: DataFrame) -> DataFrame:
    """series, file_date, file_name, path, common: what each path of each file is called in the common table.

    Renames and moves of the scripts are composed along each series, on full paths; two passes over the files in order
    carry no more than the names of one file, so any number of renames in a row is followed. Only a path that its own
    series never ties to the common schema (the series opens with it, or the member was missing in the file between)
    is read as most of the other series have it, where the file has no other member of that name.
    """
    s = staged(file_schemas(lines))
    e = edit_scripts(lines, s).where("change in ('renamed', 'moved')")
    changes = e.groupBy(*FILE).agg(F.collect_list(F.struct(F.col("old_path").alias("path"), F.col("new_path").alias("common"))).alias("pairs"))
    none = F.lit(None).cast(_PAIRS)
    files = s.select(*FILE).join(changes, FILE, "left").withColumn("forward", none).withColumn("backward", none)
    ahead = files.repartition("series").sortWithinPartitions("series", "file_date", "file_name").mapInPandas(_walk(False), _NAMES)
    down = [F.col("series"), F.col("file_date").desc(), F.col("file_name").desc()]
    both = ahead.repartition("series").sortWithinPartitions(*down).mapInPandas(_walk(True), _NAMES).drop("pairs")
    paths = s.select(*FILE, F.col("members.path").alias("paths"))
    own = staged(both.join(paths, FILE).mapInPandas(_own_paths, f"{_FILE}, path string, own string"))
    known = own.where(F.col("own").isin(COMMON))
    nodes = sorted(_COMMON_NODES)
    votes = own.where(F.col("own").isin(nodes) & ~F.col("path").isin(nodes)).groupBy("path", "own").agg(F.count_distinct("series").alias("n"))
    most = votes.groupBy("path").agg(F.max_by("own", F.struct("n", "own")).alias("node"), F.max("n").alias("top"), F.sum("n").alias("all")).where("2 * top > all")
    most = staged(most.select(F.col("path").alias("head"), "node"))
    open_ = own.where(~F.col("own").isin(COMMON))
    words = open_.select("path").distinct().withColumn("other", F.col("path"))
    for _ in range(3):  # each round ends one level deeper in the common schema, which has three
        heads = words.withColumn("head", F.explode(F.expr("transform(sequence(1, size(split(other, '[.]'))), n -> array_join(slice(split(other, '[.]'), 1, n), '.'))")))
        near = heads.join(most, "head").groupBy("path").agg(F.max_by(F.struct("head", "node"), F.length("head")).alias("m"))
        words = words.join(near, "path", "left").select("path", F.coalesce(F.concat("m.node", F.expr("substring(other, length(m.head) + 1)")), F.col("other")).alias("other"))
    open_ = open_.join(words.where(F.col("other").isin(COMMON)), "path", "left")
    filled = known.select(*FILE, F.col("own").alias("other")).distinct().withColumn("filled", F.lit(True))
    rest = open_.join(filled, [*FILE, "other"], "left").withColumn("own", F.coalesce(F.when(F.col("filled").isNull(), F.col("other")), F.col("own")))
    return known.unionByName(rest.select(*FILE, "path", "own")).withColumnRenamed("own", "common")


def consistent_table(lines: DataFrame) -> DataFrame:
    """One table of all readable lines: line_id, file, the members of the common schema, components, the rest in extra.

    Every file's projection is the scripts of its series compiled to a map from its own paths to the common ones (per
    file and path, at most its members), joined to its lines. Retyped members are brought to one type by their leading number.
    components has every electrolyte component in the order of the list, with its place as keys of extra write it;
    formula, concentration and electrolyte_ph are those of the first that holds anything. extra is a JSON object of
    all else. A line delivered twice comes once.
    """
    names = projections(lines).where("path <> common").groupBy(*FILE).agg(F.collect_list(F.struct("path", "common")).alias("names"))
    return _joined(lines, names).mapInPandas(_table_rows, f"line_id long, {_FILE}, " + ", ".join(f"{c} {t}" for c, t in _COLUMNS.items())).distinct()


def _joined(lines: DataFrame, of_files: DataFrame) -> DataFrame:
    """line_id, file, payload of all lines with what of_files has for their file, null if nothing."""
    f = of_files.select(*(F.col(c).alias(f"of_{c}") for c in FILE), *(c for c in of_files.columns if c not in FILE))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in FILE]
    return lines.select("line_id", *FILE, "payload").join(f, same, "left").drop(*(f"of_{c}" for c in FILE))
