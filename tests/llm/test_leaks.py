"""Problem 7: planted leaks with small changes, decoys, exact containment, recall of passages of just a third."""

import random
import time

import pytest

from factspan.llm import leaks as S

VOCAB = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te", "vo", "za", "pe", "du", "fi") for b in ("nar", "bel", "dic", "fos", "gum", "hil", "jet", "kov", "lum", "mis")]
TELL = "Answer briefly, and state how sure you are."


def corpus(seed=4, n=300):
    r = random.Random(seed)
    items = [(i, "s", (TELL + " " if i % 2 else "") + " ".join(r.choice(VOCAB) for _ in range(r.randint(28, 80))), "x") for i in range(40)]
    docs, want = [], set()
    for d in range(n):
        fill = lambda k: " ".join(r.choice(["the", "cell", "was", "held", "at", "open", "for", "an", "hour", "then", "run"]) for _ in range(k))
        kind, i = r.choice("whole part short tell none".split()), r.randrange(len(items))
        ws = items[i][2].removeprefix(TELL).split()
        if kind == "whole":
            ws = [r.choice([w, w, w, w, w, w, w, w, w.upper(), "also " + w]) for w in ws]
            body = r.choice([" ".join(ws), "\n".join(ws), " | ".join(ws)])
            want.add((d, i))
        elif kind == "part":
            k = int(len(ws) * 0.5)
            a = r.randrange(len(ws) - k)
            part = ws[a : a + k]
            part[k // 2] = part[k // 2][:2] + "­" + part[k // 2][2:]
            part[k // 3] = part[k // 3].replace("a", "а").replace("o", "о")
            body = " ".join(part)
            want.add((d, i))
        else:
            body = {"short": " ".join(ws[: len(ws) // 6]), "tell": TELL, "none": fill(5)}[kind]
        docs.append((d, f"{fill(30)} {body} {fill(30)}"))
    return docs + [(900, None), (901, ""), (902, " \n"), (903, fill(60_000))], items, want


def frames(spark, docs, items):
    return spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, suite string, text string, answer string")


def test_planted(spark):
    docs, items, want = corpus()
    got = {tuple(r) for r in S.found(*frames(spark, docs, items)).collect()}
    assert got == want


def test_joined_item_texts_give_the_same(spark):
    docs, items, want = corpus(9, 80)
    assert {tuple(r) for r in S.search(*frames(spark, docs, items), max_item_chars=0).collect()} == want


@pytest.mark.parametrize("n", [3, 9, 28, 30, 33, 45, 60, 100, 300])
def test_needed_shingles(n):
    """What a third of n words keeps of its shingles if every fifth word is changed."""
    size = -(-n // 3)
    ws = [f"w{i}" for i in range(size)]
    changed = int(0.2 * size + 1e-9)
    step = (size - changed) // (changed + 1)
    kept = list(ws)
    for k in range(changed):
        kept[(k + 1) * (step + 1) - 1] = "x"
    left = {tuple(ws[i : i + 3]) for i in range(size - 2)} & {tuple(kept[i : i + 3]) for i in range(size - 2)}
    assert S.needed(n) <= max(1, len(left))


def test_repeated_items_and_short_texts(spark):
    docs = [(1, "x " * 20 + "alpha beta gamma delta epsilon zeta eta theta iota"), (2, "one two three four five six seven eight nine"), (3, "alpha"), (3, None)]
    items = [(7, "s", "alpha beta gamma delta epsilon zeta eta theta iota", "a"), (7, "r", "one two three four five six seven eight nine", "a"), (8, "s", "alpha", "a"), (9, "s", " ", "a")]
    d, i = frames(spark, docs, items)
    assert {tuple(r) for r in S.found(d, i).collect()} == {(1, 7), (2, 7)}
    assert [tuple(r) for r in S.leaked_items(d, i).collect()] == [(7, "r", 2)]


def test_a_third_with_changed_words(spark):
    """Passages of just a third of an item with every fifth word changed: the sieve must let at least nine in ten pass."""
    r = random.Random(8)
    items = [(i, "s", " ".join(r.choice(VOCAB) for _ in range(r.choice([33, 60, 100]))), "x") for i in range(60)]
    docs, want = [], set()
    for d in range(240):
        i = d % len(items)
        ws = items[i][2].split()
        k = -(-len(ws) // 3)
        a = r.randrange(len(ws) - k)
        part = ws[a : a + k]
        for at in range(2, k - 1, 5):
            part[at] = "other"
        docs.append((d, "the cell was held " * 8 + " ".join(part) + " then it ran" * 8))
        if S.held(ws, S.words(docs[-1][1])) >= S.SHARE - 1e-9:
            want.add((d, i))
    got = {tuple(x) for x in S.found(*frames(spark, docs, items)).collect()}
    assert all(S.held(items[i][2].split(), S.words(docs[d][1])) >= S.SHARE - 1e-9 for d, i in got)
    assert len(want) > 150 and len(got & want) >= 0.9 * len(want), (len(want), len(got & want))


def test_empty(spark):
    docs, items, _ = corpus(1, 5)
    d, i = frames(spark, docs, items)
    assert S.found(d.limit(0), i).count() == 0 and S.found(d, i.limit(0)).count() == 0


def test_windows_hold_the_minima():
    texts = [["a", "b", "c", "d", "e", "f", "g", "h"], [], ["x", "y"], ["p", "q", "r", "s"]]
    w = S.Windows(texts, {})
    at, size, text = w.places(3, 2)
    assert text.tolist() == [0, 0, 0, 3] and w.count.tolist() == [6, 0, 0, 2] and size.tolist() == [3, 3, 3, 2]
    m, where = w.minima(at, size)
    for k in range(S.K):
        v = w.shingles * S._A[k] + S._B[k]
        v ^= v >> S.np.uint64(31)
        assert m[k].tolist() == [v[0:3].min(), v[2:5].min(), v[3:6].min(), v[10:12].min()] and v[where[k]].tolist() == m[k].tolist()


def plain_contained(item, doc, share):
    n, width = len(item) - 1, max(1, int(S.np.ceil(len(item) * share - 1e-9)) - 1)
    pairs = [tuple(item[i : i + 2]) for i in range(n)]
    reach = width + width // 4 + S.GAP
    for j in range(len(doc) - 1):
        here = {tuple(doc[k : k + 2]) for k in range(j, min(j + reach, len(doc) - 1))}
        if any(sum(p in here for p in pairs[i : i + width]) >= S.CONTAINED * width - 1e-9 for i in range(n - width + 1)):
            return True
    return False


def test_containment_is_the_plain_count():
    r = random.Random(3)
    for _ in range(300):
        item = [r.choice("abcdefgh") for _ in range(r.randint(2, 30))]
        doc = [r.choice("abcdefghxyz") for _ in range(r.randint(0, 60))]
        assert S.contained(item, doc, 1 / 3) == plain_contained(item, doc, 1 / 3)


def test_equal_words_end_soon():
    start = time.time()
    assert S.contained(["a"] * 60, ["a"] * 60_000) and S.held(["a"] * 60, ["a"] * 60_000, 1 / 3) >= 1 / 3
    assert time.time() - start < 3


@pytest.mark.parametrize("doc,low,high", [("a b c d e f g h", 1, 1), ("a b x d e f g h", 1, 1), ("a b c d", 0.5, 0.5), ("a b zz zz zz zz zz c d", 0.25, 0.25), ("h g f e d c b a", 0, 0), ("", 0, 0)])
def test_held(doc, low, high):
    assert low <= S.held("a b c d e f g h".split(), doc.split()) <= high
