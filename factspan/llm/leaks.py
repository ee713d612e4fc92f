"""Evaluation texts leaking into training text (problem 7), by size-partitioned MinHash containment search.

Items are partitioned by their number of words. Any passage that counts as a leak of an item holds a window of a third
of the smallest item of its partition, so in each partition the windows of that size of items and documents are
compared: each of K hash functions keeps a window's smallest shingle, and the share of functions that agree estimates
how much of the item's window the document's window contains. Windows without any shingle of an item cannot agree and
are left out before anything is compared or shuffled. Candidates are verified by exact containment of the shingles of
an item's window in a window of the document, and then on the order of their words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspan.session import staged

#: Words in a shingle. Three, not five: one changed word would spoil half of a window of ten words otherwise.
SHINGLE = 3
#: Hash functions, and how many must agree in one window for a candidate.
K, AGREE = 16, 2
#: Bounds of the size partitions grow by this factor.
GROWTH = 1.7
#: Share of an item's words that a running passage must hold.
SHARE = 1 / 3
#: Words in a shingle of the exact containment, and the share of an item window's shingles that must be contained. Two
#: words in ten may be changed; each changed word spoils two of these.
PAIR, CONTAINED = 2, 0.5
#: A small change leaves fewer than so many words between two kept pairs, and this share of a passage's words in place.
GAP, IN_PLACE = 4, 0.8
#: Windows of a document start every so many-th part of a window.
STEPS = 3
#: Bits of the filter of item shingles that every task gets: 2 ** BITS / 8 bytes, 8 MB, however many items there are.
BITS = 26
#: Item texts that may be sent to every task, in characters; beyond, they are joined to the documents that ask for them.
MAX_ITEM_CHARS = 30_000_000
#: Copies of the items' keys over which documents with the same passage are spread.
SALTS = 8
#: Openings that so many items share are instructions.
SHARED = 3

# Letters of other scripts that look like Latin ones.
_LOOKALIKE = str.maketrans("аеорсухіјѕһԁԛѡкмтвнзαορνικτυχε", "aeopcyxijshdqwkmtbhzaopviktuxe")
_SENTENCE = regex.compile(r"^.*?[.:!?](?=\s|$)", regex.S)
_HYPHEN = re.compile(r"(?<=[^\W\d_])-\s*(?=[^\W\d_])")


class _Letters(dict):
    """What each character of a decomposed text becomes: letters and digits themselves, marks and invisible ones nothing,
    blanks a blank, hyphens a hyphen, all else a point. Filled as characters come up."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in ("Mn", "Cf"):
            out = ""
        elif kind[0] in "LN":
            out = c.translate(_LOOKALIKE)
        else:
            out = " " if c.isspace() else "-" if c in "-‐‑" else "."
        self[code] = out
        return out


_LETTERS = _Letters()


def words(text: str) -> list[str]:
    """The words of a text without regard to case, accents, look-alike letters, invisible characters, hyphens, layout."""
    text = text.lower() if text.isascii() else unicodedata.normalize("NFKD", text).lower()
    text = text.translate(_LETTERS)
    if "-" in text:
        text = _HYPHEN.sub("", text).replace("-", " ")
    return text.replace(".", " ").split()


_A = np.array([xxhash.xxh64_intdigest(f"a{i}") | 1 for i in range(K)], dtype=np.uint64)
_B = np.array([xxhash.xxh64_intdigest(f"b{i}") for i in range(K)], dtype=np.uint64)
#: Words of documents that a task works on at once, and windows whose minima it takes at once.
CHUNK, BLOCK = 150_000, 4_000


class Windows:
    """The shingles of several texts laid end to end, and the K minima of windows that stay inside a text."""

    def __init__(self, texts: list[list[str]], known: dict[str, int]) -> None:
        for ws in texts:
            for w in ws:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
        marks = np.fromiter((known[w] for ws in texts for w in ws), dtype=np.uint64)
        lengths = np.fromiter((len(ws) for ws in texts), dtype=np.int64, count=len(texts))
        self.start = np.cumsum(lengths) - lengths
        self.count = np.maximum(lengths - SHINGLE + 1, 0)
        n = max(len(marks) - SHINGLE + 1, 0)
        h = np.zeros(n, dtype=np.uint64)
        for i in range(SHINGLE):
            h = (h ^ marks[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        self.shingles = h

    def bits(self) -> np.ndarray:
        """The bit of the filter that each shingle has."""
        return (self.shingles >> np.uint64(64 - BITS)).astype(np.int64)

    def places(self, width: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first shingle, shingles, text) of each window; windows start every step shingles and at the last possible place.

        A text of fewer shingles than a window is one window; one without any shingle has none.
        """
        long, short = np.flatnonzero(self.count >= width), np.flatnonzero((self.count > 0) & (self.count < width))
        room = self.count[long] - width
        n = room // step + 1 + (room % step > 0)
        text = np.repeat(long, n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = self.start[text] + np.minimum(at * step, np.repeat(room, n))
        return np.r_[at, self.start[short]], np.r_[np.full(len(at), width), self.count[short]], np.r_[text, short]

    def minima(self, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(K, windows): the smallest value of each function in each window, and the place of the shingle that has it."""
        least, where = np.zeros((K, len(at)), dtype=np.uint64), np.zeros((K, len(at)), dtype=np.int64)
        width = int(size.max()) if len(size) else 0
        block = max(1, BLOCK * 32 // max(width, 1))
        for a in range(0, len(at), block):
            z = slice(a, a + block)
            place = at[z, None] + np.minimum(np.arange(width), size[z, None] - 1)
            h = self.shingles[place]
            for k in range(K):
                v = h * _A[k] + _B[k]
                v ^= v >> np.uint64(31)
                best = v.argmin(axis=1)[:, None]
                least[k, z] = np.take_along_axis(v, best, 1)[:, 0]
                where[k, z] = np.take_along_axis(place, best, 1)[:, 0]
        return least, where


def _keyed(minima: np.ndarray, part: int) -> np.ndarray:
    """int64 keys that also tell the function and the partition."""
    salt = np.arange(K, dtype=np.uint64)[:, None] + np.uint64(part * K + 1)
    m = (minima ^ (salt * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xA0761D6478BD642F)
    return (m >> np.uint64(1)).astype(np.int64)


def size_part(n: int) -> int:
    """The partition of an item of so many words."""
    return max(0, int(np.floor(np.log(max(n, 1)) / np.log(GROWTH) + 1e-9)))


def part_width(part: int) -> int:
    """Shingles in a window of a partition: those of a third of its smallest item, one at least."""
    return max(1, int(np.ceil(np.ceil(GROWTH**part) * SHARE)) - SHINGLE + 1)


def bare_items(items: DataFrame) -> DataFrame:
    """item_id, part_id, text: items without the instruction sentence that SHARED or more of them open with.

    Null and blank texts have no row; an item given with several texts has a row and a part_id for each.
    """

    def opening(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            first = [m.group(0) if (m := _SENTENCE.match(t.strip())) else "" for t in b["text"]]
            rest = [t.strip()[len(f) :] for t, f in zip(b["text"], first)]
            yield pd.DataFrame({"item_id": b["item_id"], "text": b["text"], "first": [" ".join(words(f)) for f in first], "rest": rest})

    src = items.where("item_id is not null and trim(text) <> ''").selectExpr("cast(item_id as long) as item_id", "text").distinct()
    o = src.mapInPandas(opening, "item_id long, text string, first string, rest string")
    shared = o.where("first <> ''").groupBy("first").agg(F.countDistinct("item_id").alias("n")).where(F.col("n") >= SHARED)
    o = o.join(shared.select("first", F.lit(True).alias("told")), "first", "left")
    bare = F.when(F.col("told") & (F.length(F.trim("rest")) > 0), F.col("rest")).otherwise(F.col("text"))
    return o.select("item_id", F.xxhash64("item_id", "text").alias("part_id"), bare.alias("text"))


def needed(n: int) -> int:
    """Shingles that are left of a SHARE of n words with one word in five changed, as far apart as can be."""
    size = int(np.ceil(n * SHARE - 1e-9))
    changed = int((1 - IN_PLACE) * size + 1e-9)
    return max(1, size - changed - (SHINGLE - 1) * (changed + 1))


def item_keys(bare: DataFrame) -> DataFrame:
    """part, key, part_id, need: the keys of all windows of each item in its own size partition and, as part -1, its shingles.

    need: shingles a document must have in common with the item (needed).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [words(t) for t in b["text"]]
            part = np.array([size_part(len(ws)) for ws in texts])
            for p in np.unique(part):
                own = np.flatnonzero(part == p)
                win = Windows([texts[i] for i in own], {})
                at, size, text = win.places(part_width(int(p)), 1)
                k = _keyed(win.minima(at, size)[0], int(p))
                who = np.broadcast_to(b["part_id"].to_numpy()[own][text], k.shape)
                yield pd.DataFrame({"part": int(p), "key": k.ravel(), "part_id": who.ravel(), "need": 0}).drop_duplicates()
            win = Windows(texts, {})
            inside = [(a, a + n) for a, n in zip(win.start, win.count)]
            for i, (a, z), ws in zip(b["part_id"], inside, texts):
                yield pd.DataFrame({"part": -1, "key": np.unique(win.shingles[a:z]).view(np.int64), "part_id": i, "need": needed(len(ws))})

    return bare.mapInPandas(run, "part int, key long, part_id long, need int")


def shingle_filter(bare: DataFrame) -> np.ndarray:
    """A bit for each shingle of the items, as bytes: at most 2 ** BITS bits reach the driver, by words of 64 of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            win = Windows([words(t) for t in b["text"]], {})
            inside = np.concatenate([np.arange(a, a + n) for a, n in zip(win.start, win.count)] or [np.zeros(0, dtype=np.int64)])
            bit = np.unique(win.bits()[inside])
            at, first = np.unique(bit >> 6, return_index=True)
            word = np.bitwise_or.reduceat(np.uint64(1) << (bit & 63).astype(np.uint64), first) if len(bit) else np.zeros(0, dtype=np.uint64)
            yield pd.DataFrame({"at": at, "word": word.view(np.int64)})

    got = bare.select("text").mapInPandas(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()
    out = np.zeros(1 << (BITS - 6), dtype=np.int64)
    out[got["at"].to_numpy(np.int64)] = got["word"].to_numpy(np.int64)
    return out


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[int], list[list[str]], Windows]]:
    """Documents of CHUNK words or, if one alone is longer, of one document, with their windows."""
    known: dict[str, int] = {}
    ids, texts, size = [], [], 0
    for b in batches:
        for d, t in zip(b["doc_id"], b["text"]):
            ids.append(d)
            texts.append(words(t))
            size += len(texts[-1])
            if size >= CHUNK:
                yield ids, texts, Windows(texts, known)
                ids, texts, size = [], [], 0
                known = known if len(known) < 1_000_000 else {}
    if ids:
        yield ids, texts, Windows(texts, known)


def contained(item: list[str], doc: list[str], share: float = SHARE) -> bool:
    """Whether some window of a share of the item's words has CONTAINED of its shingles in one window of the document.

    Exact, on shingles of PAIR words as they are: for each window of the document that starts with one of the item's
    shingles and is a fourth longer than the item's window, the item's shingles in it are marked, and the item's
    windows with enough marks are sought.
    """
    n = len(item) - PAIR + 1
    if n < 1:
        return False
    width = window(len(item), share)
    reach = width + width // 4 + GAP
    where: dict[tuple[str, ...], list[int]] = {}
    for i in range(n):
        where.setdefault(tuple(item[i : i + PAIR]), []).append(i)
    met = [(j, at) for j in range(len(doc) - PAIR + 1) if (at := where.get(tuple(doc[j : j + PAIR])))]
    place = np.array([j for j, _ in met])
    need, block = CONTAINED * width - 1e-9, max(1, 4_000_000 // n)
    for a in range(0, len(met), block):
        ends = np.searchsorted(place, place[a : a + block] + reach)
        last = int(ends[-1])
        marks = np.zeros((last - a + 1, n), dtype=np.int32)
        for r in range(a, last):
            marks[r - a + 1, met[r][1]] = 1
        total = marks.cumsum(axis=0)
        inside = np.concatenate([np.zeros((len(ends), 1), dtype=np.int32), (total[ends - a] - total[np.arange(len(ends))] > 0).cumsum(axis=1)], axis=1)
        if (inside[:, width:] - inside[:, : n - width + 1]).max() >= need:
            return True
    return False


def window(n: int, share: float) -> int:
    """Shingles of PAIR words in a share of an item of n words."""
    return max(1, int(np.ceil(n * share - 1e-9)) - PAIR + 1)


def enough_shared(item: list[str], pairs: set, there: set, share: float) -> bool:
    """Whether contained() can be true at all: as many shingles as it wants of a window stand somewhere in the document.

    An item that repeats shingles has fewer distinct ones than places, so it always may be.
    """
    return len(pairs) < len(item) - PAIR + 1 or len(pairs & there) >= CONTAINED * window(len(item), share) - 1e-9


def held(item: list[str], doc: list[str], enough: float = 1.0) -> float:
    """The largest share of an item's words that a document holds as one running passage; enough ends the search.

    Pairs of neighbouring words that stand in both are linked to a passage as long as at most GAP - 1 words of either
    side lie between two of them, at the same distance give or take two; the item's words from the passage's first to
    its last count, if at least IN_PLACE of them are in place. A place of the item and the document has one passage
    that ends there, the best, so the work grows with the pairs in common alone.
    """
    n = len(item)
    where: dict[tuple[str, str], list[int]] = {}
    for i in range(n - 1):
        where.setdefault((item[i], item[i + 1]), []).append(i)
    rows: list[tuple[int, dict[int, tuple[int, int]]]] = []  # document word, by last item word: first item word, item words in place
    best = 0.0
    for j in range(len(doc) - 1):
        at = where.get((doc[j], doc[j + 1]))
        if not at:
            continue
        rows = [r for r in rows if j - r[0] <= GAP]
        new: dict[int, tuple[int, int]] = {}
        for i in at:
            first, got = i, 2
            for d, ends in rows:
                gj = j - d
                for gi in range(max(0, gj - 2), min(GAP, gj + 2) + 1):
                    if (c := ends.get(i - gi)) and (more := c[1] + min(2, 1 + gi)) > got:
                        first, got = c[0], more
            new[i + 1] = (first, got)
            span = i + 2 - first
            if got >= IN_PLACE * span:
                best = max(best, span / n)
        if best >= enough:
            return best
        rows.append((j + 1, new))
    return best


def _candidates(docs: DataFrame, bare: DataFrame) -> DataFrame:
    """doc_id, part_id: documents that agree with an item in AGREE minima and have as many of its shingles as it needs.

    One pass over the documents gives the minima of all windows with a shingle of an item, each once per document, and
    the shingles of items themselves; nothing else is shuffled. Agreement and exact containment are counts over joins.
    """
    keys = staged(item_keys(bare))
    parts = sorted(r["part"] for r in keys.where("part >= 0").select("part").distinct().collect())  # one row per size partition: logarithmic in the longest item
    sent = docs.sparkSession.sparkContext.broadcast(shingle_filter(bare))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filter_ = sent.value
        for ids, _, win in _chunks(batches):
            bit = win.bits()
            hit = (filter_[bit >> 6] >> (bit & 63)) & 1
            hit[np.setdiff1d(np.arange(len(hit)), np.concatenate([np.arange(a, a + n) for a, n in zip(win.start, win.count)]), assume_unique=True)] = 0
            upto = np.r_[0, np.cumsum(hit)]
            if not upto[-1]:
                continue
            who, at = np.array(ids), np.flatnonzero(hit)
            text = np.searchsorted(win.start, at, side="right") - 1
            yield pd.DataFrame({"doc_id": who[text], "part": -1, "key": win.shingles[at].view(np.int64)}).drop_duplicates()
            for p in parts:
                width = part_width(p)
                at, size, text = win.places(width, max(1, width // STEPS))
                some = np.flatnonzero(upto[at + size] > upto[at])
                if len(some):
                    m, place = win.minima(at[some], size[some])
                    f, w = np.nonzero(hit[place] > 0)
                    yield pd.DataFrame({"doc_id": who[text[some[w]]], "part": p, "key": _keyed(m, p)[f, w]}).drop_duplicates()

    salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = docs.mapInPandas(spread, "doc_id long, part int, key long").withColumn("salt", F.pmod("doc_id", F.lit(SALTS)).cast("int"))
    met = met.join(salted, ["part", "key", "salt"])
    both = met.groupBy("doc_id", "part_id").agg(F.count_if(F.col("part") >= 0).alias("agree"), F.count_if(F.col("part") < 0).alias("common"), F.max("need").alias("need"))
    return both.where((F.col("agree") >= AGREE) & (F.col("common") >= F.col("need"))).select("doc_id", "part_id")


def search(documents: DataFrame, eval_items: DataFrame, share: float | None = SHARE, max_item_chars: int = MAX_ITEM_CHARS) -> DataFrame:
    """doc_id, item_id: documents that hold share of an item's words as one running passage; None returns the candidates.

    Candidates by MinHash and the exact number of shingles in common, then exact containment in a window of the
    document, then the order of the words. There is one search, however many items there are; what goes to every task
    is the filter of 2 ** BITS bits and, up to max_item_chars, the item texts, which beyond that are joined to the
    documents that ask for them. Null, empty and blank texts and null ids have no row; a text under SHINGLE words
    neither leaks nor is leaked, as it has no shingle. Repeated document ids are one document with several texts,
    repeated item ids one item with several.
    """
    bare = staged(bare_items(eval_items))
    docs = documents.where("text is not null and doc_id is not null").selectExpr("cast(doc_id as long) as doc_id", "text")
    pairs = _candidates(docs, bare)
    if share is None:
        return pairs.join(bare, "part_id").select("doc_id", "item_id").distinct()
    few = (bare.agg(F.sum(F.length("text"))).first()[0] or 0) <= max_item_chars  # one row
    own = {r["part_id"]: (r["item_id"], r["text"]) for r in bare.collect()} if few else None
    sent = docs.sparkSession.sparkContext.broadcast(own)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[object, tuple[list[str], set[tuple[str, ...]]]] = {}
        for b in batches:
            out = []
            for d, t, items in zip(b["doc_id"], b["text"], b["items"]):
                doc = words(t)
                there = set(zip(doc, doc[1:]))
                for x in items:
                    item, text = sent.value[x] if few else (x["item_id"], x["item"])
                    if len(known) > 50_000:
                        known = {}
                    if text not in known:
                        ws = words(text)
                        known[text] = (ws, set(zip(ws, ws[1:])))
                    ws, pairs_ = known[text]
                    if enough_shared(ws, pairs_, there, share) and contained(ws, doc, share) and held(ws, doc, share - 1e-9) >= share - 1e-9:
                        out.append((d, item))
            yield pd.DataFrame(out, columns=["doc_id", "item_id"])

    # candidates of one document, no more than there are items, go with its text, which is read once
    asked = pairs if few else pairs.join(bare.withColumnRenamed("text", "item"), "part_id")
    asked = asked.groupBy("doc_id").agg(F.collect_list("part_id" if few else F.struct("item_id", "item")).alias("items"))
    return docs.join(asked, "doc_id").select("doc_id", "text", "items").mapInPandas(verify, "doc_id long, item_id long").distinct()


def found(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """p7_found: doc_id, item_id of each document that holds at least a third of an item's words as one passage."""
    return search(documents, eval_items)


def leaked_items(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """item_id, suite, n_docs: the items that leak, with the number of documents each leaks into; of several suites the first."""
    n = found(documents, eval_items).groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return n.join(eval_items.groupBy("item_id").agg(F.min("suite").alias("suite")), "item_id").select("item_id", "suite", "n_docs")
