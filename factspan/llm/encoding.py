"""Token ids of the whole corpus by a public byte-level BPE (problem 6), with a pair occurrence index.

Within a partition the distinct pre-tokens of a batch of texts are laid out as one chain of byte ids. Every adjacent
pair that the vocabulary can merge is indexed under the rank of its merge with all positions where it occurs. Ranks are
applied in ascending order, each to all its positions at once; a merge changes only the lists of the pairs beside it,
whose ranks are always higher, so the order stays right.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from importlib.util import find_spec
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Fixed value: how the vocabulary's makers split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pre-tokens whose ids a task keeps; beyond that it forgets all and starts anew, which only costs time.
CACHE = 400_000
#: Characters of text that are encoded together.
BATCH_CHARS = 4_000_000


def default_ranks() -> str:
    """The installed vocabulary file of byte_bpe_50k; a parameter everywhere else."""
    spec = find_spec("public_tokenizers")
    where = Path(spec.origin).parent if spec and spec.origin else Path("/opt/tokenizers")
    return str(where / "byte_bpe_50k.tiktoken")


class PairIndex:
    """Merges of one vocabulary, applied to many pre-tokens at once."""

    def __init__(self, ranks_file: bytes) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line.strip())}
        self.bytes_id = [ranks[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            if len(token) > 1:
                pair = self._last_pair(token, rank, ranks)
                if pair:
                    self.merges[pair] = rank

    @staticmethod
    def _last_pair(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one: what is left of it under all merges of lower rank."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(rank, 0))
            if best[0] >= rank:
                return None
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def encode(self, words: Iterable[bytes]) -> list[list[int]]:
        """The ids of each word."""
        ids: list[int] = []
        ends: list[int] = []
        own, merges = self.bytes_id, self.merges
        for w in words:
            ids.extend(own[b] for b in w)
            ids.append(-1)  # nothing merges across the end of a word
            ends.append(len(ids) - 1)
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        at: dict[int, list[int]] = {}
        for i in range(n - 1):
            r = merges.get((ids[i], ids[i + 1]))
            if r is not None:
                at.setdefault(r, []).append(i)
        active = list(at)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            for i in sorted(at.pop(rank)):  # left to right, as in a word the left of two overlapping pairs goes first
                a = ids[i]
                j = nxt[i] if a >= 0 else n
                if j >= n or merges.get((a, ids[j])) != rank:
                    continue
                k = nxt[j]
                ids[i], ids[j], nxt[i] = rank, -2, k
                if k < n:
                    prv[k] = i
                    r = merges.get((rank, ids[k]))
                    if r is not None:
                        if r not in at:
                            at[r] = []
                            heapq.heappush(active, r)
                        at[r].append(i)
                h = prv[i]
                if h >= 0:
                    r = merges.get((ids[h], rank))
                    if r is not None:
                        if r not in at:
                            at[r] = []
                            heapq.heappush(active, r)
                        at[r].append(h)
        out, start = [], 0
        for e in ends:
            out.append([x for x in ids[start:e] if x >= 0])
            start = e + 1
        return out


class TextEncoder:
    def __init__(self, index: PairIndex) -> None:
        self.index, self.known, self.split = index, {}, regex.compile(PATTERN).findall

    def __call__(self, texts: list[str | None]) -> list[list[int]]:
        pieces = [self.split(t) if t else [] for t in texts]
        if len(self.known) > CACHE:
            self.known = {}
        new = list({w for p in pieces for w in p} - self.known.keys())
        self.known.update(zip(new, self.index.encode(w.encode("utf-8", "surrogatepass") for w in new)))
        known = self.known
        return [[i for w in p for i in known[w]] for p in pieces]


def encoded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """doc_id, ids: the token ids of every text, without special tokens.

    Null and empty texts have an empty list; blank texts are encoded as they are; strings that look like special
    tokens are ordinary text. Repeated ids keep a row each; extra columns are ignored. The vocabulary's
    merges (50,000, of fixed size) are read where the job is started and sent along, so executors need no file.
    """
    path = Path(ranks_path or default_ranks())
    index = df.sparkSession.sparkContext.broadcast(PairIndex(path.read_bytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = TextEncoder(index.value)
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            start = 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (end == start or size < BATCH_CHARS):
                    size += len(texts[end] or "")
                    end += 1
                ids = pa.array(encode(texts[start:end]), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(start, end - start), ids], ["doc_id", "ids"])
                start = end

    return df.selectExpr(f"cast({id_col} as long) as doc_id", f"{text_col} as text").mapInArrow(run, "doc_id long, ids array<int>")
