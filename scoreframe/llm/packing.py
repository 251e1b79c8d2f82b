"""Packing by lexical retrieval: a document's nearest unused neighbours fill the rest of its window.

Documents are cut at multiples of the window; whole windows need no neighbours, the tails do. Tails are range-partitioned
by a min-hash of their token ids, ties by id, so that alike tails stand together and a group of copies of any size spreads
over partitions. Each partition is worked off in shards of at most SHARD tokens. A shard has a BM25 inverted index of
its tails: the longest unused tail seeds a window, all unused tails that share an id with it are taken in BM25 order where
they fit whole, then the longest unused tail that fits; a gap of more than GAP tokens is closed by cutting the next
neighbour, whose rest stays unused. Only the last window of a shard can be left with more padding.

A null or empty text is the end token alone. Rows are packed one by one, also where ids repeat or are null. An empty table
gives no pieces.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.common import materialize, table
from scoreframe.llm.texthash import batches, mix64
from scoreframe.llm.tokenize import tokenizer_path, word_tokenizer

WINDOW, END = 4096, 2
#: Most tokens in a shard, the largest gap that is padded and the BM25 parameters.
SHARD, GAP = 1_500_000, 48
K1, B = 1.2, 0.75

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def crc_of(ids: np.ndarray) -> int:
    """CRC-32 of the ids as little-endian 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def tails_and_windows(docs: DataFrame, path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """Every row's whole windows (without ids) and its tail (with ids and a min-hash of them)."""

    def run(frames):
        encoder = word_tokenizer(path)
        mixed = (mix64(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1 << 20)) >> np.uint64(1)).astype(np.int64)
        for pdf in frames:
            for part in batches([len(t or "") for t in pdf.text]):
                coded, ends = encoder.encode_flat(list(pdf.text.iloc[part]))
                ids, ends = np.insert(coded, ends, end), ends + np.arange(1, len(ends) + 1)
                sizes = np.diff(ends, prepend=0)
                tails = sizes // window * window
                low = np.minimum.reduceat(np.append(mixed[ids], 0), np.column_stack([ends - sizes + tails, ends]).reshape(-1))[::2]
                rows = []
                for doc_id, stop, size, tail, least in zip(pdf.doc_id.iloc[part], ends.tolist(), sizes.tolist(), tails.tolist(), low.tolist(), strict=True):
                    begin = stop - size
                    for at in range(0, tail, window):
                        rows.append((doc_id, at, window, crc_of(ids[begin + at : begin + at + window]), size, None, 0))
                    if tail < size:
                        rows.append((doc_id, tail, size - tail, None, size, ids[begin + tail : stop].tobytes(), least))
                out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "low"])
                out["doc_id"], out["ids_crc32"] = out.doc_id.astype("Int64"), out.ids_crc32.astype("Int64")
                yield out

    return docs.select("doc_id", "text").mapInPandas(run, PIECES + ", ids binary, low long")


class Index:
    """A BM25 inverted index over the tails of one shard; ids of one tail alone lead nowhere and aren't held."""

    def __init__(self, tails: list[np.ndarray]):
        lengths = np.array([len(t) for t in tails])
        doc = np.repeat(np.arange(len(tails)), lengths)
        key, count = np.unique(np.concatenate(tails).astype(np.int64) * len(tails) + doc, return_counts=True)
        term, self.doc = key // len(tails), key % len(tails)
        self.terms, df = np.unique(term, return_counts=True)
        norm = K1 * (1 - B + B * lengths / lengths.mean())
        idf = np.log1p((len(tails) - df + 0.5) / (df + 0.5))
        self.weight = np.repeat(idf, df) * count * (K1 + 1) / (count + norm[self.doc])
        self.ends = np.append(0, np.cumsum(df))
        self.unused = np.ones(len(tails), bool)
        self.held = self.left = len(tails)
        self._keep(np.repeat(df > 1, df))

    def _keep(self, keep: np.ndarray) -> None:
        self.ends = np.append(0, np.cumsum(keep))[self.ends]
        self.doc, self.weight = self.doc[keep], self.weight[keep]

    def drop(self, i: int) -> None:
        """Tail i is used up; once half of the tails held are, their places are cleared."""
        self.unused[i] = False
        self.left -= 1
        if 2 * self.left < self.held:
            self.held = self.left
            self._keep(self.unused[self.doc])

    def neighbours(self, tail: np.ndarray) -> np.ndarray:
        """All unused tails that share an id with a tail, best first."""
        at = np.searchsorted(self.terms, np.unique(tail))
        runs = [slice(a, b) for a, b in zip(self.ends[at].tolist(), self.ends[at + 1].tolist(), strict=True) if a < b]
        if not runs:
            return np.zeros(0, np.int64)
        score = np.bincount(np.concatenate([self.doc[r] for r in runs]), np.concatenate([self.weight[r] for r in runs]), len(self.unused))
        found = np.flatnonzero((score > 0) & self.unused)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(tails: list[np.ndarray], window: int = WINDOW, gap: int = GAP) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (tail, from, to): every position of every tail lies in one of them."""
    index = Index(tails)
    begun = [0] * len(tails)  # where the unused rest of a tail begins
    left = np.array([len(t) for t in tails])
    by_length = sorted((len(t), i) for i, t in enumerate(tails))  # of unused rests
    windows = []

    def rest(i: int) -> int:
        return len(tails[i]) - begun[i]

    def use(i: int, n: int, into: list) -> None:
        by_length.pop(bisect.bisect_left(by_length, (rest(i), i)))
        into.append((i, begun[i], begun[i] + n))
        begun[i] += n
        left[i] -= n
        if rest(i):
            bisect.insort(by_length, (rest(i), i))
        else:
            index.drop(i)

    while by_length:
        seed, filled = by_length[-1][1], []
        room = window - rest(seed)
        use(seed, rest(seed), filled)
        near = index.neighbours(tails[seed]) if by_length and (room > gap or by_length[0][0] <= room) else np.zeros(0, np.int64)
        fits = near[left[near] <= room]
        while len(fits):  # the run that fits as it stands, then on behind the first that doesn't
            n = int(np.searchsorted(np.cumsum(left[fits]), room, "right"))
            for i in fits[:n].tolist():
                room -= rest(i)
                use(i, rest(i), filled)
            fits = fits[n + 1 :]
            fits = fits[left[fits] <= room]
        while room and by_length and by_length[0][0] <= room:
            i = by_length[bisect.bisect_right(by_length, (room, len(tails))) - 1][1]
            room -= rest(i)
            use(i, rest(i), filled)
        if room > gap and by_length:
            more = near[index.unused[near]]
            use(int(more[0]) if len(more) else by_length[-1][1], room, filled)
        windows.append(filled)
    return windows


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of every row of docs (doc_id, text) with sequence_id and offset.

    A piece that is cut for a window takes its own part of the ids; CRCs are taken from the ids that are packed.
    """
    pieces = materialize(tails_and_windows(docs, path or tokenizer_path(), window), "pieces")
    ranged = pieces.repartitionByRange("low", "doc_id", "start", "length").sortWithinPartitions("low", "doc_id", "start", "length")

    def run(frames):
        number = TaskContext.get().partitionId() << 33

        def flush(rows):
            nonlocal number
            out = []
            tails = [np.frombuffer(r[5], "<u2") for r in rows]
            for filled in pack_shard(tails, window) if rows else []:
                offset = 0
                for i, a, b in filled:
                    doc_id, start, _, _, total, _ = rows[i]
                    out.append((doc_id, start + a, b - a, crc_of(tails[i][a:b]), total, number, offset))
                    offset += b - a
                number += 1
            return out

        def frame(rows):
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            out["doc_id"] = out.doc_id.astype("Int64")
            return out

        held, tokens = [], 0
        for pdf in frames:
            whole = []
            for row in zip(pdf.doc_id, pdf.start, pdf.length, pdf.ids_crc32, pdf.doc_tokens, pdf.ids, strict=True):
                if row[5] is None:
                    whole.append((*row[:5], number, 0))
                    number += 1
                    continue
                if tokens + row[2] > SHARD:
                    whole += flush(held)
                    held, tokens = [], 0
                held.append(row)
                tokens += row[2]
            yield frame(whole)
        yield frame(flush(held))

    return ranged.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids").mapInPandas(run, PIECES + ", sequence_id long, offset long")


def op2_packing(spark, sf_dir) -> DataFrame:
    """Every document's pieces in windows of 4096 tokens."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
