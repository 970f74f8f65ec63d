"""Filling containers of fixed capacity with items: conflict-constrained best fit over residual-ordered bins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.llm.tokens import TOKENIZERS, Counter
from docweft.operators.runtime import cut, spread

#: Items that are packed together; the same on every cluster, so that documents always pack alike.
BLOCK_ITEMS = 4000
#: Containers of the first round with more than this share of their room left are opened again and packed once more.
SLACK = 0.01
#: A source or cluster with more members in a block has its own list of the containers that are open to it.
OFTEN = 64


class Bins:
    """Open containers ordered by the room they have left.

    A bit mask holds the residuals that occur, so the successor of a size is found at once. Each container carries a
    bitmap of its sources and one of its duplicate clusters; the search goes on to the next larger residual until the
    tightest container that is open to the item is found. Of equally tight ones, one without the item's source is taken.

    ``views`` are the (sources, clusters) bitmaps of frequent items. Each view orders only the containers without those,
    so that many copies of one text never walk past each other's containers. Entries whose container has moved on are
    dropped when they are met.
    """

    def __init__(self, capacity: int, views: list[tuple[int, int]] = [(0, 0)], apart: bool = False):
        self.capacity = capacity
        self.views = views
        self.apart = apart
        self.mask = [0] * len(views)
        self.by_room: list[dict[int, list[int]]] = [{} for _ in views]
        self.room: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def _tightest(self, size: int, source: int, cluster: int, view: int) -> int:
        no_source, no_cluster = self.views[view]
        above, room = self.mask[view] >> size, size - 1
        while above:
            step = (above & -above).bit_length()
            room += step
            above >>= step
            there = self.by_room[view][room]
            pick = -1
            for i in range(len(there) - 1, -1, -1):
                b = there[i]
                if self.room[b] != room or self.clusters[b] & no_cluster or self.sources[b] & no_source:
                    there[i] = there[-1]
                    there.pop()
                elif self.clusters[b] & cluster or self.apart and self.sources[b] & source:
                    continue
                elif not self.sources[b] & source:
                    pick = b
                    break
                elif pick < 0:
                    pick = b
            if not there:
                self.mask[view] &= ~(1 << room)
            if pick >= 0:
                return pick
        return -1

    def put(self, size: int, source: int, cluster: int, view: int = 0) -> int:
        """The container that takes an item; source and cluster are bitmaps of one bit (0: none)."""
        b = self._tightest(size, source, cluster, view)
        if b < 0:
            b = len(self.room)
            self.room.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        left = self.room[b] = self.room[b] - size
        self.sources[b] |= source
        self.clusters[b] |= cluster
        if left:
            for v, (no_source, no_cluster) in enumerate(self.views):
                if not (self.clusters[b] & no_cluster or self.sources[b] & no_source):
                    self.by_room[v].setdefault(left, []).append(b)
                    self.mask[v] |= 1 << left
        return b


def pack(sizes: list[int], sources: list[str], clusters: list[int | None], capacity: int, apart: bool = False) -> tuple[list[int], Bins]:
    """The container number of each item, and the containers. Items of falling size fill best.

    Members of one cluster never share a container; with ``apart`` nor do those of one source.
    """
    members: dict[int, int] = {}
    for c in clusters:
        if c is not None:
            members[c] = members.get(c, 0) + 1
    bits: dict[int | None, int] = {}
    for c, n in members.items():
        if n > 1:  # only a cluster that meets itself needs a bit
            bits[c] = 1 << len(bits)
    source_bit: dict[str, int] = {}
    for s in sources:
        source_bit.setdefault(s, 1 << len(source_bit))
    kinds = [(source_bit[s] if apart else 0, bits.get(c, 0)) for s, c in zip(sources, clusters)]
    often: dict[tuple[int, int], int] = {}
    for s, c in kinds:
        for k in {(s, c), (s, 0), (0, c)}:
            often[k] = often.get(k, 0) + 1
    views = [(0, 0), *(k for k, n in often.items() if n > OFTEN and k != (0, 0))]
    at = {k: i for i, k in enumerate(views)}
    bins = Bins(capacity, views, apart)
    best = [next(at[k] for k in ((s, c), (s, 0), (0, c), (0, 0)) if k in at) for s, c in kinds]
    return [bins.put(n, source_bit[s], bits.get(c, 0), v) for n, s, c, v in zip(sizes, sources, clusters, best)], bins


_ITEM = "doc_id bigint, piece_no int, first_token bigint, n_tokens int, source string, cluster bigint"


def sized_items(documents: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizers: str = TOKENIZERS) -> DataFrame:
    """One row per item: doc_id, piece_no, first_token, n_tokens, source (trimmed, lower case), cluster.

    A text of more than ``capacity`` tokens, and no other, is cut into full pieces and a rest. The cluster numbers texts
    that are equal after blanks are folded and case is ignored (a 64-bit hash). Null and empty texts give one item of no
    tokens and no cluster.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizers)
        for b in batches:
            n = np.array([counter.count(t) for t in b.column("text").to_pylist()], np.int64)
            pieces = np.maximum(1, -(-n // capacity))
            row = np.repeat(np.arange(len(n)), pieces)
            no = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = no * capacity
            at = pa.array(row)
            yield pa.record_batch(
                [b.column("doc_id").take(at), pa.array((no + 1).astype(np.int32)), pa.array(first), pa.array(np.minimum(capacity, n[row] - first).astype(np.int32)), b.column("source").take(at), b.column("cluster").take(at)],
                names=["doc_id", "piece_no", "first_token", "n_tokens", "source", "cluster"],
            )

    text = F.col(text_col)
    folded = F.lower(F.trim(F.regexp_replace(text, r"[\t\r\n][ \t\r\n]*| [ \t\r\n]+", " ")))
    src = documents.select(
        F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.coalesce(F.lower(F.btrim(source_col, F.lit(" \t\r\n"))), F.lit("")).alias("source"), F.when(F.length(folded) > 0, F.xxhash64(folded)).alias("cluster")
    )
    return spread(src).mapInArrow(run, _ITEM)


_PLACED = _ITEM + ", block int, bin int, bin_tokens int"


def _packer(capacity: int, keep_over: float | None, apart: bool = False):
    """Packs each block (rows come sorted by block and falling size); bin is null where a loose one is opened again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(t: pa.Table) -> Iterator[pa.RecordBatch]:
            sizes = t["n_tokens"].to_pylist()
            to, bins = pack(sizes, t["source"].to_pylist(), t["cluster"].to_pylist(), capacity, apart)
            at = np.array(to, np.int64)
            used = (capacity - np.array(bins.room, np.int64))[at]
            loose = used < capacity * (1 - keep_over) if keep_over is not None else np.zeros(len(at), bool)
            out = t.append_column("bin", pa.array(at.astype(np.int32), mask=loose)).append_column("bin_tokens", pa.array(used.astype(np.int32), mask=loose))
            yield from out.combine_chunks().to_batches(max_chunksize=20_000)

        held: list[pa.Table] = []
        for b in batches:
            t = pa.Table.from_batches([b])
            block = np.asarray(t["block"])
            edges = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(block)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if held and np.asarray(held[0]["block"].slice(0, 1))[0] != block[lo]:
                    yield from packed(pa.concat_tables(held))
                    held = []
                held.append(t.slice(lo, hi - lo))
        if held:
            yield from packed(pa.concat_tables(held))

    return run


def _round(items: DataFrame, capacity: int, n: int, block_items: int, keep_over: float | None, apart: bool) -> DataFrame:
    blocks = max(1, -(-n // block_items))
    spread = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(blocks)), F.lit(blocks)).cast("int"))
    placed = spread.repartition(blocks, "block") if blocks > 1 else spread.coalesce(1)
    return placed.sortWithinPartitions("block", F.desc("n_tokens"), "doc_id", "piece_no").mapInArrow(_packer(capacity, keep_over, apart), _PLACED)


def pack_documents(documents: DataFrame, capacity: int, tokenizers: str = TOKENIZERS, block_items: int = BLOCK_ITEMS, slack: float = SLACK, apart_sources: bool = False, **columns: str) -> DataFrame:
    """Sequences of ``capacity`` tokens filled with whole documents; only longer ones are cut.

    Result: bin_id, doc_id, piece_no, first_token, n_tokens, bin_tokens, source, cluster. Copies of one text never share
    a container. Sources are mixed where that costs no room; with ``apart_sources`` no container holds two documents of one
    source either, which leaves far more room. Every document stands in the result; one without tokens has a null bin_id.

    Items are spread over blocks of about ``block_items`` by a hash of the document, so no source or group of copies
    gathers in a task, and each block is packed by best fit in falling order of size. Containers with more than
    ``slack`` of their room left are opened and their items packed again together.
    """
    items = sized_items(documents, capacity, tokenizers=tokenizers, **columns)
    sized = cut(items)
    some = sized.filter("n_tokens > 0")
    first = cut(_round(some, capacity, some.count(), block_items, slack, apart_sources))
    loose = first.filter("bin is null").drop("block", "bin", "bin_tokens")
    again = _round(loose, capacity, loose.count(), block_items, None, apart_sources)

    def named(df: DataFrame, round_no: int) -> DataFrame:
        return df.select(F.concat_ws("-", F.lit(round_no), "block", "bin").alias("bin_id"), "doc_id", "piece_no", "first_token", "n_tokens", "bin_tokens", "source", "cluster")

    none = sized.filter("n_tokens = 0").select(F.lit(None).cast("string").alias("bin_id"), "doc_id", "piece_no", "first_token", "n_tokens", F.lit(None).cast("int").alias("bin_tokens"), "source", "cluster")
    return named(first.filter("bin is not null"), 1).unionByName(named(again, 2)).unionByName(none)
