"""Parent-child rows of unknown depth to whole hierarchies: nested-set ranges, paths, levels, roots, loops."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweft.operators.runtime import bounded, cut, place

#: Groups of at most this many rows are solved whole inside one task; larger ones by doubling over the cluster.
GROUP_ROWS = 200_000
_BATCH_ROWS = 100_000

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
COLUMNS = {
    "level": "int",
    "root": "string",
    "path": "array<string>",
    "subtree_size": "bigint",
    "range_start": "bigint",
    "range_end": "bigint",
    "loop": "string",
    "on_loop": "boolean",
}


def solve(group: np.ndarray, node: np.ndarray, parent: np.ndarray, order: np.ndarray, with_path: bool = True) -> dict[str, object]:
    """All hierarchies of some whole groups. (group, node) is unique; order ranks siblings, then their place does.

    Upward: leaves hand their subtree size to their parents until none is left; what is never handed up lies on a loop.
    Downward: each node takes its preorder range from its parent's start and the prefix sum of its siblings' sizes;
    what is never reached hangs on a loop.
    """
    n = len(node)
    names = pd.factorize(np.concatenate([node, parent]), use_na_sentinel=True)[0].astype(np.int64)
    width = int(names.max(initial=0)) + 1
    groups = pd.factorize(group)[0].astype(np.int64)
    key = groups * width + names[:n]
    sort = np.argsort(key, kind="stable")
    wanted = np.where(names[n:] >= 0, groups * width + names[n:], -1)
    at = np.minimum(np.searchsorted(key[sort], wanted), max(n - 1, 0))
    up = np.where((wanted >= 0) & (key[sort][at] == wanted), sort[at], -1) if n else np.zeros(0, np.int64)

    # upward
    size = np.ones(n, np.int64)
    waits = np.bincount(up[up >= 0], minlength=n)
    done = np.zeros(n, bool)
    front = np.flatnonzero(waits == 0)
    while len(front):
        done[front] = True
        front = front[up[front] >= 0]
        above = up[front]
        np.add.at(size, above, size[front])
        np.subtract.at(waits, above, 1)
        above = np.unique(above)
        front = above[waits[above] == 0]
    on_loop = ~done

    # the least name on each loop, by doubling along it
    least = node.copy()
    on = np.flatnonzero(on_loop)
    if len(on):
        place = np.full(n, -1)
        place[on] = np.arange(len(on))
        step, low = place[up[on]], np.array([str(x) for x in node[on]], object)
        while True:
            other = low[step]
            smaller = other < low
            if not smaller.any():
                break
            low, step = np.where(smaller, other, low), step[step]
        least[on] = low
        size[on] = 0

    # prefix sums over siblings; the nodes without a parent are the siblings under their group
    family = np.where(up >= 0, up, n + groups)
    family[on_loop] = -1 - np.arange(n)[on_loop]
    by = np.lexsort((order, family))
    before = np.cumsum(size[by]) - size[by]
    first = np.r_[True, family[by][1:] != family[by][:-1]] if n else np.zeros(0, bool)
    offset = np.zeros(n, np.int64)
    offset[by] = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), n])) if n else 0

    # downward
    start = np.full(n, -1, np.int64)
    level = np.full(n, -1, np.int64)
    top = np.arange(n)
    loop = np.full(n, None, object)
    loop[on] = least[on]
    kids = by[family[by] >= 0]
    kids = kids[up[kids] >= 0]
    lo, hi = np.searchsorted(up[kids], np.arange(n), "left"), np.searchsorted(up[kids], np.arange(n), "right")
    # kids are sorted by family, so by parent
    roots = np.flatnonzero((up < 0))
    start[roots], level[roots] = offset[roots], 0
    front = np.concatenate([roots, on])
    layers = [roots]
    while len(front):
        count = hi[front] - lo[front]
        over = np.repeat(front, count)
        pick = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[front], count)
        down = kids[pick]
        reached = start[over] >= 0
        start[down] = np.where(reached, start[over] + 1 + offset[down], -1)
        level[down] = np.where(reached, level[over] + 1, -1)
        top[down] = top[over]
        loop[down] = loop[over]
        layers.append(down[reached])
        front = down
    whole = start >= 0
    out: dict[str, object] = {"level": np.where(whole, level, -1), "root": np.where(whole, node[top] if n else node, None), "subtree_size": np.where(whole, size, -1), "range_start": start, "range_end": np.where(whole, start + size - 1, -1), "loop": loop, "on_loop": on_loop, "whole": whole}
    if with_path:
        path: list[list[str] | None] = [None] * n
        for layer in layers:
            for i in layer:
                path[i] = [*path[up[i]], node[i]] if up[i] >= 0 else [node[i]]
        out["path"] = path
    return out


def _solver(group: str, node: str, parent: str, order: list[str], keep: list[str], schema: pa.Schema, with_path: bool, only_loops: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(t: pa.Table) -> Iterator[pa.RecordBatch]:
            ids = t.select([group, node]).to_pandas()
            t = t.take(np.flatnonzero(~ids.duplicated().to_numpy()))  # sorted: the first of each is its row
            rank = np.empty(t.num_rows, np.int64)
            rank[np.asarray(pc.sort_indices(t, [(c, "ascending") for c in order], null_placement="at_end")) if order else slice(None)] = np.arange(t.num_rows)
            got = solve(np.asarray(t[group]), t[node].to_pandas().to_numpy(object), t[parent].to_pandas().to_numpy(object), rank, with_path)
            whole = got.pop("whole")
            at = np.flatnonzero(~whole) if only_loops else np.arange(t.num_rows)
            if not len(at):
                return
            cols = []
            for f in schema:
                v = got.get(f.name)
                if v is None:
                    cols.append(t[f.name].take(at).cast(f.type))
                elif f.name == "path":
                    cols.append(pa.array([v[i] for i in at], f.type))
                elif f.name in ("level", "subtree_size", "range_start", "range_end"):
                    cols.append(pa.array(v[at], mask=v[at] < 0).cast(f.type))
                else:
                    cols.append(pa.array(v[at], f.type, from_pandas=True))
            yield from pa.table(cols, schema=schema).combine_chunks().to_batches(max_chunksize=20_000)

        held: list[pa.Table] = []
        rows = 0
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows < _BATCH_ROWS:
                continue
            t = pa.concat_tables(held)
            g = np.asarray(t[group])
            stop = int(np.searchsorted(g, g[-1], "left"))  # the last group may go on
            if stop:
                yield from solved(t.slice(0, stop))
            held = [t.slice(stop)]
            rows = t.num_rows - stop
        if rows:
            yield from solved(pa.concat_tables(held))

    return run


def _doubled(nodes: DataFrame, group: str, node: str, order: list[str], with_path: bool, only_loops: bool) -> DataFrame:
    """The same result for groups too large for one task, by pointer doubling: as many rounds as the binary logarithm of
    the greatest level, each of one or two joins on (group, node) over the whole cluster, and one table at a time.

    nodes: one row per (group, node) with ``_parent`` null unless that node exists. After round k each node knows its
    ancestor 2**k levels up. Upward, it hands its subtree size there. The levels that occur have no gap, so a round in
    which no node newly meets its root is the last: what is open then never ends.
    """
    key = [group, node]
    base = cut(nodes)
    is_root = F.col("_parent").isNull()
    state = base.select(*key, F.col("_parent").alias("_up"), F.when(is_root, 0).otherwise(1).alias("_level"), F.when(is_root, F.col(node)).alias("_root"), F.lit(1).cast("bigint").alias("_size"))
    state = cut(state)
    left = None
    while True:
        n_open = state.filter("_up is not null").count()
        if n_open == left or n_open == 0:
            break
        left = n_open
        ahead = state.select(group, F.col(node).alias("_up"), F.col("_up").alias("_up2"), F.col("_level").alias("_level2"), F.col("_root").alias("_root2"))
        given = state.filter("_up is not null").groupBy(group, F.col("_up").alias(node)).agg(F.sum("_size").alias("_given"))
        state = cut(
            state.join(ahead, [group, "_up"], "left")
            .join(given, key, "left")
            .select(*key, F.col("_up2").alias("_up"), (F.col("_level") + F.coalesce("_level2", F.lit(0))).alias("_level"), F.coalesce("_root", "_root2").alias("_root"), (F.col("_size") + F.coalesce("_given", F.lit(0))).alias("_size")),
            bare=True,
        )
    none = {c: F.lit(None).cast(k) for c, k in COLUMNS.items()}
    cols = [*base.columns, *(c for c in COLUMNS if c != "path" or with_path)]
    out = None
    if n_open:  # nodes on loops or leading into one
        rest = base.join(state.filter("_up is not null").select(*key), key, "left_semi")
        low = cut(rest.select(group, node, F.col("_parent").alias("_up"), F.col(node).alias("_low")))
        longest = low.groupBy(group).count().agg(F.max("count")).first()[0]
        for _ in range(int(longest).bit_length()):  # then each has gone at least once around its loop
            ahead = low.select(group, F.col(node).alias("_up"), F.col("_up").alias("_up2"), F.col("_low").alias("_low2"))
            low = cut(low.join(ahead, [group, "_up"]).select(*key, F.col("_up2").alias("_up"), F.least("_low", "_low2").alias("_low")), bare=True)
        on = low.select(group, F.col("_up").alias(node)).distinct().withColumn("_on", F.lit(True))
        names = low.join(on, key).select(group, F.col(node).alias("_up"), F.col("_low").alias("_loop"))
        looping = low.join(names, [group, "_up"]).join(on, key, "left").select(*key, "_loop", F.coalesce("_on", F.lit(False)).alias("_on"))
        out = rest.join(looping, key).withColumns({**none, "loop": F.col("_loop"), "on_loop": F.col("_on")}).select(*cols)
    if only_loops:
        return out if out is not None else base.withColumns(none).select(*cols).limit(0)
    trees = base.join(state.filter("_up is null").drop("_up"), key)
    sibling = F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in order], F.col(node))
    offsets = _prefix(trees.withColumn("_order", sibling), [group, "_parent"], "_order", "_size")
    path = [F.array(node).alias("path")] if with_path else []
    done = cut(offsets.select(*base.columns, "_level", "_root", "_size", F.col("_parent").alias("_up"), (F.col("_before") + F.when(is_root, 0).otherwise(1)).alias("_start"), *path))
    while not done.filter("_up is not null").isEmpty():  # downward: a start is the sum of the offsets on the way to the root
        ahead = done.select(group, F.col(node).alias("_up"), F.col("_up").alias("_up2"), F.col("_start").alias("_start2"), *([F.col("path").alias("_path2")] if with_path else []))
        path = [F.when(F.col("_path2").isNull(), F.col("path")).otherwise(F.concat("_path2", "path")).alias("path")] if with_path else []
        done = cut(done.join(ahead, [group, "_up"], "left").select(*base.columns, "_level", "_root", "_size", F.col("_up2").alias("_up"), (F.col("_start") + F.coalesce("_start2", F.lit(0))).alias("_start"), *path), bare=True)
    whole = done.withColumns({"level": F.col("_level"), "root": F.col("_root"), "subtree_size": F.col("_size"), "range_start": F.col("_start"), "range_end": F.col("_start") + F.col("_size") - 1, "loop": none["loop"], "on_loop": F.lit(False)}).select(*cols)
    return whole if out is None else whole.unionByName(out)


def _prefix(df: DataFrame, keys: list[str], order: str, size: str) -> DataFrame:
    """The sum of ``size`` over the rows before each row, by keys, as ``_before``; no key is summed in one task.

    Rows are range-partitioned by (keys, order); the totals of each key in each partition (a few rows per key) give each
    partition its start. Keys may be null.
    """
    ranged = cut(df.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "_part").agg(F.sum(size).alias("_total"))
    starts = totals.withColumn("_at", F.sum("_total").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_total"))
    inside = Window.partitionBy(*keys, "_part").orderBy(order)
    summed = ranged.withColumn("_in", F.sum(size).over(inside) - F.col(size)).alias("a")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_part"]]
    return summed.join(starts.alias("b"), same).select(*[F.col(f"a.{c}") for c in df.columns if c != order], (F.col("a._in") + F.col("b._at")).alias("_before"))


def hierarchies(
    rows: DataFrame,
    group: str = "snapshot_id",
    node: str = "anchor",
    parent: str = "parent_anchor",
    order: tuple[str, ...] = ("ord", "id"),
    keep: tuple[str, ...] = (),
    with_path: bool = True,
    only_loops: bool = False,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Full hierarchies of parent-child rows within each group.

    Result: group, node, parent, the ``keep`` columns, level (0 for roots), root, path (array from the root down to the
    node, if ``with_path``), subtree_size, range_start and range_end (preorder numbers within the group: the
    descendants of x are the rows with range_start in (x.range_start, x.range_end]), loop (the least node, by code
    points, of the loop on which following parents ends; then the other columns are null) and on_loop.

    Rows with null group or node are ignored; of several rows of one (group, node) that of least ``order`` counts (nulls
    last). A null parent, or one that is no node of the group, makes a root. With
    ``only_loops`` only nodes whose parents never end are returned.

    Siblings are ranked by ``order`` (nulls last), then by node. Groups up to ``group_rows`` rows travel whole to one
    task, many in a batch, and are solved in vectors; larger ones by pointer doubling over the whole cluster, in rounds
    of the logarithm of their greatest level. Both give the same rows.
    """
    keep = tuple(c for c in keep if c not in (group, node, parent))
    if clash := sorted({group, node, parent, *keep} & set(COLUMNS)):
        raise ValueError(f"columns named like results: {clash}")
    order = tuple(order)
    cols = list(dict.fromkeys([group, node, parent, *order, *keep]))
    src = rows.filter(F.col(group).isNotNull() & F.col(node).isNotNull()).select(*cols)
    types = dict(src.dtypes)
    result = {group: types[group], node: "string", parent: "string", **{c: types[c] for c in keep}} | {k: v for k, v in COLUMNS.items() if k != "path" or with_path}
    ddl = ", ".join(f"`{k}` {v}" for k, v in result.items())
    schema = pa.schema([(k, _arrow(v)) for k, v in result.items()])
    first = [F.col(c).asc_nulls_last() for c in order]
    big = cut(rows.filter(F.col(group).isNotNull()).groupBy(group).count().filter(F.col("count") > group_rows).select(group))
    any_big = not big.isEmpty()
    if any_big:
        big, few = bounded(big)
        big = F.broadcast(big) if few else big
    run = _solver(group, node, parent, list(order), list(keep), schema, with_path, only_loops)
    small = src.join(big, group, "left_anti") if any_big else src
    small = small.repartition(group).sortWithinPartitions(group, node, *first)
    out = small.mapInArrow(run, ddl)
    if not any_big:
        return out
    pick = F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in order])
    one = src.join(big, group, "left_semi").groupBy(group, node).agg(F.min_by(F.struct(*[c for c in cols if c not in (group, node)]), pick).alias("_r")).select(group, node, *[F.col(f"_r.{c}").alias(c) for c in cols if c not in (group, node)])
    has = one.select(group, F.col(node).alias(parent), F.col(node).alias("_parent"))
    linked = one.join(has, [group, parent], "left").select(*cols, "_parent")
    far = _doubled(linked, group, node, list(order), with_path, only_loops)
    return out.unionByName(far.select(*[F.col(c).cast(result[c]).alias(c) for c in result]))


def _arrow(kind: str) -> pa.DataType:
    if kind not in _ARROW:
        from pyspark.sql.pandas.types import to_arrow_type
        from pyspark.sql.types import _parse_datatype_string

        return to_arrow_type(_parse_datatype_string(kind))
    return _ARROW[kind]


def _sweep(group: str, node: str, schema: pa.Schema):
    """Links of rows sorted by (group, range_start): at each row, the ancestors are the ranges still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, open_ = None, pa.table([])
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            parts = np.asarray(t["_part"])
            for lo, hi in zip(*(lambda e: (e[:-1], e[1:]))(np.r_[0, np.flatnonzero(np.diff(parts)) + 1, len(parts)])):
                piece = t.slice(lo, hi - lo)
                carried = 0
                if part == parts[lo]:
                    carried, piece = open_.num_rows, pa.concat_tables([open_, piece])
                part = parts[lo]
                g = pd.factorize(np.asarray(piece[group].combine_chunks().to_pandas(), object))[0]
                level, start, end, fresh = (np.asarray(piece[c]) for c in ("level", "range_start", "range_end", "_fresh"))
                fresh = fresh & (np.arange(len(fresh)) >= carried)
                at = np.arange(len(level))
                for k in range(int(level.max())):
                    last = np.maximum.accumulate(np.where(level == k, at, -1))  # of the rows before, the nearest of level k
                    low = np.flatnonzero(fresh & (level > k) & (last >= 0))
                    up = last[low]
                    holds = (g[up] == g[low]) & (end[up] >= start[low])
                    low, up = low[holds], up[holds]
                    if len(low):
                        out = [piece[group].take(low), piece[node].take(up), piece[node].take(low), pa.chunked_array([pa.array((level[low] - k).astype(np.int32))])]
                        yield from pa.table(out, schema=schema).combine_chunks().to_batches(max_chunksize=50_000)
                still = np.flatnonzero((g == g[-1]) & (end >= start[-1]))
                open_ = piece.take(still).combine_chunks()

    return run


def descendants(tree: DataFrame, group: str = "snapshot_id", node: str = "anchor") -> DataFrame:
    """Every link (group, ancestor, descendant, distance) of solved hierarchies, one row per link and no more.

    Rows are range-partitioned by (group, range_start), so that no group gathers, and each range is swept once: the
    ancestors of a row are the nested-set ranges open at its start. To each range come the few rows whose own range
    reaches over its edge. Nodes without a whole path have no links. Needs level, range_start and range_end.
    """
    whole = tree.filter("range_start is not null").select(group, node, "level", "range_start", "range_end")
    ranged = cut(whole.repartitionByRange(group, "range_start").withColumn("_part", F.spark_partition_id()))
    # one row per partition: where it starts
    edges = ranged.groupBy("_part").agg(F.min(F.struct(group, "range_start")).alias("_e")).select(F.col("_part").alias("_to"), F.col(f"_e.{group}").alias(group), F.col("_e.range_start").alias("_edge"))
    over = ranged.join(F.broadcast(edges), group).filter("range_start < _edge and range_end >= _edge").select(group, node, "level", "range_start", "range_end", F.col("_to").alias("_part"), F.lit(False).alias("_fresh"))
    both = ranged.withColumn("_fresh", F.lit(True)).unionByName(over)
    n = ranged.rdd.getNumPartitions()
    kind = dict(tree.dtypes)[group]
    schema = pa.schema([(group, _arrow(kind)), ("ancestor", pa.string()), ("descendant", pa.string()), ("distance", pa.int32())])
    swept = place(both, max(n, 1), "_part").sortWithinPartitions("_part", group, "range_start")
    return swept.mapInArrow(_sweep(group, node, schema), f"`{group}` {kind}, ancestor string, descendant string, distance int")


def in_subtree(tree: DataFrame, chosen: DataFrame, group: str = "snapshot_id", node: str = "anchor") -> DataFrame:
    """The descendants of some chosen (group, node) rows, by nested-set ranges.

    A range is looked up only in the stretches of 64 preorder numbers it covers, so no group is crossed with itself.
    """
    heads = tree.join(chosen.select(group, node).distinct(), [group, node], "left_semi").filter("loop is null")
    heads = heads.select(group, F.col(node).alias("ancestor"), F.col("range_start").alias("_s"), F.col("range_end").alias("_e"), F.explode(F.sequence(F.floor(F.col("range_start") / 64), F.floor(F.col("range_end") / 64))).alias("_b"))
    return (
        tree.filter("loop is null")
        .withColumn("_b", F.floor(F.col("range_start") / 64))
        .join(heads, [group, "_b"])
        .filter("range_start > _s and range_start <= _e")
        .select(group, "ancestor", F.col(node).alias("descendant"), "level")
    )
