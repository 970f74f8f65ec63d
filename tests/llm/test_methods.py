"""Page differencing, exact splitting, packing and mixing against brute force, and markup that earlier rules lost."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

pytest.importorskip("docweft.llm.splitting")

from docweft.llm import markup, mixing, packing, pages, splitting  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def lcs(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    return int(t[-1, -1])


@pytest.mark.parametrize("seed", range(30))
def test_common_lines_are_longest(seed):
    r = random.Random(seed)
    a, b = ([r.choice(["x", "y ", "z", "", " u"]) for _ in range(r.randrange(14))] for _ in range(2))
    blank = lambda v: [x.strip() or None for x in v]
    same = pages.common_lines(blank(a), blank(b))
    fold = lambda v: [x.strip() for x in v if x.strip()]
    kept = [x.strip() for x, s in zip(b, same) if s]
    assert sum(same) == lcs(fold(a), fold(b)) and all(kept)
    it = iter(fold(a))
    assert all(any(x == y for y in it) for x in kept)


def test_shared_lines_over_partitions(spark):
    rows = [(i, f"s{i % 3}", f"/p{i:03d}", f"menu\nbody {i}\n\nfoot") for i in range(60)] + [(99, None, "/x", "menu"), (98, "s0", "/p", None), (97, "s9", "/a", "")]
    df = spark.createDataFrame(rows, "id bigint, host string, path string, body string").withColumn("text", F.lit("clash"))
    got = {x.id: x for x in pages.shared_lines(df, "id", F.col("host"), F.col("path"), "body", ["id"]).collect()}
    assert set(got) == {*range(60), 97}
    assert {i for i, x in got.items() if x.n_shared == 0} == {0, 1, 2, 97}
    assert got[3].shared == [0, 3] and got[3].n_lines == 3 and got[3].n_shared == 2
    left = {x.id: x.body for x in pages.without_shared(df, pages.shared_lines(df, "id", F.col("host"), F.col("path"), "body", ["id"]), "id", "body").collect()}
    assert left[3] == "body 3\n" and left[0] == "menu\nbody 0\n\nfoot" and left[98] is None and left[97] == "" and len(left) == 63
    assert pages.shared_lines(df.limit(0), "id", F.col("host"), F.col("path"), "body", ["id"]).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_cuts_are_best_over_all_words(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["a", "bc ", ". D", "\n\n", "\n1. ", " ", "e"]) for _ in range(r.randrange(16, 28)))[:44]
    limit, overlap = 20, 4
    if len(text) <= limit:
        return
    at, rank = splitting.boundaries(text, limit)
    penalty = np.array([splitting.PENALTIES[k] for k in splitting._KINDS])[rank]
    n = len(text)
    count = -(-(n - overlap) // (limit - overlap))
    even = (n + (count - 1) * overlap) / count

    def start(i):
        near = [j for j in range(len(at)) if at[i] - overlap - 1 <= at[j] <= at[i] - overlap + 1]
        return at[min(near, key=lambda j: penalty[j] + abs(at[j] - (at[i] - overlap)) / overlap)] if near else max(0, at[i] - overlap)

    def cost(cuts):
        total, s = 0.0, 0
        for i in cuts:
            if at[i] - s > limit or at[i] <= s:
                return np.inf
            total += penalty[i] + splitting.PER_PIECE + splitting.IMBALANCE * ((at[i] - s - even) / even) ** 2
            s = start(i)
        return total

    got = splitting.split_text(text, limit, overlap)
    ends = {int(p): i for i, p in enumerate(at)}
    mine = cost([ends[e] for _, e, _ in got])
    inner = range(len(at) - 1)
    best = min(cost([*c, len(at) - 1]) for k in range(max(count - 1, 1), 5) for c in combinations(inner, k))
    assert mine <= best + 1e-9


def test_sources_and_copies_apart():
    r = random.Random(4)
    n = 500
    sizes = sorted((r.randrange(1, 400) for _ in range(n)), reverse=True)
    sources, clusters = [r.choice("aaabcd") for _ in range(n)], [r.choice([None, 1, 1, 2, i]) for i in range(n)]
    for apart in (False, True):
        to, bins = packing.pack(sizes, sources, clusters, 1000, apart)
        for b in set(to):
            inside = [i for i in range(n) if to[i] == b]
            named = [clusters[i] for i in inside if clusters[i] is not None]
            assert sum(sizes[i] for i in inside) == 1000 - bins.room[b] <= 1000 and len(named) == len(set(named))
            assert not apart or len({sources[i] for i in inside}) == len(inside)
        # best fit: no item would have gone tighter without a conflict when it came
        room, held = {}, {}
        for i in range(n):
            open_ = [room[b] for b in room if room[b] >= sizes[i] and not (clusters[i] is not None and clusters[i] in held[b][0]) and not (apart and sources[i] in held[b][1])]
            assert room.get(to[i], 1000) == min(open_, default=1000)
            room[to[i]] = room.get(to[i], 1000) - sizes[i]
            c, s = held.setdefault(to[i], (set(), set()))
            c.add(clusters[i]), s.add(sources[i])


def test_a_hot_cluster_takes_linear_time():
    import time

    def took(n):
        t = time.perf_counter()
        packing.pack([100] * n, ["a"] * n, [1] * n, 2048)
        return time.perf_counter() - t

    assert took(16_000) < 20 * max(took(4_000), 0.005)


def test_mixing_refuses_more_than_there_is(spark):
    docs = spark.createDataFrame([(i, "word " * 50, "ab"[i % 2]) for i in range(20)], "doc_id bigint, text string, source string")
    aims = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    with pytest.raises(ValueError, match="reach"):
        mixing.mix_sources(docs, aims, total_tokens=10**9)


def test_shares_are_settled_over_all_tasks(spark):
    r = random.Random(3)
    docs = spark.createDataFrame([(i, ["pear ", "fig "][i % 2] * r.choice([5, 20, 300]), "ab"[i % 2]) for i in range(400)], "doc_id bigint, text string, source string").repartition(16)
    aims = spark.createDataFrame([("a", 0.35, 2), ("b", 0.65, 1)], "source string, target_share double, max_repeats int")
    for weight in (1.0, 0.7):
        report = {x.source: x for x in mixing.mix_sources(docs, aims, label_weight=weight)[1].collect()}
        assert abs(report["a"].expected_share - 0.35) < 0.01 and abs(sum(x.reached_share for x in report.values()) - 1) < 1e-9


@pytest.mark.parametrize(
    "text, want",
    [
        (r"\textbf{a {b {c} d} e}", "a b c d e"),
        (r"x \frac{a}{b} y", r"x $\frac{a}{b}$ y"),
        (r"\emph{\textbf{\textit{\texttt{\textsc{deep}}}}}", "deep"),
        ("<ol start=3><li>one</li><li>two<ul><li>in</li></ul></li></ol>", "3. one\n4. two\n    - in"),
        (r"\begin{enumerate}\item a \item b\end{enumerate}", "1. a\n2. b"),
        ("{{a|{{b|{{c|{{d|{{e|{{f|g}}}}}}}}}}}}", "g"),
        ("kept    `x` <b>y</b>", "kept    `x` y"),
        ("[[File:a.png|thumb|" + "long caption " * 60 + "end]]", "long caption " * 60 + "end"),
        ("the set {item, offset} and \\emph{x}", "the set {item, offset} and x"),
        ("``" + "quoted " * 80 + "end'' and `code`", '"' + "quoted " * 80 + 'end" and `code`'),
    ],
)
def test_markup_of_any_depth_and_length(text, want):
    assert markup.clean(text) == want
