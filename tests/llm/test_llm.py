"""The training-data operators: brute force, exact round trips, held-out accuracy and edge cases."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

pytest.importorskip("docweft.llm.splitting")

from docweft.llm import markup, mixing, packing, repetition, splitting, tokens  # noqa: E402
from docweft.sources.tables import SCHEMAS, empty  # noqa: E402

DOC = SCHEMAS["documents"]


def doc(i, text, source="a"):
    return (i, text, None, source, len(text or ""), None, None, None)


# ---- splitting -----------------------------------------------------------------------------------------------------

TEXTS = [
    "word " * 300,
    "x" * 1500,
    "元を範囲で置き換える。" * 120,
    "Para one is here. It goes on.\n\n" * 40,
    "\n".join(f"{i}. Let *a{i}* be a step with some words in it." for i in range(60)),
    "```\n" + "code line\n" * 80 + "```\n\nAfter it. " + "Tail. " * 100,
    "é́" * 700,
    " \n\t" * 500,
]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
@pytest.mark.parametrize("overlap", [0, 40])
def test_pieces_give_the_text_again(text, overlap):
    limit = 400
    pieces = splitting.split_text(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    back, end = "", 0
    for s, e, _ in pieces:
        assert 0 < e - s <= limit and s <= end < e
        if end:
            assert abs((end - s) - overlap) <= overlap / 4 + 1
        back += text[end:e]
        end = e
    assert back == text


def test_cuts_lie_at_the_best_boundaries():
    text = ("A sentence here. " * 20).strip() + "\n\n" + ("Another one there. " * 18).strip()
    kinds = [k for _, _, k in splitting.split_text(text, 400, 0)]
    assert kinds == ["paragraph", "end"]


def test_splitting_is_optimal_on_small_texts():
    r = random.Random(5)
    for _ in range(15):
        text = "".join(r.choice(["ab ", "c. ", "d\n", "e\n\n", "fgh"]) for _ in range(40))
        limit = 30
        at, rank = splitting.boundaries(text, limit)
        pen = [splitting.PENALTIES[splitting._KINDS[k]] for k in rank]
        n, count = len(text), -(-len(text) // limit)
        even = n / count
        best = {0: 0.0}
        for p, c in zip(at, pen):
            options = [best[q] + c + splitting.PER_PIECE + splitting.IMBALANCE * ((p - q - even) / even) ** 2 for q in best if 0 < p - q <= limit]
            if options:
                best[int(p)] = min(options)
        got, last = 0.0, 0
        for _, e, kind in splitting.split_text(text, limit, 0):
            got += splitting.PENALTIES[kind] + splitting.PER_PIECE + splitting.IMBALANCE * ((e - last - even) / even) ** 2
            last = e
        assert got == pytest.approx(best[n])


def test_split_rows(spark):
    rows = spark.createDataFrame([(1, "a" * 11), (2, "a" * 10), (3, None), (4, ""), (1, "b c d e f g h i")], "id bigint, content_text string").selectExpr("*", "'z' AS piece", "1 AS start")
    out = splitting.split_oversized(rows, 10, 2).collect()
    assert {x.id for x in out} == {1} and all(len(x.piece) <= 10 for x in out)
    assert splitting.split_oversized(empty(spark, "sections"), 10, 2).count() == 0


# ---- markup --------------------------------------------------------------------------------------------------------

CASES = [
    ("A <b>bold</b> word", {"html"}, "A bold word"),
    ("Tom &amp; Ann&nbsp;x &#8211; y &lt frozen", {"reference"}, "Tom & Ann x – y < frozen"),
    ("See [[External history|the pinned mesh]] and [[outer tree]].", {"wiki"}, "See the pinned mesh and outer tree."),
    ("''it'' and '''bold''' text", {"wiki"}, "it and bold text"),
    ("== Head ==\ntext", {"wiki"}, "## Head\ntext"),
    ('{| class="x"\n! a !! b\n|-\n| c || d\n|}', {"wiki"}, "a | b\nc | d"),
    ("The \\texttt{ring} uses 40\\% of \\emph{it}.", {"latex"}, "The ring uses 40% of it."),
    ("``quoted''\\footnote{x} text", {"latex"}, '"quoted" (x) text'),
    ("cost $O(n^{2} \\log n)$ here", {"latex"}, "cost $O(n^{2} \\log n)$ here"),
    ("\\[ a = b \\]", {"latex"}, "$$a = b$$"),
    ("\\begin{itemize}\\item one \\item two\\end{itemize}", {"latex"}, "- one\n- two"),
    ("<ul><li>one<li>two</ul>", {"html"}, "- one\n- two"),
    ("<pre class=idl>interface A { };</pre>", {"html"}, "```\ninterface A { };\n```"),
    ("<h3 id=x>Head</h3>", {"html"}, "### Head"),
    ("<![CDATA[kept]]><!-- gone -->", {"html"}, "kept"),
    # no markup
    ("Its [[Frozen]] slot; 3 < n and n > 1 & more; a * b; snake_case; {a, b}; $9 of $71 each; <https://x.example/#y>", set(), None),
    ("`<b>&amp; [[a b]] \\emph{x}` and\n\n```\n<i>''x''</i>\n```", set(), None),
    ("**bold** [a](b#c) and *x*\n\n| a | b |\n| --- | --- |", set(), "bold a and x\n\n| a | b |\n| --- | --- |"),
    ("", set(), ""),
]


@pytest.mark.parametrize("text,found,clean", CASES, ids=range(len(CASES)))
def test_markup(text, found, clean):
    assert set(markup.kinds(text, "content_text")) == found
    if clean is not None:
        assert markup.clean(text).strip() == clean


@pytest.mark.parametrize("title,case", [("The `x` attribute", 1), ("## Head", 1), ("A _token_ state", 1), ("with ~~x~~", 1), ("[a](#b)", 1), ("[[View]] of a target", 0), ("a_b values", 0), ("Scope * slot", 0), ("a < b & c", 0), ("", 0)])
def test_titles(title, case):
    assert bool(markup.kinds(title, "title")) == bool(case)


def test_cleaning_again_changes_nothing():
    for text, found, _ in CASES:
        if found and "latex" not in found:
            once = markup.clean(text)
            assert markup.clean(once) == once


def test_markup_rows(spark):
    rows = spark.createDataFrame([(1, "<b>x</b>", "plain"), (1, None, "a &amp; b"), (2, "", None), (3, "x", "y " * 50_000 + "<i>z</i>")], "id bigint, title string, content_text string").selectExpr("*", "1 AS field", "2 AS section_id")
    got = {(x.section_id, x.field) for x in markup.clean_markup(rows).collect()}
    assert got == {(1, "title"), (1, "content_text"), (3, "content_text")}
    assert markup.clean_markup(rows, only_cases=False).count() == 6
    assert markup.clean_markup(empty(spark, "sections")).count() == 0


def test_doubt_covers_all_cases(spark):
    """What the pattern inside the plan lets pass holds no markup."""
    texts = [t for t, _, _ in CASES]
    rows = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "id bigint, title string, content_text string")
    got = {(x.section_id, x.field) for x in markup.clean_markup(rows).collect()}
    assert got == {(i, f) for i, t in enumerate(texts) for f in ("title", "content_text") if markup.kinds(t, f)}


# ---- tokens and packing --------------------------------------------------------------------------------------------


def test_token_counts_are_exact():
    enc, c = tokens.encoder(), tokens.Counter()
    r = random.Random(2)
    parts = ["word", " ", "  ", "\n", "\n\n    ", "it's", "é", "元の", "12.5", "\t", "\xa0", "...", "x" * 80, " \n ", "\r\n"]
    for _ in range(500):
        t = "".join(r.choice(parts) for _ in range(r.randrange(20)))
        assert c.count(t) == len(enc.encode_ordinary(t)), repr(t)
    assert c.count(None) == c.count("") == 0


def test_best_fit_against_search_of_all_bins():
    r = random.Random(4)
    for _ in range(20):
        cap = 50
        items = sorted(((r.randrange(1, 51), r.choice("ab"), r.choice([None, *range(6)])) for _ in range(80)), reverse=True, key=lambda x: x[0])
        to, bins = packing.pack([x[0] for x in items], [x[1] for x in items], [x[2] for x in items], cap)
        room, members = [], []
        for (n, _, c), b in zip(items, to):
            fits = [room[i] for i in range(len(room)) if room[i] >= n and (c is None or c not in members[i])]
            if b == len(room):
                assert not fits
                room.append(cap), members.append(set())
            else:
                assert room[b] == min(fits)  # the tightest compatible one
            room[b] -= n
            if c is not None:
                assert c not in members[b]
                members[b].add(c)
        assert room == bins.room and min(room) >= 0


def test_packing(spark):
    r = random.Random(1)
    rows = [doc(i, "word " * r.choice([1, 5, 20, 90]), r.choice(["A ", "b", None])) for i in range(600)] + [doc(1000, "long " * 950), doc(1001, ""), doc(1002, None), doc(1, "word " * 3)]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "1 AS bin", "2 AS n_tokens", "3 AS cluster")
    got = packing.pack_documents(docs, 100, block_items=200).collect()
    whole = {}
    for x in got:
        whole.setdefault(x.bin_id, []).append(x)
    assert {x.doc_id for x in got} == {x[0] for x in rows}
    assert {x.doc_id for x in whole.pop(None)} == {1001, 1002}
    for items in whole.values():
        assert sum(x.n_tokens for x in items) == items[0].bin_tokens <= 100
        clusters = [x.cluster for x in items]
        assert len(clusters) == len(set(clusters))  # copies of one text lie apart
    long = sorted((x.first_token, x.n_tokens) for x in got if x.doc_id == 1000)
    assert [n for _, n in long[:-1]] == [100] * (len(long) - 1) and [s for s, _ in long] == list(range(0, 100 * len(long), 100))
    assert all(x.piece_no == 1 for x in got if x.doc_id != 1000)
    assert packing.pack_documents(empty(spark, "documents"), 100).count() == 0


def test_packing_leaves_little_room(spark):
    r = random.Random(3)
    words = "alpha beta gamma delta epsilon zeta".split()
    rows = [doc(i, " ".join(r.choice(words) for _ in range(r.randrange(5, 120)))) for i in range(3000)]
    got = packing.pack_documents(spark.createDataFrame(rows, DOC), 256).filter("n_tokens > 0").collect()
    bins = len({x.bin_id for x in got})
    assert bins <= 1.01 * -(-sum(x.n_tokens for x in got) // 256) + 1


# ---- mixing --------------------------------------------------------------------------------------------------------

TARGETS = "source string, target_share double, max_repeats int"


def corpus(n=1500, seed=0):
    r = random.Random(seed)
    words = {"a": "queue lock timer".split(), "b": "paper ink margin".split(), "c": "tree leaf root".split()}
    rows = []
    for i in range(n):
        s = r.choices("abc", [8, 3, 1])[0]
        rows.append(doc(i, " ".join(r.choice(words[s]) for _ in range(r.randrange(5, 60))), r.choice([s, s.upper(), f" {s} "])))
    return rows


def test_mix_reaches_the_shares(spark):
    docs = spark.createDataFrame(corpus(), DOC)
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4)], TARGETS)
    draws, report = mixing.mix_sources(docs, t)
    got = {x.source: x for x in report.collect()}
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert got[s].reached_share == pytest.approx(share, abs=0.01)
    caps = {"a": 1, "b": 2, "c": 4}
    rows = draws.collect()
    assert len(rows) == 1500 and all(0 <= x.repeats <= caps[x.source] for x in rows)
    assert sum(x.repeats * x.n_tokens for x in rows) == sum(x.tokens for x in got.values())


def test_mix_without_documents_or_labels(spark):
    rows = corpus(300) + [doc(1000, "queue lock timer lock", None), doc(1001, None, "zzz"), doc(1002, "", "a")]
    t = spark.createDataFrame([("a", 0.4, 1), ("b", 0.4, 1), ("none", 0.2, 3)], TARGETS)
    draws, report = mixing.mix_sources(spark.createDataFrame(rows, DOC), t)
    got = {x.source: x for x in report.collect()}
    assert got["none"].tokens == 0 and got["a"].reached_share == pytest.approx(got["b"].reached_share, abs=0.03)
    assert draws.count() == 303
    d, r = mixing.mix_sources(empty(spark, "documents"), t)
    assert d.count() == 0 and {x.tokens for x in r.collect()} == {0}
    d, r = mixing.mix_sources(spark.createDataFrame(rows, DOC), t.limit(0))
    assert d.filter("repeats > 0").count() == 0


def test_classifier_on_held_out_rows():
    rows = [(x[1], x[3].strip().lower()) for x in corpus(900, 5)]
    model = mixing.DomainClassifier(["a", "b", "c"]).fit(rows[:600])
    right = sum("abc"[int(np.argmax(model.posterior(t)))] == s for t, s in rows[600:])
    assert right >= 0.95 * 300
    assert model.posterior(None).sum() == pytest.approx(1)


def test_gradient_meets_soft_targets(spark):
    """Documents of mixed membership: the fitted totals meet the goal."""
    r = random.Random(9)
    members = spark.createDataFrame([(10 + i % 7, [p, 1 - p]) for i, p in enumerate(r.random() for _ in range(400))], "n_tokens bigint, p array<double>")
    goal = np.array([900.0, 1100.0])
    _, reached = mixing.fit_rates(members, ["x", "y"], goal, np.array([1.0, 1.0]))
    assert np.allclose(reached, goal, rtol=0.02)


# ---- repetition ----------------------------------------------------------------------------------------------------


def brute(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    marked, seen = [False] * len(w), set()
    for i in range(len(w) - 7):
        g = tuple(w[i : i + 8])
        if g in seen:
            marked[i : i + 8] = [True] * 8
        seen.add(g)
    return len(w), sum(marked)


def texts(seed, n=300):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    out = [None, "", "   ", "one two", "same " * 15, "same " * 16, "a b c d e f g h " * 2, "Ab ab AB aB " * 9, "x_y x_y x_y " * 10, "½ ² ٣ " * 20]
    for _ in range(n):
        w = [r.choice(vocab) for _ in range(r.randrange(5, 80))]
        for _ in range(r.randrange(4)):
            s = r.randrange(len(w))
            w[r.randrange(len(w)) :] += w[s : s + r.randrange(5, 30)] if r.random() < 0.7 else []
        out.append(r.choice([" ", ", ", "\n"]).join(w))
    return out


def test_repetition_against_brute_force(spark):
    ts = texts(1)
    docs = spark.createDataFrame([doc(i, t) for i, t in enumerate(ts)], DOC).selectExpr("*", "1 AS n_words", "2 AS share")
    want = {i: brute(t) for i, t in enumerate(ts)}
    cases = {i: (n, k) for i, (n, k) in want.items() if n >= 16 and 3 * k >= n}
    assert 5 < len(cases) < len(ts)
    for order in (None, [], ["fours", "pairs", "vocabulary", "length"], ["vocabulary"]):
        got = {x.doc_id: (x.n_words, x.n_repeated) for x in repetition.repetitive_documents(docs, order=order).collect()}
        assert got == cases, order
    profile = {x.doc_id: (x.n_words, x.n_repeated) for x in repetition.repetition_profile(docs).collect()}
    assert profile == want
    assert repetition.repetitive_documents(empty(spark, "documents")).count() == 0


def test_rules_never_reject_a_case():
    words = repetition._Words()
    for t in texts(7, 600):
        w = words.of(t).copy()
        if repetition.is_case(w):
            assert not any(rule(w) for rule in repetition.RULES.values())


def test_chance_collisions_are_looked_at(monkeypatch):
    w = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 1, 2, 3, 4, 5, 6, 7, 8])
    right = repetition.repeated_words(w)
    real = np.unique
    monkeypatch.setattr(repetition.np, "unique", lambda h, **k: real(h * np.uint64(0), **k) if k else real(h))  # all hashes equal
    assert (repetition.repeated_words(w) == right).all() and right.sum() == 8


def test_cascade_orders_by_rejection_per_cost():
    est = [("length", 1e-6, 0.1), ("vocabulary", 2e-5, 0.3), ("pairs", 1e-4, 0.9), ("fours", 1e-3, 0.95), ("exact", 2e-4, 0.0)]
    assert repetition.cascade(est) == ["length", "vocabulary", "pairs"]


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_blocks_are_packed_alike_in_any_batches(size):
    import pyarrow as pa

    r = random.Random(6)
    rows = sorted(((b, -r.randrange(1, 60), i) for b in range(5) for i in range(40)))
    t = pa.table(
        [pa.array([i for _, _, i in rows], pa.int64()), pa.array([1] * len(rows), pa.int32()), pa.array([0] * len(rows), pa.int64()), pa.array([-n for _, n, _ in rows], pa.int32()), pa.array(["a"] * len(rows)), pa.array([i % 30 for _, _, i in rows], pa.int64()), pa.array([b for b, _, _ in rows], pa.int32())],
        names=["doc_id", "piece_no", "first_token", "n_tokens", "source", "cluster", "block"],
    )
    run = packing._packer(64, None)
    got = [tuple(x.values()) for b in run(iter(t.to_batches(max_chunksize=size))) for x in b.to_pylist()]
    assert got == [tuple(x.values()) for b in run(iter(t.to_batches())) for x in b.to_pylist()] and len(got) == len(rows)
    loose = [x for b in packing._packer(64, 0.01)(iter(t.to_batches(max_chunksize=size))) for x in b.to_pylist()]
    assert len(loose) == len(rows) and all(x["bin"] is None or x["bin_tokens"] >= 64 * 0.99 for x in loose)
