"""Parts of the operators on small inputs of their own."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracemill.llm import mixing, nearest, packing, passages, quality, simhash, tokens, topk
from tracemill.llm.licenses import scan
from tracemill.llm.vectors import queries_of


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\t.,'sabé1$\x1c\x85…中") | st.characters(codec="utf-8"), max_size=40), max_size=6))
def test_encoder_equals_the_tokenizer(texts):
    e = tokens.encoder(tokens.vocabulary_path())
    for text, ids in zip(texts, e.encode_all(texts)):
        assert ids.tolist() == e.model.encode(text, add_special_tokens=False).ids


@settings(deadline=None, max_examples=60)
@given(st.text(alphabet=st.sampled_from(" \n\t\r\x0b\x1c\x85\xa0.,'sabdelmrtvtheinéÀß1²½$_-"), max_size=200))
def test_merges_by_rank_give_the_ids_of_the_tokenizer(text):
    e = tokens.encoder(tokens.vocabulary_path())
    assert e.ranked.encode_ordinary(text) == e.model.encode(text, add_special_tokens=False).ids


def test_merges_by_rank_on_whole_texts(docs_texts):
    e = tokens.encoder(tokens.vocabulary_path())
    long = ["a" * 50_000, " " * 50_000 + "x", "?!" * 20_000, "\n \t" * 20_000]
    for text, ids in zip([*docs_texts, *long], e.encode_all([*docs_texts, *long])):
        assert ids.tolist() == e.model.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_are_left_to_their_tokenizer():
    import public_tokenizers

    e = tokens.encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Some  words,\n  ÄND others", "", None, "  "]
    assert e.ranked is None
    for text, ids in zip(texts, e.encode_all(texts)):
        assert ids.tolist() == e.model.encode(text or "", add_special_tokens=False).ids
        ends = e.ends(text or "", ids)
        assert len(ends) == len(ids) and (np.diff(ends) >= 0).all() and all(x <= len((text or "").encode()) for x in ends)


@pytest.fixture(scope="module")
def docs_texts(duck):
    return [t for (t,) in duck.execute("SELECT text FROM documents").fetchall()]


def test_a_crossing_token_goes_where_most_of_it_is():
    best, crosses = tokens.allot(np.array([2, 6, 10]), np.array([4, 5, 10]))
    assert best.tolist() == [0, 0, 2] and crosses.tolist() == [False, True, False]


@settings(deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_local_search_keeps_items_and_never_loses(lengths):
    squares = lambda bs: sum(sum(lengths[i] for i in b) ** 2 for b in bs)
    for bins in (packing.arrival(lengths, 64), [[i] for i in range(len(lengths))]):
        before, count = squares(bins), len(bins)
        after = packing.improve([list(b) for b in bins], lengths, 64)
        assert sorted(i for b in after for i in b) == list(range(len(lengths)))
        assert all(0 < sum(lengths[i] for i in b) <= 64 for b in after)
        assert squares(after) >= before and len(after) <= count
        # nothing is left to gain by moving an item or exchanging one for one
        fill = [sum(lengths[i] for i in b) for b in after]
        for x, b in enumerate(after):
            for y, t in enumerate(after):
                if x != y and fill[x] < 64 and fill[y] < 64:
                    for n in (lengths[i] for i in b):
                        for m in (0, *(lengths[i] for i in t)):
                            assert not (m < n and fill[y] + n - m <= 64 and fill[y] + n - m > fill[x])


@pytest.mark.parametrize("bins, lengths", [([[0], [1, 2], [3], [4], [5]], [6, 3, 3, 5, 4, 3]), ([[0, 1], [2, 3], [4]], [5, 3, 4, 4, 3])])
def test_local_search_empties_a_bin(bins, lengths):
    """By moves and exchanges of one for one; of one for two."""
    assert len(packing.improve(bins, lengths, 10)) < len(bins)


def test_two_take_the_place_of_one():
    lengths = [3, 3, 5, 4]
    after = packing.improve([[0, 1], [2, 3]], lengths, 10)
    assert sorted(sum(lengths[i] for i in b) for b in after) == [5, 10]


def test_the_search_and_not_the_start_removes_the_waste(duck):
    e = tokens.encoder(tokens.vocabulary_path())
    texts = [t for (t,) in duck.execute("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    lengths = [n for n in ((len(ids) + 1) % 1024 for ids in e.encode_all(texts)) if n]
    bound = -(-sum(lengths) // 1024)
    start = packing.arrival(lengths, 1024)
    after = packing.improve(start, lengths, 1024)
    assert len(start) > 1.3 * bound and len(after) <= 1.005 * bound
    assert len(packing.improve([[i] for i in range(len(lengths))], lengths, 1024)) <= 1.005 * bound


@pytest.mark.parametrize("spread", [0, 3, 20])
def test_group_links_connect_what_all_pairs_connect(spread):
    rng = random.Random(spread)
    seeds = [rng.getrandbits(64) for _ in range(5)]
    fps = np.array(sorted({s ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, spread))) % 2**64 for s in seeds for _ in range(40)}), np.uint64)

    def groups(links):
        root = list(range(len(fps)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(a)] = find(b)
        return [min(j for j in range(len(fps)) if find(j) == find(i)) for i in range(len(fps))]

    every = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 4]
    assert groups(simhash.link_group(fps, simhash.pivot_table(fps), 4)) == groups(every)


def test_hot_groups_lose_no_link(spark):
    rng = random.Random(1)
    base = rng.getrandbits(63)
    fps = sorted({base ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for _ in range(800)})
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    from tracemill.operators.graph import components

    found = components(simhash.near_links(simhash.with_tables(nodes), group=64))  # far more than a group holds
    assert found.count() == len(fps) and found.select("root").distinct().count() == 1


def test_every_choice_of_blocks_finds_its_pairs(spark):
    a = 0x0123456789ABCDEF
    pairs = [(a, a ^ m) for m in (0b1111, 1 | 1 << 20 | 1 << 40 | 1 << 60, 1 << 62, 1 << 11 | 1 << 10 | 1 << 22 | 1 << 33)]
    df = spark.createDataFrame(pairs, "x long, y long")
    for m in (6, 7, 8, 10):
        kx, ky = simhash.block_keys("x", m, 4), simhash.block_keys("y", m, 4)
        hit = F.lit(False)
        for p, q in zip(kx, ky):
            hit = hit | (p == q)
        assert df.filter(~hit).count() == 0


@settings(deadline=None, max_examples=40)
@given(st.lists(st.tuples(st.integers(0, 80), st.integers(0, 80)), min_size=1, max_size=30, unique=True))
def test_chains_rise_in_both_and_hold_every_anchor_once(anchors):
    anchors.sort()
    x, y = (np.array(c) for c in zip(*anchors))
    chains = passages.chains(x, y)
    assert sorted(i for c in chains for i in c) == list(range(len(x)))
    for c in chains:
        assert (np.diff(x[c]) > 0).all() and (np.diff(y[c]) > 0).all()


@settings(deadline=None, max_examples=150)
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(-40, 40)), min_size=1, max_size=60, unique=True))
def test_chains_score_as_the_best_of_all_predecessors(anchors):
    anchors = sorted((x, x + d) for x, d in anchors if x + d >= 0)
    if not anchors:
        return
    x, y = (np.array(c) for c in zip(*anchors))
    worth = lambda d, e: min(passages.K, d, e) - passages.COST * abs(d - e)
    best = []
    for i in range(len(x)):
        best.append(max([float(passages.K), *(best[j] + worth(x[i] - x[j], y[i] - y[j]) for j in range(i) if 0 < x[i] - x[j] <= passages.GAP and 0 < y[i] - y[j] <= passages.GAP)]))
    first = passages.chains(x, y)[0]
    score = passages.K + sum(worth(x[b] - x[a], y[b] - y[a]) for a, b in zip(first, first[1:]))
    assert abs(score - max(best)) < 1e-9


def test_run_hashes():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 2**63, 200).astype(np.uint64)
    v = np.concatenate([rng.integers(0, 2**63, 37).astype(np.uint64), w[20:120], w[:5]])
    a, b = passages.run_hashes(w, np.arange(200), 50), passages.run_hashes(v, np.arange(142), 50)
    assert (a[20:71] == b[37:88]).all() and len({*a[:151].tolist()} & {*b[:93].tolist()}) == 51 and not a[151:].any() and not b[93:].any()


def test_short_texts_hide_no_passage(spark):
    """Texts that hold parts of a passage, each too short, are the first to have its seeds."""
    w = _new_words(220, "w")
    parts = [w[20 * i : 20 * i + 40] + _new_words(60, f"o{i}_") for i in range(10)]
    found = _passages_of(spark, *parts, w, _new_words(30, "x") + w)
    assert found == [(12, 30, 250, 11, 0)]
    # one owner that has a part of the passage before the whole of it
    found = _passages_of(spark, w[100:130] + _new_words(50, "y") + w, _new_words(30, "x") + w)
    assert {i for k, a, b, o, at in found if (k, o) == (2, 1) and at - a == 50 for i in range(a, b)} == {*range(30, 250)}


def test_seeds_meet_one_owner_and_come_out_of_the_join_once(spark, monkeypatch):
    tables, keep = [], passages.stored
    monkeypatch.setattr(passages, "stored", lambda df, name: tables.append((name, df)) or keep(df, name))
    w = _new_words(200, "w")
    docs = spark.createDataFrame([(i, " ".join(_new_words(20 * (i % 2), f"x{i}-") + w)) for i in range(12)], "doc_id long, text string")
    assert {r["doc_id"] for r in passages.repeated_passages(docs).collect()} == {*range(1, 12)}
    # in turns, so that one turn's exchanges are on disk at a time
    assert [n for n, _ in tables].count("shared-seeds") == passages.TURNS > 1
    # whatever the sizes of groups, no more rows than came in
    rows = spark.createDataFrame([(i, p, 7 if p % 3 else 0, i // 2, p) for i in range(1, 30) for p in range(4)], "doc long, pos int, run long, other long, other_pos int")
    out = passages.matched(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" in plan and "Inner" not in plan
    got = {tuple(r) for r in out.collect()}
    assert got == {(i, p, i // 2, p) for i in range(1, 30) for p in range(4)} | {(i, p, 1, 1) for i in range(2, 30) for p in (1, 2)}


def test_rows_that_repeat_an_id_are_one_text(spark):
    w, o = _new_words(80, "w"), _new_words(200, "o")
    rows = [(1, " ".join(w)), (2, " ".join(w)), (2, " ".join(o + w)), (2, " ".join(w)), (None, " ".join(w))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.repeated_passages(docs)
    assert [tuple(r) for r in found.collect()] == [(2, 200, 280, 1, 0, 80, 80)]
    kept = sorted((r["doc_id"] or 0, len(r["text"].split())) for r in passages.without_passages(docs, found).collect())
    assert kept == [(0, 80), (1, 80), (2, 80), (2, 80), (2, 200)]


@pytest.mark.parametrize("length, equal, least", [(52, 1.0, 1.0), (60, 0.9, 0.9), (60, 0.85, 0.85), (120, 0.9, 0.98), (120, 0.85, 0.95), (120, 0.82, 0.9)])
def test_recall_of_fuzzy_passages(spark, length, equal, least):
    """200 pairs of texts that share a passage with words changed at random; found if most of it is."""
    rng = random.Random(length)
    rows, new = [], (f"n{i}" for i in range(10**9))
    take = lambda n: [next(new) for _ in range(n)]
    for k in range(200):
        p = take(length)
        q = list(p)
        for i in rng.sample(range(length), round(length * (1 - equal))):
            q[i] = next(new)
        rows += [(2 * k, " ".join(take(70) + p + take(70))), (2 * k + 1, " ".join(take(90) + q + take(50)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    covered = {}
    for r in passages.repeated_passages(docs).collect():
        assert (r["doc_id"], r["other_id"]) == (r["other_id"] // 2 * 2 + 1, r["other_id"])
        covered.setdefault(r["doc_id"], set()).update(range(max(r["start"], 90), min(r["stop"], 90 + length)))
    assert sum(len(c) >= 0.8 * length for c in covered.values()) >= least * 200


def test_seeds_are_shared_by_shared_runs():
    rng = np.random.default_rng(0)
    run = rng.integers(0, 2**63, passages.K + passages.WINDOW - 1).astype(np.uint64)
    for _ in range(20):
        a, b = (np.concatenate([rng.integers(0, 2**63, 30).astype(np.uint64), run, rng.integers(0, 2**63, 30).astype(np.uint64)]) for _ in range(2))
        assert set(passages.minimisers(a)[1]) & set(passages.minimisers(b)[1])


def test_hashed_words_cut_as_words_do():
    texts = [b"", b" a  B\tb\n", None, b"xa ab ba", b"a"]
    w, counts = passages.hashed_words(texts)
    assert counts.tolist() == [0, 3, 0, 3, 1] and w[0] == w[6] and w[1] == w[2] and len({*w.tolist()}) == 5


def test_hashed_words_in_small_chunks(monkeypatch):
    texts = [b"one two three", b"", b"a" * 5000 + b" two " + b"b" * 300, b"three  one " * 50]
    want, counts = passages.hashed_words(texts)
    monkeypatch.setattr(passages, "CHUNK", 7)
    got, again = passages.hashed_words(texts)
    assert (got == want).all() and (counts == again).all() and want[0] == want[7]


def test_fuzzy_passage_and_its_cut(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    shared = [word() for _ in range(120)]
    changed = [w if i % 17 else word() for i, w in enumerate(shared)]
    own = [[word() for _ in range(80)] for _ in range(3)]
    rows = [(1, " ".join(own[0] + shared)), (2, " ".join(own[1] + changed + own[2])), (3, " ".join(own[2][:40]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.repeated_passages(docs)
    (r,) = found.collect()
    assert (r["doc_id"], r["other_id"]) == (2, 1) and abs(r["start"] - 80) <= 1 and abs(r["stop"] - 200) <= 2
    kept = {x["doc_id"]: x["text"] for x in passages.without_passages(docs, found).collect()}
    assert kept[1] == rows[0][1] and kept[3] == rows[2][1] and len(kept[2].split()) in range(160, 164)


def _passages_of(spark, *texts):
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts, 1)], "doc_id long, text string")
    return sorted((r["doc_id"], r["start"], r["stop"], r["other_id"], r["other_start"]) for r in passages.repeated_passages(docs).collect())


def _new_words(n, name):
    return [f"{name}{i}" for i in range(n)]


def test_a_copy_goes_on_behind_a_missing_block_and_in_another_order(spark):
    w = _new_words(700, "w")
    found = _passages_of(spark, w, w[:200] + w[300:])
    assert found == [(2, 0, 200, 1, 0), (2, 200, 600, 1, 300)]
    parts = [w[i : i + 100] for i in range(0, 700, 100)]
    order = [4, 5, 0, 6, 2, 1, 3]
    found = _passages_of(spark, w, [x for k in order for x in parts[k]])
    assert {i for _, a, b, _, at in found for i in range(a, b)} >= {*range(700)} and {(order[a // 100] * 100, at) for _, a, _, _, at in found} == {(i, i) for i in (400, 0, 600, 200, 100, 300)}


def test_passages_stand_apart_where_an_alignment_matches_poorly(spark):
    a, b = _new_words(60, "a"), _new_words(60, "b")
    found = _passages_of(spark, a + _new_words(35, "x") + b, a + _new_words(35, "y") + b)
    assert found == [(2, 0, 60, 1, 0), (2, 95, 155, 1, 95)]
    blocks = [_new_words(55, f"b{i}_") for i in range(6)]
    page = lambda name, n: [w for i, x in enumerate(blocks) for w in x + _new_words(n, f"{name}{i}_")]
    found = _passages_of(spark, page("x", 26), page("y", 29))
    assert found == [(2, 84 * i, 84 * i + 55, 1, 81 * i) for i in range(6)]
    assert _passages_of(spark, a[:20] + _new_words(11, "x") + b[:40], a[:20] + _new_words(11, "y") + b[:40]) == [(2, 0, 71, 1, 0)]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.integers(8, 90), st.integers(0, 20), st.integers(0, 20)), min_size=1, max_size=8), st.integers(0, 20), st.integers(0, 20))
def test_alignments_are_paths_and_their_segments_are_passages(parts, left, right):
    new = iter(range(10**6))
    a, b, xs, ys = [next(new) for _ in range(left)], [next(new) for _ in range(right)], [], []
    for n, da, db in parts:
        xs.append(len(a)), ys.append(len(b))
        run = [next(new) for _ in range(n)]
        a += run + [next(new) for _ in range(da)]
        b += run + [next(new) for _ in range(db)]
    px, py, same, lo, hi = passages.align(np.array(a), np.array(b), xs, ys)
    dx, dy = np.diff(px), np.diff(py)
    assert ((dx == 0) | (dx == 1)).all() and ((dy == 0) | (dy == 1)).all() and (dx + dy > 0).all() and (np.array(a)[px[same]] == np.array(b)[py[same]]).all()
    assert same.sum() == sum(n for n, _, _ in parts)
    found = passages.segments(px, py, same, lo, hi, 50, 0.8)
    for x0, x1, y0, y1, n in found:
        assert min(x1 - x0, y1 - y0) >= 50 and n >= 0.8 * max(x1 - x0, y1 - y0)
    whole = xs[-1] + parts[-1][0] - xs[0], ys[-1] + parts[-1][0] - ys[0]
    assert len(found) == 1 or min(whole) < 50 or same.sum() < 0.8 * max(whole)
    covered = {x for x0, x1, *_ in found for x in range(x0, x1)}
    for (n, _, _), x in zip(parts, xs):
        assert n < 50 or covered >= {*range(x, x + n)}


def test_quantiser_weighs_parallel_error():
    x = np.random.default_rng(1).normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = nearest.Quantiser.fit(x, threshold=0.5)
    plain = nearest.Quantiser(q.books, 1.0)
    at = np.arange(len(q.books))
    along = lambda z: np.abs(((q.split(x)[0] - q.books[at, z.codes(x)]) * q.split(x)[1]).sum((1, 2))).mean()
    assert q.eta > 1 and along(q) < along(plain)
    v = q.tables(x[:1])[0]
    codes = nearest.pack4(q.codes(x[:9])).T
    want = (q.books[at, q.codes(x[:9])] * q.split(x[:1])[0]).sum((1, 2))
    assert np.allclose(sum(t[c] for t, c in zip(v, codes)), want, atol=1e-5)


def test_large_scores_are_exact_or_held_at_the_ends_of_longs():
    q, x = np.array([[2.0**30, 3.0], [2.0**60, 2.0], [-(2.0**60), 2.0]]), np.array([[2.0**20, 1.0], [2.0**20, 1.0], [2.0**20, 1.0]])
    scale = 2**20
    assert topk.exact_scores(q, x / 1024).tolist() == [2**60 + 3 * 1024, 2**63 - 1, -(2**63)]
    local = topk.local_scores(topk.whole(q), topk.whole(x), 2).sum(0)
    exact = [[sum(int(a) * int(b) for a, b in zip(r, c)) * scale for c in x] for r in q]
    assert all(l <= e and abs(l - e) <= abs(e) * 1e-12 for ls, es in zip(local, exact) for l, e in zip(ls, es))  # noqa: E741


def _vectors(spark, v):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id long, v array<double>").repartition(4)


@pytest.mark.parametrize("big", [1.0, 1e7, 1e12, 1e200])
def test_topk_with_large_components(spark, big):
    v = np.round(np.random.default_rng(2).normal(size=(120, 6)), 2)
    v[::7] *= big
    rows = _vectors(spark, v)
    got = [tuple(r) for r in topk.top_k(rows, queries_of(rows, 20), 5).orderBy("query_id", "rank").select("query_id", "vec_id", "score").collect()]
    ints = [[int(c) if abs(c) < 1e300 else 0 for c in (math.floor(1024 * x) for x in r)] for r in v.tolist()]
    want = []
    for q in range(0, 120, 20):
        score = {i: min(max(sum(a * b for a, b in zip(ints[q], ints[i])), -(2**63)), 2**63 - 1) for i in range(120) if i != q}
        want += [(q, i, score[i]) for i in sorted(score, key=lambda i: (-score[i], i))[:5]]
    assert got == want


def test_topk_resolves_few_of_all_rows(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(40, 32))[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows, counts = _vectors(spark, v), []
    got = topk.top_k(rows, queries_of(rows, 100), 10, seen=lambda found: counts.append(found.count()))
    assert got.count() == 400 and 400 <= sum(counts) < 0.05 * 40 * 4000


def test_ties_go_to_smaller_ids(spark):
    v = np.tile(np.eye(4), (30, 1))
    rows = _vectors(spark, v)
    for got in (topk.top_k(rows, queries_of(rows, 40), 7), nearest.search(rows, queries_of(rows, 40), 7)):
        found = {(r["query_id"], r["rank"]): r["vec_id"] for r in got.collect()}
        assert found == {(q, n + 1): i for q in (0, 40, 80) for n, i in enumerate([i for i in range(0, 120, 4) if i != q][:7])}


def test_thousands_of_copies_of_a_vector(spark):
    """More equal candidates than are kept or reranked: the smallest ids are found, and a task keeps k of them for a query."""
    rng = np.random.default_rng(6)
    v = np.concatenate([np.tile(np.round(rng.normal(size=16), 2), (5000, 1)), 0.1 * rng.normal(size=(500, 16))])[rng.permutation(5500)]
    norm = (v**2).sum(1)
    copies = np.flatnonzero(np.abs(norm - np.median(norm)) < 1e-12)
    rows = _vectors(spark, v).repartition(3)
    asked = rows.filter(F.col("id").isin(copies[[3, 900, 4000]].tolist()))
    sizes = []
    for got in (topk.top_k(rows, asked, 10, seen=lambda t: sizes.append(t.count())), nearest.search(rows, asked, 10)):
        found = {(r["query_id"], r["rank"]): r["vec_id"] for r in got.collect()}
        assert found == {(q, n + 1): i for q in copies[[3, 900, 4000]] for n, i in enumerate([i for i in copies if i != q][:10])}
    assert sum(sizes) <= 3 * 10 * rows.rdd.getNumPartitions()


def test_training_rows_are_bounded(spark):
    """One doc_id of a thousand rows: as many as are asked for are fitted on, and rows that are alike are one."""
    docs = spark.range(1000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("words of text "), F.col("id") % 300).alias("text"))
    labels = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    sizes = []
    fit = quality.fit
    quality.fit = lambda slots, stats, y: sizes.append(len(y)) or fit(slots, stats, y)
    try:
        quality.train(docs, labels, 50), quality.train(docs, labels)
        quality.MAX_BYTES, most = 200, quality.MAX_BYTES
        quality.train(docs, labels)
        quality.MAX_BYTES = most
    finally:
        quality.fit = fit
    assert sizes[:2] == [50, 300] and 0 < sizes[2] < 50


@pytest.mark.parametrize("clusters", [0, 50])
def test_nearest_recall_with_few_reranked(spark, clusters):
    """20,000 vectors of which 2 % are reranked; 200 of them are queries."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(20_000, 64))
    if clusters:
        v = v[:clusters][rng.integers(0, clusters, 20_000)] + 0.5 * v
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = _vectors(spark, v)
    got = {}
    for r in nearest.search(rows, queries_of(rows, 100), 20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 20_000, 100):
        score = v @ v[q]
        score[q] = -np.inf
        hits += len(got[q] & {*np.argsort(-score)[:20].tolist()})
    assert hits >= 0.9 * 20 * 200


@pytest.mark.parametrize("kind", ["lengths", "near copies", "both"])
def test_nearest_of_uneven_vectors(spark, kind):
    """Vectors of very different lengths, and thousands that lie closer together than the codebooks tell apart."""
    rng = np.random.default_rng(12)
    v = rng.normal(size=(6000, 32))
    if kind != "lengths":
        v = v[:3][rng.integers(0, 3, 6000)] + 0.01 * rng.normal(size=(6000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if kind != "near copies":
        v *= np.exp(1.5 * rng.normal(size=(6000, 1)))
    rows = _vectors(spark, v)
    got = {}
    for r in nearest.search(rows, queries_of(rows, 100), 20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 6000, 100):
        score = v @ v[q]
        score[q] = -np.inf
        hits += len(got[q] & {*np.argsort(-score)[:20].tolist()})
    assert hits >= 0.99 * 20 * 60


def _water(budget, nodes):
    """Shares of (weight, room) by filling the fullest in turn."""
    share, open_ = [0.0] * len(nodes), {i for i, (w, r) in enumerate(nodes) if w > 0}
    left = budget
    while open_:
        total = sum(nodes[i][0] for i in open_)
        full = {i for i in open_ if left * nodes[i][0] / total >= nodes[i][1]}
        if not full:
            for i in open_:
                share[i] = left * nodes[i][0] / total
            break
        for i in full:
            share[i] = nodes[i][1]
        left -= sum(nodes[i][1] for i in full)
        open_ -= full
    return share


@pytest.mark.parametrize("budget", [0, 10, 300, 1000, 10_000])
def test_budgets_go_to_siblings_first(spark, budget):
    rng = random.Random(budget)
    leaves = [(f"d{i % 3}", f"l{i % 4}", f"s{i}", rng.randint(0, 120)) for i in range(36)]
    weights = {"domain": {("d0",): 5.0, ("d1",): 1.0}, "lang": {("d0", "l1"): 0.0, ("d2", "l2"): 7.0}}
    want, room = {}, lambda f: sum(n * 1.5 for *p, n in leaves if f(p))

    def down(path, given):
        depth = len(path)
        if depth == 3:
            want[path] = given
            return
        kids = sorted({tuple(p[: depth + 1]) for *p, _ in leaves if tuple(p[:depth]) == path})
        level = mixing.TREE[depth]
        nodes = [(weights.get(level, {}).get(k, 1.0), room(lambda p, k=k: tuple(p[: depth + 1]) == k)) for k in kids]
        for k, s in zip(kids, _water(given, nodes)):
            down(k, s)

    down((), float(budget))
    tables = {level: spark.createDataFrame([(*k, w) for k, w in rows.items()], [*mixing.TREE[: len(next(iter(rows)))], "weight"]) for level, rows in weights.items()}
    df = spark.createDataFrame(leaves, [*mixing.TREE, "tokens"])
    got = {tuple(r[c] for c in mixing.TREE): r["target"] for r in mixing.leaf_budgets(df, tables, budget, 1.5).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1.001 for k in want)


def test_mix_takes_the_longest_prefix(spark):
    rng = random.Random(5)
    rows = [(i, "d", "en" if i % 3 else "de", "s", rng.randint(0, 9)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long")
    got = mixing.mix(docs, {}, 3000.0, epochs=2, seed=4).collect()
    again = mixing.mix(docs.repartition(7), {}, 3000.0, epochs=2, seed=4).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    plan = {r["lang"]: (r["tokens"], r["target"]) for r in mixing.leaf_budgets(docs.groupBy(*mixing.TREE).agg(F.sum("n_tokens").alias("tokens")), {}, 3000.0, 2).collect()}
    for lang, (total, target) in plan.items():
        whole, over = divmod(target, total)
        mine = docs.filter(F.col("lang") == lang).withColumn("epoch", F.lit(whole)).withColumn("at", mixing.order_key(F.col("doc_id"), 4).bitwiseAND(F.lit(2**50 - 1)))
        placed = sorted((r["at"] >> 40, r["at"], r["doc_id"], r["n_tokens"]) for r in mine.withColumn("at", F.col("at")).collect())
        placed.sort(key=lambda r: (r[0] % mixing.PARTS, r[1], r[2]))
        want, used = set(), 0
        for _, _, k, n in placed:
            if used + n > over:
                break
            used += n
            want.add(k)
        assert {r["doc_id"] for r in got if r["lang"] == lang and r["epoch"] == whole} == (want if over else set())
        for e in range(whole):
            assert {r["doc_id"] for r in got if r["lang"] == lang and r["epoch"] == e} == {r[0] for r in rows if r[2] == lang}


def test_license_within_a_long_text(spark):
    filler = " ".join(f"w{i}" for i in range(997))
    notice = "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, f"{filler} {notice} {filler}"), (2, notice[:-3]), (3, "licensed under the apache"), (4, notice.upper())]
    found = {(r["doc_id"], r["template"], r["first_word"]) for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(1, "gpl-3.0", 997), (2, "gpl-3.0", 0), (4, "gpl-3.0", 0)}
