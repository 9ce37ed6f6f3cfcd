"""Conversation repair, tokenizer alignment and decontamination against plain computations, and on awkward rows."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tracemill.llm import alignment, conversations, decontaminate
from tracemill.llm.registry import QUERIES
from tracemill.llm.tokens import vocabulary_path

SPACE = " \t\n\x0b\x0c\r"
AFTER = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        part = zlib.crc32(":".join(" " if v is None else str(v) for v in (c, t)).encode()) % 20
        if part:
            x = "" if part == 1 else re.sub("[.!?]", "", x) if part == 2 else x
            out += [(c, t, "user" if part == 4 else r, x)] * (2 if part == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, r, x in rows:
        bare = x.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def repaired(rows):
    """gaps, faults, illegal, cost, audit and digest by uniform-cost search over (cost, audit)."""
    f = faults(rows)
    done, heap = set(), [(0, "", 0, 0, ())]
    while True:
        cost, audit, i, q, out = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            break
        if (i, q) in done:
            continue
        done.add((i, q))
        puts = [(r, AFTER[q][r[0]]) for r in ("user", "assistant") if r[0] in AFTER[q]]
        for role, to in puts:
            heapq.heappush(heap, (cost + 3, audit + "I", i, to, (*out, f"{role}:")))
        if i < len(rows):
            _, r, x = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q, out))
            if f[i] in ("", "truncated"):
                cut = 3 * (f[i] == "truncated")
                if r[:1] in AFTER[q]:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, AFTER[q][r[:1]], (*out, f"{r}:{x}")))
                for role, to in puts:
                    heapq.heappush(heap, (cost + cut + 3, audit + "R", i + 1, to, (*out, f"{role}:{x}")))
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len({*turns}) if turns else 0
    return gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def in_order(rows):
    return sorted(rows, key=lambda r: ((0, 0) if r[0] is None else (1, r[0]), r[1].encode(), r[2][:64].encode(), hashlib.md5(r[2].encode()).hexdigest()))


def whole(rows):
    by = {c: [] for c, *_ in rows}
    for c, *row in damage(rows):
        by[c].append(tuple(row))
    return {c: repaired(in_order(v)) for c, v in by.items()}


def test_op11_equals_uniform_cost_search(spark, duck):
    rows = duck.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op11_conversations"](spark, DATA).collect()}
    assert got == whole(rows) and got


def test_searches_and_chunks_give_the_least_audit():
    rnd = random.Random(1)
    for n in [*range(26)] * 20:
        rows = [(i, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool"]), rnd.choice(["a.", "b", "", f"d {i}.", f"e {i}.", f"f {i}"])) for i in range(n)]
        codes = ["suax".find(r[0] if r[0] in "sua" else "x") + {"": 0, "truncated": 4}.get(f, 8) for (_, r, _), f in zip(rows, faults(rows))]
        want = repaired(rows)[5:7]
        assert conversations.Search(codes, None).best(0) == want
        if n:
            tables = [conversations.tables(codes[i : i + 5]) for i in range(0, n, 5)]
            way = conversations.through(np.array([t[0] for t in tables]), np.array([t[1] for t in tables]))
            assert "".join(t[2][4 * q + to] for t, (q, to) in zip(tables, way)) + conversations.TAIL[way[-1][1]] == want[1]


def test_failed_states_are_not_searched_again():
    search = conversations.Search([0, 1, 2, 3, 5, 6] * 10, None)
    calls, under = [], search.under
    search.under = lambda *a: calls.append(a[:2]) or under(*a)
    search.best(0)
    assert len(calls) < 20 * 60 * 4


def test_conversations_on_awkward_rows(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(None, None, None, None), (None, 3, "user", "x."), (None, 3, "user", "x."), (7, None, "user", "q"), (7, None, "assistant", "q."), (8, 1, "", ""), (8, 5, "user", " \n")]
    rows += [(9, i // 2, rnd.choice(["user", "assistant", "system", "x"]), rnd.choice(["same.", f"t {i}.", f"u {i}", f"v {i}!"])) for i in range(700)]
    rows += [(10, 5, "user", "copy.")] * 300 + [(11, 1, "user", "long " * 200_000 + "end.")] + [(c, 0, "user", "dropped.") for c in range(100, 140)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("cid", "part", "id", "n", "cost")})
    df.repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op11_conversations"](spark, str(tmp_path)).collect()}
    want = whole(rows)
    assert got == want and any(v[6] == "" for v in want.values())
    none = spark.createDataFrame([], df.schema)
    summary, kept = conversations.repair(none)
    assert summary.count() == 0 and kept.count() == 0 and conversations.digests(kept).count() == 0


def test_repair_gives_the_rows(spark):
    rows = spark.createDataFrame([(1, 0, "system", "Be brief."), (1, 1, "user", "Well?"), (1, 2, "user", "Well, well?"), (1, 3, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    summary, kept = conversations.repair(rows)
    assert summary.first()["audit"] == "KKIKK"
    got = [(r["role"], r["text"]) for r in kept.orderBy("conv_id", "part", "seg", "at").collect()]
    assert got == [("system", "Be brief."), ("user", "Well?"), ("assistant", ""), ("user", "Well, well?"), ("assistant", "Yes.")]


def both_bytes(text):
    """Ids and bytes of a text's tokens, from the libraries themselves."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(both_bytes, "models"):
        a = Tokenizer.from_file(vocabulary_path())
        a.encode_special_tokens = True
        both_bytes.models = a, sentencepiece.SentencePieceProcessor(model_file=alignment.pieces_path())
    a, b = both_bytes.models
    visible = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    byte = {chr(c): c for c in visible} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in visible)}
    left = a.encode(" " + text, add_special_tokens=False)
    right = b.encode(text)
    pieces = [b.id_to_piece(i) for i in right]
    return list(zip(left.ids, [bytes(byte[c] for c in t) for t in left.tokens])), list(zip(right, [bytes([int(p[3:-1], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in pieces]))


def aligned(text):
    """n_a, n_b, groups and linked id pairs, byte by byte."""
    if not text:
        return None
    a, b = both_bytes(text)
    raw = (" " + text).encode()
    if b"".join(t for _, t in a) != raw or b"".join(t for _, t in b) != raw:
        return None
    of = [[i for i, (_, t) in enumerate(x) for _ in t] for x in (a, b)]
    links = sorted({*zip(*of)})
    groups, left, right = [], [], []
    for k in range(len(raw)):
        ends = [k + 1 == len(raw) or o[k] != o[k + 1] for o in of]
        left += [str(a[of[0][k]][0])] * ends[0]
        right += [str(b[of[1][k]][0])] * ends[1]
        if all(ends):
            groups.append(",".join(left) + "|" + ",".join(right))
            left, right = [], []
    return len(a), len(b), groups, [(a[i][0], b[j][0]) for i, j in links]


def alignment_of(texts):
    found = {k: aligned(t) for k, t in texts.items()}
    n = collections.Counter(p for v in found.values() if v for p in {*v[3]})
    best = collections.Counter()
    for (a, _), m in n.items():
        best[a] = max(best[a], m)
    none = (0, 0, 0, 0, 0, 0, "")
    return {k: none if v is None else (v[0], v[1], len(v[2]), len(v[3]), sum(n[p] == best[p[0]] for p in v[3]), sum(n[p] for p in v[3]), hashlib.sha256(";".join(v[2]).encode()).hexdigest()) for k, v in found.items()}


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_op12_equals_a_walk_over_bytes(spark, duck):
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_alignment"](spark, DATA).collect()}
    assert got == alignment_of(texts) and got


ODD = ["", None, " ", "\n\n x  y\t", "Ä é 漢字 🙂 <|endoftext|> <s> </s> <0x41>", "a▁b", "\u0000 nul", "of " * 3000, "ﬁ ½  x", "word", "x" * 5000, "long words here. " * 20_000]


def test_alignment_on_awkward_texts(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(9, "word"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "pairs", "n_a", "groups")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op12_alignment"](spark, str(tmp_path)).collect()
    want = alignment_of({i: t for i, (_, t) in enumerate(rows)})
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, *(r[c] for c in COLUMNS)) for r in got) == sorted((rows[i][0] if rows[i][0] is not None else -1, *v) for i, v in want.items())
    assert want[5][0] == 0 and want[4][0] > 0  # a text of U+2581 isn't given back, strings of special tokens are plain text
    assert alignment.alignments(docs.limit(0)).count() == 0


def test_counts_may_be_joined(spark):
    """Beyond the bound of a broadcast the same counts come by a join."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    found = alignment.alignments(docs).cache()
    counts = alignment.pair_counts(found)
    a, b = (sorted(map(tuple, alignment.link_scores(found, counts, "doc_id", most).collect())) for most in (0, 10**6))
    assert a == b and len(a) == 40


def test_products_equal_dense_ones():
    rng = np.random.default_rng(3)
    for _ in range(30):
        x, y = (rng.integers(0, 3, s) * (rng.random(s) < 0.3) for s in ((7, 9), (9, 5)))
        rows = [alignment.Csr(np.concatenate([[0], np.cumsum((m > 0).sum(1))]), np.nonzero(m)[1], m.shape[1], m[m > 0]) for m in (x, y)]
        dense = lambda m: np.array([[m.values[m.starts[i] : m.starts[i + 1]][m.columns[m.starts[i] : m.starts[i + 1]] == j].sum() for j in range(m.width)] for i in range(m.height)])
        assert (dense(rows[0].times(rows[1])) == x @ y).all() and (dense(rows[0].transposed()) == x.T).all() and (rows[0].sums() == x.sum(1)).all()
        a, b = (np.unique(np.append(rng.integers(1, 30, 8), 30)) for _ in "ab")
        shared = dense(alignment.shared_groups(a, b))
        cuts = np.intersect1d(a, b)
        assert (shared == (np.searchsorted(cuts, a)[:, None] == np.searchsorted(cuts, b)[None, :])).all()
        low = lambda e: np.concatenate([[0], e[:-1]])
        bytes_both = np.minimum(a[:, None], b[None, :]) - np.maximum(low(a)[:, None], low(b)[None, :])
        assert (dense(alignment.overlaps(a, b)) == np.maximum(bytes_both, 0)).all()


def hits(docs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    windows = collections.defaultdict(set)
    for k, t in items:
        w = split(t)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            windows[tuple(w[i : i + window])].add("" if k is None else str(k))
    sizes = {len(w) for w in windows}
    out = []
    for k, t in docs:
        w = split(t)
        hit, own = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    own |= found
        out.append((-1 if k is None else k, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_decontamination_on_awkward_rows(spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    items = [(1, " ".join(words[:25])), (2, "Only, four words-here!"), (3, "one"), (4, None), (5, ""), (6, "..."), (None, " ".join(words[30:42])), (7, " ".join(words[5:16])), (7, "Ä six word item Über ñ"), (10, " ".join(words[:25])), (11, "a a a a a a a a a a a a")]
    docs = [(1, " ".join(words)), (1, " ".join(words)), (2, None), (3, ""), (4, "--- \n"), (5, "ONLY four; words here and only four words"), (None, "one two"), (6, " ".join(words[:9])), (7, " ".join(words[3:15]) + " x " + " ".join(words[30:40])), (8, "filler text " * 60_000 + " ".join(words[8:19])), (9, "ä six word item über ñ Ä six word item Über ñ"), (12, "a " * 30), (13, " ".join(words[:25]) + "\u0000" + " ".join(words[5:16]))]
    spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "words", "n_words", "runs", "spans")}).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("key", "words")}).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], *tuple(r)[1:]) for r in QUERIES["op13_decontaminate"](spark, str(tmp_path)).collect())
    want = hits(docs, items)
    assert got == want and sum(r[5] for r in want) > 5
    a, b = (spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("documents", "benchmark"))
    assert decontaminate.contamination(a.limit(0), b).count() == 0
    assert [r["n_words"] for r in decontaminate.contamination(a, b.limit(0)).filter("size(spans) > 0").collect()] == []
    clean = {r["doc_id"] for r in decontaminate.without_contamination(a, b).collect()}
    assert clean == {2, 3, 4, 6}


def test_copies_are_matched_once(spark):
    """Thousands of copies of a passage make one text to match, and a hot shingle is no prefix where rarer ones are."""
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("before "), F.lit(passage), F.lit(" after")).alias("text"))
    items = spark.createDataFrame([(1, passage), (2, passage + " rare end of it all")], "item_id long, text string")
    rows = decontaminate.contamination(docs, items).collect()
    assert len(rows) == 3000 and all([(s["low"], s["high"]) for s in r["spans"]] == [(1, 21)] and r["item_ids"] == ["1", "2"] for r in rows)


@pytest.mark.parametrize("n", [1, 3, 5])
def test_shingle_hashes_tell_texts_apart(n):
    texts = [b"a b c d e f", b"", b"a b c d e", b"x", b"b c d e f g"]
    hashes, at = decontaminate.shingle_hashes(texts, n)
    flat = [w for t in texts for w in t.split(b" ")]
    assert len({*hashes}) == len({tuple(flat[i : i + n]) for i in at}) and len(at) == sum(max(0, len(t.split()) - n + 1) for t in texts)
