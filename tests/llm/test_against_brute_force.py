"""Each operator's query, over its whole table, against a plain computation of the same result."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F
from tests.conftest import DATA
from tracemill.llm import katz, mixing, quality, registry, tokens
from tracemill.llm.registry import QUERIES, SQL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, same):
    same(QUERIES[name], SQL[name])


def test_all_are_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES} == set(range(1, 14))


def test_op1_recall(spark, duck):
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY 1").fetchall()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = collections.defaultdict(list)
    for r in QUERIES["op1_nearest"](spark, DATA).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in ids[ids % 20 == 0]:
        score = v @ v[ids == q][0]
        other = ids != q
        best = {*ids[other][np.lexsort([ids[other], -score[other]])[:20]]}
        found = got[q]
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True) and len(found) == 20
        assert all(abs(s - score[ids == i][0]) < 1e-12 for i, s in found)
        hits += len(best & {i for i, _ in found})
    assert hits >= 0.9 * 20 * (ids % 20 == 0).sum()


def test_op2_components(spark, docs):
    prints = []
    for _, text in docs:
        w = words(text)
        shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    group = list(range(len(docs)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    want = {(docs[i][0], f"{prints[i]:016x}", docs[find(i)][0]) for i in range(len(docs))}
    assert {tuple(r) for r in QUERIES["op2_simhash"](spark, DATA).select("doc_id", "fingerprint", "component_id").collect()} == want


def test_op3_katz(spark, docs):
    text = {k: [*words(t), "\n"] for k, t in docs}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in text}
    count, pairs, context = collections.Counter(), collections.Counter(), collections.Counter()
    for k, w in text.items():
        if not held[k]:
            both = list(zip([" ", *w[:-1]], w))
            count.update(w), pairs.update(both), context.update(a for a, _ in both)
    n, whole = sum(count.values()), sum(count.values()) + 0.1 * (len(count) + 1)
    spectrum = np.bincount([r for r in pairs.values() if r <= katz.K + 1], minlength=katz.K + 2).astype(float)
    d = katz.discounts(spectrum)
    discounted = lambda r: (d[r] if r <= katz.K else 1.0) * r
    base = lambda w: (count.get(w, 0) + 0.1) / whole
    left, free = collections.defaultdict(lambda: 1.0), collections.defaultdict(lambda: 1.0)
    for (a, b), r in pairs.items():
        left[a] -= discounted(r) / (context[a] + 0.1)
        free[a] -= base(b)

    def p(a, b):
        r = pairs.get((a, b), 0)
        return discounted(r) / (context[a] + 0.1) if r else left[a] / free[a] * base(b)

    for a in ("the", "of", " "):  # every context's probabilities add up to 1
        assert abs(sum(p(a, b) for b in count) + p(a, "never seen") - 1) < 1e-9
    rows = {r["doc_id"]: r for r in QUERIES["op3_katz"](spark, DATA).collect()}
    assert len(rows) == len(docs)
    for k, w in text.items():
        r = rows[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(w), sum(x in count for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10(base(x)) for x in w), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(a, b)) for a, b in zip([" ", *w[:-1]], w)), rel_tol=1e-9)
    assert sum(r["score"] for r in rows.values() if r["held_out"]) > sum(r["base_score"] for r in rows.values() if r["held_out"])


def test_op4_section_tokens(spark, docs):
    model = tokens.encoder(tokens.vocabulary_path()).model
    got = collections.defaultdict(list)
    for r in QUERIES["op4_section_tokens"](spark, DATA).orderBy("doc_id", "section").collect():
        got[r["doc_id"]].append((r["start"], r["stop"], r["n_tokens"], r["n_crossing"]))
    for k, text in docs:
        lines = text.splitlines(keepends=True) if "\r" not in text else [x + "\n" for x in text.split("\n")]
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        ends = np.cumsum([len(x.encode()) for x in lines])
        counts, crossed = [0] * len(lines), [0] * len(lines)
        at = 0
        for token in model.encode(text, add_special_tokens=False).tokens:
            over = [max(0, min(e, at + len(token)) - max(s, at)) for s, e in zip([0, *ends[:-1]], ends)]
            best = over.index(max(over))
            counts[best] += 1
            crossed[best] += sum(o > 0 for o in over) > 1
            at += len(token)
        stops = np.cumsum([len(x) for x in lines])
        assert got[k] == list(zip([0, *stops[:-1]], stops, counts, crossed))


def test_op6_finds_every_repeated_run(spark, docs):
    covered = collections.defaultdict(lambda: collections.defaultdict(bool))
    for r in QUERIES["op6_passages"](spark, DATA).collect():
        assert r["other_id"] < r["doc_id"]
        for i in range(r["start"], r["stop"]):
            covered[r["doc_id"]][i] = True
    seen, missed, total = set(), 0, 0
    for k, text in docs:
        w = words(text)
        if len({*w}) * 4 < len(w):
            continue  # a few words over and over: such runs match in many ways
        runs = {tuple(w[i : i + 60]): i for i in range(len(w) - 59)}
        for run, i in runs.items():
            if run in seen:
                total += 1
                missed += sum(covered[k][j] for j in range(i, i + 60)) < 58
        seen |= runs.keys()
    assert total and not missed


def test_op8_pieces_and_sequences(spark, docs):
    model = tokens.encoder(tokens.vocabulary_path()).model
    rows = QUERIES["op8_pack"](spark, DATA).collect()
    got = {(r["doc_id"], r["piece"]): r for r in rows}
    total = 0
    for k, text in docs:
        ids = np.array([*model.encode(text, add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        at = piece = 0
        while at < len(ids):
            step = 1024 if at or len(ids) % 1024 == 0 else len(ids) % 1024
            r = got.pop((k, piece))
            assert (r["start"], r["length"], r["ids_crc32"]) == (at, step, zlib.crc32(ids[at : at + step].tobytes()))
            at, piece = at + step, piece + 1
    assert not got
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 1024
    assert len(bins) <= 1.005 * total / 1024 + 2


def plain_score(model, text):
    """The machine's score from its definition: all pairs of features."""
    slots, stats = quality.text_features((text or "").encode())
    x = {int(s): 1 / math.sqrt(max(len(slots), 1)) for s in slots}
    for i, (edges, v) in enumerate(zip(model.edges, stats)):
        x[quality.SLOTS + i * quality.BINS + sum(e <= v for e in edges)] = 1.0
    at, value = np.array(list(x)), np.array(list(x.values()))
    f = model.v[at].astype(float) * value[:, None]
    pairs = sum(float(f[i] @ f[:i].sum(0)) for i in range(1, len(f)))
    return 1 / (1 + math.exp(-(model.bias + float(model.w[at].astype(float) @ value) + pairs)))


def test_op9_scores_are_those_of_the_definition(spark, docs):
    """Linear-time scores against the sum over all pairs of features."""
    table = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    model = quality.train(table, spark.read.parquet(f"{DATA}/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in QUERIES["op9_quality"](spark, DATA).collect()}
    assert len(got) == len(docs)
    for k, text in docs:
        assert abs(got[k] - plain_score(model, text)) < 1e-4


def test_op7_mix(spark, docs):
    """The query against a plain walk down the tree and along each leaf's seeded order."""
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    order = table.crossJoin(spark.range(3).select(F.col("id").cast("int").alias("epoch"))).select("doc_id", "lang", "source", "text", "epoch", mixing.order_key(F.col("doc_id"), 17).bitwiseAND(F.lit(2**50 - 1)).alias("place"))
    leaves = collections.defaultdict(dict)
    for r in order.collect():
        domain = "domain" + str(zlib.crc32((r["source"] or "").encode()) % 4)
        leaves[domain, r["lang"], r["source"]][r["doc_id"], r["epoch"]] = ((r["place"] >> 40) % mixing.PARTS, r["place"], len(words(r["text"])))
    total = {leaf: sum(n for (_, e), (_, _, n) in d.items() if e == 0) for leaf, d in leaves.items()}

    def weight(path):
        if len(path) == 1:
            return int(path[0][-1]) + 1.0
        return 3.0 if path[1:] == ("en",) else 1.0

    share = {}

    def down(path, given):
        if len(path) == 3:
            share[path] = given
            return
        open_ = {leaf[: len(path) + 1] for leaf in total if leaf[: len(path)] == path}
        room = {k: 2.0 * sum(n for leaf, n in total.items() if leaf[: len(k)] == k) for k in open_}
        kids, left = sorted(open_, key=str), given
        while open_:
            whole = sum(weight(k) for k in open_)
            full = {k for k in open_ if left * weight(k) / whole >= room[k]}
            for k in full or open_:
                down(k, room[k] if full else left * weight(k) / whole)
            if not full:
                break
            left -= sum(room[k] for k in full)
            open_ -= full
        assert kids

    down((), 0.6 * sum(total.values()))
    want = set()
    for leaf, d in leaves.items():
        whole, over = divmod(math.floor(share[leaf] + 1e-6), max(total[leaf], 1))
        for epoch in range(whole + 1):
            used = 0
            for (k, e), (_, _, n) in sorted(((x, y) for x, y in d.items() if x[1] == epoch), key=lambda p: (*p[1][:2], p[0][0])):
                used += n
                if epoch == whole and (used > over or not over):
                    break
                want.add((*leaf, k, n, epoch))
    got = {tuple(r[c] for c in ("domain", "lang", "source", "doc_id", "n_tokens", "epoch")) for r in QUERIES["op7_mix"](spark, DATA).collect()}
    assert got == want and want


def test_op9_held_out_accuracy(spark, duck):
    rows = {r["doc_id"]: r for r in QUERIES["op9_quality"](spark, "/root/testdata/sf0.01").collect()}
    labels = duck.execute("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall()
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for k, r in rows.items())
    held = [(rows[k]["predicted"], q) for k, q in labels if rows[k]["held_out"]]
    assert sum(p == q for p, q in held) / len(held) > 0.93


def test_op10_equals_brute_force(spark, duck):
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY 1").fetchall()
    ids, v = np.array([r[0] for r in rows]), np.floor(1024 * np.array([r[1] for r in rows], float)).astype(int)
    got = [tuple(r) for r in QUERIES["op10_topk"](spark, DATA).orderBy("query_id", "rank").select("query_id", "rank", "vec_id", "score").collect()]
    want = []
    for q in ids[ids % 100 == 0]:
        score, other = v @ v[ids == q][0], ids != q
        best = np.lexsort([ids[other], -score[other]])[:10]
        want += [(q, n + 1, ids[other][i], score[other][i]) for n, i in enumerate(best)]
    assert got == want
