"""The pipeline on the smallest tables: what each stage must have achieved, checked plainly."""

import collections
import random
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import DATA
from tests.llm.test_against_brute_force import plain_score, words
from tracemill.functions.scratch import stored
from tracemill.llm import quality, similar, tokens
from tracemill.llm.simhash import fingerprints
from tracemill.operators.graph import components


@pytest.fixture(scope="module")
def steps(spark):
    at = spark.read.parquet(f"{DATA}/documents.parquet")
    out = {"given": at}
    for name, stage in corpus_pipeline.STAGES:
        at = stored(stage(spark, at, DATA), name)
        out[name] = at
    return out


def test_columns_and_order(steps):
    names = ["quality", "near_duplicates", "passages", "mixing", "packing"]
    assert [n for n, _ in corpus_pipeline.STAGES] == names
    for n in names[:-1]:
        assert steps[n].columns == steps["given"].columns


def test_each_stage_keeps_some_of_its_input(steps):
    ids = {n: {r["doc_id"] for r in df.select("doc_id").collect()} for n, df in steps.items()}
    order = ["given", "quality", "near_duplicates", "passages", "mixing", "packing"]
    for a, b in zip(order, order[1:]):
        assert ids[b] <= ids[a]
    assert len(ids["quality"]) < len(ids["given"]) and len(ids["near_duplicates"]) < len(ids["quality"])
    assert ids["passages"] == ids["near_duplicates"] and ids["packing"] == ids["mixing"] and 0 < len(ids["mixing"]) < len(ids["passages"])


def test_no_near_duplicates_remain(steps):
    prints = [r["fp"] & (2**64 - 1) for r in fingerprints(steps["near_duplicates"]).collect()]
    assert not any((a ^ b).bit_count() <= 4 for i, a in enumerate(prints) for b in prints[:i])


def test_no_long_run_repeats(steps):
    seen, repeated = {}, collections.Counter()
    for r in steps["passages"].orderBy("doc_id").collect():
        w = words(r["text"])
        if len({*w}) * 4 < len(w):
            continue  # a few words over and over
        for i in range(len(w) - 59):
            run = tuple(w[i : i + 60])
            repeated[r["doc_id"]] += seen.setdefault(run, r["doc_id"]) != r["doc_id"]
    assert not +repeated
    given = {r["doc_id"]: r["text"] for r in steps["near_duplicates"].collect()}
    changed = [r for r in steps["passages"].collect() if r["text"] != given[r["doc_id"]]]
    assert all(len(re.findall(r"\S+", r["text"])) <= len(re.findall(r"\S+", given[r["doc_id"]])) - 50 and r["n_chars"] == len(r["text"]) for r in changed)


def test_run_is_the_stages(spark, steps):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).select(*columns).collect())) == sorted(map(tuple, steps["packing"].select(*columns).collect()))


def _least_of_group(rows):
    """The least doc_id of each row's group, by the similarity of all pairs."""
    sets = {}
    for k, text in rows:
        w = words(text)
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in sets}


def test_near_duplicates_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghijklmnopqrst") + str(rng.randrange(300))
    rows = [(10**6, ""), (10**6 + 1, None), (10**6 + 2, "one two"), (10**6 + 3, "One  two"), (10**6 + 4, "two")]
    for b in range(20):
        base = [word() for _ in range(rng.choice([12, 60, 300, 900]))]
        for v in range(12):
            changed = [w if rng.random() > v / 200 else word() for w in base]
            rows.append((b * 100 + v, " ".join(changed)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = _least_of_group([(k, t or "") for k, t in rows])
    assert {r["doc_id"]: r["component_id"] for r in similar.similar_groups(docs).collect()} == want
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, DATA).collect()]
    assert sorted(kept) == sorted({*want.values()}) and 20 < len(kept) < 200


def test_rows_of_one_id_are_told_apart(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, a, "en"), (5, b, "en"), (5, a, "de"), (4, c, "en"), (9, b, "en"), (None, b, "en"), (3, None, "en"), (7, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("hash", F.lit("x"))
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, DATA).collect()]
    assert sorted(kept, key=str) == sorted([(5, a), (5, b), (4, c), (None, b), (3, None)], key=str)


def test_the_pipeline_against_plain_stages(spark, steps):
    """What the stages keep, from the classifier's scores on: groups by all pairs, and pieces of what the mix kept."""
    model = quality.train(steps["given"], spark.read.parquet(f"{DATA}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in steps["given"].collect()}
    good = {k for k, t in texts.items() if plain_score(model, t) >= 0.3}
    assert {r["doc_id"] for r in steps["quality"].collect()} == good
    groups = _least_of_group([(k, texts[k] or "") for k in good])
    assert {r["doc_id"] for r in steps["near_duplicates"].collect()} == {*groups.values()}
    kept = {r["doc_id"]: r["text"] for r in steps["mixing"].collect()}
    assert kept.items() <= {r["doc_id"]: r["text"] for r in steps["passages"].collect()}.items()
    assert sum(len(words(t)) for t in kept.values()) <= 0.8 * sum(len(words(r["text"])) for r in steps["passages"].collect())
    e = tokens.encoder(tokens.vocabulary_path())
    want = collections.Counter()
    for k, t in kept.items():
        want[k] = len(e.model.encode(t or "", add_special_tokens=False).ids) + 1
    got, bins = collections.Counter(), collections.Counter()
    for r in steps["packing"].collect():
        got[r["doc_id"]] += r["length"]
        bins[r["sequence_id"]] += r["length"]
    assert got == want and max(bins.values()) <= 1024 and len(bins) <= 1.01 * sum(want.values()) / 1024 + 2


@pytest.mark.parametrize("group, most", [(8, 10**6), (1024, 40), (1024, 10**6)])
def test_large_groups_are_dealt_into_parts(spark, group, most):
    rows = [(i, 1, i, 5, bytes([i % 3]) * similar.BANDS * similar.ROWS, [100 * (i % 3) + j for j in range(5)]) for i in range(60)]
    keyed = spark.createDataFrame(rows, "node long, key long, root long, size int, sketch binary, shingles array<long>")
    found = components(similar.linked(keyed, group, most)).collect()
    assert len(found) == 60 and {(r["node"], r["root"]) for r in found} == {(i, i % 3) for i in range(60)}


def test_links_of_a_group_are_those_of_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**62, 60)
    sets = [np.unique(np.where(rng.random(60) < rng.choice([0.02, 0.06, 0.12]), rng.integers(0, 2**62, 60), base)).astype(np.uint64) for _ in range(80)] + [np.zeros(0, np.uint64)]
    sketch = np.stack([(similar.minhashes(x) >> np.uint64(7)).astype(np.uint8) for x in sets])
    size = np.array([len(x) for x in sets])
    a, b = similar.link_run(np.arange(81), np.arange(81), size, sketch, np.concatenate(sets).view(np.int64))
    every = [(i, j) for i in range(80) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]

    def groups(pairs):
        root = list(range(81))
        for x, y in pairs:
            old, new = root[x], root[y]
            root = [new if r == old else r for r in root]
        return {tuple(i for i in range(81) if root[i] == r) for r in root}

    assert groups(zip(a, b)) == groups(every) and len(a) == 81 - len(groups(every)) and 2 < len(groups(every)) < 81


def test_the_stage_leaves_what_all_pairs_leave(steps):
    want = _least_of_group([(r["doc_id"], r["text"]) for r in steps["quality"].collect()])
    assert {r["doc_id"] for r in steps["near_duplicates"].collect()} == {*want.values()}
