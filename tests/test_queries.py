"""Every query against its SQL on the smallest tables; those that SQL can't express against brute force."""

import difflib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.jobs import registry
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(name, same):
    same(registry.QUERIES[name], registry.SQL[name])


def test_only_known_queries_lack_sql():
    assert set(registry.QUERIES) - set(registry.SQL) == {"html_extract", "bootstrap_ci", "fuzzy_title"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25


def test_html_extract_drops_chrome(spark):
    rows = registry.QUERIES["html_extract"](spark, DATA).collect()
    assert len(rows) == 50 and all(r["title"] and r["body"] for r in rows)
    assert not any("track(" in r["body"] or "<p" in r["body"] for r in rows)


def test_bootstrap_equals_a_plain_one(spark, duck):
    rows = duck.execute("SELECT doc_id, CAST(quality AS DOUBLE) - (1.0 - toxic) FROM labels").fetchall()
    hashes = {r["doc_id"]: r["h"] for r in spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    total, weight = np.zeros(5000), np.zeros(5000)
    for k, v in rows:
        w = np.random.default_rng([1234, hashes[k] & (2**64 - 1)]).poisson(1.0, 5000)
        total += w * v
        weight += w
    means = np.sort(total / weight)
    row = registry.QUERIES["bootstrap_ci"](spark, DATA).first()
    assert abs(row["low"] - means[125]) < 1e-12 and abs(row["high"] - means[4875]) < 1e-12
    assert row["low"] < sum(v for _, v in rows) / len(rows) < row["high"]


def test_fuzzy_title_equals_all_pairs(spark, duck):
    rows = duck.execute("SELECT p_partkey, p_name FROM part").fetchall()
    titles = sorted({" ".join(n.lower().split()) for _, n in rows})
    want = {}
    for k, name in rows:
        q = re.sub(r"[^a-z0-9_]+", " ", (name[:3] + name[4:]).lower()).strip()
        ratio = lambda a, t: difflib.SequenceMatcher(None, t, a).ratio()
        found = {t: (0, -ratio(q, t)) for t in titles if ratio(q, t) >= 0.6}
        for w in {*q.split()} if " " in q else ():
            near = sorted((-ratio(w, t), t) for t in titles if ratio(w, t) >= 0.75)[:2]
            for r, t in near:
                found[t] = min(found.get(t, (2, 0)), (1, r))
        best = sorted(found, key=lambda t: (*found[t], t))[:3]
        want |= {(k, i + 1): (t, round(-found[t][1], 6)) for i, t in enumerate(best)}
    got = {(r["p_partkey"], r["rank"]): (r["p_name"], r["ratio"]) for r in registry.QUERIES["fuzzy_title"](spark, DATA).collect()}
    assert got == want and want
