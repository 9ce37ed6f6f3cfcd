"""Katz backoff bigram model: counts, Good-Turing discounts and scores of whole texts (operator 3)."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.passages import hashed_words, mix
from tracemill.llm.quality import fold
from tracemill.llm.shared import give_back, ship, stored, tidied

#: Words stand for their 64-bit hashes; these two stand for a text's start and end.
START, END = np.uint64(0x5BD1E995A5A5A5A5), np.uint64(0x27D4EB2F165667C5)
#: Counts up to K are discounted.
K = 5
#: Added to counts in the base and in the contexts, so that every context keeps some weight for words not seen in it.
FLOOR = 0.1
#: Tokens for each group of pairs, about the most in a block of documents, and the most documents in one.
GROUP, BLOCK, BLOCK_DOCS = 2_000_000, 600_000, 30_000
#: A word with more than one in HEAVY of all training tokens is counted beforehand, and so is a pair of such words with more
#: than one in HEAVY_PAIRS; there are fewer than these numbers of either.
HEAVY, HEAVY_PAIRS = 1000, 20_000

_U = np.uint64
_EMPTY = np.zeros(0, _U)


#: What deal() sends to a group: pairs of words with how often a block has them, in all and in training, and of which of its
#: documents they are; or, with ids, a block's documents: ids, tokens and flags (n; 1: in training, 2: no id), and sums (x).
DEALT = pa.schema([("g", pa.int32()), ("block", pa.int64()), ("first", pa.list_(pa.int64())), ("second", pa.list_(pa.int64())), ("often", pa.list_(pa.int32())), ("trained", pa.list_(pa.int32())), ("doc", pa.list_(pa.int16())), ("ids", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("x", pa.list_(pa.float64()))])
#: What count() gives: a block's documents as they came; sums of its documents (doc, x, n); counts of contexts (h, table), for
#: the group g of weights(); the counts of counts (table); and the first words of a block's pairs not in training (h, doc).
COUNTED = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("g", pa.int32()), ("h", pa.list_(pa.int64())), ("doc", pa.list_(pa.int16())), ("x", pa.list_(pa.float64())), ("n", pa.list_(pa.int32())), ("table", pa.list_(pa.int64()))])
_KINDS = {"int32": "int", "int64": "long", "string": "string", "list<element: int64>": "array<long>", "list<element: int32>": "array<int>", "list<element: int16>": "array<smallint>", "list<element: double>": "array<double>"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_KINDS[str(f.type).replace('item', 'element')]}" for f in schema)


def _table(schema: pa.Schema, rows: list[dict]) -> pa.Table:
    """Rows of numpy arrays and scalars; a column that a row lacks is null."""
    columns = []
    for f in schema:
        if not pa.types.is_list(f.type):
            columns.append(pa.array([r.get(f.name) for r in rows], f.type))
            continue
        kind = f.type.value_type.to_pandas_dtype()
        values = [r.get(f.name) for r in rows]
        offsets = np.concatenate([[0], np.cumsum([0 if v is None else len(v) for v in values])]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, kind), *[v.astype(kind, copy=False) for v in values if v is not None]])
        columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, f.type.value_type), mask=pa.array([v is None for v in values], pa.bool_())))
    return pa.Table.from_arrays(columns, schema=schema)


def _lists(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and how many each list has."""
    whole = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    sizes = whole.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return whole.flatten().to_numpy(zero_copy_only=False).view(kind), sizes


def _blocks(batches):
    """Blocks of whole documents: their rows, their tokens with each text's end, and how many each text has."""
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        begun, words, counts, size = 0, [], [], 0
        for i in range(0, len(texts), 128):
            w, c = hashed_words(texts.slice(i, 128).to_pylist())
            words.append(np.insert(w, np.cumsum(c), END))
            counts.append(c + 1)
            size += len(words[-1])
            if size >= BLOCK or i + 256 - begun > BLOCK_DOCS or i + 128 >= len(texts):
                done = min(len(texts), i + 128)
                yield batch.slice(begun, done - begun), np.concatenate(words), np.concatenate(counts)
                begun, words, counts, size = done, [], [], 0


def _before(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.concatenate([[START], tokens[:-1]])
    out[np.cumsum(counts)[:-1]] = START
    return out


def _lookup(keys: np.ndarray, values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """values of sorted keys; -1 where there is none."""
    if not len(keys):
        return np.full(len(of), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
    return np.where(keys[at] == of, values[at], -1)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _U(0x9E3779B97F4A7C15) + mix(second))


def _heavy(counted: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    rows = counted.filter(F.col("n") > least).orderBy("h").toArrow()  # fewer than HEAVY or HEAVY_PAIRS
    keys = rows["h"].to_numpy().view(_U) if len(rows) else _EMPTY
    by = np.argsort(keys)
    return keys[by], (rows["n"].to_numpy() if len(rows) else np.zeros(0, np.int64))[by]


def word_counts(rows: DataFrame) -> DataFrame:
    """h and n, the training count of each word; partial counts meet by word."""

    def run(batches):
        for batch, tokens, counts in _blocks(batches):
            keep = np.repeat(~batch.column("held").to_numpy(zero_copy_only=False), counts)
            h, n = np.unique(tokens[keep], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return rows.mapInArrow(tidied(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, held_out_fold: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    The model learns from texts outside fold 0 of crc32(doc_id). Its pairs have
    the probability d(r) r / (c + FLOOR), r the pair's and c the first word's
    training count, d the Good-Turing discount; what a first word's pairs leave
    goes to all other words in proportion to the base, so that its
    probabilities add up to 1 exactly. The base gives a word (count + FLOOR)
    / (N + FLOOR (V + 1)), the last share being for words never seen.

    Null and empty texts are one end token; null doc_ids are held out; repeated
    rows count each for themselves; other columns are left out, whatever their
    names; an empty table gives no rows. Pairs are dealt by their second word, those
    of heavy words by both; heavy pairs are counted beforehand and stay where
    they are, so no group grows with a word's share of the corpus.
    """
    spark = docs.sparkSession
    ship(spark)
    held = F.coalesce(fold(F.col("doc_id"), held_out_fold) == 0, F.lit(True)).alias("held")
    rows = docs.select("doc_id", "text", held)
    words = stored(word_counts(rows), "words")
    n_all, v_all = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = words.filter(F.col("h") == int(END.view(np.int64))).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy, heavy_n = _heavy(words, n_all / HEAVY)
    groups = max(1, -(-n_all // GROUP))

    def pairs_of_heavy(batches):
        for batch, tokens, counts in _blocks(batches):
            first = _before(tokens, counts)
            keep = np.repeat(~batch.column("held").to_numpy(zero_copy_only=False), counts)
            keep &= (_lookup(heavy, heavy_n, tokens) >= 0) & ((first == START) | (_lookup(heavy, heavy_n, first) >= 0))
            h, n = np.unique(_pair(first[keep], tokens[keep]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    both, both_n = _heavy(rows.mapInArrow(tidied(pairs_of_heavy), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), n_all / HEAVY_PAIRS)

    def sums(doc, size, second, r, c) -> np.ndarray:
        """Of each document: base, the part of its score that counts alone give, known tokens, and pairs by count from 0 to K. r and c by pair occurrence."""
        base = np.log10(c + FLOOR)
        a = np.where(r > 0, np.log10(np.maximum(r, 1)), base) - np.where(second == END, 0.0, base)
        out = [np.bincount(doc, w, size) for w in (base, a, c > 0)]
        return np.stack([*out, *[np.bincount(doc, r == i, size) for i in range(K + 1)]]).astype(np.float64)

    def deal(batches):
        """A block's pairs for each group; what is known of its documents goes to one of them."""
        for number, (batch, tokens, counts) in enumerate(_blocks(batches)):
            block = TaskContext.get().partitionId() << 32 | number
            first, doc = _before(tokens, counts), np.repeat(np.arange(len(counts), dtype=np.int16), counts)
            known = _lookup(both, both_n, _pair(first, tokens))
            own = known >= 0
            local = sums(doc[own], len(counts), tokens[own], known[own], _lookup(heavy, heavy_n, tokens[own]))
            train = ~batch.column("held").to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id")
            flags = train + 2 * ids.is_null().to_numpy(zero_copy_only=False)
            row = {"ids": ids.fill_null(0).to_numpy(zero_copy_only=False), "n": np.concatenate([counts, flags]), "x": local.ravel()}
            yield from _table(DEALT, [{"g": crc32(str(block).encode()) % groups, "block": block} | row]).to_batches()
            first, second, doc = first[~own], tokens[~own], doc[~own]
            del known, own, tokens
            if not len(first):
                continue
            group = (np.where(_lookup(heavy, heavy_n, second) >= 0, _pair(first, second), second) % _U(groups)).astype(np.int32)
            by = np.lexsort([first, second, group])
            first, second, doc, group = first[by], second[by], doc[by], group[by]
            del by
            at = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])]))
            often = np.diff(np.append(at, len(first)))
            trained = np.add.reduceat(train[doc].astype(np.int32), at)
            ends = np.flatnonzero(np.diff(group[at], append=-1)) + 1  # of each group's pairs
            rows, a, x = [], 0, 0
            for b in ends.tolist():
                y = x + int(often[a:b].sum())
                rows.append({"g": int(group[x]), "block": block, "first": first[at[a:b]], "second": second[at[a:b]], "often": often[a:b], "trained": trained[a:b], "doc": doc[x:y]})
                a, x = b, y
                if len(rows) == 16 or b == len(at):
                    yield from _table(DEALT, rows).to_batches()
                    rows = []

    def count(given: pa.Table) -> pa.Table:
        """Counts a group's pairs and words, and gives what COUNTED says."""
        give_back()
        done, out = [], []

        def give(row: dict | None = None) -> None:
            """Keeps a row, and makes a small batch of every few, as the JVM holds a batch whole."""
            nonlocal out
            out += [row] if row else []
            if len(out) >= 16 or not row:
                done.append(_table(COUNTED, out))
                out = []

        for i in np.flatnonzero(given["ids"].is_valid().to_numpy()):
            h, x, n = (given[c][int(i)].values.to_numpy(zero_copy_only=False) for c in ("ids", "x", "n"))
            give({"kind": "docs", "block": given["block"][int(i)].as_py(), "h": h, "x": x, "n": n})
        if given["first"].null_count < given.num_rows:
            first, sizes = _lists(given["first"], np.uint64)
            second, _ = _lists(given["second"], np.uint64)
            often, _ = _lists(given["often"], np.int32)
            n, _ = _lists(given["trained"], np.int32)
            docs_, docs_each = _lists(given["doc"], np.int16)
            blocks_ = given["block"].to_pylist()
            by = np.lexsort([first, second])
            word = np.concatenate([[True], np.diff(second[by]) != 0])
            pair = word | np.concatenate([[True], np.diff(first[by]) != 0])
            at = np.flatnonzero(pair)
            r_each = np.add.reduceat(n[by], at, dtype=np.int64)
            c_each = np.add.reduceat(n[by], np.flatnonzero(word), dtype=np.int64)
            r, c = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
            r[by], c[by] = r_each[np.cumsum(pair) - 1], c_each[np.cumsum(word) - 1]
            seen = by[at][r_each > 0]
            del by, word, pair, at
            before = _lookup(heavy, heavy_n, second)
            c = np.where(before >= 0, before, c)
            del before
            h1, rs, cs = first[seen], r[seen], c[seen]
            order = np.argsort(h1)
            h1, rs, cs = h1[order], rs[order], cs[order]
            if len(h1):
                ctx = np.flatnonzero(np.concatenate([[True], np.diff(h1) != 0]))
                table = np.stack([np.add.reduceat(x, ctx) for x in (np.ones(len(h1), np.int64), cs, *[(rs == i).astype(np.int64) for i in range(1, K + 1)])])
                for row in context_rows(h1[ctx], table, groups):
                    give(row)
            del h1, rs, cs, order, seen
            give({"kind": "spectrum", "table": np.bincount(np.minimum(r_each, K + 2), minlength=K + 3)[: K + 2]})
            ends, doc_ends = np.cumsum(sizes), np.cumsum(docs_each)
            for block, a, b, x, y in zip(blocks_, ends - sizes, ends, doc_ends - docs_each, doc_ends):
                if a == b:
                    continue
                times, doc = often[a:b], docs_[x:y]
                rr, cc = np.repeat(r[a:b], times), np.repeat(c[a:b], times)
                some, of = np.unique(doc, return_inverse=True)
                found = sums(of, len(some), np.repeat(second[a:b], times), rr, cc)
                give({"kind": "sums", "block": block, "doc": some, "x": found[:2].ravel(), "n": found[2:].ravel()})
                if (rr == 0).any():
                    give({"kind": "unseen", "block": block, "h": np.repeat(first[a:b], times)[rr == 0].view(np.int64), "doc": doc[rr == 0]})
        give()
        give_back()
        return pa.concat_tables(done)

    dealt = rows.mapInArrow(tidied(deal), _ddl(DEALT))
    counted = stored(dealt.repartition(groups, "g").groupBy("g").applyInArrow(count, _ddl(COUNTED)), "counted", row_group=8 << 20)

    spectrum = np.zeros(K + 2)
    place = F.posexplode("table").alias("count", "pairs")
    for row in counted.filter("kind = 'spectrum'").select(place).groupBy("count").agg(F.sum("pairs").alias("pairs")).collect():  # K + 2 rows
        spectrum[row["count"]] = row["pairs"]
    for n in both_n[both_n <= K + 1]:
        spectrum[n] += 1
    discount = discounts(spectrum)
    whole = n_all + FLOOR * (v_all + 1)

    def weights(given: pa.Table) -> pa.Table:
        """log10 of each context's backoff weight times (its count + FLOOR)."""
        give_back()
        h, sizes = _lists(given["h"], np.uint64)
        flat, _ = _lists(given["table"], np.int64)
        ends = np.cumsum(sizes)
        tables = [flat[(K + 2) * a : (K + 2) * b].reshape(K + 2, -1) for a, b in zip(ends - sizes, ends)]
        h, of = np.unique(h, return_inverse=True)
        total = np.stack([np.bincount(of, t, len(h)) for t in np.concatenate(tables, axis=1)])
        left = FLOOR + sum((1 - discount[i]) * i * total[1 + i] for i in range(1, K + 1))
        return pa.table({"h": h.view(np.int64), "weight": np.log10(left / (1 - (total[1] + FLOOR * total[0]) / whole))})

    # heavy pairs stay out of the groups, but count among what their first word has seen
    contexts = counted.filter("kind = 'contexts'").select("g", "h", "table")
    if hidden := hidden_contexts(both, both_n, heavy, heavy_n, groups):
        hidden = [(r["g"], r["h"].astype(np.int64).tolist(), r["table"].tolist()) for r in hidden]
        contexts = contexts.unionByName(spark.createDataFrame(hidden, "g int, h array<long>, table array<long>"))
    table = contexts.groupBy("g").applyInArrow(weights, "h long, weight double")

    unseen = counted.filter("kind = 'unseen'").select("block", F.explode(F.arrays_zip("h", "doc")).alias("u")).groupBy("block", "u.h", "u.doc").agg(F.count("*").alias("n"))
    backed = unseen.join(table, "h", "left").groupBy("block", "doc").agg(F.sum(F.col("n") * F.coalesce("weight", F.lit(float(np.log10(FLOOR))))).alias("back"))
    pairs = F.sort_array(F.collect_list(F.struct("doc", "back")))  # a block's documents are bounded
    back = backed.groupBy("block").agg(pairs.alias("p")).select(F.lit("back").alias("kind"), "block", F.col("p.doc").alias("doc"), F.col("p.back").alias("x"))

    def total(given: pa.Table) -> pa.Table:
        """The documents of a block."""
        logs = np.log10(discount[1:])
        kinds = given["kind"].to_pylist()
        of = lambda name, i: given[name][i].values.to_numpy(zero_copy_only=False)
        own = kinds.index("docs")
        ids = of("h", own)
        n, flags = of("n", own).astype(np.int64).reshape(2, -1)
        out = of("x", own).reshape(-1, len(ids)).copy()
        back = np.zeros(len(ids))
        for i, kind in enumerate(kinds):
            if kind == "sums":
                doc = of("doc", i)
                out[:2, doc] += of("x", i).reshape(2, -1)
                out[2:, doc] += of("n", i).reshape(K + 2, -1)
            elif kind == "back":
                back[of("doc", i)] = of("x", i)
        base = out[0] - n * np.log10(whole)
        full = out[1] - np.log10(ends + FLOOR) + (out[4:] * logs[:, None]).sum(0) - out[3] * np.log10(whole) + back
        give_back()
        return pa.table({
            "doc_id": pa.array(ids, mask=flags >= 2), "held_out": flags % 2 == 0, "n_tokens": n, "n_known": np.rint(out[2]).astype(np.int64),
            "train_tokens": np.full(len(n), n_all), "base_score": base, "score": full,
        })

    parts = counted.filter("kind in ('docs', 'sums')").select("kind", "block", "h", "doc", "x", "n").unionByName(back, allowMissingColumns=True)
    return parts.groupBy("block").applyInArrow(total, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def context_rows(h: np.ndarray, table: np.ndarray, groups: int) -> list[dict]:
    """Counts of contexts, for the group of each."""
    to = (h % _U(groups)).astype(np.int64)
    by = np.argsort(to, kind="stable")
    cut = np.flatnonzero(np.diff(to[by], append=-1)) + 1
    return [{"kind": "contexts", "g": int(to[p[0]]), "h": h[p].view(np.int64), "table": table[:, p].ravel()} for p in np.split(by, cut[:-1]) if len(p)]


def discounts(spectrum: np.ndarray) -> np.ndarray:
    """d(0) to d(K) by Good-Turing from the counts of counts; where those give no value within (0, 1), 1 - 1 / (2 r)."""
    out = np.ones(K + 1)
    n = spectrum
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common != 1 else 0.0
        out[r] = d if 0 < d < 1 else 1 - 1 / (2 * r)
    return out


def hidden_contexts(both: np.ndarray, both_n: np.ndarray, heavy: np.ndarray, heavy_n: np.ndarray, groups: int) -> list[dict]:
    """Context sums of the heavy pairs, which no group sees, found among the pairs of heavy words."""
    first = np.concatenate([heavy, [START]])
    f, s = np.repeat(first, len(heavy)), np.tile(heavy, len(first))
    r = _lookup(both, both_n, _pair(f, s))
    f, s, r = f[r >= 0], s[r >= 0], r[r >= 0]
    table = np.stack([np.ones(len(f), np.int64), _lookup(heavy, heavy_n, s), *[(r == i).astype(np.int64) for i in range(1, K + 1)]])
    return context_rows(f, table, groups)


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
