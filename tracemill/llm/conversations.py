"""Repair of conversations' turn structure by iterative-deepening A* over edits (operator 11)."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark import TaskContext

from tracemill.llm.shared import ship, stored, tidied

#: Initials of roles; any other role is the last.
INITIALS = "suax"
#: States of `(s?(ua)+)?`: nothing yet, behind s, behind u, behind a. The state behind each initial; None where it can't stand.
AFTER = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
#: The role that may be put in at each state, and the state behind it.
PUT = [("user", 2), ("user", 2), ("assistant", 3), ("user", 2)]
#: What edits cost, and what a truncated row costs that stays.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: What ends a conversation from each state.
TAIL = ["", "II", "I", ""]
#: Rows of a conversation that are searched as one, and rows of a chunk of longer ones.
WHOLE, CHUNK = 64, 32
#: White space, as the words' pattern has it.
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of rows damaged by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 takes out its `.!?`, 3 repeats it, 4 makes it the user's. Nulls are one space (turn stays null)."""
    part = F.pmod(F.crc32(F.encode(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]), "UTF-8")), F.lit(20))
    at = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), part.alias("part")).filter("part != 0")
    role = F.when(F.col("part") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("part") == 1, "").when(F.col("part") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return at.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("part") == 3, 2).otherwise(1)))).drop("col")


class Search:
    """The cheapest edits of a run of rows from one state on, the least in ASCII among them.

    codes: of each row the index of its initial, and 4 if it is truncated or 8
    if it must go. goal is the state to end in, right behind the last row's
    edit; None is the conversation's end, with insertions behind the last row.
    """

    def __init__(self, codes: list[int], goal: int | None):
        self.codes, self.goal = codes, goal
        self.needs: dict[tuple[int, int], float] = {}  # failed states, and what is known to be needed from there
        n = len(codes)
        self.base, self.saved, clash = [0] * (n + 1), [0] * (n + 1), [0] * (n + 2)
        later: int | None = None  # the next row that may stay, if it is u or a
        for i in range(n - 1, -1, -1):
            initial, cut = INITIALS[codes[i] % 4], 4 <= codes[i] < 8
            gone = codes[i] >= 8
            odd = not gone and initial in "sx"
            self.base[i] = self.base[i + 1] + (DELETE if gone else min(DELETE, REROLE + TRUNCATED * cut) if odd else TRUNCATED * cut)
            self.saved[i] = max(self.saved[i + 1], (min(DELETE, REROLE + TRUNCATED * cut) - TRUNCATED * cut) * (odd and initial == "s"))
            clash[i] = clash[i + 1]
            if odd:
                later = None
            elif not gone:
                if later is not None and codes[later] % 4 == codes[i] % 4:
                    least = DELETE - TRUNCATED if cut or 4 <= codes[later] < 8 else REROLE
                    clash[i] = max(clash[i], least + clash[later + 1])
                later = i
        self.clash = clash

    def need(self, i: int, q: int) -> float:
        """At least what must be paid from row i in state q: rows that go or are cut, roles that can't stay, pairs of equal neighbours."""
        known = self.needs.get((i, q))
        return known if known is not None else self.base[i] - (self.saved[i] if q == 0 else 0) + self.clash[i]

    def edits(self, i: int, q: int):
        """Edits in ASCII order: letter, cost, row, state."""
        put = PUT[q][1]
        if i < len(self.codes):
            code = self.codes[i]
            cut = TRUNCATED * (4 <= code < 8)
            yield "D", DELETE, i + 1, q
            yield "I", INSERT, i, put
            if code < 8:
                if (kept := AFTER[q].get(INITIALS[code % 4])) is not None:
                    yield "K", cut, i + 1, kept
                yield "R", REROLE + cut, i + 1, put
        elif self.goal is None:
            yield "I", INSERT, i, put

    def under(self, i: int, q: int, budget: float, path: list[str]) -> float:
        """Depth first under a bound: -1 with the path of edits, or what is needed if that is more than the budget."""
        if i == len(self.codes) and (q in (0, 3) if self.goal is None else q == self.goal):
            return -1
        least = math.inf
        for letter, cost, row, state in self.edits(i, q):
            if (need := cost + self.need(row, state)) <= budget:
                path.append(letter)
                found = self.under(row, state, budget - cost, path)
                if found < 0:
                    return -1
                path.pop()
                need = cost + found
            least = min(least, need)
        self.needs[i, q] = max(least, self.need(i, q))
        return self.needs[i, q]

    def best(self, entry: int) -> tuple[int, str] | None:
        """Cost and audit; None where the goal is out of reach."""
        live = [c for c in self.codes if c < 8]
        if self.goal == 0 and entry != 0 or self.goal == 1 and entry != 1 and (entry != 0 or not any(c % 4 == 0 for c in live)):
            return None
        bound = self.need(0, entry)
        while True:
            path: list[str] = []
            found = self.under(0, entry, bound, path)
            if found < 0:
                return int(bound), "".join(path)
            bound = found


def tables(codes: list[int]) -> tuple[list[int], list[int], list[str]]:
    """For each state before and behind a chunk (4 * before + behind): the cost (-1: out of reach), the audit's rank among those from that state, the audit."""
    costs, ranks, audits = [-1] * 16, [-1] * 16, [""] * 16
    for goal in range(4):
        search = Search(codes, goal)
        for entry in range(4):
            if found := search.best(entry):
                costs[4 * entry + goal], audits[4 * entry + goal] = found
    for q in range(0, 16, 4):
        for k, i in enumerate(sorted((i for i in range(q, q + 4) if costs[i] >= 0), key=audits.__getitem__)):
            ranks[i] = k
    return costs, ranks, audits


def through(costs: np.ndarray, ranks: np.ndarray) -> list[tuple[int, int]]:
    """States before and behind each chunk on the cheapest way through a conversation, its audit the least.

    An audit of a chunk ends with the edit of its last row, so none is the
    beginning of another, and audits can be compared chunk by chunk.
    """
    togo = np.zeros((len(costs) + 1, 4), np.int64)
    togo[-1] = [INSERT * len(t) for t in TAIL]
    far = np.int64(1) << 40
    each = np.where(costs < 0, far, costs).reshape(-1, 4, 4)
    for k in range(len(costs) - 1, -1, -1):
        togo[k] = (each[k] + togo[k + 1]).min(axis=1)
    out, q = [], 0
    for k in range(len(costs)):
        fits = np.flatnonzero(each[k, q] + togo[k + 1] == togo[k, q])
        to = int(fits[np.argmin(ranks[k].reshape(4, 4)[q, fits])])
        out.append((q, to))
        q = to
    return out


def _coded(turns: DataFrame) -> DataFrame:
    """The turns in order: cid, turn, id, n, code, and the fault of all copies but the first."""
    light = turns.select("cid", "turn", "role", "id", "n", F.substring("text", 1, 64).alias("head"), F.md5("text").alias("digest"), F.rtrim("text", F.lit(SPACE)).alias("bare"))
    light = light.select("cid", "turn", "role", "id", "n", "head", "digest", (F.col("bare") == "").alias("blank"), (~F.right("bare", F.lit(1)).isin(*".!?")).alias("truncated"))
    light = stored(light, "turn-keys")
    first = light.groupBy("cid", "role", "digest").agg(F.min(F.struct("turn", "id")).alias("first"), F.count("*").alias("m")).filter("m > 1")
    first = stored(first.select("cid", "role", "digest", F.col("first.id").alias("first")), "repeated-turns")
    initial = F.substring("role", 1, 1)
    code = F.coalesce(F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2), F.lit(3))
    fault = F.when(F.col("blank"), 2).when(F.col("first") != F.col("id"), 3).when(F.col("truncated"), 1).otherwise(0)
    coded = light.join(first, ["cid", "role", "digest"], "left").withColumn("code", code).withColumn("fault", fault)
    return coded.repartitionByRange("cid", "turn", "role", "head", "digest").sortWithinPartitions("cid", "turn", "role", "head", "digest").select("cid", "id", "n", "code", "fault")


def chunks_of(turns: DataFrame) -> DataFrame:
    """Conversations cut into chunks, each solved where it stands.

    Turns are dealt by ranges of conversation and turn, so that a conversation
    of any length spreads over tasks. A conversation that lies within a task and
    has WHOLE rows at most is searched as one (whole); of the others, each chunk of
    CHUNK rows is searched from every state to every state.
    """
    ship(turns.sparkSession)
    schema = "cid string, part int, seg long, whole boolean, ids array<long>, codes binary, first int, last int, illegal long, blank long, duplicate long, truncated long, costs array<int>, ranks array<int>, audits array<string>"

    def run(batches):
        part = TaskContext.get().partitionId()
        seg, begun = 0, False  # begun: whether the open conversation has chunks already or may go back to another task
        cid, at = None, []  # the open conversation's rows: id, code, fault
        before: int | None = None
        out: list[tuple] = []

        def chunk(rows: list[tuple], whole: bool) -> None:
            nonlocal seg, before
            codes = [c + (8 if f >= 2 else 4 * f) for _, c, f in rows]
            names = ["" if before is None else INITIALS[before], *[INITIALS[c] for _, c, _ in rows]]
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(names, names[1:]) if a)
            faults = [sum(f == k for _, _, f in rows) for k in (2, 3, 1)]
            if whole:
                cost, audit = Search(codes, None).best(0)
                costs, ranks, audits = [cost], [0], [audit]
            else:
                costs, ranks, audits = tables(codes)
            before = rows[-1][1]
            out.append((cid, part, seg, whole, [i for i, _, _ in rows], bytes(codes), rows[0][1], rows[-1][1], illegal, *faults, costs, ranks, audits))
            seg += 1

        def close(last: bool) -> None:
            nonlocal begun, before
            if at:
                if not begun and not last and len(at) <= WHOLE:
                    chunk(at, True)
                else:
                    for i in range(0, len(at), CHUNK):
                        chunk(at[i : i + CHUNK], False)
            at.clear()
            begun, before = False, None

        def batch_of() -> pa.RecordBatch:
            t = pa.table({n: [r[k] for r in out] for k, n in enumerate(kinds.names)}, kinds)
            out.clear()
            return t.combine_chunks().to_batches()[0]

        begun = True  # the task's first conversation may have begun in the one before
        for batch in batches:
            for c, i, n, code, fault in zip(*(x.to_pylist() for x in batch.columns)):
                if c != cid:
                    close(False) if cid is not None else None
                    cid = c
                for k in range(n):  # copies of a turn behind the first are duplicates, of a blank one blank
                    at.append((i, code, fault if k == 0 or fault == 2 else 3))
                    if len(at) > WHOLE:
                        begun = True
                        if len(at) >= WHOLE + CHUNK:
                            chunk(at[:CHUNK], False)
                            del at[:CHUNK]
            if len(out) > 2000:
                yield batch_of()
        if cid is not None:
            close(True)
        if out:
            yield batch_of()

    number = pa.list_(pa.int32())
    kinds = pa.schema([("cid", pa.string()), ("part", pa.int32()), ("seg", pa.int64()), ("whole", pa.bool_()), ("ids", pa.list_(pa.int64())), ("codes", pa.binary()), ("first", pa.int32()), ("last", pa.int32()), *[(n, pa.int64()) for n in ("illegal", "blank", "duplicate", "truncated")], ("costs", number), ("ranks", number), ("audits", pa.list_(pa.string()))])
    return _coded(turns).mapInArrow(tidied(run), schema)


def pieces_of(chunks: DataFrame) -> DataFrame:
    """cid, part, seg, entry, piece and cost of every chunk on its conversation's cheapest way."""

    def way(table: pa.Table) -> pa.Table:
        t = table.sort_by([("part", "ascending"), ("seg", "ascending")])
        costs, ranks = (np.array(t.column(c).to_pylist(), np.int64) for c in ("costs", "ranks"))
        way = through(costs, ranks)
        tails = [""] * (len(way) - 1) + [TAIL[way[-1][1]]]
        return pa.table({"cid": t.column("cid"), "part": t.column("part"), "seg": t.column("seg"), "entry": pa.array([q for q, _ in way], pa.int32()), "to": pa.array([q for _, q in way], pa.int32()), "tail": tails})

    cut = chunks.filter("not whole")
    ways = cut.select("cid", "part", "seg", "costs", "ranks").groupBy("cid").applyInArrow(way, "cid string, part int, seg long, entry int, to int, tail string")
    at = (F.col("entry") * 4 + F.col("to") + 1).cast("int")
    joined = cut.join(ways, ["cid", "part", "seg"])
    solved = joined.select("cid", "part", "seg", "entry", F.concat(F.element_at("audits", at), "tail").alias("piece"), (F.element_at("costs", at) + INSERT * F.length("tail")).cast("long").alias("cost"))
    whole = chunks.filter("whole").select("cid", "part", "seg", F.lit(0).alias("entry"), F.element_at("audits", 1).alias("piece"), F.element_at("costs", 1).cast("long").alias("cost"))
    return whole.unionByName(solved)


def edited(chunks: DataFrame, pieces: DataFrame) -> DataFrame:
    """cid, part, seg, at, id and role of the rows that repaired conversations have: id is null for those put in, role is null for those kept as they are."""

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for cid, part, seg, ids, codes, entry, piece in zip(*(c.to_pylist() for c in batch.columns)):
                q, row = entry, 0
                for at, letter in enumerate(piece):
                    if letter != "D":
                        role, to = (None, AFTER[q][INITIALS[codes[row] % 4]]) if letter == "K" else PUT[q]
                        for c, v in zip(cols, (cid, part, seg, at, None if letter == "I" else ids[row], role)):
                            c.append(v)
                        q = to
                    row += letter != "I"
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string()))], names=["cid", "part", "seg", "at", "id", "role"])

    return chunks.select("cid", "part", "seg", "ids", "codes").join(pieces.select("cid", "part", "seg", "entry", "piece"), ["cid", "part", "seg"]).mapInArrow(tidied(run), "cid string, part int, seg long, at int, id long, role string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations' faults and cheapest repairs, and their repaired rows, of rows with conv_id, turn, role and text.

    The first table has a row for each conv_id: gaps, blank, duplicate,
    truncated, illegal, cost and audit. Edits are K(eep) 0, R(erole to user or
    assistant) 3, D(elete) 4, which blank and duplicate rows must have, and I(nsert
    an empty user or assistant turn) 3; a truncated row that stays costs 3 more.
    What is left has the role initials `(s?(ua)+)?`; of the cheapest audits the
    least in ASCII stands. The second table has conv_id, part, seg and at (their
    order), role and text of each repaired row.

    Turns come in order, nulls first; rows of one turn by role, then by the
    text's first 64 characters, then by its MD5. Rows that are alike are one row
    and its duplicates. Null roles and texts are one space; rows without a
    conv_id are one conversation. Empty texts are blank; long ones count whole.
    Other columns are left out, whatever their names; an empty table gives none.

    Depth-first search under increasing bounds, with a table of failed states,
    finds an audit of up to WHOLE rows at once and of longer conversations chunk by
    chunk; the way through the chunks is a shortest path over the four states.
    """
    cid = F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("cid")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    turns = rows.select(cid, "turn", role, text).groupBy("cid", "turn", "role", "text").agg(F.count("*").alias("n"))
    turns = stored(turns.withColumn("id", F.monotonically_increasing_id()), "turns")
    chunks = stored(chunks_of(turns), "conversation-chunks")
    pieces = stored(pieces_of(chunks), "edits")
    gaps = turns.select("cid", "turn").distinct().groupBy("cid").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    parts = chunks.groupBy("cid", "part").agg(F.min_by("first", "seg").alias("first"), F.max_by("last", "seg").alias("last"), *[F.sum(c).alias(c) for c in ("illegal", "blank", "duplicate", "truncated")])
    before = F.lag("last").over(Window.partitionBy("cid").orderBy("part"))  # a conversation's parts are at most the tasks
    legal = F.concat(before, F.lit(","), F.col("first")).isin("0,1", "1,2", "2,1")
    parts = parts.withColumn("broken", F.when(before.isNotNull() & ~legal, 1).otherwise(0))
    counts = parts.groupBy("cid").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], (F.sum("illegal") + F.sum("broken")).alias("illegal"))
    audit = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("part", "seg", "piece"))), lambda x: x["piece"]))
    costs = pieces.groupBy("cid").agg(F.sum("cost").alias("cost"), audit.alias("audit"))
    ids = rows.select("conv_id").distinct().select("conv_id", cid)
    summary = ids.join(gaps, "cid", "left").join(counts, "cid", "left").join(costs, "cid", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    kept = edited(chunks, pieces).withColumnRenamed("role", "new").join(turns.select("id", "role", "text"), "id", "left")
    kept = kept.select("cid", "part", "seg", "at", F.coalesce("new", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return summary.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit")), ids.join(kept, "cid").drop("cid")


def digests(repaired: DataFrame, key: str = "conv_id") -> DataFrame:
    """key and sha256 of its `role:text` lines, in order. A digest is made line by line: a conversation's texts are never held together."""
    ship(repaired.sparkSession)
    kind = repaired.schema[key].dataType.simpleString()

    def run(batches):
        now, digest, out = None, None, []
        for batch in batches:
            for k, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest is None or k != now:
                    if digest:
                        out.append((now, digest.hexdigest()))
                    now, digest = k, hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], batch.schema.field(0).type), pa.array([d for _, d in out])], names=[key, "sha256"])
                out = []
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([now], batch.schema.field(0).type), pa.array([digest.hexdigest()])], names=[key, "sha256"])

    lines = repaired.repartition(key).sortWithinPartitions(key, "part", "seg", "at").select(key, F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.mapInArrow(tidied(run), f"`{key}` {kind}, sha256 string")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    ids = rows.select("conv_id").distinct()
    summary, repaired = repair(damaged(rows))
    found = digests(repaired).withColumnRenamed("conv_id", "digest_id")
    full = ids.join(summary.withColumnRenamed("conv_id", "summary_id"), F.col("conv_id").eqNullSafe(F.col("summary_id")), "left").join(found, F.col("conv_id").eqNullSafe(F.col("digest_id")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty: Column = F.lit(hashlib.sha256(b"").hexdigest())
    return full.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", empty).alias("repaired_sha256"))
