"""Milestones, questions, violations and replies: keyed states, and what their texts say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.functions.columns import natural_key


def seeded(board: DataFrame, defaults: DataFrame, key: str = "key", number: str = "id", prefix: str = "M", width: int = 3) -> DataFrame:
    """The board with the default entries that it lacks by key, PENDING, under the numbers that follow its highest.

    defaults are few (a list in code) and have a column `position`.
    """
    highest = board.agg(F.coalesce(F.max(F.regexp_extract(number, rf"^{prefix}(\d+)$", 1).try_cast("long")), F.lit(0)).alias("_top"))
    new = defaults.join(board.select(key).distinct(), key, "left_anti").withColumn("_n", F.row_number().over(Window.orderBy("position")))
    next_ = (F.col("_top") + F.col("_n")).cast("string")  # lpad would cut longer ones
    rows = new.join(F.broadcast(highest)).withColumn(number, F.concat(F.lit(prefix), F.lpad(next_, F.greatest(F.lit(width), F.length(next_)), "0")))  # one row
    return board.unionByName(rows.withColumn("status", F.lit("PENDING")).drop("_n", "_top", "position"), allowMissingColumns=True)


def closed(board: DataFrame, verdicts: DataFrame, key: str = "id") -> DataFrame:
    """The board with the status and note of each closed entry; entries that verdicts don't name, and names that the board lacks, change nothing."""
    v = verdicts.select(F.col(key).alias("_k"), F.col("status").alias("_s"), F.col("note").alias("_n"))
    out = board.join(v, F.col(key) == F.col("_k"), "left")
    return out.withColumn("status", F.coalesce("_s", "status")).withColumn("note", F.coalesce("_n", "note")).select(*board.columns)


def listed(board: DataFrame, key: str = "id", status: str | None = None) -> DataFrame:
    """Entries with `position` in natural order (M2 before M10), of one status if it is given; missing notes are empty."""
    rows = board if status is None else board.filter(F.col("status") == status)
    # a board is small: one row for each milestone of a run
    return rows.withColumn("note", F.coalesce("note", F.lit(""))).withColumn("position", F.row_number().over(Window.orderBy(*natural_key(key))))


def first_resolution(events: DataFrame, key: str, status: str, order: str, pending: str = "pending") -> DataFrame:
    """Status of each question: that of its first event other than pending, as nothing overwrites it; pending without one."""
    done = F.col(status) != pending
    out = events.groupBy(key).agg(F.min(order).alias("asked"), F.min_by(status, F.when(done, F.col(order))).alias("_s"), F.min(F.when(done, F.col(order))).alias("resolved"))
    return out.select(key, F.coalesce("_s", F.lit(pending)).alias("status"), "asked", "resolved")


def annotated(df: DataFrame, entries: str, note: Column, name: str = "note") -> DataFrame:
    """Sets a field of the last entry of a nested log; an empty or null log stays as it is."""
    n = F.size(entries)
    return df.withColumn(entries, F.transform(entries, lambda e, i: F.when(i == n - 1, e.withField(name, note)).otherwise(e)))


def shown(violations: DataFrame, group: str, most: int = 2) -> DataFrame:
    """Of each group its violations, the first of each (rule, subject), errors first: the first `most` in full, the others as a digest.

    violations has rule, subject, severity, message and position.
    """
    first = violations.groupBy(group, "rule", "subject").agg(F.min_by(F.struct("severity", "message", "position"), F.struct((F.col("severity") != "error").alias("s"), "position")).alias("v"))
    n = F.row_number().over(Window.partitionBy(group).orderBy(F.col("v.severity") != "error", "v.position"))
    ranked = first.withColumn("n", n)
    one = F.struct("n", F.concat_ws(" ", "rule", "v.message").alias("t"))
    other = F.struct("n", F.concat(F.col("rule"), F.lit("("), F.coalesce("subject", F.lit("")), F.lit(")")).alias("t"))
    texts = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["t"])
    out = ranked.groupBy(group).agg(texts(F.when(F.col("n") <= most, one)).alias("_head"), texts(F.when(F.col("n") > most, other)).alias("_rest"))
    digest = F.when(F.size("_rest") > 0, F.concat(F.lit("+"), F.size("_rest").cast("string"), F.lit(" more: "), F.array_join("_rest", ", ")))
    return out.select(group, F.array_join("_head", "\n").alias("head"), digest.alias("digest"))


def escalated(violations: DataFrame, round_: str, rules: int = 3, repeats: int = 2) -> DataFrame:
    """Subjects that broke so many different rules, or one as an error in so many rounds in a row, with why."""
    named = violations.filter("subject is not null")
    broken = named.groupBy("subject").agg(F.countDistinct("rule").alias("n_rules"))
    errors = named.filter("severity = 'error'").select("subject", "rule", round_).distinct()
    run = errors.withColumn("_run", F.col(round_) - F.row_number().over(Window.partitionBy("subject", "rule").orderBy(round_)))
    longest = run.groupBy("subject", "rule", "_run").agg(F.count("*").alias("n")).groupBy("subject").agg(F.max("n").alias("n_repeats"))
    out = broken.join(longest, "subject", "left").withColumn("n_repeats", F.coalesce("n_repeats", F.lit(0)))
    return out.filter((F.col("n_rules") >= rules) | (F.col("n_repeats") >= repeats))


def stalled(writes: DataFrame, group: str, at: str, now: Column, limit: int) -> DataFrame:
    """Seconds since each run's last write, and whether that is more than the limit."""
    last = writes.groupBy(group).agg(F.max(at).alias("_last"))
    return last.select(group, F.greatest(now - F.col("_last"), F.lit(0)).alias("idle"), (now - F.col("_last") > limit).alias("stalled"))


def unclaimed(notes: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """Notes that nobody has claimed, each once."""
    return notes.join(claims.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def context_plan(messages: DataFrame, group: str, order: str, cost: str, role: str, budget: int, share: float = 0.5, first: str = "user", result: str = "tool") -> DataFrame:
    """Adds part: head for a conversation's first message of the first role, tail for the newest messages that fit with it into a share of the
    budget, and span for what stands between, which is to be summarised. A tail never starts with results whose call is in the span."""
    w = Window.partitionBy(group)
    head_at = F.min(F.when(F.col(role) == first, F.col(order))).over(w)
    out = messages.withColumn("_head", head_at).withColumn("_is_head", F.coalesce(F.col(order) == F.col("_head"), F.lit(False)))
    spent = F.coalesce(F.max(F.when(F.col("_is_head"), F.col(cost))).over(w), F.lit(0))
    newest = w.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_spent", spent).withColumn("_used", F.sum(F.when(F.col("_is_head"), 0).otherwise(F.col(cost))).over(newest))
    over = ~F.col("_is_head") & (F.col("_spent") + F.col("_used") > F.lit(int(budget * share)))
    out = out.withColumn("_fits", ~F.col("_is_head") & ~F.coalesce(F.bool_or(over).over(newest), F.lit(False)))
    # the oldest of those that fit that is no result opens the tail
    opens = F.min(F.when(F.col("_fits") & (F.col(role) != result), F.col(order))).over(w)
    part = F.when(F.col("_is_head"), "head").when(F.col("_fits") & (F.col(order) >= opens), "tail").otherwise("span")
    return out.withColumn("part", part).select(*messages.columns, "part")


def section(text: str | Column, name: str) -> Column:
    """Body of a section, empty without one: under `# name` and what follows on that line, under **name**, or behind `name:`.

    A section under a heading ends at the next heading, line in bold or rule;
    one that goes on in the line of its name ends at the first blank line.
    """
    c = F.col(text) if isinstance(text, str) else text
    bold = rf"(?:\*\*|__){name}\b[ \t]*:?[ \t]*(?:\*\*|__)?[ \t]*:?"
    opens = rf"(?im)^[ \t]*(?:#{{1,6}}[ \t]+{name}\b.*|{bold}[ \t]*|{name}[ \t]*:[ \t]*)$"
    goes_on = rf"(?im)^[ \t]*(?:{bold}|{name}[ \t]*:)[ \t]*(?=\S)"
    heading = r"#{1,6}[ \t]|---[ \t]*$|(?:\*\*|__)[^*_\n]+(?:\*\*|__)[ \t]*:?[ \t]*$"
    under = F.regexp_extract(c, rf"{opens}((?s:.*?))(?=\n[ \t]*(?:{heading})|\z)", 1)
    behind = F.regexp_extract(c, rf"{goes_on}((?s:.*?))(?=\n[ \t]*(?:\n|{heading})|\z)", 1)
    at = lambda p: F.when(c.rlike(p), F.regexp_instr(c, F.lit(p)))
    first, second = at(opens), at(goes_on)
    return F.when(first.isNull() & second.isNull(), "").when(second.isNull() | (first <= second), _trimmed(under)).otherwise(_trimmed(behind))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def review_gaps(df: DataFrame, text: str) -> DataFrame:
    """Elements of a review with status gap: a row for each, of a JSON object in a fence or anywhere; a damaged reply has none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    blob = F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    parsed = df.withColumn("_e", F.explode(F.from_json(blob, "struct<elements: array<struct<element: string, status: string, note: string>>>")["elements"]))
    gaps = parsed.filter(F.lower("_e.status") == "gap")
    return gaps.select(*[c for c in df.columns if c != text], F.coalesce("_e.element", F.lit("?")).alias("element"), F.coalesce("_e.note", F.lit("")).alias("note"))


def judged(reply: str | Column) -> tuple[Column, Column]:
    """Whether a judge's reply flags, and its critique: `SUBSTANCE: OK` or `SUBSTANCE: FLAG`, `CRITIQUE: ...`; what can't be read flags nothing and is kept."""
    c = F.col(reply) if isinstance(reply, str) else reply
    said = F.upper(F.regexp_extract(c, r"(?i)substance\s*:\s*\**\s*(OK|FLAG)\b", 1))
    critique = _trimmed(F.regexp_extract(c, r"(?is)critique\s*:\s*(.*)", 1))
    whole = _trimmed(F.coalesce(c, F.lit("")))
    text = F.when(said == "OK", "").when(said == "FLAG", F.when(critique != "", critique).otherwise(whole)).otherwise(whole)
    return F.coalesce(said == "FLAG", F.lit(False)), text


def paper_keys(doi: str | Column, arxiv: str | Column, title: str | Column) -> Column:
    """Names under which a record is known: its DOI unless that is arXiv's, its arXiv id without version, its title's letters and digits if more than 20."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    d, a = col(doi), F.lower(F.regexp_replace(col(arxiv), r"v\d+$", ""))
    t = F.regexp_replace(F.lower(F.coalesce(col(title), F.lit(""))), "[^a-z0-9]", "")
    own = [F.when((d != "") & ~d.startswith("10.48550/arxiv."), F.concat(F.lit("doi:"), d)), F.when(a != "", F.concat(F.lit("arxiv:"), a)), F.when(F.length(t) > 20, F.concat(F.lit("title:"), t))]
    return F.array_compact(F.array(*own))


def best_id(arxiv: str, doi: str, other: str) -> Column:
    """The id to ask for a paper by: its arXiv id without version, else its DOI, else another."""
    some = lambda c: F.when(c != "", c)
    return F.coalesce(some(F.regexp_replace(arxiv, r"v\d+$", "")), some(F.col(doi)), F.col(other), F.lit(""))


def for_audience(df: DataFrame, audience: str, who: str) -> DataFrame:
    """Entries that name an audience among theirs, or none at all."""
    return df.filter(F.col(audience).isNull() | (F.size(audience) == 0) | F.array_contains(audience, who))


def dangling(hypotheses: DataFrame, delegations: str, open_ids: DataFrame, key: str) -> DataFrame:
    """Hypotheses and those of their delegations that are open."""
    each = hypotheses.select(key, F.explode(delegations).alias("delegation")).distinct()
    return each.join(open_ids.select(F.col("id").alias("delegation")).distinct(), "delegation", "left_semi")


def tally(df: DataFrame, column: str, missing: str = "unchecked") -> DataFrame:
    """Rows of each verdict, those without one under `missing`."""
    return df.groupBy(F.coalesce(F.col(column), F.lit(missing)).alias(column)).agg(F.count("*").alias("n"))


def splice(document: Column, begin: str, end: str, rows: Column) -> Column:
    """A document with what stands between two markers replaced; without both it stays as it is."""
    import re

    return F.regexp_replace(document, F.lit(rf"(?s)({re.escape(begin)}\n).*?({re.escape(end)})"), F.concat(F.lit("$1"), F.replace(F.replace(rows, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")), F.lit("\n$2")))
