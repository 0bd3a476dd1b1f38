"""Conversation structure repair: the cheapest edits after which roles alternate, by a fold over the turns.

Windows give each turn its number and its fault. The sorted turns of a conversation are folded with aggregate(), which
carries four structs (cost, audit), the cheapest way into each state of the role grammar (s?(ua)+)?: nothing yet, after
the system turn, after a user's turn, after an assistant's. least() takes the cheaper struct and among equals the
ASCII-least audit. That is exact: of two ways into one state over the same turns and at the same cost neither audit is
the beginning of the other, as they differ by more than insertions, so the order holds whatever follows.

A long conversation is folded in segments, from each of the four states, and the segments' results are joined; so the
audit that a fold carries stays short. The repaired lines are made from the audit in pieces likewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patternmill.llm.common import unsigned_crc32
from patternmill.llm.merkle import crc32_sql

#: Turns of a segment, and letters of a piece of the audit.
SEGMENT = 512
STATES = ["none", "system", "user", "assistant"]
INSERT, CHANGE, DELETE, OPEN_END = 2, 2, 3, 1
#: The initials that may follow each other.
PAIRS = ["su", "ua", "au"]
WAY = "struct<cost: bigint, audit: string>"
INK, END = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def flagged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with n (from 1, by turn, nulls first; ties by role and text), initial, fault, illegal and fresh.

    fault is the first of blank, duplicate and truncated, or null. illegal: the initials of the turn before and of this
    one may not follow each other. fresh: the first row of a turn that is not null. One shuffle, by conversation.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    within, alike = Window.partitionBy("conv_id").orderBy(*order), Window.partitionBy("conv_id", "role", "text").orderBy(*order)
    told = rows.select("conv_id", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"))
    told = told.withColumn("__nth", F.row_number().over(alike)).withColumn("n", F.row_number().over(within)).withColumn("__prev", F.lag(F.struct("initial", "turn")).over(within))
    fault = F.when(~F.col("text").rlike(INK), "blank").when(F.col("__nth") > 1, "duplicate").when(~F.col("text").rlike(END), "truncated")
    illegal = F.col("__prev").isNotNull() & ~F.concat("__prev.initial", "initial").isin(PAIRS)
    fresh = F.col("turn").isNotNull() & ~F.col("__prev.turn").eqNullSafe(F.col("turn"))
    return told.withColumns({"fault": fault, "illegal": illegal, "fresh": fresh}).drop("__nth", "__prev")


def _way(cost: Column | int, audit: Column | str) -> Column:
    c, a = (F.lit(cost) if isinstance(cost, int) else cost), (F.lit(audit) if isinstance(audit, str) else audit)
    return F.struct(c.cast("long").alias("cost"), a.alias("audit"))


def _more(way: Column, cost: Column | int, letter: Column | str) -> Column:
    """The way with one more edit; null where there is no way."""
    return F.when(way.isNotNull(), _way(way["cost"] + cost, F.concat(way["audit"], F.lit(letter) if isinstance(letter, str) else letter)))


def _with_inserts(none: Column, system: Column, user: Column, assistant: Column) -> Column:
    """The four ways, with turns inserted where that is cheaper."""
    asked = F.least(user, *[_more(w, INSERT, "I") for w in (none, system, assistant)])
    return F.struct(none.alias("none"), system.alias("system"), asked.alias("user"), F.least(assistant, _more(asked, INSERT, "I")).alias("assistant"))


def _step(acc: Column, turn: Column) -> Column:
    """The four ways after one more turn."""
    out = lambda way: _more(way, DELETE, "D")
    extra = F.when(turn["cut"], OPEN_END).otherwise(0)

    def kept(way: Column, initial: str) -> Column:
        same = turn["initial"] == initial
        return F.when(~turn["gone"], _more(way, extra + F.when(same, 0).otherwise(CHANGE), F.when(same, "K").otherwise("R")))

    none, system, user, assistant = (acc[s] for s in STATES)
    opened = F.when(~turn["gone"] & (turn["initial"] == "s"), _more(none, extra, "K"))
    return _with_inserts(out(none), F.least(out(system), opened), F.least(out(user), *[kept(w, "u") for w in (none, system, assistant)]), F.least(out(assistant), kept(user, "a")))


def _ways(start: str, turns: str, inserts: bool) -> Column:
    """The fold over the turns of a segment from a state; inserts: turns may be put in before the first one."""
    empty = F.lit(None).cast(WAY)
    own = {s: _way(0, "") if s == start else empty for s in STATES}
    plain = F.struct(*[own[s].alias(s) for s in STATES])
    kind = "struct<" + ", ".join(f"{s}: {WAY}" for s in STATES) + ">"
    return F.aggregate(F.col(turns), (_with_inserts(*own.values()) if inserts else plain).cast(kind), lambda a, t: _step(a, t).cast(kind)).cast(kind)


def _joined(acc: Column, part: Column) -> Column:
    """The ways through the segments so far and one more; part: the ways through it from each state."""
    into = lambda to: F.least(*[F.when(acc[s].isNotNull() & part[s][to].isNotNull(), _way(acc[s]["cost"] + part[s][to]["cost"], F.concat(acc[s]["audit"], part[s][to]["audit"]))) for s in STATES])
    return F.struct(*[into(s).alias(s) for s in STATES])


def _lines(audit: Column, turns: Column) -> Column:
    """The repaired turns (role, text) that an audit gives, in pieces of SEGMENT letters.

    What comes after the system turn, if that is kept, is a user's and an assistant's turn by turns.
    """
    deleted = F.length(F.regexp_extract(audit, "^D*", 0))
    system = (F.substr(audit, deleted + 1, F.lit(1)) == "K") & (F.get(turns, deleted)["initial"] == "s")
    shift = F.when(system, 1).otherwise(0)
    kind = "struct<at: int, k: int, lines: array<struct<role: string, text: string>>>"

    def piece(c: Column) -> Column:
        before, own = F.substr(audit, F.lit(1), c * SEGMENT), F.substr(audit, c * SEGMENT + 1, F.lit(SEGMENT))
        at, k = F.length(F.translate(before, "I", "")), F.length(F.translate(before, "D", "")) - shift
        start = F.struct(at.cast("int").alias("at"), k.cast("int").alias("k"), F.array().cast("array<struct<role: string, text: string>>").alias("lines")).cast(kind)

        def put(a: Column, letter: Column) -> Column:
            turn = F.get(turns, a["at"])
            role = F.when(letter == "K", turn["role"]).when(a["k"] % 2 == 0, "user").otherwise("assistant")
            line = F.struct(role.alias("role"), F.when(letter == "I", "").otherwise(turn["text"]).alias("text"))
            lines = F.when(letter == "D", a["lines"]).otherwise(F.concat(a["lines"], F.array(line)))
            return F.struct((a["at"] + F.when(letter == "I", 0).otherwise(1)).alias("at"), (a["k"] + F.when(letter == "D", 0).otherwise(1)).alias("k"), lines.alias("lines")).cast(kind)

        return F.aggregate(F.filter(F.split(own, ""), lambda x: x != ""), start, put, lambda a: a["lines"])

    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.length(audit) / SEGMENT).cast("int")), piece))


def repaired(rows: DataFrame) -> DataFrame:
    """A row for each conversation of rows (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit and turns, an array of the repaired (role, text).

    Blank and duplicate turns must go. A role that is empty has no initial and cannot be kept; one of another initial
    than s, u and a is changed or deleted. A null conv_id is a conversation of its own; null roles and texts count as
    one space. Repeated rows are duplicates. No rows give none. A conversation's turns end in one row, as its repaired
    text is one value: that bounds how long it may be.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    told = flagged(rows.select("conv_id", "turn", space("role"), space("text")))
    gone = F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False))
    turn = F.struct("n", "role", "text", "initial", gone.alias("gone"), F.coalesce(F.col("fault") == "truncated", F.lit(False)).alias("cut"))
    sums = {f: F.count_if(F.col("fault") == f) for f in ("blank", "duplicate", "truncated")} | {"illegal": F.count_if("illegal"), "distinct": F.count_if("fresh")}
    cut = told.groupBy("conv_id", F.floor((F.col("n") - 1) / SEGMENT).alias("seg")).agg(
        F.sort_array(F.collect_list(turn)).alias("turns"), F.min("turn").alias("low"), F.max("turn").alias("high"), *[c.alias(k) for k, c in sums.items()]
    )
    first = F.col("seg") == 0
    parts = F.struct(F.when(first, _ways("none", "turns", True)).otherwise(_ways("none", "turns", False)).alias("none"), *[F.when(~first, _ways(s, "turns", False)).alias(s) for s in STATES[1:]])
    one = cut.withColumn("part", parts).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("seg", "part", "turns"))).alias("segs"), F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(k).alias(k) for k in sums]
    )
    kind = "struct<" + ", ".join(f"{s}: {WAY}" for s in STATES) + ">"
    start = F.struct(*[(_way(0, "") if s == "none" else F.lit(None).cast(WAY)).alias(s) for s in STATES]).cast(kind)
    best = F.aggregate("segs", start, lambda a, s: _joined(a, s["part"]).cast(kind), lambda a: F.least(a["none"], a["assistant"]))
    whole = one.withColumn("best", best).withColumn("all", F.flatten(F.transform("segs", lambda s: s["turns"])))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0)).cast("long")
    counts = [F.col(k).cast("long").alias(k) for k in ("blank", "duplicate", "truncated", "illegal")]
    return whole.select("conv_id", gaps.alias("gaps"), *counts, F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), "all").select("*", _lines(F.col("audit"), F.col("all")).alias("turns")).drop("all")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with nulls as one space, damaged by the CRC of conv_id and turn: dropped, emptied, cut off, repeated or given to the user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = unsigned_crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    told = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("__kind")).where("__kind <> 0")
    cut = F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("__kind") == 4, "user").otherwise(F.col("role"))
    return told.select("conv_id", "turn", role.alias("role"), cut.alias("text"), F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("__copy")).drop("__copy")


def report(rows: DataFrame) -> DataFrame:
    """What repaired() says of the damaged conversations, for each conv_id of rows; where nothing is left, zeros and empty texts."""
    told = repaired(damaged(rows))
    joined = rows.select(F.col("conv_id").alias("__id")).distinct().join(told, F.col("__id").eqNullSafe(F.col("conv_id")), "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return joined.select(
        F.col("__id").alias("conv_id"), *map(count, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce(lines, F.lit("")), 256).alias("repaired_sha256")
    )


def _sql_more(way: str, cost: str, letter: str) -> str:
    return f"printf('%012d', CAST(substr({way}, 1, 12) AS BIGINT) + {cost}) || substr({way}, 13) || {letter}"


def _sql_step() -> str:
    """SQL for the four ways (strings of cost and audit) after the next turn, with and then without insertions."""
    out = lambda w: _sql_more(w, str(DELETE), "'D'")

    def kept(way: str, initial: str) -> str:
        return f"CASE WHEN NOT gone THEN {_sql_more(way, f'(cut::INT + CASE WHEN initial = {initial!r} THEN 0 ELSE {CHANGE} END)', f'CASE WHEN initial = {initial!r} THEN {chr(39)}K{chr(39)} ELSE {chr(39)}R{chr(39)} END')} END"

    opened = f"CASE WHEN NOT gone AND initial = 's' THEN {_sql_more('e', 'cut::INT', chr(39) + 'K' + chr(39))} END"
    return f"{out('e')} AS e, least({out('s')}, {opened}) AS s, least({out('u')}, {', '.join(kept(w, 'u') for w in 'esa')}) AS u, least({out('a')}, {kept('u', 'a')}) AS a"


def _sql_inserts(source: str) -> str:
    more = lambda w: _sql_more(w, str(INSERT), "'I'")
    return f"SELECT g, n, e, s, u, least(a, {more('u')}) AS a FROM (SELECT g, n, e, s, least(u, {', '.join(map(more, 'esa'))}) AS u, a FROM {source})"


ORACLE_SQL = rf"""
WITH RECURSIVE told AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    ({crc32_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")}) % 20 AS kind
  FROM conversations
), hurt AS (
  SELECT g, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM told WHERE kind <> 0
), seen AS (
  SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, copy) AS n, row_number() OVER (PARTITION BY g, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM hurt
), rows AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY g ORDER BY n) || initial AS pair FROM seen
), flags AS (
  SELECT *, fault IN ('blank', 'duplicate') AS gone, fault = 'truncated' AS cut FROM rows
), counts AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS last
  FROM flags GROUP BY g
), ways AS (
  {_sql_inserts("(SELECT DISTINCT g, CAST(0 AS BIGINT) AS n, '000000000000' AS e, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM flags)")}
  UNION ALL
  {_sql_inserts(f"(SELECT w.g, w.n + 1 AS n, {_sql_step()} FROM ways w JOIN flags f ON w.g = f.g AND f.n = w.n + 1)")}
), best AS (
  SELECT w.g, CAST(substr(least(e, a), 1, 12) AS BIGINT) AS cost, substr(least(e, a), 13) AS audit FROM ways w JOIN counts c ON w.g = c.g AND w.n = c.last
), walk AS (
  SELECT g, audit, 0 AS i, CAST(0 AS BIGINT) AS at_turn, 0 AS told, CAST('' AS VARCHAR) AS before, CAST([] AS VARCHAR[]) AS lines FROM best
  UNION ALL
  SELECT g, audit, i + 1, at_turn + CASE WHEN letter = 'I' THEN 0 ELSE 1 END, told, CASE WHEN letter = 'D' THEN before ELSE substr(new_role, 1, 1) END,
    CASE WHEN letter = 'D' THEN lines ELSE list_append(lines, new_role || ':' || CASE WHEN letter = 'I' THEN '' ELSE new_text END) END
  FROM (
    SELECT w.*, substr(audit, i + 1, 1) AS letter, f.text AS new_text, CASE WHEN substr(audit, i + 1, 1) = 'K' THEN f.role WHEN before = 'u' THEN 'assistant' ELSE 'user' END AS new_role
    FROM walk w LEFT JOIN flags f ON w.g = f.g AND f.n = w.at_turn + 1 WHERE i < length(audit)
  )
), ended AS (
  SELECT g, array_to_string(lines, chr(10)) AS whole FROM walk WHERE i = length(audit)
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM told) o LEFT JOIN counts c ON o.g = c.g LEFT JOIN best b ON o.g = b.g LEFT JOIN ended e ON o.g = e.g
"""
