"""Faults of conversations and their cheapest repair by a grammar of roles.

A repaired conversation is empty or has one leading system turn or none, and then user and assistant in turn. Every
conversation is cut into runs of rows, each a short string of symbols; tasks hand batches of runs to DuckDB, whose recursive query
advances one row for all runs at once and keeps, for every state of the grammar, the least cost and its audit. Runs of
long conversations are put together pair by pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import placed
from .sqlparts import CRC_TABLE, crc32
from .store import written

#: White space by the contract: blank, and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
#: The grammar's steps from 0 (nothing yet), 1 (after system), 2 (after user), 3 (after assistant); 0 and 3 may end.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ENDS = (0, 3)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Plans have their own letters for what becomes a user's (I, R) or an assistant's (J, S); they sort as the audit's D, I, K, R do.
AUDIT = ("JS", "IR")


def _inserts(state: int) -> list[tuple[int, int, str]]:
    """(state, cost, plan) after no, one or two insertions; more lead to no state at less cost."""
    found = [(state, 0, "")]
    for _ in range(2):
        at, cost, plan = found[-1]
        found.append((GRAMMAR[at]["u"], cost + INSERT, plan + "I") if "u" in GRAMMAR[at] else (GRAMMAR[at]["a"], cost + INSERT, plan + "J"))
    return found


def moves() -> list[tuple[str, int, int, int, str]]:
    """(symbol, state before, state after, cost, plan) of a row and the insertions before it.

    Symbols: D for a row that must go, else the role's initial (o for others), a capital where the row is truncated.
    """
    out = []
    for symbol in "DsuaoSUAO":
        extra = TRUNCATED if symbol in "SUAO" else 0
        for start in GRAMMAR:
            for at, cost, plan in _inserts(start):
                out.append((symbol, start, at, cost + DELETE, plan + "D"))
                if symbol != "D":
                    choices = [(symbol.lower(), "K", 0), ("u", "R", REROLE), ("a", "S", REROLE)]
                    out += [(symbol, start, GRAMMAR[at][r], cost + c + extra, plan + p) for r, p, c in choices if r in GRAMMAR[at]]
    return out


def closing() -> list[tuple[int, int, str]]:
    """(state, cost, plan) of the cheapest insertions that end a conversation in each state."""
    return [(s, *min((cost, plan) for at, cost, plan in _inserts(s) if at in ENDS)) for s in GRAMMAR]


STEPS = """
with recursive dp(id, n, origin, state, best) as (
  select id, 0, o, o, {'cost': 0::bigint, 'plan': ''} from runs join (values (0), (1), (2), (3)) s(o) on o = 0 or not first
  union all
  select d.id, d.n + 1, d.origin, m.after, min({'cost': d.best.cost + m.cost, 'plan': d.best.plan || m.plan})
  from dp d join runs r on r.id = d.id join moves m on m.symbol = substr(r.symbols, d.n + 1, 1) and m.before = d.state
  where d.n < length(r.symbols) group by d.id, d.n, d.origin, m.after)
select d.id, d.origin, d.state, d.best.cost as cost, d.best.plan as plan from dp d join runs r on r.id = d.id and d.n = length(r.symbols)"""
RUN = "key string, seg long, origin int, state int, cost long, plan string"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``RUN`` for runs (key, seg, symbols), some 20,000 symbols at a time."""
    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
    con.execute("create table moves(symbol varchar, before int, after int, cost bigint, plan varchar)")
    con.executemany("insert into moves values (?, ?, ?, ?, ?)", moves())
    names = [x.split()[0] for x in RUN.split(", ")]

    def answer(keys: list, segs: list, texts: list) -> pa.RecordBatch:
        con.register("runs", pa.table({"id": pa.array(range(len(keys)), pa.int64()), "first": pa.array([s == 0 for s in segs]), "symbols": pa.array(texts, pa.string())}))
        ids, origin, state, cost, plan = zip(*con.execute(STEPS).fetchall(), strict=True)
        con.unregister("runs")
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(([keys[i] for i in ids], [segs[i] for i in ids], origin, state, cost, plan), kinds, strict=True)], names)

    held: tuple[list, list, list] = ([], [], [])
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for column, value in zip(held, row, strict=True):
                column.append(value)
            size += len(row[2])
            if size >= 20_000:
                yield answer(*held)
                held, size = ([], [], []), 0
    if held[0]:
        yield answer(*held)
    con.close()


def _whole(runs: DataFrame) -> DataFrame:
    """(key, cost, plan) of the least cost over all runs of each key, from rows of ``RUN``: neighbours are joined until one run is left."""
    last = runs.groupBy("key").agg(F.max("seg").alias("last"))
    state = written(runs.join(last, "key"), "repair-runs")
    alone = [state.filter("last = 0")]
    state = state.filter("last > 0")
    while not state.isEmpty():
        half = state.withColumn("pair", F.shiftright("seg", 1))
        left, right = half.filter("seg % 2 = 0"), half.filter("seg % 2 = 1")
        right = right.select("key", "pair", F.col("origin").alias("state"), F.col("state").alias("after"), F.col("cost").alias("more"), F.col("plan").alias("rest"))
        both = left.join(right, ["key", "pair", "state"]).groupBy("key", "pair", "last", "origin", F.col("after").alias("state"))
        both = both.agg(F.min(F.struct((F.col("cost") + F.col("more")).alias("cost"), F.concat("plan", "rest").alias("plan"))).alias("best"))
        both = both.select("key", F.col("pair").alias("seg"), "origin", "state", "best.cost", "best.plan", F.shiftright("last", 1).alias("last"))
        odd = left.filter("seg = last").select("key", F.col("pair").alias("seg"), "origin", "state", "cost", "plan", F.shiftright("last", 1).alias("last"))
        state = written(both.unionByName(odd), "repair-runs")
        alone.append(state.filter("last = 0"))
        state = state.filter("last > 0")
    done = alone[0]
    for more in alone[1:]:
        done = done.unionByName(more)
    ends = F.create_map(*[F.lit(x) for s, cost, plan in closing() for x in (s, f"{cost}:{plan}")])
    end = F.split(ends[F.col("state")], ":")
    best = F.min(F.struct((F.col("cost") + end[0].cast("long")).alias("cost"), F.concat("plan", end[1]).alias("plan"))).alias("best")
    return done.filter("origin = 0").groupBy("key").agg(best).select("key", "best.cost", "best.plan")


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, idx, ops) for each row of a conversation: its letter after those inserted before it; the last row has those that follow, too."""
    for batch in batches:
        for key, plan in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = re.finditer("[IJ]*[KRSD](?:[IJ]+$)?", plan)
            place, more = 0, True
            while more:
                ops = [m.group() for m, _ in zip(found, range(50_000), strict=False)]
                more = len(ops) == 50_000
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(ops), pa.string()), pa.array(range(place, place + len(ops)), pa.int64()), pa.array(ops, pa.string())], ["key", "idx", "ops"])
                place += len(ops)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, repaired_sha256) from lines in the order of key and place, without holding more than a batch."""
    now, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([state.hexdigest()], pa.string())], ["key", "repaired_sha256"])

    for batch in batches:
        for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key == now:
                state.update(b"\n")
            else:
                if state:
                    yield row()
                now, state = key, sha256()
            state.update(line.encode())
    if state:
        yield row()


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with one row in four damaged, by the crc32 of ``conv_id:turn`` modulo 20; a null role or text becomes a blank."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    kept = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def repair(rows: DataFrame, run: int = 256) -> tuple[DataFrame, DataFrame]:
    """Faults and cheapest repair of conversations (conv_id, turn, role, text): a row for each conversation, and the repaired turns.

    The first: key, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. The second: key, conv_id, idx, sub (their order), role, text.
    Rows follow each other by turn, nulls first, then by role and text (its first 100 characters, then its digest). A null role or text counts
    as one blank; a null conv_id is a conversation of its own. Faults, costs and grammar are the module's constants. ``gaps`` ignores null
    turns and is null beyond 64 bits. Repeated rows are duplicates; a role is known by its first letter, others than s, u and a can only be
    reroled or deleted; a conversation may have any number of rows (``run`` of them in one symbol string); other columns are ignored; empty tables give empty ones.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    conv = rows.schema["conv_id"].dataType
    known = F.when(F.col("key") != "", F.expr("substring(key, 2)")).cast(conv).alias("conv_id")
    asked = rows.select(_key(F.col("conv_id")).alias("key"), "turn", blank("role"), blank("text"))
    asked = asked.withColumn("head", F.substring("text", 1, 100)).withColumn("digest", F.sha2("text", 256))
    table = placed(asked, ["key"], ["turn", "role", "head", "digest"], "repair-rows").drop("head")
    table = written(table, "repair-placed")

    body = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    marks = table.select("key", "idx", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("open"))
    firsts = table.filter(body != "").groupBy("key", "role", "digest").agg(F.min("idx").alias("idx")).select("key", "idx", F.lit(True).alias("fresh"))
    marks = marks.join(firsts, ["key", "idx"], "left")
    fault = F.when(F.col("blank"), "b").when(F.col("fresh").isNull(), "d").when(F.col("open"), "t").otherwise("-")
    groups = marks.select("key", (F.col("idx") / run).cast("long").alias("seg"), F.struct("idx", "initial", fault.alias("fault")).alias("mark")).groupBy("key", "seg").agg(F.sort_array(F.collect_list("mark")).alias("marks"))
    text = lambda f: F.array_join(F.transform("marks", f), "")
    symbol = lambda m: F.when(m["fault"].isin("b", "d"), "D").when(m["fault"] == "t", F.upper(m["initial"])).otherwise(m["initial"])
    runs = written(groups.select("key", "seg", text(symbol).alias("symbols"), text(lambda m: m["fault"]).alias("faults"), text(lambda m: m["initial"]).alias("initials")), "repair-symbols")

    best = written(_whole(runs.select("key", "seg", "symbols").mapInArrow(_solve, RUN)), "repair-plans")
    pairs = "filter(sequence(1, length(initials)), i -> i < length(initials) and substring(initials, i, 2) not in ('su', 'ua', 'au'))"
    count = lambda letter: F.sum(F.length(F.regexp_replace("faults", f"[^{letter}]", "")))
    inner = runs.groupBy("key").agg(count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"), F.sum(F.size(F.expr(pairs))).alias("illegal"))
    ends = runs.filter("seg > 0").select("key", "seg", F.substring("initials", 1, 1).alias("b"))
    starts = runs.select("key", (F.col("seg") + 1).alias("seg"), F.substring("initials", -1, 1).alias("a"))
    across = starts.join(ends, ["key", "seg"]).filter(~F.concat("a", "b").isin("su", "ua", "au")).groupBy("key").agg(F.count("*").alias("across"))
    wide = F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1 - F.countDistinct("turn")
    turns = table.groupBy("key").agg(F.coalesce(wide, F.lit(0)).alias("wide")).select("key", F.expr("try_cast(wide as bigint)").alias("gaps"))
    summary = inner.join(turns, "key").join(best, "key").join(across, "key", "left")
    illegal = (F.col("illegal") + F.coalesce("across", F.lit(0))).alias("illegal")
    summary = summary.select("key", known, "gaps", "blank", "duplicate", "truncated", illegal, "cost", F.translate("plan", *AUDIT).alias("audit"))

    ops = best.select("key", "plan").mapInArrow(_dealt, "key string, idx long, ops string")
    lines = table.join(ops.hint("merge"), ["key", "idx"])  # plans are far smaller packed than dealt out: their size says nothing of the ops
    role = "case op when 'K' then role when 'I' then 'user' when 'R' then 'user' else 'assistant' end"
    lines = lines.select("*", F.posexplode(F.split("ops", "")).alias("sub", "op")).filter("op not in ('', 'D')")
    return summary, lines.select("key", known, "idx", "sub", F.expr(role).alias("role"), F.expr("if(op in ('I', 'J'), '', text)").alias("text"))


def digests(turns: DataFrame) -> DataFrame:
    """(key, repaired_sha256) of ``role:text`` lines; a hash reads its lines one after another, so a conversation's pass through one task, as a stream."""
    lines = turns.select("key", "idx", "sub", F.concat("role", F.lit(":"), "text").alias("line")).repartition("key").sortWithinPartitions("key", "idx", "sub")
    return lines.select("key", "line").mapInArrow(_hashed, "key string, repaired_sha256 string")


def repaired(original: DataFrame, rows: DataFrame, run: int = 256) -> DataFrame:
    """For every conv_id of ``original`` the faults, cost and audit of its ``rows`` and the digest of its repaired turns; without rows zeros, an empty audit and the digest of nothing."""
    summary, turns = repair(rows, run)
    every = original.select("conv_id").distinct().withColumn("key", _key(F.col("conv_id")))
    out = every.join(summary.drop("conv_id"), "key", "left").join(digests(turns), "key", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    gaps = F.when(F.col("audit").isNull(), 0).otherwise(F.col("gaps")).cast("long").alias("gaps")
    return out.select("conv_id", gaps, *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"))


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repaired(rows, damage(rows))


def _oracle() -> str:
    listed = ", ".join(f"('{s}', {a}, {b}, {c}, '{p}')" for s, a, b, c, p in moves())
    ends = ", ".join(f"({s}, {c}, '{p}')" for s, c, p in closing())
    new = lambda p: f"case {p} when 'I' then ['user:'] when 'J' then ['assistant:'] when 'K' then [r.role || ':' || r.text] when 'R' then ['user:' || r.text] when 'S' then ['assistant:' || r.text] else [] end"
    added = f"list_concat({new('substr(m.plan, 1, 1)')}, {new('substr(m.plan, 2, 1)')}, {new('substr(m.plan, 3, 1)')})"
    audit = "translate({}, 'JS', 'IR')"
    return f"""
with recursive {CRC_TABLE},
moves(symbol, before, after, cost, plan) as (values {listed}),
ends(state, cost, plan) as (values {ends}),
o as (select *, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
d as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32("k")} % 20 as kind from o, tab),
e as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
  case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text,
  unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) as copy from d),
f as (select *, row_number() over w as n,
  regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') as body, case when substr(role, 1, 1) in ('s', 'u', 'a') then substr(role, 1, 1) else 'o' end as initial
  from e window w as (partition by conv_id order by turn nulls first, role, text)),
g as (select *, case when body = '' then 'b' when row_number() over (partition by conv_id, role, text order by n) > 1 then 'd' when right(body, 1) not in ('.', '!', '?') then 't' else '' end as fault,
  coalesce(lag(initial) over (partition by conv_id order by n) || initial not in ('su', 'ua', 'au'), false) as illegal from f),
r as (select conv_id, n, role, text, case when fault in ('b', 'd') then 'D' when fault = 't' then upper(initial) else initial end as symbol from g),
dp(conv_id, n, state, best) as (
  select distinct conv_id, cast(0 as bigint), 0, {{'cost': cast(0 as bigint), 'plan': '', 'lines': cast([] as varchar[])}} from r
  union all
  select p.conv_id, r.n, m.after, min({{'cost': p.best.cost + m.cost, 'plan': p.best.plan || m.plan, 'lines': list_concat(p.best.lines, {added})}})
  from dp p join r on r.conv_id is not distinct from p.conv_id and r.n = p.n + 1 join moves m on m.symbol = r.symbol and m.before = p.state
  group by p.conv_id, r.n, m.after),
last as (select conv_id, max(n) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank,
  count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated, count(*) filter (illegal) as illegal from g group by conv_id),
best as (select l.*, unnest(min({{'cost': p.best.cost + e.cost, 'plan': p.best.plan || e.plan,
    'lines': list_concat(p.best.lines, case e.plan when 'J' then ['assistant:'] when 'IJ' then ['user:', 'assistant:'] else [] end)}}) over (partition by l.conv_id)), row_number() over (partition by l.conv_id) as one
  from last l join dp p on p.conv_id is not distinct from l.conv_id and p.n = l.n join ends e on e.state = p.state)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(b.cost, 0) as cost, coalesce({audit.format("b.plan")}, '') as audit, sha256(coalesce(array_to_string(b.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join best b on b.conv_id is not distinct from o.conv_id and b.one = 1"""


ORACLES = {"op12_conversation_repair": _oracle()}
QUERIES = {"op12_conversation_repair": op12_conversation_repair}
