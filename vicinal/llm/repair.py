"""Repair of damaged conversations: an error-correcting Earley parse of their rows' roles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vicinal.llm.base import dropped, table, written

#: Grammar of roles, s?(ua)+ or nothing: what a rule gives, what it goes on from, the role it adds. Rules are left-linear, so every item
#: of a chart begins where the chart does and a column holds four completed items at most, however long a conversation is.
RULES = (("opened", "empty", "s"), ("asked", "empty", "u"), ("asked", "opened", "u"), ("asked", "answered", "u"), ("answered", "asked", "a"))
STATES, GOALS = ("empty", "opened", "asked", "answered"), ("empty", "answered")
#: Costs of the error productions; a truncated row that stays costs CUT more. s can't be inserted, and nothing is reroled to it.
INSERT, REROLE, DELETE, CUT = 2, 2, 3, 1
NAMES = {"u": "user", "a": "assistant"}
#: Rows of a conversation that one chart holds, a power of two.
CHUNK = 256
#: Parts of a conversation and text for the searches of earlier rows; charts that a worker keeps, of conversations up to SHORT rows.
SALT, KEPT, SHORT = 64, 50_000, 32
BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "_none boolean, _conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

Items = dict[str, tuple[int, str]]


def completed(items: Items) -> Items:
    """Prediction and completion with the insert productions, until no item has a lesser (cost, audit)."""
    items, agenda = dict(items), list(items)
    while agenda:
        state = agenda.pop()
        cost, audit = items[state]
        for left, before, role in RULES:
            if before == state and role in NAMES and (left not in items or (cost + INSERT, audit + "I") < items[left]):
                items[left] = (cost + INSERT, audit + "I")
                agenda.append(left)
    return items


def scanned(items: Items, initial: str, mark: str, n: int) -> Items:
    """The next column: over a row that stands n times, whose first may be kept, reroled or deleted; the others are duplicates."""
    forced = mark in "bd"
    many = n if forced else n - 1
    found = {state: (cost + DELETE, audit + "D") for state, (cost, audit) in items.items()} if not forced else items
    if not forced:
        more = CUT if mark == "t" else 0
        for left, before, role in RULES:
            if before in items and (role == initial or role in NAMES):
                cost, audit = items[before]
                new = (cost + more, audit + "K") if role == initial else (cost + more + REROLE, audit + "R")
                if left not in found or new < found[left]:
                    found[left] = new
    return {state: (cost + DELETE * many, audit + "D" * many) for state, (cost, audit) in found.items()} if many else found


def chart(rows: list[tuple[str, str, int]], state: str = "empty") -> Items:
    """The last column's completed items of a chart that begins in `state`: the least (cost, audit) for each state after the rows.

    Cost follows from the audit, and of two audits of the same rows at one cost neither begins the other, so what is least stays so
    under whatever comes before or after it. Inserts come before a row; those at a conversation's end are in `closing`.
    """
    items: Items = {state: (0, "")}
    for initial, mark, n in rows:
        items = scanned(completed(items), initial, mark, n)
    return items


def closing(state: str) -> tuple[int, str]:
    """The cheapest way from a state to the end of a conversation: inserts only."""
    return min(x for s, x in completed({state: (0, "")}).items() if s in GOALS)


def repaired(audit: str, rows: Iterator[tuple[str, str]], begun: int, odd: bool) -> Iterator[tuple[str, str]]:
    """What an audit makes of rows: (role, text). `begun`: repaired rows before these; odd: whether all repaired rows are odd in number,
    as only those that begin with s are. The grammar says which role stands at each place."""
    for edit in audit:
        row = None if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            yield row
        else:
            yield NAMES["ua"[(begun - odd) % 2]], row[1] if row else ""
        begun += 1


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after damage by crc32(conv_id:turn) % 20; a row of kind 3 stands twice. _none and _conv are the conversation."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))), F.lit(20))
    df = rows.select(F.col("conv_id").isNull().alias("_none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0).cast("long")).alias("_conv"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return df.select("_none", "_conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("n"))


def ordered(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows by conversation and turn, equal rows as one with their number: a written table with `pos`, which rises in that order.

    A conversation of any size is dealt over tasks by ranges of its turns. Rows of one turn go by role, the text's first 200
    characters and its hash.
    """
    same = rows.groupBy("_none", "_conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    same = same.withColumn("dig", F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))).withColumn("head", F.substring("text", 1, 200))
    by = ["_none", "_conv", "turn", "role", "head", "dig"]
    rest = F.rtrim(F.col("text"), F.lit(BLANKS))
    mark = F.when(rest == "", "b").when(F.substring(rest, -1, 1).isin(".", "!", "?"), "k").otherwise("t")
    df = same.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("pos", F.monotonically_increasing_id())
    initial = F.substring("role", 1, 1)
    return written(df.select("_none", "_conv", "turn", "role", "text", "n", "dig", "pos", F.floor(F.col("pos") / chunk).alias("chunk"), F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), mark.alias("mark")), "turns")


def marked(rows: DataFrame) -> DataFrame:
    """Rows without texts; mark d: the role and text stand earlier in the conversation. The search is dealt out by place, so one
    text that makes up a conversation is in SALT groups; what meets for one text is a row a group."""
    thin = rows.select("_none", "_conv", "turn", "dig", "pos", "n", "chunk", "initial", "mark", F.pmod("pos", F.lit(SALT)).alias("salt"))
    each = thin.filter("mark <> 'b'").groupBy("_none", "_conv", "dig", "salt").agg(F.min("pos").alias("least"), F.max("pos").alias("most"))
    per = W.partitionBy("_none", "_conv", "dig")
    first = each.withColumn("first", F.min("least").over(per)).filter(F.col("most") > F.col("first")).drop("least", "most")
    return thin.join(first, ["_none", "_conv", "dig", "salt"], "left").withColumn("mark", F.when((F.col("mark") != "b") & (F.col("pos") > F.col("first")), "d").otherwise(F.col("mark"))).drop("dig", "salt", "first")


_CHARTS: dict[tuple, list] = {}


def _charts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk: per pair of states (cost, rank of the audit among the chunk's, audit); -1 where no parse leads."""
    for batch in batches:
        cost, rank, audit, illegal = [], [], [], []
        for initials, marks, numbers, spans in zip(*(batch.column(x).to_pylist() for x in ("initials", "marks", "numbers", "spans")), strict=True):
            key = (initials, marks, tuple(numbers), spans)
            found = _CHARTS.get(key)
            if not found:
                rows = list(zip(initials, marks, numbers, strict=True))
                got = {(s, t): x for s in (STATES if spans else STATES[:1]) for t, x in chart(rows, s).items()}
                order = {a: i for i, a in enumerate(sorted({a for _, a in got.values()}))}
                pairs = [got.get((s, t)) for s in STATES for t in STATES]
                wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)) + sum(n - 1 for n in numbers)
                found = [[x[0] if x else -1 for x in pairs], [order[x[1]] if x else -1 for x in pairs], [x[1] if x else None for x in pairs], wrong]
                if len(_CHARTS) >= KEPT:
                    _CHARTS.clear()
                if len(initials) <= SHORT:
                    _CHARTS[key] = found
            for out, x in zip((cost, rank, audit, illegal), found, strict=True):
                out.append(x)
        keep = ["_none", "_conv", "chunk", "spans", "blank", "duplicate", "truncated", "low", "high", "turns", "head", "tail"]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keep), pa.array(cost, pa.list_(pa.int64())), pa.array(rank, pa.list_(pa.int32())), pa.array(audit, pa.list_(pa.string())), pa.array(illegal, pa.int64())], [*keep, "cost", "rank", "audit", "illegal"])


def charts(rows: DataFrame) -> DataFrame:
    """A row for each conversation's CHUNK places with its parses and counts: a written table. A conversation within one chunk is parsed
    from its beginning only."""
    n, mark = F.col("n"), F.col("mark")
    seq = F.sort_array(F.collect_list(F.struct("pos", "initial", "mark", "n")))
    turns = F.collect_set("turn")
    df = rows.groupBy("_none", "_conv", "chunk").agg(seq.alias("seq"), F.sum(F.when(mark == "b", n).otherwise(0)).alias("blank"), F.sum(F.when(mark == "b", 0).when(mark == "d", n).otherwise(n - 1)).alias("duplicate"), F.sum(F.when(mark == "t", 1).otherwise(0)).alias("truncated"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(turns).cast("long").alias("turns"))
    some = rows.groupBy("_none", "_conv").agg(F.min("chunk").alias("c0"), F.max("chunk").alias("c1")).filter("c0 < c1").select("_none", "_conv", F.lit(True).alias("spans"))
    field = lambda f: F.transform("seq", lambda x: x[f])
    df = df.join(some, ["_none", "_conv"], "left").select("_none", "_conv", "chunk", F.coalesce("spans", F.lit(False)).alias("spans"), "blank", "duplicate", "truncated", "low", "high", "turns", F.array_join(field("initial"), "").alias("initials"), F.array_join(field("mark"), "").alias("marks"), field("n").alias("numbers"))
    df = df.withColumn("head", F.substring("initials", 1, 1)).withColumn("tail", F.substring("initials", -1, 1))
    kind = "_none boolean, _conv long, chunk long, spans boolean, blank long, duplicate long, truncated long, low long, high long, turns long, head string, tail string, cost array<long>, rank array<int>, audit array<string>, illegal long"
    return written(df.mapInArrow(_charts, kind), "charts")


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a conversation from its last to its first: for each state at a chunk's beginning the state after it that leads to the
    least (cost, audit) of all that follows. Only costs and ranks are held."""
    now, ahead = None, {}
    for batch in batches:
        to = []
        for none, conv, cost, rank in zip(*(batch.column(x).to_pylist() for x in ("_none", "_conv", "cost", "rank")), strict=True):
            if (none, conv) != now:
                now, ahead = (none, conv), {t: closing(s)[0] for t, s in enumerate(STATES)}
            best = {s: min(((cost[4 * s + t] + ahead[t], rank[4 * s + t], t) for t in range(4) if cost[4 * s + t] >= 0 and t in ahead), default=None) for s in range(4)}
            ahead = {s: x[0] for s, x in best.items() if x}
            to.append([x[2] if x else -1 for x in best.values()])
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("_none", "_conv", "chunk")), pa.array(to, pa.list_(pa.int32()))], ["_none", "_conv", "chunk", "to"])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state = None, 0
    for batch in batches:
        pair = []
        for none, conv, to in zip(*(batch.column(x).to_pylist() for x in ("_none", "_conv", "to")), strict=True):
            if (none, conv) != now:
                now, state = (none, conv), 0
            pair.append(4 * state + to[state])
            state = to[state]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("_none", "_conv", "chunk")), pa.array(pair, pa.int32())], ["_none", "_conv", "chunk", "pair"])


def chosen(parses: DataFrame) -> DataFrame:
    """(_none, _conv, chunk, pair): which of a chunk's parses the cheapest repair of the whole conversation takes. Chunks of
    conversations that have several stream through a task in order; there are CHUNK times fewer of them than rows."""
    cost, rank = F.col("cost"), F.col("rank")
    ends = F.array(*(F.when(cost[t] >= 0, F.struct((cost[t] + closing(s)[0]).alias("c"), rank[t].alias("r"), F.lit(t).alias("pair"))) for t, s in enumerate(STATES)))
    whole = parses.filter("not spans").select("_none", "_conv", "chunk", F.array_min(F.filter(ends, lambda x: x.isNotNull()))["pair"].alias("pair"))
    parts = parses.filter("spans").select("_none", "_conv", "chunk", "cost", "rank").repartition("_none", "_conv").sortWithinPartitions("_none", "_conv", F.desc("chunk"))
    kind = "_none boolean, _conv long, chunk long"
    back = parts.mapInArrow(_backward, f"{kind}, to array<int>").repartition("_none", "_conv").sortWithinPartitions("_none", "_conv", "chunk")
    return whole.unionByName(back.mapInArrow(_forward, f"{kind}, pair int"))


class _Conversation:
    """What is known of a conversation whose rows come in order."""

    def __init__(self, odd: bool) -> None:
        self.sums, self.audit, self.odd, self.out = [0] * 5, [], odd, 0
        self.low = self.high = None
        self.turns, self.tail, self.sha = 0, None, hashlib.sha256()

    def put(self, audit: str, rows: Iterator[tuple[str, str]]) -> None:
        for role, text in repaired(audit, rows, self.out, self.odd):
            self.sha.update(f"{chr(10) if self.out else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.out += 1

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (gaps, *self.sums, "".join(self.audit), self.sha.hexdigest())


def _written_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each conversation in order, each chunk's parse before its rows: audits joined, repaired rows hashed as they come."""
    now, conv = None, None
    edits, place = "", 0
    done: list[tuple] = []

    def end() -> None:
        state = "asked" if conv.asked else "opened" if conv.opened else "empty"
        cost, audit = closing(state)
        conv.sums[4] += cost
        conv.audit.append(audit)
        conv.put(audit, iter(()))
        done.append((*now, *conv.row()))

    for batch in batches:
        for r in batch.to_pylist():
            key = (r["_none"], r["_conv"])
            if key != now:
                if now is not None:
                    end()
                now, conv = key, _Conversation(r["odd"])
                conv.asked = conv.opened = False
            if r["pos"] < 0:
                edits, place = r["audit"], 0
                state = STATES[r["pair"] % 4]
                conv.asked, conv.opened = state == "asked", state == "opened"
                for i, x in enumerate(("blank", "duplicate", "truncated", "illegal", "cost")):
                    conv.sums[i] += r[x]
                if conv.tail and conv.tail + r["head"] not in ("su", "ua", "au"):
                    conv.sums[3] += 1
                conv.tail = r["tail"]
                if r["turns"]:
                    conv.turns += r["turns"] - (conv.high == r["low"])
                    conv.low, conv.high = r["low"] if conv.low is None else conv.low, r["high"]
                conv.audit.append(edits)
                continue
            for _ in range(r["n"]):
                upto = place
                while edits[upto] == "I":
                    upto += 1
                conv.put(edits[place : upto + 1], iter([(r["role"], r["text"])]))
                place = upto + 1
        if len(done) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], _FIELDS)
            done = []
    if now is not None:
        end()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], _FIELDS)


_FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]


def repair(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text), after the damage that `damaged` does: conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256.

    A null conv_id is a conversation, a null turn comes first and takes no part in gaps, a null role or text is one space. Rows of one
    turn go by role, the text's first 200 characters and its hash; equal rows are one row with a number until they are parsed, and all
    but the first are duplicates. Empty and very long texts are read whole. A conversation that loses all rows has zeros, an empty
    audit and the hash of nothing; an empty table gives no rows; extra columns are ignored. A conversation of any length is parsed
    in chunks, which tasks share; only its hash, which goes from its first row to its last, streams through one.
    """
    all_ids = rows.select(F.col("conv_id").isNull().alias("_none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0).cast("long")).alias("_conv")).distinct()
    turns = ordered(damaged(rows), chunk)
    parses = charts(marked(turns))
    picked = parses.join(chosen(parses), ["_none", "_conv", "chunk"]).select("_none", "_conv", "chunk", "pair", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns", "head", "tail", F.col("cost")[F.col("pair")].alias("cost"), F.col("audit")[F.col("pair")].alias("audit"))
    # the repaired rows of all chunks and the inserts at the end: an odd number begins with s
    count = F.length(F.translate("audit", "D", ""))
    last = F.max_by(F.pmod("pair", F.lit(4)), "chunk")
    more = F.element_at(F.create_map(*(x for t, s in enumerate(STATES) for x in (F.lit(t), F.lit(len(closing(s)[1]))))), last)
    odd = picked.groupBy("_none", "_conv").agg((F.pmod(F.sum(count) + more, F.lit(2)) == 1).alias("odd"))
    picked = picked.join(odd, ["_none", "_conv"])
    plan = picked.withColumns({"pos": F.lit(-1).cast("long"), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string"), "n": F.lit(0).cast("long")})
    texts = turns.select("_none", "_conv", "chunk", "pos", "role", "text", "n")
    both = plan.unionByName(texts, allowMissingColumns=True).repartition("_none", "_conv").sortWithinPartitions("_none", "_conv", "chunk", "pos")
    found = both.mapInArrow(_written_out, SCHEMA)
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    conv: Column = F.when(~F.col("_none"), F.col("_conv")).alias("conv_id")
    out = all_ids.join(found, ["_none", "_conv"], "left").select(conv, *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
    out = written(out, "repaired")
    dropped(turns, parses)
    return out


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


def _bump(x: str, cost: str, edit: str) -> str:
    return f"(lpad(CAST(CAST(left({x}, 7) AS BIGINT) + {cost} AS VARCHAR), 7, '0') || substr({x}, 8) || {edit})"


#: The same by dynamic programming in SQL; an item is its cost in seven digits and its audit, so the least text is the least item.
OP11_SQL = rf"""
WITH RECURSIVE r AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT)) AS bytes
  FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations)),
c AS (SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda x, b:
        list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 20 AS kind FROM r),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM c, range(2) t(twice) WHERE kind <> 0 AND (twice = 0 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM d),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS rest,
        left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM o),
f AS (SELECT *, rest = '' AS blank, rest <> '' AND again AS dup, rest <> '' AND NOT again AND right(rest, 1) NOT IN ('.', '!', '?') AS cut FROM m),
p AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '0000000' AS e, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM d
  UNION ALL
  SELECT conv_id, i, {_bump("e", "3", "'D'")},
    CASE WHEN blank OR dup THEN {_bump("s", "3", "'D'")} ELSE least({_bump("s", "3", "'D'")}, CASE WHEN ini = 's' THEN {_bump("e", "CAST(cut AS INT)", "'K'")} END) END,
    CASE WHEN blank OR dup THEN {_bump("u", "3", "'D'")} ELSE least({_bump("u", "3", "'D'")}, {_bump("least(e, s, a)", "CAST(cut AS INT) + CASE WHEN ini = 'u' THEN 0 ELSE 2 END", "CASE WHEN ini = 'u' THEN 'K' ELSE 'R' END")}) END,
    CASE WHEN blank OR dup THEN {_bump("a", "3", "'D'")} ELSE least({_bump("a", "3", "'D'")}, {_bump("u", "CAST(cut AS INT) + CASE WHEN ini = 'a' THEN 0 ELSE 2 END", "CASE WHEN ini = 'a' THEN 'K' ELSE 'R' END")}) END
  FROM (SELECT f.conv_id, f.i, blank, dup, cut, ini, e, s, u, least(a, {_bump("u", "2", "'I'")}) AS a
        FROM f JOIN (SELECT conv_id, i, e, s, a, least(u, {_bump("least(e, s, a)", "2", "'I'")}) AS u FROM p) q ON f.conv_id IS NOT DISTINCT FROM q.conv_id AND f.i = q.i + 1)),
g AS (SELECT conv_id, least(e, a, {_bump("u", "2", "'I'")}) AS best FROM (SELECT p.conv_id, e, a, least(u, {_bump("least(e, s, a)", "2", "'I'")}) AS u
        FROM p JOIN (SELECT conv_id, max(i) AS n FROM f GROUP BY 1) x ON p.conv_id IS NOT DISTINCT FROM x.conv_id AND p.i = x.n)),
l AS (SELECT conv_id, CAST(left(best, 7) AS BIGINT) AS cost, substr(best, 8) AS audit FROM g),
w AS (SELECT conv_id, audit, k, substr(audit, k, 1) AS edit, length(replace(left(audit, k), 'I', '')) AS at, length(replace(left(audit, k), 'D', '')) AS place, length(replace(audit, 'D', '')) AS made
      FROM l, range(1, 100000) t(k) WHERE k <= length(audit)),
y AS (SELECT w.conv_id, string_agg(CASE WHEN edit = 'K' THEN f.role ELSE CASE WHEN (place + made) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN edit = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY k) AS text
      FROM w LEFT JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.at = f.i AND edit <> 'I' WHERE edit <> 'D' GROUP BY 1),
z AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, CAST(sum(blank::INT) AS BIGINT) AS blank, CAST(sum(dup::INT) AS BIGINT) AS duplicate,
        CAST(sum(cut::INT) AS BIGINT) AS truncated, CAST(sum((prior IS NOT NULL AND prior || ini NOT IN ('su', 'ua', 'au'))::INT) AS BIGINT) AS illegal FROM f GROUP BY 1)
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(y.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN z ON v.conv_id IS NOT DISTINCT FROM z.conv_id
LEFT JOIN l ON v.conv_id IS NOT DISTINCT FROM l.conv_id LEFT JOIN y ON v.conv_id IS NOT DISTINCT FROM y.conv_id
"""
