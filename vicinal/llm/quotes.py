"""Quotations in messages linked to the messages they come from; conversations in reply order without quotes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm.asof import latest_before
from vicinal.llm.base import dropped, table, written
from vicinal.llm.flat import parts

#: The marks before a quoted line: one > for each level.
MARKS = r"^[\x20\t]*>[>\x20\t]*"
#: A line that says whose quotation follows.
SAYS = r"(wrote|writes|said|schrieb|escribió|a écrit)\s*:\s*$"
#: A unit of fewer words is no evidence, unless it is the whole of a message.
FEW = 3

_MARKS, _SAYS = re.compile(MARKS), re.compile(SAYS)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")


def bare(text: str) -> str:
    """text without what isn't a letter or digit at its ends, in time that follows its length."""
    i, j = 0, len(text)
    while i < j and not text[i].isalnum():
        i += 1
    while j > i and not text[j - 1].isalnum():
        j -= 1
    return text[i:j]


def normal(text: str) -> str:
    """What quoting changes doesn't count: case, white space, so line breaks too, and punctuation at the ends."""
    return bare(re.sub(r"\s+", " ", text.lower()))


def passages(text: str) -> list[tuple[int, list[str]]]:
    """(level, paragraphs) of each maximal run of lines of one quote level; 0 is the message's own text. Lines that announce a
    quotation belong to none; lines without text end a paragraph."""
    lines = re.split("\r?\n", text)
    marks = [m[0].count(">") if (m := _MARKS.match(x)) else 0 for x in lines]
    out: list[tuple[int, list[str]]] = []
    open_ = False
    for i, (line, level) in enumerate(zip(lines, marks, strict=True)):
        if not level and line.rstrip().endswith(":") and _SAYS.search(line) and i + 1 < len(lines) and marks[i + 1]:
            continue
        body = _MARKS.sub("", line).strip()
        if not body:
            open_ = False
            continue
        if not out or out[-1][0] != level:
            out.append((level, []))
            open_ = False
        if open_:
            out[-1][1][-1] += " " + body
        else:
            out[-1][1].append(body)
        open_ = True
    return out


def units(paragraphs: list[str]) -> list[tuple[int, str]]:
    """(kind, normalised text): 0 the whole, 1 its paragraphs, 2 their sentences."""
    found = [(0, normal(" ".join(paragraphs)))]
    found += [(1, normal(p)) for p in paragraphs] if len(paragraphs) > 1 else []
    return found + [(2, normal(s)) for p in paragraphs for s in _SENTENCE.split(p)]


def key(unit: str, whole: bool) -> int | None:
    """Hash by which a unit is looked up; short units only stand for whole messages."""
    short = len(unit.split(" ")) < FEW
    if not unit or (short and not whole):
        return None
    return xxhash.xxh64_intdigest(("=" if short else "") + unit) - 2**63


def told(text: str) -> list[tuple[int, int, int, int, int]]:
    """(level, passage, kind, hash, words) of what a message says itself (level 0, passage -1) and of what it quotes."""
    runs = passages(text)
    own = [p for level, ps in runs if level == 0 for p in ps]
    said = {(u, True) for _, u in units(own)[:1]} | {(u, False) for level, ps in runs if level == 0 for _, u in units(ps)}
    rows = {(0, -1, 0, h, len(u.split(" "))) for u, whole in said if (h := key(u, whole)) is not None}
    for i, (level, ps) in enumerate(runs):
        if level:
            rows |= {(level, i, kind, h, len(u.split(" "))) for kind, u in units(ps) if (h := key(u, kind == 0)) is not None}
    return sorted(rows)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in parts(whole):
            rows = [(c, t, *x) for c, t, text in zip(*(batch.column(k).to_pylist() for k in ("c", "turn", "text")), strict=True) for x in told(text)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()), strict=True)], ["c", "turn", "level", "passage", "kind", "hash", "words"])


def _ids() -> list[Column]:
    """c: the conversation as text, null apart from all others; turn as a long, null where it isn't a number."""
    return [F.when(F.col("conv_id").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("conv_id").cast("string"))).alias("c"), F.expr("try_cast(turn AS bigint)").alias("turn")]


def linked(messages: DataFrame) -> DataFrame:
    """(c, turn, parent_turn, n_linked): messages that quote an earlier one of their conversation, and how many passages did.

    A quoted passage is a maximal run of lines of one level, joined over its line breaks. It is looked up whole, by paragraphs and
    by sentences, each in the latest earlier message that says it itself: an as-of join by conversation and hash. Whole goes before
    paragraphs, those before sentences; of several messages the one with most words counts, then the latest. The parent is the
    message that most words of the least linked level come from, then the latest. Conversations without a > are not parsed.
    """
    some = messages.select(*_ids(), "text").filter("turn is not null and text is not null")
    quoting = some.filter(F.contains("text", F.lit(">"))).select("c").distinct()
    rows = some.distinct().join(quoting, "c", "left_semi").select("c", "turn", "text").mapInArrow(_parse, "c string, turn long, level int, passage int, kind int, hash long, words int")
    rows = written(rows, "units")
    asked = rows.filter("level > 0").select("c", "hash").distinct()
    found = latest_before(rows.join(asked, ["c", "hash"], "left_semi"), ["c", "hash"], "turn", F.col("level") == 0, [], "level").filter("level > 0 and found is not null")
    votes = found.groupBy("c", "turn", "level", "passage", "kind", F.col("found.at").alias("parent_turn")).agg(F.sum("words").alias("words"))
    each = votes.groupBy("c", "turn", "level", "passage").agg(F.max(F.struct((-F.col("kind")).alias("kind"), "words", "parent_turn")).alias("best"))
    by_parent = each.groupBy("c", "turn", "level", F.col("best.parent_turn").alias("parent_turn")).agg(F.sum("best.words").alias("words"), F.count("*").alias("n"))
    return by_parent.groupBy("c", "turn").agg(F.max_by("parent_turn", F.struct(-F.col("level"), "words", "parent_turn")).alias("parent_turn"), F.sum("n").alias("n_linked"))


def _roots(links: DataFrame) -> DataFrame:
    """(c, turn, root_turn, depth): paths to the root are halved in rounds, each a written table; what has arrived isn't joined again."""
    paths = written(links.select("c", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("depth"), F.lit(True).alias("moved")), "paths")
    while paths.filter("moved").limit(1).count():
        step = paths.select("c", F.col("turn").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        on = paths.filter("moved").join(step, ["c", "up"], "left").select("c", "turn", F.coalesce("further", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved"))
        before, paths = paths, written(on.unionByName(paths.filter("not moved")), "paths")
        dropped(before)
    return paths.select("c", "turn", F.col("up").alias("root_turn"), "depth")


def _places(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(c, turn, place): each message's place in its thread, replies after what they reply to, a reply's own replies before the
    next one, replies to one message by turn.

    A walk around each tree goes down (0) and up (1) once at every message; its elements are a list, and doubling steps along it
    count the downs that are left. So a thread of any size is spread over tasks, in as many rounds as its size has binary digits.
    """
    top = roots.select("c", F.col("root_turn").alias("turn")).distinct()
    child = links.groupBy("c", F.col("parent_turn").alias("turn")).agg(F.min(F.col("turn")).alias("first"))
    older = latest_before(links.select("c", "parent_turn", "turn"), ["c", "parent_turn"], "turn", F.lit(True), [], "turn")
    younger = older.filter("found is not null").select("c", F.col("found.at").alias("turn"), F.col("turn").alias("next"))
    all_ = links.select("c", "turn", "parent_turn").unionByName(top.withColumn("parent_turn", F.lit(None).cast("long")))
    node = all_.join(child, ["c", "turn"], "left").join(younger, ["c", "turn"], "left")
    down = F.struct(F.lit(0).alias("k"), F.coalesce("first", "turn").alias("nt"), F.col("first").isNull().cast("int").alias("nk"))
    up = F.struct(F.lit(1).alias("k"), F.coalesce("next", "parent_turn").alias("nt"), F.when(F.col("next").isNotNull(), 0).when(F.col("parent_turn").isNotNull(), 1).alias("nk"))
    walk = written(node.select("c", "turn", F.explode(F.array(down, up)).alias("x")).select("c", "turn", "x.*", (F.lit(1) - F.col("x.k")).cast("long").alias("left")), "walk")
    while walk.filter("nt is not null").limit(1).count():
        step = walk.select("c", F.col("turn").alias("nt"), F.col("k").alias("nk"), F.col("nt").alias("nt2"), F.col("nk").alias("nk2"), F.col("left").alias("more"))
        on = walk.filter("nt is not null").join(step, ["c", "nt", "nk"]).select("c", "turn", "k", F.col("nt2").alias("nt"), F.col("nk2").alias("nk"), (F.col("left") + F.col("more")).alias("left"))
        before, walk = walk, written(on.unionByName(walk.filter("nt is null")), "walk")
        dropped(before)
    left = walk.filter("k = 0").select("c", "turn", "left")
    size = left.join(top, ["c", "turn"], "left_semi").select("c", F.col("turn").alias("root_turn"), F.col("left").alias("size"))
    of = roots.select("c", "turn", "root_turn").unionByName(top.withColumn("root_turn", F.col("turn")))
    return left.join(of, ["c", "turn"]).join(size, ["c", "root_turn"]).select("c", "turn", (F.col("size") - F.col("left")).alias("place"))


def ordered(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, text without quotes, parent_turn, root_turn, depth, place, n_quoted, n_linked.

    Sorted by conv_id, root_turn and place, each conversation is in reply order: a reply comes after what it replies to, and before
    the next reply to that. A message without a linked quotation starts a thread. conv_id may be of any type, null is a
    conversation of its own; a turn that isn't a whole number, or null, is linked with nothing. A null text stays null, an empty
    one empty; texts of any length are parsed whole; messages of one conversation and turn, repeated or not, share their links;
    no messages give no rows; extra columns are ignored.
    """
    links = written(linked(messages), "quotes")
    roots = written(_roots(links), "roots")
    marked = F.transform(F.split("text", "\r?\n", -1), lambda x: F.struct(x.alias("raw"), x.rlike(MARKS).alias("quoted")))
    df = messages.select("conv_id", F.col("turn").alias("_turn"), "role", marked.alias("lines"), *_ids())
    gone = lambda x, i: x["quoted"] | (x["raw"].rlike(r":\s*$") & x["raw"].rlike(SAYS) & F.coalesce(F.get("lines", i + 1)["quoted"], F.lit(False)))
    text = F.trim(F.array_join(F.transform(F.filter("lines", lambda x, i: ~gone(x, i)), lambda x: x["raw"]), "\n"), F.lit(" \t\n\x0b\x0c\r"))
    df = df.select("conv_id", "_turn", "role", text.alias("text"), F.size(F.filter("lines", lambda x: x["quoted"])).alias("n_quoted"), "c", "turn")
    said = links.join(roots, ["c", "turn"])
    out = df.join(said, ["c", "turn"], "left").join(_places(links, roots), ["c", "turn"], "left")
    long_ = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", F.col("_turn").alias("turn"), "role", "text", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), long_("depth"), long_("place"), F.greatest("n_quoted", F.lit(0)).cast("long").alias("n_quoted"), long_("n_linked"))


def quoting(messages: DataFrame) -> DataFrame:
    """Messages in which some quote earlier ones, as mail programs do: of every four, by a hash of conversation and turn, one quotes
    the message before it, wrapped anew, one the last sentences of the message two before under a line that says so, and one both
    as nested levels."""
    m = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    one = m.filter("conv_id is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("told"))
    for k in (1, 2):
        m = m.join(one.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("told").alias(f"t{k}")), ["conv_id", "turn"], "left")
    wrapped = lambda c: F.regexp_replace(c, r"(?<!\S)((?:\S++[ \t]++){7}\S++)[ \t]++", "$1\n")
    quoted = lambda c, mark: F.regexp_replace(c, r"(?m)^", mark)
    tail = F.regexp_extract("t2", r"(?<![^.!?])([^.!?]++[.!?]++\s*+)$", 1)
    how = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    head = F.when((how == 0) & F.col("t1").isNotNull(), quoted(wrapped("t1"), "> ")).when((how == 1) & (tail != ""), F.concat(F.lit("Someone wrote:\n"), quoted(tail, "> "))).when((how == 2) & F.col("t1").isNotNull() & F.col("t2").isNotNull(), F.concat(quoted(wrapped("t2"), "> > "), F.lit("\n"), quoted("t1", "> ")))
    return m.select("conv_id", "turn", "role", F.when(head.isNotNull(), F.concat(head, F.lit("\n\n"), F.coalesce("text", F.lit("")))).otherwise(F.col("text")).alias("text"))


def op9_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, with quotations put in as `quoting` says: the table has none."""
    return ordered(quoting(table(spark, sf_dir, "conversations")))
