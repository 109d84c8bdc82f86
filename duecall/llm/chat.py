"""Chat formatting by quotation linking. DataFrame functions only.

A message's lines have a quote level: their leading ``>`` marks. Neighbouring lines of
one level from 1 on are a quoted passage; a line that only announces a quote ("... wrote:")
right before one belongs to it. Passages are normalised (marks off, lower case, white
space collapsed) and hashed, whole, by paragraph and by line; so is the unquoted part
of every message. Joined by hash, a quote leads to the message that wrote it: one of its
own conversation if there is one, else of any, always an earlier one by (conv_id, turn),
the earliest that has the passage. A message replies to the original of its lowest quote
level, there of its longest form (whole, paragraph, line), there of the earliest line.

Conversations joined by quotes become one thread, named by the smallest conv_id. Thread,
conv_id and turn order messages so that each follows the one it replies to. Quoted lines
are taken out of the text.

Originals are aggregated to one row for each hash before the join, so a passage that very
many messages hold or quote makes no pairs; the join is between written tables and plain
shuffles, so that a common hash can be split. A thread is never gathered: it is rows in order.

Null texts stay null, empty ones empty; very long ones are handled line by line. Messages with a null conv_id or turn are kept and never linked.
Repeated rows are one message and get one result each; ties between originals go to the earliest.
An empty table gives no rows. Only conv_id, turn, role and text are read, so extra columns don't matter.

``quoting`` makes a table of replies out of plain conversations: each message that follows
others quotes the one before it, and that one's quote of the message before, as mail does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duecall.llm.common import SPACE, let, text_key, written

MARKS = r"^[\x20\x09]{0,3}(?:>[\x20\x09]?)++"
ANNOUNCES = r"^.{0,200} (?:wrote|writes|schrieb|a écrit|escribió)[\x20\x09]{0,2}:[\x20\x09\r]*$"
#: Shorter lines and paragraphs don't identify a message; a whole passage does at any length.
LEAST_WORDS = 3
WHOLE, PARAGRAPH, LINE = 0, 1, 2


def parsed(text: Column) -> Column:
    """array<struct(level, line)> of a text; the line that announces a quote has the quote's level."""

    def of(lines: Column) -> Column:
        def by_marks(marks: Column) -> Column:
            def by_levels(levels: Column) -> Column:
                def row(x: Column, i: Column) -> Column:
                    announces = (F.get(levels, i) == 0) & (F.coalesce(F.get(levels, i + 1), F.lit(0)) > 0) & x.rlike(ANNOUNCES)
                    return F.struct(F.when(announces, F.lit(-1)).otherwise(F.get(levels, i)).alias("level"), F.substr(x, F.length(F.get(marks, i)) + 1).alias("line"))

                return F.transform(lines, row)

            return let(F.transform(marks, lambda m: F.length(m) - F.length(F.replace(m, F.lit(">"), F.lit("")))), by_levels)

        return let(F.transform(lines, lambda x: F.regexp_extract(x, MARKS, 0)), by_marks)

    return let(F.split(F.coalesce(text, F.lit("")), "\n"), of)


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, SPACE, " ")))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}|{SPACE}$", "")


def units(text: Column) -> Column:
    """array<struct(form, hash)> of a passage: itself, its paragraphs and its lines."""

    def some(parts: Column, form: int) -> Column:
        long = F.filter(F.transform(parts, normal), lambda x: (F.length(x) - F.length(F.translate(x, " ", ""))) >= LEAST_WORDS - 1)
        return F.transform(F.array_distinct(long), lambda x: F.struct(F.lit(form).alias("form"), F.xxhash64(x).alias("hash")))

    whole = F.filter(F.array(normal(text)), lambda x: x != "")
    whole = F.transform(whole, lambda x: F.struct(F.lit(WHOLE).alias("form"), F.xxhash64(x).alias("hash")))
    return F.concat(whole, some(F.split(text, r"\n[\x20\x09\r]*\n"), PARAGRAPH), some(F.split(text, "\n"), LINE))


def own_text(lines: Column) -> Column:
    return F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["line"]), "\n")


def passages(lines: Column) -> Column:
    """array<struct(level, at, text)>: the runs of one quote level, by their first line; linear in the lines."""
    first = F.filter(
        F.transform(lines, lambda x, i: F.struct(x["level"].alias("level"), i.alias("at"), ((x["level"] > 0) & (F.coalesce(F.get(lines, i - 1)["level"], F.lit(0)) != x["level"])).alias("starts"))),
        lambda x: x["starts"],
    )
    last = F.transform(
        F.filter(
            F.transform(lines, lambda x, i: F.struct(i.alias("at"), ((x["level"] > 0) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) != x["level"])).alias("ends"))),
            lambda x: x["ends"],
        ),
        lambda x: x["at"],
    )
    text = lambda s, e: F.array_join(F.transform(F.slice(lines, s["at"] + 1, e - s["at"] + 1), lambda x: x["line"]), "\n")
    return F.zip_with(first, last, lambda s, e: F.struct(s["level"].alias("level"), s["at"].alias("at"), text(s, e).alias("text")))


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, tkey, to_conv, to_turn): the message that each quoting message replies to."""
    keyed = messages.filter("conv_id is not null and turn is not null").select("conv_id", "turn", text_key(F.col("text")).alias("tkey"), "text")
    quoting = keyed.filter(F.col("text").rlike("(?m)" + MARKS))
    quotes = quoting.select("conv_id", "turn", "tkey", F.explode(let(parsed(F.col("text")), passages)).alias("p"))
    quotes = quotes.select("conv_id", "turn", "tkey", F.col("p.level").alias("level"), F.col("p.at").alias("at"), F.inline(let(F.col("p.text"), units)))
    quotes = written(quotes.groupBy("conv_id", "turn", "tkey", "hash").agg(F.min(F.struct("level", "form", "at")).alias("rank")), "quotes")
    wanted = written(quotes.select("hash").distinct(), "wanted")
    originals = keyed.select("conv_id", "turn", F.inline(let(let(parsed(F.col("text")), own_text), units))).join(wanted, "hash", "left_semi")
    near = originals.groupBy("hash", "conv_id").agg(F.min("turn").alias("near_turn"))
    near = written(near, "near")
    far = written(near.groupBy("hash").agg(F.min("conv_id").alias("to_conv"), F.min_by("near_turn", "conv_id").alias("to_turn")), "far")
    here = quotes.join(near, ["hash", "conv_id"], "left").withColumn("near_turn", F.when(F.col("near_turn") < F.col("turn"), F.col("near_turn")))
    found = here.join(far, "hash", "left")
    earlier = F.col("to_conv") < F.col("conv_id")
    found = found.select(
        "conv_id", "turn", "tkey", "rank",
        F.when(F.col("near_turn").isNotNull(), F.col("conv_id")).when(earlier, F.col("to_conv")).alias("to_conv"),
        F.when(F.col("near_turn").isNotNull(), F.col("near_turn")).when(earlier, F.col("to_turn")).alias("to_turn"),
    ).filter("to_turn is not null")
    best = F.min(F.struct("rank", "to_conv", "to_turn")).alias("b")
    return found.groupBy("conv_id", "turn", "tkey").agg(best).select("conv_id", "turn", "tkey", "b.to_conv", "b.to_turn")


def threads(replies: DataFrame) -> DataFrame:
    """(conv_id, thread_id) of the conversations that quotes join: each round a conversation
    takes the least name next to it and then its name's name, so chains halve."""
    ties = replies.filter("conv_id <> to_conv").select(F.col("conv_id").alias("a"), F.col("to_conv").alias("b"))
    both = written(ties.union(ties.select("b", "a")).distinct(), "ties")
    if both.isEmpty():
        return both.select(F.col("a").alias("conv_id"), F.col("b").alias("thread_id"))
    names = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("name")).withColumnRenamed("a", "conv_id"), "names")
    while True:
        near = both.join(names.withColumnRenamed("conv_id", "b"), "b").groupBy("a").agg(F.min("name").alias("near"))
        hooked = written(names.join(near.withColumnRenamed("a", "conv_id"), "conv_id").select("conv_id", "name", F.least("name", "near").alias("next")), "hooked")
        jump = hooked.select(F.col("conv_id").alias("next"), F.col("next").alias("far"))
        after = written(hooked.join(jump, "next").select("conv_id", "name", F.least("next", "far").alias("next")), "names")
        if after.filter("name <> next").isEmpty():
            return after.select("conv_id", F.col("next").alias("thread_id"))
        names = after.select("conv_id", F.col("next").alias("name"))


def formatted(messages: DataFrame) -> DataFrame:
    """(thread_id, conv_id, turn, role, text, to_conv, to_turn, n_quotes), in reply order: text
    without quotes, to_* the message replied to, n_quotes the quoted passages."""
    replies = written(links(messages), "replies")
    named = threads(replies).withColumnRenamed("conv_id", "_tc")
    replies = replies.withColumnsRenamed({"conv_id": "_c", "turn": "_n", "tkey": "_t"})
    keyed = messages.select("conv_id", "turn", "role", "text", text_key(F.col("text")).alias("tkey"))
    quoted = F.col("text").rlike("(?m)" + MARKS)
    shape = F.when(quoted, let(parsed(F.col("text")), lambda x: F.struct(trimmed(own_text(x)).alias("text"), F.size(passages(x)).alias("n"))))
    keyed = keyed.withColumn("_s", shape.otherwise(F.struct(F.col("text").alias("text"), F.lit(0).alias("n"))))
    out = keyed.join(replies, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_n")) & (F.col("tkey") == F.col("_t")), "left")
    out = out.join(named, F.col("conv_id") == F.col("_tc"), "left")
    out = out.select(F.coalesce("thread_id", "conv_id").alias("thread_id"), "conv_id", "turn", "role", F.col("_s.text").alias("text"), "to_conv", "to_turn", F.col("_s.n").cast("long").alias("n_quotes"))
    return out.repartitionByRange("thread_id", "conv_id", "turn", "text").sortWithinPartitions("thread_id", "conv_id", "turn", "text")


def quoting(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) with, before its own text, each message's quote of the
    turn before, announced, and of the turn before that at the second level, where these have words.

    A turn is joined to the turns before it by (conv_id, turn), each aggregated to one text first:
    a conversation of very many turns is never gathered.
    """
    keyed = messages.select("conv_id", "turn", "role", "text")
    one = written(keyed.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).groupBy("conv_id", "turn").agg(F.min("text").alias("said")), "said")
    before = lambda k: one.select(F.col("conv_id").alias(f"c{k}"), (F.col("turn") + k).alias(f"t{k}"), F.col("said").alias(f"q{k}"))
    out = keyed
    for k in (1, 2):
        out = out.join(before(k), (F.col("conv_id") == F.col(f"c{k}")) & (F.col("turn") == F.col(f"t{k}")), "left")
    marked = lambda c, m: F.concat(F.array_join(F.transform(F.split(c, "\n"), lambda x: F.concat(F.lit(m), x)), "\n"), F.lit("\n"))
    head = F.concat(F.when(F.coalesce("q2", "q1").isNotNull(), F.lit("The other wrote:\n")).otherwise(""), F.coalesce(marked("q2", ">> "), F.lit("")), F.coalesce(marked("q1", "> "), F.lit("")))
    return out.select("conv_id", "turn", "role", F.concat(head, F.col("text")).alias("text"))


def markup(role: Column, text: Column) -> Column:
    """A message in chat markup; what looks like a mark in its text is escaped."""
    own = F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<\\|"))
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("user")), F.lit("|>\n"), own, F.lit("\n<|end|>\n"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each message, in reply order, with its chat markup. The table's conversations
    hold no quotes, so all are made into replies that quote first."""
    out = formatted(written(quoting(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "quoting"))
    return out.withColumn("markup", markup(F.col("role"), F.col("text")))


#: Without quotes and hashes: a message replies to the earliest turn of its conversation that
#: holds the quoted text whole, as a paragraph or as a line.
ORACLE = r"""
WITH m AS (SELECT conv_id, turn, role, text, regexp_matches(coalesce(text, ''), '[^\x20\x09-\x0D]') AS has FROM conversations),
one AS (SELECT conv_id, turn, min(text) AS text FROM m WHERE has GROUP BY conv_id, turn),
u0 AS (SELECT conv_id, turn, 0 AS form, text AS part FROM one
  UNION ALL SELECT conv_id, turn, 1, unnest(regexp_split_to_array(text, '\n[\x20\x09\r]*\n')) FROM one
  UNION ALL SELECT conv_id, turn, 2, unnest(string_split(text, chr(10))) FROM one),
u AS (SELECT conv_id, turn, form, lower(trim(regexp_replace(part, '[\x20\x09-\x0D]+', ' ', 'g'))) AS unit FROM u0),
v AS (SELECT conv_id, unit, min(turn) AS turn FROM u WHERE form = 0 OR length(unit) - length(replace(unit, ' ', '')) >= 2 GROUP BY conv_id, unit),
w AS (SELECT u.conv_id, u.turn, v.turn AS origin FROM u JOIN v ON v.conv_id = u.conv_id AND v.unit = u.unit WHERE form = 0)
SELECT m.conv_id AS thread_id, m.conv_id, m.turn, role,
  CASE WHEN a.conv_id IS NULL AND b.conv_id IS NULL THEN text ELSE regexp_replace(text, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') END AS text,
  CASE WHEN coalesce(a.origin, b.origin) IS NOT NULL AND text IS NOT NULL THEN m.conv_id END AS to_conv,
  CASE WHEN text IS NOT NULL THEN coalesce(a.origin, b.origin) END AS to_turn,
  CASE WHEN text IS NULL THEN 0 ELSE (a.conv_id IS NOT NULL)::BIGINT + (b.conv_id IS NOT NULL)::BIGINT END::BIGINT AS n_quotes,
  '<|' || coalesce(role, 'user') || '|>' || chr(10) || replace(coalesce(CASE WHEN a.conv_id IS NULL AND b.conv_id IS NULL THEN text ELSE regexp_replace(text, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') END, ''), '<|', '<\|') || chr(10) || '<|end|>' || chr(10) AS markup
FROM m LEFT JOIN w a ON a.conv_id = m.conv_id AND a.turn = m.turn - 1 LEFT JOIN w b ON b.conv_id = m.conv_id AND b.turn = m.turn - 2
"""
