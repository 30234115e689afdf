"""Quotation linking in conversations (DataFrame operations only).

A line quotes when it starts with '>' marks; their number is its level. A run of lines of one level is a passage. Passages and their
lines are hashed after normalising (marks off, lower case, white space as one space), and so are the unquoted text of every message,
its paragraphs and its lines. A passage links to the latest earlier message of its conversation that holds its text, failing that to
the first message of another conversation that does. A passage whose text stands nowhere links to the message that holds most of its lines,
if over half: in its conversation before others, then by the lines held, then the latest (in others: the first). A message replies to what its first linked
passage of level 1 comes from (of any level where no level-1 passage links). Replies chain by pointer doubling.

Equal hashes meet as aggregates: within a conversation by a running maximum over (conversation, hash), across conversations through
one row per hash, so a text that starts a third of all conversations costs one row each. Lines held by many messages are counted
by sets of such lines, so a greeting brings no message together with every passage.

Cases: a null text counts as empty; messages with a null conv_id or turn are kept and never linked within a conversation; repeated rows get equal
answers; a text that is only quotes has an empty body; marks without text after them link with nothing; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import attach, semi_by_key, written

MARK = r"^[ \t]*>"
MARKS = r"^[ \t]*(?:>[ \t]*)+"
#: Messages up to which a line that they hold brings each of them together with a passage; beyond it, it is a common line.
HOT_LINE = 64
WROTE = r"(?i)^\s*(on\b.*|.*\b)wrote:\s*$"


def _norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, MARKS, "")), r"\s+", " "))


def _body(lines: Column) -> Column:
    """The unquoted lines, without the attribution line right above a quotation."""
    quoted = lambda x: x.rlike(MARK)
    own = F.filter(lines, lambda x, i: ~quoted(x) & ~(x.rlike(WROTE) & F.coalesce(quoted(F.get(lines, i + 1)), F.lit(False))))
    return F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "")


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, msg, passage, level, hash, lines (hashes): the quoted passages of messages(conv_id, turn, msg, lines)."""
    quoting = messages.where(F.exists("lines", lambda x: x.rlike(MARK))).dropDuplicates(["conv_id", "turn", "msg"])
    cut = quoting.select("conv_id", "turn", "msg", F.posexplode("lines").alias("at", "line"))
    cut = cut.withColumn("level", F.when(F.col("line").rlike(MARK), F.regexp_count(F.regexp_extract("line", MARKS, 0), F.lit(">"))).otherwise(0))
    order = Window.partitionBy("conv_id", "turn", "msg").orderBy("at")
    cut = cut.withColumn("new", (F.col("level") != F.coalesce(F.lag("level").over(order), F.lit(0))).cast("int")).withColumn("passage", F.sum("new").over(order))
    cut = cut.where("level > 0").withColumn("norm", _norm(F.col("line")))
    got = cut.groupBy("conv_id", "turn", "msg", "passage", "level").agg(F.sort_array(F.collect_list(F.struct("at", "norm"))).alias("own"))
    text = F.trim(F.regexp_replace(F.array_join(F.transform("own", lambda x: x["norm"]), " "), r"\s+", " "))
    got = got.withColumn("text", text).where("text <> ''")
    return got.select("conv_id", "turn", "msg", "passage", "level", F.xxhash64("text").alias("hash"), F.transform(F.filter("own", lambda x: x["norm"] != ""), lambda x: F.xxhash64(x["norm"])).alias("lines"))


def _places(looked: DataFrame, held: DataFrame) -> DataFrame:
    """looked(pid, conv_id, turn, key, ...) with near, the latest earlier turn of its conversation among held(conv_id, turn, key), and far, the
    first (conv_id, turn) of all other conversations. Each key has one row for its first message and the first one of a second conversation."""
    per = written(held.groupBy("key", "conv_id").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n")), "quote-firsts")
    first = per.groupBy("key").agg(F.min(F.struct("conv_id", F.col("first_turn").alias("turn"))).alias("first"), F.sum("n").alias("held_by"), F.count("*").alias("convs"))
    first = written(first, "quote-firsts")
    others = attach(per.select("key", "conv_id", "first_turn"), first.where("convs > 1").select("key", "first", "held_by"), ["key"], "held_by")
    second = others.where(F.col("conv_id") != F.col("first.conv_id")).groupBy("key").agg(F.min(F.struct("conv_id", F.col("first_turn").alias("turn"))).alias("second"))
    asked = looked.groupBy("key").agg(F.count("*").alias("asked_by"))
    firsts = written(first.join(second, "key", "left").join(asked, "key").select("key", "first", "second", "asked_by"), "quote-firsts")
    both = looked.withColumn("source", F.lit(None).cast("long")).unionByName(held.select("conv_id", "turn", "key", F.col("turn").alias("source")), allowMissingColumns=True)
    earlier = Window.partitionBy("conv_id", "key").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max("source").over(earlier)).where("pid is not null").drop("source")
    placed = attach(near, firsts, ["key"], "asked_by")
    near_ = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.col("near"))
    far = F.when(F.col("first.conv_id").eqNullSafe(F.col("conv_id")), F.col("second")).otherwise(F.col("first"))
    return placed.withColumn("near", near_).withColumn("far", far).drop("first", "second", "asked_by", "key")


def _most_lines(rest: DataFrame, held: DataFrame) -> DataFrame:
    """pid, from_conv, from_turn: where most lines of the passages rest(pid, conv_id, turn, lines) stand, by held(conv_id, turn, msg, hash).

    Every message that holds over half of a passage's lines is counted. Those that hold a rare line of it (in HOT_LINE messages at most) are met by
    that line, and the common lines of both are added from their lists. The others hold common lines only: messages with the same set of
    common lines are one signature, passages with the same common lines one class, and a signature's nearest and first message stand for all."""
    rest = rest.withColumn("n", F.size("lines"))
    lines = rest.select("pid", "conv_id", "turn", "n", F.explode("lines").alias("hash")).groupBy("pid", "conv_id", "turn", "n", "hash").agg(F.count("*").alias("weight"))
    lines = written(lines, "quote-lines")
    held = written(semi_by_key(held, lines.select("hash").distinct(), "hash"), "quote-held")
    spread = held.groupBy("hash").agg(F.count("*").alias("held_by"))
    quoted = lines.groupBy("hash").agg(F.count("*").alias("quoted_by"))
    spread = written(spread.join(quoted, "hash"), "quote-spread")
    lines = written(attach(lines, spread.select("hash", "held_by", "quoted_by"), ["hash"], "quoted_by").where("held_by is not null").drop("quoted_by"), "quote-lines")
    held = written(attach(held, spread.select("hash", F.col("held_by").alias("n_held")), ["hash"], "n_held"), "quote-held")
    message = ["from_conv", "from_turn", "from_msg"]
    held = held.select(F.col("conv_id").alias("from_conv"), F.col("turn").alias("from_turn"), F.col("msg").alias("from_msg"), "hash", "n_held")
    common = written(held.where(F.col("n_held") > HOT_LINE).groupBy(*message).agg(F.sort_array(F.collect_set("hash")).alias("set")), "quote-common")
    asked = lines.where(F.col("held_by") > HOT_LINE).groupBy("pid", "conv_id", "turn", "n").agg(F.sort_array(F.collect_list(F.struct("hash", "weight"))).alias("asked"))
    asked = written(asked, "quote-asked")
    # messages met by a rare line
    met = lines.where(F.col("held_by") <= HOT_LINE).join(held.where(F.col("n_held") <= HOT_LINE), "hash")
    own = F.col("from_conv").eqNullSafe(F.col("conv_id"))
    met = met.where(~own | (F.col("from_turn") < F.col("turn"))).groupBy("pid", "conv_id", "n", *message).agg(F.sum("weight").alias("votes"))
    met = met.join(common, message, "left").join(asked.select("pid", "asked"), "pid", "left")
    more = F.aggregate(F.filter("asked", lambda x: F.array_contains("set", x["hash"])), F.lit(0).cast("long"), lambda a, x: a + x["weight"])
    met = met.withColumn("votes", F.col("votes") + F.coalesce(more, F.lit(0).cast("long"))).where("2 * votes > n").select("pid", "conv_id", "from_conv", "from_turn", "votes")
    # messages of common lines only
    asked = asked.where(2 * F.aggregate("asked", F.lit(0).cast("long"), lambda a, x: a + x["weight"]) > F.col("n")).withColumn("class", F.xxhash64("asked", "n"))
    signed = written(common.select(F.col("from_conv").alias("conv_id"), F.col("from_turn").alias("turn"), F.xxhash64("set").alias("key"), "set"), "quote-signed")
    sets = signed.groupBy("key").agg(F.first("set").alias("set")).select("key", F.explode("set").alias("hash"))
    classes = asked.groupBy("class", "n").agg(F.first("asked").alias("asked")).select("class", "n", F.explode("asked").alias("x")).select("class", "n", F.col("x.hash").alias("hash"), F.col("x.weight").alias("weight"))
    good = written(classes.join(sets, "hash").groupBy("class", "n", "key").agg(F.sum("weight").alias("votes")).where("2 * votes > n").select("class", "key", "votes"), "quote-classes")
    placed = written(_places(written(asked.select("pid", "conv_id", "turn", "class").join(good, "class").drop("class"), "quote-lookups"), signed.select("conv_id", "turn", "key")), "quote-placed")
    near = placed.where("near is not null").select("pid", "conv_id", F.col("conv_id").alias("from_conv"), F.col("near").alias("from_turn"), "votes")
    far = placed.where("far is not null").select("pid", "conv_id", F.col("far.conv_id").alias("from_conv"), F.col("far.turn").alias("from_turn"), "votes")
    late = F.when(own, F.col("from_turn")).otherwise(-F.col("from_turn"))
    best = F.max(F.struct(own.alias("own"), "votes", (-F.col("from_conv")).alias("conv"), late.alias("late"), "from_conv", "from_turn")).alias("b")
    return met.unionByName(near).unionByName(far).groupBy("pid").agg(best).select("pid", "b.from_conv", "b.from_turn")


def link(found: DataFrame, bodies: DataFrame) -> DataFrame:
    """passages with from_conv, from_turn and exact (its whole text, not most of its lines, stands there)."""
    pid = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("conv_id", "turn", "msg", "passage")])
    found = written(found.withColumn("pid", pid), "quote-found")
    units = F.array_distinct(F.concat(F.array(F.col("body")), F.split("body", r"\n[ \t]*\n"), F.split("body", "\n")))
    units = F.array_distinct(F.filter(F.transform(units, _norm), lambda x: x != ""))
    held = bodies.where("conv_id is not null and turn is not null").select("conv_id", "turn", "msg", F.explode(units).alias("unit")).select("conv_id", "turn", "msg", F.xxhash64("unit").alias("hash"))
    asked = found.select(F.explode(F.concat(F.array("hash"), F.col("lines"))).alias("hash")).distinct()
    held = written(semi_by_key(held, asked, "hash").distinct(), "quote-units")
    wholes = found.select("pid", "conv_id", "turn", F.col("hash").alias("key"))
    exact = _places(wholes, held.select("conv_id", "turn", F.col("hash").alias("key")))
    there = F.when(F.col("near").isNotNull(), F.struct(F.col("conv_id"), F.col("near").alias("turn"))).otherwise(F.col("far"))
    exact = written(exact.withColumn("there", there).where("there is not null").select("pid", F.col("there.conv_id").alias("from_conv"), F.col("there.turn").alias("from_turn"), F.lit(True).alias("exact")), "quote-exact")
    rest = written(found.where(F.size("lines") > 1).join(exact, "pid", "left_anti").select("pid", "conv_id", "turn", "lines"), "quote-rest")
    if rest.limit(1).count():
        exact = exact.unionByName(_most_lines(rest, held).withColumn("exact", F.lit(False)))
    return found.join(exact, "pid", "left").select("conv_id", "turn", "msg", "passage", "level", "from_conv", "from_turn", "exact")


def threads(replies: DataFrame) -> DataFrame:
    """conv_id, turn, thread, depth of messages that reply within their conversation: replies(conv_id, turn, parent)."""
    state = written(replies.groupBy("conv_id", "turn").agg(F.min("parent").alias("thread")).withColumn("depth", F.lit(1).cast("long")), "quote-threads")
    while state.alias("s").join(state.select("conv_id", F.col("turn").alias("thread")), ["conv_id", "thread"], "left_semi").limit(1).count():
        up = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        state = written(state.join(up, ["conv_id", "thread"], "left").select("conv_id", "turn", F.coalesce("next", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "quote-threads")
    return state


def reply_order(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, turn, role, body, n_quoted, n_linked, reply_conv, reply_turn, thread, depth.

    A row per message; in order of (conv_id, thread, depth, turn) each conversation reads as threads with their replies."""
    lines = F.split(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), "\r\n?", "\n"), "\n")
    messages = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), lines.alias("lines"))
    messages = messages.select("*", F.xxhash64("lines").alias("msg"))
    bodies = messages.select("conv_id", "turn", "role", "msg", _body(F.col("lines")).alias("body"))
    found = written(passages(messages), "quote-passages")
    linked = written(link(found, bodies), "quote-links")
    one = F.min(F.when(F.col("from_turn").isNotNull(), F.struct((F.col("level") > 1).alias("deep"), "passage", "from_conv", "from_turn"))).alias("r")
    per = linked.groupBy("conv_id", "turn", "msg").agg(F.count("*").alias("n_quoted"), F.count("from_turn").alias("n_linked"), one)
    per = written(per.select("conv_id", "turn", "msg", "n_quoted", "n_linked", F.col("r.from_conv").alias("reply_conv"), F.col("r.from_turn").alias("reply_turn"), F.lit(1).alias("rows_")), "quote-replies")
    deep = threads(per.where("reply_conv = conv_id and reply_turn < turn").select("conv_id", "turn", F.col("reply_turn").alias("parent")))
    mid = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("conv_id", "turn", "msg")])  # nulls match too
    full = attach(bodies.withColumn("mid", mid), per.withColumn("mid", mid).drop("conv_id", "turn", "msg"), ["mid"], "rows_").drop("rows_", "mid")
    full = attach(full, deep.withColumn("rows_", F.lit(1)), ["conv_id", "turn"], "rows_")
    return full.select("conv_id", "turn", "role", "body", F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_conv", "reply_turn", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"))
