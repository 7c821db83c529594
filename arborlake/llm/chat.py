"""Chat formatting by quotation linking (operator 10), in DataFrame operations only.

A line's quote level is the number of ``>`` before its text. A passage is a
run of lines of one level; passages, and lines of ``LINE_WORDS`` words or
more for quotes of a part, are normalised, hashed and joined to the latest
earlier message of the conversation that says the same one level further out.
The message that most quoted passages (then lines) come from is the one
replied to; without a link it is the turn before. Replies make trees: each
message gets its thread's root, its depth and its position when a thread is
read reply by reply (a message, then each answer with all its own answers).
``assemble`` puts threads together without quotes.

Where only neighbours in an order matter (the last message that says a line,
the next answer), turns are looked at in strides of ``STRIDE``, so that no
task takes a whole conversation. Trees that branch are walked by doubling
pointers; plain runs of turns need no walk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.llm.graph import cut_lineage

_PREFIX = "^[ \\t]*((?:>[ \\t]*)*)"
#: A line that only says whose words follow. (Fixed values.)
_ATTRIBUTION = "(?i)^\\s*(on\\s.*\\swrote|.*\\swrote|am\\s.*\\sschrieb.*|le\\s.*\\sa écrit|el\\s.*\\sescribió)\\s*:\\s*$"
LINE_WORDS = 3
STRIDE = 1024
#: Messages of a thread that ``assemble`` puts into one row.
PART = 1000


def level_of(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _PREFIX, 1), "[^>]", ""))


def words_of(line: Column) -> Column:
    """A line without its quote marks, lower-cased, its white space folded."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, _PREFIX, "")), "[ \\t\\r\\f\\x0B]+", " "))


def unquoted(text: Column) -> Column:
    """The lines of level 0 less attributions of quotes, trimmed of blank lines at the ends."""
    lines = F.split(text, "\n")
    quoted = lambda i: F.coalesce(F.get(lines, i + 1).rlike("^[ \\t]*>"), F.lit(False))
    kept = F.filter(lines, lambda x, i: (level_of(x) == 0) & ~(x.rlike(_ATTRIBUTION) & quoted(i)))
    plain = F.when(F.contains(text, F.lit(">")), F.array_join(kept, "\n")).otherwise(text)
    return F.regexp_replace(plain, "^\\s+|\\s+$", "")


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, kind (0 passage, 1 line), hash: what each message says and quotes, once."""
    x = messages.select("conv_id", "turn", F.split("text", "\n").alias("lines"))
    x = x.select("conv_id", "turn", F.transform("lines", level_of).alias("levels"), F.transform("lines", words_of).alias("said"))
    count = F.size("said")
    x = x.withColumn("starts", F.filter(F.sequence(F.lit(0), count - 1), lambda i: (i == 0) | (F.get("levels", i) != F.get("levels", i - 1))))
    run = lambda s, k: F.filter(F.slice("said", s + 1, F.coalesce(F.get("starts", k + 1), count) - s), lambda t: t != "")
    unit = lambda level, kind, said: F.struct(level.alias("level"), F.lit(kind).alias("kind"), said.alias("said"))
    whole = F.transform("starts", lambda s, k: unit(F.get("levels", s), 0, F.array_join(run(s, k), " ")))
    lines = F.transform("said", lambda t, i: unit(F.get("levels", i), 1, t))
    long = F.filter(lines, lambda u: F.size(F.split(u["said"], " ")) >= LINE_WORDS)
    return x.select("conv_id", "turn", F.explode(F.concat(whole, long)).alias("u")).filter("u.said <> ''").select("conv_id", "turn", "u.level", "u.kind", F.md5("u.said").alias("hash")).distinct()


def _stride(turn: str = "turn") -> Column:
    return F.floor(F.col(turn) / STRIDE).cast("long")


def links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, source, n_linked: for each message with linked quotes, the turn most of them come from (ties to the latest)."""
    quoting = messages.filter(F.col("text").rlike("(?m)^[ \\t]*>")).select("conv_id").distinct()
    units = cut_lineage(passages(messages.join(quoting, "conv_id", "left_semi")))  # conversations without quotes need no pass
    key = ["conv_id", "level", "kind", "hash"]
    said = units.select("conv_id", (F.col("level") + 1).alias("level"), "kind", "hash", "turn", _stride().alias("s"))
    asked = units.filter("level > 0").select(*key, "turn", _stride().alias("s"))
    both = said.withColumn("source", F.lit(1)).union(asked.withColumn("source", F.lit(0)))
    near = Window.partitionBy(*key, "s").orderBy("turn", "source").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("near", F.last(F.when(F.col("source") == 1, F.col("turn")), ignorenulls=True).over(near)).filter("source = 0")
    # the last turn that says it in the strides before
    per = said.groupBy(*key, "s").agg(F.max("turn").alias("top")).withColumn("source", F.lit(1)).union(asked.select(*key, "s", F.lit(None).cast("long").alias("top"), F.lit(0).alias("source")).distinct())
    before = Window.partitionBy(*key).orderBy("s").rangeBetween(Window.unboundedPreceding, -1)
    far = per.withColumn("far", F.max("top").over(before)).filter("source = 0 and far is not null").select(*key, "s", "far")
    met = both.join(far, [*key, "s"], "left").withColumn("from", F.coalesce(F.when(F.col("near") < F.col("turn"), F.col("near")), "far")).filter("from is not null")
    met = met.groupBy("conv_id", "turn", "from").agg(F.count_if(F.col("kind") == 0).alias("p"), F.count_if(F.col("kind") == 1).alias("l"))
    best = met.groupBy("conv_id", "turn").agg(F.max(F.struct("p", "l", "from")).alias("best"))
    return best.select("conv_id", "turn", F.col("best.from").alias("source"), (F.col("best.p") + F.col("best.l")).alias("n_linked"))


def _chase(t: DataFrame) -> DataFrame:
    """conv_id, turn, at, dist: the end of each pointer path and its length, from (conv_id, turn, at, dist) of single steps; an end points to itself.

    Paths that have reached their end leave the loop, so a root that many
    messages lead to is joined once for each of them.
    """
    t = cut_lineage(t)
    done, step = t.filter("at = turn"), t.filter("at <> turn")
    while not step.isEmpty():
        known = done.select("conv_id", F.col("turn").alias("at"), F.col("at").alias("far"), F.col("dist").alias("more"), F.lit(True).alias("ended"))
        known = known.union(step.select("conv_id", "turn", "at", "dist", F.lit(False)))
        step = cut_lineage(step.join(known, ["conv_id", "at"]).select("conv_id", "turn", F.col("far").alias("at"), (F.col("dist") + F.col("more")).alias("dist"), "ended"))
        done, step = done.union(step.filter("ended").drop("ended")), step.filter("not ended").drop("ended")
    return cut_lineage(done)


def _next_answer(nodes: DataFrame) -> DataFrame:
    """conv_id, turn, sibling: the next turn that answers the same message."""
    kids = nodes.filter("reply_to is not null").select("conv_id", "reply_to", "turn", _stride().alias("s"))
    near = F.lead("turn").over(Window.partitionBy("conv_id", "reply_to", "s").orderBy("turn"))
    far = kids.groupBy("conv_id", "reply_to", "s").agg(F.min("turn").alias("low"))
    far = far.withColumn("far", F.lead("low").over(Window.partitionBy("conv_id", "reply_to").orderBy("s"))).drop("low")
    return kids.withColumn("near", near).join(far, ["conv_id", "reply_to", "s"]).select("conv_id", "turn", F.coalesce("near", "far").alias("sibling"))


def threads(nodes: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, thread (its root's turn), depth, position, from (conv_id, turn, reply_to) of distinct turns."""
    end = F.col("reply_to").isNull()
    near = F.count_if(F.col("reply_to") == F.col("turn") - 1)
    runs = nodes.groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("z"), F.count("*").alias("n"), near.alias("k"))
    plain = runs.select("conv_id", "a", ((F.col("z") - F.col("a") + 1 == F.col("n")) & (F.col("k") == F.col("n") - 1)).alias("plain"))
    nodes = cut_lineage(nodes.join(plain, "conv_id"))
    run = F.col("turn") - F.col("a")
    easy = nodes.filter("plain").select("conv_id", "turn", "reply_to", F.col("a").alias("thread"), run.alias("depth"), run.alias("position"))
    rest = nodes.filter("not plain").select("conv_id", "turn", "reply_to")
    if rest.isEmpty():
        return easy
    roots = _chase(rest.select("conv_id", "turn", F.coalesce("reply_to", "turn").alias("at"), F.when(end, 0).otherwise(1).cast("long").alias("dist")))
    x = rest.join(_next_answer(rest), ["conv_id", "turn"], "left")
    first = rest.filter("reply_to is not null").groupBy("conv_id", F.col("reply_to").alias("turn")).agg(F.min("turn").alias("child"))
    x = cut_lineage(x.join(first, ["conv_id", "turn"], "left"))
    # up to the nearest message, itself included, that another answer to the same one follows
    up = _chase(x.select("conv_id", "turn", F.when(F.col("sibling").isNotNull() | end, F.col("turn")).otherwise(F.col("reply_to")).alias("at"), F.when(F.col("sibling").isNotNull() | end, 0).otherwise(1).cast("long").alias("dist")))
    up = up.select("conv_id", "turn", "at").join(x.select("conv_id", F.col("turn").alias("at"), F.col("sibling").alias("after")), ["conv_id", "at"]).select("conv_id", "turn", "after")
    follow = x.join(up, ["conv_id", "turn"]).select("conv_id", "turn", F.coalesce("child", "after").alias("to"))
    left = _chase(follow.select("conv_id", "turn", F.coalesce("to", "turn").alias("at"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("dist")))
    left = left.select("conv_id", "turn", F.col("dist").alias("left"))
    y = rest.join(roots.select("conv_id", "turn", F.col("at").alias("thread"), F.col("dist").alias("depth")), ["conv_id", "turn"]).join(left, ["conv_id", "turn"])
    whole = left.withColumnsRenamed({"turn": "thread", "left": "all"})
    y = y.join(whole, ["conv_id", "thread"]).select("conv_id", "turn", "reply_to", "thread", "depth", (F.col("all") - F.col("left")).alias("position"))
    return easy.union(y)


def format_chat(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to, n_linked, thread, depth, position, content, formatted: one row per message.

    Null texts are empty, null roles ``unknown``. ``reply_to`` is null for a
    message without a linked quote or a turn right before it; it then begins a
    thread, as does a message whose conversation or turn is null. Of sources
    that are quoted alike the latest counts; messages of one turn share its
    place; texts of any length are read whole. Repeated rows give repeated
    rows; an empty table gives no rows; other columns are ignored.
    """
    m = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = m.filter("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("prior"))
    nodes = turns.join(links(m.filter("conv_id is not null and turn is not null")), ["conv_id", "turn"], "left").join(before, ["conv_id", "turn"], "left")
    nodes = cut_lineage(nodes.select("conv_id", "turn", F.coalesce("source", "prior").alias("reply_to"), F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked")))
    place = threads(nodes.drop("n_linked")).join(nodes.select("conv_id", "turn", "n_linked"), ["conv_id", "turn"])
    out = m.join(place, ["conv_id", "turn"], "left").withColumn("content", unquoted(F.col("text")))
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id", "turn", "role", "reply_to", F.coalesce("n_linked", zero).alias("n_linked"), F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", zero).alias("depth"), F.coalesce("position", zero).alias("position"), "content",
        F.concat(F.lit("<|"), "role", F.lit("|>\n"), "content", F.lit("\n<|end|>")).alias("formatted"),
    )


def assemble(chat: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, thread, part, text, n_messages: threads in reply order without quotes, ``part`` positions a row; repeated rows count once."""
    rows = chat.select("conv_id", "thread", F.floor(F.col("position") / part).cast("long").alias("part"), "position", "turn", "role", "formatted").distinct()
    got = rows.groupBy("conv_id", "thread", "part").agg(F.array_sort(F.collect_list(F.struct("position", "turn", "role", "formatted"))).alias("m"))
    return got.select("conv_id", "thread", "part", F.array_join("m.formatted", "\n").alias("text"), F.size("m").cast("long").alias("n_messages"))
