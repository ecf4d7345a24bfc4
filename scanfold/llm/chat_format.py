"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A conversation becomes one formatted text: each turn is marked by control strings, and control
strings inside a turn's text are escaped so that they never look like marks. Each assistant turn
then becomes an example of its own: its context is everything before it, and only its reply is
trainable. An example states its context and its reply as byte positions in the formatted text, so
all examples of a conversation together take as much room as the conversation itself;
``example_texts`` cuts the texts out.

Escaping puts one backslash between the first character of a control string and the rest, one more
where there are some already, so it can be undone exactly. Turns are ordered by turn, then role and
text; turns that repeat stay. A null text is empty, a null role is the role ``""``. Rows whose
conversation is null are one conversation. One without an assistant turn has no example. An
empty table gives an empty result. Only the four named columns are read. A conversation is one
row, as a training example is, and so is bounded by the 2 GB of a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanfold.llm.common import text_of

BEGIN = "<s>"
#: The template: what stands before and after the text of a turn, by role; any other role's name stands in its mark.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("[REPLY] ", "</s>"), "system": ("[SYS] ", " [/SYS]")}
OTHER = ("[ROLE ", "] ", " [/ROLE]")
#: What could be read as a mark, without its first character.
_REST = r"/?(?:s>|INST\]|REPLY\]|SYS\]|ROLE[ \]])"
_ESCAPE = rf"([<\[])(\\*{_REST})"
_UNESCAPE = rf"([<\[])\\(\\*{_REST})"
#: One turn of a formatted text.
_TURN = r"(?s)\[INST\] .*? \[/INST\]|\[REPLY\] .*?</s>|\[SYS\] .*? \[/SYS\]|\[ROLE [^\]]*\] .*? \[/ROLE\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPE), F.lit(r"$1\\$2"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_UNESCAPE), F.lit("$1$2"))


def _by_role(role: Column, of_mark, other: Column) -> Column:
    found = F.when(role == "user", of_mark("user"))
    for name in ("assistant", "system"):
        found = found.when(role == name, of_mark(name))
    return found.otherwise(other)


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted (UTF-8 bytes), examples: an array of
    (context_end, reply_start, reply_end), one for each assistant turn."""
    role, text = text_of("role"), text_of("text")
    # The two signs that a role's name may not have in its mark are written as in urls.
    name = escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("]"), F.lit("%5D")))
    rows = turns.select(
        "conv_id", F.col("turn").alias("turn"), role.alias("role"), text.alias("text"),
        _by_role(role, lambda r: F.lit(MARKS[r][0]), F.concat(F.lit(OTHER[0]), name, F.lit(OTHER[1]))).alias("before"),
        escape(text).alias("own"), _by_role(role, lambda r: F.lit(MARKS[r][1]), F.lit(OTHER[2])).alias("after"))
    size = F.octet_length("before") + F.octet_length("own") + F.octet_length("after")
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum(size).over(order), F.lit(0)) + len(BEGIN))
    first = F.col("at") + F.octet_length("before")
    turn = F.struct("at", F.concat("before", "own", "after").alias("piece"), (F.col("role") == "assistant").alias("reply"),
                    first.alias("first"), (first + F.octet_length("own")).alias("last"))
    whole = placed.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(turn)).alias("turns"))
    return whole.select(
        "conv_id", "n_turns",
        F.encode(F.concat(F.lit(BEGIN), F.array_join(F.col("turns.piece"), "")), "UTF-8").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["reply"]), lambda t: F.struct(
            t["at"].alias("context_end"), t["first"].alias("reply_start"), t["last"].alias("reply_end"))).alias("examples"))


def examples(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, example (from 0), context_end, reply_start, reply_end."""
    return formatted.select("conv_id", F.posexplode("examples").alias("example", "e")).select("conv_id", "example", "e.*")


def example_texts(formatted: DataFrame) -> DataFrame:
    """conv_id, example, context, reply: the texts of each example as a trainer reads them. Contexts
    repeat what is before them, so this is for reading examples, not for storing them."""
    cut = F.transform("examples", lambda e: F.struct(
        F.decode(F.substring("formatted", F.lit(1), e["context_end"].cast("int")), "UTF-8").alias("context"),
        _reply(e).alias("reply")))
    return formatted.select("conv_id", F.posexplode(cut).alias("example", "e")).select("conv_id", "example", "e.*")


def _reply(e: Column) -> Column:
    return F.decode(F.substring(F.col("formatted"), (e["reply_start"] + 1).cast("int"), (e["reply_end"] - e["reply_start"]).cast("int")), "UTF-8")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as an array of (role, text), from its marks alone."""

    def turn(piece: Column) -> Column:
        own = [F.when(F.startswith(piece, F.lit(a)), F.struct(F.lit(r).alias("role"), unescape(F.substring(
            piece, F.lit(len(a) + 1), F.length(piece) - len(a) - len(b))).alias("text"))) for r, (a, b) in MARKS.items()]
        name = F.regexp_extract(piece, r"^\[ROLE ([^\]]*)\] ", 1)
        skip = F.length(name) + len(OTHER[0]) + len(OTHER[1])
        role = F.replace(F.replace(unescape(name), F.lit("%5D"), F.lit("]")), F.lit("%25"), F.lit("%"))
        other = F.struct(role.alias("role"), unescape(F.substring(piece, skip + 1, F.length(piece) - skip - len(OTHER[2]))).alias("text"))
        return F.coalesce(*own, other)

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), turn)


def example_replies(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn, as a trainer is given it: conv_id, example, context_end (bytes of
    the formatted text that are its context) and target, the reply with its own marks cut out of the
    text behind the context. Only the reply between the marks is trainable."""
    cut = F.transform("examples", lambda e: F.struct(e["context_end"].alias("context_end"), F.decode(F.substring(
        F.col("formatted"), (e["context_end"] + 1).cast("int"), (e["reply_end"] - e["context_end"]).cast("int") + len(MARKS["assistant"][1])), "UTF-8").alias("target")))
    return formatted.select("conv_id", F.posexplode(cut).alias("example", "e")).select("conv_id", "example", "e.*")


def trainable(target: Column) -> Column:
    """The reply's own text of a target: what stands between an assistant's marks, unescaped."""
    before, after = MARKS["assistant"]
    whole = F.startswith(target, F.lit(before)) & F.endswith(target, F.lit(after))
    return F.when(whole, unescape(F.substring(target, F.lit(len(before) + 1), F.length(target) - len(before) - len(after))))


def format_digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, n_examples, context_bytes (of all examples together).

    The loss columns and the counts of examples come from one row per example; a target without its
    marks has no trainable text, which makes the digests differ."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = formatted.select("conv_id", read_turns(F.decode("formatted", "UTF-8")).alias("turns"),
                            F.length(F.decode("formatted", "UTF-8")).cast("long").alias("formatted_chars"))
    read = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), "formatted_chars")
    replies = example_replies(formatted).select(F.col("conv_id").alias("conv"), "example", "context_end", trainable(F.col("target")).alias("reply"))
    loss = replies.groupBy("conv").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("example", "reply")))["reply"], "").alias("loss"),
        F.count("*").alias("examples"), F.sum("context_end").cast("long").alias("context"))
    both = read.join(loss, read["conv_id"].eqNullSafe(loss["conv"]), "left")
    text = F.coalesce("loss", F.lit(""))
    return both.select("conv_id", "n_turns", "turns_sha256", F.length(text).cast("long").alias("loss_chars"), F.sha2(text, 256).alias("loss_sha256"), "formatted_chars",
                       F.coalesce("examples", F.lit(0)).cast("long").alias("n_examples"), F.coalesce("context", F.lit(0)).cast("long").alias("context_bytes"))
