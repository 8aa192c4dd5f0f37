"""Chat formatting in budgeted, turn-aligned windows. DataFrame functions only.

The prefix sum of a conversation's turn tokens says in which span a turn starts, so
spans need no loop. What the system turn leaves of the budget is the room; a turn of
over a quarter of it is a span of its own, and the others share a span if they start in
the same half of the room, so these spans leave a quarter for history. Each span becomes
one window: the conversation's first system turn, as many of a limited number of turns
before the span as still fit, and the span itself. Only assistant turns of the span are
under the loss mask; whatever is repeated is masked, so that every target occurs once
over all windows of a conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside roles and texts a
caret goes between ``<`` and ``|`` behind any carets that are there (``<|`` to ``<^|``,
``<^|`` to ``<^^|``), and a role's line breaks become ``<|n``, so no control string can
occur in them and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY = 1024, 2
START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\^*)\|", r"<^$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\^(\^*)\|", r"<$1|")


def _role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("<|n"))


def _unrole(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<|n"), F.lit("\n")))


def tokens(text: Column) -> Column:
    """An estimate of a turn's tokens that needs no vocabulary: words and other
    characters, or a third of all characters if that is more, and the turn's marks."""
    return F.greatest(F.ceil(F.char_length(text) / 3), F.regexp_count(text, F.lit(r"\w+|[^\w\s]"))) + 4


def windows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", *, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window (from 0), formatted, n_repeated (turns at
    its head that earlier windows hold too), targets (begin and end of each target in
    formatted, in characters), n_tokens.

    Null texts and roles count as empty; turns are in order of turn, ties in order of
    role and text, null turns first; a null conversation id is a conversation. Repeated
    rows are repeated turns. n_tokens is at most ``budget`` but where a window's one new
    turn, with the system turn, takes more by itself; then nothing else is repeated.
    Other columns are ignored; an empty table gives no windows."""
    t = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    t = t.withColumn("n", tokens(F.col("text")))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    recent = order.rowsBetween(-history, -1)
    t = t.withColumn("at", F.row_number().over(order) - 1)
    first = F.first(F.when(F.col("role") == "system", F.struct("at", "role", "text", "n")), ignorenulls=True)
    t = t.withColumn("system", first.over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    t = t.withColumn("room", F.greatest(F.lit(budget) - F.coalesce("system.n", F.lit(0)), F.lit(1)))
    large = (F.col("n") > F.floor(F.col("room") / 4)).cast("int")
    # small turns before, so that large ones don't move the others' spans; and large ones up to here
    t = t.withColumn("large", large).withColumn("sum", F.coalesce(F.sum(F.when(large == 0, F.col("n"))).over(before), F.lit(0)))
    t = t.withColumn("larges", F.sum("large").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("span", F.struct("larges", (1 - F.col("large")).alias("small"), F.when(F.col("large") == 0, F.floor(F.col("sum") / F.greatest(F.floor(F.col("room") / 2), F.lit(1)))).alias("cell")))
    new = ~F.coalesce(F.lag("span").over(order) == F.col("span"), F.lit(False))
    t = t.withColumn("recent", F.when(new, F.collect_list(F.struct("at", "role", "text", "n")).over(recent)))
    spans = t.groupBy("conv", "span").agg(
        F.array_sort(F.collect_list(F.struct("at", "role", "text", "n"))).alias("own"),
        F.min(F.struct("at", "recent", "system")).alias("head"),
    )
    spans = spans.withColumn("window", F.row_number().over(Window.partitionBy("conv").orderBy("span")) - 1)
    tokens_of = lambda turns: F.aggregate(turns, F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    none = F.array().cast(spans.schema["own"].dataType)
    system = F.when(F.col("head.system.at") < F.col("head.at"), F.array("head.system")).otherwise(none)
    spans = spans.withColumns({"sys": system, "past": F.array_sort(F.filter("head.recent", lambda x: ~F.coalesce(x["at"] == F.col("head.system.at"), F.lit(False))))})
    spans = spans.withColumn("slack", F.lit(budget) - tokens_of(F.col("sys")) - tokens_of(F.col("own")))
    past = F.filter("past", lambda x: tokens_of(F.filter("past", lambda y: y["at"] >= x["at"])) <= F.col("slack"))
    system = F.col("sys")
    spans = spans.withColumn("again", F.concat(system, past))
    shown = F.concat(
        F.transform("again", lambda x: F.struct(F.concat(F.lit(START), _role(x["role"]), F.lit("\n")).alias("head"), escaped(x["text"]).alias("text"), F.lit(False).alias("target"), x["n"].alias("n"))),
        F.transform("own", lambda x: F.struct(F.concat(F.lit(START), _role(x["role"]), F.lit("\n")).alias("head"), escaped(x["text"]).alias("text"), (x["role"] == "assistant").alias("target"), x["n"].alias("n"))),
    )
    spans = spans.withColumn("shown", shown)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("targets"))

    def step(acc, x):
        begin = acc["at"] + F.char_length(x["head"])
        end = begin + F.char_length(x["text"])
        target = F.struct(begin.alias("begin"), end.alias("end"))
        return F.struct((end + len(END)).alias("at"), F.when(x["target"], F.concat(acc["targets"], F.array(target))).otherwise(acc["targets"]).alias("targets"))

    return spans.select(
        F.col("conv").alias(conv_col),
        F.col("window").cast("long").alias("window"),
        F.array_join(F.transform("shown", lambda x: F.concat(x["head"], x["text"], F.lit(END))), "").alias("formatted"),
        F.size("again").alias("n_repeated"),
        F.aggregate("shown", zero, step)["targets"].alias("targets"),
        F.aggregate("shown", F.lit(0).cast("long"), lambda acc, x: acc + x["n"]).alias("n_tokens"),
    )


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The conversations that the windows hold, from their text and masks alone:
    conv_id, window, turns (role and text of what is new in the window), loss (the
    texts under the mask)."""
    parts = F.slice(F.split("formatted", r"<\|im_start\|>", -1), F.col("n_repeated") + 2, F.size(F.split("formatted", r"<\|im_start\|>", -1)))
    turn = lambda p: F.struct(_unrole(F.substring_index(p, "\n", 1)).alias("role"), unescaped(p.substr(F.position(F.lit("\n"), p) + 1, F.char_length(p) - F.position(F.lit("\n"), p) - len(END))).alias("text"))
    return formatted.select(
        conv_col,
        "window",
        F.transform(parts, turn).alias("turns"),
        F.transform("targets", lambda x: unescaped(F.col("formatted").substr(x["begin"] + 1, x["end"] - x["begin"]))).alias("loss"),
        F.char_length("formatted").alias("chars"),
    )


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, what reading its windows back gives: n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars."""
    read = read_back(formatted, conv_col)
    per = read.groupBy(conv_col).agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("chars"))
    turns = F.flatten(F.transform("w", lambda x: x["turns"]))
    loss = F.array_join(F.flatten(F.transform("w", lambda x: x["loss"])), "")
    said = F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return per.select(
        conv_col,
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"),
    )
