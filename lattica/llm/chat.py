"""Chat formatting in budgeted windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import materialize

#: Control strings of the template; each begins with "<|", which never occurs in an escaped text.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"


def escape(text: Column) -> Column:
    """text without "<|": a backslash is doubled and "<|" becomes "<\\|"."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """The inverse of escape."""
    return F.regexp_replace(text, F.lit(r"\\([\\|])"), F.lit("$1"))


def windows(chats: DataFrame, budget: int = 512, chars_per_token: int = 4, block: int = 256) -> DataFrame:
    """Windows of chats (conv_id, turn, role, text): conv_id, window, text, n_tokens, over_budget, and turns, an array of
    (place, kind, start, len) with the code points of each turn's text in the window's text. kind is system, history or
    new; loss is an array of (start, len) over the new assistant texts.

    A turn's tokens are the code points of its formatted form over chars_per_token, rounded up. Prefix sums of them, by
    blocks of turns and then within, give each turn its window: the turns that begin within the same budget / 2
    tokens. Later windows repeat the system turn (the first turn, if its role is system) and as history the turn before
    the window, if it has at most budget / 4 tokens; both are masked. So each turn is new in one window, and a window
    is over budget only if one turn alone, or a long system turn, makes it so.

    Rows are ordered by turn (nulls first), then role and text; repeated rows are turns of their own. Null texts and
    roles count as empty, a null conv_id is a conversation of its own. Other columns are ignored.
    """
    stride, tail = budget // 2, budget // 4
    rows = chats.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.floor(F.coalesce("turn", F.lit(-1)) / block).alias("block")
    )
    rows = rows.withColumn("form", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS), escape(F.col("text")), F.lit(END)))
    rows = rows.withColumn("tokens", F.ceil(F.length("form") / chars_per_token).cast("long"))
    # Pass 1: totals of blocks of turns, and what stands before each block. Pass 2: within blocks.
    parts = rows.groupBy("conv_id", "block").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
    parts = parts.select(
        F.col("conv_id").alias("c"),
        F.col("block").alias("b"),
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_n"),
        F.sum("tokens").over(Window.partitionBy("conv_id")).alias("total"),
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"upto": F.sum("tokens").over(inside), "place": F.row_number().over(inside)})
    rows = rows.join(parts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    end = F.col("upto") + F.col("base")
    rows = rows.select("conv_id", "role", "form", "tokens", "total", (F.col("place") + F.col("base_n")).alias("place"), (end - F.col("tokens")).alias("start"), end.alias("end"))
    own, following = F.floor(F.col("start") / stride), F.floor(F.col("end") / stride)
    is_system = (F.col("place") == 1) & (F.col("role") == "system")
    # The last turn of a window ends where the next window's first turn begins.
    is_tail = (following > own) & (F.col("tokens") <= tail) & ~is_system & (F.col("end") < F.col("total"))
    kind = lambda w, name: F.struct(w.cast("long").alias("window"), F.lit(name).alias("kind"))
    seen = F.concat(
        F.array(kind(own, "new")),
        F.when(is_tail, F.array(kind(following, "history"))).otherwise(F.array().cast("array<struct<window:bigint,kind:string>>")),
    )
    # Later windows with a new turn of their own, and only those, get the system turn.
    later = rows.select("conv_id", own.cast("long").alias("window")).where("window > 0").distinct()
    system = rows.where(is_system).select(F.col("conv_id").alias("c"), F.lit("system").alias("kind"), "place", "role", "form", "tokens")
    system = later.join(system, F.expr("conv_id <=> c")).select("conv_id", "window", "kind", "place", "role", "form", "tokens")
    rows = rows.withColumn("seen", F.explode(seen)).select("conv_id", "seen.window", "seen.kind", "place", "role", "form", "tokens").union(system)
    packed = rows.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(F.struct("place", "kind", "role", "form", "tokens"))).alias("rows"))
    packed = packed.where(F.exists("rows", lambda r: r["kind"] == "new"))
    spans = F.aggregate(
        "rows",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<place:bigint,kind:string,role:string,start:int,len:int>>").alias("turns")),
        lambda a, r: F.struct(
            (a["at"] + F.length(r["form"])).alias("at"),
            F.concat(
                a["turns"],
                F.array(
                    F.struct(
                        r["place"].cast("long").alias("place"),
                        r["kind"].alias("kind"),
                        r["role"].alias("role"),
                        (a["at"] + F.instr(r["form"], SAYS) - 1 + len(SAYS)).alias("start"),
                        (F.length(r["form"]) - F.instr(r["form"], SAYS) + 1 - len(SAYS) - len(END)).alias("len"),
                    )
                ),
            ).alias("turns"),
        ),
        lambda a: a["turns"],
    )
    out = packed.select("conv_id", "window", F.array_join(F.transform("rows", lambda r: r["form"]), "").alias("text"), spans.alias("spans"), F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + r["tokens"]).alias("n_tokens"))
    return out.select(
        "conv_id",
        "window",
        "text",
        "n_tokens",
        (F.col("n_tokens") > budget).alias("over_budget"),
        F.transform("spans", lambda s: F.struct(s["place"].alias("place"), s["kind"].alias("kind"), s["start"].alias("start"), s["len"].alias("len"))).alias("turns"),
        F.transform(F.filter("spans", lambda s: (s["kind"] == "new") & (s["role"] == "assistant")), lambda s: F.struct(s["start"].alias("start"), s["len"].alias("len"))).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What the windows hold, a row a conversation: turns (role, text) in order, and the texts under the loss mask.
    Roles and texts come from the windows' text alone: it is cut at the control strings and unescaped."""
    cut = F.filter(F.split("text", r"<\|end\|>"), lambda x: x != "")
    halves = F.transform(cut, lambda x: F.split(F.substr(x, F.lit(len(TURN) + 1)), r"<\|says\|>", 2))
    turns = F.filter(
        F.zip_with(halves, F.col("turns"), lambda h, t: F.struct(t["place"].alias("place"), t["kind"].alias("kind"), unescape(h[0]).alias("role"), unescape(h[1]).alias("text"))),
        lambda t: t["kind"] == "new",
    )
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("text"), s["start"] + 1, s["len"]))), "")
    read = formatted.select("conv_id", "window", turns.alias("turns"), loss.alias("loss"), F.length("text").alias("chars"))
    return read.groupBy("conv_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("window", "turns"))), lambda w: w["turns"])).alias("turns"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("window", "loss"))), lambda w: w["loss"]), "").alias("loss"),
        F.sum("chars").cast("long").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_windows"),
    )


def op2_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted, written and read back."""
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(
        F.lit(-7).cast(chats.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(chats.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(tricky).alias("text"),
    )
    read = read_back(materialize(windows(chats.unionByName(more)), "chat-windows"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )
