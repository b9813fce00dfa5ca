"""Repair of conversations whose structure is damaged, by the cheapest edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import in_order, materialize

#: Rows of a conversation that one array holds at most.
SEGMENT = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: More than any repair costs: a state that isn't reached.
_NEVER = 1 << 50
#: What stands so far: nothing, a system turn alone, a user turn last, an assistant turn last. Only the first and the last may end.
STATES = "esua"


def damaged(chats: DataFrame) -> DataFrame:
    """chats (conv_id, turn, role, text) with rows dropped, emptied, without sentence ends, repeated or of another role, by the crc32 of
    "conv_id:turn" modulo 20: 0, 1, 2, 3, 4; a null counts as one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = chats.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20).alias("hit")).where("hit != 0")
    rows = rows.withColumns(
        {
            "text": F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
            "role": F.when(F.col("hit") == 4, "user").otherwise(F.col("role")),
        }
    )
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _way(cost: Column | int, audit: Column | str) -> Column:
    lit = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return F.struct(lit(cost, "long").alias("cost"), lit(audit, "string").alias("audit"))


def _more(way: Column, cost: Column | int, letters: Column | str) -> Column:
    return _way(way["cost"] + cost, F.concat(way["audit"], letters if isinstance(letters, Column) else F.lit(letters)))


def _inserted(a: Column) -> tuple[Column, Column, Column, Column]:
    """The four ways after up to two inserted turns."""
    u = F.least(a["u"], *(_more(a[x], INSERT, "I") for x in "esa"))
    end = F.least(a["a"], _more(a["u"], INSERT, "I"), *(_more(a[x], 2 * INSERT, "II") for x in "es"))
    return a["e"], a["s"], u, end


def _step(a: Column, row: Column) -> Column:
    """The four ways after one more row: inserted turns before it, then the row is kept, gets another role, or goes."""
    e, s, u, end = _inserted(a)
    must, initial, fine = row["fault"].isin("blank", "duplicate"), row["initial"], F.when(row["fault"] == "truncated", TRUNCATED).otherwise(0)
    gone = lambda way: _more(way, DELETE, "D")

    def stays(way: Column, role: str) -> Column:
        kept = initial == role
        return _way(F.when(must, F.lit(_NEVER)).otherwise(way["cost"] + fine + F.when(kept, KEEP).otherwise(REROLE)), F.concat(way["audit"], F.when(kept, "K").otherwise("R")))

    system = _way(F.when(must | (initial != "s"), F.lit(_NEVER)).otherwise(e["cost"] + fine + KEEP), F.concat(e["audit"], F.lit("K")))
    return F.struct(
        gone(e).alias("e"), F.least(gone(s), system).alias("s"), F.least(gone(u), stays(F.least(e, s, end), "u")).alias("u"), F.least(gone(end), stays(u, "a")).alias("a")
    )


def _through(rows: Column, entry: str) -> Column:
    """The cheapest ways through a segment's rows from a state: to each state its (cost, audit), the audit led by the entry state."""
    begin = F.struct(*(_way(0 if x == entry else _NEVER, STATES.index(entry).__str__()).alias(x) for x in STATES))
    return F.aggregate(rows, begin, _step)


def _joined(a: Column, segment: Column) -> Column:
    """The ways through all segments so far and one more."""
    by_end = []
    for end in STATES:
        ways = [_way(a[x]["cost"] + segment["ways"][x][end]["cost"], F.concat(a[x]["audit"], segment["ways"][x][end]["audit"])) for x in STATES]
        by_end.append(F.least(*ways).alias(end))
    return F.struct(*by_end)


def _lines(rows: Column, piece: Column) -> Column:
    """A segment's repaired rows as lines "role:text", by its piece of the audit: the entry state's digit, then for each row the turns
    inserted before it, and what becomes of it. The role that is due is assistant after user, else user."""
    due = F.when(F.substring(piece, 1, 1) == "2", "a").otherwise("u")
    tokens = F.regexp_extract_all(piece, F.lit("(I*[DKR])"), F.lit(1))
    pairs = F.zip_with(rows, tokens, lambda r, t: F.struct(r["role"].alias("role"), r["text"].alias("text"), r["initial"].alias("initial"), t.alias("token")))
    name = lambda x: F.when(x == "u", "user").otherwise("assistant")
    other = lambda x: F.when(x == "u", "a").otherwise("u")

    def add(a: Column, r: Column) -> Column:
        n, last = F.length(r["token"]) - 1, F.right(r["token"], F.lit(1))
        first, second = F.concat(name(a["due"]), F.lit(":")), F.concat(name(other(a["due"])), F.lit(":"))
        new = F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(first)).otherwise(F.array(first, second))
        due = F.when(n == 1, other(a["due"])).otherwise(a["due"])
        line = F.concat(F.when(last == "K", r["role"]).otherwise(name(due)), F.lit(":"), r["text"])
        # A system turn is kept only where nothing stands before it, and a user turn is due after it too.
        then = F.when((last == "D") | (r["initial"] == "s") & (last == "K"), due).otherwise(other(due))
        return F.struct(F.concat(a["lines"], new, F.when(last == "D", F.array().cast("array<string>")).otherwise(F.array(line))).alias("lines"), then.alias("due"))

    return F.aggregate(pairs, F.struct(F.array().cast("array<string>").alias("lines"), due.alias("due")), add, lambda a: a["lines"])


def repaired(chats: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and text of each conversation of chats (conv_id, turn, role,
    text), in order of turn (nulls first), then role and text.

    A row's fault is the first of: blank (its text has no word), duplicate (role and text stand earlier), truncated (its last
    character that isn't white space isn't one of .!?). gaps counts the turns that are missing between the least and the greatest,
    illegal the neighbours whose roles' initials aren't su, ua or au.

    The repair gives initials (s?(ua)+)? at the least cost: Keep 0, Rerole to user or assistant 3, Delete 4 (blank and duplicate
    rows must go), Insert an empty user or assistant turn 3; a truncated row that stays adds 3. audit holds the edits' initials;
    of equal costs it is the least in ASCII. text holds the lines "role:text".

    Rows are sorted over all partitions and cut into segments of at most 256 of a conversation. A fold over a segment's sorted rows
    carries the cheapest way to each of the four states, from each of the four that the segment may begin in; a second one over a
    conversation's segments joins these ways, so no array holds more rows than a segment. Only the results, the audit and the text
    of a conversation, are one row. A null conv_id is a conversation; null roles and texts count as one space. Repeated rows are
    rows of their own. Other columns are ignored. A conversation without rows isn't there.
    """
    said = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = chats.select("conv_id", "turn", said("role"), said("text"))
    rows = in_order(rows, F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), name="repair-sorted")
    rows = rows.withColumn("segment", F.floor(F.col("idx") / SEGMENT))
    earlier = Window.partitionBy("conv_id", "role", "text").orderBy("pid", "idx")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", "blank").when(F.row_number().over(earlier) > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    rows = rows.withColumns({"fault": fault, "initial": F.substring("role", 1, 1)})
    inside = Window.partitionBy("conv_id", "pid", "segment").orderBy("idx")
    rows = rows.withColumn("pair", F.concat(F.lag("initial").over(inside), "initial"))
    turn = F.struct("idx", "role", "text", "initial", "fault")
    count = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0)).cast("long")
    segments = rows.groupBy("conv_id", "pid", "segment").agg(
        F.sort_array(F.collect_list(turn)).alias("rows"), *(count(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")),
        count(~F.col("pair").isin("su", "ua", "au")).alias("illegal"),
    )
    ways = F.struct(*(_through(F.col("rows"), x).alias(x) for x in STATES))
    segments = segments.withColumns({"first": F.col("rows")[0]["initial"], "last": F.element_at("rows", -1)["initial"], "ways": ways})
    segments = materialize(segments, "repair-segments")

    part = F.struct("pid", "segment", "ways", "first", "last")
    whole = segments.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"), *(F.sum(x).cast("long").alias(x) for x in ("blank", "duplicate", "truncated", "illegal")))
    begin = F.struct(*(_way(0 if x == "e" else _NEVER, "").alias(x) for x in STATES))
    e, s, u, a = _inserted(F.aggregate("parts", begin, _joined))
    seams = F.zip_with(F.slice("parts", F.lit(2), F.size("parts")), F.slice("parts", F.lit(1), F.size("parts") - 1), lambda x, y: F.concat(y["last"], x["first"]))
    whole = whole.select(
        "conv_id", "blank", "duplicate", "truncated", (F.col("illegal") + F.size(F.filter(seams, lambda x: ~x.isin("su", "ua", "au")))).cast("long").alias("illegal"), F.least(e, a).alias("best"),
        F.transform("parts", lambda x: F.struct(x["pid"].alias("pid"), x["segment"].alias("segment"))).alias("places"),
    )
    whole = materialize(whole, "repair-whole")

    pieces = F.regexp_extract_all("best.audit", F.lit("([0-3][DIKR]*)"), F.lit(1))
    placed = whole.select("conv_id", F.explode(F.arrays_zip("places", pieces.alias("piece"))).alias("x")).select(F.col("conv_id").alias("c"), F.col("x.places.pid").alias("p"), F.col("x.places.segment").alias("g"), F.col("x.piece").alias("piece"))
    lines = segments.join(placed, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pid") == F.col("p")) & (F.col("segment") == F.col("g")))
    lines = lines.select("conv_id", "pid", "segment", _lines(F.col("rows"), F.col("piece")).alias("lines")).where(F.size("lines") > 0)
    texts = lines.groupBy(F.col("conv_id").alias("c")).agg(F.sort_array(F.collect_list(F.struct("pid", "segment", F.array_join("lines", "\n").alias("text")))).alias("texts"))
    gaps = rows.groupBy(F.col("conv_id").alias("k")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    audit = F.regexp_replace("best.audit", "[0-3]", "")
    # Turns inserted after the last row: one is an assistant's, two are a user's and an assistant's.
    tail = F.regexp_extract("best.audit", "(I*)$", 1)
    tail = F.when(tail == "I", F.array(F.lit("assistant:"))).when(tail == "II", F.array(F.lit("user:"), F.lit("assistant:"))).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.concat(F.coalesce(F.transform("texts", lambda x: x["text"]), F.array().cast("array<string>")), tail), "\n")
    found = whole.join(texts, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(gaps, F.col("conv_id").eqNullSafe(F.col("k")))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), audit.alias("audit"), text.alias("text"))


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired; those that lost all rows too."""
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = repaired(damaged(chats)).withColumnRenamed("conv_id", "c")
    every = chats.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    numbers = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("repaired_sha256"))
