"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation estimates how far each can be
trusted, and the posterior probability of quality decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import documents, materialize, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
ROUNDS = 40
#: At the start a rule is right of good text nearly always, of bad text half the time.
START = {"prior": 0.85, "good": 0.98, "bad": 0.5}
#: Bounds of the estimates. The rules' votes against a text are made to be rarely wrong, hence the floor for good text.
LOW, HIGH, GOOD = 0.02, 0.999, 0.97


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


#: The rules by name, in order of their votes: 1 good, -1 bad, 0 abstains.
RULES = ("symbols", "repeats", "dup_lines", "word_length", "capitals", "stops", "shouts", "letters")


def votes() -> list[Column]:
    """The rules, in the order of RULES. Each is silent where its statistic says little."""

    def rule(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    symbols, repeats, lines = _ratio("n_symbols", "n_words"), _ratio("n_repeat_words", "n_words"), _ratio("n_dup_lines", "n_lines")
    length, capitals = _ratio("word_chars", "n_words"), _ratio("n_upper", "n_letters")
    stops, shouts = _ratio("n_stopped_lines", "n_lines"), _ratio("n_shouts", "n_words")
    letters = _ratio("n_letters", "word_chars")
    return [
        rule(symbols < 0.03, symbols > 0.15),
        rule(repeats < 0.05, repeats > 0.25),
        rule((lines < 0.05) & (F.col("n_lines") >= 3), lines > 0.3),
        rule((length >= 3) & (length <= 9), (length < 2) | (length > 15)),
        rule((capitals > 0.005) & (capitals < 0.15), (capitals > 0.5) | (F.col("n_letters") < F.col("n_words"))),
        rule(stops > 0.6, (stops < 0.2) & (F.col("n_words") >= 20)),
        rule(shouts < 0.02, shouts > 0.2),
        rule(letters > 0.93, letters < 0.895),
    ]


def _window_hashes() -> Column:
    """A hash of each window of eight words; of shorter texts none."""
    n = F.size("words")
    return F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules read, of whole texts; a null text counts as empty.

    Repeated windows: only texts with an equal pair of window hashes sort theirs; neighbours in the order are equal
    windows, and the words under the union of their places are counted from gaps between places.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", text.alias("text"))
    d = d.select("doc_id", "text", words(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    d = d.select("doc_id", "text", "words", "lines", _window_hashes().alias("hashes"))
    repeated = F.size("hashes") > F.size(F.array_distinct("hashes"))
    # Sorted (hash, place) pairs of those texts; the fold keeps the pair before and the places of equal neighbours.
    pairs = F.when(repeated, F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("pairs", pairs).drop("hashes")
    n = F.size("pairs")
    places = F.filter(
        F.transform(
            F.col("pairs"),
            lambda x, k: F.when(((k > 0) & (F.get("pairs", F.greatest(k - 1, F.lit(0)))["h"] == x["h"])) | ((k < n - 1) & (F.get("pairs", k + 1)["h"] == x["h"])), x["i"]),
        ),
        lambda i: i.isNotNull(),
    )
    d = d.withColumn("places", F.sort_array(places)).drop("pairs")
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).cast("long").alias("words"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["words"] + F.least(i - a["last"], F.lit(WINDOW))).cast("long").alias("words"), i.alias("last")),
        lambda a: a["words"],
    )
    bare = F.length(F.translate("text", SYMBOLS, ""))
    return d.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        (F.length("text") - bare).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"[.!?:;\"')\]]\s*$"))).cast("long").alias("n_stopped_lines"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        F.regexp_count("text", F.lit("!!")).cast("long").alias("n_shouts"),
    )


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def posterior_sql(v: str, p: str) -> str:
    """SQL: probability of quality given votes v under parameters p."""
    term = "if(element_at({v}, i) = 0, 0D, if(element_at({v}, i) = 1, ln({up}), ln({down})))"
    good = f"aggregate(sequence(1, size({v})), ln({p}.prior), (a, i) -> a + {term.format(v=v, up=f'element_at({p}.good, i)', down=f'1 - element_at({p}.good, i)')})"
    bad = f"aggregate(sequence(1, size({v})), ln(1 - {p}.prior), (a, i) -> a + {term.format(v=v, up=f'1 - element_at({p}.bad, i)', down=f'element_at({p}.bad, i)')})"
    return f"(1D / (1D + exp(least(700D, {bad} - {good}))))"


def estimate(patterns: DataFrame, n_rules: int, rounds: int = ROUNDS, floor: float = GOOD) -> DataFrame:
    """One row of estimates from (votes, n), a row for each pattern of votes (3 to the power of the rules at most):
    prior, and for each rule the probability that its vote is right on good and on bad text.

    A vote of -1 stays evidence against a text (right on bad oftener than wrong on good), so that the classes keep their
    meaning; floor is the least that a rule is right of good text. Without patterns the estimates are those at the start.
    """
    start = f"named_struct('prior', {START['prior']}D, 'good', array_repeat({START['good']}D, {n_rules}), 'bad', array_repeat({START['bad']}D, {n_rules}))"
    weighted = "transform(patterns, x -> named_struct('v', x.votes, 'g', x.n * " + posterior_sql("x.votes", "p") + ", 'n', cast(x.n AS DOUBLE)))"

    def share(num: str, den: str) -> str:
        total = lambda cond, what: f"aggregate(w, 0D, (a, x) -> a + if({cond}, {what}, 0D))"
        what = num
        return f"(1D + {total(den, what)}) / (2D + {total('element_at(x.v, r) != 0', what)})"

    good = share("x.g", "element_at(x.v, r) = 1")
    bad = share("x.n - x.g", "element_at(x.v, r) = -1")
    prior = "(1D + aggregate(w, 0D, (a, x) -> a + x.g)) / (2D + aggregate(w, 0D, (a, x) -> a + x.n))"
    step = _let(
        "w",
        weighted,
        f"named_struct('prior', least({HIGH}D, greatest({LOW}D, {prior})),"
        f" 'good', transform(sequence(1, {n_rules}), r -> least({HIGH}D, greatest({floor}D, {good}))),"
        f" 'bad', transform(sequence(1, {n_rules}), r -> {_let('gd', f'least({HIGH}D, greatest({floor}D, {good}))', f'least({HIGH}D, greatest({LOW}D, 1D - gd + {LOW}D, {bad}))')}))",
    )
    fit = f"aggregate(sequence(1, {rounds}), {start}, (p, _) -> {step})"
    rows = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    return rows.select(F.expr(f"if(size(patterns) > 0, {fit}, {start})").alias("p"))


def judge(docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30, threshold: float = 0.5) -> DataFrame:
    """A row for each of docs (doc_id, text): the statistics, votes, base_failed, quality (posterior probability) and
    kept. A text fails the base with fewer than min_words words or with more than max_repeat_percent of its words in
    repeated windows.

    The statistics are computed once and written without the texts. Patterns of votes, at most 3 ** 8, are counted, and
    the posterior of each is joined back by pattern, a table of that bounded size.

    Null and empty texts have zero counts and fail the base; repeated rows are judged each; an empty table gives an
    empty result; other columns are ignored.
    """
    rules = votes()
    stats = materialize(statistics(docs).withColumn("votes", F.array(*rules)), "quality-statistics")
    patterns = stats.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    fitted = estimate(patterns, len(rules))
    # One row of estimates beside at most 3 ** 8 patterns.
    quality = patterns.join(F.broadcast(fitted)).select(F.col("votes").alias("pattern"), F.expr(posterior_sql("votes", "p")).alias("quality"))
    quality = materialize(quality, "quality-posterior")
    judged = stats.join(F.broadcast(quality), F.col("votes") == F.col("pattern")).drop("pattern")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The verdict on every text. Nulls, repeated rows and empty tables: see judge."""
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    return judge(documents(spark, sf_dir).select("doc_id", "text")).select(*columns)
