"""Small tables with what operators must bear: nulls in any column, empty and long texts, ties, repeated rows, and columns
whose names the operators use themselves."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns with clashing names.
EXTRA = "a string, b bigint, node string, n string, h string, pid string, at string, words string, pieces string, base string, kind string, row_key string, part string, votes string"
EXTRA_NAMES = [x.split()[0] for x in EXTRA.split(", ")]


def prose(seed, n, lang="en"):
    rng = random.Random(seed)
    syllables = {"en": "the of and ing ther tion ly ed st an".split(), "de": "der die ung sch ein ich keit auf lich und".split()}[lang]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))


def rows():
    out = []
    for i in range(24):
        out.append((i, prose(i, 60 + 10 * i, "de" if i % 3 == 0 else "en"), "de" if i % 3 == 0 else "en", f"s{i % 3}", None))
    whole = out[5][1]
    near = whole.split()
    near[40] = "changed"
    passage = out[7][1].split()[10:75]
    out += [
        (30, whole, "en", "s1", None),
        (31, " ".join(near), "en", "s1", None),
        (32, prose(99, 80) + " " + " ".join(passage) + " " + prose(98, 70), "en", None, None),
        (33, None, None, None, None),
        (34, "", "en", "s0", 0),
        (35, " \t\n", None, "s0", None),
        (36, "one two", "en", "", None),
        (37, "one two", "en", "", None),
        (38, "12 34 ## 56", None, "s2", None),
        (39, prose(500, 9000), "en", "s2", None),
        (40, "Tab\tand\x0bfeed\x0c é ünï   wide\nline\nline\n\nline\n", None, "s2", None),
        (41, "A text that names <|endoftext|> and <|startoftext|> itself, <|endoftext|>", "en", "s2", None),
        (20, out[20][1], "en", "s2", None),
    ]
    return out


def documents(spark, extra=False):
    docs = spark.createDataFrame(rows(), SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        docs = docs.select("*", *(F.lit("x" if t == "string" else 1).alias(c) for c, t in (x.split() for x in EXTRA.split(", "))))
    return docs


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def with_null_id(spark):
    return documents(spark).union(spark.createDataFrame([(None, prose(7, 90), "en", "s1", None)], SCHEMA))
