"""Small documents with everything that operators must bear."""

import random
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    """Words as the operators count them, A-Z lower-cased."""
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def sentence(rng, n):
    return " ".join(rng.choice(["river", "stone", "lamp", "éclair", "über", "go", "and", "the", "of", "x1", "grün", "naïve", "日本"]) + str(rng.randrange(40)) for _ in range(n))


def documents(seed=1):
    rng = random.Random(seed)
    rows = [(i, sentence(rng, rng.randrange(1, 120)) + rng.choice([".", "!", "\n", " "]), "en", "s", 1) for i in range(40)]
    base = sentence(rng, 120)
    rows += [(100 + i, " ".join(w if rng.random() > 0.01 else "changed" for w in base.split()), "en", "s", 1) for i in range(12)]
    rows += [(120, base, "en", "s", 1), (121, base, None, None, None), (121, base, None, None, None), (122, base.upper(), "en", "s", 1)]
    rows += [(200, None, None, None, None), (201, "", "en", "s", 0), (202, " \n\t ", "en", "s", 4), (None, "a text without an id but with words", None, None, None), (None, None, None, None, None)]
    rows += [(300, sentence(rng, 40_000), "en", "s", 1), (301, "y" * 50_000, "en", "s", 1), (302, "日" * 3000, "ja", "s", 3000)]
    return rows


def frame(spark, rows=None, extra=True):
    """The documents as a DataFrame, with columns whose names clash with those of results."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    return df.withColumns({"n_tokens": F.lit("clash"), "score": F.lit(1), "n_words": F.lit(None).cast("string"), "spans": F.lit("x"), "fp": F.lit(0), "key": F.lit("k")}) if extra else df


def key(row):
    return tuple((v is not None, str(v)) for v in row)


def thue_morse(n):
    """Two different strings of a and b that hashes by powers of a number confuse, from n = 1024 on."""
    s = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return s, s.translate({97: "b", 98: "a"})
