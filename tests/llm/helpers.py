import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def words(text):
    return WORD.findall(text or "")


def prose(seed, n, prefix=""):
    """n words of made-up prose, nearly all different."""
    import random

    r = random.Random(seed)
    return " ".join(prefix + r.choice(LOREM) + str(r.randrange(1000)) for _ in range(n))


def frame(spark, rows, extra=False):
    """documents from (doc_id, text[, lang, source]); extra adds columns that clash with inner names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for c in ("kept", "n", "words", "hash", "pos", "shard", "size", "count"):
            df = df.withColumn(c, F.lit("x"))
    return df


EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four"), (6, "a b c " * 40), (7, "a b c " * 40),
    (8, "é ß 漢字 \U0001f600 " * 20), (9, prose(1, 120)), (9, prose(1, 120)), (10, prose(2, 3000)), (11, prose(3, 80), None, None),
    (12, "line one\nline one\n \nline one\nother # $ < > | & * %"), (None, prose(4, 60)), (13, "x\x0by\x0cz\x00w"),
]
