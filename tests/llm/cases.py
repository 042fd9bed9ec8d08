"""Awkward rows for all text operators, and plain restatements of what they compute."""

import random
import re
import zlib

from pyspark.sql import functions as F

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Columns that operators use inside; here they hold something else.
CLASHING = ("id", "h", "n", "piece", "score", "label", "part", "key", "c", "token", "found", "kept", "component", "low", "first")


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())


def lowered(text):
    return words((text or "").encode().translate(LOWER).decode())


def rows(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    some = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, family = some(60), some(120).split()
    out = [(i, some(rng.randint(0, 90))) for i in range(n)]
    out += [(1000 + i, f"{some(10)} {passage}\n{some(rng.randint(0, 30))}") for i in range(12)]
    for i in range(12):
        w = list(family)
        w[rng.randrange(len(w))] = some(1)
        out.append((2000 + i, " ".join(w)))
    out += [(3000 + i, out[5][1]) for i in range(4)]
    out += [(4000, None), (4001, ""), (4002, " \t\n "), (4003, "one"), (4004, "One two"), (4005, "one TWO"), (4006, "a " * 3000), (4007, some(4000)),
            (4008, "I'll <|endoftext|> don't ' 's   x ΑΣ İß ▁▁ á \x1c \x85"), (4009, "\r\n\x0b\x0c"), (4010, "🙂" * 50), (None, some(50)), (None, None), (None, some(50))]
    return out


def frame(spark, data=None, clash=True):
    """doc_id, text, source, lang, n_chars and clashing columns."""
    data = rows() if data is None else data
    docs = spark.createDataFrame([(i, t, None if k % 5 == 0 else f"s{k % 3}") for k, (i, t) in enumerate(data)], "doc_id long, text string, source string")
    docs = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    for name in CLASHING if clash else ():
        docs = docs.withColumn(name, F.lit("other"))
    return docs.repartition(3)


def crc_mod(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n
