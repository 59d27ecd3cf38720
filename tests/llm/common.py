"""Awkward documents that every operator has to take: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(n))


def documents(seed=3, n=60):
    rng = random.Random(seed)
    base = [words(rng, rng.randint(25, 120)) for _ in range(n)]
    passage = words(rng, 70)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, base[0], "en", "s", 1) for i in range(12)]  # exact copies
    for i in range(30):  # near copies
        w = base[1].split() * 3
        w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((200 + i, " ".join(w), "en", "hot", 2))
    rows += [(300 + i, f"{words(rng, 30)}\n{passage}\n{words(rng, 30)}", None, "hot", None) for i in range(6)]
    lines = [words(rng, 8) for _ in range(40)]
    rows += [(400, "\n".join(lines), "en", "s", 1), (401, "\n".join(["new first line", *lines[:30], "changed", *lines[31:]]), "en", "s", 1)]
    rows += [(500, None, None, None, None), (501, "", "en", "s", 0), (502, "   \n\t ", "en", "s", 3), (503, "one", "en", "s", 3), (504, "one", "en", "s", 3)]
    rows += [(505, words(rng, 9000), "en", "s", 9), (506, "ñandú Ünïcode ß 東京 \U0001f600 it's <|endoftext|>", "xx", "s", 1)]
    rows += [(None, words(rng, 30), "en", "s", 1), (None, None, None, None, None)]
    rows += [(7, base[7], "en", "s", 1), (8, words(rng, 40), "en", "s", 1)]  # a repeated row's id and text, and an id with another text
    return rows


def frame(spark, rows=None):
    """With extra columns that are named like what operators add."""
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    from pyspark.sql import functions as F

    extra = ("n_tokens", "ids", "node", "root", "key", "class_id", "n_lines", "text_hash", "kept", "score", "start", "_gone")
    return df.select("*", *(F.lit("x").alias(c) for c in extra)).repartition(3)
