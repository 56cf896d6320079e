"""Small tables for the operators of training data, with the odd cases each must stand."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Extra columns with names the operators use themselves.
CLASHING = "node long, bucket string, n long, class string, kept boolean, shard int, slot long, target double, docs long, component long"


def prose(words: int, seed: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghiklmnoprstu") for _ in range(draw.randint(2, 9))) for _ in range(words))


def odd_documents() -> list[tuple]:
    base, other = prose(60, 1), prose(80, 2)
    words = base.split()
    near = " ".join([*words[:30], "changed", *words[31:]])
    rows = [
        (1, base, "en", "a", len(base)), (2, base, "en", "b", 0), (3, near, "en", None, None), (4, other, "de", "a", 1),
        (5, "", "en", "a", 0), (6, None, None, "b", None), (7, " \t\n ", "fr", "c", 3), (8, "three small words", "en", "c", 17),
        (9, "three  small\nwords", "en", "c", 17), (10, prose(9000, 3), "en", "a", 5), (10, prose(50, 4), "en", "a", 5),
        (None, base, "en", "a", 7), (12, "ünï cödé ßtraße\n" + other, "de", "a", 9), (12, "ünï cödé ßtraße\n" + other, "de", "a", 9),
        (13, "12345 $$$ 999", "en", "d", 4), (14, "x" * 30000, "en", "d", 1), (-5, "THREE SMALL WORDS", "en", "d", 1),
    ]
    return rows


def documents(spark, rows=None, clashing: bool = False):
    rows = odd_documents() if rows is None else rows
    df = spark.createDataFrame(rows, SCHEMA)
    if clashing:
        for field in CLASHING.split(", "):
            name, kind = field.split(" ")
            df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
    return df
