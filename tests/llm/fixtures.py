"""Small tables with the cases that every operator must bear."""

from __future__ import annotations

import random

from pyspark.sql import Row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_texts() -> list[str | None]:
    """Nulls, empty and blank texts, odd characters, one very long text, copies and shared passages."""
    rnd = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma,", "delta.", "été", "naïve", "中文", "x1", "the", "of", "a", "ZETA!", "don't", "😀"]
    passage = " ".join(f"shared{i}" for i in range(60))

    def prose(n: int) -> str:
        return " ".join(rnd.choice(vocabulary) + (str(rnd.randrange(50)) if rnd.random() < 0.5 else "") for _ in range(n))

    # Two words that a sum of bytes times powers modulo 2^64 can't tell apart.
    pair = ["".join(letters[bin(i).count("1") % 2] for i in range(1024)) for letters in ("ab", "ba")]
    around = [" ".join(f"around{i}" for i in range(17)), " ".join(f"behind{i}" for i in range(17))]
    base = prose(120)
    near = base.split(" ")
    near[7] = "changed"
    return [
        None, "", " \n\t ", "one", "One two", "a\x0bb\x1cc\x85d e　f", base, base, base.upper(), " ".join(near),
        prose(30) + "\n" + passage + " " + prose(30), prose(10) + " " + passage, passage, "same " * 100, prose(9000), "z" * 30_000,
        "trailing space ", "'s 're it's 12 345 ½ ², ...", prose(40), prose(3),
        *pair, *[f"{around[0]} {word} {around[1]}" for word in pair],
    ]


def documents(spark, texts=None):
    rows = [(i, text, "en", "src0", len(text or "")) for i, text in enumerate(awkward_texts() if texts is None else texts)]
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df) -> dict[int, Row]:
    return {row["doc_id"]: row for row in df.collect()}
