"""Small tables with the odd cases every operator must stand."""

import random

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, text_ string, version string, keys int, row int"


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    sounds = ["ba", "ri", "mo", "te", "lu", "sha", "ne", "ko", "di", "pa"]
    return " ".join("".join(rnd.choice(sounds) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, a long one, copies, repeated rows, clashing names."""
    same = prose(1, 80)
    made = [
        (1, same), (2, same), (2, same), (3, None), (4, ""), (5, " \n\t "), (6, prose(2, 20_000)),
        (7, prose(3, 60) + "\n" + prose(4, 3)), (8, "one"), (9, "two words"), (10, "日本語 テキスト ▁ \U0001f600"),
        (None, prose(5, 40)), (None, None), (11, prose(6, 70)), (11, prose(7, 70)), (12, "x" * 30_000),
        (13, prose(1, 79) + " changed"),
    ]
    return [(i, t, "en" if i else None, None, None if t is None else len(t), "t", "v", 7, 8) for i, t in made]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), DOC).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], DOC)


def docs_of(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
