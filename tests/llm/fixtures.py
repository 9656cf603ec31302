"""Documents with every awkward case, and plain ones."""

import random

WORDS = "river stone wind forest night garden window letter market winter bridge paper morning silver music water story travel people house".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, size string, label int, score string, keep string, a int, b int, band int, key int, tail int, nth int, n int, gram int, part int, id int, group_id string, spans string, count int, __nth int, row int, twice string, top int, rep string, hub string, keys string, first string, m int, g int"
EXTRA = ("x", "y", 7, "z", "w", 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, "g", "s", 11, 12, 13, "t", 14, "r", "h", "k", "f", 15, 16)


def row(doc_id, text, lang="en", source="s", n_chars=0):
    return (doc_id, text, lang, source, n_chars, *EXTRA)


def awkward():
    long = prose(1, 60_000)
    return [
        row(1, prose(2, 120)),
        row(2, prose(2, 120)),
        row(3, prose(2, 119) + " changed"),
        row(4, None),
        row(5, ""),
        row(6, "  \n\t "),
        row(7, long),
        row(8, long),
        row(9, prose(3, 80)),
        row(9, prose(3, 80)),
        row(None, prose(2, 120)),
        row(None, None),
        (10, prose(4, 90), None, None, None, *[None] * len(EXTRA)),
        row(11, "!!! ??? ..."),
        row(12, "one two"),
        row(13, "é ü 漢字 🙂 ▁ \u0000 x"),
    ]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
