"""A small corpus with every awkward case, and brute-force twins of the operators."""

import random
import re

AWKWARD = [
    (1, None, "en", "a", None),
    (2, "", None, "a", 0),
    (3, "Short", "en", None, 5),
    (4, "The quick brown fox jumps over the lazy dog. It's été ÉTÉ!\nSecond line of the text here.", "en", "a", 80),
    (5, "The quick brown fox jumps over the lazy dog. It's été ÉTÉ!\nSecond line of the text here.", "fr", "b", 80),
    (6, "  \t\n\r\n  ", "en", "a", 8),
    (7, "\U0001f600 世界 12345  　x", "zh", "c", 15),
    (8, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 61),
    (9, "Before ONE two, three four; five six seven eight nine ten after", "en", "a", 61),
]


def corpus(n: int = 60, seed: int = 5):
    """Rows ``doc_id, text, lang, source, n_chars``: awkward ones, random prose, copies, near copies and a long text."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("aeioubcdfgté") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    rows = list(AWKWARD)
    for i in range(10, n):
        text = ". ".join(" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 12))).capitalize() for _ in range(rnd.randint(1, 12)))
        if i % 7 == 0:
            text = rows[-1][1]
        elif i % 11 == 0:
            text = text + "\n" + rows[-2][1] + " x"
        rows.append((i, text, rnd.choice(["en", "de"]), rnd.choice(["a", "b", "c"]), len(text)))
    long = " ".join(rnd.choice(words) for _ in range(30_000))
    rows.append((n, long, "en", "a", len(long)))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=None, extra: bool = True):
    """The rows as a DataFrame, with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)
    clash = ("fp", "component", "id", "key", "n", "y", "x", "score", "piece", "ids", "shard", "slot", "size", "hash", "gone", "_gone", "_gone_lines", "_key", "edits", "words", "docs", "line", "k", "part", "w", "t")
    return df.select("*", *[F.lit("clash").alias(c) for c in clash]) if extra else df


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
