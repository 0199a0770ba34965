"""Small awkward tables and plain Python versions of what the operators compute."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

SPACE = "[^\x20\x09-\x0d]+"
CLASHING = ["chunk", "bucket", "kind", "key", "mark", "label", "text_a", "row", "part", "weight", "anomaly",
            "probability", "kept", "topic", "_text", "_tokens", "_source", "_0", "n_words", "signature"]


def words(text):
    return re.findall(SPACE, text or "")


def some_texts(seed=1, n=120, vocabulary=150, passages=8):
    """Texts of random words with shared passages, copies and near copies."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh\xe9\xdf") for _ in range(rng.randint(1, 9))) for _ in range(vocabulary)]
    shared = [" ".join(rng.choice(vocab) for _ in range(rng.randint(8, 60))) for _ in range(passages)]
    out = []
    for _ in range(n):
        parts = [rng.choice([" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40))),
                             rng.choice(shared), rng.choice(shared)[3:-5]]) for _ in range(rng.randint(1, 5))]
        out.append(rng.choice([" ", "\n"]).join(parts))
    for _ in range(n // 4):
        near = out[rng.randrange(n)].split(" ")
        if rng.random() < 0.7:
            near[rng.randrange(len(near))] = rng.choice(vocab)
        out.append(" ".join(near))
    return out


AWKWARD = ["", None, " ", "\n\n", "a", "A b", "a b c", "a  b\tc", "x" * 3000, "\0" * 120, "日本語" * 40,
           "<|endoftext|> a", "a\x0bb\x85c\x1cd", "#$%&|<>* " * 30, "the same line\n" * 20, "\U0001f600 " * 60]


def documents(spark, texts, partitions=4, first=0):
    """Rows with ids in order and every column that ``documents`` has."""
    rows = [(first + i, t, ["en", "de", None][i % 3], ["s1", "s2", "s1", None][i % 4],
             None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(partitions)


def awkward(spark, texts=()):
    """Null and repeated keys, repeated rows, nulls everywhere, columns named like the operators' own."""
    base = documents(spark, [*AWKWARD, *texts])
    more = spark.createDataFrame(
        [(3, "another text under a key that is taken", "en", "s1", None), (None, "a text without a key", None, None, 1),
         (None, None, None, None, None), (5, "A b", "en", "s1", 3), (5, "A b", "en", "s1", 3)], base.schema)
    return base.unionByName(more).withColumns({c: F.lit("clash") for c in CLASHING})


def collected(df):
    return [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect()]
