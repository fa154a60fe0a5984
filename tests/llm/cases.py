"""Tables with the cases every operator must handle."""

import random

WORDS = "the of alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau été ñandú".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


# Columns that operators use under these names themselves.
CLASH = "score held_out label n_tokens uid code spans bucket hashes kept_0 text_hash length piece rank class_id n k1 bands lines"


def awkward_rows():
    long = prose(4000, 1)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c"), (6, prose(80, 2)), (7, prose(80, 2)), (7, prose(80, 2)),
        (8, long), (9, "x" * 30000), (10, long + " tail of its own"), (None, "no id"), (None, None), (12, "漢字 ÿ́ é"), (13, "line\n" * 40),
    ]


def docs(spark, rows):
    """A documents table of (doc_id, text) rows with columns whose names clash."""
    names = CLASH.split()
    data = [(i, t, *([f"c{k}"] * len(names)), "en", "src", len(t or "")) for k, (i, t) in enumerate(rows)]
    schema = "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names) + ", lang string, source string, n_chars bigint"
    return spark.createDataFrame(data, schema)


def awkward(spark):
    return docs(spark, awkward_rows())


def empty(spark):
    return docs(spark, [])
