"""Tables with every awkward case, and a reader of results."""

import random

import pyarrow.parquet as pq

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "one two"), (5, "The quick brown fox jumps over the lazy dog near a quiet river bank today"),
    (6, "The quick brown fox jumps over the lazy dog near a quiet river bank today"), (7, "the QUICK brown fox jumps over the lazy dog near a quiet river bank tomorrow"),
    (8, "Ünïcödé straße ΑΣ 東京 \U0001f600 é"), (9, "a line that is shared\nown line nine\n  A LINE that is shared  \nshort"), (10, "a line that is shared\nshort\nown line ten"),
    (11, "word " * 3000), (12, "x" * 20000), (13, "it's 100% <|endoftext|> ok"), (14, "nul\x00 and\x0bodd\x1fspaces here"), (15, "one"),
]


def documents(spark, rows=AWKWARD):
    made = [(i, t, "en", "hot", len(t or "")) for i, t in rows]
    return spark.createDataFrame(made, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def real_texts(n, sf="sf0.01"):
    t = pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["doc_id", "text"]).slice(0, n)
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


def near_copies(seed=1, groups=6, size=6, words=60):
    """Documents in groups of edited copies with unlike amounts of change."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefgh", k=5)) for _ in range(400)]
    rows = []
    for _ in range(groups):
        base = r.choices(vocabulary, k=words)
        for _ in range(size):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 6])):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            rows.append(" ".join(own))
    r.shuffle(rows)
    return list(enumerate(rows))


def clashing(df):
    """The same rows with extra columns that bear the operators' helper names."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("own") for c in ("ids", "keep", "doc", "part", "mark", "score", "n", "block", "key", "rank", "item", "range_id")})
