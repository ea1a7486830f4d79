import re

LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "text string, doc_id long, source string, Text_ string, digest string, row long, shared int, n_words int, kept string, cls string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def table(spark, rows, parts=3):
    """``rows``: (doc_id, text[, source]); the other columns clash with names the operators use."""
    data = [(r[1], r[0], r[2] if len(r) > 2 else "s", "x", "x", 7, 7, 7, "x", "x") for r in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


def prose(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [(None, "null id text here and more"), (901, None), (902, ""), (903, "   \n\t "), (904, "word " * 30000), (905, "x" * 200000), (906, "One"), (906, "One"), (906, "Two é ü 漢字 😀")]
