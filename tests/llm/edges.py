"""Tables that every operator must stand: nulls, empty and long texts, ties, repeated rows, clashing column names, nothing."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = "fp long, key string, n long, shard int, slot long, block long, root long, uid long, kept boolean, text_sha256 string, score double, pattern int, piece int, length int, row string, _pos long, _key string"

LINE = "the plan of the house and the garden is to be made by all in the time that is left for it "


def rows() -> list[tuple]:
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    texts = [
        LINE * 4, LINE * 4, None, "", " \n\t ", "a", "one two", "ONE two", "x" * 5_000, long, long + " end", LINE + "mail a.b+c@ex-1.example.org now", LINE + "password = 'abcdef123456'\n" * 3,
        "é à ü ß 漢字 😀 " * 30, "1234 5678", "| a | b |" * 40, "THE END!! OF!! ALL!! " * 30, LINE + "call +1 (555) 123-4567 or 10.0.0.1", LINE.upper() * 3, "<|endoftext|> " + LINE,
    ]
    out = [(i, t, ("en", "de", None, "fr")[i % 4], (None, "s1", "s1", "s2")[i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    out.append((None, "no id", "en", None, 5))
    out.append((None, None, None, None, None))
    out += [out[0]] * 2  # repeated rows
    out.append((0, "another text with the same id", None, "s2", None))
    return out


def table(spark, clash: bool = True):
    df = spark.createDataFrame(rows(), SCHEMA)
    if clash:
        for c in CLASHES.split(", "):
            name, kind = c.rsplit(" ", 1)
            df = df.selectExpr("*", f"CAST(NULL AS {kind}) AS `{name}`")
    return df.repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
