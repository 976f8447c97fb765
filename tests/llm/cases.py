"""Documents at the edges: nulls, blanks, very long texts, ties, repeated rows, clashing names of other columns."""

import random

SCHEMA = "doc_id long, text string, id long, n long, h string, row string, key string, component_id long, kept boolean"


def prose(seed: int, n: int, vocabulary: int = 300) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def texts() -> list[tuple[int | None, str | None]]:
    base = prose(1, 200)
    near = [*base[:100], "changed", *base[101:]]
    far = [w if i % 9 else f"x{i}" for i, w in enumerate(base)]
    loop = prose(2, 30) * 4
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (5, "One TWO three"), (5, "One TWO three"), (6, " ".join(base)), (7, " ".join(near)), (8, " ".join(far)), (9, " ".join(loop)),
        (10, "\n".join([" ".join(base[i : i + 10]) for i in range(0, 200, 10)] * 2)), (11, "ünï cödé 日本語 12345 '' 's don't I'LL   double  spaces\n\nend "), (12, "a" * 5000), (13, " ".join(prose(3, 30_000, 5000))),
        (14, "x <|endoftext|> y<|endoftext|>"), (15, "# * $ % & | < > word"), (None, "no id at all"), (-3, "negative id " * 20),
    ]


def documents(spark):
    return spark.createDataFrame([(a, b, 7, 7, "h", "row", "key", 7, True) for a, b in texts()], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(folder: str, table: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> list[tuple]:
    import pyarrow.dataset as ds

    found = ds.dataset(f"{folder}/{table}.parquet").to_table(columns=[id_col, text_col])
    return list(zip(found[id_col].to_pylist(), found[text_col].to_pylist()))
