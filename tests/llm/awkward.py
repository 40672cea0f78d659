"""Rows that every operator has to take: nulls, empty and long texts, repeated rows, clashing columns."""

LONG = "long words run on, Éa ñ 北京 " * 6000
PASSAGE = "A passage of well over fifty bytes that several of these documents have in common, word for word. "
ROWS = [
    (7, "One plain text. " + PASSAGE), (3, PASSAGE + "Another end"), (None, "no id " + PASSAGE), (None, None),
    (1, None), (2, ""), (4, " \n\t "), (5, LONG), (6, "repeated row"), (6, "repeated row"), (9, "repeated row"),
    (8, "é" * 40 + "\x00\x1c' don't <|endoftext|> x  y\n\n z"), (-4, "negative " + PASSAGE), (10, LONG),
]
SCHEMA = ("doc_id long, text string, score string, chunk string, bucket double, payload long, fingerprint string, "
          "ids string, n int, `odd name` string, kept string, removed int, n_bytes string, _score string, _kept long, "
          "_rest struct<`a b`: int, kept: string>, _mark string, _key int, decoded string")


def documents(spark, rows=ROWS):
    more = ("s", "c", 1.5, 7, "f", "i", 3, "o", "k", 4, "b", "x", 5, (6, "z"), "m", 8, "d")
    return spark.createDataFrame([(i, t, *more) for i, t in rows], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
