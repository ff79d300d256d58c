"""Awkward rows that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length long, id long, rank long, token string"
LONG = "lorem ipsum dolor sit amet consectetur " * 3000


def rows():
    texts = [
        None, "", " \t\n", "one", "The Quick brown fox jumps over the lazy dog", "the quick BROWN fox jumps over the lazy dog",
        "the quick BROWN fox jumps over the lazy dog", LONG, LONG + "x", "a b c d e\n\na b c d e\na b c d e", "É è <|endoftext|> ＡＢ 12.5% 世运电子 don't",
        "x" * 70_000, "one two three four five six seven eight nine ten eleven twelve thirteen", "́ \xa0 z \x1c q\x85r",
    ]
    out = [(1_000_000 + i, t, None, f"s{i % 3}" if i % 4 else None, None, 1, 2, 3, "t") for i, t in enumerate(texts)]
    return [*out, out[4], (None, "a null id has words here too", *out[0][2:])]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
