import pytest

# long enough to cross every chunk, block and batch limit that the tests set
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(4000))

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog, again and again."), (2, None), (3, ""), (4, " \t\n "),
    (5, "The  quick brown\tfox jumps over the lazy dog, again and again."), (6, LONG), (7, LONG + " end"),
    (8, "  leading\n\n lines  <|endoftext|> and   runs   　 x\x1c y 中文字 don't aaaaaaaa\r\n"), (9, "word"), (9, "word"),
    (10, "a b c d e f g h"), (11, "A B C D E F G H"), (12, "äö   z \x85 q"), (None, "null id here"),
]


@pytest.fixture()
def docs(spark):
    """Odd rows beside columns whose names the operators use inside."""
    rows = [(i, t, "en" if i and i % 2 else None, f"s{(i or 0) % 3}" if i != 3 else None, len(t or ""), "x", 7)
            for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                                       "h string, size int")


@pytest.fixture()
def nothing(docs):
    return docs.limit(0)
