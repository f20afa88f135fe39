import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brute import SMALL  # noqa: E402

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, "
          "key int, root string, c0 string, pii_text string, n_pieces int, rejected string")


def edge_rows(known):
    """Rows with nulls, empty, tiny, very long and repeated texts, beside those of the small table."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    long = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    text = dict(known)
    near = text[9].split(" ")
    near[len(near) // 2] = "changed"
    return [
        (None, None), (None, text[7]), (5, text[5]), (5, text[5]), (1000, None), (1001, ""), (1002, " \n\t "),
        (1003, "word"), (1004, "a b c d"), (1005, text[5]), (1006, long), (1007, "x " * 3000),
        (1008, " ".join(near)), (1009, "a  b   c　\n\n d\u0085 e\r\n  f "), (1010, "<|endoftext|> ! <|endoftext|>"),
        (1011, "mark ▁ here  and   there▁x"),
        (1012, "mail a.b@c.de, c_d@e.f_g@h.i; call +1 (851) 555-9673 or 851-555-9673, card 4111-1111 1111 1111, "
               "ip 1.2.3.4.5.6.7.8 and 300.1.1.1, token = \"1a6c4f7bcf8c070fc75a8f6f8ed4b9a36b13d44c\" é\U0001F600 x@y.zz"),
        (1013, "1" * 5000), (1014, "a" * 20_000), (1015, long[:90_000] + " tail of its own"), (1016, "\U0001F600 " * 200),
    ]


@pytest.fixture(scope="session")
def rows(spark):
    known = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    return known + edge_rows(known)


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """The rows as a table with labels where known and columns whose names clash with results."""
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").collect()}
    full = [(d, t, lang.get(d), None if i % 3 else f"s{i}", None if t is None else len(t), 0.5, "h", 1, "r", "c", "p", 2, "no")
            for i, (d, t) in enumerate(rows)]
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(full, SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
