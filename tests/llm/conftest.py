import os
import tempfile

import pytest

os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), os.environ.get("PYTHONPATH", "")])
SMALL = "/root/testdata/sf0.001"

#: rows that every operator must stand: NULLs, empty, wordless, tied, repeated and very long texts, and columns that clash
LONG = " ".join(f"word{i % 977} stone{i % 13}" for i in range(60000))
ODD_ROWS = [
    (1, None, "en", "a", 1.0), (2, "", None, "a", 1.0), (3, " \n\t ", "en", None, 1.0), (4, "?!", "de", "b", 1.0), (5, "one", "en", "b", 1.0),
    (6, "same words in this text and more of them", "en", "b", 1.0), (7, "same words in this text and more of them", "en", "b", 1.0),
    (7, "same words in this text and more of them", "en", "b", 1.0), (None, "no id here at all", "en", "c", 1.0), (9, LONG, "en", "c", None),
    (10, "naïve café über señor 東京 <|endoftext|> á  x", "fr", "c", 1.0), (None, None, None, None, None),
]
ODD_SCHEMA = "doc_id bigint, text string, lang string, source string, score double"


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark):
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-"))


@pytest.fixture()
def odd(spark):
    d = spark.createDataFrame(ODD_ROWS, ODD_SCHEMA)
    names = ["size", "fp", "component_id", "taken", "lang_pred", "_row", "n_words", "kept", "target", "_matches"]
    return d.selectExpr("*", *[f"'x' AS {n}" for n in names])


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], ODD_SCHEMA)
