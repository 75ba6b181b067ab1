import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Texts at the edges: null, blank, one word, odd spaces, marks, control strings, broken bytes, other scripts.
EDGE_TEXTS = [
    None, "", " ", "  ", "\n", "a", "a b", " a", "a ", "a  b", "a   b\n c", "a \n b\t\t c  \n  d", "x  \ny", "▁", "a▁b", "▁▁ a",
    "　wide　", "café ﬁ ①", "<s> </s> <unk>", "<|endoftext|> x", "don't we'll  can't", "\x00 a\x00b", "\U0001f600 \U0001f469‍\U0001f680", "السلام عليكم",
    "word " * 3000, "tie tie tie", "tie tie tie", "0123 456  7", "!!! ??? ...", "\r\n\r\n", "tab\tsep\x0bv\x0cf", "a b", "MiXeD CaSe",
]


@pytest.fixture(scope="session")
def edge_rows():
    return [(i if i != 7 else None, t, "en", None if i % 3 == 0 else f"s{i % 5}", None) for i, t in enumerate(EDGE_TEXTS)]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
