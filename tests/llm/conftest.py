import random

import pytest

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve é ü tion ment".split()
#: Columns beside the ones that operators read; their names are those that the operators use themselves.
EXTRA = "lang string, source string, n_chars long, words string, version long, key string, id long, n long, label int, score double, bytes string, spans string, hashes string, digest string, copies int, hub long, component long, host string, path string, rule string, verdict string, _id long, _version long, _text string, _head long, _spans string"


def words(rnd, n):
    return [("".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4)))).capitalize() if rnd.random() < 0.1 else "".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4))) for _ in range(n)]


def edge_texts():
    """Nulls, empty and blank texts, ties, repeats, few words, odd characters, and a very long text."""
    rnd = random.Random(11)
    base = " ".join(words(rnd, 150))
    long = " ".join(words(rnd, 20_000))
    near = base.split(" ")
    near[40] = "changed"
    return [
        None, "", "   \n\t ", "one", "One", "two words", "a b c d", "a b c d e", base, base, base.upper(), " ".join(near), long, "x" * 5000, "ha " * 600,
        "naïve café ÀÉ Σς 漢字 don't I'll 12,5 <|endoftext|> \x1c end", base[:700] + " " + long[:450] + " tail", long[100:900], "é" * 450 + " q", "w" + "é" * 450,
    ]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Documents with every odd case, columns with clashing names, a null id and a row that stands twice."""
    rows = []
    for i, text in enumerate([*edge_texts(), "the row that stands twice " * 30]):
        rows.append((i, text, ["en", "fr", None][i % 3], "s", 1, "w", 1, "k", 1, 1, 1, 0.5, "b", "s", "h", "d", 2, 3, 4, "h", "p", "r", "v", 5, 6, "t", 7, "s"))
    rows += [rows[-1], (None, "a row without an id", *rows[0][2:])]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
