import pytest

from actmill.llm import truncation as tr
from actmill.llm.lines import ending

D = "doc_id long, source string, title string, word string"
A = "doc_id long, subject string"


@pytest.mark.parametrize(
    ("text", "state"),
    [
        ("Subjekti paguan tatimin.", "whole"), ("Subjekti paguan tat", "open"), ("Subjekti pagua [...]", "cut"), ("Subjekti pag…", "cut"), ("Fjalia mbaroi. [...]", "whole"),
        ("Sipas vendimit nr.", "cut"), ("në emër të Bora sh.p.k.", "whole"), ("në kuptim të shkronjës b)", "open"), ("mbaroi (shih edhe aneksin)", "whole"), ("Fund.\nb) vërtetimi i pagesës;", "whole"),
        ("Fund.\nShefi i zyrës Bora", "line"), ("kërkes�", "cut"), ("nga Ragshade\u0308z.", "whole"), ("(nr.", "cut"), ("", "empty"), ("  \n", "empty"), ("...", "empty"),
    ],
)
def test_endings(text, state):
    assert ending(text)[0] == state


def run(spark, chunks, docs=((1, "s", "Titulli i dokumentit të gjatë", "w"),)):
    c = spark.createDataFrame([(*r, "x") for r in chunks], "chunk_id string, doc_id long, text string, state string")
    return {r.chunk_id: (r.cut, r.place) for r in tr.truncated(c, spark.createDataFrame(list(docs), D), spark.createDataFrame([], A)).collect()}


def test_evidence(spark):
    sign = [(f"1:a:{i}", 1, f"Subjekti paguan tatimin e ardhurave.\nShefi i zyrës Bora{'b' * i}") for i in range(5)]
    rows = [*sign, ("x", 1, "Subjekti paguan tati"), ("x", 1, "Subjekti paguan tati"), ("y", 1, "Subjekti paguan tatimin"), ("z", 1, "Mbaroi.\nSubjekti i"), ("p", 1, "Mbaroi këtu.\n\nFaqe 12"), ("h", 1, "Mbaroi këtu.\nTitulli i dokumentit të"), ("n", 1, None), ("e", 1, ""), ("o", None, "Subjekti paguan tati")]
    got = run(spark, rows)
    assert got["x"] == (True, "word") and got["y"] == (True, "sentence") and got["z"][0]
    assert not any(got[k][0] for k in ("p", "h", "n", "e")) and not any(got[r[0]][0] for r in sign) and got["o"][0]


def test_empty(spark):
    assert run(spark, []) == {}


def test_without_the_trie_nothing_is_found(spark, monkeypatch):
    """The rows come from the trie: take it away, and all but texts at a field limit are gone."""
    data = [spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("chunks", "documents", "acts")]
    found = lambda: {r.chunk_id for r in tr.truncated(*data).filter("cut").collect()}
    want = found()
    nodes = tr.trie_nodes
    monkeypatch.setattr(tr, "trie_nodes", lambda v, a: nodes(v, a).limit(0))
    assert len(want) > 15 and len(found()) < 0.5 * len(want)


def test_trie(spark):
    v = spark.createDataFrame([("tatim", 4), ("tatime", 2), ("t", 1)], "word string, n long")
    a = spark.createDataFrame([("tat",), ("tatim",), ("zz",), ("tat",)], "word string")
    assert {tuple(r) for r in tr.trie_nodes(v, a).collect()} == {("tat", 0, 6), ("tatim", 4, 2)}


def test_copies_of_a_cut_text_do_not_make_its_last_line_recur(spark):
    copies = [(f"c{i}", i, "Afati i pagesës mbaroi.\nBrenda 48 muajve nga") for i in range(10)]
    sign = [(f"s{i}", 1, f"Subjekti {i} paguan tatimin nga data.\nShefi i zyrës Bora") for i in range(5)]
    got = run(spark, [*copies, *sign])
    assert all(got[k] == (True, "sentence") for k, *_ in copies) and not any(got[k][0] for k, *_ in sign)
