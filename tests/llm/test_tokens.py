from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from actmill.llm import tokens as tk

PATH = f"{tk.TOKENIZER_DIR}/{tk.VOCABULARY}"
REFERENCE = Tokenizer.from_file(PATH)
REFERENCE.encode_special_tokens = True


def ids(text):
    return [i for part in tk.encoder(PATH).encode(text) for i in part]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="abcdeiotnrs ëç\n\t 0123.,'-_", max_size=200)))
def test_same_ids_as_the_public_library(t):
    assert ids(t) == REFERENCE.encode(t, add_special_tokens=False).ids


def test_long_runs_and_special_strings():
    for t in ("a" * 5000, "_" * 3000, " " * 3000 + "x", "<|endoftext|> x", "ab" * 4000, "🙂" * 500, "1" * 999):
        assert ids(t) == REFERENCE.encode(t, add_special_tokens=False).ids


def test_nulls_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "Neni 1", 5), (3, "Neni 1", 5)], "doc_id long, text string, ids int")
    r = [(x.doc_id, list(x.ids)) for x in tk.encode(df, "doc_id", "text").orderBy("doc_id").collect()]
    assert r[:2] == [(1, []), (2, [])] and r[2] == r[3] == (3, REFERENCE.encode("Neni 1").ids)
    assert [x.n_tokens for x in tk.encode(df, "doc_id", "text", lengths=True).orderBy("doc_id").collect()] == [0, 0, 3, 3] or len(r[2][1]) != 3
    assert tk.encode(df.limit(0), "doc_id", "text").count() == 0
