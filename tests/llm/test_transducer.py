import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fixturelake.llm.transducer import PATTERN, VOCABULARY, Encoder, Lexicon, compile_lexicon, encode_texts, merge, ranks_of

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
HARD = ["", " ", "a" * 3000, " " * 2000 + "x", "\r\n\t  　", "it's we'll I'M", "😀🏀 ağırlığı ŞIRNAK", "<|endoftext|>", "12345678901234567890", "=-" * 500, "́é", "日本語 текст"]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks_of(VOCABULARY), special_tokens={})


@given(st.sets(st.binary(min_size=1, max_size=6), max_size=40), st.binary(max_size=6))
@settings(max_examples=100, deadline=None)
def test_transducer_holds_exactly_its_words(words, other):
    ranks = ranks_of(VOCABULARY)
    lex = Lexicon(compile_lexicon(sorted(words), ranks))
    asked = sorted(words) + [other]
    assert lex.find(asked) == [merge(w, ranks) if w in words else None for w in asked]


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_same_ids_as_the_library(text):
    import tiktoken

    text = text.encode("utf-8", "ignore").decode()
    ref = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks_of(VOCABULARY), special_tokens={})
    assert list(Encoder(Lexicon(compile_lexicon([b" the", b"the"], ranks_of(VOCABULARY))), ranks_of(VOCABULARY)).encode(text)) == ref.encode_ordinary(text)


def test_hard_texts(reference):
    e = Encoder(Lexicon(compile_lexicon([], {})), ranks_of(VOCABULARY))
    for t in HARD:
        assert list(e.encode(t)) == reference.encode_ordinary(t)


def test_in_a_table(rows, reference):
    df = rows("doc_id long, text string, ids string", *({"doc_id": i, "text": t} for i, t in enumerate(HARD * 3)), {"doc_id": 900})
    got = {r.doc_id: r.ids for r in encode_texts(df, "doc_id", "text").collect()}
    assert got == {i: reference.encode_ordinary(t) for i, t in enumerate(HARD * 3)} | {900: []}
    assert encode_texts(df.limit(0), "doc_id", "text").count() == 0
