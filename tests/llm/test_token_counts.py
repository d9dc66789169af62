"""Token counts against greedy matching that builds its pieces."""

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import token_counts as tc


def greedy(pieces, word):
    at = n = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


SMALL = st.integers(0, 2)


@settings(max_examples=1500, deadline=None)
@given(st.sets(st.lists(SMALL, min_size=1, max_size=5).map(tuple), min_size=1, max_size=12), st.lists(SMALL, min_size=1, max_size=14).map(tuple))
def test_automaton_is_greedy(pieces, word):
    assert tc.Automaton(sorted(pieces)).count(word) == greedy(pieces, word)


PIECES = set(tc.read_pieces(tc.default_vocabulary()))
COUNT = tc.counter(tc.default_vocabulary())


def plain(text):
    total = 0
    for w in library_words(text or ""):
        total += greedy(PIECES, (*w, tc.END))
    return total


LIBRARY = Tokenizer.from_file(tc.default_vocabulary())
LETTERS = tc.byte_letters()


def library_words(text):
    """The tokenizer's own normaliser and pre-tokenizer, as bytes."""
    found = LIBRARY.pre_tokenizer.pre_tokenize_str(LIBRARY.normalizer.normalize_str(text))
    return [bytes(LETTERS[c] for c in w) for w, _ in found]


#: Libraries differ in the characters that the newest versions of Unicode assign.
ASSIGNED = st.characters(exclude_categories=("Cn", "Cs"))


@settings(max_examples=500, deadline=None)
@given(st.text(ASSIGNED, max_size=40) | st.text(alphabet="aeESsTtRrVvMmLlDdΣσİÉ\u0301\u0308'’ 0٣½.,\x1c\x85\u2003日", max_size=40))
def test_words_are_those_of_the_tokenizer(text):
    assert [w.encode() for part in text.split(" ") for w in tc.words(part)] == library_words(text)


def test_words_by_hand():
    assert tc.words("don't it's") == ["don", "'t", "it", "'s"]
    assert tc.words("École") == tc.words("E\u0301COLE") == ["école"]
    assert COUNT([b"don't", "École".encode(), b"it's"]) == [2, COUNT(["école".encode()])[0], 2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cn", "Cs")), max_size=40) | st.text(alphabet="abThe .,1é日\n", max_size=60), max_size=4))
def test_texts(texts):
    assert COUNT([t.encode() for t in texts]) == [plain(t) for t in texts]


def test_every_byte_is_covered():
    assert all((b,) in PIECES and (b, tc.END) in PIECES for b in range(256))


def test_query_and_odd_rows(spark, small, odd_docs, no_docs, clashing):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in tc.op3_token_counts(spark, small).collect()}
    assert len(got) == len(docs)
    assert all(got[i] == plain(docs[i]) for i in list(docs)[:40])
    assert all(r["__tc_tokens"] == plain(r["text"]) for r in tc.counted(odd_docs).collect() if len(r["text"] or "") < 5000)
    assert tc.counted(no_docs).count() == 0
    assert tc.counted(clashing).columns == [*clashing.columns, "__tc_tokens"]
