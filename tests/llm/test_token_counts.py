from hypothesis import given, settings
from hypothesis import strategies as st

from tallymark.llm.queries import PIECES, op1_token_counts
from tallymark.llm.token_counts import Counts, LongestMatch, _built, built, count_tokens, read_pieces

SMALL = "/root/testdata/sf0.001"


def greedy(pieces: set[str], word: str, bytes_: bool = True) -> int:
    """Longest match first, by trying every length."""
    at = n = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None and not bytes_:
            return 1
        n += 1 if end else len(word[at].encode())
        at = end or at + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abcé", min_size=1, max_size=5), max_size=12), st.lists(st.text("abcdé€", max_size=14), max_size=8), st.booleans())
def test_counts_equal_greedy_matching(pieces, words, bytes_):
    match = LongestMatch(pieces, bytes_)
    assert [match.count(w) for w in words] == [greedy(pieces, w, bytes_) if w else 0 for w in words]


def test_workers_keep_one_vocabulary():
    first = built("a", ["▁", "x"], "▁", False)
    assert built("a", [], "▁", False) is first and built("b", ["▁"], "▁", False) is not first and list(_built) == ["b"]


def test_the_memory_of_words_is_bounded():
    counts = Counts(LongestMatch(["▁a", "b"]), "▁", most=3)
    assert [counts["a" + "b" * n] for n in range(9)] == list(range(1, 10)) and len(counts) <= 3
    assert counts["a" + "b" * 99] == 100 and len(counts) <= 3


def test_whole_table_against_brute_force(spark):
    pieces = set(read_pieces(PIECES))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = {r.doc_id: (r.n_words, r.n_tokens) for r in op1_token_counts(spark, SMALL).collect()}
    assert found.keys() == docs.keys()
    known = {}
    for doc_id, text in docs.items():
        words = text.split()
        for w in words:
            if w not in known:
                known[w] = greedy(pieces, "▁" + w)
        assert found[doc_id] == (len(words), sum(known[w] for w in words))


def test_edge_cases(spark):
    rows = [(1, None, 0), (None, "", 0), (3, " \n\t", 0), (4, "ab ab zz", 9), (4, "ab ab zz", 9), (5, "ab" * 50_000, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    out = count_tokens(df, ["▁", "▁ab", "ab", "a"])
    assert out.columns == ["doc_id", "n_words", "n_tokens"]
    found = sorted(((r.doc_id or 0), r.n_words, r.n_tokens) for r in out.collect())
    assert found == [(0, 0, 0), (1, 0, 0), (3, 0, 0), (4, 3, 5), (4, 3, 5), (5, 1, 50_000)]  # ▁ z z of bytes
    assert count_tokens(df.limit(0), ["a"]).count() == 0
