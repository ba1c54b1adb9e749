"""Token counts by a linear longest-match automaton.

Greedy longest-match-first word pieces ("Fast WordPiece Tokenization", 2021):
the vocabulary's trie gets failure links, and with each link the number of
pieces that a match takes off when it follows the link. A word is read once,
character by character, and only counts are added up; no piece is ever built.

Where no piece begins with a character, it counts as its bytes in UTF-8, as
vocabularies with a piece for each byte have it; or else the whole word counts
as one token.

Defined cases: null and empty texts, and texts of white space, have no words
and no tokens.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class LongestMatch:
    """The automaton. Node 0 is the root; -1 stands for no link. With `bytes_`,
    a character that no piece is made of counts as its bytes."""

    def __init__(self, pieces: Iterable[str], bytes_: bool = False):
        self.go: list[dict[str, int]] = [{}]
        self.bytes = bytes_
        worth = [0]  # tokens that a node's string makes, 0 if it is no piece
        for piece in pieces:
            node = 0
            for c in piece:
                to = self.go[node].get(c)
                if to is None:
                    to = self.go[node][c] = len(self.go)
                    self.go.append({})
                    worth.append(0)
                node = to
            worth[node] = 1 if node else 0
        if bytes_:
            for c, to in self.go[0].items():
                worth[to] = worth[to] or len(c.encode("utf-8", "surrogatepass"))
        self.link, self.taken = [-1] * len(self.go), [0] * len(self.go)
        level = [0]
        while level:
            below = []
            for node in level:
                for c, to in self.go[node].items():
                    below.append(to)
                    if worth[to]:
                        self.link[to], self.taken[to] = 0, worth[to]
                        continue
                    at, n = self.link[node], self.taken[node]
                    while at >= 0 and c not in self.go[at]:
                        n += self.taken[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[to], self.taken[to] = self.go[at][c], n
                    elif bytes_:
                        self.link[to], self.taken[to] = 0, n + len(c.encode("utf-8", "surrogatepass"))
            level = below

    def count(self, word: str) -> int:
        """The number of tokens; without bytes, 1 if the word can't be spelled."""
        go, link, taken, node, n = self.go, self.link, self.taken, 0, 0
        for c in word:
            while (to := go[node].get(c)) is None:
                n += taken[node]
                node = link[node]
                if node < 0:
                    if not self.bytes:
                        return 1
                    n += len(c.encode("utf-8", "surrogatepass"))
                    to = 0
                    break
            node = to
        while node > 0:
            n += taken[node]
            node = link[node]
        return n if node == 0 else 1


class Counts(dict):
    """Word -> tokens, filled as words occur; bounded in entries and length."""

    def __init__(self, match: LongestMatch, mark: str, most: int = 300_000):
        super().__init__()
        self.match, self.mark, self.most = match, mark, most

    def __missing__(self, word: str) -> int:
        n = self.match.count(self.mark + word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = n
        return n


#: One worker's last vocabulary: its digest and the counts of words so far.
_built: dict[str, Counts] = {}


def built(key: str, pieces: list[str], mark: str, bytes_: bool) -> Counts:
    """The worker's own counts, made anew when the vocabulary changes."""
    if key not in _built:
        _built.clear()
        _built[key] = Counts(LongestMatch(pieces, bytes_), mark)
    return _built[key]


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def counter(spark: SparkSession, pieces: list[str], mark: str = "▁", bytes_: bool = True) -> Callable[[str], Column]:
    """A function from a text column to struct(n_words, n_tokens). Words stand
    between white space and are matched with `mark` before them. The vocabulary
    is broadcast once; it doesn't grow with the data."""
    shared = spark.sparkContext.broadcast(pieces)
    key = hashlib.sha256(repr((mark, bytes_, pieces)).encode("utf-8", "surrogatepass")).hexdigest()

    @F.arrow_udf("n_words bigint, n_tokens bigint")
    def counted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tallymark.llm import token_counts as worker  # its own module, so that what is built outlives the task

        look = worker.built(key, shared.value, mark, bytes_).__getitem__
        for column in columns:
            words, tokens = [], []
            for text in column:
                found = (text.as_py() or "").split()
                words.append(len(found))
                tokens.append(sum(map(look, found)))
            yield pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["n_words", "n_tokens"])

    return counted


def count_tokens(docs: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text", mark: str = "▁", bytes_: bool = True) -> DataFrame:
    """id, n_words, n_tokens for every row. No shuffle."""
    found = docs.select(F.col(id_col), counter(docs.sparkSession, pieces, mark, bytes_)(text_col).alias("found"))
    return found.select(id_col, "found.n_words", "found.n_tokens")
