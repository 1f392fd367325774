"""Token counts under a unigram vocabulary, by dynamic programming shared along a trie of pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from sitewise.llm.common import ship, shipped

MARK = "▁"  # fixed value: the sign that stands for the space before a word in public piece vocabularies
NODES = 400_000  # a task's trie is started anew beyond this many nodes
DEPTH = 64  # characters of a prefix that is kept in the trie


@dataclass(frozen=True)
class Unigram:
    """Pieces with their log probabilities. A character that no piece covers counts as one token per UTF-8 byte."""

    scores: dict[str, float]
    unknown: float
    longest: int = field(default=0)

    @staticmethod
    def from_pieces(pieces: list[str]) -> "Unigram":
        """Pieces in order of rank get Zipf probabilities, so no corpus and no training is needed."""
        ranked = dict.fromkeys(pieces)
        total = math.log(sum(1.0 / (r + 1) for r in range(len(ranked))))
        scores = {p: -math.log(r + 1) - total for r, p in enumerate(ranked)}
        return Unigram(scores, min(scores.values(), default=0.0) - 10.0, max(map(len, scores), default=0))

    @staticmethod
    def from_sentencepiece(path: str) -> "Unigram":
        """The pieces of a public SentencePiece file, best first; control and byte pieces aside."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        return Unigram.from_pieces([model.id_to_piece(i) for i in sorted(usable, key=lambda i: (-model.get_score(i), i))])


def backwards(model: Unigram) -> dict:
    """The pieces as a trie of nested dictionaries, last character first; the empty key holds a piece's score."""
    root: dict = {}
    for piece, score in model.scores.items():
        node = root
        for c in reversed(piece):
            node = node.setdefault(c, {})
        node[""] = score
    return root


class TrieCounter(dict):
    """Pre-token (bytes without its mark) -> tokens; a node of the trie is [children by character, score, count].

    The best way to write a prefix follows from the prefixes before it, so a node is scored once,
    when it is first reached, for all pre-tokens that begin with it; a pre-token's own count stays
    where it ends. A new node looks for pieces that end at its character by walking back through
    the pieces' trie until no piece goes on. Of equal scores the longest last piece wins.
    """

    def __init__(self, unknown: float, pieces: dict) -> None:
        super().__init__()
        self.unknown, self.pieces = unknown, pieces
        self.clear_nodes()

    def clear_nodes(self) -> None:
        self.clear()
        self.root: list = [{}, 0.0, 0]
        self.size = 1

    def __missing__(self, raw: bytes) -> int:
        """Walk down to the deepest prefix that is known and score onward from there."""
        if self.size > NODES or len(self) > NODES:
            self.clear_nodes()
        token = MARK + raw.decode("utf-8", "surrogatepass")
        node = self.root
        path = [node]
        for at, c in enumerate(token):
            child = node[0].get(c)
            if child is None:
                single = len(c.encode("utf-8", "surrogatepass"))
                best, count = path[at][1] + self.unknown * single, path[at][2] + single
                piece, start = self.pieces.get(c), at
                while piece is not None:
                    score = piece.get("")
                    if score is not None and path[start][1] + score >= best:
                        best, count = path[start][1] + score, path[start][2] + 1
                    start -= 1
                    piece = piece.get(token[start]) if start >= 0 else None
                child = [{}, best, count]
                if at < DEPTH:
                    node[0][c] = child
                    self.size += 1
            path.append(child)
            node = child
        if len(token) <= DEPTH:
            self[raw] = node[2]
        return node[2]


def token_counts(docs: DataFrame, model: Unigram, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_pretokens, n_tokens.

    A pre-token is a word (no ASCII white space) with the mark before it. Null, empty and blank
    texts have none. Every batch of a task shares the task's trie, which is started anew when it
    has NODES nodes, so memory is bounded; prefixes beyond DEPTH characters aren't shared. Nothing is
    shuffled, repeated rows and null ids stay, other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = ship(docs.sparkSession, (model.unknown, model.scores))  # one vocabulary, about 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unknown, scores = shipped(shared)
        counter = TrieCounter(unknown, backwards(Unigram(scores, unknown)))
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                n_words.append(len(raw))
                n_tokens.append(sum(map(counter.__getitem__, raw)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], [id_col, "n_pretokens", "n_tokens"]
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_pretokens long, n_tokens long")
