"""Token counts under a unigram vocabulary: Aho-Corasick matches, count-only Viterbi."""

from __future__ import annotations

from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.llm.common import returns

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Pre-tokens whose counts a worker remembers.
REMEMBERED = 200_000


class Vocabulary(NamedTuple):
    pieces: list[tuple[str, float]]
    byte_fallback: bool


def read_vocabulary(path: str) -> Vocabulary:
    """Pieces and scores of a sentencepiece model file, on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]
    names = {p for p, _ in pieces}
    return Vocabulary(pieces, all(f"<0x{b:02X}>" in names for b in range(256)))


class Counter:
    """Number of tokens of a text under a unigram model.

    The text gets a leading mark, spaces become marks, and it is cut before each mark;
    each part is segmented on its own.  All vocabulary matches of a part come from one
    Aho-Corasick scan.  The dynamic program keeps, per end position, the best score and
    the number of pieces that reaches it.  Tie rules: of equal scores the piece with the
    earlier start stays; an unknown character, allowed where no piece is that single
    character, scores the least score minus 10, and comes after the pieces that start
    with it.  An unknown character counts one token per UTF-8 byte if the vocabulary has
    all byte pieces, else a run of them counts one.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for piece, score in vocabulary.pieces:
            if piece:
                self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes = vocabulary.byte_fallback
        self.memory: dict[str, int] = {}

    def part(self, text: str) -> int:
        """Matches come by their end, the longest first, which is the one with the earliest start."""
        n = len(text)
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), bytearray(n + 1)
        end, top, pieces, single = 0, 0.0, 0, True
        for last, (length, score) in self.machine.iter(text):
            while end <= last:  # the end before is complete
                if not single:
                    top, pieces = self._unknown(text, end, top, pieces, best, count, unknown)
                best[end], count[end] = top, pieces
                end, top, pieces, single = end + 1, None, 0, False
            start = end - length
            s = best[start] + score
            if top is None or s > top:
                top, pieces = s, count[start] + 1
            if length == 1:
                single = True
        while True:
            if not single:
                top, pieces = self._unknown(text, end, top, pieces, best, count, unknown)
            best[end], count[end] = top, pieces
            if end == n:
                return pieces
            end, top, pieces, single = end + 1, None, 0, False

    def _unknown(self, text: str, end: int, top: float | None, pieces: int, best: list[float], count: list[int], unknown: bytearray) -> tuple[float, int]:
        """The best of an end whose last character is no piece: that of its matches, or the unknown character."""
        start = end - 1
        s = best[start] + self.unknown
        if top is not None and s <= top:
            return top, pieces
        unknown[end] = 1
        if self.bytes:
            return s, count[start] + len(text[start].encode())
        return s, count[start] + (0 if unknown[start] else 1)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, memory = 0, self.memory
        marked = text.replace(" ", SPACE)
        if not marked.startswith(SPACE):
            marked = SPACE + marked
        head, *parts = marked.split(SPACE)
        assert not head
        for p in parts:
            n = memory.get(p)
            if n is None:
                n = self.part(SPACE + p)
                if len(p) <= 64:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[p] = n
            total += n
        return total


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``n_tokens``) of every row.

    Edge cases: null and empty texts have 0 tokens; texts of any length are segmented
    whole; repeated rows are counted each; an empty table gives an empty table; other
    columns are ignored.  No shuffle; the vocabulary (tens of thousands of pieces) is
    broadcast.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        counter = Counter(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([counter.count(t.as_py()) for t in b.column(1)], pa.int64())], names=["id", "n_tokens"])

    return d.mapInArrow(run, returns("n_tokens bigint", id=d.schema["id"].dataType)).withColumnRenamed("id", id_col)
