"""Token counts of a unigram tokenizer without tokens.

An Aho-Corasick automaton lists every vocabulary entry in a word; dynamic programming over the places of the word
carries the best score and the number of pieces on the best path, and nothing else. Ties go as in the tokenizer: of
equal scores the longest last piece stays, and an unknown character only where nothing as good ends there.
"""

from __future__ import annotations

import json

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from threadlens.llm.common import append_columns, fresh
from threadlens.llm.quality import slices, sums_by_text

#: Stands for a space, and before the first word.
MARK = "▁"
#: An unknown character scores this much less than the lowest piece.
UNKNOWN_PENALTY = 10.0
#: Characters of words whose counts are remembered by a task; a word counts for at least WORD_CHARS, and longer ones than
#: LONGEST_REMEMBERED are counted anew.
MEMORY_CHARS = 32 << 20
WORD_CHARS = 32
LONGEST_REMEMBERED = 1024


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], int | None, bool]:
    """(pieces with scores, number of the unknown piece, byte fallback) of a unigram tokenizer file (.json), or of the
    pieces and scores of a .model file."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return [(p, float(s)) for p, s in model["vocab"]], model.get("unk_id"), bool(model.get("byte_fallback"))
    import sentencepiece

    file = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(file.id_to_piece(i), float(file.get_score(i))) for i in range(file.get_piece_size())]
    return pieces, file.unk_id(), any(file.is_byte(i) for i in range(len(pieces)))


class UnigramCounter:
    """Number of pieces on the best path of a word."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool):
        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(vocabulary).items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.held = 0  # characters of the words remembered
        held = {p for p, _ in vocabulary}
        #: bytes that have a piece; a character with another byte stays one unknown piece
        self.bytes = {b for b in range(256) if f"<0x{b:02X}>" in held} if byte_fallback else set()

    def count(self, word: str) -> int:
        n = len(word)
        best: list[float] = [0.0] * (n + 1)
        # pieces in words: those that are closed, and the characters of an unknown run at the end
        pieces: list[int] = [0] * (n + 1)
        run: list[int] = [-1] * (n + 1)
        # bytes of the run that is open at a place, and whether all of them have pieces
        size_of: list[int] = [0] * (n + 1)
        known: list[bool] = [True] * (n + 1)
        matches = self.automaton.iter(word)
        ahead = next(matches, None)
        for end in range(1, n + 1):
            score, count, since, single = None, 0, -1, False
            while ahead is not None and ahead[0] == end - 1:
                size, value = ahead[1]
                start = end - size
                now = best[start] + value
                if score is None or now > score:
                    score, count, since = now, pieces[start] + 1, -1
                single = single or size == 1
                ahead = next(matches, None)
            if not single:
                now = best[end - 1] + self.unknown
                if score is None or now > score:
                    open_run = run[end - 1]
                    since = open_run if open_run >= 0 else end - 1
                    # a run of unknown characters is one thing: its pieces follow from what was carried along
                    raw = word[end - 1].encode("utf-8", "surrogatepass")
                    size_of[end] = (size_of[end - 1] if open_run >= 0 else 0) + len(raw)
                    known[end] = (known[end - 1] or open_run < 0) and self.bytes.issuperset(raw)
                    score, count = now, pieces[since] + (size_of[end] if self.bytes and known[end] else 1)
            best[end], pieces[end], run[end] = score, count, since
        return pieces[n]


def count_tokens(docs: DataFrame, vocabulary_path: str, text_col: str = "text") -> DataFrame:
    """All columns of docs, then n_tokens: pieces of the whole text by the vocabulary file.

    A text is cut before every space, which stands as a mark before the word behind it; a mark is put before the first
    word as well. Words are counted apart, once per batch. Texts are taken whole; time grows with the length, also where no
    character has a piece. Repeated rows are counted each. Null and empty texts have 0 pieces. An empty table gives an
    empty result. A name that docs has already gets a leading underscore.
    """
    state: dict = {}
    memory: dict[str, int] = {}

    def run(texts: pa.Array) -> list[pa.Array]:
        if not state:
            vocabulary, _, fallback = read_vocabulary(vocabulary_path)
            state["counter"] = UnigramCounter(vocabulary, fallback)
        return [pa.array(np.concatenate([_counts(p, state["counter"], memory) for p in slices(texts.fill_null(""))])
                         if len(texts) else np.zeros(0, np.int64), pa.int64())]

    return append_columns(docs, [text_col], [(fresh(docs, "n_tokens"), T.LongType())], run)


def _counts(texts: pa.Array, counter: UnigramCounter, memory: dict[str, int]) -> np.ndarray:
    marked = pc.replace_substring(texts, " ", MARK)
    first = pc.if_else(pc.starts_with(marked, MARK), marked, pc.binary_join_element_wise(MARK, marked, ""))
    parts = pc.split_pattern(first, MARK)
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    known = memory.get
    table = np.zeros(len(words), np.int64)
    for i, word in enumerate(words):
        n = known(word)
        if n is None:
            n = counter.count(MARK + word)
            if len(word) <= LONGEST_REMEMBERED:
                counter.held += max(WORD_CHARS, len(word))
                if counter.held > MEMORY_CHARS:
                    memory.clear()
                    counter.held = max(WORD_CHARS, len(word))
                memory[word] = n
        table[i] = n
    offsets = parts.offsets.to_numpy().astype(np.int64)
    value = table[coded.indices.to_numpy()]
    # what stands before the first mark is the empty text
    value[offsets[:-1]] = 0
    out = sums_by_text(value, offsets).astype(np.int64)
    out[pc.equal(texts, "").to_numpy(zero_copy_only=False)] = 0
    return out
