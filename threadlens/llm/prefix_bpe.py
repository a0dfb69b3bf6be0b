"""Byte-level BPE by prefix dynamic programming.

Among all tokens that end at a place of a byte string exactly one can be the last token of that prefix's encoding: the
one whose left neighbour, the last token of the prefix before it, stays its neighbour when both are encoded together.
A table with this token for each prefix holds the encodings of all prefixes; bytes are appended by going on with it, and
after an edit only the places near the edit are done anew.
"""

from __future__ import annotations

import array
import base64
import functools
import itertools
import os

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from threadlens.llm.alignment import TokenBytes
from threadlens.llm.common import append_columns, fresh

#: Bytes of pieces and their ids, about, that a worker remembers (so many a piece and 8 an id), and number of token pairs.
MEMORY_BYTES = 96 << 20
PIECE_BYTES = 250
MEMORY_PAIRS = 1 << 20
#: Longer pieces are encoded but not remembered.
LONGEST_REMEMBERED = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def merge_bytes(data: bytes, ranks: dict[bytes, int]) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
    """The definition: while neighbours together are a token, the lowest ranked ones (the leftmost of equals) become
    one. Returns the parts and the last pair joined."""
    parts, last = [data[i:i + 1] for i in range(len(data))], None
    while len(parts) > 1:
        found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        if not found:
            break
        i = min(found)[1]
        last = (parts[i], parts[i + 1])
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts, last


class Pieces(dict):
    """Ids of the pieces seen, bounded by their bytes; a piece that is not there is encoded."""

    def __init__(self, encode):
        self.encode, self.held = encode, 0

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.encode(piece)
        if len(piece) <= LONGEST_REMEMBERED:
            size = PIECE_BYTES + 8 * len(ids)
            self.held += size
            if self.held > MEMORY_BYTES:
                self.clear()
                self.held = size
            self[piece] = ids
        return ids


class PrefixBPE:
    """Tokens of a vocabulary, which of them may stand side by side, and where they occur in a byte string."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.bytes = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.pairs: dict[int, bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.pieces = Pieces(self.encode_piece)

    @functools.cached_property
    def table(self) -> TokenBytes:
        return TokenBytes([self.bytes.get(i, b"") for i in range(max(self.bytes, default=-1) + 1)])

    @functools.cached_property
    def halves(self) -> dict[int, tuple[int, int] | None]:
        """The two tokens that each token is joined from last. Tokens that merging never builds have no entry; they
        stand only for a whole piece."""
        out: dict[int, tuple[int, int] | None] = {}
        for token, i in self.ranks.items():
            parts, last = merge_bytes(token, self.ranks)
            if len(parts) == 1:
                out[i] = last and (self.ranks[last[0]], self.ranks[last[1]])
        return out

    @functools.cached_property
    def ordered(self) -> bool:
        """Whether every token ranks behind the tokens it is joined from."""
        return all(h is None or all(len(self.bytes[x]) == 1 or x < i for x in h) for i, h in self.halves.items())

    @functools.cached_property
    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for i in self.halves:
            out.add_word(self.bytes[i].decode("latin-1"), (len(self.bytes[i]), i))
        out.make_automaton()
        return out

    def spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """(bytes, rank of the token they are joined into) down the given side of a token's merges."""
        known = self.spines[side].get(token)
        if known is None:
            known, at, above = [], token, 1 << 62
            while True:
                known.append((self.bytes[at], above))
                if self.halves[at] is None:
                    break
                above, at = at, self.halves[at][side]
            self.spines[side][token] = known
        return known

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether two tokens side by side are what their bytes together are encoded as: no token over their border
        ranks before those that take its two sides away."""
        if not self.ordered:
            return merge_bytes(self.bytes[left] + self.bytes[right], self.ranks)[0] == [self.bytes[left], self.bytes[right]]
        rank, heads = self.ranks.get, self.spine(right, 0)
        for x, x_above in self.spine(left, 1):
            for y, y_above in heads:
                joined = rank(x + y)
                if joined is not None and joined < x_above and joined <= y_above:
                    return False
        return True

    def extend(self, data: bytes, last: list[int], stop=None) -> None:
        """Goes on with the last tokens of the prefixes of data, until its end or until stop(end, token) is true."""
        done = len(last) - 1
        from_ = max(0, done - self.longest + 1)
        pairs, known = self.pairs, self.pairs.get
        for at, (size, token) in self.automaton.iter(data[from_:].decode("latin-1") if from_ else data.decode("latin-1")):
            end = from_ + at + 1
            if end <= done:
                continue
            if end > done + 1:
                break
            before = last[end - size]
            if before >= 0:
                pair = before << 32 | token
                apart = known(pair)
                if apart is None:
                    if len(pairs) >= MEMORY_PAIRS:
                        pairs.clear()
                    apart = pairs[pair] = self.stay_apart(before, token)
                if not apart:
                    continue
            last.append(token)
            done = end
            if stop is not None and stop(end, token):
                return
        if done < len(data):
            raise ValueError(f"byte {data[done]} is no token")

    def backward(self, last: list[int], end: int) -> list[int]:
        """The encoding of the prefix up to end."""
        out = []
        while end:
            out.append(last[end])
            end -= len(self.bytes[last[end]])
        return out[::-1]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one match of the pattern. A piece that is a token is that token."""
        raw = piece.encode("utf-8")
        whole = self.ranks.get(raw)
        if whole is not None:
            return (whole,)
        last = [-1]
        self.extend(raw, last)
        return tuple(self.backward(last, len(raw)))

    def encode(self, text: str) -> list[int]:
        return list(itertools.chain.from_iterable(map(self.pieces.__getitem__, self.pattern.findall(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class PrefixTable:
    """The last token of the encoding of each prefix of a byte string."""

    def __init__(self, model: PrefixBPE, data: bytes = b""):
        self.model, self.data, self.last = model, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        """Bytes behind the last one; nothing before is done anew."""
        self.data += data
        self.model.extend(self.data, self.last)

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Put new for the bytes from start to end; returns how many places were done anew. Behind the edit, work stops
        when as many places in a row as the longest token has bytes are as before."""
        old, shift, behind, same = self.last, len(new) - (end - start), start + len(new), 0

        def settled(at: int, token: int) -> bool:
            nonlocal same
            same = same + 1 if at > behind and old[at - shift] == token else 0
            return same >= self.model.longest

        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[:start + 1]
        self.model.extend(self.data, self.last, settled)
        done = len(self.last) - 1 - start
        self.last.extend(old[len(self.last) - shift:])
        return done

    def ids(self, end: int | None = None) -> list[int]:
        """Ids of the prefix up to end, all bytes by default."""
        return self.model.backward(self.last, len(self.data) if end is None else end)


class TextEncoding:
    """Ids of a text that is appended to and edited."""

    def __init__(self, model: PrefixBPE, text: str = ""):
        self.model, self.text = model, ""
        self.starts: list[int] = []
        self.tables: list[PrefixTable] = []
        self.replace(0, 0, text)

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put new for the characters from start to end. Pieces are split anew from the first one whose match may have
        looked at the edit (a match looks at most two characters behind itself), until a split falls on an old one."""
        shift = len(new) - (end - start)
        ends = [*self.starts[1:], len(self.text)][:len(self.starts)]
        first = next((i for i, e in enumerate(ends) if e + 2 > start), len(ends))
        text = self.text[:start] + new + self.text[end:]
        at = self.starts[first] if first < len(ends) else len(self.text)
        old = {s + shift: i for i, s in enumerate(self.starts) if s >= end}
        starts, tables, rest = self.starts[:first], self.tables[:first], len(ends)
        spare = self.tables[first:]
        for m in self.model.pattern.finditer(text, at):
            if m.start() >= start + len(new) and m.start() in old:
                rest = old[m.start()]
                break
            raw = m.group().encode("utf-8")
            table = spare.pop(0) if spare else PrefixTable(self.model)
            head = len(os.path.commonprefix([raw, table.data]))
            tail = len(os.path.commonprefix([raw[head:][::-1], table.data[head:][::-1]]))
            table.edit(head, len(table.data) - tail, raw[head:len(raw) - tail])
            starts.append(m.start())
            tables.append(table)
        kept = self.tables[rest:]
        # a table taken for another piece is no longer that of its old piece
        taken = {id(t) for t in tables}
        kept = [t if id(t) not in taken else PrefixTable(self.model, self._old_piece(rest + i)) for i, t in enumerate(kept)]
        self.starts = starts + [s + shift for s in self.starts[rest:]]
        self.tables = tables + kept
        self.text = text

    def _old_piece(self, i: int) -> bytes:
        end = self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text)
        return self.text[self.starts[i]:end].encode("utf-8")

    def ids(self) -> list[int]:
        out: list[int] = []
        for table in self.tables:
            whole = self.model.ranks.get(table.data)
            out.extend((whole,) if whole is not None else table.ids())
        return out


@functools.lru_cache(maxsize=2)
def load(path: str, pattern: str) -> PrefixBPE:
    """The model of a file, kept by a worker over its tasks."""
    return PrefixBPE(read_ranks(path), pattern)


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """All columns of docs, then token_ids, an array of int: the ids of the whole text by the ranks of a .tiktoken file,
    each match of the pattern encoded by itself, without special tokens (their strings are ordinary text).

    Null and empty texts have the empty array. Texts of any length are taken whole; time grows with the length, also
    inside a piece without a blank. Repeated rows and ids, null ids or none make no difference: each row is encoded by
    its text alone. An empty table gives an empty result. A name that docs has already gets a leading underscore.
    """

    def run(texts: pa.Array) -> list[pa.Array]:
        model = load(ranks_path, pattern)
        offsets, values = [0], array.array("i")
        for text in texts:
            values.extend(model.encode(text.as_py() or ""))
            offsets.append(len(values))
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(values, np.int32), pa.int32()))]

    return append_columns(docs, [text_col], [(fresh(docs, "token_ids"), T.ArrayType(T.IntegerType()))], run)


def decode_ids(docs: DataFrame, ranks_path: str, pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """All columns of docs, then token_bytes, a binary: the bytes of the ids one after another. A null or empty array
    gives no bytes; an id that the file does not have is an error. Names as in ``encode_texts``."""

    def run(ids: pa.Array) -> list[pa.Array]:
        table = load(ranks_path, pattern).table
        out = []
        for row in ids:
            own = row.values.to_numpy() if row.is_valid else np.zeros(0, np.int32)
            if len(own) and (own.min() < 0 or own.max() >= len(table.width) or not table.width[own].all()):
                raise ValueError("an id that the file does not have")
            out.append(table.joined(own).tobytes())
        return [pa.array(out, pa.binary())]

    return append_columns(docs, [ids_col], [(fresh(docs, "token_bytes"), T.BinaryType())], run)
