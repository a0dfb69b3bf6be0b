"""Token ids of whole texts, each distinct word of a batch encoded once."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLANK = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A space beside another blank, or at an end.
ODD_SPACE = rf" {_BLANK}|{_BLANK} |^ | $"
#: How byte-level vocabularies split a text, and which bytes they write as themselves.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_of_char() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: plain bytes stand for themselves, the others, in
    order, for the code points from 256."""
    plain = set(PLAIN_BYTES)
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in PLAIN_BYTES} | {chr(256 + i): b for i, b in enumerate(rest)}


def fast_encoder(file: dict):
    """An encoder of ordinary text with the ids of a byte-level BPE file whose merges stand in the order of their ids;
    None for other files."""
    model = file["model"]
    plain = (file["normalizer"] is None and file["post_processor"] is None and model["type"] == "BPE"
             and not model.get("ignore_merges") and not model.get("dropout"))
    if not plain or file["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True,
                                              "use_regex": True}:
        return None
    vocab = model["vocab"]
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if any(vocab[b] <= vocab[a] for a, b in zip(merged, merged[1:])):  # noqa: B905
        return None
    import tiktoken

    of = byte_of_char()
    special = {t["content"] for t in file["added_tokens"]}
    ranks = {bytes(of[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


class BatchEncoder:
    """Ids of a byte-level BPE file, as its library gives them, for batches of texts.

    The file's splitting rule never lets a piece reach over a single space between two other characters. So a text is
    cut there, each part (with the space before it) is encoded once per batch, and the ids of the texts are gathered
    from those of the parts. Texts in which a space touches another blank, and files of another kind, are encoded
    whole.
    """

    def __init__(self, path: str, slice_bytes: int = 4 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.fast = fast_encoder(file)
        self.special = [t["content"] for t in file["added_tokens"]]
        self.slice_bytes = slice_bytes
        if self.fast is not None:
            self.width = np.zeros(max(self.fast._mergeable_ranks.values()) + 1, np.int64)
            for token, i in self.fast._mergeable_ranks.items():
                self.width[i] = len(token)

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text, encoded whole."""
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)

    def batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; null counts as empty."""
        texts = texts.fill_null("")
        sizes = pc.binary_length(texts).to_numpy()
        start = 0
        for stop in range(1, len(texts) + 1):
            if stop == len(texts) or sizes[start:stop + 1].sum() > self.slice_bytes:
                yield from self._slice(texts.slice(start, stop - start))
                start = stop

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        alone = pc.or_(pc.match_substring_regex(texts, ODD_SPACE), pc.equal(texts, ""))
        for s in self.special:
            alone = pc.or_(alone, pc.match_substring(texts, s))
        alone = np.ones(len(texts), bool) if self.fast is None else alone.to_numpy(zero_copy_only=False)
        cut = texts.filter(pa.array(~alone))
        gathered = iter(self._gather(cut)) if len(cut) else iter(())
        for i, whole in enumerate(alone):
            yield self.encode(texts[i].as_py()) if whole else next(gathered)

    def _gather(self, texts: pa.Array) -> list[np.ndarray]:
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        at, words = coded.indices.to_numpy().copy(), coded.dictionary
        heads = np.unique(at[offsets[:-1]])
        ids = np.array(self.fast.encode_ordinary(" " + " ".join(words.to_pylist())), np.uint32)
        ends = np.cumsum(self.width[ids])
        first = np.zeros(len(words) + 1, np.int64)
        first[1:] = np.searchsorted(ends, np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)) + 1
        # the first part of a text has no space before it, so it gets ids of its own
        extra = [self.fast.encode_ordinary(words[int(h)].as_py()) for h in heads]
        extra_ends = np.cumsum([len(x) for x in extra]) + len(ids)
        ids = np.concatenate([ids, np.fromiter(itertools.chain.from_iterable(extra), np.uint32)])
        first = np.concatenate([first, extra_ends])
        at[offsets[:-1]] = len(words) + np.searchsorted(heads, at[offsets[:-1]])
        start, size = first[at].astype(np.int32), np.diff(first)[at].astype(np.int32)
        upto = np.cumsum(size, dtype=np.int64)
        where = np.repeat(start - (upto - size).astype(np.int32), size) + np.arange(upto[-1], dtype=np.int32)
        return np.split(ids[where], upto[offsets[1:-1] - 1])
