import itertools
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from threadlens.llm import alignment as al
from threadlens.llm import prefix_bpe as pb

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [(None, None, "x"), (1, "", "x"), (2, " ", None), (3, "the end " * 40000, "x"), (3, "the end " * 40000, "x"), (4, "a" * 20000, "x"),
       (5, "<|endoftext|> <s></s> <0x41>", "x"), (6, "two▁words", "x"), (7, "　a  b\n\nc d \x00 e ", "x"), (None, "again", "x")]


@pytest.fixture(scope="module")
def model():
    return pb.load(MULTI, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(model):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=model.ranks, special_tokens={})


def mixed(rng, n):
    return "".join(rng.choices("abcdehilnorst   '.,\n\t12日é🙂 ", k=rng.randrange(n)))


@pytest.mark.parametrize("seed", range(12))
def test_prefixes_equal_merging_for_any_ranks(seed):
    rng = random.Random(seed)
    ranks = {bytes([c]): i for i, c in enumerate(b"abc")}
    while len(ranks) < 40:
        token = "".join(rng.choices("abc", k=rng.randrange(2, 6))).encode()
        ranks.setdefault(token, len(ranks))
    trained = pb.PrefixBPE(ranks, ".+")
    for _ in range(40):
        data = bytes(rng.choices(b"abc", k=rng.randrange(1, 30)))
        table = pb.PrefixTable(trained, data)
        for end in range(len(data) + 1):
            assert [trained.bytes[i] for i in table.ids(end)] == pb.merge_bytes(data[:end], ranks)[0]


def test_ids_equal_the_library(model, library):
    rng = random.Random(3)
    for text in [mixed(rng, 200) for _ in range(400)] + ["", "a" * 3000, " " * 3000 + "x", "it's <|endoftext|>"]:
        assert model.encode(text) == library.encode_ordinary(text)
        assert model.decode(model.encode(text)) == text.encode()


def test_edits_and_appends_are_exact_and_local(model, library):
    for seed in range(60):
        rng = random.Random(seed)
        text = pb.TextEncoding(model, mixed(rng, 80))
        for _ in range(6):
            start = rng.randrange(len(text.text) + 1)
            text.replace(start, rng.randrange(start, len(text.text) + 1), mixed(rng, 12))
            text.append(mixed(rng, 4))
            assert text.ids() == library.encode_ordinary(text.text)
    table = pb.PrefixTable(model, b"abcdefgh" * 5000)
    assert table.edit(20000, 20002, b"xyz") < 200
    assert table.ids() == pb.PrefixTable(model, table.data).ids()
    with pytest.raises(ValueError):
        pb.PrefixTable(pb.PrefixBPE({b"a": 0}, ".+"), b"ab")


def test_encode_and_decode_frames(spark, library):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, token_ids string")
    out = pb.decode_ids(pb.encode_texts(docs, MULTI, public_tokenizers.PATTERN), MULTI, public_tokenizers.PATTERN, "_token_ids")
    assert out.columns == ["doc_id", "text", "token_ids", "_token_ids", "token_bytes"]
    rows = out.collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r["_token_ids"] == library.encode_ordinary(r.text or "") and bytes(r.token_bytes) == (r.text or "").encode()
    assert pb.encode_texts(docs.limit(0), MULTI, public_tokenizers.PATTERN).count() == 0


def brute_alignment(texts):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    table, pieces = al.load(A, B).a_table, al.load(A, B).b_table
    each, docs_with = [], Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        ids = [a.encode(raw.decode(), add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
        spans = []
        for side, of in zip(ids, (table, pieces), strict=True):
            ends = list(itertools.accumulate(len(of[i]) for i in side))
            spans.append([(e - len(of[i]), e, i) for e, i in zip(ends, side, strict=True)])
        if not text or any(b"".join(of[i] for i in side) != raw for side, of in zip(ids, (table, pieces), strict=True)):
            each.append(([], [], [], []))
            continue
        links, j = [], 0
        for s, e, x in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((x, spans[1][k][2]))
                k += 1
        both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [[[], []] for _ in both]
        for side in (0, 1):
            at = 0
            for _, e, i in spans[side]:
                groups[at][side].append(str(i))
                at += e == both[at]
        each.append((spans[0], spans[1], groups, links))
        docs_with.update(set(links))
    best = defaultdict(int)
    for (x, _), n in docs_with.items():
        best[x] = max(best[x], n)
    return [(len(p), len(q), len(g), len(k), sum(docs_with[x] == best[x[0]] for x in k), sum(docs_with[x] for x in k),
             ";".join(",".join(x) + "|" + ",".join(y) for x, y in g)) for p, q, g, k in each]


@pytest.mark.parametrize("wave", [1, 1 << 27])
def test_alignment_matches_brute_force(spark, wave):
    rng = random.Random(9)
    rows = [(i + 10, mixed(rng, 60), None) for i in range(80)] + ODD
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string").repartition(7)
    out = al.align_tokenizers(docs, A, B, shards=3, fan_in=2, wave_bytes=wave)
    assert out.columns == ["doc_id", "text", "n_a", "_n_a", *al.FIELDS[1:], "token_groups"]
    got = sorted((tuple(r)[0:2] + tuple(r)[3:] for r in out.collect()), key=str)
    want = sorted(((i, t) + w for (i, t, _), w in zip(rows, brute_alignment([t for _, t, _ in rows]), strict=True)), key=str)
    assert got == want


def test_alignment_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert al.align_tokenizers(empty, A, B).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    assert [tuple(r)[2:] for r in al.align_tokenizers(nulls, A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 3
