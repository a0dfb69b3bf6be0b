import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from threadlens.llm import count_automata as ca


def brute_phrases(rows, min_count, top, dominated):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    cand = {g: a for g, a in f.items() if len(g) > 2 and a >= min_count}
    out = []
    for g, a in cand.items():
        lang, w = g[0], g[1:]
        if any(h[0] == lang and len(h) > len(g) and 100 * b >= dominated * a and
               any(h[i:i + len(w)] == w for i in range(1, len(h) - len(w) + 1)) for h, b in cand.items()):
            continue
        score, k = min((1000000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, f[(lang, *w[:k])], f[(lang, *w[k:])], n[lang], score))
    result = []
    for lang in n:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        result += [(r[0], i + 1, *r[1:]) for i, r in enumerate(mine)]
    return sorted(result)


WORDS = ["a", "b", "ab", "é", "Z", "zz", "日本", "\x1f", "a b", "q"]


@pytest.mark.parametrize("shard,range_grams", [(1 << 20, 4_000_000), (20, 300)])
def test_phrases_match_brute_force(spark, monkeypatch, shard, range_grams):
    monkeypatch.setattr(ca, "SAMPLE_SHARE", 0.9)
    monkeypatch.setattr(ca, "SAMPLE_STEP", 1)
    monkeypatch.setattr(ca, "SHARD_WORDS", shard)
    rng = random.Random(4)
    rows = [(rng.choice(["en", "de", None, "", "zh"]), "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\t", ". ", "\n", "  "])
             for _ in range(rng.randrange(60)))) for _ in range(120)]
    rows += [("en", None), ("en", ""), (None, None), ("fr", ".,;:!?"), ("en", "a b ab " * 3000), ("en", "one two three"), ("en", "one two three")]
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS phrase", "2 AS n").repartition(5)
    for min_count, top, dominated in ((3, 2000, 50), (2, 7, 90)):
        got = sorted(tuple(r) for r in ca.mine_phrases(docs, min_count=min_count, top=top, dominated=dominated,
                                                       range_grams=range_grams).collect())
        assert got == brute_phrases(rows, min_count, top, dominated)


def test_empty_tables_have_no_phrases(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert ca.mine_phrases(empty).count() == 0
    assert ca.mine_phrases(spark.createDataFrame([("en", None), (None, " . ")], "lang string, text string")).count() == 0


def grams_of(automaton):
    words = automaton.words.to_pylist()
    return {tuple(words[c[i]] for c in columns): int(w[i]) for columns, w, _ in automaton.paths() for i in range(len(w)) if w[i]}


def test_shards_cut_anywhere_unite_to_the_counts(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices("a b c d ee f. g".split(), k=rng.randrange(1, 40))) for _ in range(30)]
    words, first, _ = ca.words_of(pa.array(texts))
    want = Counter()
    for t in texts:
        for piece in t.split("."):
            w = piece.encode().split()
            want.update(tuple(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    bounds = ca.Bounds([("en", (b"b", b"a", b"zz")), ("en", (b"c", b"c", b"d")), ("xx", (b"a", b"a", b"a"))])
    parts = {}
    for start in range(0, len(words), 17):
        reach = min(len(words), start + 19)
        for number, lang, blob in ca.close_shard("en", words.slice(start, reach - start), first[start:reach], min(17, reach - start), bounds):
            parts.setdefault(number, []).append(ca.CountAutomaton.load(blob))
    assert sorted(parts) == [0, 1, 2]
    found, total = {}, 0
    for shard in parts.values():
        made, n = ca.union(shard, 1)
        assert not set(found) & set(grams_of(made))
        found |= grams_of(ca.CountAutomaton.load(made.dump()))
        total += n
    assert found == dict(want) and total == len(words)


def test_equal_states_are_stored_once_and_lookup_walks_them():
    words = pa.array([b"a", b"b", b"c", b"x"], pa.large_binary())
    grams = [(1, 0, 0, 5), (1, 4, 0, 3), (1, 4, 2, 3), (2, 4, 0, 3), (2, 4, 2, 3), (3, 4, 2, 1)]
    columns = [np.array(c) for c in zip(*grams, strict=True)]
    made = ca.CountAutomaton.from_sorted(words, columns[:3], columns[3])
    assert len(made.layers[2]["label"]) == 2 and len(made.layers[1]["label"]) == 2
    asked = [np.array([0, 0, 1, 2, 2, 3, 0]), np.array([-1, 3, 3, 3, 3, -1, 2]), np.array([-1, -1, 1, 1, -1, -1, -1])]
    assert made.lookup(asked).tolist() == [5, 3, 3, 1, 0, 0, 0]
