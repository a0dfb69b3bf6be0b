import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from threadlens.llm import decontaminate as dc
from threadlens.llm import token_count as tc
from threadlens.llm import unit_dedup as ud

PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [(None, None, "a", 1), (1, "", "b", 2), (2, " \n\n ", None, 3), (3, "word " * 50000, "c", 4), (4, "x", "d", 5)]


def fewest_edits(item, text):
    """Edits of the best occurrence of item anywhere in text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (a != b)))
        row = now
    return min(row)


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at, how = rng.randrange(len(out)), rng.randrange(3)
        if how == 0:
            out[at] = rng.choice("abcdefgh ")
        elif how == 1:
            out.insert(at, rng.choice("abcdefgh"))
        else:
            del out[at]
    return "".join(out)


@pytest.mark.parametrize("seed", range(6))
def test_items_found_as_by_full_alignment(seed):
    rng = random.Random(seed)
    make = lambda n: dc.normal("".join(rng.choices("abcdefgh   ", k=n)))
    items = [(i, make(rng.randrange(50, 160))) for i in range(5)]
    items = [(i, t) for i, t in items if len(t) >= dc.MIN_CHARS]
    index = dc.ItemIndex(items, 0.1)
    for _ in range(12):
        i, t = rng.choice(items)
        text = dc.normal(make(rng.randrange(1, 200)) + edited(rng, t, rng.randrange(0, len(t) // 6)) + make(rng.randrange(1, 200)))
        got = {m[0]: m[3] for m in index.matches(text)}
        for (j, item), k in zip(items, index.edits, strict=True):
            edits = fewest_edits(item, text)
            assert got.get(j) == (edits if edits <= k else None)


def test_items_have_their_whole_share_of_edits():
    text = "the seven quiet rivers ran past mill towns by night until the very last of them froze over in the snow"
    for m in range(dc.MIN_CHARS, 91):
        item = text[:m]
        k = m // 10
        assert dc.budget(m, 0.1) == k
        places = [(i + 1) * m // (k + 1) for i in range(k)]
        other = "".join("#" if i in places else c for i, c in enumerate(item))
        assert dc.ItemIndex([(1, item)], 0.1).matches("before " + other + " after") == [(1, 7, 7 + m, k)]


@pytest.mark.parametrize("seed", range(4))
def test_short_items_found_verbatim_between_word_edges(seed):
    rng = random.Random(seed)
    words = ["a", "ab", "abc", "b", "b,c", "c.", "9", "\u6771", "\u4eac", "\u6771\u4eac"]
    items = sorted({dc.normal(" ".join(rng.choices(words, k=rng.randrange(1, 4)))) for _ in range(6)})
    index = dc.VerbatimIndex(list(enumerate(items)))
    for _ in range(40):
        text = dc.normal("".join(rng.choices([*words, " ", " ", " "], k=rng.randrange(0, 30))))
        expected = set()
        for i, item in enumerate(items):
            for at in range(len(text) - len(item) + 1):
                end = at + len(item)
                inside = (at and dc.one_word(text[at - 1], text[at])) or (end < len(text) and dc.one_word(text[end - 1], text[end]))
                if text[at:end] == item and not inside:
                    expected.add((i, at, end, 0))
                    break
        assert set(index.matches(text)) == expected
    assert dc.VerbatimIndex([]).matches("a b") == []


def test_short_items_and_repeated_rows(spark):
    item = "Who wrote  Emma?"
    docs = spark.createDataFrame([(1, "Quiz: who wrote emma? Jane Austen."), (1, "Quiz: who wrote emma? Jane Austen."), (2, "who wrote emmas"),
                                  (3, "somewho wrote emma? no"), (4, None), (5, ""), (6, "x " * 60000 + "WHO WROTE EMMA?")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, " "), (9, None), (None, "quiz")], "item_id long, text string")
    for chars in (1 << 20, 3):
        rows = [(r.doc_id, [(m.item, m.start, m.end, m.edits) for m in r.matches]) for r in dc.find_items(docs, items, block_chars=chars).collect()]
        assert sorted(rows) == [(1, [(7, 6, 21, 0)]), (1, [(7, 6, 21, 0)]), (2, []), (3, []), (4, []), (5, []),
                                (6, [(7, 120000, 120015, 0)])]


def test_find_items_places_and_blocks(spark):
    item = "The quick brown fox jumps over the lazy dog, and then some more of it."
    rows = [(7, f"Before\n {item.upper()}  After", None, 0), (8, "nothing here", "x", 1), *ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, matches string, item int")
    items = spark.createDataFrame([(1, item), (2, item), (3, None), (None, "y" * 90), (4, "short"), (5, "zq" * 40)],
                                  "item_id long, text string")
    for chars in (1 << 20, 60):
        out = dc.find_items(docs, items, block_chars=chars)
        assert out.columns == [*docs.columns, "_matches"]
        found = {r.doc_id: r["_matches"] for r in out.collect()}
        assert [tuple(m) for m in found[7]] == [(1, 8, 8 + len(item), 0)]
        assert all(not m for d, m in found.items() if d != 7)
    assert dc.find_items(docs.limit(0), items).count() == 0
    assert dc.find_items(docs, items.limit(0)).where("size(_matches) > 0").count() == 0


def test_counts_equal_the_library():
    vocabulary, unknown, _ = tc.read_vocabulary(PIECES)
    for fallback in (True, False):
        library = Tokenizer(models.Unigram(vocabulary, unknown, fallback))
        library.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tc.MARK, prepend_scheme="always", split=True)
        counter = tc.UnigramCounter(vocabulary, fallback)
        texts = ["", "a", " ", "  ", " a b ", "▁a", "x▁ y", "日本語𠀀𠀁 z", "\n\t𠀀́𠀀", "<unk> <0x41>", "\0a",
                 "the of and " * 30, "abc" * 200]
        want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
        assert tc._counts(pa.array(texts), counter, {}).tolist() == want


def test_ties_keep_the_longest_last_piece(tmp_path):
    vocabulary = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("ba", -2.0)]
    library = Tokenizer(models.Unigram(vocabulary, 0, False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tc.MARK, prepend_scheme="always", split=True)
    counter = tc.UnigramCounter(vocabulary, False)
    rng = random.Random(0)
    texts = ["".join(rng.choices("abq ", k=rng.randrange(1, 14))) for _ in range(300)]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert tc._counts(pa.array(texts), counter, {}).tolist() == want
    library.save(str(tmp_path / "u.json"))
    assert tc.read_vocabulary(str(tmp_path / "u.json"))[0] == vocabulary


def test_count_edge_cases(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, n_tokens string, x int")
    out = tc.count_tokens(df, PIECES)
    got = [r["_n_tokens"] for r in out.collect()]
    assert got[:2] == [0, 0] and got[3] > 50000 and tc.count_tokens(df.limit(0), PIECES).count() == 0


def test_long_unknown_runs_take_time_in_proportion():
    import time

    vocabulary, _, _ = tc.read_vocabulary(PIECES)
    for fallback in (True, False):
        counter = tc.UnigramCounter(vocabulary, fallback)
        took = []
        for n in (20_000, 80_000):
            start = time.process_time()
            assert counter.count("\U00020001" * n) == (4 * n if fallback else 1)
            took.append(time.process_time() - start)
        assert took[1] < 12 * took[0] + 0.2
    mixed = tc.UnigramCounter([("a", -1.0), ("<0xF0>", 0.0)], True)
    assert mixed.count("a\U00020001\U00020001a") == 3


def brute_units(rows, unit, least):
    """Rows in the order of id (null first); rows that share an id in the order in which they were numbered."""
    seen, out = set(), []
    for doc, text in rows:
        parts = [(text or "")[a:b] for a, b in ud.cut_units(text or "", unit)]
        words = [p.lower().split() for p in parts]
        old = []
        for w in words:
            key = " ".join(w)
            old.append(bool(w) and key in seen)
            seen.add(key)
        real = [i for i, w in enumerate(words) if w]
        gone = set()
        if real and all(old[i] for i in real):
            gone = set(range(len(parts)))
        for i in real:
            for j in real:
                if i <= j and all(old[k] for k in real if i <= k <= j) and sum(len(words[k]) for k in real if i <= k <= j) >= least:
                    gone.update(range(i, j + 1))
        out.append((doc, len(parts), len(gone), "".join(p for i, p in enumerate(parts) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("unit,hot", [("sentence", 1000), ("line", 1000), ("paragraph", 1000), ("sentence", 3)])
def test_units_match_brute_force(spark, monkeypatch, unit, hot):
    monkeypatch.setattr(ud, "HOT_LEAST", hot)
    rng = random.Random(5)
    pool = [" ".join(rng.choices("one two three four five six".split(), k=rng.randrange(1, 15))) + rng.choice([". ", ".\n", "!\n\n", " "])
            for _ in range(25)]
    rows = [(i + 50, "".join(rng.choices(pool, k=rng.randrange(12))) + rng.choice(["", f"New {i}. ", "Six. "]), None, 0) for i in range(60)]
    rows = [r for r in ODD if r[0] is not None] + rows
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_text string, gone int")
    out = ud.dedup_units(df.repartition(4), unit=unit)
    assert out.columns == [*df.columns, "n_units", "n_removed", "kept_spans", "_kept_text"]
    got = out.collect()
    want = brute_units([r[:2] for r in rows], unit, ud.MIN_RUN_WORDS)
    assert sorted(((r.doc_id, r.n_units, r.n_removed, r["_kept_text"]) for r in got), key=str) == want
    assert any(w[2] for w in want)
    for r in got:
        assert "".join((r.text or "")[s.start:s.end] for s in r.kept_spans) == r["_kept_text"]
    assert ud.dedup_units(df.limit(0)).count() == 0


def test_rows_that_share_an_id_lose_nothing_unique(spark):
    long = "The seven quiet rivers ran past the mill towns by night, until the last of them froze in deep snow that winter."
    rows = [(1, "Common sentence here."), (5, "Common sentence here."), (5, "Unique text that occurs once only."), (5, long), (5, long),
            (None, "First of all."), (None, long + " Own end."), (None, None), (9, "Another text. " + long)]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.kept_text) for r in
                 ud.dedup_units(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(True, 1, "Common sentence here."), (True, 5, ""), (True, 5, "Unique text that occurs once only."), (True, 5, ""),
                          (True, 5, ""), (False, 0, "First of all."), (False, 0, long + " Own end."), (False, 0, ""),
                          (True, 9, "Another text. ")])


def test_passage_inside_other_text_goes_and_short_lines_stay(spark):
    passage = " ".join(f"Sentence {w} is here for all to see and read." for w in "one two three four five six".split())
    line, copy = "Licensed under the terms.", "One two. Three four five.\nSix!"
    rows = [(1, f"Other words here. {passage} Tail."), (2, f"No. More. {passage} End of it."), (3, copy), (4, copy),
            (5, f"First text here.\n{line}\nMore of it."), (6, f"Another begins so.\n{line}\nOther end."), (7, line), (8, " \n")]
    got = {r.doc_id: r.kept_text for r in ud.dedup_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "No. More. End of it.", 3: copy, 4: "", 5: rows[4][1], 6: rows[5][1], 7: "", 8: " \n"}
