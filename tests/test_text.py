import re

import pytest
from pyspark.sql import functions as F

from threadlens import lexicons as lex
from threadlens.functions import emoji as em
from threadlens.functions import text as tx


@pytest.fixture(scope="module")
def apply(spark):
    def run(function, *texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        return [r[0] for r in rows.select(function(F.col("t")).alias("x"), "i").orderBy("i").select("x").collect()]

    return run


def test_empty_null_and_blank(apply):
    texts = ("", None, " \t\n")
    assert apply(tx.word_rate, *texts) == [0.0, None, 0.0]
    assert apply(tx.slang_count, *texts) == [0, None, 0]
    assert apply(tx.emoji_count, *texts) == [0, None, 0]
    assert apply(tx.clean_text, *texts) == ["", None, ""]
    assert apply(tx.clean_punctuation, *texts) == ["", None, ""]


def test_unicode_white_space_splits_as_in_python(apply):
    text = "a b c d　e\x1cf​g"
    assert apply(tx.whitespace_tokens, text) == [text.split()]


def test_capitals(apply):
    assert apply(tx.capitalized_count, "CamelCase APple NASA RT ARTICLE") == [3]
    # RT is deleted first, inside words too: NASA, AP and A..ICLE remain
    assert apply(tx.full_capitalized_count, "CamelCase APple NASA RT ARTICLE") == [3]


def test_relic_counts(spark):
    row = spark.sql("SELECT 'RT ARTICLE #USER##USER# #URL# #HASHTAG' AS t")
    assert list(row.select(*tx.relic_counts(F.col("t")).values()).first()) == [2, 2, 0, 1]


def test_emoji_are_counted_by_character(apply):
    assert apply(tx.emoji_count, "😀😀😀", "👨‍👩", "🇬🇷", "no") == [3, 2, 2, 0]


def test_slang_needs_whole_tokens(apply):
    assert apply(tx.slang_count, "LOL lol, lol\nlol", "no cap", "the the") == [3, 0, 2]


def test_negation_is_a_token(apply):
    assert apply(lambda t: tx.negation_flag(tx.whitespace_tokens(t)), "not", "nothing", "oh no", "NO") == [1, 0, 1, 0]
    assert apply(tx.has_negation, "not", "nothing", "oh no", "NO", "no way", "-no") == [1, 0, 1, 0, 1, 0]


def test_contractions_take_the_first_alternative_and_do_not_rescan(apply):
    table = {"i'd": "i would", "i'd've": "X", "he's": "he is", "can't": "cannot", "won't": "will not"}
    assert apply(lambda t: tx.expand_contractions(t, table), "i'd've the's plant can't. won't") == [
        "i would've the is plant cannot. will not"]


def test_contraction_guard_changes_nothing():
    import re

    for table in (lex.CONTRACTIONS, lex.TRAIT_TEXT_CONTRACTIONS):
        plain = re.compile(tx.contraction_pattern(table))
        fast = re.compile(tx.contraction_pattern(table, guarded=True))
        text = " ".join(table) + " want i'd've 'cause o'clock nor x'y"
        assert plain.findall(text) == fast.findall(text)


def test_fast_patterns_match_the_plain_ones(apply):
    text = "a  b\tc D-1 é\n"
    for fast, plain in ((tx.FAST_SPACES, tx.SPACES), (tx.FAST_NON_ALPHA, tx.NON_ALPHA)):
        assert apply(lambda t: F.regexp_replace(t, fast, "_"), text) == apply(
            lambda t: F.regexp_replace(t, plain, "_"), text)


def test_links_mentions_and_marks(apply):
    assert apply(tx.strip_links, "see https://a.b/c?d=1 and www.x.y, wwwzq end") == ["see  and   end"]
    assert apply(tx.remove_punctuation, "@name hi!!! it's [a-b]_c\\d") == [" hi it's abcd"]
    assert apply(tx.clean_punctuation, ' "Hi|there", (x/y) #z?\n') == ["Hithere   x y  z"]


def test_clean_text_and_variants(apply):
    text = "RT @bob I can't see the article via https://x.y #Url café 42!"
    assert apply(tx.clean_text, text) == ["i cannot see the aicle caf "]
    assert apply(tx.clean_text_for_linear, text) == ["i can't see the aicle caf 42"]
    assert apply(lambda t: tx.clean_text(t, whole_word=True), "RT the article") == ["the article"]
    assert apply(tx.clean_text_for_traits, "I want it, nor you") == [["i", "wanot", "it", "not", "you"]]


def test_filter_tokens(apply):
    stop = ["the", "is"]
    kept = lambda t: tx.filter_tokens(tx.whitespace_tokens(t), stop)
    assert apply(kept, "the cat is :-) not nt go xx " + "y" * 41 + " " + "z" * 42) == [["cat", "not", "nt", "y" * 41]]


def test_ngrams(spark, apply):
    rows = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    got = [r[0] for r in rows.select(tx.ngrams(F.col("t"), 1, 3)).collect()]
    assert got == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]


def test_emoji_names_and_gate(apply):
    assert apply(em.demojize, "x😀y🔒") == ["x:grinning_face:y:locked:"]
    assert apply(em.emoji_names, "🕐🎱😀") == [[":grinning_face:"]]
    assert apply(lambda t: em.emoji_names(t, name_gate=False), "🎱") == [[":pool_8_ball:"]]
    assert apply(lambda t: em.emotion_means(t)["joy"], "😀🔒", "none") == [pytest.approx(0.525), 0.0]


def test_recode_rejects_unknown_values(spark):
    rows = spark.createDataFrame([("M",), ("F",), (None,)], "g string")
    assert [r[0] for r in rows.select(tx.recode(F.col("g"), {"M": 0, "F": 1})).collect()] == [0, 1, None]
    with pytest.raises(Exception, match="no code for X"):
        spark.createDataFrame([("X",)], "g string").select(tx.recode(F.col("g"), {"M": 0, "F": 1})).collect()


def test_post_date_and_single_line(apply):
    assert [str(d) for d in apply(tx.post_date, "Wed Feb 28 23:59:59 +0000 2024")] == ["2024-02-28"]
    assert apply(tx.single_line, "a\r\nb\nc") == ["a b\nc"]


def test_only_runs_with_an_apostrophe_are_searched(apply, monkeypatch):
    texts = ["xi'd've 'cause'''don'tcan't won't", "no mark at all", "'", "''i'll''", "", "y'all'd've\ny'alls  i'dé'd", "é'twasn't'",
             "she's.it's-that's", None]
    table = lex.CONTRACTIONS
    plain = re.compile(tx.contraction_pattern(table))
    assert apply(tx.expand_contractions, *texts) == [t and plain.sub(lambda m: table[m[0]], t) for t in texts]
    odd = {"don't": "do\nnot", "nor": "not or"}
    assert apply(lambda c: tx.expand_contractions(c, odd), "don't nor") == ["do\nnot not or"]
    monkeypatch.setattr(tx, "replace_matches", lambda text, pattern, mapping: F.upper(text))
    assert apply(tx.expand_contractions, "abc don't x'y z") == ["abc DON'T X'Y z"]


def test_blanks_between_tokens(apply):
    texts = ("  a  b ", "a b", " ", "", "a\tb", " a  b\n", "a \n", "\u2003a\u3000 b", None)
    assert apply(tx.one_blank, *texts) == [t and " ".join(t.split()) for t in texts]


def test_emoji_are_looked_for_in_texts_that_can_have_them(apply, monkeypatch):
    texts = ("plain text", "caf\u00e9 \U0001F600\U0001F600 x", "", "\u2702", None)
    assert apply(tx.emoji_count, *texts) == [0, 2, 0, 1, None]
    monkeypatch.setattr(tx, "occurrences", lambda text, pattern: F.lit(7).cast("long"))
    assert apply(tx.emoji_count, *texts[:4]) == [0, 7, 0, 7]
