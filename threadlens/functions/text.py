r"""Text functions: Column in, Column out, all evaluated by Spark's own expressions.

Patterns are written with explicit character classes because ``\s`` differs between engines.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlens import lexicons as lex

# The characters Python treats as white space.
SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Emoji ranges that are counted.
EMOJI_RANGES = r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}"
# ASCII punctuation without the apostrophe.
PUNCTUATION = r"""!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~"""

SPACES = f"[{SPACE}]+"
EMOJI = f"[{EMOJI_RANGES}]"
CAPITALIZED = "[A-Z][a-z]+"
FULL_CAPITALIZED = "[A-Z][A-Z]+"
LINK = f"(?s)http[^{SPACE}]+|www.[^{SPACE}]+"
MENTION = f"@[^{SPACE}]+"
PUNCT_CLASS = f"[{PUNCTUATION}]"
NON_ASCII = r"[^\x{0}-\x{7F}]+"
NON_ALPHA = "[^a-z A-Z]+"
DROPPED_MARKS = r"""[?|!'"#]"""
SPACED_MARKS = r"[.,)(|/]"
WORD = r"[\p{L}\p{N}_]{2,}"


def guarded(pattern: str, skip: str) -> str:
    """The pattern behind a one-range lookahead that turns most characters away before a wide class is tried.

    ``skip`` must be a range the pattern cannot start with, so the matches stay the same.
    """
    return f"(?!{skip}){pattern}"


# The same matches as SPACES and NON_ALPHA, faster on mostly ASCII text.
FAST_SPACES = guarded(SPACES, "[!-~]")
FAST_NON_ALPHA = guarded(NON_ALPHA, "[a-z]")
# Runs of white space other than one blank.
UNEVEN_SPACES = guarded(f"(?:[{SPACE}]{{2,}}|[{SPACE}&&[^ ]])", "[!-~]")


def delete(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def occurrences(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def whitespace_tokens(text: Column) -> Column:
    """Non-empty runs between white space."""
    return F.array_remove(F.split(text, FAST_SPACES), "")


def word_tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-cased runs of two or more word characters, without the stop words."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    if stop_words:
        tokens = F.filter(tokens, lambda t: ~t.isin(stop_words))
    return tokens


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All n-grams with low <= n <= high as one array; blanks between words.

    Size n is size n-1 zipped with the tokens shifted by n-1; a null token, or the padding of the
    shorter side, makes the n-gram null, and nulls are dropped at the end. Pass a materialised
    column: the tokens are read once per size.
    """
    sizes = {1: tokens}
    for n in range(2, high + 1):
        shifted = F.slice(tokens, n, F.greatest(F.size(tokens) - (n - 1), F.lit(0)))
        sizes[n] = F.zip_with(sizes[n - 1], shifted, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_compact(F.concat(*[sizes[n] for n in range(low, high + 1)]))


def word_rate(text: Column, divisor: float = 300.0) -> Column:
    """White-space tokens over the assumed number of posts per user."""
    return F.size(whitespace_tokens(text)) / F.lit(divisor)


def one_byte_each(text: Column) -> Column:
    """Whether no character takes more than one byte; such a text has no emoji."""
    return F.length(text) == F.octet_length(text)


def emoji_count(text: Column) -> Column:
    """Characters in the emoji ranges; a run of three counts three."""
    return F.when(one_byte_each(text), F.lit(0).cast("long")).otherwise(occurrences(text, EMOJI))


def whole_token_pattern(words: list[str]) -> str:
    """Matches a white-space token that equals one of the words; a word with white space inside never does."""
    single_words = [w for w in words if w and not re.search(r"\s", w)]
    single = [re.escape(w) for w in single_words]
    start, end = f"(?<![!-~])(?<![^{SPACE}])", f"(?![!-~])(?![^{SPACE}])"
    # a look at the first character turns most positions away before the wide classes are tried
    first = "".join(sorted({re.escape(w[0]) for w in single_words}))
    return f"(?=[{first}]){start}(?:{'|'.join(single)}){end}" if single else "(?!)"


def slang_count(text: Column, slang: list[str] = lex.SEED_SLANG) -> Column:
    """White-space tokens that equal a slang key after lower-casing. For long lists use a lexicon join."""
    return occurrences(F.lower(text), whole_token_pattern([s.lower() for s in slang]))


def clean_relics(text: Column) -> Column:
    """Delete the anonymisation markers wherever they stand."""
    for relic in lex.RELICS:
        text = F.replace(text, F.lit(relic), F.lit(""))
    return text


def capitalized_count(text: Column) -> Column:
    return occurrences(clean_relics(text), CAPITALIZED)


def full_capitalized_count(text: Column) -> Column:
    return occurrences(clean_relics(text), FULL_CAPITALIZED)


def relic_counts(text: Column) -> dict[str, Column]:
    names = ["retweets_count", "user_mentions_count", "hashtags_count", "url_count"]
    return {name: occurrences(text, relic) for name, relic in zip(names, lex.RELICS)}


def negation_flag(tokens: Column) -> Column:
    """1 when a token is a negation, else 0."""
    return F.arrays_overlap(tokens, F.array(*[F.lit(n) for n in lex.NEGATIONS])).cast("int")


def has_negation(text: Column) -> Column:
    """negation_flag of the white-space tokens, without building them."""
    return text.rlike(whole_token_pattern(lex.NEGATIONS)).cast("int")


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACES}|{FAST_SPACES}$", "")


def one_blank(text: Column) -> Column:
    """The white-space tokens with one blank between them."""
    return F.trim(F.regexp_replace(text, UNEVEN_SPACES, " "))


def clean_punctuation(text: Column) -> Column:
    """Delete some marks, space out others, strip, and put everything on one line."""
    text = F.regexp_replace(delete(text, DROPPED_MARKS), SPACED_MARKS, " ")
    return F.replace(strip_space(text), F.lit("\n"), F.lit(" "))


def strip_links(text: Column) -> Column:
    return delete(text, LINK)


def remove_punctuation(text: Column) -> Column:
    """Delete mentions, then every ASCII punctuation mark but the apostrophe."""
    return delete(delete(text, MENTION), PUNCT_CLASS)


def contraction_pattern(contractions: dict[str, str], guarded: bool = False) -> str:
    """Alternation of the keys in map order.

    The guard is a lookahead that every key satisfies: letters up to an apostrophe, or a key
    without one. It rejects most positions before the long alternation is tried.
    """
    keys = "|".join(re.escape(k) for k in contractions)
    if not guarded:
        return keys
    lead = max((len(k.split("'")[0]) for k in contractions if "'" in k), default=0)
    plain = [re.escape(k) for k in contractions if "'" not in k]
    return f"(?={'|'.join([f"[A-Za-z]{{0,{lead}}}+'", *plain])})(?:{keys})"


def string_map(entries: dict[str, str]) -> Column:
    return F.map_from_arrays(
        F.array(*[F.lit(k) for k in entries]), F.array(*[F.lit(v) for v in entries.values()])
    )


def once(value: Column, use) -> Column:
    """use(value), where the value is evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def replace_matches(text: Column, pattern: str, mapping: Column) -> Column:
    """One left-to-right pass: each match is replaced by its mapped value and not scanned again."""

    def replaced(t: Column) -> Column:
        pieces = F.zip_with(
            F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)),
            lambda gap, m: F.concat(gap, F.coalesce(F.try_element_at(mapping, m), m, F.lit(""))),
        )
        return F.array_join(pieces, "")

    return once(text, replaced)


# A whole run of letters and apostrophes with an apostrophe in it; inside a run one look back turns a position away.
APOSTROPHE_RUN = "(?<![A-Za-z'])[A-Za-z]*+'[A-Za-z']*+"


def expand_contractions(text: Column, contractions: dict[str, str] = lex.CONTRACTIONS) -> Column:
    """Keys are replaced wherever they stand. If all are made of letters and an apostrophe, none reaches out of a run of
    such characters, so only runs with an apostrophe are searched, one to a line."""
    pattern, table = contraction_pattern(contractions, guarded=True), string_map(contractions)
    if any("\n" in v for v in contractions.values()) or not all(
            "'" in k and re.fullmatch("[A-Za-z']+", k) for k in contractions):
        return replace_matches(text, pattern, table)

    def expanded(t: Column) -> Column:
        runs = F.regexp_extract_all(t, F.lit(APOSTROPHE_RUN), F.lit(0))
        done = F.split(replace_matches(F.array_join(runs, "\n"), pattern, table), "\n", -1)
        pieces = F.zip_with(F.split(t, APOSTROPHE_RUN, -1), done, lambda gap, run: F.concat(gap, F.coalesce(run, F.lit(""))))
        return F.when(F.contains(t, F.lit("'")), F.array_join(pieces, "")).otherwise(t)

    return once(text, expanded)


def _drop_substrings(text: Column, whole_word: bool) -> Column:
    for part in lex.CLEAN_SUBSTRINGS:
        text = delete(text, rf"\b{part}\b") if whole_word else F.replace(text, F.lit(part), F.lit(""))
    return text


def _ascii_lower(text: Column, links: bool, whole_word: bool) -> Column:
    text = remove_punctuation(strip_links(text) if links else text)
    return delete(_drop_substrings(F.lower(text), whole_word), NON_ASCII)


def only_alpha(tokens: Column) -> Column:
    """Delete non-letters inside each token; tokens that become empty stay."""
    return F.transform(tokens, lambda t: F.regexp_replace(t, FAST_NON_ALPHA, ""))


def clean_text(text: Column, whole_word: bool = False) -> Column:
    """Links, punctuation, case, markers, non-ASCII, contractions; letters only; one blank between tokens.

    Markers such as ``rt`` also vanish inside words unless whole_word is set.
    """
    expanded = expand_contractions(_ascii_lower(text, links=True, whole_word=whole_word))
    # tokens hold no blanks, so the letter filter works on the joined string as on each token
    return delete(one_blank(expanded), FAST_NON_ALPHA)


def clean_text_for_linear(text: Column, whole_word: bool = False) -> Column:
    """As clean_text, without contraction expansion and letter filter."""
    return one_blank(_ascii_lower(text, links=True, whole_word=whole_word))


def emoticon_list() -> list[str]:
    return lex.HAPPY_EMOTICONS + lex.SAD_EMOTICONS


def clean_text_for_traits(text: Column) -> Column:
    """Trait variant: keeps link text, wider contraction map, drops emoticons, returns the token list."""
    expanded = expand_contractions(
        _ascii_lower(text, links=False, whole_word=False), lex.TRAIT_TEXT_CONTRACTIONS
    )
    tokens = only_alpha(whitespace_tokens(expanded))
    return F.filter(tokens, lambda t: ~t.isin(emoticon_list()) | t.isin(lex.KEEP_WORDS))


def filter_tokens(tokens: Column, stop_words: list[str]) -> Column:
    """Keep words of 3 to 41 characters that are no stop word, emoticon or mark, and the listed keep words."""
    dropped = stop_words + lex.EXTRA_STOP_WORDS + emoticon_list()
    punctuation = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
    return F.filter(
        tokens,
        lambda t: (
            ~t.isin(dropped)
            & ~F.lit(punctuation).contains(t)
            & ~t.rlike(f"^{SPACES}$")
            & (F.length(t) > 2) & (F.length(t) < 42)
        ) | t.isin(lex.KEEP_WORDS),
    )


def join_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, ",")


def single_line(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit(" "))


def keyword_match(text: Column, keywords: list[str]) -> Column:
    """Case-insensitive test for any of the keywords."""
    return text.rlike("(?i)" + "|".join(re.escape(k) for k in keywords))


def post_date(created_at: Column) -> Column:
    """Date of a 'Mon Jan 01 00:00:07 +0000 2024' stamp; the weekday is not needed to parse it."""
    return F.to_timestamp_ntz(F.substring(created_at, 5, 100), F.lit("MMM dd HH:mm:ss '+0000' yyyy")).cast("date")


def recode(value: Column, codes: dict[str, int]) -> Column:
    """Mapped code; a value outside the map is an error, null stays null."""
    result = F.when(value.isNull(), F.lit(None).cast("int"))
    for key, code in codes.items():
        result = result.when(value == key, F.lit(code))
    return result.otherwise(F.raise_error(F.concat(F.lit("no code for "), value)).cast("int"))
