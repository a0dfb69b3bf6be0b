"""Word lists and lookup tables.

Lists marked "fixed values" define results and are stated as they are used. Lexicons of open size
(slang, emoji emotions, word scores) are parameters: the seeds below are small and our own, and
``threadlens.sources.readers`` loads user files of the same shape.
"""

from __future__ import annotations

import glob
import os
import re
import zipfile
from functools import lru_cache

import pyspark

# Contraction expansions. Order matters, the first listed alternative wins.
CONTRACTIONS = {
    "ain't": "is not", "aren't": "are not", "can't": "cannot", "'cause": "because",
    "could've": "could have", "couldn't": "could not", "didn't": "did not", "doesn't": "does not",
    "don't": "do not", "hadn't": "had not", "hasn't": "has not", "haven't": "have not",
    "he'd": "he would", "he'll": "he will", "he's": "he is", "how'd": "how did",
    "how'd'y": "how do you", "how'll": "how will", "how's": "how is", "I'd": "I would",
    "I'd've": "I would have", "I'll": "I will", "I'll've": "I will have", "I'm": "I am",
    "I've": "I have", "i'd": "i would", "i'd've": "i would have", "i'll": "i will",
    "i'll've": "i will have", "i'm": "i am", "i've": "i have", "isn't": "is not",
    "it'd": "it would", "it'd've": "it would have", "it'll": "it will", "it'll've": "it will have",
    "it's": "it is", "let's": "let us", "ma'am": "madam", "mayn't": "may not",
    "might've": "might have", "mightn't": "might not", "mightn't've": "might not have",
    "must've": "must have", "mustn't": "must not", "mustn't've": "must not have",
    "needn't": "need not", "needn't've": "need not have", "o'clock": "of the clock",
    "oughtn't": "ought not", "oughtn't've": "ought not have", "shan't": "shall not",
    "sha'n't": "shall not", "shan't've": "shall not have", "she'd": "she would",
    "she'd've": "she would have", "she'll": "she will", "she'll've": "she will have",
    "she's": "she is", "should've": "should have", "shouldn't": "should not",
    "shouldn't've": "should not have", "so've": "so have", "so's": "so as", "this's": "this is",
    "that'd": "that would", "that'd've": "that would have", "that's": "that is",
    "there'd": "there would", "there'd've": "there would have", "there's": "there is",
    "here's": "here is", "they'd": "they would", "they'd've": "they would have",
    "they'll": "they will", "they'll've": "they will have", "they're": "they are",
    "they've": "they have", "to've": "to have", "wasn't": "was not", "we'd": "we would",
    "we'd've": "we would have", "we'll": "we will", "we'll've": "we will have", "we're": "we are",
    "we've": "we have", "weren't": "were not", "what'll": "what will",
    "what'll've": "what will have", "what're": "what are", "what's": "what is",
    "what've": "what have", "when's": "when is", "when've": "when have", "where'd": "where did",
    "where's": "where is", "where've": "where have", "who'll": "who will",
    "who'll've": "who will have", "who's": "who is", "who've": "who have", "why's": "why is",
    "why've": "why have", "will've": "will have", "won't": "will not", "won't've": "will not have",
    "would've": "would have", "wouldn't": "would not", "wouldn't've": "would not have",
    "y'all": "you all", "y'all'd": "you all would", "y'all'd've": "you all would have",
    "y'all're": "you all are", "y'all've": "you all have", "you'd": "you would",
    "you'd've": "you would have", "you'll": "you will", "you'll've": "you will have",
    "you're": "you are", "you've": "you have",
}

# Two more entries of the trait-text variant.
TRAIT_TEXT_CONTRACTIONS = {**CONTRACTIONS, "nor": "not", "nt": "not"}

# Words that are always kept.
KEEP_WORDS = ["n't", "not", "nor", "nt"]

# Stop words added to the English list.
EXTRA_STOP_WORDS = [
    '"', "|",
    "say", "get", "go", "know", "may", "need", "like", "make", "see", "want", "come", "take", "use", "would", "can",
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "also", "across", "among",
    "beside", "however", "yet", "within", "mr", "bbc", "image", "getty", "de", "en", "caption", "copyright",
    "something",
]

# Emoticons.
HAPPY_EMOTICONS = [
    ":-)", ":)", ";)", ":o)", ":]", ":3", ":c)", ":>", "=]", "8)", "=)", ":}", ":^)", ":-D", ":D", "8-D", "8D", "x-D",
    "xD", "X-D", "XD", "=-D", "=D", "=-3", "=3", ":-))", ":'-)", ":')", ":*", ":^*", ">:P", ":-P", ":P", "X-P", "x-p",
    "xp", "XP", ":-p", ":p", "=p", ":-b", ":b", ">:)", ">;)", ">:-)", "<3",
]
SAD_EMOTICONS = [
    ":L", ":-/", ">:/", ":S", ">:[", ":@", ":-(", ":[", ":-||", "=L", ":<", ":-[", ":-<", "=\\", "=/", ">:(", ":(",
    ">.<", ":'-(", ":'(", ":\\", ":-c", ":c", ":{", ">:\\", ";(",
]

# Tokens that flag a negation, and markers left in the posts by anonymisation.
NEGATIONS = ["not", "no"]
RELICS = ["RT", "#USER#", "#HASHTAG#", "#URL#"]
CLEAN_SUBSTRINGS = ["rt", "via", "user", "hashtag", "url", "amp"]


@lru_cache(maxsize=1)
def english_stop_words() -> list[str]:
    """English stop words as shipped with Spark, read from its jar so that no session is needed."""
    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    for jar in glob.glob(os.path.join(home, "jars", "spark-mllib_*.jar")):
        with zipfile.ZipFile(jar) as archive:
            text = archive.read("org/apache/spark/ml/feature/stopwords/english.txt").decode("utf-8")
        return text.split()
    from pyspark.ml.feature import StopWordsRemover

    return list(StopWordsRemover.loadDefaultStopWords("english"))


# Seed slang keys; the last two show that a key with a blank never equals one token.
SEED_SLANG = [
    "afaik", "asap", "brb", "btw", "fomo", "fyi", "gg", "idk", "imho", "imo", "irl", "jk", "lmk", "lol", "nvm", "omg",
    "rofl", "smh", "tbh", "ttyl", "the", "yolo", "good vibes", "no cap",
]

# Seed emoji emotions: emoji, name, anger, fear, joy, sadness.
SEED_EMOJI = [
    ("😀", ":grinning_face:", 0.05, 0.05, 0.90, 0.05),
    ("😂", ":face_with_tears_of_joy:", 0.10, 0.05, 0.85, 0.20),
    ("😍", ":smiling_face_with_heart-eyes:", 0.02, 0.05, 0.95, 0.08),
    ("😡", ":pouting_face:", 0.95, 0.30, 0.02, 0.40),
    ("😢", ":crying_face:", 0.20, 0.35, 0.05, 0.92),
    ("😱", ":face_screaming_in_fear:", 0.25, 0.94, 0.08, 0.45),
    ("🔒", ":locked:", 0.15, 0.25, 0.15, 0.20),
    ("🔥", ":fire:", 0.40, 0.30, 0.50, 0.10),
    ("🚀", ":rocket:", 0.10, 0.15, 0.70, 0.05),
    ("🎉", ":party_popper:", 0.03, 0.04, 0.96, 0.03),
    ("💔", ":broken_heart:", 0.30, 0.40, 0.03, 0.95),
    ("🕐", ":one_o’clock:", 0.12, 0.22, 0.24, 0.21),
    ("🎱", ":pool_8_ball:", 0.11, 0.13, 0.40, 0.12),
]

# Seed word scores: word, valence in [-4, 4], polarity in [-1, 1].
SEED_WORD_SCORES = [
    ("good", 1.9, 0.7), ("great", 3.1, 0.8), ("happy", 2.7, 0.8), ("love", 3.2, 0.5), ("nice", 1.8, 0.6),
    ("bad", -2.5, -0.7), ("awful", -2.0, -1.0), ("hate", -2.7, -0.8), ("sad", -2.1, -0.5), ("worthless", -1.9, -0.8),
    ("this", 0.4, 0.1), ("for", -0.3, -0.05), ("with", 0.2, 0.15), ("hello", 1.0, 0.2),
]

_READABLE_NAME = re.compile(r":[A-Za-z\-_]+:")


def gated_emoji(entries, name_gate: bool = True):
    """Drop entries whose name is not made of letters, '-' and '_' alone, unless the gate is off."""
    return [e for e in entries if not name_gate or _READABLE_NAME.search(e[1])]
