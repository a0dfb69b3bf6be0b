"""Declared schemas of the inputs; nothing is inferred on read."""

from pyspark.sql import types as T

POST = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("post_pos", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("ground_truth", T.IntegerType()),
])

TRUTH = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("label_text", T.StringType()),
])

AUTHOR_XML = T.StructType([
    T.StructField("_id", T.StringType()),
    T.StructField("documents", T.StructType([
        T.StructField("document", T.ArrayType(T.StringType())),
    ])),
])

REPLY = T.StructType([
    T.StructField("tweet_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("tweet_text", T.StringType()),
    T.StructField("text", T.StringType()),
])

THREAD = T.StructType(REPLY.fields + [T.StructField("replies", T.ArrayType(REPLY))])

THREADS = T.StructType([T.StructField("results", T.ArrayType(THREAD))])

REPLY_MAP = T.MapType(T.StringType(), T.ArrayType(T.LongType()))

RAW_STATUS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("user", T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("screen_name", T.StringType()),
        T.StructField("followers_count", T.LongType()),
    ])),
])

# Trait table: ten scores and the account key in the last column.
TRAIT_COLUMNS = ["ADMIRATION", "AGRE", "ANXIETY", "AVOIDANCE", "CONS", "EXTR", "NARCISSISM", "NEUR", "OPEN", "RIVALRY"]

TRAITS = T.StructType(
    [T.StructField(name, T.DoubleType()) for name in TRAIT_COLUMNS] + [T.StructField("twitter_uid", T.LongType())]
)

EMOJI_LEXICON = T.StructType([
    T.StructField("emoji", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("anger", T.DoubleType()),
    T.StructField("fear", T.DoubleType()),
    T.StructField("joy", T.DoubleType()),
    T.StructField("sadness", T.DoubleType()),
])

WORD_SCORES = T.StructType([
    T.StructField("word", T.StringType()),
    T.StructField("valence", T.DoubleType()),
    T.StructField("polarity", T.DoubleType()),
])
