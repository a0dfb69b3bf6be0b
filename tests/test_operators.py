import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.operators import features as ft
from threadlens.operators import metrics as mt
from threadlens.operators import relational as rel
from threadlens.operators import skew
from threadlens.operators import threads as th
from threadlens.operators import surrogate as sg


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_ranks_of_a_hot_group_equal_a_window(spark):
    """One key holds most of the rows and spans many ranges."""
    data = [(1 if i % 10 else i, i * 3) for i in range(2000)]
    df = spark.createDataFrame(data, "k int, v long")
    got = rows(skew.position_in_group(df, ["k"], "v", width=64), "v")
    seen, want = {}, []
    for k, v in sorted(data, key=lambda r: r[1]):
        want.append((k, v, seen.get(k, 0)))
        seen[k] = seen.get(k, 0) + 1
    assert got == want


def test_hash_order_is_a_rank_per_stratum(spark):
    df = spark.range(1000).withColumn("s", (F.col("id") % 7 == 0).cast("int"))
    out = skew.hash_order(df, ["s"], F.pmod(F.xxhash64("id"), F.lit(1000)), ["id"], 1000, buckets=16)
    for s, n in ((0, 857), (1, 143)):
        assert sorted(r.pos for r in out.where(F.col("s") == s).collect()) == list(range(n))


def test_running_totals_and_positions(spark):
    values = np.random.default_rng(1).permutation(3000)
    df = spark.createDataFrame([(float(v), int(v) % 5) for v in values], "x double, n long")
    got = rows(skew.running_totals(df, "x", ["n"], descending=True, buckets=8), F.desc("x"))
    total = 0
    for x, n, cum in got:
        total += n
        assert cum == total
    sliced = rel.slice_rows(df.select("x"), "x", 100, 110)
    assert [r[0] for r in rows(sliced, "x")] == [float(i) for i in range(100, 110)]


def test_top_k_with_a_hot_key(spark):
    df = spark.createDataFrame([(0 if i < 900 else i, i) for i in range(1000)], "k int, v int")
    got = skew.top_k(df, ["k"], [F.desc("v")], 3, ["v"], salts=8)
    assert [r.v for r in got.where("k = 0").orderBy("rank").collect()] == [899, 898, 897]
    assert got.count() == 103


def test_partition_count_does_not_change_results(spark):
    df = spark.createDataFrame([(i, f"w{i % 7} w{i % 11} w{i % 3}") for i in range(300)], "id long, t string")
    results = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(rows(ft.vocabulary(df, "t", 1, 2, [], k=50), "term"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]


def test_vocabulary_pruning_equals_full_counting(spark, monkeypatch):
    texts = ["red red car", "red car park", "blue car", "park bench red car", "blue blue sky"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    pruned = rows(ft.vocabulary(df, "t", 1, 3, [], min_df=0.4, max_df=0.9), "term")
    crowded = ft.frequent_slots
    monkeypatch.setattr(ft, "frequent_slots", lambda tokens, least: crowded(tokens, F.lit(0)))  # every word passes
    assert pruned == rows(ft.vocabulary(df, "t", 1, 3, [], min_df=0.4, max_df=0.9), "term")
    assert [(r[0], r[1], r[2]) for r in pruned] == [
        ("blue", 3, 2), ("car", 4, 4), ("park", 2, 2), ("red", 4, 3), ("red car", 3, 3)]


def test_tfidf_matches_the_formula(spark):
    df = spark.createDataFrame([(0, "aa bb aa"), (1, "bb cc"), (2, "zz")], "id long, t string")
    model = ft.fit_tfidf(df.where("id < 2"), "t", 1, 1, [], min_df=0.0, max_df=1.0)
    out = {(r.id, r.term): r.weight for r in model.long_form(model.transform(df, "t"), "tfidf", ["id"]).collect()}
    rare, common = np.log(3 / 2) + 1, np.log(3 / 3) + 1
    length = np.hypot(2 * rare, common)
    assert out[(0, "aa")] == pytest.approx(2 * rare / length)
    assert out[(0, "bb")] == pytest.approx(common / length)
    assert not [k for k in out if k[0] == 2]


def test_scaling_and_bins(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (1, 3.0, 5.0), (2, None, 5.0), (3, 4.0, 5.0)], "id int, a double, b double")
    assert rows(ft.min_max_scale(df, ["a", "b"]), "id") == [
        (0, 0.0, 0.0), (1, pytest.approx(2 / 3), 0.0), (2, None, 0.0), (3, 1.0, 0.0)]
    values = spark.createDataFrame([(i, float(v), 2.0) for i, v in enumerate([0, 1, 2, 3])], "id int, a double, b double")
    # 1 and 2 lie on inner edges and belong to the lower bin; a constant lies in the middle
    assert rows(ft.equal_width_bins(values, ["a", "b"]), "id") == [(0, 0, 1), (1, 0, 1), (2, 1, 1), (3, 2, 1)]


def test_word_scores_negation_reaches_three_words(spark):
    df = spark.createDataFrame([(0, "not really so good"), (1, "not one two three good"), (2, "nothing")], "id long, t string")
    lexicon = spark.createDataFrame([("good", 2.0, 0.5)], "word string, valence double, polarity double")
    got = rows(ft.word_scores(df, "id", "t", lexicon), "id")
    near, far = -0.74 * 2.0, 2.0
    assert got[0][1] == pytest.approx(near / np.sqrt(near ** 2 + 15))
    assert got[1][1] == pytest.approx(far / np.sqrt(far ** 2 + 15))
    assert got[2][1:] == (0.0, 0.0, 0)


def test_word_scores_look_up_in_the_task_as_by_a_join(spark):
    df = spark.createDataFrame([(0, "no good bad, odd"), (1, "not a plain good good"), (1, "bad not"), (2, None), (None, "good odd")],
                               "id long, t string")
    lexicon = spark.createDataFrame([("good", 2.0, 0.5), ("bad", -1.5, None), ("bad", 1.0, 0.25), ("odd", None, 0.1), (None, 9.0, 9.0)],
                                    "word string, valence double, polarity double")
    own, joined = (rows(ft.word_scores(df, "id", "t", lexicon, max_words=n).where("id is not null"), "id") for n in (10, 0))
    assert own[0][1:] == pytest.approx(joined[0][1:]) and own[1][1:] == pytest.approx(joined[1][1:]) and own[2] == joined[2]
    plan = ft.word_scores(df, "id", "t", lexicon)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_full_outer_rejects_duplicates(spark):
    a = spark.createDataFrame([("u", 1), ("v", 2)], "user_id string, a int")
    b = spark.createDataFrame([("v", 3), ("w", 4)], "user_id string, b int")
    assert rows(rel.full_outer_features([a, b], "user_id"), "user_id") == [("u", 1, None), ("v", 2, 3), ("w", None, 4)]
    with pytest.raises(Exception, match="duplicate user_id"):
        rel.full_outer_features([a, b.union(b)], "user_id").collect()


THREADS = [
    (1, 0, "cats like milk", 1), (1, 1, "cats like fish", 1), (1, 2, "dogs like bones", 0), (1, 3, "dogs like bones", 0),
    (1, 4, "cats drink milk", 1), (2, 0, "root", 0), (2, 1, "same", 1), (2, 2, "label", 1), (3, 0, "alone", 1),
]


def threads(spark):
    return spark.createDataFrame(THREADS, "thread_id long, pos long, text string, label int")


def test_thread_filters_and_homophily(spark):
    t = threads(spark)
    kept = rel.filter_thread_size(t, "thread_id", F.col("pos") > 0, 3, 10)
    assert {r.thread_id for r in kept.collect()} == {1}
    flags = {r.thread_id: (r.homophilous, r.first_label) for r in rel.thread_homophily(t, "thread_id", "pos", "label").collect()}
    assert flags == {1: (0, 1), 2: (1, 1)}
    assert [r.thread_id for r in sg.homophily_report(t).collect()] == [2]


def test_exemplars_prefer_the_later_of_equal_replies(spark):
    t = threads(spark).where("thread_id = 1")
    similar = th.reply_similarity(t, th.thread_tfidf(t, "text"))
    best = {(r.label, r["rank"]): r.pos for r in th.exemplars(similar).collect()}
    assert best[(0, 1)] == 3 and best[(0, 2)] == 2


def test_surrogate_is_stationary_and_adds_up(spark):
    t = threads(spark).where("thread_id = 1").withColumn("proba", F.lit(0.5))
    distinct = sg.distinct_posts(t, ["text"])
    assert distinct.count() == 4
    found = sg.thread_surrogates(distinct, th.thread_tfidf(distinct, "text"))
    row = found.first()
    assert row.gradient < 1e-6
    assert sum(w.contribution for w in row.words) + row.intercept == pytest.approx(row.margin)
    assert row.surrogate_label == int(row.margin > 0) == 1
    result = sg.explain_threads(t, found).first()
    assert result.replies == 4 and result.tweet_text == "cats like milk"
def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.8), (0, 0.3), (1, 0.2), (0, 0.1)], "label int, score double")
    curve = rows(mt.roc_curve(df), F.desc("threshold"))
    third, two = pytest.approx(1 / 3), pytest.approx(2 / 3)
    assert curve == [(0.9, 0.0, third), (0.8, third, two), (0.3, two, two), (0.2, two, 1.0), (0.1, 1.0, 1.0)]
    # pairs won: 0.9 beats 3, 0.8 beats 2 and ties 1, 0.2 beats 1
    assert mt.roc_auc(df).first().auc == pytest.approx(6.5 / 9)
    assert mt.youden_threshold(df).first().threshold == 0.9
    assert rows(mt.pr_curve(df), F.desc("threshold"))[-1][0] == 0.2
    hard = df.withColumn("prediction", F.lit(0))
    report = {r["class"]: (r.precision, r.recall, r.f1, r.support) for r in mt.class_report(hard).collect()}
    assert report["1"] == (0.0, 0.0, 0.0, 3) and report["0"][:2] == (0.5, 1.0)


def test_one_row_per_user_and_root_at_any_length(spark):
    posts = [("u", i, f"{i},") for i in range(6000)] + [("v", 5000, "x"), ("v", 0, "y")]
    df = spark.createDataFrame(posts, "user string, pos long, t string").repartition(4)
    got = {r.user: (r.corpus, r.n_posts) for r in rel.concat_posts(df, "user", "pos", "t").collect()}
    assert got == {"u": ("".join(f"{i}," for i in range(6000)), 6000), "v": ("yx", 2)}
    lists = {r.user: r.reply_ids for r in rel.list_replies(df, "user", "pos", "t", width=64).collect()}
    assert lists["u"] == [f"{i}," for i in range(6000)] and lists["v"] == ["y", "x"]


def test_nested_threads_of_any_size(spark):
    posts = [(1, i, f"t{i}") for i in range(301)] + [(2, 0, "lone")]
    got = {r.thread: r for r in rel.nest_replies(spark.createDataFrame(posts, "thread int, pos int, t string").repartition(3),
                                                 "thread", "pos", ["t"]).collect()}
    assert got[1].n_replies == 300 and [p.t for p in got[1].replies] == [f"t{i}" for i in range(1, 301)]
    assert got[2].n_replies == 0 and got[2].replies == [] and got[2].t == "lone"


def test_distinct_first_by_digest(spark):
    df = spark.createDataFrame([("a", "x", 3), ("a", "x", 1), ("a", None, 2), (None, "a", 5), ("a", "", 4)], "l string, t string, i int")
    got = {(r.l, r.t, r.i) for r in rel.distinct_first(df, ["l", "t"], "i").collect()}
    assert got == {("a", "x", 1), ("a", None, 2), (None, "a", 5), ("a", "", 4)}


def test_shared_folder(spark):
    from threadlens.session import shared_dir

    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (configured or spark.sparkContext.getCheckpointDir()).rstrip("/")


def test_best_by_tie_rules(spark):
    df = spark.createDataFrame([("a", 0.7, 0), ("b", 0.7, 1), ("c", 0.1, 2)], "name string, s double, p int")
    assert rel.best_by(df, "s", "p", "name").first().best == "b"
    assert rel.best_by(df, "s", "p", "name", last_wins=False).first().best == "a"


def test_emotions_from_a_table_equal_the_columns(spark):
    from threadlens import lexicons as lex
    from threadlens.functions import emoji as em

    kept = lex.gated_emoji(lex.SEED_EMOJI, True)
    table = spark.createDataFrame([(e[0], e[1], *map(float, e[2:6])) for e in kept],
                                  "emoji string, name string, anger double, fear double, joy double, sadness double")
    marks = [e[0] for e in kept]
    texts = [marks[0] * 2 + " a " + marks[-1], "none", "é" + marks[1], None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    by_table = {r.id: tuple(r)[1:] for r in em.emotion_means_by(df, "id", "t", table).collect()}
    inline = df.select("id", *[c.alias(n) for n, c in em.emotion_means(F.col("t")).items()]).collect()
    for r in inline:
        assert by_table[r.id] == pytest.approx(tuple(x or 0.0 for x in tuple(r)[1:]))


def test_parts_of_a_group_are_the_group(spark):
    texts = [(u, i, None if i == 5 else f"{u}{i};") for u, n in (("a", 23), ("b", 1)) for i in range(n)]
    posts = spark.createDataFrame(texts, "user_id string, n long, text string").repartition(5)
    parts = rel.concat_parts(posts, "user_id", "n", "text", width=4).orderBy("user_id", "part").collect()
    whole = {r.user_id: r.corpus for r in rel.concat_posts(posts, "user_id", "n", "text").collect()}
    assert {u: "".join(p.corpus for p in parts if p.user_id == u) for u in whole} == whole
    assert [p.n_posts for p in parts if p.user_id == "a"] == [4, 4, 4, 4, 4, 3]
    nested = rel.nest_parts(posts, "user_id", "n", ["text"], 10).where("user_id = 'a'").orderBy("part").collect()
    assert [[r.n for r in p.replies] for p in nested] == [list(range(1, 10)), list(range(10, 20)), [20, 21, 22]]
    assert rel.concat_parts(posts.limit(0), "user_id", "n", "text").count() == 0


def test_sketched_vocabulary_equals_the_plain_one(spark):
    """Whatever the number of slots; small sketches let more n-grams pass, exact counts decide."""
    rows = [(" ".join(f"w{(i * j + j // 3) % 23}" for j in range(1, 30)),) for i in range(80)]
    docs = spark.createDataFrame([*rows, ("",), (None,)], "text string")
    plain = ft.vocabulary(docs, "text", 1, 3, None, 0.03, 0.9, 200, sketch_slots=0).collect()
    assert len(plain) > 50
    for slots in (1, 64, 1 << 14):
        assert ft.vocabulary(docs, "text", 1, 3, None, 0.03, 0.9, 200, sketch_slots=slots).collect() == plain
