import random

from pyspark.sql import functions as F

from parallaxa.llm.abuse import FEATURES, AbuseModel, Lexicon, dense_features, fold, score_texts, terms, word_key

SMALL = AbuseModel(trees=8, depth=3)
NONE = Lexicon({})
GOOD = ["The strap is solid and the box was neat", "Nothing rattles after 5 weeks", "Your lens works at night", "My rat likes the cage"]
BAD = ["Only a worthless idiot would work there", "Kill yourself, moron", "Come over and lick me", "Foreigners are vermin"]


def test_disguises_fold_to_the_same_words():
    plain = fold("you worthless bastard")[0]
    for text in ("you w o r t h l e s s b-a-s-t-a-r-d", "y​ou wоrthlеss bastarrrd", "You w0rthle$s b_astard", "YOU wortlhess basatrd!", "<b>you</b> worthless&#32;bastard"):
        assert fold(text)[0] == plain, text
    assert word_key("f*ck") == word_key("f**k") and word_key("12") == word_key("mt63975") == "0"


def test_features_of_nothing():
    assert set(dense_features(None, NONE)) == set(dense_features("", NONE)) == set(dense_features(" 😀 !! ** ", NONE)) == {0.0}
    assert len(dense_features("x " * 200_000, NONE)) == len(dense_features("", NONE))


def test_words_of_running_japanese():
    at = {n: i for i, n in enumerate(FEATURES)}
    for text, kind in (
        ("お前は本当にバカだ。", "slur"), ("おまえらはみんなクズ野郎だ", "slur"), ("ﾊﾞｶは黙れ", "slur"), ("お前は馬鹿だ", "slur"), ("さっさと死ねよ", "threat"),
        ("外国人は出て行け", "group"), ("セックスしようよ", "sexual"), ("ハ\u3099カめ", "slur"), ("you馬鹿", "slur"),
    ):
        found = dense_features(text, NONE)
        assert found[at[f"{kind}_density"]] > 0 and found[at[f"{kind}_sentence"]] > 0, text
    assert dense_features("お前は本当にバカだ。", NONE)[at["near_second"]] >= 0.25
    assert dense_features("あなたの三脚", NONE)[at["second_density"]] > 0
    for text in ("バカンスに持って行きました。", "裸足で使えます。", "ハカセの三脚は5週間で届きました。", "クスリ", "カメラのボタン"):
        found = dense_features(text, NONE)
        assert not any(found[at[f"{kind}_sentence"]] for kind in ("slur", "insult", "threat", "hate", "sexual")), text
        assert found[at["disguised"]] == 0, text


def test_terms_inside_running_japanese():
    learned = set(terms(fold("お前の顔はゲロだ")[0][0]))
    shared = learned & set(terms(fold("やっぱりゲロだと思う")[0][0]))
    assert "ゲ ロ" in shared and "ゲ ロ だ" in shared
    assert fold("Привет, 你好")[0] == [[word_key("привет"), "你", "好"]]


def corpus(n):
    rnd = random.Random(6)
    docs, truth = [], {}
    for i in range(n):
        bad = rnd.random() < 0.3
        parts = [rnd.choice(GOOD) for _ in range(rnd.randrange(4))] + [rnd.choice(BAD if bad else GOOD)]
        rnd.shuffle(parts)
        docs.append((i, ". ".join(parts)))
        truth[i] = bad
    return docs, truth


def test_held_out_accuracy_with_noisy_judgements(spark):
    docs, truth = corpus(400)
    rnd = random.Random(7)
    labels = [(i, 1, truth[i] ^ (rnd.random() < 0.04)) for i in range(200)]
    labels += [(i, 2, truth[i]) for i in range(100)] + [(5, 3, None), (None, 1, True), (9999, 1, True)]
    extra = [(1000, None), (1001, ""), (1002, "?!"), (3, docs[3][1])]
    d = spark.createDataFrame(docs + extra, "doc_id bigint, text string").selectExpr("*", "1 as label", "2 as fold", "3 as score")
    lab = spark.createDataFrame(labels, "doc_id bigint, annotator_id int, abusive boolean")
    rows = score_texts(d, lab, SMALL).rows.collect()
    assert len(rows) == len(docs) + len(extra) and all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r for r in rows}
    assert got[1000].score == got[1001].score == 0 and not got[1002].abusive
    held = [i for i in range(200, 400)]
    assert sum(got[i].abusive == truth[i] for i in held) >= 0.95 * len(held)


def test_few_judgements_still_find(spark):
    """Six judged cases in 400 texts, as few as a hash quarter might miss altogether."""
    docs = [(i, "You are a worthless idiot" if i % 4 == 0 else f"{GOOD[i % 4]} and {i}") for i in range(400)]
    labels = [(i, 1, i % 4 == 0) for i in range(24)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    lab = spark.createDataFrame(labels, "doc_id bigint, annotator_id int, abusive boolean")
    rows = score_texts(d, lab, SMALL).rows.collect()
    assert {r.doc_id for r in rows if r.abusive} == {i for i in range(0, 400, 4)}
    lab = lab.where("doc_id < 20")  # five cases, three of them for the trees
    assert sum(r.abusive for r in score_texts(d, lab, SMALL).rows.collect() if r.doc_id % 4 == 0) == 100


def test_without_judgements_nothing_is_known(spark):
    d = spark.createDataFrame([(1, "You idiot"), (2, "A neat strap"), (3, None)], "doc_id bigint, text string")
    lab = spark.createDataFrame([(1, 1, True)], "doc_id bigint, annotator_id int, abusive boolean")
    for labels in (lab, lab.limit(0)):
        got = {r.doc_id: (r.score, r.abusive) for r in score_texts(d, labels).rows.collect()}
        assert got == {1: (None, False), 2: (None, False), 3: (0.0, False)}
    assert score_texts(d.limit(0), lab).rows.count() == 0


def test_kept_columns_and_long_tags(spark):
    docs, truth = corpus(120)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "doc_id % 3 as score", "'x' as text2")
    lab = spark.createDataFrame([(i, 1, truth[i]) for i in range(60)], "doc_id bigint, annotator_id int, abusive boolean")
    rows = score_texts(d.drop("score").withColumn("origin", F.col("doc_id") % 3), lab, SMALL, keep=["origin"]).rows.collect()
    assert all(r.origin == r.doc_id % 3 for r in rows) and len(rows) == 120
    tag = '<a href="' + "idiot-bastard-" * 40 + '">'
    assert fold(f"a {tag}neat strap")[0] == fold("a neat strap")[0]
