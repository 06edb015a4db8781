"""The ways taken for very large groups give the same rows as the plain ways."""

from datetime import datetime
from decimal import Decimal

import pytest
from helpers import rows_of, same
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlens.operators import skew
from threadlens.operators.extract import assign_uid, number_answers, question_status
from threadlens.operators.features import features
from threadlens.operators.quality import fix_counts, lift_tags, reconcile_counts
from threadlens.operators.ranks import RankSpec, add_ranks, first_row, guarded_rank
from threadlens.operators.reports import max_upvotes, predict_top, strawman
from threadlens.operators.threads import nest, thread_tags, threads
from threadlens.schema import THREAD

NONE = skew.HotKeys(THREAD, None)


@pytest.fixture(scope="module")
def answers(spark):
    """Thread 'big' holds most rows, and most of those share one value."""
    rows = []
    for i in range(400):
        thread = "big" if i % 3 else f"t{i % 17}"
        votes = "0" if i % 2 else str(i % 11 - 3)
        rows.append(("c", thread, f"u{i}", i, float(i * 37 % 23) if i % 13 else None, votes, "solution" if i % 5 == 0 else "---"))
    return spark.createDataFrame(
        rows, "site string, thread_id string, uid string, ordinal int, score double, upvotes string, resolve string"
    )


@pytest.fixture()
def tiny(monkeypatch):
    """Groups of more than five rows count as large everywhere."""
    monkeypatch.setattr(skew, "HOT_ROWS", 5)


def test_heavy_keys(answers):
    hot = skew.heavy_keys(answers, THREAD, 50)
    assert [r.thread_id for r in hot.frame.collect()] == ["big"]
    assert not skew.heavy_keys(answers, THREAD, 10_000)
    assert hot.hot(answers).count() + hot.cold(answers).count() == answers.count()


def test_null_keys_are_large_groups_too(spark):
    rows = spark.createDataFrame([(None, i) for i in range(9)] + [("t", 1)], "g string, x int")
    hot = skew.heavy_keys(rows, ["g"], 5)
    assert [r.g for r in hot.frame.collect()] == [None]
    assert hot.hot(rows).count() == 9 and [r.g for r in hot.cold(rows).collect()] == ["t"]
    totals = skew.attach_group(rows, ["g"], {"n": F.count("*")}, hot)
    assert {(r.g, r.n) for r in totals.collect()} == {(None, 9), ("t", 1)}


def test_all_large_keys_are_named(spark):
    rows = spark.range(30_000).select((F.col("id") / 2).cast("long").alias("g"))
    assert skew.heavy_keys(rows, ["g"], 1).frame.count() == 15_000


def test_ranks(answers, tiny):
    specs = [RankSpec("score", "down"), RankSpec("score", "up", descending=False), RankSpec("ordinal", "last")]
    same(add_ranks(answers, specs), add_ranks(answers, specs, hot=NONE))


@pytest.mark.parametrize(
    "kind, values",
    [
        ("string", ["9", "10", "100", "x", None, "10"]),
        ("bigint", [2**53, 2**53 + 1, 2**53 + 2, None, 2**53 + 1, -5]),
        ("decimal(38,2)", [Decimal("1e30"), Decimal("1e30") + Decimal("0.01"), None, Decimal(0), Decimal(0), Decimal(-1)]),
        ("double", [float("nan"), 1.0, None, float("inf"), -0.0, 0.0]),
        ("timestamp", [datetime(2020, 1, 1), datetime(2020, 1, 1, 0, 0, 0, 1), None, None, datetime(1960, 1, 1), datetime(2020, 1, 1)]),
    ],
)
def test_ranks_do_not_depend_on_the_size(spark, monkeypatch, kind, values):
    """Whole row sets with the limit at one row and at infinity, for keys of every type, NULL threads too."""
    rows = [(site, f"{site}{i}", v, i % 2) for site in ("a", "b", None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"site string, uid string, k {kind}, other int").withColumn("thread_id", F.lit("t"))
    specs = [RankSpec("k", "down"), RankSpec("k", "up", descending=False), RankSpec("other", "o")]
    plain = rows_of(add_ranks(df, specs, hot=NONE).drop("k"))
    monkeypatch.setattr(skew, "HOT_ROWS", 1)
    assert rows_of(add_ranks(df, specs).drop("k")) == plain


def test_text_ranks_go_by_number(spark):
    df = spark.createDataFrame([("a", "t", str(i), v) for i, v in enumerate(["9", "10", "100"])], "site string, thread_id string, uid string, k string")
    assert {r.k: r.k_rank for r in add_ranks(df, [RankSpec("k", "k_rank")]).collect()} == {"9": 3, "10": 2, "100": 1}


def test_guarded_rank(answers, tiny):
    mixed = answers.withColumn("upvotes", F.when((F.col("thread_id") == "t3") & (F.col("ordinal") > 100), "---").otherwise(F.col("upvotes")))
    got = guarded_rank(mixed, "upvotes")
    same(got, guarded_rank(mixed, "upvotes", hot=NONE))
    assert got.filter((F.col("thread_id") == "t3") & F.col("upvotes_rank").isNotNull()).isEmpty()


def test_numbers(answers, tiny):
    marked = answers.withColumns({"is_best": F.col("ordinal") == 7, "page_no": F.col("ordinal") % 4, "pos": F.col("ordinal")})
    same(number_answers(marked.drop("ordinal")), number_answers(marked.drop("ordinal"), hot=NONE))


def test_dense_numbers(answers):
    numbered = assign_uid(answers.select("uid"), ["uid"], "n")
    expected = {uid: i + 1 for i, uid in enumerate(sorted(r.uid for r in answers.collect()))}
    assert {r.uid: r.n for r in numbered.collect()} == expected


def test_running_total_covers_groups_over_many_pieces(spark):
    rows = spark.range(0, 20_000).withColumn("g", F.col("id") % 2)
    total = skew.running_total(rows, ["g"], ["id"], F.col("id"), "before")
    expected = rows.withColumn(
        "before",
        F.coalesce(F.sum("id").over(Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    total = total.select(expected.columns)
    assert total.exceptAll(expected).isEmpty() and expected.exceptAll(total).isEmpty()


def test_predictions(answers, tiny):
    got = predict_top(answers)
    same(got, predict_top(answers, hot=NONE))
    hits = got.filter(F.col("prediction") == "solution")
    a = hits.filter(F.col("resolve") == "solution").count()
    c = hits.filter(F.col("resolve") == "---").count()
    misses = got.filter(F.col("prediction") == "")
    b, d = misses.filter(F.col("resolve") == "---").count(), misses.filter(F.col("resolve") == "solution").count()
    row = strawman(answers).first()
    assert (row.a, row.b, row.c, row.d, row.total_answers) == (a, b, c, d, 400)


def test_only_negative_votes_predict_nothing(spark):
    rows = spark.createDataFrame(
        [("c", "t", "1", "-3", "solution"), ("c", "t", "2", "-1", "---")],
        "site string, thread_id string, uid string, upvotes string, resolve string",
    )
    assert [r.prediction for r in predict_top(rows).collect()] == ["", ""]
    assert tuple(strawman(rows).first())[:4] == (0, 1, 0, 1)
    assert strawman(rows.limit(0)).first().accuracy is None


def test_features(tables, monkeypatch):
    posts = tables.store
    plain = rows_of(features(posts, hot=NONE))
    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    hot = skew.heavy_keys(posts, THREAD)
    assert hot and not hot.cold(posts).isEmpty()
    assert rows_of(features(posts, hot=hot)) == plain


def test_features_of_the_other_site(tables):
    """The question counts as answer 1, the last answer is lost, and upvotes have no ranks."""
    posts = tables.store
    rows = features(posts, compat="c", unranked=["upvotes_rank"], hot=NONE)
    assert rows.filter(F.col("upvotes_rank").isNotNull()).isEmpty()
    pairs = {(r.question_uid, r.answer_uid) for r in rows.collect()}
    expected = {(r.question_uid, r.uid) for r in threads(posts, compat="c").collect()}
    assert pairs == expected and all((q, q) in pairs for q, _ in pairs)


def test_copies_of_a_question(tables):
    """Copies of a question do not multiply its answers."""
    posts = tables.store
    copies = posts.unionByName(posts.filter(F.col("type") == "question"))
    same(threads(copies).drop("text"), threads(posts).drop("text"))


def test_threads_and_first_rows(tables, monkeypatch):
    posts = tables.store.drop("text")
    plain = threads(posts)
    marked = first_row(plain, ("resolved",), hot=NONE)
    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    same(threads(posts), plain)
    same(first_row(threads(posts), ("resolved",)), marked)


def test_nested_threads_are_long(tables):
    nested, plain = nest(tables.store), threads(tables.store)
    assert nested.count() == plain.count()
    assert {(r.thread_id, r.ordinal, r.answer.uid) for r in nested.collect()} == {(r.thread_id, r.ordinal, r.uid) for r in plain.collect()}


def test_large_threads_keep_their_shape(spark):
    rows = [("a", "t", "question", 0, 2500, ["q"])] + [("a", "t", "answer", i, 0, [f"tag{i}"]) for i in range(1, 2501)]
    posts = spark.createDataFrame(rows, "site string, thread_id string, type string, ordinal int, answers int, tags array<string>")
    posts = posts.withColumns({"uid": F.col("ordinal").cast("string"), **{c: F.lit(None).cast("string") for c in ("author", "text", "date_time", "views", "upvotes", "resolve")}})
    assert nest(posts).count() == 2500
    assert thread_tags(posts, F.col("tags")).count() == 2501
    assert lift_tags(posts).filter("lifted").count() == 2500


def test_fixed_counts(tables):
    posts = tables.posts_gap()
    lowered = {r.thread_id: r.answers for r in reconcile_counts(posts).collect()}
    fixed = fix_counts(posts)
    assert fixed.columns == posts.columns and fixed.count() == posts.count()
    assert {r.thread_id: r.answers for r in fixed.filter("type = 'question'").collect()} == lowered


def test_threads_without_answers_are_there(spark):
    questions = spark.createDataFrame([("c", "1"), ("c", "2")], "site string, thread_id string")
    answers = spark.createDataFrame([("c", "1", True, "5")], "site string, thread_id string, is_best boolean, upvotes string")
    assert {(r.thread_id, r.resolve) for r in question_status(answers, questions).collect()} == {("1", "True"), ("2", "False")}
    assert {(r.thread_id, r.max_upvotes) for r in max_upvotes(answers, questions).collect()} == {("1", 5), ("2", 0)}


def test_prefix_counts(spark):
    def post(thread, ordinal, answers=0):
        kind = "question" if ordinal == 0 else "answer"
        return ("a", thread, ordinal, kind, answers)

    rows = [post("gap", 0, 4), post("gap", 1), post("gap", 2), post("gap", 4), post("none", 0, 2), post("full", 0, 1), post("full", 1)]
    rows += [post("late", 0, 3), post("late", 2), post("late", 3), post("copies", 0, 2), post("copies", 1), post("copies", 1), post("copies", 2)]
    df = spark.createDataFrame(rows, "site string, thread_id string, ordinal int, type string, answers int")
    got = {r.thread_id: (r.answers, r.lowered) for r in reconcile_counts(df).collect()}
    assert got == {"gap": (2, True), "none": (0, True), "full": (1, False), "late": (0, True), "copies": (2, False)}


def test_building_a_join_starts_no_job(spark, tables):
    """Joins and checks are plans only; nothing is probed or collected on the way."""
    posts = tables.store
    context = spark.sparkContext
    context.setJobGroup("built", "")
    try:
        threads(posts)
        threads(posts, compat="c")
        nest(posts)
        reconcile_counts(posts)
        fix_counts(posts)
        lift_tags(posts)
        assert not context.statusTracker().getJobIdsForGroup("built")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_staged_tables_are_released(spark):
    from threadlens import session

    held = session.run_dir(spark).removeprefix("file:")
    path = session.fresh_path(spark, "x")
    assert path.removeprefix("file:").startswith(held)
    table = session.stage(spark.range(3), "released")
    assert table.count() == 3


@pytest.mark.parametrize("limit", [0, 10**9])
def test_rows_that_repeat_a_uid_are_ranked_by_their_own_value(spark, monkeypatch, limit):
    monkeypatch.setattr(skew, "HOT_ROWS", limit)
    rows = spark.createDataFrame([("a", "t", "u1", 5), ("a", "t", "u1", 3), ("a", "t", "u2", 4)], "site string, thread_id string, uid string, v int")
    ranked = add_ranks(rows, [RankSpec("v", "high"), RankSpec("v", "low", False)])
    assert sorted((r.uid, r.v, r.high, r.low) for r in ranked.collect()) == [("u1", 3, 3, 1), ("u1", 5, 1, 3), ("u2", 4, 2, 2)]
    assert ranked.columns == ["site", "thread_id", "uid", "v", "high", "low"]
