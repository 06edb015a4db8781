"""Learned sentence ends against texts whose ends are known."""

import random
import time

import pytest
from conftest import SMALL

import __spark_entry__ as contract
from threadlens.functions import text as tx
from threadlens.operators.sentences import held_pairs, learned_sentences

NOUNS = "engine table river garden window letter market doctor bridge lesson winter number".split()
VERBS = "holds takes finds leaves keeps turns opens".split()


def made_texts(n, seed=7):
    """Texts of plain sentences; some have abbreviations inside. With each the true number of sentences and the longest."""
    rnd = random.Random(seed)

    def sentence():
        a, b, c = rnd.choice(NOUNS), rnd.choice(VERBS), rnd.choice(NOUNS)
        return rnd.choice(
            [
                f"The {a} {b} the {c}.",
                f"This {a} {b} a {c}!",
                f"It {b} the {c} and the {a}.",
                f"Then Dr. Smith {b} the {a}.",
                f"Some {a}s, e.g. the {c}, stay here.",
                f"The {a} and Mr. Brown saw approx. two {c}s.",
                f"Why is the {a} etc. near this {c}?",
            ]
        )

    out = []
    for i in range(n):
        parts = [sentence() for _ in range(rnd.randrange(1, 12))]
        out.append((i, " ".join(parts), len(parts), max(len(p.split()) for p in parts)))
    return out


@pytest.fixture(scope="module")
def made(spark):
    texts = made_texts(300)
    return texts, spark.createDataFrame([(i, t) for i, t, _, _ in texts], "uid long, text string")


def shown(df):
    return {r.uid: (r.sentences, r.longest_sentence) for r in df.collect()}


def test_planted_abbreviations_end_no_sentence(made):
    texts, posts = made
    got = shown(learned_sentences(posts, held_pairs(posts)))
    assert got == {i: (count, longest) for i, _, count, longest in texts}


def test_learned_pairs_serve_other_texts(spark, made):
    held = held_pairs(made[1])
    rows = [(1, "We met Dr. Smith. The end."), (2, "See e.g. the engine. It turns."), (3, "No mark"), (4, "The river."), (5, "")]
    rows += [(6, None), (7, " \n "), (8, "... !! ?"), (9, "wait... The end.")]
    got = shown(learned_sentences(spark.createDataFrame(rows, "uid long, text string"), held))
    assert got == {1: (2, 4), 2: (2, 4), 3: (1, 2), 4: (1, 2), 5: (0, 0), 6: (0, 0), 7: (0, 0), 8: (3, 1), 9: (2, 2)}


def test_without_pairs_the_fixed_rule_stands(spark, made):
    texts, posts = made
    none = held_pairs(posts.limit(0))
    assert none.count() == 0
    got = {r.uid: r.sentences for r in learned_sentences(posts, none).collect()}
    assert got == {r.uid: r.n for r in posts.select("uid", tx.sentence_count(posts.text).alias("n")).collect()}


def test_clashing_columns_stay_out(spark, made):
    posts = made[1].selectExpr("uid", "text", "1 as n", "2 as at", "3 as sentences", "4 as type", "5 as word")
    assert shown(learned_sentences(posts, held_pairs(posts))) == {i: (c, m) for i, _, c, m in made[0]}


@pytest.mark.parametrize("text", ["a" + "-" * 500_000 + "b. C", "a. " * 300_000, "a." * 300_000, "." * 500_000 + " x"])
def test_time_grows_with_the_text(spark, made, text):
    posts = spark.createDataFrame([(1, text)], "uid long, text string")
    start = time.time()
    assert len(shown(learned_sentences(posts, held_pairs(posts)))) == 1
    assert time.time() - start < 40


def test_no_python_workers(spark):
    plan = contract.queries()["q_ft_sentences_learned"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
