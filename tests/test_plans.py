"""Physical plans: no Python workers, few exchanges, filters and columns at the scan."""

import math
import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as contract
from threadlens.operators.features import RANKS
from threadlens.operators.ranks import add_ranks
from threadlens.operators.skew import HotKeys
from threadlens.schema import POST, THREAD
from threadlens.sources.posts import read_store, write_posts


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q_ft_feature_table", "q_ft_loglik", "q_co_stems", "q_ex_html_text", "q_rp_confusion", "q_th_nested"])
def test_no_python_workers(spark, name):
    assert not re.search("EvalPython|MapInPandas|FlatMapGroups|BatchEval", plan_of(contract.queries()[name](spark, SMALL)))


def test_all_ranks_share_one_exchange(tables):
    columns = {s.key for s in RANKS}
    answers = tables.store.select(*THREAD, "uid", *[F.lit(1.0).alias(c) for c in columns])
    plan = plan_of(add_ranks(answers, RANKS, hot=HotKeys(THREAD, None)))
    assert plan.count("Exchange hashpartitioning") == 1


def test_feature_table_shuffles_no_text(spark):
    plan = plan_of(contract.queries()["q_ft_feature_table"](spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for line in plan.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "text#" not in line


def test_site_filter_prunes_folders(spark, tables, tmp_path):
    path = str(tmp_path / "posts")
    write_posts(tables.store.withColumn("site", F.element_at(F.array(F.lit("a"), F.lit("b")), F.col("ordinal") % 2 + 1)), path)
    plan = plan_of(read_store(spark, path, "b").select("uid"))
    assert re.search(r"PartitionFilters: \[.*site", plan)
    assert re.search(r"ReadSchema: struct<uid:string>", plan)
    assert read_store(spark, path).columns == POST.fieldNames()


def test_type_filter_reaches_the_scan(spark):
    plan = plan_of(contract.queries()["q_ft_feature_table"](spark, SMALL))
    assert "EqualTo(type,question)" in plan


def test_words_of_a_post_are_counted_before_the_lexicon_join(spark, tables):
    from threadlens.operators.corpus import lexicon, log_likelihood

    posts = spark.createDataFrame([(i, "again " * 200 + "twice twice") for i in range(20)], "uid long, text string")
    scored = log_likelihood(posts, lexicon(posts))
    logical = scored._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(logical) if "Join Inner" in line)
    left = [line for line in logical[join + 1 : join + 5] if "Aggregate" in line]
    assert left, logical
    # 200 x 200 occurrences of a word that stands 4,000 times in the corpus, 2 x 2 of one that stands 40 times; two stems
    expected = (200 * 200 * math.log(4_000) + 2 * 2 * math.log(40)) / 2
    assert {r.loglikelihood for r in scored.collect()} == {math.floor(expected * 100 + 0.5) / 100}
