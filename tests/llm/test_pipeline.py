"""The pipeline against plain loops, stage by stage and as a whole."""

import random
from collections import Counter

import corpus_pipeline as p
import pytest
from llm.test_decontaminate import brute as contaminated
from llm.test_language_id import SYLLABLES, words
from llm.test_line_dedup import brute as without_repeats
from llm.test_packing import contents, one_by_one
from llm.test_simhash_dedup import brute_components, fingerprint

from threadlens.llm import language_id, packing


def corpus():
    rnd = random.Random(11)
    passage = words(rnd, SYLLABLES["bb"], 30)
    line = lambda lang: words(rnd, SYLLABLES[lang], rnd.randrange(3, 12))
    shared = [line("aa") for _ in range(12)]
    rows = []
    for _ in range(70):
        lang = rnd.choice(sorted(SYLLABLES))
        rows.append([line(lang) for _ in range(rnd.randrange(1, 9))])
    for k in range(0, 70, 9):
        rows.append([*rows[k][:1], *shared, *rows[k + 1][:2]])
        rows.append([*rows[k], "Q"])  # a near copy
        rows.append([line("cc"), "see " + passage.upper() + " end"])
        rows.append(list(rows[k]))
    out = [(i, "\n".join(lines), rnd.choice(["aa", "bb", None])) for i, lines in enumerate(rows)]
    return [*out, (500, None, "aa"), (501, "", None), (502, "12 34 !", "bb"), (503, "W " * 9000, None), (504, "ka", None)], [(1, passage), (2, None)]


@pytest.fixture(scope="module")
def folder(spark, make, tmp_path_factory):
    rows, items = corpus()
    out = str(tmp_path_factory.mktemp("pipeline"))
    make(rows, strange=True).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_against_brute_force(spark, folder):
    rows, items = corpus()
    docs = [(i, t) for i, t, _ in rows if t and any(c.isalpha() for c in t)]
    shorter = without_repeats(docs)
    docs = [(i, shorter[i, t]) for i, t in docs if shorter[i, t] == t or shorter[i, t].strip(" ")]
    component = brute_components([(i, fingerprint(t)) for i, t in docs])
    docs = [(i, t) for i, t in docs if component[i] == i]
    bad = {i for i, _, hit, _ in contaminated(docs, items) if hit}
    docs = [(i, t) for i, t in docs if i not in bad]
    got = p.run(spark, folder).collect()
    assert {r.doc_id for r in got} == {i for i, _ in docs} and bad
    total = Counter()
    for r in got:
        total[r.doc_id] += r.length
    assert total == Counter({i: len(t.split()) for i, t in docs})
    top = max(packing.SIZES)
    sizes = Counter(n for t in total.values() for n in ([top] * (t // top) + [t % top]) if n)
    assert contents([r for r in got if r.length]) == one_by_one(sizes, packing.SIZES)


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in p.STAGES] == [
        "language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing",
    ]
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
        assert out.count() > 0
        assert p.STAGES[-1][1](spark, out, folder).count() > 0


def test_stages_on_an_empty_table(spark, folder, make):
    docs = make([], strange=True)
    for _, stage in p.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_clean_documents_stay(spark, folder):
    rows, _ = corpus()
    clean = {i for i, t, _ in rows[:70]}
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 70")
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    assert {r.doc_id for r in docs.collect()} == clean


def test_language_model_sees_the_stage_input(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert set(language_id.learn(docs)) == {"aa", "bb"}
