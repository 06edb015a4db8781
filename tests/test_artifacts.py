"""Artifacts are addressed by their input and rules."""

from pathlib import Path

from pyspark.sql import functions as F

from threadlens.sources import tables
from threadlens.sources.tables import fingerprint, materialize_for


def rows(spark, *values):
    return spark.createDataFrame([(v, f"t{v}") for v in values], "v long, t string")


def test_fingerprint_ignores_order_and_sees_repeats(spark):
    one = rows(spark, 1, 2, 3, 3)
    assert fingerprint(one) == fingerprint(rows(spark, 3, 1, 3, 2).repartition(3))
    others = [rows(spark, 1, 2, 3), rows(spark, 1, 2, 2, 3), rows(spark), rows(spark, 1, 2, 3, 4), one.withColumn("t", F.lit(None).cast("string"))]
    assert len({fingerprint(d) for d in [one, *others]}) == 6


def test_changed_input_or_rules_rebuild_and_same_ones_reuse(spark, tmp_path):
    built = []

    def build(df):
        built.append(1)
        return df.select((F.col("v") * 10).alias("w"))

    def ask(df, rules="1"):
        return sorted(r.w for r in materialize_for(spark, str(tmp_path), df, rules, build).collect())

    assert ask(rows(spark, 1, 2)) == [10, 20] and len(built) == 1
    assert ask(rows(spark, 2, 1)) == [10, 20] and len(built) == 1
    assert ask(rows(spark, 1, 5)) == [10, 50] and len(built) == 2
    assert ask(rows(spark, 1, 2), "2") == [10, 20] and len(built) == 3
    assert ask(rows(spark)) == [] and len(built) == 4


def test_the_loser_of_a_race_reads_the_winners_table(spark, tmp_path):
    def winner(df):
        return df.select("v")

    def loser(df):
        materialize_for(spark, str(tmp_path), df, "1", winner)  # finished by another job meanwhile
        return df.select((F.col("v") + 100).alias("v"))

    got = materialize_for(spark, str(tmp_path), rows(spark, 1, 2), "1", loser)
    assert sorted(r.v for r in got.collect()) == [1, 2]
    assert len(list(Path(tmp_path).glob("manifest-*"))) == 1


def test_a_manifest_whose_writer_is_gone_is_made_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables.time, "sleep", lambda _: None)
    materialize_for(spark, str(tmp_path), rows(spark, 1), "1", lambda df: df)
    (manifest,) = Path(tmp_path).glob("manifest-*")
    manifest.write_text("")
    (Path(tmp_path) / f".{manifest.name}.crc").unlink(missing_ok=True)
    assert materialize_for(spark, str(tmp_path), rows(spark, 1), "1", lambda df: df).count() == 1
    assert manifest.read_text().startswith("table-")
