"""Operator 7: secret scans with a random forest that removes false positives.

Candidates are what patterns find: long unbroken strings with a digit, values behind ``=`` or ``:``, values that are
assigned to a credential's name (also behind up to three blanks, quoted ones with blanks within), and heads of
private keys. Each is described by its length, its character transitions (changes between digits, lower case,
upper case and symbols; shares of these; distinct characters), its dictionary coverage (share of it that frequent
words of the corpus cover), its path and its neighbouring words. A random forest trained from labelled
findings gives the probability of a secret; a finding below ``KEEP`` is a false positive.

Labelled findings are a table (doc_id, start, label 0/1). Where none is given, labels come from rules of high
precision: a value assigned to a credential's name or of a provider's fixed form is 1, others are 0. At most
``SAMPLE`` labelled findings, those with the smallest hash, are learned from. With labels of one kind only
there is nothing to learn and the label is the score.

The dictionary is the ``DICTIONARY`` most frequent words over all documents. Main path: DataFrame functions and the
forest of Spark's own library; texts are never shuffled, findings are narrow rows.

Defined results: null and empty texts have no findings; rows that repeat a doc_id and text give their findings
once; a null path has no mark; patterns are linear in the text (possessive), whatever its length.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlens.llm.common import quoted
from threadlens.session import stage

KEEP = 0.5
SAMPLE = 20_000
DICTIONARY = 200
TREES, DEPTH, SEED = 24, 6, 7

# Names that credentials are assigned to, and how.
_NAME = r"(?:pass|passwd|password|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential)s?[\"']?"
_NAMED = r"(?<=(?i:" + _NAME + r")\s{0,3}[=:]\s{0,3}"

# What a candidate looks like.
_CANDIDATES = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
    # assigned to a credential's name; the short look behind comes first, as it fails at nearly all places. A quoted
    # value ends at its quote, on the same line; one that has no such end is taken by the patterns below
    r"(?<=[=:]\s{0,3}[\"']?)(?:"
    + "|".join((
        _NAMED + r"\")[^\"\r\n]{8,}+(?=\")",
        _NAMED + r"')[^'\r\n]{8,}+(?=')",
        _NAMED + r")[^\s\"'=:,;]{8,}+={0,2}",
    ))
    + ")",
    # a whole run of at least 16 characters, one of them a digit
    r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}+={0,2}",
    r"(?<=[=:])[^\s\"'=:,;]{8,}+",
    r"(?<=[=:] ?[\"'])[^\s\"']{8,}+",
)
CANDIDATE = "|".join(_CANDIDATES)

# What stands before an assigned value, and forms that providers give theirs.
ASSIGNED = r"(?i)" + _NAME + r"\s{0,3}[=:]\s{0,3}[\"']?$"
PROVIDER = r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|sk-[0-9A-Za-z-]{20,}|AIza[0-9A-Za-z_-]{35}|-----BEGIN .*)$"

# Neighbouring words that speak for and against a secret, and paths of samples and generated files.
CREDENTIAL_WORDS = r"(?i)\b(?:pass|passwd|password|passphrase|pwd|secret|token|api[_-]?key|key|auth|bearer|credential)s?\b"
DIGEST_WORDS = r"(?i)\b(?:sha-?\d*|md5|commit|hash|digest|checksum|uuid|guid|revision|etag|isbn|card|phone|version)\b"
SAMPLE_PATH = r"(?i)(?:^|[/_.\-])(?:tests?|spec|fixtures?|examples?|samples?|mocks?|docs?|vendor|lock|min)(?:[/_.\-]|$)"

BEFORE, AFTER = 80, 40


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(id, th, path, pos, value, before, after, start): candidates in the order of the text."""
    path = F.lit(None).cast("string") if path_col is None else quoted(path_col).cast("string")
    texts = docs.select(quoted(id_col).alias("id"), path.alias("path"), quoted(text_col).alias("text"))
    texts = texts.where(F.col("text").rlike(CANDIDATE)).withColumn("th", F.xxhash64("text"))
    # what is not a candidate: one part before each and one behind the last
    parts = F.transform(
        F.split("text", CANDIDATE, -1),
        lambda p: F.struct(
            F.length(p).alias("n"), F.substring(p, -BEFORE, BEFORE).alias("tail"), F.substring(p, 1, AFTER).alias("head")
        ),
    )
    cut = texts.select("id", "th", "path", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("values"), parts.alias("parts"))
    n = F.size("values")
    zipped = F.arrays_zip(
        F.col("values").alias("value"), F.slice("parts", F.lit(1), n).alias("left"), F.slice("parts", F.lit(2), n).alias("right")
    )
    found = cut.select("id", "th", "path", F.posexplode(zipped).alias("pos", "c")).select(
        "id", "th", "path", "pos", F.col("c.value").alias("value"), F.col("c.left.n").alias("gap"),
        # a short gap has the end of the candidate before it in view
        F.col("c.left.tail").alias("before"), F.col("c.right.head").alias("after"),
    )
    once = found.dropDuplicates(["id", "th", "pos"])
    upto = Window.partitionBy("id", "th").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum(F.col("gap") + F.length("value")).over(upto)
    return once.withColumn("start", (ends - F.length("value")).cast("long")).drop("gap")


def dictionary(docs: DataFrame, text_col: str = "text", words: int = DICTIONARY) -> list[str]:
    """The most frequent words of 3 to 12 letters over all documents, counted before the shuffle."""
    word = F.explode(F.split(F.lower(quoted(text_col)), r"[^\p{L}]+")).alias("w")
    counts = docs.select(word).where(F.length("w").between(3, 12)).groupBy("w").agg(F.count("*").alias("n"))
    return [r.w for r in counts.orderBy(F.desc("n"), "w").limit(words).collect()]


def _share(value: Column, kind: str) -> Column:
    return F.regexp_count(value, F.lit(kind)) / F.length(value)


def _classes(value: Column) -> Column:
    """Each character as its class: a digit, lower case, upper case, or symbol."""
    out = value
    for pattern, mark in ((r"[0-9]", "0"), (r"\p{Ll}", "a"), (r"\p{Lu}", "A"), (r"[^0aA]", "-")):
        out = F.regexp_replace(out, pattern, mark)
    return out


FEATURES = (
    "length", "digits", "lower", "upper", "symbols", "transitions", "distinct", "hex", "coverage",
    "sample_path", "credential_words", "digest_words", "assigned", "quoted",
)


def features(found: DataFrame, words: list[str]) -> DataFrame:
    """``found`` with one double column for each of ``FEATURES``."""
    value, before, after = F.col("value"), F.col("before"), F.col("after")
    longest = sorted((w for w in words if w.isalpha()), key=lambda w: (-len(w), w))
    uncovered = F.regexp_replace(F.lower(value), "|".join(longest), "") if longest else value
    near = F.concat(F.regexp_extract(before, r"(?:\S+\s+){0,2}\S*\s*$", 0), F.lit(" "), F.regexp_extract(after, r"^\s*\S*(?:\s+\S+)?", 0))
    made = {
        "length": F.length(value),
        "digits": _share(value, r"[0-9]"),
        "lower": _share(value, r"\p{Ll}"),
        "upper": _share(value, r"\p{Lu}"),
        "symbols": _share(value, r"[^\p{L}0-9]"),
        "transitions": F.regexp_count(_classes(value), F.lit(r"0(?=[^0])|a(?=[^a])|A(?=[^A])|-(?=[^-])")) / F.length(value),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.length(value),
        "hex": value.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$").cast("int"),
        "coverage": 1 - F.length(uncovered) / F.length(value),
        "sample_path": F.coalesce(F.col("path").rlike(SAMPLE_PATH), F.lit(False)).cast("int"),
        "credential_words": near.rlike(CREDENTIAL_WORDS).cast("int"),
        "digest_words": near.rlike(DIGEST_WORDS).cast("int"),
        "assigned": before.rlike(r"[=:]\s{0,3}[\"']?$").cast("int"),
        "quoted": before.rlike(r"[\"']$").cast("int"),
    }
    return found.select("*", *[made[name].cast("double").alias(name) for name in FEATURES])


def rule_label() -> Column:
    return (F.col("before").rlike(ASSIGNED) | F.col("value").rlike(PROVIDER)).cast("double")


def forest(labelled: DataFrame, sample: int = SAMPLE):
    """Forest fitted to a bounded sample of ``labelled`` (features, label, id, start); None if all labels are
    alike. The sample is one sorted partition, so the forest does not depend on how the table is split."""
    key = F.xxhash64("id", "start", "value")
    rows = labelled.withColumn("key", key).orderBy("key", "id", "start").limit(sample)
    rows = stage(rows.select(*FEATURES, "label").coalesce(1), "labelled-findings")
    if rows.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(rows)
    return RandomForestClassifier(featuresCol="vector", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(vectors)


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str | None = "source",
    labels: DataFrame | None = None,
) -> DataFrame:
    """One row a candidate: id, start (character, from 0), value, score, is_secret."""
    found = candidates(docs, id_col, text_col, path_col)
    known = stage(features(found, dictionary(docs, text_col)), "findings")
    if labels is None:
        labelled = known.withColumn("label", rule_label())
    else:
        given = labels.select(quoted(id_col).alias("id"), F.col("start").cast("long").alias("start"), F.col("label").cast("double").alias("label"))
        labelled = known.join(given.where("label is not null"), ["id", "start"])
    model = forest(labelled)
    if model is None:
        default = F.lit(0.0) if labels is not None else rule_label()
        scored = known.withColumn("score", default)
    else:
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(known)
        scored = model.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    return scored.select(
        F.col("id").alias(id_col), "start", "value", F.col("score"), (F.col("score") >= KEEP).alias("is_secret")
    )
