import random
import time

import pytest
import regex
from pyspark.sql import functions as F

from threadlens.llm import secret_scan as x


def texts(rnd, n):
    hexes = lambda k: "".join(rnd.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(rnd.choice("ABCDEFGHijklmnop0123456789") for _ in range(k))
    rows = []
    for i in range(n):
        kind = i % 6
        body = {
            0: f'the token = "{hexes(40)}" of',
            1: f"and password={mixed(18)} to",
            2: f"commit {hexes(40)} was",
            3: f"card {''.join(rnd.choice('0123456789') for _ in range(16))} is",
            4: f"see /docs/the_of_and_to_example_{i}/page_and_the_of to",
            5: "nothing to see here",
        }[kind]
        rows.append((i, f"some words of prose {body} the end of it", None))
    return rows


def by_loop(text):
    """Candidates by one search after the other."""
    return [(m.start(), m.group()) for m in regex.finditer(x.CANDIDATE, text)]


def test_candidates_and_places(make):
    rnd = random.Random(1)
    rows = texts(rnd, 60)
    rows += [(100, " ".join(t for _, t, _ in rows), None), (101, "é😀 token=abcdefgh1 " + rows[0][1], None), (102, "=abcdefgh-1234567890123456==", None)]
    got = {(r.id, r.start, r.value) for r in x.candidates(make(rows, strange=True)).collect()}
    assert got == {(i, at, value) for i, t, _ in rows for at, value in by_loop(t)}


def test_held_out_accuracy(make):
    """Labelled findings train the forest; others of the same kinds are told apart."""
    rnd = random.Random(2)
    train, test = texts(rnd, 600), texts(rnd, 300)
    df = make(train + [(10_000 + i, t, None) for i, t, _ in test])
    found = {(r.id, r.start): r.value for r in x.candidates(df).collect()}
    truth = {k: float(k[0] % 6 in (0, 1) if k[0] < 10_000 else (k[0] - 10_000) % 6 in (0, 1)) for k in found}
    labels = df.sparkSession.createDataFrame([(i, s, truth[i, s]) for i, s in found if i < 10_000], "doc_id long, start long, label double")
    got = x.scan_secrets(df, labels=labels).where(F.col("doc_id") >= 10_000).collect()
    right = [r.is_secret == bool(truth[r.doc_id, r.start]) for r in got]
    assert len(right) > 200 and sum(right) / len(right) > 0.97


def test_rules_are_the_default_labels(make):
    rows = texts(random.Random(3), 300)
    got = x.scan_secrets(make(rows)).collect()
    secret = {r.doc_id for r in got if r.is_secret}
    assert {i for i, _, _ in rows if i % 6 in (0, 1)} <= secret
    assert not [i for i in secret if i % 6 in (2, 3, 5)]


def test_edges(make):
    key = "-----BEGIN RSA PRIVATE KEY-----"
    rows = [(1, None, None), (2, "", None), (3, "no candidate", None), (4, key, None), (5, 'a="', None), (None, key, None), (6, key, None), (6, key, None)]
    got = x.scan_secrets(make(rows, strange=True)).collect()
    assert sorted(((r.doc_id or 0), r.start, r.value, r.score) for r in got) == [(i, 0, key, 1.0) for i in (0, 4, 6)]
    assert x.scan_secrets(make([])).count() == 0
    assert x.scan_secrets(make(["nothing"])).count() == 0


@pytest.mark.parametrize("piece", ["a", "a1", "=", "= '", "-----BEGIN ", "A/", "0"])
def test_long_runs_take_linear_time(make, piece):
    text = piece * (1_000_000 // len(piece))
    df = make([text])
    began = time.time()
    x.candidates(df).agg(F.sum("start")).collect()
    assert time.time() - began < 20


def test_main_path_is_native(make):
    plan = x.scan_secrets(make(texts(random.Random(4), 60)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


FORMS = {
    "password: Tr0ub4dor&3x": "Tr0ub4dor&3x",
    "password = S3cr3t!Pass#2024xyz": "S3cr3t!Pass#2024xyz",
    "token: abcdefghijklmnopqrstuvwx": "abcdefghijklmnopqrstuvwx",
    'api_key =  "abcDEFgh!jk"': "abcDEFgh!jk",
    'db_pass = "correct horse battery staple"': "correct horse battery staple",
    "Secret:   'it is \"quoted\" here'": 'it is "quoted" here',
    '{"password" : "hunter2hunter2"}': "hunter2hunter2",
    "auth_token :\tabcdefgh12345678==": "abcdefgh12345678==",
    "passwd = abcdef0123456789!tail": "abcdef0123456789!tail",
}


def test_forms_of_assignments(make):
    """Blanks around the sign, quoted values with blanks, values of letters only: found whole, and told as secrets."""
    rows = [(i, f"some words\n  {t}\nand more words", None) for i, t in enumerate(FORMS)]
    others = [(100 + i, t, None) for i, t in enumerate(("note: nothing follows", "the password is not here", 'say = "one two three"'))]
    noise = [(1000 + i, t, None) for i, t, _ in texts(random.Random(6), 120)]
    got = x.scan_secrets(make(rows + others + noise)).where("doc_id < 1000").collect()
    assert {(r.doc_id, r.value) for r in got} == set(enumerate(FORMS.values()))
    assert all(rows[r.doc_id][1][r.start :].startswith(r.value) and r.is_secret for r in got)


@pytest.mark.parametrize("piece", ["password: ", 'pass="', "pass='\"", "token =   ", "secret: 'a ", "pass=\"a pass='b "])
def test_long_runs_of_assignments_take_linear_time(make, piece):
    df = make([piece * (1_000_000 // len(piece))])
    began = time.time()
    x.candidates(df).agg(F.sum("start")).collect()
    assert time.time() - began < 20
