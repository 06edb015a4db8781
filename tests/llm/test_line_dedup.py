import hashlib
import random
from collections import defaultdict

from threadlens.llm.line_dedup import BASE, MODULUS, line_dedup


def cut(text):
    """Chunks by a plain loop."""
    lines = text.split("\n")
    h = [int(hashlib.md5(line.encode()).hexdigest()[:8], 16) for line in lines]
    r = [((h[i - 1] if i else 0) * BASE + h[i]) % MODULUS for i in range(len(h))]
    out, first = [], 0
    for i in range(1, len(lines) - 2):
        if r[i] < r[i - 1] and r[i] <= r[i + 1]:
            out.append(lines[first : i + 1])
            first = i + 1
    return [*out, lines[first:]]


def brute(rows):
    """{(doc_id, text): new text} by a loop over all chunks in order."""
    places = defaultdict(list)
    for i, t in rows:
        for no, c in enumerate(cut(t) if t is not None else []):
            if len(c) > 1 and any(x.strip(" ") for x in c):
                places["\n".join(c)].append((i is not None, i or 0, no, t))
    gone = {p for same in places.values() for p in same if p[:3] != min(same)[:3]}
    out = {}
    for i, t in rows:
        if t is not None:
            left = [c for no, c in enumerate(cut(t)) if (i is not None, i or 0, no, t) not in gone]
            out[i, t] = "\n".join(x for c in left for x in c)
        else:
            out[i, t] = None
    return out


def got(df):
    return {(r.doc_id, r.text) for r in df.collect()}


def test_against_brute_force(make):
    rnd = random.Random(3)
    pool = [f"line {rnd.randrange(10**6)}" for _ in range(60)]
    passage = [f"shared {i}" for i in range(14)]
    rows = []
    for i in range(80):
        lines = [rnd.choice(pool) + str(rnd.randrange(40)) for _ in range(rnd.randrange(0, 12))]
        if rnd.random() < 0.5:
            lines += passage[rnd.randrange(3) :]
        lines += [rnd.choice(pool) for _ in range(rnd.randrange(0, 5))]
        rows.append((i, "\n".join(lines)))
    rows += [(100 + i, rows[5][1]) for i in range(4)]
    expected = brute(rows)
    result = line_dedup(make([(i, t, None) for i, t in rows]))
    assert got(result) == {(i, left) for (i, t), left in expected.items()}
    # the shared passage is found in spite of different surroundings
    assert sum(t.count("shared 6") for t in expected.values()) < sum("shared 6" in t for _, t in rows) / 4


def test_edges(make, spark):
    text = "\n".join(f"some line {i}" for i in range(9))
    long = "\n".join("x" * 1000 for _ in range(2000))
    rows = [
        (1, None, None), (2, "", None), (3, "one line", None), (4, "one line", None), (5, "\n\n\n", None), (6, "\n\n\n", None),
        (7, text, None), (8, text, None), (9, long, None), (None, "a\nb", None), (10, "a\nb", None),
    ]
    df = make(rows, strange=True)
    result = line_dedup(df)
    assert result.columns[: len(df.columns)] == df.columns
    assert got(result) == {
        (1, None), (2, ""), (3, "one line"), (4, "one line"), (5, "\n\n\n"), (6, "\n\n\n"),
        (7, text), (8, ""), (9, long), (None, "a\nb"), (10, ""),
    }
    assert {r.doc_id: (r.n_lines, r.n_removed) for r in result.collect()}[8] == (9, 9)
    assert line_dedup(make([])).count() == 0


def test_repeated_rows_are_treated_alike(make):
    text = "\n".join(f"some line {i}" for i in range(9))
    assert [r.text for r in line_dedup(make([(1, text, None), (1, text, None)])).collect()] == [text, text]
    assert {(r.doc_id, r.text) for r in line_dedup(make([(1, text, None), (1, text, None), (2, text, None)])).collect()} == {(1, text), (2, "")}


def test_main_path_is_native(make):
    plan = line_dedup(make(["a\nb"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
