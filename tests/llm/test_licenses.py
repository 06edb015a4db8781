import random
import time
from collections import Counter

import pytest

from threadlens.llm import licenses as n


def dice(a, b):
    a, b = (Counter(zip(x, x[1:], strict=False)) for x in (a, b))
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


def brute(text, templates, threshold):
    """All runs of lines against all templates."""
    lines = n.text_lines(text.encode())
    best = {}
    for name, several in sorted(templates.items()):
        for template in several:
            words = [w for line in n.text_lines(template.encode()) for w in line]
            for i in range(len(lines)):
                for j in range(i, len(lines)):
                    if not lines[i] or not lines[j]:
                        continue
                    value = dice([w for line in lines[i : j + 1] for w in line], words)
                    if value >= threshold and (name not in best or (-value, i, j) < best[name]):
                        best[name] = (-value, i, j)
    chosen = []
    for name, (value, i, j) in sorted(best.items(), key=lambda x: (x[1][0], x[0])):
        if all(j < a or i > b for _, _, a, b in chosen):
            chosen.append((name, -value, i, j))
    return sorted(chosen, key=lambda x: (x[2], x[0]))


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force(seed):
    rnd = random.Random(seed)
    vocabulary = "the of and license software this is provided under a version any to".split()
    templates = {f"T{k}": tuple(" ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([4, 8, 15]))) for _ in range(2)) for k in range(5)}
    scanner = n.Scanner(templates, 0.6)
    for _ in range(40):
        lines = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 9))) for _ in range(6)]
        planted = rnd.choice(rnd.choice(list(templates.values()))).split()
        if rnd.random() < 0.7:
            planted[rnd.randrange(len(planted))] = "changed"
        cut = rnd.randrange(1, len(planted))
        lines[3:3] = [" ".join(planted[:cut]).title(), " ".join(planted[cut:]) + "."]
        text = "\n".join(lines)
        got = [(a, round(b, 9), c, d) for a, b, c, d in scanner.scan(text.encode())]
        assert got == [(a, round(b, 9), c, d) for a, b, c, d in brute(text, templates, 0.6)]


def test_templates_find_themselves(make):
    rows, expected = [], set()
    for name, several in n.TEMPLATES.items():
        for text in several:
            rows.append(f"prose before it\n\nCopyright (c) 2020 Some One\n{text.upper()}\n\nprose behind it")
            expected.add((len(rows) - 1, name, 1.0))
    got = {(r.doc_id, r.license_id, round(r.dice, 9)) for r in n.scan_licenses(make(rows, strange=True)).collect()}
    assert got == expected


def test_near_texts_and_others(make):
    mit = n.TEMPLATES["MIT"][0].replace("charge", "cost").replace("sell copies", "sell any copies")
    rows = [mit, "The licence of this work is not stated.", "Released under the MIT Licence", "of the and to the of", None, "", "x " * 300_000]
    got = {(r.doc_id, r.license_id) for r in n.scan_licenses(make(rows)).collect()}
    assert got == {(0, "MIT"), (2, "MIT")}
    assert n.scan_licenses(make([])).count() == 0
    twice = n.scan_licenses(make([(1, "Released under the MIT License.", None)] * 2)).collect()
    assert [tuple(r) for r in twice] == [(1, "MIT", 1.0, 0, 0)] * 2


def test_every_occurrence_is_found():
    """One licence several times, and a licence whose best run lies in the text of another."""
    bsd2, bsd3 = n.TEMPLATES["BSD-2-Clause"][0], n.TEMPLATES["BSD-3-Clause"][0]
    changed = bsd2.replace("reproduce", "show").replace("SPECIAL", "ODD").replace("STRICT", "ANY")
    parts = [n.TEMPLATES["MIT"][0], "prose", bsd3, "prose", changed, "prose", n.TEMPLATES["MIT"][0], "Released under the MIT License."]
    places, at = [], 0
    for part in parts:
        places.append((at, at + part.count("\n")))
        at = places[-1][1] + 1
    got = [(name, i, j) for name, _, i, j in n.Scanner(n.TEMPLATES).scan("\n".join(parts).encode())]
    names = ["MIT", None, "BSD-3-Clause", None, "BSD-2-Clause", None, "MIT", "MIT"]
    assert got == [(name, *place) for name, place in zip(names, places, strict=True) if name]


def test_runs_against_all_runs():
    """All runs of lines against all templates, the best first, none twice."""
    rnd = random.Random(9)
    vocabulary = "the of and license software this is".split()
    templates = {f"T{k}": (" ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([5, 9]))),) for k in range(4)}
    several = 0
    for _ in range(60):
        lines = []
        for _ in range(5):
            words = rnd.choice(list(templates.values()))[0].split()
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            lines += [" ".join(words[:3]), " ".join(words[3:]), "something else here"]
        text = "\n".join(lines)
        runs = []
        for name, (template,) in templates.items():
            for i in range(len(lines)):
                for j in range(i, len(lines)):
                    value = dice([w for line in n.text_lines("\n".join(lines[i : j + 1]).encode()) for w in line], template.encode().split())
                    if value >= 0.6:
                        runs.append((-value, name, i, j))
        chosen = []
        for value, name, i, j in sorted(runs):
            if all(j < a or i > b for _, _, a, b in chosen):
                chosen.append((name, round(-value, 9), i, j))
        got = [(a, round(b, 9), c, d) for a, b, c, d in n.Scanner(templates, 0.6).scan(text.encode())]
        assert got == sorted(chosen, key=lambda x: (x[2], x[0]))
        several += len({x[0] for x in got}) < len(got)
    assert several > 10


def test_only_the_holder_goes():
    """What stands in the line behind the holder's clause counts, and so do lines that only begin with the word."""
    scan = n.Scanner(n.TEMPLATES).scan
    flat = n.TEMPLATES["MIT"][0].replace("\n", " ")
    for text, dice in (
        ("Copyright (c) 2024 X. Released under the MIT License.", 1.0),
        ("Copyright 2019-2024 X Inc. All rights reserved. Released under the MIT License.", 1.0),
        (f"Copyright (c) 2024 Some One. {flat}", 1.0),
        (f"Copyright (c) 2024 Some One {flat}", 0.97),
    ):
        assert [(name, value >= dice - 1e-9) for name, value, _, _ in scan(text.encode())] == [("MIT", True)]
    kept = "copyright holders be liable for any claim".encode()
    assert n.line_words(kept.upper()) == kept.split()
    for line in (b"Copyright (c) 2020 Some One", b"(c) Copyright 2020 A. B. Some", b"COPYRIGHT Some One", "Copyright © Zoë".encode()):
        assert b"copyright" not in n.line_words(line)


def test_relatives_are_told_apart():
    scan = n.Scanner(n.TEMPLATES).scan
    for name in ("AGPL-3.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "CC0-1.0", "Zlib", "BSL-1.0", "EPL-2.0"):
        for text in n.TEMPLATES[name]:
            assert [f[0] for f in scan(text.encode())] == [name]


def test_a_long_line_of_a_holder_takes_linear_time():
    began = time.time()
    n.Scanner(n.TEMPLATES).scan(b"copyright " + b"a.b " * 500_000)
    assert time.time() - began < 10
