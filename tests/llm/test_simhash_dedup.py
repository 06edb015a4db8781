import random
import re

import xxhash
from pyspark.sql import functions as F

from threadlens.llm import simhash_dedup as s


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """{id: component} from (id, fingerprint)."""
    todo = {i: f for i, f in prints}
    out = {}
    for i in sorted(todo):
        if i in out:
            continue
        reached, front = {i}, [i]
        while front:
            k = front.pop()
            for j, f in todo.items():
                if j not in reached and (f ^ todo[k]).bit_count() <= 3:
                    reached.add(j)
                    front.append(j)
        out |= dict.fromkeys(reached, min(reached))
    return out


def texts():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdeéß") for _ in range(rnd.randrange(1, 6)))
    base = [" ".join(word() for _ in range(rnd.randrange(0, 120))) for _ in range(20)]
    out = list(base)
    for t in base:
        for _ in range(4):
            ws = t.split()
            for _ in range(rnd.randrange(0, 3)):
                if ws:
                    ws[rnd.randrange(len(ws))] = word()
            out.append("\t".join(ws).upper() if rnd.random() < 0.2 else " ".join(ws))
    return [*out, None, "", " \n", "one", "One", "one two", "a b c d e"]


def test_against_brute_force(make):
    rows = list(enumerate(texts()))
    got = s.simhash_classes(make([(i, t, None) for i, t in rows], strange=True)).select("id", s.hex16().alias("f"), "component_id").collect()
    prints = {i: fingerprint(t) for i, t in rows}
    assert {r.id: int(r.f, 16) for r in got} == prints
    assert {r.id: r.component_id for r in got} == brute_components(prints.items())


def test_all_links_within_three_bits(spark):
    """Fingerprints at chosen distances, chains among them: exactly the pairs at 1 to 3 bits."""
    rnd = random.Random(2)
    values = {0, 2**64 - 1}
    for _ in range(60):
        f = rnd.getrandbits(64)
        values.add(f)
        for bits in (1, 2, 3, 4, 5):
            g = f
            for b in rnd.sample(range(64), bits):
                g ^= 1 << b
            values.add(g)
    signed = {v - 2**64 if v >= 2**63 else v: v for v in values}
    got = {frozenset((r.a, r.b)) for r in s.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    expected = {frozenset((a, b)) for a in signed for b in signed if a != b and (signed[a] ^ signed[b]).bit_count() <= 3}
    assert got == expected and len(expected) > 100


def test_every_word_is_covered(spark):
    """Covering radius 1: the nearest anchor differs in at most one bit and is a code word."""
    rnd = random.Random(3)
    classes = spark.createDataFrame([(rnd.getrandbits(63),) for _ in range(200)], "fp long")
    homes, guests = s.anchors(classes)
    assert homes.withColumn("s", s._syndrome(F.col("anchor"))).where("s <> 0").count() == 0
    assert guests.withColumn("s", s._syndrome(F.col("anchor"))).where("s <> 0").count() == 0
    assert {r[0] for r in guests.groupBy("half", "guest").count().select("count").collect()} <= {1, 16}


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(str(i * 7919 % 1009) for i in range(5000))
    whole = s.fingerprint(text.encode())
    monkeypatch.setattr(s, "BLOCK", 100)
    assert s.fingerprint(text.encode()) == whole == (lambda f: f - 2**64 if f >= 2**63 else f)(fingerprint(text))


def test_stage_keeps_one_of_each_group(make):
    same = " ".join(f"word{i}" for i in range(50))
    rows = [(4, same, None), (2, same, None), (2, same, None), (9, same.upper(), None), (5, "another text altogether here", None), (None, "no id", None)]
    df = make(rows, strange=True)
    left = s.keep_one(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id or -1) for r in left.collect()) == [-1, 2, 5]
    assert s.simhash_classes(make([])).count() == 0


def test_components(spark):
    from threadlens.llm.common import components

    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (95, 100), (7, 7), (200, 300), (300, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_row_goes_only_if_another_of_its_component_stays(make):
    one, other = (" ".join(f"{w}{i}" for i in range(50)) for w in ("word", "thing"))
    rows = [(2, one, None), (2, other, None), (9, one, None), (None, "no id at all", None), (None, "no id at all", None), (None, other, None), (7, None, None)]
    left = sorted((r.doc_id or -1, r.text or "") for r in s.keep_one(make(rows, strange=True)).collect())
    assert left == [(-1, "no id at all"), (2, other), (2, one), (7, "")]
