import hashlib

from pyspark.sql import functions as F

from threadlens.llm.chat import rotate


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "unknown", text or ""))
    out = []
    for conv, held in convs.items():
        held.sort(key=lambda t: (*t[:3], hashlib.md5(t[3].encode()).hexdigest()))
        for who in {t[2] for t in held} - {"system"}:
            at = 0
            for known, turn, speaker, text in held:
                role = "system" if speaker == "system" else "assistant" if speaker == who else f"user name={speaker}"
                head, body = f"<|im_start|>{role}\n", text.replace("<|", "<\\|") + "<|im_end|>"
                mask = (at + len(head), at + len(head) + len(body)) if speaker == who else (None, None)
                segment = head + body + "\n"
                out.append((conv, who, turn if known else None, speaker, segment, at, at + len(segment), *mask))
                at += len(segment)
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", "hö"), (1, 3, "ann", "😀"), (1, 3, "cyd", None),
    (2, 0, "system", "alone"), (3, 0, None, "who"), (3, None, "bob", "early"), (3, 1, "bob", "same"), (3, 1, "bob", "same"),
    (None, 0, "ann", "no id"), (None, 1, "bob", "neither"), (4, 0, "ann", ""), (5, 0, "ann", "long " * 50_000),
]


def test_against_brute_force(spark):
    df = turns(spark, ROWS).withColumns({c: F.lit("mine") for c in ("perspective", "segment", "start", "conv", "_piece")})
    assert rows_of(rotate(df)) == sorted(brute(ROWS), key=repr)


def test_masks_cover_the_assistant_only(spark):
    got = rotate(turns(spark, ROWS)).collect()
    views = {}
    for r in sorted(got, key=lambda r: r.start):
        views.setdefault((r.conv_id, r.perspective), []).append(r)
    for (_, who), held in views.items():
        text = "".join(r.segment for r in held)
        for r in held:
            assert text[r.start : r.stop] == r.segment
            assert (r.mask_start is not None) == (r.speaker == who)
            if r.mask_start is not None:
                assert text[r.mask_start : r.mask_stop].endswith("<|im_end|>")
                assert text[: r.mask_start].endswith("<|im_start|>assistant\n")


def test_names_are_safe(spark):
    got = rotate(turns(spark, [(1, 0, "a b|>\n", "x"), (1, 1, "ok", "y")])).where("perspective = 'ok'").collect()
    assert {r.segment.split("\n")[0] for r in got} == {"<|im_start|>user name=a_b___", "<|im_start|>assistant"}


def test_long_dialogue_and_empty_table(spark):
    rows = [(7, i, f"p{i % 3}", f"turn {i}") for i in range(3000)]
    assert rows_of(rotate(turns(spark, rows))) == sorted(brute(rows), key=repr)
    assert rotate(turns(spark, [])).count() == 0


def test_main_path_is_native(spark):
    plan = rotate(turns(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
