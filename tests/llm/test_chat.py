from cutweave.llm import chat
from cutweave.llm.chat import rotate_perspectives

SCHEMA = "conv_id long, turn long, role string, text string, segment string, position int"


def brute(rows):
    out = []
    key = lambda r: tuple((v is not None, v) for v in (r[1], r[2])) + (r[3] or "",)
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=key)
        for who in {r[2] for r in turns} - {None, "system"}:
            at = 0
            for n, (_, turn, speaker, text) in enumerate(turns, 1):
                safe = lambda s: s.replace("<|", "<\\|")
                role = "assistant" if speaker == who else "system" if speaker == "system" else "user name=" + safe((speaker or "unknown").replace("\n", " "))
                head = f"<|im_start|>{role}\n"
                seg = head + safe(text or "") + "<|im_end|>\n"
                own = speaker == who
                out.append((conv, who, n, turn, speaker, seg, own, at, at + len(seg), at + len(head) if own else None, at + len(seg) - 1 if own else None))
                at += len(seg)
    return sorted(out, key=str)


def test_all_cases(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 2)
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "ann", "tie"), (1, 2, "ann", "tie"), (1, 5, "c\nd", "ü" * 9)]
    rows += [(2, None, "ann", "no turn"), (2, 3, None, "no speaker"), (None, 1, "ann", "no dialogue"), (None, 2, "bob", ""), (3, 1, "system", "alone")]
    rows += [(4, i, "ab"[i % 2], "x" * (i * 37 % 11)) for i in range(200)] + [(5, 0, "ann", "long " * 50000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in rotate_perspectives(df).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert rotate_perspectives(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stays_in_the_jvm(spark):
    df = rotate_perspectives(spark.createDataFrame([(1, 1, "a", "b", "", 1)], SCHEMA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
