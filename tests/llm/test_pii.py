import hashlib
import random
import re

from studyframe.llm import pii
from studyframe.llm.work import table


def brute(text):
    """The base as the contract words it, by plain regular expressions."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(x) if k % 2 == 0 else sum(map(int, str(2 * int(x)))) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_equals_plain_expressions():
    rng = random.Random(1)
    bits = ["a", "b.c", "@", ".", "1", "255", "256", "4716 2210 5188 5662", "+", "-", " ", "(", ")", "é", "%", "@x.y", "0004", "\n", "5500000000000004", "+1 (988) 555-2485"]
    for _ in range(6000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for part in ("1", "a", "1.", "@", "+1", "a@", "1-", "+(", "@a."):
        pii.base_spans(part * 200_000)


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = {r["doc_id"]: r for r in pii.digests(pii.spans(docs)).collect()}
    for r in docs.collect():
        want = brute(r["text"])
        row = got[r["doc_id"]]
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert row["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) <= {*row["spans"].split(","), ""}
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == j for s in want) for j in range(4)]
    for r in pii.redact(docs).collect():
        assert not brute(r["text"].replace("<", " ").replace(">", " "))
    assert pii.redact(docs).columns == docs.columns


def test_context_finds_numbers_of_another_form(spark):
    rng = random.Random(2)
    texts = [f"hello there call me on mobile: +1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)} today" for _ in range(12)]
    texts += ["reach us mobile: 030 5551 7788 thanks", "the 030 5551 9999 is a part number", None, "", "again 030 5551 7788", "word " * 50_000]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(0, texts[0], "x")], "doc_id long, text string, base string")
    rows = pii.digests(pii.spans(docs)).orderBy("doc_id").collect()
    assert len(rows) == len(texts) + 1
    got = {r["doc_id"]: r["spans"] for r in rows}
    assert got[12] == "phone:17:30" and got[13] == "" and got[14] == got[15] == "" and got[16] == "phone:6:19"
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[12] == "reach us mobile: <phone> thanks" and clean[13] == texts[13] and clean[14] is None and clean[16] == "again <phone>"
    assert pii.spans(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).count() == 0


def test_rounds_go_on_until_nothing_new_is_reached(spark):
    rng = random.Random(8)
    numbers = [[f"030 {555 + h} {1000 + 10 * h + k}" for k in range(6)] for h in range(7)]
    texts = [f"ask ring0: +1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)} now" for _ in range(8)]
    for h, some in enumerate(numbers):
        texts += [f"ask ring{h}: {n} now" for n in some] + [f"ask ring{h + 1}: {n} now" for n in some] * 2
    long = "x" * 300
    texts += [f"to {long}: a{k}@b.example end" for k in range(8)] + [f"to {long}: {'y' * 90}(at)bb end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digests(pii.spans(docs)).collect()}
    assert all(got[k] for k in range(len(texts)))
    assert "<email>" in {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}[len(texts) - 1]
