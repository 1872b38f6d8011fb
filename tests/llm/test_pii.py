"""Personal data: strict spans against a plain Python version, the model, redaction, odd input."""

import hashlib
import random
import re

from pageframe.llm import pii
from pageframe.llm.queries import op5_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                "card": 13 <= len(d) <= 19 and luhn(d),
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


HAND = [
    None, "", "plain words only", "a@b.c_d@e.f, x@y@z.com ..@a.b.c. end",
    "0001.002.255.0255 1.2.3.4.5.6.7.8 256.1.1.1 9.9.9.9", "4111 1111-1111 1111 and 4111111111111111",
    "4111 1111 1111 1111 5 is too much; 79927398713 too few", "+1 (389) 555-5010. +12 +1-2 +49 30 1234567-",
    "é𝔘 mail: zoë.x@exämple.com +1 (389) 555-5010", "write joe (at) mail [dot] com or (212) 555-0199 now",
    "1" * 5000 + " " + "a" * 20000 + "@" + "b." * 3000,
]


def texts():
    rng = random.Random(5)
    alphabet = "0123456789" * 3 + "+-. ()@ab_%é\n"
    return HAND + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(300)]


def test_strict_spans_equal_brute_force(spark, folder):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r for r in op5_pii(spark, folder(rows)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want, row = brute(text), got[i]
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert row["base_sha256"] == hashlib.sha256(line.encode()).hexdigest(), text
        assert [row[f"n_{k}"] for k in PATTERNS] == [sum(w[0] == k for w in want) for k in PATTERNS]
        assert set(line.split(",")) - {""} <= set(row["spans"].split(","))


def test_reliable_labelers_win():
    counts = {"phone:+++++": 80, "phone:0+0++": 40, "phone:0+++0": 9, "phone:0---0": 60, "phone:0-0--": 50}
    model = pii.fit_patterns(counts)
    assert "phone:0+0++" in model.accepted() and "phone:0---0" not in model.accepted()
    assert pii.fit_patterns({}).accepted() == []


def test_redaction_keeps_columns(table):
    docs = table([(1, "to a@b.com +1 (389) 555-5010!"), (2, None), (3, ""), (3, ""), (None, "1.2.3.4")])
    out = pii.redacted(docs, pii.fit(docs))
    assert out.columns == docs.columns
    got = sorted(((r["text"] or "", r["n_chars"]) for r in out.collect()), key=str)
    assert got == [("", 0), ("", 0), ("", None), ("<IP>", 4), ("to <EMAIL> <PHONE>!", 19)]


def test_empty_table(table):
    docs = table([])
    assert pii.annotated(docs, pii.fit(docs)).count() == 0
