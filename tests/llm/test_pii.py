import hashlib
import random
import re

from helixframe.llm import pii

RX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    """The base spans by the patterns themselves."""
    out = []
    for rank, (kind, rx) in enumerate(RX.items()):
        for m in re.finditer(rx, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def base(text):
    return [f"{k}:{s}:{e}" for s, _, k, e, b in sorted(pii.find(text, pii.automaton())) if b]


def test_random():
    rng = random.Random(3)
    for alphabet in ("01.25@+- ()a.é", "0123456789 -", "12.0", "a@b.-%+ü\n", "+1 (2).-9x", "4111 -.@+aé:"):
        for _ in range(1500):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))
            assert base(t) == brute(t), t


def test_known():
    t = "Writé to bob.smith@mail.example.com or +1 (555) 123-4567; 10.0.0.256 10.0.0.25, 4111 1111 1111 1111, see https://a.example.com/x?y=1. IBAN: GB82 WEST 1234 5698 7654 32 ok. Account no: 12345-6789."
    found = {k: t[s:e] for s, _, k, e, _ in pii.find(t, pii.automaton())}
    assert found == {"email": "bob.smith@mail.example.com", "phone": "+1 (555) 123-4567", "ip": "10.0.0.25", "card": "4111 1111 1111 1111", "url": "https://a.example.com/x?y=1", "iban": "GB82 WEST 1234 5698 7654 32", "account": "12345-6789"}


def test_frame(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (2, "a@b.c", "z"), (2, "a@b.c", "z"), (None, "no data", None), (3, "1" * 50000 + " a@b.c", None)], "doc_id long, text string, spans string")
    rows = pii.find_pii(df).collect()
    assert sorted(len(r.spans) for r in rows) == [0, 0, 0, 1, 1, 1]
    assert pii.find_pii(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pii.op1(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in RX]
        assert set(want) <= set(r.spans.split(",") if r.spans else [])


def test_borders_and_cases():
    kinds = lambda t: {k: t[s:e] for s, _, k, e, b in pii.find(t, pii.automaton()) if not b}
    assert kinds("Caliban 123456 and subaccount 12345678") == {}
    assert kinds("HTTP://A.example.com/x") == {"url": "HTTP://A.example.com/x"} and kinds("see hTtP://b.example.com/x, ok") == {"url": "hTtP://b.example.com/x"}
    assert kinds("MailTo:bob@x.example.com") == {"url": "MailTo:bob@x.example.com"}
    assert kinds("pay to GB82WEST12345698765432 now") == {"iban": "GB82WEST12345698765432"} and kinds("pay to GB82WEST12345698765433 now") == kinds("pay XGB82WEST12345698765432") == {}
    assert kinds("DE89 3704 0044 0532 0130 00") == {"iban": "DE89 3704 0044 0532 0130 00"}
    assert kinds("account 12345678") == {"account": "12345678"} == kinds("(Account: 12345678)") == kinds("iBaN 12345678")
    assert kinds("Account no: 12345-6789, account number 77777777") == {"account": "77777777"}


def test_added_kinds_grow_with_the_text():
    t = "IBAN GB82 WEST 1234 5698 7654 32, account 12345678; AB12CD34 " * 20000
    assert len(pii.find(t, pii.automaton())) >= 40000
