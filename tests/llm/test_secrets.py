import hashlib
import random
import re

from retenta.llm import secrets
from .conftest import rows

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(secrets.BASE[k], s, e) for s, k, e in sorted(found)]


def test_base_rules_match_regular_expressions():
    rng = random.Random(1)
    bits = ["password", "PassWd", "secret", "token", "apikey", "API_KEY", '"', "'", " ", "  ", ":", "=", "AKIA", "K", "ſ",
            "abcdef0123456789", "0123abc", "AKIAABCDEFGHIJKLMN", "xyzXYZ123/+", "é", "\n", "-", "_", "a", "9", "Z"]
    scan = secrets.scanner().spans
    for _ in range(8000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert [s for s in scan(text) if s[0] in secrets.BASE] == brute(text), text


def test_added_rules():
    scan = secrets.scanner().spans
    assert scan("x ghp_" + "a1" * 18)[0] == ("github", 2, 42)
    assert scan("ghp_short") == []
    assert scan("é -----BEGIN RSA PRIVATE KEY-----") == [("private_key", 2, 33)]
    assert ("slack", 0, 20) in scan("xoxb-1234567890-abcd")
    assert ("google", 0, 39) in scan("AIza" + "x" * 35)


def test_minimal_automaton_equals_patterns():
    tree = secrets._Parser("a(b|c)*d{2,3}", False).alternatives()
    auto = secrets.Automaton([tree])
    for text in ("add", "abcbddd", "ad", "abcd", "addd"):
        m = re.match("a(b|c)*d{2,3}", text)
        assert auto.longest(text.encode(), 0) == (m.end() if m else None)
    same = secrets.Automaton([secrets._Parser("ab|cb", False).alternatives()])
    assert len(same.move) == 4   # a and c lead to one state; its successor; the dead state


def test_digest_of_documents(spark, docs, none):
    special = spark.createDataFrame([(1, None), (2, ""), (None, "token: abcdefghijklmn"), (3, "x" * 200_000 + " 0123456789abcdef")],
                                    "doc_id long, text string")
    got = rows(secrets.digest(secrets.scan(special)), "doc_id", "n_assign", "n_access", "n_hex", "spans")
    assert got == [(None, 1, 0, 0, "assign:0:21"), (1, 0, 0, 0, ""), (2, 0, 0, 0, ""), (3, 0, 0, 1, "hex:200001:200017")]
    for r in secrets.digest(secrets.scan(special)).collect():
        base = ",".join(s for s in r["spans"].split(",") if s)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert secrets.digest(secrets.scan(docs)).count() == docs.count()
    assert secrets.scan(none).count() == 0
