import hashlib
import random
import re
import time

import pytest

from textharbor.llm import secrets

KEY, HEX = "AKIA" + "Z7" * 8, "0123456789abcdef" * 2
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
TEXTS = [
    None, "", "nothing to see", f"é password = 'hunter2-long' and {KEY}", "token=secret:abcdefgh", "TOKEN=short api_key: 12345678",
    f"{HEX} {HEX}f x{HEX[:31]}", "AKIA1234567890123 AKIA12 AKIA12345678901", f"apikey={HEX}", "ſecret=abcdefghij toKen=abcdefghij",
    f"user_name: joe.doe\ntoken at https://api.example.com:8443/x is q9Zr8Lk2Wm5Tn7Bv1Xc4 end", "user_name: joe.doe alone",
    "q9Zr8Lk2Wm5Tn7Bv1Xc4 alone at 10.0.0.1", f"{KEY} " + "x " * 150 + "q9Zr8Lk2Wm5Tn7Bv1Xc4", f"{KEY} 10.0.0.1 q9Zr8Lk2Wm5Tn7Bv1Xc4",
    "password=" + "a" * 50_000, "login=abc " * 300 + HEX, 'secret"=  "aaaaaaaa" secret = "bb"',
]


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 32]
    return sorted(found)


def test_base_findings(spark, documents):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, TEXTS[6])]
    got = secrets.secret_report(documents(rows)).collect()
    wanted = []
    for key, text in rows:
        found = base(text)
        listed = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in found)
        wanted.append((str(key), *[sum(k == i for _, k, _ in found) for i in range(3)], hashlib.sha256(listed.encode()).hexdigest()))
        strong = [s for s in secrets.find_spans(text or "")[0] if s.kind in secrets.STRONG]
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in strong) == listed
    assert sorted((str(r.doc_id), *r[1:5]) for r in got) == sorted(wanted)


def kinds(text):
    return [s.kind for s in secrets.find_spans(text)[0]]


def test_weak_parts_need_their_complement():
    assert kinds(TEXTS[10]) == ["identifier", "endpoint", "token"]
    assert kinds(TEXTS[11]) == [] and kinds(TEXTS[12]) == []
    assert kinds(TEXTS[13]) == ["access"]  # too far away
    assert kinds(TEXTS[14]) == ["access", "endpoint", "token"]
    many = kinds(TEXTS[16])
    assert many[-1] == "hex" and 0 < many.count("identifier") < 300


def test_scope_is_a_join_of_intervals():
    for gap in range(0, 12):
        text = f"{KEY}{' ' * gap} q9Zr8Lk2Wm5Tn7Bv1Xc4"
        assert ("token" in [s.kind for s in secrets.find_spans(text, scope=6)[0]]) == (gap + 1 <= 6)


def test_empty_table(spark, documents):
    assert secrets.secret_report(documents([])).count() == 0


IDENTIFIER = re.compile(
    r"""\b(access_?key_?id|client_?id|account|user_?name|login|user)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.IGNORECASE | re.ASCII
)


def linked_plainly(text, scope):
    """All spans by the definition, every part against every other."""
    strong = [(s, e, ("assign", "access", "hex")[k]) for s, k, e in base(text)]

    def apart(a, b):
        return a[1] <= b[0] or b[1] <= a[0]

    def near(a, others):
        return any(apart(a, b) and (0 <= a[0] - b[1] <= scope or 0 <= b[0] - a[1] <= scope) for b in others)

    def parts(pattern, kind):
        found = [(m.start(), m.end(), kind) for m in re.finditer(pattern, text)]
        return [p for p in found if all(apart(p, s) for s in strong)]

    names = parts(IDENTIFIER, "identifier")
    identifiers = [s for s in strong if s[2] == "access"] + names
    word = "[A-Za-z0-9+/_-]"
    tokens = [t for t in parts(f"(?<!{word}){word}{{20,}}={{0,2}}", "token") if re.search("[0-9]", text[t[0] : t[1]]) and re.search("[A-Za-z]", text[t[0] : t[1]])]
    tokens = [t for t in tokens if near(t, identifiers)]
    known = [s for s in strong if s[2] in ("assign", "hex")] + tokens
    ends = parts(r"\b(?:[a-z][a-z0-9+.-]{0,30}://[A-Za-z0-9.-]+(?::[0-9]+)?|(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]+)?)", "endpoint")
    ends = [x for x in ends if near(x, identifiers) and near(x, known)]
    every = strong + [n for n in names if near(n, known)] + tokens + ends
    order = {kind: i for i, kind in enumerate(secrets.KINDS)}
    return sorted((s, order[kind], e) for s, e, kind in every)


def test_linked_spans_against_every_pair():
    rng = random.Random(7)
    pieces = [KEY, HEX, "password=hunter2-long", "user_name: joe.doe", "login=abc", "client_id = x9.y", "q9Zr8Lk2Wm5Tn7Bv1Xc4", "10.0.0.1",
              "https://api.example.com:8443", "plain words here", "é", "x" * 15, "secret:short", "user: " + KEY, "token=" + HEX, "ABCDEFGHIJKLMNOPQRSTUVWX"]
    linked = 0
    for _ in range(400):
        text = "".join(rng.choice(pieces) + rng.choice([" ", "\n", "; ", " " * rng.randint(1, 30)]) for _ in range(rng.randint(1, 12)))
        scope = rng.choice([0, 3, 20, 200])
        got = [(s.start, s.rank, s.end) for s in secrets.find_spans(text, scope)[0]]
        assert got == linked_plainly(text, scope)
        linked += sum(rank > 2 for _, rank, _ in got)
    assert linked > 300


@pytest.mark.parametrize("text", [
    "user=abc " + "a-" * 500_000, "user=abc " + "a" * 1_000_000, "login: ab " + "user " * 200_000, "password=" + "a1" * 500_000 + " user=abc q9Zr8Lk2Wm5Tn7Bv1Xc4" * 20_000,
    f"{KEY} " * 40_000, "user=abc " * 100_000, "secret" + " " * 1_000_000, "1.2.3." * 200_000 + f"{HEX} login=abcd", "user=abc " + "A1+/" * 250_000,
])
def test_time_is_in_proportion_to_the_text(text):
    began = time.process_time()
    secrets.find_spans(text)
    assert time.process_time() - began < 8
