import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewake.llm import pii, secret_scan
from tidewake.llm.automata import compile_all
from tidewake.llm.queries import QUERIES

BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def personal(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def holds(row, base):
    assert row.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), (row, base)
    assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(b.startswith(k) for b in base) for k, _ in BASE]
    every = row.spans.split(",") if row.spans else []
    assert set(base) <= set(every) and len(every) == len(set(every))
    order = [(pii.KINDS.index(k), int(b), int(e)) for k, b, e in (s.split(":") for s in every)]
    assert order == sorted(order)


def test_query_keeps_all_base_spans(spark, sf, texts):
    rows = QUERIES["op8_weak_supervision"](spark, sf).collect()
    assert {r.doc_id for r in rows} == texts.keys()
    for r in rows:
        holds(r, personal(texts[r.doc_id]))


HARD = ["a@b.c_d@e.f", "x@y@z.w", "a@b c@d.e", "..@a.b", "a@b..c", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256", "1.2.3",
        "001.002.003.004", "1.1.1.00000001", "4111 1111 1111 1111", "4111-1111 1111-1111-", "4111  1111", "é 4111111111111111",
        "+1 (555) 010-9999", "+1-- -- 2", "++12345678901", "+1234567890123456", "tel (212) 555-0100 now", "+49 30 1234567 x@y.de",
        "write to joe (at) mail (dot) org", "123-45-6789", "DE89370400440532013000", "🙂 a@b.co 漢 1.2.3.4", "9" * 5000,
        "a" * 3000 + "@", "a.b@" * 500, "1." * 3000, "+1" + "-" * 3000, "4111 1111 1111 1111\n5500-0000-0000-0004"]


def test_hard_texts(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.personal_data(df).collect()}
    for i, text in enumerate(HARD):
        holds(rows[i], personal(text))
    masked = {r.doc_id: r.text for r in pii.masked(df).collect()}
    assert masked[23] == "🙂 <email> 漢 <ip>"
    for i, text in enumerate(HARD):
        spans = sorted((int(b), int(e), pii.KINDS.index(k)) for k, b, e in
                       (s.split(":") for s in rows[i].spans.split(",") if s))
        out, at = "", 0
        for b, e, k in spans:
            if b >= at:
                out += text[at:b] + f"<{pii.KINDS[k]}>"
            at = max(at, e)
        assert masked[i] == out + text[at:]


def test_no_python_in_the_plan(spark, documents, capsys):
    pii.candidates(documents).explain()
    assert "Python" not in (plan := capsys.readouterr().out) and "Arrow" not in plan


def test_odd_rows_for_pii(odd, none):
    rows = pii.personal_data(odd).collect()
    assert len(rows) == 13 and all(r.n_email == 0 and r.spans == "" for r in rows)
    assert pii.personal_data(none).collect() == [] and pii.masked(none).collect() == []
    masked = pii.masked(odd)
    assert masked.columns == odd.columns
    key = lambda r: (str(r.doc_id), str(r.text))
    assert sorted(masked.collect(), key=key) == sorted(odd.collect(), key=key)


def test_repeated_rows_for_pii(spark):
    df = spark.createDataFrame([(1, "a@b.co"), (1, "a@b.co"), (None, "a@b.co"), (1, "no")], "doc_id long, text string")
    assert sorted(r.spans for r in pii.personal_data(df).collect()) == ["", "email:0:6", "email:0:6", "email:0:6"]


def test_em_finds_the_reliable_labelers():
    rng = np.random.default_rng(2)
    patterns = {}
    for _ in range(4000):
        true = rng.random() < 0.4
        votes = tuple(int(v) for v in (
            (1 if true else -1) if rng.random() < 0.95 else (-1 if true else 1),
            (1 if true else -1) if rng.random() < 0.9 else (-1 if true else 1),
            0 if rng.random() < 0.5 else ((1 if true else -1) if rng.random() < 0.9 else (-1 if true else 1)),
            rng.choice([-1, 1])))
        patterns[votes] = patterns.get(votes, 0) + 1
    prior, right = pii.reliabilities(patterns)
    assert abs(prior - 0.4) < 0.06
    assert abs(right[0][0] - 0.95) < 0.05 and abs(right[1][1] - 0.9) < 0.05 and right[3][0] < 0.7
    rows = [(0, 3, v, n, pii.posterior(v, prior, right)) for v, n in patterns.items()]
    weights = pii.classifier(rows)
    assert weights["v_form=1"] > weights["v_form=-1"] and weights["v_form=1"] > weights["v_edge=1"]


SCANNER = secret_scan.Scanner()
PARTS = st.sampled_from(["token", "secret", "api_key", "APIKEY", "password", "passwd", "=", ":", " ", "  ", "\"", "'", "AKIA",
                         "ABCD1234", "abcdef0123456789", "0a" * 16, "f" * 31, "ghp_", "A" * 36, "xoxb-", "12345-abc", "AIza",
                         "B_-" * 12, "eyJ", "ab.cd", ".", "x", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "://", "user:",
                         "pw@", "sk_live_", "9" * 20, "é", "漢", "\n", "to", "ken", "a"])


def secrets(text):
    out = []
    for i, rule in enumerate(secret_scan.RULES):
        for m in re.finditer(rule.pattern, text, re.IGNORECASE | re.ASCII if rule.any_case else 0):
            width = len(m.group())
            if rule.value:
                width -= re.match(rule.value, m.group(), re.IGNORECASE).end()
            if width >= rule.least:
                out.append((m.start(), i, m.end()))
    return [(i, b, e) for b, i, e in sorted(out)]


def in_bytes(text, spans):
    return sorted((i, len(text[:b].encode()), len(text[:e].encode())) for i, b, e in spans)


@settings(max_examples=500, deadline=None)
@given(st.lists(PARTS, max_size=14))
def test_scan_equals_regular_expressions(parts):
    text = "".join(parts)
    assert sorted(SCANNER.spans(text.encode())) == in_bytes(text, secrets(text))


@pytest.mark.parametrize("pattern", ["ab?c*", "(x|yy)+z", "[a-c]{3}", "a{2,}b", r"\.x", "a(b|c)?d"])
def test_automaton_equals_fullmatch(pattern):
    dfa = compile_all([(pattern, False)])
    rng = np.random.default_rng(1)
    for _ in range(3000):
        word = "".join(rng.choice(list("abcdxyz."), rng.integers(0, 7)))
        state = dfa.start
        for b in word.encode():
            state = dfa.table[state + b]
        assert (state >= dfa.accepting) == bool(re.fullmatch(pattern, word)), word


def test_secret_query(spark, sf, texts):
    for r in QUERIES["op9_combined_automaton"](spark, sf).collect():
        found = secrets(texts[r.doc_id])
        shown = [f"{secret_scan.RULES[i].kind}:{b}:{e}" for i, b, e in found]
        base = [s for s, (i, _, _) in zip(shown, found) if i < 3]
        assert r.spans == ",".join(shown)
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(i == k for i, _, _ in found) for k in range(3)]


def test_odd_rows_for_secrets(spark, odd, none):
    rows = secret_scan.scan(odd).collect()
    assert len(rows) == 13
    assert [(r.doc_id, r.n_hex) for r in rows if r.spans] == [(9, 1)]  # 200 000 times a
    assert secret_scan.scan(none).collect() == []
    got = secret_scan.scan(spark.createDataFrame([(1, "é token = \"abcdefgh1\"")], "doc_id long, text string")).first()
    assert got.spans == "assign:2:20"
