"""Secret scan and personal data against plain regular expressions."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirelight.llm import pii, secret_scan

WORDS = ["password", "Token", "api_key", "=", ":", '"', " ", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "x@y.org", "@", "a.b", ".", "+1", "(",
         ")", "-", "555", "4111111111111111", "1.2.3.4", "999.1.1.1", "é", "\n", "ſecret", "token", "secret: ", "abcdefghijklm", "%", "0"]
TEXTS = st.lists(st.sampled_from(WORDS), max_size=30).map("".join)


def plain_secrets(text):
    found = []
    for m in re.finditer(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(?:", "(?i:"), text, re.A):
        found += [(m.start(), 0, m.end())] if len(m[2]) >= 12 else []
    for k, pattern, least in ((1, "AKIA[A-Z0-9]+", 18), (2, "[0-9a-f]+", 16)):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def plain_pii(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    tests = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda t: 12 <= len(d := re.sub("[^0-9]", "", t)) <= 19 and luhn(d)),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(re.sub("[^0-9]", "", t)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(tests) for m in re.finditer(p, text) if ok(m[0]))


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_base_spans_are_those_of_the_plain_patterns(text):
    got = [f for f in secret_scan.scan(text) if f[1] < 3]
    assert ",".join(f[2] for f in got) == plain_secrets(text)
    assert pii.detect(text) == plain_pii(text)
    base, added = pii.find(text)
    assert base == plain_pii(text)
    for _, kind, _ in added:
        assert kind in range(4)


@pytest.mark.parametrize(
    ("text", "kind", "shown"),
    [
        ("write to jane.doe (at) mail [dot] example (dot) org now", "email", "jane.doe (at) mail [dot] example (dot) org"),
        ("write to jane at mail dot example dot org, now", "email", "jane at mail dot example dot org"),
        ("to jane_d at example.org now", "email", "jane_d at example.org"),
        ("mail jаne@exаmple.org please", "email", "jаne@exаmple.org"),
        ("mail jane＠example．org please", "email", "jane＠example．org"),
        ("mail ja​ne@example.org", "email", "ja​ne@example.org"),
        ("card four one one one 1111 one one one one 1111 ok", "card", "four one one one 1111 one one one one 1111"),
        ("host one nine two dot one six eight dot one dot seven up", "ip", "one nine two dot one six eight dot one dot seven"),
        ("call plus four nine three zero one two three four five six seven today", "phone", "plus four nine three zero one two three four five six seven"),
        ("call +４９ (30) 1234567", "phone", "+４９ (30) 1234567"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, shown):
    _, added = pii.find(text)
    assert (pii.KINDS.index(kind), shown) in [(k, text[s:e]) for s, k, e in added]


@pytest.mark.parametrize("text", ["", "look at example.com", "one at a time, two of six", "The dot at the end.", "É à la ªº 1 2 3 4 5 6 7 8 9", "a" * 50000, "@" * 5000])
def test_clean_texts_get_nothing(text):
    assert pii.find(text) == ([], [])


@pytest.mark.parametrize(
    ("text", "kind", "shown"),
    [
        ("host 192 dot 168 dot 17 dot 10 is up", "ip", "192 dot 168 dot 17 dot 10"),
        ("host 10 punto 0 Punto 0 punto 1.", "ip", "10 punto 0 Punto 0 punto 1"),
        ("card four 1 one 1 1111 one 1 one 1 1111 ok", "card", "four 1 one 1 1111 one 1 one 1 1111"),
        ("call plus one 2 three 4 five 6 seven 8 nine 0 today", "phone", "plus one 2 three 4 five 6 seven 8 nine 0"),
        ("ask alice at example.com now", "email", "alice at example.com"),
        ("ask (alice at example.com) now", "email", "alice at example.com"),
        ("ASK JOHN AT EXAMPLE.COM", "email", "JOHN AT EXAMPLE.COM"),
        ("jane at mail dot example dot internationalsite", "email", "jane at mail dot example dot internationalsite"),
        ("jane at mail.internationalsite", "email", "jane at mail.internationalsite"),
    ],
)
def test_more_disguises_map_back_to_the_source(text, kind, shown):
    _, added = pii.find(text)
    assert (pii.KINDS.index(kind), shown) in [(k, text[s:e]) for s, k, e in added]


@pytest.mark.parametrize("text", ["Visit us at example.com", "SEE MORE AT EXAMPLE.COM", "999 dot 1 dot 1 dot 1", "1 dot 2 dot 3", "on 1 2 3 4 5 6 one 7"])
def test_more_clean_texts_get_nothing(text):
    assert pii.find(text) == ([], [])


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, extra int")


def test_ownership_parts_examples_from_owned_keys(spark):
    shared, own = "token = 'c0ffee00c0ffee12aa34bb56'", "token = 'zq8Xr51LmN0pWv7tKd'"
    rows = [(i, f"text {shared}", f"owner{i % 7}", "en", 1) for i in range(70)]
    rows += [(100, f"x {own}", "owner1", "en", 1), (101, f"{own} y", "owner1", "de", 1), (102, None, None, None, None), (103, "", "o", "en", 0), (None, own, "owner1", "en", 1)]
    got = {r.id: r for r in secret_scan.secret_scan(_docs(spark, rows)).collect()}
    assert got[5].n_copied == 2 and got[5].live == "" and got[5].most_owners == 7
    assert got[100].live == "assign:2:29" and got[100].most_repos == 2 and got[None].most_owners == 1
    assert got[102].spans == "" and got[103].n_assign == 0 and len(got) == 75
    assert secret_scan.mask(rows[70][1], got[100].masked) == "x [SECRET]'"


KEY = "\n".join("MIIEpAIBAAKCAQEA7x" + "abcdEFGH0123+/" * 3 + str(i) for i in range(9))


@pytest.mark.parametrize(
    ("text", "left"),
    [
        (f"a -----BEGIN RSA PRIVATE KEY-----\n{KEY}\nab12==\n-----END RSA PRIVATE KEY----- b", "a [SECRET] b"),
        (f"-----BEGIN PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n{KEY}\nAbC1\n\nNow prose.", "[SECRET]\n\nNow prose."),
        (f"key: \"-----BEGIN PRIVATE KEY-----\\n{KEY}\\nab1=\\n\" and more words", 'key: "[SECRET]\\n" and more words'),
        (f"-----BEGIN PRIVATE KEY----- {KEY} then prose -----BEGIN EC PRIVATE KEY----- {KEY} -----END EC PRIVATE KEY-----.", "[SECRET] then prose [SECRET]."),
        ("the line -----BEGIN PRIVATE KEY----- opens a key", "the line [SECRET] opens a key"),
        (f"git clone https://{'user' * 20}:{'Zx9_k' * 60}@host/x", f"git clone https://{'user' * 20}:[SECRET]@host/x"),
    ],
)
def test_whole_keys_and_long_credentials_are_masked(text, left):
    spans = [f[2] for f in secret_scan.scan(text) if f[1] > 3]
    assert secret_scan.mask(text, ",".join(spans)) == left


def test_keys_that_begin_alike_are_told_apart():
    first, second = (f"-----BEGIN PRIVATE KEY-----\n{KEY}\n{x * 40}\n-----END PRIVATE KEY-----" for x in "xy")
    assert {f[3] for f in secret_scan.scan(f"{first} {second}") if f[1] == 4} == {first, second}


@pytest.mark.parametrize("text", ["-----BEGIN PRIVATE KEY-----" * 20000, "-----BEGIN PRIVATE KEY-----" + "\n " * 200000, "://" + "a" * 400000, "://a:" * 80000])
def test_long_odd_texts_are_read_in_linear_time(text):
    start = time.process_time()
    secret_scan.scan(text)
    assert time.process_time() - start < 5


def test_personal_data_rows(spark):
    rows = [(1, "a@b.org or +49 30 1234567", "s", "en", 1), (2, None, "s", "en", 1), (None, "x (at) y (dot) org", "s", "en", 1), (4, "", "s", "en", 1)]
    got = {r.id: r for r in pii.find_personal_data(_docs(spark, rows)).collect()}
    assert (got[1].spans, got[1].n_phone, got[2].spans, got[None].spans, got[None].n_added) == ("email:0:7,phone:11:25", 1, "", "email:0:18", 1)
    assert pii.find_personal_data(_docs(spark, [])).count() == 0


@pytest.mark.parametrize("text", [" ", "\n", "a @ ", "1 ", "x at ", " dot ", "(", "a.b@", "+1 ", "@"])
def test_personal_data_in_linear_time(text):
    began = time.perf_counter()
    pii.find(text * (1_000_000 // len(text)))
    assert time.perf_counter() - began < 10
