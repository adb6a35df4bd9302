from __future__ import annotations

import base64
import textwrap

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.secrets import REDACTED, credential_spans, private_key_container, preview_counts, found_spans, redact, redact_fragments

GHP = "ghp_" + "a1B2" * 9
AKIA = "AKIA" + "IOSFODNN7ABCDEFG"


def found(text):
    return [text[a:b] for a, b in credential_spans(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ('password = "hunter2-blue"', "hunter2-blue"),
        ("api_key: Zx81kk2P", "Zx81kk2P"),
        ('const char *token = "abc-def-12";', "abc-def-12"),
        ('const SECRET: &str = "left-right-9";', "left-right-9"),
        ("ENV DB_PASSWORD s3cr3tvalue", "s3cr3tvalue"),
        ("<password>blue-moon-7</password>", "blue-moon-7"),
        ("url = postgres://app:p4ss!x@db.host/x", "p4ss!x"),
        ('"Authorization": "Bearer abcDEF123456"', "abcDEF123456"),
        ("Authorization: Basic c3ZjOmFiYzEyMw==", "c3ZjOmFiYzEyMw=="),
        ("machine h login u password Tr0ub4dor", "Tr0ub4dor"),
        ("curl --user a --password Xy12Zz9 https://h", "Xy12Zz9"),
        ("//reg.host/:_authToken=Qw3rTy99", "Qw3rTy99"),
        ('{"name": "api_key", "value": "q1w2e3r4"}', "q1w2e3r4"),
        ("- name: TOKEN\n  value: q1w2e3r4", "q1w2e3r4"),
        (f"run --with {GHP} --limit 3", GHP),
        (f'connect("{AKIA}")', AKIA),
        ("# login is admin / red-fox-55 (password)", "red-fox-55"),
        ("-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----\nx = 1", "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"),
        ("k: -----BEGIN PRIVATE KEY-----\nabc\ndef", "-----BEGIN PRIVATE KEY-----\nabc\ndef"),
    ],
)
def test_credentials(text, want):
    assert found(text) == [want]


@pytest.mark.parametrize(
    "text",
    [
        'password = ""', 'password = "changeme"', 'token = "${TOKEN}"', 'secret = os.environ["SECRET"]', "password = read_setting('x')", "token_count = 4649",
        'api_key = "YOUR_API_KEY"', 'api_key = "<your-token>"', 'password = "********"', 'secret = "{{ vault.db }}"', "postgresql://app@host/db",
        'sha256 = "' + "ab" * 32 + '"', 'id = "0eb175ed-006c-468b-ad46-ae08f8e993d8"', "Authorization: Bearer $TOKEN", "# the password field may be empty",
        "-----BEGIN PUBLIC KEY-----\nabc\n-----END PUBLIC KEY-----", '"integrity": "sha512-zbLfavqQ8rfrzR32v5hA8hXJqkAZQGV"', "url = https://h/x?user=reader", 'field("password", label="catalog")',
    ],
)
def test_nothing_there(text):
    assert found(text) == []


def test_encoded_layers_are_opened():
    inner = f'{{"password": "hunter2-blue", "x": "{GHP}"}}'
    one = base64.b64encode(inner.encode()).decode()
    two = base64.b64encode(f"blob={one}".encode()).decode()
    for literal in (one, two, inner.encode().hex(), "".join(f"%{b:02x}" for b in inner.encode()), "".join(f"\\x{b:02x}" for b in inner.encode())):
        text = f"x1 = '{literal}' # end"
        assert found(text) == [literal], literal[:20]
    assert found("x = '" + base64.b64encode(b"just some harmless text here").decode() + "'") == []


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body


def test_key_containers():
    integer = der(2, b"\x05" * 40)
    pkcs1 = der(0x30, der(2, b"\x00") + integer * 8)
    pkcs8 = der(0x30, der(2, b"\x00") + der(0x30, der(6, b"\x2a\x86\x48")) + der(4, pkcs1))
    sec1 = der(0x30, der(2, b"\x01") + der(4, b"\x09" * 32))
    public = der(0x30, der(0x30, der(6, b"\x2a\x86\x48")) + der(3, b"\x00" * 60))
    assert all(map(private_key_container, (pkcs1, pkcs8, sec1, b"openssh-key-v1\x00rest")))
    assert not any(map(private_key_container, (public, pkcs1[:-1], b"", b"\x30\x82")))
    blob = base64.b64encode(pkcs8).decode()
    assert found(f"cert = {blob}") == [blob]


TEXT = st.lists(st.sampled_from(['password = "', "hunter2", '"', "\n", " ", "token: ", GHP, "://u:p@h", "-----BEGIN PRIVATE KEY-----", "%41%42", "\\", "'", "{", "}"]) | st.characters(blacklist_categories=["Cs"]), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_spans_are_sound_and_all_else_stays(text):
    spans = credential_spans(text)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    parts = redact(text, spans).split(REDACTED)
    if REDACTED not in text:
        outside = [text[a:b] for (_, a), (b, _) in zip([(0, 0), *spans], [*spans, (len(text), 0)])]
        assert parts == outside


def test_fragments(spark):
    df = spark.createDataFrame(
        [(1, 9, 'password = "hunter2-blue"', "p"), (1, 9, 'password = "hunter2-blue"', "p"), (2, 9, None, "p"), (3, 9, " ", "p"), (4, 8, "x" * 200_000, "p")],
        "fragment_id long, preview_id long, content string, spans string",
    )
    r = redact_fragments(df).cache()
    assert [tuple(x) for x in found_spans(r).collect()] == [(1, 12, 24)]
    assert {x.fragment_id: x.redacted for x in r.collect() if x.fragment_id < 4} == {1: 'password = "[REDACTED]"', 2: None, 3: " "}
    previews = spark.createDataFrame([(9, 1), (8, None), (7, 0)], "preview_id long, redaction_count int")
    assert sorted(map(tuple, preview_counts(r, previews).collect())) == [(7, 0, 0, True), (8, None, 0, False), (9, 1, 1, True)]
    assert redact_fragments(df.limit(0)).count() == 0


@pytest.mark.parametrize("layers", [1, 2, 5, 6, 9])
def test_layers_are_opened_to_the_last(layers):
    inner = b"password=Ab3xQ9z7Lm"
    for i in range(layers):
        inner = inner.hex().encode() if i % 3 == 1 else base64.b64encode(inner)
    text = f'blob = "{inner.decode()}"'
    (a, b), = credential_spans(text)
    assert text[a:b].rstrip("=") == inner.decode().rstrip("=")
    assert credential_spans(f'blob = "{base64.b64encode(b"nothing of interest in here").decode()}"') == []


def der(tag: int, content: bytes) -> bytes:
    n = len(content)
    return bytes([tag, n]) + content if n < 128 else bytes([tag, 0x82]) + n.to_bytes(2, "big") + content


RSA = der(0x30, der(2, b"\0") + b"".join(der(2, bytes(range(1, 60)) * k) for k in (3, 1, 3, 2, 2, 2, 2, 2)))
PKCS12 = der(0x30, der(2, b"\3") + der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x07\x01") + der(0xA0, der(4, bytes(90)))) + der(0x30, bytes(40)))
PGP = b"\x95\x00\x60" + b"\x04" + b"\x5f\x00\x00\x01" + b"\x01" + bytes(90)
STORE = b"\xfe\xed\xfe\xed\x00\x00\x00\x02\x00\x00\x00\x01" + bytes(60)


@pytest.mark.parametrize("container", [RSA, PKCS12, PGP, STORE])
@pytest.mark.parametrize("form", ["one line", "64 columns", "continued", "concatenated", "escaped"])
def test_containers_are_found_in_literals_broken_into_lines(container, form):
    code = base64.b64encode(container).decode().rstrip("=")
    lines = [code[i : i + 64] for i in range(0, len(code), 64)]
    join = {"one line": "", "64 columns": "\n    ", "continued": "\\\n", "concatenated": '"\n  + "', "escaped": "\\n"}[form]
    text = 'data:\n    "' + join.join(lines) + '"\nother: 1\n'
    (a, b), = credential_spans(text)
    assert text[a:b] == join.join(lines)
    public = der(0x30, der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01") + der(5, b"")) + der(3, bytes(range(140))))
    lines = textwrap.wrap(base64.b64encode(public).decode(), 64)
    assert credential_spans(join.join(lines)) == []


def test_stand_ins_with_a_random_part_are_credentials():
    assert [t for t in ('password = "my-example-Zk3vQ9xLm2"', 'password = "example-password"', 'token = "your_token_here"') if credential_spans(t)] == ['password = "my-example-Zk3vQ9xLm2"']


def test_long_names_and_types_lose_nothing():
    name = "a" * 300 + "_password"
    text = f'{name}: {"List[" * 30}str{"]" * 30} = "Zk3vQ9xLm2"'
    (a, b), = credential_spans(text)
    assert text[a:b] == "Zk3vQ9xLm2"
