"""Secret spans against plain regular expressions, and the links of weak parts."""

import hashlib
import random
import re

from rows import DOCS, docs

from kifulake.llm import secrets
from kifulake.llm.queries import QUERIES

ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(secrets.KINDS[k], s, e) for s, k, e in sorted(out)]


KEY, ID, WEAK = "AKIAABCDEFGH1234", "QX9ZK41PLM83TTR7", "aB3dE5gH7jK9mN1pQ3sT5vX7zZ"
TEXTS = [
    f"é {KEY} token=x token: 'abcdefgh' PASSWORD = \"12345678\"", "token=secret=abcdefgh", "token:token:abcdefghij", "apI_KEY=ABCDEFGH apikey=short", "AKIAAKIA", "AKIA" * 5, "0123456789abcdef" * 2,
    "f" * 31, "f" * 32 + "AKIA" + "0" * 32, "tokenK=abcdefgh toKen=abcdefgh", f"id {ID} then {WEAK} at https://h.example/x", f"{ID} alone", f"{WEAK} alone https://h.example/",
    f"{KEY}\n\n{WEAK}", f"{KEY} {'w ' * 400}{WEAK}", f"{KEY}\n{WEAK}\nhttp://end.point/a", "secret : = 'abcdefghi'", "passwd='ÉÉÉÉÉÉÉÉ'", "İ" * 40 + " secret=abcdefghi",
]


def test_awkward(spark):
    d = docs(spark, [*TEXTS, *[t for t in docs(spark).toPandas().text.tolist() if isinstance(t, str) or t is None]])
    got = secrets.scan(d).collect()
    key = lambda i: (i is not None, i or 0)
    base = sorted((key(r.doc_id), [tuple(s) for s in r.spans if s.kind in secrets.BASE_KINDS]) for r in got)
    assert base == sorted((key(r.doc_id), brute(r.text)) for r in d.collect())


def test_links():
    def kinds(text):
        base = secrets.base_spans(text)
        return [secrets.KINDS[k] for _, _, k in sorted(secrets.linked_spans(text, base))]

    assert kinds(f"id {ID} then {WEAK} at https://h.example/x") == ["identifier", "secret", "endpoint"]
    assert kinds(f"{ID} alone") == [] and kinds(f"{WEAK} alone https://h.example/") == []
    assert kinds(f"{KEY} {WEAK}") == ["secret"]
    assert kinds(f"{KEY}\n\n{WEAK}") == []  # another scope
    assert kinds(f"{KEY} {'w ' * 400}{WEAK}") == []  # out of reach
    assert kinds(f"{ID} token=abcdefgh12") == ["identifier"]


def test_secrets_after_an_equals_sign():
    def found(text):
        return [(secrets.KINDS[k], text[s:e]) for s, e, k in sorted(secrets.linked_spans(text, secrets.base_spans(text)))]

    for name in ("aws_secret_access_key=", "AccountKey=", "KEY=", "export KEY='", "a==", "k ="):
        assert found(f"{KEY}\n{name}{WEAK}") == [("secret", WEAK)], name
    assert found(f"{ID}\nKEY={WEAK}==\nhttps://h.example/") == [("identifier", ID), ("secret", f"{WEAK}=="), ("endpoint", "https://h.example/")]
    assert ("secret", WEAK) in found(f"{ID} https://h.example/x?v=1&sig={WEAK}&n=2")
    assert found(f"{KEY} {WEAK}=x") == found(f"{KEY} {WEAK}===") == []  # a name, or no padding


def test_long_secrets():
    def found(text):
        return [(s, e) for s, e, k in secrets.linked_spans(text, secrets.base_spans(text)) if k == 4]

    for n in (23, 24, 128, 129, 130, 1000, 1_000_000):
        long = (WEAK * (n // len(WEAK) + 1))[:n]
        for pad in ("", "=", "=="):
            assert found(f"{KEY} {long}{pad} x") == ([(17, 17 + n + len(pad))] if n >= 24 else []), n
        assert found(f"{KEY} {long}=== x") == []


def test_endpoints_that_hold_their_credentials():
    def found(text):
        return [text[s:e] for s, e, k in secrets.linked_spans(text, secrets.base_spans(text)) if k == 5]

    for url in (f"https://h/x?id={ID}&token=abcdefgh12", f"https://h/{KEY}?sig={WEAK}", f"https://h/?k={KEY}&h=" + "0f" * 16):
        assert found(f"see {url} x") == [url], url
    assert found(f"{KEY} https://h/x?token=abcdefgh12") == ["https://h/x?token=abcdefgh12"]
    assert found(f"{WEAK} https://h/x?id={KEY}") == [f"https://h/x?id={KEY}"]
    assert found("https://h/x?token=abcdefgh12") == found(f"https://h/{KEY}") == []  # one part alone
    assert found(f"{KEY}\n\nhttps://h/x?token=abcdefgh12") == []  # another scope


def test_endpoints_match_the_pattern():
    pattern = re.compile(r"[a-z][a-z0-9+.-]*://[A-Za-z0-9.-]+(?::[0-9]+)?[^\s\"'<>]*")
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice(["a", "b", "1", "+", "://", ":", "/", " ", "A", ".", ":80", '"', "é"]) for _ in range(r.randint(0, 25)))
        assert list(secrets._endpoints(text)) == [m.span() for m in pattern.finditer(text)], text


def test_links_beside_a_very_long_span():
    """One value of a million characters neither hides nor slows the links around it."""
    many = f"{ID} {WEAK}\n\n" * 2000
    long = "token=" + "a" * 1_000_000
    text = many + long + "\n\n" + many
    base = secrets.base_spans(text)
    found = secrets.linked_spans(text, base)
    assert sum(k == 3 for *_, k in found) == sum(k == 4 for *_, k in found) == 4000


def test_empty(spark):
    assert secrets.scan(spark.createDataFrame([], DOCS)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op9_linked_secrets"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        spans, g = brute(r.text), got[r.doc_id]
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert g.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(k == n for k, _, _ in spans) for n in ("assign", "access", "hex"))
        assert set(text.split(",")) - {""} <= set(g.spans.split(","))
