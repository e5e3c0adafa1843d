import random
import re

from docmill.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


ADDED = [("gh[opsur]_[A-Za-z0-9]+", 40), ("xox[abprs]-[A-Za-z0-9-]+", 15), ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 0)]


def added(text):
    """The kinds that the operator adds, by plain regexes."""
    return [(m.start(), 3 + k, m.end()) for k, (p, least) in enumerate(ADDED) for m in re.finditer(p, text or "") if len(m[0]) >= least]


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_random_texts_against_re():
    scanner = secrets.compile_scanner()
    rng = random.Random(3)
    bits = ["token", "Secret", "PASSWORD", "passwd", "api_key", "apikey", "=", ":", " ", "  ", '"', "'", "abc", "abcdef", "AKIA", "ABCDEFGH12345678", "0123456789ab", "f", "\n", "é", "-", "x", "toktoken", "ſecret"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        data = text.encode()
        want = sorted(base(text) + added(text))
        block = rng.choice([1, 3, 7, 1 << 21])
        assert secrets.code_point_spans(data, secrets.scan(scanner, data, block)) == want, text


def test_added_kinds_against_re():
    scanner = secrets.compile_scanner()
    rng = random.Random(4)
    bits = ["ghp_", "gho_", "gh", "xoxb-", "xoxp", "-", "a1" * 9, "Z9" * 18, "_", " ", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "KEY", "0a" * 12, "token=", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(20000)]
    found = secrets.scan_texts(scanner, [t.encode() for t in texts])
    for text, f in zip(texts, found, strict=True):
        assert secrets.code_point_spans(text.encode(), f) == sorted(base(text) + added(text)), text


def test_long_texts_stay_small():
    """Hex, and hex between words: memory of the text's own size and some, and time in proportion."""
    import time
    import tracemalloc

    scanner = secrets.compile_scanner()
    hexes = b"0a1b2c3d" * (5 << 17)
    mixed = (b"the key deadbeefdeadbeefdeadbeef00, Zahl: 12\n" * 60_000)[: 5 << 19]
    for data in (hexes, mixed):
        took = []
        for part in (data[: len(data) // 4], data):
            began = time.time()
            found = secrets.scan(scanner, part)
            took.append(time.time() - began)
            assert len(found) == (1 if part[0] == 48 else len(re.findall(b"[0-9a-f]{24,}", part)))
        assert took[1] < 12 * took[0] + 1
        tracemalloc.start()
        secrets.scan(scanner, data[: 1 << 19])
        assert tracemalloc.get_traced_memory()[1] < 60 << 20
        tracemalloc.stop()


def test_operator(spark):
    rows = [(1, None), (2, ""), (3, "é token = abcdef!"), (4, "x" * 50000 + " AKIA" + "Z" * 16), (None, "no"), (5, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 36), (5, "password: 'deadbeefdeadbeefdeadbeef00'")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as spans", "'r' as kind")
    found = secrets.find_secrets(df).collect()
    assert len(found) == len(rows)
    got = {(r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans)) for r in found}
    assert (3, (("assign", 2, 16),)) in got
    assert (4, (("access", 50001, 50021),)) in got
    assert (1, ()) in got and (2, ()) in got and (None, ()) in got
    assert (5, (("pem", 0, 31), ("hex", 36, 72), ("github", 32, 72))) not in got
    assert (5, (("assign", 0, 37), ("hex", 11, 37))) in got
    assert secrets.find_secrets(df.limit(0)).count() == 0


def test_redaction(spark):
    rows = [(1, None, None), (2, "a token=abcdefgh b", 18), (3, "clean", 99), (4, "password: 'deadbeefdeadbeefdeadbeef00'", 38)]
    out = {r.doc_id: r for r in secrets.redact_secrets(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert out[2].text == "a [secret] b" and out[2].n_chars == 12
    assert out[3].text == "clean" and out[3].n_chars == 99 and out[1].text is None
    assert out[4].text == "[secret]'"
