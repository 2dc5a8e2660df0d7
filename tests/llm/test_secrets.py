import hashlib
import math
import random
import re
from collections import Counter

from creditloom.llm import secrets as S

RANDOM64 = "q7Rz9Tk2Lw4Xb8Vn1Mc6Jd3Hf5Gs0Pa"


def found(docs_of, texts):
    df = docs_of([(i, t) for i, t in enumerate(texts)]).withColumnRenamed("ids", "secrets")
    out = S.find_secrets(df)
    assert [c for c in out.columns if c != "secrets"] == [c for c in df.columns if c not in ("text", "secrets")]
    return {r.doc_id: [tuple(s) for s in r.secrets] for r in out.collect()}


def brute_windows(run, cls):
    """Entropy of every window from its own counts."""
    good = []
    for at in range(len(run) - cls.window + 1):
        part = run[at:at + cls.window]
        bits = -sum(c / cls.window * math.log2(c / cls.window) for c in Counter(part).values())
        if bits >= cls.bits - 1e-12 and all(set(part) & set(m) for m in cls.mixed):
            good.append((at, at + cls.window))
    merged = []
    for a, b in good:
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return merged


def test_windows_equal_brute_force():
    rng = random.Random(1)
    for cls in S.CLASSES:
        letters = "0123456789abcdefABCDEF" if cls.kind == "entropy16" else "abcdefXYZ0123456789ABCghijk_-/+mnopqRSTUVW"
        for _ in range(150):
            few = rng.sample(letters, rng.randint(2, len(letters)))
            run = "".join(rng.choice(few) for _ in range(rng.randint(0, 90)))
            assert S.suspicious(run, cls) == brute_windows(run, cls)


def brute_base(text):
    spans = []
    for k, (kind, pattern, group, least) in enumerate([
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24),
    ]):
        spans += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans)]


def test_known_forms_equal_brute_force(docs_of):
    rng = random.Random(2)
    pieces = ["token", "secret", "API_KEY", "apikey", "Password", "=", ":", " ", '"', "'", "AKIA", "A1B2C3D4E5F6G7H8", "abc123", "0f" * 6, "x.", "é", "\n", "ſecret", "=toKen"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(400)] + [None, "", "secret=token:abcdefg", "toKen=abcdefg"]
    got = found(docs_of, texts)
    for i, text in enumerate(texts):
        base = [f"{k}:{a}:{b}" for k, a, b in got[i] if k in S.BASE_KINDS]
        assert base == brute_base(text or ""), text


def test_entropy_spans_and_allow_list(docs_of):
    hexa = "9F86D081884C7D659A2FEAA0C55AD015"
    texts = [
        f"é see {RANDOM64} here", f"see https://host.example/{RANDOM64} here", f"get ?key={RANDOM64}", f"etag: {RANDOM64}", "donaudampfschifffahrtsgesellschaft",
        f"x {hexa} y", f"sha256={hexa}", "550e8400-e29b-41d4-a716-446655440000", "EXAMPLE" + RANDOM64, "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz1B",
        f'token = "{RANDOM64}"', "12345678901234567890123456789012345678901234567890", f"password={RANDOM64} and {hexa}",
    ]
    got = found(docs_of, texts)
    kinds = {i: [k for k, *_ in spans] for i, spans in got.items()}
    assert got[0] == [("entropy64", 6, 6 + len(RANDOM64))]
    assert kinds[2] == ["entropy64"] and kinds[5] == ["entropy16"]
    assert kinds[11] == ["hex"]  # digits alone are a known form
    for i in (1, 3, 4, 6, 7, 8, 9):
        assert kinds[i] == [], texts[i]
    assert kinds[10] == ["assign"] and kinds[12] == ["assign", "entropy16"]


def test_very_long_empty_and_repeated(docs_of, spark):
    long = "plain words here. " * 150_000
    text = long + f"token={'ab12' * 12} " + long
    got = found(docs_of, [text, text, None, ""])
    at = len(long)
    assert got[0] == got[1] == [("assign", at, at + 54), ("hex", at + 6, at + 54)] and got[2] == got[3] == []
    assert S.find_secrets(docs_of([])).count() == 0


def test_query(spark, small):
    rows = S.op13_secret_scan(spark, small).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in rows:
        base = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in S.BASE_KINDS)
        assert [s for s in r.spans.split(",") if s.split(":")[0] in S.BASE_KINDS] == base
    assert len(rows) == len(texts)
