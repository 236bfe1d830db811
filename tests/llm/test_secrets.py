from __future__ import annotations

import hashlib
import random
import re
import time

from conftest_llm import EDGE_TEXTS
from kartoteka.llm import secrets
from kartoteka.registry.base import table

PATTERNS = {
    "assign": re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+"),
}


def brute_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text or ""):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= {"assign": 12, "access": 18, "hex": 16}[kind]:
                out.append((m.start(), list(PATTERNS).index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def check(docs):
    rows = secrets.scan_secrets(docs).collect()
    assert len(rows) == docs.count()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    for r in rows:
        expected = brute_base(texts[r.doc_id][0])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in expected) for k in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert set(expected) <= set(r.spans.split(",") if r.spans else [])
    return rows


def test_base_matches_brute_force(spark):
    assert sum(r.n_hex for r in check(table(spark, "/root/testdata/sf0.01", "documents"))) > 0


def test_edge_texts(documents):
    check(documents(EDGE_TEXTS + [
        "é" * 40 + "TOKEN = \"abcdefghijkl\"", "toKen=abcdefghijklm", "paſſword=abcdefghijklm", "api_key:'aaaaaaaaaaaa",
        "password=secret=abcdefghijklm", "AKIA" + "Z" * 13, "AKIA" + "Z" * 14, "f" * 15, "f" * 16 + "G" + "0" * 17]))
    assert secrets.scan_secrets(documents([])).count() == 0


KEY = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYz9q3T1"


def test_weak_parts_count_only_together():
    assert secrets.find_secrets(f"see {KEY} there")[1] == []
    assert secrets.find_secrets("at https://db.example.com/x only")[1] == []
    text = f"login: bob-smith key {KEY} at https://db.example.com/x"
    assert {k for k, *_ in secrets.find_secrets(text)[1]} == {"secret", "identity", "endpoint"}
    apart = f"login: bob-smith {'word ' * 60} {KEY}"
    assert secrets.find_secrets(apart)[1] == []
    assert secrets.find_secrets(f"login: bob-smith\n\n{KEY}")[1] == []


def test_masking_takes_effect_and_keeps_columns(documents):
    docs = documents(["x password=abcdefghijklmnop y", None, "clean"])
    masked = secrets.mask_secrets(docs)
    assert masked.columns == docs.columns
    rows = {r.doc_id: r for r in masked.collect()}
    assert rows[0].text == "x [assign] y" and rows[0].n_chars == 12 and rows[1].text is None and rows[2].text == "clean"


def brute_links(parts, borders):
    """Which weak parts have a part of another kind near them, by all pairs."""
    needs = {"secret": {"identity", "endpoint"}, "identity": {"secret"}, "endpoint": {"secret"}}
    scope = [sum(b <= start for b in borders) for start, *_ in parts]
    return [(kind, start, end) for i, (start, end, kind, weak) in enumerate(parts) if weak and any(
        scope[i] == scope[j] and other in needs[kind] and max(start - e, s - end) <= secrets.REACH
        for j, (s, e, other, _) in enumerate(parts) if j != i)]


def test_links_equal_all_pairs(monkeypatch):
    rng = random.Random(5)
    for _ in range(300):
        parts = sorted((s, s + rng.choice([3, 30, 300, 900]), rng.choice(["secret", "identity", "endpoint"]), rng.random() < 0.7)
                       for s in (rng.randrange(3000) for _ in range(rng.randrange(1, 14))))
        text = list("x" * 4000)
        for at in rng.sample(range(3990), 3):
            text[at:at + 2] = "\n\n"
        monkeypatch.setattr(secrets, "_parts", lambda *_: parts)
        text = "".join(text)
        got = secrets.linked_spans(text, [])
        if len({kind for _, _, kind, _ in parts}) > 1:
            assert got == brute_links(parts, [m.end() for m in re.finditer(r"\n\s*\n", text)])


def test_a_long_part_reaches_as_far_as_it_goes():
    text = "secret=deadbeefdeadbeef-" + "x" * 240 + " user=bobby user=carol"
    assert [text[s:e] for _, s, e in secrets.find_secrets(text)[1]] == ["user=bobby", "user=carol"]


def test_no_tail_is_left_after_masking():
    text = f"client_id={'kq' * 45} key {KEY}"
    assert secrets.mask(text) == "[identity] key [secret]"


def test_words_of_two_classes():
    lower = "k3v9x1q8z7m2p5w4r6t0yb"
    assert {k for k, *_ in secrets.find_secrets(f"login: bob-smith key {lower}")[1]} == {"identity", "secret"}
    for plain in ("internationalization", "aaaaaaaaaaaaaaaaaaaa1111", "SomeVeryLongIdentifierName"):
        assert secrets.find_secrets(f"login: bob-smith key {plain}")[1] == []


def test_time_is_linear_in_parts():
    text = " ".join(f"{i:016x} user=u{i}" for i in range(20_000))
    start = time.perf_counter()
    base, more = secrets.find_secrets(text)
    assert len(base) == 20_000 and len(more) == 20_000 and time.perf_counter() - start < 4


def test_columns_in_the_order_of_the_contract(documents):
    assert secrets.scan_secrets(documents(["x"])).columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"]
