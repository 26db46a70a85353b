"""The registered corpus queries against plain loops, on the smallest tables; those with SQL are also in test_queries."""

import base64
import collections
import hashlib

import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from contestlake.llm import packing, queries, secrets
from tests.llm import brute
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def encode():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def run(spark, sf, name):
    return queries.QUERIES[name](spark, sf).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    rows, status, _ = compare(spark, connect(sf), sf, queries.QUERIES[name], queries.ORACLES[name])
    assert status == "ok" and rows > 0


def test_every_operator_has_one_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_secrets(spark, sf, docs):
    rows = run(spark, sf, "op1_secret_scan")
    assert len(rows) == len(docs)
    for r in rows:
        counts, spans = brute.base_secrets(docs[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == counts
        assert r.base_sha256 == brute.sha(spans)
        assert set(filter(None, spans.split(","))) <= set(r.spans.split(","))


def test_urls(spark, sf):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = run(spark, sf, "op2_url_filter")
    assert len(rows) == len(urls)
    for r in rows:
        _, found, rest = (urls[r.page_id] or "").partition("://")
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest)) if found else 0
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end]) if found else ""
        path = rest[end:].split("?")[0].split("#")[0] if found else ""
        fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_suffixes(spark, sf, docs):
    want = brute.repeats(docs)
    rows = run(spark, sf, "op4_suffix_dedup")
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want
    assert len(rows) == len(docs) and any(v[1] for v in want.values())


def test_packing(spark, sf, docs, encode):
    filled = brute.check_pieces(run(spark, sf, "op5_packing"), list(docs.items()), encode)
    assert filled > 0.98


def test_chat(spark, sf):
    turns = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-7] = [(0, "user", queries.CONTROLS), (1, "assistant", queries.CONTROLS)]
    rows = run(spark, sf, "op8_chat_formatting")
    assert len(rows) == len(turns)
    for r in rows:
        some = sorted(turns[r.conv_id])
        loss = "".join(t for _, role, t in some if role == "assistant")
        assert r.n_turns == len(some)
        assert r.turns_sha256 == brute.sha("".join(f"{role}\n{t}\n" for _, role, t in some))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), brute.sha(loss))


def test_paragraphs(spark, sf, docs):
    texts = list(docs.items())
    want = dict(zip(docs, brute.paragraph_copies(texts)))
    hit = dict(zip(docs, brute.repeated_runs(texts)))
    total = caught = 0
    for r in run(spark, sf, "op10_paragraph_dedup"):
        spans, firsts = want[r.doc_id]
        assert r.removed == ",".join(f"{a}:{z}" for a, z in spans)
        assert r.n_removed == len(spans) and r.duplicate_of == sorted(firsts)
        total += len(hit[r.doc_id])
        caught += sum(any(a <= s and e <= z for a, z in spans) for s, e in hit[r.doc_id])
        assert not hit[r.doc_id] or r.n_removed
    assert caught >= 0.9 * total > 0


def test_pipeline(spark, sf, docs, encode):
    """Each stage by a plain loop over what the one before it kept."""
    con = connect(sf)
    kept = {r[0] for r in con.execute(queries.ORACLES["op6_quality_rules"]).fetchall() if r[-1]}
    now = {d: docs[d] for d in kept}
    roots = brute.components(now)
    now = {d: t for d, t in now.items() if roots[d] == d}
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    hits = brute.contamination(now, items)
    now = {d: t for d, t in now.items() if not hits[d][1]}
    redacted = {d: secrets.redact(t or "") for d, t in now.items()}
    for text in redacted.values():
        assert brute.base_secrets(text)[0] == [0, 0, 0]
    rows = corpus_pipeline.run(spark, sf).collect()
    brute.check_pieces(rows, list(redacted.items()), encode)
    assert 0 < len(now) < len(docs)


def test_stages_hand_on_the_columns_of_documents(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, sf).columns == frame.columns


def test_key_structures():
    def der(tag, body):
        n = len(body)
        return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82, n >> 8, n & 255])) + body

    number = der(2, b"\0")
    big = der(2, b"\x01" + b"\x55" * 63)
    rsa = der(0x30, number + big * 8)
    pkcs8 = der(0x30, number + der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(4, rsa))
    ec = der(0x30, der(2, b"\1") + der(4, b"\x77" * 32) + der(0xA0, der(6, b"\x2a\x86")))
    for key in (rsa, pkcs8, ec):
        assert secrets.is_private_key(key)
        assert not secrets.is_private_key(key[:-1]) and not secrets.is_private_key(key + b"\0")
        text = "x " + base64.b64encode(key).decode() + " y"
        assert [k for _, _, k in secrets.confirmed_spans(text)] == ["key"]
        assert secrets.redact(text) == "x [secret] y"
        pem = "-----BEGIN PRIVATE KEY-----\n" + base64.encodebytes(key).decode() + "-----END PRIVATE KEY-----"
        assert [(s, e) for s, e, _ in secrets.confirmed_spans(pem)] == [(0, len(pem))]
        assert [k for _, _, k in secrets.confirmed_spans(" " + key.hex() + " ")] == ["key"]
    assert secrets.confirmed_spans(base64.b64encode(hashlib.sha512(b"no key").digest() * 3).decode()) == []
    part = lambda s: base64.urlsafe_b64encode(s).decode().rstrip("=")
    token = f"{part(b'{"alg":"HS256"}')}.{part(b'{"sub":"1"}')}.{part(b'signature')}"
    assert [(s, e, k) for s, e, k in secrets.confirmed_spans(f"a {token} b")] == [(2, 2 + len(token), "token")]
    assert secrets.confirmed_spans(f"a {part(b'{"typ":"JWT"}')}.{part(b'{}')}.x b") == []


def test_cuts_keep_the_ids(encode):
    texts = ["a  b c\n d", " lead", "trail ", "tab\t x", "x\u00a0 y", "it's we'll 12 34 5a", "", " ", "  ", "\n\n a b", "…  — x", "a \u200b b"]
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == encode(text), text
        assert "".join(packing.cuts(text)) == text
