"""Every opN query against a brute-force version over the whole small tables."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from ledgerloom.llm import queries as Q
from ledgerloom.llm.packing import CAPACITY


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    return [(r.page_id, r.url, r.html or "") for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_op1(spark, sf_dir, pages):
    first = {}
    for page, _, html in sorted(pages):
        first.setdefault(html, page)
    want = {p: (len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if first[h] == p else "revisit", None if first[h] == p else first[h]) for p, _, h in pages}
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in Q.op1_warc_round_trip(spark, sf_dir).collect()}
    assert got == want


def _tokens(name):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.tokenizer_path(name))
    tok.encode_special_tokens = True
    return lambda t: tok.encode(t, add_special_tokens=False).ids


def test_op2(spark, sf_dir, docs):
    encode, start, want = _tokens("byte_bpe_50k.json"), 0, {}
    for doc in sorted(docs):
        ids = np.array([*encode(docs[doc]), 0], dtype="<u4")
        want[doc] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in Q.op2_repair_token_ids(spark, sf_dir).collect()}
    assert got == want


def test_op3(spark, sf_dir, docs):
    fps = {}
    for doc, text in docs.items():
        ws = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        grams = [" ".join(ws[k : k + 4]) for k in range(max(1, len(ws) - 3))] if ws else []
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps[doc] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    ids = sorted(fps)
    comp = {d: d for d in ids}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    want = {d: (f"{fps[d]:016x}", find(d)) for d in ids}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.op3_simhash_near_duplicates(spark, sf_dir).collect()}
    assert got == want


def test_op5(spark, sf_dir, docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        ws = word.findall(lower(r.text or ""))
        size = min(10, len(ws))
        for k in range(len(ws) - size + 1 if ws else 0):
            windows[tuple(ws[k : k + size])].add(str(r.item_id))
    want = {}
    for doc, text in docs.items():
        ws, hit, items = word.findall(lower(text)), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(ws) - size + 1):
                if found := windows.get(tuple(ws[k : k + size])):
                    hit.update(range(k, k + size))
                    items |= found
        want[doc] = (len(ws), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in Q.op5_decontamination(spark, sf_dir).collect()}
    assert got == want


def test_op8(spark, sf_dir, docs):
    groups = defaultdict(list)
    for doc, text in docs.items():
        groups[lower(text)].append(doc)
    want = {d: (max(groups[lower(t)]), len(groups[lower(t)]), d == max(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for d, t in docs.items()}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in Q.op8_exact_duplicates(spark, sf_dir).collect()}
    assert got == want


def test_op9(spark, sf_dir, docs):
    encode = _tokens("word_bpe_49k.json")
    rows = Q.op9_packing(spark, sf_dir).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    total = 0
    for doc, text in docs.items():
        ids, at = np.array([*encode(text), 2], dtype="<u4"), 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
        total += at
    padded = 0
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= CAPACITY
        padded += at if at & (at - 1) == 0 else CAPACITY
    assert padded <= 1.03 * total + CAPACITY


def test_op10_catches_toxic_and_leaves_clean(spark, sf_dir):
    """Held-out accuracy on the larger table: documents with words that only toxic texts use go, others stay."""
    rows = {r.doc_id: r for r in Q.op10_toxicity(spark, "/root/testdata/sf0.01").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert set(rows) == set(texts)
    slurs = {"trash", "pathetic", "idiot", "worthless", "disgusting", "stupid", "clown", "loser", "scum", "moron"}
    truth = {d: len(slurs & set(re.findall(r"[a-z]+", t.lower()))) >= 2 for d, t in texts.items()}
    caught = sum(rows[d].rejected for d in texts if truth[d]) / max(1, sum(truth.values()))
    wrong = sum(rows[d].rejected for d in texts if not truth[d]) / sum(not x for x in truth.values())
    assert caught > 0.95 and wrong < 0.02
