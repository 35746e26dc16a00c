"""The queries that SQL cannot express, against brute force over whole small tables; and the tokenizers against the library."""

import html
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from ledgerloom.llm import html_crf, paragraphs, simhash, toxicity, urlrules
from ledgerloom.llm import queries as Q
from ledgerloom.llm.tokens import GENERATION, Encoder

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _classes(pairs, nodes):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    return find


def test_op4(spark):
    """Lines of 20 words by all pairs at Jaccard 0.8; passages by what every repeated run of 50 words must and no other word may have."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    rows = {r.doc_id: r for r in Q.op4_paragraph_minhash(spark, SMALL).collect()}
    assert set(rows) == set(docs)
    lines = [(d, k, tuple(ws)) for d in sorted(docs) for k, x in enumerate(docs[d].split("\n")) if len(ws := _words(x)) >= paragraphs.LEAST]
    first = {}
    for d, k, ws in lines:
        first.setdefault(ws, (d, k))
    sets = {ws: {ws[i : i + 5] for i in range(len(ws) - 4)} for ws in first}
    where = defaultdict(set)
    for ws, s in sets.items():
        for g in s:
            where[g].add(ws)
    pairs = {(a, b) for found in where.values() for a in found for b in found if a < b}
    alike = [(first[a], first[b]) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    find = _classes(alike, first.values())
    want = defaultdict(list)
    for d, k, ws in lines:
        if find(first[ws]) != (d, k):
            want[d].append(k)
    assert {d: r.removed for d, r in rows.items() if r.removed} == dict(want) and want
    # Passages.
    words = {d: [w for x in docs[d].split("\n") for w in _words(x)] for d in docs}
    gone = {}
    for d, r in rows.items():
        sizes = [len(_words(x)) for x in docs[d].split("\n")]
        inside = [k in r.removed for k, n in enumerate(sizes) for _ in range(n)]
        cut = [any(s.start <= i < s.end for s in r.spans) for i in range(len(inside))]
        gone[d] = (inside, cut)
    open_ = [d for d in sorted(docs) if not words[d] or not all(gone[d][0])]
    seen = defaultdict(list)
    for d in open_:
        for i in range(len(words[d]) - paragraphs.UNIT + 1):
            seen[tuple(words[d][i : i + paragraphs.UNIT])].append((d, i))
    for d in open_:
        for s in rows[d].spans:
            for i in range(s.start, s.end):
                assert any(len(seen[tuple(words[d][k : k + paragraphs.UNIT])]) > 1 for k in range(max(0, i - paragraphs.UNIT + 1), i + 1))
    place = {}
    for d in open_:
        inside, cut = gone[d]
        for i in range(len(words[d]) - 49):
            at = place.setdefault(tuple(words[d][i : i + 50]), (d, i))
            if (at[0] != d or i >= at[1] + 50) and not all(inside[i : i + 50]):
                assert sum(a or b for a, b in zip(inside[i : i + 50], cut[i : i + 50])) >= paragraphs.UNIT - paragraphs.WINNOW or any(inside[i : i + 50])
                assert rows[d].n_repeated > 0


def test_units_catch_every_passage(spark):
    """Passages of exactly 50 words anywhere in lines, across line ends, and beside others; clean texts stay."""
    rng = random.Random(8)
    new = lambda n: [f"w{rng.randint(0, 10**7)}" for _ in range(n)]
    shared = [new(50) for _ in range(40)]
    texts, holds = [], {}
    for k in range(200):
        own = sorted(rng.sample(range(40), rng.randint(0, 2)))
        ws = new(rng.randint(0, 60))
        for i in own:
            ws += shared[i] + new(rng.randint(1, 60))
        texts.append((k, "".join(w + ("\n" if rng.random() < 0.05 else " ") for w in ws)))
        holds[k] = own
    df = spark.createDataFrame([*texts, (500, None), (501, ""), (502, " ".join(new(49) * 2)), (502, " ".join(new(30)))], "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r for r in paragraphs.repeated_paragraphs(df, least=20, every=False).collect()}
    counts = Counter(i for own in holds.values() for i in own)
    first = {}
    for k in range(200):
        for i in holds[k]:
            first.setdefault(i, k)
    for k in range(200):
        assert (rows[k].n_repeated > 0) == any(counts[i] > 1 for i in holds[k])
        assert (rows[k].n_removed > 0) == any(first[i] != k for i in holds[k])
        assert set(rows[k].repeats_of) <= {j for i in holds[k] for j in range(k) if i in holds[j]}
    assert rows[500].n_removed == rows[501].n_removed == 0


def test_repeated_ids_lose_only_their_own_lines(spark):
    rng = random.Random(4)
    line = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(30))
    a, b, c = line(), line(), line()
    df = spark.createDataFrame([(1, a, 0), (7, f"{b}\n{a}", 1), (7, c, 2), (9, f"{c}\n{b}", 3)], "doc_id long, text string, row int")
    got = {r.row: r.text for r in paragraphs.drop_repeated_paragraphs(df).collect()}
    assert got == {0: a, 1: b, 2: c, 3: ""}


def test_op6(spark):
    """Labels from the given rules, other urls as not blocked, every combination of tokens counted, the least ones that reach the bounds as rules."""
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    rows = {r.page_id: r for r in Q.op6_url_rules(spark, sf).collect()}

    def parse(url):
        if not url or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]

    def given(host, path):
        fits = [(len(h + p), h + p, v) for h, p, v in urlrules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else None

    def tokens(host, path):
        found = ["h:" + x for x in re.findall(r"[^.\-_:]+", host)] + ["p:" + x for x in re.findall(r"[^/.\-_]+", path.lower())]
        return {t for t in found if not re.fullmatch(r".:\d*", t)}

    labels = {r.url: (r.label, r.held_out) for r in urlrules.rule_labels(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    assert labels.keys() == {p.url for p in pages if p.url is not None}
    assert all(label == (given(*parse(u)) or (None, None))[1] for u, (label, _) in labels.items())
    baskets = [(tokens(*parse(u)), label) for u, (label, held) in labels.items() if not held]
    n, base = len(baskets), sum(label == "block" for _, label in baskets) / len(baskets)
    count, block = Counter(), Counter()
    for ts, label in baskets:
        for size in range(1, len(ts) + 1):
            for c in combinations(sorted(ts), size):
                count[c] += 1
                block[c] += label == "block"
    rules = {c: block[c] / count[c] for c in count if block[c] >= 0.01 * n - 1e-9 and block[c] / count[c] >= 0.9 and block[c] / count[c] / base >= 1.2}
    least = {c: v for c, v in rules.items() if not any(x in rules for size in range(1, len(c)) for x in combinations(c, size))}
    assert least
    for p in pages:
        host, path = parse(p.url)
        own, fits = given(host, path), [c for c in least if set(c) <= tokens(host, path)]
        want = (host, path, own[0] if own else None, own[1] if own else "block" if fits else "allow")
        r = rows[p.page_id]
        assert (r.host, r.path, r.rule, r.verdict) == want
    empty = spark.createDataFrame([(1, None)], "page_id long, url string")
    assert urlrules.judge(empty, mined=urlrules.mine(urlrules.rule_labels(empty))).first().verdict == "allow"


def test_op7(spark):
    """The article's blocks by regular expressions, on every page of a whole table."""
    sf = "/root/testdata/sf0.01"
    rows = {r.page_id: r for r in Q.op7_html_crf(spark, sf).collect()}
    for p in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search(r"(?s)<article>(.*)</article>", p.html)[1]
        blocks = [" ".join(html.unescape(re.sub(r"(?s)<[^>]+>", "", x)).split()) for x in re.split(r"(?i)</?(?:p|h1|h2|br|ul|li|div)\b[^>]*>", re.sub(r"(?s)<!--.*?-->", "", article))]
        assert rows[p.page_id].text == " ".join(b for b in blocks if b) and rows[p.page_id].n_chars == len(rows[p.page_id].text)


def test_html_drops_nothing_but_what_it_must():
    model = html_crf.trained()
    body = "<p>A formula <math><mi>x</mi><mo>=</mo><mn>1</mn></math> in a paragraph that is long enough to be of the article.</p>"
    more = "<noscript><p>A paragraph for readers without scripts, as long as any other of the article.</p></noscript><object>The text that stands in for an object, told in full.</object><iframe>And one for a frame, which is told in full as well.</iframe>"
    text, _ = html_crf.main_text(f"<article><h1>T</h1>{body}{more}<form><textarea>no</textarea></form><script>no</script></article>", model)
    assert text.startswith("T A formula x=1 in a paragraph") and "without scripts" in text and "stands in" in text and "for a frame" in text and "no" not in text.split()


@pytest.mark.parametrize("page", ["<div>x" * 60_000, "".join(f'<div class="c{k} menu">x' for k in range(20_000)), "<!-- x" * 60_000, "<a " * 60_000, "<span>" * 20_000 + "<td>x</td>" * 20_000, "<div>" * 20_000 + "x</p>" * 20_000])
def test_deep_and_unclosed_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html_crf.main_text(page, html_crf.trained())
    assert time.process_time() - began < 10


def test_op10(spark):
    """Scores of every document of a whole table, from the model's weights by definition; repeated rows and ids are scored each."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = defaultdict(list)
    for r in Q.op10_toxicity(spark, SMALL).collect():
        rows[r.doc_id].append(r)
    for d in docs.collect():
        ws = [w.encode() for w in _words(d.text)]
        seen = Counter()
        for w in ws:
            chars = w.decode("utf-8", "replace")
            seen[w] += 1
            for k in (4, 5, 6, 7, 8):
                if len(w) > 4 and k < len(chars):
                    seen[chars[:k].encode() + b"*"] += 1
        score = sum(a * np.log1p(seen[f]) + b * min(100.0 * seen[f] / len(ws), 3.0) for f, (a, b) in model.weights.items() if seen[f])
        below = [1 / (1 + np.exp(score - t)) for t in model.thresholds]
        p = np.diff([0.0, *below, 1.0])
        (r,) = rows[d.doc_id]
        assert abs(r.severity - p @ [0, 1, 2]) < 1e-9 and abs(r.p_toxic - (1 - p[0])) < 1e-9 and r.grade == int(np.argmax(p)) and r.rejected == (1 - p[0] >= toxicity.REJECT)
    twice = docs.limit(20).unionByName(docs.limit(20))
    assert toxicity.score(twice, model).count() == 40


@pytest.mark.parametrize(("bits", "together"), [(4, 2), (4, 3), (2, 2)])
def test_simhash_links_do_not_depend_on_the_segments(spark, bits, together):
    rng = random.Random(bits + together)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(12)})
    find = _classes([(a, b) for i, b in enumerate(fps) for a in fps[:i] if (a ^ b).bit_count() <= bits], fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r.fp: r.component for r in simhash.link_components(nodes, bits, together).collect()}
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups(got) == groups({signed(f): find(f) for f in fps})
    assert simhash.together_for(10**5, 4) == 1 and simhash.together_for(10**9, 4) > 1


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_the_library(name, spaced):
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\n\n", ".", ",", "'s", "'", "1", "23", "é", "É", "ß", "ﬁ", "İ", "Σ", "σ", "é", "\t", "\r\n", "\xa0", "　", "\x02", "漢", "😀", "<|endoftext|>", "-", "The", "THE", "don't", "World", "!", ")", "...", "%%%", "\x1c", "​", "’", "ñ", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(8000)] + ["", " ", "x" * 5000, " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(15_000))]
    enc = Encoder(Q.tokenizer_path(name), spaced)
    for _ in range(2):
        got = enc.encode(texts)
        want = enc.tok.encode_batch(texts, add_special_tokens=False)
        assert all(np.frombuffer(g, "<u4").tolist() == w.ids for g, w in zip(got, want))
    assert 0 < len(enc.young) + len(enc.old) <= 2 * GENERATION + 50_000
