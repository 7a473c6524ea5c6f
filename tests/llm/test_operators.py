"""Corpus operators against brute force, on small tables with nulls, ties, repeats and odd columns."""

import base64
import hashlib
import math
import os
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

LONG = "lorem ipsum dolor sit amet " * 3000
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefgh"), int(r.integers(2, 7)))) for _ in range(n))


def texts():
    base = prose(1, 120)
    words = base.split()
    near = " ".join(["changed", *words[1:]])
    passage = prose(2, 40)
    rows = [
        base, base, near, base.upper(), prose(3, 90), f"{prose(4, 30)} {passage} {prose(5, 25)}", f"{prose(6, 12)}\n{passage}\t{prose(7, 50)}",
        None, "", "   \n", "one two", "one two", "word", LONG, prose(8, 200) + " " + prose(8, 200),
        "mail jo.x@mail.example.com, ip 10.0.0.255 or 10.0.0.256, card 4111 1111 1111 1111, call +1 (437) 555-0689.", "ünï cödé ÄÖÜ " * 30,
    ]
    return [(i, t, None if i == 3 else "en", None if i == 4 else f"s{i % 3}", None) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = texts()
    return spark.createDataFrame([*rows, rows[5], (None, rows[0][1], "en", "s0", 1)], DOC).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOC)


def shingles(t, size=5):
    w = (t or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def component(links, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_near_duplicates(spark, docs):
    from beatframe.llm.near_dedup import keep_one, near_duplicates

    sets = {i: shingles(t) for i, t, *_ in texts()}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = component(links, sets)
    got = near_duplicates(docs, 85).collect()
    assert len(got) == len(texts()) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    kept = sorted(r.doc_id for r in keep_one(docs, 85).collect() if r.doc_id is not None)
    assert kept == sorted(i for i in want if want[i] == i)
    assert near_duplicates(empty(spark)).count() == 0


def test_large_group_of_near_copies(spark, monkeypatch):
    """A cluster of many blocks, part of it in pieces of its own."""
    from beatframe.llm.near_dedup import near_duplicates

    words = prose(11, 100).split()
    far = prose(12, 26).split()
    rows = []
    for i in range(330):
        w = list(words)
        if i % 3 == 0:  # a second family, not similar enough to the first
            w[40:66] = far
        w[i % 100] = f"x{i}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = component(links, sets)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert got == want


def test_components(spark):
    from beatframe.llm.common import components

    r = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in r.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(1, 60)]
    want = component(links, {x for e in links for x in e})
    got = {x.id: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k in got} and all(k in got for k, v in want.items() if k != v)


def test_remove_repeats(spark, docs):
    from beatframe.llm.substring import remove_repeats

    seen, want = set(), {}
    for i, t, *_ in texts():
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - 19):
            z = tuple(w[k : k + 20])
            gone |= set(range(k, k + 20)) if z in seen else set()
            seen.add(z)
        want[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    got = remove_repeats(docs).collect()
    assert len(got) == len(want) + 2
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]
    assert remove_repeats(empty(spark)).count() == 0


def vectors(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(150, 8))
    x[40:60] = x[0] + r.normal(size=(20, 8)) * 0.15
    x[60:65] = x[1]
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    rows += [(150, None, 1), (151, [1.0, None] + [0.0] * 6, 1), (152, [float("nan")] * 8, 1), (153, [float("inf")] + [0.0] * 7, 1), (154, [0.0] * 8, 1), (155, [], 1), rows[7]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3), rows


def test_top_products(spark):
    from beatframe.llm.topk import top_products

    df, rows = vectors(spark)
    v = {i: np.floor(64 * np.array(e, np.float32).astype(float)) for i, e, _ in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)}
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_products(df.where("vec_id <> 7"), F.col("vec_id") % 20 == 0).collect())
    v.pop(7)
    pad = {i: np.pad(x, (0, 8 - len(x))) for i, x in v.items()}
    want = []
    for q in pad:
        if q % 20 == 0:
            best = sorted((-int(pad[q] @ pad[i]), i) for i in pad if i != q)[:20]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert top_products(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_similar_vectors(spark):
    from beatframe.llm.embedding_dedup import similar_vectors

    df, rows = vectors(spark)
    ok = [(k, i, np.array(e, np.float32).astype(float)) for k, (i, e, _) in enumerate(rows) if e and all(c is not None and math.isfinite(c) for c in e) and any(e)]
    unit = {k: x / np.linalg.norm(x) for k, _, x in ok}
    name = {k: i for k, i, _ in ok}
    links = [(a, b) for a, b in combinations(unit, 2) if unit[a] @ unit[b] >= 0.95]
    n = Counter(x for e in links for x in e)
    comp = component([(name[a], name[b]) for a, b in links], {i for i, *_ in rows})
    got = similar_vectors(df).collect()
    assert len(got) == len(rows)
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted((i, n[k], comp[i], comp[i] == i) for k, (i, *_) in enumerate(rows))
    assert similar_vectors(df.limit(0)).count() == 0


def test_personal_data(spark, docs):
    from beatframe.llm.pii import base_spans, personal_data, redacted

    out = {r.doc_id: r for r in personal_data(docs).collect()}
    r = out[15]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    text = texts()[15][1]
    base = ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(text))
    assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(base.split(",")) <= set(r.spans.split(","))
    assert out[7].spans == "" and out[7].redacted is None and out[4].spans == ""
    clean = {r.doc_id: r for r in redacted(docs).collect()}
    assert "<EMAIL>" in clean[15].text and "4111" not in clean[15].text and clean[4].text == texts()[4][1]
    assert personal_data(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_base_patterns(seed):
    from beatframe.llm.pii import base_spans, luhn

    r = np.random.default_rng(seed)
    text = "".join(r.choice(list("01259.@ab-_+() \n%é"), 400)) + " 4111 1111-1111 1111 a@b.c_d@e.f 1.2.3.4.5.6.7.8 " + "9" * 50
    digits = lambda s: re.sub("[^0-9]", "", s)
    want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    want += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    assert base_spans(text) == want


def test_quality(spark, docs):
    from beatframe.llm.quality import accepted, quality_scores

    rows = [(i, prose(i, 60) if i % 3 else " ".join(w + "###" for w in prose(i, 60).split())) for i in range(400)]
    d = spark.createDataFrame([*rows, (1000, None), (None, "")], "doc_id long, text string")
    y = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(5, None, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    out = quality_scores(d, y).collect()
    assert len(out) == 402
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id is not None and r.doc_id < 400:
            assert r.predicted == int(r.doc_id % 3 > 0)
    assert accepted(d, y).where("doc_id < 400").count() == sum(i % 3 > 0 for i in range(400))
    assert quality_scores(docs, y.limit(0)).count() == docs.count()
    assert quality_scores(empty(spark), y).count() == 0


def test_mixing(spark, docs):
    from beatframe.llm.mixing import mixed, mixture, rake

    t = np.random.default_rng(1).random((4, 3, 2)) + 0.1
    want = [np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.25, 0.25]), np.array([0.9, 0.1])]
    w = rake(t, want)
    for k in range(3):
        assert np.allclose(w.sum(axis=tuple(j for j in range(3) if j != k)), want[k])
    out = mixed(docs, share=0.5).collect()
    assert len(out) == docs.count() and all(0 <= r["_probability"] <= 1 for r in out)
    tokens = sum(r["_tokens"] for r in out)
    assert abs(sum(r["_tokens"] * r["_probability"] for r in out) - 0.5 * tokens) < 1e-6 * tokens
    assert mixture(docs).columns == docs.columns
    given = mixed(docs, {"source": {"s0": 0.5, "s1": 0.5}}, share=0.1)
    assert given.where("_source = 'other'").agg(F.max("_weight")).first()[0] == 0
    assert mixed(empty(spark)).count() == 0


def test_language_scores(spark, docs):
    from beatframe.llm.lm import language_scores

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    words = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    got = language_scores(docs).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)), 4)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert language_scores(empty(spark)).count() == 0


def test_language_model_is_a_distribution():
    """Costs of all words of a small alphabet add up to at most 1."""
    from beatframe.llm import lm

    value, item, place, ctx = lm._bytes_of(np.frombuffer(b"abab", np.uint8), np.array([2, 2]), np.array([0, 1]))
    assert value.tobytes() == b"ab ab " and place.tolist() == [0, 1, 2, 0, 1, 2] and item.tolist() == [0, 0, 0, 1, 1, 1]
    for k in range(5):  # contexts do not see the class, the last one does
        assert (ctx[k][:3] == ctx[k][3:]).all()
    assert (ctx[5][:3] != ctx[5][3:]).all()
    bits = [(step, node.tolist(), y.tolist()) for step, node, y in lm._bits(np.array([0b01100001], np.uint8))]
    assert [y[0] for _, _, y in bits] == [0, 1, 1, 0, 0, 0, 0, 1] and [n[0] for _, n, _ in bits] == [1, 2, 5, 11, 22, 44, 88, 176]


def test_warc(spark):
    from beatframe.llm.common import fresh
    from beatframe.llm.warc import captures, round_trip, write_archives

    html = "<p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n</p>é"
    rows = [(1, "http://a/é x\r\ny", html), (2, "http://b/", html), (3, None, None), (4, "u", ""), (5, "u", "x" * 300000), (6, "u", "only"), (6, "u", "only"), (None, "u", html)]
    pages = spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, payload int")
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    top = {}
    for i, _, t in rows:
        top[sha(t)] = max(top.get(sha(t), -1), -1 if i is None else i)
    want = sorted((str(i), len((t or "").encode()), sha(t), "response" if i == top[sha(t)] else "revisit", str(None if i == top[sha(t)] else top[sha(t)])) for i, _, t in rows)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in round_trip(pages).collect())
    assert got == want
    path = fresh(spark, "test")
    write_archives(pages, path)
    for r in captures(spark, path).collect():
        assert r.request.fields["Host"] is not None and r.request.id and r.metadata.id
        assert (r.response.payload is None) == (r.response.warc_type == "revisit")
        if r.page_id == 2:
            assert r.response.payload.decode() == html
    assert round_trip(pages.limit(0)).count() == 0


def test_packing(spark, docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from beatframe.llm.packing import pack, shortest_pack_first

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    more = spark.createDataFrame([(100, "<|endoftext|> a  b\n\n c", "en", "s", 1)], DOC)
    d = docs.where("doc_id <> 5").unionByName(more)
    ids = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 0] for r in d.collect()}
    out = pack(d, path, with_ids=True).collect()
    back, place = {}, {}
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == len(back.setdefault(r.doc_id, [])) and r.doc_tokens == len(ids[r.doc_id]) and r.length == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        back[r.doc_id] += r.ids
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert back == ids
    for p in place.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024
    assert pack(empty(spark), path).count() == 0
    count = {int(k): int(c) for k, c in zip(range(1, 65), np.random.default_rng(2).integers(0, 50, 64))}
    got = Counter()
    for p, n in shortest_pack_first(count, 64):
        assert sum(p) <= 64
        for x in p:
            got[x] += n
    assert got == Counter({k: c for k, c in count.items() if c})


def test_language_model_counts_all_contexts(spark):
    """10,000 words of 24 letters a or b: whole words tell them apart (14 bits), their last four bytes do not (24 bits)."""
    from beatframe.llm import lm

    r = np.random.default_rng(5)
    vocabulary = ["".join(x) for x in r.choice(list("ab"), (10_000, 24))]
    rows = [(i, " ".join(vocabulary[k] for k in r.permutation(10_000)[:1000])) for i in range(40)]
    got = lm.language_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).where("not held_out").collect()
    bits = -sum(x.score for x in got) / sum(x.n_tokens for x in got) / math.log10(2)
    assert 13 < bits < 20
    # counts of bits from counts of bytes
    seen = Counter({(c, v): int(r.integers(0, 9)) for c in range(1, 6) for v in r.choice(256, 9, replace=False).tolist()})
    pairs = np.array(sorted((c << 8) + v for c, v in seen), np.uint64)
    out = lm._counted(pairs, np.array([seen[int(p) >> 8, int(p) & 255] for p in pairs]))
    for p, x in zip(pairs.tolist(), out.T):
        c, v = p >> 8, p & 255
        assert x[0] == seen[c, v]
        for k in range(8):
            assert x[k + 1] == sum(m for (d, u), m in seen.items() if d == c and u >> (7 - k) == (v >> (7 - k)) ^ 1)


def test_mixing_gives_every_value_its_target(spark, monkeypatch):
    from beatframe.llm import mixing

    rows = [(i, prose(i % 7, 5 + i % 100), "en" if i % 3 else "de", f"s{i % 100}", None) for i in range(300)]
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    out = mixing.mixed(docs).collect()
    tokens, weight, seen = Counter(), Counter(), set()
    for r in out:
        tokens[r["_source"]] += r["_tokens"]
        cell = (r["_source"], r["_lang"], r["_topic"])
        weight[r["_source"]] += 0 if cell in seen else r["_weight"]
        seen.add(cell)
    assert len(tokens) == 100
    for s, t in tokens.items():
        assert abs(weight[s] - math.sqrt(t) / sum(math.sqrt(x) for x in tokens.values())) < 1e-5
    # a table that is too large for the driver gives the same
    cells = spark.createDataFrame([(f"s{i % 5}", "en" if i % 3 else "de", i % 2, 1 + i * i % 50 if i else 0) for i in range(30)], "_source string, _lang string, _topic int, tokens long")
    for given, share in (([None] * 3, 0.5), ([{"s1": 0.9, "s2": 0.1, "none": 1.0}, None, None], 0.3)):
        a, b = (sorted(f(cells, given, share, 0.5).collect()) for f in (mixing._on_driver, mixing._in_spark))
        assert [x[:3] for x in a] == [x[:3] for x in b]
        assert np.allclose([x[3:] for x in a], [x[3:] for x in b], atol=1e-8)
    # centres are moved by all documents
    monkeypatch.setattr(mixing, "SAMPLE", 3)
    c = mixing.topics(docs.select("doc_id", "text"))
    import pyarrow as pa

    v = mixing._hashed(pa.array([r[1] for r in rows]))[1]
    near = (v @ c.T).argmax(axis=1)
    for k in range(len(c)):
        total = v[near == k].sum(axis=0)
        assert np.allclose(total / np.sqrt(total @ total), c[k], atol=1e-3)


def test_warc_of_many_members(spark, tmp_path):
    import gzip

    from beatframe.llm import warc

    records = []
    for i in range(40):
        load = f"<p>page {i}</p>\r\n\r\n" + "x" * (i * 70_000)
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n{load}"
        records.append(warc._record("response", f"<urn:{i}>", f"http://a/{i}", http, "application/http;msgtype=response"))
        records.append(warc._record("metadata", f"<urn:m{i}>", f"http://a/{i}", f"page-id: {i}\r\n", "application/warc-fields", WARC_Concurrent_To=f"<urn:{i}>"))
    data = [f"{x}\r\n\r\n".encode() for x in records]
    members = b"".join(gzip.compress(x) for x in data)
    (tmp_path / "a.warc.gz").write_bytes(members)
    got = sorted((r.page_id, r.response.payload_bytes) for r in warc.captures(spark, str(tmp_path), payloads=False).collect())
    assert got == [(i, len(f"<p>page {i}</p>\r\n\r\n") + i * 70_000) for i in range(40)]
    for raw in (members, gzip.compress(b"".join(data)), members + bytes(20), b""):
        for step in (7_001, 1 << 20):
            assert b"".join(warc.inflated(raw, step)) == (b"".join(data) if raw else b"")
    assert [x for _, x in warc.parse(warc.inflated(members))] == [x for _, x in warc.parse(b"".join(data))]
    with pytest.raises(ValueError):
        list(warc.parse(warc.inflated(members[:-30])))


def test_huge_vectors_take_part(spark):
    from beatframe.llm.topk import top_products

    r = np.random.default_rng(4)
    vecs = [(i, [float(x) for x in r.normal(size=4)]) for i in range(60)]
    vecs += [(60, [1e200, 0.0, 0.0, 0.0]), (61, [2e307, -2e307, 0.0, 0.0]), (62, [-1e160, 3.0, 0.0, 1.0])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    whole = {i: [int(max(-1e300, min(1e300, np.floor(64 * np.longdouble(x))))) for x in v] for i, v in vecs}
    clip = lambda x: max(-(2**63) + 1, min(2**63 - 1, x))
    want = {}
    for q in whole:
        if q % 20 == 0:
            scores = sorted(((-clip(sum(a * b for a, b in zip(whole[q], whole[c]))), c) for c in whole if c != q))
            want[q] = [(k + 1, c, -s) for k, (s, c) in enumerate(scores[:5])]
    got = {}
    for x in top_products(df, F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    assert got == want


def test_clashing_names_in_mixing_and_dedup(spark, docs):
    from beatframe.llm.mixing import mixed, mixture
    from beatframe.llm.near_dedup import keep_one

    odd = docs.withColumns({c: F.lit(f"own {c}") for c in ("_topic", "_tokens", "_weight", "_source", "_kept", "_kept_id", "rest", "tokens")})
    for f in (mixture, lambda d: keep_one(d, 85)):
        plain, out = f(docs), f(odd)
        assert out.columns == odd.columns
        assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in plain.collect())
        assert {tuple(r) for r in out.select("_topic", "_tokens", "_weight", "_source", "_kept_id", "rest").distinct().collect()} == {tuple(f"own {c}" for c in ("_topic", "_tokens", "_weight", "_source", "_kept_id", "rest"))}
    assert mixed(odd).schema["_topic"].dataType.simpleString() == "int"


def test_language_model_numbers_are_small():
    """What units and blocks write: sorted hashes lose the bits that their order gives, counts the bytes that none needs."""
    from beatframe.llm import lm

    r = np.random.default_rng(6)
    for kind in (np.uint8, np.int32, np.float32, np.int64):
        x = r.integers(0, 200, 1000).astype(kind)
        for part in (x, x[:1], x[:0]):
            assert (lm._unzip((part.nbytes, lm._zip(part)), kind) == part).all()
    h = np.unique(r.integers(0, 1 << 64, 100_000, dtype=np.uint64))
    assert (lm._unzip_sorted(len(h), lm._zip_sorted(h)) == h).all() and len(lm._zip_sorted(h)) < 6.5 * len(h)
    assert [z.start for _, z in lm._cut(h, 64)] == [int((h < np.uint64(k << 58)).sum()) for k in range(64)] and not list(lm._cut(h[:0], 64))
    for top in (1, 255, 256, 1 << 20, 1 << 40):
        c = r.integers(0, top, 1000, endpoint=True)
        c[0] = top
        assert (lm._unzip_counts(1000, lm._zip_counts(c)) == c).all()
    few = r.geometric(0.5, (9, 10_000))
    assert len(lm._zip_counts(few)) < 0.8 * len(pa.compress(few.astype(np.float32).tobytes(), codec="zstd", asbytes=True))


def test_language_scores_written_bytes(spark, monkeypatch):
    """Tables between the steps, on 240,000 words of 30,000; scores add up where words share the class before them."""
    from beatframe.llm import lm

    r = np.random.default_rng(7)
    word = np.array(["".join(x) + "." for x in r.choice(list("abcdefghijklmnop"), (30_000, 7))])
    texts = [" ".join(word[r.integers(0, 30_000, 600)]) for _ in range(400)]
    pairs = [(texts[2 * k], texts[2 * k + 1]) for k in range(5)]
    rows = [*enumerate(texts), (1000, ""), *((1001 + k, " ".join(p)) for k, p in enumerate(pairs)), (1001, " ".join(pairs[0])), (None, texts[0])]
    written = {}

    def settle(df, what):
        out = settled(df, what)
        written[what] = sum(os.path.getsize(f.removeprefix("file:")) for f in out.inputFiles())
        return out

    settled = lm.settle
    monkeypatch.setattr(lm, "settle", settle)
    got = lm.language_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    score = {x.doc_id: x.score for x in got}
    for k in range(5):
        assert abs(score[1001 + k] + score[1000] - score[2 * k] - score[2 * k + 1]) < 1e-6
    assert score[None] == score[0] and len({x.score for x in got if x.doc_id == 1001}) == 1
    assert sum(written.values()) < 5_350_000, written
