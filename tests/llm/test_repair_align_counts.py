"""Conversation repair, tokenizer alignment and cached token counts against brute force."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CONV = "conv_id long, turn long, role string, text string"
DOC = "doc_id long, text string, lang string, content string, chunk int, pair string"


# ---- conversation repair -----------------------------------------------------
def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate, role, text = zlib.crc32(name.encode()) % 20, " " if role is None else role, " " if text is None else text
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def brute(rows):
    """All cheapest edits by plain recursion over (row, what was built), letters as text."""
    seen, faults, ends = set(), [], []
    for _, _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.cache
    def best(i, built, left=2):  # built: last initial; more than two insertions in a row are never cheapest
        ways = [(0, "", ())] if i == len(rows) and built in ("", "a") else []
        new = "assistant" if built == "u" else "user"
        if i < len(rows):
            role, text = rows[i][2:]
            c, l, r = best(i + 1, built)
            ways.append((c + 2, "D" + l, r))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 * (faults[i] == "truncated")
                if (built, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    c, l, r = best(i + 1, role[0])
                    ways.append((c + extra, "K" + l, ((role, text), *r)))
                c, l, r = best(i + 1, new[0])
                ways.append((c + extra + 1, "R" + l, ((new, text), *r)))
        if left:
            c, l, r = best(i, new[0], left - 1)
            ways.append((c + 5, "I" + l, ((new, ""), *r)))
        return min(ways or [(10**9, "", ())], key=lambda w: w[:2])

    cost, letters, kept = best(0, "")
    turns = {t for _, t, _, _ in rows if t is not None}
    initials = [r[2][:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, letters,
        hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest(),
    ), kept


def expected(rows, ids):
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())):
        by[r[0]].append(r)
    return {i: brute(by[i]) for i in ids}


def conversations(n=160):
    r = random.Random(7)
    rows = []
    for conv in range(n):
        for turn in range(r.randint(1, 9)):
            rows.append((conv, None if r.random() < 0.05 else turn + r.randint(0, 2), r.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "sage"]),
                         r.choice(["Yes.", "No!", "Why?", "well", " ", "", None, "hm \n", f"text {r.random()}.", f"open {r.random()}", "Ok. \t"])))
    rows += [(None, 0, "user", "a."), (None, 1, "assistant", "b."), (None, None, "system", "s.")]
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, *rows[40:60], (gone, 0, "user", "All of it goes.")]


def test_repair(spark):
    from beatframe.llm.repair import damage, repair, repaired_rows

    rows = conversations()
    df = spark.createDataFrame(rows, CONV).withColumn("many", F.lit("x")).withColumn("key", F.lit(1)).repartition(5)
    ids = {r[0] for r in rows}
    want = expected(damaged(rows), ids)
    got = {r.conv_id: tuple(r)[1:] for r in repair(damage(df), of=df).collect()}
    assert got == {k: v for k, (v, _) in want.items()}
    # (an insertion is never cheapest at these costs: one deletion mends as much)
    assert any(v[6] == "" for v, _ in want.values()) and sum("R" in v[6] for v, _ in want.values()) > 20
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = expected(plain, ids)
    got = defaultdict(list)
    for r in repaired_rows(df).orderBy("place").collect():
        got[r.conv_id].append((r.role, r.text))
    assert {k: tuple(v) for k, v in got.items()} == {k: v for k, (_, v) in want.items() if v}
    empty = spark.createDataFrame([], CONV)
    assert repair(damage(empty), of=empty).count() == 0 and repaired_rows(empty).count() == 0


def test_every_short_conversation():
    """All sequences of up to five symbols, against a plain search over costs and letters."""
    from itertools import product

    from beatframe.llm import repair as R

    def plain(symbols):
        best = {(R.START): (0, "")}
        for s in [*symbols, None]:
            for _ in range(3):
                for q, (c, l) in list(best.items()):
                    n = R.FITTING[q]
                    best[n] = min(best.get(n, (1 << 30, "")), (c + 5, l + "I"))
            if s is not None:
                new = {}
                for q, (c, l) in best.items():
                    for letter, more, n in R._edits(s, q):
                        new[n] = min(new.get(n, (1 << 30, "")), (c + more, l + letter))
                best = new
        return min(best[q] for q in (R.START, R.AFTER_A) if q in best)

    every = [np.array(s, np.uint8) for n in range(5) for s in product(range(9), repeat=n)]
    rng = np.random.default_rng(3)
    every += [rng.integers(0, 9, int(n)).astype(np.uint8) for n in rng.integers(5, 60, 300)]
    assert R.audits(every) == [plain(s.tolist()) for s in every]


def test_long_conversation_in_pieces(monkeypatch):
    from beatframe.llm import repair as R

    rng = np.random.default_rng(5)
    many = [rng.choice(9, 1000, p=[0.02, 0.4, 0.3, 0.05, 0.02, 0.06, 0.05, 0.02, 0.08]).astype(np.uint8) for _ in range(4)]
    whole = R.audits(many)
    monkeypatch.setattr(R, "PIECE", 96)
    assert R.audits(many) == whole


def test_open_conversation_across_batches(spark):
    from beatframe.llm.repair import repair

    rows = [(1, t, "user" if t % 2 else "assistant", f"line {t}.") for t in range(3000)] + [(1, 7, "assistant", "again.")] * 500 + [(2, 0, "user", "a.")]
    df = spark.createDataFrame(rows, CONV)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
        got = {r.conv_id: r for r in repair(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    # 0 is an assistant's, so it goes; the 500 copies too, but one comes between 7 and 8
    assert got[1].duplicate == 499 and got[1].audit.count("D") >= 500 and got[1].gaps == 0 and got[2].audit == "D"
    assert got[1].audit.startswith("DK") and len(got[1].audit.replace("I", "")) == 3500


# ---- tokenizer alignment -----------------------------------------------------
def documents():
    r = random.Random(11)
    words = ["alpha", "beta", "naïve", "Straße", "漢字かな", "  ", "\n\n", "x1y2", "don't", "12345", "🙂", "supercalifragilistic", "\t", "é", "<|endoftext|>", "<s>"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(60)]
    texts += [None, "", " ", "a", "with ▁ inside", "nul \x00 here", "<|endoftext|>", "</s> <unk> <0x41>", "word " * 20000, texts[0], texts[0]]
    return [(i if i % 17 else None, t, None, "c", 1, "p") for i, t in enumerate(texts)]


def test_alignment(spark, monkeypatch):
    import sentencepiece
    from tokenizers import Tokenizer

    from beatframe.llm import align

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {v: k for k, v in {**{x: chr(x) for x in [*range(33, 127), *range(161, 173), *range(174, 256)]}}.items()}
    letters |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in letters.values())}
    rows, linked, holders = [], [], Counter()
    for doc, text, *_ in documents():
        x, y = [], []
        if text:
            enc, ids = a.encode(f" {text}", add_special_tokens=False), b.encode(text)
            x = [(i, bytes(letters[c] for c in t)) for i, t in zip(enc.ids, enc.tokens)]
            y = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p := b.id_to_piece(i)) else p.replace("▁", " ").encode()) for i in ids]
            if b"".join(t for _, t in x) != f" {text}".encode() or b"".join(t for _, t in y) != f" {text}".encode():
                x, y = [], []

        def spans(tokens):
            at, out = 0, []
            for i, t in tokens:
                out.append((i, at, at + len(t)))
                at += len(t)
            return out

        x, y = spans(x), spans(y)
        ends = sorted({e for *_, e in x} & {e for *_, e in y})
        groups = [([i for i, s, e in x if p < e <= q], [i for i, s, e in y if p < e <= q]) for p, q in zip([0, *ends], ends)] if len(x) < 5000 else None
        j, links = 0, []
        for i, s, e in x:
            while j and y[j - 1][2] > s:
                j -= 1
            while j < len(y) and y[j][2] <= s:
                j += 1
            k = j
            while k < len(y) and y[k][1] < e:
                links.append((i, y[k][0]))
                k += 1
        linked.append(links)
        holders.update(set(links))
        rows.append((doc, len(x), len(y), len(ends), len(links), groups))
    most = defaultdict(int)
    for (i, _), k in holders.items():
        most[i] = max(most[i], k)
    want = []
    for (doc, na, nb, ng, nl, groups), links in zip(rows, linked):
        text = None if groups is None else ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        sha = None if text is None else hashlib.sha256(text.encode()).hexdigest() if text else ""
        want.append((doc, na, nb, ng, nl, sum(holders[p] == most[p[0]] for p in links), sum(holders[p] for p in links), sha))
    df = spark.createDataFrame(documents(), DOC).repartition(3)
    for limit in (align.LINKS, 500):
        monkeypatch.setattr(align, "LINKS", limit)
        got = [tuple(r) for r in align.alignments(df, A, B).collect()]
        key = lambda r: (r[0] is not None, r[0] or 0, r[1:4])
        got, expect = sorted(got, key=key), sorted(want, key=key)
        assert [g[:7] for g in got] == [w[:7] for w in expect]
        assert all(w[7] is None or g[7] == w[7] for g, w in zip(got, expect))
    counts = {(r.a_id, r.b_id): (r.n_docs, r.best) for r in align.pair_counts(df, A, B).collect()}
    assert counts == {p: (k, k == most[p[0]]) for p, k in holders.items()}
    one = align.alignments(df.where("doc_id = 1"), A, B, with_groups=True).first()
    assert hashlib.sha256(one.groups.encode()).hexdigest() == one.groups_sha256
    assert align.alignments(df.where("false"), A, B).count() == 0
    assert align.alignments(df.where("text is null"), A, B).agg(F.sum("n_links")).first()[0] == 0


def test_intervals():
    from beatframe.llm.align import coalesce, overlaps

    assert coalesce(np.array([0, 2, 5, 0, 3, 5]), np.array([2, 5, 6, 3, 5, 6])).tolist() == [0, 0, 1, 0, 0, 1]
    a, b = overlaps(np.array([0, 2, 5]), np.array([2, 5, 6]), np.array([0, 3, 5]), np.array([3, 5, 6]))
    assert list(zip(a.tolist(), b.tolist())) == [(0, 0), (1, 0), (1, 1), (2, 2)]


# ---- token counts ------------------------------------------------------------
def test_token_counts(spark, tmp_path):
    from tokenizers import Tokenizer

    import sentencepiece
    from beatframe.llm.token_counts import stored, token_counts

    rows = documents()
    df = spark.createDataFrame(rows, DOC).repartition(3)
    own, piece = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    lower = public_tokenizers.path("word_bpe_49k.json")
    word = Tokenizer.from_file(lower)
    word.no_truncation()
    cache = str(tmp_path / "cache")
    for path, count in ((A, lambda t: len(own.encode(t, add_special_tokens=False).ids)), (B, lambda t: len(piece.encode(t))), (lower, lambda t: len(word.encode(t, add_special_tokens=False).ids))):
        want = sorted(((d or -1, len((t or "").encode()), n := count(t or ""), n > 512) for d, t, *_ in rows))
        got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(df, path, cache).collect())
        assert got == want
    texts = {t or "" for _, t, *_ in rows}
    assert stored(spark, cache).count() == 3 * len(texts) == spark.read.parquet(cache).count()


def test_only_misses_are_encoded(spark, tmp_path):
    from beatframe.llm.token_counts import token_counts, version

    cache = str(tmp_path / "cache")
    spark.createDataFrame([(hashlib.sha256(b"one two").digest(), version(A), 77), (hashlib.sha256(b"three").digest(), "other", 55)], "content binary, tokenizer string, n_tokens long").write.parquet(cache)
    df = spark.createDataFrame([(1, "one two"), (2, "three"), (3, "three")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts(df, A, cache).collect()} == {1: 77, 2: 1, 3: 1}
    assert spark.read.parquet(cache).count() == 3
    assert token_counts(df.where("false"), A, cache).count() == 0


@pytest.mark.parametrize("step", [997])
def test_counts_of_code_points(step):
    """The ranks give the library's counts on every code point in context."""
    from tokenizers import Tokenizer

    from beatframe.llm.token_counts import counter

    own, count = Tokenizer.from_file(A), counter(A)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 50 * step):
        text = "".join(f"a{c}b {c}{c} 1" for c in points[at : at + step])
        assert count(text) == len(own.encode(text, add_special_tokens=False).ids)
