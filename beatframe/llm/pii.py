"""Personal data by a semi-Markov conditional random field.

Base spans are found by fixed patterns and always stay.  The field then looks at what is left:
around digits and at-signs a text is cut into small tokens, every segment of at most ``LONGEST``
tokens that could be an entity is a candidate, and whole-span features score it as each kind
(digits and how they are grouped, separators, checksum, octets, the words beside it).  Dynamic
programming over segment ends picks boundaries and kinds together; base spans are fixed
segments of it.  Text away from digits and at-signs has no candidate and so is outside.

Weights are trained by averaged structured updates on a bounded sample of windows
(``SAMPLE``, by hash, from the whole corpus), whose base spans are the truth, each also in
disguise (country code or plus sign left out, at-sign spelt out), so that the field learns the
shape of an entity beyond its pattern.

Scale: texts are read where they lie; nothing is shuffled but the sample.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import chunks, prepare

KINDS = ("email", "ip", "card", "phone")
LONGEST, AROUND, SAMPLE, EPOCHS, MARGIN = 16, 24, 2000, 4, 1.0
# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a run of digits matches from its start or not at all
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_SOLID = re.compile(r"\S+")
_TRIGGER = re.compile(r"[0-9@]+|[(\[]at[)\]]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|[^\sA-Za-z0-9]")
_HIT = r"[0-9@]|[(\[]at[)\]]"
_DIGITS = re.compile(r"[0-9]+")
_AT = re.compile(r" ?(?:@|[(\[]at[)\]]) ?")


def luhn(digits: str) -> bool:
    v = [int(c) for c in reversed(digits)]
    return (sum(v[::2]) + sum(sum(divmod(2 * x, 10)) for x in v[1::2])) % 10 == 0


def _octets(text: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in text.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = []
    if "@" in text:
        at = -1
        while (at := text.find("@", at + 1)) >= 0:  # only in the unbroken piece around an at-sign
            a = b = at
            while a and not text[a - 1].isspace():
                a -= 1
            while b < len(text) and not text[b].isspace():
                b += 1
            # a run of local characters without an at-sign after it is tried once, not from each of its places
            out += [("email", m[0], m[1]) for m in _emails(text, a, b)]
            at = b
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if _octets(m[0])]
    for m in CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def _emails(text: str, a: int, b: int):
    """Matches of EMAIL within text[a:b]: a local run, an at-sign, a domain."""
    while a < b and (m := _LOCAL.search(text, a, b)):
        if m.end() < b and text[m.end()] == "@" and (d := _DOMAIN.match(text, m.end() + 1, b)):
            yield m.start(), d.end()
            a = d.end()
        else:
            a = m.end()


def _windows(text: str) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _possible(s: str) -> tuple[str, ...]:
    """The kinds that a segment could be at all."""
    if not (s[0].isalnum() or s[0] in "+(") or not s[-1].isalnum() or "\n" in s or len(s) > 80:
        return ()
    if "@" in s or "(at)" in s or "[at]" in s:
        return ("email",) if s.count("@") <= 1 and not any(c.isspace() for c in _AT.sub("@", s)) else ()
    groups = _DIGITS.findall(s)
    digits = sum(map(len, groups))
    if s.count(".") == 3 and all(c in "0123456789." for c in s):
        return ("ip", "phone") if digits >= 9 else ("ip",)
    if not all(c in "0123456789 +().-" for c in s) or "  " in s:
        return ()
    kinds = ("card",) if 13 <= digits <= 19 and luhn("".join(groups)) else ()
    return (*kinds, "phone") if 9 <= digits <= 15 and len(groups) > 1 else kinds


def _features(text: str, a: int, b: int) -> list[str]:
    """Of a whole span, to be read with a kind."""
    s = text[a:b]
    groups = [len(x) for x in _DIGITS.findall(s)]
    n = sum(groups)
    f = ["bias", f"groups={'-'.join(map(str, groups[:6]))}", f"last2={groups[-2:]}", f"digits={n}", f"few={len(groups)}"]
    f += [f"sep={c}" for c in sorted(set(s) & set(" .-()+@"))]
    if any(c.isalpha() for c in s):
        f.append("letters")
    if len(ends := _AT.split(s)) > 1:
        f += ["at", f"dot_after={'.' in ends[-1]}"]
    if s.count(".") == 3 and not f[-1] == "letters":
        f.append(f"octets={_octets(s) if all(c in '0123456789.' for c in s) else False}")
    if n >= 13:
        f.append(f"luhn={luhn(''.join(_DIGITS.findall(s)))}")
    before, after = text[a - 1 : a] if a else "", text[b : b + 1]
    f += [f"before={_kind(before)}", f"after={_kind(after)}"]
    return f


def _kind(c: str) -> str:
    return "edge" if not c or c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c if c in "+-.@(" else "mark"


def _score(weights: dict, f: list[str], kind: str) -> float:
    return sum(weights.get((kind, x), 0.0) for x in f)


def decode(text: str, fixed: list[tuple[str, int, int]], weights: dict, margin: float = MARGIN) -> list[tuple[str, int, int]]:
    """Best segmentation of ``text`` around the fixed spans: the spans that the field adds.
    A segment must beat being outside by ``margin``."""
    taken = np.zeros(len(text) + 1, bool)
    for _, a, b in fixed:
        taken[a:b] = True
    edge = [m.start() for m in _TOKEN.finditer(text)] + [len(text)]
    best = [0.0] * len(edge)
    last: list[tuple] = [()] * len(edge)
    live = False
    for j in range(1, len(edge)):
        if best[j - 1] > best[j] or not last[j]:
            best[j], last[j] = best[j - 1], (j - 1, None)
        for i in range(max(0, j - LONGEST), j):
            a, b = edge[i], edge[j]
            if taken[a:b].any() or not (kinds := _possible(text[a:b])):
                continue
            f = _features(text, a, b)
            for kind in kinds:
                v = best[i] + _score(weights, f, kind) - margin
                if v > best[j]:
                    best[j], last[j], live = v, (i, kind), True
    out = []
    if live:
        j = len(edge) - 1
        while j:
            i, kind = last[j]
            if kind:
                out.append((kind, edge[i], edge[j]))
            j = i
    return out[::-1]


def train(windows: list[tuple[str, list[tuple[str, int, int]]]]) -> dict:
    """Averaged structured updates: towards the spans of the truth, away from those decoded."""
    weights: dict = defaultdict(float)
    total: dict = defaultdict(float)
    t = 1
    for _ in range(EPOCHS):
        for text, truth in windows:
            got = decode(text, [], weights, 0.0)
            for spans, sign in ((set(truth) - set(got), 1.0), (set(got) - set(truth), -1.0)):
                for kind, a, b in spans:
                    for x in _features(text, a, b):
                        weights[kind, x] += sign
                        total[kind, x] += sign * t
            t += 1
    return {k: v - total[k] / t for k, v in weights.items() if v - total[k] / t}


def disguised(text: str, spans: list[tuple[str, int, int]]):
    """The window itself, and it with one entity written in another way."""
    yield text, spans
    for k, (kind, a, b) in enumerate(spans):
        s = text[a:b]
        new = re.sub(r"^\+[0-9]{1,3}[ .-]?(?=[(0-9])|^\+", "", s) if kind == "phone" else s.replace("@", " (at) ") if kind == "email" else s
        if new != s and len(spans) == 1:
            yield text[:a] + new + text[b:], [(kind, a, a + len(new))]


def _apart(spans):
    """Those that overlap no earlier one of the list."""
    out = []
    for s in spans:
        if all(s[2] <= a or b <= s[1] for _, a, b in out):
            out.append(s)
    return sorted(out, key=lambda s: s[1])


def _sample(batches):
    for b in chunks(batches):
        texts = pc.fill_null(b.column("text"), "")
        texts = texts.filter(pc.match_substring_regex(texts, "[0-9@]"))
        doc, rows = [], []
        for text in texts.to_pylist():
            spans = base_spans(text)
            for a, z in _windows(text):
                if z - a <= 400:
                    own = [(k, x - a, y - a) for k, x, y in spans if a <= x and y <= z]
                    rows.append((text[a:z], [{"kind": k, "a": x, "b": y} for k, x, y in own]))
        t = pa.array([r[0] for r in rows], pa.string())
        s = pa.array([r[1] for r in rows], pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32())])))
        yield pa.RecordBatch.from_arrays([t, s], names=["text", "spans"])


def fit(docs: DataFrame) -> dict:
    """Weights from at most SAMPLE windows of the corpus."""
    w = docs.select("text").mapInArrow(_sample, "text string, spans array<struct<kind:string,a:int,b:int>>")
    rows = w.orderBy(F.xxhash64("text"), "text").limit(SAMPLE).collect()
    return train([x for r in rows for x in disguised(r.text, _apart([(s.kind, s.a, s.b) for s in r.spans]))])


def spans_of(text: str, weights: dict) -> tuple[list, list]:
    """Base spans, and all spans, by kind and start."""
    base = base_spans(text)
    more = []
    for a, b in _windows(text):
        own = [(k, max(x, a) - a, min(y, b) - a) for k, x, y in base if x < b and a < y]
        more += [(k, x + a, y + a) for k, x, y in decode(text[a:b], own, weights)]
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))


def _join(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans) -> str:
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _find(weights: dict):
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for b in chunks(batches):
            texts = pc.fill_null(b.column("text"), "")
            hit = pc.match_substring_regex(texts, _HIT).to_numpy(zero_copy_only=False)
            n = len(texts)
            count, sha, spans = np.zeros((n, 4), np.int64), [empty] * n, [""] * n
            clean: list = [None] * n
            for i in np.flatnonzero(hit).tolist():
                text = texts[i].as_py()
                base, every = spans_of(text, weights)
                for k, _, _ in base:
                    count[i, KINDS.index(k)] += 1
                if every:
                    sha[i] = hashlib.sha256(_join(base).encode()).hexdigest()
                    spans[i] = _join(every)
                    clean[i] = redact(text, every)
            redacted = pc.coalesce(pa.array(clean, pa.string()), b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(count[:, k]) for k in range(4)), pa.array(sha), pa.array(spans), redacted], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "redacted"])

    return run


def _redact(weights: dict):
    def run(batches):
        for b in chunks(batches):
            texts = pc.fill_null(b.column("text"), "")
            clean: list = [None] * len(texts)
            for i in np.flatnonzero(pc.match_substring_regex(texts, _HIT).to_numpy(zero_copy_only=False)).tolist():
                if every := spans_of(text := texts[i].as_py(), weights)[1]:
                    clean[i] = redact(text, every)
            at = b.schema.get_field_index("text")
            yield b.set_column(at, "text", pc.coalesce(pa.array(clean, pa.string()), b.column("text")))

    return run


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of personal data in ``text`` replaced by its kind."""
    prepare(docs.sparkSession)
    return docs.mapInArrow(_redact(fit(docs)), docs.schema)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, redacted (the text with spans replaced).

    Counts and hash are of the base spans; ``spans`` has those added by the field too.  Null
    text counts as empty and stays null.  Repeated rows give a row each.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shape = ", ".join(["doc_id long", *(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string", "redacted string"])
    return docs.mapInArrow(_find(fit(docs)), shape)
