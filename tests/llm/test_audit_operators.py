import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from statuta.llm import divergence, personal_data as pd_, part_codes as pc
from statuta.llm.divergence import source_divergence
from statuta.llm.part_codes import part_codes
from statuta.llm.personal_data import base_spans, candidates, digests, find_personal_data

# --- divergence -------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_divergence(rows, min_docs=3, top=200):
    """Every count and every pair over all terms; rows: (id, text, lang, source)."""
    of = defaultdict(lambda: defaultdict(Counter))
    docs, groups = defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source, found = lang or "", source or "", TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        of[lang][source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        whole = Counter()
        for s in sources:
            whole.update({t: of[lang][s][t] for t in kept})
        shares = lambda counts: {t: 1 + 10**9 * (counts[t] + 1) // (sum(counts[x] for x in kept) + len(kept)) for t in kept}
        p, q = {s: shares(of[lang][s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if of[lang][s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -value, k + 1) for k, (value, _, item) in enumerate(found)}
    return out


def _docs(seed, n):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "kéßnT" for b in "aeiouöxyz"] + ["日本", "ÉA", "Éa", "a"]
    return [(k, " 1,".join(rng.choices(words, [1 / (j + 1) for j in range(len(words))], k=rng.randrange(0, 12))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "Z", None, "é"])) for k in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_divergence_equals_plain_counts(docs_of, seed):
    rows = _docs(seed, 90) + [(900, None, "en", "nothing"), (901, "", "xx", "alone"), (902, "one two", "yy", "a"), (903, "three", "yy", "b"), (0, "repeated id", "en", "s1")]
    rows += [rows[3]] * 2  # repeated rows are documents of their own
    got = [tuple(r) for r in source_divergence(docs_of(rows), top_terms=5).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_divergence(rows, top=5)
    assert {r for r in got if r[0] == "yy"} == {("yy", "a", "pair", "b", 0, 1), ("yy", "b", "pair", "a", 0, 1)} and not any(r[0] == "xx" for r in got)


def test_divergence_of_other_thresholds_and_no_rows(docs_of):
    rows = _docs(9, 60)
    assert {tuple(r) for r in source_divergence(docs_of(rows), min_docs=1).collect()} == plain_divergence(rows, min_docs=1)
    assert source_divergence(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        source_divergence(docs_of(rows), min_docs=0)


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1, 2)], names=["lang", "source", "text"])


@pytest.mark.parametrize("cap", [3, 300])
def test_sketch_never_underestimates_and_drops_most_rare_terms(monkeypatch, cap):
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "_PIECE", 7)
    monkeypatch.setattr(divergence, "WIDTH_BITS", 12)
    rng = random.Random(1)
    rows = [("en", "s", " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + int(rng.random() ** 3 * 26))}" for _ in range(20)) + f" rare{''.join(chr(97 + int(c)) for c in str(k))}") for k in range(400)]
    docs = Counter(t for r in rows for t in set(TERM.findall(r[2])))
    tables = []
    for low in range(0, 400, 100):
        (out,) = divergence._sketched(cap)(iter([_batch(rows[low : low + 100])]))
        tables.append(divergence._unpack(out.column(0)[0].as_py(), cap).astype(int))
    table = np.minimum(sum(tables), cap)
    terms = list(docs)
    at = divergence._cells(b"en", [t.encode() for t in terms])
    least = np.stack([row[c] for row, c in zip(table, at)]).min(axis=0)
    assert all(e >= min(cap, docs[t]) for e, t in zip(least, terms))
    rare = [e >= cap for e, t in zip(least, terms) if docs[t] < cap]
    assert sum(rare) < 0.1 * len(rare)

    class Sent:
        value = np.packbits(table >= cap, axis=1, bitorder="little")

    n, d = Counter(), Counter()
    for out in divergence._survivors(Sent)(iter([_batch(rows)])):
        for r in out.to_pylist():
            n[r["term"]] += r["n"]
            d[r["term"]] += r["docs"]
    assert {t for t in docs if docs[t] >= cap} <= set(d) and all(d[t] == docs[t] and n[t] == sum(TERM.findall(r[2]).count(t) for r in rows) for t in list(d)[:20])


# --- part codes -------------------------------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows: (id, vector, label) that take part, ids distinct -> {id: (code, error, label_error)} and the codebooks."""
    down = lambda x: math.floor(scale * x) if abs(x) < 1e290 else math.floor(x) * scale
    rows = sorted(rows)
    made = [[down(x) for x in v] for _, v, _ in rows]
    size = len(made[0]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for v in made]
    books = [[cut[k][p] for k in range(min(entries, len(rows)))] for p in range(parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for v in cut:
                held[near(v[p], books[p])[1]].append(v[p])
            books[p] = [[sum(c) // len(held[k]) for c in zip(*held[k])] if k in held else e for k, e in enumerate(books[p])]
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, label), e in zip(rows, errors):
        by_label[label] += e
    cap = 2**63 - 1
    return {i: (bytes(k for _, k in f).hex(), min(e, cap), min(by_label[label], cap)) for (i, _, label), f, e in zip(rows, found, errors)}, books


def _vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, key string, raw string")


@pytest.mark.parametrize("n,dims,big", [(60, 16, 1.0), (5, 8, 1.0), (40, 24, 1e25), (30, 8, 1e300)])
def test_part_codes_equal_plain_rounds(spark, n, dims, big):
    rng = random.Random(n)
    rows = [(k * 7 - 20, [rng.choice([-1, 1, 0.3, -0.25]) * big if rng.random() < 0.5 else rng.gauss(0, 1) for _ in range(dims)], rng.choice([1, 2, None])) for k in range(n)]
    odd = [(1000, None, 1), (1001, [1.0] * (dims - 1) + [None], 1), (1002, [float("nan")] * dims, 2), (1003, [float("-inf")] * dims, 2), (1004, [1.0] * (dims + 8), 2), (1005, [], None)]
    found, books = part_codes(_vectors(spark, rows + odd), return_books=True)
    want, plain = plain_codes(rows)
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in found.collect()}
    assert got == want and books.tolist() == plain
    digest = hashlib.sha256(",".join(str(x) for part in plain for entry in part for x in entry).encode()).hexdigest()
    assert {r.codebooks_sha256 for r in found.collect()} == {digest}


def test_part_codes_of_ties_repeats_and_nothing(spark):
    same = [(k // 2, [0.5] * 8, None) for k in range(40)] + [(None, [0.5] * 8, 3)]
    got = part_codes(_vectors(spark, same)).collect()
    assert len(got) == 41 and {(r.code, r.error, r.label_error) for r in got} == {("00" * 8, 0, 0)} and sum(r.vec_id is None for r in got) == 1
    for rows in ([], [(1, None, 1)], [(1, [1.0] * 9, 1)]):
        assert part_codes(_vectors(spark, rows)).count() == 0
    with pytest.raises(ValueError):
        part_codes(_vectors(spark, same), entries=257)


def test_blocks_hold_bounded_rows():
    batch = lambda n: pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(["="] * n), pa.array([[0.5] * 8] * n, pa.list_(pa.float64()))], names=["vec_id", "key", "vector"])
    made = list(pc._blocks(8, False, 4096)(iter([batch(3000), batch(0), batch(3000), batch(10)])))
    sizes = [len(b.column(0)[0]) for b in made]
    assert sum(sizes) == 6010 and max(sizes) <= pc.BLOCK_ROWS
    assert pc._block(made[0].column(2)[0].as_py(), 8, False, 4096).shape == (8, sizes[0])


# --- personal data ----------------------------------------------------------------------------

GAZETTEERS = {"domains": pd_.TOP_DOMAINS, "codes": pd_.CALLING_CODES, "names": pd_.GIVEN_NAMES}
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def plain_base(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if max(map(int, m.group().split("."))) <= 255]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and plain_luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


def test_base_spans_equal_the_plain_forms():
    rng = random.Random(5)
    pieces = ["a@b.co", "@", "a", ".", "-", "+", " ", "(", "1", "12", "4111111111111111", "4111 1111 1111 1111", "255.1.2.3", "256.1.2.3", "1.2.3", "0001.2.3.4", "+49 30 123456", "+1", ")", "é", "_%", "x@y", ".de", "5-5", "\n", "０", "1.2.3.4.5"]
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 14)))
        assert [(pd_.KINDS[k], a, b) for k, a, b in base_spans(text)] == plain_base(text), text


def test_candidates_of_endless_runs_take_linear_time():
    n = 300_000
    for text in ("1" * n, "1 " * n, "a" * n, "a@" * n, "+1 " * n, "1.2." * n, "+" + "1(" * n, "A" * n, "The " * n, "Dr. " * n, ":" * n, "a:1:" * n, "a at b dot " * (n // 4), "[at]" * n, "a.9@b.com " * (n // 10), "4111 1111 1111 1112 " * (n // 20)):
        began = time.time()
        candidates(text, GAZETTEERS)
        assert time.time() - began < 20, text[:20]


#: What the base forms miss, and look-alikes that are no personal data.
HIDDEN = ["{w}.{w} [at] example [dot] com", "{w} (at) {w}.org", "{w} at {w} dot net", "2001:db8:0:1::{h}", "+1 (212) 555-{d4} 190.137.223.204", "4111111111111111 4012888888881881 {d4}", "call (212) 555-{d4}", "card 3782 822463 10005", "my name is Anna {W}", "Dr. {W} {W}"]
HARMLESS = ["token = \"{h}{h}{h}{h}{d8}{h}\"", "order {d8}", "at noon", "The Same Words", "12:30:45", "version 999.1.2.3", "number 9807915762804490", "ISBN 978{d4}{d4}1", "the year 2020 2021 2022", "page 12 of 400"]


def _filled(rng, form):
    word = lambda: "".join(rng.choices("bcdfglmnprstvz", k=5))
    out = re.sub(r"\{d(\d)\}", lambda m: "".join(rng.choices("123456789", k=int(m[1]))), form)
    return re.sub(r"\{(.)\}", lambda m: {"w": word(), "W": word().capitalize(), "h": "".join(rng.choices("abcdef0123456789", k=4))}[m[1]], out)


def _text(rng, *parts):
    prose = lambda: " ".join("".join(rng.choices("aeioulnrst", k=rng.randrange(2, 8))) for _ in range(12))
    return prose() + "".join(f". {p} {prose()}" for p in parts)


def test_added_spans_catch_hidden_data_and_leave_the_rest(docs_of):
    rng = random.Random(3)
    plain = ["bob.99@mail.example.com", "+1 (212) 555-1234", "192.0.2.77", "4111111111111111"]
    rows, hidden = [], {}
    for k in range(600):
        if k % 3 == 0:
            part = _filled(rng, HIDDEN[k // 3 % len(HIDDEN)])
            hidden[k] = HIDDEN[k // 3 % len(HIDDEN)]
        else:
            part = _filled(rng, HARMLESS[k % len(HARMLESS)]) if k % 3 == 1 else rng.choice(plain)
        rows.append((k, _text(rng, part), "en", "s"))
    found, report = find_personal_data(docs_of(rows), return_report=True)
    got = {r.doc_id: r.spans for r in found.collect()}
    added = {k: [s for s in spans if not s.base] for k, spans in got.items()}
    assert all(added[k] for k in hidden), {hidden[k] for k in hidden if not added[k]}
    assert not any(got[k] for k in got if k % 3 == 1), [rows[k][1] for k in got if k % 3 == 1 and got[k]][:3]
    assert not any(added[k] for k in got if k % 3 == 2)
    for k, spans in got.items():
        assert [(s.kind, s.start, s.end) for s in spans if s.base] == plain_base(rows[k][1])
        order = [(pd_.KINDS.index(s.kind), s.start) for s in spans]
        assert order == sorted(order)
    # Estimated, not assumed: the digits' check tells cards apart, and its prior has moved.
    assert report["card"]["personal"]["check"] > 0.95 and report["card"]["not"]["check"] < 0.1


def test_reliabilities_are_estimated_from_the_votes():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.4
    accuracy = [(0.95, 0.05), (0.9, 0.3), (0.6, 0.4), (0.99, 0.2), (0.8, 0.1), (0.7, 0.3)]
    votes = np.stack([np.where(rng.random(20000) < 0.2, 0, np.where(rng.random(20000) < np.where(truth, a, b), 1, 2)) for a, b in accuracy], axis=1)
    patterns, place, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    chance, right, wrong = pd_.estimate(patterns, counts.astype(float), np.zeros(len(patterns), dtype=bool))
    assert np.abs(right - [a for a, _ in accuracy]).max() < 0.03 and np.abs(wrong - [b for _, b in accuracy]).max() < 0.03
    assert ((chance[place.ravel()] > 0.5) == truth).mean() > 0.95


def test_personal_data_of_odd_rows(docs_of):
    long = "word " * 200_000 + "x@y.org"
    rows = [(1, None), (2, ""), (3, "é x@y.org +1 (826) 555-4081 190.137.223.204"), (3, "é x@y.org +1 (826) 555-4081 190.137.223.204"), (None, "10.0.0.1"), (5, long)]
    got = sorted((tuple(r) for r in digests(find_personal_data(docs_of(rows))).collect()), key=lambda r: (r[0] or 0, r[1:]))
    empty = hashlib.sha256(b"").hexdigest()
    assert got[0] == (None, 0, 1, 0, 0, hashlib.sha256(b"ip:0:8").hexdigest(), "ip:0:8")
    assert got[1:3] == [(1, 0, 0, 0, 0, empty, ""), (2, 0, 0, 0, 0, empty, "")]
    want = (3, 1, 1, 0, 0, hashlib.sha256(b"email:2:9,ip:28:43").hexdigest(), "email:2:9,ip:28:43,phone:10:27")
    assert got[3:5] == [want] * 2 and got[5][-1] == f"email:{len(long) - 7}:{len(long)}"
    assert find_personal_data(docs_of([])).count() == 0
