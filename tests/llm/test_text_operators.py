import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from statuta.llm.license_scan import TEMPLATES, license_scan
from statuta.llm.line_dedup import dedup_lines, open_parts
from statuta.llm.mixing import mix_sources, poisson_cdf
from statuta.llm.packing import hilbert_keys, pack_documents
from statuta.llm.quality import chi2_cdf, chi2_quantile, keep_good, quality_verdicts, text_stats
from statuta.llm.token_counts import token_counts
from statuta.llm.tokens import tokenizer_path

ODD = ["", "a\nb", " x ", "a  b", "don't 'S", "<|endoftext|>a", "é́x", "日本語 text", "İstanbul ΣΑΣ", "a\x1cb", "12.5%%", "x\ty", " ", "a b", "w" * 3000]


def brute_stats(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


@pytest.mark.parametrize("text", [None, *ODD, "a b c a b c a", "x y\nx y\n\n\nx y", "# $ %|\n<>&*", "é è é è é è"])
def test_text_stats(text):
    around = [None, "left, with words", text, "", "right"]
    got = text_stats(pa.array(around, pa.string()))
    assert tuple(got[2, :5]) == brute_stats(text)
    words = (text or "").split() and [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    assert tuple(got[2, 6:]) == ((sum(c in "!?" for c in text), sum(map(str.isupper, text)), sum(c in "0123456789" for c in text), len(set(words))) if words else (0,) * 4)


def test_chi2():
    assert abs(chi2_cdf(chi2_quantile(0.95, 9), 9) - 0.95) < 1e-9 and abs(chi2_quantile(0.95, 1) - 3.841459) < 1e-5


def _prose(seed, n=120):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(3, 8))) for _ in range(n))


def test_outliers_go_and_clean_documents_stay(docs_of):
    rows = [(k, _prose(k, 80 + k % 90), "en", "s1" if k % 2 else None) for k in range(700)]
    rows += [(1000 + k, " ".join(w + "###" for w in _prose(k).split()), "en", "s1") for k in range(5)] + [(2000, None, None, None), (2001, "few words", "en", "s1")]
    got = {r.doc_id: r for r in quality_verdicts(docs_of(rows)).collect()}
    assert len(got) == len(rows)
    assert {k for k, r in got.items() if not r.kept} == {*range(1000, 1005), 2000, 2001}
    assert got[2000].base_failed and not got[1000].base_failed
    assert keep_good(docs_of(rows[:3])).count() == 3 and quality_verdicts(docs_of([])).count() == 0


def test_small_groups_are_judged_by_the_whole(docs_of, monkeypatch):
    from statuta.llm import quality

    junk = lambda k: " ".join(w + "###" for w in _prose(k).split())
    few = [(k, _prose(k, 80 + k % 90), "fr", None) for k in range(60)] + [(100 + k, junk(k), "fr", None) for k in range(3)]
    many = [(1000 + k, _prose(1000 + k, 80 + k % 90), "en", "s1") for k in range(250)]
    for rows, limit in ((few, 0), (few + many, 10**6)):
        monkeypatch.setattr(quality, "MAX_BROADCAST", limit)
        assert {r.doc_id for r in quality_verdicts(docs_of(rows)).collect() if not r.kept} == {100, 101, 102}
    assert keep_good(docs_of(few)).count() == 60 and keep_good(docs_of(few[:1])).count() == 1


def plain_estimate(x, q):
    """Reweighted minimum covariance determinant of integer vectors x, by numpy alone: (centre, scatter)."""
    x = np.array(x, dtype=np.float64) / q.SCALE
    floor, d = q._LEAST, x.shape[1]
    centre = np.median(x, axis=0)
    spread = np.sqrt((1.4826 * np.median(np.abs(x - centre), axis=0)) ** 2 + np.diag(floor))
    z = (x - centre) / spread
    shapes = [np.eye(d)]
    for y in (np.tanh(z), z / np.maximum(1e-9, np.sqrt((z**2).sum(axis=1)))[:, None]):
        y = np.round(16384 * y)
        p = y.T @ y
        unit = np.sqrt(np.maximum(np.diag(p), 1e-300))
        shapes.append(p / unit[:, None] / unit[None, :])
    square = lambda c, s: np.einsum("ij,jk,ik->i", x - c, np.linalg.inv(s + floor), x - c)
    found = [(math.inf, k, centre, s * spread[:, None] * spread[None, :], True) for k, s in enumerate(shapes)]

    def step(before, k, c, s, open_):
        d2 = square(c, s)
        bins = np.floor(64 * np.log2(d2 + 1e-6))
        order, counts = np.unique(bins, return_counts=True)
        near = x[bins <= order[np.flatnonzero(np.cumsum(counts) - counts < q.COVERAGE * len(x))[-1]]]
        s = np.cov(near.T, bias=True) * q._factor(q.COVERAGE)
        log_det = np.linalg.slogdet(s + floor)[1]
        return log_det, k, near.mean(axis=0), s, before - log_det > q.SETTLED

    for turn in range(q.MAX_STEPS):
        found = [step(*f) if f[-1] else f for f in found]
        if turn + 1 == q.TRIALS:
            found = [min(found, key=lambda f: f[:2])]
    _, _, c, s, _ = found[0]
    near = x[square(c, s) <= q.chi2_quantile(q.REWEIGHT, d)]
    return near.mean(axis=0), np.cov(near.T, bias=True) * q._factor(q.REWEIGHT)


def plain_verdicts(rows):
    """doc -> (distance, kept) of rows (id, text, lang, source) that pass the base rules, by numpy alone."""
    from statuta.llm import quality as q

    names, scope = [x.split()[0] for x in q.STATS.split(", ")], {"ln": math.log, "sqrt": math.sqrt}
    stats = text_stats(pa.array([r[1] for r in rows], pa.string()))
    passed = [k for k, s in enumerate(stats) if s[0] >= 50 and 100 * s[4] <= 50 * s[0]]
    rows, stats = [rows[k] for k in passed], stats[passed]
    half_up = lambda v: math.floor(abs(v) * q.SCALE + 0.5) * (1 if v >= 0 else -1)
    x = np.array([[half_up(eval(sql, scope, dict(zip(names, map(int, s))))) for sql, _ in q.FEATURES.values()] for s in stats])
    of = lambda test: x[[k for k, r in enumerate(rows) if test(r)]]
    whole = plain_estimate(x, q)
    expected, limit = {}, math.sqrt(q.chi2_quantile(1 - q.TAIL, x.shape[1]))
    for group in {r[2:4] for r in rows}:
        centre, scatter = whole
        for own in (of(lambda r: r[2] == group[0]), of(lambda r: r[2:4] == group)):
            c, s = plain_estimate(own, q) if len(own) > 1 else (own[0] / q.SCALE, np.zeros((x.shape[1],) * 2))
            w = len(own) / (len(own) + q.SHRINK)
            centre, scatter = w * c + (1 - w) * centre, w * s + (1 - w) * scatter
        for k, r in enumerate(rows):
            if r[2:4] == group:
                v = x[k] / q.SCALE - centre
                d = math.sqrt(v @ np.linalg.inv(scatter + q._LEAST) @ v)
                expected[r[0]] = (d, d <= limit)
    return expected


def test_quality_matches_a_plain_estimate(docs_of):
    """Sources and languages of several sizes against numpy."""
    sizes = {("en", "a"): 260, ("en", "b"): 40, ("en", None): 9, ("fr", "a"): 30, (None, "c"): 1}
    rows = [(1000 * g + k, _prose(977 * g + k, 60 + (7 * k) % (80 + 30 * g)) + " Z!" * (k % 3), *group) for g, (group, n) in enumerate(sizes.items()) for k in range(n)]
    rows += [(9000, "w " * 5000 + _prose(1, 6000), "en", "a"), (9001, None, "en", "a")] + [rows[0]] * 2
    got = {r.doc_id: (r.distance, r.kept) for r in quality_verdicts(docs_of(rows)).collect()}
    expected = plain_verdicts(rows)
    assert len(got) == len(set(r[0] for r in rows)) and not got[9001][1]
    assert max(abs(got[k][0] - expected[k][0]) for k in expected) < 1e-6
    assert all(got[k][1] == expected[k][1] for k in expected)


def test_packing_round_trip(docs_of):
    rows = [(k, t) for k, t in enumerate([*ODD, None, "same text", "same text", _prose(1, 900)])] + [(5, "again"), (None, "no id")]
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    pieces = pack_documents(docs_of(rows), length=64, with_ids=True).collect()
    stream = defaultdict(dict)
    for p in pieces:
        assert len(p.ids) == p.length and zlib.crc32(np.array(p.ids, dtype="<u4").tobytes()) == p.ids_crc32
        assert p.offset not in stream[p.sequence_id] and p.offset + p.length <= 64
        stream[p.sequence_id][p.offset] = p
    for k, found in stream.items():
        at = 0
        for offset in sorted(found):
            assert offset == at
            at += found[offset].length
        assert at == 64 or k == max(stream)
    got = Counter(p.doc_tokens for p in pieces if p.start == 0)
    assert got == Counter(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    own = sorted((p.start, p.ids) for p in pieces if p.doc_id == 17)
    assert sum((i for _, i in own), []) == [*library.encode("same text", add_special_tokens=False).ids, 1]
    assert pack_documents(docs_of([])).count() == 0


def test_hilbert_curve_is_a_walk():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    walk = cells[np.argsort(hilbert_keys(cells, 3))]
    assert len(set(hilbert_keys(cells, 3).tolist())) == 512 and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_token_counts_and_cache(spark, docs_of, tmp_path):
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = [(k, t) for k, t in enumerate([*ODD, None, "same", "same", _prose(2, 700)])] + [(None, "same")]
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        got = token_counts(docs_of(rows), cache=cache).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == Counter((i, len((t or "").encode()), n := len(library.encode(t or "").ids), n > 512) for i, t in rows)
    stored = spark.read.parquet(f"{cache}/*")
    assert stored.count() == len({t or "" for _, t in rows})  # encoded once, appended once
    assert token_counts(docs_of([])).count() == 0


def test_license_scan(docs_of):
    notice = dict((label, text) for label, text in TEMPLATES)["bsd"].split()
    wrapped = "\n".join(" ".join(notice[k : k + 6]) for k in range(0, len(notice), 6))
    apart = "\n\n".join(" ".join(notice[k : k + 6]) for k in range(0, len(notice), 6))
    rows = [(1, "Licensed under CC BY-NC 4.0."), (2, None), (3, "ALL\nrights, reserved all rights reserved"), (4, "Licensed under the Apache License, Version 2.0."), (5, "License the apache plain"), (6, "accby all rights reservedx")]
    rows += [(7, f"Head line\n{wrapped}\ntail"), (8, apart), (9, "w " * 30_000 + wrapped), (9, "\n".join(["some line"] * 2000) + "\n" + wrapped), (9, "Redistribution\n" * 500)] + [(10, wrapped)] * 2
    got = defaultdict(list)
    for r in license_scan(docs_of(rows)).collect():
        got[r.doc_id].append(r)
    one = {k: v[0] for k, v in got.items()}
    assert (one[1].labels, one[1].base_labels, one[1].n_words, one[1].first_word, one[1].score) == ("cc-by,cc-by-nc", "cc-by", 7, 2, 1.0)
    assert (one[2].n_words, one[2].labels, one[2].first_word, one[2].score) == (0, "", None, 0.0)
    assert (one[3].n_base, one[3].first_word, one[3].last_word) == (2, 0, 3)
    assert (one[4].labels, one[4].n_base, one[4].score) == ("apache", 0, 1.0)
    assert one[5].labels == "" and one[6].labels == ""
    assert one[7].labels == "bsd" and one[8].labels == "" and sorted(r.labels for r in got[9]) == ["", "bsd", "bsd"]
    assert [r.labels for r in got[10]] == ["bsd", "bsd"] and one[10].score == 1.0
    assert license_scan(docs_of([])).count() == 0


def test_license_templates_are_cut_like_texts(spark, docs_of):
    """Templates with capitals, points and signs, against every template held with every block."""
    rng, letters = random.Random(2), "abcdefgh"
    templates = [(f"t{k}", " ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 8)))) for k in range(60)] + [("full", "Apache License, Version 2.0 (c++)"), ("none", "...")]
    rows = [(k, "".join(rng.choice(letters + "  \n") for _ in range(rng.randrange(200)))) for k in range(60)] + [(100, "the apache LICENSE version 2 0 C"), (101, "A.B.")]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan(docs_of(rows), templates=templates, phrases=[("A.B", "dots")]).collect()}
    words = lambda x: [w for w in re.split(r"[^a-z0-9]+", x.lower()) if w]
    span = max(len(words(t)) for _, t in templates)
    for doc, text in rows:
        lines, best, found = [words(x) for x in text.split("\n")], 0.0, set()
        for i in range(len(lines)):
            after, j = [], i + 1
            while lines[i] and j < len(lines) and lines[j] and len(after) < span:
                after, j = after + lines[j], j + 1
            held = lines[i] + after
            for label, notice in templates:
                if (t := set(words(notice))) and len(t & set(held)) >= max(1, math.ceil(0.8 * len(t) - 1e-9)):
                    found.add(label)
                    best = max(best, len(t & set(held)) / len(t))
        flat = sum(lines, [])
        dots = any(flat[k : k + 2] == ["a", "b"] for k in range(len(flat)))
        assert got[doc] == (",".join(sorted(found | ({"dots"} if dots else set()))), 1.0 if dots else best), doc
    assert "full" in got[100][0] and "dots" in got[101][0]


def plain_line_dedup(rows):
    """Every line against every other: doc -> numbers of the lines that go. Ids are unique."""
    held = []
    for doc, text in rows:
        for number, line in enumerate((text or "").split("\n")):
            tokens = [w for w in re.split(r"[\x20\x09-\x0D]+", line) if w]
            masked = ["<*>" if re.search("[0-9]", w) else w for w in tokens]
            if tokens:
                held.append((doc, number, masked if 2 * sum(w == "<*>" for w in masked) <= len(tokens) else tokens))

    def template(tokens, out):
        n, (parts, _) = len(tokens), open_parts(len(tokens))
        edge = [2 + i * (n - 2) // parts for i in range(parts + 1)]
        return out, *(None if any(edge[i] <= k < edge[i + 1] for i in out) else w for k, w in enumerate(tokens))

    gone = defaultdict(set)
    for make, least in ((lambda t: [tuple(t)], 2), (lambda t: [template(t, out) for out in combinations(range(open_parts(len(t))[0]), open_parts(len(t))[1])] if len(t) > 2 else [], 3)):
        docs = defaultdict(set)
        for doc, _, tokens in held:
            for key in make(tokens):
                docs[key].add(doc)
        for doc, number, tokens in held:
            if any(len(docs[key]) >= least and doc != min(docs[key]) for key in make(tokens)):
                gone[doc].add(number)
    return {doc: None if text is None else "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone[doc]) for doc, text in rows}


def test_line_dedup_against_every_pair(docs_of):
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice(["aa", "bb", "cc", "dd", "e1", "7"]) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 9, 13])))
    rows = [(k, rng.choice(["", " ", "\n"]).join([""]) + "\n".join(line() for _ in range(rng.randrange(6)))) for k in range(120)] + [(500, None), (501, ""), (502, "\n\n"), (503, "one long line " * 9000)]
    got = {r.doc_id: r.text for r in dedup_lines(docs_of(rows)).collect()}
    assert got == plain_line_dedup(rows)
    assert any(got[k] != t for k, t in rows) and any(got[k] == t and t for k, t in rows)


def test_line_dedup(docs_of, spark):
    names = ["anna", "bert", "carl", "dora", "emil", "fritz", "gerd", "hans", "ida", "jan"]
    wide = lambda k: f"report of {names[k]} for this week was read out and {names[9 - k]} agreed again"
    passage = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [(k, f"Posted by {names[k]}\nAll rights reserved.\n{wide(k)}\nown {names[k] * 3} text stays here with {names[(3 * k) % 10]}\nlog 12:0{k} of 7 items done") for k in range(10)]
    rows += [(20, passage), (21, f"{passage}\nown end"), (30, None), (31, ""), (None, passage)]
    got = {r.doc_id: r for r in dedup_lines(docs_of(rows), counts=("n_lines", "gone")).collect()}
    assert got[0].text == rows[0][1] and got[0].gone == 0 and got[0].n_lines == 5
    # By similarity: a field in a short line, two fields far apart, a short line as it is, digits.
    assert all(got[k].text == rows[k][1].split("\n")[3] for k in range(1, 10))
    assert got[20].text == passage and got[21].text == "own end" and got[None].text == ""  # from two documents on
    assert got[30].text is None and got[30].n_lines == 0 and got[31].text == ""
    twice = dedup_lines(spark.createDataFrame([(1, "x y", "h", "i")] * 2 + [(2, "x y", "h", "i")], "doc_id long, text string, line_hash string, LINE_ID string"))
    assert twice.columns == ["doc_id", "text", "line_hash", "LINE_ID"] and sorted(map(tuple, twice.collect())) == [(1, "x y", "h", "i")] * 2 + [(2, "", "h", "i")]
    assert dedup_lines(docs_of([])).count() == 0


def test_mixing(docs_of, spark, monkeypatch):
    from statuta.llm import mixing

    rows = [(k, "text " * 20, "en", "big") for k in range(900)] + [(1000 + k, "text " * 20, "en", None) for k in range(100)] + [(2000, None, None, "void")]
    counts = ("copies", "copy", "place")
    got = mix_sources(docs_of(rows), counts=counts).collect()
    n = Counter(r.source for r in got)
    share = lambda s: s**0.7
    goal = 1000 * share(900) / (share(900) + share(100))
    assert abs(n["big"] - goal) < 5 * math.sqrt(goal)
    per = Counter(r.doc_id for r in got)
    assert all(per[r.doc_id] == r.copies for r in got)
    again = mix_sources(docs_of(rows).repartition(7), counts=counts).collect()
    assert sorted((r.doc_id, r.copy, r.place) for r in again) == sorted((r.doc_id, r.copy, r.place) for r in got)
    with monkeypatch.context() as m:  # the way for tables too large to broadcast
        m.setattr(mixing, "MAX_STEPS", 0)
        assert Counter(r.doc_id for r in mix_sources(docs_of(rows)).collect()) == per
    only = mix_sources(docs_of(rows), weights={"big": 1.0}).collect()
    assert {r.source for r in only} <= {"big", "void"}
    assert abs(poisson_cdf(2.0)[0] - math.exp(-2)) < 1e-12 and poisson_cdf(1000.0)[-1] > 1 - 1e-9
    # Repeated rows draw alike; columns named like the operator's own come back as they were.
    twice = mix_sources(spark.createDataFrame([(k // 2, "words " * 9, "s", "a", "b") for k in range(60)], "doc_id long, text string, source string, cdf string, mix_cdf string"))
    per = Counter(r.doc_id for r in twice.collect())
    assert twice.columns == ["doc_id", "text", "source", "cdf", "mix_cdf"] and per and all(v % 2 == 0 for v in per.values())
    assert {(r.cdf, r.mix_cdf) for r in twice.collect()} == {("a", "b")}
    assert mix_sources(docs_of([])).count() == 0


def test_weights_that_name_no_source_give_no_copy(docs_of):
    rows = [(k, "some text here", "en", "ab"[k % 2]) for k in range(40)] + [(100, "", "en", "empty"), (101, None, "en", None)]
    for weights in ({"gone": 1.0}, {"a": 0.0}, {}):
        assert {r.source for r in mix_sources(docs_of(rows), weights).collect()} <= {"empty", None}
    assert {r.source for r in mix_sources(docs_of(rows), {"a": 1.0, "gone": 3.0}).collect()} <= {"a", "empty", None}
    for bad in (-1.0, math.nan, math.inf):
        with pytest.raises(ValueError):
            mix_sources(docs_of(rows), {"a": bad})


def test_estimates_of_a_source_decide(docs_of, monkeypatch):
    """What is normal in one source is an outlier in another, and other estimates give other verdicts."""
    from statuta.llm import quality

    marked = lambda k: " ".join(w + "##" for w in _prose(k, 90 + k % 80).split())
    plain = lambda k: _prose(k, 90 + k % 80)
    rows = [(k, marked(k), "xx", "tags") for k in range(450)] + [(1000 + k, plain(1000 + k), "en", "prose") for k in range(1500)]
    rows += [(5000 + k, marked(5000 + k), "en", "prose") for k in range(3)] + [(6000 + k, plain(6000 + k), "xx", "tags") for k in range(3)]
    gone = lambda: {r.doc_id for r in quality_verdicts(docs_of(rows)).filter("not kept").collect()}
    assert gone() == {*range(5000, 5003), *range(6000, 6003)}
    def one_for_all(counted, scratch, fit=quality._fit):
        found = fit(counted, scratch)
        return found.select("g_lang", "g_source").crossJoin(found.filter("g_source = '=prose'").select("centre", "root"))

    monkeypatch.setattr(quality, "_fit", one_for_all)
    assert gone() == {*range(450), *range(5000, 5003)}
