"""The whole pipeline against a composition of plain stages."""

import hashlib
import math
import random
from collections import Counter, defaultdict

from tokenizers import Tokenizer

import corpus_pipeline
from statuta.llm.tokens import tokenizer_path

from .test_near_dup import groups_by_brute_force
from .test_text_operators import _prose, plain_line_dedup, plain_verdicts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _documents():
    rng, rows = random.Random(8), []
    shared = [f"shared passage {_prose(900 + k, 12)}" for k in range(3)]
    for k in range(120):
        lines = [_prose(20 * k + j, 30 + (k + j) % 9) for j in range(3)] + rng.sample(shared, k % 3)
        rng.shuffle(lines)
        rows.append((k, "\n".join(lines), "en" if k % 4 else "fr", f"s{k % 3}" if k % 7 else None))
    for k in range(12):  # copies with a word changed, and whole ones
        words = rows[3 * k][1].replace("\n", " \n ").split(" ")
        words[5 + k] = "changed"
        rows.append((200 + k, (" ".join(words) if k % 2 else rows[3 * k][1]).replace(" \n ", "\n"), "en", "s1"))
    rows += [(300 + k, " ".join(w + "###" for w in _prose(k, 90).split()), "en", "s0") for k in range(4)] + [(400, None, "en", "s0"), (401, "short", "en", "s0")]
    return rows


def _copies(rows):
    size = Counter()
    for _, text, _, source in rows:
        size[source] += len(text)
    weight = {s: n**0.7 for s, n in size.items() if n}
    out = {}
    for doc, _, _, source in rows:
        rate = weight[source] / sum(weight.values()) * sum(size.values()) / size[source] if size[source] else 1.0
        at, k, total = int(hashlib.md5(f"17:{doc}".encode()).hexdigest()[:12], 16) / 2**48, 0, 0.0
        while True:
            total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            if total > at:
                break
            k += 1
        out[doc] = k
    return out


def test_pipeline_against_plain_stages(spark, tmp_path):
    rows = _documents()
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    kept = {k for k, (_, good) in plain_verdicts(rows).items() if good}
    good = [r for r in rows if r[0] in kept]
    texts = plain_line_dedup([(i, t) for i, t, *_ in good])
    groups = groups_by_brute_force([(i, t or "") for i, t in texts.items()], 80)
    left = [(i, texts[i], lang, source) for i, _, lang, source in good if groups[i][1] == i]
    assert len(kept) < len(rows) and any(texts[i] != t for i, t, *_ in good)
    copies = _copies(left)
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(p.doc_id for p in pieces if p.start == 0) == {i: n for i, n in copies.items() if n}
    tokens = {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t, *_ in left}
    assert all(p.doc_tokens == tokens[p.doc_id] for p in pieces)
    total, ends = Counter(), defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == ends[p.sequence_id]
        ends[p.sequence_id] += p.length
        total[p.doc_id] += p.length
    assert total == {i: n * tokens[i] for i, n in copies.items() if n}
    assert all(n == 2048 for s, n in ends.items() if s != max(ends))


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA + ", text_hash string, gone string, cdf string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
