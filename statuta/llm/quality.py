"""Quality rules with robust multivariate outlier rejection.

Base rules look at one text alone. The method then estimates, for every language and source, the
minimum covariance determinant of a transformed statistic vector and rejects texts by their
Mahalanobis distance.

Estimates cover all rows. Three deterministic starts (medians with median absolute deviations, the
correlation of hyperbolic tangents, the spatial sign covariance) take concentration steps: the
``COVERAGE`` share of rows nearest to the current centre gives the next centre and scatter. After
``TRIALS`` steps the start of the least determinant goes on alone until its determinant no longer
falls; rows within the 0.975 quantile of that estimate then give the reweighted one.

Every row counts for its language and source, for its language and for the whole. The estimate of a
language is shrunk towards the whole and that of a source towards its language, by ``SHRINK``
pseudo-rows each, so a source of any size has an estimate of its own and a small one leans on more.

A step is one aggregation to (group, distance bin) and a running sum over the bins, so a hot group
is summed up on every partition before anything is shuffled and no group meets in one task.
Statistics are integers in 1/1024, which makes all sums exact and the verdicts independent of the
partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .shared import Scratch
from .words import Words, pieces, windows

SCALE = 1024
#: name -> (SQL over the counts, least standard deviation): a spread below the second figure is noise.
FEATURES = {
    "log_words": ("ln(1 + n_words)", 0.5),
    "word_length": ("ln(word_chars / n_words)", 0.1),
    "symbols": ("sqrt(n_symbols / n_words)", 0.05),
    "marks": ("sqrt(n_marks / n_words)", 0.1),
    "capitals": ("sqrt(n_capitals / word_chars)", 0.05),
    "digits": ("sqrt(n_digits / word_chars)", 0.12),
    "dup_lines": ("n_dup_lines / n_lines", 0.12),
    "repeats": ("n_repeat_words / n_words", 0.12),
    "distinct": ("ln(n_distinct_words / n_words)", 0.2),
}
COVERAGE = 0.75
#: Steps that every start takes; the best goes on until the log determinant falls by less than ``SETTLED``. It falls with every step, so that comes; more than ``MAX_STEPS`` is an error.
TRIALS, MAX_STEPS, SETTLED = 2, 200, 1e-3
#: Rows within this quantile of the chi-square distribution give the reweighted estimate.
REWEIGHT = 0.975
#: Weight of the wider estimate, in rows.
SHRINK = 200
#: Chance of a row of a normal population to be rejected; small, as real statistics have longer tails.
TAIL = 1e-9
#: Distances are binned by 64 steps to the power of two.
_BINS = 64
#: Most rows of estimates that are broadcast (some 600 bytes each); beyond, rows are joined by salted keys.
MAX_BROADCAST = 20_000
_SALTS = 32

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_marks long, n_capitals long, n_digits long, n_distinct_words long"


def _bytes(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_SYMBOLS, _MARKS, _DIGITS, _CAPITALS = map(_bytes, (b"#*$%&|<>", b"!?", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_LEADS = np.array([b & 0xC0 != 0x80 for b in range(256)])
_upper: np.ndarray | None = None


def _capitals(found: Words) -> np.ndarray:
    """Upper-case letters of each text, by Unicode where a text is not ASCII."""
    global _upper
    if not len(found.data) or found.data.max() < 128:
        return found.per_text(_CAPITALS[found.data])
    if _upper is None:
        _upper = np.array([chr(k).isupper() for k in range(0x110000)])
    points = np.frombuffer(found.data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    upto = np.concatenate([[0], np.cumsum(_upper[points])])
    places = np.concatenate([[0], np.cumsum(_LEADS[found.data])])[found.offsets]
    return np.diff(upto[np.minimum(places, len(points))])


def text_stats(texts: pa.Array) -> np.ndarray:
    """Counts of each text in the order of ``STATS``; null counts as empty."""
    found = Words(texts)
    data, offsets, first = found.data, found.offsets.tolist(), found.first.tolist()
    hashes = found.hashes(fold=False)
    triples = windows(hashes, 3)
    out = np.zeros((len(texts), 10), dtype=np.int64)
    out[:, 0] = np.diff(found.first)
    lead_of_word = found.per_word(_LEADS[data])
    word_upto = np.concatenate([[0], np.cumsum(lead_of_word)])
    out[:, 1] = np.diff(word_upto[found.first])
    out[:, 2], out[:, 6], out[:, 8] = (found.per_text(x[data]) for x in (_SYMBOLS, _MARKS, _DIGITS))
    out[:, 7] = _capitals(found)
    for k, (a, b) in enumerate(zip(first, first[1:])):
        n = b - a
        if not n:
            out[k, 6:9] = 0
            continue
        lines = [x for x in data[offsets[k] : offsets[k + 1]].tobytes().split(b"\n") if x.strip()]
        out[k, 5], out[k, 3] = len(lines), len(lines) - len(set(lines))
        ordered = np.sort(hashes[a:b])
        out[k, 9] = 1 + np.count_nonzero(ordered[1:] != ordered[:-1])
        if n >= 4:
            own = triples[a : b - 2]
            ordered = np.sort(own)
            twice = ordered[1:][ordered[1:] == ordered[:-1]]
            if len(twice):
                again = np.isin(own, twice)
                covered = np.zeros(n, dtype=bool)
                for j in range(3):
                    covered[j : j + n - 2] |= again
                out[k, 4] = covered.sum()
    return out


def _counted(at: int, kept: bool):
    """Counts beside the columns; ``at``: the text's, which stays if ``kept`` and is the last one otherwise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in STATS.split(", ")]
        for batch in batches:
            for part in pieces(batch, at):
                stats, own = text_stats(part.column(at)), part.num_columns - (not kept)
                yield pa.RecordBatch.from_arrays([*part.columns[:own], *(pa.array(stats[:, k]) for k in range(10))], names=[*part.schema.names[:own], *names])

    return run


BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function by its series."""
    if x <= 0:
        return 0.0
    term = total = 1.0 / a
    k = 1
    while term > total * 1e-16:
        term *= x / (a + k)
        total += term
        k += 1
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_cdf(x: float, d: int) -> float:
    return _gamma_p(d / 2, x / 2)


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, d) < p else (low, mid)
    return high


NAMES = list(FEATURES)
PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i, len(NAMES))]
_LEAST = np.diag([FEATURES[x][1] ** 2 for x in NAMES])


def _factor(share: float) -> float:
    """Consistency factor of the scatter of the nearest ``share`` of a normal population."""
    d = len(NAMES)
    return share / chi2_cdf(chi2_quantile(share, d), d + 2)


def _square(values) -> np.ndarray:
    out = np.empty((len(NAMES), len(NAMES)))
    for (i, j), x in zip(PAIRS, values):
        out[i, j] = out[j, i] = x
    return out


def _moments(n: int, sums, products) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter; integers are exact up to the division."""
    sums = [int(x) for x in sums]
    scatter = _square((n * int(p) - sums[i] * sums[j]) / (n * n * SCALE * SCALE) for (i, j), p in zip(PAIRS, products))
    return np.array([x / (n * SCALE) for x in sums]), scatter


def _root(scatter: np.ndarray) -> list[float]:
    """Upper-triangular root of the inverse of ``scatter`` with the least spreads."""
    root = np.linalg.cholesky(np.linalg.inv(scatter + _LEAST)).T
    return [float(root[i, j]) for i, j in PAIRS]


def _log_det(scatter: np.ndarray) -> float:
    return float(np.linalg.slogdet(scatter + _LEAST)[1])


PARAMS = "g_lang string, g_source string, start int, centre array<double>, root array<double>, log_det double, open boolean"


def _stepped(factor: float):
    """(n, sums, products, before) of a group and start -> the next estimate; open while the determinant falls."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            out = []
            for lang, source, start, n, sums, products, before in zip(x.g_lang, x.g_source, x.start, x.n, x.sums, x.products, x.before):
                centre, scatter = _moments(int(n), sums, products)
                log_det = _log_det(scatter * factor)
                out.append((lang, source, start, centre.tolist(), _root(scatter * factor), log_det, bool(before - log_det > SETTLED)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PARAMS.split(", ")])

    return run


def _started(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Medians, deviations and products of transformed rows -> the three starts of a group."""
    for x in frames:
        out = []
        for lang, source, mid, off, tanh, sign in zip(x.g_lang, x.g_source, x.mid, x.off, x.tanh, x.sign):
            spread = np.sqrt((1.4826 * np.array(off) / SCALE) ** 2 + np.diag(_LEAST))
            for start, products in enumerate((None, tanh, sign)):
                shape = np.eye(len(NAMES))
                if products is not None:
                    shape = _square(int(p) for p in products)
                    unit = np.sqrt(np.maximum(np.diag(shape), 1e-300))
                    shape = shape / unit[:, None] / unit[None, :]
                scatter = shape * spread[:, None] * spread[None, :]
                out.append((lang, source, start, [m / SCALE for m in mid], _root(scatter), math.inf, True))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PARAMS.split(", ")])


def _shrunk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reweighted moments of a source, its language and the whole -> centre and root."""
    factor = _factor(REWEIGHT)
    for x in frames:
        out = []
        for row in x.itertuples():
            centre, scatter = _moments(int(row.whole_n), row.whole_sums, row.whole_products)
            scatter = scatter * factor
            for n, size, sums, products in ((row.lang_n, row.lang_size, row.lang_sums, row.lang_products), (row.n, row.size, row.sums, row.products)):
                own, around = _moments(int(n), sums, products)
                weight = size / (size + SHRINK)
                centre, scatter = weight * own + (1 - weight) * centre, weight * around * factor + (1 - weight) * scatter
            out.append((row.g_lang, row.g_source, centre.tolist(), _root(scatter)))
        yield pd.DataFrame(out, columns=["g_lang", "g_source", "centre", "root"])


def _distance() -> F.Column:
    """Squared Mahalanobis distance of the row's vector, all in generated code."""
    at = {p: k for k, p in enumerate(PAIRS)}
    terms = []
    for i in range(len(NAMES)):
        inner = " + ".join(f"root[{at[i, j]}] * (f_{NAMES[j]} / {SCALE}D - centre[{j}])" for j in range(i, len(NAMES)))
        terms.append(f"pow({inner}, 2)")
    return F.expr(" + ".join(terms))


KEY = ["g_lang", "g_source"]


def _counted_rows(docs: DataFrame, keep: list[str], text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """Counts, statistics and base verdict of each row; the columns of ``keep`` have the prefix ``k_``.

    Group names begin with "=", so that no null or literal clashes with the wider groups' "*".
    """
    name = lambda c: F.concat(F.lit("="), F.coalesce(F.col(c).cast("string"), F.lit("\0")))
    src = docs.select(*(F.col(c).alias(f"k_{c}") for c in keep), name(lang_col).alias("g_lang"), name(source_col).alias("g_source"), *([] if text_col in keep else [F.col(text_col).alias("text")]))
    kept = text_col in keep
    own = src.schema.fields if kept else src.schema.fields[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + ", " + STATS
    counted = src.mapInArrow(_counted(list(keep).index(text_col) if kept else len(own), kept), schema).withColumn("base_failed", F.expr(BASE_FAILED))
    scale = lambda sql: F.expr(f"cast(round(({sql}) * {SCALE}) as long)")
    return counted.withColumns({f"f_{k}": F.when(~F.col("base_failed"), scale(sql)) for k, (sql, _) in FEATURES.items()})


def _met(rows: DataFrame, estimates: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` beside their group's saved ``estimates``: broadcast below a checked size, else by salted keys, so a hot group is split."""
    if estimates.count() <= MAX_BROADCAST:
        return rows.join(F.broadcast(estimates), KEY, how)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*(f"f_{x}" for x in NAMES)), F.lit(_SALTS)))
    return salted.join(estimates.withColumn("salt", F.explode(F.expr(f"sequence(0L, {_SALTS - 1}L)"))), [*KEY, "salt"], how).drop("salt")


def _sums(*more: str) -> list[F.Column]:
    """Exact sums and products of the rows of an aggregation's group."""
    return [F.count("*").alias("n"), *(F.expr(f"sum(f_{x})").alias(f"s_{x}") for x in NAMES), *(F.expr(f"sum(f_{NAMES[i]} * f_{NAMES[j]})").alias(f"p_{i}_{j}") for i, j in PAIRS), *map(F.expr, more)]


def _arrays() -> list[F.Column]:
    return [F.array(*(F.col(f"s_{x}").cast("string") for x in NAMES)).alias("sums"), F.array(*(F.col(f"p_{i}_{j}").cast("string") for i, j in PAIRS)).alias("products")]


def _starts(rows: DataFrame, scratch: Scratch, parts: int) -> DataFrame:
    # Exact medians, as the statistics are integers of a bounded range.
    median = lambda what, k: F.expr(f"cast(percentile({what}, 0.5) as double)").alias(f"m{k}")
    both = [F.col(f"m{k}") for k in range(len(NAMES))]
    mid = scratch.save(rows.groupBy(*KEY).agg(*(median(f"f_{x}", k) for k, x in enumerate(NAMES))).select(*KEY, F.array(*both).alias("mid")), "mid", parts)
    off = _met(rows, mid).groupBy(*KEY).agg(*(median(f"abs(f_{x} - mid[{k}])", k) for k, x in enumerate(NAMES))).select(*KEY, F.array(*both).alias("off"))
    off = scratch.save(mid.join(off, KEY), "off", parts)
    # Transformed rows as integers of 14 bits, whose products sum up exactly.
    z = {f"z{k}": F.expr(f"(f_{x} - mid[{k}]) / sqrt(pow(1.4826 * off[{k}], 2) + {(SCALE * FEATURES[x][1]) ** 2})") for k, x in enumerate(NAMES)}
    around = _met(rows, off).withColumns(z).withColumn("norm", F.expr(f"greatest(1e-9, sqrt({' + '.join(f'z{k} * z{k}' for k in range(len(NAMES)))}))"))
    around = around.withColumns({f"{t}{k}": F.expr(f"cast(round(16384 * {sql.format(k=k)}) as long)") for t, sql in (("t", "tanh(z{k})"), ("u", "z{k} / norm")) for k in range(len(NAMES))})
    summed = around.groupBy(*KEY).agg(*(F.expr(f"sum({t}{i} * {t}{j})").alias(f"{t}_{i}_{j}") for t in "tu" for i, j in PAIRS))
    flat = summed.select(*KEY, *(F.array(*(F.col(f"{t}_{i}_{j}") for i, j in PAIRS)).alias(name) for t, name in (("t", "tanh"), ("u", "sign"))))
    return scratch.save(off.join(flat, KEY).mapInPandas(_started, PARAMS), "starts", parts)


def _fit(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Estimates (g_lang, g_source, centre, root) for every language and source of the counted rows."""
    good = scratch.save(rows.filter("not base_failed").select(*KEY, *(f"f_{x}" for x in NAMES)), "good")
    levels = F.array(F.struct("g_lang", "g_source"), F.struct("g_lang", F.lit("*").alias("g_source")), F.struct(F.lit("*").alias("g_lang"), F.lit("*").alias("g_source")))
    wide = good.select(F.explode(levels).alias("g"), *(f"f_{x}" for x in NAMES)).select("g.g_lang", "g.g_source", *(f"f_{x}" for x in NAMES))

    # Tables of estimates have a row a group and start: so many files.
    parts = 1 + good.select(*KEY).distinct().count() // 1000
    params, done, factor = _starts(wide, scratch, parts), None, _factor(COVERAGE)
    key = [*KEY, "start"]
    best = W.partitionBy(*KEY).orderBy("log_det", "start")
    for step in range(1, MAX_STEPS + 1):
        near = _met(wide, params).withColumn("bin", F.expr("0D") + F.floor(_BINS * F.log2(_distance() + 1e-6)))
        binned = near.groupBy(*key, "bin").agg(*_sums("max(log_det) as before"))
        upto = W.partitionBy(*key).orderBy("bin")
        chosen = binned.withColumn("inner", F.sum("n").over(upto) - F.col("n")).withColumn("all", F.sum("n").over(W.partitionBy(*key))).filter(f"inner < {COVERAGE} * all")
        exact = lambda c: F.expr(f"sum(cast({c} as decimal(38,0)))").alias(c)
        sums = chosen.groupBy(*key).agg(F.sum("n").alias("n"), F.max("before").alias("before"), *(exact(f"s_{x}") for x in NAMES), *(exact(f"p_{i}_{j}") for i, j in PAIRS))
        made = scratch.save(sums.select(*key, "n", "before", *_arrays()).mapInPandas(_stepped(factor), PARAMS), f"step_{step}", parts)
        if step < TRIALS:
            params = made
            continue
        if step == TRIALS:
            made = scratch.save(made.withColumn("rank", F.row_number().over(best)).filter("rank = 1").drop("rank"), "best", parts)
        settled = made.filter("not open")
        done, params = settled if done is None else done.union(settled), made.filter("open")
        if params.isEmpty():
            break
    else:
        raise RuntimeError(f"estimates have not settled in {MAX_STEPS} steps")
    done = scratch.save(done, "done", parts)

    # Reweighting: one more aggregation over the rows that the least determinant takes for regular.
    limit = chi2_quantile(REWEIGHT, len(NAMES))
    sizes = wide.groupBy(*KEY).agg(F.count("*").alias("size"))
    regular = _met(wide, done).filter(_distance() <= limit).groupBy(*KEY).agg(*_sums())
    found = scratch.save(regular.select(*KEY, "n", *_arrays()).join(sizes, KEY), "regular", parts)
    named = lambda t: [F.col(c).alias(f"{t}_{c}") for c in ("n", "size", "sums", "products")]
    whole = found.filter("g_lang = '*'").select(*named("whole"))  # one row
    langs = found.filter("g_source = '*' and g_lang <> '*'").select("g_lang", *named("lang"))
    met = found.filter("g_source <> '*'").join(langs, "g_lang").crossJoin(F.broadcast(whole))
    return scratch.save(met.mapInPandas(_shrunk, "g_lang string, g_source string, centre array<double>, root array<double>"), "estimates", parts)


def _scored(rows: DataFrame, estimates: DataFrame, tail: float) -> DataFrame:
    """``rows`` with distance and kept."""
    judged = _met(rows, estimates, "left").withColumn("distance", F.when(~F.col("base_failed"), F.sqrt(_distance())))
    rejected = F.col("distance") > math.sqrt(chi2_quantile(1 - tail, len(NAMES)))
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(rejected, F.lit(False)))


def quality_verdicts(docs: DataFrame, keep: list[str] = ("doc_id",), text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tail: float = TAIL) -> DataFrame:
    """``keep`` columns, counts, distance, base_failed and kept of each row; rows stay as many as they are.

    Null text counts as empty and fails the base rules. Null languages and sources are groups
    of their own. Rows that fail the base rules take no part in the estimates. A source of few
    rows is judged by little more than its language's estimate, a language of few rows by that of
    all rows; one row alone is its own centre and stays. Ties and repeated rows count each; an
    empty table gives none. Names of other columns don't matter.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.save(_counted_rows(docs, keep, text_col, lang_col, source_col), "rows")
    judged = _scored(rows, _fit(rows, scratch), tail)
    counts = [x.split()[0] for x in STATS.split(", ")]
    return judged.select(*(F.col(f"k_{c}").alias(c) for c in keep), *counts, "base_failed", "distance", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject, with the same columns.

    Rows are stored once beside their counts, so they are never joined by id: null and repeated ids
    are safe and no column's name can clash. Null and empty texts go, as they fail the base rules;
    repeated rows and ties are judged alike; an empty table gives none.
    """
    scratch, own = Scratch(docs.sparkSession, "quality"), docs.columns
    rows = scratch.save(_counted_rows(docs, own, "text", "lang", "source"), "rows")
    judged = _scored(rows, _fit(rows, scratch), TAIL)
    return judged.filter("kept").select(*(F.col(f"k_{c}").alias(c) for c in own))
