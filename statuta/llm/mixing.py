"""Mixing sources to target weights by Poisson replication.

Every source gets a target share of the mixture; its mean repetition rate is the share's size over
the source's own. A document's count inverts the Poisson distribution of that mean at a hash of
seed and id, so the draw is the same on every run and every partitioning. Documents are exploded
by their counts and dealt out by another hash, a global shuffle in one exchange. The table of rates
is a row a source and broadcast while it is small, so texts move once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .shared import Scratch, free_name

#: Target shares are proportional to size ** ALPHA where no weights are given.
ALPHA = 0.7
SEED = 17
_STEP = 2.0**48
#: Most numbers of all sources' distributions that are broadcast (8 bytes each); beyond, rows meet them by salted keys.
MAX_STEPS = 2_000_000
_SALTS = 64


def poisson_cdf(rate: float) -> list[float]:
    """P(X <= j) for j = 0, 1, ... until the tail is below the resolution of the draw."""
    if rate <= 0:
        return [1.0]
    out, total = [], 0.0
    for j in range(math.ceil(rate + 12 * math.sqrt(rate) + 30)):
        total += math.exp(j * math.log(rate) - rate - math.lgamma(j + 1))
        out.append(total)
    return out


def _with_cdf(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        frame["cdf"] = [poisson_cdf(x) for x in frame.rate]
        yield frame


def _draw(*parts: Column) -> Column:
    """48 hashed bits as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", counts: tuple[str, str, str] | None = None
) -> DataFrame:
    """The columns of ``docs``, a row a copy, in hashed order; ``counts`` names three more columns for
    the number of copies, the copy (from 1) and its place in the order.

    Sizes are characters. With ``weights`` a source not named gets none, without them shares are
    ``size ** alpha``; the whole mixture is as large as ``docs``. Null sources are a source of
    their own, null ids draw alike, repeated rows draw alike, empty texts weigh nothing but are
    drawn with their source's rate; a source of no characters has rate 1. Where ``weights`` give no source
    of the table anything, no source with characters gets a copy; negative or non-finite weights raise
    ValueError. Equal places are ordered
    by id and copy. An empty table gives none. Names of other columns don't matter.
    """
    if weights and not all(math.isfinite(w) and w >= 0 for w in weights.values()):
        raise ValueError("weights are finite numbers from 0 on")
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.length(text_col), F.lit(0))).cast("double").alias("size"))
    if weights is None:
        wanted = F.pow("size", F.lit(alpha))
    else:
        wanted = F.lit(0.0)
        for name, weight in weights.items():
            wanted = F.when(F.col("source") == name, float(weight)).otherwise(wanted)
    sized = scratch.save(sized.withColumn("wanted", F.when(F.col("size") > 0, wanted).otherwise(0.0)), "sizes")
    whole = sized.agg(F.sum("size").alias("all"), F.sum("wanted").alias("weights"))
    rates = sized.crossJoin(F.broadcast(whole)).select("source", F.when(F.col("size") == 0, 1.0).when(F.col("weights") == 0, 0.0).otherwise(F.col("wanted") / F.col("weights") * F.col("all") / F.col("size")).alias("rate"))  # one row beside each source
    rates = scratch.save(rates.mapInPandas(_with_cdf, "source string, rate double, cdf array<double>").drop("rate"), "rates")

    own = [c for c in docs.columns if c not in (counts or ())]
    from_, cdf, salt, at_, copies, copy, place = (free_name(own, x) for x in ("mix_source", "mix_cdf", "mix_salt", "mix_at", "mix_copies", "mix_copy", "mix_place"))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    named = rates.select(F.col("source").alias(from_), F.col("cdf").alias(cdf))
    same = F.col(source_col).eqNullSafe(F.col(from_))
    steps = rates.agg(F.sum(F.size("cdf"))).first()[0] or 0
    if steps <= MAX_STEPS:
        met = docs.select(*own).join(F.broadcast(named), same)
    else:  # a hot source is dealt out by salts
        salted = named.withColumn(f"{salt}_2", F.explode(F.expr(f"sequence(0L, {_SALTS - 1}L)")))
        met = docs.select(*own, F.pmod(F.xxhash64(key), F.lit(_SALTS)).alias(salt)).join(salted, same & (F.col(salt) == F.col(f"{salt}_2")))
    drawn = met.withColumn(at_, _draw(F.lit(str(seed)), key) / F.lit(_STEP)).withColumn(copies, F.expr(f"cast(size(filter({cdf}, c -> c <= {at_})) as long)")).filter(F.col(copies) > 0)
    dealt = drawn.select(*own, copies, F.explode(F.expr(f"sequence(1L, {copies})")).alias(copy))
    placed = dealt.withColumn(place, _draw(F.lit(str(seed)), key, F.col(copy).cast("string")))
    ordered = placed.repartition(place).sortWithinPartitions(place, id_col, copy)
    return ordered.select(*own, *(F.col(c).alias(n) for c, n in zip((copies, copy, place), counts or ())))


def mixed_sql() -> str:
    """The same rows for DuckDB."""
    draw = lambda *parts: f"cast('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 12) as bigint)"
    key = "coalesce(cast(doc_id as varchar), 'null')"
    return f"""
with sized as (select source, cast(sum(coalesce(length(text), 0)) as double) as size from documents group by source),
wanted as (select source, size, case when size > 0 then pow(size, {ALPHA}) else 0.0 end as w from sized),
rates as (select source, case when size > 0 then w / (select sum(w) from wanted) * (select sum(size) from wanted) / size else 1.0 end as rate from wanted),
pmf as (
  select source, j, exp(j * ln(rate) - rate - lgamma(j + 1)) as p
  from (select source, rate, unnest(range(cast(ceil(rate + 12 * sqrt(rate) + 30) as bigint))) as j from rates)),
cdf as (select source, list(c order by j) as cdf from (select source, j, sum(p) over (partition by source order by j) as c from pmf) group by source),
drawn as (
  select d.*, len(list_filter(c.cdf, lambda x: x <= {draw(f"'{SEED}'", key)} / {_STEP})) as copies
  from documents d join cdf c on d.source is not distinct from c.source),
copied as (select *, unnest(range(1, copies + 1)) as copy from drawn where copies > 0)
select doc_id, text, lang, source, n_chars, cast(copies as bigint) as copies, copy, {draw(f"'{SEED}'", key, 'cast(copy as varchar)')} as place from copied"""
