"""Sparse features in long form: (row key, term or index, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import checkpointed

#: Fixed value: words of two characters on, and the single letters that are words.
TOKEN = r"(?U)\b(?:[aeouy]|\w{2,})\b"


def tokens(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def ngrams(words: Column, least: int = 1, most: int = 3) -> Column:
    """Runs of ``least`` to ``most`` adjacent words, each run joined by single spaces."""

    def of(n: int) -> Column:
        if n == 1:
            return words
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(*(of(n) for n in range(least, most + 1)))


#: Texts a task, where rows of key and term are dealt out: tasks grow in number with the corpus, not in size.
TASK_TEXTS = 1000


def task_number(texts: int, spark: SparkSession) -> int:
    """Tasks for the terms of so many texts; not fewer than the session runs at once."""
    return max(spark.sparkContext.defaultParallelism, -(-texts // TASK_TEXTS))


def term_counts(data: DataFrame, key: str, text: str, least: int = 1, most: int = 3, tasks: int | None = None) -> DataFrame:
    """(key, term, tf); texts without a word have no row.

    ``tasks`` deals the texts to so many first (see ``task_number``): a task counts keys and terms in a
    table as long as what it reads, which without that is as long as a file's row group.
    """
    data = data.select(key, text).repartition(tasks, key) if tasks else data
    # Words are a column of their own, or every run would tokenize its text again.
    words = data.select(F.col(key), tokens(text).alias("__words"))
    return words.select(key, F.explode(ngrams(F.col("__words"), least, most)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def term_frequencies(data: DataFrame, key: str, text: str, least: int = 1, most: int = 3) -> DataFrame:
    """(term, df, tf): keys that hold the term, and how often they do.

    Where no key stands twice, a text's runs are sorted within its row and the first of equal ones
    is marked, so that rows of key and term need no shuffle: only sums by term are moved.
    """
    if not data.groupBy(key).count().filter("count > 1").isEmpty():
        return term_counts(data, key, text, least, most).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    words = data.select(tokens(text).alias("__words"))
    runs = words.select(F.sort_array(ngrams(F.col("__words"), least, most)).alias("__runs"))
    marked = F.transform("__runs", lambda term, i: F.struct(term.alias("term"), ((i == 0) | (F.get("__runs", i - 1) != term)).cast("long").alias("new")))
    return runs.select(F.inline(marked)).groupBy("term").agg(F.sum("new").alias("df"), F.count("*").alias("tf"))


def fit_vocabulary(counts: DataFrame, n_rows: int | Column) -> DataFrame:
    """(term, df, idf) of training counts; idf = ln((1 + n) / (1 + df)) + 1. Indexed by ``with_index`` where an order is wanted."""
    n = F.lit(n_rows) if isinstance(n_rows, int) else n_rows
    return counts.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1)


def with_index(vocabulary: DataFrame, order: str = "term", name: str = "feature_index") -> DataFrame:
    """0-based index in order of the terms' code points, without one task for all.

    Terms are filed by their first three characters; an index is the rows of the files before
    plus the place within the file.
    """
    first = F.substring(F.col(order), 1, 3)
    cells = vocabulary.groupBy(first.alias("__cell")).agg(F.count("*").alias("__n"))
    before = cells.withColumn("__before", F.sum("__n").over(W.orderBy("__cell")) - F.col("__n")).drop("__n")
    met = vocabulary.withColumn("__cell", first).join(before, "__cell")
    return met.withColumn(name, (F.row_number().over(W.partitionBy("__cell").orderBy(order)) - 1 + F.col("__before")).cast("long")).drop("__cell", "__before")


def weigh(counts: DataFrame, vocabulary: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """(key, term, value): tf * idf over each row's length. Terms not in the vocabulary drop out.

    Squares are summed in their order, so that rows of equal counts have equal values to the last bit.
    ``tasks`` deals the keys to so many. Counts pass by a task's part of the vocabulary and aren't sorted by term.
    """
    raw = counts.join(vocabulary.select("term", "idf").hint("shuffle_hash"), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("raw"))
    raw = raw.repartition(tasks, key) if tasks else raw
    whole = W.partitionBy(key).orderBy("raw").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return raw.select(key, "term", (F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(whole))).alias("value"))


def proportional_count(vocabulary: int, share: tuple[int, int] = (70, 3770)) -> int:
    """round(vocabulary * part / whole), halves to even."""
    return round(vocabulary * share[0] / share[1])


def proportional(vocabulary: Column, share: tuple[int, int] = (70, 3770)) -> Column:
    """The same of a column."""
    return F.bround(vocabulary * share[0] / share[1]).cast("long")


def _told_apart(value: Column, digits: int) -> Column:
    """The value at ``digits``; from where doubles have no more of them, as it is."""
    unit = 10.0**digits
    return F.when(F.abs(value) * unit < 2**52, F.floor(value * unit + 0.5) / unit).otherwise(value)


def mutual_information(values: DataFrame, labels: DataFrame, key: str, label: str, digits: int = 12, tasks: int | None = None) -> DataFrame:
    """(term, mi): information in nats of each term's exact values, zero among them, about the label.

    Values are rounded to ``digits`` before they are told apart. Cells of the value zero are what
    the class totals leave. A column a class holds the counts, so that values are shuffled once, by
    term and value (to ``tasks``, if given), and only sums by term alone.
    """
    sizes = {r["l"]: r["n_l"] for r in labels.groupBy(F.col(label).alias("l")).agg(F.count("*").alias("n_l")).collect()}  # a row a class
    n, classes = F.lit(sum(sizes.values())), [l for l in sizes if l is not None]
    gain = lambda c, nv, nl: F.when(c > 0, c / n * F.log(n * c / (nv * F.lit(nl)))).otherwise(0.0)
    added = lambda parts: sum(parts, F.lit(0.0))
    met = values.join(labels.select(key, F.col(label).alias("l")), key).select("term", _told_apart(F.col("value"), digits).alias("v"), "l")
    met = met.repartition(tasks, "term", "v") if tasks else met
    cells = met.groupBy("term", "v").agg(F.count("*").alias("n_v"), *(F.count_if(F.col("l") == l).alias(f"c{k}") for k, l in enumerate(classes)))
    some = added(gain(F.col(f"c{k}"), F.col("n_v"), sizes[l]) for k, l in enumerate(classes))
    sums = cells.groupBy("term").agg(F.sum(some).alias("some"), F.sum("n_v").alias("n_t"), *(F.sum(f"c{k}").alias(f"c{k}") for k in range(len(classes))))
    left = [(F.lit(sizes[l]) - F.col(f"c{k}"), sizes[l]) for k, l in enumerate(classes)] + [(F.lit(sizes[l]), sizes[l]) for l in sizes if l is None]
    none = added(gain(c0, n - F.col("n_t"), n_l) for c0, n_l in left)
    return sums.select("term", (F.col("some") + none).alias("mi"))


def with_rank(data: DataFrame, orders: list[Column], name: str = "rank") -> DataFrame:
    """``data`` with its place (from 1) in the total order ``orders``, without one task for all.

    Rows are dealt out by ranges of the order and kept so; a rank is the rows of the ranges before
    plus the place within the range.
    """
    part = F.spark_partition_id()
    ranged = checkpointed(data.repartitionByRange(*orders).withColumn("__range", part))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    # A row a range, as many as shuffle partitions at most.
    before = sizes.withColumn("__before", F.sum("__n").over(W.orderBy("__range")) - F.col("__n")).drop("__n")
    place = F.row_number().over(W.partitionBy("__range").orderBy(*orders))
    return ranged.join(F.broadcast(before), "__range").withColumn(name, place + F.col("__before")).drop("__range", "__before")


#: Selections up to this size are ranked in one task; larger ones by ranges. The result is the same.
ONE_TASK = 10_000


def select_k_best(scores: DataFrame, k: int, score: str = "mi", index: str = "feature_index", digits: int = 12) -> DataFrame:
    """The k best features: at the cut-off the highest index stays; ``rank`` shows ties in index order."""
    rated = scores.withColumn("__s", F.round(score, digits))
    cut, shown = [F.desc("__s"), F.desc(index)], [F.desc("__s"), F.asc(index)]
    if k <= ONE_TASK:
        return rated.orderBy(*cut).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*shown))).drop("__s")
    best = with_rank(rated, cut, "__place").filter(F.col("__place") <= k).drop("__place")
    return with_rank(best, shown).withColumn("rank", F.col("rank").cast("int")).drop("__s")


def matrix_difference(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Largest absolute difference of two sparse matrices; what one lacks counts as zero.

    Cells are grouped, not joined: matrices that stand dealt by some of the keys are neither moved nor
    sorted for it. A cell that stands several times counts by its extremes.
    """
    none, x = F.lit(None).cast("double"), F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    both = a.select(*keys, x.alias("__x"), none.alias("__y")).unionByName(b.select(*keys, none.alias("__x"), x.alias("__y")))
    extreme = lambda of, c: F.coalesce(of(c), F.lit(0.0))
    met = both.groupBy(*keys).agg(F.greatest(extreme(F.max, "__x") - extreme(F.min, "__y"), extreme(F.max, "__y") - extreme(F.min, "__x")).alias("__d"))
    return met.agg(F.coalesce(F.max("__d"), F.lit(0.0)).alias("max_difference"))


def selected_terms(values: DataFrame, labels: DataFrame, indexed: DataFrame, k: int | None, key: str, label: str) -> DataFrame:
    """(term, feature_index) of the k best terms by the rows of ``labels`` alone, numbered anew by rank; all of ``indexed`` if k is None."""
    if k is None:
        return indexed.select("term", "feature_index")
    scored = indexed.select("term", "feature_index").join(mutual_information(values, labels, key, label), "term", "left")
    best = select_k_best(scored.withColumn("mi", F.coalesce("mi", F.lit(0.0))), k)
    return best.select("term", (F.col("rank") - 1).cast("long").alias("feature_index"))


def information_by_fold(values: DataFrame, rows: DataFrame, key: str, label: str, fold: str, whole: bool = False, digits: int = 12) -> DataFrame:
    """(fold, term, mi): ``mutual_information`` by the rows outside each fold; with ``whole`` by all rows too, as the fold null.

    A column a fold and class holds the counts of a term's value, and a fold's own are taken from their sums:
    values are shuffled once for all folds.
    """
    sizes = {(r["f"], r["l"]): r["n"] for r in rows.groupBy(F.col(fold).alias("f"), F.col(label).alias("l")).agg(F.count("*").alias("n")).collect()}  # a row a fold and class
    folds, classes = sorted({f for f, _ in sizes}), sorted({l for _, l in sizes})
    met = values.join(rows.select(key, F.col(label).alias("l"), F.col(fold).alias("f")), key)
    cells = met.groupBy("term", _told_apart(F.col("value"), digits).alias("v")).agg(*(F.count_if((F.col("f") == f) & (F.col("l") == l)).alias(f"c{i}_{j}") for i, f in enumerate(folds) for j, l in enumerate(classes)))
    sets = [*enumerate(folds), *([(-1, None)] if whole else [])]
    seen = lambda i, j: sum((F.col(f"c{k}_{j}") for k in range(len(folds)) if k != i), F.lit(0))
    counts = cells.select("term", *(seen(i, j).alias(f"s{i}_{j}") for i, _ in sets for j in range(len(classes)))) if sizes else cells
    total = {i: [sum(n for (g, m), n in sizes.items() if m == l and (f is None or g != f)) for l in classes] for i, f in sets}
    gain = lambda i, c, nv, nl: F.when(c > 0, c / F.lit(sum(total[i])) * F.log(F.lit(sum(total[i])) * c / (nv * F.lit(nl)))).otherwise(0.0)
    added = lambda parts: sum(parts, F.lit(0))
    cols = range(len(classes))
    some = [added(gain(i, F.col(f"s{i}_{j}"), added(F.col(f"s{i}_{m}") for m in cols), total[i][j]) for j in cols) for i, _ in sets]
    sums = counts.groupBy("term").agg(*(F.sum(x).alias(f"some{i}") for (i, _), x in zip(sets, some)), *(F.sum(f"s{i}_{j}").alias(f"t{i}_{j}") for i, _ in sets for j in cols))
    none = {i: added(gain(i, F.lit(total[i][j]) - F.col(f"t{i}_{j}"), F.lit(sum(total[i])) - added(F.col(f"t{i}_{m}") for m in cols), total[i][j]) for j in cols) for i, _ in sets}
    kind = rows.schema[fold].dataType
    pairs = F.array(*(F.struct(F.lit(f).cast(kind).alias(fold), (F.col(f"some{i}") + none[i]).alias("mi")) for i, f in sets))
    return sums.select("term", F.explode(pairs).alias("x")).select(f"x.{fold}", "term", "x.mi")


def selected_by_fold(values: DataFrame, rows: DataFrame, indexed: DataFrame, k: int, key: str, label: str, fold: str, whole: bool = False) -> DataFrame:
    """(fold, term, feature_index): what ``selected_terms`` gives for the rows outside each fold (with ``whole``, of all rows as the fold null)."""
    scored = information_by_fold(values, rows, key, label, fold, whole).join(indexed.select("term", F.col("feature_index").alias("__i")), "term").withColumn("__s", F.round("mi", 12))
    scored = checkpointed(scored.select(fold, "term", "__i", "__s"))

    def placed(data: DataFrame, *orders: Column) -> DataFrame:
        """Places from 1 within each fold."""
        if k <= ONE_TASK:
            return data.withColumn("__place", F.row_number().over(W.partitionBy(fold).orderBy(*orders)))
        first = F.asc_nulls_first(fold)
        sizes = data.groupBy(fold).agg(F.count("*").alias("__n")).withColumn("__before", F.sum("__n").over(W.orderBy(first)) - F.col("__n")).select(F.col(fold).alias("__f"), "__before")  # a row a fold
        ranked = with_rank(data, [first, *orders], "__place")
        return ranked.join(F.broadcast(sizes), F.col(fold).eqNullSafe(F.col("__f"))).withColumn("__place", F.col("__place") - F.col("__before")).drop("__f", "__before")

    best = placed(scored, F.desc("__s"), F.desc("__i")).filter(F.col("__place") <= k).drop("__place")
    return placed(best, F.desc("__s"), F.asc("__i")).select(fold, "term", (F.col("__place") - 1).cast("long").alias("feature_index"))


def to_vectors(values: DataFrame, vocabulary: DataFrame, size: int, key: str, rows: DataFrame | None = None) -> DataFrame:
    """(key, features) as sparse vectors, for the learners; ``rows`` adds keys without any term as zero vectors."""
    from pyspark.ml.linalg import Vectors, VectorUDT

    made = F.udf(lambda cells: Vectors.sparse(size, [(int(c["i"]), float(c["v"])) for c in cells or []]), VectorUDT())
    met = values.join(vocabulary.select("term", "feature_index"), "term")
    cells = met.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("feature_index").alias("i"), F.col("value").alias("v")))).alias("cells"))
    return (cells if rows is None else rows.select(key).join(cells, key, "left")).select(key, made("cells").alias("features"))
