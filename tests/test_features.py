"""Weights and information that must not hang on the order in which rows come."""

import math
import random
import re

from pyspark.sql import functions as F

from statuta.operators import tfidf as V
from statuta.plans import feature_queries


def test_equal_documents_have_equal_weights_to_the_last_bit(spark):
    rng = random.Random(7)
    terms = [(f"t{k}", rng.randint(1, 40), rng.uniform(1, 9)) for k in range(300)]
    orders = [terms, terms[::-1], sorted(terms, key=lambda t: t[2]), rng.sample(terms, len(terms))]
    counts = spark.createDataFrame([(d, t, tf) for d, order in enumerate(orders) for t, tf, _ in order], "doc_id int, term string, tf int").coalesce(1)
    vocabulary = spark.createDataFrame([(t, idf) for t, _, idf in terms], "term string, idf double")
    found = V.weigh(counts, vocabulary, "doc_id").groupBy("term").agg({"value": "min"}).join(V.weigh(counts, vocabulary, "doc_id").groupBy("term").agg({"value": "max"}), "term")
    assert found.filter("`min(value)` <> `max(value)`").count() == 0


def test_mutual_information_of_shared_values_and_missing_labels(spark):
    values = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.5), (3, "a", 0.25), (4, "b", 1.0)], "doc_id int, term string, value double")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 0), (5, 1)], "doc_id int, l int")
    found = {r["term"]: round(r["mi"], 12) for r in V.mutual_information(values, labels, "doc_id", "l").collect()}
    ln = math.log
    a = 1 / 5 * ln(5 / (2 * 2)) + 1 / 5 * ln(5 / (2 * 3)) + 1 / 5 * ln(5 / 3) + 1 / 5 * ln(5 / (2 * 2)) + 1 / 5 * ln(5 / (2 * 3))
    b = 1 / 5 * ln(5 / 2) + 1 / 5 * ln(5 / (4 * 2)) + 3 / 5 * ln(5 * 3 / (4 * 3))
    assert found == {"a": round(a, 12), "b": round(b, 12)}


def test_queries_hand_few_texts_at_once_to_python(spark, tmp_path):
    from statuta.plans.base import table

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "10000")
    spark.range(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert table(spark, str(tmp_path), "documents").count() == 3 and 0 < int(spark.conf.get(name)) <= 512


def test_term_frequencies_of_repeated_and_single_keys(spark):
    rows = [(1, "casa roja casa roja casa"), (2, "roja casa"), (3, None), (4, ""), (5, "una casa")]
    of = lambda data: {r.term: (r.df, r.tf) for r in V.term_frequencies(spark.createDataFrame(data, "id int, text string"), "id", "text", 1, 2).collect()}
    assert of(rows) == {"casa": (3, 5), "roja": (2, 3), "una": (1, 1), "casa roja": (1, 2), "roja casa": (2, 3), "una casa": (1, 1)}
    assert of(rows + [(1, "casa")])["casa"] == (3, 6)
    plan = V.term_frequencies(spark.createDataFrame(rows, "id int, text string"), "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def _tables(spark, folder) -> str:
    texts = ["casa roja casa", "roja casa azul", "una casa", None, "", "casa azul azul mar", "mar roja"]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(5)], "doc_id long, quality int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def _tasks_grow_with_texts(spark, folder, monkeypatch, name, least):
    """The query deals texts to ``least`` tasks and more where a task may have one, and its rows stay the same."""
    query = getattr(feature_queries, name)
    whole = sorted(query(spark, folder).collect())
    monkeypatch.setattr(V, "TASK_TEXTS", 1)
    plan = query(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    dealt = [int(n) for n in re.findall(r"RepartitionByExpression \[doc_id#\d+L?\], (\d+)", plan)]
    assert dealt and min(dealt) >= least > spark.sparkContext.defaultParallelism
    assert sorted(query(spark, folder).collect()) == whole and whole


def test_mutual_information_deals_texts_before_it_counts_their_terms(spark, tmp_path, monkeypatch):
    _tasks_grow_with_texts(spark, _tables(spark, tmp_path), monkeypatch, "mutual_information", 5)


def test_unseen_texts_are_dealt_as_the_fitted_ones_are(spark, tmp_path, monkeypatch):
    _tasks_grow_with_texts(spark, _tables(spark, tmp_path), monkeypatch, "transform_unseen", 5)


def test_matrices_are_compared_by_grouped_cells_without_a_join(spark):
    of = lambda *cells: spark.createDataFrame(list(cells), "d int, t string, value double")
    found = lambda a, b: V.matrix_difference(a, b, ["d", "t"]).first().max_difference
    a = of((1, "a", 0.5), (1, "b", -2.0), (2, "a", None), (3, "c", 1.0))
    assert found(a, a) == 0.0 and found(a, of()) == 2.0 and found(of(), a) == 2.0 and found(of(), of()) == 0.0
    assert found(a, of((1, "a", 0.75), (1, "b", -2.0), (3, "c", 1.0), (4, "a", 0.0))) == 0.25
    assert found(a, of((2, "a", -3.0), (1, "b", -2.0), (3, "c", 1.0))) == 3.0
    assert found(of((1, "a", 1.0), (1, "a", 5.0)), of((1, "a", 2.0))) == 3.0
    dealt = a.repartition(5, "d")
    plan = V.matrix_difference(dealt, dealt.withColumn("value", F.round("value", 1)), ["d", "t"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(d" in plan and ", t#" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
