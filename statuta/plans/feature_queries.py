"""Features: tokens, n-grams, TF-IDF, mutual information, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import tfidf as V
from ..session import checkpointed
from .base import query, table

#: Words as the tokenizer sees them: word runs, kept from two characters on or as one of five letters.
_TOKENS = "select doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'), lambda x: length(x) >= 2 or x in ('a', 'e', 'o', 'u', 'y')) as t from documents"
_LABELLED = f"select k.* from ({_TOKENS}) k join labels using (doc_id)"


def _unigrams(source: str) -> str:
    return f"select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from ({source})) group by doc_id, term"


def _ngrams(source: str) -> str:
    two = "list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])"
    three = "list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])"
    return f"select doc_id, term, count(*) as tf from (select doc_id, unnest(list_concat(list_concat(t, {two}), {three})) as term from ({source})) group by doc_id, term"


def _values(source: str) -> str:
    return f"""
c as ({_unigrams(source)}),
v as (select term, count(*) as df, ln((1 + (select count(*) from labels)) / (1 + count(*))) + 1 as idf from c group by term),
w as (select doc_id, term, tf * idf as raw from c join v using (term)),
x as (select doc_id, term, raw / sqrt(sum(raw * raw) over (partition by doc_id)) as value from w)"""


_MI = f"""
with {_values(_LABELLED)},
l as (select quality as l, count(*) as n_l from labels group by quality),
n as (select count(*) as n from labels),
cells as (select term, round(value, 12) as v, quality as l, count(*) as c from x join labels using (doc_id) group by all),
bv as (select term, v, sum(c) as n_v from cells group by term, v),
bl as (select term, l, sum(c) as c_l from cells group by term, l),
ht as (select term, sum(c) as n_t from cells group by term),
present as (select term, sum(c / n * ln(n * c / (n_v * n_l))) as s from cells join bv using (term, v) join l using (l), n group by term),
zero as (select ht.term, sum(case when n_l - coalesce(c_l, 0) > 0 then (n_l - coalesce(c_l, 0)) / n * ln(n * (n_l - coalesce(c_l, 0)) / ((n - n_t) * n_l)) else 0 end) as z
  from ht cross join l cross join n left join bl on bl.term = ht.term and bl.l = l.l group by ht.term),
mi as (select term, s + z as mi from present join zero using (term))"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")


def _weighed(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _labelled(spark, sf_dir)
    n = table(spark, sf_dir, "labels").count()
    tasks = V.task_number(n, spark)
    counts = V.term_counts(data, "doc_id", "text", 1, 1, tasks)
    return V.weigh(counts, V.fit_vocabulary(counts, n), "doc_id", tasks)


def _information(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return V.mutual_information(_weighed(spark, sf_dir), labels, "doc_id", "quality", tasks=V.task_number(labels.count(), spark))


@query(f"select doc_id, cast(len(t) as bigint) as n_tokens, array_to_string(t, ' ') as tokens from ({_TOKENS})")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.tokens("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@query(f"select term, count(*) as df, sum(tf)::bigint as tf from ({_ngrams(_TOKENS)}) group by term")
def ngram_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.term_frequencies(_docs(spark, sf_dir), "doc_id", "text")


@query(f"select term, row_number() over (order by encode(term)) - 1 as feature_index, count(*) as df from ({_unigrams(_TOKENS)}) group by term")
def vocab_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    counts = V.term_counts(docs, "doc_id", "text", 1, 1, V.task_number(docs.count(), spark))
    return V.with_index(counts.groupBy("term").agg(F.count("*").alias("df")))


@query(f"with {_values(_LABELLED)} select term, df, round(idf, 9) as idf from v")
def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "labels").count()
    counts = V.term_counts(_labelled(spark, sf_dir), "doc_id", "text", 1, 1, V.task_number(n, spark))
    return V.fit_vocabulary(counts, n).select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"with {_values(_LABELLED)} select doc_id, term, round(value, 9) as value from x")
def tfidf_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighed(spark, sf_dir).select("doc_id", "term", F.round("value", 9).alias("value"))


@query(f"""
with {_values(_LABELLED)}, s as (select term, round(sum(value), 9) as weight from x group by term)
select term, weight from s order by weight desc, term limit 50""")
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighed(spark, sf_dir).groupBy("term").agg(F.round(F.sum("value"), 9).alias("weight")).orderBy(F.desc("weight"), "term").limit(50)


@query(f"""
with {_values(_LABELLED)},
unseen as (select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from ({_TOKENS}) where doc_id not in (select doc_id from labels)) group by doc_id, term),
w2 as (select doc_id, term, tf * idf as raw from unseen join v using (term))
select doc_id, count(*) as n_terms, round(max(raw / norm), 9) as largest from (select *, sqrt(sum(raw * raw) over (partition by doc_id)) as norm from w2) group by doc_id""")
def transform_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows outside the fitted set: terms that training did not see drop out."""
    docs, n = _docs(spark, sf_dir), table(spark, sf_dir, "labels").count()
    fitted = V.term_counts(_labelled(spark, sf_dir), "doc_id", "text", 1, 1, V.task_number(n, spark))
    rest, tasks = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_anti"), V.task_number(docs.count(), spark)
    out = V.weigh(V.term_counts(rest, "doc_id", "text", 1, 1, tasks), V.fit_vocabulary(fitted, n), "doc_id", tasks)
    return out.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.round(F.max("value"), 9).alias("largest"))


@query(_MI + " select term, round(mi, 9) + 0.0 as mi from mi")
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _information(spark, sf_dir).select("term", (F.round("mi", 9) + 0.0).alias("mi"))


@query(_MI + """, i as (select term, row_number() over (order by encode(term)) - 1 as feature_index, round(mi, 9) as mi from mi),
k as (select *, row_number() over (order by mi desc, feature_index desc) as r from i)
select row_number() over (order by mi desc, feature_index) as rank, feature_index, term, mi from k where r <= 100""")
def select_k_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = V.with_index(checkpointed(_information(spark, sf_dir))).withColumn("mi", F.round("mi", 9))
    return V.select_k_best(scored, 100).select(F.col("rank").cast("long").alias("rank"), "feature_index", "term", "mi")


@query(r"""
with w as (select distinct lang, unnest(string_split_regex(lower(coalesce(text, '')), '[ \t\n\r\f\v]+')) as word from documents),
n as (select lang, count(*) as vocabulary from w where word <> '' group by lang)
select lang, vocabulary, cast(round_even(vocabulary * 70 / 3770, 0) as bigint) as model_a, cast(round_even(vocabulary * 20 / 3770, 0) as bigint) as model_c from n""")
def proportional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms to keep of each language's words, in proportion to its vocabulary."""
    words = table(spark, sf_dir, "documents").select("lang", F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[ \t\n\r\f\x0B]+")).alias("word")).filter("word <> ''")
    sizes = words.distinct().groupBy("lang").agg(F.count("*").alias("vocabulary"))
    return sizes.select("lang", "vocabulary", V.proportional(F.col("vocabulary")).alias("model_a"), V.proportional(F.col("vocabulary"), (20, 3770)).alias("model_c"))


@query(f"with {_values(_LABELLED)} select round(max(abs(case when term > 'm' then value else 0 end - round(value, 2))), 9) as max_difference from x")
def matrix_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of the later terms against the whole one at two digits."""
    values = _weighed(spark, sf_dir)
    return V.matrix_difference(values.filter("term > 'm'"), values.withColumn("value", F.round("value", 2)), ["doc_id", "term"]).select(F.round("max_difference", 9).alias("max_difference"))
