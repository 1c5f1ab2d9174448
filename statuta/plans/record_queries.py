"""Records: eligibility, duplicates, splits, folds, registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators import duplicates as D, eligibility as E, registry as R, splitting as S, validation as V
from ..operators.metric_join import join_work
from ..sources import writers
from .base import query, table

_REVIEW = """
select d.doc_id, d.text, case when l.doc_id is null then 'hold' when l.toxic = 1 then 'no' else 'yes' end as chosen,
  case when l.quality = 1 then 'regulative' when l.quality = 0 then 'constitutive' else 'undetermined' end as label
from documents d left join labels l on d.doc_id = l.doc_id"""
_REASONS = f"""
select doc_id, label, array_to_string(list_filter([case when chosen <> 'yes' then 'include_in_final_set_' || chosen end,
  case when label not in ('regulative', 'constitutive', 'non_institutional') then 'invalid_reviewer_gold_label' end,
  case when text is null or trim(text) = '' then 'blank_candidate_text_original' end], lambda x: x is not null), '; ') as reasons
from ({_REVIEW})"""
_GROUPS = "select doc_id, text, lang, source, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as k, 'DUP_' || upper(substr(sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))), 1, 16)) as g from documents"
_MAP = {"include": "chosen", "label": "label", "text": "text", "key": "candidate_id"}


def _review(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l_id")
    met = docs.join(labels, F.col("doc_id") == F.col("l_id"), "left")
    return met.select(
        "doc_id", "text", F.col("doc_id").cast("string").alias("candidate_id"),
        F.when(F.col("l_id").isNull(), "hold").when(F.col("toxic") == 1, "no").otherwise("yes").alias("chosen"),
        F.when(F.col("quality") == 1, "regulative").when(F.col("quality") == 0, "constitutive").otherwise("undetermined").alias("label"),
    )


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.with_groups(table(spark, sf_dir, "documents"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.concat(F.col("quality"), F.lit("/"), F.col("toxic")).alias("label"))


@query(f"select doc_id, reasons as exclusion_reasons from ({_REASONS})")
def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.with_reasons(_review(spark, sf_dir), **_MAP).select("doc_id", "exclusion_reasons")


@query(f"select doc_id, label from ({_REASONS}) where reasons = ''")
def eligible_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.eligible(_review(spark, sf_dir), **_MAP).select("doc_id", "label")


@query(f"select reason, count(*) as n from (select unnest(string_split(reasons, '; ')) as reason from ({_REASONS}) where reasons <> '') group by reason")
def exclusion_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.reason_counts(_review(spark, sf_dir), **_MAP)


@query(f"""
with c as (select * from (values (0, 'regulative'), (1, 'constitutive'), (2, 'non_institutional')) as t(class_order, label)),
e as (select label, count(*) as n from ({_REASONS}) where reasons = '' group by label)
select c.class_order, c.label, coalesce(e.n, 0) as n from c left join e using (label)""")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.class_counts(E.eligible(_review(spark, sf_dir), **_MAP), "label")


@query("select lang, cast(0 as bigint) as expected, count(*) as observed from documents where lang <> 'en' group by lang")
def source_count_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    expected = docs.filter("lang = 'en'").groupBy("lang").agg(F.count("*").alias("expected"))
    return E.count_mismatches(docs, ["lang"], expected)


@query("select count(*) as n_rows, count(*) filter (doc_id is null) as blank_ids, count(doc_id) as nonblank_ids, count(distinct doc_id) as distinct_ids, cast(0 as bigint) as duplicated_ids from documents")
def id_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.id_uniqueness(table(spark, sf_dir, "documents"), "doc_id")


@query("""
select * from (
  select cast(doc_id as varchar) as id, 'lang' as "column", lang as left_value, case when doc_id = 11 then null else upper(lang) end as right_value from documents where doc_id < 30
  union all select cast(doc_id as varchar), 'source', source, null from documents where doc_id = 11) order by id, "column" limit 10""")
def sheet_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    other = docs.filter("doc_id <> 11").withColumn("lang", F.when(F.col("doc_id") < 30, F.upper("lang")).otherwise(F.col("lang")))
    return E.table_differences(docs, other, "doc_id", ["lang", "source"])


@query(f"select doc_id, g as duplicate_group_id, count(*) over (partition by g) as duplicate_group_size from ({_GROUPS})")
def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir).select("doc_id", "duplicate_group_id", "duplicate_group_size")


@query(f"""
with s as (select g, count(*) as n from ({_GROUPS}) group by g)
select count(*) as total_groups, count(*) filter (n > 1) as multi_groups, cast(coalesce(sum(n) filter (n > 1), 0) as bigint) as records_in_multi,
  cast(coalesce(sum(n - 1) filter (n > 1), 0) as bigint) as surplus_records, max(n) as largest_group from s""")
def duplicate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.group_statistics(_grouped(spark, sf_dir))


@query(f"""
select g as duplicate_group_id, count(*) as size, string_agg(cast(doc_id as varchar), ' | ' order by doc_id) as ids,
  array_to_string(list_sort(list_distinct(list(lang))), ' | ') as labels, arg_min(text, doc_id) as first_text
from ({_GROUPS}) group by g having count(*) > 1""")
def duplicate_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.group_listing(_grouped(spark, sf_dir), "doc_id", "lang")


@query(f"select g as duplicate_group_id, count(distinct source) as n_labels from ({_GROUPS}) group by g having count(distinct source) > 1")
def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies that different sources hold."""
    return D.label_conflicts(_grouped(spark, sf_dir), "source")


@query("select lang as duplicate_group_id from documents group by lang having min(text) <> max(text)")
def hash_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by language alone, so that texts differ within them."""
    docs = table(spark, sf_dir, "documents")
    return D.hash_collisions(docs.select(F.col("lang").alias("duplicate_group_id"), F.col("text").alias("normalized_text")))


@query()
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages with a ratio of at least 0.4."""
    return D.near_duplicates(D.with_groups(table(spark, sf_dir, "benchmark")), threshold=0.4)


@query()
def near_duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different document texts with a ratio of at least 0.9."""
    return D.near_duplicates(D.with_groups(table(spark, sf_dir, "documents")), "lang")


@query()
def near_duplicate_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of document texts that the metric join compares, against those of the length bands."""
    grouped = D.with_groups(table(spark, sf_dir, "documents"))
    return join_work(grouped.groupBy(F.col("duplicate_group_id").alias("id")).agg(F.min("normalized_text").alias("text")), 0.9)


@query("""
select doc_id, label, cast((row_number() over (partition by label order by sha256('42' || chr(0) || doc_id), doc_id) - 1) % 5 as int) as fold
from (select doc_id, quality || '/' || toxic as label from labels)""")
def cv_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cv_folds(_labels(spark, sf_dir), "label", "doc_id").select("doc_id", "label", "fold")


@query("""
select fold, label, count(*) as n from (
  select label, cast((row_number() over (partition by label order by sha256('42' || chr(0) || doc_id), doc_id) - 1) % 5 as int) as fold
  from (select doc_id, quality || '/' || toxic as label from labels)) group by fold, label""")
def fold_class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cv_folds(_labels(spark, sf_dir), "label", "doc_id").groupBy("fold", "label").agg(F.count("*").alias("n"))


_SPLIT = """
with l as (select doc_id, quality || '/' || toxic as label from labels),
c as (select label, count(*) as n from l group by label),
t as (select sum(n) as n_all, cast(ceil(sum(n) * 0.2) as bigint) as goal from c),
x as (select label, n, n * goal / n_all as exact, floor(n * goal / n_all) as low, goal from c, t),
y as (select label, low + case when row_number() over (order by exact - low desc, n desc, label) <= goal - sum(low) over () then 1 else 0 end as take from x),
r as (select l.*, row_number() over (partition by label order by sha256('42' || chr(0) || doc_id), doc_id) as place from l),
s as (select r.doc_id, r.label, case when place <= take then 'test' else 'training' end as split from r join y using (label))
"""


@query(_SPLIT + "select doc_id, label, split from s")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stratified_split(_labels(spark, sf_dir), "label", "doc_id").select("doc_id", "label", "split")


@query(_SPLIT + """
select split, coalesce(label, 'all') as label, n, n / max(case when label is null then n end) over (partition by split) as share
from (select split, label, count(*) as n from s group by grouping sets ((split), (split, label)))""")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_summary(S.stratified_split(_labels(spark, sf_dir), "label", "doc_id"), "label")


@query(_SPLIT + """
select label, abs(count(*) filter (split = 'test') / max(t_all) - count(*) / max(n_all)) as difference
from s, (select count(*) as n_all, count(*) filter (split = 'test') as t_all from s) group by label""")
def split_share_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.share_differences(S.stratified_split(_labels(spark, sf_dir), "label", "doc_id"), "label")


@query("""select unnest(['all_ids_assigned_once', 'candidate_ids_do_not_overlap', 'every_class_in_both_sets', 'no_blank_id', 'no_blank_label', 'no_blank_text',
  'only_approved_labels', 'text_unchanged', 'training_plus_test_equals_eligible']) as check_name, true as passed""")
def split_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _labels(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return S.split_checks(S.stratified_split(data, "label", "doc_id"), data, "doc_id", "label", "text")


@query()
def group_aware_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _grouped(spark, sf_dir).select("doc_id", "duplicate_group_id", F.col("lang").alias("label"))
    one = labelled.groupBy("duplicate_group_id").agg(F.min("label").alias("label"))
    return S.group_aware_split(labelled.drop("label").join(one, "duplicate_group_id"), "label", "duplicate_group_id").select("doc_id", "label", "duplicate_group_id", "split")


@query("select event_type, event_id, ts, user_id from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as r from events) where r = 1")
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_per(table(spark, sf_dir, "events"), ["event_type"], "event_id", "ts").select("event_type", "event_id", "ts", "user_id")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.format_string("SEG_%06d", "event_id").alias("segmentation_id"), F.col("user_id").cast("string").alias("document_id"), F.col("ts").alias("created_at"), "event_type", "props")


@query("select printf('SEG_%06d', max(event_id) + 1) as next_id from events")
def next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.next_id(_events(spark, sf_dir), "segmentation_id", "SEG")


@query("select printf('SEG_%06d', event_id) as segmentation_id, cast(user_id as varchar) as document_id from events where event_type = 'purchase' order by ts desc, event_id desc limit 1")
def latest_completed_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).withColumn("status", F.when(F.col("event_type") == "purchase", "Completed").otherwise("Failed"))
    return R.latest(events, "segmentation_id", completed_only=True).select("segmentation_id", "document_id")


@query("select o.o_orderkey, o.o_custkey from orders o left join customer c on o.o_custkey = c.c_custkey where c.c_custkey is null or c.c_nationkey % 5 is distinct from o.o_custkey % 5")
def lineage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").alias("c_custkey"), (F.col("o_custkey") % 5).alias("part"))
    parent = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 5).alias("part"))
    return R.lineage_breaks(child, parent, "c_custkey", ["part"]).select("o_orderkey", "o_custkey")


@query("""
select 'amount_not_negative' as check_name, count(*) filter (l_extendedprice < 0) as violations from lineitem
union all select 'discount_below_one', count(*) filter (not l_discount < 0.1) from lineitem""")
def registry_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.check_violations(table(spark, sf_dir, "lineitem"), {"amount_not_negative": F.col("l_extendedprice") >= 0, "discount_below_one": F.col("l_discount") < 0.1})


@query("select event_id, json_valid(props) as ok from events")
def json_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", R.is_json("props").alias("ok"))


@query("""
select c_custkey as key, 'left' as only_in from customer where c_custkey not in (select p_partkey * 2 from part)
union all select p_partkey * 2, 'right' from part where p_partkey * 2 not in (select c_custkey from customer)""")
def key_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") * 2).alias("key"))
    return V.missing_keys(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), parts, "key")


@query("select doc_id, lang, quality, toxic from documents left join labels using (doc_id)")
def lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.one_to_one(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic")


@query("""
with m as (
  select *, row_number() over (partition by user_id % 20 order by ts desc, printf('MODEL_%06d', event_id) desc) as r
  from events where event_id % 3 = 0 and event_id % 5 <> 0 and event_id % 2 = 1)
select cast(user_id % 20 as int) as vectorization, printf('MODEL_%06d', event_id) as model_id, configuration, round(case configuration when 'A1' then event_id % 100 / 100.0 else event_id % 50 / 50.0 end, 6) as macro_f1
from m, (select unnest(['A1', 'A2']) as configuration) where r = 1""")
def prior_model_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each vectorization the newest completed Model A that reports A1 and A2, read out of its JSON."""
    e = table(spark, sf_dir, "events")
    one = lambda label, value: F.struct(F.lit(label).alias("configuration_label"), F.struct(value.alias("macro_f1")).alias("overall"))
    held = F.struct(
        F.when(F.col("event_id") % 2 == 1, F.array(F.lit("A2"), F.lit("A1"))).otherwise(F.array(F.lit("A1"))).alias("held_out_reported_configurations"),
        F.struct(one("plain", F.col("event_id") % 100 / 100).alias("A1"), one("balanced", F.col("event_id") % 50 / 50).alias("A2")).alias("configurations"),
    )
    events = e.select(
        (F.col("user_id") % 20).cast("int").alias("vectorization"), F.format_string("MODEL_%06d", "event_id").alias("model_id"), F.col("ts").alias("created_at"), F.to_json(held).alias("final_test_metrics_json"),
        F.when(F.col("event_id") % 3 == 0, "Model A").otherwise("Model B").alias("model_designation"), F.when(F.col("event_id") % 5 == 0, "Failed").otherwise("Completed").alias("model_status"),
    )
    chosen = R.prior_model(events, "vectorization", ["A1", "A2"])
    read = R.prior_results(chosen).join(chosen.select("model_id", "vectorization"), "model_id")
    return read.select("vectorization", "model_id", F.col("configuration_id").alias("configuration"), F.round("value", 6).alias("macro_f1"))


@query("""
with c as (select quality, count(*) as n from labels group by quality)
select 'eligible_records' as item, cast(300 as bigint) as expected, (select count(*) from labels) as observed, (select count(*) from labels) = 300 as passed
union all select 'quality.' || k, cast(100 as bigint), coalesce((select n from c where cast(quality as varchar) = k), 0), coalesce((select n from c where cast(quality as varchar) = k), 0) = 100 from (select unnest(['0', '1', '2']) as k)""")
def eligibility_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("quality", F.col("quality").cast("string"))
    return E.policy_check(labels, "quality", 300, {"0": 100, "1": 100, "2": 100}, ["0", "1", "2"])


@query("""
select lang as run, source as partition, cast(case when source = 'src1' then 0 else 10 end as bigint) as expected, count(*) as observed
from documents group by lang, source having count(*) <> case when source = 'src1' then 0 else 10 end
union all select lang, 'test', 5, 0 from documents group by lang""")
def registered_partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("run"), F.col("source").alias("partition"))
    runs = docs.select("run").distinct()
    expected = docs.distinct().filter("partition <> 'src1'").withColumn("expected", F.lit(10)).unionByName(runs.select("run", F.lit("test").alias("partition"), F.lit(5).alias("expected")))
    return V.partition_counts(docs, "run", "partition", expected)


@query("select count(*) as records, count(*) filter (lang = 'en') as english, count(*) filter (lang = 'en' and source = 'src1') as english_src1 from documents")
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts read back out of the manifest of the documents by language and source."""
    made = writers.partition_manifest(table(spark, sf_dir, "documents"), "doc_id", "lang", "source", name="documents")
    path = lambda p: F.coalesce(F.get_json_object("manifest", p).cast("long"), F.lit(0))
    return made.select(path("$.records").alias("records"), path("$.partitions.en").alias("english"), path("$.classes.en.src1").alias("english_src1"))


@query("select doc_id, row_number() over (order by sha256('42' || chr(0) || doc_id), doc_id) as place from labels")
def seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "labels").select("doc_id", F.lit("all").alias("label"))
    return S._numbered(one, "label", "doc_id", 42).select("doc_id", F.col("__place").alias("place"))


@query("select doc_id, case when quality = floor(quality) then cast(cast(quality as bigint) as varchar) else '' end as quality, trim(cast(toxic as varchar)) as toxic from labels")
def comparison_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return labels.select("doc_id", X.comparison_value(F.col("quality").cast("double"), "double").alias("quality"), X.comparison_value(F.col("toxic"), "int").alias("toxic"))


