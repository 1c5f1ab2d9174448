import hashlib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from statuta.functions import text as X
from statuta.operators import alignment as A, duplicates as D, eligibility as E, metrics as M, normalize as N, page_quality as Q, registry as R, splitting as S, tfidf as V, validation as C
from statuta.sources import readers, writers


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression.alias("y")).first().y


def test_text_functions(spark):
    assert one(spark, " a  b\t c ", X.normalize_whitespace("x")) == "a b c"
    assert one(spark, None, X.normalize_whitespace("x")) == ""
    assert one(spark, " :- CONTROL  X", X.clean_title_separator("x")) == "CONTROL X"
    assert one(spark, "el 24-11-2017 x", X.parse_dd_mm_yyyy("x")) == "2017-11-24"
    assert one(spark, "documento generado el 2-May-2018", X.parse_generated_date("x")) == "2018-05-02"
    assert one(spark, "documento generado el 2-Jan-2018", X.parse_generated_date("x", english=False)) is None
    assert one(spark, "a\nb\n", X.line_count("x")) == 2
    assert one(spark, "Árbol único 1", X.word_count("x")) == 3
    assert one(spark, "a�b�", X.replacement_char_count("x", doubled=True)) == 4
    assert one(spark, "agua de l'agua año-nuevo", X.title_case("x")) == "Agua De L'Agua Año-Nuevo"
    assert one(spark, " CAPÍTULO / V ", X.safe_id_part("x")) == "CAPÍTULO_V"
    assert one(spark, "“a” – ﬁn… x", X.replace_characters("x")) == "\"a\" - fin... x"
    title, body = X.split_title("x")
    assert one(spark, "Disposiciones generales El plan rige", title) == "Disposiciones generales"
    assert one(spark, "Disposiciones generales El plan rige", body) == "El plan rige"
    title, body = X.split_visual_title("x")
    assert one(spark, "Valores límite Nota: x", body) == "Nota: x"
    said, rest = X.split_source_note("x")
    assert one(spark, "Fuente: Ministerio del Medio Ambiente El dato", said) == "Fuente: Ministerio del Medio Ambiente"
    assert one(spark, "abc", X.duplicate_group_id(F.col("x"))) == "DUP_" + hashlib.sha256(b"abc").hexdigest()[:16].upper()


def test_page_quality(spark):
    rows = [(1, None), (2, "  \n"), (3, "short"), (4, "x" * 60 + "�"), (5, "y" * 60)]
    out = Q.assess_pages(spark.createDataFrame(rows, "page_number int, raw_text string")).orderBy("page_number").collect()
    assert [r.review_reason_code for r in out] == ["blank_extraction", "blank_extraction", "near_blank_extraction", "replacement_character", "none"]
    assert "(5 < 50 non-space" in out[2].notes and not out[4].requires_manual_review


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("La norma rige en\nla Región.\nOtro párrafo.", "La norma rige en la Región.\nOtro párrafo."),
        ("regula-\nción final", "regulación final"),
        ("CAPÍTULO I DE LAS\nFUENTES FIJAS\nArtículo 1.- Uno", "CAPÍTULO I DE LAS FUENTES FIJAS\nArtículo 1.- Uno"),
        ("Artículo 57\n: Se entenderá", "Artículo 57: Se entenderá"),
        ("a\n\n\n\nb ; c", "a\n\nb; c"),
        ("Página 3\n<b>texto</b> &amp; más", "texto & más"),
        ("Título : Plan\nde gestión", "Título: Plan de gestión"),
        ("", ""),
        (None, ""),
    ],
)
def test_normalization(spark, raw, expected):
    got = N.normalize_pages(spark.createDataFrame([(raw,)], "raw_text string")).first()
    assert got.normalized_text == expected


def test_duplicate_groups_and_conflicts(spark):
    rows = [(1, "  Árbol\tVERDE  ", "a"), (2, "árbol verde", "a"), (3, "otro", "b"), (4, "Café Verde", "a"), (5, "CAFÉ VERDE\t", "b")]
    grouped = D.with_groups(spark.createDataFrame(rows, "id int, text string, label string"))
    ids = {r.id: r.duplicate_group_id for r in grouped.collect()}
    assert ids[1] == ids[2] != ids[3] and ids[4] == ids[5]
    assert [r.duplicate_group_id for r in D.label_conflicts(grouped).collect()] == [ids[4]]
    with pytest.raises(D.LabelConflict):
        D.require_consistent(grouped, "label")


def test_near_duplicates_match_all_pairs(spark):
    from difflib import SequenceMatcher

    texts = ["the agency shall submit report within ten days.", "the agency shall submit the report within ten days.", "x", "nothing like it at all", "the agency shall submit a report in ten days."]
    grouped = D.with_groups(spark.createDataFrame([(t,) for t in texts], "text string"))
    expected = sum(SequenceMatcher(None, min(a, b, key=X_id), max(a, b, key=X_id), autojunk=False).ratio() >= 0.85 for i, a in enumerate(texts) for b in texts[i + 1 :])
    assert D.near_duplicates(grouped, threshold=0.85).count() == expected


def X_id(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_eligibility(spark):
    rows = [("1", "yes", "regulative", "t"), ("2", " YES ", "Constitutive", "t"), ("3", "no", "regulative", "t"), ("", "hold", "x", " "), ("5", None, "regulative", "t")]
    data = spark.createDataFrame(rows, "candidate_id string, include_in_final_set string, reviewer_gold_label string, candidate_text_original string")
    got = {r.candidate_id: r.exclusion_reasons for r in E.with_reasons(data).collect()}
    assert got == {"1": "", "2": "", "3": "include_in_final_set_no", "": "include_in_final_set_hold; invalid_reviewer_gold_label; blank_candidate_text_original; blank_candidate_id", "5": "include_in_final_set_blank"}
    assert [r.n for r in E.class_counts(E.eligible(data), "reviewer_gold_label").orderBy("class_order").collect()] == [1, 1, 0]


def test_splits(spark):
    rows = [(f"c{k}", "abc"[k % 3], f"text {k}", f"g{k // 2 if k < 6 else k}") for k in range(60)]
    data = spark.createDataFrame(rows, "id string, label string, text string, g string")
    a, b, c = (S.stratified_split(data, "label", "id", seed=s) for s in (42, 42, 43))
    test = lambda d: {r.id for r in d.filter("split = 'test'").collect()}
    assert test(a) == test(b) != test(c) and len(test(a)) == 12
    assert all(r.passed for r in S.split_checks(a, data, "id", "label", "text").collect())
    one_label = data.withColumn("label", F.when(F.substring("g", 2, 9).cast("int") < 3, "a").otherwise(F.col("label")))
    grouped = S.group_aware_split(one_label, "label", "g")
    assert all(r.passed for r in S.split_checks(grouped, one_label, "id", "label", "text", "g").collect())
    assert len(test(grouped)) == 12
    with pytest.raises(ValueError):
        S.stratified_split(data, "label", "id", test_size=1.0)


def every_choice(sizes, share):
    """(distance to the goal, summed distance to the shares, total) of the best choice, by trying all."""
    options = []
    for found in (sizes[k] for k in sorted(sizes)):
        sums = {0}
        for size, n in found.items():
            sums = {x + size * k for x in sums for k in range(n + 1)}
        rows = max(sums)
        options.append((rows, [x for x in sums if 0 < x < rows]))
    goal = math.ceil(sum(rows for rows, _ in options) * share)
    return goal, min((abs(sum(c) - goal), round(sum(abs(x - rows * share) for x, (rows, _) in zip(c, options)), 6), sum(c)) for c in itertools.product(*(o for _, o in options)))


def test_choose_groups_is_best():
    rng = random.Random(3)
    for _ in range(200):
        sizes = {k: {1: 1, 41: 1} | {rng.choice([1, 2, 3, 5, 8, 13, 40]): rng.randint(1, 3) for _ in range(rng.randint(1, 3))} for k in "abc"[: rng.randint(1, 3)]}
        share = rng.choice([0.01, 0.1, 0.2, 0.5, 0.99])
        chosen = S.choose_groups(sizes, share)
        held = {k: sum(s * n for s, n in found.items()) for k, found in chosen.items()}
        assert all(0 < n <= sizes[k][s] for k, found in chosen.items() for s, n in found.items())
        goal, best = every_choice(sizes, share)
        apart = sum(abs(held[k] - share * sum(s * n for s, n in sizes[k].items())) for k in sizes)
        assert (abs(sum(held.values()) - goal), round(apart, 6), sum(held.values())) == best


def test_choose_groups_of_many_rows():
    sizes = {"a": {1: 900_000, 7: 9_000}, "b": {3: 4, 1000: 1}, "c": {5: 2}, "d": {100_000: 1, 1: 1}}
    chosen = S.choose_groups(sizes, 0.2)
    held = {k: sum(s * n for s, n in found.items()) for k, found in chosen.items()}
    assert sum(held.values()) == math.ceil(0.2 * sum(s * n for found in sizes.values() for s, n in found.items()))
    assert held["c"] == 5 and held["d"] in (1, 100_000) and all(chosen["a"].get(s, 0) <= n for s, n in sizes["a"].items())
    with pytest.raises(ValueError):
        S.choose_groups(sizes | {"e": {9: 1}}, 0.2)


def test_sheet_cells_may_hold_line_feeds(spark, tmp_path):
    (tmp_path / "s.csv").write_text('title,,\nid, note ,note,\n1,"two\nlines, ""quoted""",x\n2,,y,z\n', encoding="utf-8")
    rows = readers.sheet(spark, str(tmp_path / "s.csv"), header_row=2, required=["id"]).orderBy("_source_row").collect()
    assert [tuple(r) for r in rows] == [("1", 'two\nlines, "quoted"', "x", "", 3), ("2", "", "y", "z", 4)]


def test_runs_are_registered_with_their_files_or_not_at_all(spark, tmp_path):
    path = lambda name: f"file://{tmp_path}/{name}"
    event = lambda k: spark.createDataFrame([(f"SPLIT_{k:06d}", "D1")], "split_id string, document_id string")
    first, second = (spark.range(n).withColumn("x", F.lit("v")) for n in (5, 7))
    made = writers.publish_run(first, path("t"), event(1), path("events"), "split_id", path("files"))
    assert made.count() == spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path("t")).count() and made.filter("length(sha256) <> 64").isEmpty()
    readers.require_files(spark, made)
    with pytest.raises(ValueError):  # the event stands already: the first table comes back
        writers.publish_run(second, path("t"), event(1), path("events"), "split_id", path("files"))
    assert spark.read.parquet(path("t")).count() == 5 and spark.read.parquet(path("events")).count() == 1
    with pytest.raises(ValueError):
        readers.require_files(spark, made.withColumn("sha256", F.lit("0" * 64)))
    orphans = spark.createDataFrame([("SPLIT_000009", "a"), ("SPLIT_000001", "b")], "split_id string, v string")
    assert [r.v for r in R.committed(orphans, spark.read.parquet(path("events")), "split_id").collect()] == ["b"]
    with pytest.raises(R.RegistryError):
        R.append_with_children(event(2), path("events"), "split_id", {path("rows"): orphans}, {})


def test_reports_are_tables(spark, tmp_path):
    tables = {"curve": spark.range(3), "metrics": spark.range(2).withColumn("x", F.lit('a "b"\nc'))}
    for form in ("parquet", "csv"):
        writers.write_report(tables, f"{tmp_path}/{form}", form)
    assert spark.read.parquet(f"{tmp_path}/parquet/curve").count() == 3
    assert {r.x for r in readers.partition(spark, f"{tmp_path}/csv/metrics", ["id", "x"]).collect()} == {'a "b"\nc'}
    paths = spark.createDataFrame([("/r/a/b",), ("a/b",), ("./x",), ("s3://k/v",), ("/r/" + "p" * 20_000,)], "p string")
    assert [r[0] for r in paths.select(X.relative_path(F.col("p"), "/r")).collect()] == ["a/b", "a/b", "./x", "s3://k/v", "p" * 20_000]
    assert [r[0] for r in paths.select(X.resolve_path(F.col("p"), "/r/")).collect()][:4] == ["/r/a/b", "/r/a/b", "/r/x", "s3://k/v"]


def test_manifest_membership(spark):
    data = spark.createDataFrame([(k, "test" if k % 3 else "train", "ab"[k % 2]) for k in range(20)], "id int, part string, label string")
    made = writers.partition_manifest(data, "id", "part", "label", seed=42)
    writers.require_membership(made, data.repartition(3), "id", "part", "label")
    with pytest.raises(ValueError):
        writers.require_membership(made, data.withColumn("part", F.when(F.col("id") == 1, "train").when(F.col("id") == 0, "test").otherwise(F.col("part"))), "id", "part", "label")


def test_near_duplicates_are_all_pairs(spark):
    from difflib import SequenceMatcher

    rng = random.Random(7)
    texts = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(5, 40))) for _ in range(25)]
    texts += [t[: len(t) // 2] + "x" + t[len(t) // 2 :] for t in texts[:8]] + ["", "zz"]
    grouped = D.with_groups(spark.createDataFrame(list(enumerate(texts)), "id int, text string"))
    held = {r.duplicate_group_id: r.normalized_text for r in grouped.collect()}
    got = {(r[0], r[1]): r[2] for r in D.near_duplicates(grouped, threshold=0.7).collect()}
    ids = sorted(g for g, t in held.items() if t)
    ratios = {(a, b): SequenceMatcher(None, held[a], held[b], autojunk=False).ratio() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    assert set(got) == {p for p, r in ratios.items() if r >= 0.7} and len(got) >= 8


def test_similar_pairs_are_all_pairs(spark):
    rng = random.Random(9)
    words = [[rng.choice("abcdefghij") for _ in range(rng.randrange(8))] for _ in range(60)]
    found = A.similar_pairs(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(words)], "id int, k string"), "id", "k", 0.6)
    sets = [set(w) for w in words]
    expected = {(i, j) for j in range(60) for i in range(j) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.6 * max(len(sets[i]), len(sets[j]))}
    assert {(r.a, r.b) for r in found.collect()} == expected and expected


def test_rated_pairs_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(A, "PAIR_ROWS", 16)
    monkeypatch.setattr(A, "RARE", 20)
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["the", "of", "and", *(f"w{k}" for k in range(40))]) for _ in range(rng.randrange(12))) for _ in range(90)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, k string")
    want = {(i, j): A.similarity(texts[i], texts[j]) for j in range(90) for i in range(j) if texts[i] and texts[j] and len({*texts[i].split()} & {*texts[j].split()}) >= 0.2 * max(len({*texts[i].split()}), len({*texts[j].split()}))}
    got = {(r.a, r.b): r.similarity for r in A.rated_pairs(rows, "id", "k", 0.2).collect()}
    assert got == want and len(got) > 100
    spelled = spark.createDataFrame([(i, j, texts[i], texts[j]) for i, j in want], "a int, b int, ka string, kb string")
    assert all(abs(r.s - want[r.a, r.b]) < 1e-12 for r in spelled.select("a", "b", A.token_similarity(F.col("ka"), F.col("kb")).alias("s")).collect())


def test_copies_are_linked_by_their_first(spark):
    rows = spark.createDataFrame([(k, "a b c d") for k in range(9, 59)] + [(3, "a b x y"), (60, "a b x y"), (61, ""), (62, None)], "id int, k string")
    got = {(r.a, r.b): round(r.similarity, 9) for r in A.linked_classes(rows, "id", "k", 0.2).collect()}
    assert got == {(3, 9): round(A.similarity("a b x y", "a b c d"), 9), (3, 60): 1.0} | {(9, k): 1.0 for k in range(10, 59)}


def test_shuffled_labels_score_at_chance(spark):
    from statuta.operators import forests

    rng = random.Random(1)
    rows = [(k, float(rng.randrange(2)), k % 4) for k in range(80)]
    values = [(k, f"t{rng.randrange(300)}", 1.0) for k in range(80) for _ in range(8)]
    indexed = V.with_index(spark.createDataFrame(values, "doc_id int, term string, value double").select("term").distinct())
    data = spark.createDataFrame(rows, "doc_id int, label_index double, fold int")
    cells = spark.createDataFrame(values, "doc_id int, term string, value double").groupBy("doc_id", "term").agg(F.max("value").alias("value"))
    got = forests.cross_validate(data, cells, indexed, ["0", "1"], {"A1": (False, 40), "B1": (False, None)}, forests.Settings(trees=5, max_depth=4)).groupBy("configuration_id").agg(F.avg("accuracy").alias("a")).collect()
    assert {r.configuration_id for r in got} == {"A1", "B1"} and all(0.3 < r.a < 0.7 for r in got)


def test_nested_elimination_and_importances(spark):
    from pyspark.ml.linalg import Vectors

    from statuta.operators import forests

    rng = random.Random(2)
    rows = [(k, k % 3 == 0 and 1.0 or 0.0, k % 2, Vectors.dense([float(k % 3 == 0) + rng.random() / 4] + [rng.random() for _ in range(11)])) for k in range(45)]
    data = spark.createDataFrame([(a, float(b), c, d) for a, b, c, d in rows], ["doc_id", "label_index", "fold", "features"]).withColumn("fold", F.col("fold").cast("int"))
    small = forests.Settings(trees=5, max_depth=4)
    metrics, curves = forests.nested_elimination(data, ["0", "1"], 12, 2, step=0.25, inner_folds=3, configurations={"C1": False}, settings=small)
    got = curves.collect()
    assert {r.outer_fold for r in got} == {0, 1} and sorted({r.number_of_retained_features for r in got}) == [2, 3, 6, 9, 12]
    assert all(sum(r.selected_as_optimal for r in got if r.outer_fold == k) == 1 for k in (0, 1))
    assert metrics.count() == 2 and metrics.agg(F.min("macro_f1")).first()[0] > 0.8
    model = forests.fit_forest(data, settings=small)
    table = forests.importance_table(model, spark.range(12).select(F.col("id").alias("feature_index"), F.format_string("t%02d", "id").alias("term"))).orderBy("rank").collect()
    assert [r["rank"] for r in table] == list(range(1, 13)) and table[0].feature_index == 0
    assert [(-r.importance, r.feature_index) for r in table] == sorted((-r.importance, r.feature_index) for r in table)


def test_tokenizer_and_features(spark):
    assert one(spark, "a e o u y x ñ 1 casa Árbol", V.tokens("x")) == ["a", "e", "o", "u", "y", "casa", "árbol"]
    data = spark.createDataFrame([(1, "árbol arbol a"), (2, "y término árbol")], "id int, text string")
    counts = V.term_counts(data, "id", "text", 1, 2)
    vocabulary = V.fit_vocabulary(counts, 2)
    unseen = V.weigh(V.term_counts(spark.createDataFrame([(9, "nunca árbol")], "id int, text string"), "id", "text", 1, 2), vocabulary, "id")
    assert [(r.term, r.value) for r in unseen.collect()] == [("árbol", 1.0)]
    assert (V.proportional_count(23464), V.proportional_count(23464, (20, 3770))) == (436, 124)


def test_metrics_tie_rule(spark):
    means = lambda a, b: spark.createDataFrame([("A1", a), ("A2", b)], "configuration_id string, macro_f1 double")
    assert M.choose_configuration(means(0.8000000000001, 0.8000000000002)).first().configuration_id == "A1"
    assert M.choose_configuration(means(0.8, 0.8000001)).first().configuration_id == "A2"


def test_alignment(spark):
    blocks = A.align_texts(["uno dos tres", "cuatro cinco", "seis"], ["uno dos tres", "cuatro cinco seis"])
    assert [(a, b) for a, b, _ in blocks] == [([0], [0]), ([1, 2], [1])]
    assert A.relationship(1, 1, 1.0) == "exact" and A.relationship(2, 1, 0.9) == "merge" and A.relationship(1, 0, 0.0) == "unmatched_candidate"
    got = one(spark, "Artículo 5: La «Norma» (nueva) N° 7", A.match_key(F.col("x")))
    assert got == "la norma n° 7"


def test_registry(spark, tmp_path):
    events = spark.createDataFrame([("SEG_000001", "D1", "2020"), ("SEG_000007", "D1", "2021"), ("odd", "D2", "2022")], "segmentation_id string, document_id string, created_at string")
    assert R.next_id(events, "segmentation_id", "SEG").first().next_id == "SEG_000008"
    with pytest.raises(R.RegistryError):
        R.next_id(events, "segmentation_id", "SEG", strict=True)
    path = str(tmp_path / "events")
    R.append(events, path, "segmentation_id")
    with pytest.raises(R.RegistryError):
        R.append(events.limit(1), path, "segmentation_id")
    assert R.latest(spark.read.parquet(path), "segmentation_id").first().segmentation_id == "odd"
    assert C.differences(events, spark.read.parquet(path)).isEmpty()


def test_sources_and_sinks(spark, tmp_path):
    sheet = tmp_path / "s.csv"
    sheet.write_text('skip,,\n id , name ,"n"\n1,"a, b",\n2,c,3\n', encoding="utf-8")
    rows = readers.sheet(spark, str(sheet), header_row=2, required=["id", "name"]).orderBy("_source_row").collect()
    assert [(r.id, r.name, r.n, r._source_row) for r in rows] == [("1", "a, b", "", 3), ("2", "c", "3", 4)]
    data = spark.createDataFrame([("1", "a"), ("2", "")], "id string, t string")
    writers.write_csv(data, str(tmp_path / "out"), ["id", "t"], single=True)
    assert C.differences(data, readers.partition(spark, str(tmp_path / "out"), ["id"])).isEmpty()
    writers.publish(data, str(tmp_path / "table"))
    writers.publish(data.limit(1), str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 1
    assert writers.archive(data, str(tmp_path / "history"), "RUN_1").endswith("RUN_1")
    with pytest.raises(Exception):
        writers.archive(data, str(tmp_path / "history"), "RUN_1")
    made = writers.manifest(spark, b=1, a="x")
    writers.require_manifest(made, ["a", "b"])
    assert made.first().manifest == '{"a":"x","b":1}'
    pages = readers.pages_from_files(spark, str(sheet), lambda data: [data.decode(), None])
    assert [(r.page_number, r.raw_text is None) for r in pages.orderBy("page_number").collect()] == [(1, False), (2, True)]


@pytest.mark.parametrize("one_task", [0, 10_000])
def test_ranks_of_many_ties(spark, monkeypatch, one_task):
    from statuta.operators import tfidf as V

    monkeypatch.setattr(V, "ONE_TASK", one_task)
    rng = random.Random(1)
    rows = [(k, rng.choice([0.0, 0.0, 0.5, rng.random()])) for k in range(500)]
    made = V.select_k_best(spark.createDataFrame(rows, "feature_index long, mi double").repartition(7), 320).collect()
    best = sorted(rows, key=lambda r: (-round(r[1], 12), -r[0]))[:320]
    want = {i: k for k, (i, _) in enumerate(sorted(best, key=lambda r: (-round(r[1], 12), r[0])), 1)}
    assert {r.feature_index: r.rank for r in made} == want and len(made) == 320
    assert V.select_k_best(spark.createDataFrame([], "feature_index long, mi double"), 3).count() == 0


def test_elimination_of_shuffled_labels_stays_at_chance(spark):
    """Many random terms and random labels: chosen by all rows they would look well, chosen inside the folds they don't."""
    from statuta.operators import forests, tfidf as V

    rng = random.Random(12)
    cells = [(k, f"t{j:03d}", 1.0) for k in range(60) for j in range(150) if rng.random() < 0.3]
    values = spark.createDataFrame(cells, "doc_id long, term string, value double").persist()
    rows = spark.createDataFrame([(k, float(rng.random() < 0.5), k % 3) for k in range(60)], "doc_id long, label_index double, fold int").persist()
    indexed = spark.createDataFrame([(f"t{j:03d}", j) for j in range(150)], "term string, feature_index long").persist()
    chosen = lambda train: V.to_vectors(values, V.selected_terms(values, train, indexed, 6, "doc_id", "label_index"), 6, "doc_id", rows)
    settings = forests.Settings(trees=5, max_depth=4)
    best = lambda data, **more: forests.recursive_elimination(data, ["0", "1"], 6, 3, step=0.5, settings=settings, **more)[1].agg(F.max("mean_inner_cv_macro_f1")).first()[0]
    inside, leaking = best(rows, featured=chosen), best(rows.join(chosen(rows), "doc_id"))
    assert inside < 0.62 and inside + 0.03 < leaking
    for df in (values, rows, indexed):
        df.unpersist()
