import json
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from statuta.operators import segments as G, structure as T, tree
from statuta.plans.structure_queries import DECREE, structure_page_ranges

EXPECTED = [
    "metadata_block", "metadata_field", "metadata_field", "decree_header", "preamble", "paragraph", "chapter", "article", "paragraph", "lettered_item",
    "roman_item", "numbered_item", "paragraph", "table", "object_note", "numbered_heading", "paragraph", "signature_block",
]


def _pages(spark):
    rows = [("D", page, "\n".join(t for t, p in DECREE if p == page)) for page in (1, 2)]
    return spark.createDataFrame(rows, "document_id string, page_number int, normalized_text string")


def test_decree_types_and_parents(spark):
    rows = T.parse_structure(_pages(spark)).orderBy("element_order").collect()
    assert [r.element_type for r in rows] == EXPECTED
    by_id = {r.element_id: r for r in rows}
    assert len(by_id) == len(rows)
    at = {r.element_type: r for r in rows}
    assert by_id[at["article"].parent_id].element_type == "chapter"
    assert by_id[at["lettered_item"].parent_id].element_type == "article"
    assert by_id[at["object_note"].parent_id].element_type == "table"
    assert at["chapter"].label == "CAPÍTULO I" and at["chapter"].title == "DISPOSICIONES GENERALES"
    assert at["numbered_heading"].label == "I.5" and at["chapter"].page_end == 2
    assert at["metadata_field"].element_text.startswith("Título")


def test_year_is_no_item_and_signature_takes_the_rest(spark):
    lines = "CAPÍTULO I\nArtículo 1: Uno.\n2016. Año.\nAnótese y publíquese.\nRúbrica final"
    rows = T.parse_structure(spark.createDataFrame([("D", 1, lines)], "document_id string, page_number int, normalized_text string")).orderBy("element_order").collect()
    assert [r.element_type for r in rows] == ["chapter", "article", "paragraph", "paragraph", "signature_block"]
    assert rows[-1].element_text == "Anótese y publíquese. Rúbrica final"


def test_embedded_preamble_mark_gets_its_own_line(spark):
    page = spark.createDataFrame([("D", 1, "lo dispuesto; y Considerando: que sí\nen el decreto: nada")], "document_id string, page_number int, normalized_text string")
    assert [r.text for r in T.logical_lines(page).orderBy("line_no", "piece_no").collect()] == ["lo dispuesto; y", "Considerando:", "que sí", "en el decreto: nada"]


def test_page_continuation_and_ranges(spark):
    pages = spark.createDataFrame([("D", 1, "CAPÍTULO I\nArtículo 1: El texto que"), ("D", 2, "continúa aquí.")], "document_id string, page_number int, normalized_text string")
    made = T.parse_structure(pages)
    last = made.orderBy("element_order").collect()[-1]
    assert last.element_text == "El texto que continúa aquí." and (last.page_start, last.page_end) == (1, 2)
    assert {r.last_page for r in tree.page_ranges(made).collect()} == {2}


def test_page_ranges_of_every_order(spark, tmp_path):
    spark.range(150).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    found = structure_page_ranges(spark, str(tmp_path)).groupBy("document_id").count().collect()
    assert len(found) == 150 and {r["count"] for r in found} == {len(EXPECTED) + 2 * (k % 4) + k % 3 for k in range(12)}


def test_page_ranges_rise_through_all_levels(spark):
    rows = [("D", f"E{k}", f"E{k - 1}" if k else None, 50 - k, 50 + k) for k in range(12)] + [("D", "F", "E3", 1, 2), ("X", "E0", None, 7, 7), ("X", "E1", "gone", 3, 3)]
    made = tree.page_ranges(spark.createDataFrame(rows, "document_id string, element_id string, parent_id string, page_start int, page_end int"))
    got = {(r.document_id, r.element_id): (r.first_page, r.last_page) for r in made.collect()}
    assert got == {("D", f"E{k}"): (1 if k <= 3 else 39, 61) for k in range(12)} | {("D", "F"): (1, 2), ("X", "E0"): (7, 7), ("X", "E1"): (3, 3)}


def _random_elements(seed, n, docs=6):
    """Flat rows of random trees; children may stand before their parents."""
    rng = random.Random(seed)
    rows = []
    for d in range(docs):
        size = rng.randrange(0, n)
        place = rng.sample(range(size), size)
        for k in range(size):
            parent = None if k == 0 or rng.random() < 0.1 else f"E{rng.randrange(max(0, k - 5), k)}" if rng.random() < 0.95 else "gone"
            rows.append((f"D{d}", f"E{k}", parent, place[k], rng.choice([None, rng.randrange(50)]), rng.randrange(50), rng.choice(["x", 'q"\\ \n{[]}', None]), rng.randrange(2)))
    return rows


ELEMENT_SCHEMA = "document_id string, element_id string, parent_id string, element_order int, page_start int, page_end int, element_text string, requires_manual_review int"


def _plain_trees(rows):
    """doc -> (rows in pre-order with their subtree, nested roots)."""
    out = {}
    for doc in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == doc), key=lambda r: r[3])
        ids, below = {r[1] for r in own}, defaultdict(list)
        for r in own:
            below[r[2] if r[2] in ids else None].append(r)
        order = []

        def walk(r, depth):
            at = len(order)
            order.append(None)
            children = [walk(c, depth + 1) for c in below[r[1]]]
            inside = [r, *(x[0] for x in order[at + 1 :])]
            starts = [x[4] for x in inside if x[4] is not None]
            order[at] = (r, at, len(inside), depth, min(starts, default=None), max(x[5] for x in inside), sum(x[7] for x in inside))
            node = {"element_id": r[1], "parent_id": r[2], "requires_manual_review": r[7] == 1} | ({"element_text": r[6]} if r[6] is not None else {}) | {"children": children}
            return node

        out[doc] = ([walk(r, 0) for r in below[None]], order)
    return out


@pytest.mark.parametrize("seed,n", [(1, 40), (2, 200)])
def test_trees_equal_a_plain_builder(spark, seed, n):
    rows = _random_elements(seed, n)
    frame = spark.createDataFrame([(*r, "a clash") for r in rows], ELEMENT_SCHEMA + ", depth string")
    measures = {"first": ("min", "page_start"), "last": ("max", "page_end"), "reviews": ("sum", "requires_manual_review")}
    got = {(r.document_id, r.element_id): (r.preorder, r.subtree, r.depth, r.first, r.last, r.reviews) for r in tree.with_labels(frame, measures).collect()}
    want = _plain_trees(rows)
    assert got == {(doc, o[0][1]): o[1:] for doc, (_, order) in want.items() for o in order}
    made = tree.nested_documents(frame, ["element_id", "parent_id", "requires_manual_review"], ["element_text"]).collect()
    assert {r.document_id: json.loads(r.structure) for r in made} == {doc: roots for doc, (roots, _) in want.items()}
    assert {r.document_id: r.elements_count for r in made} == {doc: len(order) for doc, (_, order) in want.items()}


def test_very_deep_and_very_wide_trees():
    n = 200_000
    long = 50_000
    chain = np.arange(-1, long - 1)
    pre, size, depth = tree.interval_labels(chain)
    assert pre.tolist() == depth.tolist() == list(range(long)) and size.tolist() == list(range(long, 0, -1))
    assert tree.rolled_up(np.ones(long, dtype=np.int64), chain, depth, "sum").tolist() == size.tolist()
    pre, size, depth = tree.interval_labels(np.r_[-1, np.zeros(n, dtype=np.int64)])
    assert pre.tolist() == list(range(n + 1)) and size[0] == n + 1 and depth.max() == 1
    assert [x.tolist() for x in tree.interval_labels(np.empty(0, dtype=np.int64))] == [[], [], []]
    with pytest.raises(tree.BrokenTree):
        tree.interval_labels(np.array([1, 2, 0, -1]))
    with pytest.raises(tree.BrokenTree):
        tree.parent_places(["a", "a"], [None, None])


def test_nested_decree(spark):
    made = T.parse_structure(_pages(spark))
    (row,) = tree.nested_documents(made).collect()
    flat = made.orderBy("element_order").collect()
    found = []

    def walk(nodes, parent):
        for node in nodes:
            assert node["parent_id"] == parent
            found.append(node["element_id"])
            walk(node["children"], node["element_id"])

    walk(json.loads(row.structure), None)
    assert sorted(found) == sorted(r.element_id for r in flat) and row.elements_count == len(flat)
    first = json.loads(row.structure)[0]
    assert first["element_type"] == "metadata_block" and first["requires_manual_review"] is False and "element_text" not in first and first["children"][0]["content_status"] == "text_extracted"


def _sentences(spark, text):
    row = ("D", "D_P001", None, 1, "paragraph", text, 1, 1, 0, None, None)
    schema = "document_id string, element_id string, parent_id string, element_order int, element_type string, element_text string, page_start int, page_end int, requires_manual_review int, review_reason_code string, review_reason_note string"
    elements = spark.createDataFrame([row], schema)
    made = G.candidate_statements(elements)
    assert all(r.violations == 0 for r in G.statement_checks(made, elements).collect())
    return [(r.statement_text, r.review_reason_code) for r in made.orderBy("statement_order").collect()]


def test_protected_boundaries(spark):
    texts = lambda t: [x for x, _ in _sentences(spark, t)]
    assert texts("Art. 5 del D.S. N° 10. Otra cosa va.") == ["Art. 5 del D.S. N° 10.", "Otra cosa va."]
    assert texts("El Sr. Pérez firmó. Luego salió.") == ["El Sr. Pérez firmó.", "Luego salió."]
    assert texts("Hay etc. y otros. Fin.") == ["Hay etc. y otros.", "Fin."]
    assert texts("Norma de PM2.5. El valor es.") == ["Norma de PM2.5. El valor es."]
    assert texts("Ver Gráfico I 3. Se indica.") == ["Ver Gráfico I 3.", "Se indica."]
    assert texts("Lo siguiente:\nuno;\ndos. Tres.") == ["Lo siguiente:\nuno;\ndos.", "Tres."]
    assert texts("Sin final") == ["Sin final"]


def test_statement_warnings(spark):
    found = dict(_sentences(spark, "el texto empieza en minúscula y sigue. Corta."))
    assert found["el texto empieza en minúscula y sigue."] == "sentence_starts_lowercase"
    assert found["Corta."] == "very_short_sentence"
    assert dict(_sentences(spark, "Este texto no tiene punto final"))["Este texto no tiene punto final"] == "missing_terminal_punctuation"


def test_small_trees_are_labelled_many_at_once_and_documents_cross_batches(spark):
    """Half of the rows are one document, the rest documents of 50 rows; equal ids stand in all; null is a document too."""
    k = F.col("id")
    document = F.when(k < 45_000, "big").when(k < 45_050, None).otherwise(F.concat(F.lit("d"), F.floor(k / 50).cast("string")))
    place = F.when(k < 45_000, k).otherwise(k % 50)
    rows = spark.range(90_000).select(document.alias("document_id"), F.concat(F.lit("e"), place.cast("string")).alias("element_id"), F.when(place > 0, "e0").alias("parent_id"), (-place).alias("element_order"), place.alias("v"))
    made = tree.with_labels(rows, {"least": ("min", "v"), "all": ("sum", "v")})
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    n = F.when(F.col("document_id") == "big", 45_000).otherwise(50)
    root = F.col("v") == 0
    right = (F.col("preorder") == F.when(root, 0).otherwise(n - F.col("v"))) & (F.col("subtree") == F.when(root, n).otherwise(1)) & (F.col("depth") == F.when(root, 0).otherwise(1)) & (F.col("least") == F.col("v")) & (F.col("all") == F.when(root, n * (n - 1) / 2).otherwise(F.col("v")))
    assert made.count() == 90_000 and made.filter(~F.coalesce(right, F.lit(False))).count() == 0


def test_parents_are_sought_in_the_own_document_only():
    places = tree.forest_places(np.array([0, 0, 1, 1]), np.array([0, 1, 0, 2]), np.array([9, 0, 1, 0]), np.array([True, False, False, False]))
    assert places.tolist() == [-1, 0, -1, 2]
    with pytest.raises(tree.BrokenTree):
        tree.forest_places(np.array([0, 1, 1]), np.array([0, 0, 0]), np.array([1, 1, 1]), np.array([True] * 3))


def test_structure_takes_one_shuffle_and_one_sort(spark):
    plan = T.parse_structure(_pages(spark))._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning(document_id") == plan.count("Exchange") == 1 and "Window" not in plan and "Aggregate" not in plan
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_marks_are_found_whatever_letter_they_begin_with(spark):
    lines = [t for t, _ in DECREE] + ["tItulo IV x", "ſección I rara", "ıv. raro", "Ítem", "Párrafo 2", "Subsección V", "artículo único transitorio: x", "Cuadro 3. Uno", "Gráfico 1: a", "figura 2. b", "ANEXO: c", "fuente: d", "z.9) e", "x. f", "– g", "tómese razón", "Registrese", "B. Letra"]
    frame = spark.createDataFrame([("D", 1, t) for t in lines], "document_id string, page_number int, text string")
    plain = F.coalesce(*(F.when(F.rlike("text", F.lit(T.MARKS[k])), T.CODE[k]) for k in T.MARKS), F.lit(T.CODE["rest"]))
    told = T._told(frame).select(F.col("said") == plain, F.col("is_field") == F.rlike("text", F.lit(T.METADATA_FIELD)), F.col("note") == F.rlike("text", F.lit(T.NOTE_OF_OBJECT))).collect()
    assert len(told) == len(lines) and all(all(r) for r in told)


def test_lines_of_many_documents_go_on_over_pages_and_reviews_rise(spark):
    text = "CAPÍTULO I\nArtículo 1: El texto que"
    rows = [(d, p, t, p == 2 and d == "D007", "c" if p == 2 else None) for d in [f"D{k:03d}" for k in range(300)] + [None] for p, t in ((2, "continúa aquí.\na) letra"), (1, text))]
    pages = spark.createDataFrame(rows, "document_id string, page_number int, normalized_text string, requires_manual_review boolean, review_reason_code string")
    found = {}
    for r in T.parse_structure(pages).orderBy("element_order").collect():
        found.setdefault(r.document_id, []).append((r.element_type, r.element_text, r.page_end, r.requires_manual_review, r.review_reason_code))
    plain = [("chapter", None, 2, 0, None), ("article", None, 2, 0, None), ("paragraph", "El texto que continúa aquí.", 2, 0, None), ("lettered_item", "letra", 2, 0, "c")]
    assert len(found) == 301 and all(v == plain for k, v in found.items() if k != "D007")
    assert found["D007"] == [("chapter", None, 2, 0, None), ("article", None, 2, 1, "c"), plain[2], ("lettered_item", "letra", 2, 1, "c")]
