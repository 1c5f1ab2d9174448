"""Trees of elements: interval labels, measures rolled up over subtrees, and nested documents.

A tree is flat rows with a parent id. Its interval labels are the place of an element in pre-order
and the number of elements of its subtree: an element's subtree is then the run of rows
``[preorder, preorder + subtree)``, whatever the depth. Labels and measures of many documents are
worked out together as one forest in arrays, level by level within the arrays, so there is one
shuffle and no job a level. The nested form is put together from rows in pre-order: each row opens
its element and closes as many as end there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import BATCH_ROWS

DOC, ID, PARENT, ORDER = "document_id", "element_id", "parent_id", "element_order"
LABELS = ("preorder", "subtree", "depth")
#: How a measure is rolled up, and what it begins with.
ROLL_UPS = {"min": (np.minimum, np.iinfo(np.int64).max), "max": (np.maximum, np.iinfo(np.int64).min), "sum": (np.add, 0)}


class BrokenTree(ValueError):
    """Parent links form a circle, or an id stands twice."""


def parent_places(ids: list[str], parents: list[str | None]) -> np.ndarray:
    """Place of each row's parent; -1 for roots: no parent, or one that isn't among the rows."""
    at = {name: k for k, name in enumerate(ids)}
    if len(at) < len(ids):
        raise BrokenTree("an element id stands twice in a document")
    return np.array([at.get(p, -1) if p is not None else -1 for p in parents], dtype=np.int64)


def depths(parent: np.ndarray) -> np.ndarray:
    """Number of elements above each, by doubling the steps up: as many rounds as the depth has bits."""
    n = len(parent)
    up = np.append(np.where(parent < 0, n, parent), n)
    steps = np.append(np.where(parent < 0, 0, 1), 0).astype(np.int64)
    for _ in range(max(1, n).bit_length() + 1):
        steps, up = steps + steps[up], up[up]
    if (up != n).any():
        raise BrokenTree("parent links form a circle")
    return steps[:n]


def by_level(depth: np.ndarray) -> list[np.ndarray]:
    """Rows of each depth, in their order."""
    rows = np.argsort(depth, kind="stable")
    return np.split(rows, np.flatnonzero(np.diff(depth[rows])) + 1) if len(rows) else []


def interval_labels(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(preorder, subtree size, depth) of rows that are in the order of siblings."""
    depth = depths(parent)
    levels = by_level(depth)
    size = np.ones(len(parent), dtype=np.int64)
    for rows in levels[:0:-1]:
        np.add.at(size, parent[rows], size[rows])
    preorder = np.zeros(len(parent), dtype=np.int64)
    for rows in levels:
        # Siblings follow each other by their sizes; the first stands behind the parent.
        rows = rows[np.argsort(parent[rows], kind="stable")]
        upto = np.cumsum(size[rows]) - size[rows]
        first = np.r_[True, parent[rows[1:]] != parent[rows[:-1]]]
        above = parent[rows]
        start = np.where(above < 0, 0, preorder[np.maximum(above, 0)] + 1)
        preorder[rows] = start + upto - np.repeat(upto[first], np.diff(np.append(np.flatnonzero(first), len(rows))))
    return preorder, size, depth


def rolled_up(values: np.ndarray, parent: np.ndarray, depth: np.ndarray, how: str) -> np.ndarray:
    """The measure of every element with all below it, from the deepest level up."""
    out, fold = values.copy(), ROLL_UPS[how][0]
    for rows in by_level(depth)[:0:-1]:
        fold.at(out, parent[rows], out[rows])
    return out


#: Elements that are labelled at once, at least: whole documents, so that small ones don't cost a call each.
FOREST_ROWS = 20_000


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Equal values of the columns as equal numbers from 0; null is a value."""
    whole = pa.chunked_array([c for column in columns for c in column.chunks], columns[0].type).combine_chunks()
    codes = whole.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(codes, np.cumsum([len(c) for c in columns])[:-1])


def forest_places(documents: np.ndarray, ids: np.ndarray, parents: np.ndarray, orphans: np.ndarray) -> np.ndarray:
    """``parent_places`` of many documents, all by number: no parent outside the own document; ``orphans`` name none."""
    span = int(max(ids.max(initial=0), parents.max(initial=0))) + 1
    own, named = documents * span + ids, documents * span + parents
    order = np.argsort(own, kind="stable")
    known = own[order]
    if (known[1:] == known[:-1]).any():
        raise BrokenTree("an element id stands twice in a document")
    at = np.minimum(np.searchsorted(known, named), max(len(known) - 1, 0))
    return np.where(orphans | (known[at] != named), -1, order[at]) if len(known) else np.empty(0, np.int64)


def _labelled_forest(table: pa.Table, measures: dict[str, tuple[str, str]], columns: list[str]) -> pa.Table:
    """Labels of whole documents, whose rows stand together in the order of siblings."""
    document = _codes(table[DOC])[0]
    first = np.flatnonzero(np.r_[True, document[1:] != document[:-1]]) if len(document) else np.empty(0, np.int64)
    start = np.repeat(first, np.diff(np.append(first, len(document))))
    ids, parents = _codes(table[ID], table[PARENT].cast(table[ID].type))
    parent = forest_places(document, ids, parents, table[PARENT].is_null().to_numpy())
    # Roots of a document follow those of the one before, so its pre-order is a run of the forest's.
    preorder, size, depth = interval_labels(parent)
    made = [pa.array(x) for x in (preorder - start, size, depth)]
    for how, column in measures.values():
        empty = ROLL_UPS[how][1]
        given = table[column].cast(pa.int64())
        held = rolled_up(given.fill_null(empty).to_numpy(), parent, depth, how)
        some = rolled_up((~np.asarray(given.is_null())).astype(np.int64), parent, depth, "sum") > 0
        made.append(pa.array(held, mask=~some if how != "sum" else None))
    for name, column in zip(columns, made):
        table = table.append_column(name, column)
    return table


def whole_documents(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table], pa.Table]) -> Iterator[pa.RecordBatch]:
    """What ``work`` makes of whole documents, many at once; rows of a document stand together."""
    held, rows, wait = [], 0, FOREST_ROWS
    for batch in batches:
        if batch.num_rows:
            held, rows = held + [batch], rows + batch.num_rows
        if rows < wait:
            continue
        # The last document may go on in the next batch.
        table = pa.Table.from_batches(held)
        document = _codes(table[DOC])[0]
        ends = np.flatnonzero(document[1:] != document[:-1])
        cut = int(ends[-1]) + 1 if len(ends) else 0
        if cut:
            yield from work(table.slice(0, cut)).to_batches(BATCH_ROWS)
            held = table.slice(cut).to_batches()
        rows -= cut
        wait = max(FOREST_ROWS, 2 * rows)
    if held:
        yield from work(pa.Table.from_batches(held)).to_batches(BATCH_ROWS)


def with_labels(elements: DataFrame, measures: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """``elements`` with preorder (from 0 within the document), subtree and depth, and ``measures``:
    name -> (min, max or sum, integer column) over each element's subtree.

    Siblings stand by element_order, equal orders by id; a parent may stand behind its children.
    Elements whose parent is not in their document are roots. Nulls take no part in a measure: one
    over nulls alone is null, a sum 0. Raises BrokenTree (in the job) for circles and ids that stand
    twice in a document. A document is one task's work; small ones are labelled many at once, and a
    task holds some ``FOREST_ROWS`` rows and its longest document.
    """
    measures = measures or {}
    own = elements.drop(*LABELS, *measures)
    columns = [*LABELS, *measures]
    schema = StructType([*own.schema.fields, *(StructField(c, LongType()) for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return whole_documents(batches, lambda table: _labelled_forest(table, measures, columns))

    dealt = own.repartition(DOC).sortWithinPartitions(DOC, F.asc_nulls_last(ORDER), F.asc_nulls_last(ID))
    return dealt.mapInArrow(run, schema)


def page_ranges(elements: DataFrame) -> DataFrame:
    """Page range of every element with all below it."""
    links = elements.select(DOC, ID, PARENT, *([ORDER] if ORDER in elements.columns else [F.lit(0).alias(ORDER)]), F.col("page_start").alias("first"), F.col("page_end").alias("last"))
    made = with_labels(links, {"first_page": ("min", "first"), "last_page": ("max", "last")})
    return made.select(DOC, ID, F.col("first_page").cast("int").alias("first_page"), F.col("last_page").cast("int").alias("last_page"))


#: Fields of a nested element, and those that only an element with a text has.
FIELDS = ["element_id", "parent_id", "element_type", "label", "title", "page_start", "page_end", "structure_confidence", "requires_manual_review", "review_reason_code", "review_reason_note"]
TEXT_FIELDS = ["element_text", "text_source", "content_status"]


def nested_documents(elements: DataFrame, fields: list[str] | None = None, text_fields: list[str] | None = None) -> DataFrame:
    """One row a document: document_id, elements_count, structure (JSON array of its roots, each with
    its children, in the order of elements).

    Any depth: rows in pre-order open an element each, and close those that end there. A document is
    one string, so it must fit one.
    """
    fields, text_fields = FIELDS if fields is None else fields, TEXT_FIELDS if text_fields is None else text_fields
    labelled = with_labels(elements)
    whole = lambda names: F.to_json(F.struct(*(_json_value(labelled, c) for c in names)), {"ignoreNullFields": "false"})
    inside = lambda text: F.substr(text, F.lit(2), F.length(text) - 2)
    said = F.when(F.col(text_fields[0]).isNotNull(), F.concat(F.lit(","), inside(whole(text_fields)))).otherwise("") if text_fields else F.lit("")
    order = W.partitionBy(DOC).orderBy("preorder")
    rows = labelled.withColumns({"after": F.coalesce(F.lead("depth").over(order), F.lit(0)), "last": F.lead("depth").over(order).isNull()})
    closes = F.greatest(F.col("depth") - F.col("after") + 1, F.lit(0)).cast("int")
    comma = F.when((closes > 0) & ~F.col("last"), ",").otherwise("")
    piece = F.concat(F.lit("{"), inside(whole(fields)), said, F.lit(',"children":['), F.repeat(F.lit("]}"), closes), comma)
    rows = rows.select(DOC, F.struct("preorder", piece.alias("piece")).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["piece"]), "")
    return rows.groupBy(DOC).agg(F.count(F.lit(1)).alias("elements_count"), F.concat(F.lit("["), joined, F.lit("]")).alias("structure"))


def _json_value(elements: DataFrame, name: str):
    return (F.col(name) == 1).alias(name) if name == "requires_manual_review" and dict(elements.dtypes)[name] != "boolean" else F.col(name)
