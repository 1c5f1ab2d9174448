"""What stands open above each line of a document, and the elements that lines make, in arrays.

Lines of many documents are worked out together, as the trees of ``tree.py`` are: a line is a place,
"the last line before that passes a test" is a running maximum of places, which counts if it lies in
the own document, and a division counts if nothing that ends it came later. Texts are only carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .tree import _codes, depths

DIVISIONS, HEADINGS, ARTICLES = ["chapter", "section", "subsection"], ["numbered_heading", "lettered_heading"], ["article", "transitory_article"]
VISUALS = ["table", "graph", "figure"]
ITEMS = ["compound_item", "numbered_item", "roman_item", "lettered_item", "bullet_item"]
#: Marks that a title can't be.
NO_TITLE = [*ARTICLES, *DIVISIONS, *HEADINGS, *VISUALS, "annex"]
#: Parts of ids: by label under the document, numbered under the document, numbered under the parent.
LABELLED = {
    "preamble": "PREAMBLE", "chapter": "CH", "section": "SEC", "subsection": "SUBSEC", "article": "ART", "transitory_article": "TRANSITORY_ART", "numbered_heading": "HEAD",
    "lettered_heading": "LHEAD", "table": "TABLE", "graph": "GRAPH", "figure": "FIGURE", "annex": "ANNEX",
}
NUMBERED = {"metadata_field": "META_001_FIELD", "title": "TITLE", "decree_header": "DECREE_HEADER", "signature_block": "SIGNATURE"}
BELOW = {"paragraph": "P", "bullet_item": "BULLET_", "object_note": "NOTE_"}
KINDS = [
    "decree_header", "preamble", *DIVISIONS, *HEADINGS, *ARTICLES, *VISUALS, "annex", "source_note", *ITEMS, "signature_block", "rest",
    "metadata_field", "metadata_more", "title", "object_note", "metadata_block", "paragraph", "other",
]
CODE = {kind: k for k, kind in enumerate(KINDS)}
_NO_PAGE = np.iinfo(np.int64).min


def _among(*kinds: str) -> np.ndarray:
    """Whether each kind is among these, by code."""
    return np.isin(np.arange(len(KINDS)), [CODE[k] for k in kinds])


def _known(*places: np.ndarray) -> np.ndarray:
    """The first of the places that is one."""
    out = places[-1]
    for place in places[-2::-1]:
        out = np.where(place >= 0, place, out)
    return out


def _nth(*codes: np.ndarray) -> np.ndarray:
    """How many rows up to each, itself included, have its codes."""
    order = np.lexsort(codes[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for code in codes:
        new[1:] |= code[order][1:] != code[order][:-1]
    first = np.flatnonzero(new)
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) + 1
    return out


def _digits(numbers: np.ndarray) -> pa.Array:
    """Three digits at least."""
    return pc.utf8_lpad(pa.array(numbers).cast(pa.string()), 3, "0")


def _one(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], column.type)


def _text(rows: np.ndarray, values: pa.Array) -> pa.Array:
    """The values of the rows; null for a place below 0."""
    return values.take(pa.array(np.maximum(rows, 0), mask=rows < 0))


def _joined(some: pa.Array, rest: pa.Array, sep: str = "_") -> pa.Array:
    """Both, or the second where the first is null."""
    return pc.coalesce(pc.binary_join_element_wise(some, rest, sep), rest)


def _unique(documents: np.ndarray, names: pa.Array) -> pa.Array:
    """Names, with a number from the second of a document on."""
    again = _nth(documents, _codes(pa.chunked_array([names]))[0])
    return pc.if_else(pa.array(again == 1), names, pc.binary_join_element_wise(names, _digits(again), "_"))


def made_elements(lines: pa.Table, schema: pa.Schema) -> pa.Table:
    """Elements of whole documents, whose lines stand together in their order."""
    total = lines.num_rows
    if not total:
        return schema.empty_table()
    document = _codes(lines["document_id"])[0]
    at = np.arange(total)
    start = np.maximum.accumulate(np.where(np.r_[True, document[1:] != document[:-1]], at, 0))
    flag = lambda name: _one(lines[name]).fill_null(False).to_numpy(zero_copy_only=False)
    said = _one(lines["said"]).to_numpy().astype(np.int64)
    field, note, title_like, lower = flag("is_field"), flag("note"), flag("title_like"), flag("lower")
    page = _one(lines["page_number"]).cast(pa.int64()).fill_null(_NO_PAGE).to_numpy()

    def upto(test: np.ndarray) -> np.ndarray:
        found = np.maximum.accumulate(np.where(test, at, -1))
        return np.where(found >= start, found, -1)

    def last(test: np.ndarray) -> np.ndarray:
        found = np.r_[-1, np.maximum.accumulate(np.where(test, at, -1))[:-1]]
        return np.where(found >= start, found, -1)

    def later(own: np.ndarray, *ends: np.ndarray) -> np.ndarray:
        return np.where(own > np.maximum.reduce(ends), own, -1)

    # The header lasts to the first line that neither is a field nor goes on with a title.
    told = last(field)
    goes_on = (told >= 0) & flag("is_title_field")[told] & ~_among("decree_header", "preamble")[said]
    header = upto((told >= 0) & ~field & ~goes_on) >= 0
    in_header = ~header & (field | (told >= 0))
    mark = np.where(in_header, np.where(field, CODE["metadata_field"], CODE["metadata_more"]), said)
    # One title, before any article or after what ends it.
    is_ = lambda *kinds: _among(*kinds)[mark]
    in_article = later(last(is_(*ARTICLES)), last(is_("preamble", *DIVISIONS, *HEADINGS))) >= 0
    may = ~in_header & ~in_article & title_like & ~_among(*NO_TITLE)[said]
    mark = np.where(may & (last(may) < 0), CODE["title"], mark)
    labelled = is_(*LABELLED)
    own_label = mark == said
    rows = np.flatnonzero(labelled)
    names = _unique(document[rows], _one(lines["base"]).take(pa.array(rows)))
    place = np.full(total, -1)
    place[rows] = np.arange(len(rows))
    ids = _text(place, names) if len(rows) else pa.nulls(total, pa.string())

    opened = {"chapter": ["chapter"], "section": ["section"], "subsection": ["subsection"], "head": ["numbered_heading"], "lettered": ["lettered_heading"], "article": ARTICLES, "preamble": ["preamble"], "visual": VISUALS, "signature": ["signature_block"], "transitory": ["transitory_article"]}
    o = {name: last(is_(*kinds)) for name, kinds in opened.items()}
    signature, transitory, chapter = o["signature"], o["transitory"], o["chapter"]
    cleared = np.maximum.reduce([o["chapter"], o["section"], o["subsection"]])
    visual = later(o["visual"], cleared, o["head"], o["lettered"], o["article"], o["preamble"])
    preamble = later(o["preamble"], cleared, o["head"], o["lettered"], o["article"])
    article = later(o["article"], cleared, o["head"], o["lettered"], o["preamble"])
    lettered, head = later(o["lettered"], cleared, o["head"]), later(o["head"], cleared)
    subsection, section = later(o["subsection"], o["section"], o["chapter"]), later(o["section"], o["chapter"])
    mark = np.where((visual >= 0) & note & is_(*ITEMS, "signature_block", "rest"), CODE["object_note"], mark)

    # Headings: above a numbered one the open lettered one, else the last of less depth; above a lettered one the open numbered one.
    numbered, is_head = is_("numbered_heading"), is_(*HEADINGS)
    level = _one(lines["level"]).fill_null(0).to_numpy()
    wider = np.full(total, -1)
    for depth in np.unique(level[numbered]):
        own = numbered & (level == depth)
        wider[own] = last(numbered & (level < depth))[own]
    wider = np.where(wider > cleared, wider, -1)
    over = np.where(numbered, _known(lettered, wider), np.where(is_head, head, -1))
    top = np.where(is_head, over, np.where((lettered >= 0) | (head >= 0), last(is_head), -1))
    chain = np.where(top >= 0, depths(over)[top] + 1, 0)

    # Lines that go on with the text of an earlier one: ``owner``.
    parent = _known(article, lettered, head, subsection, section, chapter, preamble)
    has_body = ~_one(lines["body"]).is_null().to_numpy(zero_copy_only=False) & own_label
    noted = flag("noted") & has_body
    rest = is_("rest") & (signature < 0)
    sentence = is_(*ITEMS) | (is_(*HEADINGS, *ARTICLES, "source_note") & has_body) | (is_(*VISUALS, "annex") & has_body & ~noted)
    before = np.maximum(at - 1, 0)
    ready = rest & lower & (at > start) & (page > page[before]) & (page[before] != _NO_PAGE)
    # A run of lines that may each go on: all do after a sentence; else the first makes a paragraph, if it has a parent, and the others go on with it.
    run = last(~ready)
    after_sentence = (run >= 0) & (sentence[run] | (rest[run] & (parent[run] >= 0)))
    first = np.where(run >= 0, run, start - 1) + 1
    follows = ready & (after_sentence | ((at != first) & (parent >= 0)))
    owner = np.where(follows, np.where(after_sentence, run, first), np.where(is_("rest") & (signature >= 0), signature, np.where(is_("metadata_more"), last(is_("metadata_field")), at)))
    reach = np.full(total, _NO_PAGE)
    np.maximum.at(reach, owner, page)
    text = _one(lines["text"])
    added = np.flatnonzero(owner != at)
    added = added[np.argsort(owner[added], kind="stable")]
    longer, sizes = np.unique(owner[added], return_counts=True)
    place = np.full(total, -1)
    place[longer] = np.arange(len(longer))
    pieces = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), text.take(pa.array(added)))
    more = _text(place, pc.binary_join(pieces, " ")) if len(longer) else pa.nulls(total, pa.string())

    def joined(words: pa.Array) -> pa.Array:
        some = pc.if_else(pc.equal(words, ""), pa.scalar(None, pa.string()), words)
        return pc.if_else(more.is_valid(), _joined(some, more, sep=" "), words)

    # Elements: a block before the first field, one of the line, one of the body that follows its title.
    is_field = is_("metadata_field")
    block = upto(is_field & (last(is_field) < 0))
    divisions = sum((x >= 0).astype(np.int64) for x in (chapter, section, subsection))
    division = _known(subsection, section, chapter)
    plain = is_("rest")
    kind = np.where(plain, np.where(parent >= 0, CODE["paragraph"], CODE["other"]), mark)
    alone = is_("chapter", "preamble", "title", "decree_header", "signature_block")
    rules = [
        (is_field, block), (is_("section", "annex"), chapter), (is_("subsection"), _known(section, chapter)), (is_head, _known(top, division)), (is_(*ARTICLES), _known(lettered, head, division)),
        (is_("source_note"), _known(visual, parent)), (is_("object_note"), visual), (alone, np.full(total, -1)),
    ]
    up = np.select([test for test, _ in rules], [x for _, x in rules], parent)
    under = np.where(article >= 0, divisions + chain + 1, np.where(chain + divisions > 0, chain + divisions, preamble >= 0))
    depth_rules = [
        (is_field, 1), (alone, 0), (is_("section", "annex"), chapter >= 0), (is_("subsection"), (chapter >= 0).astype(np.int64) + (section >= 0)),
        (is_(*HEADINGS, *ARTICLES), divisions + chain), (is_("object_note") | (is_("source_note") & (visual >= 0)), under + 1),
    ]
    depth = np.select([test for test, _ in depth_rules], [np.broadcast_to(np.asarray(x, dtype=np.int64), total) for _, x in depth_rules], under)
    innermost = _known(article, lettered, head, division)
    firm = ((article >= 0) & (article != transitory)) | (innermost < 0)
    guessed = is_("title", *HEADINGS, *VISUALS, "annex", "source_note", "object_note", "compound_item", "roman_item", "bullet_item", "signature_block")
    sure = np.where(plain & (parent < 0), 2, np.where(guessed | (plain & ~firm), 1, 0))
    visible = is_(*VISUALS, "annex")
    inside = is_(*HEADINGS, *ARTICLES) | (visible & noted)
    second_up = np.where(inside, at, np.where(is_("annex"), chapter, parent))
    second_depth = np.where(inside, depth + 1, np.where(is_("annex"), depth, under))

    kept = owner == at
    is_block = is_field & (block == at)
    second = kept & has_body
    parts = [np.flatnonzero(kept & is_block), np.flatnonzero(kept), np.flatnonzero(second)]
    line = np.concatenate(parts)
    part = np.repeat([0, 1, 2], [len(x) for x in parts])
    sub = np.where(part == 1, is_block[line], part == 2).astype(np.int64)
    order = np.lexsort((sub, line))
    line, part, sub = line[order], part[order], sub[order]
    pick = lambda *values: np.select([part == 0, part == 1], [np.asarray(v)[line] if np.ndim(v) else np.full(len(line), v) for v in values[:2]], values[2][line] if np.ndim(values[2]) else values[2])
    e_kind = pick(CODE["metadata_block"], kind, np.where(visible & noted, CODE["object_note"], CODE["paragraph"]))
    e_up = pick(-1, up, second_up)
    e_depth = pick(0, depth, second_depth)
    e_sure = pick(0, sure, np.where(is_(*ARTICLES), 0, 1))
    e_reach = pick(page, np.where(has_body, page, reach), reach)

    # Children's pages and reviews go to their parent, pages that a continued line reaches to all above it.
    end = np.full(total, _NO_PAGE)
    begins = sub == 0
    end[line[begins]] = e_reach[begins]
    child = np.flatnonzero(e_up >= 0)
    np.maximum.at(end, e_up[child], page[line[child]])
    far = np.flatnonzero(kept & (reach > page) & (page != _NO_PAGE) & ~is_("signature_block"))
    most = reach[far]

    def raise_to(rows: np.ndarray, test: np.ndarray) -> None:
        use = test & (rows >= 0)
        np.maximum.at(end, rows[use], most[use])

    own_field, own_annex, own_head = is_field[far], is_("annex")[far], is_(*HEADINGS, *ARTICLES)[far]
    other = ~own_field & ~own_annex & ~own_head
    within = other & (innermost[far] >= 0)
    raise_to(block[far], own_field)
    raise_to(chapter[far], own_annex)
    raise_to(far, own_head)
    raise_to(preamble[far], other & ~within)
    raise_to(article[far], within)
    for x in (subsection, section, chapter):
        raise_to(x[far], own_head | within)
    step = np.where(own_head | within, top[far], -1)
    while (step >= 0).any():
        raise_to(step, step >= 0)
        step = np.where(step >= 0, over[step], -1)
    e_end = np.where(begins, end[line], e_reach)

    review = flag("requires_manual_review")
    told_off = child[review[line[child]]]
    any_child = np.zeros(total, dtype=bool)
    any_child[e_up[told_off]] = True
    e_review = review[line] | (begins & any_child[line])

    def passed_on(name: str) -> pa.Array:
        given = _one(lines[name])
        some = ~given.is_null().to_numpy(zero_copy_only=False)
        source = np.full(total, total)
        telling = told_off[some[line[told_off]]]
        np.minimum.at(source, e_up[telling], line[telling])
        source = np.where(source < total, source, -1)
        return _text(np.where(some[line], line, np.where(begins, source[line], -1)), given)

    # Ids: of the label, numbered under the document, or under the parent.
    doc_text = _one(lines["document_id"])
    block_ids = pc.binary_join_element_wise(doc_text, "META_001", "_")
    in_block = (e_up >= 0) & is_field[np.maximum(e_up, 0)]
    parent_id = pc.if_else(pa.array(in_block), _text(e_up, block_ids), _text(e_up, ids))
    e_id = _text(np.where((part == 1) & labelled[line], line, -1), ids)
    e_id = pc.if_else(pa.array(part == 0), _text(line, block_ids), e_id)
    has_id = e_id.is_valid().to_numpy(zero_copy_only=False)
    nested = (e_up >= 0) & _among(*BELOW, *ITEMS)[e_kind]
    series = np.where(nested, e_kind, np.where(_among(*NUMBERED)[e_kind], e_kind + len(KINDS), -1))
    e_doc = document[line]
    k = _nth(np.where(has_id, -1, e_doc), np.where(has_id, 0, np.where(nested, e_up, -1)), np.where(has_id, 0, series))
    names_of = lambda table, other: pa.array([table.get(x, other) for x in KINDS], pa.string()).take(pa.array(e_kind))
    number = _digits(k)
    label = pc.if_else(pa.array(is_field), _one(lines["field_label"]), pc.if_else(pa.array(own_label), _one(lines["label"]), pa.scalar(None, pa.string())))
    e_label = _text(np.where(part == 1, line, -1), label)
    tag = _text(np.where((part == 1) & own_label[line], line, -1), _one(lines["part"]))
    below = pc.binary_join_element_wise(parent_id, pc.binary_join_element_wise(names_of(BELOW, None), number, ""), "_")
    item = _joined(parent_id, pc.binary_join_element_wise("ITEM", pc.coalesce(tag, pa.array(k).cast(pa.string())), "_"))
    loose = _joined(doc_text.take(pa.array(line)), pc.binary_join_element_wise(names_of(NUMBERED, "OTHER"), number, "_"))
    name = pc.coalesce(e_id, pc.if_else(pa.array(nested), pc.coalesce(below, item), loose))

    content = pc.if_else(pa.array(is_field), _one(lines["field_text"]), pc.if_else(pa.array(own_label & ~plain & ~is_("object_note")), _one(lines["content"]), text))
    main = pc.if_else(pa.array(has_body), content, joined(content))
    words = pc.if_else(pa.array(part == 1), _text(line, main), pc.if_else(pa.array(part == 2), _text(line, joined(_one(lines["body"]))), pa.scalar(None, pa.string())))
    heard = pc.if_else(pa.array(is_("title")), _one(lines["small"]), pc.if_else(pa.array(own_label & ~is_("source_note")), _one(lines["title"]), pa.scalar(None, pa.string())))
    pages = lambda x: pa.array(x, pa.int64(), mask=x == _NO_PAGE).cast(pa.int32())
    made = [
        doc_text.take(pa.array(line)), _unique(e_doc, name), parent_id, pa.array(_nth(e_doc)), pa.array(e_depth), pa.array(KINDS, pa.string()).take(pa.array(e_kind)), e_label, _text(np.where(part == 1, line, -1), heard),
        pages(page[line]), pages(e_end), words, pa.array(["high", "medium", "uncertain"]).take(pa.array(e_sure)), pa.array(e_review.astype(np.int32)), passed_on("review_reason_code"), passed_on("review_reason_note"),
    ]
    return pa.Table.from_arrays([x.cast(f.type) for x, f in zip(made, schema)], schema=schema)
