"""Main text of web pages by site template removal.

The subtrees of all block elements of a page, whatever their tag or class, and the runs of text beside
them are hashed, an element by the hashes of its children. Spark counts on how many different pages
of a host each hash stands, and subtrees that recur on ``SHARE`` of them are deleted, on ``MIN_PAGES``
at least whatever the host's size: a passage that some articles quote is no template of the site.
Pages that are copies of each other hold the same article and count once, so a copied article isn't
one either. Rules by tag, role and class then take what never belongs to an article and stands too
seldom to be counted (navigation, forms, adverts, comments and so on), and text outside a marked
``main``.

Hashes are mixed with the host, so that counting moves 8-byte keys. Pages are parsed twice: the
first time only hashes are stored, the second time a page's blocks go, compressed, to meet the
hashes that are templates. Time and memory are in proportion to a page's markup, however deep it is
nested.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .shared import Scratch, meet
from .url_filter import host_and_path
from .words import pieces

#: Share of a host's different pages that makes a subtree its template, and the least pages.
SHARE, MIN_PAGES = 0.5, 3

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose content is no text of the page at all, and furniture, which is counted like all else.
_MUTE = frozenset("head title script style noscript template iframe svg select textarea input canvas audio video datalist xmp noembed noframes".split())
_OUT = frozenset("nav footer aside form button dialog menu".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_OUT_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar rail footer comment comments "
    "disqus reply replies respond share sharing social related recommended recommendations widget toolbar pagination pager masthead topbar".split()
)
#: Words that may stand beside these in a name: "share-bar" is furniture, "share-prices" is not.
_LAYOUT_NAMES = frozenset(
    "bar bars box boxes slot list lists item items link links button buttons icon icons wrap wrapper container content block section area panel unit zone group row col column grid inner outer "
    "top bottom left right center main site page global primary secondary header head body title text label form field area post posts article articles story stories news content feed sticky fixed "
    "mobile desktop small large big hidden js module component cookie policy message bar floating google".split()
)
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that carry an article's sentences: within an article their class or id alone doesn't leave them out.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption caption td th tr table".split())
#: Open elements that a start tag ends.
_ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
_SCOPE = frozenset("html body table td th caption button object template article main section div blockquote".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/>]|$)", re.I)
_NAME = re.compile(r"[a-z]+")


def _left_out(tag: str, attrs: str, inside: bool) -> bool:
    """inside: within a marked article."""
    if tag in _OUT and not (tag == "button" and inside) or (tag == "header" and not inside):
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
        if name == "role" and value.strip() in _OUT_ROLES:
            return True
        if name in ("class", "id") and not (inside and tag in _PROSE) and any(map(_furniture, value.split())):
            return True
    return False


def _furniture(name: str) -> bool:
    """A class or id of nothing but words for furniture and layout, one for furniture among them."""
    words = {w for w in _NAME.findall(name) if len(w) > 1}
    return not _OUT_NAMES.isdisjoint(words) and words <= _OUT_NAMES | _LAYOUT_NAMES


class _Open:
    __slots__ = ("tag", "mute", "ruled", "article", "parts", "number", "said")

    def __init__(self, tag: str, mute: bool, ruled: bool, article: int, number: int):
        self.tag, self.mute, self.ruled, self.article, self.number = tag, mute, ruled, article, number
        self.parts: list[str] = []
        self.said = False


class Page:
    """blocks: (text, number of the innermost element, 1 within main + 2 within an article) of what no
    rule takes; parents, hashes: of all block elements, whose numbers begin at 1 and ascend from a parent
    to its children; a hash is None where the element says nothing."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, int]] = []
        self.parents: list[int] = [0]
        self.hashes: list[int | None] = [None]
        self._stack = [_Open("", False, False, 0, 0)]
        self._open: Counter = Counter()
        self._text: list[str] = []
        self._parse(source)
        # A page has one main text, but any number of articles, teasers among them.
        if any(r & 1 for _, _, r in self.blocks):
            self.blocks = [b for b in self.blocks if b[2]]

    def own(self) -> list[str]:
        """Texts of the page's articles, or of all its blocks: what copies of a page agree on."""
        return [text for text, _, r in self.blocks if r & 2] or [text for text, *_ in self.blocks]

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            self._text = []
            top = self._stack[-1]
            if text:
                self.blocks.append((text, top.number, top.article))

    def _close(self) -> None:
        done, above = self._stack.pop(), self._stack[-1]
        self._open[done.tag] -= 1
        if done.said:
            above.said = True
            digest = _signed("\x01".join([done.tag, *done.parts]))
            if done.tag in _BLOCK and done.tag not in ("html", "body", "main") and not done.mute:
                self.hashes[done.number] = digest
            above.parts.append(f"<{digest:x}")
        elif not done.mute:
            above.parts.append("<" + done.tag)

    def _pop_to(self, at: int) -> None:
        while len(self._stack) > at:
            if self._stack[-1].tag in _BLOCK:
                self._flush()
            self._close()

    def _say(self, text: str) -> None:
        top = self._stack[-1]
        if top.mute or not text:
            return
        said = html.unescape(text)
        if not top.ruled:
            self._text.append(said)
        if (told := " ".join(said.split())):
            top.parts.append(told)
            top.said = True

    def _start(self, tag: str, attrs: str) -> None:
        stack = self._stack
        if tag in _BLOCK:
            self._flush()
            # A block ends an open paragraph, unless another block stands between.
            for k in range(len(stack) - 1, 0, -1) if self._open["p"] else ():
                if stack[k].tag == "p":
                    self._pop_to(k)
                    break
                if stack[k].tag in _SCOPE:
                    break
        if tag in _ENDS and any(self._open[x] for x in _ENDS[tag][0]):
            ended, limit = _ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in limit:
                    break
                if stack[k].tag in ended:
                    self._pop_to(k)
                    if tag != "tr" or not any(self._open[x] for x in ended):
                        break
        top = stack[-1]
        if tag in _VOID:
            if not top.mute and not top.ruled and tag in ("br", "hr", "wbr"):
                self._text.append("" if tag == "wbr" else " ")
            return
        mute = top.mute or tag in _MUTE
        ruled = top.ruled or mute or _left_out(tag, attrs, top.article & 2 > 0)
        article = top.article | 2 * (tag == "article") | bool(tag == "main" or re.search(r"""role\s*=\s*["']?main\b""", attrs, re.I))
        number = top.number
        if not mute and tag in _BLOCK and tag not in ("html", "body", "main"):
            number = len(self.parents)
            self.parents.append(top.number)
            self.hashes.append(None)
        self._open[tag] += 1
        stack.append(_Open(tag, mute, ruled, article, number))

    def _end(self, tag: str) -> None:
        if not self._open[tag]:
            return
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k].tag == tag:
                if tag in _BLOCK:
                    self._flush()
                self._pop_to(k)
                return

    def _parse(self, source: str) -> None:
        at = 0
        while True:
            m = _TOKEN.search(source, at)
            if m is None:
                break
            self._say(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, m[3])
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])|$(?!\n)", re.I).search(source, at)
                at = end.start() if end and end.start() < len(source) else len(source)
        self._say(source[at:])
        self._flush()
        self._pop_to(1)


def _signed(said: str, seed: int = 0) -> int:
    digest = xxhash.xxh64_intdigest(said, seed)
    return digest - (1 << 64) if digest >= 1 << 63 else digest


class Marked:
    """A page with its hashes mixed with the host: ``hashes`` of all elements that say something (None for
    others), ``runs`` of the blocks that are not all of their element, ``main`` of the page's own text."""

    def __init__(self, source: str | None, host: str):
        self.page, site = Page(source or ""), xxhash.xxh64_intdigest(host)
        self.hashes = [None if h is None else _signed(str(h), site) for h in self.page.hashes]
        inside = Counter(n for _, n, _ in self.page.blocks) + Counter(p for p, h in zip(self.page.parents, self.page.hashes) if h is not None)
        self.runs = [_signed("\x01\x01" + text, site) if not n or inside[n] > 1 else None for text, n, _ in self.page.blocks]
        self.main = _signed("\n".join(self.page.own()), site)

    def keys(self) -> list[int]:
        return sorted({h for h in (*self.hashes, *self.runs) if h is not None})

    def packed(self) -> list:
        """[parents, hashes, blocks as (text, element, run)] of the elements around blocks, numbered anew."""
        parents, needed = self.page.parents, bytearray(len(self.page.parents))
        for _, n, _ in self.page.blocks:
            needed[n] = 1
        for k in range(len(parents) - 1, 0, -1):
            if needed[k]:
                needed[parents[k]] = 1
        needed[0] = 1
        held = [k for k in range(len(parents)) if needed[k]]
        place = dict(zip(held, range(len(held))))
        return [[place[parents[k]] for k in held], [self.hashes[k] for k in held], [(text, place[n], run) for (text, n, _), run in zip(self.page.blocks, self.runs)]]


def without(packed: list, templates: set[int]) -> list[str]:
    """Texts of the blocks that neither stand in a template nor are one."""
    parents, hashes, blocks = packed
    gone = [False] * len(parents)
    for k in range(1, len(parents)):
        gone[k] = gone[parents[k]] or hashes[k] in templates
    return [text for text, n, run in blocks if not gone[n] and run not in templates]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, host, html) -> (key, site, main, hashes)."""
    for batch in batches:
        for part in pieces(batch, 2, 128):
            made = [(_signed(host), Marked(source, host)) for host, source in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            columns = [pa.array([s for s, _ in made], pa.int64()), pa.array([m.main for _, m in made], pa.int64()), pa.array([m.keys() for _, m in made], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["key", "site", "main", "hashes"])


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns are host and markup, which the compressed blocks replace."""
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for part in pieces(batch, batch.num_columns - 1, 128):
            packed = [Marked(source, host).packed() for host, source in zip(part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist())]
            made = [packer.compress(json.dumps(x, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "replace")) for x in packed]
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(made, pa.binary())], names=[*part.schema.names[:-2], "blocks"])


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns are blocks and template hashes, which the text that is left replaces."""
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        pairs = zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())
        texts = ["\n".join(without(json.loads(unpacker.decompress(packed)), set(gone or ()))) for packed, gone in pairs]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string())], names=[*batch.schema.names[:-2], "text"])


def site_templates(found: DataFrame, scratch: Scratch, share: float = SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """(key, gone): the template hashes on each page of ``found`` (key, site, main, hashes) that has any."""
    stands = found.select("key", "site", "main", F.explode("hashes").alias("hash"))
    # Most hashes stand on one page; places are looked at for the rest only.
    often = scratch.save(stands.groupBy("hash").agg(F.count("*").alias("n"), F.min("site").alias("site")).filter(f"n >= {int(min_pages)}"), "often")
    places = scratch.save(meet(stands.select("key", "main", "hash"), often.select("hash"), ["hash"]), "places")
    counted = places.select("hash", "main").distinct().groupBy("hash").agg(F.count("*").alias("pages")).filter(f"pages >= {int(min_pages)}")
    hosts = found.select("site", "main").distinct().groupBy("site").agg(F.count("*").alias("n"))
    named = counted.join(often.select("hash", "site"), "hash").join(hosts, "site")
    template = named.filter(F.col("pages") >= share * F.col("n")).select("hash")
    return meet(places, template, ["hash"]).groupBy("key").agg(F.collect_set("hash").alias("gone"))


def extract_text(pages: DataFrame, keep: list[str] = ("page_id", "url"), url_col: str = "url", html_col: str = "html", share: float = SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """``keep`` columns, text, n_chars of every row: the article's blocks joined by line feeds.

    Null and empty markup give an empty text. A null URL has the empty host, like one without
    ``://``. A host's subtrees are its templates from ``share`` of its different pages on and from
    ``min_pages`` pages at least; a page that holds nothing else has no text.
    Repeated rows give equal rows; an empty table gives none. Names of other columns don't matter.
    """
    scratch = Scratch(pages.sparkSession, "pages")
    host, _ = host_and_path(F.col(url_col))
    # Rows of one address and markup have one key and the same templates.
    key = F.xxhash64(url_col, html_col).alias("key")
    found = pages.select(key, host.alias("host"), F.col(html_col).alias("html")).mapInArrow(_hashed, "key long, site long, main long, hashes array<long>")
    gone = site_templates(scratch.save(found, "hashes"), scratch, share, min_pages)

    src = pages.select(*(F.col(c).alias(f"k_{c}") for c in keep), key, host.alias("host"), F.col(html_col).alias("html"))
    fields = lambda df, n: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:n])
    stored = src.mapInArrow(_stored, fields(src, -2) + ", blocks binary")
    met = meet(stored, gone, ["key"], "left").select(*(f"k_{c}" for c in keep), "blocks", "gone")
    out = met.mapInArrow(_left, fields(met, -2) + ", text string").select(*(F.col(f"k_{c}").alias(c) for c in keep), "text")
    return out.select(*keep, "text", F.length("text").cast("long").alias("n_chars"))
