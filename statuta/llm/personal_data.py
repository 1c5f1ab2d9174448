"""Personal data by weak supervision: labelers vote on candidate spans, their reliabilities are estimated, a classifier decides.

Base spans (e-mail addresses, IP addresses, card and phone numbers in fixed forms) always stand.
Candidates beyond them are looser: spelled-out addresses, IPv6, numbers inside runs that fail as a
whole, national phone numbers, cards of other lengths and separators, names. Six labelers (forms,
checks, gazetteers and the context) vote yes, no or nothing on every candidate. Expectation-maximisation
over the counts of vote patterns estimates how reliable each labeler is for a kind, with base spans as
known positives, and gives every pattern a probability. A logistic classifier for each kind is then
fitted to these, over votes and shape bits, and decides on the candidates.

Texts are read once. What reaches the driver is the table of patterns: 5 kinds x 3^6 votes x 2^4
shape bits at most, counted over all candidates, whatever the corpus.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import Scratch
from .words import pieces

KINDS = ("email", "ip", "card", "phone", "name")
EMAIL, IP, CARD, PHONE, NAME = range(5)
LABELERS = ("form", "check", "gazetteer", "cue", "border", "company")
YES, NO, NONE = 1, 2, 0
SHAPE_BITS = 4
#: Characters before a span that are read for cue words, and around it for other base spans.
CUE_REACH, COMPANY_REACH = 32, 120
#: A candidate is taken from this probability on.
ACCEPT = 0.9
#: What a labeler is held to be before any data: P(yes | personal), P(yes | not), in so many votes' worth.
PRIOR_YES, PRIOR_FALSE, PRIOR_WEIGHT = 0.9, 0.2, 20.0
#: Prior weights of the classifier (bias, yes, no, shape bit) and how much they weigh.
PRIOR_BIAS, PRIOR_VOTE, RIDGE = -1.0, 1.5, 1.0

#: Gazetteers, parameters of ``find_personal_data``.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co ai app dev de fr es it nl be at ch uk ie pt pl cz se no fi dk eu us ca mx br ar cl au nz jp cn kr in za ru tr gr hu ro".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 234 254 351 352 353 354 358 359 380 420 421 852 886 971 972".split())
GIVEN_NAMES = frozenset("Anna Maria Marie Peter Paul John Mary James Robert Michael William David Linda Elizabeth Susan Sarah Karen Thomas Daniel Laura Julia Sophie Emma Lucas Lukas Hans Klaus Jürgen Wolfgang Ursula Sabine Petra Jean Pierre Jacques Michel Claire Camille Nathalie Isabelle José Juan Carlos Luis Miguel Carmen Lucía Elena Pablo Diego Javier Antonio Manuel".split())
TITLES = frozenset("Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra Don Doña".split())
CUES = {
    EMAIL: "mail e-mail email contact write correo courriel kontakt".split(),
    IP: "ip address host server client login adresse dirección".split(),
    CARD: "card visa mastercard amex credit debit karte carte tarjeta".split(),
    PHONE: "phone tel telephone mobile cell fax call telefon handy téléphone teléfono móvil".split(),
    NAME: "name signed contact patient nom nombre dear attn".split(),
}
AGAINST = "token key hash sha md5 id no number order invoice version v section serial ref isbn part model build".split()

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Where numbers stand: every base form of digits lies within one such run.
_RUN = re.compile(r"[+0-9][0-9+().\x20-]*")
_QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_OBSCURED = re.compile(r"[\[({<]\s?(?:at|At|AT|@)\s?[\])}>]|\x20@\x20|\x20(?:at|AT)\x20(?=[A-Za-z0-9-]{1,63}\x20(?:dot|DOT)\x20)")
_OBSCURED_DOMAIN = re.compile(r"\s?([A-Za-z0-9-]{1,63}(?:(?:\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?|\x20(?:dot|DOT)\x20|\.)[A-Za-z0-9-]{1,63})+)")
_COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")
_HEX = frozenset("0123456789abcdefABCDEF:.")
_CAPITALISED = re.compile(r"[A-ZÀ-ÖØ-Þ][^\W\d_]{1,30}+(?:\x20[A-ZÀ-ÖØ-Þ][^\W\d_]{1,30}+)++")
_TITLED = re.compile(r"([A-ZÀ-ÖØ-Þ][^\W\d_]{1,30}+)\.\x20([A-ZÀ-ÖØ-Þ][^\W\d_]{1,30}+(?:\x20[A-ZÀ-ÖØ-Þ][^\W\d_]{1,30}+){0,2}+)")
_NUMBER = re.compile(r"[0-9]+")
_GROUPED = re.compile(r"[0-9]{4}(?:(?:[\x20.-]{1,2}[0-9]{4}){3}|[\x20.-]{1,2}[0-9]{6}[\x20.-]{1,2}[0-9]{4,5})(?![0-9])")
_NATIONAL = re.compile(r"(?:\([0-9]{2,5}\)[\x20.-]?|[0-9]{2,5}[\x20.-])[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3}(?![0-9])")
_TOKEN = re.compile(r"[^\x20]+")
_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _left_run(text: str, end: int, floor: int, allowed: frozenset[str]) -> int:
    while end > floor and text[end - 1] in allowed:
        end -= 1
    return end


def _base(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, matches of the base forms that fail their check), each leftmost and non-overlapping for its kind."""
    good: list[Span] = []
    failed: list[Span] = []
    floor, at = 0, text.find("@")
    while at >= 0:
        start = _left_run(text, at, floor, _LOCAL)
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            good.append((EMAIL, start, domain.end()))
        floor = domain.end() if domain else at + 1
        at = text.find("@", floor)
    for run in _RUN.finditer(text):
        low, high = run.span()
        if high - low < 7:
            continue
        for m in _QUAD.finditer(text, low, high):
            fits = all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 and not x[:-3].strip("0") for x in m.group().split("."))
            (good if fits else failed).append((IP, *m.span()))
        for m in _CARD.finditer(text, low, high):
            digits = _digits(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                good.append((CARD, *m.span()))
            elif len(digits) > 12:
                failed.append((CARD, *m.span()))
        for m in _PHONE.finditer(text, low, high):
            (good if 8 <= len(_digits(m.group())) <= 15 else failed).append((PHONE, *m.span()))
    return good, failed


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of all base spans by kind and start, in code points."""
    return sorted(_base(text)[0])


def _loose_emails(text: str) -> Iterator[Span]:
    for m in _OBSCURED.finditer(text):
        end = m.start()
        if end and text[end - 1] == " ":
            end -= 1
        start = _left_run(text, end, max(0, end - 64), _LOCAL)
        domain = _OBSCURED_DOMAIN.match(text, m.end())
        if start < end and domain:
            yield EMAIL, start, domain.end()


def _loose_ips(text: str) -> Iterator[Span]:
    upto = 0
    for m in _COLONS.finditer(text):
        if m.start() < upto:
            continue
        start = _left_run(text, m.start(), max(0, m.start() - 40), _HEX)
        upto = m.end()
        while upto < len(text) and text[upto] in _HEX and upto - start < 64:
            upto += 1
        end = upto - (text[upto - 1] == ".") - (text[upto - 1] == ":" and text[upto - 2] != ":")
        if text.count(":", start, end) > 1:
            yield IP, start, end


class Held:
    """Disjoint intervals that the given spans cover, in order."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for low, high in sorted((a, b) for _, a, b in spans):
            if self.ends and low < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], high)
            else:
                self.starts.append(low)
                self.ends.append(high)

    def meets(self, low: int, high: int) -> bool:
        k = bisect_right(self.ends, low)
        return k < len(self.starts) and self.starts[k] < high

    def free(self, low: int, high: int) -> Iterator[tuple[int, int]]:
        """What of [low, high) no interval covers."""
        k = bisect_right(self.ends, low)
        while k < len(self.starts) and self.starts[k] < high:
            if self.starts[k] > low:
                yield low, self.starts[k]
            low = max(low, self.ends[k])
            k += 1
        if low < high:
            yield low, high


def _loose_numbers(text: str, failed: list[Span], held: Held) -> Iterator[Span]:
    """Cards and phones inside runs that aren't one base number."""
    for kind, low, high in failed:
        for a, b in held.free(low, high) if kind == PHONE else ():
            if text[a] != "+":
                continue
            end, digits = a, 0
            for token in _TOKEN.finditer(text, a, b):
                own = len(_digits(token.group()))
                if own > 12 or digits + own > 15 or _QUAD.fullmatch(token.group()):
                    break
                end, digits = token.end(), digits + own
            while end > a and not "0" <= text[end - 1] <= "9":
                end -= 1
            if digits > 7:
                yield PHONE, a, end
    for run in _RUN.finditer(text):
        if run.end() - run.start() < 7:
            continue
        begin = run.start() - (run.start() > 0 and text[run.start() - 1] == "(")
        for at, high in held.free(begin, run.end()):
            while at < high:
                m = _NATIONAL.match(text, at, high) if not at or not text[at - 1].isalnum() else None
                if m and 8 <= len(_digits(m.group())) <= 13:
                    yield PHONE, *m.span()
                    at = m.end()
                    continue
                m = _NUMBER.match(text, at, high)
                if not m:
                    at += 1
                    continue
                grouped = _GROUPED.match(text, at, high)
                end = max(m.end(), grouped.end() if grouped else 0)
                if end - at >= 7:
                    yield (CARD if grouped or end - at > 12 else PHONE), at, end
                at = end


def _loose_names(text: str, names: frozenset[str]) -> Iterator[Span]:
    for m in _CAPITALISED.finditer(text):
        words, at, k = m.group().split(" "), m.start(), 0
        while k < len(words):
            first, size = (k + 1, 3) if words[k] in TITLES else (k, 3) if words[k] in names else (k, 0)
            own = words[first : first + size]
            if len(own) > (first == k):  # a given name alone is none
                start = at + (len(words[k]) + 1) * (first - k)
                yield NAME, start, start + len(" ".join(own))
            else:
                own, first = words[k : k + 1], k
            at += sum(len(w) + 1 for w in words[k : first + len(own)])
            k = first + len(own)
    for m in _TITLED.finditer(text):
        if m[1] in TITLES:
            yield NAME, *m.span(2)


def _vote(yes: bool, no: bool) -> int:
    return YES if yes else NO if no else NONE


def _votes(text: str, span: Span, held: Held, gazetteers: dict) -> tuple[int, int]:
    """(votes of all labelers as digits to the base 3, shape bits) of a candidate."""
    kind, start, end = span
    own = text[start:end]
    digits = _digits(own)
    before = [w.lower() for w in _WORD.findall(text[max(0, start - CUE_REACH) : start])]
    after = text[end] if end < len(text) else " "
    ahead = text[start - 1] if start else " "
    if kind == EMAIL:
        plain = re.sub(r"\s?[\[({<]?\s?\b(?:dot|DOT)\b\s?[\])}>]?\s?", ".", re.sub(r"\s?[\[({<]\s?(?:at|At|AT|@)\s?[\])}>]\s?|\s@\s|\s(?:at|AT)\s", "@", own))
        local, _, domain = plain.partition("@")
        labels = domain.split(".")
        form = _vote(len(local) <= 64 and not local.startswith(".") and ".." not in local, True)
        check = _vote(len(labels) > 1 and all(x and x[0] != "-" and x[-1] != "-" for x in labels) and labels[-1].isalpha(), True)
        listed = _vote(labels[-1].lower() in gazetteers["domains"], True)
    elif kind == IP:
        if ":" in own:
            try:
                address = ipaddress.ip_address(own)
            except ValueError:
                address = None
            form = _vote(own.count(":") >= 3 or "::" in own and len(own) > 3, True)
            check, listed = _vote(address is not None, True), _vote(address is not None and (address.is_global or address.is_private) and not address.is_unspecified, address is None)
        else:
            parts = own.split(".")
            form = _vote(all(x == "0" or x[0] != "0" for x in parts), True)
            check = _vote(all(len(x) <= 3 and int(x) <= 255 for x in parts), True)
            listed = _vote(False, parts[0].strip("0") == "" or len(parts[0]) > 3)
    elif kind == CARD:
        groups = [len(x) for x in re.findall(r"[0-9]+", own)]
        form = _vote(groups in ([4, 4, 4, 4], [4, 6, 5], [4, 6, 4], [4, 4, 4, 4, 3], [16], [19]) or groups == [15] and own[0] == "3", True)
        check = _vote(13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1, True)
        listed = _vote(digits[0] in "3456" or "2221" <= digits[:4] <= "2720", True)
    elif kind == PHONE:
        groups = re.findall(r"[0-9]+", own)
        # An international prefix, an area code in brackets or with a trunk zero, or three, three and four digits.
        form = _vote(own[0] in "+(" or len(groups) > 2 and groups[0][0] == "0" or list(map(len, groups)) == [3, 3, 4] and groups[0][0] > "1", True)
        check = _vote(8 <= len(digits) <= 15 and len(set(digits)) > 2, True)
        code = digits if own[0] == "+" else digits[2:] if digits[:2] == "00" else ""
        listed = _vote(any(code[:k] in gazetteers["codes"] for k in (1, 2, 3)), bool(code))
    else:
        words = own.split(" ")
        form = _vote(len(words) > 1, False)
        check = _vote(len({w.lower() for w in words}) == len(words), True)
        listed = _vote(words[0] in gazetteers["names"], False)
        before = [*before, "name"] if before and before[-1].capitalize() in TITLES else before
    cue = _vote(not set(before[-3:]).isdisjoint(CUES[kind]), not set(before[-2:]).isdisjoint(AGAINST) or bool(before) and ahead in "\"'=" and kind != NAME)
    border = _vote(not (ahead.isalnum() or after.isalnum() or ahead in "_@/\\" or after in "_@/\\"), True)
    first, last = bisect_right(held.ends, start) - 1, bisect_left(held.starts, end)
    company = _vote(first >= 0 and held.ends[first] > start - COMPANY_REACH or last < len(held.starts) and held.starts[last] < end + COMPANY_REACH, False)
    shape = (len(own) > len(digits)) | (own[0] in "+([") << 1 | (start == 0 or ahead == "\n") << 2 | (after in ".,;:)\n ") << 3
    packed = 0
    for vote in (form, check, listed, cue, border, company):
        packed = packed * 3 + vote
    return packed, shape


def candidates(text: str, gazetteers: dict) -> list[tuple[int, int, int, int, int, bool]]:
    """(kind, start, end, votes, shape, whether base) of all spans to judge, by kind and start.

    Base spans may overlap each other; the others overlap none.
    """
    base, failed = _base(text)
    held = Held(base)
    out = [(*s, *_votes(text, s, held, gazetteers), True) for s in base]
    loose = [*(s for s in failed if s[0] == IP), *_loose_numbers(text, failed, held), *_loose_emails(text), *_loose_ips(text), *_loose_names(text, gazetteers["names"])]
    upto = 0
    for span in sorted(loose, key=lambda s: (s[1], -s[2])):
        if span[1] >= upto and not held.meets(*span[1:]):
            upto = span[2]
            out.append((*span, *_votes(text, span, held, gazetteers), False))
    return sorted(out)


def _found(gazetteers: dict):
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.int32()), ("shape", pa.int32()), ("base", pa.bool_())]))
    names = ("kind", "start", "end", "votes", "shape", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                spans = [[dict(zip(names, c)) for c in candidates(t, gazetteers)] if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return run


def _unpacked(votes: np.ndarray) -> np.ndarray:
    return np.stack([votes // 3 ** (len(LABELERS) - 1 - k) % 3 for k in range(len(LABELERS))], axis=1)


def estimate(votes: np.ndarray, counts: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of each pattern, P(yes | personal), P(yes | not) of each labeler) by expectation-maximisation.

    ``votes``: a row a pattern; ``counts``: how often each occurs; ``known``: patterns that are
    personal data. A labeler that abstains says nothing. Runs until no reliability moves by 1e-9.
    """
    yes, no = (votes == YES).astype(float), (votes == NO).astype(float)
    right, wrong, share = (np.full(len(LABELERS), x) for x in (PRIOR_YES, PRIOR_FALSE, 0.5))
    while True:
        odds = np.log(share[0] / (1 - share[0])) + yes @ np.log(right / wrong) + no @ np.log((1 - right) / (1 - wrong))
        chance = np.where(known, 1.0, 1 / (1 + np.exp(-np.clip(odds, -500, 500))))
        mass = chance * counts, (1 - chance) * counts
        made = [(PRIOR_WEIGHT * prior + m @ yes) / (PRIOR_WEIGHT + m @ (yes + no)) for m, prior in zip(mass, (PRIOR_YES, PRIOR_FALSE))]
        open_ = ~known
        share = np.full(1, (1 + mass[0][open_].sum()) / (2 + counts[open_].sum()))
        moved = max(np.abs(made[0] - right).max(), np.abs(made[1] - wrong).max())
        right, wrong = made
        if moved < 1e-9:
            return chance, right, wrong


def _design(votes: np.ndarray, shape: np.ndarray) -> np.ndarray:
    bits = shape[:, None] >> np.arange(SHAPE_BITS) & 1
    return np.concatenate([np.ones((len(votes), 1)), votes == YES, votes == NO, bits], axis=1).astype(float)


def fit(x: np.ndarray, chance: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weights of a logistic classifier for soft labels, drawn towards the prior weights, by Newton's method."""
    n = len(LABELERS)
    prior = np.concatenate([[PRIOR_BIAS], np.full(n, PRIOR_VOTE), np.full(n, -PRIOR_VOTE), np.zeros(SHAPE_BITS)])
    loss = lambda w: (counts * (np.logaddexp(0, x @ w) - chance * (x @ w))).sum() + RIDGE / 2 * ((w - prior) ** 2).sum()
    w = prior.copy()
    while True:
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (counts * (p - chance)) + RIDGE * (w - prior)
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if size <= 1e-6 or np.abs(size * step).max() < 1e-9:
            return w


def _accepted(rows: list) -> tuple[list[int], dict]:
    """(codes of accepted (kind, votes, shape), what was estimated for each kind) of the counted patterns."""
    codes, report = [], {}
    for kind, name in enumerate(KINDS):
        own = sorted((r for r in rows if r.kind == kind), key=lambda r: (r.votes, r.shape, r.base))
        if not own:
            continue
        packed, shape, counts, known = (np.array([r[k] for r in own]) for k in ("votes", "shape", "count", "base"))
        votes = _unpacked(packed)
        chance, right, wrong = estimate(votes, counts.astype(float), known)
        x = _design(votes, shape)
        # More than a thousand spans weigh as a thousand: the prior still counts where votes hardly occur.
        w = fit(x, chance, counts * min(1.0, 1000 / counts.sum()))
        fine = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500))) >= ACCEPT
        codes += [(kind * 3 ** len(LABELERS) + r.votes) << SHAPE_BITS | r.shape for r, f in zip(own, fine) if f]
        report[name] = {"personal": dict(zip(LABELERS, right)), "not": dict(zip(LABELERS, wrong)), "weights": w}
    return sorted(set(codes)), report


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top_domains: frozenset[str] = TOP_DOMAINS, calling_codes: frozenset[str] = CALLING_CODES, given_names: frozenset[str] = GIVEN_NAMES, return_report: bool = False) -> DataFrame | tuple[DataFrame, dict]:
    """A row a document: doc_id, spans (array of kind, start, end, base; by kind, then start; code
    points, end exclusive); with ``return_report`` also the labelers' estimated reliabilities.

    Null and empty texts have no span. Repeated rows and ids each get a row and count in the
    estimates; null ids keep their row. Added spans overlap no base span. With few candidates the
    prior reliabilities decide. An empty table gives no row. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "personal-data")
    gazetteers = {"domains": top_domains, "codes": calling_codes, "names": given_names}
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, spans array<struct<kind:int,start:int,end:int,votes:int,shape:int,base:boolean>>"
    found = scratch.save(src.mapInArrow(_found(gazetteers), schema), "candidates")
    patterns = found.select(F.inline("spans")).groupBy("kind", "votes", "shape", "base").count()
    codes, report = _accepted(patterns.collect())  # a row a pattern, see the head of this module
    code = f"shiftleft(c.kind * {3 ** len(LABELERS)} + c.votes, {SHAPE_BITS}) + c.shape"
    taken = f"c.base or ({code}) in ({', '.join(map(str, codes))})" if codes else "c.base"
    named = "element_at(array({}), c.kind + 1)".format(", ".join(f"'{k}'" for k in KINDS))
    out = found.select("doc_id", F.expr(f"transform(filter(spans, c -> {taken}), c -> struct({named} as kind, c.start as start, c.end as end, c.base as base))").alias("spans"))
    return (out, report) if return_report else out


def digests(found: DataFrame) -> DataFrame:
    """doc_id, number of base spans of each kind, base_sha256, spans as text."""
    joined = lambda spans: f"array_join(transform({spans}, c -> concat_ws(':', c.kind, c.start, c.end)), ',')"
    base = "filter(spans, c -> c.base)"
    counts = [F.expr(f"cast(size(filter(spans, c -> c.base and c.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(F.expr(joined(base)), 256).alias("base_sha256"), F.expr(joined("spans")).alias("spans"))
