"""Personal data by candidates and boosted trees.

Base spans are those that four strict rules find (email, ip, card, phone); they always stay. Generators of high recall
propose further spans, which overlap and are often wrong: addresses with written-out or bracketed signs, loose addresses,
every window of neighbouring groups of a run of digits, addresses of four parts with odd signs, IPv6. A candidate's
features are its format (lengths, groups, signs, checksum, ranges) and its context (neighbouring characters, cue words
before and after it, words that speak against it). Boosted trees give a probability, which is calibrated on candidates
that they haven't seen; each kind's threshold is the least at which precision there surely reaches PRECISION. Candidates
above it are taken, the most probable first, where they overlap none that was taken and no base span.

There are no labels of personal data, so examples come from the corpus: base spans with their contexts are positives, as
they are and in disguises that the rules don't see (signs written out, brackets, other separators, no country code), with
and without a cue word; everything else that the generators propose in these contexts is a negative, and so are dates,
versions, amounts, and numbers of orders, planted in such contexts. Fitted on a bounded sample: of each kind, at most
EXAMPLES base spans and as many other candidates, those with the least hashes of all in the corpus. Without any base
span in the corpus there are no examples, and base spans are all that is found.

Null texts are empty and have no spans. Very long texts are read whole; the work is linear in their length. Offsets are
code points, ends exclusive. Repeated rows each get their row; an empty table gives none. Ids of any kind will do. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import random
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .trees import Boosted, threshold
from .work import Work

KINDS = ("email", "ip", "card", "phone")
#: Base spans, and other candidates, of each kind that the trees are fitted on at most.
EXAMPLES = 600
#: What the lower bound of a kind's precision must reach on candidates held out.
PRECISION = 0.9
#: Characters of context on either side.
NEAR = 48

Span = tuple[int, str, int]  # start, kind, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match begins where a run of digits does
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        low = m.end() if m else at + 1
        if m:
            yield start, m.end()
        at = text.find("@", low)


def base_spans(text: str) -> list[Span]:
    """The spans of the strict rules, by start and kind. Each kind's are the leftmost that don't overlap."""
    out = [(a, "email", b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if text.count(".") > 2:
            out += [(m.start(), "ip", m.end()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) < 4 for p in m[0].split("."))]
        out += [(m.start(), "card", m.end()) for m in _CARD.finditer(text) if m.end() - m.start() > 11 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(m.start(), "phone", m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


# Generators. Each is linear in the text: what an anchor can reach is bounded.
_OPEN, _SHUT = r"[\[({<]", r"[\])}>]"
_ANCHOR = re.compile(rf"{_OPEN}\s?(?:at|AT|At|dot|DOT|Dot|@|\.)\s?{_SHUT}|\s(?:dot|DOT|Dot)\s|\s@\s|@")
_AT = rf"(?:\s?{_OPEN}\s?(?:at|AT|At|@)\s?{_SHUT}\s?|\s(?:at|AT|At|@)\s|\s?@\s?)"
_DOT = rf"(?:\s?{_OPEN}\s?(?:dot|DOT|Dot|\.)\s?{_SHUT}\s?|\s(?:dot|DOT|Dot|\.)\s|\.)"
_SPELLED = re.compile(rf"[\w%+-]{{1,32}}(?:{_DOT}[\w%+-]{{1,32}}){{0,3}}{_AT}[\w-]{{1,32}}(?:{_DOT}[\w-]{{1,32}}){{0,4}}")
_RUN = re.compile(r"[+(]?[0-9](?:[\x20 ().,/_-]{0,3}[0-9]){6,}")
_GROUP = re.compile(r"[0-9]+")
_QUAD = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:\s?{_OPEN}?\s?[.,]\s?{_SHUT}?\s?[0-9]{{1,3}}){{3}}(?![0-9])")
_SIX = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?:::?[0-9A-Fa-f]{1,4}){2,7}(?:::)?(?![0-9A-Za-z:])")
_REACH = 100


def candidates(text: str) -> list[Span]:
    """Spans that may be personal data, overlapping ones too, in order and without base spans' own."""
    out: set[Span] = set()
    low = 0
    for m in _ANCHOR.finditer(text):
        if m.start() < low:
            continue
        near = max(0, m.start() - _REACH)
        low = m.end() + _REACH
        out.update((near + x.start(), "email", near + x.end()) for x in _SPELLED.finditer(text[near : low + _REACH]))
    if _DIGIT.search(text):
        for m in _RUN.finditer(text):
            groups = [(m.start() + g.start(), m.start() + g.end()) for g in _GROUP.finditer(m[0])]
            for i, (start, _) in enumerate(groups):
                n = 0
                for j in range(i, min(i + 8, len(groups))):
                    n += groups[j][1] - groups[j][0]
                    if n > 19:
                        break
                    begin = start - 1 if start > m.start() and text[start - 1] in "+(" or i == 0 and m[0][0] in "+(" else start
                    if 7 <= n <= 15:
                        out.add((begin, "phone", groups[j][1]))
                    if 12 <= n <= 19:
                        out.add((start, "card", groups[j][1]))
        out.update((m.start(), "ip", m.end()) for m in _QUAD.finditer(text))
        if text.count(":") > 2:
            out.update((m.start(), "ip", m.end()) for m in _SIX.finditer(text))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


# Cue words of the four languages of the tables.
_CUES = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|reach|adresse|correo|courriel|schreib|kontakt|contacto)"),
    "ip": re.compile(r"(?i)\b(?:ip|ipv4|ipv6|host|server|address|servidor|serveur|adresse|addr)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|tarjeta|carte|karte|kredit|pay|paid|pan)"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|telefon|telephone|call|mobile|cell|fax|ring|sms|whatsapp|llama|appel|anruf|ruf|numero|nummer)"),
}
_AGAINST = re.compile(r"(?i)\b(?:order|invoice|version|release|build|date|isbn|issn|serial|total|price|page|section|id|ref|bestellung|pedido|commande|year|line|ticket|sku)\b|[$€£#%]")
_WRITTEN = re.compile(r"(?i)\bat\b|\bdot\b|[\[({<]\s?[@.]\s?[\])}>]")


def _kind_of(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in ".,;:!?" else 5


def features(before: str, kind: str, span: str, after: str) -> list[float]:
    """Format and context of a span. before and after: the NEAR characters around it, or fewer at the ends of the text."""
    digits, groups = _digits(span), [len(g) for g in _GROUP.findall(span)] or [0]
    parts = [int(g) for g in _GROUP.findall(span) if len(g) < 6]
    last = re.split(r"[^A-Za-z]+", span)[-1]
    two = [p for p in parts if p < 100]
    return [
        *[float(kind == k) for k in KINDS], len(span), len(digits), sum(c.isalpha() for c in span), len(groups), groups[0], groups[-1], max(groups), min(groups),
        span.count("-"), span.count("."), sum(c.isspace() for c in span), span.count("(") + span.count(")"), float(span[0] == "+"), float(span[0] == "("), span.count("/"), span.count(","), span.count(":"),
        float("@" in span), float(len(digits) > 11 and luhn(digits)), float(len(parts) == 4 and max(parts) < 256), len(set(digits)) / max(len(digits), 1),
        sum(1900 <= p < 2100 for p in parts), float(len(two) > 1 and max(two[:2]) < 32), len(_WRITTEN.findall(span)), len(last), float(1 < len(last) < 7), sum(c in "abcdefABCDEF" for c in span),
        _kind_of(before[-1:]), _kind_of(before[-2:-1]), _kind_of(after[:1]), _kind_of(after[1:2]), *[float(bool(_CUES[k].search(before[-32:]))) for k in KINDS], float(bool(_CUES[kind].search(before))),
        float(bool(_CUES[kind].search(after[:24]))), float(bool(_AGAINST.search(before[-24:]))), float(bool(_AGAINST.search(after[:8]))), float(before[-2:].strip()[-1:] == "+"), sum(c.isdigit() for c in before[-8:]), sum(c.isdigit() for c in after[:8]),
    ]


def _around(text: str, start: int, end: int) -> tuple[str, str, str]:
    return text[max(0, start - NEAR) : start], text[start:end], text[end : end + NEAR]


# Examples.
_SIGNS = ((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" AT ", " DOT "), ("[at]", "."), (" @ ", " . "), ("@", "[.]"), (" (at) ", "."))
_BEFORE = {
    "email": ("email: ", "mail me at ", "contact ", "write to ", "e-mail ", "correo: ", "courriel ", "kontakt: "),
    "ip": ("ip ", "host ", "from address ", "server "),
    "card": ("card ", "credit card number ", "visa ", "tarjeta ", "carte ", "paid with "),
    "phone": ("call ", "phone: ", "tel ", "mobile ", "fax: ", "telefon ", "reach me on "),
}
_DECOYS = (
    "20{a:02d}-{m:02d}-{d:02d} {h:02d}:{a:02d}:{m:02d}", "{d:02d}/{m:02d}/19{a:02d} {h:02d}:{m:02d}", "order {n:08d}", "order number {n:08d}{n:08d}", "invoice {n:010d}", "version {m}.{d}.{h}.{a}{n}", "release 2.{m}.{n}.{d}", "${m},{n:03d},{n:03d}.{a:02d}",
    "ISBN 978-{m}-{n:04d}-{a:02d}-{d}", "pages {n} - {n}{m}", "total {n},{n} {n}", "{h:02d}:{m:02d}:{d:02d}", "ticket {n:012d}", "serial {n:04d}-{n:04d}-{n:04d}-{n:04d}", "{n:08d}{n:09d}", "ref {a:02d}.{n}.{n}.{n}", "meet at noon . then", "look at it dot com", "all at once dot", "{a} {d} {m} {h} {n}",
)


_ENDS = ("com", "org", "net", "de", "fr", "es", "io", "edu", "info", "co.uk")


def made_up(kind: str, r: random.Random) -> str:
    """A span of the kind as its rule has it, unlike those of the corpus."""
    word = lambda a, b: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(a, b)))
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    if kind == "email":
        name = r.choice((word(3, 9), f"{word(2, 7)}.{word(3, 8)}", f"{word(3, 7)}{r.randrange(100)}", f"{word(1, 4)}_{word(3, 6)}"))
        return f"{name}@{r.choice(('', word(2, 5) + '.'))}{word(3, 9)}.{r.choice(_ENDS)}"
    if kind == "ip":
        return ".".join(str(r.choice((r.randrange(256), r.randrange(256), r.randrange(20), 0, 1, 10, 192, 168))) for _ in range(4))
    if kind == "card":
        d = r.choice(("4", "51", "55", "6011", "37"))
        d += number((14 if d == "37" else 15) - len(d))
        return next(d + c for c in "0123456789" if luhn(d + c))
    code = r.choice(("1", "44", "49", "33", "34", "351", "7"))
    d = number(12 - len(code) - r.randrange(3))
    return f"+{code} " + r.choice((f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:2]} {d[2:6]} {d[6:]}", f"{d[:3]} {d[3:6]} {d[6:]}", d))


def disguises(kind: str, span: str, r: random.Random) -> list[str]:
    """A base span in forms that the rules of its kind don't see, and in others that they do."""
    if kind == "email":
        name, _, host = span.partition("@")
        return [name + a + host.replace(".", d) for a, d in r.sample(_SIGNS, 3)] + [name.replace(".", " dot ") + " at " + host.replace(".", " dot ")]
    if kind == "ip":
        six = ":".join(f"{r.randrange(1, 65536):x}" for _ in range(8))
        return [span.replace(".", "[.]"), span.replace(".", " . "), r.choice((six, "fe80::" + six[-9:].lstrip(":"), "2001:db8::" + six.split(":")[0]))]
    d = _digits(span)
    if kind == "card":
        s = r.choice((".", " - ", "/", "_", "  "))
        return [s.join(d[i : i + 4] for i in range(0, len(d), 4)), r.choice((" ", "-")).join(d[i : i + 4] for i in range(0, len(d), 4))]
    own, whole = d[-10:], span.lstrip("+")
    if len(own) < 10:
        return ["00" + d, d[-7:-4] + "-" + d[-4:]]
    a, b, c = own[:3], own[3:6], own[6:]
    return [r.choice((f"({a}) {b}-{c}", f"({a}){b}-{c}")), r.choice((f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}")), r.choice((f"1-{a}-{b}-{c}", f"00{d}", f"0{a} {b}{c}", "00" + whole)), r.choice((f"{b}-{c}", f"+{d[:1]} / {a} / {b}{c}"))]


def _rows(text: str, truth: set[Span]) -> Iterator[tuple[list[float], float, int]]:
    for a, k, b in candidates(text):
        yield features(_around(text, a, b)[0], k, text[a:b], text[b : b + NEAR]), float((a, k, b) in truth), KINDS.index(k)


def examples(found: list[tuple[int, int, str, str, str]], seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels, kinds and contexts' numbers of the examples made from (label, kind, before, span, after)."""
    r, rows = random.Random(seed), []
    for n, (label, kind, before, span, after) in enumerate(found):
        k = KINDS[kind]
        if not label:
            rows.append((features(before, k, span, after), 0.0, kind, n))
            continue
        other = made_up(k, r)
        for form in [span, *disguises(k, span, r), other, *disguises(k, other, r)]:
            cue = r.choice(_BEFORE[k]) if r.random() < 0.5 else ""
            text, at = f"{before}{cue}{form}{after}", len(before) + len(cue)
            rows += [(*x, n) for x in _rows(text, {(at, k, at + len(form))})]
        for form in r.sample(_DECOYS, 4):
            put = form.format(a=r.randrange(60), m=r.randrange(1, 13), d=r.randrange(1, 29), h=r.randrange(24), n=r.randrange(1, 10 ** r.randrange(1, 8)))
            rows += [(*x, n) for x in _rows(f"{before}{put}{after}", set())]
    x, y, kinds, groups = ([row[i] for row in rows] for i in range(4))
    return np.array(x, np.float64), np.array(y), np.array(kinds, np.int64), np.array(groups, np.int64)


class Finder:
    """Trees and thresholds; without trees, base spans only."""

    def __init__(self, trees: Boosted | None = None, least: dict[str, float] | None = None):
        self.trees, self.least = trees, least or {}

    @classmethod
    def fit(cls, found: list[tuple[int, int, str, str, str]], precision: float = PRECISION) -> "Finder":
        if not any(label for label, *_ in found):
            return cls()
        x, y, kinds, groups = examples(found)
        unseen = groups % 3 == 2  # whole contexts
        if not (y[unseen].any() and y[~unseen].any()):
            return cls()
        trees = Boosted().fit(x[~unseen], y[~unseen])
        trees.calibrate(x[unseen], y[unseen])
        p = trees.probability(x[unseen])
        cuts = {k: threshold(p[kinds[unseen] == i], y[unseen][kinds[unseen] == i], precision) for i, k in enumerate(KINDS)}
        return cls(trees, {k: c for k, c in cuts.items() if c is not None})

    def added(self, texts: list[str | None], base: list[list[Span]]) -> list[list[tuple[float, Span]]]:
        """For each text the spans above their thresholds that overlap neither a base span nor one another, with probabilities."""
        rows, where, out = [], [], [[] for _ in texts]
        if self.trees is None:
            return out
        for n, (t, own) in enumerate(zip(texts, base)):
            spans = [s for s in candidates(t or "") if s[1] in self.least]
            for s in _free(spans, own):
                before, span, after = _around(t, s[0], s[2])
                rows.append(features(before, s[1], span, after))
                where.append((n, s))
        for i in range(0, len(rows), 1 << 14):
            for p, (n, s) in zip(self.trees.probability(np.array(rows[i : i + (1 << 14)])).tolist(), where[i : i + (1 << 14)]):
                if p >= self.least[s[1]]:
                    out[n].append((p, s))
        return [_best(x) for x in out]


def _free(spans: list[Span], taken: list[Span]) -> list[Span]:
    """The spans that overlap none of those taken; both in order of their starts."""
    if not taken:
        return spans
    starts = np.array([s[0] for s in taken])
    reach = np.maximum.accumulate([s[2] for s in taken])
    return [s for s in spans if (i := int(np.searchsorted(starts, s[2], "left"))) == 0 or reach[i - 1] <= s[0]]


def _best(found: list[tuple[float, Span]]) -> list[tuple[float, Span]]:
    """The most probable first, then the longest, then the first, as far as none overlaps one taken before."""
    taken: list[tuple[float, Span]] = []
    for p, s in sorted(found, key=lambda x: (-round(x[0], 9), x[1][0] - x[1][2], x[1][0], KINDS.index(x[1][1]))):
        # neighbours only, as spans are short: kept in order of their starts
        i = int(np.searchsorted([t[1][0] for t in taken], s[0])) if taken else 0
        if (i == 0 or taken[i - 1][1][2] <= s[0]) and (i == len(taken) or s[2] <= taken[i][1][0]):
            taken.insert(i, (p, s))
    return taken


def gather(docs: DataFrame, most: int = EXAMPLES, work: Work | None = None) -> list[tuple[int, int, str, str, str]]:
    """(label, kind, before, span, after) of base spans (1) and of other candidates (0) of all texts: of each kind and label those with the least hashes."""

    def pick(batches):
        heaps: dict[tuple[int, int], list] = {}
        for b in batches:
            for text in b.column(0):
                t = text.as_py() or ""
                base = base_spans(t)
                for label, spans in ((1, base), (0, _free(candidates(t), base) if "@" in t or _DIGIT.search(t) or "dot" in t else [])):
                    for a, k, e in spans:
                        around = _around(t, a, e)
                        h = -int.from_bytes(hashlib.blake2b("\0".join((k, *around)).encode("utf-8", "replace"), digest_size=7).digest(), "big")
                        heap = heaps.setdefault((label, KINDS.index(k)), [])
                        if len(heap) < most or h > heap[0][0]:
                            if all(h != x[0] for x in heap):
                                (heapq.heappush if len(heap) < most else heapq.heapreplace)(heap, (h, around))
        rows = [(label, k, -h, *around) for (label, k), heap in heaps.items() for h, around in heap]
        types = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string())
        names = ["label", "kind", "h", "before", "span", "after"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    rows = docs.where("text is not null").select("text").mapInArrow(pick, "label int, kind int, h long, before string, span string, after string")
    rows = rows.dropDuplicates(["label", "kind", "h"])
    rows = (work or Work(docs.sparkSession)).save(rows, "examples")  # of each task, ``most`` of each kind and label
    parts = [rows.where((F.col("label") == label) & (F.col("kind") == k)).orderBy("h").limit(most) for label in (1, 0) for k in range(len(KINDS))]
    got = reduce(DataFrame.unionAll, parts).collect()
    return [(r.label, r.kind, r.before, r.span, r.after) for r in sorted(got, key=lambda r: (-r.label, r.kind, r.h))]


def find(docs: DataFrame, finder: Finder) -> DataFrame:
    """(doc_id, base, spans): strings of the base spans and of all spans of each text (doc_id, text)."""

    def search(batches):
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            base = [base_spans(t) for t in texts]
            more = finder.added(texts, base)
            every = [sorted([*own, *(s for _, s in new)], key=lambda s: (s[0], KINDS.index(s[1]))) for own, new in zip(base, more)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([joined(s) for s in x], pa.string()) for x in (base, every)]], ["doc_id", "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(search, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base string, spans string")


def redact(docs: DataFrame, finder: Finder) -> DataFrame:
    """The documents (text, ...) with each span as ``[KIND]``; of spans that overlap, the first one's kind stands for all."""

    def mask(batches):
        at = None
        for b in batches:
            at = b.schema.get_field_index("text") if at is None else at
            texts = [t.as_py() for t in b.column(at)]
            base = [base_spans(t or "") for t in texts]
            out = []
            for t, own, new in zip(texts, base, finder.added(texts, base)):
                parts, low = [], 0
                for a, k, e in sorted([*own, *(s for _, s in new)], key=lambda s: (s[0], KINDS.index(s[1]))):
                    if a >= low:
                        parts += [t[low:a], f"[{k.upper()}]"]
                    low = max(low, e)
                out.append("".join([*parts, t[low:]]) if parts else t)
            columns = list(b.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return docs.mapInArrow(mask, docs.schema)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, Finder.fit(gather(docs)))
    counts = [F.regexp_count("base", F.lit(f"{k}:")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


QUERIES = {"op12_pii": op12_pii}
SQL: dict[str, str] = {}
