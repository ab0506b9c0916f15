"""Personal data by weak supervision (operator 11).

Four kinds: email, ip, card, phone. Base patterns settle the plain cases, and stay. Wider patterns propose further
spans: obfuscated addresses (``name [at] host dot org``), version 6 addresses, card numbers among other digits or with
dots, phone numbers without a country code; and what the base patterns matched and their tests refused.

Labelers vote on every span, for, against or not at all: regex labelers on its form, gazetteers (top-level domains, card
issuers, dialling prefixes, reserved values) and context labelers (cue words in front, what it is glued to, neighbours
that are personal data). Votes are counted as patterns (kind, base or not, votes), at most 3^8 of them a kind whatever the
corpus. Expectation-maximisation over these counts estimates each labeler's reliability, how often it votes which way on
personal data and on the rest; base spans are known to be personal data. The estimate gives every pattern a probability,
and with it as target a logistic regression on form, context words and votes is trained on a bounded sample of
looks of spans (``sample`` a kind, the least hashes): the final classifier, which judges every proposed span.
A span is taken if the classifier is for it and its votes are, too.

All patterns read a text in time linear in its length: an address is looked for from its ``@``, digits from the start
of their run.

Defined results: null and empty texts hold no spans; repeated rows are judged alike; proposed spans that overlap a base
span, or a likelier one, give way (ties: the earlier one, then the order of kinds); without any span there is no
model and nothing to judge; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import ipaddress
import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanworks.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
# The base patterns, from the character that each match must hold or begin with.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Wider patterns, all of bounded length.
AT = re.compile(r"(?i)[\[({<]\s{0,3}(?:at|@|arroba)\s{0,3}[\])}>]|(?<=\s)(?:at|arroba)\s(?=\s{0,3}[a-z0-9-]{1,63}\s{1,3}dot\s)")
DOT = r"(?:\s{0,3}[\[({<]\s{0,3}(?:dot|\.)\s{0,3}[\])}>]\s{0,3}|\.|\s{1,3}dot\s{1,3})"
HIDDEN = re.compile(rf"(?i)\s{{0,3}}[a-z0-9-]{{1,63}}(?:{DOT}[a-z0-9-]{{2,63}}){{1,5}}")
IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
DOTTED = re.compile(r"(?<![\w.])[0-9]{4}(?:[./][0-9]{4}){3}(?![\w]|\.[0-9])")
NATIONAL = re.compile(r"(?<![\w+.,/-])(?:\([0-9]{2,5}\)[ -]?|[0-9]{2,5}[ ./-])[0-9]{2,8}(?:[ ./-][0-9]{2,5}){0,4}(?![\w]|[./-][0-9])")
# Gazetteers and cue words.
TOP_LEVEL = frozenset("com org net edu gov mil int info biz io dev app co me de at ch fr be es pt it nl uk ie us ca au nz in jp kr cn br mx ar cl se no dk fi pl cz ru eu".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|30|36|38|6011|65|35")
DIALLING = re.compile(r"00[1-9]|0[1-9]|1[ .-]?\(?[2-9]|\([0-9]{3}\)|[2-9][0-9]{2}[ .-]")
CUES = {
    "email": frozenset("mail email e-mail correo courriel kontakt contact contacto write reach schreiben escribe".split()),
    "ip": frozenset("ip ipv4 ipv6 host server address adresse dirección client ping login".split()),
    "card": frozenset("card visa mastercard amex credit debit karte kreditkarte carte tarjeta pan payment".split()),
    "phone": frozenset("tel phone telephone telefon téléphone teléfono call fax mobile cell mobil handy rufen appelez llame whatsapp sms".split())
}
AGAINST = frozenset(
    "version v isbn issn order invoice bestellung rechnung commande facture pedido factura ticket issue sku part serial token key hash id no nr"
    " page pages seite página total price preis prix precio eur usd date datum fecha build release figure table section chapter".split()
)
LABELERS = ("form", "test", "reserved", "gazetteer", "cue", "against", "glued", "neighbour")
WORDS = re.compile(r"[^\W_]+(?:-[^\W_]+)?")
#: How often other numbers pass a kind's test at most (a check digit is right by chance once in ten).
CHANCE = {"card": 0.15}
#: Places of hashed features, code points of context on either side, distance of neighbours.
WIDTH, AROUND, NEAR = 512, 48, 120


@dataclass
class Span:
    kind: str
    start: int
    end: int
    base: bool
    votes: str = ""  # one character a labeler: + for, - against, 0 neither


def luhn(digits: str) -> bool:
    """The check digit of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The base patterns' matches that pass their tests, by kind and start; and those that fail."""
    found, failed = [], []
    last = at = 0
    while (at := text.find("@", at)) >= 0:
        m = DOMAIN.match(text, at)
        start = at
        while m and start > last and text[start - 1] in LOCAL:
            start -= 1
        if m and start < at:
            found.append(Span("email", start, m.end(), True))
            last = at = m.end()
        else:
            # nothing before the mark can be reached over it
            last = at = at + 1
    for m in IP.finditer(text):
        good = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))
        (found if good else failed).append(Span("ip", m.start(), m.end(), good))
    for m in CARD.finditer(text):
        digits = digits_of(m.group())
        good = 13 <= len(digits) <= 19 and luhn(digits)
        if good or len(digits) >= 13:
            (found if good else failed).append(Span("card", m.start(), m.end(), good))
    for m in PHONE.finditer(text):
        good = 9 <= len(digits_of(m.group())) <= 15
        if good or len(m.group()) <= 40:
            (found if good else failed).append(Span("phone", m.start(), m.end(), good))
    return found, failed


def shortened(text: str, s: Span, starts: list[int]) -> int:
    """Where a phone number ends that ran into what follows it: before the next base span, at a blank, with 9 to 13
    digits; 0 if there is no such place."""
    k = bisect.bisect_right(starts, s.start)
    limit = min(s.end, s.start + 40, starts[k] if k < len(starts) else s.end)
    for end in range(limit, s.start, -1):
        if "0" <= text[end - 1] <= "9" and (end == len(text) or not text[end].isalnum()) and (end == limit or text[end] in " ."):
            n = len(digits_of(text[s.start : end]))
            if n < 9:
                return 0
            if n <= 13:
                return end
    return 0


def proposed(text: str, found: list[Span], failed: list[Span]) -> list[Span]:
    """Further spans that may be personal data."""
    out = []
    starts = sorted(s.start for s in found)
    for m in AT.finditer(text):
        host = HIDDEN.match(text, m.end())
        end = m.start()
        while end > 0 and m.start() - end < 3 and text[end - 1].isspace():
            end -= 1
        start = end
        while start > 0 and end - start < 64 and (text[start - 1].isalnum() or text[start - 1] in LOCAL):
            start -= 1
        if host and start < end:
            out.append(Span("email", start, host.end(), False))
    for m in IP6.finditer(text):
        try:
            ipaddress.IPv6Address(m.group())
        except ValueError:
            continue
        if m.group() != "::":
            out.append(Span("ip", m.start(), m.end(), False))
    for s in failed:
        if s.kind != "card":
            out.append(s)
            if s.kind == "phone" and (end := shortened(text, s, starts)):
                out.append(Span("phone", s.start, end, False))
            continue
        # runs of digit groups that pass the test, and single groups as long as a card number can be
        groups = [(g.start() + s.start, g.end() + s.start) for g in re.finditer("[0-9]+", text[s.start : s.end])]
        done = s.start
        for i, (a, _) in enumerate(groups):
            if a < done:
                continue
            size, best = 0, None
            for j in range(i, min(i + 19, len(groups))):
                size += groups[j][1] - groups[j][0]
                if size > 19:
                    break
                if size >= 13 and (luhn(digits_of(text[a : groups[j][1]])) or (j == i and best is None)):
                    best = groups[j][1]
            if best:
                out.append(Span("card", a, best, False))
                done = best
    out += [Span("card", m.start(), m.end(), False) for m in DOTTED.finditer(text)]
    out += [Span("phone", m.start(), m.end(), False) for m in NATIONAL.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return out


def around(text: str, s: Span) -> tuple[list[str], list[str]]:
    """The words in front of a span, nearest first, and those behind it."""
    before = text[max(0, s.start - AROUND) : s.start].lower().rpartition("\n")[2]
    after = text[s.end : s.end + AROUND].lower().partition("\n")[0]
    return WORDS.findall(before)[::-1][:4], WORDS.findall(after)[:3]


def vote(text: str, s: Span, others: list[Span]) -> str:
    """The labelers' votes on a span."""
    span = text[s.start : s.end]
    digits = digits_of(span)
    before, _ = around(text, s)
    shape = [len(g) for g in re.findall("[0-9]+", span)]
    say = lambda yes, no=False: "+" if yes else "-" if no else "0"
    if s.kind == "email":
        host = re.sub(r"(?i)\s*[\[({<]?\s*\bdot\b\s*[\])}>]?\s*", ".", re.split(r"(?i)@|[\[({<]?\s*\b(?:at|arroba)\b\s*[\])}>]?", span)[-1]).strip().lower()
        name = re.split(r"[@\s\[({<]", span)[0]
        form, test = say(re.search(r"@|[\[({<]", span)), say("." in host, "." not in host)
        reserved = say(False, name.lower() in {"user", "name", "someone", "you", "noreply", "no-reply"} or host in {"localhost", "domain.com"})
        known = say(host.rpartition(".")[2] in TOP_LEVEL, True)
    elif s.kind == "ip":
        parts = [int(p.lstrip("0") or 0) if len(p.lstrip("0")) < 5 else 99999 for p in span.split(".")] if "." in span and ":" not in span else []
        form = say(":" in span and span.count(":") >= 3 or (parts and not any(len(p) > 1 and p[0] == "0" for p in span.split("."))), True)
        test = say(not parts or max(parts) <= 255, True)
        reserved = say(False, span in {"::1", "0.0.0.0"} or parts[:1] == [127] or bool(parts) and max(parts) < 10)
        known = say(len(parts) == 4 and max(parts) > 31)
    elif s.kind == "card":
        form = say(shape in ([4, 4, 4, 4], [4, 6, 5], [4, 6, 4]) or len(shape) == 1, True)
        test = say(13 <= len(digits) <= 19 and luhn(digits), True)
        reserved = say(False, len(set(digits)) < 4 or digits in "01234567890123456789" * 2)
        known = say(ISSUERS.match(digits), True)
    else:
        form = say("(" in span or shape[-2:] in ([3, 4], [2, 2], [4, 4]) or len(shape) == 2 and shape[0] in (3, 4, 5), True)
        test = say(9 <= len(digits) <= 15, True)
        date = re.search(r"(?<![0-9])(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-]|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}(?![0-9])", span)
        reserved = say(False, bool(date) or len(set(digits)) < 3)
        known = say(span.startswith("+") or DIALLING.match(span), True)
    cue = say(any(w in CUES[s.kind] for w in before))
    against = say(False, any(w in AGAINST for w in before[:2]))
    glued = say(False, (s.start > 0 and text[s.start - 1].isalnum()) or (s.end < len(text) and text[s.end].isalnum()))
    near = say(any(o.kind != s.kind and o.base and o.start < s.end + NEAR and s.start < o.end + NEAR for o in others))
    return form + test + reserved + known + cue + against + glued + near


def spans_of(text: str | None) -> list[Span]:
    """All spans of a text with their votes: base spans by kind and start, then proposed ones that don't overlap them."""
    if not text or not re.search(r"[0-9@:]|(?i:\b(?:at|arroba)\b)", text):
        return []
    found, failed = base_spans(text)
    more = proposed(text, found, failed)
    if found and more:
        taken = sorted((s.start, s.end) for s in found)
        begin, reach = [a for a, _ in taken], list(itertools.accumulate((b for _, b in taken), max))
        more = [s for s in more if (k := bisect.bisect_left(begin, s.end)) == 0 or reach[k - 1] <= s.start]
    every = found + more
    if not every:
        return []
    # neighbours are looked for among the spans close by alone
    order = sorted(range(len(found)), key=lambda i: found[i].start)
    starts = [found[i].start for i in order]
    for s in every:
        low, high = bisect.bisect_left(starts, s.start - 4 * NEAR), bisect.bisect_left(starts, s.end + NEAR)
        s.votes = vote(text, s, [found[order[i]] for i in range(low, high)])
    return every


def features(text: str, s: Span) -> tuple[str, list[int]]:
    """Hashed places of what the classifier sees of a span: kind with form, context words, votes."""
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]", "9", text[s.start : min(s.end, s.start + 80)]))
    runs = re.sub(r"9{5,}", "9+", shape)
    before, after = around(text, s)
    names = [f"k={s.kind}", f"s={s.kind}:{runs}", *(f"v={s.kind}:{n}{v}" for n, v in zip(LABELERS, s.votes, strict=True) if v != "0")]
    names += [f"t={s.kind}:{runs[i : i + 3]}" for i in range(len(runs) - 2)]
    names += [f"b={s.kind}:{re.sub('[0-9]', '9', w)}" for w in before[:2]] + [f"a={s.kind}:{re.sub('[0-9]', '9', w)}" for w in after[:1]]
    return s.kind, sorted({zlib.crc32(n.encode()) % WIDTH for n in names})


SEEN = "kind string, base boolean, votes string, places array<int>"


def candidates(docs: DataFrame) -> DataFrame:
    """(kind, base, votes, places) of every span of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                rows += [(s.kind, s.base, s.votes, features(text, s)[1]) for s in spans_of(text)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.bool_(), pa.string(), pa.list_(pa.int32())), strict=True)],
                    names=["kind", "base", "votes", "places"]
                )

    return docs.select("text").mapInArrow(run, SEEN)


def reliabilities(patterns: list[tuple[str, bool, int]], chance: float = 1.0, rounds: int = 60, least: float = 2.0) -> tuple[np.ndarray, float, dict[str, float]]:
    """Expectation-maximisation over (votes, base, count) of one kind.

    Returns the labelers' votes by class (labelers x class x vote -, 0, +), the share of personal data among spans
    that aren't base, and the probability of each pattern of votes. A labeler starts as better than chance by ``least``
    counts, so the classes can't change places; what isn't personal data passes the test with at most ``chance``."""
    votes = np.array([["-0+".index(c) for c in v] for v, _, _ in patterns])
    base, n = np.array([b for _, b, _ in patterns]), np.array([float(k) for _, _, k in patterns])
    test = LABELERS.index("test")
    score = ((votes == 2).sum(axis=1) - (votes == 0).sum(axis=1)).astype(float)
    # to begin with, and only then, a majority of votes decides; a failed test weighs as much as all others
    p = np.where(base, 1.0, 1 / (1 + np.exp(-(score - 4.0 * (votes[:, test] == 0)))))
    start = np.array([[3.0, 2.0, 1.0], [1.0, 2.0, 3.0]]) * least / 2
    one_hot = np.stack([votes == k for k in range(3)], axis=2).astype(float)
    share, table = 0.5, np.zeros((len(LABELERS), 2, 3))
    for _ in range(rounds):
        for c, weight in enumerate((n * (1 - p), n * p)):
            counts = np.einsum("i,ilk->lk", weight, one_hot) + start[c]
            table[:, c] = counts / counts.sum(axis=1, keepdims=True)
        if (over := min(table[test, 0, 2], 1 - 1e-9)) > chance:
            table[test, 0] *= [(1 - chance) / (1 - over)] * 2 + [chance / over]
        share = (float((n * p)[~base].sum()) + 1) / (float(n[~base].sum()) + 2)
        log = np.log(table)
        odds = np.log(share / (1 - share)) + np.einsum("ilk,lk->i", one_hot, log[:, 1] - log[:, 0])
        p = np.where(base, 1.0, 1 / (1 + np.exp(-np.clip(odds, -50, 50))))
    return table, share, {v: float(1 / (1 + np.exp(-np.clip(o, -50, 50)))) for (v, _, _), o in zip(patterns, odds, strict=True)}


class Classifier:
    """Logistic regression on hashed places, by full gradient steps on probabilistic targets; weights sum up to 1."""

    def __init__(self, places: list[list[int]], targets: np.ndarray, share: np.ndarray, steps: int = 300, rate: float = 2.0, decay: float = 1e-4) -> None:
        rows = np.repeat(np.arange(len(places)), [len(p) for p in places])
        flat = np.fromiter(itertools.chain.from_iterable(places), np.int64, len(rows))
        self.weights, self.bias = np.zeros(WIDTH), 0.0
        scale = 1 / np.sqrt(np.bincount(flat, share[rows], WIDTH) + 1e-3)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, self.weights[flat], len(places)) + self.bias, -30, 30)))
            error = (p - targets) * share
            self.weights -= rate * scale * np.bincount(flat, error[rows], WIDTH) + decay * self.weights
            self.bias -= rate * error.sum()

    def probability(self, places: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[places].sum() + self.bias, -30, 30))))


@dataclass
class Model:
    """The classifier (None without any span), and what expectation-maximisation found: reliabilities by kind, and the
    probability of each pattern of votes."""

    classifier: Classifier | None
    reliability: dict[str, np.ndarray]
    probability: dict[tuple[str, str], float]

    def of(self, text: str, s: Span) -> float:
        """How likely a proposed span is personal data: what the classifier says, but no more than its votes do."""
        if self.classifier is None:
            return 0.0
        kind, places = features(text, s)
        return min(self.classifier.probability(places), self.probability.get((kind, s.votes), 0.0))


def fit(docs: DataFrame, sample: int = 4_000) -> Model:
    """Learn from the votes of all texts, and from at most sample looks of spans of each kind, half of them of base spans.

    A look is what the classifier sees of a span; it counts as often as it occurs, however many spans share it."""
    looks = materialize(candidates(docs).groupBy("kind", "base", "votes", "places").agg(F.count("*").alias("n")), "looks")
    patterns = looks.groupBy("kind", "base", "votes").agg(F.sum("n").alias("n"), F.count("*").alias("looks")).orderBy("kind", "base", "votes").collect()  # at most 2 * 3^8 a kind
    reliability, probability = {}, {}
    for kind in sorted({r["kind"] for r in patterns}):
        table, _, posterior = reliabilities([(r["votes"], r["base"], r["n"]) for r in patterns if r["kind"] == kind], CHANCE.get(kind, 1.0))
        reliability[kind] = table
        probability |= {(kind, v): p for v, p in posterior.items()}
    places: list[list[int]] = []
    targets: list[float] = []
    share: list[float] = []
    place = F.pmod(F.xxhash64("places", "votes"), F.lit(1 << 30))
    for kind, base in itertools.product(KINDS, (True, False)):
        found = sum(r["looks"] for r in patterns if r["kind"] == kind and r["base"] == base)
        # thinned out by the hash first, so that each task brings its share of the sample
        bound = min(1.0, 1.5 * (sample // 2) / max(1, found) + 1e-6) * (1 << 30)
        drawn = looks.where((F.col("kind") == kind) & (F.col("base") == base)).where(place <= F.lit(int(bound)))
        rows = drawn.orderBy(place, "votes", "places").limit(sample // 2).select("votes", "places", "n").collect()
        places += [list(r["places"]) for r in rows]
        targets += [1.0 if base else probability[kind, r["votes"]] for r in rows]
        total = sum(r["n"] for r in rows)
        share += [r["n"] / total for r in rows]  # base and proposed spans of each kind weigh the same
    classifier = Classifier(places, np.array(targets), np.array(share) / sum(share)) if places else None
    return Model(classifier, reliability, probability)


def chosen(text: str, every: list[Span], model: Model, least: float = 0.5) -> list[tuple[Span, float]]:
    """Base spans, and the proposed ones that the classifier takes, by kind and start."""
    out = [(s, 1.0) for s in every if s.base]
    judged = [(s, model.of(text, s)) for s in every if not s.base]
    kept: list[tuple[int, int]] = []  # in order, none over another
    for s, p in sorted(judged, key=lambda x: (-x[1], x[0].start, KINDS.index(x[0].kind), x[0].end)):
        at = bisect.bisect_left(kept, (s.end, 0))
        if p >= least and (at == 0 or kept[at - 1][1] <= s.start):
            kept.insert(at, (s.start, s.end))
            out.append((s, p))
    return sorted(out, key=lambda x: (KINDS.index(x[0].kind), x[0].start))


FOUND = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean,probability:double>>"


def detected(docs: DataFrame, model: Model | None = None, least: float = 0.5) -> DataFrame:
    """doc_id and the spans of personal data of every row, by kind and start (code points, end exclusive)."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                spans = chosen(text, every, shared.value, least) if (every := spans_of(text)) else []
                rows.append([{"kind": s.kind, "start": s.start, "end": s.end, "base": s.base, "probability": p} for s, p in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)


def digested(found: DataFrame) -> DataFrame:
    """doc_id, base spans by kind, their digest, all spans as text, and how many the method added."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["base"])
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(number, KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(spans).alias("spans"), (F.size(spans) - F.size(base)).cast("long").alias("n_added")
    )
