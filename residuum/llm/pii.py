"""Personal data by weak supervision.

Fixed patterns give the base spans. Wider candidates (the base spans, and what lies beside them: numbers that
stand next to each other, phones without a plus, written-out addresses, colon notation) are voted on by six labelers:
pattern, checksum, gazetteer, grouping, isolation and context. Expectation-maximisation over the counts of vote patterns,
taken from all candidates of all rows, estimates how reliable each labeler is for each kind; a logistic span
classifier trained on its posteriors decides which candidates are added.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from residuum.session import stage

ROWS = 512
#: Kinds as listed.
KINDS = ["email", "ip", "card", "phone"]
LABELERS = ["pattern", "checksum", "gazetteer", "grouping", "isolation", "context"]
#: A candidate is added from this probability on.
ADD = 0.6
#: What the labelers are taken to know before counting, for every kind: P(yes | personal), P(no | personal), P(yes | not), P(no | not).
PRIOR = {"pattern": (.9, .05, .3, .5), "checksum": (.98, .01, .1, .85), "gazetteer": (.6, .2, .3, .5), "grouping": (.6, .1, .3, .4), "isolation": (.9, .05, .5, .4), "context": (.3, .05, .1, .3)}
#: Weight of that belief, as a share of the candidates of the kind.
BELIEF = 0.25
ROUNDS, FIT_STEPS, FIT_RATE, DECAY = 60, 400, 1.0, 1e-4

#: Gazetteers: ends of host names, first digits of card issuers (as ranges of four digits), calling codes, reserved first bytes.
ENDS = "com org net edu gov mil int info biz io co me de fr es it nl be at ch uk ie pt pl se no dk fi cz hu ro gr eu us ca mx br ar cl pe jp cn kr in au nz za ru ua tr il".split()
ISSUERS = [(3000, 3059), (3400, 3499), (3528, 3589), (3600, 3699), (3700, 3799), (3800, 3999), (4000, 4999), (5100, 5599), (6011, 6011), (6221, 6229), (6440, 6599), (2221, 2720)]
CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
RESERVED = {0, *range(224, 256)}
#: Words that announce a kind, and words that announce something else with digits in it.
CUES = {"email": "mail email courriel correo contact write schreiben écrire kontakt contacto", "ip": "ip host server address adresse dirección client login peer",
        "card": "card visa mastercard amex credit debit karte kreditkarte carte tarjeta crédito", "phone": "phone tel telephone call fax mobile cell telefon anrufen téléphone appeler teléfono llamar"}
CUES = {kind: set(words.split()) for kind, words in CUES.items()}
OTHER = set("version release order invoice isbn issn page section chapter id ticket serial rechnung seite kapitel bestellung commande facture chapitre pedido factura página total sum".split())

# The four patterns. Each is written so that a failed start is never tried again inside the same run.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9]+(?:[ -][0-9]+)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# Candidates beside them.
GROUPED = re.compile(r"\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])")
BARE = re.compile(r"(?<![0-9.(+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
WRITTEN = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT|@)[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(](?:dot|DOT|\.)[\])] ?[A-Za-z0-9-]{1,63}){1,4}")
COLONS = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
GROUPS = ([4, 4, 4, 4], [4, 6, 5], [4, 4, 4, 4, 3])


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def only_digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the pattern, from one @ to the next."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in LOCAL:
            begin -= 1
        host = HOST.match(text, at + 1) if begin < at else None
        if host:
            out.append((begin, host.end()))
        last = host.end() if host else at + 1
        at = text.find("@", last)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, stop) by start, then kind as listed."""
    out = [(a, 0, b) for a, b in emails(text)]
    if re.search("[0-9]", text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if _card(m[0])]
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(only_digits(m[0])) <= 15]
    return sorted(out)


def _octet(digits: str) -> bool:
    rest = digits.lstrip("0")
    return len(rest) < 4 and int(rest or 0) < 256


def _card(text: str) -> bool:
    # A number beyond 37 characters has more than 19 digits.
    return len(text) < 38 and 14 <= len(d := only_digits(text)) <= 19 and luhn(d)


def _card_parts(text: str, at: int) -> Iterator[tuple[int, int]]:
    """Numbers inside a run of digit groups: solid ones, and neighbouring groups in a usual card layout."""
    groups = [(m.start(), m.end()) for m in re.finditer("[0-9]+", text)]
    sizes = [b - a for a, b in groups]
    i = 0
    while i < len(groups):
        layout = next((g for g in GROUPS if sizes[i:i + len(g)] == g), None)
        if layout:
            yield at + groups[i][0], at + groups[i + len(layout) - 1][1]
            i += len(layout)
        else:
            if 14 <= sizes[i] <= 19:
                yield at + groups[i][0], at + groups[i][1]
            i += 1


def _phones(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Grouped phones up to the next base span of another kind, and bare ones outside them."""
    fixed, out, last = [a for a, k, _ in base if k != 3], [], 0
    at = text.find("+")
    while at >= 0:
        limit = bisect.bisect_right(fixed, at)
        m = GROUPED.match(text, at, fixed[limit] if limit < len(fixed) else len(text)) if at >= last else None
        if m:
            out.append(m.span())
            last = m.end()
        at = text.find("+", at + 1)
    known = sorted(out + [(a, b) for a, k, b in base if k == 3])
    for m in BARE.finditer(text):
        i = bisect.bisect_left(known, (m.end(), 0))
        if not i or known[i - 1][1] <= m.start():
            out.append(m.span())
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out = set(base)
    if re.search("[0-9]", text):
        out |= {(m.start(), 1, m.end()) for m in IP.finditer(text) if len(m[0]) <= 24}
        for m in CARD.finditer(text):
            if len(m[0]) >= 14:
                out |= {(a, 2, b) for a, b in _card_parts(m[0], m.start())}
        phones = _phones(text, base)
        out |= {(a, 3, b) for a, b in phones}
        if text.count(":") >= 7:
            out |= {(m.start(), 1, m.end()) for m in COLONS.finditer(text)}
    if "at)" in text or "at]" in text or "AT)" in text or "AT]" in text or "@)" in text or "@]" in text:
        out |= {(m.start(), 0, m.end()) for m in WRITTEN.finditer(text)}
    return sorted(out)


def _vote(yes: bool, no: bool = False) -> str:
    return "+" if yes else "-" if no else "0"


def votes(text: str, start: int, kind: int, stop: int, is_base: bool) -> str:
    """Six letters, one a labeler: + for personal, - against, 0 without an opinion."""
    value = text[start:stop]
    digits = only_digits(value) if kind else ""
    before, after = text[start - 1:start], text[stop:stop + 1]
    near = [w.strip(".,;:!?()\"'").lower() for w in text[max(0, start - 40):start].split()[-3:]]
    cue = _vote(any(w in CUES[KINDS[kind]] for w in near), any(w in OTHER for w in near))
    free = _vote(not (before.isalnum() or after.isalnum() or before == "_"), True)
    if kind == 0:
        host = re.split(r"[@)\]]", value, maxsplit=1)[1] if re.search(r"[@)\]]", value) else ""
        labels = re.findall("[A-Za-z0-9-]+", re.sub(r"[\[(](?:dot|DOT)[\])]", ".", host))
        good = all(len(x) < 64 and x[0] != "-" and x[-1] != "-" for x in labels)
        return "".join([_vote(is_base, False), _vote(good, True), _vote(bool(labels) and labels[-1].lower() in ENDS, bool(labels) and labels[-1].isdigit()), _vote("@" in value), free, cue])
    if kind == 1 and ":" in value:
        return "".join(["+", "+", "0", "0", free, cue])
    if kind == 1:
        parts = value.split(".")
        fits = all(len(p) < 4 and int(p) < 256 for p in parts)
        plain = all(p == str(int(p)) for p in parts) if fits else False
        return "".join([_vote(is_base, True), _vote(fits, True), _vote(False, fits and int(parts[0]) in RESERVED), _vote(plain, True), _vote(free == "+" and before != "." and after != ".", True), cue])
    if kind == 2:
        sizes = [len(g) for g in re.findall("[0-9]+", value)]
        known = any(a <= int(digits[:4]) <= b for a, b in ISSUERS)
        return "".join([_vote(is_base, False), _vote(luhn(digits), True), _vote(known, False), _vote(sizes in GROUPS or len(sizes) == 1, True), free, cue])
    national = not value.startswith("+")
    code = not national and any(digits.startswith(c) for c in CODES)
    shaped = bool(GROUPED.fullmatch(value) or BARE.fullmatch(value))
    return "".join([_vote(is_base), _vote(10 <= len(digits) <= 15, True), _vote(code), _vote(shaped, True), free, cue])


def shape(value: str) -> str:
    """Length and separators of a value, as two letters."""
    n = len(only_digits(value))
    size = "s" if n < 10 else "m" if n < 14 else "l" if n < 17 else "x"
    seps = {c for c in value if c in " -.()"}
    return size + ("n" if not seps else "o" if len(seps) == 1 else "v")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of start, kind, stop) and candidates (start, kind, stop, cell); ``cell`` is all that is learned from."""
    spans = "array<struct<start:int,kind:int,stop:int>>"
    found = "array<struct<start:int,kind:int,stop:int,cell:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())])
        more = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("cell", pa.string())])
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                bases, wider = [], []
                for value in batch.column(1):
                    text = value.as_py() or ""
                    base = base_spans(text)
                    own = set(base)
                    bases.append([{"start": a, "kind": k, "stop": b} for a, k, b in base])
                    wider.append([{"start": a, "kind": k, "stop": b, "cell": f"{k}{votes(text, a, k, b, (a, k, b) in own)}{shape(text[a:b])}"} for a, k, b in candidates(text, base)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, pa.list_(span)), pa.array(wider, pa.list_(more))], ["doc_id", "base", "candidates"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {spans}, candidates {found}")


def reliabilities(cells: dict[str, int]) -> tuple[dict[str, float], dict[str, np.ndarray]]:
    """Expectation-maximisation of one kind: the posterior of every cell, and [personal or not, vote] a labeler."""
    names, total = sorted(cells), sum(cells.values())
    n = np.array([cells[c] for c in names], float)
    seen = np.array([["+-0".index(v) for v in c[1:1 + len(LABELERS)]] for c in names])
    belief = np.array([[[p[0], p[1], 1 - p[0] - p[1]], [p[2], p[3], 1 - p[2] - p[3]]] for p in (PRIOR[x] for x in LABELERS)])
    theta, share = belief.copy(), 0.5
    for _ in range(ROUNDS):
        log = np.log(theta[np.arange(len(LABELERS))[:, None], :, seen.T]).sum(axis=0) + np.log([share, 1 - share])
        post = 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -60, 60)))
        weight = np.stack([n * post, n * (1 - post)])
        for l in range(len(LABELERS)):
            for v in range(3):
                theta[l, :, v] = (weight * (seen[:, l] == v)).sum(axis=1) + BELIEF * total * belief[l, :, v]
        theta /= theta.sum(axis=2, keepdims=True)
        share = (weight[0].sum() + 1) / (total + 2)
    return dict(zip(names, post)), dict(zip(LABELERS, theta))


def features(cell: str) -> list[str]:
    kind = cell[0]
    return [f"{kind}", *[f"{kind}{l}{v}" for l, v in enumerate(cell[1:1 + len(LABELERS)])], f"{kind}{cell[-2:]}"]


def classifier(cells: dict[str, int], labels: dict[str, float]) -> dict[str, float]:
    """Weights of a logistic model on the features of a cell, fitted to the posteriors weighted by counts."""
    index = {f: i for i, f in enumerate(sorted({f for c in cells for f in features(c)}))}
    x = np.zeros((len(cells), len(index)))
    for row, c in enumerate(cells):
        x[row, [index[f] for f in features(c)]] = 1
    per_kind = {k: sum(n for c, n in cells.items() if c[0] == k) for k in {c[0] for c in cells}}
    n = np.array([v / per_kind[c[0]] for c, v in cells.items()]) ** 0.5
    n, y, w = n / n.sum(), np.array([labels[c] for c in cells]), np.zeros(len(index))
    momentum = np.zeros(len(index))
    for _ in range(FIT_STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        momentum = 0.9 * momentum + x.T @ (n * (p - y)) + DECAY * w
        w -= FIT_RATE * momentum
    return {f: float(w[i]) for f, i in index.items()}


def probability(model: dict[str, float], cell: str) -> float:
    return float(1 / (1 + np.exp(-sum(model.get(f, 0.0) for f in features(cell)))))


def train(found: DataFrame) -> tuple[dict[str, float], dict[str, dict[str, np.ndarray]]]:
    """The span classifier and the reliabilities of the labelers of every kind, from all rows of ``scan``.

    Only counts of cells reach the driver: a cell is a kind, six votes of three values and a shape of twelve,
    so there are at most 4 * 729 * 12, however long the table is.
    """
    counts = found.select(F.explode("candidates.cell").alias("cell")).groupBy("cell").count()
    cells = {r["cell"]: r["count"] for r in counts.collect()}
    labels, known = {}, {}
    for k, kind in enumerate(KINDS):
        own = {c: n for c, n in cells.items() if c[0] == str(k)}
        if own:
            post, known[kind] = reliabilities(own)
            labels |= post
    return (classifier(cells, labels) if cells else {}), known


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


class Taken:
    """Places that spans cover; base spans of different kinds may overlap and are merged."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.stops: list[int] = []
        for a, b in sorted(spans):
            if self.stops and a < self.stops[-1]:
                self.stops[-1] = max(b, self.stops[-1])
            else:
                self.starts.append(a)
                self.stops.append(b)

    def free(self, a: int, b: int) -> bool:
        i = bisect.bisect_left(self.starts, b)
        return not i or self.stops[i - 1] <= a

    def add(self, a: int, b: int) -> None:
        i = bisect.bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.stops.insert(i, b)


def find_personal(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Places are code points, ends exclusive. Null and empty texts have no spans; very long texts are scanned
    whole in linear time; repeated rows and ids are scanned each on its own; an empty table gives no rows; further
    columns are ignored. An added span touches no base span and no other added one (the likeliest go first, then the earliest).
    """
    found = stage(scan(docs))
    model, _ = train(found)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            rows = []
            for base, wider in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans = [(s["start"], s["kind"], s["stop"]) for s in base]
                taken = Taken([(a, b) for a, _, b in spans])
                for c in wider:
                    if c["cell"] not in known:
                        known[c["cell"]] = probability(model, c["cell"])
                free = sorted(((-known[c["cell"]], c["start"], c["kind"], c["stop"]) for c in wider if known[c["cell"]] >= ADD))
                added = []
                for _, a, k, b in free:
                    if taken.free(a, b):
                        added.append((a, k, b))
                        taken.add(a, b)
                counts = [sum(k == i for _, k, _ in spans) for i in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(_listed(spans).encode()).hexdigest(), _listed(sorted(spans + added)), len(added)))
            columns = list(zip(*rows)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]],
                                             ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return found.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
