"""Personal data: fixed patterns, and spans that a character BiLSTM-CRF adds to them.

The tagger learns from labelled spans: base spans in a bounded sample of documents, and the same
values rewritten as people write them to evade patterns ("name (at) host", "555 123 4567").
Text is cut into overlapping windows. Each kind of span holds a digit, an @ or "(at)", so windows
with none of these are all outside by definition; every other window is decoded. A character's
tag is taken from the window in whose middle it lies best, and spans are read from the whole
text's tags, so that a span over a window's edge is one span.

Defined results: null and empty text have no spans; repeated rows are scanned alike; the work is
linear in a text's length; with no labelled span at all nothing is added to the base.
"""

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from memlake.llm import rows, spans, tagger

KINDS = ("email", "ip", "card", "phone")
#: Length of a window and distance between windows, in characters.
WINDOW, STRIDE = 64, 32
#: Bound on the documents from which labelled spans are taken.
TRAIN_ROWS = 800
#: Bound on the windows that are trained on.
TRAIN_WINDOWS = 2400
#: An added span has at least so many digits; an email an @ or "at" and a dot instead.
LEAST_DIGITS = {"ip": 4, "card": 14, "phone": 10}
MOST_DIGITS = {"ip": 12, "card": 19, "phone": 15}
AT = re.compile(r"[\x20(\[]at[\x20)\]]")


def base(text: str) -> tuple[dict[str, list], dict[str, list]]:
    """Base spans by kind, and by kind the matches that failed their checks."""
    ip, not_ip = spans.ips(text)
    card, not_card = spans.cards(text)
    phone, not_phone = spans.phones(text)
    good = {"email": spans.emails(text), "ip": ip, "card": card, "phone": phone}
    return good, {"email": [], "ip": not_ip, "card": not_card, "phone": not_phone}


def _rewritten(kind: str, value: str, r) -> str:
    """A value as written to evade patterns."""
    if kind == "email":
        name, host = value.split("@", 1)
        form = r.integers(4)
        if form == 0:
            return f"{name} (at) {host}"
        if form == 1:
            return f"{name} [at] {host.replace('.', ' [dot] ')}"
        if form == 2:
            return f"{name} at {host.replace('.', ' dot ')}"
        return f"{name} @ {host}"
    digits = re.sub(r"[^0-9]", "", value)
    if kind == "ip":
        return value.replace(".", ("[.]", " . ", "(.)")[r.integers(3)])
    if kind == "card":
        mark = (".", "/", "_")[r.integers(3)]
        return mark.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    last = digits[-10:]
    return (f"({last[:3]}) {last[3:6]}-{last[6:]}", f"{last[:3]}-{last[3:6]}-{last[6:]}",
            f"{last[:3]}.{last[3:6]}.{last[6:]}", f"tel {last[:3]} {last[3:6]} {last[6:]}")[r.integers(4)]


def labelled(texts: list[str], windows: int = TRAIN_WINDOWS, seed: int = 0) -> list[tuple[str, list]]:
    """Labelled windows: (text, [(kind, start, end)]). Half have a rewritten value in their middle,
    a quarter the value as it is, a quarter none."""
    r = np.random.default_rng(seed)
    plain, values = [], {k: [] for k in KINDS}
    for t in texts:
        found, bad = base(t)
        for k in KINDS:
            values[k] += [(t, s, e) for s, e in found[k]]
        at = int(r.integers(max(1, len(t) - WINDOW)))
        plain.append(t[at:at + WINDOW])
        plain += [t[max(0, s - 20):e + 20][:WINDOW] for k in KINDS for s, e in bad[k][:2]]
    kinds = [k for k in KINDS if values[k]]
    if not kinds or not plain:
        return []
    out = []
    for i in range(windows):
        if i % 4 == 3:
            out.append((plain[int(r.integers(len(plain)))], None))
            continue
        kind = kinds[i // 4 % len(kinds)]
        t, s, e = values[kind][int(r.integers(len(values[kind])))]
        value = t[s:e] if i % 4 == 2 else _rewritten(kind, t[s:e], r)
        value = value[:WINDOW - 8]
        left = int(r.integers(0, WINDOW - len(value) - 2))
        before = t[max(0, s - left):s]
        out.append(((before + value + t[e:])[:WINDOW], [(kind, len(before), len(before) + len(value))]))
    # what else the base finds in a window is labelled too
    done = []
    for t, own in out:
        own = own or []
        found, _ = base(t)
        own += [(k, s, e) for k in KINDS for s, e in found[k]
                if not spans.overlaps([(a, b) for _, a, b in own], s, e)]
        done.append((t, own))
    return done


def fit(texts: list[str], seed: int = 0, epochs: int = 6) -> dict | None:
    """Weights of the tagger, or None where there is nothing to learn from."""
    examples = labelled(texts, seed=seed)
    if not examples:
        return None
    x = np.zeros((len(examples), WINDOW), np.int16)
    y = np.zeros((len(examples), WINDOW), np.int64)
    for i, (t, own) in enumerate(examples):
        x[i, :len(t)] = tagger.symbols(spans.codes(t))
        for kind, s, e in own:
            y[i, s:e] = 2 + 2 * KINDS.index(kind)
            y[i, s] -= 1
    return tagger.train(x, y, 1 + 2 * len(KINDS), epochs=epochs, seed=seed)


def _marked(code: np.ndarray, text: str) -> np.ndarray:
    """Which characters can be part of what makes a span: digits, @, and "at" set apart."""
    hit = ((code >= 48) & (code <= 57)) | (code == 64)
    if "at" in text:
        for m in re.finditer(r"[(\[]at[)\]]|\x20at\x20(?=\S+\x20dot\x20)", text):
            hit[m.start():m.end()] = True
    return hit


def tagged(texts: list[str], weights: dict, batch: int = 1024) -> list[np.ndarray]:
    """Tags of all characters of whole texts, reconciled from overlapping windows."""
    codes = [spans.codes(t) for t in texts]
    tags = [np.zeros(len(c), np.int8) for c in codes]
    best = [np.full(len(c), -1, np.int16) for c in codes]
    where = []
    for i, c in enumerate(codes):
        at = np.flatnonzero(_marked(c, texts[i]))
        if len(at):  # windows k with k * STRIDE <= position < k * STRIDE + WINDOW
            last = at // STRIDE
            near = np.unique(np.concatenate([last - j for j in range(WINDOW // STRIDE)]))
            where += [(i, int(k) * STRIDE) for k in near if k >= 0]
    middle = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]).astype(np.int16)
    for at in range(0, len(where), batch):
        some = where[at:at + batch]
        x = np.zeros((len(some), WINDOW), np.int16)
        for j, (i, s) in enumerate(some):
            piece = codes[i][s:s + WINDOW]
            x[j, :len(piece)] = tagger.symbols(piece)
        y = tagger.decode(x, weights)
        for j, (i, s) in enumerate(some):
            n = min(WINDOW, len(codes[i]) - s)
            here = middle[:n].copy()
            if s == 0:
                here[:WINDOW // 2] = WINDOW  # the text's edge is no window's edge
            better = here > best[i][s:s + n]
            tags[i][s:s + n][better] = y[j, :n][better]
            best[i][s:s + n][better] = here[better]
    return tags


def read(tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans in a row of tags: runs of one kind, a new one at each beginning."""
    kind = (tags.astype(np.int64) + 1) // 2
    cut = np.flatnonzero((np.diff(kind, prepend=0) != 0) | ((tags > 0) & (tags % 2 == 1)))
    ends = np.append(cut[1:], len(tags))
    return [(KINDS[kind[s] - 1], int(s), int(e)) for s, e in zip(cut, ends) if kind[s]]


def _plausible(kind: str, value: str) -> bool:
    if kind == "email":
        return ("@" in value or bool(AT.search(value))) and ("." in value or "dot" in value)
    digits = sum(c in "0123456789" for c in value)
    if not LEAST_DIGITS[kind] <= digits <= MOST_DIGITS[kind]:
        return False
    return kind != "card" or spans.luhn(re.sub(r"[^0-9]", "", value))


def find(texts: list[str], weights: dict | None) -> list[tuple[dict, dict]]:
    """Per text the base spans and the added ones. Added ones are trimmed, plausible, and overlap
    neither a base span nor a match of their kind that the base's own checks refused."""
    out = []
    more = tagged(texts, weights) if weights else [None] * len(texts)
    for t, tags in zip(texts, more):
        found, bad = base(t)
        taken = [s for k in KINDS for s in found[k]]
        added = {k: [] for k in KINDS}
        for kind, s, e in read(tags) if tags is not None and tags.any() else ():
            while s < e and t[s] in " ,;:\n":
                s += 1
            while e > s and t[e - 1] in " .,;:\n":
                e -= 1
            if _plausible(kind, t[s:e]) and not spans.overlaps(taken + bad[kind], s, e):
                added[kind].append((s, e))
        out.append((found, added))
    return out


def training_texts(docs: DataFrame, rows_most: int = TRAIN_ROWS) -> list[str]:
    """About so many texts with a digit run or an @, chosen by a hash of doc_id, twice as many at most."""
    some = docs.where(F.col("text").rlike(r"[0-9]{3}|@"))
    share = rows_most / max(1, some.count())
    point = F.pmod(F.xxhash64("doc_id", F.lit("personal")), F.lit(1 << 30)) / float(1 << 30)
    return sorted(r[0] for r in some.where(point < share).select("text").limit(2 * rows_most).collect())


def scan(docs: DataFrame, weights: dict | None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added per row of docs."""

    def make():
        def work(cols):
            found = find(rows.texts(cols["text"]), weights)
            return {f"n_{k}": [len(b[k]) for b, _ in found] for k in KINDS} | {
                "doc_id": cols["doc_id"],
                "base_sha256": [spans.sha256(spans.joined(b, KINDS)) for b, _ in found],
                "spans": [spans.joined({k: b[k] + a[k] for k in KINDS}, KINDS) for b, a in found],
                "n_added": [sum(map(len, a.values())) for _, a in found]}

        return work

    return rows.map_batches(
        docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"),
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
        "base_sha256 string, spans string, n_added long", make)
