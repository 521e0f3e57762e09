"""Personal data by base patterns and a skip-chain conditional random field.

The base patterns find e-mail addresses, IP addresses, card and phone numbers.  The field
labels every candidate token (a word with a digit or an at sign, or the value of a secret
wherever it stands) of a document as one of those kinds, a secret, or other.  Neighbouring
candidates share a chain potential.  Tokens with the same characters, or the same long run of
digits, each share a skip potential with one variable for what they name, so all mentions of a
document are two links apart and a token repeated a thousand times has a thousand links.  Loopy
message passing carries what one mention shows to the others: a number written with its
context once is found wherever it stands bare.  Bare mentions of one name say the same thing
again, so their own scores count once together.  Base spans stay; the field adds spans.

The weights are trained piecewise on a bounded sample (``TRAIN_DOCS`` documents of at most
``TRAIN_BYTES``, by least hash), labelled by the base patterns and by assignments to secret
names.  Extraction, graph and inference cover whole texts of all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone", "secret"]
OTHER = len(KINDS)
N_LABELS = OTHER + 1
TRAIN_DOCS = 2000
TRAIN_BYTES = 20_000
ROUNDS = 200          # rounds of message passing, if a document's messages do not settle before
DAMPING = 0.3
NAME_WEIGHT = 2.0     # of a mention's link to its name, as two of them stand between two mentions
SURE = 0.9            # least marginal of an added span
SEED_WEIGHT = 8.0     # unary score of a token that a base span covers

# fixed patterns of the base kinds, written so that every search is linear in the text
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SECRET = re.compile(r"(?i)(?:token|secret|password|api_key)[ ]?[=:][ ]?[\"']?([A-Za-z0-9_/+-]{16,})")
NOT_SPACE_END = re.compile(r"[\x20\x09-\x0D]")
CANDIDATE = re.compile(r"[0-9@]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"
EDGE = ".,;:!?\"'()[]{}<>#*$%&|="
HEX = re.compile(r"[0-9a-fA-F]{20,}")
DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: an address starts where its local characters begin, or after the match before."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the base patterns in code points, by kind and start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if not CANDIDATE.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(len, DIGITS.findall(m[0]))) <= 15:
                out.append(("phone", *m.span()))
    return out


@dataclass
class Graph:
    """Candidate tokens of a batch of documents and their links."""

    doc: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    seed: list[int] = field(default_factory=list)      # label of the span that covers the token, or OTHER
    features: list[list[int]] = field(default_factory=list)
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)     # each mention and the one before, for training
    named: list[list[int]] = field(default_factory=list)          # the mentions of one name, two or more


N_FEATURES = 20


def _features(core: str, before: str) -> list[int]:
    """Numbers of the features that hold."""
    digits = sum(map(len, DIGITS.findall(core)))
    plain = core.isascii()
    only = plain and core.isdigit()
    groups = core.split(".") if plain else []
    named = before.rstrip(" =:\"'").lower().endswith(("token", "secret", "password", "api_key"))
    checks = (
        True, "@" in core, "@" in core and "." in core.rpartition("@")[2], only, digits >= 13, 9 <= digits < 13, 4 <= digits < 9, digits < 4,
        len(groups) == 4 and all(g.isdigit() for g in groups), len(groups) == 4 and all(g.isdigit() and len(g) <= 3 and int(g) <= 255 for g in groups),
        core.startswith("+"), "(" in core or ")" in core, "-" in core, HEX.fullmatch(core) is not None,
        len(core) >= 32 and not only, named, before.endswith("\""), only and 13 <= digits <= 19 and luhn(core),
        not only and core.isalnum(), before.rstrip().endswith("="),
    )
    return [n for n, ok in enumerate(checks) if ok]


def _words(text: str, secrets: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The candidate tokens of a text, in order."""
    tokens: list[tuple[int, int]] = []
    last = 0
    for m in CANDIDATE.finditer(text):
        if m.start() < last:
            continue
        start = max(last, *(text.rfind(c, last, m.start()) + 1 for c in SPACES))
        stop = NOT_SPACE_END.search(text, m.end())
        last = stop.start() if stop else len(text)
        tokens.append((start, last))
    # secrets without a digit: where they are assigned, and every other place
    plain = {text[a:b] for a, b, _ in secrets if not CANDIDATE.search(text, a, b)}
    if plain:
        held = {a for a, _ in tokens}
        for m in WORD.finditer(text):
            if m.start() not in held and (m[0].strip(EDGE) in plain or any(v[1] in plain for v in SECRET.finditer(m[0]))):
                tokens.append(m.span())
    return sorted(tokens)


def add_document(g: Graph, n: int, text: str, spans: list[tuple[str, int, int]]) -> None:
    """Add the candidate tokens of one text and their chain and skip links."""
    secrets = [(m.start(1), m.end(1), KINDS.index("secret")) for m in SECRET.finditer(text)]
    tokens = _words(text, secrets)
    if not tokens:
        return
    covered = sorted((a, b, KINDS.index(k)) for k, a, b in spans)
    covered = sorted(covered + secrets)
    same: dict[str, list[int]] = {}
    at, previous = 0, None
    for start, stop in tokens:
        core = text[start:stop].strip(EDGE)
        a = start + text[start:stop].find(core) if core else start
        b = a + len(core)
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        x, y, seed = a, b, OTHER
        for k in range(at, len(covered)):
            if covered[k][0] >= b:
                break
            if covered[k][1] > a:
                x, y, seed = covered[k]
                break
        if KINDS[seed:seed + 1] == ["secret"]:
            a, b = max(a, x), min(b, y)   # the value without the name it is assigned to
        node = len(g.doc)
        g.doc.append(n)
        g.start.append(a)
        g.end.append(b)
        g.seed.append(seed)
        g.features.append(_features(core, text[max(0, a - 24):a]))
        if previous is not None and not text[previous:start].strip(SPACES):
            g.chain.append((node - 1, node))
        previous = stop
        digits = "".join(DIGITS.findall(core))
        name = text[a:b].lower() if seed == KINDS.index("secret") else core.lower()
        if len(digits) >= 7 and not any(c.isalpha() for c in name):
            name = "#" + digits
        if len(name) >= 7:
            same.setdefault(name, []).append(node)
    for mentions in same.values():
        if len(mentions) > 1:
            g.named.append(mentions)
            g.skip += zip(mentions, mentions[1:])


@dataclass
class Model:
    unary: np.ndarray      # features x labels
    chain: np.ndarray      # labels x labels, symmetric
    skip: np.ndarray


def _matrix(g: Graph) -> np.ndarray:
    x = np.zeros((len(g.doc), N_FEATURES))
    for n, on in enumerate(g.features):
        x[n, on] = 1
    return x


def train(g: Graph, steps: int = 300) -> Model:
    """Piecewise training: a softmax for tokens, and smoothed log ratios of linked labels.

    A bare token whose twin a pattern labels is neither a kind nor other for certain, so it
    and that link are left out.
    """
    y = np.array(g.seed, np.int64)
    unsure = {n for link in g.skip for n, m in (link, link[::-1]) if y[n] == OTHER != y[m]}
    sure = [n for n in range(len(y)) if n not in unsure]
    weights = np.zeros((N_FEATURES, N_LABELS))
    if sure:
        x, target = _matrix(g)[sure], np.eye(N_LABELS)[y[sure]]
        for _ in range(steps):
            z = x @ weights
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            weights += 1.0 * (x.T @ (target - p) / len(sure) - 1e-3 * weights)
    share = (np.bincount(y, minlength=N_LABELS) + 1.0) / (len(y) + N_LABELS)

    def ratio(links: list[tuple[int, int]], prior: np.ndarray) -> np.ndarray:
        n = prior.copy()
        for a, b in links:
            n[y[a], y[b]] += 0.5
            n[y[b], y[a]] += 0.5
        return np.clip(np.log(n / n.sum() / np.outer(share, share)), -4, 4)

    # before any evidence, linked tokens of the skip chain agree
    return Model(weights, ratio(g.chain, np.outer(share, share) * 5), ratio([k for k in g.skip if not unsure & set(k)], np.diag(share) * 5 + np.outer(share, share) * 0.5))


def node_scores(g: Graph, model: Model) -> np.ndarray:
    """Own scores of all tokens and, behind them, of the names, which have none."""
    scores = np.zeros((len(g.doc) + len(g.named), N_LABELS))
    scores[:len(g.doc)] = _matrix(g) @ model.unary
    seed = np.array(g.seed, np.int64)
    for mentions in g.named:
        bare = [n for n in mentions if seed[n] == OTHER]
        scores[bare] /= max(1, len(bare))
    known = np.flatnonzero(seed != OTHER)
    scores[known, seed[known]] += SEED_WEIGHT
    return scores


def name_links(g: Graph) -> list[tuple[int, int]]:
    return [(len(g.doc) + k, n) for k, mentions in enumerate(g.named) for n in mentions]


def marginals(g: Graph, model: Model) -> np.ndarray:
    """Label marginals of all tokens by damped loopy message passing; each document stops by its own messages."""
    scores = node_scores(g, model)
    names = name_links(g)
    links = np.array(g.chain + names, np.int64).reshape(-1, 2)
    pair = np.concatenate([np.repeat(model.chain[None], len(g.chain), 0), np.repeat(NAME_WEIGHT * model.skip[None], len(names), 0)])
    of = np.concatenate([links[:, 0], links[:, 1]])
    to = np.concatenate([links[:, 1], links[:, 0]])
    pair = np.concatenate([pair, pair])
    back = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
    told = np.zeros((len(of), N_LABELS))
    doc = np.array(g.doc + [g.doc[m[0]] for m in g.named], np.int64)[of] if len(links) else np.zeros(0, np.int64)

    def beliefs() -> np.ndarray:
        return scores + np.stack([np.bincount(to, told[:, k], minlength=len(scores)) for k in range(N_LABELS)], axis=1)

    moving = np.arange(len(of))
    for _ in range(ROUNDS):
        if not len(moving):
            break
        cavity = (beliefs()[of[moving]] - told[back[moving]])[:, :, None] + pair[moving]
        top = cavity.max(axis=1)
        new = np.log(np.exp(cavity - top[:, None, :]).sum(axis=1)) + top
        new -= new.max(axis=1, keepdims=True)
        change = np.zeros(int(doc.max()) + 1)
        np.maximum.at(change, doc[moving], np.abs(new - told[moving]).max(axis=1))
        told[moving] = DAMPING * told[moving] + (1 - DAMPING) * new
        moving = moving[change[doc[moving]] >= 1e-4]
    b = (beliefs() if len(links) else scores)[:len(g.doc)]
    p = np.exp(b - b.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def find(texts: list[str], model: Model) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; all spans by kind, then start."""
    base = [base_spans(t) for t in texts]
    g = Graph()
    for n, (t, spans) in enumerate(zip(texts, base)):
        if CANDIDATE.search(t) or SECRET.search(t):
            add_document(g, n, t, spans)
    every = [list(b) for b in base]
    if g.doc:
        p = marginals(g, model)
        best = p.argmax(axis=1)
        order: dict[int, list[int]] = {}
        follows = {b for _, b in g.chain}
        for i in np.flatnonzero((best != OTHER) & (p.max(axis=1) >= SURE)).tolist():
            order.setdefault(g.doc[i], []).append(i)
        for n, nodes in order.items():
            taken = sorted((a, b) for _, a, b in base[n])
            at = 0
            for i in nodes:
                while at < len(taken) and taken[at][1] <= g.start[i]:
                    at += 1
                if at < len(taken) and taken[at][0] < g.end[i] or g.end[i] == g.start[i]:
                    continue
                kind, last = KINDS[best[i]], every[n][-1] if every[n] else None
                # a phone number's words are neighbours; a plus sign starts the next number
                if kind == "phone" and i in follows and last and last[0] == kind and last[2] == g.end[i - 1] and texts[n][g.start[i]] != "+":
                    every[n][-1] = (kind, last[1], g.end[i])
                else:
                    every[n].append((kind, g.start[i], g.end[i]))
    key = lambda s: (KINDS.index(s[0]), s[1])
    return [(sorted(b, key=key), sorted(e, key=key)) for b, e in zip(base, every)]


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
SPAN_SQL = "array<struct<kind:string,start:bigint,stop:bigint>>"


def _tag(shared, types: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find([t or "" for t in batch.column(1).to_pylist()], shared.value)
            as_rows = lambda spans: [{"kind": k, "start": a, "stop": b} for k, a, b in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([as_rows(x[i]) for x in found], SPAN) for i in range(2)]], schema=types)

    return run


def learn(docs: DataFrame, text_col: str) -> Model:
    """Train on the documents of least hash among those with a candidate token.

    The share of the hash range that holds about twice the sample is taken first, so only
    so many texts are made distinct and sorted; the sample has a fixed bound.
    """
    fit = docs.select(F.col(text_col).alias("text")).where(F.octet_length("text") <= TRAIN_BYTES).where(F.col("text").rlike("[0-9@]"))
    share = min(1.0, 2 * TRAIN_DOCS / max(1, fit.count()))
    some = fit.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = some.distinct().orderBy(F.pmod(F.xxhash64("text"), F.lit(1 << 30)), "text").limit(TRAIN_DOCS).collect()
    g = Graph()
    for n, row in enumerate(sample):
        add_document(g, n, row["text"], base_spans(row["text"]))
    return train(g)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, base spans and all spans, arrays of (kind, start, stop) in code points.

    A null text is empty and has no span.  Equal texts have equal base spans; what the field
    adds depends on one document's own tokens only.  Repeated rows and null ids give rows of
    their own.  Other columns are not read.  An empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, text_col))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType
    types = pa.schema([("id", to_arrow_type(kind)), ("base", SPAN), ("spans", SPAN)])
    out = source.mapInArrow(_tag(shared, types), f"id {kind.simpleString()}, base {SPAN_SQL}, spans {SPAN_SQL}")
    return out.toDF(id_col, "base", "spans")
