"""Personal data: fixed patterns, extended by a skip-chain conditional random field.

Base spans come from patterns with checks. Tokens that hold a digit or an at-sign are the nodes of a
random field over labels (none, email, ip, card, phone); all other tokens have the label none for
certain, so they cut the chain and need no node. A base span, and a run of neighbouring number tokens
that repeats a number of the document, give their nodes one key from all their digits. Neighbouring nodes share a chain potential; nodes
whose keys agree (the same address, or the same last digits, whatever the separators) share a skip
potential with one hub for each key of a document, however far apart they are; a base span of the key
fixes the label of its hub. Loopy message passing runs over all documents of a slice at once, until no
message changes. Nodes inside base spans keep their label; a node that gets a label from them or from
its own shape adds a span.

The weights are trained by pseudo-likelihood on a bounded sample of documents whose labels are the
base spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1
#: The patterns of the contract. Where the pattern could be read from several starts of one
#: run of digits, only the first start can match, which the look-behind states.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
CORE = re.compile(r"[A-Za-z0-9+(].*[A-Za-z0-9)]", re.S)
DIGITS = re.compile(r"[^0-9]+")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long"

Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each at-sign outward."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """All base spans by start, then kind."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    for m in ADDRESS.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 4 and int(p or 0) < 256 for p in parts):
            out.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = DIGITS.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(DIGITS.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


class Graph(NamedTuple):
    """Nodes of several documents, then hubs: features, labels fixed by base spans, edges (chain and skip), places.

    A hub stands for a key of a document: skip edges join it to every node of the key, and a base span
    of the key fixes its label. ``pairs`` are consecutive occurrences of a key, for training.
    """

    features: np.ndarray  # node x feature
    fixed: np.ndarray  # label of a base span, 0 otherwise
    chain: np.ndarray  # edges, two columns
    skip: np.ndarray
    places: list[tuple[int, int, int]]  # document, start, end; none for hubs
    pairs: np.ndarray = np.zeros((0, 2), np.int64)
    starts: set[int] | frozenset[int] = frozenset()  # nodes at which a run of number tokens begins


FEATURES = 18


def shape(core: str, digits: str) -> list[bool]:
    n = len(digits)
    parts = core.split(".")
    return [
        True, "@" in core, core.count("@") == 1 and "." in core.rpartition("@")[2], n == 0, 1 <= n <= 3, 4 <= n <= 6, 7 <= n <= 9, 10 <= n <= 13, 14 <= n <= 19, n > 19,
        core.startswith("+"), core.startswith("("), "-" in core, len(parts) == 4 and all(p.isdigit() and len(p) < 4 for p in parts), n == len(core), any(c.isalpha() for c in core), 14 <= n <= 19 and luhn(digits), len(core) > 24,
    ]


def key_of(core: str, digits: str) -> str | None:
    """What similar tokens share: the address in lower case, else the last seven digits or more of a number."""
    if "@" in core:
        return core.lower()
    if len(digits) >= 7 and not any(c.isalpha() for c in core):
        return digits if len(digits) > 13 or core.count(".") == 3 else digits[-7:]
    return None


def graph(texts: list[str | None], spans: list[list[Span]]) -> Graph:
    features, fixed, chain, pairs, hubs, places, starts = [], [], [], [], [], [], set()
    for doc, (text, own) in enumerate(zip(texts, spans)):
        last_end, at, first, words, linked, covered = -1, 0, len(places), [], [], {}
        for token in TOKEN.finditer(text or ""):
            core = CORE.search(token[0])
            start, end = (token.start() + core.start(), token.start() + core.end()) if core else token.span()
            word = text[start:end]
            digits = DIGITS.sub("", word)
            while at < len(own) and own[at][1] <= start:
                at += 1
            node = len(places)
            around = [s for s in own[at : at + 4] if s[0] < end and s[1] > start]
            for s in around:
                covered.setdefault(s, []).append(node)
            features.append(shape(word, digits))
            fixed.append(around[0][2] + 1 if around else 0)
            places.append((doc, start, end))
            words.append((word, digits))
            linked.append(last_end >= 0 and text[last_end : token.start()].isspace())
            if linked[-1]:
                chain.append((node - 1, node))
            last_end = token.end()
        keys, begun = occurrences(text or "", first, words, linked, fixed, covered)
        starts |= begun
        for found in keys.values():
            if len(found) > 1:
                pairs += [(x[-1], y[-1]) for x, y in zip(found, found[1:])]
                hubs.append([node for nodes in found for node in nodes])
    skip = [(node, len(places) + hub) for hub, nodes in enumerate(hubs) for node in nodes]
    hub_labels = [next((fixed[node] for node in nodes if fixed[node]), 0) for nodes in hubs]
    return Graph(
        np.concatenate([np.array(features, np.float64).reshape(-1, FEATURES), np.zeros((len(hubs), FEATURES))]), np.array(fixed + hub_labels, np.int64),
        np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2), places, np.array(pairs, np.int64).reshape(-1, 2), starts,
    )


def occurrences(text: str, first: int, words: list[tuple[str, str]], linked: list[bool], fixed: list[int], covered: dict[Span, list[int]]) -> tuple[dict[str, list[list[int]]], set[int]]:
    """The nodes of every occurrence of each key of a document, in text order, and the first nodes of runs.

    A key comes from a base span, a token, or a run of neighbouring number tokens whose digits end a
    number that the document holds as a base span or a token.
    """
    found: list[tuple[str, list[int]]] = []
    numbers: dict[str, set[str]] = {}
    spanned = {}  # node: keys of its base spans

    def add(key: str, nodes: list[int], word: str, digits: str) -> None:
        found.append((key, nodes))
        if "@" not in word and not (word.count(".") == 3 and len(digits) < 14):
            numbers.setdefault(key, set()).add(digits)

    for (a, b, _), nodes in covered.items():
        digits = DIGITS.sub("", text[a:b])
        key = key_of(text[a:b], digits)
        if key is not None:
            add(key, nodes, text[a:b], digits)
            for node in nodes:
                spanned.setdefault(node, set()).add(key)
    for node, (word, digits) in enumerate(words, first):
        key = key_of(word, digits)
        if key is not None and key not in spanned.get(node, ()):
            add(key, [node], word, digits)
    starts = set()
    free = first  # the first node that no run holds
    for end in range(first + 1, first + len(words)) if numbers else ():
        digits, best, node = "", None, end
        while node >= free and not fixed[node] and "@" not in words[node - first][0] and not any(ch.isalpha() for ch in words[node - first][0]):
            digits = words[node - first][1] + digits
            if len(digits) > 19:
                break
            if node < end and len(digits) >= 7:
                key = digits if len(digits) > 13 else digits[-7:]
                if any(n.endswith(digits) for n in numbers.get(key, ())):
                    best = key, node
            if not linked[node - first]:
                break
            node -= 1
        if best is not None:
            found.append((best[0], list(range(best[1], end + 1))))
            starts.add(best[1])
            free = end + 1
    keys: dict[str, list[list[int]]] = {}
    for key, nodes in sorted(found, key=lambda f: f[1][0]):
        keys.setdefault(key, []).append(nodes)
    return keys, starts


class Weights(NamedTuple):
    unary: np.ndarray  # feature x label
    chain: np.ndarray  # label x label
    skip: np.ndarray


def train(g: Graph, steps: int = 1500, rate: float = 1.0, decay: float = 2e-4) -> Weights:
    """Pseudo-likelihood: every node given its neighbours' labels, by full gradient steps.

    Each node counts again with its own features hidden, and once more with its chain hidden too, so
    that the chain and skip potentials learn what they alone tell; the third kind weighs as much as the first.
    """
    n = len(g.places)
    g = g._replace(features=g.features[:n], fixed=g.fixed[:n])
    eye = np.eye(LABELS)
    inputs = [g.features, *(np.zeros((n, LABELS)) for _ in range(3))]  # features, left, right, skip neighbours
    np.add.at(inputs[1], g.chain[:, 1], eye[g.fixed[g.chain[:, 0]]])
    np.add.at(inputs[2], g.chain[:, 0], eye[g.fixed[g.chain[:, 1]]])
    np.add.at(inputs[3], g.pairs[:, 1], eye[g.fixed[g.pairs[:, 0]]])
    np.add.at(inputs[3], g.pairs[:, 0], eye[g.fixed[g.pairs[:, 1]]])
    w = Weights(np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)))
    if not n:
        return w
    hidden = [np.zeros_like(x) for x in inputs]
    inputs = [np.concatenate([x, h if i < 1 else x, h if i < 3 else x]) for i, (x, h) in enumerate(zip(inputs, hidden))]
    linked = inputs[3].any(1) | (np.arange(3 * n) < 2 * n)  # a node without skip edges tells nothing in its third copy
    inputs, wanted = [x[linked] for x in inputs], np.tile(eye[g.fixed], (3, 1))[linked]
    weight = np.where(np.arange(len(wanted)) < 2 * n, 1.0, n / max(1, len(wanted) - 2 * n))[:, None] / (3 * n)
    for _ in range(steps):
        score = inputs[0] @ w.unary + inputs[1] @ w.chain + inputs[2] @ w.chain.T + inputs[3] @ w.skip
        p = np.exp(score - score.max(1, keepdims=True))
        error = (wanted - p / p.sum(1, keepdims=True)) * weight
        skip = inputs[3].T @ error
        w = Weights(
            w.unary + rate * (inputs[0].T @ error - decay * w.unary),
            w.chain + rate * (inputs[1].T @ error + (inputs[2].T @ error).T - decay * w.chain),
            w.skip + rate * ((skip + skip.T) / 2 - decay * w.skip),
        )
    return w


def labels(g: Graph, w: Weights, rounds: int = 1000, damping: float = 0.3, tolerance: float = 1e-4) -> np.ndarray:
    """The most likely label of each node after loopy message passing (sum-product).

    A message is computed again as long as it or one that it depends on changes by more than
    ``tolerance``. Damping grows every fifty rounds, so that cycles settle; ``rounds`` only ends a
    field that does not settle even so.
    """
    n = len(g.fixed)
    unary = g.features @ w.unary
    held = g.fixed > 0
    unary[held] = -1e6  # far below any sum of messages
    unary[held, g.fixed[held]] = 0.0
    edges = np.concatenate([g.chain, g.chain[:, ::-1], g.skip, g.skip[:, ::-1]])
    c, s = len(g.chain), len(g.skip)
    back = np.concatenate([np.arange(c) + c, np.arange(c), np.arange(s) + 2 * c + s, np.arange(s) + 2 * c])
    potentials = np.stack([w.chain, w.chain.T, w.skip, w.skip.T])
    kind = np.repeat(np.arange(4), [c, c, s, s])
    sent = np.zeros((len(edges), LABELS))
    belief = unary.copy()
    active = np.arange(len(edges))
    for turn in range(rounds):
        if not len(active):
            break
        keep = min(0.95, damping + 0.05 * (turn // 50))
        before = belief[edges[active, 0]] - sent[back[active]]
        joint = before[:, :, None] + potentials[kind[active]]
        top = joint.max(1)
        new = top + np.log(np.exp(joint - top[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        change = (1 - keep) * (new - sent[active])
        sent[active] += change
        np.add.at(belief, edges[active, 1], change)
        moved = active[np.abs(change).max(1) > tolerance]
        touched = np.zeros(n, bool)
        touched[edges[moved, 1]] = True
        again = touched[edges[:, 0]]
        again[moved] = True
        active = np.flatnonzero(again)
    return belief.argmax(1) if n else np.zeros(0, np.int64)


def plausible(word: str, kind: int) -> bool:
    """What an added span must look like, so that potentials alone never make one of stray numbers."""
    n = len(DIGITS.sub("", word))
    if kind == 0:
        return "." in word.rpartition("@")[2] and "@" in word
    if kind == 1:
        return word.count(".") == 3 and 4 <= n <= 12
    return 13 <= n <= 19 if kind == 2 else 7 <= n <= 15


def added_spans(g: Graph, found: np.ndarray, spans: list[list[Span]], texts: list[str | None]) -> list[list[Span]]:
    """Spans of nodes with a label outside base spans; the parts of a phone or card number join across white space."""
    out: list[list[Span]] = [[] for _ in spans]
    joined = {(int(a), int(b)) for a, b in g.chain}
    last = None
    n = len(g.places)
    for node in np.flatnonzero((found[:n] > 0) & (g.fixed[:n] == 0)):
        doc, start, end = g.places[node]
        kind = int(found[node]) - 1
        if any(a < end and b > start for a, b, _ in spans[doc]):
            continue
        mine = out[doc]
        parts = kind == KINDS.index("phone") or kind == KINDS.index("card") and len(DIGITS.sub("", texts[doc][start:end])) < 13
        if mine and last == node - 1 and node not in g.starts and (last, node) in joined and mine[-1][2] == kind and parts:
            mine[-1] = (mine[-1][0], end, kind)
        else:
            mine.append((start, end, kind))
        last = node
    return [[s for s in own if plausible(text[s[0] : s[1]], s[2])] if own else own for own, text in zip(out, texts)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def fit(docs: DataFrame, sample_rows: int = 2000, longest: int = 40_000) -> Weights:
    """Weights from about ``sample_rows`` documents, spread by hash, of at most ``longest`` characters each."""
    n = max(1, docs.count())
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(n)) < sample_rows
    sample = docs.filter(spread & (F.length("text") <= longest)).select(F.col("text").cast("string")).limit(2 * sample_rows)
    texts = sorted(r[0] for r in sample.toLocalIterator())
    return train(graph(texts, [base_spans(t) for t in texts]))


def find_personal_data(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """doc_id, numbers of base spans, base and all spans as text (kind:start:end in code points), n_added.

    One row per row of ``docs``. NULL and empty texts have no spans. Repeated rows give repeated
    results; a NULL doc_id stays NULL; further columns are ignored; an empty table gives an empty
    result. Base spans of different kinds may overlap; added spans overlap no base span.
    """
    w = fit(docs) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in slices(batch):
                base = [base_spans(t) if t else [] for t in texts]
                g = graph(texts, base)
                more = added_spans(g, labels(g, w), base, texts)
                counts = [[sum(k == kind for _, _, k in own) for own in base] for kind in range(len(KINDS))]
                columns = [ids, *counts, [written(b) for b in base], [written(b + m) for b, m in zip(base, more)], [len(m) for m in more]]
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
                names = ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "n_added"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
