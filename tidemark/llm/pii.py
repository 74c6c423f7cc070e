"""Personal data by pattern, extended by a skip-chain conditional random field.

Base spans come from four patterns. The mentions of a document (base spans, and looser
candidates: numbers without their prefix, obfuscated addresses, repeated local parts,
names) are the nodes of a conditional random field. Neighbours in the text are joined by a
chain; mentions with the same or a similar key, however distant, share a skip potential.
Loopy sum-product gives each mention its marginal, so that a bare number that repeats a
phone number found elsewhere becomes a phone number too. Base mentions are observed.

Semantics
* Offsets are code points, ends exclusive. A null text is the empty text. Whole texts are
  read; skip edges join each mention to the one before with its key and to the last and the next observed
  one, so their number is linear in the text.
* Base spans always stay; added ones never overlap a base span or each other.
* Rows repeat as they are; columns other than the id and the text are ignored; an empty
  table gives no rows.
* The model is trained here, by pseudo-likelihood, on generated documents (``TRAIN_DOCS``).
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .work import key_and_text

KINDS = ("email", "ip", "card", "phone", "name")
LABELS = ("none", *KINDS)
#: An added span needs this marginal probability.
LEAST_MARGINAL = 0.9
BP_ROUNDS, DAMPING = 12, 0.3
NEAR = 40  # characters between neighbours on the chain
TRAIN_DOCS, TRAIN_STEPS, TRAIN_SEED = 600, 300, 7

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_NUMBER = re.compile(r"\(?[0-9](?:(?:[ .-]|\) ?| ?\(|\[\.\])?[0-9])+")
_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+ ?([\[({]at[\])}]|\bat\b|[\[({]@[\])}]) ?[A-Za-z0-9-]+(?:(?:\.| ?[\[({](?:dot|\.)[\])}] ?| dot )[A-Za-z0-9-]+)+", re.I)
_TITLE = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\b\.? ((?:[A-Z][a-z]{2,20})(?: [A-Z][a-z]{2,20})?)\b")
_CUE = re.compile(r"(call|phone|tel|telephone|mobile|cell|fax|whatsapp|card|visa|mastercard|credit|ip|host|server|address|mail|email|contact|order|isbn|version|invoice|id|no|page)[ :.#]*$", re.I)
_HAS = re.compile(r"[0-9@]|[\[({]at[\])}]|\b(?:Mr|Mrs|Ms|Dr|Prof)\b", re.I)


def luhn(digits: str) -> bool:
    values = [int(d) for d in digits]
    doubled = [2 * d - 9 * (d > 4) for d in values[-2::-2]]
    return (sum(values[-1::-2]) + sum(doubled)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: around each @ the run of local characters before it, then a domain."""
    out, after = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            after = m.end()
        at = text.find("@", max(at + 1, after))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        if len(parts) < 4:
            continue
        start = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in four):
                out.append((start, end))
            start = end + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", *s) for s in emails(text)]
    if re.search("[0-9]", text):
        found += [("ip", *s) for s in addresses(text)]
        found += [("card", *s) for s in cards(text)]
        if "+" in text:
            found += [("phone", *s) for s in phones(text)]
    return found


# --- the random field -------------------------------------------------------------------


class Node:
    __slots__ = ("start", "end", "label", "keys", "features")

    def __init__(self, start: int, end: int, label: int | None, keys: list, features: list[str]):
        self.start, self.end, self.label, self.keys, self.features = start, end, label, keys, features


def _digit_keys(digits: str) -> list:
    keys = [("all", digits)] if len(digits) >= 6 else []
    return keys + ([("tail", digits[-7:])] if len(digits) >= 7 else [])


def _shape(text: str, start: int, end: int) -> list[str]:
    word = text[start:end]
    digits = sum(map(str.isdigit, word))
    cue = _CUE.search(text, max(0, start - 24), start)
    out = ["bias", f"digits={min(digits, 20)}", "sep=" + "".join(sorted({c for c in word if c in " .-()"}))]
    out.append("cue=" + (cue.group(1).lower() if cue else ""))
    groups = [len(g) for g in re.findall("[0-9]+", word)]
    out.append("groups=" + "-".join(map(str, groups[:6])))
    return out


def mentions(text: str, base: list[tuple[str, int, int]]) -> list[Node]:
    """Base spans and candidates, in text order; candidates never overlap what was taken before."""
    # Base spans of different kinds may nest or overlap: what they cover, as intervals apart from each other.
    taken: list[tuple[int, int]] = []
    for s, e in sorted((s, e) for _, s, e in base):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    starts = [s for s, _ in taken]

    def free(s: int, e: int) -> bool:
        i = bisect.bisect_left(starts, e)
        return not i or taken[i - 1][1] <= s

    nodes, locals_ = [], set()
    for kind, s, e in base:
        word = text[s:e]
        if kind == "email":
            local = word.split("@", 1)[0].lower()
            keys = [("mail", local)]
            if len(local) >= 5 and re.search(r"[0-9._]", local[1:-1] or ""):
                locals_.add(local)
        elif kind == "ip":
            keys = [("ip", *word.split("."))]
        else:
            keys = _digit_keys(_NOT_DIGIT.sub("", word))
        nodes.append(Node(s, e, LABELS.index(kind), keys, []))

    def add(s: int, e: int, keys: list, features: list[str]) -> None:
        if free(s, e):
            i = bisect.bisect_left(starts, s)
            starts.insert(i, s)
            taken.insert(i, (s, e))
            nodes.append(Node(s, e, None, keys, features))

    for m in _AT.finditer(text) if "at" in text or "[@" in text else ():
        local = re.split(r"[ \[({]", m.group(), maxsplit=1)[0].lower()
        how = "bracket" if m.group(1)[0] in "[({" else "plain"
        add(*m.span(), [("mail", local)], ["bias", f"at={how}", "cue=" + (c.group(1).lower() if (c := _CUE.search(text, max(0, m.start() - 24), m.start())) else "")])
    if locals_:
        for m in re.finditer(r"[A-Za-z0-9][A-Za-z0-9._%+-]{3,}[A-Za-z0-9]", text):
            if m.group().lower() in locals_:
                add(*m.span(), [("mail", m.group().lower())], ["bias", "handle"])
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() >= 6:
            digits = _NOT_DIGIT.sub("", m.group())
            if "[.]" in m.group():
                add(*m.span(), [("ip", *m.group().split("[.]"))], ["bias", "defanged"])
            elif len(digits) >= 6:
                s = m.start() + (m.group()[0] == "(" and ")" not in m.group())
                add(s, m.end(), _digit_keys(digits), _shape(text, s, m.end()))
    names: list[tuple[int, int]] = [m.span(1) for m in _TITLE.finditer(text)]
    for s, e in names:
        add(s, e, [("name", w) for w in text[s:e].split()], ["bias", "title"])
    if words := {w for s, e in names for w in text[s:e].split()}:
        for m in re.finditer(r"\b[A-Z][a-z]{2,20}\b", text):
            if m.group() in words:
                add(*m.span(), [("name", m.group())], ["bias", "capital"])
    nodes.sort(key=lambda n: (n.start, n.end))
    return nodes


CHAIN, SAME, SIMILAR = 0, 1, 2


def edges(nodes: list[Node]) -> list[tuple[int, int, int]]:
    """Chain edges between neighbours; skip edges to the last mention with the same key, and to the last and the next observed one."""
    out, last, observed = [], {}, {}
    later: list[list[tuple[int, tuple]]] = [[] for _ in nodes]
    coming, nearest = {}, {}
    for i in range(len(nodes) - 1, -1, -1):
        for key in nodes[i].keys:
            # Where the next mention is the observed one, it links back itself.
            if nodes[i].label is None and key in coming and nearest[key] != coming[key]:
                later[i].append((coming[key], key))
            nearest[key] = i
            if nodes[i].label is not None:
                coming[key] = i
    for i, n in enumerate(nodes):
        if i and n.start - nodes[i - 1].end <= NEAR:
            out.append((i - 1, i, CHAIN))
        linked = set()
        for key in n.keys:
            for j in (last.get(key), observed.get(key)):
                if j is not None and j not in linked:
                    linked.add(j)
                    out.append((j, i, SIMILAR if key[0] == "tail" else SAME))
            last[key] = i
            if n.label is not None:
                observed[key] = i
        for j, key in later[i]:
            if j not in linked:
                linked.add(j)
                out.append((i, j, SIMILAR if key[0] == "tail" else SAME))
    return out


class Weights:
    def __init__(self, unary: dict[str, np.ndarray], pair: np.ndarray):
        self.unary, self.pair = unary, pair

    def potentials(self, nodes: list[Node]) -> np.ndarray:
        out = np.zeros((len(nodes), len(LABELS)))
        for i, n in enumerate(nodes):
            if n.label is not None:
                out[i] = -30.0
                out[i, n.label] = 0.0
            for f in n.features:
                if (w := self.unary.get(f)) is not None:
                    out[i] += w
        return out


def marginals(weights: Weights, nodes: list[Node]) -> np.ndarray:
    """Loopy sum-product in logs, all messages at once, damped."""
    unary, links = weights.potentials(nodes), edges(nodes)
    if not links:
        belief = unary
    else:
        a, b, kind = np.array(links).T
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        pair = np.concatenate([weights.pair[kind], weights.pair[kind].transpose(0, 2, 1)])
        message = np.zeros((len(source), len(LABELS)))
        for _ in range(BP_ROUNDS):
            belief = unary.copy()
            np.add.at(belief, target, message)
            out = (belief[source] - message[back])[:, :, None] + pair
            top = out.max(1, keepdims=True)
            new = (top + np.log(np.exp(out - top).sum(1, keepdims=True)))[:, 0]
            message = DAMPING * message + (1 - DAMPING) * (new - new.max(1, keepdims=True))
        belief = unary.copy()
        np.add.at(belief, target, message)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(weights: Weights, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    nodes = mentions(text, base)
    if all(n.label is not None for n in nodes):
        return []
    p = marginals(weights, nodes)
    best = p.argmax(1)
    return [(LABELS[k], n.start, n.end) for n, k, row in zip(nodes, best, p, strict=True) if n.label is None and k and row[k] >= LEAST_MARGINAL]


# --- training ---------------------------------------------------------------------------


def _generated(rng: random.Random) -> tuple[str, dict[tuple[int, int], int]]:
    """A document and the labels of its candidate mentions; what isn't listed is none."""
    words = "the of and report late summer market house river build light paper green under meeting list value found".split()
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    parts: list[tuple[str, str | None]] = []
    say = lambda *x: parts.extend(x)

    def spread(*found: tuple[str, str]) -> None:
        """Mentions of one thing with words between them; the full form, which comes first here, may stand anywhere."""
        for x in rng.sample(found, len(found)) if rng.random() < 0.5 else found:
            say((" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))), None), x)

    for _ in range(rng.randint(2, 6)):
        say((" ".join(rng.choice(words) for _ in range(rng.randint(2, 25))), None))
        a, b, c = d(3), d(3), d(4)
        local = rng.choice(words) + rng.choice("._") + d(2)
        kind = rng.randrange(14)
        gap = (" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))), None)
        if kind == 0:
            spread((rng.choice([f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"+1{a}{b}{c}", f"+1-{a}-{b}-{c}"]), "phone"), *[
                (rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}{b}{c}", f"{b}-{c}", f"{a}.{b}.{c}"]), "phone") for _ in range(rng.randint(1, 3))
            ])
        elif kind == 1:
            say((rng.choice(["call", "phone:", "tel.", "mobile", "fax"]), None), (rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}"]), "phone"))
        elif kind == 2:
            spread((f"{local}@mail{d(1)}.example.com", "email"), (local, "email"))
        elif kind == 3:
            say((f"{local} {rng.choice(['[at]', '(at)', '{at}'])} site{d(1)}{rng.choice(['.com', ' [dot] com', ' (dot) org'])}", "email"))
        elif kind == 4:
            say((f"{rng.choice(words)} at site{d(2)}.com", None))
        elif kind == 5:
            body = d(15)
            body += next(x for x in "0123456789" if luhn(body + x))
            spread((body, "card"), *[(rng.choice([".".join(re.findall("....", body)), body[:8] + "." + body[8:]]), "card") for _ in range(rng.randint(1, 3))])
        elif kind == 6:
            four = [str(rng.randint(10, 250)) for _ in range(4)]
            spread((".".join(four), "ip"), ("[.]".join(four), "ip"))
        elif kind == 7:
            name = rng.choice(["Alder", "Birch", "Cedar", "Hazel", "Rowan", "Maple"])
            say((rng.choice(["Mr.", "Mrs.", "Dr.", "Prof."]), None), (name, "name"), gap, (name, "name"))
        elif kind in (8, 9):
            say((rng.choice([f"19{d(2)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.20{d(2)}", f"{d(3)} {d(3)} {d(3)}", d(rng.randint(6, 18)), f"{d(3)}-{d(3)}-{d(4)}", f"({a}) {b}-{c}"]), None))
        elif kind == 10:
            x = d(rng.randint(7, 14))
            say((rng.choice(["order", "isbn", "version", "invoice", "id", "no", "page"]), None), (x, None), gap, (x, None))
        elif kind == 11:
            say((f"{d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}", None), gap, (f"{d(8)}", None))
        elif kind == 12:
            x = rng.choice([f"{d(3)}-{d(3)}-{d(4)}", d(10), f"{d(4)} {d(4)} {d(4)} {d(4)}"])
            say((x, None), gap, (x, None))
    text, labels = "", {}
    for s, kind in parts:
        if kind:
            labels[(len(text), len(text) + len(s))] = LABELS.index(kind)
        text += s + " "
    return text, labels


@cache
def trained() -> Weights:
    """Pseudo-likelihood: each mention's label given its features and its neighbours' labels."""
    rng = random.Random(TRAIN_SEED)
    rows, ys, n_labels = [], [], len(LABELS)
    for _ in range(TRAIN_DOCS):
        text, truth = _generated(rng)
        nodes = mentions(text, base_spans(text))
        gold = [n.label if n.label is not None else truth.get((n.start, n.end), 0) for n in nodes]
        around: list[list[tuple[str, int]]] = [[] for _ in nodes]
        for i, j, kind in edges(nodes):
            around[j].append((f"edge{kind}>", gold[i]))
            around[i].append((f"edge{kind}<", gold[j]))
        for n, y, near in zip(nodes, gold, around, strict=True):
            if n.label is None:
                rows.append(n.features + [f"{e}{k}" for e, k in near])
                ys.append(y)
    index = {f: i for i, f in enumerate(sorted({f for r in rows for f in r}))}
    x = np.zeros((len(rows), len(index)))
    for i, r in enumerate(rows):
        for f in r:
            x[i, index[f]] += 1
    y, w = np.eye(n_labels)[ys], np.zeros((len(index), n_labels))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, TRAIN_STEPS + 1):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = x.T @ (p - y) / len(rows) + 2e-4 * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    pair = np.zeros((3, n_labels, n_labels))
    for kind in range(3):
        for k in range(n_labels):
            if (i := index.get(f"edge{kind}>{k}")) is not None:
                pair[kind, k] += w[i]
            if (i := index.get(f"edge{kind}<{k}")) is not None:
                pair[kind, :, k] += w[i]
    return Weights({f: w[i] for f, i in index.items() if not f.startswith("edge")}, pair)


# --- Spark ------------------------------------------------------------------------------


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: Weights | None = None) -> DataFrame:
    """``doc_id, base, added``: lists of (kind, start, end) for every row."""
    model = weights or trained()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added = [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                found = base_spans(text) if _HAS.search(text) else []
                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in found])
                more = added_spans(model, text, found) if _HAS.search(text) else []
                added.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in more])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(span)), pa.array(added, pa.list_(span))], ["doc_id", "base", "added"])

    s = "array<struct<kind:string,start:bigint,end:bigint>>"
    return key_and_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, base {s}, added {s}")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    key = lambda x: F.struct(rank(x).alias("k"), x["start"].alias("s"), x["end"].alias("e"), x["kind"].alias("kind"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.transform(c, key)), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(n, KINDS[:4]), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
