"""Plain versions of the operators, for small fixtures."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
LONG = 2_400_000


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def corpus(seed=5, n=120):
    """(doc_id, text): unique, copied, nearly copied and passage-sharing documents, and the odd ones."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["The", "é", "naïve", "ß", "😀", "x,", "End."]
    say = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage, base = say(60), say(120)
    out = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (6, "One"), (7, "a b c d"), (8, "a b c d e"), (9, base), (9, base)]
    for i in range(10, n):
        k = i % 6
        if k == 0:
            out.append((i, say(r.randrange(1, 80))))
        elif k == 1:
            out.append((i, say(r.randrange(20)) + " " + passage + " " + say(r.randrange(40))))
        elif k == 2:
            w = base.split()
            for _ in range(r.randrange(1, 6)):
                w[r.randrange(len(w))] = r.choice(words)
            out.append((i, "  ".join(w)))
        elif k == 3:
            out.append((i, base.upper() if i % 4 else base))
        elif k == 4:
            a = r.randrange(40)
            out.append((i, passage[a : a + r.randrange(60, 200)] + "\n" + base[: r.randrange(10, 600)]))
        else:
            out.append((i, (say(3) + " ") * r.randrange(1, 30)))
    r.shuffle(out)
    return out


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    keep = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return [(i, keep[t or ""], len(groups[t or ""]), i == keep[t or ""], sha(t or "")) for i, t in rows]


def substring(rows, k=13):
    first = {}
    docs = [(i, SPACE.findall(t or "")) for i, t in rows]
    for i, w in docs:
        for p in range(len(w) - k + 1):
            if i is not None:
                x = tuple(w[p : p + k])
                first[x] = min(first.get(x, i), i)
    out = []
    for i, w in docs:
        gone = set()
        for p in range(len(w) - k + 1):
            if i is not None and first[tuple(w[p : p + k])] < i:
                gone.update(range(p, p + k))
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def shingles(text):
    w = SPACE.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows):
    """Rows that repeat an id are one document with each of its texts."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and i is not None and j is not None and 100 * len(x & y) >= 75 * len(x | y):
                i, j = sorted((find(i), find(j)))
                parent[j] = i
    return [(i, len(s), find(i)) for i, s in sets]


def contamination(rows, items, k=13):
    windows = defaultdict(set)
    for item, t in items:
        w = WORD.findall((t or "").translate(UPPER))
        if w:
            n = min(k, len(w))
            for p in range(len(w) - n + 1):
                windows[tuple(w[p : p + n])].add(item)
    sizes = {len(x) for x in windows}
    out = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(UPPER))
        hit, found = set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (x := tuple(w[p : p + n])) in windows:
                    hit.update(range(p, p + n))
                    found |= windows[x]
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(names), sha(",".join(names)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def suffixes(rows, k=400):
    docs = [(i, (t or "").encode()) for i, t in rows]
    key = lambda b, p: hashlib.blake2b(b[p : p + k], digest_size=12).digest()
    seen = Counter(key(b, p) for _, b in docs for p in range(len(b) - k + 1))
    out = []
    for i, b in docs:
        gone, last = bytearray(len(b)), 0
        for p in range(len(b) - k + 1):
            if seen[key(b, p)] > 1:
                lo = max(p, last)
                gone[lo : p + k] = b"\1" * (p + k - lo)
                last = p + k
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), runs, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return out


def unit(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52


def poisson(u, mean):
    p = cdf = math.exp(-mean)
    k = 0
    while u >= cdf and k < mean + 12 * math.sqrt(mean) + 31:
        k += 1
        p *= mean / k
        cdf += p
    return k


def mixed(rows, temperature=0.5):
    """rows: (doc_id, source); gives (doc_id, copy) in output order."""
    n = Counter(s for _, s in rows)
    total = sum(c**temperature for c in n.values())
    out = []
    for i, s in rows:
        rate = len(rows) / total * n[s] ** temperature / n[s]
        for c in range(1, poisson(unit(f"mix-1:{i}:1"), rate) + 1):
            out.append((unit(f"mix-1-order:{i}:{c}"), i, c))
    return [(i, c) for _, i, c in sorted(out)]


def languages(rows):
    """{doc_id: (language, rejected)} by the rule that operator 8 states, for rows (doc_id, text, lang) with ids and texts of their own."""
    import zlib

    import zstandard

    learn = [r for r in rows if r[1] and r[2] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    counts = Counter(r[2] for r in learn)
    order = sorted(counts, key=lambda x: (-counts[x], x))
    how = zstandard.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=17, search_log=5, min_match=3, strategy=5, write_content_size=False, write_checksum=False, write_dict_id=False)
    models = {}
    for lang in order:
        ranked = []
        for i, text, label in learn:
            if label == lang:
                n = len(text.encode())
                ranked.append(((1 if n > 16384 else 2 if n < 400 else 0), hashlib.md5(f"lid:{i}".encode()).hexdigest(), text))
        parts = []
        for odd, _, text in sorted(ranked)[:64]:
            if odd == 1:
                middle = max(1, int((len(text) - 4096) / 2)) - 1
                text = text[middle : middle + 4096]
            if text in parts:
                continue
            if not parts or sum(len(p.encode()) for p in parts) + len(text.encode()) <= 112 * 1024:
                parts.append(text)
        content = "\n".join(parts[::-1]).lower().encode()
        models[lang] = (content, zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))

    def size(data, lang):
        content, prepared = models[lang]
        coder = zstandard.ZstdCompressor(compression_params=how, dict_data=prepared)
        tail = content[-300:]
        return sum(len(coder.compress(tail + b" " + data[i : i + 4096])) - len(coder.compress(tail)) for i in range(0, len(data), 4096))

    out = {}
    for i, text, _ in rows:
        if not text or not any(c.isalpha() for c in text):
            out[i] = ("und", True)
            continue
        sizes = [size(text.lower().encode(), lang) for lang in order]
        best, second = sorted(sizes)[:2]
        out[i] = (order[sizes.index(best)], second - best < max(1, 0.02 * best))
    return out


def page(r):
    """(a random well-formed page, its visible words)."""
    words = []

    def text(seen):
        w = f"w{r.randrange(10**6)}"
        if seen:
            words.append(w)
        return w + r.choice([" ", "\n", "&nbsp;", " <!-- w0 --> "])

    def node(depth, seen):
        kind = r.randrange(9 if depth < 5 else 2)
        many = lambda: "".join(node(depth + 1, seen) for _ in range(r.randrange(1, 4)))
        if kind < 2:
            return text(seen)
        if kind == 2:
            return f"<{(t := r.choice(['p', 'b', 'span', 'h2', 'i']))}>{text(seen)}</{t}>"
        if kind == 3:
            return f"<div>{many()}</div>"
        if kind == 4:
            return "<ul>" + "".join(f"<li>{node(depth + 1, seen)}</li>" for _ in range(r.randrange(1, 4))) + "</ul>"
        if kind == 5:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{text(seen)}</td>" for _ in range(r.randrange(1, 4))) + "</tr>" for _ in range(r.randrange(1, 4))) + "</table>"
        if kind == 6:
            hide = r.choice(["hidden", "style='display: none'", "class=gone"])
            return f"<div {hide}>{''.join(node(depth + 1, False) for _ in range(2))}</div>"
        if kind == 7:
            return f"<{(t := r.choice(['script', 'style', 'template']))}>w1</{t}>"
        return f"<section>{many()}</section><br>"

    body = "".join(node(0, True) for _ in range(r.randrange(1, 8)))
    return f"<html><head><title>w2</title><style>.gone {{display: none}} @media print {{div {{display: none}}}}</style></head><body>{body}</body></html>", words


def visible(html):
    """Words of a page as the standard library's parser reads it, without what is hidden."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.hidden, self.words = [], []

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            if tag != "br":
                self.hidden.append(tag in ("head", "script", "style", "template", "title") or "hidden" in a or "none" in a.get("style", "") or a.get("class") == "gone")

        def handle_endtag(self, tag):
            self.hidden.pop()

        def handle_data(self, data):
            if not any(self.hidden):
                self.words.extend(re.findall(r"w[0-9]+", data))

    reader = Reader()
    reader.feed(html)
    return reader.words
