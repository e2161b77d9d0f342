"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def warc(rows):
    """(page_id, html) -> {page_id: (bytes, digest, type, refers_to)} for distinct page ids."""
    first = {}
    for page, html in rows:
        data = (html or "").encode()
        first[data] = min(first.get(data, page), page)
    out = {}
    for page, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        refers = None if first[data] == page else first[data]
        out[page] = (len(data), digest, "response" if refers is None else "revisit", refers)
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
           lambda v: all(int(p) <= 255 for p in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+",
             lambda v: 16 <= len(re.sub("[ -]", "", v)) <= 19 and luhn(re.sub("[ -]", "", v))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(re.sub("[^0-9]", "", v)) <= 15),
}


def pii(text):
    return [
        (kind, m.start(), m.end())
        for kind, (pattern, valid) in PII.items()
        for m in re.finditer(pattern, text or "") if valid(m[0])
    ]


def pii_digest(text):
    spans = pii(text)
    joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    counts = Counter(k for k, _, _ in spans)
    return tuple(counts[k] for k in PII) + (hashlib.sha256(joined.encode()).hexdigest(),)


def disclosed(rows, k=3, threshold=0.8, min_joint=2, margin=2.0, z=1.645):
    """(doc_id, text) -> {doc_id: term spans} for distinct ids and texts, without ips and cards."""
    import math

    words, held, docs = {}, {}, {}
    for d, text in rows:
        base = pii(text)
        docs[d] = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"\w+", text)]
        words[d] = {w for w, _, _ in docs[d]}
        docs[d] = [x for x in docs[d] if all(x[2] <= s or x[1] >= e for _, s, e in base)]
        held[d] = set()
        for kind, s, e in base:
            value = text[s:e].lower()
            digits = re.sub(r"[^0-9]", "", value)
            part = value.split("@")[1] if kind == "email" else digits[:3]
            held[d].add(((kind, "value", re.sub(r"[^\w@.]", "", value)), (kind, "part", part), (kind,)))

    def share(word, node):
        has = [d for d in held if any(node in chain for chain in held[d])]
        return sum(word in {w for w, _, _ in docs[d]} for d in has), len(has)

    def score(word, chain):
        p = overall = sum(word in w for w in words.values()) / len(rows)
        best, evident = 0.0, False
        for node in reversed(chain):
            joint, n = share(word, node)
            f = joint / n
            low = (f + z * z / (2 * n) - z * math.sqrt(f * (1 - f) / n + (z / (2 * n)) ** 2)) / (
                1 + z * z / n)
            evident |= joint >= min_joint and low >= margin * overall
            p = (joint + k * p) / (n + k)
            if len(node) > 1 and n < len(rows):
                best = max(best, math.log(p / overall) / -math.log(n / len(rows)))
        return best if evident else 0.0

    out = {}
    for d in docs:
        terms = {w for w in {w for w, _, _ in docs[d]} if any(score(w, c) >= threshold for c in held[d])}
        out[d] = [(s, e) for w, s, e in docs[d] if w in terms]
    return out


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    counts, hit = Counter(grams), set()
    for i, gram in enumerate(grams):
        if counts[gram] > 1:
            hit.update(range(i, i + 5))
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit),
            n < 10 or 100 * len(hit) > 20 * n)


def contamination(text, items, size=13):
    words = BENCH_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, item_text in items:
        own = BENCH_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), item_text or ""))
        k = min(size, len(own))
        grams = {tuple(own[i:i + k]) for i in range(len(own) - k + 1)} if own else set()
        for i in range(len(words) - k + 1) if own else ():
            if tuple(words[i:i + k]) in grams:
                hit.update(range(i, i + k))
                found.add(str(item) if item is not None else "null")
    ids = ",".join(sorted(found))
    return (len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(),
            len(hit) > 0 and 20 * len(hit) >= len(words))


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule(url, rules):
    host, path = host_path(url)
    best = None
    for action, rule_host, rule_path in rules:
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            if best is None or len(rule_host + rule_path) > len(best[1]):
                best = (action, rule_host + rule_path)
    return best


def similarity(a, b, size=5):
    """Probability Jaccard with weights 1 + ln(count), straight from the definition."""
    import math

    def weights(text):
        words = WORD.findall(text)
        k = min(size, len(words))
        counts = Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
        return {g: 1 + math.log(c) for g, c in counts.items()}

    x, y = weights(a), weights(b)
    every = x.keys() | y.keys()
    return sum(
        1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in x.keys() & y.keys()
    )


def classes(rows, threshold=0.8):
    """(doc_id, text) -> {doc_id: smallest id of its class}, all pairs compared."""
    parent = {i: i for i, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if a and b and WORD.search(a) and WORD.search(b):
            if a == b or similarity(a, b) >= threshold - 1e-9:
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return {i: top(i) for i, _ in rows}


def shards(rows, n, overhead=16):
    """(doc_id, text) -> {doc_id: (size, crc, shard, slot)} for distinct ids."""
    keyed = sorted((d, zlib.crc32((t or "").encode()), len((t or "").encode()) + overhead)
                   for d, t in rows)
    total, before, slots, out = sum(k[2] for k in keyed), 0, Counter(), {}
    for doc, crc, size in keyed:
        shard = min(n - 1, (2 * before + size) * n // (2 * total))
        out[doc] = (size, crc, shard, slots[shard])
        slots[shard] += 1
        before += size
    return out
