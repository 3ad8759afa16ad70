"""Plain restatements of the operators that SQL does not express, and of Spark's hash; shared by tests."""

import hashlib
import math
import re
import struct

import xxhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def spark_hash(*values):
    """xxhash64 of ints (as four bytes where given as ('i', x)), longs and strings, signed; nulls leave it as it is."""
    seed = 42
    for v in values:
        if v is None:
            continue
        data = struct.pack("<i", v[1]) if isinstance(v, tuple) else struct.pack("<q", v) if isinstance(v, int) else v.encode()
        seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def mixture(rows, share=0.6, powers=(0.5, 0.8, 0.9), seed=42):
    """{row: (source, lang, topic, n_tokens, probability, sampled)} of rows (doc_id, text, source, lang)."""
    cells, facts = {}, {}
    for k, (doc, text, source, lang) in enumerate(rows):
        text = text or ""
        n = len(SPACE.findall(text))
        topic = "table" if text.count("|") * 5 >= n else "note" if n < 60 else "list" if (text.count("\n") + 1) * 8 >= n else "article" if n < 1000 else "long-form"
        cell = (source or "(none)", lang or "(none)", topic)
        cells[cell] = cells.get(cell, 0) + n
        facts[k] = (cell, n, doc, text)
    total = sum(cells.values())
    p = dict.fromkeys(cells, share)
    want = []
    for d in range(3):
        sums = {}
        for c, n in cells.items():
            sums[c[d]] = sums.get(c[d], 0) + n
        raw = {v: s ** powers[d] if s else 0.0 for v, s in sums.items()}
        want.append({v: share * total * x / (sum(raw.values()) or 1) for v, x in raw.items()})
    for _ in range(200):
        moved = 0.0
        for d in range(3):
            have = {}
            for c, n in cells.items():
                have[c[d]] = have.get(c[d], 0.0) + n * p[c]
            for c, n in cells.items():
                if n and have[c[d]]:
                    x = min(1.0, p[c] * want[d][c[d]] / have[c[d]])
                    moved, p[c] = max(moved, abs(x - p[c])), x
        if moved < 1e-9:
            break
    out = {}
    for k, (cell, n, doc, text) in facts.items():
        draw = (spark_hash(("i", seed), doc, text) % (1 << 53)) / (1 << 53)
        out[k] = (*cell, n, p[cell], draw < p[cell])
    return out


def shards(names, size):
    """The table by explicit permutations of all slots, claimed in turns."""
    draw = lambda name, salt: int(hashlib.sha256(f"{salt}|{name}".encode()).hexdigest()[:16], 16)
    orders = []
    for n in names:
        offset, step = draw(n, "offset") % size, draw(n, "step") % (size - 1) + 1
        orders.append(iter([(offset + j * step) % size for j in range(size)]))
    table = {}
    while len(table) < size:
        for name, order in zip(names, orders):
            if len(table) == size:
                break
            table[next(x for x in order if x not in table)] = name
    return table


def slot(doc, text, size):
    return spark_hash(str(doc) if doc is not None else hashlib.sha256((text or "").encode()).hexdigest()) % size


def close(a, b):
    return math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-9)


def alnum_words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contaminated(text, items, window=10):
    words = alnum_words(text)
    for item in map(alnum_words, items):
        n = min(window, len(item))
        for j in range(len(item) - n + 1) if n else ():
            if any(words[i : i + n] == item[j : j + n] for i in range(len(words) - n + 1)):
                return True
    return False


def shingles(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = SPACE.findall(low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def one_of_each_group(ids, texts):
    """The places of ids that are the smallest of what they reach by links."""
    sets, up = [shingles(t) for t in texts], list(range(len(ids)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                a, b = find(i), find(j)
                if a != b:
                    up[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    return {i for i in range(len(ids)) if find(i) == i}


def quality(text, lang):
    """(base_failed, class distance, common distance, kept)."""
    from sievewright.llm.quality import BAND_PARTS, CLASS_REFERENCE, COMMON_SHARE, COMMON_WORDS, MAX_DISTANCE

    text, lang = text or "", re.match("[^-_]*", lang or "")[0].lower()
    words = SPACE.findall(text)
    seen, places = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            places.update(p for i in at for p in range(i, i + 5))
    failed = len(words) < 10 or 100 * len(places) > 20 * len(words)

    def divergence(counts, reference):
        p, q = [c / (sum(counts) or 1) for c in counts], [r / sum(reference) for r in reference]
        half = lambda x, y: 0.5 * x * math.log2(x / ((x + y) / 2)) if x > 0 else 0.0
        return sum(half(a, b) + half(b, a) for a, b in zip(p, q))

    classes = common = 0.0
    if lang in CLASS_REFERENCE and len(text) >= 200:
        kinds = [("upper", "[A-Z]"), ("digits", "[0-9]"), ("space", r"[\x09-\x0D\x20]"), ("marks", r"[.,;:!?'\"()\-]"), ("odd", r"[\x00-\x08\x0E-\x1F#*$%&|<>+/=@\[\]\\^_`{}~\x7F]"), ("beyond", r"[^\x00-\x7F]")]
        others = [len(re.findall(k, text)) for _, k in kinds]
        classes = divergence([max(0, len(text) - sum(others)), *others], CLASS_REFERENCE[lang])
    if lang in COMMON_WORDS and len(words) >= 50:
        known, width = COMMON_WORDS[lang], len(COMMON_WORDS[lang]) // len(BAND_PARTS)
        bands = [sum(w in known[i * width : (i + 1) * width] for w in words) for i in range(len(BAND_PARTS))]
        common = divergence([*bands, len(words) - sum(bands)], [COMMON_SHARE[lang] * x for x in BAND_PARTS] + [1 - COMMON_SHARE[lang]])
    return failed, math.sqrt(max(0, classes)), math.sqrt(max(0, common)), not failed and classes + common <= MAX_DISTANCE**2
