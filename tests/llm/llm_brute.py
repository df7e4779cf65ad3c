"""Plain Python versions of the operators' definitions, and awkward documents."""

import hashlib
import random
import re
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def corpus(seed=5):
    """Documents with copies, near copies, shared passages, and every awkward text; also rows to compare by id."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["éa", "Straße", "THE", "the"]

    def prose(n):
        return " ".join(rnd.choice(vocabulary) + rnd.choice(["", "", "", ".", ",\n"]) for _ in range(n))

    docs, passage = {}, prose(45)
    for i in range(40):
        docs[i] = prose(rnd.randint(1, 160))
    for i in range(40, 60):
        docs[i] = docs[i - 40]
    for i in range(60, 110):  # a large group of near copies
        base = docs[7 if i < 90 else 11].split(" ")
        for _ in range(rnd.randint(0, 4)):
            base[rnd.randrange(len(base))] = rnd.choice(vocabulary)
        docs[i] = " ".join(base)
    for i in range(110, 125):
        docs[i] = prose(rnd.randint(5, 30)) + " " + passage + " " + prose(rnd.randint(5, 30))
    docs[125], docs[126], docs[127] = None, "", " \n\t "
    docs[128], docs[129], docs[130] = "one", "a b c d", "A B C D"
    docs[131] = "x " * 30_000
    docs[132] = "y" * 50_000
    docs[133] = docs[131] + "end"
    docs[134] = prose(20_000)
    docs[135] = docs[134].replace("w7", "w8", 3)
    docs[136] = " ".join(f"{i}" for i in range(25)) * 3
    return docs


def frame(spark, docs, partitions=3):
    """``documents`` with columns whose names the operators use themselves."""
    rows = [(i, t, "en", f"src{i % 4}" if i % 7 else None, 1, "x", 2, 3.0, None) for i, t in docs.items()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, n long, score double, sig string"
    return spark.createDataFrame(rows, schema).repartition(partitions)


def windows(tokens, size):
    if not tokens:
        return []
    return [tuple(tokens[i : i + size]) for i in range(max(1, len(tokens) - size + 1))]


def contamination(docs, items, size=10):
    owners = defaultdict(set)
    for item, text in items.items():
        for w in windows(alnum_words(text), size):
            owners[w].add(item)
    out = {}
    for i, text in docs.items():
        tokens, hit, met = alnum_words(text), set(), set()
        for length in {len(w) for w in owners}:
            for k in range(len(tokens) - length + 1):
                if (w := tuple(tokens[k : k + length])) in owners:
                    hit.update(range(k, k + length))
                    met |= owners[w]
        out[i] = (len(tokens), len(hit), sorted(met))
    return out


def near(docs, items, size=10, span=20):
    """Items with a window whose words all lie within ``span`` words of a place of its rarest word."""
    tokens = {i: alnum_words(t) for i, t in docs.items()}
    places = {i: defaultdict(list) for i in docs}
    totals = defaultdict(int)
    for i, ws in tokens.items():
        for k, w in enumerate(ws):
            places[i][w].append(k)
            totals[w] += 1
    out = {i: set() for i in docs}
    for item, text in items.items():
        for window in set(windows(alnum_words(text), size)):
            anchor = min(window, key=lambda w: (totals[w], window.index(w)))
            for i, ws in tokens.items():
                if item not in out[i] and any(set(window) <= set(ws[max(0, k - span) : k + span + 1]) for k in places[i].get(anchor, ())):
                    out[i].add(item)
    return {i: sorted(x) for i, x in out.items()}


def substring(docs, size=20):
    seen, out = set(), {}
    for i in sorted(docs):
        tokens, cover = words(docs[i]), set()
        for k in range(len(tokens) - size + 1):
            w = tuple(tokens[k : k + size])
            if w in seen:
                cover.update(range(k, k + size))
            seen.add(w)
        out[i] = (len(tokens), len(cover), " ".join(t for k, t in enumerate(tokens) if k not in cover))
    return out


def jaccard(docs, shingle=5, percent=80):
    sets, parent = {}, {i: i for i in docs}
    for i, text in docs.items():
        sets[i] = set(windows(words((text or "").translate(LOWER)), shingle))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i in sorted(sets):
        common = Counter()
        for s in sets[i]:
            common.update(index[s])
            index[s].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in docs}


def measures(text):
    text = text or ""
    tokens = words(text)
    found = Counter(tuple(tokens[k : k + 5]) for k in range(len(tokens) - 4))
    cover = {p for k in range(len(tokens) - 4) if found[tuple(tokens[k : k + 5])] > 1 for p in range(k, k + 5)}
    seen, twice = set(), 0
    for line in text.split("\n"):
        if words(line):
            twice += line in seen
            seen.add(line)
    failed = len(tokens) < 10 or 100 * len(cover) > 20 * len(tokens)
    return len(tokens), sum(map(len, tokens)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(cover), failed


def _luhn(digits):
    total = 0
    for k, d in enumerate(int(c) for c in reversed(digits)):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(text):
    """Base spans as (start, kind number, end, kind)."""
    out = []
    for number, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), number, m.end(), kind))
    return sorted(out)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
