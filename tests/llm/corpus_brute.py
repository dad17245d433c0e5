"""Plain Python versions of the corpus operators' contracts, for small tables."""

import collections
import hashlib
import re
import zlib

SPACE = r"[\x20\x09-\x0D]+"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return [w for w in re.split(SPACE, (text or "").translate(LOW)) if w]


def letters(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def shingles(text, size=5):
    w = spaced(text)
    return {tuple(w[i:i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def near(rows, size=5, least=75):
    """(doc_id, n_shingles, component_id) per row; rows are (doc_id, text)."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    held = collections.defaultdict(list)
    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        common = collections.Counter(j for x in s for j in held[x])
        for j, n in common.items():
            if 100 * n >= least * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for x in s:
            held[x].append(i)
    least = collections.defaultdict(lambda: float("inf"))
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least[find(i)], doc)
    return [(doc, len(sets[i]), None if doc is None else least[find(i)]) for i, (doc, _) in enumerate(rows)]


def exact(rows):
    """(doc_id, keep_id, group_size, kept, text_sha256) per row."""
    key = lambda t: re.sub(SPACE, "", t or "")
    groups = collections.defaultdict(list)
    for doc, text in rows:
        groups[key(text)].append((-len(text or ""), doc is None, 0 if doc is None else doc))
    out = []
    for doc, text in rows:
        best = min(groups[key(text)])
        keep = None if best[1] else best[2]
        out.append((doc, keep, len(groups[key(text)]), doc == keep and -len(text or "") == best[0],
                    hashlib.sha256(key(text).encode()).hexdigest()))
    return out


def urls(rows, rules):
    """(page_id, host, path, rule, verdict) per page."""
    out = []
    for page, url in rows:
        host = path = ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host):])[0]
            host = host.translate(LOW)
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        out.append((page, host, path, best[1], best[2]))
    return out


def leaks(rows, items):
    """(doc_id, n_words, n_hit, item texts) per row."""
    found = []
    for item, text in items:
        w = letters(text)
        found += [(item, tuple(w[i:i + min(10, len(w))])) for i in range(max(len(w) - 9, 1))] if w else []
    out = []
    for doc, text in rows:
        w, hit, names = letters(text), set(), set()
        for item, window in found:
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i:i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    names.add(str(item))
        out.append((doc, len(w), len(hit), sorted(names)))
    return out


def near_leaks(rows, items, slop=3):
    """Distinct (doc_id, item_id, start, distance) of windows whose two rarest terms stand near each other, but not in place."""
    texts = [(doc, letters(t)) for doc, t in rows]
    times = collections.Counter(x for _, w in texts for x in w)
    out = set()
    for item, text in items:
        w = letters(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            known = sorted((times[x], o, x) for o, x in enumerate(w[i:i + 10]) if times[x])[:2]
            if len(known) == 2:
                (_, o1, t1), (_, o2, t2) = known
                for doc, words in texts:
                    first, second = ([p - o for p, x in enumerate(words) if x == t] for o, t in ((o1, t1), (o2, t2)))
                    out |= {(doc, item, a, b - a) for a in first for b in second if 0 < abs(b - a) <= slop}
    return out


def lines(rows):
    """(doc_id, n_lines, n_dropped, kept_sha256) per row; a null id counts as one document after all others."""
    key = lambda line: re.sub(rf"^{SPACE}|{SPACE}$", "", line).translate(LOW)
    rank = lambda doc: (doc is None, 0 if doc is None else doc)
    held = collections.defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                held[key(line)].add(rank(doc))
    out = []
    for doc, text in rows:
        all_lines = (text or "").split("\n")
        drop = [len(key(x)) >= 10 and len(held[key(x)]) > 1 and rank(doc) != min(held[key(x)]) for x in all_lines]
        kept = "\n".join(x for x, d in zip(all_lines, drop) if not d)
        out.append((doc, len(all_lines), sum(drop), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def sizes(rows):
    """(doc_id, size, text_crc32) per row."""
    return [(doc, len((text or "").encode()) + 16, zlib.crc32((text or "").encode())) for doc, text in rows]


def crc_fold(doc):
    return 0 if doc is None else zlib.crc32(str(doc).encode()) % 4


def failed(text):
    """The failed filters A to D."""
    text = text or ""
    words = [w for w in re.split(SPACE, text) if w]
    return "".join(f for f, bad in (("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)),
                                    ("C", 100 * len(re.findall("[A-Z]", text)) > 2 * len(text)), ("D", re.search("[#$%&*|]", text))) if bad)
