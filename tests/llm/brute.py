"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def id_order(doc_id):
    return (doc_id is None, doc_id or 0)


def substrings(docs, window=20):
    """(doc_id, n_words, n_removed, kept_sha256) of (doc_id, text) rows."""
    seen, out = set(), []
    for doc_id, text in sorted(docs, key=lambda d: (id_order(d[0]), d[1] or "")):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc_id, len(words), sum(gone), sha(kept)))
    return sorted(out, key=str)


def shingles(text, n=5):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    n = min(n, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def jaccard_groups(docs, percent=75):
    """{doc_id: (number of shingles, component)} of (doc_id, text) rows with distinct ids."""
    sets = {d: shingles(t) for d, t in docs if d is not None}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for d, s in sets.items():
        for e, shared in Counter(e for x in s for e in holders[x] if e < d).items():
            if 100 * shared >= percent * (len(s) + len(sets[e]) - shared):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def kept_lines(
    docs, masked, depth=3, least_docs=3, least_tokens=4, least_fixed=0.7, verbatim=False, long_tokens=50
):
    """{(doc_id, text): remaining text} of (doc_id, text) rows."""
    rows = sorted({(d, t or "") for d, t in docs}, key=lambda d: (id_order(d[0]), d[1]))
    lines, leaves = {}, defaultdict(lambda: defaultdict(set))
    for place, (_, text) in enumerate(rows):
        for number, line in enumerate(text.split("\n")):
            form = tuple(masked(line))
            if len(form) >= least_tokens:
                lines[place, number] = form
                leaves[len(form), form[:depth]][form].add(place)
    template = {}
    for forms in leaves.values():
        support = defaultdict(set)
        for form, own in forms.items():
            for at, token in enumerate(form):
                support[at, token] |= own
        for form, own in forms.items():
            if len(own) >= least_docs:
                template[form] = (0, form)
                continue
            fixed = tuple(
                t if t != "<*>" and len(support[at, t]) >= least_docs else None
                for at, t in enumerate(form)
            )
            if sum(t is not None for t in fixed) >= least_fixed * len(form):
                template[form] = (1, fixed)
    where = defaultdict(set)
    for (place, _), form in lines.items():
        if form in template:
            where[template[form]].add(place)
    as_is = defaultdict(set)
    for place, (_, text) in enumerate(rows):
        for line in text.split("\n"):
            as_is[tuple(line.split())].add(place)

    def recurs(words, place):
        """Whether a short or long line stands in an earlier document and in enough of them."""
        if not verbatim or not words or least_tokens <= len(words) < long_tokens:
            return False
        least = 2 if len(words) >= long_tokens else least_docs
        return len(as_is[words]) >= least and place != min(as_is[words])

    out = {}
    for place, (doc_id, text) in enumerate(rows):
        kept = []
        for number, line in enumerate(text.split("\n")):
            own = where.get(template.get(lines.get((place, number))), ())
            dropped = len(own) >= least_docs and place != min(own)
            if not dropped and not recurs(tuple(line.split()), place):
                kept.append(line)
        out[doc_id, text] = "\n".join(kept)
    return out
