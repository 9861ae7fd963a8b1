"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter


def words(text) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def near_duplicates(docs):
    """docs: (doc_id, text) pairs -> {doc_id: (n_shingles, component)}."""
    sets = {}
    for i, text in docs:
        w = words(lower(text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = {}
    for i, s in sets.items():
        for g in s:
            having.setdefault(g, []).append(i)
    pairs = {(a, b) for v in having.values() for k, a in enumerate(v) for b in v[k + 1 :]}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def substring_dedup(docs, length=13):
    """-> {doc_id: (n_words, n_removed, kept text)}."""
    first = {}
    for i, text in docs:
        w = words(text)
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, text in docs:
        w = words(text)
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def quality_base(text):
    """-> (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = set()
    for k in range(len(w) - 4):
        if grams[tuple(w[k : k + 5])] > 1:
            covered.update(range(k, k + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def line_dedup(docs, m=2):
    """-> {doc_id: (n_lines, n_removed, n_runs, longest_run, kept text)}."""
    seq = {i: [x for x in (t or "").split("\n") if words(x)] for i, t in docs}
    first = {}
    for i in sorted(seq):
        for p in range(len(seq[i])):
            for n in range(1, len(seq[i]) - p + 1):
                first.setdefault(tuple(seq[i][p : p + n]), (i, p))
    out = {}
    for i, t in docs:
        s = seq[i]
        gone = {q for p in range(len(s) - m + 1) if first[tuple(s[p : p + m])] != (i, p) for q in range(p, p + m)}
        source = {}
        for p in range(len(s)):
            n = 1
            while p + n <= len(s) and first[tuple(s[p : p + n])] != (i, p):
                source[p] = first[tuple(s[p : p + n])]
                n *= 2
        runs = []
        for p, (d, q) in source.items():
            if p - 1 in source and source[p - 1] == (d, q - 1):
                continue
            n = 0
            while p + n < len(s) and q + n < len(seq[d]) and s[p + n] == seq[d][q + n]:
                n += 1
            if n >= m:
                runs.append(n)
        keep, k = [], -1
        for x in (t or "").split("\n"):
            k += bool(words(x))
            if not (words(x) and k in gone):
                keep.append(x)
        out[i] = (len(s), len(gone), len(runs), max(runs, default=0), "\n".join(keep))
    return out


def quality_kept(rows, fence=6, z=3, min_group=100):
    """rows: (doc_id, text, lang, source) -> ids that pass the adaptive thresholds."""
    names = {"len": (1, 0, None), "sym": (2, 0, 1), "dup": (3, 5, 1), "rep": (4, 0, 10)}

    def bucket(v):
        shift = max(v.bit_length() - 10, 0)
        return v >> shift << shift

    data = []
    for i, text, lang, source in rows:
        q = (*quality_base(text), len([x for x in (text or "").split("\n") if words(x)]))
        failed = q[0] < 10 or 100 * q[4] > 20 * q[0]
        values = {k: (1000 * q[num] // max(q[den], 1), q[num], q[den]) for k, (num, den, _) in names.items()}
        data.append((i, lang or "", source or "", failed, values, q[0].bit_length() or 1))

    def quantiles(k, keep):
        v = sorted(bucket(x[4][k][0]) for x in data if not x[3] and keep(x))
        return (len(v), {n: next(b for j, b in enumerate(v) if (j + 1) * 20 >= len(v) * n) for n in (5, 10, 15, 18)}) if v else (0, None)

    cache, kept = {}, set()
    for i, lang, source, failed, values, size in data:
        odd = False
        for k, (_, _, event) in names.items():
            key = (k, lang, source, size)
            if key not in cache:
                tries = [lambda x: (x[1], x[2], x[5]) == key[1:], lambda x: (x[1], x[5]) == (lang, size), lambda x: x[1] == lang, lambda x: True]
                found = [quantiles(k, t) for t in tries]
                cache[key] = next((q for n, q in found[:3] if n >= min_group), found[3][1])
            q = cache[key]
            if q is None:
                continue
            v, num, den = values[k]
            if event is None:
                odd = odd or v > q[15] + fence * (q[15] - q[10]) or v < q[5] - fence * (q[10] - q[5])
            else:
                over = 1000 * num - (q[18] + fence * (q[18] - q[10])) * den
                odd = odd or (over > 0 and over * over > z * z * 10**6 * event * num)
        if not failed and not odd:
            kept.add(i)
    return kept


def contaminated(docs, items, threshold=0.5):
    """Full Smith-Waterman of every item against every whole document."""
    import string

    drop = str.maketrans("", "", string.punctuation)

    def normal(t):
        return words((t or "").lower().translate(drop))

    known = [w for w in (normal(t) for _, t in items) if w]
    out = set()
    for i, text in docs:
        d = normal(text)
        for item in known:
            if not set(item) & set(d):
                continue
            best, row = 0, [0] * (len(d) + 1)
            for w in item:
                new = [0] * (len(d) + 1)
                for j, x in enumerate(d, 1):
                    new[j] = max(0, row[j - 1] + (2 if x == w else -1), row[j] - 1, new[j - 1] - 1)
                best, row = max(best, *new), new
            if best >= threshold * 2 * len(item):
                out.add(i)
                break
    return out


def alignments(docs, items):
    """Best local alignment of every item with every whole document, cell by cell."""
    out = {}
    for i, d in docs.items():
        out[i] = {}
        for k, item in items.items():
            best, row = 0, [0] * (len(d) + 1)
            for w in item:
                new = [0]
                for j, x in enumerate(d, 1):
                    new.append(max(0, row[j - 1] + (2 if x == w else -1), row[j] - 1, new[j - 1] - 1))
                best, row = max(best, *new), new
            out[i][k] = best
    return out


def url_templates(rows, z=2.58, share=0.05, borrow=40, prior=8):
    """rows: (id, url, bad or None) -> {id: (template, purity)} by a plain tree."""
    pages = []
    for i, url, bad in rows:
        m = re.match(r"[\s\S]*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        pages.append([i, host, [x for x in path.split("/") if x], bad, ""])

    def tally(some):
        return sum(p[3] is not None for p in some), sum(bool(p[3]) for p in some)

    def chi(b1, l1, b, n):
        d = b1 * n - l1 * b
        return d * d * n / (l1 * (n - l1) * b * (n - b)) if 0 < l1 < n and 0 < b < n else 0.0

    def cut(branches):
        """branches: [(name, labels, bad)], already in order -> parts"""
        n, b = sum(x[1] for x in branches), sum(x[2] for x in branches)
        best, at, l1, b1 = 0.0, 0, 0, 0
        for k, (_, x, y) in enumerate(branches, 1):
            l1, b1 = l1 + x, b1 + y
            if chi(b1, l1, b, n) > best:
                best, at = chi(b1, l1, b, n), k
        return cut(branches[:at]) + cut(branches[at:]) if best > z * z else [branches]

    done, alive, level = [], pages, 0
    while alive:
        nodes, by_template = {}, {}
        for p in alive:
            nodes.setdefault((p[1], p[4]), []).append(p)
        going = {k: v for k, v in nodes.items() if tally(v)[0] > z * z and 0 < tally(v)[1] < tally(v)[0]}
        after = []
        for k, v in nodes.items():
            for p in v:
                if k in going and len(p[2]) > level:
                    after.append(p)
                    by_template.setdefault(p[4], []).append(p[2][level])
                else:
                    p[4] += "/**" if len(p[2]) > level else ""
                    done.append(p)
        for key, v in going.items():
            here = [p for p in v if len(p[2]) > level]
            counts, every = Counter(p[2][level] for p in here), Counter(by_template.get(key[1], []))
            name = {x: x if (n + borrow * every[x] / sum(every.values())) / (len(v) + borrow) >= share else "*" for x, n in counts.items()}
            groups = {}
            for p in here:
                groups.setdefault(name[p[2][level]], []).append(p)
            branches = sorted(((x, *tally(some)) for x, some in groups.items()), key=lambda x: (x[2] / x[1] if x[1] else 0, x[0]))
            parts = cut(branches) if branches else []
            label = {}
            for part in parts:
                names = sorted(x[0] for x in part)
                label |= {x: names[0] if len(names) == 1 else "*" if len(parts) == 1 or "*" in names else "{" + "|".join(names) + "}" for x in names}
            for x, some in groups.items():
                for p in some:
                    p[4] += "/" + label[x]
        alive, level = after, level + 1
    n, b = tally(pages)
    p0 = (b + 1) / (n + 10)
    hosts, leaves, out = {}, {}, {}
    for p in done:
        hosts.setdefault(p[1], []).append(p)
        leaves.setdefault((p[1], p[4]), []).append(p)
    for (host, template), some in leaves.items():
        hl, hb = tally(hosts[host])
        tl, tb = tally(some)
        for p in some:
            out[p[0]] = template, (tb + prior * (hb + prior * p0) / (hl + prior)) / (tl + prior)
    return out


def mixed(rows, rounds=8, alpha=0.9, budget=0.8, slack=0.9, seed=7):
    """rows: (doc_id, text, lang, source) -> sampled ids."""
    cells, place = {}, {}
    for i, text, lang, source in rows:
        n = len(words(text))
        bars = (text or "").count("|")
        topic = "table" if bars * 5 >= max(n, 5) else "brief" if n < 100 else "article" if n < 1000 else "book"
        place[i] = (source or "", lang or "", topic)
        cells[place[i]] = cells.get(place[i], 0) + n
    total = sum(cells.values())
    target = []
    for d in range(3):
        share = {}
        for key, n in cells.items():
            share[key[d]] = share.get(key[d], 0) + n
        flat = {v: (n / total) ** alpha for v, n in share.items()}
        target.append({v: f / sum(flat.values()) * total for v, f in flat.items()})
        budget = min(budget, slack * min(share[v] / t for v, t in target[d].items() if t))
    w = {key: float(n) for key, n in cells.items()}
    most = {key: n / budget for key, n in cells.items()}
    for _ in range(rounds):
        for d in range(3):
            have, full = {}, {}
            for key, x in w.items():
                have[key[d]] = have.get(key[d], 0) + x
                full[key[d]] = full.get(key[d], 0) + (x if x >= most[key] * (1 - 1e-12) else 0)
            for key, x in w.items():
                v = key[d]
                if not have[v]:
                    continue
                if target[d][v] <= have[v]:
                    w[key] = x * target[d][v] / have[v]
                elif x < most[key] * (1 - 1e-12):
                    w[key] = min(most[key], x * (target[d][v] - full[v]) / (have[v] - full[v]))
    p = {k: w[k] / most[k] if n else 1.0 for k, n in cells.items()}
    draw = {i: int(hashlib.md5(f"{i}:{seed}".encode()).hexdigest()[:13], 16) / 2**52 for i in place}
    return {i for i in place if draw[i] < p[place[i]]}


def shards(docs, limit=1 << 20):
    """-> {doc_id: prefix} by splitting oversized buckets on the next bit."""
    bits = {i: f"{int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16):060b}" for i, _ in docs}
    size = {i: len((t or "").encode()) for i, t in docs}
    out, work = {}, [("", list(bits))]
    while work:
        prefix, ids = work.pop()
        if sum(size[i] for i in ids) <= limit or len(ids) == 1:
            out.update(dict.fromkeys(ids, prefix))
        else:
            for b in "01":
                part = [i for i in ids if bits[i][len(prefix)] == b]
                if part:
                    work.append((prefix + b, part))
    return out
