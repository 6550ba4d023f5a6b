"""Plain versions of the operators, for small inputs."""

import hashlib
import re


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# near groups
def shingle_set(t, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def groups(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and min(len(x), len(y)) * 100 >= 85 * max(len(x), len(y)) and 100 * len(x & y) >= 85 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(least.get(find(a), i), i)
    return sorted((i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets))


# personal data
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


def base_spans(t):
    out = []
    for k, (kind, p) in enumerate(KINDS.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def spans_text(spans):
    return ",".join(f"{list(KINDS)[k]}:{a}:{b}" for a, k, b in spans)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def _valid(k, x):
    d = re.sub("[^0-9]", "", x)
    return (True, all(int(p) <= 255 for p in x.split(".")) if k == 1 else True, 14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15)[k]


def proposals(t, pii):
    """Every match that is no base span: (start, k, stop, votes, shape)."""
    out = []
    for wide, patterns in ((False, KINDS), (True, pii.WIDE)):
        for kind, p in patterns.items():
            k, last = list(KINDS).index(kind), 0
            for m in re.finditer(p, t or ""):
                x, gap = m[0], t[last : m.start()]
                last = m.end()
                if not wide and (_valid(k, x) or k == 2 and len(re.sub("[^0-9]", "", x)) < 14):
                    continue
                d = re.sub("[^0-9]", "", x)
                if k == 0:
                    g = 1 if re.search("[A-Za-z0-9-]*$", x)[0].lower() in pii.TOP_DOMAINS else -1
                elif k == 1:
                    first = re.match(r"0*([0-9]{1,3})[.]", x)
                    g = 0 if not first else 1 if 1 <= int(first[1]) <= 223 else -1
                elif k == 2:
                    g = 1 if d.startswith(tuple(pii.ISSUERS)) else -1
                else:
                    g = 1 if (d.startswith(tuple(pii.COUNTRY_CODES)) if x[0] == "+" else re.match("[2-9](?!11)[0-9]{2}[2-9]", d)) else -1
                before = gap[-40:]
                votes = (0 if wide else -1, g, int(bool(re.search(pii.CUES[kind], before.lower()))), -1 if gap and gap[-1].isalnum() else 1)
                marks = set(re.findall(r"[\x20().:@-]", x))
                shape = (min(len(x) // 8, 5), min(len(marks), 2), int(bool(re.search(r"([0-9])\1\1\1", x))), int(bool(re.search(r"[^\W\d_][^a-zA-Zé]{0,3}\Z", before))), int(not gap or gap[-1] in "\n\t|"))
                out.append((m.start(), k, m.end(), votes, shape))
    return out


def all_spans(t, pii, weights):
    base = base_spans(t)
    more = []
    for start, k, stop, votes, shape in proposals(t, pii):
        z = sum(a * b for a, b in zip(pii._row(votes, shape), weights[k]))
        if 1 / (1 + 2.718281828459045**-z) >= pii.ACCEPT and not any(a < stop and start < b for a, _, b in base):
            more.append((start, k, stop))
    return sorted(base + more)
