"""Plain versions of the nine problems, straight from their statements; no engine code."""

from __future__ import annotations

import collections
import itertools
import json
import re
import unicodedata

WORD = re.compile(r"[^\W_]+")


def alnum(t):
    return "".join(c for c in t.lower() if c.isalnum())


def p1(corpus, raw):
    out = set()
    parsed = []
    for i, line in raw:
        try:
            o = json.loads(line) if line else None
        except ValueError:
            o = None
        if isinstance(o, dict):
            parsed.append((i, o.get("text"), o.get("label")))
    for tab, rows in (("corpus", [(r["row_idx"], r["text"], r["label"]) for r in corpus]), ("raw_records", parsed)):
        groups = collections.defaultdict(list)
        for i, t, label in rows:
            if t is not None and label is not None and alnum(t):
                groups[alnum(t), label.strip().lower()].append(i)
        for g in groups.values():
            out |= {(tab, min(g), i) for i in g if i != min(g)}
    return out


def tok(t):
    return re.findall("[a-z0-9_'\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in t))


def p2(corpus):
    texts = [r["text"] for r in corpus if r["text"] is not None]
    df = collections.Counter(w for t in texts for w in set(tok(t)))
    return {(w, "rare") for w, n in df.items() if n < 3} | {(w, "common") for w, n in df.items() if n >= 3 and n > len(texts) / 10}


def p3(corpus, k=80):
    where = collections.defaultdict(set)
    for r in corpus:
        t = r["text"] or ""
        for i in range(len(t) - k + 1):
            where[t[i : i + k]].add(r["row_idx"])
    return {i for s in where.values() if len(s) > 1 for i in s}


def p5(corpus):
    rows = [(r["row_idx"], r["split"] == "train", frozenset(WORD.findall(r["text"].lower())), alnum(r["text"])) for r in corpus if r["text"] is not None and r["split"] in ("train", "validation", "test")]
    rows = [r for r in rows if len(r[2]) >= 5]
    out = set()
    train, rest = [r for r in rows if r[1]], [r for r in rows if not r[1]]
    for a, b in itertools.product(train, rest):
        if a[3] == b[3] or (min(len(a[2]), len(b[2])) >= 0.8 * max(len(a[2]), len(b[2])) and len(a[2] & b[2]) * 10 >= 8 * len(a[2] | b[2])):
            out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def p6(corpus):
    docs = [(r["row_idx"], collections.Counter(tok(r["text"]))) for r in corpus if r["text"] is not None]
    df = collections.Counter(w for _, c in docs for w in c)
    return {(i, w) for i, c in docs for w, n in c.items() if n >= 3 and 2 <= df[w] <= 5}


def p8(docs, items, k=12):
    known = collections.defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").lower())
        for j in range(len(w) - k + 1):
            known[" ".join(w[j : j + k])].add(i)
    out = set()
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for j in range(len(w) - k + 1):
            out |= {(d, i) for i in known.get(" ".join(w[j : j + k]), ())}
    return out


def look(s):
    """A plain canonical form: NFKD of every character, no marks of format, one table of look-alikes."""
    table = dict(zip("аеорсхуһԁԝԛѵіјѕոսօɡοριν", "aeopcxyhdwqvijsnuogopiv", strict=True)) | {"А": "A", "О": "O", "І": "I", "Ѕ": "S", "Т": "T", "Ο": "O", "Ι": "I", "т": "t", "к": "k", "м": "m"}
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if unicodedata.category(c) != "Cf" and not 0xFE00 <= ord(c) <= 0xFE0F)
    return unicodedata.normalize("NFC", "".join(table.get(c, " " if unicodedata.category(c) == "Zs" else c) for c in s))


def p4(corpus, queue):
    out = set()
    for field in ("text", "uid"):
        groups = collections.defaultdict(list)
        for r in corpus:
            if r[field] is not None and look(r[field]).strip():
                groups[look(r[field])].append(r)
        for g in groups.values():
            out |= {(field, *sorted((a["row_idx"], b["row_idx"]))) for a, b in itertools.combinations(g, 2) if a[field] != b[field]}
    exact, alike = collections.defaultdict(list), collections.defaultdict(list)
    for r in corpus:
        if r["uid"] is not None:
            exact[r["uid"]].append(r)
            alike[look(r["uid"])].append(r)
    for q in queue:
        if q["uid"] is None:
            continue
        rows = exact.get(q["uid"])
        if rows is None:
            rows = alike.get(look(q["uid"]), [])
            out |= {("queue_uid", r["row_idx"], q["entry_id"]) for r in rows}
        for r in rows:
            if q["excerpt"] is not None and r["text"] is not None and q["excerpt"] != r["text"][:140] and look(q["excerpt"]) == look(r["text"][:140]):
                out.add(("excerpt", r["row_idx"], q["entry_id"]))
    return out
