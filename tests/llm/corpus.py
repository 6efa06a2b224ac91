"""Small corpora and brute-force versions for the tests."""

import hashlib
import random
import re
from collections import defaultdict

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id long, block int, shard int, "
          "score double, kept_text string, n_words long, text_hash long, _part int")


def docs(spark, rows, partitions=3):
    """Documents with further columns whose names clash with those of operators."""
    full = [(i, t, "en", None, None if t is None else len(t), 1, 2, 3, 0.5, "x", 4, 5, 6) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions) if full else spark.createDataFrame([], SCHEMA)


def random_corpus(seed, n=60, words=40):
    """Texts over few words, with shared passages, near copies, copies, ties, odd
    white space, nulls, blanks and one very long word."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "Be", "cé", "d1", "e.", "日本", "f-g", "h"]) + rng.choice(["", "x", "Y", "zz", "7"])
    text = lambda k: rng.choice([" ", " ", "  ", "\t", "\n"]).join(word() for _ in range(k))
    passages = [text(rng.randint(5, 25)) for _ in range(6)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2 and out:
            base = rng.choice(out)[1] or ""
            parts = base.split(" ")
            if parts and rng.random() < 0.7:
                parts[rng.randrange(len(parts))] = word()
            body = " ".join(parts)
        else:
            body = " ".join([text(rng.randint(0, words)), rng.choice(passages), text(rng.randint(0, words // 2))])
        out.append((len(out) * 3, body))
    k = len(out) * 3
    out += [(k, None), (k + 1, ""), (k + 2, " \n\t "), (k + 3, "z" * 3000), (k + 4, "one two"), (k + 5, "ONE two"), (k + 6, passages[0] * 40)]
    rng.shuffle(out)
    return out


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_substrings(rows, window=13):
    words = {i: spaced(t) for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k:k + window]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def brute_components(rows, n=5):
    sets = {}
    for i, t in rows:
        w = spaced(lower(t))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for a in sets:
        for b in sets:
            same = len(sets[a] & sets[b])
            if a < b and same and 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                links += 1
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}, links


def brute_lines(rows):
    key = lambda line: lower(line.strip("\t\n\x0b\x0c\r "))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def brute_contamination(rows, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for item, t in items:
        w = split(t)
        k = min(window, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[s:s + k])].add(item)
    out = {}
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if (got := windows.get(tuple(w[s:s + k]))):
                    found |= got
                    hit |= set(range(s, s + k))
        out[i] = (len(w), sorted(hit), sorted(found))
    return out
