"""Secret scans, tokenizer alignment and conversation repair against plain
Python versions."""

import hashlib
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from admitflow.llm import alignment, conversation_repair, queries, secrets_ledger
from tests.llm import corpus

# ---------------------------------------------------------------- secrets

BRUTE = [("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 8),
         ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile(r"[0-9a-f]+"), 0, 32)]


def brute_secrets(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, pattern, group, least) in enumerate(BRUTE)
             for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return [f"{kind}:{s}:{e}" for s, _, kind, e in sorted(found)]


def spans_of(findings):
    return ",".join(f"{f['kind']}:{f['start']}:{f['stop']}" for f in findings if f["kind"] in secrets_ledger.BASE)


def secret_texts(seed=5, n=80):
    rng = random.Random(seed)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "=", ":", " ", "  ", '"', "'", "abcdefgh", "AKIA", "AKIAABCDEFGHIJKL",
            "0123456789abcdef", "0123456789abcdef0123456789abcdef", "é", "😀", "\n", "K", "xy.z", "-", "/", "ſecret"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return texts + [None, "", "a" * 5000, "secret=token:abcdefghij", "token=" * 50 + "abcdefghi", ("secret: abcdefgh12 " * 2000)]


def test_secrets_equal_plain_python(spark):
    rows = [(i * 2, t) for i, t in enumerate(secret_texts())]
    rows += [rows[3], rows[3], (None, rows[4][1]), (None, None)]
    ledger = secrets_ledger.Ledger(spark, f"{spark.sparkContext.getCheckpointDir()}/t-{uuid.uuid4().hex}")
    docs = corpus.docs(spark, rows)
    secrets_ledger.scan(docs, ledger)
    got = Counter((r["doc_id"], spans_of(r["findings"])) for r in secrets_ledger.locate(docs, ledger).select("doc_id", "findings").collect())
    assert got == Counter((i, ",".join(brute_secrets(t))) for i, t in rows)


def test_ledger_scans_what_is_unseen(spark):
    ledger = secrets_ledger.Ledger(spark, f"{spark.sparkContext.getCheckpointDir()}/t-{uuid.uuid4().hex}")
    first = spark.createDataFrame([("a", 1, "token=abcdefgh1"), ("b", 1, "nothing"), ("c", 1, "token=abcdefgh1")], "path string, version int, text string")
    base = secrets_ledger.RULES[:2]
    secrets_ledger.scan(first, ledger, base)
    assert ledger.scanned().count() == 2 * 2 and ledger.findings().count() == 1
    assert secrets_ledger.unseen(first, ledger, base).count() == 0
    second = first.unionByName(spark.createDataFrame([("a", 2, "AKIAABCDEFGHIJKLMN"), ("b", 2, "token=abcdefgh1")], first.schema))
    todo = {r["blob"]: list(r["rules"]) for r in secrets_ledger.unseen(second, ledger, base).collect()}
    assert list(todo.values()) == [["assign@1", "access@1"]]  # the one blob that is new
    changed = (base[0], secrets_ledger.Rule("access", 2, r"AKIA[A-Z]{4}"))
    todo = Counter(tuple(r["rules"]) for r in secrets_ledger.unseen(second, ledger, changed).collect())
    assert todo == {("access@2",): 2, ("assign@1", "access@2"): 1}
    secrets_ledger.scan(second, ledger, changed)
    secrets_ledger.scan(second, ledger, changed)  # nothing is left to do
    assert ledger.scanned().count() == 4 + 2 + 2
    got = {(r["path"], r["version"]): spans_of(r["findings"]) for r in secrets_ledger.locate(second, ledger, changed).collect()}
    assert got == {("a", 1): "assign:0:15", ("b", 1): "", ("c", 1): "assign:0:15", ("a", 2): "access:0:8", ("b", 2): "assign:0:15"}


def test_repeated_scan_after_a_failure_and_clashing_names(spark):
    ledger = secrets_ledger.Ledger(spark, f"{spark.sparkContext.getCheckpointDir()}/t-{uuid.uuid4().hex}")
    rows = spark.createDataFrame([(1, "token=abcdefgh1")], "doc_id long, text string")
    marks = secrets_ledger.unseen(rows, ledger)
    found = secrets_ledger.find(rows.select(secrets_ledger.blob_of(rows.text).alias("blob"), "text").join(marks, "blob"))
    found.write.mode("append").parquet(f"{ledger.folder}/findings")  # the scan was lost before its marks
    secrets_ledger.scan(rows, ledger)
    assert [len(r["findings"]) for r in secrets_ledger.locate(rows, ledger).collect()] == [1]
    with pytest.raises(ValueError, match="findings"):
        secrets_ledger.locate(rows.selectExpr("*", "1 AS findings"), ledger)
    empty = secrets_ledger.Ledger(spark, f"{ledger.folder}-none")
    secrets_ledger.scan(rows.limit(0), empty)
    assert secrets_ledger.locate(rows.limit(0), empty).count() == 0


def test_third_of_equal_rows_is_scanned_once(spark):
    rows = [(i, "token=abcdefgh1" if i % 3 == 0 else f"text {i}") for i in range(900)]
    ledger = secrets_ledger.Ledger(spark, f"{spark.sparkContext.getCheckpointDir()}/t-{uuid.uuid4().hex}")
    docs = corpus.docs(spark, rows)
    secrets_ledger.scan(docs, ledger)
    assert ledger.findings().count() == 1
    assert sum(len(r["findings"]) for r in secrets_ledger.locate(docs, ledger).select("findings").collect()) == 300


# ---------------------------------------------------------------- alignment

@pytest.fixture(scope="module")
def coders():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    byte = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}
    bytes_a = lambda i: bytes(byte[c] for c in a.id_to_token(i))
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return a, b, bytes_a, bytes_b


def brute_alignment(coders, texts):
    a, b, bytes_a, bytes_b = coders
    facts, links = [], []
    for text in texts:
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        own = [b"".join(map(f, x)) for f, x in zip((bytes_a, bytes_b), ids, strict=True)]
        if not text or any(x != (" " + text).encode() for x in own):
            facts.append((0, 0, 0, 0, ""))
            links.append(Counter())
            continue
        ends = [np.cumsum([len(f(i)) for i in x]).tolist() for f, x in zip((bytes_a, bytes_b), ids, strict=True)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [[[i for i, e in zip(x, y, strict=True) if lo < e <= hi] for x, y in zip(ids, ends, strict=True)] for lo, hi in zip([0, *cuts], cuts, strict=False)]
        held = Counter((i, j) for x, y in groups for i in x for j in y)
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        facts.append((len(ids[0]), len(ids[1]), len(groups), sum(held.values()), hashlib.sha256(line.encode()).hexdigest()))
        links.append(held)
    count = Counter(p for held in links for p in held)
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return [(*f[:4], sum(n for p, n in held.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in held.items()), f[4])
            for f, held in zip(facts, links, strict=True)]


ODD = [None, "", " ", "  ", "a ", "a  b   c ", "\n a\n\n", "x▁y", "▁", "<|endoftext|> <s> a </s>", "日本語テキスト", "z" * 3000, " " * 100, "\0a",
       "é̀ ﬁ 😀😀", "tab\t\ttab \r\n x", "the " * 300, "aaaa" * 400]


def test_alignment_equals_plain_python(spark, coders):
    texts = ODD + [t for _, t in corpus.random_corpus(3, n=40)]
    rows = list(enumerate(texts)) + [(2, "again one id"), (None, "no id"), (None, "no id")]
    got = alignment.align(corpus.docs(spark, rows))[0]
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    expected = brute_alignment(coders, [t for _, t in rows])
    assert Counter(map(tuple, got.collect())) == Counter((i, *x) for (i, _), x in zip(rows, expected, strict=True))


def test_alignment_over_several_containers(spark, coders, monkeypatch):
    monkeypatch.setattr(alignment, "FLUSH", 300)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 500)
    monkeypatch.setattr(alignment, "DENSE", 16)
    monkeypatch.setattr(alignment, "WIDE", 4)
    rows = [(i, t) for i, (_, t) in enumerate(corpus.random_corpus(4, n=60))]
    s = alignment.Postings()
    s.add(np.arange(20), np.full(20, 7), np.where(np.arange(20) == 3, 5, 1))
    pairs, docs, planes = s.planes()
    low, who, plane = alignment.plane_rows(planes)
    assert pairs.tolist() == [7] and docs.tolist() == [20]
    assert Counter(zip(low.tolist(), plane.tolist(), strict=True)) == Counter([(i, 0) for i in range(20)] + [(3, 2)])
    coder = alignment.PlainEncoder.default(), alignment.PieceEncoder(alignment.vocabulary_path(alignment.PIECES))
    expected = brute_alignment(coders, [t for _, t in rows])
    links = alignment_links(rows, coder)
    assert [sum(x.values()) for x in links] == [x[3] for x in expected]


def alignment_links(rows, coder):
    data, offsets = alignment.wh.text_buffers(pa.array([t for _, t in rows]))
    s = alignment.aligned(data, offsets, *coder)
    out = [Counter() for _ in rows]
    for row, pair, n in s.links():
        for r, p, k in zip(row.tolist(), pair.tolist(), n.tolist(), strict=True):
            out[r][p] += k
    return out


def test_alignment_pairs_and_empty_table(spark, coders):
    rows = [(i, "the cat" if i % 3 == 0 else f"the dog {i}") for i in range(300)]
    out, pairs = alignment.align(corpus.docs(spark, rows))
    top = pairs.orderBy(pairs["count"].desc()).first()
    assert top["count"] == 300 and top["best"]
    expected = brute_alignment(coders, [t for _, t in rows])
    assert Counter(map(tuple, out.collect())) == Counter((i, *x) for (i, _), x in zip(rows, expected, strict=True))
    assert alignment.align(corpus.docs(spark, []))[0].count() == 0


# ---------------------------------------------------------------- repair

def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute_repair(rows, damaged):
    """A plain dynamic programme over turns and states."""
    result = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        best = {0: (0, "", ())}
        for k in range(len(own) + 1):
            for _ in range(3):
                for q, (cost, audit, lines) in list(best.items()):
                    new = ("assistant", 3) if q == 2 else ("user", 2)
                    value = (cost + 5, audit + "I", (*lines, f"{new[0]}:"))
                    best[new[1]] = min(best.get(new[1], value), value)
            if k == len(own):
                break
            following = {}
            for q, (cost, audit, lines) in best.items():
                moves = [(q, 2, "D", ())]
                if faults[k] not in ("blank", "duplicate"):
                    more, role, text = 5 * (faults[k] == "truncated"), own[k][2], own[k][3]
                    to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], q))
                    if to:
                        moves.append((to, more, "K", (f"{role}:{text}",)))
                    role, to = ("assistant", 3) if q == 2 else ("user", 2)
                    moves.append((to, more + 1, "R", (f"{role}:{text}",)))
                for to, more, letter, line in moves:
                    value = (cost + more, audit + letter, lines + line)
                    following[to] = min(following.get(to, value), value)
            best = following
        cost, audit, lines = min(best[q] for q in (0, 3) if q in best)
        known = [r[1] for r in own if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(x[2][:1] + y[2][:1] not in ("su", "ua", "au") for x, y in zip(own, own[1:], strict=False))
        result.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                       hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return Counter(result)


def conversations(seed, n=60, most=12):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", "Same. ", "a\nb.", None, "x" * 2000 + ".", "日本。"]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant"] if rng.random() < 0.8 else ["system", "tool", "", None, "u"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), role, rng.choice(texts) if rng.random() < 0.5 else f"Turn {turn} of {conv}."))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, conv string, audit string, pos int, code int, blank int"


def _table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2, 3) for r in rows], SCHEMA).repartition(3)


def _repair(spark, rows):
    table = _table(spark, rows)
    damaged = conversation_repair.damage(table)
    plans = conversation_repair.plan_repairs(table, damaged)
    return conversation_repair.with_digests(plans, conversation_repair.repaired_turns(damaged, plans))


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_a_plain_programme(spark, seed):
    rows = conversations(seed)
    rows += rows[:5] + [(777, 0, "user", "One."), (778, 5, "user", "Two?")]
    got = _repair(spark, rows)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert Counter(map(tuple, got.collect())) == brute_repair(rows, brute_damage(rows))


def test_repair_of_a_long_conversation_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "BLOCK", 4)
    monkeypatch.setattr(conversation_repair, "FAN", 3)
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["One.", f"Turn {t}.", f"cut {t}"])) for t in range(150)]
    rows += conversations(3, n=8)
    assert Counter(map(tuple, _repair(spark, rows).collect())) == brute_repair(rows, brute_damage(rows))


def test_a_third_of_equal_rows_and_an_empty_table(spark):
    rows = [(1, 3, "user", "Same.")] * 200 + [(c, t, "user", "Other.") for c in range(2, 30) for t in range(4)]
    assert Counter(map(tuple, _repair(spark, rows).collect())) == brute_repair(rows, brute_damage(rows))
    assert _repair(spark, []).count() == 0


def test_agenda_agrees_with_every_split_of_the_turns():
    rng = random.Random(2)
    for _ in range(60):
        leaves = [conversation_repair.axioms(rng.randrange(12)) for _ in range(rng.randint(2, 14))]
        k = rng.randint(1, len(leaves) - 1)
        halves = [conversation_repair.derive(x) for x in (leaves[:k], leaves[k:])]
        assert conversation_repair.derive(halves) == conversation_repair.derive(leaves)
        assert conversation_repair.goal(halves) == conversation_repair.goal(leaves)


def test_queries_run_on_small_tables(spark):
    for name in ("op11_secret_scans", "op12_tokenizer_alignment", "op13_conversation_repair"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
