"""Ranked search, divergence audit and chat formatting against brute force; odd rows and empty tables."""

import collections
import hashlib
import math
import random
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbago.llm import chats, divergence, search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, k):
    terms = [(i, WORD.findall((t or "").translate(ASCII))) for i, t in docs]
    n, words = sum(1 for _, t in terms if t), sum(len(t) for _, t in terms)
    df = collections.Counter(x for _, t in terms for x in set(t))
    merged = collections.defaultdict(collections.Counter)
    for i, t in items:
        merged[i].update(WORD.findall((t or "").translate(ASCII)))
    out = {}
    for i, asked in merged.items():
        found = []
        for d, t in terms:
            tf = collections.Counter(t)
            m = 25 + (75 * len(t) * n) // words if words else 25
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 8 * m)) for x, c in asked.items() if tf[x])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        found.sort(key=lambda f: f[:3])
        if found:
            out[i] = [(r + 1, f[3], -f[0]) for r, f in enumerate(found[:k])]
    return out


def ranked(spark, docs, items, k, **options):
    got = collections.defaultdict(list)
    index = search.build(docs, **options)
    for r in search.ranked(index, items, k).collect():
        got[r.item_id].append((r["rank"], r.doc_id, r.score))
    return {i: sorted(v) for i, v in got.items()}


def test_search_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 60)))) for i in range(900)]
    docs += [(2000 + i, docs[7][1]) for i in range(40)] + [(3, docs[3][1])]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(25)] + [(30, docs[7][1]), (31, "Ünknown"), (32, None), (30, "w1 W1-w2")]
    df, it = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = brute_search(docs, items, 10)
    assert ranked(spark, df, it, 10) == want
    assert ranked(spark, df, it, 10, segment_bytes=5000) == want


def test_search_leaves_blocks_compressed(monkeypatch):
    rng = random.Random(6)
    docs = [" ".join(["common"] * rng.randint(1, 3) + [f"r{rng.randrange(4000)}" for _ in range(4)]).encode() for _ in range(6000)]
    docs[4321] += b" rare rare"
    batch = search._segment(0, pa.array(range(6000)), docs, 6000, sum(len(d.split()) for d in docs))
    table = pa.Table.from_batches([batch])
    table = table.filter(pa.compute.is_in(table["term"], pa.array(["common", "rare", "r17"])))
    table = table.append_column("weight", pa.array([{"common": 3, "rare": 8000, "r17": 6000}[t] for t in table["term"].to_pylist()]))
    monkeypatch.setattr(search, "PIVOTS", 8)
    postings = search.Postings(table)
    docs, scores = postings.best([(postings.place[t], 1) for t in ("common", "rare", "r17")], 3)
    assert docs[0] == 4321 and len(docs) == 3 and (scores[:-1] >= scores[1:]).all()
    assert len(postings.decoded) < len(table) // 2


def test_search_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    items = [(1, "the DOG w5x5"), (None, "id here"), (2, ""), (3, None)]
    it = spark.createDataFrame(items, "item_id long, text string").withColumnsRenamed({}).selectExpr("*", "1 AS doc_id", "'x' AS term")
    assert ranked(spark, odd_docs.withColumnRenamed("h", "segment"), it, 4, segment_bytes=100) == brute_search(rows, items, 4)
    assert ranked(spark, odd_docs.limit(0), it, 4) == {} and ranked(spark, odd_docs, it.limit(0), 4) == {}


def brute_audit(rows, least, top):
    docs = [(la or "", so or "", LETTERS.findall((t or "").translate(ASCII))) for la, so, t in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = collections.Counter(x for d in mine for x in set(d[2]))
        kept = [x for x, c in df.items() if c >= least]
        counts = {s: collections.Counter(x for d in mine if d[1] == s for x in d[2] if df[x] >= least) for s in {d[1] for d in mine}}
        whole = sum(counts.values(), collections.Counter())
        p = {s: {x: 1 + 10**9 * (c[x] + 1) // (sum(c.values()) + len(kept)) for x in kept} for s, c in counts.items()}
        q = {x: 1 + 10**9 * (whole[x] + 1) // (sum(whole.values()) + len(kept)) for x in kept}
        for s in counts:
            pair = [(o, sum((p[s][x] - p[o][x]) ** 2 // p[o][x] for x in kept)) for o in counts if o != s]
            term = [(x, (p[s][x] - q[x]) ** 2 // q[x]) for x in kept if counts[s][x] and p[s][x] > q[x]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda f: (-f[1], f[0].encode()))
                out |= {(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(found[:most])}
    return out


def audited(df, **options):
    return {tuple(r) for r in divergence.audit(df, **options).select("lang", "source", "part", "item", "value", "rank").collect()}


def test_audit_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(rng.choice(["en", "de", None]), rng.choice("abcde"), " ".join(rng.choices(["The", "the", "Ö2x", "zz", "q-r", "ß"] + [f"v{chr(97 + i)}" for i in range(20)], k=rng.randint(0, 12)))) for _ in range(150)]
    rows += [("fr", "a", "lone words"), ("fr", "b", None), ("fr", None, ""), ("xx", "only", "one one one"), *[("en", "a", "same text again")] * 3]
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 AS term", "2 AS n", "3 AS item")
    want = brute_audit(rows, 3, 4)
    assert audited(df, top=4) == want
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    assert audited(df, top=4) == want
    assert audited(df.limit(0)) == set()


def test_audit_shares_are_exact(spark):
    df = spark.createDataFrame([(0, 7), (10**13, 3 * 10**13 + 1), (9_223_372_034, 10**10), (9_223_372_036, 10**10)], "n long, total long")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(divergence.share(F.col("n"), F.col("total"), 10**9)).collect()]
    assert got == [1 + 10**9 * (r.n + 1) // r.total for r in df.collect()]


CONTROLS = st.lists(st.sampled_from(["\\", "#", "##", "###", "</turn>", "<", "/turn>", ":", ": ", "\n", "a", "é☃", "### Assistant: "])).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(CONTROLS, CONTROLS), max_size=4))
def test_template_round_trip(turns):
    whole = "".join(chats.render(r, t)[0] for r, t in turns)
    assert [(r, chats.unescape(whole[a:b])) for r, a, b in chats.parse(whole)] == turns
    for role, text in turns:
        formatted, a, b = chats.render(role, text)
        assert chats.unescape(formatted[a:b]) == text and "###" not in formatted[a:b] and "</turn>" not in formatted[a:b]


def brute_fold(events):
    """Messages of one conversation's events (message, seq, kind, role, text), taken in order of seq, as a user would see it."""
    shown = {}
    for m, _, kind, role, text in sorted(events, key=lambda e: e[1]):
        if kind == "open":
            shown[m] = [role or "", text or ""]
        elif m in shown:
            if kind == "delta":
                shown[m][1] += text or ""
            elif kind == "edit":
                shown[m][1] = text or ""
            elif kind == "regenerate":
                shown[m][1] = ""
                for later in [x for x in shown if x > m]:
                    del shown[later]
    return [tuple(shown[m]) for m in sorted(shown)]


def test_fold_brute_force(spark):
    rng = random.Random(9)
    log, want = [], {}
    for c in range(60):
        events, seq, top = [], 0, 0
        for _ in range(rng.randint(0, 40)):
            seq += rng.randint(1, 3)
            if not top or rng.random() < 0.3:
                top += 1
                events.append((top, seq, "open", rng.choice(["user", "assistant", None]), rng.choice(["", "hi", None])))
            else:
                events.append((rng.randint(1, top), seq, rng.choice(["delta", "delta", "edit", "regenerate", "odd"]), None, rng.choice(["x", "</turn>", None, "### "])))
        want[c] = brute_fold(events)
        log += [(c, *e) for e in events]
    rng.shuffle(log)
    df = spark.createDataFrame(log, "conv_id long, msg long, seq long, kind string, role string, text string").selectExpr("*", "1 AS c", "2 AS o0").repartition(3)
    got = collections.defaultdict(list)
    for r in chats.rendered(df).collect():
        [(role, a, b)] = chats.parse(r.formatted)
        assert (r.loss_from, r.loss_to) == ((a, b) if role == "assistant" else (0, 0))
        got[r.conv_id].append((role, chats.unescape(r.formatted[a:b])))
    assert {c: m for c, m in want.items() if m} == got


def test_chats_odd_rows(spark):
    rows = [(1, 2, "assistant", "b. B"), (1, 1, "user", "a\nb. c"), (1, 1, "user", "a\nb. c"), (None, None, None, None), (2, 0, "assistant", None), (2, None, "a: \\", "t"), (3, 0, "assistant", "long. ☃ " * 9000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS seq", "'x' AS kind", "'y' AS pieces")
    got = {r.conv_id: r for r in chats.read_back(chats.format_turns(df)).collect()}

    def sha(*turns):
        return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()

    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars) for c, r in got.items()} == {
        1: (3, sha(("user", "a\nb. c"), ("user", "a\nb. c"), ("assistant", "b. B")), 4), None: (1, sha(("", "")), 0),
        2: (2, sha(("a: \\", "t"), ("assistant", "")), 0), 3: (1, sha(("assistant", "long. ☃ " * 9000)), 72000),
    }
    assert chats.read_back(chats.format_turns(df.limit(0))).collect() == []
