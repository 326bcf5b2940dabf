"""Periodic runs, the prefix trie and URL filters against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import more_queries, periodic_runs, prefix_trie, url_filters
from tidemark.llm.tokens import numbered, words_of

WORD = re.compile("[^\x20\x09-\x0D]+")


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def brute_runs(words, least=24):
    """Every lag of every place; of stretches equal in start and length the smallest lag."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            if j > i and j - i + q >= max(least, 3 * q):
                found.setdefault((i - q, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def repetitive(rng, n=260):
    words = []
    while len(words) < rng.randint(0, n):
        kind = rng.random()
        if kind < 0.5:
            unit = [f"w{rng.randint(0, rng.choice([0, 1, 9]))}" for _ in range(rng.randint(1, 14))]
            words += (unit * rng.randint(1, 12))[: rng.randint(1, 90)]
        elif kind < 0.7 and words:
            words += words[-rng.randint(1, len(words)) :] * rng.randint(1, 4)
        else:
            words += [f"w{rng.randint(0, 5)}" for _ in range(rng.randint(1, 30))]
    return words[:600]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = {i: " ".join(repetitive(rng)) for i in range(80)}
    out |= {100: None, 101: "", 102: " \n\t ", 103: "a " * 5000, 104: "é\n" * 24, 105: "a " * 23, 106: ("x y  z\t" * 8).strip(), 107: out[3], -4: "b " * 40}
    return out


def test_periodic_runs_match_brute_force(spark, texts):
    docs = spark.createDataFrame([*texts.items(), (None, "b " * 30), (3, texts[3])], "doc_id long, text string").repartition(3)
    got = periodic_runs.periodic_runs(docs).withColumn("top", periodic_runs.strongest(F.col("runs"))).collect()
    assert len(got) == len(texts) + 2
    some = 0
    for r in got:
        words = WORD.findall("b " * 30 if r.doc_id is None else texts[r.doc_id] or "")
        want = brute_runs(words) if len(words) < 3000 else [(0, len(words), 1)]
        assert (r.n_words, [tuple(x) for x in r.runs]) == (len(words), want)
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r.text == " ".join(w for i, w in enumerate(words) if i not in gone)
        top = max(want, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        assert (tuple(r.top) if r.top else None) == top
        some += len(want)
    assert some > 100


@pytest.mark.parametrize("least", [6, 12, 24, 50])
def test_runs_of_other_least_lengths(least):
    rng = random.Random(least)
    for _ in range(60):
        docs = [[int(w[1:]) for w in repetitive(rng, 160)] for _ in range(3)]
        ids, first = np.array(sum(docs, []), np.int64), np.cumsum([0] + [len(d) for d in docs])
        text, start, length, period = periodic_runs.find_runs(ids, first, least)
        got = [[(int(a), int(b), int(q)) for t, a, b, q in zip(text, start, length, period) if t == k] for k in range(3)]
        assert got == [brute_runs(d, least) for d in docs]


def test_words_are_numbered_by_their_bytes():
    """Two Thue-Morse words collide under any polynomial hash modulo 2**64; their numbers differ."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    data = f"{a} {b}  {a}\n".encode()
    words = words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert numbered(words).tolist() == [0, 1, 0]


def test_runs_of_awkward_tables(spark):
    docs = spark.createDataFrame([(1, "a " * 30, 5, "x"), (1, "a " * 30, 5, "x"), (None, None, None, None)], "doc_id long, text string, n_words int, runs string")
    rows = periodic_runs.periodic_runs(docs).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.text, len(r.runs)) for r in rows) == [(0, 0, "", 0), (1, 30, "a", 1), (1, 30, "a", 1)]
    assert periodic_runs.periodic_runs(docs.where("false")).count() == 0


def test_texts_are_rebuilt_by_their_ids(spark, texts):
    docs = spark.createDataFrame([*texts.items(), (None, "b a")], "doc_id long, text string")
    changed = 0
    for r in more_queries.rebuilt_texts(docs).collect():
        text = texts[r.doc_id] if r.doc_id is not None else "b a"
        h, words = zlib.crc32(str(r.doc_id).encode()), WORD.findall(text or "")
        if r.doc_id is None or h % 10 or not words:
            assert r.text == text
            continue
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert WORD.findall(r.text) == [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        changed += 1
    assert changed > 3


def brute_trie(sequences):
    """Node by node: sequences is {conv_id: [(key, size), ...]}."""
    members = {}
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, convs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(convs) - 1) * p[-1][1] if p else 0
    rows = []
    for prefix, convs in members.items():
        ends = sorted(c for c in convs if len(sequences[c]) == len(prefix))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        rows.append((min(convs), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(convs), children[prefix], leaves[prefix], saved[prefix], digest))
    return sorted(rows, key=str)


def keyed(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16], len(text)


def ordered(rows):
    """{conv_id: [(key, size), ...]} by turn, null first, equal ones by key."""
    out = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, keyed(*r[2:]))):
        out.setdefault(conv, []).append(keyed(role, text))
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def conversations(seed, n, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.choice([1, 2, 3, 5, most])):
            rows.append((conv, turn, rng.choice(["user", "bot", None]), rng.choice(["", "a", "bb", "é", None, "long text"]) if rng.random() < 0.7 or turn > 6 else "first"))
    rows += [(None, 0, "user", "nobody's"), (1, None, "user", "early"), (2, 0, "user", "tie"), (2, 0, "user", "tie"), (2, 0, "bot", "other tie")]
    return rows


def as_rows(df):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_prefix_trie_matches_brute_force(spark):
    rows = conversations(1, 60, 9)
    turns = prefix_trie.keyed_turns(spark.createDataFrame(rows, CONVERSATIONS).repartition(5))
    want = ordered(rows)
    assert {c: [(bytes(r.key), r.size) for r in sorted(rs, key=lambda r: r.position)] for c, rs in itertools.groupby(sorted(turns.collect(), key=lambda r: r.conv_id), key=lambda r: r.conv_id)} == want
    silent = {1000: [], -3: []}
    ids = spark.createDataFrame([(c,) for c in (*want, *silent)], "conv_id long")
    assert as_rows(prefix_trie.prefix_trie(turns, ids)) == brute_trie(want | silent)


def test_long_conversations_cross_spans_and_ranges(spark, monkeypatch):
    """Conversations of up to 40 spans, some of whole spans, one a prefix of another; rows of one cross the borders of ranges."""
    monkeypatch.setattr(prefix_trie, "ROWS_OF_RANGE", 50)
    rng = random.Random(2)
    base = [("user", rng.choice("abcde")) for _ in range(64 * 9 + 5)]
    long = {0: base, 1: base[: 64 * 8], 2: base[:64], 3: base[:63], 4: base[:128] + [("bot", "x")], 5: base[: 64 * 4 + 1], 6: base[:300] + base[:70], 7: base[: 64 * 8] + [("bot", "y")] * 3}
    rows = [(c, i, *t) for c, turns in long.items() for i, t in enumerate(turns)]
    turns = prefix_trie.keyed_turns(spark.createDataFrame(rows, CONVERSATIONS).repartition(3))
    got = as_rows(prefix_trie.prefix_trie(turns, turns.select("conv_id").distinct()))
    assert got == brute_trie(ordered(rows))


def test_trie_of_a_hot_group_and_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_OF_CHUNK", 7)
    rows = [(c, t, "user", "same") for c in range(100) for t in range(2)] + [(200, 0, "user", "other")]
    turns = prefix_trie.keyed_turns(spark.createDataFrame(rows, CONVERSATIONS))
    assert as_rows(prefix_trie.prefix_trie(turns, turns.select("conv_id").distinct())) == brute_trie(ordered(rows))


def test_empty_tries(spark):
    none = spark.createDataFrame([], CONVERSATIONS)
    turns = prefix_trie.keyed_turns(none)
    ids = turns.select("conv_id").distinct()
    assert prefix_trie.prefix_trie(more_queries.rebuilt_turns(turns, ids), ids).count() == 0
    one = spark.createDataFrame([(5,)], "conv_id long")
    assert as_rows(prefix_trie.prefix_trie(turns, one)) == brute_trie({5: []})


def test_conversations_are_rebuilt_from_the_head_of_their_hundred(spark):
    rows = [(c + b, t, "user", f"{c % 7}-{t % 3}") for b in (0, 100, 300) for c in range(25) for t in range((c * 7 + b) % 6) if (b, c) != (300, 0)]
    rows += [(r[0] - 600, *r[1:]) for r in rows[:40]]
    own = ordered(rows)
    turns = prefix_trie.keyed_turns(spark.createDataFrame(rows, CONVERSATIONS))
    got = {}
    for r in sorted(more_queries.rebuilt_turns(turns, turns.select("conv_id").distinct()).collect(), key=lambda r: (r.conv_id, r.position)):
        got.setdefault(r.conv_id, []).append((r.position, bytes(r.key), r.size))
    for c, turns_of in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(np.fmod(c, 100))
        assert [x[1:] for x in got.get(c, [])] == own.get(base, [])[:h] + turns_of[h:]
        assert [x[0] for x in got.get(c, [])] == list(range(len(got.get(c, []))))


URLS = [
    None, "", "no scheme", "http://", "http://COM/", "http://x.com", "http://x.COM/", "https://a.example.com/en/1", "https://www.example.com/en/1?x=2", "https://b.www.example.com/en/", "https://notexample.com/en/1",
    "http://example.net/es/3#f", "http://example.net/fr/3", "http://example.net/de/3", "ftp://é.net/es/ü?q=1#://x.com/", "mailto:a@b.com", "http://a.org/en/5?u=http://x.com/en/", "http://net/es/", "http://planet/es/", "://h.com/p", "http://h.com?x/en/", "HTTP://Mixed.Example.Org/En/7",
]


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate({i: i + 32 for i in range(65, 91)}), re.match(r"[^?#]*", rest[len(host) :])[0]


def brute_rule(host, path):
    fits = [r for r in more_queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_urls_are_taken_apart_and_listed(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    got = {r.page_id: r for r in url_filters.judged(df, more_queries.URL_RULES).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = brute_parts(url)
        rule = brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule.text if rule else None)
        assert got[i].verdict == (rule.verdict if rule else got[i].verdict) and got[i].verdict in ("allow", "block")


def test_mined_rules_match_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(120):
        tokens = sorted(rng.sample("abcdef", rng.randint(0, 4)))
        verdict = None if rng.random() < 0.2 else "block" if {"a", "b"} <= set(tokens) or rng.random() < 0.2 else "allow"
        rows.append((verdict, tokens))
    known = [r for r in rows if r[0]]
    least = int(np.ceil(0.05 * len(known) - 1e-12))
    want = {}
    for size in range(1, 5):
        for items in itertools.combinations("abcdef", size):
            held = [v for v, t in known if set(items) <= set(t)]
            for v in ("allow", "block"):
                if held.count(v) >= least and held.count(v) / len(held) >= 0.7:
                    want[items, v] = (held.count(v) / len(held), held.count(v) / len(known))
    kept = {k: x for k, x in want.items() if not any((tuple(t for t in k[0] if t != o), k[1]) in want and want[tuple(t for t in k[0] if t != o), k[1]][0] >= x[0] for o in k[0])}
    df = spark.createDataFrame(rows, "verdict string, tokens array<string>")
    rules = url_filters.mined_rules(df, 0.05, 0.7)
    got = {(tuple(r.antecedent), r.verdict): (r.confidence, r.support) for r in rules.collect()}
    assert got.keys() == kept.keys() and len(kept) > 5
    assert all(got[k] == pytest.approx(kept[k]) for k in kept)
    counts = {t: sum(t in x for _, x in known) for t in "abcdef"}
    assert all(r.anchor == min(r.antecedent, key=lambda t: (counts[t], t)) for r in rules.collect())

    for r in url_filters.matched(df.select("tokens"), rules, "tokens").collect():
        held = [(-x[0], -x[1], len(k[0]), " ".join(k[0]), k[1]) for k, x in want.items() if set(k[0]) <= set(r.tokens)]
        best = min(held, default=None)
        assert (r.mined, r.mined_verdict) == ((best[3], best[4]) if best else (None, None))


def test_url_filters_of_awkward_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.judged(none, more_queries.URL_RULES).count() == 0
    unlisted = spark.createDataFrame([(1, "http://a.org/", "mine", "mine", ["z"])] * 2, "page_id long, url string, host string, verdict string, tokens array<string>")
    rows = url_filters.judged(unlisted, more_queries.URL_RULES).collect()
    assert [(r.host, r.verdict, r.rule, r.mined, r.tokens) for r in rows] == [("a.org", "allow", None, None, ["z"])] * 2
    assert url_filters.judged(unlisted, more_queries.URL_RULES, default="block").first().verdict == "block"
