"""Prefix trie, filter audit and suffix dedup against brute force, with limits so small that every path is taken."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from vigilframe.llm import filter_audit, prefix_trie, suffix_dedup

TURNS = "conv_id long, turn long, role string, text string, depth long, k1 string"


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, held in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(held) - 1) * len(node[-1][1]) if node else 0
    out = Counter()
    for node, held in members.items():
        ends = ",".join(map(str, sorted(c for c in held if built[c] == node)))
        out[(min(held), len(node), min(members[node[:-1]]) if node else None, len(held), children[node], leaves[node], saved[node],
             hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def trie_rows(frame):
    return Counter(tuple(r) for r in frame.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def random_turns(seed):
    draw = random.Random(seed)
    rows = []
    for c in [*range(0, 30), *range(100, 112), 205, 207, 300, 311, -5, -100]:
        for t in range(draw.choice([1, 2, 6, 9, 14])):
            rows.append((c, t if draw.random() < 0.9 else None, draw.choice(["user", None, ""]), draw.choice(["a", "bb", "", None, "ccc", "é東"]), 1, "x"))
    same = [(t, "user", f"turn {t}") for t in range(11)]  # a conversation many times, and a longer one
    rows += [(c, t, r, x, 1, "x") for c in range(400, 430) for t, r, x in same]
    rows += [(460, t, "user", f"turn {t}", 1, "x") for t in range(40)]
    return rows + [(None, 1, "user", "no conversation", 1, "x"), (7, 1, "user", "again", 1, "x"), (7, 1, "user", "again", 1, "x")]


@pytest.mark.parametrize("limits", [
    prefix_trie.Limits(), prefix_trie.Limits(stretch=3, suffixes=2, turns=4, shard=10, block=2), prefix_trie.Limits(stretch=4, suffixes=100, turns=1000, shard=50, block=3),
])
def test_trie_equals_brute_force(spark, limits):
    rows = random_turns(limits.stretch)
    frame = spark.createDataFrame(rows, TURNS).repartition(5)
    assert trie_rows(prefix_trie.trie(frame, limits)) == brute_trie(rows)


def test_trie_of_no_rows(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 0, "user", "x", 1, "x")], TURNS)).count() == 0
    # All turns are dropped and the conversation that lends its first ones is absent: only the root.
    lonely = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 0)
    rows = [(lonely, 0, "user", "x", 1, "x")]
    assert trie_rows(prefix_trie.trie(spark.createDataFrame(rows, TURNS))) == brute_trie(rows)


def test_keys_of_parts_combine():
    ids = random.Random(1).randbytes(16 * 9)
    whole = prefix_trie.prefix_keys(ids, 0, 0, 0)
    assert (prefix_trie.prefix_keys(ids[64:], 4, *whole[4].tolist()) == whole[4:]).all()


# ---------------------------------------------------------------- filter audit

AUDIT = "doc_id long, text string, lang string, mask int, n long"


def test_intervals_are_the_removal_steps():
    orders = list(permutations("ABCDE"))
    assert filter_audit.orders() == ["".join(o) for o in orders]
    counts = np.arange(32) ** 2 + 1
    steps = filter_audit.removals(counts)
    for rank, order in enumerate(orders):
        want = [0] * 5
        for mask in range(1, 32):
            want[next(i for i, f in enumerate(order) if mask & filter_audit.BIT[f])] += counts[mask]
        assert steps[:, rank].tolist() == want


def test_audit_on_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(120))
    rows = [(1, words, "en", 1, 1), (2, words, "en", 1, 1), (2, words, "en", 1, 1), (None, words, "en", 1, 1), (3, None, None, 1, 1), (4, "", "", 1, 1),
            (5, words + " #", "de", 1, 1), (6, words.upper(), "de", 1, 1), (7, " ".join(["w"] * 150), "de", 1, 1), (8, words + " long" * 50_000, "de", 1, 1)]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (5, None, 1)]
    docs = spark.createDataFrame(rows, AUDIT)
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == 3 * 120 * 5
    fails = defaultdict(list)  # part: (letters, good, toxic)
    for part, letters, good, toxic in [("en", "", 1, 0), ("en", "E", 1, 1), ("en", "E", 1, 1), ("en", "", 0, 0), ("", "A", 0, 0), ("", "AE", 0, 0),
                                       ("de", "D", 0, 1), ("de", "C", 0, 0), ("de", "B", 0, 0), ("de", "B", 0, 0)]:
        fails[part].append((letters, good, toxic))
    for part, docs_ in fails.items():
        worth = Counter()
        for order in filter_audit.orders():
            for f in order:
                worth[f] += sum(1 for d in docs_ if f in d[0] and not any(x in d[0] for x in order[: order.index(f)]))
        for order in filter_audit.orders():
            for step, f in enumerate(order, 1):
                there = [d for d in docs_ if not any(x in d[0] for x in order[: step - 1])]
                out = [d for d in there if f in d[0]]
                r = got[(part, order, step)]
                assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) == (
                    len(there) - len(out), len(out), sum(f in d[0] for d in docs_) - len(out), sum(d[0] == f for d in docs_),
                    sum(d[1] for d in out), sum(d[2] for d in out), worth[f])
    assert filter_audit.audit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# ---------------------------------------------------------------- suffix arrays

def brute_dedup(texts, window):
    places = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if places[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("window, gram", [(8, 4), (12, 4), (40, 8), (5, 4), (70, 16)])
def test_shard_order_is_sorted_and_common_prefixes_are_right(window, gram):
    draw = random.Random(window)
    for trial in range(12):
        letters = b"ab" if trial % 2 else b"abcdefgh"
        pieces = [bytes(draw.choice(letters) for _ in range(draw.randint(window, 150))) for _ in range(12)]
        pieces += [pieces[0] + pieces[1], b"a" * 200, b"a" * 150]
        order, shared, begin, sizes, data = suffix_dedup.shard_order(pieces, window, gram)
        held = [bytes(data[p : p + window]) for p in order]
        assert held == sorted(held) and len(held) == sum(len(p) - window + 1 for p in pieces)
        for i in range(1, len(held)):
            n = next((k for k in range(window) if held[i][k] != held[i - 1][k]), window)
            assert shared[i] == n


def test_pieces_cover_all_windows_once(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 50)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 300)
    draw = random.Random(4)
    texts = [bytes(draw.choice(b"abcde") for _ in range(n)) for n in (0, 15, 16, 40, 299, 300, 301, 2000)] + [b"z" * 900]
    seen, names_of = Counter(), {}
    for number, names, contents, starts, sizes, inner in suffix_dedup.pieces_of(texts, 16, 4):
        assert sizes.max() <= 50
        for name, content, s, w, twice in zip(names.tolist(), contents.tolist(), starts.tolist(), sizes.tolist(), inner.tolist()):
            grams = suffix_dedup.string_hashes(np.frombuffer(texts[number][s : s + w + 15], np.uint8), 4)
            assert twice == ((grams == name).sum() > 1)
            for i in range(s, s + w):
                seen[(number, i)] += 1
                assert names_of.setdefault(texts[number][i : i + 16], name) == name
    assert seen == Counter((n, i) for n, t in enumerate(texts) for i in range(len(t) - 15))


@pytest.mark.parametrize("shard_pieces, lane", [(1 << 10, 1 << 17), (3, 40)])
def test_dedup_equals_brute_force(spark, monkeypatch, shard_pieces, lane):
    monkeypatch.setattr(suffix_dedup, "SHARD_PIECES", shard_pieces)
    monkeypatch.setattr(suffix_dedup, "LANE", lane)
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdeé東") for _ in range(draw.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, common = prose(40), prose(12)
    texts = [None, "", "short", prose(60), "x" * 500, "ab" * 300, passage, passage + prose(5) + passage]
    texts += [prose(15) + passage[draw.randint(0, 30):] + prose(9) for _ in range(8)]
    texts += [prose(draw.randint(1, 9)) + " " + common + " " + prose(draw.randint(1, 9)) for _ in range(40)]  # one anchor, many pieces
    copy = prose(50)
    near = copy.replace("a", "o", 3)
    texts += [copy] * 6 + [near, near + "!", prose(30)]
    rows = [(n if n % 7 else None, t, "en", n) for n, t in enumerate(texts)] + [(50, passage, "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, anchor string, start int").repartition(4)
    got = Counter(tuple(r) for r in suffix_dedup.deduplicated(docs, window=40, gram=8).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    want = Counter((r[0], *b) for r, b in zip(rows, brute_dedup([(r[1] or "").encode() for r in rows], 40)))
    assert got == want
    assert suffix_dedup.deduplicated(docs.limit(0)).count() == 0


def test_dedup_on_the_given_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: b for r, b in zip(rows, brute_dedup([(r.text or "").encode() for r in rows], 400))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(docs).collect()}
    assert got == want


def test_digests_that_end_in_zero_bytes(spark):
    """A text is found by its whole digest, also where that ends in a zero byte."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=9))
    passage = " ".join(word() for _ in range(60))
    while not suffix_dedup.digest_of((text := f"{word()} {passage} {word()}").encode()).endswith(b"\0"):
        pass
    docs = spark.createDataFrame([(1, text), (2, f"{word()} {passage} {word()}")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.deduplicated(docs).collect()}
    assert got == {1: (len(passage) + 2, 1), 2: (len(passage) + 2, 1)}
