"""The training-data operators against SQL, brute force, round trips and held-out labels, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import check
import corpus_pipeline
from vigilframe.llm import cascade, components, language, mixing, packing, quotes, separators, signature_join, sketch, tokens, toxicity, url_tree
from vigilframe.llm.queries import ORACLES, QUERIES, TOKENIZER, URL_RULES

LONG = " ".join(f"word{i % 9000} and the {i}" for i in range(20_000))
TEXTS = [None, "", " \n\t ", "one", "two words", "same text again and again, line by line", "same text again and again, line by line", LONG,
         "!!! ### 123", "a b c d e f g h i j k l m n o p", "É Ñ ß <|endoftext|> \x1c mixed\u00a0space İstanbul 東京 𝒳"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, level string, rank string"


def odd_rows(spark, n=None):
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, 0, 1.0, 7, "x", "y") for i, t in enumerate(TEXTS)]
    rows += [(None, "no id at all", "en", "s", 0, 1.0, 7, "x", "y"), rows[9], rows[9]]
    return spark.createDataFrame(rows[:n] if n is not None else rows, DOCS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, small, name):
    got = QUERIES[name](spark, small).toArrow()
    assert check.compare(got, check.connect(small).execute(ORACLES[name]).to_arrow_table()) == ""


def test_ids_are_the_tokenizers():
    random.seed(3)
    letters = "abcxyzABCéèßñ'’0123.,-#<|> \n\t\x1c\u00a0東İΣ𝒳\u0301"
    texts = [t or "" for t in TEXTS] + ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(800)]
    whole, ids = Tokenizer.from_file(TOKENIZER), tokens.ChunkTokens(TOKENIZER, most=500)
    for text in texts:
        assert np.frombuffer(ids.text(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(spark):
    docs = odd_rows(spark)
    rows = packing.pack(docs, TOKENIZER, group_docs=4).toPandas()
    whole = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for r in docs.collect():
        ids = np.array(whole.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        for s in range(0, len(ids), 2048):
            want[(r.doc_id, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids))] += 1
    got = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows.itertuples())
    assert got == want
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048
    assert packing.pack(docs.limit(0), TOKENIZER).count() == 0


def test_first_fit_is_first_fit():
    random.seed(1)
    lengths = sorted((random.randint(1, 100) for _ in range(500)), reverse=True)
    room, want = [], []
    for n in lengths:
        b = next((i for i, r in enumerate(room) if r >= n), len(room))
        room += [100] * (b == len(room))
        want.append((b, 100 - room[b]))
        room[b] -= n
    assert packing.first_fit(lengths, 100) == want


def test_sketch_against_sets(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: -r.doc_id)

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    got = {r.doc_id: r for r in sketch.fingerprints(docs).collect()}
    errors = []
    for i, r in enumerate(rows):
        after = rows[(i + 1) % len(rows)].text
        edited = r.text[: len(r.text) - len(r.text) // 3] + after[: len(r.text) // 3]
        g, a, b = got[r.doc_id], shingles(r.text), shingles(edited)
        assert g.n_chars == len(r.text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors.append(abs(g.near_edited - len(a & b) / len(a | b)))
    assert np.mean(errors) < 0.06 and max(errors) < 0.35
    same = defaultdict(set)
    for r in rows:
        same[r.text].add(got[r.doc_id].fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_sketch_merges_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    a, b = (np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * 2) for n in (50_000, 400))
    limit, kept = sketch.merged(sketch.sketch(a, 16, 32), sketch.sketch(b, 16, 32))
    both = np.union1d(a, b)
    assert (kept == both[both <= np.uint64(limit)]).all()
    assert sketch.likeness(sketch.sketch(b, 16, 32), (limit, kept))[1] == 1.0
    assert sketch.from_text(sketch.to_text(limit, kept))[0] == limit
    rows = sketch.fingerprints(odd_rows(spark)).collect()
    assert len(rows) == len(TEXTS) + 3
    assert sketch.fingerprints(odd_rows(spark, 0)).count() == 0
    assert sketch.fingerprints(odd_rows(spark, 6).where("doc_id = 5")).head().near_next == 1.0


def links_of(docs, width, num, den):
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    names, n = {d: d for d in sets}, Counter()
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    for _ in sets:
        for a, b in pairs:
            names[a] = names[b] = min(names[a], names[b])
    return {d: (len(sets[d]), names[d], n[d]) for d in sets}


@pytest.mark.parametrize("width,num,den", [(3, 90, 100), (5, 8, 10)])
def test_join_against_all_pairs(spark, monkeypatch, width, num, den):
    random.seed(5)
    base = [[f"w{random.randint(0, 400)}" for _ in range(random.choice([2, 3, 8, 60, 200]))] for _ in range(12)]
    docs = []
    for i in range(160):
        words = list(random.choice(base))
        for _ in range(random.randint(0, max(1, len(words) // 25))):
            words[random.randrange(len(words))] = f"e{random.randint(0, 9)}"
        docs.append((i, " ".join(words)))
    docs += [(500, None), (501, ""), (502, " \n")]
    frame = spark.createDataFrame([(d, t, "c", "r") for d, t in docs], "doc_id long, text string, cls string, root string")
    want = links_of(docs, width, num, den)
    for limit in (1024, 8):  # the second cuts the groups into blocks
        monkeypatch.setattr(signature_join, "BLOCK_CLASSES", limit)
        rows = signature_join.linked_documents(frame, width, num, den).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in rows} == want
    monkeypatch.setattr(signature_join, "BLOCK_CLASSES", 1024)
    kept = signature_join.one_of_each(frame, width, num, den)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {d for d, w in want.items() if w[1] == d}


@pytest.mark.parametrize("side", [0, 1])
def test_block_with_one_side(side):
    rows = pd.DataFrame({"cls": [1, 2], "weight": [1, 1], "side": [side, side], "tokens": [np.arange(9, dtype=np.uint64).tobytes()] * 2})
    assert signature_join.link_block(rows, 8, 10).empty


def test_join_with_more_parts_than_classes(spark, monkeypatch):
    random.seed(6)
    docs = []
    for i in range(6):
        words = [f"w{i}x{k}" for k in range(100 + 7 * i)]
        docs += [(10 * i + k, " ".join([*words, *["end"] * (k > 0), *["more"] * (k > 1)])) for k in range(3)]
    monkeypatch.setattr(signature_join, "BLOCK_TOKENS", 40)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = signature_join.linked_documents(frame, 3, 8, 10).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in rows} == links_of(docs, 3, 8, 10)


def test_join_odd_rows(spark):
    rows = signature_join.linked_documents(odd_rows(spark), 3, 90, 100).collect()
    assert len(rows) == len(TEXTS) + 3
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert [r.n_links for r in rows if r.doc_id == 9] == [2, 2, 2]
    assert signature_join.linked_documents(odd_rows(spark, 0)).count() == 0
    assert signature_join.one_of_each(odd_rows(spark)).where("doc_id = 9").count() == 1


def test_one_of_each_judges_rows_not_ids(spark):
    def text(name, n=40):
        return " ".join(f"{name}{k}" for k in range(n))

    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, text("c") + " end"), (None, ""), (None, None),  # no ids
            (1, text("c")), (2, text("d")), (2, text("e")), (2, text("e").upper()), (7, text("d") + " end"), (3, text("f") + " end"), (3, text("g")), (4, ""), (4, "")]
    want = Counter([(None, text("a")), (None, text("b")), (None, ""), (None, None), (1, text("c")), (2, text("d")), (2, text("e")),
                    (3, text("f") + " end"), (3, text("g")), (4, ""), (4, "")])
    for parts in (1, 5):
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert Counter(tuple(r) for r in signature_join.one_of_each(frame).collect()) == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    roots = {r.node: r.root for r in components.components(edges).collect()}
    assert len({roots[i] for i in range(41)}) == 1 and roots[100] == roots[101] != roots[0]


@pytest.mark.parametrize("most", [1 << 20, 5])
def test_components_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(components, "FINISH_EDGES", most)
    draw = random.Random(most)
    pairs = [(draw.randint(-200, 200) << 40, draw.randint(-200, 200) << 40) for _ in range(230)] + [(9, 9)]
    low = {}

    def find(x):
        while low.setdefault(x, x) != x:
            x = low[x]
        return x

    for u, v in pairs:
        a, b = find(u), find(v)
        low[max(a, b)] = min(a, b)
    rows = components.components(spark.createDataFrame(pairs, "u long, v long").repartition(6)).collect()
    groups = defaultdict(set)
    for r in rows:
        groups[r.root].add(r.node)
    want = defaultdict(set)
    for u, v in pairs:
        if u != v:
            want[find(u)] |= {u, v}
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values())) and all(r in g for r, g in groups.items())
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_mixing_odd_rows(spark):
    docs = odd_rows(spark)
    rows = mixing.mixed(docs).toPandas()
    assert len(rows) == docs.count() and (rows.taken <= 3 * rows["size"]).all()
    assert mixing.mixed(docs.limit(0)).count() == 0
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == rows.copies.sum()


def test_counts_and_verdicts(spark, small):
    for r in cascade.judged(spark.read.parquet(f"{small}/documents.parquet").unionByName(odd_rows(spark).select("doc_id", "text", "lang", "source", "n_chars"))
                            .withColumn("text", F.col("text"))).join(spark.range(1), F.lit(True)).collect():
        assert r.kept is not None and (not r.base_failed or not r.kept)
    docs = odd_rows(spark)
    got = {r.doc_id: r for r in cascade.judged(docs).collect()}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        spots = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(spots))
    assert cascade.judged(docs.limit(0)).count() == 0


def test_rule_order_changes_no_verdict(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    a = {(r.doc_id, r.kept) for r in cascade.judged(docs).collect()}
    b = {(r.doc_id, r.kept) for r in cascade.judged(docs, cascade.default_rules()[::-1], sample_rows=5).collect()}
    assert a == b


def test_urls(spark, small):
    extra = [(-1, None, "x"), (-2, "no scheme", "x"), (-3, "HTTP://A.ORG", "x"), (-4, "h://q.example.org/es/x?y#z", "x"), (-4, "h://q.example.org/es/x?y#z", "x"),
             (-5, "h://n.net/" + "/".join("abcdefghijklmnop"), "x"), (-6, "h://example.org/en/12", "x"), (-7, "://", "x"), (None, "h://m.com/de/1", "x")]
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", F.lit("x").alias("host")).unionByName(
        spark.createDataFrame(extra, "page_id long, url string, host string"))
    rows = url_tree.judged_urls(pages, URL_RULES).collect()
    assert len(rows) == pages.count()
    urls = {r.page_id: r.url for r in pages.collect()}
    for r in rows:
        rest = (urls[r.page_id] or "").partition("://")[2] if "://" in (urls[r.page_id] or "") else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(t), t, v) for t, v in URL_RULES for h, s, p in [t.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith(s + p)]
        rule = max(fits, default=(0, None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule[1]) and r.verdict == (rule[2] or r.verdict) and r.verdict in ("allow", "block")
    assert url_tree.judged_urls(pages.limit(0), URL_RULES).count() == 0


def test_url_templates(spark):
    paths = [("h.com", f"/user/n{i}/p", 1, 1, i % 2) for i in range(40)] + [("h.com", f"/bad/{i}", 5, 5, 5) for i in range(9)] + [("h.com", "/good/1", 50, 50, 0)]
    rows = url_tree.templates(spark.createDataFrame(paths, "host string, path string, n long, seen long, bad long")).collect()
    names = {r.path: r.template for r in rows}
    assert names["/user/n3/p"] == "/user/*/p" and names["/bad/1"] == "/bad/*" and names["/good/1"] == "/good/*"


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op9_naive_bayes_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    model = language.learnt(odd_rows(spark))
    got = {r.doc_id: r for r in language.with_language(odd_rows(spark), model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 8)] == ["und"] * 4 and got[3].lang_pred == "en"
    empty = language.learnt(odd_rows(spark, 0))
    assert {r.lang_pred for r in language.with_language(odd_rows(spark), empty).collect()} == {"und"}


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op8_lexicon_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = Counter((r.toxic, r.predicted) for r in rows)
    assert hit[(1, 1)] / (hit[(1, 1)] + hit[(1, 0)]) > 0.85 and hit[(1, 1)] / (hit[(1, 1)] + hit[(0, 1)]) > 0.9


def test_automaton_against_edit_distance():
    terms = ["stupid", "disgusting", "scum", "worth*", "moron"]
    found = toxicity.Automaton(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    random.seed(2)
    for _ in range(4000):
        word = list(random.choice(terms).rstrip("*"))
        for _ in range(random.randint(0, 3)):
            at = random.randrange(len(word) + 1)
            word[at : at + random.randint(0, 1)] = random.choice(["", "x", "s", "t"])
        word = "".join(word) or "a"
        near = [distance(word, t) for t in terms if not t.endswith("*") and distance(word, t) <= toxicity.edits_of(t)]
        got = found.find(word)
        if near:
            assert got[1] == min(near)
        else:
            assert got is None or (got[0] == "worth*" and word.startswith("worth"))


def test_quotation_is_told_from_abuse():
    lexicon = toxicity.Lexicon({"idiot": 5.0})
    direct, misspelt, quoted, line = lexicon.features(["you are an idiot", "an idi0t here", 'it "is idiot talk" there', "> an idiot line"], lexicon.memo())
    assert direct[0] > 0 and direct[2] > 0 and misspelt[1] > 0 and quoted[3] > 0 and quoted[0] == 0 and line[3] > 0


def test_toxicity_odd_rows(spark):
    docs = odd_rows(spark)
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    for frame in (labels, labels.limit(0)):
        rows = toxicity.scored(docs, toxicity.learnt(docs, frame)).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)


def test_separators_against_a_loop(spark):
    random.seed(4)
    blocks, want = [], []
    for file in range(3):
        ids = [9 if random.random() < 0.02 else random.randint(10, 99) for _ in range(5000)] if file else [9, 9, 11, 12]
        start, index = 0, 0
        for i, t in enumerate(ids):
            if t == 9:
                want.append((file, index, start, i - start, True))
                start, index = i + 1, index + 1
        if start < len(ids):
            want.append((file, index, start, len(ids) - start, False))
        blocks += [(file, b, bytearray(np.array(ids[b * 7 : b * 7 + 7], "<u2").tobytes())) for b in range(-(-len(ids) // 7))]
    frame = spark.createDataFrame(blocks + [(7, 0, None)], "file long, block long, data binary")
    assert sorted(map(tuple, separators.documents_in(frame, 9).collect())) == sorted(want)


def test_separator_query_counts_tokens(spark):
    docs = odd_rows(spark)
    whole = Tokenizer.from_file(TOKENIZER)
    files = separators.token_files(docs, TOKENIZER, 65_535, block=64, shard=4)
    got = Counter(r.n_tokens for r in separators.documents_in(files, 65_535).collect())
    assert got == Counter(len(whole.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect())


def test_quotes_odd_rows(spark):
    rows = [(1, 0, "user", "First line\nsecond line", "x"), (1, 1, "a", "> first  LINE!\n>> unknown\nown words", "x"), (1, 2, "a", None, "x"), (1, 3, "a", "", "x"),
            (1, 4, "b", "> own words\n> second line\nend", "x"), (None, 0, "u", "null thread", "x"), (None, 1, "u", "> null thread", "x"),
            (2, None, "u", "> first line", "x"), (1, 4, "b", "> own words\n> second line\nend", "x")]
    got = {(r.conv_id, r.turn): r for r in quotes.linked_messages(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, level string")).collect()}
    assert len(got) == 8
    assert (got[(1, 1)].reply_to, got[(1, 1)].n_quoted, got[(1, 1)].n_linked, got[(1, 1)].own_text) == (0, 2, 1, "own words")
    assert got[(1, 4)].reply_to == 1 and got[(1, 4)].quoted_turns == "0,1" and got[(1, 2)].reply_to == 1
    assert got[(None, 1)].reply_to == 0 and got[(2, None)].reply_to is None


def test_conversations_with_branching_replies(spark):
    says = {0: (None, "start"), 1: (0, "a"), 2: (0, "b"), 3: (1, "c"), 4: (0, "d"), 5: (3, "e"), 6: (1, "f"), 600: (0, "late"), 601: (2, "g")}
    rows = [(c, t, "u", (f"> {says[to][1]}\n" if to is not None else "") + own) for c in (1, None) for t, (to, own) in says.items()]
    rows += [(2, None, "u", "no place"), (2, 4, "u", "alone")]
    linked = quotes.linked_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = quotes.conversations(linked).collect()
    order = [(0, 0), (1, 1), (3, 2), (5, 3), (6, 2), (2, 1), (601, 2), (4, 1), (600, 1)]
    for c in (1, None):
        assert [(r.turn, r.depth, r.root, r.position, r.own_text) for r in got if r.conv_id == c] == [
            (t, depth, 0, k, says[t][1]) for k, (t, depth) in enumerate(order)]
    assert [(r.turn, r.root, r.depth, r.position) for r in got if r.conv_id == 2] == [(None, None, None, None), (4, 4, 0, 0)]
    assert quotes.conversations(linked.limit(0)).count() == 0


def test_mail_across_segments(spark):
    turns = [0, 1, 2, 511, 512, 1024, 1025, 1026, 1027, 5000]
    rows = [(c, t, "u", f"m{t}") for c in (1, None) for t in turns]
    got = {(r.conv_id, r.turn): r.text for r in quotes.as_mail(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    marks = lambda k: "\n".join([*[f">> m{turns[k - 2]}"] * (k > 1), *[f"> m{turns[k - 1]}"] * (k > 0), f"m{turns[k]}"])
    assert got == {(c, t): marks(k) for c in (1, None) for k, t in enumerate(turns)}


def test_one_set_for_many_copies(spark):
    docs = spark.createDataFrame([(None if i % 2 else 7, f"many copies of this text {i % 3}") for i in range(300)], "doc_id long, text string").repartition(3)
    flags = spark.sparkContext.broadcast(np.ones(signature_join.FILTER_SLOTS, bool))
    assert signature_join.wanted_sets(docs, flags, 3).groupBy("cls").count().select("count").collect() == [(1,)] * 3


def test_packing_spreads_rows_of_one_id(spark):
    for doc in (None, 5):
        docs = spark.createDataFrame([(doc, "the same text")] * 200, "doc_id long, text string")
        sizes = packing.pack(docs, TOKENIZER, group_docs=10).groupBy(F.shiftright("sequence_id", packing.GROUP_BITS).alias("g")).count().collect()
        assert len(sizes) > 10 and max(r["count"] for r in sizes) < 40


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, small)
        assert after.columns == docs.columns, name
        ids = [r.doc_id for r in after.collect()]
        assert set(ids) <= {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "near_duplicates":
            want = links_of([(r.doc_id, r.text) for r in docs.collect()], 5, 8, 10)
            assert sorted(ids) == sorted(d for d, w in want.items() if w[1] == d)
        docs = spark.createDataFrame(after.toPandas(), after.schema)
    rows = corpus_pipeline.STAGES[4][1](spark, docs, small).toPandas()
    assert rows.groupby("doc_id").size().index.isin(before).all()
    assert rows.length.sum() == rows[rows.start == 0].doc_tokens.sum()


def test_mixing_keeps_every_source_and_splits_ties(spark):
    rows = [(i, "w " * 40, "big") for i in range(200)] + [(1000 + i, "w " * 5, "tiny") for i in range(5)]  # tiny stops at 3 times its size
    rows += [(2000 + i, "", "empty") for i in range(4)] + [(3000 + i, "w " * 10, None) for i in range(50)]
    rows += [(None, "w " * 10, "no ids")] * 400 + [(77, "w " * 10, "one id")] * 300
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, source string, row string, level long").repartition(5)
    got = mixing.mixed(docs).toPandas()
    assert len(got) == len(rows)
    want = Counter((r[2], len(r[1].split())) for r in rows)
    assert Counter((None if s != s or s is None else s, n) for s, n in zip(got["source"], got["size"])) == want
    for source, part in got.groupby("source", dropna=False):
        assert (part["taken"] <= 3 * part["size"]).all() and part["target"].nunique() == 1
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= part["size"].max()
    assert (got[got["source"] == "tiny"]["taken"] == 15).all()
    copies = Counter({(s, n): 0 for s, n in want})
    for r in mixing.mixed_rows(docs).collect():
        copies[(r.source, len(r.text.split()))] += len(r.text.split())
    taken = got.assign(source=got["source"].where(got["source"].notna(), None)).groupby(["source", "size"], dropna=False)["taken"].sum()
    assert {(None if s != s else s, n): v for (s, n), v in taken.items()} == dict(copies)


def test_packing_keeps_large_ids_beside_null(spark):
    ids = [(1 << 53) + 1, None, -(1 << 62) - 3, (1 << 63) - 1, None]
    docs = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], "doc_id long, text string").coalesce(1)
    assert Counter(r.doc_id for r in packing.pack(docs, TOKENIZER).collect()) == Counter(ids)


def brute_links(rows):
    """What linked_messages says of (conv_id, turn, text) rows, by a scan of all earlier ones."""
    mark = re.compile(r"[ \t]*((?:>[ \t]?)*)")
    norm = lambda line: re.sub(r"[\s!-/:-@\[-`{-~]+", " ", line.lower(), flags=re.A).strip()
    lines = [[(mark.match(x)[1].count(">"), norm(x)) for x in re.split("\r\n|\n|\r", text)] if text is not None else [] for _, _, text in rows]
    out = []
    for (conv, turn, _), own in zip(rows, lines):
        earlier = [(t, ls) for (c, t, _), ls in zip(rows, lines) if c == conv and t is not None and turn is not None and t < turn]
        found = [(level, max((t for t, ls in earlier if (0, n) in ls), default=None)) for level, n in own if level and n]
        votes = Counter(t for level, t in found if level == 1 and t is not None)
        reply = max(votes, key=lambda t: (votes[t], t)) if votes else max((t for t, _ in earlier), default=None)
        out.append((conv, turn, reply, ",".join(map(str, sorted({t for _, t in found if t is not None}))),
                    sum(level > 0 for level, _ in own), sum(t is not None for _, t in found), max((level for level, _ in own), default=0)))
    return sorted(out, key=repr)


LINKS = ["conv_id", "turn", "reply_to", "quoted_turns", "n_quoted", "n_linked", "max_level"]


def test_quotes_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quotes, "SEGMENT", 3)
    monkeypatch.setattr(quotes, "ENDS", 2)
    random.seed(11)
    pool = ["alpha", "Beta!", "  gamma, delta", "---", "", "ok", "tEn eleven"]
    rows = []
    for conv in [1, 2, None] * 2:
        for _ in range(30):
            text = random.choice(["\n", "\r\n"]).join(random.choice(["", "", "> ", ">> ", " >  > ", ">"]) + random.choice(pool) for _ in range(random.randint(1, 5)))
            rows.append((conv, random.choice([None, *range(25)]), random.choice([text, text, text, None, ""])))
    rows += rows[:20] + [(7, 4, "> alpha")] * 5
    frame = spark.createDataFrame([(c, t, "u", x, 1, 2) for c, t, x in rows], "conv_id long, turn long, role string, text string, conv int, segment int")
    got = [tuple(r) for r in quotes.linked_messages(frame).select(*LINKS).collect()]
    assert sorted(got, key=repr) == brute_links(rows)
    assert quotes.linked_messages(frame.limit(0)).count() == 0


def test_mail_lines_are_those_of_the_written_mail(spark, monkeypatch):
    monkeypatch.setattr(quotes, "SEGMENT", 4)
    random.seed(5)
    rows = [(c, t, "u", "\n".join(random.choice(["one", "two", "> three", "Four."]) for _ in range(random.randint(1, 3))))
            for c in (1, None, 3) for t in sorted(random.sample(range(60), 25))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    mail = quotes.as_mail(frame)
    got = quotes.linked_messages(frame, quotes.mail_lines(frame)).select(*LINKS).collect()
    assert sorted(map(tuple, got), key=repr) == brute_links([(r.conv_id, r.turn, r.text) for r in mail.collect()])


def test_rows_without_a_turn_stay_apart(spark):
    rows = [(1, None, "u", f"> line {i}\nown {i}") for i in range(5)] + [(1, None, "u", None)]
    got = quotes.linked_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(r.own_text for r in got) == ["", *[f"own {i}" for i in range(5)]] and sum(r.n_quoted for r in got) == 5


def test_short_terms_are_found_misspelt():
    lexicon = toxicity.Lexicon({"scum": 3.0, "oaf": 2.0, "idio*": 1.0}, frozenset({"scam"}))
    assert [lexicon.match(w) for w in ("scum", "scvm", "scuum", "scm", "scam", "scvn")] == [("scum", 0), ("scum", 1), ("scum", 1), ("scum", 1), None, None]
    assert lexicon.match("oaf") == ("oaf", 0) and lexicon.match("oat") is None and lexicon.match("idxot") is None
    assert lexicon.features(["you are scvm"], lexicon.memo())[0][1] > 0


def brute_repeats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    return len({i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)})


@pytest.mark.parametrize("bits", [32, 60])  # 60: four bits of hash, so most windows share theirs
def test_repeats_where_hashes_collide(spark, monkeypatch, bits):
    monkeypatch.setattr(cascade, "PLACE_BITS", bits)
    random.seed(bits)
    texts = [" ".join(random.choices("abcdefg", k=n)) for n in (0, 1, 2, 3, 4, 9, 40, 200)] + ["x y " * 50, "a b c d a b c", None]
    texts += [" ".join(random.choices([f"w{i}" for i in range(60)], k=400))]
    got = cascade.counted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_repeat_words for r in got} == {i: brute_repeats(t) for i, t in enumerate(texts)}


def test_rules_go_by_rejections_left_per_cost(spark, monkeypatch):
    low = [cascade.Rule(name, F.col("n_words") % 100 < n) for name, n in (("a", 60), ("b", 50), ("c", 10))] + [cascade.Rule("d", F.col("n_words") % 100 >= 90)]
    monkeypatch.setattr(cascade, "rule_costs", lambda sample, rules: {"a": 1.0, "b": 0.5, "c": 0.001, "d": 1.0})
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(100 + i))) for i in range(100)], "doc_id long, text string")
    # c is nearly free; then b rejects 40 in half a second, d and a 10 each of what is left in one: the first named goes first.
    assert [r.name for r in cascade.ordered_rules(docs, low)] == ["c", "b", "a", "d"]
    assert cascade.ordered_rules(docs.limit(0), low)


def test_rules_against_plain_python(spark, small):
    """kept by the eight rules, each said anew."""
    import unicodedata

    import regex

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    want = {}
    for r in docs.collect():
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        n, chars = len(words), sum(map(len, words))
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        letters = sum(unicodedata.category(c)[0] == "L" for c in text)
        bad = [
            n < 50 or 100 * brute_repeats(text) > 50 * n, chars < 2 * n or chars > 15 * n, 10 * len(re.findall(r"[#*$%&|<>]", text)) > n,
            10 * (len(lines) - len(set(lines))) > 3 * len(lines), 10 * letters < 6 * chars,
            2 * sum(unicodedata.category(c) == "Lu" for c in text) > letters,
            10 * sum(any(unicodedata.category(c)[0] == "L" for c in w) for w in words) < 8 * n,
            10 * len(regex.findall(r"(?m)(?:\.\.\.|\u2026)[ \t]*$", text)) > 3 * len(lines), 10 * len(regex.findall(r"(?m)^[ \t]*[-*\u2022]", text)) > 9 * len(lines)]
        want[r.doc_id] = not any(bad)
    got = {r.doc_id: r.kept for r in cascade.judged(docs).collect()}
    assert got == want and len(set(want.values())) == 2


def test_contained_excerpts_never_score_zero():
    rng = np.random.default_rng(8)
    errors, unknown = [], 0
    long = np.sort(rng.integers(0, 1 << 64, 20_000, np.uint64))
    whole = sketch.sketch(long, 16, 32)
    for _ in range(300):
        part = np.sort(rng.choice(long, 20, replace=False))
        near, inside = sketch.likeness(sketch.sketch(part, 16, 32), whole)
        unknown += inside is None
        errors += [] if inside is None else [1 - inside]
        assert 0 <= near <= 1
    assert errors and max(errors) == 0 and 0.18 < unknown / 300 < 0.38
    none = sketch.sketch(long[:0], 16, 32)
    assert sketch.likeness(none, none) == (1, 1) and sketch.likeness(none, whole) == (0, 0) and sketch.likeness(whole, none) == (0, 0)


def test_texts_are_taken_up_in_slices(spark):
    """What a task makes of texts at once doesn't follow the size of Spark's batches."""
    from types import SimpleNamespace

    class Bounded:  # stands for the flags of wanted documents, and for the models
        def __getitem__(self, slots):
            assert len(slots) <= 1024
            return np.ones(len(slots), bool)

        def scores(self, texts, memo=None):
            assert len(texts) <= 1024
            return [("en", 0.5)] * len(texts) if memo is None else np.full(len(texts), 0.5)

        lexicon = SimpleNamespace(memo=dict)

    local = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda model: SimpleNamespace(value=model)))
    docs = spark.range(5000).coalesce(1).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words and the number "), "id").alias("text"))
    assert signature_join.wanted_sets(docs, SimpleNamespace(value=Bounded()), 5).count() == 5000
    assert docs.select(language.predicted(F.col("text"), Bounded(), local).alias("p")).where("p.score = 0.5").count() == 5000
    assert docs.select(toxicity.score_of(F.col("text"), Bounded(), local).alias("s")).where("s = 0.5").count() == 5000
