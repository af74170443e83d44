"""Operators against plain Python versions, on hot ids, clashing column names and empty or odd tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from vigilframe.llm import language, separators, signature_join, sketch, url_tree
from vigilframe.llm.queries import QUERIES, TOKENIZER, URL_RULES

WORD = 1 << 64


def hot_documents(spark):
    """A third without an id, a third with one id, the others with ids of their own; some texts repeat."""
    random.seed(11)
    rows = []
    for i in range(240):
        text = " ".join(random.choice("abcdefghij") * random.randint(1, 6) for _ in range(random.randint(0, 40)))
        rows.append((None if i % 3 == 0 else 100 if i % 3 == 1 else i, None if i % 50 == 0 else text))
    rows += [(100, "again and again"), (100, "again and again"), (None, ""), (-(1 << 62), "low"), ((1 << 53) + 1, "high"), ((1 << 53) + 2, "higher")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows


def test_next_documents_where_ids_are_hot(spark):
    docs, rows = hot_documents(spark)
    marks = {r.text: r.m for r in docs.select("text", F.xxhash64("text").alias("m")).collect()}
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), marks[r[1]], r[1] or ""))
    want = Counter()
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        want[(doc, len(text), hashlib.sha256(edited.encode()).hexdigest())] += 1
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in sketch.fingerprints(docs).collect())
    assert got == want


def test_hot_ids_are_cut_into_buckets(spark):
    docs = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 1, 7).when(F.col("id") % 3 == 2, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    rows, n = sketch.with_next(docs, 12)
    sizes = [r["count"] for r in rows.groupBy("bucket").count().collect()]
    assert len(sizes) == n and max(sizes) < 1.6 * 30_000 / 12 and sum(sizes) == 30_000 + n


@pytest.mark.parametrize("few", [10_000, 0])
def test_crowded_token_files_are_cut(spark, monkeypatch, tmp_path, few):
    monkeypatch.setattr(separators, "FEW", few)
    docs, rows = hot_documents(spark)
    placed = separators.with_file(docs, 4).collect()
    assert Counter((r.doc_id, r.text) for r in placed) == Counter(rows)
    sizes = Counter(r.file for r in placed)
    texts = Counter((r.doc_id, r.text) for r in placed)
    assert max(sizes.values()) <= 16 + max(texts.values()) and sum(f >= separators.FAR for f in sizes) > 20
    assert all(r.file == r.doc_id // 4 for r in placed if r.doc_id is not None and r.doc_id != 100 and r.file < separators.FAR)
    whole = Tokenizer.from_file(TOKENIZER)
    want = Counter((d, len(whole.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
    monkeypatch.setattr(separators, "SHARD", 4)
    monkeypatch.setattr(separators.with_file, "__defaults__", (4,))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r.n_tokens) for r in QUERIES["op6_separator_scan"](spark, str(tmp_path)).collect())
    assert Counter(n for _, n in got.elements()) == Counter(n for _, n in want.elements())
    assert Counter(d for d, _ in got.elements()) == Counter(d for d, _ in want.elements())
    assert {k: n for k, n in got.items() if k[0] not in (None, 100)} == {k: n for k, n in want.items() if k[0] not in (None, 100)}


def test_clashing_column_names(spark):
    names = ["__cls", "__spread", "__id", "__kept", "__row", "__judged", "__source", "__copy", "c0", "c1", "a.b", "root", "none"]
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "one two three four five six seven"), (3, "")], "doc_id long, text string")
    docs = docs.select("doc_id", F.lit("en").alias("lang"), "text", F.lit("s").alias("source"), *[F.lit(i).alias(n) for i, n in enumerate(names)])
    kept = signature_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "en", "one two three four five six seven", "s", *range(13)), (3, "en", "", "s", *range(13))]
    same = corpus_pipeline.kept(docs, F.length("text"), lambda n: n > 0)
    assert same.columns == docs.columns and same.count() == 2
    mixed = corpus_pipeline.mix_sources(spark, docs.drop("a.b"), "")
    assert mixed.columns == docs.drop("a.b").columns


def odd_tables(spark, small, path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `__judged` string")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline_on_an_empty_table(spark, small, tmp_path):
    assert corpus_pipeline.run(spark, odd_tables(spark, small, tmp_path, [])).count() == 0


def test_pipeline_on_odd_rows(spark, small, tmp_path):
    given = [r for r in spark.read.parquet(f"{small}/documents.parquet").collect() if r.text]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "x") for r in given]
    texts = [f"plain sentence number {w} of a report on trade between the two towns and their {w} harbours" for w in ("one", "seven")]
    rows += [(None, t, None, None, None, None) for t in texts] + [(10**6, None, "en", None, None, None), (10**6 + 1, "", "en", "x", 0, "x"), (10**6 + 2, "!!! 12", "en", "x", 0, "x")]
    rows += [rows[0], rows[0]]
    pieces = corpus_pipeline.run(spark, odd_tables(spark, small, tmp_path, rows)).collect()
    ids = {p.doc_id for p in pieces}
    assert None in ids and not ids & {10**6, 10**6 + 1, 10**6 + 2}
    assert ids <= {r[0] for r in rows}
    assert all(p.offset + p.length <= 2048 for p in pieces)


def plain_buckets(text):
    """Buckets of a text's n-grams, one gram at a time."""
    if not any(c.isalpha() for c in text):
        return []
    line = " " + re.sub("\0+", " ", "".join(c if c.isalpha() else "\0" for c in text.lower())) + " "
    out = []
    for order in language.ORDERS:
        for i in range(len(line) - order + 1):
            h = 0
            for c in line[i : i + order]:
                h = ((h << 21) | ord(c)) % WORD
            h = h * (2 * order + 1) % WORD
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                h = (h ^ (h >> shift)) * factor % WORD
            out.append((h ^ (h >> 31)) % language.BUCKETS)
    return out


def plain_language(taught, text, smoothing):
    counts, rows = defaultdict(Counter), Counter()
    for lang, t in taught:
        counts[lang].update(plain_buckets(t))
        rows[lang] += 1
    grams = plain_buckets(text or "")
    if not grams:
        return "und", 0.0
    logits = {}
    for lang in sorted(rows):
        total = sum(counts[lang].values()) + smoothing * language.BUCKETS
        log = np.log(rows[lang] / sum(rows.values())) + sum(np.log((counts[lang][g] + smoothing) / total) for g in grams)
        logits[lang] = log / np.sqrt(len(grams))
    best = max(logits, key=logits.get)
    return best, 1 / sum(np.exp(v - logits[best]) for v in logits.values())


def test_language_equals_plain_bayes(spark):
    taught = [("en", "The ships left the harbour, and the crew sang."), ("en", "A report of the year 1999!"), ("de", "Die Schiffe verließen den Hafen."),
              ("fr", "Les navires ont quitté le port; l'été."), ("es", "Los barcos salieron del puerto."), ("es", "¿Qué año?")]
    asked = [t for _, t in taught] + [None, "", "123 !", "x", "the harbour of the ship", "é", "Straße İstanbul 東京", "port " * 500]
    model = language.learnt(spark.createDataFrame(taught, "lang string, text string"))
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    for r in language.with_language(docs, model).collect():
        lang, score = plain_language(taught, asked[r.doc_id], 0.1)
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-3), asked[r.doc_id]


def plain_templates(paths, levels, most_children=16, mass=2.0, z=1.0):
    """{(host, path): template} by walking the tree level by level."""
    prior = (sum(p[4] for p in paths) + 1) / (sum(p[3] for p in paths) + 2)
    parts = {}
    for host, path, *_ in paths:
        cut = re.sub("^/", "", path).split("/", levels - 1)
        parts[host, path] = ["*" if re.fullmatch("[0-9]+([.][A-Za-z0-9]+)?", p) else p for p in cut]
    at = {k: "" for k in parts}
    for level in range(max(map(len, parts.values()))):
        nodes = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
        for host, path, *numbers in paths:
            if level < len(parts[host, path]):
                child = nodes[host, at[host, path]][parts[host, path][level]]
                for i in range(3):
                    child[i] += numbers[i]
        names = {}
        for node, children in nodes.items():
            visits = sum(c[0] for c in children.values())
            if len(children) > most_children or (len(children) >= 4 and visits < 2 * len(children)):
                names |= {(node, p): "*" for p in children}
                continue
            order = []
            for part, (_, seen, bad) in children.items():
                p = (bad + mass * prior) / (seen + mass)
                order.append((part == "*", p, part, p * (1 - p) / (seen + mass)))
            branches, last = [], None
            for child in sorted(order):
                if last is None or child[0] != last[0] or child[1] - last[1] > z * (child[3] + last[3]) ** 0.5:
                    branches.append([])
                branches[-1].append(child[2])
                last = child
            for branch in branches:
                names |= {(node, p): "|".join(sorted(branch)) for p in branch}
        for key in at:
            if level < len(parts[key]):
                at[key] = f"{at[key]}/{names[(key[0], at[key]), parts[key][level]]}"
    return at


@pytest.mark.parametrize("levels", [2, 8])
def test_templates_equal_a_plain_walk(spark, levels):
    random.seed(5)
    paths = set()
    for _ in range(500):
        path = "/" + "/".join(random.choice(("en", "de", "news", "7", "2024", "a.b", "", f"t{random.randint(0, 30)}")) for _ in range(random.randint(0, 4)))
        paths.add((random.choice(("h.com", "i.org", "")), path))
    paths = [(h, p, n, s := random.randint(0, n), random.randint(0, s)) for h, p in sorted(paths) for n in [random.randint(1, 6)]]
    frame = spark.createDataFrame(paths, "host string, path string, n long, seen long, bad long")
    got = {(r.host, r.path): r.template for r in url_tree.templates(frame, levels=levels).collect()}
    assert got == plain_templates(paths, levels)


def test_verdicts_equal_plain_shares(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    rows = url_tree.judged_urls(pages, URL_RULES).collect()
    says = {t: v for t, v in URL_RULES}
    paths = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        c = paths[r.host, r.path]
        c[0] += 1
        c[1] += r.rule is not None
        c[2] += says.get(r.rule) == "block"
    names = plain_templates([(*k, *v) for k, v in paths.items()], 8)
    share = lambda bad, seen, prior: (bad + 2 * prior) / (seen + 2)
    sums = defaultdict(lambda: [0, 0])
    for (host, path), (_, seen, bad) in paths.items():
        for key in (None, host, (host, names[host, path])):
            sums[key][0] += bad
            sums[key][1] += seen
    whole = (sums[None][0] + 1) / (sums[None][1] + 2)
    for r in rows:
        want = share(*sums[r.host, r.template], share(*sums[r.host], whole))
        assert r.template == names[r.host, r.path] and r.blocked_share == pytest.approx(want)
        if abs(want - 0.5) > 1e-9:
            assert r.verdict == (says[r.rule] if r.rule else "block" if want >= 0.5 else "allow")
