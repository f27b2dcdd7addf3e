"""The operators and their queries, against brute force and SQL on small tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

import corpus_pipeline
from tarnwell.llm import chat, components, decontam, exact, html, jaccard, licences, mixing, packing, quality, registry, tokens, toxicity
from tarnwell.sources import staged

SF = "/root/testdata/sf0.001"
DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def odd_rows():
    """Nulls, empty and long texts, ties, rows that repeat, and ids beyond 2^53."""
    r = random.Random(1)
    base = " ".join(f"w{r.randrange(2000)}" for _ in range(120))
    near = base.replace(base.split()[60], "zz", 1)
    big = 2**60 + 1
    long = " ".join(f"v{r.randrange(5000)}" for _ in range(30_000))
    return [(1, base, "a"), (2, base, "b"), (3, near, None), (4, None, "a"), (5, "", "b"), (6, "one two", "c"), (7, "one two", "c"), (7, "one two", "c"), (big, long, "a"), (big + 1, long, "a"), (None, "lonely text of some six words", "a"), (9, "   \n", None)]


def sql(query, name="documents", sf=SF):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = con.execute(query)
    return [c[0] for c in got.description], got.fetchall()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    columns, want = sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, SF).select(*columns).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_exact_dedup_on_odd_rows(spark):
    rows = odd_rows()
    frame = docs_of(spark, rows).withColumns({"kept": F.lit("x"), "f1": F.lit(1), "n": F.lit(2), "id": F.lit(3)})
    got = exact.exact_dedup(frame).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    for r in got:
        members = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256 and r.doc_id in g)
        assert r.group_size == len(members) and r.keep_id == max(members, key=lambda x: (x is not None, x))
    assert sum(r.kept for r in got) == len(groups)
    assert exact.exact_dedup(docs_of(spark, [])).count() == 0


def test_colliding_fingerprints_drop_nothing(spark, monkeypatch):
    constant = F.udf(lambda t: (1, 1), "f1 long, f2 long")
    monkeypatch.setattr(exact, "_fingerprint", constant)
    rows = [(i, t, "a") for i, t in enumerate(["aaaa", "bbbb", "aaaa", "cccc", "bbbb", "dddd", "aaaa"])]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(docs_of(spark, rows)).collect()}
    assert got == {0: (6, 3, False), 1: (4, 2, False), 2: (6, 3, False), 3: (3, 1, True), 4: (4, 2, True), 5: (5, 1, True), 6: (6, 3, True)}


def test_fingerprints_of_documents_in_chunks(spark):
    whole = [(1, b"abc" * 5000), (2, b""), (3, b"xyz")]
    chunks = [(d, k, b[at : at + 4000]) for d, b in whole for k, at in enumerate(range(0, max(1, len(b)), 4000))]
    got = {r.d: (r.n_bytes, r.f1, r.f2) for r in exact.fingerprint_chunks(spark.createDataFrame(chunks, "d long, k int, b binary"), "d", "k", "b").collect()}
    want = exact._pack(exact.fingerprints_of([b for _, b in whole]))
    assert got == {d: (len(b), f1, f2) for (d, b), f1, f2 in zip(whole, want.f1, want.f2, strict=True)}


def brute_classes(rows):
    sets = [set(s.tolist()) for s in jaccard._sets([t for _, t, _ in rows])]
    n = len(rows)
    near = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], min(ids) if ids else None, len(near[i])))
    return out


def near_rows(seed, texts=40):
    r = random.Random(seed)
    rows = []
    for _ in range(texts):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randrange(40, 200))]
        for _ in range(r.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(r.randrange(0, 6)):
                copy[r.randrange(len(copy))] = f"x{r.randrange(3000)}"
            rows.append((len(rows) * 3 + 1, " ".join(copy), r.choice("abc")))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_join_is_that_of_all_pairs(spark, monkeypatch, small):
    if small:  # every bucket splits to the last level, every cluster is cut into blocks
        for k, v in (("SMALL", 1), ("BLOCK_SKETCHES", 2), ("BLOCK_SETS", 2)):
            monkeypatch.setattr(jaccard, k, v)
        monkeypatch.setattr(jaccard, "RUNS", 60)
    rows = near_rows(4, 25 if small else 60) + odd_rows()
    frame = docs_of(spark, rows).withColumns({"rep": F.lit(1), "class_id": F.lit(2), "xx": F.lit("a")})
    got = [(r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_classes(frame).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_classes(rows)))


def test_jaccard_join_moves_a_sketch_once_however_many_buckets_its_set_is_in(spark):
    rng = np.random.default_rng(5)
    sig = rng.integers(0, 1 << 32, (40, jaccard.COORDINATES), dtype=np.uint32)
    sketches = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sig)], "rep long, sig binary")
    rows = [(int(b), i, i % 3) for i in range(30) for b in rng.integers(-(1 << 63), (1 << 63) - 1, i % 7 + 1)]
    members = staged.stage(spark.createDataFrame(rows, "bucket long, rep long, comp long"))
    met = jaccard._with_sketches(members, sketches)
    assert met.count() == 30  # and not a row for each bucket
    assert sorted((r.bucket, r.rep, r.comp) for r in met.select("rep", "comp", F.inline("own")).collect()) == sorted(rows)
    assert all(bytes(r.sig) == sig[r.rep].tobytes() for r in met.collect())
    got = sorted(map(tuple, met.mapInPandas(jaccard._split, jaccard._MEMBERS).collect()))
    want = set()
    for b, i, c in rows:
        _, paths = jaccard.children(sig[i : i + 1], np.array([0]), np.array([b], np.int64).view(np.uint64))
        want |= {(int(p), i, c) for p in paths.view(np.int64)}
    assert got == sorted(want) and want


def test_jaccard_join_keeps_one_of_each_class_and_takes_an_empty_table(spark):
    rows = odd_rows()
    got = jaccard.jaccard_classes(docs_of(spark, rows)).collect()
    kept = [r for r in got if r.kept]
    assert len(kept) == 7 and all(r.doc_id == r.class_id for r in kept)
    assert jaccard.jaccard_classes(docs_of(spark, [])).count() == 0


def test_components_of_paths_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 202), (202, 200)] + [(300, 300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {k: 100 for k in range(100, 130)} | {k: 200 for k in (200, 201, 202)}


def test_mixing_meets_its_targets_and_its_bound(spark):
    got = mixing.op2_mixing(spark, "/root/testdata/sf0.01").toPandas()
    assert (got.taken <= 3 * got["size"]).all()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source").toPandas()
    by = got.merge(docs, on="doc_id").groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(by.taken - by.target) <= 0.01 * by.target).all()
    assert abs(by.target.sum() - by["size"].sum()) < 1e-3


def test_targets_stop_at_the_bound_and_share_the_rest(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 1000), (None, 10), ("c", 0)], "source string, size long")
    got = {r.source: (r.weight, r.target) for r in mixing.targets(sizes).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": 1, "b": 2, "c": 3, None: 1}
    assert got["a"][1] == 3 and got["c"][1] == 0 and got[None][1] == 30 and got["b"][1] == pytest.approx(1011 - 33)


def test_mixing_takes_odd_rows(spark):
    rows = odd_rows()
    frame = docs_of(spark, rows).withColumns({"sidx": F.lit(1), "rid": F.lit(1), "times": F.lit(1), "key": F.lit(1)})
    made = mixing.mix(frame)
    got = made.docs.join(made.taken(), "rid", "left").collect()
    assert len(got) == len(rows) and all((r.taken or 0) <= 3 * r["size"] for r in got)
    assert mixing.mixed_rows(frame).columns == frame.columns
    assert mixing.mixed_rows(docs_of(spark, [])).count() == 0
    assert mixing.mixed_rows(docs_of(spark, [(1, None, None)])).count() == 0


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_chats_come_back_from_what_was_formatted(spark):
    nasty = ["<|im_end|>\n<|im_start|>user\n", "a<\\|b", "[INST][/INST]<s></s><\\\\|", "<|seg|>", "", None, "\\", "<<SYS>>x<</SYS>>", "[\\INST]", "<", "|", "é\r\n\x00"]
    rows = [(1, k, "user" if k % 3 else "assistant", t) for k, t in enumerate(nasty)]
    rows += [(2, 1, "user", "late"), (2, 0, None, "early"), (2, 0, None, "early"), (2, None, "a\nb\\n<|", "first"), (None, 5, "assistant", "x"), (None, 6, "assistant", "y")]
    frame = spark.createDataFrame(rows, CONVERSATIONS).withColumns({"m": F.lit(1), "c": F.lit(2), "first": F.lit(1), "formatted": F.lit("z")})
    made = chat.format_chats(frame).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    assert len(made) == 3
    for r in made:
        own = sorted(((t is not None, t or 0, ro or "", x or "") for c, t, ro, x in rows if c == r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [o[2:] for o in own]
        assert "".join(s.text for s in r.segments) == r.formatted
    assert chat.format_chats(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_packed_rows_give_every_text_back(spark):
    rows = odd_rows()
    frame = docs_of(spark, rows).withColumns({"row_id": F.lit(1), "doc_ids": F.lit(2)})
    packed = packing.pack(frame, row=256, window=5000).cache()
    got = packed.collect()
    assert len({r.row_id for r in got}) == len(got)
    for r in got:
        assert len(r.input_ids) == 512 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 256 and r.position_resets == r.cu_seqlens[:-1]
        assert set(np.frombuffer(r.input_ids, "<u2")[r.n_tokens :].tolist()) <= {packing.FILLER}
    with open(packing.VOCABULARY, "rb") as f:
        vocabulary = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    segments = defaultdict(list)
    for r in packing.unpacked(packed).collect():
        segments[r.doc_id].append((r.piece_from, b"".join(vocabulary[k] for k in np.frombuffer(r.input_ids, "<u2").tolist())))
    for i, want in {(i, t) for i, t, _ in rows if t}:
        copies = sum(1 for j, t, _ in rows if (j, t) == (i, want))
        text = b"".join(b for _, b in sorted(segments[i])).decode()
        assert text == want if copies == 1 else len(text) == copies * len(want)
    assert None not in {r for r in segments} or any(i is None for i, _, _ in rows)
    assert packing.pack(docs_of(spark, [])).count() == 0


def test_decontamination_finds_what_brute_force_finds(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontam.op8_decontamination(spark, SF).collect()}
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    bench = {r.item_id: words(r.text) for r in items.collect()}
    want = set()
    for r in docs.collect():
        w = " ".join(words(r.text))
        want |= {(r.doc_id, k) for k, b in bench.items() if f" {' '.join(b)} " in f" {w} "}
    assert got == want and want


def test_decontamination_in_parts_and_on_odd_rows(spark, monkeypatch):
    items = spark.createDataFrame([(1, odd_rows()[0][1]), (2, "lonely text of some six words"), (3, None), (4, "")], "item_id long, text string")
    frame = docs_of(spark, odd_rows()).withColumns({"item_id": F.lit(1), "id": F.lit(2)})
    want = {(1, 1), (2, 1), (3, 1), (None, 2)}
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(frame, items).collect()} == want
    monkeypatch.setattr(decontam, "PART_WORDS", 40)
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(frame, items).collect()} == want
    assert decontam.overlaps(frame, items.limit(0)).count() == 0 and decontam.overlaps(docs_of(spark, []), items).count() == 0


def test_extraction_query_reads_articles(spark):
    import html as std

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in html.op5_html_extraction(spark, SF).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(std.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article.replace("<br>", " "))]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_extraction_query_is_that_of_pages_folded_one_by_one(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    slots, roots = {}, {}
    for i, url, page in rows:
        host = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", url)[1].lower()
        roots[i] = host, html.parse(page)
        slot = html.Slot(html.Folded([roots[i][1]]))
        slots[host] = html.merge(slots[host], slot) if host in slots else slot
    read = {i: html.read(root, slots[host]) for i, (host, root) in roots.items()}
    assert sum(by for _, by in read.values()) >= 0.8 * len(rows)  # the template names the region
    got = {r.page_id: r.text for r in html.op5_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: "\n".join(blocks) for i, (blocks, _) in read.items()}


def test_counts_of_templates_are_those_of_all_pages(spark):
    from .test_numpy_parts import rotating_pages

    made, texts = rotating_pages(120)
    rows = [(i, "http://a/x", p) for i, p in enumerate([*made, *made[:30]])]  # copies of a page are one page
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    assert {r.page_id: r.text for r in html.main_text(frame).collect()} == dict(enumerate([*texts, *texts[:30]]))
    pages = spark.read.parquet(f"{SF}/pages.parquet").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), "html")
    both = pages.unionByName(frame.select(F.lit("a").alias("host"), "html"))
    got = {r.host: html.pickle.loads(r.template) for r in html.templates(both).collect()}
    stood = {}
    for r in both.collect():
        root = html.parse(r.html)
        stood.setdefault(r.host, {}).update({html._page(root)[0]: 1})
        number = {id(x): i for i, x in enumerate(html.preorder(got[r.host]))}
        out = []
        html.standing(got[r.host], html.Mark(html.marks(html.Slot(html.Folded([root])))), number, out)
        for i, content, n in out:
            at = stood.setdefault((r.host, i), {})
            was = at.get(html._page(root)[0], (content, n))
            at[html._page(root)[0]] = min(content, was[0]), max(n, was[1])
    for host, template in got.items():
        assert template.counts[0] == len(stood[host])
        for i, x in enumerate(html.preorder(template)):
            seen = stood.get((host, i), {}).values()
            assert x.counts == (len(seen), len({c for c, _ in seen}), sum(n for _, n in seen))


def test_extraction_takes_odd_pages(spark):
    rows = [(1, "http://a/x", None), (2, None, "<p>hi"), (3, "nonsense", ""), (None, "http://a/y", "<p>a<p>b"), (1, "http://a/x", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "template": F.lit(2), "text": F.lit(3)})
    got = sorted(((r.page_id, r.text) for r in html.main_text(frame).collect()), key=repr)
    assert got == sorted([(1, ""), (1, ""), (2, "hi"), (3, ""), (None, "a\nb")], key=repr)
    assert html.main_text(frame.limit(0)).count() == 0


@pytest.mark.parametrize(("name", "least"), [("op7_toxicity", 0.75), ("op10_quality", 0.95)])
def test_classifiers_on_what_they_were_not_fitted_on(spark, name, least):
    sf = "/root/testdata/sf0.01"
    got = registry.queries()[name](spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    held = got[got.held_out].merge(labels, on="doc_id")
    y, s = held["toxic" if name == "op7_toxicity" else "quality"], held.score
    auc = np.mean([(s[y == 1].to_numpy()[:, None] > s[y == 0].to_numpy()).mean() + 0.5 * (s[y == 1].to_numpy()[:, None] == s[y == 0].to_numpy()).mean()])
    assert auc >= least
    assert got.score.between(0, 1).all() and ((got.score >= 0.5).astype(int) == got.predicted).all()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_scores_are_those_of_plain_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels.select("doc_id", F.col("toxic").alias("y")), toxicity.held_out)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.score, r.predicted, r.held_out) for r in toxicity.op7_toxicity(spark, SF).collect()}
    for i, text in texts.items():
        total = model.bias
        for word in set(re.findall(r"[^\W_]+", (text or "").lower())):
            total += sum(float(model.weights[f]) for f in set(toxicity.features(word)))
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        assert got[i][0] == pytest.approx(p, abs=1e-4) and got[i][1] == int(got[i][0] >= 0.5) and got[i][2] == (zlib.crc32(str(i).encode()) % 5 == 0)
    net = quality.train(docs, labels.select("doc_id", F.col("quality").alias("y")), quality.held_out)
    for r in quality.op10_quality(spark, SF).collect():
        assert r.score == quality.score_texts(net, [quality._bytes(texts[r.doc_id])])[0] and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_small_sources_meet_their_targets_beside_any_corpus(spark):
    r = random.Random(9)
    rows = [(i, " ".join("w" for _ in range(r.randrange(1, 400))), "big" if i % 40 else f"s{i // 40}") for i in range(1200)]
    for slots in (50, 1 << 20):
        made = mixing.mix(docs_of(spark, rows), slots=slots)
        by = made.docs.join(made.taken(), "rid", "left").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("size").alias("size")).collect()
        assert all(abs((x.taken or 0) - x.target) <= max(1, 0.01 * x.target) for x in by if x.source != "big")
        got = made.docs.join(made.taken(), "rid", "left").collect()
        assert all((x.taken or 0) <= 3 * x["size"] for x in got)


def test_classifiers_take_odd_rows_and_no_labels(spark):
    frame = docs_of(spark, odd_rows())
    none = spark.createDataFrame([], "doc_id long, y int")
    some = spark.createDataFrame([(1, 1), (3, 0), (3, 0), (None, 1), (6, None)], "doc_id long, y int")
    never = lambda c: F.lit(False)
    for labels in (none, some):
        for module in (toxicity, quality):
            got = frame.select(module.probability(spark, module.train(frame, labels, never))("text").alias("p")).collect()
            assert len(got) == len(odd_rows()) and all(0 <= r.p <= 1 for r in got)
    empty = docs_of(spark, [])
    assert empty.select(quality.probability(spark, quality.train(empty, none, never))("text")).count() == 0
    assert empty.select(toxicity.probability(spark, toxicity.train(empty, none, never))("text")).count() == 0


def test_licence_query_finds_every_line_of_a_licence(spark):
    got = {(r.doc_id, r.paragraph) for r in licences.op9_licence_scan(spark, SF).collect()}
    want = {(r.doc_id, k) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for k, p in enumerate(r.text.split("\n")) if re.search("licen[sc]e", p, re.I)}
    assert got == want
    odd = docs_of(spark, [*odd_rows(), (77, "x\nReleased under the MIT License.", "a")])
    assert [(r.doc_id, r.paragraph, r.licence) for r in licences.scan(odd, licences.train(odd)).collect()] == [(77, 1, "MIT")]
    assert licences.scan(docs_of(spark, []), licences.train(docs_of(spark, []))).count() == 0


def test_pipeline_stages_do_what_brute_force_does(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_classifier(spark, docs, SF).cache()
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(good - {r.doc_id for r in kept.collect()}) <= 0.02 * len(good) and kept.columns == docs.columns
    unique = corpus_pipeline.jaccard_join(spark, kept, SF).cache()
    rows = [(r.doc_id, r.text, r.source) for r in kept.collect()]
    assert {r.doc_id for r in unique.collect()} == {c for _, c, _ in brute_classes(rows)}
    clean = corpus_pipeline.benchmark_decontamination(spark, unique, SF).cache()
    leaks = {r.doc_id for r in decontam.op8_decontamination(spark, SF).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in unique.collect()} - leaks
    mixed = corpus_pipeline.mix_sources(spark, clean, SF)
    assert mixed.columns == docs.columns and mixed.exceptAll(mixed).count() == 0 and mixed.distinct().exceptAll(clean).count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select(F.explode("doc_ids").alias("doc_id")).collect()} <= {r.doc_id for r in clean.collect()}


def test_the_pipeline_gives_what_plain_loops_give(spark):
    """Quality by scoring each text alone, classes by all pairs, items by their words, the mixture by its SQL, and the
    packed rows read back."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    net = quality.train(docs, labels, quality.held_out)
    rows = [r for r in rows if quality.score_texts(net, [quality._bytes(r[1])])[0] >= 0.5]
    first = {c for _, c, _ in brute_classes(rows)}
    rows = [r for r in rows if r[0] in first]
    words = lambda t: " " + " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())) + " "
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(i in words(r[1]) for i in items)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    times = {i: int(taken / size + 0.5) if size else 0 for i, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.OP2_SQL})").fetchall()}
    with open(packing.VOCABULARY, "rb") as f:
        encoding = packing._encoding(f.read())
    want = {i: sorted(encoding.encode_ordinary(t) * 1) for i, t, _ in rows if times[i]}
    packed = corpus_pipeline.run(spark, SF).cache()
    got = defaultdict(list)
    for r in packing.unpacked(packed).collect():
        got[r.doc_id] += np.frombuffer(r.input_ids, "<u2").tolist()
    assert set(got) == set(want)
    assert all(sorted(got[i]) == sorted(want[i] * times[i]) for i in want)
    assert all(r.cu_seqlens[-1] == r.n_tokens <= packing.ROW for r in packed.collect())


def test_pipeline_stages_take_columns_of_any_name(spark):
    names = ["_id", "_hash", "_text", "_row", "_own", "row", "own_id", "own_hash", "id", "hash", "key", "kept", "times", "rep"]
    frame = docs_of(spark, odd_rows()).withColumns({n: F.lit(n) for n in names})
    for step, many in ((corpus_pipeline.jaccard_join, 7), (corpus_pipeline.benchmark_decontamination, len(odd_rows()))):
        got = step(spark, frame, SF)
        assert got.columns == frame.columns and got.count() == many and all(r[n] == n for r in got.collect() for n in names)
    assert corpus_pipeline.mix_sources(spark, frame, SF).columns == frame.columns
    assert corpus_pipeline.quality_classifier(spark, frame, SF).columns == frame.columns
    empty = frame.limit(0)
    for step in (corpus_pipeline.quality_classifier, corpus_pipeline.jaccard_join, corpus_pipeline.benchmark_decontamination, corpus_pipeline.mix_sources, corpus_pipeline.token_packing):
        assert step(spark, empty, SF).count() == 0


def test_pipeline_stages_take_odd_rows(spark):
    frame = docs_of(spark, odd_rows())
    assert corpus_pipeline.mix_sources(spark, frame, SF).where("doc_id = 4 OR doc_id = 5").count() == 0  # no words
    assert 0 < corpus_pipeline.token_packing(spark, frame, SF).count()
    assert corpus_pipeline.jaccard_join(spark, frame, SF).count() == 7
    assert corpus_pipeline.benchmark_decontamination(spark, frame, SF).count() == len(odd_rows())
    assert tokens.words([None, ""])[1].tolist() == [0, 0, 0]


def test_decontamination_stage_removes_only_the_rows_that_overlap(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    leaks = [(None, f"before {item} after", "a"), (9, f"{item} again", None)]
    frame = docs_of(spark, [*odd_rows(), *leaks])
    got = corpus_pipeline.benchmark_decontamination(spark, frame, SF)
    assert got.columns == frame.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, docs_of(spark, odd_rows()).collect()), key=repr)
