"""Odd rows, clashing names, large shapes and whole-pipeline results of the training-text operators."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_lines import components as line_groups
from test_lines import plain
from test_operators import RANKS, WORDS, brute_components, shingles, tiktoken_encoding

from palimpsest.llm import decontaminate, html_blocks, lang_id, layouts, pii, token_orc, toxicity


def words_of(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_html_of_unclosed_elements_is_read_in_linear_time():
    model = html_blocks.trained_labeller()
    for tag in ("<div>x ", "<span>x ", "<li>x ", "<p>x ", "<b>x</i> ", "<li></ul>x ", '<a href="', "<div a='"):
        page = tag * (1_000_000 // len(tag))
        start = time.process_time()
        html_blocks.read_blocks(page)
        assert time.process_time() - start < 5, tag
    deep = html_blocks.read_blocks("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after</p>")
    assert [(b.text, b.depth) for b in deep.blocks] == [("deep", 3000), ("after", 1)] and sum(np.sign(deep.steps)) == 0
    pages = [html_blocks.read_blocks("<div>x " * 500), html_blocks.read_blocks("<article><p>Some words of an article, long enough.</article>")]
    alone = [html_blocks.label_pages(model, [p])[0] for p in pages]
    assert all((a == b).all() for a, b in zip(alone, html_blocks.label_pages(model, pages)))  # no page reads another's paths


def test_html_labels_of_unseen_names(monkeypatch):
    model = html_blocks.trained_labeller()
    unseen = {"ARTICLE": ["longread", "prose-wrap"], "SIDE": ["gutter", "flank"], "ADVERT": ["mpu", "leaderboard"], "NOTICE": ["ribbon", "toast"], "MENU": ["crumbs", "drawer"], "SHARE": ["actions", "handles"], "FOOT": ["imprint-bar", "baseline"]}
    for name, values in unseen.items():
        monkeypatch.setattr(layouts, name, values)
    right = total = 0
    for page, wanted in layouts.generate_pages(200, seed=77):
        own = html_blocks.read_blocks(page)
        told = html_blocks.label_pages(model, [own])[0]
        right += sum((b.text in wanted) == bool(t) for b, t in zip(own.blocks, told))
        total += len(told)
    assert right / total > 0.88


def test_languages_without_bound():
    rng = random.Random(41)
    letters = [chr(0x100 + i) for i in range(400)]
    samples = {}
    for k in range(100):
        own = rng.sample(letters, 12)
        samples[f"l{k:03d}"] = ["".join(rng.choice(own) for _ in range(300)).encode() for _ in range(4)]
    model = lang_id.fit({name: texts[:3] for name, texts in samples.items()})
    data = np.frombuffer(b"".join(texts[3] for texts in samples.values()), dtype=np.uint8)
    lengths = model.lengths(data, np.concatenate([[0], np.cumsum([len(t[3]) for t in samples.values()])]))
    assert model.languages == sorted(samples) and (lengths.argmin(1) == np.arange(100)).all()


def test_languages_of_all_byte_values():
    every = bytes(b for b in range(256) if not 65 <= b <= 90)
    rng = random.Random(42)
    shuffled = [bytes(rng.sample(every, len(every))) for _ in range(6)]
    tree = lang_id.grow(shuffled[:5])
    assert len(tree.runs[0]) == 230 and all(len(set(r.tolist())) == len(r) for r in tree.runs)
    model = lang_id.LanguageModel(["x"], [tree])
    text = shuffled[5]
    total = 0.0
    for i, c in enumerate(text):  # the definition, from counts
        p = 1.0
        for k in range(lang_id.ORDER, -1, -1):
            if i < k:
                continue
            after = [t[j + k] for t in shuffled[:5] for j in range(len(t) - k) if t[j : j + k] == text[i - k : i]]
            if not after:
                continue
            n, q = len(after), len(set(after))
            if c in after:
                p *= after.count(c) / (n + q)
                break
            p *= q / (n + q)
        else:
            p /= 256
        total -= np.log(p)
    assert np.isclose(model.lengths(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))[0, 0], total, rtol=1e-5)


def test_foreign_texts_are_told_and_long_samples_learnt(spark):
    rng = random.Random(43)
    kinds = {"aa": ["ta", "ri", "mo", "ne", "lu"], "bb": ["sch", "ung", "ein", "er", "ch"]}
    rows = [(i, words_of(rng, kinds[k], 80), k) for i, k in enumerate(["aa", "bb"] * 120)]
    rows += [(1000 + i, words_of(rng, ["quo", "vix", "zza"], 6000), "long") for i in range(12)]  # every row beyond the sample's bound
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit_on_documents(docs)
    assert model.languages == ["aa", "bb", "long"] and all(np.isfinite(t.limit) for t in model.trees)
    told = lang_id.identify(docs.select("doc_id", "text"), model)
    assert told.where("foreign").count() == 0
    others = ["Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita.", "Het is vandaag mooi weer en de kinderen spelen buiten op straat met hun vrienden bij de haven."]
    strange = spark.createDataFrame([(i, t, True, 1) for i, t in enumerate(others)] + [(9, None, None, None)], "doc_id long, text string, foreign boolean, bits_per_byte int")
    got = {r.doc_id: r for r in lang_id.identify(strange, model).collect()}
    assert got[0].foreign and got[1].foreign and not got[9].foreign and got[9].bits_per_byte is None


def test_token_files_have_stripes_indexes_and_filters(spark, tmp_path):
    rng = random.Random(44)
    docs = spark.createDataFrame([(3 * i, words_of(rng, ["ta", "ri", "mo", "ne"], 120)) for i in range(6000)] + [(6, "again")], "doc_id long, text string")
    path = str(tmp_path / "ids")
    token_orc.write_token_orc(docs, path, WORDS, partitions=1, stripe_bytes=1 << 16, index_stride=1000)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    import glob

    file = jvm.org.apache.hadoop.fs.Path(glob.glob(path + "/*.orc")[0])
    reader = jvm.org.apache.orc.OrcFile.createReader(file, jvm.org.apache.orc.OrcFile.readerOptions(conf))
    rows = reader.rows()
    assert reader.getStripes().size() > 1 and reader.getRowIndexStride() == 1000
    for stripe in reader.getStripes():
        streams = list(rows.readStripeFooter(stripe).getStreamsList())
        assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= {s.getKind().toString() for s in streams}
    rows.close()

    def read(wanted):
        df = spark.read.schema(token_orc.FILE_SCHEMA).orc(path).where(F.col("doc_id").isin(wanted))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        scans = [plan]
        while scans:
            node = scans.pop()
            if "FileSourceScan" in node.getClass().getName():
                return node.metrics().apply("numOutputRows").value()
            if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
                scans.append(node.executedPlan())
            children = node.children()
            scans += [children.apply(i) for i in range(children.size())]

    assert 0 < read([9000]) < 6001 and read([9001]) < read([9000])  # an id that isn't there, within the range of one that is
    again = [(r.start, r.n_tokens) for r in token_orc.read_token_orc(spark, path, [6]).orderBy("start").collect()]
    assert len(again) == 2 and again[0][0] + again[0][1] == again[1][0]


def test_added_tokens_as_the_library_gives_them():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(WORDS), token_orc.PieceEncoder(WORDS)
    rng = random.Random(45)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", " ", "x", "Word.", "é", "\n", "a, b! "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 12))) for _ in range(3000)]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = own.encode(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_account_numbers():
    found = lambda text: [text[a:b] for a, b, k in pii.find_spans(text) if k == "account"]
    assert found("IBAN GB29 NWBK 6016 1331 9268 19 and more") == ["GB29 NWBK 6016 1331 9268 19"]
    assert found("Iban: NL91 ABNA 0417 1643 00. NEXT") == ["NL91 ABNA 0417 1643 00"] and found("iBAN DE89370400440532013000") == ["DE89370400440532013000"]
    assert found("SSN: 123-45-6789") == found("Ssn 123-45-6789") == ["123-45-6789"] and found("iban of nobody") == []
    assert [k for *_, k in pii.find_spans("see Https://example.org/x")] == ["url"]


def test_spans_and_items_under_clashing_names(spark):
    df = spark.createDataFrame([(1, "mail a@b.co", "old", 5, 6), (None, None, None, None, None)], "doc_id long, text string, pii_spans string, items int, d0 int")
    spans = {r.doc_id: r.pii_spans for r in pii.detect_pii(df).collect()}
    assert [tuple(s) for s in spans[1]] == [("email", 5, 11)] and spans[None] == []
    bench = spark.createDataFrame([(7, "mail a@b.co"), (8, "one two three four five six"), (None, "mail a@b.co")], "item_id long, text string")
    for size in (1 << 20, 1):  # in one block, and in one for each item
        got = {r.doc_id: (r["items"], r.d0) for r in decontaminate.find_items(df, bench, block_bytes=size).collect()}
        assert got == {1: ([7], 6), None: ([], None)}


def test_blocks_of_items_find_what_one_block_finds(spark):
    rng = random.Random(46)
    items = [words_of(rng, ["ta", "ri", "mo"], rng.randrange(1, 40)) for _ in range(30)]
    texts = [words_of(rng, ["ta", "ri", "mo"], 60) + " " + rng.choice(items) for _ in range(60)] * 2 + [None, ""]
    docs = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    told = [sorted((r.doc_id, r.text or "", tuple(r["items"])) for r in decontaminate.find_items(docs, bench, block_bytes=size).collect()) for size in (1 << 20, 300)]
    assert told[0] == told[1] and len(told[0]) == len(texts) and any(t[2] for t in told[0])


def test_toxicity_takes_odd_labels(spark):
    rng = random.Random(47)
    docs = spark.createDataFrame([(i, words_of(rng, ["ta", "ri"], 30) + (" zgrog" if i % 4 == 0 else "")) for i in range(200)] + [(None, "x"), (3, None)], "doc_id long, text string")
    rows = [(i, int(i % 4 == 0), "t") for i in range(200)] + [(None, 1, "t"), (5, None, "t"), (4, 1, "t"), (4, 1, "t")]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int, text string")
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.fit_on_documents(docs, labels)).collect()}
    assert scores[8] > scores[9] and len(scores) == 201
    one = toxicity.fit_on_documents(docs, labels.where("toxic = 0"))
    assert 0 <= toxicity.score_toxicity(docs, one).first().score < 0.5


def test_near_duplicates_with_repeated_ids(spark):
    from palimpsest.llm import near_dup

    rng = random.Random(48)
    a, b, c = (words_of(rng, ["ta", "ri", "mo", "ne", "lu"], 60) for _ in range(3))
    rows = [(5, a, 1), (5, b, 2), (5, a, 1), (3, a, 3), (9, b + " end", 4), (7, c, 5), (None, c, 6), (None, None, 7), (7, None, 8)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, mark int"), shingle=2).collect()
    told = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id if r.component_id is not None else -1, r.kept, r.n_shingles > 0) for r in got)
    # id 5 has two texts, so what is like either is of one component
    assert told == sorted([(5, 3, False, True), (5, 3, False, True), (5, 3, False, True), (3, 3, True, True), (9, 3, False, True), (7, 7, True, True), (-1, -1, True, True), (-1, -1, True, False), (7, 7, True, False)])


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with every kind of thing the stages take out, and odd rows."""
    rng = random.Random(49)
    kinds = {"aa": ["ta", "ri", "mo", "ne", "lu", "ka", "so"], "bb": ["sch", "ung", "ein", "er", "ch", "ver", "an"]}
    item = [words_of(rng, kinds["aa"], 30) for _ in range(5)]
    texts = []
    for i in range(120):
        k = rng.choice(["aa", "bb"])
        texts.append(("\n".join(words_of(rng, kinds[k], rng.randrange(8, 30)) for _ in range(rng.randrange(1, 6))), k))
    texts += [(texts[i][0], texts[i][1]) for i in range(10)]  # copies
    texts += [(t.replace("\n", " ") + " more", k) for t, k in texts[20:30]]  # near copies, lines joined
    texts += [(words_of(rng, kinds["aa"], 25) + "\n" + it + "\n" + words_of(rng, kinds["aa"], 25), "aa") for it in item]
    texts += [(f"{words_of(rng, kinds['bb'], 12)}\nAll rights reserved", "bb") for _ in range(5)]
    texts += [(None, "aa"), ("", "aa"), ("12 34 !!", "bb"), (words_of(rng, kinds["aa"], 4000), None)]
    folder = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, k, "s", len(t or "")) for i, (t, k) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(item)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), {i: t for i, (t, _) in enumerate(texts)}, item


def test_pipeline_equals_brute_force(spark, corpus):
    """All stages by definition, on whole texts: the language model alone is taken as it is."""
    import corpus_pipeline

    folder, texts, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    known = {r.doc_id for r in lang_id.identify(docs.select("doc_id", "text"), lang_id.fit_on_documents(docs)).where("lang_pred <> 'und' and not foreign").collect()}
    assert all(i in known for i in range(120))
    left = {i: t for i, t in texts.items() if i in known}
    lines = [(i, n, line) for i, t in sorted(left.items()) for n, line in enumerate(t.split("\n")) if plain(line)]
    group = line_groups([plain(line) for _, _, line in lines])
    # lines too short to be compared with others are grouped with their copies alone
    short = lambda p: len(p.split()) < 5 and len(p.encode()) < 20
    assert not any(group[p] != p and (short(p) or short(group[p])) for p in group)
    first, gone = {}, set()
    for i, n, line in lines:
        if first.setdefault(group[plain(line)], (i, n)) != (i, n):
            gone.add((i, n))
    after = {}
    for i, t in left.items():
        kept = [line for n, line in enumerate(t.split("\n")) if (i, n) not in gone]
        if len(kept) == len(t.split("\n")) or any(x.strip() for x in kept):
            after[i] = "\n".join(kept)
    told = brute_components(after, 5)
    alone = {i: t for i, t in after.items() if told[i][0] == 0 or told[i][1] == i}
    sets = [shingles(it, 5) for it in items]
    clean = {i: t for i, t in alone.items() if not any(100 * len(s & shingles(t, 5)) >= 80 * len(s) for s in sets)}
    assert len(texts) > len(left) > 0 and len(after) < len(left) and len(clean) < len(alone)
    library = tiktoken_encoding()
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == set(clean)
    for i, t in clean.items():
        ids = library.encode_ordinary(t)
        assert got[i].n_tokens == len(ids) and bytes(got[i].ids) == np.array(ids, "<u4").tobytes() and got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_stages_take_odd_and_repeated_rows(spark, corpus):
    import corpus_pipeline

    folder, texts, _ = corpus
    base = spark.read.parquet(f"{folder}/documents.parquet")
    row = base.where("doc_id = 1")
    odd = base.union(row).union(row).union(spark.createDataFrame([(None, "ta ri mo ne lu " * 50, None, None, None), (5000, "mota neri " * 30_000, "aa", "s", None)], base.schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd, folder)
        assert kept.columns == base.columns, name
        rows = kept.collect()
        assert {r.doc_id for r in rows} <= {*texts, None, 5000}, name
        copies = [r.text for r in rows if r.doc_id == 1]
        assert len(copies) in (0, 3) and len(set(copies)) <= 1, name  # repeated rows share their result
    assert RANKS and stage
