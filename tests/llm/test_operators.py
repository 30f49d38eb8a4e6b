"""Operators against brute force, libraries and held-out rows; odd rows of every kind."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import ann, byte_bpe, decontaminate, edits, html_blocks, kernels, lang_id, layouts, line_dedup, near_dup, pii, token_orc, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")

#: Null, empty, blank, one word, repeated rows, a long word, a very long text, odd signs.
ODD = [None, "", " \n\t ", "word", "word", "x" * 5000, "lorem ipsum dolor sit amet " * 8000, "naïve ʼs 't 日本 😀́ \x1c\x85", "a\n\nb"]


def odd_documents(spark):
    """Odd texts with nulls in other columns, and columns whose names an operator might use itself."""
    rows = [(i, t, None, None, 7, "s", 0.5) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, mark string, score double")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, size):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_components(texts, size, percent=80):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def mutated(rng, text, rate):
    return " ".join(f"m{rng.randrange(10**6)}" if rng.random() < rate else w for w in text.split())


def near_copies(rng):
    """Groups of copies, chains of near copies, small sets, and texts that share a long passage but are no copies."""
    word = lambda: f"w{rng.randrange(3000)}"
    texts = []
    for _ in range(25):
        base = " ".join(word() for _ in range(rng.randrange(1, 120)))
        texts += [base] * rng.randrange(1, 4)
        for _ in range(rng.randrange(0, 8)):
            base = mutated(rng, base, rng.choice([0.01, 0.03, 0.06]))
            texts.append(base)
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randrange(5, 80))) for _ in range(60)]
    texts += [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 9))) for _ in range(80)]
    hub = " ".join(word() for _ in range(150))
    texts += [hub] + [mutated(rng, hub, 0.05) for _ in range(60)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    texts = dict(enumerate(near_copies(random.Random(size))))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, shingle=size).collect()}
    assert got == brute_components(texts, size)


def test_near_duplicates_in_long_lists_of_small_sets(spark):
    texts = {}
    for b in range(4):
        base = [f"b{b}{c}" for c in "pqrst"]
        texts |= {100 * b + i: " ".join([*base, f"x{b}y{i}"]) for i in range(60)}  # sets of five values with those of the base
        texts[10_000 + b] = " ".join(base)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, shingle=2).collect()}
    assert got == brute_components(texts, 2)


def test_near_duplicates_odd_rows(spark):
    rows = {r.doc_id: r for r in near_dup.near_duplicates(odd_documents(spark), shingle=2).collect()}
    assert [rows[i].n_shingles for i in (0, 1, 2, 3, 4)] == [0, 0, 0, 1, 1]
    assert all(rows[i].kept and rows[i].component_id == i for i in (0, 1, 2, 3)) and not rows[4].kept and rows[4].component_id == 3
    assert near_dup.near_duplicates(odd_documents(spark).limit(0)).count() == 0


def test_pii_equals_patterns():
    def brute(t):
        out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])) % 10 == 0:
                out.append((m.start(), m.end(), "card"))
        out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
        return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))

    rng = random.Random(2)
    parts = ["1", "2", "55", "256", "0", "4111111111111111", ".", " ", "-", "+", "@", "a", "B", "x.y", "(", ")", "é", "https://", "iban ", "%", "٣"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 25)))
        assert [s for s in pii.find_spans(text) if s[2] in pii.BASE_KINDS] == brute(text), text


def test_pii_further_kinds_and_odd_rows(spark):
    text = "see https://example.org/a?b=1. or www.example.com, IBAN: DE44 5001 0517 5407 3249 31 end"
    found = {k: text[a:b] for a, b, k in pii.find_spans(text) if k in ("url", "account")}
    assert found["account"].startswith("DE44") and found["url"] == "www.example.com"
    assert pii.redact("mail a@b.co now", pii.find_spans("mail a@b.co now")) == "mail [email] now"
    rows = pii.span_digests(pii.detect_pii(odd_documents(spark))).collect()
    assert len(rows) == len(ODD) and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() and r.spans == "" for r in rows)
    one = pii.span_digests(pii.detect_pii(spark.createDataFrame([(1, "é a@b.co 1.2.3.4")], "doc_id long, text string"))).first()
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 0, 0) and one.spans == "email:2:8,ip:9:16"
    assert one.base_sha256 == hashlib.sha256(b"email:2:8,ip:9:16").hexdigest() == pii.digest_of(pii.find_spans("é a@b.co 1.2.3.4"))


def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_library():
    own, library = byte_bpe.encoder(RANKS), tiktoken_encoding()
    rng = random.Random(4)
    parts = list("abcstmdrvle'  \n\t 　1٣½é!.,-ñ日本😀_AS\x1c\x85​") + ["'re", "'ve", "'ll", " '", "''s", "  ", "́", "x" * 70, "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(5000)] + ["", " ", "'s", "y" * 3000]
    data, offsets = kernels.utf8(pa.array(texts))
    for lo, hi in kernels.chunks(offsets, 20_000):
        part = offsets[lo : hi + 1]
        ids, first = own.encode(data[part[0] : part[-1]], part - part[0])
        for text, a, b in zip(texts[lo:hi], first, first[1:]):
            assert ids[a:b].tolist() == library.encode_ordinary(text), text
            assert own.decode(ids[a:b], own.token_offsets(ids[a:b])).tobytes() == text.encode()


def test_byte_bpe_scan_equals_steps():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 5000):
        symbols = rng.integers(0, 12, n).astype(np.uint8)
        state, expected = 0, []
        for s in symbols:
            state = byte_bpe._step(state, int(s))
            expected.append(state)
        assert byte_bpe.states(symbols).tolist() == expected


def test_byte_bpe_odd_rows(spark):
    rows = {r.doc_id: r for r in byte_bpe.token_digests(odd_documents(spark), RANKS).collect()}
    library = tiktoken_encoding()
    for i, text in enumerate(ODD):
        ids = library.encode_ordinary(text or "")
        assert rows[i].n_tokens == len(ids) and rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_token_orc(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    docs = odd_documents(spark).unionByName(spark.createDataFrame([(100 + i, f"Text no. {i}, it's {'©' if i % 9 == 0 else 'done'}!") for i in range(300)], "doc_id long, text string"), allowMissingColumns=True)
    path = str(tmp_path / "ids")
    token_orc.write_token_orc(docs, path, WORDS, partitions=5)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = token_orc.read_token_orc(spark, path).orderBy("doc_id").collect()
    at = 0
    for r in rows:
        assert r.token_ids == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1] and r.start == at
        at += r.n_tokens
    assert len(rows) == len(texts)
    crc = {r.doc_id: r.ids_crc32 for r in token_orc.with_crc(token_orc.read_token_orc(spark, path)).collect()}
    assert all(crc[r.doc_id] == zlib.crc32(np.array(r.token_ids, "<u4").tobytes()) for r in rows)
    assert [r.doc_id for r in token_orc.read_token_orc(spark, path, [103, 5]).orderBy("doc_id").collect()] == [5, 103]
    import glob

    from pyarrow import orc

    file = orc.ORCFile(sorted(glob.glob(path + "/*.orc"))[0])
    assert file.nstripes >= 1 and "token_ids" in file.schema.names
    token_orc.write_token_orc(docs.limit(0), str(tmp_path / "none"), WORDS, partitions=2)
    assert token_orc.read_token_orc(spark, str(tmp_path / "none")).count() == 0


def test_language_lengths_equal_definition():
    rng = random.Random(3)
    samples = {"a": [b"abracadabra abacus", b"banana bandana"], "b": [b"zigzag zebra zoo", b"fizz buzz"]}
    model = lang_id.fit(samples)
    counts = {}
    for name, texts in samples.items():
        tree = defaultdict(lambda: defaultdict(int))
        for t in texts:
            for i, c in enumerate(t):
                for k in range(lang_id.ORDER + 1):
                    if i >= k:
                        tree[t[i - k : i]][c] += 1
        counts[name] = tree

    def cost(tree, text):
        total = 0.0
        for i, c in enumerate(text):
            p = 1.0
            for k in range(lang_id.ORDER, -1, -1):
                seen = tree.get(text[i - k : i]) if i >= k else None
                if seen:
                    n, q = sum(seen.values()), len(seen)
                    if c in seen:
                        p *= seen[c] / (n + q)
                        break
                    p *= q / (n + q)
            else:
                p /= 256
            total -= np.log(p)
        return total

    texts = [bytes(rng.choice(b"abnzigf er") for _ in range(rng.randrange(0, 30))) for _ in range(200)]
    data, offsets = kernels.utf8(pa.array(texts))
    got = model.lengths(data, offsets)
    for t, row in zip(texts, got):
        assert np.allclose(row, [cost(counts["a"], t), cost(counts["b"], t)], rtol=1e-4)


def test_language_id_held_out_and_odd_rows(spark):
    rng = random.Random(6)
    alphabets = {"aa": "abcdefg aeiou", "bb": "nopqrst uxyz", "cc": "éèçàù lmno"}
    rows = [(i, "".join(rng.choice(alphabets[k]) for _ in range(120)), k) for i, k in enumerate(rng.choice(sorted(alphabets)) for _ in range(300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit_on_documents(docs)
    told = {r.doc_id: r.lang_pred for r in lang_id.identify(docs, model).collect()}
    held = [(i, k) for i, _, k in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all(told[i] == k for i, k in held)
    odd = {r.doc_id: r for r in lang_id.identify(odd_documents(spark), model).collect()}
    assert [odd[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and odd[0].score == 0.0 and 0 < odd[6].score <= 1
    assert lang_id.fit_on_documents(docs.limit(0)) is None
    assert {r.lang_pred for r in lang_id.identify(docs, None).collect()} == {"und"}


def test_language_lengths_of_long_texts():
    model = lang_id.fit({"a": [b"abc abd abe"], "b": [b"xyz xyy xzz"]})
    text = b"abc xyz " * 200
    data = np.frombuffer(text, dtype=np.uint8)
    whole = model.lengths(data, np.array([0, len(data)]))
    kept, kernels.CHUNK_BYTES = kernels.CHUNK_BYTES, 100
    try:
        assert np.allclose(lang_id._in_pieces(model, data, np.array([0, len(data)])), whole)
    finally:
        kernels.CHUNK_BYTES = kept


def test_toxicity_learns_subwords(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ta", "ri", "mo", "ne", "lu", "ka"]) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(600):
        text = [word() for _ in range(rng.randrange(20, 200))]
        bad = i % 3 == 0
        if bad:
            for _ in range(max(1, len(text) // 40)):
                text[rng.randrange(len(text))] = "zgrog" + rng.choice(["", "en", "ing", "x", "ers"])
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit_on_documents(docs, marks)
    extra = spark.createDataFrame([(1000, " ".join(word() for _ in range(60)) + " zgrogful " + " ".join(word() for _ in range(60)))], "doc_id long, text string")
    told = {r.doc_id: r.score for r in toxicity.score_toxicity(docs.union(extra), model).collect()}
    held = [(told[i] >= toxicity.THRESHOLD, bool(t)) for i, _, t in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([a == b for a, b in held]) > 0.95 and told[1000] >= toxicity.THRESHOLD
    odd = {r.doc_id: r.score for r in toxicity.score_toxicity(odd_documents(spark), model).collect()}
    assert len(odd) == len(ODD) and all(0 <= s <= 1 for s in odd.values()) and odd[0] == odd[1] == odd[2]
    assert toxicity.fit_on_documents(docs, marks.limit(0)).score(np.zeros(0, np.uint8), np.array([0, 0])).shape == (1,)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(500)}"
    items = [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(60)] + ["", None, "one two", "one two"]
    texts = []
    for _ in range(200):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 300)))]
        for _ in range(rng.randrange(0, 3)):
            passage = mutated(rng, rng.choice([i for i in items if i]), rng.choice([0, 0.02, 0.05, 0.1]))
            parts += [passage, word()]
        texts.append(" ".join(parts))
    texts += ["one two", "One  TWO", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    wanted = {}
    for d, t in enumerate(texts):
        have = shingles(t, 5)
        wanted[d] = [i for i, it in enumerate(items) if (s := shingles(it, 5)) and 100 * len(s & have) >= 80 * len(s)]
    assert {r.doc_id: r["items"] for r in decontaminate.find_items(docs, bench).collect()} == wanted
    kept, decontaminate.BLOCK_BYTES = decontaminate.BLOCK_BYTES, 2000
    blocks = list(decontaminate.item_blocks(bench, "item_id", "text", 2000))
    decontaminate.BLOCK_BYTES = kept
    assert len(blocks) > 2 and sum(len(b.ids) for b in blocks) == 62
    found = [[] for _ in texts]
    data, offsets = kernels.utf8(pa.array(texts))
    for b in blocks:
        found = [sorted(x + y) for x, y in zip(found, b.search(data, offsets))]
    assert dict(enumerate(found)) == wanted
    assert all(r["items"] == [] for r in decontaminate.find_items(docs, bench.limit(0)).collect())


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 10))) for _ in range(2))
        assert edits.edit_distance(a, b) == plain(a, b)


def brute_lines(texts):
    """Lines that stay, by comparing all pairs of distinct normalised lines."""
    entries, places = {}, defaultdict(list)
    for d, text in texts.items():
        if not text:
            continue
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        _, numbers, marks, sims = line_dedup.marks_and_keys(data, np.array([0, len(data)]))[:4]
        lines = text.encode().split(b"\n")
        for n, mark, sim in zip(numbers.tolist(), marks.tolist(), sims.tolist()):
            entries.setdefault(mark, (sim, line_dedup.normalise(lines[n]).decode()))
            places[mark].append((d, n))
    parent = {e: e for e in entries}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(entries)
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            apart = ((entries[a][0] ^ entries[b][0]) & (2**64 - 1)).bit_count()
            if apart <= line_dedup.RADIUS and line_dedup.alike([entries[a][1].encode()], [entries[b][1].encode()])[0]:
                parent[top(b)] = top(a)
    groups = defaultdict(list)
    for e in entries:
        groups[top(e)] += places[e]
    gone = {p for g in groups.values() for p in sorted(g)[1:]}
    out = {}
    for d, text in texts.items():
        if not text:
            out[d] = text
            continue
        lines = text.split("\n")
        left = [line for n, line in enumerate(lines) if (d, n) not in gone]
        if len(left) == len(lines) or any(x.strip() for x in left):
            out[d] = "\n".join(left)
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(12)
    word = lambda: f"w{rng.choice('abcdefghij')}{rng.choice('klmnopqrst')}{rng.choice('uvwxyz')}"
    pool = [" ".join(word() for _ in range(rng.randrange(2, 60))) for _ in range(60)]
    texts = {}
    for d in range(150):
        lines = []
        for _ in range(rng.randrange(1, 7)):
            line = rng.choice(pool)
            roll = rng.random()
            if roll < 0.3:
                line = mutated(rng, line, 0.03)
            elif roll < 0.5:
                line = line.upper() + "!"
            elif roll < 0.7:
                line = " ".join(word() for _ in range(20))
            lines.append(line)
        texts[d] = "\n".join(lines)
    texts |= {500: None, 501: "", 502: "\n\n", 503: "too short", 504: "too short"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()} == brute_lines(texts)


def test_lines_alike_by_edits_are_joined(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice(["ta", "ri", "mo", "ne", "lu", "ka", "so", "pi"]) for _ in range(rng.randrange(1, 4)))
    pairs = []
    for i in range(600):
        one = [word() for _ in range(rng.randrange(6, 50))]
        other = list(one)
        for _ in range(1 if i < 400 else max(1, len(one) // 10)):
            other[rng.randrange(len(other))] = word()
        if line_dedup.alike([" ".join(one).encode()], [" ".join(other).encode()])[0] and one != other:
            pairs.append((" ".join(one), " ".join(other)))
    head = " ".join(word() for _ in range(4))  # a long list: many lines of one beginning, some of them alike
    hot = [f"{head} {word()} {word()} {word()} {word()}" for _ in range(80)]
    pairs += [(h, " ".join([*h.split()[:-1], h.split()[-1] + "x"])) for h in hot]
    df = spark.createDataFrame([(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)], "doc_id long, text string")
    left = {r.doc_id for r in line_dedup.dedup_lines(df).collect()}
    joined = [2 * i + 1 not in left for i in range(len(pairs))]
    assert len(pairs) > 550 and np.mean(joined) >= 0.98 and all(joined[-len(hot) :])


def test_op5_takes_out_repeated_short_lines(spark, tmp_path):
    from palimpsest.llm import queries

    texts = ["First one here.\nAll rights reserved.\nLes.", "All Rights Reserved\nsecond one\nles", "今日は良い天気です。散歩に行きましょう。\nthird", "fourth\n今日は良い天気です。散歩に行きましょう。\n---\n---"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in queries.op5_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: texts[0], 1: "second one", 2: texts[2], 3: "fourth\n---\n---"}


def test_line_dedup_odd_rows(spark):
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(odd_documents(spark)).collect()}
    assert len(rows) == len(ODD) and rows[0].text is None and rows[6].text == ODD[6]
    assert line_dedup.dedup_lines(odd_documents(spark).limit(0)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(1500, 16)).astype(np.float32)
    vectors[200:600] = vectors[200]  # copies of one vector, queries among them
    rows = [(i, v.tolist(), None) for i, v in enumerate(vectors)]
    rows += [(9000, None, 1), (9100, [0.0] * 16, 1), (9200, [float("nan")] + [1.0] * 15, 1), (9300, [1.0] * 3, 1), (9400, [None] + [1.0] * 15, 1), (9500, [float("inf")] + [1.0] * 15, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 100))
    double, hits = vectors.astype(np.float64), 0
    for q, found in got.items():
        d = np.sqrt(((double - double[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        hits += len({i for i, _ in found} & set(order))
        assert len(found) == 10 and all(s == d[i] for i, s in found) and found == sorted(found, key=lambda x: (x[1], x[0]))
    assert hits >= 0.9 * 10 * len(got) and [i for i, _ in got[300]] == list(range(200, 210))
    few = ann.nearest(df.where("vec_id < 3")).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, 1), (0, 2)]
    assert ann.nearest(df.limit(0)).count() == 0


def test_leaves_agree_with_visits():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(800, 8))
    forest = ann.grow(v, 800, trees=4, leaf=20)
    leaves = forest.leaves(v)
    assert np.isclose(forest.share.sum(), 4)
    for i in range(50):
        visited = forest.visit(forest.planes @ v[i] - forest.offsets, 0.2)
        assert set(leaves[i]) <= set(forest.visit(forest.planes @ v[i] - forest.offsets, 4.1)) and visited[0] in set(leaves[i])


def test_neighbours_in_cells_and_blocks(spark):
    """Leaves dealt to several cells, queries to several blocks, huge components, ids repeated and null."""
    rng = np.random.default_rng(12)
    vectors = np.concatenate([rng.normal(size=(900, 8)), 1e200 * rng.normal(size=(20, 8))])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(None, vectors[3].tolist()), (5, vectors[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    kept = ann.CELL_ROWS, ann.QUERY_ROWS, ann.HELD_ROWS
    ann.CELL_ROWS, ann.QUERY_ROWS, ann.HELD_ROWS = 5, 30, 400
    try:
        got = defaultdict(list)
        for r in ann.nearest(df, every=10).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
    finally:
        ann.CELL_ROWS, ann.QUERY_ROWS, ann.HELD_ROWS = kept
    assert sorted(got) == list(range(0, 920, 10))
    with np.errstate(over="ignore"):
        for q, found in got.items():
            d = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
            order = [i for i in np.lexsort((np.arange(920), d)) if i != q][:10]
            assert len({i for i, _ in found}) >= 9 and all(s == d[i] for i, s in found)
            if q < 900 and 5 not in order:  # all leaves are visited at this size
                assert [i for i, _ in found] == order


def test_html_blocks_read():
    page = "<!doctype html><title>t</title><script>var a='</p>';</script><nav><ul><li><a href='/x'>Home &amp; more</a><li>Two</ul></nav><!-- <p>no</p> --><article><p>One <b>two</b>\n three<p>Four<br>five &lt;tag&gt; &copy; a < b</article><foot"
    blocks = html_blocks.read_blocks(page).blocks
    assert [b.text for b in blocks] == ["Home & more", "Two", "One two three", "Four five <tag> © a < b"]
    assert blocks[0].linked == len("Home & more") and blocks[1].linked == 0
    assert html_blocks.read_blocks("").blocks == []


def test_html_labels_held_out_pages():
    model = html_blocks.trained_labeller()
    pages = list(layouts.generate_pages(150, seed=4242))
    blocks = [html_blocks.read_blocks(p) for p, _ in pages]
    right = total = 0
    for (_, wanted), own, told in zip(pages, blocks, html_blocks.label_pages(model, blocks)):
        right += sum((b.text in wanted) == bool(t) for b, t in zip(own.blocks, told))
        total += len(own.blocks)
    assert right / total > 0.97


def test_html_gradients():
    rng = np.random.default_rng(0)
    model = html_blocks.Labeller.fresh(hidden=3, path_dim=2, word_dim=2)
    inputs = model.weights["f_x"].shape[0]
    x, mask = rng.normal(size=(4, 2, inputs)), np.array([[1, 1], [1, 1], [1, 1], [1, 0]], dtype=bool)
    y = (rng.random((4, 2)) > 0.5).astype(float)
    grads, dx, loss = model.gradients(x, mask, y)
    for name in ("f_h", "b_x", "out", "f_b"):
        w = model.weights[name]
        at = tuple(int(rng.integers(s)) for s in w.shape)
        w[at] += 1e-6
        assert np.isclose((model.gradients(x, mask, y)[2] - loss) / 1e-6, grads[name][at], atol=1e-4)
        w[at] -= 1e-6
    x[1, 0, 1] += 1e-6
    assert np.isclose((model.gradients(x, mask, y)[2] - loss) / 1e-6, dx[1, 0, 1], atol=1e-4)


def test_html_rows(spark):
    body = "".join(f"<p>Sentence number {i} of the article, long enough to read.</p>" for i in range(5))
    page = f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy it now.</div><article><h1>Title</h1>{body}</article><footer>&copy; example.org</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page, "x"), (2, "u", None, "x"), (3, None, "", "x")], "page_id long, url string, html string, n_blocks string")
    rows = {r.page_id: r for r in html_blocks.extract_main_text(df).collect()}
    assert rows[1].text.split("\n") == ["Title"] + [f"Sentence number {i} of the article, long enough to read." for i in range(5)]
    assert rows[2].text == rows[3].text == "" and rows[2].n_blocks == 0


def test_kernels():
    texts = ["A b  a", None, "", "x", "  y\x0bz"]
    data, offsets = kernels.utf8(pa.array(texts))
    starts, ends, first = kernels.word_spans(data, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == ["A", "b", "a", "x", " ", "y", "z"] and first.tolist() == [0, 3, 3, 3, 4, 7]
    hashes = kernels.span_hashes(data, starts, ends)
    assert hashes[0] == hashes[2] != hashes[1]
    sets = list(kernels.text_sets(data, offsets, 2))
    assert [len(s) for s in sets] == [2, 0, 0, 1, 2]
    kept, kernels.CHUNK_BYTES = kernels.CHUNK_BYTES, 4
    try:
        assert (kernels.span_hashes(data, starts, ends) == hashes).all()
    finally:
        kernels.CHUNK_BYTES = kept


def test_queries_and_pipeline(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    import corpus_pipeline
    from palimpsest.llm import queries

    assert len(queries.queries()) == 10 and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "byte_bpe"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "/root/testdata/sf0.001")
        assert kept.columns == docs.columns, name
        assert kept.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0, name
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in out} == set(texts)
    assert all(r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() for r in out)
    assert all(component == i for i, (_, component) in brute_components(texts, 5).items())


def test_neighbours_of_a_large_table(spark):
    vectors = np.random.default_rng(8).normal(size=(4000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.nearest(df, search=80).collect():  # as little against the table as the default is at two million rows
        got[r.query_id].add(r.vec_id)
    hits = [len(got[q] & set(np.argsort(((vectors - vectors[q]) ** 2).sum(1), kind="stable")[1:11].tolist())) for q in range(0, 4000, 100)]
    assert np.mean(hits) >= 9
