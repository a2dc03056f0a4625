"""The corpus operators against brute force, round trips and held-out labels, with hard rows."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield.llm import gif, huffman, licenses, media, mixing, near_dup, order_minhash, pieces, sharding, token_output, toxicity, warc

SF = "/root/testdata/sf0.001"
HARD = [None, "", " ", "a", "é" * 40, "x" * 70_000, "two words", "two words", "tab\tand\nline  gaps ", "▁ mark <s> 漢字 🙂\x00", "<|endoftext|> THE The the.", "word " * 3_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, x, f"s{k % 3}" if k % 5 else None, "clash", 1) for k, x in enumerate(HARD)] + [(6, "two words", "s0", "clash", 1), (None, "no id here", "s1", "clash", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string, size int")


def empty(docs):
    return docs.limit(0)


def test_token_file(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = token_output.read(spark, token_output.write(docs, path, 2), with_ids=True).orderBy("start").collect()
    want = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    start = 0
    for row, (known, doc_id, text) in zip(got, want, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids) == (doc_id if known else None, start, len(ids), ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_output.read(spark, token_output.write(empty(docs), path, 2)).count() == 0


@pytest.mark.parametrize("counts", [[], [5], [1, 1], [2**k for k in range(30)], list(range(1, 600))])
def test_huffman_is_complete_limited_and_exact(counts):
    counts = np.array([0, *counts, 0], np.int64)
    lengths = huffman.code_lengths(counts, 12)
    n = int((counts > 0).sum())
    assert lengths.max(initial=0) <= 12 and (n < 2 or (0.5 ** lengths[lengths > 0].astype(float)).sum() == 1)
    ids = np.random.default_rng(1).choice(np.flatnonzero(counts), 1000) if n else np.zeros(0, int)
    code = huffman.Code(lengths)
    data, offsets = code.encode(ids)
    assert (code.decode(data, offsets, len(ids)) == ids).all()


def test_media_round_trip(docs):
    rows = {(r.doc_id, r.n_bytes): r for r in media.features(media.stored(docs)).collect()}
    for d in docs.collect():
        text = (d.text or "").encode()
        padded = text + b" " * (-len(text) % 192 if text else 192)
        row = rows[d.doc_id, len(text)]
        assert (row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert media.from_gif(media.as_gif(text)) == (padded, len(text))
    assert media.features(media.stored(empty(docs))).count() == 0


def test_lzw_against_a_plain_decoder():
    def plain(codes):
        table, out, last = {}, [], None
        for c in codes:
            if c == 256:
                table, last = {k: bytes([k]) for k in range(256)}, None
                continue
            if c == 257:
                break
            entry = table[c] if c in table else last + last[:1]
            out.append(entry)
            if last is not None and len(table) < 3838 + 256:
                table[len(table) + 2] = last + entry[:1]
            last = entry
        return b"".join(out)

    rng = random.Random(3)
    for data in (b"", b"a", b"a" * 9_000, bytes(rng.choices(range(256), k=30_000)), bytes(rng.choices(b"ab ", k=50_000))):
        stream, codes, position, width, size = gif.lzw_encode(data), [], 0, 9, 258
        bits = int.from_bytes(stream, "little")
        first = True
        while not codes or codes[-1] != 257:
            c = bits >> position & (1 << width) - 1
            position += width
            codes.append(c)
            if c == 256:
                width, size, first = 9, 258, True
            else:
                size += 0 if first else 1
                first = False
                width = min(12, size.bit_length())
        assert plain(codes) == data == gif.lzw_decode(stream, 8, len(data)).tobytes()
    with pytest.raises(ValueError, match="nothing"):
        gif.lzw_decode(bytes([0, 255, 255, 255]), 8, 10)


def test_frames_disposal_and_transparency(spark):
    palette = np.zeros((256, 3), np.uint8)
    palette[1], palette[2] = (255, 0, 0), (0, 0, 255)
    full, dot = np.ones((4, 4), np.uint8), np.array([[2, 0], [0, 2]], np.uint8)
    f = [gif.Frame(0, 0, 4, 4, full, palette, 100, 1), gif.Frame(1, 1, 2, 2, dot, palette, 50, 3, 0), gif.Frame(0, 0, 2, 2, dot, palette, 20, 2, 0), gif.Frame(3, 3, 1, 1, dot[:1, :1], palette, 10, 0)]
    data = gif.write(4, 4, f, palette)
    shown = list(gif.composed(gif.read(data)))
    assert shown[1][1, 1].tolist() == [0, 0, 255, 255] and shown[1][1, 2].tolist() == [255, 0, 0, 255]
    assert shown[2][1, 1].tolist() == [0, 0, 255, 255] and shown[2][2, 2].tolist() == [255, 0, 0, 255]
    assert shown[3][0, 0, 3] == 0 and shown[3][3, 3].tolist() == [0, 0, 255, 255]
    rows = media.frames(spark.createDataFrame([(7, bytearray(data)), (8, None)], "id long, media binary")).orderBy("frame").collect()
    assert [(r.id, r.start_ms, r.delay_ms) for r in rows] == [(7, 0, 100), (7, 100, 50), (7, 150, 20), (7, 170, 10)]
    assert rows[0].red[15] == 16 and sum(rows[3].blue) == 12


def test_pieces_equal_the_library(spark, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    more = [(100 + k, "".join(rng.choices("ab the ing  \n▁éß漢🙂\t<s>0x 123", k=rng.randint(0, 60)))) for k in range(500)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = sorted((r.doc_id or -1, library.encode(r.text or "")) for r in table.collect())
    ids = pieces.encode(table, path)
    assert sorted((r.doc_id or -1, r.ids) for r in ids.collect()) == want
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(table, path).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == sorted((d, len(x), sha(",".join(map(str, x))), sha(library.decode(x) if x else "")) for d, x in want)
    assert sorted(r.text for r in pieces.decode(ids, path).collect()) == sorted(library.decode(x) if x else "" for _, x in want)
    assert pieces.digests(empty(docs), path).count() == 0


def brute_kmers(text, k=5):
    """Hash of each numbered k-mer in text order: the sums in whole numbers, the numbers by a plain count."""
    m, powers, seen, out = (1 << 64) - 1, [int(x) for x in order_minhash.POWERS], defaultdict(int), []

    def mixed(x):
        x = (x ^ x >> 32) * int(order_minhash.MIX) & m
        return x ^ x >> 29

    codes = [ord(c) for c in text]
    if len(codes) < k:
        keys = [sum(c * p for c, p in zip(codes, powers, strict=False)) * powers[-1] + len(codes) + 1]
    else:
        keys = [sum(c * p for c, p in zip(codes[j : j + k], powers, strict=False)) for j in range(len(codes) - k + 1)]
    for key in keys:
        key = mixed(key & m) >> 20
        out.append(mixed(key * powers[1] + seen[key] * powers[2] & m))
        seen[key] += 1
    return out


def brute_sketch(text):
    kmers, out, m = brute_kmers(text), [], (1 << 64) - 1
    for a, b in zip(order_minhash.FIRST[: order_minhash.COORDINATES].tolist(), order_minhash.SECOND.tolist(), strict=False):
        hashed = []
        for place, x in enumerate(kmers):
            h = (x >> 32) * a & 0xFFFFFFFF
            hashed.append(((h ^ h >> 15) * b & 0xFFFFFFFF, x, place))
        least = sorted(hashed)[: order_minhash.TUPLE]
        total = len(least)
        for _, x, _ in sorted(least, key=lambda y: y[2]):
            total = (total * int(order_minhash.MIX) & m) + x & m
            total = (total ^ total >> 32) * int(order_minhash.MIX) & m
            total ^= total >> 29
        out.append(total >> 32)
    return out


def test_order_minhash(docs):
    for text in ("", "abc", "é漢🙂ab", "abcdeabcde", "the quick brown fox jumps over the lazy dog " * 20):
        assert order_minhash.sketch(text).tolist() == brute_sketch(text)
        kmers, place = order_minhash.numbered_kmers(text)
        assert kmers[np.argsort(place)].tolist() == brute_kmers(text) and len(set(kmers.tolist())) == max(1, len(text) - 4)
    docs = docs.unionByName(docs.where("doc_id = 4").withColumn("text", F.concat("text", F.lit(" other"))))  # one doc_id, two texts
    marked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text")).collect()
    rows = [(d, t) for d, t, _ in sorted(((r.doc_id if r.doc_id is not None else -1, r.text, r.mark) for r in marked), key=lambda x: (-x[0], x[2]))]
    want = []
    for k, (doc_id, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        other = order_minhash.edited(text, following)
        a, b, c = map(order_minhash.sketch, (text, other, following))
        want.append((doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), a.tobytes().hex(), order_minhash.likeness(a, b), order_minhash.likeness(a, c)))
    for shards in (1, 3, 40):
        got = [(r.doc_id if r.doc_id is not None else -1, r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) for r in order_minhash.edited_pairs(docs, shards).collect()]
        assert sorted(got) == sorted(want)
    assert order_minhash.edited_pairs(empty(docs), 3).count() == 0


def test_order_minhash_of_a_million_kmers():
    """Beyond 2**20 k-mers hash and place no longer share a word: the same fingerprint as the plain form's."""
    signs = np.random.default_rng(3).integers(97, 101, (1 << 20) + 50).astype(np.uint8).tobytes().decode()
    kmers, place = order_minhash.numbered_kmers(signs)
    assert kmers[np.argsort(place)].tolist() == brute_kmers(signs)


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.trained(docs, labels)
    known = docs.join(labels.where("toxic is not null"), "doc_id").where(toxicity.held_out())
    rows = toxicity.scored(known, model).join(labels, "doc_id").collect()
    toxic, clean = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    # A third of the toxic labels of this table are noise: no word of such a text tells.
    assert np.mean([x >= 0.7 for x in toxic]) > 0.5 and np.mean([x >= 0.7 for x in clean]) < 0.03


def test_toxicity_hard_rows(docs, spark):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.trained(docs, labels)
    assert {r.score for r in toxicity.scored(docs, model).collect()} == {0.0}
    assert toxicity.cleaned(docs, model).columns == docs.columns and toxicity.cleaned(docs, model).count() == docs.count()


def plain_grams(text):
    """Five-byte runs of each folded word with its ends marked, as the text's set."""
    out = set()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        marked = f"<{word}>".encode()
        out |= {marked[k : k + 5] for k in range(max(1, len(marked) - 4))}
    return out


def toxic_table(spark, n=400):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    common, bad = [word() for _ in range(400)], [word() for _ in range(12)]
    rows = [(k, " ".join(draw.sample(common, 30) + (draw.sample(bad, 4) if k % 4 == 0 else []))) for k in range(n)]
    return rows, bad, spark.createDataFrame([(k, int(k % 4 == 0) if k % 3 else None) for k in range(n)], "doc_id long, toxic int")


def test_toxicity_counts_over_all_training_rows(spark):
    """The runs with weights, by plain counts of all training rows and not of the samples."""
    rows, _, labels = toxic_table(spark)
    learn = [(k, t) for k, t in rows if zlib.crc32(str(k).encode()) % 3 != 1]
    positive = [t for k, t in learn if k % 3 and k % 4 == 0]
    p, u = (defaultdict(int) for _ in range(2))
    for texts, count in ((positive, p), ([t for _, t in learn], u)):
        for t in texts:
            for g in plain_grams(t):
                count[g] += 1
    n, m = len(positive), len(learn)
    want = {g for g in p if p[g] >= max(3, 0.004 * n) and (p[g] / n + 0.5 / n) / (u[g] / m + 0.5 / m + 1e-4) >= 2}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held, unlabelled, prior = toxicity.sample(docs, labels, 10, 20)
    found = toxicity.chosen_grams(docs.where(~toxicity.held_out()), labels.where("toxic = 1").select("doc_id"))
    assert {int(g).to_bytes(5).lstrip(b"\0") for g in found} == want and len(held) == 10 and len(unlabelled) == 20
    known = [k % 4 == 0 for k, _ in learn if k % 3]
    assert abs(prior - sum(known) / len(known)) < 1e-12


@pytest.mark.parametrize("sigmoid", [False, True])
@pytest.mark.parametrize("prior", [0.05, 3.0])
def test_toxicity_risk_and_its_slopes(sigmoid, prior):
    """The risk by plain sums, and slopes by small differences; a factor of three makes the second term negative."""
    draw = np.random.default_rng(4)
    texts = [np.flatnonzero(draw.random(6) < 0.5) for _ in range(25)]
    p, u, w = texts[:10], texts[10:], draw.normal(size=7)
    loss = (lambda z: 1 / (1 + math.exp(z))) if sigmoid else (lambda z: math.log(1 + math.exp(-z)))

    def plain(weights):
        z = lambda rows: [sum(weights[j] for j in own) + weights[6] for own in rows]
        mean = lambda rows, sign: sum(loss(sign * x) for x in z(rows)) / len(rows)
        return prior * mean(p, 1), mean(u, -1) - prior * mean(p, -1)

    rows = [toxicity.Rows(x, np.arange(6)) for x in (p, u)]
    terms = toxicity.risk(*[x.times(w[:6]) + w[6] for x in rows], prior, sigmoid)
    assert np.allclose(terms, plain(w))
    negative = plain(w)[1] < 0
    walked = lambda weights: -plain(weights)[1] if negative else sum(plain(weights))
    steps = [(walked(w + 1e-6 * e) - walked(w - 1e-6 * e)) / 2e-6 for e in np.eye(7)]
    assert np.allclose(toxicity.slopes(*rows, w, prior, sigmoid), steps, atol=1e-6)
    assert negative == (prior == 3.0)


def test_toxicity_hard_rows_under_a_trained_model(spark, docs):
    rows, bad, labels = toxic_table(spark)
    model = toxicity.trained(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    clash = docs.withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(1)).unionByName(
        spark.createDataFrame([(900, " ".join(bad)), (901, " ".join(bad).upper()), (902, "word " * 300_000 + bad[0])], "doc_id long, text string"), allowMissingColumns=True)
    got = toxicity.scored(clash, model).collect()
    texts = defaultdict(set)
    for r in clash.collect():
        z = model.bias + sum(model.features.get(int.from_bytes(g), 0) for g in plain_grams(r.text))
        texts[r.doc_id].add(round(1 / (1 + math.exp(-z)), 9))
    for r in got:
        assert round(r.score, 9) in texts[r.doc_id]
    scores = {r.doc_id: r.score for r in got}
    bias = 1 / (1 + math.exp(-model.bias))
    assert len(got) == clash.count() and scores[900] == scores[901] > 0.7 > scores[0] and scores[0] == scores[1] == pytest.approx(bias)
    assert toxicity.cleaned(clash, model).columns == clash.columns
    assert {r.doc_id for r in toxicity.cleaned(clash, model).collect()} == {r.doc_id for r in got if r.score < 0.7}
    assert toxicity.scored(empty(docs), model).count() == 0 and toxicity.cleaned(empty(docs), model).count() == 0


def test_toxicity_sample_is_bounded_under_repeated_ids(spark):
    rows = spark.range(600).selectExpr("if(id < 500, 0L, id) doc_id", "concat('text ', id) text")
    labels = spark.createDataFrame([(0, 1), (0, 1), (501, 0)], "doc_id long, toxic int")
    positive, unlabelled, prior = toxicity.sample(rows, labels, 5, 50)
    assert (len(positive), len(unlabelled), prior) == (1, 50, 0.5)


def test_toxicity_of_long_clean_texts_of_unseen_words(spark):
    draw = random.Random(5)
    word = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    common, toxic = ([word("abcdefghijklmnopqrstuvwxyz", 7) for _ in range(n)] for n in (2_000, 60))
    rows = [(k, " ".join(draw.sample(common, 40) + (draw.sample(toxic, 8) if k % 5 == 0 else []))) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.trained(docs, spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(900)], "doc_id long, toxic int"))
    scorer = toxicity.Scorer(model)
    score = lambda text: float(scorer.scores(pa.array([text]))[0])
    signs = [chr(x) for x in range(0x4E00, 0x9FA5)]
    assert score(" ".join(draw.sample(toxic, 8))) >= toxicity.THRESHOLD
    unseen = score("漢")
    assert all(score(" ".join(word(signs, 4) for _ in range(20_000))) == unseen < toxicity.THRESHOLD for _ in range(3))


def brute_sets(rows, words):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold))
        yield doc_id, {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def brute_rows(rows, words, percent):
    """(doc_id, n_shingles, component_id) of each row, rows of one doc_id apart; and how many pairs of rows are linked."""
    sets = list(brute_sets(rows, words))
    root, holders, shared = list(range(len(sets))), defaultdict(list), defaultdict(int)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (doc_id, own) in enumerate(sets):
        for x in own if doc_id is not None else ():
            for j in holders[x]:
                shared[j, k] += 1
            holders[x].append(k)
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a][1]) + len(sets[b][1]) - n)]
    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    least = {}
    for k, (doc_id, _) in enumerate(sets):
        if doc_id is not None:
            least[find(k)] = min(doc_id, least.get(find(k), doc_id))
    return [(doc_id, len(own), least.get(find(k))) for k, (doc_id, own) in enumerate(sets)], len(links)


def brute_components(rows, words, percent):
    return {doc_id: (n, c) for doc_id, n, c in brute_rows(rows, words, percent)[0]}


@pytest.mark.parametrize(("words", "percent", "rows", "n_bands"), [(3, 85, 8, 56), (5, 80, 7, 64)])
def test_near_duplicates(spark, docs, words, percent, rows, n_bands):
    rng = random.Random(7)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    more = []
    for k in range(140):  # a group of edited copies, some linked only through others
        own = list(base)
        for _ in range(rng.randrange(9)):
            own[rng.randrange(120)] = f"z{rng.randrange(9)}"
        more.append((1000 + k, " ".join(own)))
    table = docs.where("doc_id is not null").select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = brute_components([(r.doc_id, r.text) for r in table.collect()], words, percent)
    got = near_dup.near_duplicates(table, words, percent, rows, n_bands).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(k, n, c, k == c) for k, (n, c) in want.items()}


def test_block_links_with_giant_components(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng = random.Random(11)
    rows = []
    for k in range(60):
        own = [f"w{j}" for j in range(100)]
        for _ in range(rng.randrange(6)):
            own[rng.randrange(100)] = f"z{rng.randrange(5)}"
        rows.append((k, " ".join(own)))
    want = brute_components(rows, 3, 85)
    texts = dict(rows)
    members = []
    for k, text in texts.items():
        own = near_dup.shingles(text, 3)
        component = k if k >= 30 else 0  # thirty are already one component, larger than a block
        members.append((0, k, component, bytearray((near_dup.signature(own, 448) & np.uint32(255)).astype(np.uint8).tobytes()), own.view(np.int64).tolist()))
    frame = spark.createDataFrame(members, "cluster long, node long, component long, short binary, elements array<long>")
    links = [(r.a, r.b) for r in near_dup.block_links(frame, 85).collect()]
    root = {k: (0 if k < 30 else k) for k in texts}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    groups = defaultdict(set)
    for k in texts:
        groups[find(k)].add(k)
    for k, (_, c) in want.items():
        assert find(k) == find(c)


ORDER = lambda x: tuple((v is not None, v) if v is not None else (False, 0) for v in x)


def test_near_duplicates_of_hard_rows(spark, docs):
    """Null ids, repeated ids with other texts, empty tables: each row has the component of its own text."""
    long = " ".join(f"w{k}" for k in range(300))
    more = [(7, long), (7, "quite another text of its own"), (3, long + " end"), (None, long), (50, "w0"), (50, long), (-4, "quite another text of its own"), (50, long)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in table.collect()]
    want, _ = brute_rows(rows, 3, 85)
    got = near_dup.near_duplicates(table, 3, 85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=ORDER) == sorted(want, key=ORDER)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dup.near_duplicates(empty(docs)).count() == 0
    # One row of each component stays, and every row without id or words.
    kept = [(r.doc_id, r.text) for r in near_dup.deduplicated(table, 3, 85).collect()]
    assert sum(d is None for d, _ in kept) == 2 and sum(not (t or "").split() for _, t in kept) == 3
    linked = [(d, t) for d, t in kept if d is not None and (t or "").split()]
    assert brute_rows(linked, 3, 85)[1] == 0  # nothing alike is left
    every = {frozenset(x) for d, x in brute_sets(rows, 3) if d is not None and x}
    held = [x for _, x in brute_sets(linked, 3)]
    assert all(any(100 * len(x & y) >= 85 * len(x | y) for y in held) for x in every)  # and nothing is lost
    assert {(3, long + " end"), (-4, "quite another text of its own"), (50, "w0")} <= set(linked) and {(50, long), (7, long)}.isdisjoint(linked)


def test_recall_of_the_two_settings(spark):
    """Every link of the documents at sf0.01 by brute force, under the settings of the query and of the pipeline."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for words, percent, n_rows, n_bands in ((3, 85, 8, 56), (5, 80, 7, 64)):
        want, links = brute_rows(rows, words, percent)
        got = near_dup.near_duplicates(docs, words, percent, n_rows, n_bands).collect()
        assert links > 50 and sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(want)


def test_deduplicated_keeps_one_and_the_columns(docs):
    out = near_dup.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, k) for k in range(12) if k != 7] + [(True, 0)]
    assert near_dup.deduplicated(empty(docs)).count() == 0


def test_mix(docs, spark):
    rows = docs.select(F.col("doc_id"), F.col("source"), mixing.word_count().alias("size"))
    out = mixing.systematic(rows).collect()
    assert len(out) == docs.count()
    total = sum(r.size for r in out)
    targets = {r.source: (r.target, r.source_size) for r in out}
    assert abs(sum(t for t, _ in targets.values()) - total) < 1e-6 * total and all(t <= 3 * s for t, s in targets.values())
    assert all(0 <= r.copies <= 3 for r in out)
    again = mixing.systematic(rows).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in out)
    assert mixing.mixed_documents(empty(docs)).count() == 0 and mixing.systematic(rows.limit(0)).count() == 0


def test_shards(docs):
    out = sorted(sharding.byte_shards(sharding.sized(docs), 4).collect(), key=lambda r: (r.shard, r.slot))
    assert [r.size for r in out] and len(out) == docs.count()
    assert sorted((r.size, r.text_crc32) for r in out) == sorted((len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs.collect())
    for shard in {r.shard for r in out}:
        assert [r.slot for r in out if r.shard == shard] == list(range(sum(r.shard == shard for r in out)))
    ids = [(r.doc_id is not None, r.doc_id or 0) for r in out]
    assert ids == sorted(ids)
    total, before = sum(r.size for r in out), 0
    for r in out:
        assert r.shard == min(3, (2 * before + r.size) * 4 // (2 * total))
        before += r.size
    assert sharding.byte_shards(sharding.sized(empty(docs)), 4).count() == 0


def test_license_base_places_and_fuzzy_labels(docs, spark):
    texts = ["", None, "Released under the MIT  License, mit-license", "cc by cc by", "GNU Genral Public Licence", "unit license commit license", "Apache Lisense 2", "x" * 5_000, "The Mozila Public License"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(docs.select("doc_id", "text").where("doc_id is null"))
    got = {r.doc_id: r for r in licenses.scanned(frame).collect()}
    for k, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        places = [(j, label) for phrase, label in licenses.BASE.items() for j in range(len(words)) if words[j : j + len(phrase.split())] == phrase.split()]
        row = got[k]
        starts = [j for j, _ in places]
        assert (row.n_words, row.n_base, row.first_word, row.last_word) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert row.base_labels == ",".join(sorted({x for _, x in places})) and set(row.base_labels.split(",")) <= {*row.labels.split(","), ""}
    assert got[4].labels == "gpl" and 0 < got[4].score < 1 and got[6].labels == "apache" and got[8].labels == "mpl" and got[5].labels == ""
    spans = licenses.notices(frame.where("doc_id = 4")).head()
    assert (spans.first_word, spans.n_words, spans.edits, spans.found) == (0, 4, 2, "gnu genral public licence")
    assert licenses.scanned(empty(docs)).count() == 0


def brute_labels(text):
    """Labels by edit distance over every run of whole words."""
    joined = licenses.folded(text)
    words, out = joined.split(), set()

    def apart(a, b):
        table = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        return table[len(a), len(b)]

    for phrase, label in (licenses.BASE | licenses.MORE).items():
        there = phrase.split()
        for i in range(len(words)):
            for j in range(i + 1, min(len(words), i + len(there) + 3) + 1):
                here = words[i:j]
                if len(here) == len(there):
                    near = all(apart(x, y) <= len(y) // 5 for x, y in zip(here, there, strict=True))
                else:
                    near = all(x in here for x in there if len(x) < 5)
                if near and apart(" ".join(here), phrase) <= len(phrase) // 10:
                    out.add(label)
    return ",".join(sorted(out))


def test_license_labels_against_edit_distance(spark):
    """Short names stand unedited, long notices may be edited; edited phrases at random agree with the brute force."""
    plain = ["a fit license", "kit license here", "it license", "emit license", "the bad license", "godzilla public license", "unit", "m it license"]
    draw = random.Random(9)
    edited = []
    for phrase in sorted(licenses.BASE | licenses.MORE):
        for _ in range(25):
            signs = list(phrase)
            for _ in range(draw.randint(0, 3)):
                k = draw.randrange(len(signs))
                signs[k : k + draw.randint(0, 1)] = draw.choice(["", "x", " ", "e"])
            edited.append("see " + "".join(signs) + draw.choice(["", " here", ", version 2"]))
    texts = plain + edited
    got = {r.doc_id: r.labels for r in licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(plain))] == [""] * len(plain)
    assert {t: got[k] for k, t in enumerate(texts)} == {t: brute_labels(t) for t in texts}
    assert sum(x != "" for x in got.values()) > 100


def test_license_hard_rows(spark, docs):
    clash = docs.withColumnRenamed("key", "labels").withColumn("score", F.lit("clash")).withColumn("n_words", F.lit(None))
    rows = licenses.scanned(clash).collect()
    assert len(rows) == docs.count() and {r.labels for r in rows} == {""} and all(isinstance(r.score, float) for r in rows)
    long = spark.createDataFrame([(1, "word " * 200_000 + "mit license " + "é" * 300_000)], "doc_id long, text string")
    row = licenses.scanned(long).head()
    assert (row.n_words, row.n_base, row.first_word, row.labels) == (200_003, 1, 200_000, "mit")


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/", "same"), (2, None, "same"), (5, "http://b/\r\n", "same"), (3, "http://c/", None), (4, "http://d/", ""), (None, "http://e/", "alone é"), (9, "u", "y" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    files = warc.write(pages)
    got = {(r.page_id, r.url): r for r in warc.read(files).collect()}
    sha = lambda x: base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()
    last = {"same": 5, "": 4}
    for page_id, url, html in rows:
        row = got[page_id, url if url is None else url.replace("\r", "%0D").replace("\n", "%0A")]
        response = page_id == last.get(html or "", page_id)
        assert (row.payload_bytes, row.payload_digest) == (len((html or "").encode()), sha(html))
        assert (row.record_type, row.refers_to) == (("response", None) if response else ("revisit", last[html or ""]))
        assert row.payload == (bytearray((html or "").encode()) if response else None)
    paths = [r.path for r in warc.export(files, str(tmp_path / "out")).collect()]
    archived = [f for p in paths for f, _ in warc.records(iter([open(p, "rb").read()]))]
    ids = [f["warc-record-id"] for f in archived]
    assert len(archived) == len(set(ids)) == len(rows) and all(f["warc-date"] == warc.DATE for f in archived)
    assert all(f["warc-refers-to"] in ids for f in archived if f["warc-type"] == "revisit")
    assert warc.read(warc.write(pages.limit(0))).count() == 0


@pytest.mark.parametrize("lent", [0, 200_000])
def test_warc_hard_rows_equal_the_sql(spark, tmp_path, monkeypatch, lent):
    """Null and repeated ids, repeated rows, clashing columns, and short payloads that are never revisits."""
    import duckdb

    monkeypatch.setattr(warc, "LENT", lent)
    rows = [(None, "unique"), (None, "five"), (5, "five"), (5, "five"), (2, "five"), (None, "nulls"), (None, "nulls"), (9, ""), (8, None), (-3, "x"), (-4, "x")]
    pages = spark.createDataFrame([(k, f"http://{n}/", h, 1, "clash", "c") for n, (k, h) in enumerate(rows)], "page_id long, url string, html string, last long, sha1 string, copies string")
    files = warc.write(pages)
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "html").toArrow())
    key = lambda x: tuple((v is not None, str(v)) for v in x)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = con.sql(f"SELECT {', '.join(names)} FROM ({warc.OP10_SQL})").fetchall()
    assert sorted((tuple(r) for r in warc.read(files).select(*names).collect()), key=key) == sorted(want, key=key)
    ids = [f["warc-record-id"] for r in files.collect() for f, _ in warc.records(iter([bytes(r.data)]))]
    assert len(ids) == len(set(ids))
    short = {(r.page_id, r.record_type) for r in warc.read(warc.write(pages, least=2)).where("payload_bytes < 2").collect()}
    assert short == {(9, "response"), (8, "response"), (-3, "response"), (-4, "response")}


def test_media_features_from_the_stored_files(spark, docs):
    long = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(77, "long text " * 150_000)], "doc_id long, text string"))
    files = media.stored(long).collect()
    rows = {(r.doc_id, r.media_sha256): r for r in media.features(media.stored(long)).collect()}
    for f in files:
        data = bytes(f.media)
        row = rows[f.doc_id, hashlib.sha256(data).hexdigest()]
        pixels = b"".join(x.indices.tobytes() for x in gif.read(data).frames)
        shades = [sum(pixels.count(bytes([v])) for v in range(16 * k, 16 * k + 16)) for k in range(16)]
        assert (row.media_bytes, row.payload_bytes, row.feature) == (len(data), len(pixels), ",".join(map(str, shades)))
    assert max(r.n_bytes for r in rows.values()) == 1_500_000


def test_media_damage_interlace_and_own_palettes():
    data = media.as_gif(b"some words of a text " * 40)
    for bad in (b"", data[:5], b"XXX" + data[3:], data[: len(data) // 2], data[:-1], gif.write(192, 1, [], media.GREYS)):
        with pytest.raises(ValueError):
            media.from_gif(bad)
    rows = np.arange(40, dtype=np.uint8).reshape(10, 4)
    common, own = np.zeros((256, 3), np.uint8), np.arange(768, dtype=np.uint16).astype(np.uint8).reshape(256, 3)
    sent = rows[[0, 8, 4, 2, 6, 1, 3, 5, 7, 9]]  # every 8th row from 0, every 8th from 4, every 4th from 2, every 2nd from 1
    file = bytearray(gif.write(4, 10, [gif.Frame(0, 0, 4, 10, sent, own, 0, 0)], common))
    at = file.index(bytes([0x2C, 0, 0, 0, 0, 4, 0, 10, 0])) + 9
    file[at] |= 0x40
    frame = gif.read(bytes(file)).frames[0]
    assert (frame.indices == rows).all() and (frame.rgb() == own[rows]).all()


def test_warc_damage():
    member = warc.record(1, "u", b"payload", warc.digest(b"payload"), "self")
    assert len(list(warc.records(iter([member[:10], member[10:] + member])))) == 2
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.records(iter([member[:-3]])))
    text = gzip.decompress(member)
    with pytest.raises(ValueError, match="digest"):
        warc.framed(text.replace(b"payload\r\n\r\n", b"payloae\r\n\r\n"))
    with pytest.raises(ValueError, match="Content-Length"):
        warc.framed(text[:-5])


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = c.toxicity_stage(spark, docs, SF)
    bad = toxicity.scored(docs, toxicity.trained(docs, spark.read.parquet(f"{SF}/labels.parquet"))).where("score >= 0.7").count()
    assert kept.columns == docs.columns and kept.count() == docs.count() - bad
    one = c.near_dedup_stage(spark, kept, SF)
    want = brute_components([(r.doc_id, r.text) for r in kept.collect()], 5, 80)
    assert sorted(r.doc_id for r in one.collect()) == sorted({x for _, x in want.values()})
    mixed = c.mixing_stage(spark, one, SF)
    assert mixed.columns == docs.columns
    taken = mixing.systematic(one.select("doc_id", "source", mixing.word_count().alias("size"))).agg(F.sum("copies")).head()[0]
    assert mixed.count() == taken == c.pieces_stage(spark, mixed, SF).count()


def test_pipeline_run_on_hard_rows(spark, tmp_path):
    """Null and empty texts, repeated ids with other texts, copies and null sources through ``run``: the stages' own results."""
    import corpus_pipeline as c

    own = " ".join(f"word{k}" for k in range(80))
    rows = [(k, t, "en", f"s{k % 3}" if k % 4 else None, len(t or "")) for k, t in enumerate([*HARD, own, own + " end", "some other text", own.upper()])]
    rows += [(3, "the same id with a text of its own " + own[:200], "en", "s0", 1), (3, HARD[3], "en", "s0", 1), (None, "no id", None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, None, None), (4, 1, 0), (5, 0, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = c.run(spark, str(tmp_path)).collect()
    # Without confirmed toxic texts nothing is rejected; one of each component stays; the mix repeats rows.
    want, _ = brute_rows([r[:2] for r in rows], 5, 80)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = near_dup.deduplicated(docs)
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert {d for d, _ in left} == {r[2] if r[2] is not None else r[0] for r in want} and sum(d == 3 for d, _ in left) == 2
    taken = {(r.doc_id, r.text): 0 for r in kept.collect()}
    for r in mixing.mixed_documents(kept).collect():
        taken[r.doc_id, r.text] += 1
    sent = defaultdict(int)
    for (doc_id, _), n in taken.items():
        sent[doc_id] += n
    got = defaultdict(int)
    for r in out:
        got[r.doc_id] += 1
    assert got == {k: n for k, n in sent.items() if n}
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert c.run(spark, str(tmp_path / "none")).count() == 0
