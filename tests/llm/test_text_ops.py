"""Tokenizers, fingerprints, SimHash, suffixes, languages and quality against brute force, on small fixtures with odd rows."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from skein.llm import bpe, components, edit_embedding, langid, quality, simhash, suffix_dedup, token_count

BPE, WORDS, PIECES = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
rnd = random.Random(17)
ODD = ["".join(rnd.choice(["a", "b", "the", "ing", "É", "日本", " ", "  ", "\n", "\t", ".", "#", "1", "’", "ß", "😀", "'s", "Σ", "İ", "\x1c", "\x85", "​", "<|endoftext|>", "<|ENDOFTEXT|>"]) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
ROWS = [(0, None), (1, ""), (2, " \n"), (3, "x" * 30_000), (4, "ab" * 9_000 + " " + "#" * 5_000), (5, "same text twice"), (5, "same text twice"), (None, "no id"), (7, "Ünïcode \x00 byte")] + [(10 + i, t) for i, t in enumerate(ODD)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "extra", 1.5) for i, t in ROWS], "doc_id long, text string, Score string, N_TOKENS double").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def test_bpe(docs, empty):
    import tiktoken

    with open(BPE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode_decode(docs, BPE, P.PATTERN)
    assert encoded.columns == [*docs.columns, "token_ids", "decoded"]
    got = encoded.collect()
    for r in got:
        assert r.token_ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert len(got) == len(ROWS)
    again = bpe.decode(encoded.select("text", "token_ids"), BPE, P.PATTERN).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in again)
    r = next(r for r in bpe.digests(encoded).collect() if r.doc_id == 7)
    ids = library.encode_ordinary("Ünïcode \x00 byte")
    assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert bpe.digests(bpe.encode_decode(empty, BPE, P.PATTERN)).collect() == []
    with pytest.raises(ValueError, match="no token"):
        bpe.codec(BPE, P.PATTERN).decode([10**6])


def test_bpe_order():
    # Equal ranks merge from the left, also if a merge makes a pair of lower rank than the one before.
    ranks = {b"a": 10, b"b": 11, b"aa": 2, b"aab": 0, b"ba": 1}
    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    for n in range(200):
        piece = bytes(random.Random(n).choices(b"ab", k=n % 12 + 2))
        if piece not in ranks:
            assert bpe.merge(piece, ranks) == plain(piece)


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    got = token_count.count_tokens(docs, WORDS).collect()
    assert len(got) == len(ROWS) and [r.n_tokens for r in got] == [len(library.encode(r.text or "", add_special_tokens=False).ids) for r in got]
    r = {r.doc_id: r for r in token_count.lengths(token_count.count_tokens(docs, WORDS)).collect()}
    assert r[3].over_limit and not r[1].over_limit and r[7].n_bytes == len("Ünïcode \x00 byte".encode()) and r[0].n_bytes == 0
    assert token_count.lengths(token_count.count_tokens(empty, WORDS)).collect() == []


def embedded(text):
    """The walks of one text, step by step."""
    codes = [1 + ((ord(c) * 2654435761 % 2**32) >> 16) % 255 for c in text] + [0]
    steps, out = max(1, 2 * len(text) + int(2 * np.sqrt(len(text)))), ""
    for w in range(edit_embedding.WALKS):
        at, seen = 0, []
        for j in range(steps):
            seen.append(codes[at])
            at += int(edit_embedding._moves()[w][j % edit_embedding.PERIOD][codes[at]])
        for c in range(w * edit_embedding.SAMPLES, (w + 1) * edit_embedding.SAMPLES):
            j = int([r for r in edit_embedding._records()[c] if r < steps][-1])
            h = (seen[j] * 0x9E3779B97F4A7C15 % 2**64) ^ (j * 0xC2B2AE3D27D4EB4F % 2**64) ^ (c * 0x165667B1)
            out += f"{(h ^ h >> 31) * 0xD6E8FEB86659FD93 % 2**64 >> 60:x}"
    return out


def test_fingerprints(docs, empty):
    got = edit_embedding.edits(docs).collect()
    order = sorted(ROWS, key=lambda r: -(1 << 63) if r[0] is None else r[0], reverse=True)
    assert len(got) == len(ROWS)
    by_id, expected = {r.doc_id: r for r in got}, []
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        expected.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
        if len(text) < 100 and i != 5:
            assert (by_id[i].fingerprint, by_id[i].edited_fingerprint) == (embedded(text), embedded(edited))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(expected, key=repr)
    assert 0.5 < by_id[3].near_edited < 1
    assert all((r.near_edited >= 0.8) >= r.edited_linked and (r.near_next >= 0.8) >= r.next_linked for r in got)
    assert all(r.edited_linked for r in got if r.fingerprint == r.edited_fingerprint)
    assert edit_embedding.edits(empty).collect() == []
    single = edit_embedding.edits(docs.where("doc_id = 7")).collect()
    assert len(single) == 1 and single[0].near_next == 1


def test_fingerprint_neighbours(spark):
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(600)) for _ in range(30)]
    changed = [t[:250] + "XY" + t[252:400] + t[401:] for t in base]
    a = edit_embedding.append_fingerprint(spark.createDataFrame(list(enumerate(base)), "doc_id int, text string"))
    b = edit_embedding.append_fingerprint(spark.createDataFrame(list(enumerate(changed)), "doc_id int, text string"))
    left, right = ({r.fingerprint: r.doc_id for r in x.collect()} for x in (a, b))
    pairs = {(left[r.a], right[r.b]) for r in edit_embedding.near(a, b, 0.5).collect()}
    assert all(i == j for i, j in pairs) and len(pairs) >= 24


def test_fingerprint_recall(spark):
    """Of all pairs whose fingerprints are alike, by comparing each with each, the bands find nearly all; all that they find is alike."""
    texts = []
    for _ in range(60):
        base = "".join(rnd.choice("abcdefgh ") for _ in range(900))
        texts += [base, base[:300] + "Z" + base[300:], base[:100] + base[101:700] + "QQ" + base[700:], base[:450]]
    prints = edit_embedding.fingerprints(texts)
    names = edit_embedding.text_of(prints)
    brute = {(names[i], names[j]) for i in range(len(texts)) for j in np.flatnonzero(edit_embedding.likeness(np.repeat(prints[i : i + 1], len(texts), 0), prints) >= 0.8).tolist() if names[i] != names[j]}
    df = spark.createDataFrame([(x,) for x in names], "fingerprint string")
    found = {(r.a, r.b) for r in edit_embedding.near(df, df).collect()}
    assert len(brute) > 80 and found <= brute and len(found) >= 0.99 * len(brute)
    assert edit_embedding.near(df.limit(0), df).collect() == []
    row = {x: i for i, x in enumerate(names)}
    some = sorted(brute)[:50]
    assert edit_embedding.proposed(prints[[row[i] for i, _ in some]], prints[[row[j] for _, j in some]]).all()


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, radius=4):
    up = list(range(len(prints)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                up[find(i)] = find(j)
    lowest = {}
    for i, x in enumerate(ids):
        lowest.setdefault(find(i), []).append(x)
    return [min((x for x in lowest[find(i)] if x is not None), default=None) for i in range(len(ids))]


@pytest.fixture(scope="module")
def similar(spark):
    rows = [(i, t) for i, t in ROWS if len(t or "") < 1000][:80]
    for k in range(12):
        words = [rnd.choice("alpha beta gamma delta Épsilon zeta eta theta".split()) + str(rnd.randint(0, 60)) for _ in range(400)]
        for c in range(rnd.randint(1, 6)):
            copy = words[:]
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(400)] = "changed"
            rows.append((1000 + 10 * k + c, " ".join(copy)))
    return rows, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, Fingerprint int").repartition(4)


@pytest.mark.parametrize("tile", [simhash.TILE, 3])
def test_simhash(similar, empty, tile):
    rows, docs = similar
    prints = [plain_simhash(t or "") for _, t in rows]
    expected = sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, plain_components(prints, [i for i, _ in rows]))), key=repr)
    assert sorted((tuple(r) for r in simhash.hexadecimal(simhash.classes(docs, tile=tile)).collect()), key=repr) == expected
    assert simhash.hexadecimal(simhash.classes(empty)).collect() == []


def test_near_dedup(similar):
    rows, docs = similar
    lowest = plain_components([plain_simhash(t or "") for _, t in rows], [i for i, _ in rows])
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted({i for (i, _), c in zip(rows, lowest) if i == c}, key=repr)


def test_near_dedup_by_class(spark):
    """Null and repeated ids with different texts: one row of each class, whatever its id."""
    texts = [" ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 99)) for _ in range(50)) for _ in range(4)]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (1, texts[1]), (None, texts[2]), (2, texts[3]), (2, "quite another text")]
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([rows[0], *rows[3:]], key=repr)


def test_links_between():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    u, v = simhash.links_between(base, near, 4)
    links = {(int(a), int(b)) for a, b in zip(u, v)}
    want = {(int(near[j]), int(base[i])) for i in range(300) for j in range(300) if (int(base[i]) ^ int(near[j])).bit_count() <= 4}
    assert links == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 103), (101, 103), (102, 103), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 104)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def removed(texts, length=400):
    """What a string of `length` bytes that starts elsewhere covers, by listing all of them."""
    count = {}
    for b in texts:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    out = []
    for b in texts:
        cover = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


BASE = "".join(rnd.choice("abcdé ") for _ in range(2500))
LONG = [None, "", "a" * 399, "a" * 400, "a" * 401, "b" * 1500, BASE, BASE[:1300] + "x" + BASE[1300:], BASE[700:1200], BASE[700:1099], "ab" * 600, "xyz" + "ab" * 199 + "a", BASE * 2, "q" * 3000, BASE, "é" * 300, "é" * 300 + "!"]
for _ in range(25):
    at = rnd.randint(0, 1800)
    LONG.append(BASE[at : at + rnd.randint(300, 900)] + "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 500))))


@pytest.mark.parametrize("length, group", [(400, suffix_dedup.GROUP), (400, 2), (240, 2), (64, suffix_dedup.GROUP)])
def test_suffix_dedup(spark, empty, length, group):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(LONG)], "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in suffix_dedup.digests(suffix_dedup.dedup(docs, length=length, group=group)).collect())
    assert got == [(i, *x) for i, x in enumerate(removed([(t or "").encode() for t in LONG], length))]
    assert suffix_dedup.digests(suffix_dedup.dedup(empty.select("doc_id", "text"))).collect() == []


def test_suffix_rows(spark):
    rows = [(1, BASE, "en"), (1, BASE, "en"), (2, "short", None), (None, "b" * 500, "x"), (3, "a" * 100 + BASE[:900], "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Removed string")
    out = suffix_dedup.dedup(docs, trim=True)
    assert out.columns == ["doc_id", "text", "removed", "kept"]
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert got == sorted([(1, ""), (1, ""), (2, "short"), (None, ""), (3, "a" * 100)], key=repr)


def test_suffix_equal_rows(spark):
    """Thousands of equal rows and one leading token in thousands of contexts take no more than their share."""
    same, passage = BASE[:1200], BASE[1500:2000]
    texts = [(1, same)] * 4000 + [(10 + i, f"{i} " + passage + f" {i} " + hashlib.sha256(str(i).encode()).hexdigest() * 6) for i in range(3000)]
    out = suffix_dedup.dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), group=64)
    got = suffix_dedup.digests(out).groupBy("n_spans", F.expr("doc_id = 1").alias("same")).agg(F.count("*").alias("n"), F.min("n_removed").alias("low")).collect()
    assert sorted((r.same, r.n_spans, r.n, r.low >= 500) for r in got) == [(False, 1, 3000, True), (True, 1, 4000, True)]


def test_suffix_blocks(monkeypatch):
    """Texts longer than a block give the same strings as in one block."""
    x = np.frombuffer((BASE * 3).encode(), np.uint8)
    whole = suffix_dedup.contexts(x, np.array([len(x)]))
    strings = {int(i): int(a) for lo, hi, a in zip(*whole[:3]) for i in range(lo, hi + 1)}
    assert sorted(strings) == list(range(len(x) - 399))
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([x.tobytes()], pa.binary())], names=["r1", "r2", "bytes"])
    pieces = [r for b in suffix_dedup._scan([batch], 400) for r in b.to_pylist()]
    assert {i: r["anchor"] for r in pieces for i in range(r["lo"], r["hi"] + 1)} == strings


def brute_word(word, p, own):
    word = langid.START + word
    total = [1.0] + [0.0] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            i = own.ids.get(word[start:end]) or (1 if end == start + 1 else 0)
            total[end] += total[start] * p[i]
    return total[-1]


def test_language_forward():
    own = langid.pieces(PIECES)
    p = np.random.default_rng(1).random((own.size, 3)) * 0.05
    p[0] = 0
    words = sorted(["a", "thering", "ñañó日本", "straße" * 4, "zction" * 9, "x" * 70], key=len)
    at, lengths = own.lattice(words)
    for w, got in zip(words, langid.forward(at, lengths, p)):
        assert got == pytest.approx([np.log(brute_word(w, p[:, k], own)) for k in range(3)])
    at, lengths = own.lattice(words[:2])
    used = langid.expected(at, lengths, p[:, 0], np.ones(2), own.size)
    # By finite differences: the expected number of uses of a piece is the derivative of log P by log p.
    for i in np.flatnonzero(used)[:12]:
        q = p[:, 0].copy()
        q[i] *= 1 + 1e-6
        change = sum(np.log(brute_word(w, q, own) / brute_word(w, p[:, 0], own)) for w in words[:2])
        assert used[i] == pytest.approx(change / 1e-6, rel=1e-3)
    # A word whose probability is below the least number: the pieces of each segmentation have all its characters.
    at, lengths = own.lattice(["straße" * 500, "zq"])
    used = langid.expected(at, lengths, p[:, 0], np.array([2.0, 3.0]), own.size)
    width = np.ones(own.size)
    width[list(own.ids.values())] = [len(x) for x in own.ids]
    assert (used * width).sum() == pytest.approx(2 * 3001 + 3 * 3)


def test_language(spark, empty):
    sample = {"en": "the and with that this from have they which their", "de": "der und die mit das ist nicht ein auch für", "fr": "les des une dans est pour que qui avec être"}
    rows = [(i, " ".join(random.Random(i).choices(words.split(), k=30)), lang) for i, (lang, words) in enumerate([*sample.items()] * 30)]
    odd = [(900, None, "en"), (901, "", "de"), (902, "123 #!", "en"), (903, "die " * 20, None), (None, "les des une", "fr"), (904, "z" * 5000, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(docs, PIECES, langid.fit(docs, PIECES)).collect()}
    assert all(got[i].lang_pred == lang and got[i].score > 0.9 for i, _, lang in rows)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "de" and got[None].lang_pred == "fr" and 0 <= got[904].score <= 1
    none = langid.predict(empty, PIECES, langid.fit(empty, PIECES))
    assert none.collect() == []
    kept = langid.keep_identified(docs, PIECES)
    assert kept.columns == docs.columns and kept.count() == len(rows) + 3


def test_quality(spark, empty):
    good = [" ".join(random.Random(i).choices("plain words make a sentence that reads well".split(), k=60)) for i in range(60)]
    bad = ["BUY!!! $$$ ### " * random.Random(i).randint(5, 20) for i in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(500, None), (501, ""), (None, "plain words"), (502, "x" * 50_000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, Predicted string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(3, 1), (7, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(got[i].predicted == int(i < 60) for i in range(120))
    x = np.random.default_rng(0).random((5, quality.BUCKETS + len(quality.STATISTICS))).astype(np.float32) * 0.02
    pairs = x.copy()
    pairs[:, quality.BUCKETS :] = np.clip((pairs[:, quality.BUCKETS :] - model.mean) / model.spread, -6, 6)
    gram = model.factors.astype(float) @ model.factors.T.astype(float)
    np.fill_diagonal(gram, 0)
    plain = model.bias + pairs @ model.linear + 0.5 * np.einsum("ni,ij,nj->n", pairs, gram, pairs)
    assert quality.raw_score(x, model) == pytest.approx(plain, rel=1e-2, abs=1e-2)
    assert quality.score(empty, quality.fit(empty, labels.limit(0))).collect() == []
