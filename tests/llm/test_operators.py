"""Each operator against a brute-force version or the library it must equal, with nulls, empty and long
texts, ties, repeated rows, empty tables and clashing column names."""
from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from gridloom.llm import chat, darts, flat, gam, hamming, leaks, lengths, masked, pieces, repeats
from gridloom.llm.links import Kept, components
from gridloom.llm.queries import PIECES, RANKS, oracle_sql, tokenizer

WORD = re.compile(r"[0-9a-z_\u0080-\U0010ffff]+")
DOCS = "doc_id long, text string"


def some_texts(n=40, seed=3):
    rnd = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"word{i}" for i in range(300)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(30, 120))] for _ in range(n // 4)]
    out = [None, "", "  \n ", "!!!", "one", "one two three", "x " * 3000, "y" * 5000]
    for _ in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 12)):
            words[rnd.randrange(len(words))] = rnd.choice(vocab)
        out.append(rnd.choice([" ", "\n", "  "]).join(words))
    return out


@pytest.fixture(scope="module")
def rows():
    texts = some_texts()
    return [*enumerate(texts), (12, texts[12]), (None, texts[12]), (None, None), (500, texts[12]), (12, "another text of the same id, with words enough to count")]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def shingles(text):
    words = WORD.findall((text or "").lower())
    return collections.Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else collections.Counter()


def test_pieces_equal_the_library(spark, rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECES))
    rnd = random.Random(1)
    odd = [None, "", " ", "a  b ", "▁a▁b", "a\r\n\n b\t", "x\u0000y", "日本語🎉 é", "</s> <0x0A>", "ab" * 900, "   " * 200, *("".join(rnd.choice("abet in\n ▁é日🎉.,1!  ") for _ in range(200)) for _ in range(30))]
    table = docs_of(spark, [*rows, *((1000 + i, t) for i, t in enumerate(odd))]).withColumnRenamed("doc_id", "ids_")
    got = pieces.decode(pieces.encode(table, tokenizer(PIECES)), tokenizer(PIECES)).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        want = model.encode(r.text or "", add_eos=True)
        assert r.ids == want and r.decoded == model.decode(want)
    for r in pieces.digests(docs_of(spark, rows), tokenizer(PIECES)).collect()[:9]:
        want = model.encode(dict(reversed(rows))[r.doc_id] or "", add_eos=True)
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert pieces.encode(table.limit(0), tokenizer(PIECES)).count() == 0
    own = pieces.Pieces(tokenizer(PIECES))
    words = ["etaoinshrdlu" * 30, "aab" * 100]
    fast = [own.merge_long(np.where(own.char[[ord(c) for c in w]] >= 0, own.char[[ord(c) for c in w]], 0)).tolist() for w in words]
    assert [model.encode("x" + w)[0:0] + f for w, f in zip(words, fast)] == [own.merge([w])[0].tolist() for w in words]


def test_repeats(spark, rows):
    least, split = {}, [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 12) if i is not None else ():
            g = tuple(w[k:k + 13])
            least[g] = min(least.get(g, i), i)
    want = collections.Counter()
    for i, w in split:
        lost = {p for k in range(len(w) - 12) if i is not None and least[tuple(w[k:k + 13])] < i for p in range(k, k + 13)}
        want[i, len(w), len(lost), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in lost).encode()).hexdigest()] += 1
    table = docs_of(spark, rows)
    assert collections.Counter(map(tuple, repeats.removals(table).collect())) == want
    assert repeats.removals(table.limit(0)).count() == 0


def test_near_duplicates(spark, rows):
    found = darts.classes(docs_of(spark, rows)).collect()
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    known = [(i, t, shingles(t)) for i, t in rows if i is not None]
    for (i, t, a), (j, u, b) in itertools.combinations(known, 2):
        same = sum((a & b).values()) >= 0.8 * sum((a | b).values()) if a and b else not a and not b and (t or "") == (u or "")
        if same:
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    assert len(found) == len(rows)
    assert {r.doc_id: r.class_id for r in found} == {i: None if i is None else root(i) for i, _ in rows}
    wide = docs_of(spark, rows).selectExpr("*", "1 as class_id", "2 as node", "3 as _rank")
    kept = darts.one_of_each(wide)
    assert kept.columns == wide.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({root(i) for i in parent})
    assert darts.classes(docs_of(spark, rows).limit(0)).count() == 0


def test_signatures_estimate_weighted_similarity():
    a, b = "p q r s t u v w " * 3 + "k l m", "p q r s t u v w " * 5 + "k l n"
    x, y = shingles(a), shingles(b)
    s = darts.signature(*darts.weighted(pa.array([a, b, ""])), k=4000)
    assert abs((s[0] == s[1]).mean() - sum((x & y).values()) / sum((x | y).values())) < 0.03 and not s[2].any()


def test_large_group_of_near_copies(spark):
    rnd = random.Random(5)
    base = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(150):
        words = list(base)
        for p in rnd.sample(range(150), rnd.choice([2, 4, 8])):
            words[p] = f"n{i}_{p}"
        rows.append((i, " ".join(words)))
    test_near_duplicates(spark, rows)


def test_files_of_kept_tables_follow_the_rows(spark, rows, monkeypatch):
    """On a local disk Hadoop starts two processes for a file; one a shuffle partition were thousands."""
    files, keep = [], Kept.keep
    monkeypatch.setattr(Kept, "keep", lambda self, df: (out := keep(self, df), files.append((self.files, len(out.inputFiles()))))[0])
    most = 2 * spark.sparkContext.defaultParallelism
    held = {"spark.sql.shuffle.partitions": str(3 * most), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = {r.doc_id: r.class_id for r in darts.classes(docs_of(spark, rows)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found[500] == found[12] and found[None] is None
    assert len(files) > 10 and max(n for bound, n in files if bound) <= most
    kept = Kept(spark)
    kept.bound(10**8)
    assert kept.files == 24415


def test_short_texts_are_signed_in_bounded_memory():
    texts = pa.array([f"some {i} words of text {i % 7}" for i in range(4000)])
    codes, begin = darts.weighted(texts)
    tracemalloc.start()
    many = darts.signature(codes, begin)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20
    part = slice(begin[300], begin[310])
    assert (many[300:310] == darts.signature(codes[part], begin[300:311] - begin[300])).all()


def test_differences_leave_in_bounded_batches(monkeypatch):
    rnd = np.random.default_rng(1)
    sides = [[np.sort(rnd.choice(500, 200, False)).astype(np.uint32) for _ in range(60)] for _ in range(2)]
    batch = pa.RecordBatch.from_pydict({"a": list(range(60)), "b": list(range(100, 160)), "label": [1] * 60, "probe": [True] * 60, **{f"codes_{c}": [x.tobytes() for x in side] for c, side in zip("ab", sides)}})
    monkeypatch.setattr(darts, "ELEMENTS", 1000)
    out = list(darts._differences([batch, batch.slice(0, 0)]))
    assert len(out) > 5 and max(b.num_rows for b in out) < 1000 + 400
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert got == [(i, 100 + i, 1, True, 200, 200, len(d), e) for i, (x, y) in enumerate(zip(*sides)) for d in [np.setxor1d(x, y)] for e in d]


def test_leaks(spark, rows):
    items = [(1, rows[20][1]), (2, " ".join(rows[30][1].split()[5:20])), (3, "one two three"), (4, ""), (5, None), (None, "one"), (6, "not there at all, never seen anywhere"), (7, " ".join(rows[25][1].upper().split()[:40]))]
    got = leaks.find(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want, bad = set(), set()
    for (k, item), (i, text) in itertools.product(items, set(rows)):
        words, own = WORD.findall((item or "").lower()), WORD.findall((text or "").lower())
        w = min(5, len(words))
        q = {tuple(words[p:p + w]) for p in range(len(words) - w + 1)} if w else set()
        n = len(q & {tuple(own[p:p + w]) for p in range(len(own) - w + 1)}) if w else 0
        if k is not None and q and n >= 0.8 * len(q):
            want.add((i, k, len(q), n))
            bad.add(text)
    assert len(want) >= 5 and {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got} == want
    wide = docs_of(spark, rows).selectExpr("*", "'x' as f1", "'y' as _f1")
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = leaks.drop(wide, bench)
    assert clean.columns == wide.columns and clean.count() == sum(t not in bad for _, t in rows)
    assert leaks.drop(wide, bench.limit(0)).count() == len(rows) and leaks.find(wide.limit(0), bench).count() == 0


def test_leaks_of_repeated_and_null_ids(spark, tmp_path):
    passage = lambda c, n=30: " ".join(f"{c}{i}" for i in range(n))
    a, b, c, d = map(passage, "abcd")
    items = [(1, a), (1, b), (1, "hello there"), (2, c), (2, c + " end"), (None, d), (None, None), (3, a)]
    rows = [(1, f"x {a} y"), (2, f"x {b} y"), (3, f"{b} and {a}"), (4, f"{c} z"), (5, d), (6, "nothing of it at all here"), (7, "well hello there you"), (None, b)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, rows)
    # an id's passages are one item, as in the SQL; a passage below five words is searched at its own width
    got = {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in leaks.find(docs, bench).collect()}
    long = {g for g in got if g[2] > 1}
    assert got - long == {(7, 1, 1, 1)} and long == {(1, 3, 26, 26), (3, 1, 52, 52), (3, 3, 26, 26), (4, 2, 27, 26)}
    duckdb = pytest.importorskip("duckdb").connect()
    for name, table, columns in (("documents", rows, "doc_id BIGINT, text VARCHAR"), ("benchmark", items, "item_id BIGINT, text VARCHAR")):
        duckdb.execute(f"CREATE TABLE {name} ({columns})")
        duckdb.executemany(f"INSERT INTO {name} VALUES (?, ?)", table)
    assert {r[:4] for r in duckdb.execute(oracle_sql()["op9_decontamination"]).fetchall()} == long
    # every passage counts for itself when documents are dropped
    assert {r.doc_id for r in leaks.drop(docs, bench).collect()} == {5, 6}
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()} == {6}


def test_quality(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    scored = gam.score(docs, gam.train(docs, labels)).join(labels.select("doc_id", "quality"), "doc_id").where(gam.remainder() == 1).collect()
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in scored]) > 0.93
    empty = gam.train(docs, labels.limit(0))
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "a", 5), (2, "", 5)], DOCS + ", score_ int")
    assert {r.score for r in gam.score(odd, empty).collect()} == {0.5}
    assert all(0 <= r.score <= 1 for r in gam.score(odd, gam.train(docs, labels)).collect()) and gam.score(odd.limit(0), empty).count() == 0


def test_quality_fits_at_most_max_rows(spark, monkeypatch):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1][:5]
    rows = [(ids[0], f"text {'word ' * k}number {k}") for k in range(200)] * 2 + [(i, "some other text") for i in ids[1:]]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    sizes = []
    monkeypatch.setattr(gam, "fit", lambda x, y: sizes.append((len(x), len({tuple(r) for r in x.tolist()}))))
    gam.train(docs_of(spark, rows), labels, max_rows=20)
    gam.train(docs_of(spark, rows), labels)
    assert sizes[0][0] == 20 and 20 < sizes[1][0] <= 204


def test_tables_equal_tree_by_tree_fit():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(2000, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rnd.random(2000) < 0.05)).astype(float)
    model = gam.fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.85 and model.pairs[0][:2] == (0, 1)


def test_lengths(spark, rows):
    import public_tokenizers

    encode = lengths.encoder(tokenizer(RANKS), public_tokenizers.PATTERN)
    sizes = [len(encode.encode_ordinary(t or "")) for _, t in rows]
    hist = lengths.histogram(lengths.count(docs_of(spark, rows), tokenizer(RANKS), public_tokenizers.PATTERN))
    for r in hist.collect():
        n = r.n_tokens
        assert (r.docs, r.docs_from, r.tokens_from) == (sizes.count(n), sum(s >= n for s in sizes), sum(s for s in sizes if s >= n))
        assert r.tokens_cut == sum(min(s, n) for s in sizes) and abs(r.share_upto - sum(s <= n for s in sizes) / len(sizes)) < 1e-12
    assert [(r.context, r.docs_over, r.tokens_cut) for r in lengths.at_limits(hist, [0, 77, 10**6]).collect()] == [(k, sum(s > k for s in sizes), sum(min(s, k) for s in sizes)) for k in (0, 77, 10**6)]
    assert [r.n_tokens for r in lengths.quantiles(hist, [0.5, 1.0]).collect()] == [sorted(sizes)[(len(sizes) + 1) // 2 - 1], max(sizes)]
    assert lengths.histogram(lengths.count(docs_of(spark, rows).limit(0), tokenizer(RANKS), public_tokenizers.PATTERN)).count() == 0


def test_chat(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "é🎉"), (1, 2, "bob", "é🎉"), (1, 5000, None, None), (1, None, "", "x"), (2, 0, "system", "alone"), (None, 1, "ann", "who?")]
    got = chat.rotate(spark.createDataFrame([(*t, 7) for t in turns], "conv_id long, turn long, role string, text string, perspective int")).collect()
    assert len(got) == 6 * 3 + 1
    for conv, who in {(r.conv_id, r.perspective) for r in got}:
        mine = sorted((r for r in got if (r.conv_id, r.perspective) == (conv, who)), key=lambda r: r.segment_start)
        whole = "".join(r.segment for r in mine)
        assert [r.segment_start for r in mine] == [len("".join(x.segment for x in mine[:k])) for k in range(len(mine))]
        for r in mine:
            assert r.trained == (r.speaker == who) and ("assistant" in r.segment) == r.trained
            assert whole[r.content_start:r.content_end] in [t[3] or "" for t in turns]


def test_hamming(spark):
    rnd = random.Random(2)
    vectors = [(i, [rnd.gauss(0, 1) for _ in range(24)]) for i in range(120)] + [(200 + i, [1.0] * 24) for i in range(30)] + [(300, None), (None, [1.0] * 24), (301, [None] * 24), (5, [0.0] * 10), (200, [1.0] * 24)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    bits = {(i, tuple(bool(v and v > 0) for v in [*x, *[0] * 24][:24])) for i, x in vectors if i is not None and x is not None}
    got = collections.defaultdict(list)
    for r in hamming.search(table, table.where("vec_id % 20 = 0"), 6).collect():
        got[r.query_id].append((r.rank, r.distance, r.neighbour_id))
    for q, b in bits:
        if q % 20 == 0:
            near = sorted((sum(x != y for x, y in zip(b, c)), i) for i, c in bits if i != q)[:6]
            assert sorted(got[q]) == [(k + 1, d, i) for k, (d, i) in enumerate(near)]


def test_pseudo_likelihood(spark, sf_dir, rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = masked.train(docs)
    texts = pa.array([t for _, t in rows])
    scored = masked.score(docs_of(spark, rows), net).collect()
    h, first = masked._hashes(texts)
    word = net.classes(h)
    for k, r in enumerate(scored):
        at = np.arange(first[k], first[k + 1])
        assert r.n_tokens == len(at)
        if not len(at):
            assert r.log_likelihood == 0.0 and r.mean_log_likelihood is None
            continue
        around = [[word[i + d] if first[k] <= i + d < first[k + 1] else masked.CLASSES for d in masked.SIDE] for i in at]
        z = np.tanh(net.hidden + sum(net.rows[s][[a[s] for a in around]] for s in range(4)))
        group = word[at] // masked.GROUP
        soft = lambda v: v - np.log(np.exp(v).sum(1, keepdims=True))
        want = soft(z @ net.to_group + net.group)[range(len(group)), group] + soft(z @ net.to_class + net.inner[group])[range(len(group)), word[at] % masked.GROUP]
        assert abs(want.sum() - r.log_likelihood) < 1e-3 + 1e-6 * abs(r.log_likelihood)
    start = masked.Network.start(net.words, np.bincount(net.classes(masked._hashes(pa.array([r.text for r in docs.collect()]))[0]), minlength=masked.CLASSES).astype(float))
    start.to_group[:], start.to_class[:] = 0, 0  # class frequencies alone
    alone = sum(r.log_likelihood for r in masked.score(docs, start).collect())
    assert sum(r.log_likelihood for r in masked.score(docs, net).collect()) > alone
    assert masked.score(docs.limit(0), masked.train(docs.limit(0))).count() == 0


def test_pseudo_likelihood_of_words(spark, sf_dir):
    rows = [(i, f"alpha beta w{i % 1500} gamma w{i % 700} rare{i} w{i % 1500}") for i in range(3000)] + [(None, None), (7, "!"), (7, "alpha w3 w3 beta")]
    docs = docs_of(spark, rows)
    counts = masked.count(docs, Kept(spark))
    net = masked.train(docs, counts=counts)
    n = collections.Counter(masked._hashes(pa.array([t for _, t in rows]))[0].tolist())
    assert {r.h % 2**64: r.n for r in counts.collect()} == n
    classes = dict(zip(n, net.classes(np.array(list(n), np.uint64)).tolist()))
    total = collections.Counter()
    for h, k in n.items():
        total[classes[h]] += k
    assert len(n) > len(net.words) + 900
    plain = collections.Counter()
    for r in masked.score(docs, net).collect():
        share = sum(np.log(n[h] / total[classes[h]]) for h in masked._hashes(pa.array([r.text]))[0].tolist())
        plain[(r.doc_id, r.n_tokens, round(r.log_likelihood + share, 2))] += 1
    for known in (0, 500, masked.KNOWN):
        got = masked.score(docs, net, counts=counts, known=known).collect()
        found = sorted((r.doc_id or -1, r.n_tokens, r.log_likelihood) for r in got)
        want = sorted((d or -1, k, v) for d, k, v in plain.elements())
        assert len(found) == len(rows) and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 0.02 for a, b in zip(found, want))
    assert {r.mean_log_likelihood is None for r in got if r.n_tokens == 0} == {True}
    assert masked.groups(54_083) == masked.GROUP < masked.groups(280_729) < masked.groups(10**8)


def test_every_word_is_masked_once(spark):
    texts = ["one", "one two", "a b c", "a b c", None, "", " ".join(f"w{i % 9}" for i in range(50))]
    word, first = np.arange(59), np.cumsum([0, 1, 2, 3, 3, 0, 0, 50])
    seen = [masked._masked(word, first, turn).tolist() for turn in range(masked.MASK_EVERY)]
    assert sorted(sum(seen, [])) == list(range(59))
    docs = spark.createDataFrame([(t,) for t in texts * 30], "text string").repartition(3)
    # short texts alone are learned too, and each round goes on from the average of the one before
    short = spark.createDataFrame([("yes no",)] * 500, "text string")
    flat_, learned = masked.train(short, rounds=0), masked.train(short)
    assert np.abs(flat_.weights - learned.weights).max() > 0
    calls = [masked.train(docs, rounds=k).weights for k in (0, 1, 2, 6)]
    assert all(np.abs(a - b).max() > 0 for a, b in itertools.pairwise(calls))


def test_flat_slices_hold_all_rows(rows):
    batch = pa.record_batch({"text": pa.array([t for _, t in rows])})
    assert sum(len(p) for p in flat.slices(batch, "text", 100)) == len(rows)


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "privacy", "encoding"]
    model = gam.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {r.doc_id for r in gam.score(docs, model).collect() if r.score >= 0.5}
    assert {r.doc_id for r in corpus_pipeline.quality(spark, docs, sf_dir).collect()} == good
    bad = {r.doc_id for r in leaks.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    clean = corpus_pipeline.decontamination(spark, docs, sf_dir)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad and clean.columns == docs.columns
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "ids", "n_tokens", "decoded"] and 0 < out.count() < docs.count()


def test_pipeline_privacy_and_encoding(spark):
    import sentencepiece

    from tests.llm.test_pii import plain_redaction

    texts = [None, "", "plain", "mail a.b@c.de or +1 235 555 3833, é 🎉", "10.0.0.1  twice  10.0.0.1", "x " * 30_000 + "a@b.cc"]
    docs = spark.createDataFrame([(i, t, len(t or ""), "en") for i, t in enumerate([*texts, texts[3]])], "doc_id long, text string, n_chars long, ids string")
    private = corpus_pipeline.privacy(spark, docs, "")
    assert private.columns == docs.columns
    clean = {r.doc_id: (r.text, r.n_chars) for r in private.collect()}
    want = {i: t if t is None else plain_redaction(t) for i, t in enumerate([*texts, texts[3]])}
    assert clean == {i: (t, len(t or "")) for i, t in want.items()}
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECES))
    got = corpus_pipeline.encoding(spark, private, "").collect()
    assert sorted(r.doc_id for r in got) == list(want)
    for r in got:
        ids = library.encode(want[r.doc_id] or "", add_eos=True)
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), library.decode(ids))
    assert corpus_pipeline.encoding(spark, corpus_pipeline.privacy(spark, docs.limit(0), ""), "").count() == 0


@pytest.mark.parametrize("shape, most", [("star", 2), ("path", 9), ("random", 7), ("empty", 2)])
def test_components_in_few_jobs(spark, shape, most):
    """Smallest reachable node of every linked node; one kept table a round and one for the result."""
    rnd = random.Random(5)
    ids = rnd.sample(range(1000), 120)
    links = {
        "star": [(min(ids), x) for x in ids if x != min(ids)] * 2,
        "path": list(itertools.pairwise(ids)),
        "random": [(rnd.choice(ids), rnd.choice(ids)) for _ in range(80)],
        "empty": [],
    }[shape]
    label = {x: x for link in links if link[0] != link[1] for x in link}
    while any(label[a] != label[b] for a, b in links if a != b):
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    kept = Kept(spark)
    found = components(spark.createDataFrame(links, "a long, b long"), kept)
    assert sorted(map(tuple, found.collect())) == sorted(label.items())
    assert kept.count <= most


def test_network_step_against_plain_sums():
    """One step equals sums word by word in doubles, repeated rows added up; arrays are kept between batches of a size."""
    rnd, group = np.random.default_rng(4), masked.GROUP
    net = masked.Network.start(np.arange(5, dtype=np.uint64), rnd.integers(1, 50, group * group).astype(float))
    word, around = rnd.integers(0, 40, 64), rnd.integers(0, 9, (len(masked.SIDE), 64))
    old = {n: getattr(net, n).astype(float) for n in net.shapes(group)}
    new, logs = {n: v.copy() for n, v in old.items()}, []
    for i, w in enumerate(word):
        h = np.tanh(old["hidden"] + sum(old["rows"][s, around[s, i]] for s in range(len(masked.SIDE))))
        g, c = divmod(int(w), group)
        one, two = np.exp(h @ old["to_group"] + old["group"]), np.exp(h @ old["to_class"] + old["inner"][g])
        one, two = one / one.sum(), two / two.sum()
        logs.append(np.log(one[g]) + np.log(two[c]))
        one[g], two[c] = one[g] - 1, two[c] - 1
        back, rate = (old["to_group"] @ one + old["to_class"] @ two) * (1 - h * h), masked.RATE / len(word)
        for n, change in (("to_group", np.outer(h, one)), ("to_class", np.outer(h, two)), ("group", one), ("hidden", back)):
            new[n] -= rate * change
        new["inner"][g] -= masked.ROW_RATE * two
        for s in range(len(masked.SIDE)):
            new["rows"][s, around[s, i]] -= masked.ROW_RATE * back
    assert np.allclose(net.forward(around, word)[0], logs, atol=1e-4)
    room = net.room
    net.learn(around, word)
    assert net.room is room
    for n, v in new.items():
        assert np.allclose(getattr(net, n), v, atol=1e-5), n
