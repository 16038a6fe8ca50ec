"""Each operator against a brute-force version, and on awkward tables."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from corpusmill.llm import boosting, covertree, extraction, htmltree, kmeanstree, langid, mixing, ngram_join, packing, substring, tokencount, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, row string, blobs int, gone_ int, part string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))


def awkward():
    """Nulls in every column, empty and very long texts, repeated rows, same ids, clashing names."""
    rest = ("k", "r", 1, 2, "p")
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10, *rest),
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10, *rest),
        (1, "another text under the same id", "en", "a", 10, *rest),
        (2, None, "en", "a", None, *rest),
        (3, "", None, "b", 0, *rest),
        (4, "   \n\t ", "de", None, 5, *rest),
        (None, "a text without an id at all", "de", "b", 5, *rest),
        (None, None, None, None, None, None, None, None, None, None),
        (5, LONG, "fr", "b", len(LONG), *rest),
        (6, f"before {PASSAGE} after", "en", "c", 1, *rest),
        (7, f"other {PASSAGE}\nend", "en", "c", 1, *rest),
        (8, "x", "en", "c", 1, *rest),
        (9, "日本語 テキスト 😀 word", "ja", "c", 1, *rest),
    ]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(awkward(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- language identification


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    train = docs.where("doc_id % 2 = 0")
    found = langid.identify(docs.where("doc_id % 2 = 1"), langid.fit(train)).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars > 100").collect()
    assert np.mean([r.predicted == r.lang for r in found]) > 0.95


def test_language_scores_equal_a_loop(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs, buckets=512)
    import pyarrow as pa

    texts = ["abc", "", None, "é", "12", "Straße 12, und: 日本!", "a" * 50, "--x"]
    score, grams = langid.score_texts(pa.array(texts), model)
    for i, t in enumerate(texts):
        low = re.sub(r"[^a-z\x80-\U0010ffff]+", " ", (t or "").lower()).removeprefix(" ")
        want, n = np.zeros(len(model.logp)), 0
        for order in model.orders:
            for at in range(len(low) - order + 1):
                raw = low[at : at + order].encode()
                buf, off = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
                bucket, _ = langid.buckets_of(*langid.char_codes(buf, off), order, 512)
                assert len(bucket) == 1
                want += model.logp[:, bucket[0]]
                n += 1
        assert grams[i] == n and np.allclose(score[i], want, atol=1e-3)


def test_language_rejects_what_is_none_and_keeps_what_is_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    rng = random.Random(4)
    noise = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxyz") for _ in range(7)) for _ in range(60))
    texts = [(1, noise), (2, "Это совсем другой язык, которого здесь нет"), (3, "1234 5678"), (4, "the and of that with 4024 0071 token=0af31c +1 (555) 000 x@y.org 10.1.2.3 the thing and")]
    found = {r.doc_id: r.accepted for r in langid.identify(spark.createDataFrame(texts, "doc_id bigint, text string"), model).collect()}
    assert found == {1: False, 2: False, 3: False, 4: True}
    assert langid.keep_identified(docs, model).count() == docs.count()


def test_language_awkward(odd, none):
    model = langid.fit(odd)
    found = langid.identify(odd, model).collect()
    assert len(found) == len(awkward())
    assert all(r.predicted is None and not r.accepted for r in found if r.doc_id in (2, 3))
    assert langid.keep_identified(odd, model).columns == odd.columns
    empty = langid.fit(none)
    assert langid.identify(none, empty).count() == 0
    assert {r.accepted for r in langid.identify(odd, empty).collect()} == {False}


# --- n-gram Jaccard join


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())


def brute_pairs(docs, n, threshold):
    sets = {}
    for i, t in docs:
        w = words(t)
        if w:
            sets[i] = frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1)))
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def test_jaccard_brute_force(spark):
    rng = random.Random(5)
    base = [[f"v{rng.randrange(60)}" for _ in range(rng.randrange(3, 60))] for _ in range(25)]
    docs = []
    for i in range(90):
        w = list(base[i % 25])
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(60)}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = brute_pairs(docs, 3, 0.5)
    found = {(r.doc_a, r.doc_b): r.jaccard for r in ngram_join.similar_pairs(df, 3, 0.5).collect()}
    # equal sets are listed with their representative only
    rep = {}
    for i, t in docs:
        w = words(t)
        rep.setdefault(frozenset(tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))), []).append(i)
    first = {i: group[0] for group in rep.values() for i in group}
    copies = {(first[i], i) for i in first if first[i] != i}
    assert set(found) == {(a, b) for a, b in want if first[a] == a and first[b] == b} | copies
    assert all(abs(found[p] - want[p]) < 1e-6 for p in found)


def brute_classes(docs, n, threshold):
    """(doc, class, links) by union of all pairs; documents without words are alone."""
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = dict.fromkeys(parent, 0)
    for a, b in brute_pairs(docs, n, threshold):
        links[a] += 1
        links[b] += 1
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return sorted(((i, root(i), links[i]) for i in parent), key=repr)


@pytest.mark.parametrize("strip", [4, 1024])
def test_jaccard_classes_brute_force(spark, monkeypatch, strip):
    """Blocks of one tile and of many, in fragments; chains, copies, and texts without words."""
    monkeypatch.setattr(ngram_join, "STRIP", strip)
    rng = random.Random(7)
    docs = []
    for i in range(150):
        w = [f"v{i % 12}x{j}" for j in range(rng.randrange(4, 40))]  # prefixes of one text: sizes differ, chains form
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(60)}"
        docs.append((i, " ".join(w)))
    docs += [(200 + i, docs[i][1]) for i in range(20)] + [(300, ""), (301, "one"), (302, " . "), (303, "one")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = brute_classes(docs, 3, 0.5)
    assert rows(ngram_join.similar_classes(df, 3, 0.5)) == want
    assert {r.doc_id for r in ngram_join.one_per_group(df, 3, 0.5).collect()} == {i for i, c, _ in want if i == c}
    pairs = {(a, b): x for (a, b), x in brute_pairs([d for d in docs if d[0] < 150], 3, 0.5).items() if x < 1}
    assert {(r.doc_a, r.doc_b) for r in ngram_join.similar_pairs(df, 3, 0.5).where("jaccard < 1").collect()} <= set(pairs)


def test_jaccard_fragments_sum_to_the_whole(spark, monkeypatch, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole, classes = rows(ngram_join.similar_pairs(docs)), rows(ngram_join.similar_classes(docs))
    monkeypatch.setattr(ngram_join, "FRAGMENT_ENTRIES", 50)
    monkeypatch.setattr(ngram_join, "STRIP", 2)
    assert rows(ngram_join.similar_pairs(docs)) == whole and whole
    assert rows(ngram_join.similar_classes(docs)) == classes


def test_jaccard_counts_in_fragments(spark, sf):
    """More than one fragment counts a part of the overlap of some pair, without any setting."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    vectors = ngram_join._vectors_of(docs, 5, 0.4, "text")
    tiles = ngram_join._tiles(vectors, vectors.select("node", F.lit(1).cast("bigint").alias("copies")), 0.4)
    assert tiles.select("label", "frag").distinct().groupBy("label").count().where("count > 1").count()


def chained_docs(n=40):
    """Threes of near copies, of which one shares an n-gram by chance with one of the next; and a family with links of its own."""
    docs = []
    for i in range(n):
        w = [f"p{i}w{j}" for j in range(30)]
        chance = [[f"chance{k}x{j}" for j in range(3)] for k in (i, i + 1)]
        docs += [(3 * i, " ".join([*chance[0], *w[3:27], *chance[1]])), (3 * i + 1, " ".join([*w[:-1], "end"])), (3 * i + 2, " ".join([*w[:-2], "the", "end"]))]
    base = [f"f{j}" for j in range(30)]
    return docs + [(1000 + i, " ".join(base[: 30 - i] + [f"g{i}y{j}" for j in range(i)])) for i in range(12)]


def test_jaccard_blocks_do_not_grow_over_others(spark, monkeypatch):
    """n-grams shared by chance chain all sets, but no block has more than a leader's neighbours; pairs count once."""
    docs = chained_docs()
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    vectors = ngram_join._vectors_of(df, 3, 0.4, "text")
    tiles = ngram_join._tiles(vectors, vectors.select("node", F.lit(1).cast("bigint").alias("copies")), 0.4).cache()
    assert max(r.n for r in tiles.groupBy("label").agg(F.countDistinct("node").alias("n")).collect()) <= 12
    assert tiles.where("size(earlier) > 0").count()
    assert rows(ngram_join.similar_classes(df, 3, 0.4)) == brute_classes(docs, 3, 0.4)
    pairs = ngram_join.similar_sets(df, 3, 0.4)
    assert pairs.count() == pairs.select("a", "b").distinct().count() == len(brute_pairs(docs, 3, 0.4))


def test_jaccard_lists_go_back_in_few_rows():
    """A range of the order sends one row per range of nodes, whatever the sets; the vectors are those of a plain count."""
    docs, parts = chained_docs(), 3
    batch = pa.record_batch([pa.array([t for _, t in docs])], names=["text_"])
    ranges = {}
    for out in ngram_join._blocks(3, parts)(iter([batch])):
        for part, row in zip(out.column(0).to_pylist(), out.to_pylist()):
            ranges.setdefault(part, []).append(row)
    back, sent = {}, []
    for held in ranges.values():
        rows_out = [r for out in ngram_join._shared_lists(parts)(iter([pa.RecordBatch.from_pylist(held)])) for r in out.to_pylist()]
        sent.append(len(rows_out))
        for r in rows_out:
            back.setdefault(r["part"], []).append(r)
    assert len(sent) == parts and max(sent) <= parts
    found = [r for held in back.values() for out in ngram_join._vectors(0.4)(iter([pa.RecordBatch.from_pylist(held)])) for r in out.to_pylist()]
    sets = [frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) for w in (words(t) for _, t in docs)]
    df = Counter(g for s in sets for g in s)
    want = [(len(s), n) for s in sets if (n := sum(df[g] > 1 for g in s)) >= 0.4 * len(s)]
    assert sorted((r["size"], sum(r["weights"])) for r in found) == sorted(want)
    assert all(set(r["prefix"]) <= set(r["lists"]) and r["prefix"] for r in found)


def test_jaccard_awkward(odd, none):
    found = {(r.doc_a, r.doc_b) for r in ngram_join.similar_pairs(odd).collect()}
    assert found == {(6, 7)}
    # one id with two texts is two rows; its text of other words is another document
    assert rows(ngram_join.similar_classes(odd)) == sorted([(i, 6 if i == 7 else i, int(i in (6, 7))) for i in (1, 1, 2, 3, 4, 5, 6, 7, 8, 9)], key=repr)
    kept = ngram_join.one_per_group(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 7").count() == 0
    assert kept.count() == len(awkward()) - 1
    assert ngram_join.similar_pairs(none).count() == 0
    assert ngram_join.similar_classes(none).count() == 0


# --- token counts


def test_pretokens_follow_the_pattern():
    rng = random.Random(1)
    alphabet = ["a", "b", "é", " ", "\n", "\t", "'", "'s", "'re", "'ll", "1", "²", "!", "ß", "　", "漢", "😀", "'d"]
    texts = ["", " ", "'s", " 's", " x"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    raw = [t.encode() for t in texts]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    _, at, first, stop = tokencount.hashed(buf, off)
    pattern = regex.compile(tokencount.PATTERN)
    for i, t in enumerate(texts):
        assert [buf[first[j] : stop[j]].tobytes().decode() for j in range(at[i], at[i + 1])] == pattern.findall(t)


@pytest.mark.parametrize("entries", [1 << 20, 40, 0])
def test_token_counts_brute_force(odd, entries):
    encode = tokencount.load_encoding(tokencount.VOCABULARY).encode_ordinary
    want = sorted(({(r[0], r[1]) for r in awkward()}), key=repr)
    want = sorted(((i, len(encode(t or ""))) for i, t in want), key=repr)
    assert rows(tokencount.token_counts(odd, broadcast_entries=entries)) == want


def test_token_counts_empty(none):
    assert tokencount.token_counts(none).count() == 0


# --- best-fit packing


def brute_pack(sizes, capacity, most):
    bins, open_, out = 0, {}, []  # bin -> free
    last = {}
    for clock, size in enumerate(sizes):
        start = 0
        while start < size:
            n = min(capacity, size - start)
            fits = [(f, -last[b], b) for b, f in open_.items() if f >= n]
            if fits:
                b = min(fits)[2]
            else:
                if len(open_) == most:
                    open_.pop(min((f, -last[b], b) for b, f in open_.items())[2])
                b, open_[bins] = bins, capacity
                bins += 1
            out.append((clock, start, n, b, capacity - open_[b]))
            open_[b] -= n
            last[b] = len(out)
            if not open_[b]:
                del open_[b]
            start += n
    return out


@pytest.mark.parametrize("most", [1, 3, 8])
def test_packing_brute_force(most):
    rng = random.Random(most)
    sizes = [rng.randrange(1, 90) for _ in range(800)]
    assert packing.pack_sizes(sizes, 40, most) == brute_pack(sizes, 40, most)


def test_packing_places_every_token_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    placed = packing.pack(docs, capacity=100, open_bins=4, shard_tokens=5000, vocabulary=None)
    total = docs.select(F.sum(F.size(F.expr(r"filter(split(text, '[ \\t\\n\\f\\r\\x0B]+'), w -> w <> '')")))).first()[0]
    found = placed.toPandas()
    assert found.n_tokens.sum() == total and found.shard.nunique() > 1
    bins = found.sort_values(["shard", "bin", "offset"]).groupby(["shard", "bin"])
    assert (bins.n_tokens.sum() <= 100).all()
    assert (bins.n_tokens.cumsum() - found.n_tokens == found.offset).all()


def test_packing_counts_tokens(spark, sf):
    """Every token of the tokenizer once, and no bin over its capacity; one shard equals the brute-force packer."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    encode = tokencount.load_encoding(tokencount.VOCABULARY).encode_ordinary
    sizes = {r.doc_id: len(encode(r.text or "")) for r in docs.collect()}
    some = [(i, n) for i, n in sorted(sizes.items()) if n]
    want = [(0, b, o, some[i][0], start, n) for i, start, n, b, o in brute_pack([n for _, n in some], packing.CAPACITY, packing.OPEN_BINS)]
    assert rows(packing.pack(docs)) == sorted(want, key=repr)


def test_row_counts_keep_repeated_rows_apart(odd):
    encode = tokencount.load_encoding(tokencount.VOCABULARY).encode_ordinary
    for entries in (1 << 20, 0):
        found = tokencount.row_counts(odd.select("doc_id", "text", F.length("text").alias("long")), broadcast_entries=entries)
        assert found.columns == ["doc_id", "long", "n_tokens"]
        assert sorted(r.n_tokens for r in found.collect()) == sorted(len(encode(r[1] or "")) for r in awkward())


def test_packing_awkward(odd, none):
    found = packing.pack(odd).collect()
    assert {r.doc_id for r in found} == {1, None, 4, 5, 6, 7, 8, 9}  # white space is tokens too
    assert packing.pack(none).count() == 0


def test_packing_in_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, "w " * (1 + i * i % 97), "ab"[i % 8 == 0]) for i in range(900)], "doc_id bigint, text string, source string")
    schedule = {"a": [(0.0, 3.0), (1.0, 1.0)], "b": [(0.0, 0.0), (1.0, 4.0)]}
    arrived = [(r.doc_id, r.n_tokens) for r in mixing.positions(docs, schedule, vocabulary=None).collect()]
    assert len({d for d, _ in arrived}) < len(arrived)
    mixing.mix(docs, schedule, vocabulary=None).write.parquet(str(tmp_path / "mixed"))
    written = spark.read.parquet(str(tmp_path / "mixed"))
    want, shards, sum_ = [], {}, 0
    for d, n in arrived:
        shards.setdefault(sum_ // 5000, []).append((d, n))
        sum_ += n
    for shard, rows_ in shards.items():
        want += [(shard, b, o, rows_[i][0], s, n) for i, s, n, b, o in packing.pack_sizes([n for _, n in rows_], 100, 4)]
    assert len(shards) > 3
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # splits are read largest first
    try:
        for mixed in (written, mixing.mix(docs, schedule, vocabulary=None)):
            assert rows(packing.pack(mixed, 100, 4, 5000, in_order=True, vocabulary=None)) == sorted(want, key=repr)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


# --- WARC


@pytest.mark.parametrize("kind", ["gzip", "zstd"])
def test_warc_round_trip_and_revisits(spark, tmp_path, kind):
    page = [(1, "http://a/1", "<p>one"), (2, "http://a/2", "<p>two"), (3, "http://b/3", "<p>one"), (3, "http://b/3", "<p>one"), (4, "http://b/4", ""), (5, None, "x"), (6, "http://c", None), (None, "http://d\r\nX: y", "<p>é")]
    records = warc.captures(spark.createDataFrame(page, "page_id bigint, url string, html string"))
    lone = records.limit(1).select(*(F.lit(v).alias(c) for c, v in dict(record_id="<urn:x>", warc_type="revisit", target_uri="http://z", date="2024-01-09T00:00:00Z", digest="sha1:none").items()), *(F.lit(None).cast("string").alias(c) for c in ("refers_to", "refers_to_uri", "refers_to_date")), F.lit(None).cast("binary").alias("payload"))
    records = records.union(lone)
    warc.write(records, str(tmp_path / "in"), kind, warc.train(records) if kind == "zstd" else None)
    found = warc.deduplicate(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()
    assert len(found) == 5 * 3 + 1
    kept = [r for r in found if r.warc_type == "response"]
    assert len(kept) == 4 and len({r.digest for r in kept}) == 4
    assert [r.record_id for r in found if not r.resolved] == ["<urn:x>"]
    originals = {r.record_id: r for r in kept}
    for r in found:
        if r.warc_type == "revisit" and r.resolved:
            assert originals[r.refers_to].digest == r.digest and originals[r.refers_to].date == r.refers_to_date
    again = warc.headers(spark, str(tmp_path / "out")).collect()
    place = lambda rs: {(r.file, r.offset, r.length, r.record_id, r.warc_type, r.refers_to) for r in rs}
    assert place(again) == place(found)
    for r in kept:
        with open(r.file, "rb") as f:
            codec, _ = warc.Codec.of(f)
            f.seek(r.offset)
            h, block = warc.decode(codec.unpack(f.read(r.length)))
        payload = warc.payload_of(h, block)
        assert warc.digest_of(payload) == h["warc-payload-digest"] and warc.digest_of(block) == h["warc-block-digest"] and len(block) == int(h["content-length"])


def archived(path, *records):
    """An archive of records as another crawler writes them: header lines and a block each."""
    codec = warc.Codec("gzip")
    path.parent.mkdir(exist_ok=True)
    raws = ["\r\n".join(["WARC/1.0", *lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n" for lines, block in records]
    path.write_bytes(b"".join(map(codec.pack, raws)))
    return raws


def unarchived(found):
    out = []
    for r in found:
        with open(r.file, "rb") as f:
            f.seek(r.offset)
            out.append(warc.Codec("gzip").unpack(f.read(r.length)))
    return out


def test_warc_keeps_what_archives_hold(spark, tmp_path):
    http = b"HTTP/1.1 404 Not Found\r\nContent-Type: image/png\r\nContent-Encoding: gzip\r\nX-A: 1\r\n\r\n"
    web = "Content-Type: application/http; msgtype=response"
    head = lambda i, kind, *more: [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{i}>", f"WARC-Date: 2024-01-0{i}T00:00:00Z", f"WARC-Target-URI: http://a/{i}", *more]
    digest = f"WARC-Payload-Digest: {warc.digest_of(b'body')}"
    raws = archived(
        tmp_path / "in" / "a.warc.gz",
        (head(1, "warcinfo", "Content-Type: application/warc-fields"), b"software: x\r\n"),
        (head(2, "response", digest, web, "WARC-IP-Address: 10.0.0.1", "WARC-Concurrent-To: <urn:8>", "WARC-Concurrent-To: <urn:9>"), http + b"body"),
        (head(3, "response", web, "WARC-IP-Address: 10.0.0.2"), http + b"body"),
        (head(4, "revisit", "WARC-Payload-Digest: sha1:NONE", "WARC-Profile: http://x/server-not-modified", web), http),
        (head(5, "request", "Content-Type: application/http; msgtype=request"), b"GET / HTTP/1.1\r\n\r\n"),
    )
    found = sorted(warc.deduplicate(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect(), key=lambda r: r.offset)
    new = unarchived(found)
    assert [new[i] for i in (0, 1, 3, 4)] == [raws[i] for i in (0, 1, 3, 4)]
    h, block = warc.decode(new[2])
    assert block == http and h["warc-ip-address"] == "10.0.0.2" and h["content-type"] == web[14:] and int(h["content-length"]) == len(http)
    assert h["warc-type"] == "revisit" and h["warc-refers-to"] == "<urn:2>" and h["warc-block-digest"] == warc.digest_of(http) and h["warc-payload-digest"] == digest[21:]


def test_warc_records_without_ids_stay(spark, tmp_path):
    bare = lambda i: (["WARC-Type: response", f"WARC-Date: 2024-01-0{i}T00:00:00Z"], b"HTTP/1.1 200 OK\r\n\r\nbody%d" % i)
    named = [([*bare(i)[0], "WARC-Record-ID: <urn:a>"], bare(i)[1]) for i in (4, 5)]
    archived(tmp_path / "in" / "a.warc.gz", *map(bare, (1, 2, 3)), *named)
    found = warc.deduplicate(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()
    assert sorted((r.date[9:10], r.record_id, r.warc_type) for r in found) == [(str(i), "<urn:a>" if i == 4 else None, "response") for i in (1, 2, 3, 4)]


def test_warc_digests_are_verified():
    import base64
    import hashlib

    sha, body = hashlib.sha1(b"body").digest(), b"4\r\nbody\r\n0\r\n\r\n"
    want = "sha1:" + sha.hex()
    for claim in (want, want.upper(), "sha1:" + base64.b32encode(sha).decode(), "SHA-1:" + base64.b32encode(sha).decode().lower(), None, "sha1:" + "0" * 40, "sha9:x", ""):
        assert warc.verified(claim, b"HTTP/1.1 200 OK\r\n\r\nbody", b"body") == want
    assert warc.verified(want, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + body, body) == want
    assert warc.verified("md5:" + hashlib.md5(b"body").hexdigest(), b"body", b"body").startswith("md5:")
    assert warc.dechunked(b"zz\r\n") is None and warc.dechunked(b"5\r\nbod") is None and warc.spelled(None) is None


def test_warc_claims_cost_no_payload(spark, tmp_path):
    """Two payloads under one claimed digest both stay; one payload under two spellings meets."""
    import base64
    import hashlib

    body = b"HTTP/1.1 200 OK\r\n\r\n"
    head = lambda i, digest: [f"WARC-Type: response", f"WARC-Record-ID: <urn:{i}>", f"WARC-Date: 2024-01-0{i}T00:00:00Z", f"WARC-Payload-Digest: {digest}"]  # noqa: E731, F541
    b32 = "sha1:" + base64.b32encode(hashlib.sha1(b"one").digest()).decode()
    archived(tmp_path / "in" / "a.warc.gz", (head(1, warc.digest_of(b"one")), body + b"one"), (head(2, warc.digest_of(b"one")), body + b"two"), (head(3, b32), body + b"one"))
    found = {r.record_id[5]: r for r in warc.deduplicate(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()}
    assert {k: r.warc_type for k, r in found.items()} == {"1": "response", "2": "response", "3": "revisit"} and found["3"].refers_to == "<urn:1>"


@pytest.mark.parametrize("kind", ["plain", "gzip", "zstd", "one member"])
def test_warc_damaged_files_keep_all_bytes(spark, tmp_path, kind):
    codec = warc.Codec("gzip" if kind == "one member" else kind)
    raws = [warc.encode({"record_id": f"<urn:{i}>", "warc_type": "response", "date": f"2024-01-0{i + 1}T00:00:00Z"}, b"body%d" % (i % 3) * 50) for i in range(5)]
    packed = [codec.pack(r) for r in raws] if kind != "one member" else [codec.pack(b"".join(raws))]
    (tmp_path / "in").mkdir()
    name = f"a{codec.suffix}"
    (tmp_path / "in" / name).write_bytes(b"".join(packed) + (b"" if kind == "one member" else packed[0][:-9]))
    found = warc.deduplicate(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()
    kinds = sorted((r.record_id or "", r.warc_type, r.payload_bytes) for r in found)
    tail = [] if kind == "one member" else [("", "damaged", len(packed[0]) - 9)]
    assert kinds == tail + [("<urn:0>", "response", 250), ("<urn:1>", "response", 250), ("<urn:2>", "response", 250), ("<urn:3>", "revisit", 0), ("<urn:4>", "revisit", 0)]
    if tail:
        whole = next(p for p in (tmp_path / "out").iterdir()).read_bytes()
        assert whole.endswith(packed[0][:-9])
    again = warc.deduplicate(spark, str(tmp_path / "out"), str(tmp_path / "out2")).collect()
    assert sorted((r.record_id or "", r.warc_type, r.payload_bytes) for r in again) == kinds


def test_warc_long_payloads_and_clashing_columns(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", ("x%d " % (i % 2)) * 400000, "p", "d", "v") for i in range(3)], "page_id bigint, url string, html string, payload string, digest string, visit string")
    records = warc.captures(pages)
    warc.write(records, str(tmp_path / "in"), dictionary=warc.train(records))
    found = warc.deduplicate(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()
    assert len(found) == 9 and sorted(r.payload_bytes for r in found if r.payload_bytes) == [1200000, 1200000]


def test_warc_empty(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    warc.write(warc.captures(empty), str(tmp_path / "in"))
    assert warc.deduplicate(spark, str(tmp_path / "in"), str(tmp_path / "out")).count() == 0


# --- HTML extraction


def test_parser_repairs():
    tree = htmltree.parse('<ul><li>a<li>b</ul><p>c<p>d<b>e<div class="x y" id=z>f</div><!-- g --><script>var t="</p>";</script><br>h &amp; i')
    own = {}
    for e, t in tree.texts:
        own.setdefault(tree.tags[e], []).append(t)
    assert own["li"] == ["a", "b"] and own["p"] == ["c", "d"] and own["div"] == ["f"]
    assert ("x", "y", "z") in tree.tokens and any("h & i" in t for _, t in tree.texts)
    assert all(p < i for i, p in enumerate(tree.parents))


@pytest.mark.parametrize(
    "source, said",
    [
        ('<p>a<svg width="1"/>b<math/>c<svg><svg/>no<svg>no</svg>no</svg>d', "abcd"),
        ("<p>a<noscript>b<template>c<iframe src=x/>d<svg>e", "abcde"),
        ("<p>a<iframe/>b<iframe>no</iframe>c", "abc"),
        ("<p>a<template>no<template>no</template>no</template>b<svg href=http://x/>no</svg>c", "abc"),
        ("<p>a<template>no<script>'</template>'</script>no<!-- </template> -->no</template>b<script>no", "ab"),
    ],
)
def test_parser_reads_past_raw_tags(source, said):
    assert "".join(t for _, t in htmltree.parse(source).texts) == said


@pytest.mark.parametrize("piece", ["<h1>", "<!", "<b>", '<a "', "</b>", "<p>", "<svg>"])
def test_parser_is_linear(piece):
    import time

    html = piece * ((1 << 20) // len(piece))
    began = time.process_time()
    htmltree.parse(html)
    assert time.process_time() - began < 12  # quadratic would be hours
    half = htmltree.parse(html[: len(html) // 2])
    assert len(half.tags) <= len(html)


def brute_features(tree):
    """The dense features, node by node and by recursion."""
    kids = [[j for j, p in enumerate(tree.parents) if p == i] for i in range(len(tree.tags))]
    own = [[t for e, t in tree.texts if e == i] for i in range(len(tree.tags))]

    def below(i):
        return [i] + [x for k in kids[i] for x in below(k)]

    def linked(i):
        return tree.tags[i] == "a" or (tree.parents[i] >= 0 and linked(tree.parents[i]))

    def chars(i):
        return sum(len(t) for j in below(i) for t in own[j])

    out = []
    for i, parent in enumerate(tree.parents):
        sub = below(i)
        texts = [t for j in sub for t in own[j]]
        n, c = len(sub), chars(i)
        links, link_chars = sum(tree.tags[j] == "a" for j in sub), sum(len(t) for j in sub if linked(j) for t in own[j])
        words, stops = sum(t.count(" ") + 1 for t in texts), sum(t.count(".") + t.count(",") for t in texts)
        caps, self_chars = sum(t[:1].isupper() for t in texts), sum(map(len, own[i]))
        family = kids[parent] if parent >= 0 else [i]
        among, place, up = sum(map(chars, family)), family.index(i), chars(parent) if parent >= 0 else c
        per = lambda a, b: a / max(b, 1)
        out.append([
            np.log1p(c), np.log1p(self_chars), np.log1p(n), per(c, n), per(link_chars, c), per(links, n), per(words, n), per(c, words), per(stops, words), per(caps, n),
            tree.depths[i], len(kids[i]), place, per(place, len(family) - 1), len(family), per(c, among), per(among, len(family)), per(c, up), per(self_chars, c),
        ])
    return np.array(out)


def test_extraction_brute_force(spark, sf):
    """Features, labels and the decoded text of whole pages against node-by-node versions."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    forest = extraction.fit(pages)
    sources = [r.html for r in pages.orderBy("page_id").limit(12).collect()] + ["<p>a<a>b</a><div>c", "plain"]
    found = {r.page_id: r for r in extraction.extract(spark.createDataFrame(list(enumerate(sources)), "page_id bigint, html string"), forest).collect()}
    for i, source in enumerate(sources):
        tree = htmltree.parse(source)
        nodes = extraction.Nodes([tree])
        features = nodes.features()
        want = brute_features(tree)
        assert np.allclose(features[:, : want.shape[1]], want)
        inside = [any(tree.tags[j] in ("article", "main") for j in ancestors(tree, k)) for k in range(len(tree.tags))]
        assert nodes.labels().tolist() == inside
        logit = forest.logit(features)

        def best(k):
            """(value of choosing k and all below, best value, chosen nodes)"""
            kids = [j for j, p in enumerate(tree.parents) if p == k]
            parts = [best(j) for j in kids]
            whole, rest = logit[k] + sum(p[0] for p in parts), sum(p[1] for p in parts)
            every = {k}.union(*(p[3] for p in parts))
            return (whole, whole, every, every) if whole > rest + 1e-12 else (whole, rest, set().union(*(p[2] for p in parts)), every)

        chosen = set().union(*(best(k)[2] for k, p in enumerate(tree.parents) if p < 0))
        assert found[i].n_nodes == len(tree.tags) and found[i].n_kept == len(chosen)
        said = "".join(t for e, t in tree.texts if e in chosen)
        assert "".join(found[i].text.split()) == "".join(said.split())


def ancestors(tree, i):
    while i >= 0:
        yield i
        i = tree.parents[i]


def test_extraction_held_out_accuracy(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    forest = extraction.fit(pages.where("page_id % 2 = 0"))
    held = [r.html for r in pages.where("page_id % 2 = 1").collect()]
    hidden = [re.sub(r"(</?)article", r"\1div", h) for h in held]
    for source in (held, hidden):
        nodes = extraction.Nodes([htmltree.parse(h) for h in source])
        truth = extraction.Nodes([htmltree.parse(h) for h in held]).labels()
        assert (nodes.decode(forest.logit(nodes.features())) == truth).mean() > 0.98
    text = extraction.extract(pages, forest).join(pages, "page_id").first()
    assert text.text and "track(" not in text.text


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = 9
        tree = htmltree.Tree()
        for i in range(n):
            p = int(rng.integers(-1, i)) if i else -1
            tree.tags.append("div"), tree.parents.append(p), tree.tokens.append(()), tree.depths.append(0 if p < 0 else tree.depths[p] + 1)
        nodes, logit = extraction.Nodes([tree]), rng.normal(size=n)
        got = nodes.decode(logit)
        best = max(
            sum(logit[i] for i in range(n) if m >> i & 1)
            for m in range(1 << n)
            if all(m >> i & 1 or tree.parents[i] < 0 or not m >> tree.parents[i] & 1 for i in range(n))
        )
        assert abs(logit[got].sum() - best) < 1e-9
        assert all(got[i] or tree.parents[i] < 0 or not got[tree.parents[i]] for i in range(n))


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = boosting.fit(x[:2000], y[:2000])
    assert ((forest.logit(x[2000:]) > 0) == y[2000:]).mean() > 0.95


def test_extraction_awkward(spark):
    deep = "<div>" * 3000 + "deep"
    data = [(1, None), (2, ""), (None, "no tags"), (3, deep), (3, deep), (4, "<p>" + "word " * 100000), (5, "<div <p a='>'>x</q></b></div"), (6, "<article><p>t</p></article>")]
    pages = spark.createDataFrame(data, "page_id bigint, html string").withColumn("text", F.lit(1)).withColumn("html_", F.lit(2))
    found = extraction.extract(pages, extraction.fit(pages)).collect()
    assert len(found) == len(data)
    assert {(r.text, r.n_nodes) for r in found if r.page_id in (1, 2)} == {("", 0)}
    unmarked = pages.where("page_id <> 6")
    assert {r.n_kept for r in extraction.extract(unmarked, extraction.fit(unmarked)).collect()} == {0}
    none = pages.limit(0)
    assert extraction.extract(none, extraction.fit(none)).count() == 0


# --- searches over vectors


def vectors(n=400, dim=8, seed=2):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(6, dim)) * 4)[rng.integers(0, 6, n)] + rng.normal(size=(n, dim))
    x[10:20] = x[0]  # ties
    return [(i, [float(v) for v in row.astype(np.float32)]) for i, row in enumerate(x)]


def brute_near(data, k, asks=lambda i: True):
    """The k nearest other ids, each at its nearest vector, of the ids that ask."""
    ids, x = np.array([i for i, _ in data]), np.array([v for _, v in data])
    out = set()
    for i in sorted({int(i) for i in ids if asks(i)}):
        near = {}
        for j in np.flatnonzero(ids == i):
            for n, d in zip(ids.tolist(), np.square(x - x[j]).sum(1).tolist()):
                if n != i:
                    near[n] = min(d, near.get(n, np.inf))
        out |= {(i, n, r + 1) for r, (_, n) in enumerate(sorted((d, n) for n, d in near.items())[:k])}
    return out


def search_rows(df):
    return {(r.query_id, r.neighbor_id, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("cell_rows", [30, 10000])
def test_dual_tree_is_exact(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(covertree, "LEAF", 16)
    data = vectors()
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    assert search_rows(covertree.top_k(df, 5, cell_rows=cell_rows)) == brute_near(data, 5)
    asked = covertree.top_k(df, 5, F.col("vec_id") % 20 == 0, cell_rows=cell_rows)
    assert search_rows(asked) == brute_near(data, 5, lambda i: i % 20 == 0)


def test_dual_tree_with_a_hot_vector(spark, monkeypatch):
    """A third of the rows are one vector: the smallest ids are the neighbours, and all ids that ask get theirs, in several groups."""
    monkeypatch.setattr(covertree, "LEAF", 16)
    monkeypatch.setattr(covertree, "GROUP_ROWS", 8)
    data = vectors(300, 4)
    data = [(i, data[0][1] if i % 3 == 0 else v) for i, v in data]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    assert search_rows(covertree.top_k(df, 5, cell_rows=20)) == brute_near(data, 5)


def test_k_means_tree_with_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(kmeanstree, "SALT_ROWS", 16)
    monkeypatch.setattr(kmeanstree, "GROUP_ROWS", 8)
    data = vectors(300, 4)
    data = [(i, data[0][1] if i % 3 == 0 else v) for i, v in data]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    got, want = search_rows(kmeanstree.neighbors(df, 5, leaf_rows=20)), brute_near(data, 5)
    assert {q for q, *_ in got} == {q for q, *_ in want} and len({x[:2] for x in got} & {x[:2] for x in want}) >= 0.9 * len(want)
    assert {x for x in got if x[0] % 3 == 0} == {x for x in want if x[0] % 3 == 0}


def counted(tree, x, k):
    seen = []

    class Counting(covertree.vs.Best):
        def offer(self, rows, ids, vecs):
            seen.append(len(rows) * len(ids))
            super().offer(rows, ids, vecs)

    covertree.search(tree, tree, Counting(np.arange(len(x)), x, k), np.arange(len(x)), x)
    return sum(seen)


def depth(node):
    return 1 + max((depth(c) for c in node.children), default=0)


def test_dual_tree_prunes(monkeypatch):
    monkeypatch.setattr(covertree, "LEAF", 32)
    x = np.array([v for _, v in vectors(2000, 3)])
    tree = covertree.build(x)

    def check(node):
        assert np.sqrt(np.square(x[node.rows] - node.center).sum(1)).max() <= node.radius + 1e-9
        for c in node.children:
            check(c)
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
            centers = np.array([c.center for c in node.children])
            apart = np.sqrt(np.square(centers[:, None] - centers[None]).sum(2))[np.triu_indices(len(centers), 1)]
            nearest = np.sqrt(np.square(x[node.rows][:, None] - centers[None]).sum(2)).min(1)
            assert apart.min() >= nearest.max() - 1e-9  # a net
        else:
            assert len(node.rows) <= 32 or node.radius == 0

    check(tree)
    assert counted(tree, x, 5) < 0.5 * len(x) ** 2


def test_dual_tree_on_the_embeddings(spark, sf):
    """The tree of real vectors has inner levels; how much it prunes is up to them."""
    table = spark.read.parquet(sf.replace("sf0.001", "sf0.1") + "/embeddings.parquet").toPandas()
    x = np.array(table.embedding.to_list(), np.float64)
    tree = covertree.build(x)
    assert depth(tree) > 2 and len(tree.children) > 1
    pruned = 1 - counted(tree, x, 10) / len(x) ** 2
    print(f"pruned {pruned:.3f} of all pairs, depth {depth(tree)}")
    assert 0 <= pruned < 1


def test_upper_levels_prune(spark):
    """Pairs of nodes of the upper levels end where the covering radii say so; no neighbour is behind them."""
    x = np.concatenate([np.random.default_rng(i).normal(size=(300, 3)) + 40 * i for i in range(8)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<float>")
    tree = covertree.upper(df, 3, len(x), 40)
    cell = tree.cells(x)
    radius = np.array([np.sqrt(np.square(x[cell == c] - tree.centers[tree.leaves[c]]).sum(1)).max() if (cell == c).any() else -np.inf for c in range(len(tree.leaves))])
    bound = np.full(len(tree.leaves), 4.0)
    for mine in (np.array([0]), np.arange(3)):
        left, far, looked = tree.unpruned(radius, bound, mine)
        centers = tree.centers[tree.leaves]
        gap = np.sqrt(np.square(centers[mine][:, None] - centers[None]).sum(2)) - radius[mine][:, None] - radius[None]
        assert set(left) == {int(c) for c in np.flatnonzero(((gap <= 4.0) & np.isfinite(radius)).any(0))}
        assert len(left) < len(tree.leaves) / 2 and looked < len(tree.children) ** 2 / 4


@pytest.mark.parametrize("leaf_rows", [16, 64])
def test_k_means_tree_recall(spark, leaf_rows):
    data = vectors(900, 16)
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    found = kmeanstree.neighbors(df, 5, leaf_rows=leaf_rows)
    want = {(q, n) for q, n, _ in brute_near(data, 5)}
    got = {(r.query_id, r.neighbor_id) for r in found.collect()}
    assert len(got & want) / len(want) >= 0.9
    asked = {(r.query_id, r.neighbor_id) for r in kmeanstree.neighbors(df, 5, F.col("vec_id") % 20 == 0, leaf_rows=leaf_rows).collect()}
    want = {(q, n) for q, n in want if q % 20 == 0}
    assert {q for q, _ in asked} == {q for q, _ in want} and len(asked & want) / len(want) >= 0.9


def test_k_means_tree_recall_of_the_query(spark, sf):
    from corpusmill.llm import queries

    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    want = {(q, n) for q, n, _ in brute_near(list(zip(table.vec_id, table.embedding)), 10, lambda i: i % 20 == 0)}
    got = {(r.query_id, r.neighbor_id) for r in queries.op8_approximate_neighbors(spark, sf).collect()}
    assert len(got & want) / len(want) >= 0.9 and len(got) == len(want)


def test_best_bin_first_is_the_order_of_the_queue(spark):
    data = vectors(900, 6)
    df = spark.createDataFrame(data, "id bigint, vec array<float>")
    tree = kmeanstree.grow(df, 6, len(data), 4, 10, 4)
    assert max(len(c) for c in tree.children) <= 4 and len(tree.leaves) > 40
    x = np.array([v for _, v in data[:50]])
    for row, order in zip(x, tree.visits(x, len(tree.leaves))):
        assert tree.queued(row) == order.tolist()


@pytest.mark.parametrize("search", [covertree.top_k, kmeanstree.neighbors])
def test_vectors_awkward(spark, search):
    data = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.5]), (None, [0.0, 0.0]), (3, None), (4, []), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [9.0, 9.0])]
    df = spark.createDataFrame([(*r, 1, 2, "q", 0) for r in data], "vec_id bigint, embedding array<float>, id int, cell int, asks string, leaf int")
    assert search_rows(search(df, 1)) == {(1, 2, 1), (2, 1, 1), (8, 2, 1)}
    assert search_rows(search(df, 5)) == {(1, 2, 1), (1, 8, 2), (2, 1, 1), (2, 8, 2), (8, 2, 1), (8, 1, 2)}
    assert search(df.limit(0)).count() == 0
    assert search(df.where("vec_id = 8")).count() == 0
    assert search(df, 2, F.col("vec_id") > 100).count() == 0
    # one id with several vectors counts once, at its nearest, and asks with all
    data = [(1, [0.0, 0.0]), (7, [1.0, 0.0]), (7, [0.0, 1.0]), (9, [2.0, 0.0]), (10, [50.0, 50.0])]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    assert search_rows(search(df, 2)) == brute_near(data, 2)
    assert {(1, 7, 1), (1, 9, 2)} <= search_rows(search(df, 2))


# --- substring dedup


@pytest.mark.parametrize("period", substring.COVERS)
def test_covers_hold_every_difference(period):
    cover = substring.COVERS[period]
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def brute_spans(docs, length):
    seen, first, later = {}, {}, {}
    order = sorted({(i, t) for i, t in docs}, key=lambda d: (d[0] is None, d[0] or 0, d[1]))
    for d in order:
        w = re.split(r"[ \t\n\v\f\r]+", d[1].strip(" \t\n\v\f\r"))
        for p in range(len(w) - length + 1):
            seen.setdefault(tuple(w[p : p + length]), []).append((d, p))
    for places in seen.values():
        if len(places) > 1:
            first.setdefault(places[0][0], set()).add(places[0][1])
            for d, p in places[1:]:
                later.setdefault(d, set()).add(p)
    out = []
    for original, marks in ((True, first), (False, later)):
        for d, starts in marks.items():
            run = None
            for p in sorted(starts):
                if run and p <= run[1]:
                    run[1] = p + length
                else:
                    if run:
                        out.append((d[0], *run, original))
                    run = [p, p + length]
            out.append((d[0], *run, original))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length", [3, 10, 50])
def test_substring_brute_force(spark, length):
    rng = random.Random(length)
    passages = [[f"p{k}w{i}" for i in range(rng.randrange(length - 2, 2 * length + 3))] for k in range(8)]
    docs = []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 80))]
            w += rng.choice(passages)[rng.randrange(0, 4) :]
        docs.append((i, " ".join(w)))
    docs += [(100, " ".join(["a"] * 3 * length)), (101, docs[0][1])]
    found = substring.repeated_spans(spark.createDataFrame(docs, "doc_id bigint, text string"), length)
    assert rows(found) == brute_spans(docs, length)


def test_substring_awkward(odd, none):
    assert rows(substring.repeated_spans(odd)) == [(6, 1, 61, True), (7, 1, 61, False)]
    kept = substring.remove_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == len(awkward())
    by_id = {r.doc_id: r for r in kept.collect()}
    assert by_id[6].text == f"before {PASSAGE} after" and by_id[7].text == "other end" and by_id[7].n_chars == 9
    assert substring.repeated_spans(none).count() == 0 and substring.remove_repeats(none).count() == 0


def words_left(kept, length):
    """The documents' words; fails if ``length`` words in a row stand twice."""
    found = {r.doc_id: r.text.split() for r in kept.collect()}
    windows = [tuple(w[i : i + length]) for w in found.values() for i in range(len(w) - length + 1)]
    assert len(windows) == len(set(windows))
    return found


def test_substring_leaves_no_window_twice(spark):
    docs = [(1, PASSAGE), (2, f"x {PASSAGE} y"), (3, f"x {PASSAGE}"), (4, f"{PASSAGE} y")]
    assert words_left(substring.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string")), 50) == {1: PASSAGE.split(), 2: ["x", "y"]}
    # words that come together when a passage goes make windows that repeat; a text that repeats in itself keeps its first place
    left, right = (" ".join(f"{k}{i}" for i in range(30)) for k in "lr")
    other = PASSAGE.replace("shared", "other")
    docs = [(1, PASSAGE), (2, other), (3, f"{left} {PASSAGE} {right}"), (4, f"{left} {other} {right}"), (5, "a " * 120)]
    found = words_left(substring.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string")), 50)
    assert found == {1: PASSAGE.split(), 2: other.split(), 3: f"{left} {right}".split(), 5: ["a"] * 50}


@pytest.mark.parametrize("length", [3, 10])
def test_substring_recount(spark, length):
    rng = random.Random(length)
    docs = [(i, " ".join(str(rng.randrange(4)) for _ in range(rng.randrange(0, 40)))) for i in range(60)]
    found = words_left(substring.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string"), length), length)
    for i, w in found.items():
        rest = iter(docs[i][1].split())
        assert all(x in rest for x in w)


# --- mixing


def test_mixing_follows_the_schedule(spark):
    docs = [(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    schedule = {"a": [(0.0, 3.0), (0.5, 1.0), (1.0, 1.0)], "b": [(0.0, 1.0), (1.0, 1.0)], "c": [(0.0, 0.0), (1.0, 4.0)]}
    found = mixing.positions(df, schedule, vocabulary=None).toPandas()
    total = sum(len(t.split()) for _, t, _ in docs)
    want = mixing.demands(schedule)
    for s in "abc":
        own = found[found.source == s].sort_values("position")
        spent = own.n_tokens.cumsum() - own.n_tokens
        t = own.position.to_numpy()
        exact = []
        for x in t:
            grid = np.linspace(0, x, 400)
            exact.append(np.trapezoid(np.interp(grid, want[s].times, want[s].weights), grid) * total)
        assert np.abs(spent.to_numpy() - np.array(exact)).max() < 0.01 * total
        again = own.groupby("doc_id").epoch.apply(lambda e: sorted(e) == list(range(len(e))))
        assert again.all()
    order = mixing.positions(df, schedule, vocabulary=None).select("position").collect()
    assert [r[0] for r in order] == sorted(r[0] for r in order)


def test_mixing_awkward_schedules(spark):
    df = spark.createDataFrame([(i, "w " * 5, "abc"[i % 3]) for i in range(90)], "doc_id bigint, text string, source string")
    found = mixing.positions(df, {"a": [(0.0, 1.0)], "b": [(0.0, 1.0)]}).collect()
    assert {r.source for r in found} == {"a", "b"}  # what the schedule leaves out is not placed
    with pytest.raises(ValueError):
        mixing.positions(df, budget=0)


def test_mixing_repeated_rows(spark):
    """Rows that are alike are each placed, as often as one another give or take one epoch."""
    df = spark.createDataFrame([(1, "a b", "x")] * 3 + [(2, "a b", "x")] * 2, "doc_id bigint, text string, source string")
    mixed = mixing.mix(df, {"x": [(0.0, 1.0)]}, vocabulary=None)
    assert sorted(r.doc_id for r in mixed.collect()) == [1, 1, 1, 2, 2]


def test_mixing_keeps_rows_whole(odd, none):
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    have = {repr(tuple(r)) for r in odd.collect()}
    assert {repr(tuple(r)) for r in mixed.collect()} <= have
    assert mixing.mix(none).count() == 0 and mixing.positions(none).count() == 0
    assert mixing.positions(odd).where("n_tokens = 0").count() == 0


# --- pipeline


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, []
    for i, (_, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, sf)
        if i < len(cp.STAGES) - 1:
            assert docs.columns == columns
        counts.append(docs.count())
    assert cp.run(spark, sf).count() == counts[-1]


def brute_language(docs, buckets=1 << 16, alpha=0.1):
    """Ids whose text is in a known language, by loops over characters."""
    import math
    from collections import Counter

    def grams(text):
        t = re.sub(r"[^a-z\x80-\U0010ffff]+", " ", text.lower()).lstrip(" ")
        code = [int.from_bytes(c.encode(), "little") for c in t]
        for order in (2, 3):
            for i in range(len(code) - order + 1):
                h = (0x811C9DC5 * order) & 0xFFFFFFFF
                for c in code[i : i + order]:
                    h = ((h ^ c) * 0x01000193) & 0xFFFFFFFF
                    h ^= h >> 15
                h = (h * 0x846CA68B) & 0xFFFFFFFF
                yield (h ^ (h >> 16)) % buckets

    found = {i: Counter(grams(t or "")) for i, t, _, _ in docs}
    seen = {}
    for i, _, lang, _ in docs:
        if lang is not None:
            seen.setdefault(lang, Counter()).update(found[i])
    total = {k: sum(c.values()) + alpha * buckets for k, c in seen.items()}
    out = set()
    for i, own in found.items():
        score = {k: sum(n * (math.log(c[b] + alpha) - math.log(total[k])) for b, n in own.items()) for k, c in seen.items()}
        if own and max(score.values()) > -math.log(buckets) * sum(own.values()):
            out.add(i)
    return out


def brute_cut(docs, length):
    """Rounds over all windows in order of (id, place), until none stands twice."""
    while True:
        first, cut = {}, {}
        for i, text in sorted(docs.items()):
            w = re.findall(rb"[^ \t\n\v\f\r]+", text.encode())
            for p in range(len(w) - length + 1):
                at = first.setdefault(tuple(w[p : p + length]), (i, p))
                if at != (i, p):
                    begin = max(p, at[1] + length) if at[0] == i else p
                    cut.setdefault(i, set()).update(range(begin, p + length))
        if not cut:
            return docs
        for i, words_ in cut.items():
            raw = docs[i].encode()
            spans = [m.start() for m in re.finditer(rb"[^ \t\n\v\f\r]+", raw)] + [len(raw)]
            kept = raw[: spans[0]] + b"".join(raw[spans[k] : spans[k + 1]] for k in range(len(spans) - 1) if k not in words_)
            docs[i] = kept.decode()
            if not docs[i].strip(" \t\n\v\f\r"):
                del docs[i]


def brute_curriculum(docs, encode):
    """(id, tokens) in the order of training, from shares at the start to their roots at the end."""
    import hashlib
    import math

    sizes = {i: len(encode(t)) for i, (t, _) in docs.items()}
    supply, total = {}, float(sum(sizes.values()))
    for i, (_, source) in docs.items():
        supply[source] = supply.get(source, 0) + sizes[i]
    roots = sum(math.sqrt(v / total) for v in supply.values())
    placed = []
    for source, have in supply.items():
        a, b, at = have / total, math.sqrt(have / total) / roots, 0
        own = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i, (_, s) in docs.items() if s == source and sizes[i])
        for h, i in own:
            epoch = 0
            while at + epoch * have < total * (a + b) / 2:
                y = (at + epoch * have) / total
                placed.append((2 * y / (a + math.sqrt(a * a + 2 * (b - a) * y)), source, h, i, epoch))
                epoch += 1
            at += sizes[i]
    return [(i, sizes[i]) for *_, i, _ in sorted(placed)]


def test_pipeline_brute_force(spark, sf, tmp_path):
    """The whole pipeline against plain Python."""
    import corpus_pipeline as cp

    rng, given = random.Random(3), spark.read.parquet(f"{sf}/documents.parquet")
    noise = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxyz") for _ in range(7)) for _ in range(60)) for _ in range(5)]
    long = [r.text for r in given.where("n_chars > 3000").orderBy("doc_id").limit(3).collect()]
    more = [(1000 + i, t) for i, t in enumerate([*noise, *(" ".join(long[0].split()[20:110]) + "\n" + t for t in long[1:])])]
    more = spark.createDataFrame([(i, t, None, "src1", len(t)) for i, t in more], given.schema)
    given.union(more).write.parquet(str(tmp_path / "documents.parquet"))
    sf = str(tmp_path)
    table = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in table.collect()]
    source = {i: s for i, _, _, s in docs}
    known = brute_language(docs)
    assert len(known) < len(docs)
    docs = [(i, t) for i, t, _, _ in docs if i in known]
    roots = {i for i, c, _ in brute_classes(docs, 5, 0.4) if i == c}
    assert len(roots) < len(docs)
    left = brute_cut({i: t for i, t in docs if i in roots}, 50)
    assert any(left.get(i) != t for i, t in docs if i in roots)
    order = brute_curriculum({i: (t, source[i]) for i, t in left.items()}, tokencount.load_encoding(tokencount.VOCABULARY).encode_ordinary)
    assert len(set(order)) < len(order)  # some documents are repeated
    shards, before = {}, 0
    for i, n in order:
        shards.setdefault(before // packing.SHARD_TOKENS, []).append((i, n))
        before += n
    want = [(shard, b, o, own[k][0], start, n) for shard, own in shards.items() for k, start, n, b, o in brute_pack([n for _, n in own], packing.CAPACITY, packing.OPEN_BINS)]
    assert rows(cp.run(spark, sf)) == sorted(want, key=repr)


def test_pipeline_keeps_the_curriculum(spark, sf):
    """Bins follow the order of training, and what is repeated does not meet itself in a bin unless bins are few."""
    import corpus_pipeline as cp

    found = cp.run(spark, sf.replace("sf0.001", "sf0.01")).toPandas()
    want = mixing.positions
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    for _, stage in cp.STAGES[:3]:
        docs = stage(spark, docs, sf)
    first = want(docs).where("epoch = 0").toPandas().set_index("doc_id").position
    bins = found[found.start == 0].groupby("doc_id").bin.min()
    both = first.to_frame().join(bins, how="inner")
    assert both.position.rank().corr(both.bin.rank()) > 0.9


def test_pipeline_awkward(spark, odd, none):
    import corpus_pipeline as cp

    docs, kept = odd, []
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == odd.columns, name
        kept.append(sorted((r.doc_id for r in docs.collect()), key=repr))
    # texts without letters and null texts go; 7 is close to 6; repeated rows and null ids stay, repeated rows without what repeats
    assert not {2, 3, 4} & set(kept[0]) and None in kept[0] and kept[0].count(1) == 3
    assert 7 in kept[0] and 7 not in kept[1] and set(kept[1]) | {7} == set(kept[0])
    assert set(kept[2]) == set(kept[1]) and set(kept[3]) <= set(kept[2])
    placed = cp.STAGES[-1][1](spark, docs, "")
    assert sorted({r.doc_id for r in placed.collect()}, key=repr) == sorted(set(kept[3]), key=repr)
    docs = none
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
