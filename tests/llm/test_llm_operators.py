"""Corpus operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import gzip
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from haplospark.llm import collocations, decontaminate, exact_dedup, mixing, ngram_join, passages, quality, queries, resample, sharding, shingles, tokenfile, toxicity, url_rules, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, words string, row string, OF string, repeats int, label string, key long, keep string, id long"
RNG = random.Random(7)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 8))) for _ in range(4000)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(text, every, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) if i % every == every - 1 else w for i, w in enumerate(text.split(" ")))


def documents(spark, rows):
    """rows: (doc_id, text[, source]); with columns whose names operators use themselves."""
    return spark.createDataFrame([(d, t, "en", (rest or ["s"])[0], len(t or ""), -1, "x", "y", "of", 9, "label", 5, "no", 3) for d, t, *rest in rows], DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    base, other = prose(300, 1), prose(120, 2)
    rows = [(1, base, "a"), (2, base, "a"), (2, base, "a"), (3, edited(base, 60, 3), "b"), (4, None, None), (5, "", "b"), (6, " \n\t ", "a"), (7, "one two", "b"), (8, "One  TWO", None)]
    rows += [(9, other, "c"), (10, other + "\n", "a"), (11, prose(60_000, 4), "c"), (None, base, "a"), (12, "é ½ ünï " + other, "b"), (13, "a b c d e", "a"), (14, "a b c d", "a")]
    return documents(spark, rows)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def oracle(sql, **tables):
    c = duckdb.connect()
    for name, df in tables.items():
        frame = df.toPandas()  # noqa: F841
        c.sql(f"CREATE TABLE {name} AS SELECT * FROM frame")
    got = c.sql(sql)
    return got.columns, got.fetchall()


def same(df, sql, **tables):
    columns, rows = oracle(sql, **tables)
    shown = lambda r: tuple("" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(map(shown, df.select(*columns).collect())) == sorted(map(shown, rows))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


# mixing


def test_mix_equals_sql(awkward, nothing):
    own = awkward.select("doc_id", "text", "source")
    same(mixing.mix_sources(own).select("doc_id", "size", "source_size", "target", "taken"), mixing.ORACLE_SQL, documents=own)
    assert mixing.mix_sources(nothing).isEmpty()


def test_mix_meets_targets_and_repeats(spark):
    rows = [(i, prose(40 + i % 30, i), f"s{i % 4 if i > 700 else 3}") for i in range(1200)]
    docs = documents(spark, rows)
    mixed = mixing.mix_sources(docs)
    sums = mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("size").alias("m"), F.first("source_size").alias("s")).collect()
    assert all(abs(r.t - r.g) <= r.m and r.g <= 3 * r.s + 1e-9 for r in sums)
    assert sum(r.g for r in sums) == pytest.approx(sum(r.s for r in sums))
    assert mixed.filter("taken > 3 * size").isEmpty()
    again = {r.doc_id: r.taken for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in mixed.collect()}
    applied = mixing.apply_mix(docs)
    assert applied.columns == docs.columns and applied.count() == mixed.agg(F.sum("repeats")).first()[0]


def test_wordless_documents_of_a_capped_source_repeat_three_times(spark):
    rows = [(i, prose(20, i) if i % 3 else " ", "a") for i in range(60)] + [(100 + i, prose(400, i), "b") for i in range(30)]
    mixed = mixing.mix_sources(documents(spark, rows), weights=(9, 1)).collect()
    assert max(r.repeats for r in mixed) == 3 and all(r.repeats == 3 and r.taken == 3 * r.size for r in mixed if r.source == "a")


# token files


def expected_tokens(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    out, start = [], 0
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_round_trip(spark, awkward, nothing):
    manifest = tokenfile.write_tokens(awkward, queries.tokenizer_path(), file_bytes=1)
    got = sorted(tuple(r) for r in tokenfile.read_tokens(manifest).filter("doc_id is not null and doc_id <> 2").collect())
    rows = sorted(((r.doc_id, r.text) for r in awkward.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == sorted(x for x in expected_tokens(rows) if x[0] not in (None, 2))
    one = tokenfile.read_tokens(manifest, [7], with_ids=True).collect()
    assert len(one) == 1 and one[0].ids[-1] == 2 and zlib.crc32(np.array(one[0].ids, "<u4").tobytes()) == one[0].ids_crc32
    assert tokenfile.encode_documents(nothing, queries.tokenizer_path()).isEmpty()


def test_token_file_is_zstandard_and_checks_sums(tmp_path):
    import zstandard

    w = tokenfile.Writer(np.dtype("<u2"))
    plain = [np.arange(i, i + 50_000, dtype="<u2").tobytes() for i in range(12)]
    data = b"".join(w.add(i, p) for i, p in enumerate(plain)) + w.flush()
    frames = len(w.frames)
    whole = data + w.tail()
    path = tmp_path / "a.zst"
    path.write_bytes(whole)
    reader = tokenfile.Reader(str(path))
    assert [ids.tobytes() for *_, ids in reader.documents()] == plain and frames > 1
    with zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True) as f:
        assert f.read() == b"".join(plain)
    bad = bytearray(whole)
    bad[len(whole) - 9 - 12 * (frames + 1) + 8] ^= 1  # the first frame's sum in the seek table
    path.write_bytes(bytes(bad))
    with pytest.raises(Exception, match="damaged|rror"):
        list(tokenfile.Reader(str(path)).documents())


def test_added_tokens_give_their_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    added = [x.content for x in t.get_added_tokens_decoder().values()]
    texts = [f"{a}{x}{b}" for x in added for a in ("", "one ", "é\n") for b in ("", " two", "two", x)] + ["<|endof text|>", "endoftext"]
    whole = [t.encode(x, add_special_tokens=False).ids for x in texts]
    e = tokenfile.Encoder(queries.tokenizer_path())
    assert added and [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)] == whole


def test_parts_give_the_tokenizers_ids():
    e = tokenfile.Encoder(queries.tokenizer_path())
    r = random.Random(1)
    texts = ["".join(r.choice("ab é1²,.\n\n  '''stmrl!\t _-́\x1f\x85\xa0½ªß中") for _ in range(r.randint(0, 25))) for _ in range(4000)]
    whole = e._whole(texts)
    assert e.by_part and e.encode(texts) == whole


# exact dedup


def test_exact_groups_equal_sql(awkward, nothing, monkeypatch):
    own = awkward.select("doc_id", "text")
    same(exact_dedup.exact_groups(own), exact_dedup.ORACLE_SQL, documents=own)
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 1)
    many = own.unionByName(own.limit(1).withColumn("doc_id", F.explode(F.sequence(F.lit(100), F.lit(400)))).select("doc_id", "text"))
    same(exact_dedup.exact_groups(many), exact_dedup.ORACLE_SQL, documents=many)
    assert exact_dedup.exact_groups(nothing).isEmpty()


# n-gram join


def brute_components(rows):
    sets = {d: shingle_set(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}


def families(n, copies):
    rows = []
    for f in range(n):
        base = prose(40 + 37 * f, 100 + f)
        rows += [(1000 * f + k, edited(base, 15 + k, k) if k else base) for k in range(copies)]
    return rows


@pytest.mark.parametrize(("copies", "block"), [(6, 1 << 21), (40, 1 << 21), (40, 3000)])
def test_components_equal_brute_force(spark, monkeypatch, copies, block):
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", block)
    rows = families(4, copies) + [(90_000 + i, t) for i, t in enumerate([None, "", "x y", "X  y", "x y z", "a b c d e", "a b c d e"])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(documents(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_lists_that_are_long_in_some_tasks_only(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LONG_LIST", 3)
    rows = families(3, 30)
    for parts in (1, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(documents(spark, rows).repartition(parts)).collect()}
        assert got == brute_components(rows)


@pytest.mark.parametrize("buckets", [1, 3])
def test_tries_find_all_similar_sets(buckets):
    r = np.random.default_rng(buckets)
    sets = []
    for _ in range(90):
        if sets and r.random() < 0.7:
            own = set(sets[r.integers(len(sets))].tolist()) ^ set(r.integers(0, 900, r.integers(0, 9)).tolist())
        else:
            own = set(r.integers(0, 900, r.integers(1, 120)).tolist())
        sets.append(np.array(sorted(own), np.uint64))
    by_key = {ngram_join.set_key(x): x for x in sets if len(x)}
    found, families = set(), []
    for b in range(buckets):
        rows = []
        for key, x in by_key.items():
            prefix = x[: ngram_join.prefix_length(len(x))]
            at = np.flatnonzero(prefix % buckets == b)
            rows.append(ngram_join.pack([key], [len(x)], [len(at)], prefix[at], at, np.zeros(len(at))))
        bucket = ngram_join.Bucket(rows)
        pairs, family = bucket.pairs()
        found |= {tuple(sorted(bucket.keys[p].tolist())) for p in pairs}
        families.append({int(bucket.keys[k]): int(v) for k, v in family.items()})
    keys = sorted(by_key)
    similar = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if 9 * len(np.intersect1d(by_key[a], by_key[b])) >= 4 * (len(by_key[a]) + len(by_key[b]))]
    assert len(similar) > 30 and len(found) < len(keys) * (len(keys) - 1) / 4
    assert all(p in found or any(p[0] in f and f[p[0]] == f.get(p[1]) for f in families) for p in similar)


def test_similar_groups_edges(awkward, nothing):
    out = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.similar_groups(awkward).collect()}
    assert out[4, 0] == 4 and out[6, 0] == 6 and out[8, 1] == 7 and out[3, len(shingle_set(edited(prose(300, 1), 60, 3)))] == 1
    assert [c for (d, _), c in out.items() if d is None] == [None]
    assert ngram_join.similar_groups(nothing).isEmpty()
    kept = ngram_join.keep_one_of_each(awkward)
    assert kept.columns == awkward.columns and sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 4, 5, 6, 7, 9, 11, 13, 14] + ([12] if brute_components([(9, prose(120, 2)), (12, "é ½ ünï " + prose(120, 2))])[12][1] == 12 else [])


def test_shingle_hashes_are_those_of_words():
    import pyarrow as pa

    texts = ["a b c d e f", "A b\tc d e", "", None, "x", "a b c d e f"]
    sets = [set(s.tolist()) for _, s in shingles.shingle_sets(pa.array(texts))]
    assert sets[0] == sets[5] and len(sets[0]) == 2 and sets[1] < sets[0] and sets[2] == sets[3] == set() and len(sets[4]) == 1


# WARC


def test_archives(spark, awkward):
    big = "<p>" + "x" * 1200 + "</p>"
    rows = [(1, "http://a/é x", big), (5, None, big), (3, "http://b", big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", "\r\n\r\nWARC/1.1\r\n" + "é" * 600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash"))
    same(warc.archive_pages(pages), warc.ORACLE_SQL, pages=pages.select("page_id", "url", "html"))
    assert warc.archive_pages(pages.limit(0)).isEmpty()


def test_every_member_stands_alone(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "y" * i) for i in range(50)], "page_id long, url string, html string").coalesce(1)
    written = warc.write_monolithic(pages)
    assert written.select("file").distinct().count() == 1
    source = written.first().file
    with pafs.LocalFileSystem().open_input_file(source.removeprefix("file://")) as f:
        raw = f.read()
    z = zlib.decompressobj(warc.GZIP)
    z.decompress(raw)
    assert z.eof and not z.unused_data  # one member in all
    out = warc.normalise(written, warc.decide(written)).first()
    fs, path = pafs.FileSystem.from_uri(out.file)
    with fs.open_input_file(path) as f:
        archive = f.read()
    assert archive.count(b"\x1f\x8b\x08") >= 50 and gzip.decompress(archive) == gzip.decompress(raw)


# sharding


@pytest.mark.parametrize("sizes", [[5], [3, 3, 3, 3], [1, 9, 1, 9, 1], list(range(1, 40)), [100] + [1] * 30])
def test_smallest_capacity(sizes):
    def needs(capacity):
        n, left = 1, capacity
        for s in sizes:
            if s > capacity:
                return 10**9
            if s > left:
                n, left = n + 1, capacity
            left -= s
        return n

    for k in (1, 2, 4, 16):
        brute = next(c for c in range(max(sizes), sum(sizes) + 1) if needs(c) <= k)
        a = np.array(sizes, np.int64)
        assert sharding.smallest_capacity(a, k) == brute
        cuts = sharding.level_cuts(a, k)
        assert len(cuts) < k and max(p.sum() for p in np.split(a, cuts)) <= brute


def test_shards(spark, awkward, nothing):
    rows = [(i, prose(30 + i % 50, i % 700)) for i in range(1500)] + [(5000 + i, "one text that many rows have") for i in range(1200)]
    docs = documents(spark, rows)
    out = sharding.shard_documents(docs).collect()
    assert len(out) == len(rows)
    shards = collections.defaultdict(list)
    for r in out:
        shards[r.shard].append(r)
    assert set(shards) == set(range(16))
    texts = dict(rows)
    where = collections.defaultdict(set)
    for r in out:
        where[texts[r.doc_id]].add(r.shard)
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    totals = [sum(r.size for r in s) for s in shards.values()]
    assert max(totals) - min(totals) <= 0.1 * max(totals) or max(totals) == 1200 * 30
    assert sharding.shard_documents(awkward).count() == awkward.count() and sharding.shard_documents(nothing).isEmpty()


# decontamination


def test_leaks(spark, nothing):
    items = [(1, prose(30, 900)), (2, prose(48, 901)), (3, "only three words"), (4, None), (5, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    near = " ".join("changed" if i == 2 else w for i, w in enumerate(items[1][1].split(" ")))
    rows = [(1, prose(80, 1) + " " + items[0][1] + " " + prose(50, 2)), (2, prose(500, 3)), (3, near + " " + prose(10, 4)), (4, "x ONLY three words y"), (5, None), (6, items[0][1].upper()), (7, " ".join(items[1][1].split(" ")[:20]))]
    docs = documents(spark, rows)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, bench).collect()}
    assert set(got) == {(1, 1), (3, 2), (4, 3), (6, 1)}
    assert got[1, 1].first_word == 80 and got[1, 1].n_words == 30 and got[1, 1].similarity == 1.0 and 0.8 <= got[3, 2].similarity < 1
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 5, 7]
    assert decontaminate.find_leaks(nothing, bench).isEmpty() and decontaminate.find_leaks(docs, bench.limit(0)).isEmpty()


def test_all_fingerprints_within_the_radius_are_found():
    items = decontaminate.Items(list(range(300)), [prose(20, 2000 + i) for i in range(300)])
    r = np.random.default_rng(1)
    for i in range(60):
        flipped = items.prints[i] ^ np.uint64(sum(1 << int(b) for b in r.choice(64, r.integers(0, 24), replace=False)))
        brute = np.flatnonzero(np.bitwise_count(items.prints ^ flipped) <= items.radius)
        assert items.within(flipped).tolist() == brute.tolist()


def brute_leaks(docs, items):
    out = {}
    for d, text in docs:
        words = words_of(text)
        for item, other in items:
            want = words_of(other)
            if not words or not want:
                continue
            bag = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
            size = min(len(want), len(words))
            for s in range(len(words) - size + 1):
                x, y = bag(words[s : s + size]), bag(want)
                both = sum((x & y).values())
                like = both / (x.total() + y.total() - both)
                if like >= 0.8 and like > out.get((d, item), (0, 0))[0]:
                    out[d, item] = like, s
    return out


def test_leaks_equal_sliding_windows(spark):
    r = random.Random(21)
    items = [(i, prose(r.choice([3, 6, 25, 40, 60]), 4000 + i)) for i in range(25)] + [(100, "to be or not to be " * 6)]
    docs = []
    for d in range(120):
        item = r.choice(items)[1].split(" ")
        for _ in range(r.randint(0, 4)):
            item[r.randrange(len(item))] = r.choice(VOCABULARY)
        docs.append((d, " ".join([prose(r.randint(0, 60), 5000 + d), *item, prose(r.randint(0, 60), 6000 + d)])))
    docs.append((500, prose(30_000, 3) + " " + items[0][1] + " " + prose(3_000, 4)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.similarity, x.first_word) for x in decontaminate.find_leaks(documents(spark, docs), bench).collect()}
    want = brute_leaks(docs, items)
    assert len(want) > 25 and {k: (pytest.approx(v[0]), v[1]) for k, v in want.items()} == got


# passages


def brute_passages(one, two, least=50, identity=0.8):
    """Whether two lists of words share a passage: every longest common subsequence of windows that begin and end with equal words."""
    ids = {w: i for i, w in enumerate({*one, *two})}
    a, b = (np.array([ids[w] for w in x]) for x in (one, two))
    for s in range(len(a) - least + 1):
        for t in np.flatnonzero(b[: len(b) - least + 1] == a[s]).tolist():
            x, y = a[s : s + 70], b[t : t + 70]
            table = np.zeros((len(x) + 1, len(y) + 1), int)
            for i, w in enumerate(x):
                table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, :-1] + (y == w), table[i, 1:]))
            n, m = np.meshgrid(np.arange(least, len(x) + 1), np.arange(least, len(y) + 1), indexing="ij")
            if (table[least:, least:] >= identity * np.maximum(n, m)).any():
                return True
    return False


@pytest.mark.parametrize("identity", [1, 0.96, 0.9, 0.86, 0.82])
def test_passages_beside_brute_alignment(spark, identity):
    r = random.Random(int(100 * identity))
    rows, found = [], set()
    for k in range(24):
        whole = [f"{w}{k}" for w in prose(r.randint(51, 60), 9000 + k).split(" ")]
        other = list(whole)
        for i in sorted(r.sample(range(len(whole)), round((1 - identity) * len(whole))), reverse=True):
            other[i : i + 1] = r.choice([[], ["changed"], [other[i], "added"]])
        texts = [[*prose(r.randint(0, 70), 20_000 + 2 * k + n).split(), *words, *prose(r.randint(0, 70), 30_000 + 2 * k + n).split()] for n, words in enumerate((whole, other))]
        rows += [(2 * k + n, " ".join(t)) for n, t in enumerate(texts)]
        if brute_passages(*texts):
            found.add((2 * k, 2 * k + 1))
    got = {(x.doc_id, x.other_id) for x in passages.repeated_passages(documents(spark, rows)).collect()}
    assert {(b, a) for a, b in got} == got
    assert len(found) > 12 and len(got & found) >= 0.95 * len(found)
    assert {p for p in got if p[0] < p[1]} <= found


def test_copies_and_long_texts_have_passages(spark):
    text, long = prose(80, 90), prose(30_000, 91)
    rows = [(5, text), (3, text.upper().replace(" ", "\n")), (9, text), (1, prose(60, 92)), (20, long), (21, prose(100, 93) + " " + long), (None, text)]
    out = {(r.doc_id, r.other_id): (r.first_word, r.n_words, r.other_first_word, r.identity) for r in passages.repeated_passages(documents(spark, rows)).collect()}
    assert out == {(3, 9): (0, 80, 0, 1.0), (5, 3): (0, 80, 0, 1.0), (9, 3): (0, 80, 0, 1.0), (20, 21): (0, 30_000, 100, 1.0), (21, 20): (100, 30_000, 0, 1.0)}


def test_many_hot_seeds_meet_in_a_join(spark, monkeypatch):
    whole = prose(60, 94)
    rows = [(d, prose(60, 40_000 + d) + " " + whole) for d in range(50)] + [(100 + d, prose(60, 41_000 + d) + " " + " ".join(whole.split(" ")[:20])) for d in range(50)]
    own = lambda: {(r.doc_id, r.first_word, r.n_words) for r in passages.repeated_passages(documents(spark, rows)).collect()}
    few = own()
    monkeypatch.setattr(passages, "HOT_BYTES", 0)
    assert {d for d, *_ in few} == set(range(50)) and own() == few


def test_passages(spark, nothing):
    shared, short = prose(70, 50), prose(30, 51)
    rows = [(1, prose(100, 60) + " " + shared + " " + prose(90, 61)), (2, shared + " " + prose(200, 62)), (3, prose(150, 63) + " " + edited(shared, 25, 5)), (4, prose(300, 64) + " " + short), (5, short + " " + prose(300, 65))]
    rows += [(6, prose(400, 66)), (7, None), (8, "few words"), (None, shared)]
    out = passages.repeated_passages(documents(spark, rows)).collect()
    assert {r.doc_id for r in out} | {r.other_id for r in out} == {1, 2, 3}
    r = next(x for x in out if (x.doc_id, x.other_id) == (2, 1))
    assert abs(r.first_word) <= 2 and abs(r.n_words - 70) <= 4 and abs(r.other_first_word - 100) <= 2
    assert passages.repeated_passages(nothing).isEmpty()


def test_passages_whose_parts_are_elsewhere(spark):
    def placed(rows):
        rows = [(d, prose(60, 1000 + 2 * d) + " " + text + " " + prose(60, 1001 + 2 * d)) for d, text in rows]
        return {(r.doc_id, r.other_id) for r in passages.repeated_passages(documents(spark, rows)).collect() if abs(r.first_word - 60) <= 2 and abs(r.n_words - 60) <= 4}

    whole = prose(60, 70).split(" ")
    half, rest = " ".join(whole[:30]), " ".join(whole[30:])
    both = [(500, " ".join(whole)), (600, " ".join(whole))]
    assert placed([(1, half), (8000, half), (2, rest), (9000, rest), *both]) == {(500, 600), (600, 500)}
    # parts that overlap and are too frequent for all pairs
    n = 40
    parts = [(k, " ".join(whole[:40])) for k in range(1, n)] + [(100 + k, " ".join(whole[20:])) for k in range(1, n)]
    parts += [(8000, " ".join(whole[:40])), (9000, " ".join(whole[20:]))]
    assert {(500, 600), (600, 500)} <= placed(parts + both)


def test_edited_passages_whose_parts_are_all_elsewhere(spark):
    r = random.Random(5)
    rows, pairs = [], set()
    for k in range(6):
        whole = [f"{w}{k}" for w in prose(60, 9500 + k).split(" ")]
        other = list(whole)
        for i in sorted(r.sample(range(60), 4), reverse=True):
            other[i : i + 1] = r.choice([[], ["changed"], [other[i], "added"]])
        pairs.add((9000 + 2 * k, 9001 + 2 * k))
        texts = [(9000 + 2 * k, whole), (9001 + 2 * k, other), *((100 * k + n, whole[:30] if n < 40 else whole[30:]) for n in range(80))]
        rows += [(d, " ".join([prose(60, 50_000 + 2 * d), *text, prose(60, 50_001 + 2 * d)])) for d, text in texts]
    one, three = (sorted(map(tuple, passages.repeated_passages(documents(spark, rows).repartition(n)).collect())) for n in (1, 3))
    assert one == three
    assert pairs <= {x[:2] for x in one} and {p[::-1] for p in pairs} <= {x[:2] for x in one}


def hot_places(texts, line):
    """The places of the seeds of a line in texts, by unit."""
    hashed = [words for _, words in passages._texts(pa.array(texts), 50)]
    grams, _ = shingles.shingle_hashes(next(passages._texts(pa.array([line]), 5))[1], np.array([0, len(line.split(" "))]), 5)
    seeds = np.unique(passages.hot_name(grams, passages._bucket(grams, 64)))
    own = np.concatenate([x for words in hashed for x in passages.contexts(words, seeds, np.full(len(seeds), len(texts)), 64)])
    own = own[np.lexsort((own["place"], own["key"], own["unit"]))]
    return np.split(own, np.flatnonzero(np.diff(own["unit"])) + 1)


def test_texts_with_only_a_line_in_common_are_not_aligned(monkeypatch):
    line, whole = prose(12, 9600), prose(60, 9601).split(" ")
    texts = [f"{prose(80, 60_000 + d)} {line} {prose(80, 70_000 + d)}" for d in range(300)]
    texts += [" ".join([*whole[:30], line, *("changed" if k == 5 and d else w for k, w in enumerate(whole[30:]))]) for d in range(2)]
    pairs, common = [], passages._common
    monkeypatch.setattr(passages, "_common", lambda *given: pairs.append(len(given[2])) or common(*given))
    found = {frozenset(own["key"][[i, j]].tolist()) for own in hot_places(texts, line) for i, j in passages.meetings(own, 50, 0.8)}
    assert found == {frozenset(passages.text_key(w) for _, w in passages._texts(pa.array(texts[300:]), 50))}
    assert 0 < sum(pairs) < 2_000


def test_runs_of_one_word_have_few_places():
    texts = [" ".join([prose(60, 80_000 + d), *["the"] * (100 + d), prose(60, 81_000 + d)]) for d in range(40)]
    (own,) = hot_places(texts, "the the the the the")
    assert np.unique(own["key"], return_counts=True)[1].max() <= 10
    linked = {int(k) for i, j in passages.meetings(own, 50, 0.8) for k in own["key"][[i, j]]}
    assert linked == set(own["key"].tolist()) and len(linked) == 40


def test_no_place_of_a_run_is_left_out():
    r = random.Random(11)
    texts = [" ".join([prose(60, 82_000 + d), *["the"] * n, prose(60, 83_000 + d)]) for d, n in enumerate((7, 60, 139, 400))]
    texts += [" ".join(["the"] * 300), " ".join(["the", "a"] * 90), " ".join(r.choice(["the", "the", "the", "a"]) for _ in range(400))]
    for line in ("the the the the the", "a the a the a"):
        for own in hot_places(texts, line):
            own = passages.every_place(own)
            got = {(int(k), int(p), w.tobytes()) for k, p, w in zip(own["key"], own["place"], own["words"], strict=True)}
            seed = own["words"][0, passages.MOST_GAP :][: passages.SEED_WORDS]
            for _, words in passages._texts(pa.array(texts), 50):
                short = np.concatenate([np.zeros(64, "<u4"), np.maximum(words >> np.uint64(32), np.uint64(1)).astype("<u4"), np.zeros(64, "<u4")])
                grams, _ = shingles.shingle_hashes(words, np.array([0, len(words)]), 5)
                places = [p for p in passages.seed_places(grams).tolist() if (short[64 + p : 69 + p] == seed).all()]
                around = {short[p : p + passages.AROUND].tobytes() for p in places}
                mine = {x for x in got if x[0] == passages.text_key(words)}
                assert {w for *_, w in mine} == around and {p for _, p, _ in mine} <= set(places)
                assert all(short[p : p + passages.AROUND].tobytes() == w for _, p, w in mine)


def test_copies_within_a_text_are_linked(spark):
    whole = prose(700, 9700)
    texts = [" ".join([prose(60, 84_000 + d), whole, prose(60, 85_000 + d), *([whole] if d == 3 else [])]) for d in range(40)]
    out = passages.repeated_passages(documents(spark, list(enumerate(texts)))).collect()
    covered = {w for r in out if r.doc_id == 3 for w in range(r.first_word, r.first_word + r.n_words)}
    assert covered >= {*range(60, 760), *range(820, 1520)}


def test_passages_at_all_places(spark):
    one, two = prose(60, 71), prose(60, 72)
    rows = [(1, one + " " + prose(80, 73) + " " + one), (2, prose(90, 74) + " " + one + " " + two), (3, two)]
    out = passages.repeated_passages(documents(spark, rows)).collect()
    assert {(r.first_word, r.other_first_word) for r in out if (r.doc_id, r.other_id) == (2, 1)} == {(90, 0), (90, 140)}


def test_passages_with_edits(spark):
    whole = prose(52, 80).split(" ")
    two = [("changed" if i in (17, 34) else w) for i, w in enumerate(whole)]
    rows = []
    for k, other in enumerate((two, whole[:40] + whole[41:], whole[:40] + ["added"] + whole[40:], whole[:12] + whole[13:])):
        for d, words in ((2 * k, whole), (2 * k + 1, other)):
            # words of each pair are its own
            words = [f"{w}{k}" for w in words]
            rows.append((d, prose(40, 2000 + d) + " " + " ".join(words) + " " + prose(40, 3000 + d)))
    out = passages.repeated_passages(documents(spark, rows)).collect()
    got = {(r.doc_id, r.other_id): (r.first_word, r.n_words, r.other_first_word, r.other_n_words) for r in out}
    ahead = {(2 * k, 2 * k + 1): (40, 52, 40, n) for k, n in enumerate((52, 51, 53, 51))}
    assert got == ahead | {(b, a): (t, m, s, n) for (a, b), (s, n, t, m) in ahead.items()}


def test_chains_equal_quadratic_search():
    r = random.Random(3)
    for _ in range(30):
        parts = sorted({(r.randint(0, 200), r.randint(0, 200), 8, 8) for _ in range(40)})
        score = []
        for a, b, n, c in parts:
            before = [score[j] - passages.GAP_COST * (a - x - m + b - y - m) for j, (x, y, m, _) in enumerate(parts[: len(score)]) if x + m <= a and y + m <= b]
            score.append(c + max([0.0, *before]))
        best = passages.chains(parts)[0]
        got = sum(8 for _ in best) - passages.GAP_COST * sum(y[0] - x[0] - 8 + y[1] - x[1] - 8 for x, y in zip(best, best[1:], strict=False))
        assert got == pytest.approx(max(score))


# URL rules


def test_urls(spark):
    urls = ["http://A.Example.NET/en/1", "https://example.net/de/2?x=http://q", "http://example.com/de/", "http://x.org/fr/3#f", "http://net", "net/en/", None, "", "x://y.com/de", "http://sub.example.com/de/9", "http://badexample.com/de/1"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(100 + i, f"http://s{i % 9}.example.com/de/{i}") for i in range(60)] + [(300 + i, f"http://s{i % 9}.example.net/en/{i}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_rules.judge_urls(pages).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(7)] == [
        ("a.example.net", "/en/1", "example.net/en/"), ("example.net", "/de/2", "net/"), ("example.com", "/de/", "example.com/de/"), ("x.org", "/fr/3", "org/fr/"), ("net", "", None), ("", "", None), ("", "", None),
    ]
    assert got[9].rule == "example.com/de/" and got[10].rule is None and got[10].verdict == "block" and got[8].rule is None
    assert url_rules.judge_urls(pages.limit(0)).isEmpty()


def test_mined_rules_equal_brute_force(spark):
    r = random.Random(5)
    rows = [(sorted(r.sample("abcdef", r.randint(1, 4))), r.choice(["block", "allow"])) for _ in range(200)]
    rows = [(t, "block" if "a" in t and "b" in t else lab) for t, lab in rows]
    mined = url_rules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.02, 0.75, 3)
    from itertools import combinations

    brute = {}
    for n in (1, 2, 3):
        for combo in combinations("abcdef", n):
            has = [lab for t, lab in rows if set(combo) <= set(t)]
            for lab in ("block", "allow"):
                k = has.count(lab)
                if has and k / len(rows) >= 0.02 and k / len(has) >= 0.75:
                    brute[combo, lab] = round(k / len(has), 9)
    pruned = {(c, lab): v for (c, lab), v in brute.items() if not any(set(p) < set(c) and lab == q and w >= v for (p, q), w in brute.items())}
    assert {(tuple(x.tokens), x.label): x.confidence for x in mined.collect()} == pruned


def test_long_queries_are_mined_in_bounded_time(spark):
    r = random.Random(6)
    keys = [f"key:{k:02d}" for k in range(30)]
    rows = [(keys + ["tld:com"], "block" if i % 10 else "allow") for i in range(60)] + [(r.sample(keys, 2) + ["tld:net"], "allow") for _ in range(200)]
    mined = url_rules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, label string"))
    rules = {(tuple(x.tokens), x.label): x.confidence for x in mined.collect()}
    assert rules[("tld:com",), "block"] == 0.9 and rules[("tld:net",), "allow"] == 1.0 and max(len(t) for t, _ in rules) == 3


def test_parameters_that_come_together_are_one_class(spark):
    rows = [(i, [f"p{j}" for j in range(300)] if i % 10 == 0 else ["q", f"r{i % 3}"], "block" if i % 10 == 0 else "allow") for i in range(100)]
    frame = spark.createDataFrame([r[1:] for r in rows], "tokens array<string>, label string")
    rules, named = url_rules.mine_classes(frame, 0.02, 0.75, 3)
    assert {r.rule_id: (r.label, r.confidence, r.support) for r in rules.collect()} == {"p0": ("block", 1.0, 0.1), "q": ("allow", 1.0, 0.9)} | {
        f"r{k}": ("allow", 1.0, sum(1 for i, t, _ in rows if i % 10 and i % 3 == k) / 100) for k in range(3)
    } and sorted(t for t, n in named.items() if n == "p0") == sorted(f"p{j}" for j in range(300))
    assert sorted(r.tokens for r in url_rules.mine_rules(frame, 0.02, 0.75, 3).collect() if r.label == "block") == sorted([f"p{j}"] for j in range(300))
    pages = spark.createDataFrame([(i, f"http://a{i % 7}.test/x?" + "&".join(f"{t}=1" for t in tokens)) for i, tokens, _ in rows] + [(200, "http://new.test/?p17=4"), (201, "http://new.test/")], "page_id long, url string")
    labelled = pages.filter("page_id < 200").selectExpr("url", "case when page_id % 10 = 0 then 'block' else 'allow' end as label")
    assert {r.page_id: r.verdict for r in url_rules.judge_urls(pages, labelled).collect()} == {i: label for i, _, label in rows} | {200: "block", 201: "allow"}


def test_both_ways_of_mining_agree(spark, monkeypatch):
    r = random.Random(8)
    rows = [(sorted(r.sample("abcdefg", r.randint(0, 5))), r.choice(["block", "block", "allow"])) for _ in range(300)] + [(None, "block"), (["a"], None)]
    own = lambda: sorted((tuple(x.tokens), x.label, x.confidence, x.support) for x in url_rules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.02, 0.6, 3).collect())
    grown = own()
    monkeypatch.setattr(url_rules, "GROWN_TOKENS", 0)
    assert grown and own() == grown


def test_verdicts_equal_brute_force(spark):
    r = random.Random(9)
    hosts = ["a.net", "example.net", "x.org", "www.example.com", "shop.com", "blog.com"]
    urls = [f"http://{r.choice(hosts)}/{r.choice(['en', 'de', 'fr', 'ads'])}/{r.choice(['p', 'q'])}{i % 7}?{r.choice(['id', 'ref', 'utm'])}={i}" for i in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labelled = spark.createDataFrame([(u, "block" if "/ads/" in u and i % 9 or "utm" in u else "allow") for i, u in enumerate(urls[:300])], "url string, label string")
    tokens = F.col("tokens")
    parts = lambda df: df.select("*", url_rules.url_tokens(F.col("url"), url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url"))).alias("tokens"))
    mined = url_rules.mine_rules(parts(labelled).select(tokens, "label")).collect()
    of = {x.page_id: set(x.tokens) for x in parts(pages).collect()}

    def verdict(i, url):
        host, path = re.match(r"http://([^/]*)([^?]*)", url).groups()
        fit = [(len(h + p), v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fit:
            return max(fit)[1]
        fits = [(-m.confidence, -len(m.tokens), -m.support, m.label, m.rule_id) for m in mined if set(m.tokens) <= of[i]]
        return min(fits)[3] if fits else "allow"

    got = {x.page_id: x.verdict for x in url_rules.judge_urls(pages, labelled).collect()}
    assert got == {i: verdict(i, u) for i, u in enumerate(urls)} and "block" in got.values()


# quality


def test_quality_on_held_out_rows(spark):
    r = random.Random(2)
    junk = lambda i: " ".join(r.choice(VOCABULARY).upper() + "!!" for _ in range(60)) if i % 2 else " | ".join(["menu"] * 50)
    rows = [(i, junk(i) if i % 4 == 0 else prose(80, i) + ".", "s" if i % 4 else "t") for i in range(800)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)], "doc_id long, quality int")
    scored = quality.score_quality(docs, labels).filter("doc_id >= 400").collect()
    assert np.mean([x.keep == (x.doc_id % 4 != 0) for x in scored]) >= 0.97
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() < 650


def test_a_fitted_model_scores_awkward_rows(spark, awkward, nothing):
    rows = [(i, prose(40, i) if i % 2 else "!!! BUY " * 30, "s" if i % 2 else None) for i in range(1000, 1200)]
    docs = awkward.unionByName(documents(spark, rows))
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000, 1150)] + [(4, None), (5, 0), (5, 0)], "doc_id long, quality int")
    out = quality.score_quality(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= x.quality_score <= 1 and x.keep == (x.quality_score >= 0.5) for x in out)
    assert len({(x.doc_id, x.quality_score) for x in out if x.doc_id in (1, 2)}) == 2
    assert np.mean([x.keep == x.doc_id % 2 for x in out if x.doc_id and x.doc_id >= 1150]) > 0.95
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns and sorted(x.doc_id or 0 for x in kept.collect()) == sorted(x.doc_id or 0 for x in out if x.keep)
    assert quality.score_quality(nothing, labels).isEmpty() and quality.keep_quality(nothing, labels).isEmpty()


def test_features_are_those_of_plain_python(spark):
    import pyarrow as pa

    texts = ["Ab cd ab\n\nÉé x", None, "", "one", "Z" * 5000]
    sources = ["a", None, "a", "b", "a"]
    f = quality.Features(pa.array(texts), [("source", pa.array(sources))])
    for i, t in enumerate(texts):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t.lower() if t.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t))
        n, c = max(1, len(words)), max(1, len(t))
        assert f.text_shape[i] == pytest.approx([sum(x.isalpha() for x in t) / c, sum("A" <= x <= "Z" for x in t) / c, len(set(words)) / n, c / n])
        assert f.meta_shape[i] == pytest.approx([np.log1p(c), np.log1p(t.count("\n") + 1), c / (t.count("\n") + 1)])
    r = np.random.default_rng(1)
    text, meta = r.normal(size=quality.SIZES["text"] + 1), r.normal(size=quality.SIZES["meta"] + 1)
    docs = spark.createDataFrame(list(zip(range(5), texts, sources, strict=True)), "doc_id long, text string, source string")
    for row, one, two in zip(quality.featurise(docs, quality.counters()).orderBy("doc_id").collect(), *f.margins(text, meta), strict=True):
        assert row.text_features.toArray() @ text[:-1] + text[-1] == pytest.approx(one) and row.meta_features.toArray() @ meta[:-1] + meta[-1] == pytest.approx(two)


def test_quality_without_classes(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (3, 1), (None, 0)], "doc_id long, quality int")
    out = quality.score_quality(awkward, labels).collect()
    assert len(out) == awkward.count() and all(x.keep and x.quality_score is None for x in out)
    assert quality.score_quality(nothing, labels).isEmpty()


# importance resampling

FEATURE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def brute_resample(rows, targets, percent=5, least=20, buckets=10_000):
    """Plain Python: (doc_id, n_features, weight, score, rank) of each row."""
    features = lambda t: [" ".join(w[i : i + k]) for w in [FEATURE_WORD.findall(lowered(t))] for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (collections.Counter(bucket(f) for x in texts for f in features(x)) for texts in ([x for _, x in rows], targets))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets))))
    out = []
    for d, x in rows:
        own = features(x)
        h = int(hashlib.sha256(f"42:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in own)
        out.append([d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(FEATURE_WORD.findall(lowered(x)))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in out]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_resample_equals_brute_force(spark, awkward, nothing):
    rows = [(i, prose(15 + i % 40, i)) for i in range(160)] + [(500 + i, prose(40, i % 3)) for i in range(30)] + [(None, prose(50, 9)), (None, None), (900, ""), (7, prose(22, 7)), (901, "ünï çode " * 12 + "x" * 200 + " Z9" * 20)]
    targets = [prose(60, 1), prose(60, 2), None, "x" * 200 + " z9 z9"]
    docs, target = documents(spark, rows), spark.createDataFrame([(t, 1) for t in targets], "text string, rank int")
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    for percent in (5, 50, 100):
        got = resample.ranked_resample(docs.repartition(5), target, percent).select(*columns).collect()
        assert ordered(map(tuple, got)) == ordered(brute_resample(rows, targets, percent))
    own = [(r.doc_id, r.text) for r in awkward.collect()]
    assert ordered(map(tuple, resample.ranked_resample(awkward, target.limit(0)).select(*columns).collect())) == ordered(brute_resample(own, []))
    assert resample.ranked_resample(nothing, target).isEmpty() and resample.draw_documents(nothing, target).isEmpty()
    drawn = resample.draw_documents(docs, target, 50)
    assert drawn.columns == docs.columns
    want = {r[0] for r in brute_resample(rows, targets, 50) if r[4]}
    assert {r.doc_id for r in drawn.collect()} == want


def test_resample_cuts_ties_by_id(spark):
    scored = spark.createDataFrame([(i, s) for i, s in enumerate([5, 9, 5, 5, -3, 5, 9])] + [(None, 5)], "doc_id long, score long")
    want = sorted([(-s, (1 << 63) - 1 if i is None else i) for i, s in [tuple(r) for r in scored.collect()]])
    for n in range(1, 9):
        assert resample.find_cutoff(scored, n) == (-want[n - 1][0], want[n - 1][1])
    assert resample.find_cutoff(scored, 0) is None and resample.find_cutoff(scored, 9) is None


# toxicity


def test_block_max_search_is_exact():
    r = np.random.default_rng(3)
    vectors, ids = [], []
    for i in range(700):
        t = sorted(r.choice(40, size=int(r.integers(0, 7)), replace=False).tolist())
        w = r.integers(1, 4, len(t)).astype(float)
        vectors.append((t, w / np.sqrt((w * w).sum()) if len(t) else w))
        ids.append(int(r.permutation(10_000)[0]) if i % 50 else 77)
    index = toxicity.BlockMaxIndex(vectors, ids, [i % 2 for i in range(700)], block=16)
    dense = np.zeros((700, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i in range(0, 700, 7):
        for without in (None, ids[i]):
            cosine = np.round(dense @ dense[i], 12)
            order = sorted((j for j in range(700) if cosine[j] > 0 and ids[j] != without), key=lambda j: (-cosine[j], ids[j]))[:9]
            places, found = index.nearest(*vectors[i], k=9, without=without)
            assert np.allclose(found, cosine[order], atol=1e-9) and sorted(zip(-np.round(found, 9), index.ids[places])) == sorted(zip(-np.round(cosine[order], 9), [ids[j] for j in order]))


def test_isotonic_pools_violators():
    x, y = toxicity.isotonic(np.array([0.1, 0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0, 1.0]))
    assert np.allclose(y, [1 / 3, 1.0]) and np.allclose(x, [0.4 / 3, 0.35])


def toxic_corpus(n):
    """Documents of which some hold words of a small invented list, or words built on an invented stem."""
    r, bad = random.Random(5), ["zorg", "vlim", "krat"]
    rows = []
    for i in range(n):
        w, toxic = prose(r.randint(5, 80), 1000 + i).split(" "), i % 7 == 0
        if toxic:
            w[len(w) // 2 : len(w) // 2] = r.sample(bad, 2) if i % 2 else ["quorfle" + r.choice(VOCABULARY) for _ in range(3)]
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxicity_on_held_out_documents(spark, nothing):
    rows = toxic_corpus(900)
    docs = documents(spark, [(d, t) for d, t, _ in rows] + [(2000, None), (2001, ""), (None, "zorg vlim"), (2002, rows[7][1]), (2002, rows[7][1])])
    labels = spark.createDataFrame([(d, 0, y) for d, _, y in rows if d % 3] + [(None, 1, 1), (5000, 0, 1), (1, 0, None)], "doc_id long, score int, toxic int")
    out = toxicity.score_toxicity(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted", "evidence"] and out.count() == docs.count()
    got = {r.doc_id: r for r in out.collect()}
    for d, _, y in rows:
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= got[d].score <= 1 and got[d].predicted == int(got[d].score >= 0.3)
    unseen = [(got[d].predicted, y) for d, _, y in rows if got[d].held_out or not d % 3]
    assert sum(p for p, y in unseen if y) >= 0.9 * sum(y for _, y in unseen) and sum(p for p, y in unseen if not y) <= 0.02 * len(unseen)
    assert got[2000].score == got[2001].score < 0.3 and got[None].predicted == 1 and got[2002].score == got[7].score and got[7].evidence
    assert all(e.cosine <= 1.000001 and e.toxic in (0, 1) for e in got[7].evidence)
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(nothing, labels).isEmpty()


# collocations


def brute_collocations(rows, top, least, cover=80):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in (1, 2, 3, 4):
                counts[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        able = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = collections.Counter()
        for q, b in able.items():
            for m in range(2, len(q)):
                for i in range(len(q) - m + 1):
                    held[q[i : i + m]] = max(held[q[i : i + m]], b)
        best = []
        for p, a in able.items():
            if 100 * held[p] < cover * a:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("top", "ahead"), [(2000, 2), (12, 1), (3, 1)])
def test_collocations_equal_brute_force(spark, top, ahead):
    """Few words make many frequent phrases; some stand in longer ones nearly always; small tops stop before all is grown."""
    r = random.Random(11)
    few, fixed = VOCABULARY[:25], ["alpha beta gamma delta", "One two\tTHREE", "é ü ï", "in spite of"]
    text = lambda: "".join(r.choice([*few, *few, *fixed]) + r.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(r.randint(0, 90)))
    rows = [(r.choice(["aa", "aa", "bb", None, "und"]), text()) for _ in range(420)] + [("aa", None), ("bb", ""), ("cc", "only once")]
    docs = spark.createDataFrame([(i, t, g, 1, "x") for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, rank int, phrase string").repartition(5)
    got = collocations.mine_collocations(docs, top=top, least=8, ahead=ahead)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_collocations(rows, top, 8)
    assert sorted(map(tuple, got.collect())) == want and len(want) >= 2 * min(top, 12)


def test_collocations_of_awkward_tables(spark, awkward, nothing):
    assert collocations.mine_collocations(nothing).isEmpty()
    same(collocations.mine_collocations(awkward), collocations.ORACLE_SQL, documents=awkward.select("text", "lang"))
    one = spark.createDataFrame([("a b " * 40_000 + ".", None)], "text string, lang string")
    assert sorted(map(tuple, collocations.mine_collocations(one).collect())) == brute_collocations([(None, "a b " * 40_000)], 2000, 30)


def test_mix_of_ids_in_two_sources(spark):
    """The written rows of each source hold what its plan takes, also where both sources have the same ids."""
    rows = [(i, prose(1 + i % 7, i), s) for s in ("s0", "s1") for i in range(150)] + [(i, prose(5, i), "s2") for i in range(20)] + [(3, prose(4, 3), None), (None, prose(6, 1), "s1")]
    docs = documents(spark, rows)
    plan = {r.source: (r.taken, r.target) for r in mixing.mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()}
    written = {r.source: r.words for r in mixing.apply_mix(docs).groupBy("source").agg(F.sum(mixing.words_of(F.col("text"))).alias("words")).collect()}
    assert {s: t for s, (t, _) in plan.items() if t} == written
    assert all(abs(taken - target) <= 7 for taken, target in plan.values())
