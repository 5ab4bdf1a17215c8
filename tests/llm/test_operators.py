"""Each operator against a plain version or a round trip, with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweft.llm import ann, bpe, chat, common, decontam, htmltext, langid, linededup, queries, simhash, tokenbin, warc

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, fp string, n_lines string, dropped string, n int"
LONG = "word " * 30_000 + "end"


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, "x", "y", "z", 1) for k, t in rows], DOCS)


TEXTS = [(1, None), (2, ""), (3, "  \n\t "), (4, LONG), (5, "Hello world, it's 12 o'clock."), (5, "Hello world, it's 12 o'clock."), (6, "ÉCOLE straße 漢字 😀 <|endoftext|> x"), (7, "a\nb\n"), (None, "no id")]


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_bpe_equals_library(spark, table):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = [*TEXTS, *((r.doc_id + 100, r.text) for r in table.collect())]
    got = bpe.encode_texts(docs_of(spark, rows), path).collect()
    want = []
    for k, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), ids, tok.decode(ids, skip_special_tokens=False)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert bpe.encode_texts(docs_of(spark, []), path).count() == 0


def test_other_rules_are_refused():
    """A file that splits or normalises otherwise would give wrong ids."""
    for make, name in ((bpe.WordBpe, "byte_bpe_50k.json"), (tokenbin.ByteBpe, "word_bpe_49k.json")):
        with pytest.raises(ValueError, match="other rules"):
            make(queries.vocabulary(name))


def test_backtracking_equals_merging():
    w = bpe.tokenizer(queries.vocabulary("word_bpe_49k.json"))
    rnd = random.Random(3)
    for _ in range(3000):
        s = "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(1, 24)))
        piece = s[:-1] + chr(ord(s[-1]) + bpe.FINAL)
        assert w.bpe.encode(piece) == w.bpe.merge(piece)


def test_splitting_fuzz():
    from tokenizers import Tokenizer

    name = queries.vocabulary("byte_bpe_50k.json")
    mine, theirs = tokenbin.tokenizer(name), Tokenizer.from_file(name)
    word, words = bpe.tokenizer(queries.vocabulary("word_bpe_49k.json")), Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    rnd = random.Random(1)
    alphabet = [*"abcdestrvlm'''   \n\t12٣ΣςßÉéİǅ€—!?.$\x85\x1c é한😀", "'s", "'ll", " 've", "<|endoftext|>", "\r\n"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50))) for _ in range(3000)]
    for tok, lib in ((mine, theirs), (word, words)):
        ids, cuts = tok.encode_many(texts)
        for i, e in enumerate(lib.encode_batch(texts, add_special_tokens=False)):
            assert ids[cuts[i] : cuts[i + 1]].tolist() == e.ids, texts[i]


def test_elias_fano():
    rnd = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (1, 10**9), (1000, 5), (5000, 10**6), (300, 10**12)):
        v = np.sort(rnd.integers(0, top, n))
        ef, end = tokenbin.EliasFano.from_bytes(tokenbin.EliasFano.encode(v).to_bytes(), 0)
        assert ef.get(np.arange(n)).tolist() == v.tolist()
        some = rnd.permutation(n)[:50]
        assert ef.get(some).tolist() == v[some].tolist()
        if n == 5000:
            assert end < 8 * n / 2


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    name = queries.vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_file(name)
    path = tokenbin.write_shards(docs_of(spark, TEXTS), name, 2, common.fresh_path(spark, "ids"))
    got = sorted((r.doc_id is not None, r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenbin.read_documents(spark, path).collect())
    start, want = 0, []
    for k, t in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((k is not None, k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)
    tokenbin.export(spark.read.parquet(path), str(tmp_path))
    shards = [tokenbin.Shard(p.read_bytes()) for p in sorted(tmp_path.iterdir())]
    assert sum(len(s.ids) for s in shards) == start and [k for s in shards for k in s.doc_ids()] == [None, 1, 2, 3, 4, 5, 5, 6, 7]
    assert shards[0].document(0).tolist()[-1] == 2
    empty = tokenbin.write_shards(docs_of(spark, []), name, 2, common.fresh_path(spark, "ids"))
    assert tokenbin.read_documents(spark, empty).count() == 0


def plain_fingerprint(text, width):
    from xxhash import xxh64_intdigest

    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    s = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
    h = [xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, most):
    root = {k: k for k, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(prints):
        for b, y in prints[:i]:
            if (x ^ y).bit_count() <= most:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: find(k) for k, _ in prints}


def test_simhash_components(spark, table):
    rows = [(r.doc_id, r.text) for r in table.collect()]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, LONG), (1006, LONG)]
    prints = [(k, plain_fingerprint(t, 3)) for k, t in rows]
    got = simhash.components(simhash.fingerprints(docs_of(spark, rows), 3), 4, 2).collect()
    assert {r.doc_id: int(bytes(r.fp).hex(), 16) for r in got} == dict(prints)
    assert {r.doc_id: r.component_id for r in got} == plain_components(prints, 2)


def test_simhash_links_are_complete(spark):
    """Chains and thick clouds of fingerprints within two bits, against all pairs; large buckets go by masks."""
    rnd = random.Random(5)
    prints, seen = [], set()
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(60):
            x ^= sum(1 << rnd.randrange(64) for _ in range(rnd.randint(1, 3)))
            if x not in seen:
                seen.add(x)
                prints.append((len(prints), x))
    df = spark.createDataFrame([(k, bytearray(x.to_bytes(8, "big"))) for k, x in prints], "doc_id bigint, fp binary")
    want = plain_components(prints, 2)
    assert {r.doc_id: r.component_id for r in simhash.components(df, 4, 2).collect()} == want
    # Buckets that are split: all of two members, and a thick cloud that shares two blocks.
    x = rnd.getrandbits(32)
    thick = sorted({x << 32 | (rnd.getrandbits(32) & 0x1F0F0F0F) for _ in range(3000)})
    prints += [(10_000 + i, y) for i, y in enumerate(thick)]
    df = spark.createDataFrame([(k, bytearray(x.to_bytes(8, "big"))) for k, x in prints], "doc_id bigint, fp binary")
    distinct = df.withColumnRenamed("doc_id", "n")
    want = plain_components(prints, 2)
    for split in (2, 500):
        edges = simhash.links(common.staged(distinct, "d"), 4, 2, split)
        got = {r.node: r.root for r in common.connected_components(edges).collect()}
        groups, expected = {}, {}
        for k, _ in prints:
            groups.setdefault(got.get(k, k), set()).add(k)
            expected.setdefault(want[k], set()).add(k)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
    base = rnd.getrandbits(64)
    cloud = np.array(sorted({base ^ (1 << rnd.randrange(32)) ^ (1 << rnd.randrange(32)) ^ (1 << rnd.randrange(32)) for _ in range(900)}), np.uint64)
    for links in (simhash._forest_matrix(cloud[:, None], 2), simhash._forest_masks(cloud, 2)):
        root = list(range(len(cloud)))
        for a, b in links:
            root = [root[a] if r == root[b] else r for r in root]
            assert int(cloud[a] ^ cloud[b]).bit_count() <= 2
        assert len(set(root)) == len(set(plain_components(list(enumerate(map(int, cloud))), 2).values()))


def test_near_components(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    text = lambda: [rnd.choice(words) for _ in range(200)]
    a, b = text(), text()
    near = [*a[:100], "changed", *a[101:]]
    half = [*a[:100], *b[:100]]
    rows = [(i, " ".join(t)) for i, t in enumerate((a, b, near, half, a, text()))] + [(10, None), (11, "")]
    got = {r.doc_id: r.component_id for r in simhash.near_components(docs_of(spark, rows)).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3, 4: 0, 5: 5, 10: 10, 11: 10}
    assert {r.doc_id for r in simhash.one_of_each(docs_of(spark, rows)).collect()} == {0, 1, 3, 5, 10}
    assert simhash.near_components(docs_of(spark, [])).count() == 0


def test_near_components_near_the_threshold(spark):
    """Copies around a similarity of 0.8, against all pairs."""
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    texts = []
    for _ in range(60):
        base = [rnd.choice(words) for _ in range(rnd.randint(80, 400))]
        texts.append(base)
        for _ in range(3):
            share = rnd.choice([0.01, 0.015, 0.02, 0.025, 0.03])
            texts.append([rnd.choice(words) if rnd.random() < share else w for w in base])
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                p, q = sorted((root[i], root[j]))
                root = [p if r == q else r for r in root]
    got = {r.doc_id: r.component_id for r in simhash.near_components(docs_of(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    assert got == dict(enumerate(root))


def near_by_all_pairs(texts):
    """Smallest number of the texts that are linked at 0.8, from every pair of them."""
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    number = {x: k for k, x in enumerate(set().union(*sets))}
    held = np.zeros((len(texts), len(number)), np.float32)
    for i, x in enumerate(sets):
        held[i, [number[y] for y in x]] = 1
    both, size = held @ held.T, held.sum(1)
    root = list(range(len(texts)))
    for i, j in np.argwhere(5 * both >= 4 * (size[:, None] + size - both)).tolist():
        if root[i] != root[j]:
            p, q = sorted((root[i], root[j]))
            root = [p if r == q else r for r in root]
    return root


def test_near_components_of_many_edits(spark):
    """Independent edits of one original are alike only by way of it."""
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    base = [rnd.choice(words) for _ in range(204)]
    texts = [[f"new{k}" if i in at else w for i, w in enumerate(base)] for k in range(1000) for at in [{rnd.randrange(10, 195) // 10 * 10 for _ in range(3)}]]
    texts.insert(700, base)
    root = near_by_all_pairs(texts)
    got = {r.doc_id: r.component_id for r in simhash.near_components(docs_of(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    assert got == dict(enumerate(root))
    assert max(root.count(r) for r in set(root)) > 900


def test_near_components_of_short_texts(spark):
    """4 against 5 shingles and 12 against 15 are at 0.8: every pair is found."""
    texts = []
    for k in range(150):
        words = [f"w{k}x{i}" for i in range(19)]
        texts += [words[:9], words[:8]] if k % 2 else [words, words[:16]]
    got = {r.doc_id: r.component_id for r in simhash.near_components(docs_of(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    assert got == dict(enumerate(near_by_all_pairs(texts))) == {i: i // 2 * 2 for i in got}


def test_large_bucket_ends(spark):
    """A hundred thousand fingerprints that share half of their bits."""
    rng = np.random.default_rng(2)
    low = np.unique(rng.integers(0, 1 << 32, 100_000, dtype=np.uint64))
    df = spark.createDataFrame([(i, bytearray(int(x).to_bytes(8, "big"))) for i, x in enumerate(low)], "n bigint, fp binary")
    edges = [(r.a, r.b) for r in simhash.links(common.staged(df, "d"), 4, 2).collect()]
    assert edges and all(int(low[a] ^ low[b]).bit_count() <= 2 for a, b in edges)
    near = {int(x): i for i, x in enumerate(low)}
    linked = {x for e in edges for x in e}
    for i in range(0, len(low), 997):
        flips = [1 << p for p in range(32)] + [1 << p | 1 << q for p in range(32) for q in range(p)]
        assert (i in linked) == any(int(low[i]) ^ f in near for f in flips)


def test_near_components_against_all_pairs(spark):
    """Whole documents of the test data, with copies of one id, without id, and empty ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = [frozenset(np.unique(simhash.shingle_hashes((t or "").encode(), 5)).tolist()) for _, t in rows]
    where, root = {}, list(range(len(rows)))
    for i, x in enumerate(sets):
        for y in x:
            where.setdefault(y, []).append(i)
    met = {}
    for i, x in enumerate(sets):
        for y in x:
            for j in where[y]:
                if j < i:
                    met[i, j] = met.get((i, j), 0) + 1
    links = [p for p, both in met.items() if 5 * both >= 4 * (len(sets[p[0]]) + len(sets[p[1]]) - both)]
    links += [(i, sets.index(x)) for i, x in enumerate(sets) if not x]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        p, q = find(i), find(j)
        if p != q:
            root[max(p, q)] = min(p, q)
    assert [k for k, _ in rows] == sorted(k for k, _ in rows) and len(links) > 30
    got = {r.doc_id: r.component_id for r in simhash.near_components(docs).collect()}
    assert got == {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}
    same = " ".join(f"w{i}" for i in range(30))
    odd = [(1, same), (1, same), (None, same + " more"), (None, None), (2, ""), (2, "another text that is here"), (3, same)] + [(9, "all of these rows are the same row")] * 40
    assert sorted(map(repr, ((r.doc_id, r.component_id) for r in simhash.near_components(docs_of(spark, odd)).collect()))) == sorted(map(repr, [(1, 1), (1, 1), (None, 1), (None, 2), (2, 2), (2, 2), (3, 1)] + [(9, 9)] * 40))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (200, 200)] + [(300, 300 + i) for i in range(1, 40)]
    for few in (0, 20, 1000):  # by rounds alone, by both ways, by one task
        groups = {}
        for r in common.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), few=few).collect():
            groups.setdefault(r.root, set()).add(r.node)
        assert sorted(map(sorted, groups.values())) == [list(range(61)), [100, 101], list(range(300, 340))]


def plain_line_dedup(rows, min_chars, min_docs):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(strip))
    where = {}
    for k, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                where.setdefault(key(x), set()).add(k)
    out = []
    for k, t in rows:
        lines = (t or "").split("\n")
        last = lambda held: max((h for h in held if h is not None), default=None)
        kept = [x for x in lines if len(where.get(key(x), ())) < min_docs or k == last(where[key(x)])]
        out.append((k, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark, table):
    common_line = "  A line that MANY documents hold, É included, and long  "
    rows = [(r.doc_id, r.text) for r in table.collect()]
    rows += [(1000 + i, f"{common_line if i % 2 else common_line.strip()}\nown {i}\n{common_line.upper() if i == 3 else ''}") for i in range(9)]
    rows += [(2000, None), (2001, ""), (2002, "\n\n"), (2003, f"{common_line}\n{common_line}"), (2004, LONG)]
    # One id with several texts, and rows without id: each loses its own frequent lines only.
    unique = "a line that no other document holds and that is long enough"
    rows += [(1004, f"{unique}\n{common_line}"), (1004, f"keep\nkeep\n{common_line}\n{unique}"), (2003, unique), (None, f"{common_line}\n{unique} 2"), (None, f"{unique} 3\nkeep\n{common_line}"), (None, None), (1004, f"{unique}\n{common_line}")]
    want = plain_line_dedup(rows, 40, 5)
    got = linededup.dedup_lines(docs_of(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got), key=repr) == want
    assert got[0].fp == "x" and got[0].dropped == "z"
    for batches in (1, 3):
        again = linededup.dedup_lines(docs_of(spark, rows), batches=batches).collect()
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in again), key=repr) == want
    assert linededup.dedup_lines(docs_of(spark, [])).count() == 0
    assert linededup.dedup_lines(docs_of(spark, [(None, unique)] * 3), min_docs=1).where("n_dropped > 0").count() == 0


def test_runs_merge_and_antijoin(spark):
    """Runs share no hash, logs hold only known ones, and no run is shuffled or sorted when it is joined."""
    runs = linededup.Runs(spark, 4, fanout=2)
    counts = lambda a, b, i: spark.range(a, b).select(F.col("id").alias("h1"), F.col("id").alias("h2"), F.lit(1).cast("bigint").alias("n_docs"), F.lit(i).cast("bigint").alias("last"))
    with linededup.sorted_scans(spark):
        for i in range(5):
            runs.add(counts(i * 10, i * 10 + 20, i))
        held = [r.h1 for t in runs.names() for r in runs.table(t).collect()]
        assert sorted(held) == list(range(60)) and len(runs.names()) == 2
        assert [sorted(r.h1 for r in runs.table(t).collect()) for t in runs.log] == [list(range(i * 10, i * 10 + 10)) for i in range(1, 5)]
        plan = runs.unknown(runs.table(runs.log[0]))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan and "Sort [" not in plan
        hashes = counts(50, 80, 9)
        assert runs.unknown(hashes).count() == 20
        got = {r.h1: (r.n_docs, r["last"]) for r in runs.totals().collect()}
    assert got == {k: ((1, 0) if k < 10 else (1, 4) if k >= 50 else (2, k // 10)) for k in range(60)}
    runs.drop()


def test_decontamination(spark):
    item = "the quick brown fox jumps over the lazy dog while seven small cats watch from a tall warm wall"
    half = item.split()
    rows = [(1, f"before {item.upper()}! after"), (2, "nothing of it here at all really nothing"), (3, " ".join(half[9:]) + " and then other words " + " ".join(half[:9])), (4, " ".join(half[:6])), (5, None), (6, ""), (7, item + " " + LONG), (7, item)]
    bench = spark.createDataFrame([(1, item, "k"), (2, None, "k"), (3, "too short", "k"), (None, item, "k")], "item_id bigint, text string, doc_id string")
    got = decontam.contaminated(docs_of(spark, rows), bench).collect()
    want = [(1, 1.0, 1), (3, 1.0, 2), (7, 1.0, 1), (7, 1.0, 1)]
    assert sorted((r.doc_id, r.coverage, r.n_tiles) for r in got if r.item_id == 1) == sorted((r.doc_id, r.coverage, r.n_tiles) for r in got if r.item_id is None) == want
    assert len(got) == 8 and got[0].item_id in (1, None)
    # Items that share an id, ids of another type, items of fewer words than a seed.
    other = "one item that has the same id but other words in it than the first one has"
    twice = spark.createDataFrame([(1, item), (1, other), (2, "Tall, warm"), (3, "lazy"), (4, "nothing REALLY"), (5, " . "), (5, "")], "item_id int, text string")
    more = [*rows, (8, f"x {other} y")]
    found = decontam.contaminated(docs_of(spark, more).withColumn("doc_id", F.col("doc_id").cast("int")), twice).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 1), (1, 2), (1, 3), (3, 1), (3, 2), (3, 3), (7, 1), (7, 1), (7, 2), (7, 2), (7, 3), (7, 3), (8, 1)]
    assert sorted(r.doc_id for r in decontam.remove_contaminated(docs_of(spark, [*rows, (None, "x")]), bench).collect() if r.doc_id) == [2, 4, 5, 6]
    assert decontam.contaminated(docs_of(spark, rows), bench.limit(0)).count() == 0
    assert decontam.contaminated(docs_of(spark, []), bench).count() == 0


def plain_tiles(a, b, least):
    """Longest common unmarked run again and again, by trying every pair of places."""
    fa, fb, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and fa[i + n] and fb[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        out.append(n)
        fa[i : i + n] = fb[j : j + n] = [False] * n


def test_tiles_against_plain():
    """The same tiles as by trying every pair of places: texts of few words, and shuffled pieces of an item."""
    rnd = random.Random(4)
    cases = []
    for _ in range(300):
        item = [rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randint(5, 25))]
        cases.append(([rnd.choice([b"a", b"b", b"c", b"d"]) for _ in range(rnd.randint(0, 30))] + item[rnd.randint(0, 4) :], item, 3))
    for _ in range(300):
        item = [b"%d" % rnd.randrange(60) for _ in range(rnd.randint(5, 40))]
        cuts = sorted(rnd.sample(range(len(item)), min(3, len(item))))
        pieces = [item[a:b] for a, b in zip([0, *cuts], [*cuts, len(item)], strict=True)]
        rnd.shuffle(pieces)
        cases.append(([w for p in pieces for w in (*p, *[b"x"] * rnd.randint(0, 1))], item, rnd.choice([2, 5])))
    for doc, item, least in cases:
        got = decontam.tiles(doc, item, least)
        for j, i, n in got:
            assert doc[j : j + n] == item[i : i + n]
        assert [n for *_, n in got] == plain_tiles(doc, item, least)


def test_tiles_of_repetitive_texts():
    assert [n for *_, n in decontam.tiles([b"w"] * 20_000, [b"w"] * 400, 5)] == [400]


def test_decontamination_against_all_pairs(spark, table):
    """Every document with every item, and the same with an item cut up, moved and dropped into other texts."""
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    rnd = random.Random(6)
    rows = [(r.doc_id, r.text) for r in table.collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    for k in range(60):
        w = rnd.choice(items)[1].split()
        a, b = sorted(rnd.sample(range(len(w)), 2))
        rows.append((10_000 + k, " ".join([*w[b:], "so", *w[: a // 2], "and", *w[a:b], rnd.choice(rows)[1] or ""])))
    got = {(r.doc_id, r.item_id): (r.n_tiles, r.longest, round(r.coverage, 9)) for r in decontam.contaminated(docs_of(spark, rows), bench).collect()}
    want = {}
    for k, t in rows:
        doc = decontam.words((t or "").encode())
        for i, x in items:
            item = decontam.words(x.encode())
            if len({*zip(*[doc[s:] for s in range(5)], strict=False)} & {*zip(*[item[s:] for s in range(5)], strict=False)}):
                laid = plain_tiles(doc, item, 5)
                if 2 * sum(laid) >= len(item):
                    want[k, i] = (len(laid), max(laid), round(sum(laid) / len(item), 9))
    assert got == want and len(want) > 30


def test_tiles_cover_what_overlaps():
    """What a longer tile leaves of a match is a tile of its own."""
    item = [b"%d" % i for i in range(20)]
    doc = [b"x", *item[2:10], b"y", *item[8:17], b"z"]
    assert sorted(n for *_, n in decontam.tiles(doc, item, 5)) == [6, 9]
    rnd = random.Random(5)
    for _ in range(300):
        item = [b"%d" % i for i in range(rnd.randint(20, 40))]
        doc = []
        for _ in range(rnd.randint(2, 5)):
            at = rnd.randrange(len(item) - 5)
            doc += [*item[at : at + rnd.randint(5, 14)], b"x"]
        assert sum(n for *_, n in decontam.tiles(doc, item, 5)) == sum(plain_tiles(doc, item, 5))


def test_language(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(d.where(~langid.held_out()))
    got = langid.predict(d, model, ["doc_id", "lang", langid.held_out().alias("held_out")])
    assert got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.99
    odd = {r.doc_id: r for r in langid.predict(docs_of(spark, TEXTS), model, ["doc_id"]).collect()}
    assert [odd[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and odd[4].lang_pred in model.languages and 0 < odd[4].score <= 1
    named = langid.predict(docs_of(spark, TEXTS).withColumnsRenamed({"fp": "score", "n": "lang_pred"}), model, ["doc_id", "score", "lang_pred", "text"])
    assert named.columns == ["doc_id", "text", "lang_pred", "score", "ambiguous"] and 0 < named.where("doc_id = 4").first().score <= 1
    none = langid.train(d.limit(0))
    assert {r.lang_pred for r in langid.predict(docs_of(spark, TEXTS), none, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(d.limit(0), model, ["doc_id"]).count() == 0
    assert {(zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in got.collect()} == {True}


def test_codewords_differ():
    for n in (1, 2, 3, 4, 5, 9, 30):
        code = langid.codewords(n)
        assert len({tuple(c) for c in code.tolist()}) == n


def test_warc(spark):
    big = "<html>" + "x" * 2000
    fake = "a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\nWARC/1.0\r\n tail"
    rows = [(1, "http://a", big), (2, None, big), (3, "u\r\nX: y", big), (4, "d", None), (5, "e", ""), (6, "f", "same"), (7, "g", "same"), (8, "h", fake), (9, "i", fake + "é" * 900), (10, "j", fake + "é" * 900), (10, "j", fake + "é" * 900), (11, "k", "WARC/1.0\r\n"), (12, "l", "z" * 999), (13, "m", "z" * 999)]
    pages = spark.createDataFrame([(*r, "q") for r in rows], "page_id bigint, url string, html string, refers_to string")
    path = common.fresh_path(spark, "w")
    warc.write_archives(pages, path)
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.records(spark, path).collect())
    last = {}
    for k, _, h in rows:
        last[h or ""] = max(k, last.get(h or "", k))
    want = []
    for k, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 1000 and last[h or ""] != k
        want.append((k, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last[h or ""] if again else None))
    assert got == sorted(want)
    assert all(r.verified for r in warc.records(spark, path).collect())
    again = [(1, "a", big), (1, "b", fake), (1, "c", "small"), (5, "a", big), (7, "b", fake), (7, "c", "WARC/1.0\r\n" * 300), (None, "d", big), (None, None, None)]
    path = common.fresh_path(spark, "w")
    fake += "é" * 900
    warc.write_archives(spark.createDataFrame([(k, u, fake if u == "b" else h) for k, u, h in again], "page_id bigint, url string, html string"), path)
    rows = sorted(((r.page_id, r.url, r.payload_bytes, r.record_type, r.refers_to, r.verified) for r in warc.records(spark, path).collect()), key=repr)
    n = len(fake.encode())
    assert rows == sorted([(1, "a", len(big), "revisit", 5, True), (1, "b", n, "revisit", 7, True), (1, "c", 5, "response", None, True), (5, "a", len(big), "response", None, True), (7, "b", n, "response", None, True), (7, "c", 3000, "response", None, True), (None, "d", len(big), "response", None, True), (None, None, 0, "response", None, True)], key=repr)
    empty = common.fresh_path(spark, "w")
    warc.write_archives(pages.limit(0), empty)
    assert warc.records(spark, empty).count() == 0


def test_warc_small_splits(spark):
    """Many splits of one archive, with record marks inside payloads."""
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("p\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\n"), F.repeat(F.lit("y"), (F.col("id") % 50).cast("int")), F.col("id").cast("string")).alias("html"))
    path = common.fresh_path(spark, "w")
    warc.write_archives(pages.coalesce(1), path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = {r.page_id: r.payload_digest for r in warc.records(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {r.page_id: hashlib.sha1(r.html.encode()).hexdigest() for r in pages.collect()}


def test_warc_read_again_with_other_splits(spark, monkeypatch):
    """Between the two reads of a broken payload's archive the splits change."""
    pages = spark.range(200).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("p\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n"), F.repeat(F.lit("y"), (F.col("id") % 70).cast("int")), F.col("id").cast("string")).alias("html"))
    path = common.fresh_path(spark, "w")
    warc.write_archives(pages.coalesce(2), path)
    real, old = warc._rejoined, spark.conf.get("spark.sql.files.maxPartitionBytes")

    def later(*args):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1700")
        return common.staged(real(*args), "whole")

    monkeypatch.setattr(warc, "_rejoined", later)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = {r.page_id: r.payload_digest for r in warc.records(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {r.page_id: hashlib.sha1(r.html.encode()).hexdigest() for r in pages.collect()}


def test_pointer_jumping():
    start = np.array([0, 5, 7, 12, 20])
    assert warc.reachable(start, np.array([7, 12, 12, 30, 1])).tolist() == [True, False, True, True, False]
    assert warc.reachable(start + 1, np.array([7, 12, 12, 30, 1])).tolist() == [False] * 5


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site name</h2></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>The title &amp; more</h1><p>It is the first   paragraph, and it has a link to <a href="x">somewhere</a> that is one of the many in the text of the page.<br>On.
<p>Short.<div class="ad">Buy now</div><form><input name="q">Search</form><p>The last one, which is as long as the others are, and has the words that are in all of them.</p></article>
<aside>Related things</aside><section id="comments"><p>I think that this is the best of all the articles that I have read on it for a long time.</p></section><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    want = "The title & more\nIt is the first paragraph, and it has a link to somewhere that is one of the many in the text of the page. On.\nShort.\nThe last one, which is as long as the others are, and has the words that are in all of them."
    assert htmltext.main_text(PAGE) == want
    rows = [(1, "u", PAGE, 1), (2, None, None, 1), (3, "v", "", 1), (3, "v", "<p", 1), (4, "w", "<div>" * 5000 + "x", 1)]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")).collect()
    assert sorted((r.page_id, r.n_chars) for r in got)[:2] == [(1, len(want)), (2, 0)] and len(got) == 5
    long = "It is one of the things that are in the text and that we have for you, as it was with all of them. " * 4
    bare = f"<body><div><a href=a>Home</a> <a href=b>About us and more</a></div><p>{long}</p><p>So it was.</p><p>{long}</p><div><a href=c>Next page</a></div></body>"
    assert htmltext.main_text(bare) == "\n".join([long.strip(), "So it was.", long.strip()])


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 16)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(5000, None, 0), (5020, [0.0] * 16, 0), (5040, [float("nan")] * 16, 0), (5060, [1.0], 0), (5080, [None] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, part int")
    got = ann.search(df, F.expr("vec_id % 20 = 0")).collect()
    x = x.astype(np.float64)
    by = {}
    for r in got:
        by.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = 0
    for q in range(0, 4000, 20):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        best = sorted(range(4000), key=lambda i: (-s[i], i))[:20]
        mine = [by[q][k] for k in range(1, 21)]
        assert mine == sorted(mine, key=lambda t: (-t[1], t[0])) and all(abs(s[i] - v) < 1e-12 for i, v in mine)
        hits += len(set(best) & {i for i, _ in mine})
    assert set(by) == set(range(0, 4000, 20)) and hits >= 0.9 * 20 * 200
    # A query far from all leaves that it would visit is compared with all vectors.
    apart = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x[:2000], rng.normal(size=(6, 16)) * 1e-3 - 50]))]
    alone = ann.search(spark.createDataFrame(apart, "vec_id bigint, embedding array<float>, part int"), F.expr("vec_id = 2000"), target=0.05).collect()
    y = np.array([np.float32(v) for _, v, _ in apart], np.float64)
    s = (y * y[2000]).sum(1)
    s[2000] = -np.inf
    assert [r.vec_id for r in sorted(alone, key=lambda r: r["rank"])][:5] == sorted(range(2006), key=lambda i: (-s[i], i))[:5] and len(alone) == 20
    big = [(i, [1e200 * (i + 1), 1e200]) for i in range(30)]
    huge = ann.search(spark.createDataFrame(big, "vec_id bigint, embedding array<double>"), F.expr("vec_id % 20 = 0")).collect()
    assert len(huge) == 40 and all(r.score == float("inf") for r in huge)
    few = ann.search(df.where("vec_id < 5"), F.expr("vec_id % 20 = 0")).collect()
    assert [(r.query_id, r["rank"]) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1), (0, 2), (0, 3), (0, 4)]
    assert ann.search(df.limit(0), F.expr("vec_id % 20 = 0")).count() == 0


def test_balanced_cut():
    x = np.random.default_rng(1).normal(size=(1000, 8))
    part = ann.balanced_cut(x, ann.neighbour_graph(x, 10), 8)
    assert np.bincount(part, minlength=8).max() <= np.ceil(1000 / 8 * 1.05)


def test_chat(spark):
    rnd = random.Random(0)
    pieces = ["\\", "#", "###", "### ", "### Assistant: ", "</turn>", " </turn>\n", "<|image:0|>", "a", " ", "\n", ":", "é"]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "tool", None, "a: b\n", "role=x"]), rnd.choice([None, "".join(rnd.choice(pieces) for _ in range(8))])) for c in range(80) for t in range(rnd.randint(1, 6))]
    rows += [(None, 0, "assistant", "x"), (200, 0, "assistant", LONG)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1))
    formatted = chat.format_conversations(turns)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        loss = "".join(t or "" for _, _, role, t in mine if role == "assistant")
        want = (len(mine), sha("".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in mine)), len(loss), sha(loss))
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == want
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


def test_chat_parts(spark):
    parts = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
    p = lambda kind, text=None, **x: (kind, text, x.get("ref"), x.get("width"), x.get("height"), x.get("seconds"), x.get("pages"))
    said = [p("text", "see <|image:0|> "), p("image", ref="s3://i", width=56, height=29), p("audio", ref="a", seconds=1.5), p("document", ref="d", pages=3), p("text", " end")]
    df = spark.createDataFrame([(1, 0, "user", said), (1, 1, "assistant", [p("text", "ok")])], f"conv_id int, turn int, role string, parts {parts}")
    r = chat.format_conversations(df, parts_col="parts").first()
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "s3://i", 4), ("audio", "a", 38), ("document", "d", 2400)]
    assert r.expanded_tokens == 2442 and chat.placeholders(r.formatted) == [0, 1, 2]
    assert chat.read_turns(r.formatted)[0][1] == "see <|image:0|> <|image:0|><|audio:1|><|document:2|> end"


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs.count()
    for name, stage in pipeline.STAGES:
        docs = common.staged(stage(spark, docs, DATA), name)
        if name != "tokens":
            assert docs.columns == pipeline.COLUMNS
        assert 0 < docs.count() <= kept
        kept = docs.count()
    empty = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "The text of it is here", None, "s", 1)], spark.read.parquet(f"{DATA}/documents.parquet").schema)
    for _, stage in pipeline.STAGES:
        stage(spark, odd, DATA).collect()
