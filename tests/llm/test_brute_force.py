"""Verdicts, mixes and the pipeline against plain versions without Spark, and inputs that are cut, repeated or named oddly."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bestfit, common, counting, dart, exact, mixing, packing, quality, suffixes, tokenizing, urlfilter, warczip

from .test_operators import by_id, naive_classes, naive_repeats, naive_statistics, naive_verdict, words

FLOORS = np.array([s for _, s in quality.STATISTICS])


def vector(text):
    n, chars, symbols, lines, repeat = naive_statistics(text)
    return None if n < 50 or 100 * repeat > 50 * n else [np.log(n), np.log(chars / n), (symbols / n) ** 0.5, (10 * lines / n) ** 0.5, (repeat / n) ** 0.5]


def estimate(rows, factor):
    value, axes = np.linalg.eigh(factor * np.cov((rows / FLOORS).T, bias=True))
    cov = (axes * np.maximum(value, 1)) @ axes.T * np.outer(FLOORS, FLOORS)
    return rows.mean(0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]


def distances(x, centre, precision):
    gap = x - centre
    return np.einsum("ij,jk,ik->i", gap, precision, gap)


def naive_mcd(x, seed=1, tries=100):
    """Least determinant over many random starts with whole concentration steps, and the verdict after reweighting."""
    r, h, best = np.random.default_rng(seed), int(np.ceil(0.75 * len(x))), None
    for _ in range(tries):
        now = estimate(x[r.choice(len(x), 6, False)], 1.0)
        for _ in range(20):
            now = estimate(x[np.argsort(distances(x, *now[:2]), kind="stable")[:h]], quality.consistency(0.75))
        if best is None or now[2] < best[2]:
            best = now
    within = x[distances(x, *best[:2]) <= quality.chi2_quantile(0.975, 5)]
    final = estimate(within, quality.consistency(0.975))
    return best[2], distances(x, *final[:2])


def naive_kept(rows):
    """(text, lang, source) of all rows to whether each is kept, or None where the two computations may differ by rounding."""
    x = [vector(t) for t, _, _ in rows]
    sizes = collections.Counter((lang, source) for v, (_, lang, source) in zip(x, rows) if v)
    pools = collections.Counter()
    for (lang, _), n in sizes.items():
        pools[lang] += n if n < quality.MIN_GROUP else 0
    name = lambda lang, source: (lang, source, 1) if sizes[lang, source] >= quality.MIN_GROUP else (lang, 2) if pools[lang] >= quality.MIN_GROUP else 3
    groups = collections.defaultdict(list)
    for i, (v, (_, lang, source)) in enumerate(zip(x, rows)):
        if v:
            groups[name(lang, source)].append(i)
    out, cut = [v is not None for v in x], quality.chi2_quantile(1 - quality.ALPHA, 5)
    for held in groups.values():
        if len(held) >= quality.MIN_GROUP:
            for i, d in zip(held, naive_mcd(np.array([x[i] for i in held]))[1]):
                out[i] = None if 0.7 * cut < d < 1.4 * cut else bool(d <= cut)
    return out


def test_quality_verdicts(docs):
    r, rows = random.Random(3), []
    for i in range(150):
        rows.append((words(i, r.randint(80, 600)), r.choice(["en", None]), r.choice(["a", "b", "c", None])))
    rows += [(" | ".join(words(i, 80).split()) + " $ # | * " * 20, "en", "a") for i in range(8)] + [(words(1, 60).replace(" ", "\n") + "\na" * 30, "en", "b")] * 3
    rows += [(words(i, 90), "fr", f"s{i}") for i in range(30)] + [(words(i, 90), "de", "x") for i in range(3)]
    out = by_id(quality.robust_outliers(docs(*[(i, *row) for i, row in enumerate(rows)])))
    want = naive_kept(rows)
    assert sum(w is None for w in want) < 5 and any(w is False and not out[i].base_failed for i, w in enumerate(want))
    assert all(w is None or out[i].kept == w for i, w in enumerate(want))


def test_quality_on_real_documents(spark, monkeypatch):
    """Groups of their own, with determinants as small as the best of many random starts."""
    docs = common.documents(spark, "/root/testdata/sf0.01")
    rows = [(r.text, r.lang, r.source) for r in docs.orderBy("doc_id").collect()]
    ids = [r.doc_id for r in docs.select("doc_id").orderBy("doc_id").collect()]
    assert any(n >= quality.MIN_GROUP for n in collections.Counter((a, b) for t, a, b in rows if vector(t)).values())
    out, want = by_id(quality.robust_outliers(docs)), naive_kept(rows)
    told = [(i, w) for i, w in zip(ids, want) if w is not None]
    assert len(told) > 0.97 * len(ids) and sum(out[i].kept == w for i, w in told) >= 0.998 * len(told)
    x = np.array([v for t, _, _ in rows if (v := vector(t))])
    vectors = spark.createDataFrame([("g", v) for v in x.tolist()], "group string, x array<double>")
    best = quality.least_determinants((vectors, len(x)), spark.createDataFrame([("g", len(x))], "group string, n long")).first()
    assert best.logdet < naive_mcd(x, tries=40)[0] + 0.15


def naive_mix(rows, order):
    """rows: id, text, source, in the order that documents follow one another in (order: numbers); words taken of each."""
    sizes = [len((t or "").encode("utf-8", "surrogatepass").split()) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = [sum(n for n, (*_, s) in zip(sizes, rows) if s == name) for name in names]
    goal = mixing.targets(total, [(3.0, 1.0, 2.0)[i % 3] for i in range(len(names))])
    held = []
    for name in names:  # a source's words, each by its document, in blocks
        flat = [i for i in sorted(range(len(rows)), key=lambda i: order[i]) if rows[i][2] == name for _ in range(sizes[i])]
        held.append([flat[a : a + mixing.BLOCK] for a in range(0, len(flat), mixing.BLOCK)])
    want = np.array([g * len(b) / n if n else 0.0 for g, b, n in zip(goal, held, total)])
    slots, taken = round(want.sum()), collections.Counter()
    shards = -(-slots // mixing.SHARD)
    counts = [sum(int(mixing.shard_counts(want / want.sum(), slots // shards + (j < slots % shards), (mixing.SEED, j))[s]) for j in range(shards)) for s in range(len(names))]
    for s, blocks in enumerate(held):
        turns = [mixing.permuted(np.arange(len(blocks)), len(blocks), mixing.hash_key(mixing.SEED, s, t)) for t in (0, 1)]
        for k in range(min(counts[s], 2 * len(blocks))):
            taken.update(blocks[turns[k // len(blocks)][k % len(blocks)]])
    return goal, [taken[i] for i in range(len(rows))]


def following(spark, rows):
    """The order that documents follow one another in, which only Spark's hash tells."""
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, doc_id long, text string, source string").withColumn("key", common.row_key())
    return [(r.b, r.key, r.doc_id is not None, r.doc_id, r.i) for r in frame.withColumn("b", F.pmod(F.xxhash64("key", "doc_id"), F.lit(256))).orderBy("i").collect()]


def test_mix_equals_a_plain_one(spark, docs):
    r = random.Random(2)
    rows = [(i, words(i, r.randint(0, 400)), r.choice(["a", "b", "é", None])) for i in range(120)] + [(None, "x y z", "a"), (7, "w", "tiny"), (500, None, "b"), (8, "x y", "a"), (8, "x y", "a")]
    out = mixing.mix_report(docs(*[(i, t, "en", s) for i, t, s in rows])).collect()
    goal, taken = naive_mix(rows, following(spark, rows))
    assert collections.Counter((x.doc_id, x.source, x.taken) for x in out) == collections.Counter((i, s, n) for (i, _, s), n in zip(rows, taken))
    assert sorted({x.target for x in out}) == sorted(set(goal))


def test_mix_does_not_depend_on_splits(spark, docs, tmp_path):
    """Files, their order, splits and partitions differ; the words taken of each document do not."""
    r, seen = random.Random(4), []
    rows = [(i, words(i, r.randint(0, 200)), "en", r.choice(["a", "b", None])) for i in range(300)] + [(3, "same", "en", "a")] * 4
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for files, partitions, size in ((1, 2, "128m"), (5, 7, "4k"), (9, 3, "16k")):
            r.shuffle(rows)
            docs(*rows).repartition(files).write.parquet(str(tmp_path / str(files)))
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            d = spark.read.parquet(str(tmp_path / str(files)))
            seen.append((sorted((x.doc_id, x.taken) for x in mixing.mix_report(d).collect()), sorted((x.doc_id, x.text) for x in mixing.mixed_texts(d).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[1])
    assert seen[0] == seen[1] == seen[2]


def test_exact_batches_can_be_added_again(spark, docs, tmp_path):
    r = random.Random(1)
    first = docs(*[(i, words(r.randint(0, 700), 3)) for i in range(1000)])
    index = exact.DigestIndex(spark, str(tmp_path / "index"), 4)
    once = sorted(map(tuple, index.add(first).collect()))
    kept = sum(x[3] for x in once)
    assert 0 < kept < 1000 and index.rows().count() == kept
    again = exact.DigestIndex(spark, str(tmp_path / "index"))  # after a lost driver
    assert sorted(map(tuple, again.add(first).collect())) == once and again.rows().count() == kept
    more = again.add(docs((5000, words(2000, 3)), (5001, words(2000, 3)), (5002, first.first().text))).collect()
    assert sorted((x.doc_id, x.kept) for x in more) == [(5000, True), (5001, False), (5002, False)] and again.rows().count() == kept + 1
    assert [x.kept for x in again.add(docs((5002, "a"), (5003, "a")), batch="x").collect()].count(True) == 1


def test_exact_index_is_not_shuffled(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(exact, "FILES", 1)
    index = exact.DigestIndex(spark, str(tmp_path / "index"), 64, per_bucket=10)
    index.add(docs(*[(i, f"text {i}") for i in range(300)]))
    groups = spark.createDataFrame([(b"x", 1)], "digest binary, n long")
    before = spark.conf.get(exact.ORDERED)
    spark.conf.set(exact.ORDERED, "true")
    plan = index.unknown(groups, "other")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(exact.ORDERED, before)
    joined = plan[plan.index("SortMergeJoin") :]
    assert joined.count("Exchange") == 1 and joined.count("Sort [") == 1  # both of the batch's side
    assert joined.index("Exchange") < joined.index("FileScan") or "Bucketed: true" in joined
    index.add(docs(*[(i, f"more {i}") for i in range(500)]))
    assert index.meta["buckets"] == 128 and index.meta["generation"] == 1 and index.rows().count() == 800
    for k in range(exact.FILES + 1):  # many small batches are put together
        index.add(docs((10_000 + k, f"batch {k}")))
    assert index.rows().count() == 802 and index.meta["generation"] >= 2
    again = exact.DigestIndex(spark, str(tmp_path / "index"))
    assert again.meta == index.meta and again.rows().count() == 802


NAMES = ["v", "label", "g", "key", "row", "parts", "pass", "rank", "s", "size", "a.b", "x`y", "__id", "__key", "__row", "__rest", "digest", "kept", "pair", "group", "sha1", "keys", "host", "found"]


@pytest.fixture()
def odd(spark):
    """Documents with columns of all names that operators use themselves."""

    def make(rows):
        full = [(i, t, "en", s, 0, *[k] * len(NAMES)) for k, (i, t, s) in enumerate(rows)]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c.replace('`', '``')}` int" for c in NAMES))

    return make


def test_clashing_columns_repeated_rows_and_null_ids(spark, odd):
    rows = [(i, words(i % 30, 60), "a") for i in range(40)] + [(None, "x y", "b"), (None, "x y", "b"), (None, None, None), (3, words(3, 60), "a"), (3, "", "a")]
    d, n = odd(rows), len(rows)
    assert quality.robust_outliers(d).count() == suffixes.remove_repeats(d).count() == mixing.mix_report(d).count() == exact.exact_dedup(d).count() == n
    assert dart.near_classes(d).count() == counting.token_counts(d).count() == n and {x.doc_id for x in packing.pack(d).collect()} == {i for i, *_ in rows}
    assert bestfit.pack_to_files(d).count() == n
    for drop, left in ((quality.drop_outliers, {i for i in range(40)}), (exact.drop_copies, {*range(30), None, 3}), (dart.drop_near_copies, {*range(30), None, 3})):
        out = drop(d)
        assert out.columns == d.columns
        got = out.select("doc_id", "text", F.col("`a.b`").alias("k"), F.col("`x``y`").alias("l")).collect()
        assert {x.doc_id for x in got} == left and all(rows[x.k][:2] == (x.doc_id, x.text) and x.k == x.l for x in got)
        assert len({x.k for x in got}) == len(got)
    assert len(exact.drop_copies(d).filter("doc_id is null").collect()) == 1  # of "x y"; the null text equals 3's empty one, which stays
    mixed = mixing.mixed_texts(d)
    assert mixed.columns == d.columns and all(x.text and x["a.b"] == x["x`y"] for x in mixed.collect())
    pages = spark.createDataFrame([(1, "http://net/es/", "h", 1, 1, 1, 1), (None, None, None, 1, 1, 1, 1), (None, None, None, 1, 1, 1, 1), (1, "http://net/es/", "h", 1, 1, 1, 1)], "page_id long, url string, html string, keys int, host int, sha1 int, `a.b` int")
    assert [x.verdict for x in urlfilter.judge(pages).collect()] == ["block", "allow", "allow", "block"]
    assert sorted((x.page_id or 0, x.payload_bytes, x.record_type) for x in warczip.round_trip(pages).collect()) == [(0, 0, "response")] * 2 + [(1, 1, "response")] * 2


def test_very_long_texts(docs, monkeypatch):
    """Pieces are far smaller than the texts, so all bounds inside texts are met."""
    monkeypatch.setattr(suffixes, "PIECE", 1 << 12)
    monkeypatch.setattr(dart, "PIECE", 1 << 9)
    base = words(5, 18_000)
    texts = [base, base[:100_000] + " tail", words(7, 100) + base[5000:9000], "é" * 60_000, " ".join(["ab"] * 40_000), "z" * 110_000]
    d = docs(*enumerate(texts))
    out = by_id(suffixes.remove_repeats(d))
    assert [tuple(out[i])[1:] for i in range(len(texts))] == naive_repeats(texts, 200)
    assert [tuple(by_id(quality.robust_outliers(d))[i])[1:6] for i in range(len(texts))] == [naive_statistics(t) for t in texts]
    assert [by_id(dart.near_classes(d))[i].class_id for i in range(len(texts))] == naive_classes(texts)
    lib = tokenizing.library(tokenizing.DEFAULT)
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert [by_id(counting.token_counts(d))[i].n_tokens for i in range(len(texts))] == list(map(len, want))
    for x in [*packing.pack(d).collect(), *bestfit.pack_to_files(d, end_id=0).collect()]:
        assert x.ids_crc32 == zlib.crc32(np.array([*want[x.doc_id], 0][x.start : x.start + x.length], "<u4").tobytes())
    shas = {x.doc_id: x.text_sha256 for x in exact.exact_dedup(d).collect()}
    assert shas == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts)}
    assert sum(x.taken for x in mixing.mix_report(d).collect()) > 0


def test_previous_factors_against_brute_force():
    r = random.Random(9)
    for _ in range(60):
        texts, at, where = [], [], 0
        for _ in range(r.randint(1, 6)):
            texts.append(bytes(r.choice(b"ab") for _ in range(r.randint(0, 40))))
            at.append(where)
            where += r.choice([0, len(texts[-1]) // 2, len(texts[-1]) + 9]) if len(texts[-1]) else 7
        depth, first = r.randint(2, 9), np.cumsum([0, *map(len, texts)])
        starts = [(first[k] + i, at[k] + i, t[i : i + depth]) for k, t in enumerate(texts) for i in range(len(t) - depth + 1)]
        hits, sources = suffixes.previous_factors(texts, np.array(at, np.int64), depth)
        place = {s: (p, x) for s, p, x in starts}
        assert set(hits.tolist()) == {s for s, p, x in starts if any(y == x and q < p for _, q, y in starts)}
        assert all(place[h][1] == place[s][1] and place[s][0] < place[h][0] for h, s in zip(hits.tolist(), sources.tolist()))


def test_table_of_lengths():
    r = random.Random(2)
    held = {"".join(r.choice("abé漢\n") for _ in range(r.randint(1, 9))): r.randint(1, 30) for _ in range(3000)}
    held = {w: n for w, n in held.items() if len(w.encode()) <= 16}
    table = counting.Lengths([*held, "x" * 17, ""], [*held.values(), 5, 5])
    asked = [*held, *("".join(r.choice("abé漢\n") for _ in range(r.randint(1, 5))) for _ in range(2000))]
    asked = [w for w in asked if len(w.encode()) <= 16]
    data = " ".join(asked).encode()
    size = np.array([len(w.encode()) for w in asked])
    start = np.cumsum(size + 1) - size - 1
    assert table.find(table.padded(data), start, size).tolist() == [held.get(w, -1) for w in asked]
    assert counting.Lengths([], []).find(table.padded(b"a"), np.array([0]), np.array([1])).tolist() == [-1]


def test_frequent_stretches_are_of_the_whole_corpus(docs, monkeypatch):
    seen = []
    monkeypatch.setattr(counting, "Lengths", lambda w, n: seen.append(w))
    counting.frequent_counts(docs(*[(i, f"first common w{i} " + " ".join(f"r{i}x{j}" for j in range(50))) for i in range(400)]), size=2, summary=8)
    assert seen == [["common", "w0"]] or seen[0][0] == "common"


def test_long_lists_of_urls_are_joined(spark):
    r = random.Random(4)
    rules = urlfilter.RULES + [(r.choice(["allow", "block"]), f"h{i}.{t}", f"/{'ab'[: i % 3]}") for i in range(60) for t in ("org", "com")]
    rules += [("allow", "twice.org", "/"), ("block", "twice.org", "/")]
    urls = [None, "", "http://twice.org/x"] + [f"https://{r.choice(['', 'www.'])}h{r.randint(0, 90)}.{r.choice(['org', 'com', 'net'])}/{r.choice(['a', 'ab', 'b', ''])}" for _ in range(400)] * 2
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for most in (urlfilter.MAX_BYTES, 4):
        out = by_id(urlfilter.judge(pages, rules, most), "page_id")
        assert [tuple(out[i])[1:] for i in range(len(urls))] == [naive_verdict(u, rules) for u in urls]


def test_pipeline_equals_plain_stages(spark, docs, tmp_path):
    """Every stage's rows against a version without Spark, on what the stage before it kept."""
    r, rows = random.Random(11), []
    for i in range(80):
        rows.append((i, words(i, r.randint(60, 300)), "en", f"s{i % 2}"))
    rows += [(100 + i, rows[i][1].replace(" ", "\t", 3), "en", "s0") for i in range(10)] + [(None, rows[5][1], "en", "s1")]
    rows += [(200 + i, rows[i][1].replace(rows[i][1].split()[9], "edit"), "en", "s1") for i in range(20, 30)]
    rows += [(300, "too short", "en", "s0"), (301, None, None, None), (302, " | ".join(words(1, 90).split()), "en", "s0"), (303, "a b c d " * 40, "en", "s1")]
    at = docs(*rows).drop("digest")
    held = sorted(((i, t, s) for i, t, _, s in rows), key=str)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        got = at.collect()
        if name == "quality":
            verdict = naive_kept([(t, "en" if t or i != 301 else None, s) for i, t, s in held])
            held = [h for h, k in zip(held, verdict) if k or k is None and any((x.doc_id, x.text) == h[:2] for x in got)]
        elif name == "exact_dedup":
            first = {}
            for h in sorted(held, key=lambda h: (h[0] is None, h[0])):
                first.setdefault(" ".join(h[1].split()), h)
            held = sorted(first.values(), key=str)
        elif name == "near_dedup":
            held.sort(key=lambda h: (h[0] is None, h[0]))
            classes = naive_classes([t for _, t, _ in held])
            held = sorted((h for k, h in enumerate(held) if classes[k] == k), key=str)
        elif name == "mix":
            _, taken = naive_mix(held, following(spark, held))
            counts, texts = collections.Counter(), collections.defaultdict(list)
            for x in got:
                counts[x.doc_id] += len(x.text.split())
                texts[x.doc_id].append(x.text)
            assert counts == +collections.Counter({h[0]: n for h, n in zip(held, taken)})
            of = {h[0]: h[1] for h in held}
            assert all(part in of[i] for i, parts in texts.items() for t in parts for part in t.split("\n"))
            mixed = got
        else:
            lib, ids = tokenizing.library(tokenizing.DEFAULT), collections.Counter()
            for x in mixed:
                whole = [*lib.encode(x.text, add_special_tokens=False).ids, 0]
                for k, (a, n) in enumerate(packing.piece_bounds(len(whole), 2048)):
                    ids[x.doc_id, k, a, n, zlib.crc32(np.array(whole[a : a + n], "<u4").tobytes())] += 1
            assert ids == collections.Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got)
            places = collections.defaultdict(list)
            for x in got:
                places[x.sequence_id].append((x.offset, x.length))
            assert all([o for o, _ in sorted(p)] == [0, *np.cumsum([n for _, n in sorted(p)])[:-1]] and sum(n for _, n in p) <= 2048 for p in places.values())
            assert len(places) <= -(-sum(x.length for x in got) // 2048) + 1
        if name in ("quality", "exact_dedup", "near_dedup"):
            assert sorted(((x.doc_id, x.text, x.source) for x in got), key=str) == held, name
