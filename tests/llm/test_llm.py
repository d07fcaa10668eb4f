"""Operators of the llm subpackage against brute force, and their edge cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkweave.llm import ann, bpe, decontamination, licences, lm, pii, quality, sharding, simhash, urls
from linkweave.llm.common import materialise

SF = "/root/testdata/sf0.001"


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="module")
def docs(spark):
    """Real documents with nulls, empty and repeated texts and rows, a long text and clashing extra columns."""
    real = read(spark, "documents").select("doc_id", "text", "lang", "source", "n_chars").limit(60)
    odd = spark.createDataFrame(
        [(1000, None, "en", None, 0), (1001, "", None, "s", 0), (1002, "same words here", "en", "s", 1), (1003, "same words here", "en", "s", 1), (1004, "a b " * 20000, "en", "s", 1), (None, "x@y.zz mit license", "en", "s", 1), (1002, "same words here", "en", "s", 1)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    return real.unionByName(odd).withColumns({"key": F.lit(1), "digest": F.lit("d"), "node": F.lit(2.5), "fp": F.lit("f"), "score": F.lit(0)}).repartition(4).cache()


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def groups(links, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


def test_simhash_components(docs):
    rows = [(i, simhash.simhash64(t)) for i, t in texts(docs)]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (rows[a][1] ^ rows[b][1]).bit_count() <= 2]
    root = groups(links, range(len(rows)))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    want = sorted((str(i), f"{fp:016x}", str(least.get(root[k]))) for k, (i, fp) in enumerate(rows))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.simhash_components(docs).collect())
    assert got == want


def test_near_duplicates(spark):
    d = spark.createDataFrame(_families(), "doc_id long, text string")
    sets = {i: set(simhash.shingle_set(t, 5).tolist()) for i, t in _families()}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = groups(links, list(sets))
    for block in (simhash.BLOCK, 8):  # the second cuts groups into chunks
        got = collections.defaultdict(set)
        for r in simhash.near_duplicates(d, block=block).collect():
            got[r.class_id].add(r.doc_id)
        assert {frozenset(v) for v in got.values()} == {frozenset(i for i in want if want[i] == r) for r in set(want.values())}


def _families():
    rng = np.random.default_rng(0)
    out = []
    for f in range(4):
        base = [f"w{x}" for x in rng.integers(0, 5000, 80)]
        for k in range(15):
            words = list(base)
            for at in rng.integers(0, 80, k // 3):
                words[at] = f"n{rng.integers(0, 9999)}"
            out.append((len(out), " ".join(words)))
    return out


def test_drop_near_duplicates(docs):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [(r.doc_id, r.text) for r in kept.collect()]
    assert sum(t == "same words here" for _, t in ids) == 1 and sum((t or "") == "" for _, t in ids) == 1


def test_bpe_equals_the_library(docs):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(bpe.default_path()), bpe.Codec(bpe.default_path())
    rng = np.random.default_rng(1)
    parts = ["a", "b", " ", "  ", "\n", "é", "日", "1", "'s", "!!", "<|endoftext|>", "\x1c", "\x85", "　", "😀", "the", " of"]
    cases = [t for _, t in texts(docs)] + ["".join(rng.choice(parts, rng.integers(1, 800))) for _ in range(200)]
    for t in cases:
        want = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want and own.decode(want) == lib.decode(want, skip_special_tokens=False)
    got = {(r.doc_id, r.ids_sha256, r.n_tokens) for r in bpe.token_digests(docs).collect()}
    assert got == {(i, hashlib.sha256(",".join(map(str, (x := own.encode(t)))).encode()).hexdigest(), len(x)) for i, t in texts(docs)}
    coded = bpe.encode_documents(docs)
    assert coded.columns == [*docs.columns, "token_ids"] and coded.count() == docs.count()


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(t):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, t):
            v, d = m.group(0), re.sub("[^0-9]", "", m.group(0))
            luhn = sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_personal_data(spark, docs):
    rng = np.random.default_rng(2)
    parts = [*"0123456789..--  @+()ab%é😀", "4111111111111111", "1.2.3.4", "a@b.c", "+1 (743) 555-3824"]
    extra = spark.createDataFrame([(k + 5000, "".join(rng.choice(parts, 40))) for k in range(300)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    want = {i: hashlib.sha256(plain_spans(t).encode()).hexdigest() for i, t in texts(both)}
    assert all(want[r.doc_id] == r.base_sha256 for r in pii.span_digests(both).collect())


def test_disclosing_terms(spark):
    rows = [(k, f"number {k} contact blorptag a@b.cc today") for k in range(6)] + [(100 + k, f"plain text today number {k}") for k in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(d).collect()}
    assert "blorptag" not in clean[0] and "[EMAIL]" in clean[0] and "today" in clean[0] and clean[100] == rows[6][1]


def test_disclosing_terms_in_whole_documents(spark):
    far = " ".join(f"filler{k}" for k in range(12))
    rows = [(k, f"note {k} Blorptag a@b.cc {far} zorgled then blorptag again") for k in range(6)]
    rows += [(50, "Zorgled without the address, and BLORPTAG"), (51, "blorptagged zorgled2 stay")]
    rows += [(100 + k, f"plain {far} then again note {k}") for k in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(d).collect()}
    assert clean[0] == f"note 0 [TERM] [EMAIL] {far} [TERM] then [TERM] again" and clean[50] == "[TERM] without the address, and [TERM]"
    assert clean[51] == rows[7][1] and clean[100] == rows[8][1]
    got = {r.doc_id: r for r in pii.span_digests(d).collect()}
    assert got[50].spans == "term:0:7,term:33:41" and got[0].n_term == 3


def test_licences(docs):
    for r in licences.scan_licences(docs).collect():
        t = next(t for i, t in texts(docs) if i == r.doc_id)
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t))
        at = [k for p in licences.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))


def test_licences_whatever_their_frequency(spark):
    header = "Licensed under the Apache License, Version 2.0"
    every = ", ".join(t for _, t, _ in licences.TEMPLATES)
    d = spark.createDataFrame([(k, f"{header} file {k}") for k in range(5)] + [(9, f"notice: {every}")], "doc_id long, text string")
    for rows in (d, d.where("doc_id < 4"), d.where("doc_id in (0, 9)")):
        for r in licences.scan_licences(rows).collect():
            want = {"apache", "apache-2.0"} if r.doc_id < 9 else {x for x, _, _ in licences.TEMPLATES} | set(licences.PHRASES.values())
            assert set(r.labels.split(",")) == want and r.score == 1.0


def test_sharding(spark, docs):
    for d, limit in ((docs.select("doc_id", "text"), 50_000), (spark.createDataFrame([(7, "x" * 400)] * 50 + [(8, "y" * 5000)], "doc_id long, text string"), 1000)):
        found = sharding.shard_of(d, limit).collect()
        size = collections.defaultdict(list)
        for r in found:
            size[r.shard, r.part].append(r.bytes)
        assert len(found) == d.count() and all(sum(v) <= limit or len(v) == 1 for v in size.values())
        names = {s for s, _ in size}
        assert not any(a != b and b.startswith(a) for a in names for b in names)  # prefix-free


def test_urls(spark):
    cases = [("http://WWW.Example.com/en/1?x", "www.example.com/en/", "allow"), ("http://example.com/en/", "example.com/en/", "block"), ("http://a.net/fr/x", "net/fr/", "block"), ("http://x.com", None, None), (None, None, None), ("nothing", None, None), ("ftp://b.com/#f", "com/", "allow")]
    d = spark.createDataFrame([(k, u) for k, (u, _, _) in enumerate(cases)], "page_id long, url string")
    got = {r.page_id: r for r in urls.judged(d).collect()}
    for k, (_, rule, verdict) in enumerate(cases):
        assert got[k].rule == rule and got[k].verdict == (verdict or got[k].verdict) and got[k].verdict in ("allow", "block")


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "If train A runs 60 km in 2 hours and then again 60 km more, how far does Alice go in total today?"), (2, "short one"), (3, None)], "item_id long, text string")
    d = spark.createDataFrame(
        [(1, "xx If train A runs 75 km in 3 hours and then again 75 km more, how far does Bob go in total today? yy"), (2, "If train A runs 75 km in 3 hours and then again 80 km more, how far does Bob go in total today?"), (3, "a short one b"), (4, None), (6, "short, one!")],
        "doc_id long, text string",
    )
    assert {(r.doc_id, r.item_id, r.exact) for r in decontamination.leaks(d, items).collect()} == {(1, 1, False), (6, 2, True)}
    # The template's opening with other values, before the item itself: places are judged apart.
    both = "If train A runs 75 km in 3 hours and then again it stops. " + items.first().text
    again = spark.createDataFrame([(5, both), (5, both)], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.exact, r.coverage) for r in decontamination.leaks(again, items).collect()] == [(5, 1, True, 1.0)]
    docs, bench = read(spark, "documents"), read(spark, "benchmark")
    texts_ = {r.item_id: r.text for r in bench.collect()}
    want = {(r.doc_id, k) for r in docs.collect() for k, t in texts_.items() if t in r.text}
    assert want <= {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()}


def test_decontamination_of_openings_numbers_and_parts(spark):
    tom = "Tom has 5 apples. Tom gives 2 to Ann. How many apples does Tom have now?"
    shop = "a shop earned 900 dollars in one week and then spent 40 of it on paint, so what is left over?"
    long = " ".join(f"word{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}" for k in range(80))
    ground, carried = "the old miller ground 7 sacks of wheat before noon and then", "he carried 7 of them over to the bridge at night alone"
    earlier = ground.replace("7", "8") + " far" * 60
    items = spark.createDataFrame([(1, tom), (2, shop), (3, long), (4, f"{ground} {carried}")], "item_id long, text string")
    d = spark.createDataFrame(
        [(1, tom.replace("Tom", "Ben")), (2, shop.replace("900", "1,250.50").replace("40", "3.5")), (3, " ".join(long.split()[20:50])),
         (4, f"{earlier} {ground} quite some time {carried}"), (5, tom.replace("Tom has", "Ben has").replace("does Tom", "does Max"))],
        "doc_id long, text string",
    )
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(d, items).collect()} == {(k, k) for k in range(1, 5)}


def test_quality_held_out(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.classify(d, l.where("doc_id % 4 <> 0")).toPandas().set_index("doc_id")
    test = l.where("doc_id % 4 = 0").toPandas().set_index("doc_id").join(found)
    assert ((test.low_probability >= 0.5) == (test.quality == 0)).mean() > 0.9
    assert not test[(test.quality == 1) & (test.toxic == 0)].rejected.mean() > 0.05


def test_quality_edges(spark, docs):
    none = read(spark, "labels").limit(0)
    assert quality.reject_low_quality(docs, none).count() == docs.count()
    assert quality.classify(docs, read(spark, "labels")).count() == docs.count()


def test_neighbours(spark):
    e = read(spark, "embeddings")
    p = e.toPandas().sort_values("vec_id")
    x, ids = np.array(p.embedding.tolist(), float), p.vec_id.to_numpy()
    got = collections.defaultdict(list)
    for r in ann.search(e).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = 0
    for k in np.nonzero(ids % 20 == 0)[0]:
        s = x @ x[k]
        s[k] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(got[ids[k]]))
    assert hits / (20 * len(got)) >= 0.9
    odd = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (20, [0.0, 0.0]), (3, None), (40, [1.0, None]), (5, [float("nan"), 1.0]), (60, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in ann.search(odd).orderBy("query_id", "rank").collect()] == [(0, 60), (0, 1), (60, 0), (60, 1)]


@pytest.mark.parametrize("kind", ["wide", "lengths"])
def test_neighbours_are_exact(spark, kind):
    """More dimensions than the codes have bits for and vectors of very different lengths: the same rows as brute force."""
    rng = np.random.default_rng(5)
    n, d = (4000, 128) if kind == "wide" else (3000, 32)
    x = rng.normal(size=(n, d)) * (1 if kind == "wide" else 10 ** rng.uniform(-3, 3, n)[:, None])
    e = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.search(e).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert len(got) == n // 20
    for k in range(0, n, 20):
        s = ann.exact_scores(x, x[k])
        s[k] = -np.inf
        assert got[k] == np.lexsort((np.arange(n), -s))[:20].tolist()


def test_language_model(docs):
    c = collections.Counter()
    for i, t in texts(docs):
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            c.update(t.encode().lower().split() + ["\n"])
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for i, t in texts(docs):
        words = t.encode().lower().split() + ["\n"]
        want[i, len(words), sum(c[w] > 0 for w in words), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), 3)] += 1
    got = lm.score_documents(docs).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_language_model_learns_from_all(spark):
    # The order of words in documents beyond the warm-up and any one share of one in eight; the counts stay the same.
    rng = np.random.default_rng(3)
    d = spark.createDataFrame([(k, " ".join(f"w{x}" for x in rng.integers(0, 50, 12))) for k in range(1000)], "doc_id long, text string")
    ids = d.where(~lm.held_out(F.col("doc_id")))
    warm = {r.doc_id for r in ids.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(lm.WARM).collect()}
    beyond = [r.doc_id for r in ids.where(F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(8)) != 0).collect() if r.doc_id not in warm]
    turned = F.when(F.col("doc_id").isin(beyond), F.array_join(F.reverse(F.split("text", " ")), " ")).otherwise(F.col("text"))
    one, two = ({r.doc_id: r for r in lm.score_documents(x.repartition(2, "doc_id")).collect()} for x in (d, d.withColumn("text", turned)))
    same = [k for k in one if k not in beyond]
    assert len(beyond) > 100 and all(one[k].base_score == two[k].base_score for k in same)
    assert any(one[k].score != two[k].score for k in same)


def test_empty_tables(spark):
    d = read(spark, "documents").limit(0)
    for f in (simhash.simhash_components, bpe.token_digests, pii.span_digests, licences.scan_licences, sharding.shard_of, lm.score_documents, simhash.drop_near_duplicates, pii.sanitise):
        assert f(d).count() == 0, f.__name__
    assert urls.judged(read(spark, "pages").limit(0)).count() == 0 and ann.search(read(spark, "embeddings").limit(0)).count() == 0
    assert decontamination.leaks(d, read(spark, "benchmark")).count() == 0 and quality.classify(d, read(spark, "labels")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = read(spark, "documents")
    out = corpus_pipeline.run(spark, SF).collect()
    kept = {r.doc_id: r for r in out}
    assert len(kept) == len(out) and set(docs.columns) < set(out[0].asDict())
    bench = [r.text for r in read(spark, "benchmark").collect()]
    own = bpe.Codec(bpe.default_path())
    for r in out:
        assert not any(b in r.text for b in bench) and plain_spans(r.text) == "" and own.decode(r.token_ids) == r.text
    assert len({r.text for r in out}) == len(out)


def test_decontamination_of_number_runs(spark):
    run = " ".join(str(1000 + 7 * k) for k in range(100))
    items = spark.createDataFrame([(k, run.replace("1000", str(k))) for k in range(5)] + [(9, "yes")], "item_id long, text string")
    d = spark.createDataFrame([(1, " ".join(str(k) for k in range(3000))), (2, f"see {run.replace('1000', '3')} there"), (3, "oh yes it is"), (4, "yes.")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(d, items).collect()} == {(2, 3), (4, 9)}


def test_url_tree(spark):
    def found(rows):
        d = spark.createDataFrame([(k, u) for k, u in enumerate(rows)], "page_id long, url string")
        return {r.template for r in urls.judged(d).collect()}

    names = [f"http://a.org/p/{c * 3}" for c in "abcdefghij"]
    assert found(names) == found(names * 3) == {"/p/*"}
    pairs = [f"http://a.org/u/{a * 3}/{b * 4}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    assert found(pairs) == {"/u/*/*"}
    assert found(["http://a.org/x/1", "http://a.org/y"]) == {"/x/{n}", "/y"}
    # Given labels: one branch is bad throughout, and pages of it without a label are blocked.
    pages = spark.createDataFrame([(k, f"http://b.org/{'ads' if k % 2 else 'news'}/{k}x{k}.html") for k in range(60)], "page_id long, url string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "page_id long, bad int")
    assert all((r.verdict == "block") == (r.page_id % 2 == 1) for r in urls.judged(pages, rules=(), labels=labels).collect())


def test_very_many_matches_in_one_text(spark):
    many = " ".join(f"u{k}@x{k}.cc" for k in range(30_000))
    d = spark.createDataFrame([(1, many), (2, "call +1 (743) 555-3824 or a@b.cc")], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(d).collect()}
    assert clean[1] == " ".join(["[EMAIL]"] * 30_000) and clean[2] == "call [PHONE] or [EMAIL]"
    assert {r.doc_id: r.n_email for r in pii.span_digests(d).collect()} == {1: 30_000, 2: 1}


def test_overlapping_spans_leave_nothing(spark):
    spans = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(a).alias("start"), F.lit(b).alias("end")) for k, a, b in (("card", 2, 8), ("phone", 5, 12), ("ip", 6, 7), ("email", 14, 15))))
    one = spark.createDataFrame([("0123456789abcdefgh",)], "t string").select(pii.rewritten(F.col("t"), spans)).first()[0]
    assert one == "01[CARD][PHONE]cd[EMAIL]fgh"


def test_written_shards_keep_their_limit(spark, tmp_path):
    rows = [(None, "x" * 400)] * 50 + [(k, "y" * 300) for k in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit(5)).repartition(3)
    sharding.write_shards(d, str(tmp_path / "s"), 1000)
    size = collections.defaultdict(int)
    back = spark.read.parquet(str(tmp_path / "s"))
    for r in back.collect():
        size[r._shard, r._part] += len(r.text)
    assert back.count() == 90 and max(size.values()) <= 1000 and set(back.columns) == {"doc_id", "text", "shard", "_shard", "_part"}


def test_directory_is_minimal(spark):
    """A shard is split exactly if it is above the limit: brute force over the hashes."""
    d = spark.createDataFrame([(k, "z" * (k % 90)) for k in range(400)], "doc_id long, text string")
    limit = 700
    rows = [(int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16), k % 90, k) for k in range(400)]

    def split(part, depth, prefix):
        if sum(b for _, b, _ in part) <= limit or len(part) == 1:
            return {i: prefix for _, _, i in part}
        out = {}
        for bit in "01":
            out |= split([r for r in part if f"{r[0]:060b}"[depth] == bit], depth + 1, prefix + bit)
        return out

    assert {r.doc_id: r.shard for r in sharding.shard_of(d, limit).collect()} == split(rows, 0, "")


CLASHING = ["__digest", "__at", "__id", "__of", "__spans", "a.b", "digest", "id", "row", "node", "kept", "x`y", "shard"]


def test_stages_keep_columns_of_any_name(spark):
    d = read(spark, "documents").limit(40)
    d = d.withColumn("text", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.concat("text", F.lit(" mail a@b.cc now")))).unionByName(d)
    for c in CLASHING:
        d = d.withColumn(c, F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")))
    labels, bench = read(spark, "labels"), read(spark, "benchmark")
    d = d.unionByName(d.limit(1).withColumns({"doc_id": F.lit(None).cast("long")})).cache()
    stages = {
        "quality": lambda x: quality.reject_low_quality(x, labels), "near": simhash.drop_near_duplicates, "leaks": lambda x: decontamination.drop_leaks(x, bench),
        "pii": pii.sanitise, "bpe": lambda x: bpe.encode_documents(x).drop("token_ids"),
    }
    given = {(r[0], *r[5:]) for r in d.collect()}
    for name, stage in stages.items():
        out = stage(d)
        assert out.columns == d.columns, name
        got = out.collect()
        assert got and {(r[0], *r[5:]) for r in got} <= given, name
        assert stage(d.limit(0)).count() == 0, name
    pages = read(spark, "pages").limit(20).withColumns({"host": F.lit("h"), "a.b": F.lit(1), "at": F.lit(2)})
    assert urls.judged(pages).count() == 20
    e = read(spark, "embeddings").limit(60).withColumns({"v": F.lit("h"), "a.b": F.lit(1), "entry": F.lit(2)})
    assert ann.search(e).count() == 20 * e.where("vec_id % 20 = 0").count()
    for f in (lm.score_documents, licences.scan_licences, bpe.token_digests, sharding.shard_of, pii.span_digests, simhash.simhash_components, lambda x: decontamination.leaks(x, bench), lambda x: quality.classify(x, labels)):
        assert f(d).count() >= 0


def test_small_sets_stay_within_the_radius():
    rng = np.random.default_rng(5)
    radius = simhash.radius_for(0.8)
    lost = 0
    for _ in range(3000):
        shared = int(rng.choice([4, 8]))
        h = rng.integers(0, 1 << 63, shared + shared // 4, dtype=np.uint64)
        a, b = (simhash.majority(simhash.spread(x)) for x in (h, h[:shared]))
        lost += sum(int(x).bit_count() for x in a ^ b) > radius
    assert lost <= 1


def test_repeated_ids_do_not_widen_the_sample(spark):
    d = spark.createDataFrame([(1, f"text number {k}", "s", "en") for k in range(50)] + [(2, "other words", "s", "en")], "doc_id long, text string, source string, lang string")
    marks = quality.labelled(d, spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int"))
    assert quality.fit(d, marks) is not None
    assert quality.classify(d, spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")).count() == 51


def test_texts_are_cut_into_words_once_for_training_and_scoring(spark, monkeypatch):
    """Besides the count, one pass cuts texts into words; training and scoring read the numbers that it wrote."""
    asked = []
    monkeypatch.setattr(lm, "materialise", lambda df, label, *by: asked.append((label, df.schema.names)) or materialise(df, label, *by))
    docs = spark.createDataFrame([(1, "a b a \u00e9 A"), (2, None), (3, "c" * 50 + " a"), (None, "b zz")], "doc_id long, text string")
    monkeypatch.setattr(lm, "HEAD", 2)
    rows = {r.doc_id: r for r in lm.score_documents(docs).collect()}
    assert [c for label, c in asked if label == "numbered"] == [["row", "doc_id", "ids", "tails"]]
    assert all("text" not in c for _, c in asked) and {k: r.n_tokens for k, r in rows.items()} == {1: 6, 2: 1, 3: 3, None: 3}
    learnt = [k for k, r in rows.items() if not r.held_out]
    assert rows[learnt[0]].train_tokens == sum(rows[k].n_tokens for k in learnt) and all(rows[k].n_known == rows[k].n_tokens for k in learnt)


def test_gradients_of_the_recurrent_model(monkeypatch):
    from linkweave.llm import gru

    for k, v in (("F32", np.float64), ("MOST", 60.0), ("TINY", 1e-300)):
        monkeypatch.setattr(gru, k, v)
    rng = np.random.default_rng(1)
    m = gru.GRU(np.array([50.0, 40, 30, 20] + [3.0] * 30), 10.0, 2)
    for k in m.p:
        m.p[k] = m.p[k].astype(float) + rng.standard_normal(m.p[k].shape) * 0.2
    docs = [rng.integers(0, 35, n).astype(np.int32) for n in (7, 5, 9)]
    held = {k: v.copy() for k, v in m.p.items()}
    m.train(docs, 1e-12, lanes=2, window=64)
    grad, m.p = {k: v / 0.1 for k, v in m.m.items()}, held
    norm = math.sqrt(sum((x * x).sum() for x in grad.values()))
    assert norm < 1  # not clipped
    for k, x in held.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in x.shape)
            was, loss = x[at], []
            for step in (1e-5, -1e-5):
                x[at] = was + step
                loss.append(-m.score(docs, lanes=2, window=64).sum() / sum(map(len, docs)))
            x[at] = was
            assert abs((loss[0] - loss[1]) / 2e-5 - grad[k][at]) < 1e-6


def test_long_documents_train_and_score_whole():
    from linkweave.llm import gru

    rng = np.random.default_rng(3)
    docs = [np.append(rng.integers(0, 35, n), 2).astype(np.int32) for n in (900, 3, 0, 40, 41, 250)]
    pieces = gru._pieces(docs, 100)
    assert max(map(len, pieces)) <= 100 and np.array_equal(np.concatenate(pieces), np.concatenate(docs))
    m = gru.GRU(np.array([50.0, 40, 30, 20] + [3.0] * 30), 10.0, 2)
    before = m.score(docs).sum()
    for _ in range(20):
        m.train(docs, 0.01, lanes=4)
    assert m.score(docs).sum() > before
    # A document's score depends neither on its neighbours nor on the lanes or windows it is scored in.
    alone = np.array([m.score([d])[0] for d in docs])
    for lanes, window in ((1, 8), (3, 32), (512, 5)):
        assert np.allclose(m.score(docs, lanes, window), alone, rtol=1e-4)


def test_logits_beyond_the_bound_stay_finite():
    from linkweave.llm import gru

    m = gru.GRU(np.array([50.0, 40, 30, 20] + [3.0] * 30), 10.0, 2)
    m.p["bw"][:] = 200
    m.p["bc"][:] = 200
    kinds, words = m._softmaxes()
    assert kinds.cut and words.cut and np.isfinite(m.score([np.array([5, 6, 2], np.int32)])).all()


@pytest.mark.parametrize("space", [" ", "\n", "\t"])
def test_bpe_of_long_white_space(space):
    """Runs of white space that the splitting pattern can't take whole."""
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(bpe.default_path()), bpe.Codec(bpe.default_path())
    for n in (9_999, 10_000, 100_000, 1_000_000, 3_000_000):
        run = space * n
        for t in (run, "a" + run + "b", "word " * 2000 + run + "1" + run + "'s") if n < 3_000_000 else (run + "x",):
            want = lib.encode(t, add_special_tokens=False).ids
            got = own.encode(t)
            assert got == want and own.decode(got) == t


def test_pipeline_stages_take_long_white_space(spark):
    docs = spark.createDataFrame([(1, "a" + " " * 1_000_000 + "b", "en", "s", 1), (2, "\n" * 1_000_000, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    coded = bpe.encode_documents(pii.sanitise(docs))
    assert {r.doc_id: len(r.token_ids) for r in coded.collect()} == {r.doc_id: r.n_tokens for r in bpe.token_digests(docs).collect()}


def plain_labels(text):
    """Base and method labels and the score, by trying every template at every place."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    at = lambda phrase: [i for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    base = {label for phrase, label in licences.PHRASES.items() if at(phrase)}
    labels, best = set(base), 0.5 if base else 0.0
    for label, template, key in licences.TEMPLATES:
        own, lead = template.split(), template[: template.index(key)].split()
        for i in at(key):
            first = i - len(lead)
            share = sum(0 <= first + k < len(words) and words[first + k] == w for k, w in enumerate(own)) / len(own)
            if share >= licences.SHARE:
                labels.add(label)
                best = max(best, share)
    return ",".join(sorted(labels)), best


def test_licence_labels_by_brute_force(spark, docs):
    false = ["ships in source and binary forms", "hereby granted free of charge entry to the museum", "the mozilla public license is discussed", "the free software foundation"]
    true = {
        "GNU Lesser General Public License v2.1": "lgpl-2.1", "Licensed under the Apache License, Version 2.0 (the License)": "apache,apache-2.0", "MIT License": "mit", "under CC-BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit", "Mozilla Public License, v. 2.0": "mpl-2.0", "the GNU General Public License, version 2 or 3": "gpl,gpl-2.0",
        "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd", "mit license " * 50: "mit",
    }
    rng = np.random.default_rng(4)
    words = sorted({w for _, t, _ in licences.TEMPLATES for w in t.split()})
    noise = [" ".join(" ".join(licences.TEMPLATES[k][1].split()[rng.integers(0, 4) :]) if k < len(licences.TEMPLATES) else rng.choice(words) for k in rng.integers(0, 40, 12)) for _ in range(60)]
    texts = [*false, *true, *noise]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in licences.scan_licences(d).collect()}
    for i, t in enumerate(texts):
        assert (got[i].labels, got[i].score) == plain_labels(t), t
    assert [got[i].labels for i in range(len(false))] == [""] * len(false)
    assert [got[len(false) + i].labels for i in range(len(true))] == list(true.values())
    for r in licences.scan_licences(docs).collect():
        if r.doc_id is not None:
            assert (r.labels, r.score) in {plain_labels(t) for i, t in texts_of(docs) if i == r.doc_id}


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_near_copies_with_an_entity_keep_their_text(spark):
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"word{x}" for x in rng.integers(0, 3000, 200))) for i in range(100)]
    base = [f"plain{x}" for x in rng.integers(0, 10**6, 1500)]
    for k in range(5):  # five near copies that alone hold an address and their words
        words = list(base)
        for at in rng.integers(0, 1500, 3):
            words[at] = f"changed{k}x{at}"
        rows.append((1000 + k, " ".join(words) + " write to someone@example.org"))
    for k in range(4):  # four different texts that share an address and a term that tells it
        rows.append((2000 + k, " ".join(f"word{x}" for x in rng.integers(0, 3000, 300)) + " Zyxwvut lives there, other@example.com"))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in pii.span_digests(d).collect()}
    assert all(got[1000 + k].n_term == 0 and got[1000 + k].n_email == 1 for k in range(5))
    assert all(got[2000 + k].n_term >= 1 for k in range(4))
    text = {r.doc_id: r.text for r in pii.sanitise(d).collect()}
    assert all("[TERM]" in text[2000 + k] and "Zyxwvut" not in text[2000 + k] for k in range(4)) and text[1000].startswith("plain")
