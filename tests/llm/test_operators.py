"""The operators against brute force on small rows: nulls, empty texts, ties, repeated rows, empty tables, other columns."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import common, dedup, license_scan, media, mixing, packing, pii, quality, sharding, toxicity, warc

DOCS = "doc_id long, text string, source string, size int, `skey` string"


def docs_of(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, (sources or ["a"] * len(texts))[i], 7, "x") for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " \n\t", "one", "word " * 3000, "aa bb cc dd ee ff gg hh ii jj kk", "aa bb cc dd ee ff gg hh ii jj kk"]


def test_quality_counts(spark):
    text = "x y z v w q\nx y z v w r\n\nx y z v w r $%"
    rows = {r.doc_id: r for r in quality.score(docs_of(spark, [text, *ODD]), quality.RULES).collect()}
    r = rows[0]
    assert (r.n_words, r.n_symbols, r.n_dup_lines) == (19, 2, 0)
    words = text.split()
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    assert r.n_repeat_words == len({j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)})
    assert rows[1].base_failed and rows[2].n_words == 0 and not rows[1].kept
    assert rows[6].kept and rows[7].kept and not rows[5].kept
    assert quality.score(docs_of(spark, []), quality.RULES).count() == 0


def test_cascade_order_by_rejection_for_cost():
    ticks = itertools.count()
    rules = (quality.Rule("never", lambda x: False), quality.Rule("some", lambda x: len(x.words) < 2), quality.Rule("most", lambda x: len(x.words) < 3))
    order = quality.cascade_order(["a", "a b", "a b", "a b c"], rules, lambda: next(ticks))
    assert [r.name for r, _, _ in order] == ["most", "never", "some"]


def test_chain_marginals_equal_all_paths():
    rng = np.random.default_rng(1)
    n = toxicity.BUCKETS + 1
    chain = toxicity.Chain(rng.normal(size=2), rng.normal(size=(2, 2)), rng.normal(size=n), rng.normal(size=n), rng.normal(size=n))
    sizes = [3, 1, 6]
    codes = rng.integers(0, n, sum(sizes))
    starts = np.append(0, np.cumsum(sizes))
    first = np.isin(np.arange(len(codes)), starts[:-1])
    odds = chain.marginals(codes, first)[0]
    for a, b in itertools.pairwise(starts):
        e, total, toxic = chain.scores(codes, first)[a:b], 0.0, np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=int(b - a)):
            w = np.exp(chain.start[y[0]] + sum(chain.move[p, q] for p, q in itertools.pairwise(y)) + sum(v for v, z in zip(e, y, strict=True) if z))
            total, toxic = total + w, toxic + w * np.array(y)
        assert np.allclose(toxic / total, 1 / (1 + np.exp(-odds[a:b])))


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels)
    found = toxicity.tag(docs.select("doc_id", "text"), model).join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).toPandas()
    hit = ((found.predicted == 1) & (found.toxic == 1)).sum()
    assert hit >= 0.5 * found.toxic.sum() and hit >= 0.7 * found.predicted.sum()
    odd = toxicity.tag(docs_of(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd) and odd[0].score == odd[1].score
    assert toxicity.tag(docs_of(spark, []), model).count() == 0


def test_warc_round_trip(spark, tmp_path):
    tricky = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, "u1", "same"), (5, "u5", "same"), (3, "u\r\n3", "same"), (2, "u2", tricky), (4, None, None), (6, "u6", ""), (7, "u7", "é x"), (None, "u", "other"), (8, "u8", "twice"), (8, "u8", "twice")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, payload int")
    path = str(tmp_path / "w")
    warc.write_archives(warc.resolve(df), path, records_per_file=2)
    rows = warc.read_archives(spark, path).collect()
    assert len(rows) == len(pages)
    by = {r.page_id: r for r in rows if r.page_id != 8}
    for i, _, html in pages:
        if i != 8:
            data = (html or "").encode()
            import base64

            assert by[i].payload_bytes == len(data) and by[i].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert (by[5].record_type, by[1].refers_to, by[3].refers_to, by[4].refers_to) == ("response", 5, 5, 6)
    assert sorted((r.record_type, r.refers_to) for r in rows if r.page_id == 8) == [("response", None), ("response", None)]
    big = warc.resolve(df, min_bytes=5).filter("page_id in (1, 3, 5)").collect()
    assert {r.record_type for r in big} == {"response"}
    assert warc.resolve(df.limit(0)).count() == 0


def test_sharding_table():
    table = sharding.lookup_table(["a", "b", "c", "d"], 101)
    assert len(table) == 101 and max(table.count(i) for i in range(4)) - min(table.count(i) for i in range(4)) <= 1
    # By the rule: turns in order, each the first free slot of its own permutation.
    free, want, orders = set(range(101)), [None] * 101, []
    for s in "abcd":
        at, skip = sharding._number(f"offset {s}") % 101, sharding._number(f"skip {s}") % 100 + 1
        orders.append([(at + k * skip) % 101 for k in range(101)])
    for turn in range(101):
        slot = next(x for x in orders[turn % 4] if x in free)
        free.remove(slot)
        want[slot] = turn % 4
    assert table == want
    fewer = sharding.lookup_table(["a", "b", "d"], 101)
    moved = sum(1 for x, y in zip(table, fewer, strict=True) if x != 2 and "abcd"[x] != "abd"[y])
    assert moved < 40
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "b"], 100)


def test_sharding_rows(spark):
    df = spark.createDataFrame([(1, "x"), (None, "y"), (1, "x")], "doc_id long, slot string")
    rows = sharding.place(df, F.col("doc_id")).collect()
    assert len(rows) == 3 and len({r.shard for r in rows if r.doc_id == 1}) == 1
    assert sharding.place(df.limit(0), F.col("doc_id")).count() == 0


def test_license_scan_equals_all_windows(spark):
    notice = license_scan.TEMPLATES["GPL-3.0-header"]
    cut = notice.replace("modify it under", "change it under")
    texts = [f"some words {notice} and more", f"a b c {cut}", "Released under the MIT license, all of it. Released under the MIT License", *ODD, "LICENSED under CC-BY-NC 4.0"]
    got = {(r.doc_id, r.license): round(r.containment, 6) for r in license_scan.scan(docs_of(spark, texts)).collect()}
    index, want = license_scan.Index(license_scan.TEMPLATES), {}
    for i, t in enumerate(texts):
        found = license_scan.shingles(index.codes_of(t)).tolist()
        for name, own in index.sets.items():
            best = max((len(own & set(found[p : p + len(own)])) / len(own) for p in range(len(found))), default=0)
            if best >= license_scan.CONTAINMENT:
                want[i, name] = best
    assert set(got) == set(want)
    for size in (1, 3, 8, 40):
        s = license_scan.settings(size)
        need = -(-8 * size // 10)
        assert 1 - (1 - (need / (s.window + size - need)) ** s.rows) ** s.bands >= 0.999


def test_mixing(spark):
    texts = ["w " * n for n in (50, 30, 1, 7, 400, 2, 9, 9, 12)] + [None, ""]
    sources = ["a", "a", "b", "b", "c", "c", None, None, "d", "d", "a"]
    df = docs_of(spark, texts, sources)
    chosen, sized = mixing.mix(df)
    rows = chosen.taken(sized).collect()
    total = sum(len((t or "").split()) for t in texts)
    size = {}
    for t, s in zip(texts, sources, strict=True):
        size[s] = size.get(s, 0) + len((t or "").split())
    order = [*sorted(s for s in size if s is not None), None]
    target, open_, left = {}, dict(zip(order, (1, 2, 3, 1, 2), strict=True)), float(total)
    while open_:
        level = left / sum(open_.values())
        over = [s for s in open_ if open_[s] * level > 3 * size[s] + 1e-9]
        if not over:
            target |= {s: w * level for s, w in open_.items()}
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
            del open_[s]
    for s in order:
        mine = [r for r in rows if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.taken <= 3 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= 1
    mixed = mixing.mixed_documents(df).collect()
    assert sum(len((r.text or "").split()) for r in mixed) == sum(r.taken for r in rows)
    assert mixing.mixed_documents(df).columns == df.columns
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_packing(spark):
    import zlib

    from tokenizers import Tokenizer

    texts = ["It's   we'll <|endoftext|> a\xa0b ΑΣ Σ İx ñ ñ", "hello, World 12", "x" * 9000, "many words here " * 4000, *ODD]
    rows = packing.packed(docs_of(spark, texts)).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [(p.start, p.length) for p in pieces] == [(a, min(4096, len(ids) - a)) for a in range(0, len(ids), 4096)]
        assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes()) for p in pieces)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-sum(r.length for r in rows) // 4096) + 1
    assert packing.packed(docs_of(spark, [])).count() == 0


def test_pack_counts_near_the_bound():
    rng = np.random.default_rng(4)
    lengths = np.minimum(4096, rng.lognormal(6, 1, 4000).astype(int) + 1)
    counts = np.bincount(lengths, minlength=4097)
    held = np.zeros(4097, dtype=int)
    plan = packing.pack_counts(counts)
    for n, bin_ in plan:
        assert sum(l * k for l, k in bin_.items()) <= 4096
        for l, k in bin_.items():
            held[l] += n * k
    assert (held == counts).all() and sum(n for n, _ in plan) <= 1.01 * lengths.sum() / 4096 + 2


def test_configurations_where_best_fit_fails():
    """Pieces that fill sequences exactly in threes and fours, of which best fit makes a fifth more; and a proven bound."""
    counts = np.zeros(4097, dtype=int)
    counts[[2068, 1044, 1064, 984]] = [6000, 6000, 6000, 12000]
    assert sum(n for n, _ in packing.pack_counts(counts)) <= 9090 < sum(n for n, _ in packing.pack_counts(counts, share=0))
    sizes, demand = packing.size_classes(counts, 4096)
    configs, bound = packing.fractional_configurations(sizes, demand, 4096)
    assert 9000 / (1 + packing.GAP) <= bound <= 9000 + 1e-6 and sum(n for _, n in configs) <= (1 + packing.GAP) * bound
    assert all(sum(n * c[i] for c, n in configs) >= demand[i] * (1 - 1e-9) for i in range(len(sizes))) and all((c * sizes).sum() <= 4096 for c, _ in configs)


def test_many_spans_in_one_text():
    """Loose spans of a text with thousands of base spans: as found by looking at all of them."""
    text = " ".join(f"a{i}@b{i}.org call 0{i % 9}1 555 {1000 + i} or +62 812 {100000 + i}" for i in range(3000))
    base = pii.base_spans(text)
    loose = pii.loose_spans(text, base)
    assert len(base) == 6000 and len(loose) >= 3000
    assert not any(a < e and s < b for _, a, b in base[::97] for _, s, e in loose)


def test_license_bands_follow_the_containment():
    assert license_scan.settings(40, 0.5).bands > license_scan.settings(40, 0.8).bands
    index = license_scan.Index(license_scan.TEMPLATES, 0.5)
    assert set(index.classes) == {license_scan.settings(len(own), 0.5) for own in index.sets.values()}


def test_offsets_hold_where_lower_case_is_longer():
    text = "İİ Bad WORDS İx end"
    assert len(toxicity.lowered(text)) == len(text) and toxicity.tokens_of(text)[1:3] == ["bad", "words"]


def test_warc_rows_that_repeat(spark):
    rows = [(1, "u", "x" * 30), (1, "u", "x" * 30), (2, "v", "y"), (None, "w", "y"), (None, "w", None)]
    found = warc.resolve(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == 5
    assert {(r.page_id, r.payload): (r.record_type, r.refers_to) for r in found} == {(1, "x" * 30): ("response", None), (2, "y"): ("response", None), (None, "y"): ("revisit", 2), (None, ""): ("response", None)}


def test_media_finds_cuts_and_edits(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 5}.example.org/p") for i in range(60)], "page_id long, url string")
    pictures = media.site_pictures(pages).cache()
    odd = spark.createDataFrame([(100, "", None), (101, "", b"no image"), (102, "", b"no image")], pictures.schema)
    rows = {r.id: r.class_id for r in media.classes(pictures.union(odd)).collect()}
    assert all(rows[i] == rows[i % 5] for i in range(60)) and len({rows[i] for i in range(5)}) == 5
    assert rows[101] == rows[102] == 101 and rows[100] == 100
    assert media.classes(pictures.limit(0)).count() == 0


def test_pii_base_equals_the_patterns(spark):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    texts = ["a@b@c.de x@y.z-. .@q.w @@a@b.c a@b.c@d.e", "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1", "+1 2345678 +12 +1 (743) 555-3824", "4111 1111-1111 1111 4111111111111111 é 4111111111111111", "x" * 50_000 + "@y.zz " + "1" * 50_000]
    for t in texts:
        want = [("email", *m.span()) for m in email.finditer(t[-200:] if len(t) > 1000 else t)] if len(t) < 1000 else None
        if want is not None:
            want += [("ip", *m.span()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
            want += [("card", *m.span()) for m in card.finditer(t) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
            want += [("phone", *m.span()) for m in phone.finditer(t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
            assert pii.base_spans(t) == want
    assert pii.base_spans(texts[-1]) == [("email", 0, 50_005)]


def test_pii_contexts_find_unseen(spark):
    known = [f"please call me on +1 555 000 {n:04d} today x{n}" for n in range(12)]
    texts = [*known, "please call me on 0555 123 4567 today", "the year 2020 2021 2022 was long", *ODD]
    rows = {r.doc_id: r["pii spans"] for r in pii.find(docs_of(spark, texts)).collect()}
    assert [(s.kind, s.start, s.end) for s in rows[12]] == [("phone", 18, 31)] and rows[13] == [] and rows[14] == []
    text = {r.doc_id: r.text for r in pii.redacted(docs_of(spark, texts)).collect()}
    assert text[12] == "please call me on [PHONE] today" and text[13] == texts[13]
    assert pii.find(docs_of(spark, [])).count() == 0


def test_near_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = []
    for base in range(12):
        words = list(rng.choice(vocabulary, 120))
        for edits in (0, 0, 2, 4, 6):
            copy = list(words)
            for at in rng.choice(120, edits, replace=False):
                copy[at] = str(rng.choice(vocabulary))
            texts.append(" ".join(copy))
    passage = " ".join(rng.choice(vocabulary, 60))
    texts += [passage + " " + " ".join(rng.choice(vocabulary, 60)) for _ in range(15)]
    texts += [*ODD, texts[0].upper()]
    rows = {r.doc_id: r for r in dedup.classes(docs_of(spark, texts)).collect()}
    codes, root = [dedup.word_codes(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            new = [i]
            for j, q in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != q)))
            row = new
        return row[-1]

    for i, j in itertools.combinations(range(len(texts)), 2):
        longer = max(len(codes[i]), len(codes[j]))
        if (texts[i] or "") == (texts[j] or "") or (abs(len(codes[i]) - len(codes[j])) <= 0.2 * longer and longer < 500 and edits(codes[i].tolist(), codes[j].tolist()) <= 0.2 * longer + 1e-9):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    assert {i: rows[i].class_id for i in rows} == {i: find(i) for i in range(len(texts))}
    kept = dedup.one_of_each(docs_of(spark, texts))
    assert kept.columns == docs_of(spark, []).columns and kept.count() == len({find(i) for i in range(len(texts))})
    assert dedup.classes(docs_of(spark, [])).count() == 0


def test_edit_distance():
    rng = np.random.default_rng(2)
    for _ in range(150):
        a = rng.integers(0, 6, rng.integers(0, 30)).astype(np.uint64)
        b = np.delete(a, rng.integers(0, max(len(a), 1), 3) % max(len(a), 1)) if len(a) > 3 and rng.random() < 0.7 else rng.integers(0, 6, rng.integers(0, 30)).astype(np.uint64)
        row = list(range(len(b) + 1))
        for i, p in enumerate(a, 1):
            new = [i]
            for j, q in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + int(p != q)))
            row = new
        most = int(rng.integers(0, 15))
        assert dedup.edit_distance(a, b, most) == (row[-1] if row[-1] <= most else None)


def brute_classes(texts):
    """Least index of each text's class, by all pairs."""
    codes, root = [dedup.word_codes(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if find(i) != find(j) and dedup.similarity(codes[i], codes[j]) is not None:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in range(len(texts))}


def test_near_dedup_one_large_group(spark):
    """Many copies with many edits: texts that are not like a bucket's ends are still linked to each other."""
    rng = np.random.default_rng(31)
    words, texts = [f"w{i}" for i in range(100)], []
    for n in range(400):
        copy = list(words)
        for at in rng.choice(100, rng.integers(8, 16), replace=False):
            copy[at] = f"x{n}y{at}"
        texts.append(" ".join(copy))
    rows = {r.doc_id: r.class_id for r in dedup.classes(docs_of(spark, texts)).collect()}
    assert rows == brute_classes(texts)


def scattered(rng, n, d):
    """Codes of n words, and the same with d of them replaced."""
    a = rng.integers(0, 2**63, n).astype(np.uint64)
    b = a.copy()
    b[rng.choice(n, d, replace=False)] = rng.integers(0, 2**63, d).astype(np.uint64)
    return a, b


def test_sketch_recall():
    """Share of pairs with a common sketch, at and above the threshold, short and long."""
    rng = np.random.default_rng(34)

    def recall(n, d, pairs=200):
        met = 0
        for _ in range(pairs):
            x, y = (dedup.sketches_of(codes) for codes in scattered(rng, n, d))
            size = min(len(x), len(y))
            met += bool((x[:size] == y[:size]).any())
        return met / pairs

    for n in (5, 8, 12, 20, 30, 60):
        assert recall(n, n // 5) >= 0.95, n
    for n in (64, 80, 100, 127, 128, 150, 200, 500):
        assert recall(n, n // 5, 600) >= 0.92 and recall(n, int(0.15 * n)) >= 0.98 and recall(n, n // 10) >= 0.99, n


def test_large_buckets_of_many_lengths(spark, monkeypatch):
    """Cells by classes of word counts look at each pair of a bucket that can be alike."""
    monkeypatch.setattr(dedup, "BLOCK", 4)
    rng = random.Random(3)
    sizes = {u: rng.choice([0, 1, 2, 4, 5, 6, 8, 10, 80, 100, 101, 125]) for u in range(60)}
    rows = spark.createDataFrame([(7, 60, 0, u, u) for u in sizes] + [(8, 3, 1, u, u) for u in range(3)], "key long, n long, slot int, uid long, root long")
    words = spark.createDataFrame(list(sizes.items()), "uid long, words long")
    cells = collections.defaultdict(list)
    for r in dedup.cells_of(rows, words, 0.8).collect():
        cells[r.key, r.i, r.j].append(r)
    met = collections.Counter((min(a.uid, b.uid), max(a.uid, b.uid)) for (k, i, j), c in cells.items() if k == 7 for a, b in itertools.combinations(c, 2) if i == j or a.block != b.block)
    assert max(met.values()) == 1 and max(map(len, cells.values())) < 30
    assert all(met[u, v] for u, v in itertools.combinations(sizes, 2) if min(sizes[u], sizes[v]) >= 0.8 * max(sizes[u], sizes[v]) - 1e-9)
    assert [(k, i, j, len(c)) for (k, i, j), c in cells.items() if k == 8] == [(8, 0, 0, 3)]


def test_one_of_each_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "p", "q"), (2, "a b c d e f", "r", None), (2, "a b c d e f", "r", None)], "doc_id long, text string, `own fp` string, row string")
    assert [tuple(r) for r in dedup.one_of_each(docs).collect()] == [(1, "a b c d e f", "p", "q")]


def test_near_dedup_pairs_at_the_threshold(spark):
    """Pairs of 5 to 30 words with as many edits as the similarity allows, every fifth word; of 200 words with 15 % edits."""
    rng, texts = np.random.default_rng(32), []
    for n in [*range(5, 31), *[200] * 20]:
        words = [f"v{len(texts)}n{i}" for i in range(n)]
        copy = list(words)
        for at in (np.arange(n // 5) * 5 + 2) if n < 50 else rng.choice(n, 30, replace=False):
            copy[at] = f"z{len(texts)}n{at}"
        texts += [" ".join(words), " ".join(copy)]
    rows = {r.doc_id: r.class_id for r in dedup.classes(docs_of(spark, texts)).collect()}
    linked = sum(rows[i] == i - 1 for i in range(1, len(texts), 2))
    assert all(rows[i] in (i, i // 2 * 2) for i in rows) and linked >= 0.95 * len(texts) / 2


def test_near_dedup_bucket_of_many_cells(spark, monkeypatch):
    """A bucket's blocks are all compared with each other: texts that share half their words, in pairs of copies."""
    monkeypatch.setattr(dedup, "BLOCK", 8)
    rng = np.random.default_rng(35)
    passage, texts = " ".join(f"p{i}" for i in range(120)), []
    for n in range(60):
        words = [f"w{n}x{i}" for i in range(60)]
        for copy in range(2):
            own = list(words)
            for at in rng.choice(60, 10 * copy, replace=False):
                own[at] = f"e{n}x{at}"
            texts.append(passage + " " + " ".join(own))
    rows = {r.doc_id: r.class_id for r in dedup.classes(docs_of(spark, texts)).collect()}
    assert rows == brute_classes(texts)


def test_near_dedup_recall_on_a_table(spark):
    """Classes of the whole small table against all pairs: no class but brute force's, and few links lost."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    brute = brute_classes([r.text for r in docs])
    rows = {r.doc_id: r.class_id for r in dedup.classes(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    want = {r.doc_id: docs[brute[i]].doc_id for i, r in enumerate(docs)}
    alike = [k for k, v in want.items() if v != k]
    assert alike and sum(rows[k] == want[k] for k in alike) >= 0.9 * len(alike)
    assert all(rows[k] == k or want[rows[k]] == want[k] for k in rows)


def test_media_meets_all_of_a_bucket(spark):
    """Images 3 and 4 share four corners, but each of these buckets has other least and greatest images."""
    corner = lambda key, at: (1, at, at, 0, [key * 4 + t for t in range(4)])
    images = {i: [] for i in (1, 2, 3, 4, 8, 9)}
    for n, others in enumerate([(1, 9), (1, 9), (2, 8), (2, 8)]):
        for i in (3, 4):
            images[i].append(corner(n, 20 + 10 * n))
        for i in others:  # two corners each: never enough votes
            images[i].append(corner(n, 20 + 17 * n * i))
    found = spark.createDataFrame(list(images.items()), f"uid long, corners array<{media.CORNER}>")
    assert [tuple(r) for r in media.copy_links(found).distinct().collect()] == [(3, 4)]


def test_media_links_by_one_table_in_either_step(spark):
    """Images 3 and 4 share four corners by one table's key alone: all other bits differ, which the first step never asked. Image 5 shares three with 3 and 4, which are too few."""
    images = {i: [] for i in (1, 2, 3, 4, 5, 8, 9)}
    corner = lambda key, at, own: (1, at, at, 0, [key * 4, *([2**32 - 1 if own else 0] * 3)])
    for n, others in enumerate([(1, 9), (1, 9), (2, 8), (2, 8)]):
        images[3].append(corner(n, 20 + 10 * n, False))
        images[4].append(corner(n, 20 + 10 * n, True))
        if n:
            images[5].append((1, 20 + 10 * n, 20 + 10 * n, 0, [n * 4, 1, 1, 1]))
        for i in others:
            images[i].append((1, 20 + 17 * n * i, 20 + 17 * n * i, 0, [n * 4, i * 7, i * 7, i * 7]))
    found = spark.createDataFrame(list(images.items()), f"uid long, corners array<{media.CORNER}>")
    assert [tuple(r) for r in media.copy_links(found).distinct().collect()] == [(3, 4)]


def test_media_sees_each_component_once(spark):
    """A corner meets a component in one row, however many images that has: no rows grow with the product of two components' images."""
    n = 500
    rooted = spark.range(2 * n).selectExpr("7L AS key", "0L AS s", f"shiftleft(id, {media._SPOT_BITS}) AS p", "id % 2 AS root")
    assert media.seen(rooted).count() == 0  # one corner an image is no link
    four = rooted.union(spark.range(2 * n).crossJoin(spark.range(3)).toDF("id", "c").selectExpr("8L + c", "0L", f"shiftleft(id, {media._SPOT_BITS}) + c + 1", "id % 2"))
    assert media.seen(four).count() == 4 * 2 * n


def test_media_copies_no_corner_more_than_fan_times(spark):
    n = 40_000
    rooted = spark.range(n).selectExpr("7L AS key", "0L AS s", "id AS p", "id % 2 AS root", "array(id) AS bits").union(spark.range(50).selectExpr("9L", "0L", "id", "id", "array(id)"))
    cells = media.dealt(rooted).cache()
    assert n * 8 < cells.filter("key = 7").count() <= n * media.FAN and cells.filter("key = 9").count() == 50
    seen = cells.filter("key = 7").groupBy("i", "j").agg(F.count_distinct("block").alias("n")).collect()
    assert len(seen) == media.FAN * (media.FAN + 1) // 2 and all(r.n == (1 if r.i == r.j else 2) for r in seen)


def test_pii_learns_long_chains(spark):
    """Forms of each level stand in contexts with those of the level before; only the first are seeds."""
    rows = [("phone", f"f{level}n{n}", level == 0, f"c{max(at, 1)}n{c}") for level in range(7) for at in (level, level + 1) for c in range(5) for n in range(12)]
    found = spark.createDataFrame(rows, "kind string, form string, seed boolean, context string")
    assert {r.form for r in pii.learn(found).collect()} == {f"f{level}n{n}" for level in range(1, 7) for n in range(12)}


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(9)
    star = [(0, i) for i in range(1, 60)]
    far_star = [(199, i) for i in range(140, 199)]
    chain = [(i, i + 1) for i in range(60, 99)]
    loose = rng.integers(200, 320, (70, 2)).tolist()
    edges = [*star, *far_star, *chain, *loose, *star[:5], (7, 7), (None, 3), (500, None)]
    root = {x: x for e in edges if e[0] is not None and e[1] is not None and e[0] != e[1] for x in e}

    def head(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a in root and b in root:
            a, b = sorted((head(a), head(b)))
            root[b] = a
    found = common.components(spark.createDataFrame(edges, "p long, q long"), "p", "q").collect()
    assert sorted(map(tuple, found)) == sorted((x, head(x)) for x in root)
    assert common.components(spark.createDataFrame([], "p long, q long"), "p", "q").count() == 0


def test_saved_where_no_folder_is_set(spark, monkeypatch):
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default if key == "spark.checkpoint.dir" else spark._jsparkSession.conf().get(key))
    path = common.shared_path(spark, "rows")
    assert path.startswith(spark.sparkContext.getCheckpointDir())
    assert sorted(r.id for r in common.saved(spark.range(5), "rows").collect()) == [0, 1, 2, 3, 4]


def test_redaction_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "write to a.b@c.de now", "p", 3)], "doc_id long, text string, `pii base` string, `pii spans` int")
    assert [tuple(r) for r in pii.redacted(docs).collect()] == [(1, "write to [EMAIL] now", "p", 3)]
    assert pii.find(docs).select("doc_id", F.size("pii base")).first()[1] == 1


def test_a_frequent_payload_is_split_and_moves_once_a_task(spark):
    """Nine rows in ten have one payload: the join of headers to originals is split, and payloads pass one exchange, after a sum by task."""
    low = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in low}
    for k, v in low.items():
        spark.conf.set(k, v)
    try:
        pages = spark.range(40_000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 10 < 9, "same").otherwise(F.col("id").cast("string")).alias("html"))
        out = warc.records(pages.repartition(8))
        found = out.select("page_id", "record_type", "payload")
        assert found.filter("record_type = 'revisit'").count() == 35_999
        done = found.orderBy("page_id")
        done.collect()
        plan = done._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
        assert "partial_first(payload" in plan
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_records_are_those_of_resolve(spark):
    """Without the payloads of revisits; repeated rows of an original are all responses."""
    rows = [(1, "u1", "same"), (5, "u5", "same"), (5, "u5", "same"), (5, "u4", "same"), (None, "n", None), (4, None, None), (None, "n", "x"), (None, "n", "x"), (7, None, "y"), (7, None, "y"), (8, "u", "long one"), (9, "u", "long one")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for least in (0, 4):
        key = lambda out: sorted((r.page_id is None, r.page_id or 0, r.url or "", r.payload if r.record_type == "response" else "", r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0, r.refers_url or "") for r in out.collect())
        assert key(warc.records(df, min_bytes=least)) == key(warc.resolve(df, min_bytes=least))
    assert warc.records(df.filter("false")).count() == 0
