"""The operators against brute force on small tables with nulls, empty, long, equal and near equal texts."""

import hashlib
import random
import re
import zlib
from itertools import combinations, permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskframe.llm import common, decontaminate, imatch, jaccard, lines, packing, suffixes, tokens, toxicity, urls, warc

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, node long, grp long, place int"


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    prose = lambda n: " ".join(draw.choice(WORDS) for _ in range(n))
    passage, base = prose(60), prose(120)
    out = [None, "", " ", "one", "one", "Ünï cödé, x. y\n\nz", base, base]
    for _ in range(25):
        w = base.split()
        w[draw.randrange(len(w))] = draw.choice(WORDS)
        out.append(" ".join(w))
    out += [f"{prose(10)}\n{passage}\n{prose(15)}" for _ in range(12)]
    out += [prose(n) for n in (3, 5, 30, 30, 4000)]
    return [(i * 3, t, "en", None if i == 4 else f"s{i % 3}", None if t is None else len(t), i, i, i, i) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('docs')}/documents.parquet"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('none')}/documents.parquet"
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def test_jaccard_components(docs, rows):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w)} if 0 < len(w) < 4 else {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(docs, hot_rows=3, slice_rows=4).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    kept = jaccard.keep_one(docs, 4, 85)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(i for i in sets if find(i) == i)


@pytest.mark.parametrize("hot", [0, 2, 20_000])
def test_suffixes(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(suffixes.repeated, "__defaults__", (50, 16, hot, 40_000))
    seen, want = set(), {}
    for i, t, *_ in rows:
        data = (t or "").encode()
        cover, own = bytearray(len(data)), set()
        for s in range(len(data) - 49):
            own.add(data[s : s + 50])
            if data[s : s + 50] in seen:
                cover[s : s + 50] = b"\x01" * 50
        seen |= own
        left = bytes(c for c, m in zip(data, cover, strict=True) if not m)
        want[i] = (len(data), sum(cover), len(re.findall(b"\x01+", bytes(cover))), hashlib.sha256(left).hexdigest())
    got = {r[0]: tuple(r)[1:] for r in suffixes.report(docs).collect()}
    assert got == want


def test_suffixes_do_not_depend_on_the_splits_of_a_scan(spark, docs, monkeypatch):
    want, plain = {tuple(r) for r in suffixes.report(docs).collect()}, common.write_beside
    changed = {"spark.sql.files.minPartitionNum": "7", "spark.sql.files.openCostInBytes": "1"}

    def moved(rows):
        for k, v in changed.items():
            spark.conf.set(k, v)
        return plain(rows)

    monkeypatch.setattr(common, "write_beside", moved)
    try:
        assert {tuple(r) for r in suffixes.report(docs).collect()} == want
    finally:
        for k in changed:
            spark.conf.unset(k)
    for length, gram in ((40, 16), (50, 12), (200, 16)):
        with pytest.raises(ValueError, match="gram"):
            suffixes.repeated(docs, length, gram)


def test_settle_streams_a_large_gram(monkeypatch):
    monkeypatch.setattr(suffixes, "HELD", 5)
    code = (np.repeat([7, 9], [30, 2]).astype(np.int64) << 24) | (1 << 16) | (1 << 8) | 3
    context = np.repeat([1, 2, 5], [20, 10, 2])
    cols = [code, context, np.concatenate([np.arange(20), np.arange(10), [1, 4]]), np.zeros(32, int), np.zeros(32, int)]
    parts = [pa.RecordBatch.from_arrays([pa.array(x[a : a + 4], t) for x, t in zip(cols, (pa.int64(),) * 3 + (pa.int32(),) * 2, strict=True)], names=["code", "context", "doc_id", "at", "part"]) for a in range(0, 32, 4)]
    out = [r for b in suffixes.settle(iter(parts)) for r in b.to_pylist()]
    assert sorted(r["doc_id"] for r in out if r["open"]) == [0, 0]
    assert sorted(r["doc_id"] for r in out if not r["open"]) == sorted([*range(1, 20), *range(1, 10), 4])


def test_tokens(docs, rows):
    from tokenizers import Tokenizer

    path = tokens.vocabulary("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    start, want = 0, []
    for i, t, *_ in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in tokens.token_file(docs, path).collect()) == want


def test_packing(docs, rows):
    path = tokens.vocabulary("byte_bpe_50k.json")
    use, got = tokens.Encoder(path), packing.pack(docs, path, length=64, windows=4).collect()
    texts = {i: t for i, t, *_ in rows}
    at, sizes = {}, {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        ids = use.encode([texts[r["doc_id"]] or ""])[0]
        assert (r["start"], r["doc_tokens"]) == (at.get(r["doc_id"], 0), len(ids))
        at[r["doc_id"]] = r["start"] + r["length"]
        assert r["ids_crc32"] == tokens.crc(ids[r["start"] : at[r["doc_id"]]])
    assert at == {i: len(use.encode([t or ""])[0]) for i, t in texts.items()}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sizes.get(r["sequence_id"], 0)
        sizes[r["sequence_id"]] = r["offset"] + r["length"]
    assert set(list(sizes.values())[:-1]) == {64}


def test_rank_is_a_permutation():
    totals = [5, 0, 12, 1]
    assert sorted(packing.rank(totals, s, x) for s, n in enumerate(totals) for x in range(n)) == list(range(18))


def test_rank_by_array():
    draw = random.Random(7)
    for large in (50, 1 << 34):
        totals = [0, *(draw.randrange(1, large) for _ in range(90)), 1, large]
        flat = np.array(totals, np.int64)
        for s in range(1, len(totals), 7):
            for x in (0, totals[s] // 2, totals[s] - 1):
                assert packing.rank(totals, s, x, flat) == packing.rank(totals, s, x)


def test_packing_keeps_the_share_of_many_sources(spark):
    draw = random.Random(8)
    many = [(i, " ".join(draw.choices(WORDS, k=draw.randrange(20, 60))), f"s{i % 101}" if i % 3 else "hot") for i in range(600)]
    got = packing.pack(spark.createDataFrame(many, "doc_id long, text string, source string").repartition(3), tokens.vocabulary("byte_bpe_50k.json"), length=256, windows=8).collect()
    source, counts, totals = {i: s for i, _, s in many}, {}, {}
    for r in got:
        s = source[r["doc_id"]]
        counts[s, r["sequence_id"]] = counts.get((s, r["sequence_id"]), 0) + r["length"]
        totals[s] = totals.get(s, 0) + r["length"]
    every, last = sum(totals.values()), max(r["sequence_id"] for r in got)
    assert len(totals) == 102 and last > 40
    for s, total in totals.items():
        for end in range(8, last + 1, 8):  # to the end of each superwindow a source has its share, but for half a token and its part of the others' halves
            assert abs(sum(counts.get((s, w), 0) for w in range(end)) - 256 * end * total / every) < 0.51 + total / every * len(totals) / 2


def test_rank_by_weights():
    totals, weights = [5, 0, 12, 1, 30], [9, 4, 4, 1, 2]
    due = sorted(((2 * x + 1) / weights[s], s, x) for s, n in enumerate(totals) for x in range(n))
    for flat in (None, np.array([totals, weights])):
        assert [packing.rank(totals, s, x, flat, weights) for _, s, x in due] == list(range(48))


def test_packing_fills_windows_to_targets(spark):
    draw = random.Random(11)
    many = [(i, " ".join(draw.choices(WORDS, k=draw.randrange(20, 60))), (None, "b", "c", "d")[min(i % 5, 3)]) for i in range(500)]
    rows, path = spark.createDataFrame(many, "doc_id long, text string, source string").repartition(3), tokens.vocabulary("byte_bpe_50k.json")
    own = {}
    for r in packing.pack(rows, path).collect():
        own[many[r["doc_id"]][2]] = own.get(many[r["doc_id"]][2], 0) + r["length"]
    got = packing.pack(rows, path, length=256, windows=8, targets={None: 0.5, "b": 0.1}).collect()
    want = {None: 0.5, "b": 0.1, "c": 0.4 * own["c"] / (own["c"] + own["d"]), "d": 0.4 * own["d"] / (own["c"] + own["d"])}
    counts, dry = {}, {}
    for r in got:
        s = many[r["doc_id"]][2]
        counts[r["sequence_id"], s] = counts.get((r["sequence_id"], s), 0) + r["length"]
        dry[s] = max(dry.get(s, 0), r["sequence_id"])
    assert sum(counts.values()) == sum(own.values()) and dry[None] < dry["c"] and dry[None] < dry["b"]
    assert dry[None] > 20
    going, last = set(want), max(dry.values())
    for w in range(last):  # each window by itself, while the same queues are going in it; carried deficits stay small
        ends = {s for s in want if dry[s] <= w}
        if not any(dry[s] == w for s in want):
            going = set(want) - ends
            for s in going:
                assert abs(counts.get((w, s), 0) - 256 * want[s] / sum(want[x] for x in going)) <= 4, (w, s)
    for bad in ({None: 0.7, "b": 0.6}, {"b": 0}, {None: 0.5, "b": 0.5}):
        with pytest.raises(ValueError, match="targets"):
            packing.pack(rows, path, targets=bad)


def test_decontaminate(spark, docs, rows):
    items = [(1, rows[40][1][:150]), (2, "one"), (3, None), (4, ""), (5, "not there at all"), (11, "one"), (None, rows[45][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    got = {r["doc_id"]: r for r in decontaminate.report(docs, bench, block_items=2).collect()}
    for i, t, *_ in rows:
        w, hit, found = split(t), set(), set()
        for item, text in items:
            x = split(text)
            for k in range(max(1, len(x) - 9)):
                p = x[k : k + 10]
                for at in range(len(w) - len(p) + 1) if p else ():
                    if w[at : at + len(p)] == p:
                        hit.update(range(at, at + len(p)))
                        found |= {str(item)} - {"None"}
        assert got[i]["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
    assert decontaminate.clean(docs, bench).count() == sum(not r["contaminated"] for r in got.values())


def test_lines(docs, rows):
    seen, want = {}, {}
    split = {i: [(k, x.strip()) for k, x in enumerate((t or "").split("\n")) if x.strip()] for i, t, *_ in rows}
    runs = {i: list(runs_of("\n".join(x for _, x in ls))) for i, ls in split.items()}
    for i in split:
        for at, run in runs[i]:
            seen.setdefault(run, (i, at))
    for i, t, *_ in rows:
        gone = {at + k for at, run in runs[i] if seen[run] != (i, at) for k in range(len(run))}
        want[i] = (len((t or "").split("\n")), len(gone))
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in lines.report(docs).collect()} == want
    clash = docs.withColumns({"_id": F.lit(1), "runs": F.lit(2), "runs_id": F.lit(3), "_runs": F.lit(4), "shared_places": F.lit(5)})
    left = lines.dedup(clash)
    assert left.columns == clash.columns and left.agg(F.sum("runs")).first()[0] == 2 * len(rows)


def test_line_dedup_deletes_a_repeated_run_to_its_end(spark):
    draw = random.Random(5)
    long, short, tail = (" ".join(draw.choice(WORDS) for _ in range(n)) for n in (50, 10, 4))
    texts = [f"x\n{long}\nother", f"p q\n{long}\n{short}\n\n{tail}\nend a", f"r\n{long}\n{short}\n{tail}\nend b", f"{long}\n{short}", f"{short}\n{tail}", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.dedup(docs).collect()}
    assert got == {0: texts[0], 1: f"p q\n{short}\n\n{tail}\nend a", 2: "r\nend b", 3: "", 4: texts[4], 5: None}
    rng = random.Random(6)
    pool = [" ".join(f"{c}{k}" for k in range(n)) for c, n in zip("abcdefg", (50, 41, 3, 12, 20, 1, 39), strict=True)]
    many = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(9)))) for i in range(40)]
    seen, want = {}, {}
    for i, t in many:
        for at, run in runs_of(t):
            seen.setdefault(run, (i, at))
    for i, t in many:
        gone = {at + k for at, run in runs_of(t) if seen[run] != (i, at) for k in range(len(run))}
        want[i] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
    assert {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(many, "doc_id long, text string")).collect()} == want


def runs_of(text):
    ls = text.split("\n") if text else []
    for a, b in combinations(range(len(ls) + 1), 2):
        if b - a >= 3 or sum(len(x.split()) for x in ls[a:b]) >= 40:
            yield a, tuple(ls[a:b])


def test_imatch(docs, rows):
    got = {r["doc_id"]: r for r in imatch.fingerprints(docs, rows_each=7).collect()}
    texts = [t or "" for _, t, *_ in rows]
    for k, (i, *_) in enumerate(rows):
        t, after = texts[k], texts[(k + 1) % len(texts)]
        half = len(t) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
    lexicon = plain_lexicon(texts, 0.0005, 0.2)
    prints = [plain_imatch(t, lexicon) for t in texts]
    for k, (i, *_) in enumerate(rows):
        t, after = texts[k], texts[(k + 1) % len(texts)]
        half = len(t) // 2
        edited = plain_imatch(t[: len(t) - half] + after[:half], lexicon)
        assert got[i]["fingerprint"] == "".join(prints[k]) and got[i]["edited_fingerprint"] == "".join(edited)
        assert got[i]["near_next"] == plain_likeness(prints[k], prints[(k + 1) % len(rows)])
        assert got[i]["near_edited"] == plain_likeness(prints[k], edited)
    for a, b in combinations(range(len(rows)), 2):
        if texts[a] == texts[b]:
            assert got[rows[a][0]]["fingerprint"] == got[rows[b][0]]["fingerprint"]


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def chained(values, seed=42):
    """Spark's xxhash64 of several values: each is hashed with the hash before it as the seed."""
    import xxhash

    for v in values:
        data = v.encode() if isinstance(v, str) else v.to_bytes(4 if abs(v) < 1000 else 8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return signed(seed)


def plain_terms(text):
    return {x for x in re.split(r"[\W_]+", text.lower()) if x}


def plain_lexicon(texts, low, high):
    count = {}
    for t in texts:
        for x in plain_terms(t):
            count[x] = count.get(x, 0) + 1
    return {x for x, n in count.items() if max(2, low * len(texts)) <= n <= max(2, high * len(texts))}


def plain_imatch(text, lexicon):
    known = plain_terms(text)
    inside = sorted(chained([x]) for x in (known & lexicon or known)) or [chained([text, "text"])]
    sign = lambda terms: f"{chained(terms) % (1 << 64):016X}"[-imatch.DIGITS :] if terms else imatch.NONE
    return [sign(inside)] + [sign([t for t in inside if chained([t, f]) % m == 0]) for f in range(imatch.SEEDS) for m in imatch.RATES]


def plain_likeness(a, b):
    either = [(x, y) for x, y in zip(a, b, strict=True) if {x, y} != {imatch.NONE}]
    return sum(x == y for x, y in either) / len(either)


def test_imatch_lexicon_is_exact(spark):
    draw = random.Random(9)
    texts = [" ".join({f"r{i * 4000 + k}" for k in range(4000)} | {f"c{draw.randrange(3000)}" for _ in range(600)}) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashes, starts = imatch.lexicon(docs.select("text"), 0.05, 0.2)
    count = {}
    for t in texts:
        for x in set(t.split()):
            count[x] = count.get(x, 0) + 1
    terms = spark.createDataFrame([(x, 2 <= n <= 8) for x, n in count.items()], "term string, inside boolean")
    assert set(hashes) == {r[0] for r in terms.filter("inside").select(F.xxhash64("term")).collect()}
    buckets = len(starts) - 1
    assert all(h & (buckets - 1) == b for b in range(buckets) for h in hashes[starts[b] : starts[b + 1]])
    known = (imatch.constant(hashes), imatch.constant(starts), buckets)
    extra = spark.createDataFrame([(f"c{k} r{k}", f"c{k}") for k in range(40)], "a string, b string").join(terms.filter("inside").withColumnRenamed("term", "b"), "b")
    got = extra.select((imatch.fingerprint(F.col("a"), *known) == imatch.fingerprint(F.col("b"), *known)).alias("same")).collect()
    assert got and all(r["same"] for r in got)  # terms of one document are not in the lexicon


def test_toxicity(spark, docs, rows):
    bad = [(1000 + k, f"you {'idiot' if k % 2 else 'fine'} {' '.join(random.Random(k).choices(WORDS, k=30))}") for k in range(200)]
    texts = spark.createDataFrame(bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if "idiot" in t else 0) for i, t in bad] + [(3, None)], "doc_id long, toxic int")
    scored = toxicity.score(texts, toxicity.learn(texts, labels)).filter(toxicity.held_out()).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in scored) and scored
    assert toxicity.keep_clean(docs, labels.limit(0)).count() == len(rows)


def test_toxicity_of_pairs_whose_terms_are_neutral():
    draw = np.random.default_rng(4)
    first, second, filler = (draw.choice(1 << 20, k, replace=False) for k in (2, 2, 400))
    sides = draw.integers(0, 2, (1600, 2))
    texts = [np.unique(np.concatenate(([first[a], second[b]], filler[draw.random(400) < 0.6]))) for a, b in sides]
    toxic = (sides[:, 0] == sides[:, 1]).astype(int)
    model = toxicity.fit(texts[:1200], toxic[:1200], 0.5, common_terms=0)
    assert {*first.tolist(), *second.tolist()} <= set(model.number)

    def score(t):
        rows = [model.number[i] for i in t.tolist() if i in model.number]
        v = model.v[rows]
        return model.b + model.w[rows].sum() + 0.5 * ((v.sum(0) ** 2 - (v**2).sum(0)).sum())

    assert np.mean([(score(t) > 0) == bool(k) for t, k in zip(texts[1200:], toxic[1200:], strict=True)]) > 0.9


def test_warc(spark, tmp_path):
    pages = [(3, "http://a/x\ny", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (5, "u", ""), (7, "v", "x" * 200_000), (8, "v", "<p>é</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    names = warc.write(df, f"file://{tmp_path}/w")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read(spark, names).collect()}
    assert got == {1: (9, "response", None), 3: (9, "revisit", 1), 8: (9, "revisit", 1), 2: (0, "response", None), 5: (0, "revisit", 2), 7: (200_000, "response", None)}
    with pytest.raises(ValueError, match="content length"):
        warc.parsed(warc.record(1, "u", b"abc", None, "d")[:-1])


def test_urls(spark):
    link = '<a href="http://bad.example.net/">'
    pages = [(1, "http://X.Example.org/en/12?q", None), (2, "https://example.org/es/", ""), (3, "nothing", None), (4, None, None), (5, "http://a.com/de/x", link), (6, "http://bad.example.net/y", '<a href="http://a.com/de/">'), (7, "http://org", None), (8, "http://good.com/fr/", None)]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.verdicts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1] == ("x.example.org", "/en/12", "example.org/en/1", "block") and got[2][2:] == ("example.org/es/", "block")
    assert got[3] == got[4] == ("", "", None, "allow") and got[5][2:] == ("com/de/", "block")
    assert got[6] == ("bad.example.net", "/y", None, "block") and got[7] == ("org", "", None, "allow") and got[8][2:] == ("com/fr/", "allow")


def test_urls_ranks_settle(spark):
    far = [(k, f"http://h{k}.net/", f'<a href="http://h{k + 1}.net/">') for k in range(7)] + [(7, "http://h7.net/", None), (8, "http://h7.net/bad/", None)]
    far += [(k, f"http://z{k}.info/", None) for k in range(9, 101)]
    got = {r["page_id"]: r["verdict"] for r in urls.verdicts(spark.createDataFrame(far, "page_id long, url string, html string"), (("block", "h7.net/bad"),)).collect()}
    assert {k for k, v in got.items() if v == "block"} == set(range(9))
    links = {("a", "b"): 1.0, ("b", "a"): 0.5, ("b", "c"): 0.5, ("c", "c2"): 1.0, ("c2", "a"): 1.0}
    graph = spark.createDataFrame([("trust", a, b, p) for (a, b), p in links.items()], "kind string, src string, dst string, part double")
    links["c", "d"] = links["d", "a"] = 0.0  # d has no out-links: its mass goes back to the seed
    links["c", "c2"], links["c", "d"], links["d", "a"] = 0.5, 0.5, 1.0
    graph = spark.createDataFrame([("trust", x, y, p) for (x, y), p in links.items() if x != "d"], "kind string, src string, dst string, part double")
    mass = urls.propagate(graph, spark.createDataFrame([("trust", "a", 4.0)], "kind string, host string, seed double"), 0.05, 0.85)
    names = ["a", "b", "c", "c2", "d"]
    step = np.array([[links.get((a, b), 0.0) for a in names] for b in names])
    want = np.linalg.solve(np.eye(5) - 0.85 * step, 0.15 * np.array([4.0, 0, 0, 0, 0]))
    found = {r["host"]: r["mass"] for r in mass.collect()}
    assert sum(abs(found[a] - x) for a, x in zip(names, want, strict=True)) <= 0.05
    with pytest.raises(RuntimeError, match="settled"):
        urls.propagate(graph, spark.createDataFrame([("trust", "a", 4.0)], "kind string, host string, seed double"), 0.05, 0.85, limit=2)


def test_warc_refuses_damaged_archives():
    import io

    whole = io.BytesIO()
    records = [warc.record(i, f"http://a/{i}", f"<p>{i}</p>".encode() * 40, None, "2024-01-01T00:00:00Z") for i in range(3)]
    assert warc.write_archive(whole, iter(records)) == 3
    data = whole.getvalue()
    assert list(warc.frames(io.BytesIO(data))) == records
    size = int.from_bytes(data[4:8], "little")
    for bad, words in ((b"", "no leading frame"), (b"\x00" + data[1:], "not a dictionary"), (data[: size // 2], "dictionary is cut off"), (data[:-3], "last frame is cut off")):
        with pytest.raises(ValueError, match=words):
            list(warc.frames(io.BytesIO(bad)))
    one = records[0]
    for bad, words in ((one.replace(b"<p>0", b"<p>9"), "block digest"), (one.replace(b"WARC/1.1", b"WARC/9.9"), "not a WARC record"), (one.replace(b"WARC-Date: ", b"WARC-Date; "), "bad header|no warc-date"), (one.replace(b"WARC-Type", b"X-Type"), "no warc-type")):
        with pytest.raises(ValueError, match=words):
            warc.parsed(bad)
    wrong = one.replace(b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:A")
    with pytest.raises(ValueError, match="payload's length or digest"):
        warc.parsed(wrong)


def test_null_ids_and_repeated_rows(spark, rows):
    base = rows[6][1]
    odd = [(None, base), (None, base), (None, None), (5, base), (5, base), (6, None), (7, base + " end"), (8, "one"), (9, "one")]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in odd], "doc_id long, text string, source string, gram long").repartition(2)
    ids = sorted([i for i, _ in odd], key=str)
    byte, word = tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("word_bpe_49k.json")
    by_id = lambda df: sorted((r["doc_id"] for r in df.collect()), key=str)
    found = jaccard.classes(docs).collect()
    assert sorted((r["doc_id"] for r in found), key=str) == ids
    assert {r["doc_id"]: r["component_id"] for r in found } == {None: None, 5: 5, 6: 6, 7: 5, 8: 8, 9: 8}
    cut = suffixes.report(docs).collect()
    size = len(base.encode())
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in cut) == sorted([("None", 0)] * 3 + [("5", size)] * 2 + [("6", 0), ("7", size), ("8", 0), ("9", 0)])
    first = sorted(tokens.token_file(docs, word).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in first] == [None] * 3 + [5, 5, 6, 7, 8, 9]
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(first, first[1:], strict=False))
    packed = packing.pack(docs, byte).collect()
    assert sum(r["length"] for r in packed) == sum(len(tokens.encoder(byte).encode([t or ""])[0]) for _, t in odd)
    prints = imatch.fingerprints(docs).collect()
    assert sorted((r["doc_id"] for r in prints), key=str) == ids
    assert len({r["fingerprint"] for r in prints if r["n_chars"] == len(base)}) == 1
    bench = spark.createDataFrame([(1, base, 1), (1, base, 2), (None, "one", 3)], "item_id long, text string, doc_id long")
    hit = decontaminate.report(docs, bench).collect()
    assert sorted((str(r["doc_id"]), r["n_items"], r["contaminated"]) for r in hit) == sorted([("None", 1, True)] * 2 + [("None", 0, False)] + [("5", 1, True)] * 2 + [("6", 0, False), ("7", 1, True), ("8", 0, True), ("9", 0, True)])
    labels = spark.createDataFrame([(5, 0, "x"), (5, 1, "y"), (8, 0, "z"), (None, 1, "n")], "doc_id long, toxic int, text string")
    scored = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    assert sorted((r["doc_id"] for r in scored), key=str) == ids and len({r["score"] for r in scored if r["doc_id"] is None}) <= 2
    assert by_id(lines.report(docs)) == ids
    pages = spark.createDataFrame([(1, "http://a.b/x", "h", "r", 0), (1, "http://a.b/x", "h", "r", 0), (None, None, "h", "r", 0)], "page_id long, url string, html string, rule string, host long")
    assert sorted((str(r["page_id"]), r["host"], r["rule"], r["verdict"]) for r in urls.verdicts(pages).collect()) == [("1", "a.b", None, "allow")] * 2 + [("None", "", None, "allow")]
    read = warc.read(spark, warc.write(pages, common.shared_folder(spark))).collect()
    assert sorted((str(r["page_id"]), r["record_type"]) for r in read) == [("1", "response")] * 2 + [("None", "response")]


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    byte, word = tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("word_bpe_49k.json")
    for df in (jaccard.classes(empty), suffixes.report(empty), tokens.token_file(empty, word), packing.pack(empty, byte), decontaminate.report(empty, bench), lines.report(empty), imatch.fingerprints(empty), toxicity.score(empty, toxicity.learn(empty, labels))):
        assert df.count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.verdicts(pages).count() == 0 and warc.read(spark, warc.write(pages, common.shared_folder(spark))).count() == 0


def test_pipeline_keeps_the_columns(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no such thing")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = common.cut(stage(spark, step, str(tmp_path)))
        assert step.columns == docs.columns, name
    assert 0 < step.count() < docs.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).select(F.sum("length")).first()[0] > 0


ODD = ["", " ", "  a", "don't can't I'll", "İstanbul İİ\nİ x", "a\n\nb", "x́ ý.", "１２ ²³. x²,", "\x00 a", " \x01 b", "<|endoftext|> a", "a <|endoftext|> b", "x<|EndOfText|>y <|startoftext|>.", "가 각\n한글.", "a'.s b's.", "Ġa Ċb", "A,B,C, d.,;", "\ta b\r\nc d　f", "...", " ...", "😀 é😀.", "ﬁ ﬂ, ǅ ß\nẞ."]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_tokenizer(name):
    from tokenizers import Tokenizer

    use, plain = tokens.Encoder(tokens.vocabulary(name), keep=40), Tokenizer.from_file(tokens.vocabulary(name))
    for turn in range(4):  # the cache overflows in between
        texts = [*ODD, *(f"word{turn} {'ab' * i}, common{chr(97 + i)}.\nnext" for i in range(30))]
        for part in (texts, [x for x in texts if "\x00" not in x]):
            ids, n = use.encode(part)
            ends = np.cumsum(n)
            want = [x.ids + [tokens.END_ID] for x in plain.encode_batch(part, add_special_tokens=False)]
            assert [ids[e - k : e].tolist() for e, k in zip(ends, n, strict=True)] == want


def test_settled_driver_and_id_types(spark):
    """Giving memory back changes no result, twice in a row too; the driver's id type is the one that holds all ids."""
    rows = spark.range(10)
    common.settle(spark)
    common.settle(spark)
    assert rows.count() == 10
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = tokens.vocabulary(name)
        assert np.iinfo(tokens.id_kind(path)).max >= tokens.encoder(path).tokenizer.get_vocab_size() - 1


def test_jaccard_sends_whole_sets_only_where_maps_allow_a_link(spark, monkeypatch):
    rng, many, asked, plain = np.random.default_rng(5), [], [], jaccard.sets_of
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))
    for i in range(20):  # pairs with about 0.45 of their shingles in common share enough tokens to be asked
        shared = words(130)
        many += [(2 * i, f"{shared} {words(75)}"), (2 * i + 1, f"{shared} {words(75)}")]

    def counted(docs, ids, k):
        asked.append(ids.count())
        return plain(docs, ids, k)

    monkeypatch.setattr(jaccard, "sets_of", counted)
    got = jaccard.classes(spark.createDataFrame(many, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(i, i) for i in range(40)]
    assert asked[-1] == 0


def test_jaccard_maps_lose_no_link():
    rng, sets = np.random.default_rng(6), []
    for n in (1, 3, 60, 64, 65, 127, 130, 500, 1030, 3000):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        for less in (0, n // 20, n // 8, n // 3):  # sizes on both sides of a map's number of bits
            other = rng.integers(0, 2**63, n // 40).astype(np.uint64)
            sets += [np.unique(base[less:]), np.unique(np.concatenate((base[less:], other)))]
    for percent in (30, 85):
        group = pd.DataFrame([(7, i, i, role, len(s), jaccard.parity(s)) for i, s in enumerate(sets) for role in (0, 1)], columns=["grp", "node", "root", "role", "n", "parity"])
        left = {(r.node, r.role) for r in jaccard.may_link(group, percent).itertuples()}
        linked = {i for i, j in permutations(range(len(sets)), 2) if 100 * jaccard.overlap(sets[i], sets[j]) >= percent * len(np.union1d(sets[i], sets[j]))}
        assert linked and {(i, role) for i in linked for role in (0, 1)} <= left
    alone = pd.DataFrame([(7, i, i, i % 2, 800, jaccard.parity(np.unique(rng.integers(0, 2**63, 800).astype(np.uint64)))) for i in range(20)], columns=group.columns)
    assert not len(jaccard.may_link(alone, 85))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_keeps_a_chunk_once_whatever_marks_follow(name):
    from tokenizers import Tokenizer

    path = tokens.vocabulary(name)
    use, plain = tokens.Encoder(path), Tokenizer.from_file(path)
    spaces = [c for c in map(chr, range(0x110000)) if c.isspace()]
    ended = ["x word" + m for m in (*tokens._MARKS, "...", ".)", '."')] + [" word, word. (word) word;\nword!"]
    odd = [f"{a}a{c}{d}b {c}{d} c{d}" for c in spaces for d in (c, " ", "\n") for a in ("", c)]
    odd += [f"{c}{m} {m}{c}{m} {c}-{m}" for c in ("", "7", "\u00b2", "\u00bd", "\u0301", "e\u0301", "\u4e2d", "\U0001f600", "'s", "_", "\ud55c") for m in (".", "),", "#(")]
    for part in (ended, odd):
        ids, counts = use.encode(part)
        want = [[*plain.encode(x, add_special_tokens=False).ids, tokens.END_ID] for x in part]
        assert counts.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]
        if part is ended:
            assert sorted(x for x in use.known if "word" in x and "(" not in x) == ["\nword", " word"]
    assert "".join(spaces) == tokens._BLANKS[1:-4]
