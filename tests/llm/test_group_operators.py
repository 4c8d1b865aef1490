"""Jaccard join, decontamination, WARC and the pipeline."""

import base64
import collections
import hashlib
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest

from stakeweave.llm import decontaminate, jaccard, pieces, pii, quality, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def components(texts: dict, k: int, t: int) -> tuple[dict, dict]:
    sets = {}
    for i, x in texts.items():
        w = (x or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= t * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "t", "every"), [(4, 85, 16), (2, 60, 1), (5, 80, 1)])
def test_components_by_brute_force(spark, k, t, every):
    rng = random.Random(k)
    texts = {1: None, 2: "", 3: " \t", 4: "a b", 5: "A  b", 6: "a b c"}
    for i in range(10, 130):
        if i % 3 and i > 20:
            w = texts[rng.randrange(10, i)].split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice("pqrstuv")
            texts[i] = " ".join(w)
        else:
            texts[i] = " ".join(rng.choices("abcdefgh", k=rng.choice([4, 12, 40])))
    rows = [(i, x, "en", "s", 1) for i, x in texts.items()] + [(None, "a b", "en", "s", 1), (4, "a b", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS n", "2 AS rep", "3 AS token", "4 AS comp")
    want, sizes = components(texts, k, t)
    got = jaccard.jaccard_components(docs, k, t, every=every, frequent=8).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.n_shingles == (sizes[r.doc_id] if r.doc_id is not None else 1)
    assert jaccard.jaccard_components(docs.limit(0), k, t).count() == 0


def test_a_repeated_long_row_links_nothing_new(spark):
    rows, ids = [], [i for i in range(40) if zlib.crc32(str(i).encode()) % 16]  # not of the sample that ranks frequent shingles
    for g, times in enumerate([(2, 1), (1, 2), (2, 2)]):
        w = [f"w{g}x{i}" for i in range(104)]
        near = w[:86] + [f"v{g}x{i}" for i in range(18)]  # 100 shingles of five words each, 82 shared: Jaccard 0.69
        for side, text in enumerate((w, near)):
            rows += [(ids[2 * g + side], " ".join(text), "en", "s", 1)] * times[side]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, DOCS), 5, 80).collect()
    assert len(got) == len(rows) and all((r.n_shingles, r.component_id) == (100, r.doc_id) for r in got)


@pytest.mark.parametrize("seed", range(2))
def test_doc_ids_with_several_texts_link_their_classes(spark, seed):
    rng = random.Random(seed)
    x, y = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(2, x), (4, x), (4, y), (7, y), (8, "alone here"), (9, None), (9, "alone  HERE"), (9, "")]
    texts = ["a b c d e f", "b c d e f g", "c d e f g h", "p q r s t u", "q r s t u v", "w x", "y z"]
    rows += [(rng.randrange(100, 130), rng.choice(texts) + " tail" * rng.randrange(2)) for _ in range(24)]
    got = {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOCS), 4, 60).collect()}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))}) for i, t in rows if (w := (t or "").lower().split())]
    for i, a in sets:
        for j, b in sets:
            if 100 * len(a & b) >= 60 * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    assert got == {(i, find(i)) for i, _ in rows} and (4, 2) in got and (7, 2) in got and (9, 8) in got


def test_ids_at_the_ends_of_the_bitmap(spark):
    ids = [25317696, 1, 2]  # xxhash64 of the first is 0 modulo 2^24
    docs = spark.createDataFrame([(i, f"some words of {i} here", "en", "s", 1) for i in ids], DOCS)
    order = spark.sparkContext.broadcast(jaccard.Order(np.empty(0, np.uint64)))
    wanted = spark.createDataFrame([(i,) for i in ids[:2]], "rep long")
    assert {r.rep for r in jaccard.segments(docs, wanted, order, 5, False).collect()} == set(ids[:2])


def test_decontamination_finds_verbatim_and_paraphrase_only(spark):
    rng = random.Random(2)
    vocabulary = ["the", "of", "and"] + ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(900)]
    item = lambda n: rng.choices(vocabulary, k=n)
    items = {i: item(rng.randrange(15, 50)) for i in range(20)}
    rows, want = [], set()
    for d in range(200):
        w = item(rng.randrange(30, 400))
        if d % 4 == 0:
            i = d // 4 % 20
            own = list(items[i])
            for _ in range(len(own) // 5 if d % 8 else 0):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            at = rng.randrange(len(w))
            w[at:at] = own
            want.add((d, i))
        rows.append((d, " ".join(w).title(), "en", "s", 1))
    rows += [(900, None, "en", "s", 1), (901, "", "en", "s", 1), (902, "the " * 60_000, "en", "s", 1), (None, " ".join(items[0]), "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS item_id", "2 AS word")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(50, None), (51, ""), (None, "x")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert len(want & got) >= 0.9 * len(want) and got <= want
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def plain(text):
    return [w.decode() for w in decontaminate.words(text)]


def test_words_are_runs_of_word_characters():
    for text in ("", None, "A b_c-d 1", "Überß “Straße”\u00a0x e\u0301f \u0130 漢字、仮名", "a\ud800b", "\x00a\x1fb"):
        assert [w.decode("utf-8", "surrogatepass") for w in decontaminate.words(text)] == (re.findall(r"\w+", text.lower()) if text else [])


def test_recall_of_the_latent_index_on_planted_items(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: " ".join(plain(r.text)) for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, x in items.items() if f" {x} " in " " + " ".join(plain(r.text)) + " "}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert want and want <= got


def test_recall_of_paraphrases(spark):
    """By share of words changed, with the answer (the rarest third, by counts made here) kept or not; sf0.01 and the seed were not used to choose settings."""
    rng = random.Random(20261127)
    docs, bench = ([(r[0], plain(r[1])) for r in spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").select(c, "text").orderBy(c).collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    count = collections.Counter(w for _, own in docs for w in set(own))
    corpus = [w for _, own in docs for w in own]
    clean = [own for _, own in docs if len(own) > 60 and not any(f" {' '.join(item[:6])} " in f" {' '.join(own)} " for _, item in bench)]
    rows, want = [], {}
    for keep in (False, True):
        for share in (0.0, 0.1, 0.2, 0.3, 0.4):
            for item_id, item in bench * 3:
                own, rare = list(item), set(sorted(set(item), key=lambda w: (count[w], w))[: max(3, len(set(item)) // 3)])
                free = [j for j, w in enumerate(item) if not (keep and w in rare)]
                for j in rng.sample(free, min(len(free), round(share * len(own)))):
                    own[j] = rng.choice(corpus)
                host = rng.choice(clean)[:400]
                at = rng.randrange(len(host) + 1)
                want.setdefault((keep, share), set()).add((len(rows), item_id))
                rows.append((len(rows), " ".join(host[:at] + own + host[at:]), "en", "s", 1))
    found = decontaminate.contaminated(spark.createDataFrame(rows, DOCS), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    recall = {k: len(pairs & got) / len(pairs) for k, pairs in want.items()}
    assert min(recall.values()) >= 0.9, recall
    assert len(got - set().union(*want.values())) <= 0.005 * len(rows)


def test_recall_does_not_fall_as_the_benchmark_grows(spark):
    rng = random.Random(5)
    long = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("length(text) > 1500").orderBy("doc_id").limit(1600).collect()
    texts = [plain(r.text) for r in long]
    items, rows, want = [], [], {"verbatim": set(), "changed": set()}
    for i in range(800):
        size, w = rng.randrange(15, 60), texts[i]
        at = rng.randrange(max(1, len(w) - size))
        items.append((i, " ".join(w[at : at + size])))
        own, host = w[at : at + size], texts[800 + i % (len(texts) - 800)][:400]
        if i % 2:
            for j in rng.sample(range(len(own)), len(own) // 5):
                own[j] = rng.choice(host)
        place = rng.randrange(len(host))
        rows.append((i, " ".join(host[:place] + own + host[place:]), "en", "s", 1))
        want["changed" if i % 2 else "verbatim"].add((i, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, DOCS), bench).collect()}
    share = {kind: len(pairs & got) / len(pairs) for kind, pairs in want.items()}
    assert min(share.values()) >= 0.9, share


def test_badly_represented_items_get_directions_of_their_own():
    rng = np.random.default_rng(1)
    items = [rng.integers(1, 400, 30) for _ in range(40)]
    basis = np.linalg.qr(rng.standard_normal((401, 8)))[0]
    whole = decontaminate.completed(basis, items, np.ones(401))
    assert np.allclose(whole.T @ whole, np.eye(whole.shape[1]))
    for own in items:
        x = np.bincount(own, minlength=401)
        assert np.linalg.norm(x @ whole) >= decontaminate.SHARE * np.linalg.norm(x)


def test_the_latent_space_is_fitted_on_every_document(spark, monkeypatch):
    ids = spark.range(5000).selectExpr("id", "xxhash64(id) AS h").selectExpr("id", "row_number() OVER (PARTITION BY pmod(h, 2048) ORDER BY h) AS place")
    last = ids.filter("place = 2").first().id  # a sample of one document in each of 2048 hash buckets would miss it
    rows = [(i, "alpha beta " * 40_000 if i == last else "nothing of note here") for i in range(5000)]
    bench = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, "gamma delta gamma"), (4, "delta gamma")], "item_id long, text string")
    seen, completed = [], decontaminate.completed
    monkeypatch.setattr(decontaminate, "completed", lambda basis, *rest: seen.append(basis) or completed(basis, *rest))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench, rank=1).collect()}
    assert got == {(last, 1)} and len(seen) == 1
    assert np.abs(seen[0][1:3, 0]).min() > 0.7 and np.abs(seen[0][3:, 0]).max() < 0.1  # alpha and beta, the leading direction of all passages


def test_passages_give_the_gram_matrix():
    rng = np.random.default_rng(4)
    ids, idf = rng.integers(0, 30, 1000).astype(np.int32), rng.random(31) + 0.1
    basis = rng.standard_normal((31, 5))
    basis[0] = 0
    full = np.zeros((-(-len(ids) // decontaminate.PASSAGE), 31))
    for at, w in enumerate(ids):
        full[at // decontaminate.PASSAGE, w] += idf[w]
    full /= np.linalg.norm(full, axis=1, keepdims=True)
    full[:, 0] = 0
    out = np.zeros_like(basis)
    decontaminate.gram(decontaminate.passages(ids), idf, basis, out)
    assert np.allclose(out, full.T @ (full @ basis), atol=1e-4)


def test_the_gram_matrix_of_many_passages_is_made_in_small_matrices(monkeypatch):
    rng = np.random.default_rng(6)
    ids, idf = (2999 * rng.random(300_000) ** 3).astype(np.int32), rng.random(3001) + 0.1
    ids[:200] = 0  # passages without a known word, and one that is cut off at the end
    basis = rng.standard_normal((3001, 5))
    basis[0] = 0
    rows = decontaminate.passages(ids)
    full, out, cells, zeros = np.zeros((len(rows), 3001)), np.zeros_like(basis), [], np.zeros
    np.add.at(full, (np.arange(len(ids)) // decontaminate.PASSAGE, ids), idf[ids])
    full /= np.linalg.norm(full, axis=1, keepdims=True)
    full[:, 0] = 0
    monkeypatch.setattr(np, "zeros", lambda shape, *rest: cells.append(np.prod(shape) * (rest == (np.float32,))) or zeros(shape, *rest))
    decontaminate.gram(rows, idf, basis, out)
    monkeypatch.undo()
    assert np.allclose(out, full.T @ (full @ basis), atol=1e-3)
    assert sum(cells) < 25 * np.count_nonzero(full)


def test_warc_round_trip_and_push_down(spark, tmp_path):
    rows = [(5, "http://a/ä b%20c", "one"), (3, "http://a/2", "one"), (7, None, None), (8, "http://b/\n", ""), (9, "http://b/9", "two é" * 10_000), (4, "u", "one"), (None, "u", "three")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS first", "2 AS payload")
    path = warc.write_warc(warc.deduplicated(pages), f"file://{tmp_path}/x")
    got = {r.page_id: r for r in warc.read_warc(spark, path).collect()}
    assert len(got) == len(rows)
    for page_id, url, html in rows:
        data, r = (html or "").encode(), got[page_id]
        assert (r.target_uri, r.payload_bytes) == (url, len(data)) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == data
    assert {i: got[i].refers_to for i in got} == {5: 3, 3: None, 4: 3, 7: None, 8: 7, 9: None, None: None}
    chosen = warc.read_warc(spark, path, "skip").filter("record_type = 'revisit' AND target_uri LIKE 'http://a%'")
    assert [r.page_id for r in chosen.collect()] == [5] and chosen.filter("page_id IN (3, 4)").count() == 0
    assert warc.read_warc(spark, warc.write_warc(warc.deduplicated(pages.limit(0)), f"file://{tmp_path}/none")).count() == 0


def test_appending_keeps_the_archive(spark, tmp_path):
    path = f"file://{tmp_path}/x"
    for rows in ([(1, "u", "one")], [(2, "v", "two"), (3, "v", "two")], [], [(1, "u", "one"), (1, "u", "one"), (1, "u", "other"), (4, None, "x" * 3_000_000)]):
        warc.write_warc(warc.deduplicated(spark.createDataFrame(rows, "page_id long, url string, html string")), path)
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_warc(spark, path).collect())
    assert got == [(1, "response", None, 3)] * 3 + [(1, "response", None, 5), (2, "response", None, 3), (3, "revisit", 2, 3), (4, "response", None, 3_000_000)]
    (tmp_path / "x" / "part-of-a-lost-task.warc.gz").write_bytes(warc.member(warc.record("response", 9, "u", b"x", warc.sha1_base32(b"x"), 1, None)))
    assert warc.read_warc(spark, path).count() == len(got)


def test_reader_takes_plain_members_and_pushes_filters(tmp_path):
    import gzip

    from pyspark.sql.datasource import EqualTo

    plain = [warc.record("response", i, f"http://x/{i}", b"p" * i, warc.sha1_base32(b"p" * i), i, None) for i in range(4)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) if i % 2 else warc.member(p) for i, p in enumerate(plain)))
    reader = warc.WarcReader(str(tmp_path), "return")
    assert [r["payload"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == [b"p" * i for i in range(4)]
    assert list(reader.pushFilters([EqualTo(("target_uri",), "http://x/2"), EqualTo(("payload_bytes",), 2)])) == [EqualTo(("payload_bytes",), 2)]
    assert [r["page_id"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == [2]


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 AS n_tokens", "2 AS component_id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    twice = docs.limit(40).union(docs.limit(40)).unionByName(spark.createDataFrame([(None, "null id words", "en", "s", 3, 1, 2)], docs.schema))
    kept = corpus_pipeline.near_duplicates(spark, twice, sf).collect()
    ids = [r.doc_id for r in kept]
    assert len(set(ids)) == len(ids) and None in ids


def test_pipeline_by_brute_force(spark):
    """Every stage worked out in Python from what the stage before it should keep."""
    sf = "/root/testdata/sf0.001"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality.judged(docs, labels).filter("kept").collect()}  # itself tested row by row
    assert all(len((texts[i] or "").split()) >= 10 for i in good)
    texts = {i: texts[i] for i in good}
    root, _ = components(texts, 5, 80)
    texts = {i: t for i, t in texts.items() if root[i] == i}
    bench = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}

    def share(item, words):
        """The longest common subsequence of the item and the best stretch of 1.5 times its length, over the item's length."""
        best, size = 0, len(item) + len(item) // 2 + 1
        if len(set(item) & set(words)) < len(set(item)) // 3:
            return 0
        for at in range(0, max(1, len(words) - size + 1 + len(item) // 4), max(1, len(item) // 4)):
            line = [0] * (len(item) + 1)
            for w in words[at : at + size]:
                line, old = [0], line
                for j, x in enumerate(item):
                    line.append(max(old[j + 1], line[j], old[j] + (w == x)))
            best = max(best, line[-1])
        return best / len(item)

    shares = {i: max(share(item, plain(t)) for item in bench.values()) for i, t in texts.items()}
    assert not [x for x in shares.values() if 0.45 <= x < 0.75]  # nothing here is a paraphrase: items stand whole or not at all
    texts = {i: t for i, t in texts.items() if shares[i] < 0.75}
    f = pii.Feistel(pii.session_key(spark))
    texts = {i: pii.pseudonymise(t, f)[0] for i, t in texts.items()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert 0 < len(got) < docs.count() and set(got) == set(texts)
    vocabulary = pieces.Pieces()
    for i, t in texts.items():
        assert vocabulary.decode(got[i].input_ids) == t and got[i].n_tokens == len(got[i].input_ids) and got[i].n_chars == len(t)
