"""License scan, sharding, language ID, PII, quality, pieces: contracts, edge cases and brute force."""

import math
import random
import re
import zlib
from datetime import date

import numpy as np
import pytest

from stakeweave.llm import langid, licenses, pieces, pii, quality, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, "   \n\t ", "en", "s", 6), (3, "   \n\t ", "en", "s", 6), (None, "plain words here", None, "s", 16),
    (5, "x" * 50_000 + " Under the MIT License " + "y " * 20_000, "en", "s", 1), (6, "ÀÉ über ß 漢字 \x00 end", "fr", None, 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).selectExpr("*", "1 AS words", "2 AS score", "3 AS n_words", "4 AS label", "5 AS shard", "6 AS size", "7 AS hits", "8 AS places")


def test_license_places_by_brute_force(spark, odd):
    rng = random.Random(1)
    vocabulary = "under the mit license apache version 2 cc by nc work gnu general public a b".split()
    rows = [(i, " ".join(rng.choices(vocabulary, k=300)) + rng.choice([" Under-THE.MIT license", " Apache License, Version 2.0", ""]), "en", "s", 1) for i in range(40)]
    base = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    for frame, texts in ((spark.createDataFrame(rows, DOCS), {r[0]: r[1] for r in rows}), (odd, {r[0]: r[1] for r in ODD})):
        got = licenses.scan_licenses(frame).collect()
        assert len(got) == frame.count()
        for r in got:
            text = texts[r.doc_id] or ""
            low = "".join(c.lower() if c.isascii() else c for c in text)
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
            at = {k: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for k, p in base.items()}
            every = sorted(x for xs in at.values() for x in xs)
            assert (r.n_words, r.n_base) == (len(words), len(every))
            assert (r.first_word, r.last_word) == ((every[0], every[-1]) if every else (None, None))
            assert r.base_labels == ",".join(sorted(k for k in at if at[k]))
            assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_longer_license_phrases_beat_the_shorter(spark):
    texts = {
        "Creative Commons Attribution-NonCommercial-ShareAlike 4.0": "cc-by-nc-sa", "Creative Commons Attribution 4.0 International": "cc-by", "Creative Commons Attribution-NoDerivatives": "cc-by-nd",
        "GNU General Public License": "gpl", "GNU General Public License, version 3": "gpl-3", "GNU General Public License version 2 and the GNU General Public License": "gpl,gpl-2", "CC BY-NC-SA": "cc-by-nc",
    }
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in got] == list(texts.values())


def test_license_empty_table(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0


def test_sharding_laws(spark, odd):
    rows = spark.createDataFrame([(i, f"t{i % 7}", "en", "s", 2) for i in range(4000)], DOCS)
    got = sharding.shard_rows(rows).collect()
    assert len(got) == 4000 and {r.shard for r in got} == set(range(8))
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    assert 300 < sum(r.grown_shard == 8 for r in got) < 600 and min(sum(r.shard == s for r in got) for s in range(8)) > 400
    again = {r.doc_id: r.shard for r in sharding.shard_rows(rows.filter("doc_id % 3 = 0").repartition(3)).collect()}
    assert all(again[r.doc_id] == r.shard for r in got if r.doc_id % 3 == 0)
    for r in sharding.shard_rows(odd).collect():
        text = {x[0]: x[1] for x in ODD}[r.doc_id] or ""
        assert (r.size, r.text_crc32) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
    assert sharding.shard_rows(odd.limit(0)).count() == 0


def test_repeated_rows_get_slots_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 100)
    rows = spark.range(3000).selectExpr("if(id < 1200, null, if(id < 2000, 7, id)) AS doc_id", "if(id % 3 = 0, null, concat('t', id % 2)) AS text", "1 AS shard", "2 AS slot", "3 AS n", "4 AS first")
    got = sharding.shard_rows(rows).collect()
    assert len(got) == 3000
    for s in range(8):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    count = lambda xs: {k: xs.count(k) for k in set(xs)}
    assert count([(r.doc_id, r.size, r.text_crc32) for r in got]) == count([(r.doc_id, len(r.text or "") + 1, zlib.crc32((r.text or "").encode())) for r in rows.collect()])


def test_weights_move_rows_only_within_their_subtree(spark):
    from pyspark.sql import functions as F

    tree = sharding.default_tree(8)
    heavier = {**tree, "region0": {**tree["region0"], "rack0": {"0": 1.0, "1": 1.0}}, "region1": {"rack2": {"4": 1.0, "5": 1.0}, "rack3": {"6": 0.5, "7": 1.5}}}
    rows = spark.range(3000).select(F.col("id"), sharding.descend(F.col("id").cast("string"), tree).alias("a"), sharding.descend(F.col("id").cast("string"), heavier).alias("b")).collect()
    moved = {(r.a, r.b) for r in rows if r.a != r.b}
    assert moved and moved <= {(6, 7)}


def test_suffix_automaton_accepts_exactly_the_substrings():
    rng = random.Random(3)
    text = "".join(rng.choices("abc", k=60))
    move = langid.suffix_automaton([ord(c) for c in text])
    parts = {text[i:j] for i in range(61) for j in range(i, 61)}
    for probe in [*parts, *("".join(rng.choices("abcd", k=rng.randrange(1, 9))) for _ in range(300))]:
        state = 0
        for c in probe:
            state = move[state].get(ord(c)) if state is not None else None
        assert (state is not None) == (probe in parts)


def brute_phrases(text: str, trained: str) -> int:
    """Phrases of the whole text by trying every length; symbols that training lacks ("\0") count twice."""
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in trained:
            j += 1
        n, i = n + 1, max(i + 1, j - 1)
    return n + text.count("\0")


@pytest.mark.parametrize("seed", range(6))
def test_phrases_by_brute_force(seed):
    rng = random.Random(seed)
    texts = {"x": "".join(rng.choices("ab c", k=3000)), "y": "".join(rng.choices("bcd ", k=400)), "z": "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(2000))}
    parser, block = langid.Parser(texts), langid.BLOCK
    probes = ["".join(rng.choices("abcd e", k=k)) for k in (1, 30, 700, 1500, block - 1, block, block + 1, 2 * block)]
    probes += [texts["x"][200:2900], texts["z"][5:1800] + "ab" + texts["z"][100:1900], "q" * 1300, texts["y"] * 6]  # phrases over many blocks
    got = parser.score(probes)
    for k, probe in enumerate(probes):
        own = parser.coded(probe)
        assert len(own) == len(re.sub(" +", " ", probe).lstrip(" ") if probe.strip() else probe) or probe.startswith(" ")
        for i, lang in enumerate(parser.langs):
            spell = lambda c, i=i: "".join(chr(0x100 + x) if x else "\0" for x in parser.symbols[i][c])
            assert got[i, k] == pytest.approx(brute_phrases(spell(own), spell(parser.coded(texts[lang]))) * parser.bits[i] / max(len(own), 1))


def test_transitions_laid_into_one_array():
    rng = random.Random(9)
    symbols = [rng.choice([1, 2, 3, rng.randrange(4, 700)]) for _ in range(3000)]
    move = langid.suffix_automaton(symbols)
    packed = langid.Automaton(move, 701)
    assert len(packed.to) < 3 * sum(map(len, move)) + 3000
    for s, own in enumerate(move):
        at = packed.base[s] + np.arange(701)
        mine = np.flatnonzero(packed.owner[np.minimum(at, len(packed.owner) - 1)] == s)
        assert {c: int(packed.to[packed.base[s] + c]) for c in mine.tolist()} == own


def test_languages_of_thousands_of_letters(spark):
    rng = random.Random(10)
    text = lambda i, k: "".join(chr(0x4E00 + 3000 * i + rng.randrange(3000)) for _ in range(k))
    rows = [(d, text(d % 3, 700), f"l{d % 3}", "s", 1) for d in range(240)] + [(1000, "Ж" * 9, None, "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = langid.identify(docs).collect()
    assert all(r.lang_pred == f"l{r.doc_id % 3}" and r.score > 0.3 for r in got if r.doc_id < 1000)
    assert sorted(map(str, langid.identify(docs, languages=1).collect())) == sorted(map(str, got))


def test_language_held_out_accuracy_and_edges(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    got = {r.doc_id: r for r in langid.identify(odd).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3)) and got[6].lang_pred != "und"
    assert [r.lang_pred for r in langid.identify(odd.withColumn("lang", odd.lang.substr(9, 1)).filter("lang = 'z'")).collect()] == []
    assert {r.lang_pred for r in langid.identify(odd.selectExpr("doc_id", "text", "cast(null AS string) AS lang")).collect()} == {"und"}


VALUES = {
    "card": ["4111 1111 1111 1111", "378282246310005", "3782 822463 10005", "4111-1111-1111-1111"], "phone": ["+1 (743) 555-3824", "+44 20 7946 0958", "+49 30 901820", "(030) 9018-2000", "743-555-3824", "+33 1 42 68 53 00"],
    "ssn": ["078-05-1120"], "ip": ["192.168.10.1"], "date": ["2024-02-29", "31/12/1999", "3/7/2024", "03/7/2024", "3/17/2024", "12/25/1999", "1.2.2003", "28.10.2011"], "email": ["und.34@mail7.example.com"],
    "iban": ["GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00"],
    "secret": ['token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "API_KEY=sk1Zx83hT0aaQ2lmP9", "password: 'Correct9Horse7Battery'", 'secret="1234567890123456"', "my_token: 0011aabbccddeeff0"],
}


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, ts in VALUES.items() for t in ts])
@pytest.mark.parametrize("key", [b"k", b"another"])
def test_pseudonyms_keep_format_and_invert(kind, text, key):
    f, back = pii.Feistel(key), pii.Feistel(key, inverse=True)
    new, kinds = pii.pseudonymise(f"see {text} now", f)
    assert kinds == {kind: 1} and new != f"see {text} now" and new.startswith("see ") and new.endswith(" now")
    assert pii.pseudonymise(new, back)[0] == f"see {text} now"
    assert pii.pseudonymise(f"{text}, {text}, {text}.", f)[0].count(new[4:-4]) == 3
    value = new[4:-4]
    if kind not in ("ip", "secret"):
        shape = lambda s: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", s)))
        assert shape(value) == shape(text)
    digits = re.sub(r"\D", "", value)
    if kind == "iban":
        own = value.replace(" ", "")
        assert own[:2] == text[:2] and int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1
    if kind == "card":
        assert pii.luhn(digits)
    if kind == "phone" and text[0] == "+":
        assert value.split(" ")[0] == text.split(" ")[0]
    if kind == "date":
        y, m, d = (int(x) for x in (value.split("-") if "-" in value else reversed(re.split(r"\D", value))))
        assert date(y, *((m, d) if not text.startswith(("3/17", "12/25")) else (d, m)))


def test_dates_of_a_shape_are_permuted_among_themselves():
    f = pii.Feistel(b"k")
    for shape in ("{d}/{m}/{y}", "{d:02d}/{m}/{y}", "{d}.{m:02d}.{y}", "{y}-{m:02d}-{d:02d}", "{m}/{d}/{y}"):
        days = [date.fromordinal(x) for x in range(date(1990, 1, 1).toordinal(), date(1996, 1, 1).toordinal())]
        days = [x for x in days if not shape.startswith("{m}") or x.day > 12]
        old = [shape.format(y=x.year, m=x.month, d=x.day) for x in days]
        new = [pii.calendar(f, x) for x in old]
        assert len(set(new)) == len(set(old)) and [len(x) for x in new] == [len(x) for x in old]
        assert [pii.calendar(pii.Feistel(b"k", inverse=True), x) for x in new] == old


def test_unvalidated_numbers_stay():
    f = pii.Feistel(b"k")
    for text in ("8007782375593431", "999.300.1.1", "2024-02-30", "000-12-3456", "12345", "x4111111111111111", "a@b", "@", "", "1" * 16, "+5 10 20", "GB82 WEST 1234 5698 7654 33", "key: misunderstandingly", "see (12) 34"):
        assert pii.pseudonymise(text, f) == (text, {})


def test_many_values_in_one_text_by_brute_force():
    """Values replaced one by one, each alone, give the same text as the whole."""
    rng, f, back = random.Random(12), pii.Feistel(b"k"), pii.Feistel(b"k", inverse=True)
    values = [t for ts in VALUES.values() for t in ts]
    for _ in range(20):
        own = [rng.choice(values) for _ in range(30)]
        text = " and; ".join(own)
        new, kinds = pii.pseudonymise(text, f)
        assert new == " and; ".join(pii.pseudonymise(v, f)[0] for v in own) and sum(kinds.values()) == 30
        assert pii.pseudonymise(new, back)[0] == text


def test_query_of_documents_by_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in pii.pseudonymised(rows, b"k").collect()}
    back = {r.doc_id: r.text for r in pii.pseudonymised(spark.createDataFrame([(r.doc_id, r.text) for r in got.values()], "doc_id long, text string"), b"k", inverse=True).collect()}
    hit = 0
    for r in rows.collect():
        new, kinds = pii.pseudonymise(r.text, pii.Feistel(b"k"))
        assert (got[r.doc_id].text, got[r.doc_id].n_pii) == (new, sum(kinds.values())) and back[r.doc_id] == r.text
        hit += bool(kinds)
    assert hit


def test_keys_come_from_the_session(spark):
    old = spark.conf.get(pii.KEY_CONF, None)
    try:
        spark.conf.unset(pii.KEY_CONF)
        drawn = pii.session_key(spark)
        assert len(drawn) == 64 and pii.session_key(spark) == drawn
        spark.conf.set(pii.KEY_CONF, "mine")
        assert pii.session_key(spark) == b"mine"
    finally:
        spark.conf.set(pii.KEY_CONF, old) if old else spark.conf.unset(pii.KEY_CONF)


def test_feistel_is_a_permutation():
    f = pii.Feistel(b"k")
    for size in (1, 2, 7, 100, 1000):
        assert sorted(f.permute(x, size, "t") for x in range(size)) == list(range(size))


def test_pii_frames(spark, odd):
    got = pii.pseudonymised(odd.selectExpr("*", "7 AS n_pii", "8 AS PII_kinds"), b"k").collect()
    assert len(got) == len(ODD) and got[0].text is None and got[0].n_pii_ == 0 and (got[0].words, got[0].n_pii, got[0].PII_kinds, got[0].pii_kinds_) == (1, 7, 8, "")
    assert pii.pseudonymised(odd.limit(0), b"k").count() == 0


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = {w: windows.count(w) for w in set(windows)}
    covered = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_quality_statistics_by_brute_force():
    rng = random.Random(6)
    ids = quality.WordIds()
    texts = [None, "", " \n ", "a b c d e a b c d e", "x\nx\n \n\ny\nx", "one # two|*"] + ["".join(rng.choices(["a ", "b ", "c\n", "d  ", "$ "], k=rng.randrange(80))) for _ in range(60)]
    for t in texts:
        assert quality.statistics(t, ids)[0] == brute_quality(t)


def test_quality_keeps_good_and_rejects_junk(spark, odd):
    """Fitted on the labels of even hashes, read on the others, on a table that no choice was made on."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    half = labels.selectExpr("*", "crc32(cast(cast(doc_id AS string) AS binary)) % 2 = 0 AS fit")
    rows = quality.judged(docs, half.filter("fit")).join(half.filter("not fit"), "doc_id").collect()
    good, bad = ([r for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) > 100 and np.mean([r.kept for r in good if not r.base_failed]) >= 0.97
    assert len(bad) > 20 and np.mean([not r.kept for r in bad]) >= 0.9
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.judged(odd, none).collect()
    assert len(got) == len(ODD) and all(r.kept != r.base_failed for r in got)
    assert quality.judged(odd.limit(0), none).count() == 0


def test_quality_query_by_brute_force(spark):
    """Every row against a forest walked node by node, and a threshold found by trying all."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.judged(docs.selectExpr("*", "1 AS x", "2 AS score"), labels.unionByName(labels)).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    mark = {r.doc_id: r.quality for r in labels.collect()}
    x = {i: np.array(quality.statistics(t, quality.WordIds())[1]) for i, t in texts.items()}
    every = np.array(list(x.values()))
    good = quality.one_per_bucket(spark.createDataFrame([(i, v.tolist()) for i, v in x.items() if mark.get(i) == 1], "doc_id long, x array<double>"))
    forest = quality.Forest(good, every.min(0), every.max(0))

    def path(tree, v):
        f, value, left, right, length = tree
        at = 0
        while f[at] >= 0:
            at = left[at] if v[f[at]] < value[at] else right[at]
        return length[at]

    score = {i: 2 ** (-np.mean([path(t, v) for t in forest.trees]) / forest.c) for i, v in x.items()}
    kept = {}
    for step in range(2001):
        over = {q: np.mean([score[i] >= step / 2000 for i in mark if mark[i] == q]) for q in (0, 1)}
        kept[step] = over[0] - over[1] if over[1] <= 0.005 else -1
    threshold = max(kept, key=lambda s: (kept[s], -s)) / 2000
    for i, r in got.items():
        base = brute_quality(texts[i])
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (*base, failed)
        assert r.score == pytest.approx(score[i]) and r.kept == (not failed and score[i] < threshold)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces()


def test_viterbi_by_brute_force(vocabulary):
    rng = random.Random(8)
    words = sorted({"▁" * rng.randrange(3) + "".join(rng.choices("theraninsó漢", k=rng.randrange(1, 9))) for _ in range(300)} - {""})
    score = {}

    def walk(node, text):
        for c, sub in node.items():
            if c == "":
                score[text] = sub
            else:
                walk(sub, c + text)

    walk(vocabulary.back, "")
    for word, ids in vocabulary.encode_sorted(words):
        best = [(0.0, [])]
        for end in range(1, len(word) + 1):
            options = [(best[s][0] + score[word[s:end]][0], best[s][1] + [score[word[s:end]][1]]) for s in range(end) if word[s:end] in score]
            if word[end - 1] not in score:
                options.append((best[end - 1][0] + vocabulary.unknown, best[end - 1][1] + [vocabulary.byte_id[b] for b in word[end - 1].encode()]))
            best.append(max(options, key=lambda o: o[0]))
        total = 0.0
        own = np.frombuffer(ids, np.int32).tolist()
        for i in own:
            text = vocabulary.bytes_of[i].decode("utf-8", "replace").replace(" ", "▁")
            total += score[text][0] if text in score and score[text][1] == i else 0.0
        expected = sum(score[t][0] for i in best[-1][1] for t in [vocabulary.bytes_of[i].decode("utf-8", "replace").replace(" ", "▁")] if t in score and score[t][1] == i)
        assert total == pytest.approx(expected) and vocabulary.decode(own).lstrip() == word.replace("▁", " ").lstrip()


def test_whole_texts_by_brute_force(spark, vocabulary):
    """Every row of the query against one search over the whole text, without words, trie or shared scores."""
    score = {}
    walk = [(vocabulary.back, "")]
    while walk:
        node, text = walk.pop()
        for c, sub in node.items():
            if c == "":
                score[text] = sub[0]
            else:
                walk.append((sub, c + text))
    assert abs(sum(math.exp(s) for s in score.values()) - 1) < 1e-9
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 1500").select("doc_id", "text").limit(40).collect()
    rows = [(r.doc_id, r.text) for r in rows] + [(-1, None), (-2, ""), (-3, " a  b\n\n c 漢字😀\u2581x")]
    got = {r.doc_id: r for r in pieces.encoded(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc_id, text in rows:
        marked = pieces.MARK + text.replace(" ", pieces.MARK) if text else ""
        best = [0.0]
        for end in range(1, len(marked) + 1):
            own = [best[s] + score[marked[s:end]] for s in range(max(0, end - 40), end) if marked[s:end] in score]
            best.append(max([*own, *([best[end - 1] + vocabulary.unknown] if marked[end - 1] not in score else [])]))
        spelt = [vocabulary.bytes_of[i].decode("utf-8", "replace").replace(" ", pieces.MARK) for i in got[doc_id].input_ids]
        unknown = sum(c not in score for c in marked)
        total = sum(score[s] for s, i in zip(spelt, got[doc_id].input_ids, strict=True) if i not in vocabulary.byte_id) + unknown * vocabulary.unknown
        assert total == pytest.approx(best[-1]) and got[doc_id].n_tokens == len(got[doc_id].input_ids)


def test_pieces_are_about_as_few_as_the_librarys(vocabulary, spark):
    import sentencepiece

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text is not null").select("text").collect()]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert sum(map(len, pieces.Encoder(vocabulary).encode(texts))) < 1.03 * sum(map(len, library.encode(texts)))


def test_round_trip(spark, odd):
    assert all(r.exact for r in pieces.round_trip(odd).collect())
    clash = odd.selectExpr("*", "7 AS input_ids", "8 AS n_tokens")
    assert [(r.input_ids, r.n_tokens, r.n_tokens_) for r in pieces.encoded(clash).collect()] == [(7, 8, len(r.input_ids_)) for r in pieces.encoded(clash).collect()]
    both = pieces.decoded(pieces.encoded(odd)).collect()
    assert [r.text for r in both] == [(t[1] or "") for t in ODD] and both[0].words == 1
    assert pieces.encoded(odd.limit(0)).count() == 0
