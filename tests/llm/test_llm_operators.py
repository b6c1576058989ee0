"""Corpus operators against brute force, round trips and held-out labels."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from groundshift.llm import decontaminate, language_id, mixing, near_join, quality, queries, simhash, token_counts, unit_dedup, url_rules, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "  \n ", "one", "one two three", "?!", "Ünïcödé ß", "a b c d e f g h i j k l", "x " * 5000, "A line of words that repeats itself.\n" * 3]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", 1) for i, t in enumerate(ODD)]
    rows += [(3, "one", "en", "s", 1), (None, "no id here at all", None, None, None), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("rep", "w", "n", "hit", "size", "target", "score", "fp", "root", "start", "tokens", "votes", "first_id", "sid", "of_id", "stays", "node", "h1"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# near join -------------------------------------------------------------------------------------


def shingle_set(text, width=5):
    w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_classes(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    ids = sorted(sets)
    where = defaultdict(list)
    for i in ids:
        for s in sets[i]:
            where[s].append(i)
    pairs = {(a, b) for members in where.values() for k, a in enumerate(members) for b in members[k + 1 :]}
    for a, b in pairs:
        inter = len(sets[a] & sets[b])
        if inter / (len(sets[a]) + len(sets[b]) - inter) >= 0.8:
            links[a] += 1
            links[b] += 1
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {i: (find(i), links[i]) for i in ids}


def test_near_join_equals_brute_force(spark):
    base = [f"w{i % 97}x{i % 13} v{i}" for i in range(120)]
    rows, n = [], 0
    for family in range(12):
        words = [f"f{family}", *base[family : family + 60]]
        for edit in range(7):
            rows.append((n, " ".join(words[: len(words) - edit * 2] + [f"e{edit}"] * (edit * 3))))
            n += 1
        rows.append((n, rows[-1][1]))
        n += 1
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    for block in (256, 5):
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows_of(near_join.near_duplicates(frame, block=block))}
        assert got == want


def test_near_join_on_documents(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows_of(near_join.near_duplicates(docs))}
    assert got == brute_classes(rows)


def test_near_join_odd_rows(odd, none):
    got = rows_of(near_join.near_duplicates(odd))
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[0]["class_id"] == 0 and by[0]["n_links"] == 0
    assert all(r["class_id"] is None for r in got if r["doc_id"] is None)
    assert near_join.near_duplicates(none).count() == 0
    kept = near_join.keep_one(odd, near_join.classify(odd))
    assert kept.columns == odd.columns


def test_near_join_of_repeated_ids(spark):
    """Texts of one id are documents of their own, and one row of each class stays."""
    body = " ".join(f"w{i}" for i in range(40))
    rows = [(5, body), (5, "quite another text about something else"), (3, body + " end"), (5, body), (None, body), (8, "alone here"), (8, "alone here"), (9, None), (9, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.lit(0)).withColumn("stays", F.lit(0)).withColumn("of_id", F.lit(0))
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in rows_of(near_join.near_duplicates(frame)))
    assert got == Counter({(5, 3, 2): 2, (3, 3, 2): 1, (5, 5, 0): 1, (None, None, 0): 1, (8, 8, 1): 2, (9, 9, 0): 2})
    kept = near_join.keep_one(frame, near_join.classify(frame))
    assert kept.columns == frame.columns
    assert Counter((r["doc_id"], r["text"]) for r in rows_of(kept)) == Counter([(5, rows[1][1]), (3, rows[2][1]), (None, body), (8, "alone here"), (9, None)])


def test_forest_finds_planted_pairs(spark):
    import random

    rnd, rows, want = random.Random(8), [], 0
    for i in range(0, 3000, 2):
        n = rnd.randint(30, 120)
        words = [f"w{rnd.randrange(10**9)}" for _ in range(n)]
        cut = int(n * rnd.uniform(0.1, 0.2))
        rows += [(i, " ".join(words)), (i + 1, " ".join(words[: n - cut]))]
        want += len(shingle_set(rows[-1][1])) / len(shingle_set(rows[-2][1])) >= 0.8
    got = rows_of(near_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert want > 1000 and sum(r["n_links"] for r in got) == 2 * want


def test_boilerplate_does_not_chain(spark):
    """10,000 texts of a pairwise similarity of 0.4 meet in nodes, but no candidate comes of it."""
    import random

    rnd = random.Random(2)
    core = " ".join(f"c{i}" for i in range(61))
    rows = [(i, core + " " + " ".join(f"u{rnd.randrange(10**9)}" for _ in range(43))) for i in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.lit(0)).select("doc_id", "th", "text")
    prof = docs.mapInArrow(near_join._profiler(near_join.TREES, 5, 0.8, 0.2), near_join._PROFILE).withColumn("sid", F.col("doc_id")).cache()
    depths = near_join.measured_depths(prof)
    nodes = near_join.trie_nodes(prof, near_join.emitted_depths(depths)).cache()
    crowded = nodes.groupBy("node").count().where("count > 100").count()
    assert set(depths.values()) <= {4, 5, 6} and crowded > 0
    assert near_join.candidates(nodes, prof).count() == 0


def test_prefixes_stop_where_the_target_is_met(spark):
    shared = lambda met, n: [[5] * met + [2] * (24 - met)] * n
    rows = [(1 << 6, s) for s in shared(8, 100)] + [(1 << 9, s) for s in shared(24, 100)] + [(1 << 12, s) for s in shared(3, 10)] + [(1 << 13, None)]
    firsts = spark.createDataFrame(rows, "n long, shared array<int>")
    pooled = 2  # all probes share two levels; at five the pooled chance still suffices
    got = near_join.measured_depths(firsts)
    assert got == {6: 5, 9: 5, 12: 5, 13: 5} and pooled <= min(got.values())
    assert near_join.measured_depths(firsts, target=1 - 1e-9) == {6: 2, 9: 5, 12: 5, 13: 5}
    assert near_join.emitted_depths({6: 5, 7: 4, 8: 8}) == {6: [4, 5], 7: [4], 8: [4, 8]}


# units -----------------------------------------------------------------------------------------


def brute_runs(text, unit, least):
    """All runs of pieces of at least ``least`` words of which no shorter one that starts or ends alike has as many."""
    pieces = unit_dedup.split_pieces(text, unit)
    size = lambda a, b: sum(max(1, len(w) // 12) for x, y in pieces[a:b] for w in text[x:y].lower().split())
    full = [(a, b) for a in range(len(pieces)) for b in range(a + 1, len(pieces) + 1) if size(a, b) >= least and size(a, a + 1) and size(b - 1, b)]
    keep = {(a, b) for a, b in full if (a, b - 1) not in full and not any((a, c) in full for c in range(a + 1, b))} | {(a, b) for a, b in full if not any((c, b) in full for c in range(a + 1, b))}
    return [(pieces[a][0], pieces[b - 1][1], " ".join(w for x, y in pieces[a:b] for w in text[x:y].lower().split())) for a, b in sorted(keep)]


def brute_units(rows, unit="sentence", least=unit_dedup.MIN_WORDS):
    """Text of each (id, text) without what an earlier one has; ranks are ids, then hashes of the texts."""
    seen, out = set(), {}
    for i, _, text in sorted((i, h, t) for i, h, t in rows):
        gone, own, new = [False] * len(text), {}, set()
        for a, b, body in unit_dedup.split_units(text, unit, least):
            if body in seen or a >= own.setdefault(body, b):
                gone[a:b] = [True] * (b - a)
            new.add(body)
        seen |= new
        out[i, text] = "".join(c for c, g in zip(text, gone, strict=True) if not g)
    return out


def ranked(frame):
    rows = frame.where("text is not null").select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), F.xxhash64("text").alias("th"), "text").distinct()
    return [tuple(r) for r in rows.collect()]


def test_runs_equal_brute_force():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=200, deadline=None, database=None)
    @given(st.lists(st.sampled_from(["a b. ", "c d e f! ", "\n", "g ", "h. i", "ninechars" * 5 + " ", "。", "? "]), max_size=12))
    def same(parts):
        text = "".join(parts)
        assert unit_dedup.split_units(text, "sentence", 5) == brute_runs(text, "sentence", 5)

    same()


@pytest.mark.parametrize("unit", ["sentence", "line", "paragraph"])
def test_units_equal_brute_force(docs, unit):
    want = brute_units(ranked(docs), unit)
    got = rows_of(unit_dedup.dedup_units(docs, unit))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {(r["doc_id"], text[r["doc_id"]]): r["text"] for r in got} == want
    for r in got:
        assert "".join(text[r["doc_id"]][s["start"] : s["end"]] for s in r["kept"]) == r["text"]
        spans = sorted((s["start"], s["end"]) for s in r["kept"] + r["removed"])
        assert sum(b - a for a, b in spans) == r["n_chars"]


def test_units_of_repeated_ids_and_rows(spark):
    passage = "One passage of many words that several of these documents hold. It has a short end. Really."
    rows = [(1, "Start. " + passage), (2, "0123456789. " * 9 + passage), (2, "Other text under the same id. " + passage), (2, "Other text under the same id. " + passage), (None, passage + " Tail."), (3, passage), (3, None), (3, ""), (4, (passage + " ") * 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit(1)).withColumn("rank", F.lit(1))
    want = brute_units(ranked(frame))
    for got in (rows_of(unit_dedup.dedup_units(frame)), rows_of(unit_dedup.cut_documents(frame))):
        expected = Counter()
        for i, t in rows:
            left = None if t is None else want[2**63 - 1 if i is None else i, t]
            if "n_chars" in got[0] or t is None or t == left or left.strip():
                expected[i, left] += 1
        assert Counter((r["doc_id"], r["text"]) for r in got) == expected
    assert want[2, rows[1][1]] == "0123456789. " * 9 and want[3, passage] == "" and want[2**63 - 1, passage + " Tail."] == "Tail."


def test_short_lines_and_texts_without_spaces(spark):
    line, passage = "Released under the MIT license.", "这是一段没有空格的很长的文字" * 20
    rows = [(i, f"{line}\nDocument number {i} goes on with text of its own, which is long enough to count.\n{passage}") for i in range(5)]
    got = {r["doc_id"]: r["text"] for r in rows_of(unit_dedup.dedup_units(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert all(line in t for t in got.values()) and sum(passage in t for t in got.values()) == 1


def test_units_cut_from_documents(docs, odd):
    for frame in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("removed", F.lit("clash"))):
        before = {r["doc_id"]: r["text"] for r in frame.collect()}
        a = {r["doc_id"]: r["text"] for r in rows_of(unit_dedup.dedup_units(frame))}
        cut = unit_dedup.cut_documents(frame)
        assert cut.columns == frame.columns
        b = {r["doc_id"]: r["text"] for r in rows_of(cut)}
        assert b == {i: t for i, t in a.items() if t is None or t == before[i] or t.strip()}


def test_units_odd_rows(odd, none):
    got = rows_of(unit_dedup.dedup_units(odd))
    assert len(got) == odd.count()
    assert next(r for r in got if r["doc_id"] == 0)["text"] is None
    line = "A line of words that repeats itself.\n"  # three make a unit, which overlaps itself
    assert next(r for r in got if r["doc_id"] == 9)["text"] == line * 3
    assert rows_of(unit_dedup.dedup_units(odd.where("doc_id = 9").withColumn("text", F.lit(line * 9))))[0]["text"] == line * 3
    assert unit_dedup.dedup_units(none).count() == 0


# tokens ----------------------------------------------------------------------------------------


def test_tokens_equal_the_library(docs, odd, none):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    for frame in (docs, odd):
        text = Counter((r["doc_id"], len((r["text"] or "").encode()), len(lib.encode(r["text"] or "", add_special_tokens=False).ids)) for r in frame.collect())
        got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows_of(token_counts.token_counts(frame, path)))
        assert got == text
    assert token_counts.token_counts(none, path).count() == 0


def test_tokens_of_strange_texts():
    import public_tokenizers as P
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib, bpe = Tokenizer.from_file(path), token_counts.WordBpe(path)

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.text(st.one_of(st.characters(codec="utf-8", exclude_categories=["Cn", "Cs"]), st.sampled_from("aab'sΣσς<|endoftext|> ")), max_size=40))
    def same(text):
        text += "<|endoftext|>" + text
        assert bpe.count([text]) == [len(lib.encode(text, add_special_tokens=False).ids)]

    same()


# warc ------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(60).cache()
    extra = spark.createDataFrame([(10_001, "http://a/", None), (10_002, None, ""), (10_003, "http://b/", "same"), (10_004, "http://c/\r\nX: y", "same"), (None, "http://d/", "same"), (10_004, "http://c/", "same")], "page_id long, url string, html string")
    both = pages.select("page_id", "url", "html").union(extra).withColumn("content", F.lit(1)).withColumn("digest", F.lit(1))
    archives = warc.write_archives(both, frame_bytes=2000, bundle_bytes=20_000)
    got = rows_of(warc.read_archives(archives))
    assert len(got) == both.count()
    text = {(r["page_id"], r["html"] or "") for r in both.collect()}
    top = {}
    for i, t in text:
        if i is not None:
            top[t] = max(i, top.get(t, i))
    want = Counter()
    for r in both.collect():
        body = (r["html"] or "").encode()
        first = r["page_id"] is None or top[r["html"] or ""] == r["page_id"]
        want[(r["page_id"], len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first else "revisit", None if first else top[r["html"] or ""])] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    one = pages.first()
    assert rows_of(warc.read_payloads(archives, [one["page_id"]]))[0]["payload"].decode() == one["html"]
    assert warc.record_index(archives).count() == len(got)


def test_warc_bundles_are_plain_zstandard(spark, sf, tmp_path):
    import zstandard

    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(5)
    paths = [r["path"] for r in warc.export_files(warc.write_archives(pages, frame_bytes=100), str(tmp_path)).collect()]
    plain = b"".join(zstandard.ZstdDecompressor().stream_reader(open(p, "rb"), read_across_frames=True).read() for p in paths)
    assert plain.count(b"WARC/1.1\r\n") == 5
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


# language --------------------------------------------------------------------------------------


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = rows_of(language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id"))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_names_may_be_any_string(spark):
    names = ["g", "k", "a`b", "n1", "lang.x", ""]
    words = [["alpha", "beta", "gamma"], ["uno", "dos", "tres"], ["yksi", "kaksi", "kolme"], ["ein", "zwei", "drei"], ["jeden", "dwa", "trzy"], ["egy", "ketto", "harom"]]
    rows = [(i * 6 + j, " ".join(words[j][(i + k) % 3] for k in range(9)), names[j]) for i in range(40) for j in range(6)] + [(900, "text without a language", None)]
    got = rows_of(language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(r["lang_pred"] == names[r["doc_id"] % 6] for r in got if r["doc_id"] < 900)
    nothing = rows_of(language_id.identify(spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")))
    assert [(r["lang_pred"], r["score"]) for r in nothing] == [("und", 0.0)]


def test_language_sample_is_bounded_at_any_size(spark):
    frame = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.lit("one hot text of all")).otherwise(F.concat(F.lit("text number "), F.col("id"))).alias("text"), F.when(F.col("id") < 19_990, "en").otherwise("rare").alias("lang"))
    got = language_id.training_sample(frame, {"en": 19_990, "rare": 10}, 500).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got}["rare"] == 6 and 100 < {r["lang"]: r["count"] for r in got}["en"] < 400
    some = language_id.training_sample(frame, {"en": 10**12, "rare": 10**12}, 10**11).count()
    assert 500 < some < 2000


def brute_back_off(model, text):
    """Language by plain sums: a known word's log frequencies, else the mean of its longest known n-grams'."""
    import regex

    total, found = [0.0] * len(model.languages), regex.findall(r"\p{L}[\p{L}\p{M}]*", (text or "").lower())
    for w in found:
        if w in model.index[0]:
            rows = [model.logs[0][model.index[0][w]]]
        else:
            rows = next((r for n in language_id.NGRAMS if (r := [model.logs[n][model.index[n][p]] for j in range(len(w) + 3 - n) if (p := f" {w} "[j : j + n]) in model.index[n]])), [])
        for i in range(len(total)):
            total[i] += sum(r[i] for r in rows) / max(len(rows), 1)
    return max(range(len(total)), key=total.__getitem__) if found else None


def test_language_equals_brute_force_back_off(docs):
    model = language_id.train(docs)
    texts = [r["text"] for r in docs.collect()] + ["zzqx wolkig", "Ünïcödé", "", None, "123 456", "blorptastic ungewiss señorita"]
    for text, (lang, score) in zip(texts, model.predict(texts), strict=True):
        at = brute_back_off(model, text)
        assert lang == ("und" if at is None else model.languages[at]) and 0 <= score <= 1


def test_language_odd_rows(odd, none):
    got = rows_of(language_id.identify(odd))
    assert len(got) == odd.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (0, 1, 2, 5)} == {"und"}
    assert language_id.identify(none).count() == 0


# quality ---------------------------------------------------------------------------------------


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


def test_quality_against_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = rows_of(quality.score_documents(docs).join(labels, "doc_id"))
    assert auc([(r["score"], r["quality"]) for r in got]) > 0.95
    good = [r for r in got if r["quality"]]
    assert sum(r["keep"] for r in good) / len(good) > 0.98


def test_quality_chances_are_those_of_the_labels(spark):
    """The fit sees no label, and finds how often each labeller votes good, bad or not at all on either class."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    counted = quality.vote_counts(docs).collect()
    _, chance = quality.fit_votes([r["votes"] for r in counted], [r["n"] for r in counted])
    texts = docs.join(labels.where("quality is not null"), "doc_id").select("text", "quality").collect()
    voted = quality.votes(quality.signals([r["text"] for r in texts])[0])
    true = [r["quality"] for r in texts]
    for j, name in enumerate(quality.LABELLERS):
        for y in (0, 1):
            on = [v[j] for v, q in zip(voted, true, strict=True) if q == y and v.any()]
            for at, vote in enumerate((quality.BAD, quality.ABSTAIN, quality.GOOD)):
                assert abs(sum(v == vote for v in on) / len(on) - chance[j, y, at]) < 0.05, (name, y, vote)


def test_quality_fit_recovers_a_mixture():
    import numpy as np

    rnd = np.random.default_rng(4)
    kinds = [(0.8, [0.0, 0.1, 0.9]), (0.12, [0.9, 0.1, 0.0]), (0.08, [0.1, 0.8, 0.1])]
    rows, true = [], []
    for k, (share, chance) in enumerate(kinds):
        n = int(5000 * share)
        rows += list(rnd.choice([-1, 0, 1], size=(n, 6), p=chance))
        true += [k == 0] * n
    patterns, at, n = np.unique(np.array(rows), axis=0, return_inverse=True, return_counts=True)
    post, chance = quality.fit_votes(patterns.tolist(), n.tolist())
    right = [(p > 0.5) == t for p, t, r in zip(post[at.ravel()], true, rows, strict=True) if r.any()]  # where someone votes
    assert sum(right) / len(right) > 0.99 and abs(chance[:, 1, 2] - 0.9).max() < 0.03
    shuffled = list(range(len(n)))[::-1]
    again, _ = quality.fit_votes(patterns[shuffled].tolist(), n[shuffled].tolist())
    assert (again[::-1] == post).all()
    assert (quality.fit_votes([[0, 0], [0, 0]], [3, 4])[0] == 1).all() and len(quality.fit_votes([], [])[0]) == 0


def test_quality_scores_equal_brute_force(spark):
    """Scores of a tiny corpus from plain dictionaries of features."""
    import math

    texts = ["A plain text of several good words, with a stop at its end. " * (1 + i % 3) for i in range(20)] + ["@@ ## $$ %% spam!!! " * 9] * 3 + ["", None, "x"]
    got = rows_of(quality.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    distinct = sorted({t for t in texts if t is not None})
    counted = Counter(tuple(v) for v in quality.votes(quality.signals(texts)[0]).tolist())
    post, _ = quality.fit_votes([list(k) for k in counted], list(counted.values()))
    soft = dict(zip(counted, post, strict=True))
    rows = [quality._unit_counts(f) for f in quality.signals(distinct)[1]]
    target = [soft[tuple(v)] for v in quality.votes(quality.signals(distinct)[0]).tolist()]
    w = look = [0.0] * (quality.FEATURES + 1)
    for step in range(quality.ITERATIONS):
        slope = [quality.RIDGE * x for x in look]
        for (place, value), y in zip(rows, target, strict=True):
            z = look[-1] + sum(look[p] * v for p, v in zip(place, value, strict=True))
            off = (1 / (1 + math.exp(-z)) - y) / len(rows)
            slope[-1] += off
            for p, v in zip(place, value, strict=True):
                slope[p] += off * v
        moved = [x - 4 * g for x, g in zip(look, slope, strict=True)]
        look, w = [m + step / (step + 3) * (m - o) for m, o in zip(moved, w, strict=True)], moved
    want = {t: 1 / (1 + math.exp(-(w[-1] + sum(w[p] * v for p, v in zip(*r, strict=True))))) if t.strip() else 0 for t, r in zip(distinct, rows, strict=True)}
    assert all(abs(r["score"] - (want[texts[r["doc_id"]]] if texts[r["doc_id"]] else 0)) < 1e-6 for r in got)


def test_quality_sample_is_bounded_at_any_size(spark):
    frame = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("one hot text of all")).otherwise(F.concat(F.lit("text number "), F.col("id"))).alias("text"))
    for n_docs, most in ((30_000, 500), (30_000, 40_000), (1, 100)):
        got = [r["h"] for r in quality.training_sample(frame, n_docs, most).select("h").collect()]
        assert 0.8 * min(most, 15_001) <= len(got) == len(set(got)) <= most
    some = quality.training_sample(frame, 10**11, 10**9).count()  # far more documents: the share of hashes shrinks, but not to none
    assert 0 < some < 15_001


def test_quality_odd_rows(odd, none):
    got = rows_of(quality.score_documents(odd))
    assert len(got) == odd.count()
    assert not any(r["keep"] for r in got if r["doc_id"] in (0, 1, 2))
    assert quality.score_documents(none).count() == 0


# decontamination -------------------------------------------------------------------------------


def brute_hits(text, items, window=10):
    lower = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    w, hit, found = lower(text), set(), set()
    for item, body in items:
        iw = lower(body)
        n = min(len(iw), window)
        grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def hits_of(frame, bench, **how):
    return Counter((r["doc_id"], r["n_words"], r["n_hit"], str(r["item_ids"]), r["n_items"], r["contaminated"]) for r in rows_of(decontaminate.contamination(frame, bench, **how)))


def brute_of(frame, items):
    out = Counter()
    for r in frame.select("doc_id", "text").collect():
        n, hit, found = brute_hits(r["text"], items)
        out[r["doc_id"], n, hit, str(found), len(found), hit > 0] += 1
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_equals_brute_force(spark, docs, odd, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "HASHES_BROADCAST", -1)
        monkeypatch.setattr(decontaminate, "BYTES_BROADCAST", -1)
    items = [(1, "one two three"), (2, "a b c d e f g h i j k"), (3, None), (4, ""), (10, "x x x x x x x x x x x"), (5, "Ünïcödé"), (6, "a b c d e f g h i j q"), (7, "h i j k l")]
    bench = spark.createDataFrame([*items, (None, "one")], "item_id long, text string").withColumn("n", F.lit("clash")).withColumn("win", F.lit("clash"))
    rows = odd.withColumn("marks", F.lit(0)).withColumn("th", F.lit(0)).withColumn("inside", F.lit(0)).withColumn("of_id", F.lit(0))
    rows = rows.union(rows.where("doc_id = 7 or doc_id is null"))
    assert hits_of(rows, bench) == brute_of(rows, items)
    extra = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert hits_of(docs, extra) == brute_of(docs, [(r["item_id"], r["text"]) for r in extra.collect()])


def test_decontamination_of_low_entropy_and_short_windows(spark):
    import random

    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choice("abc") for _ in range(n))
    items = [(i, text(rnd.randint(1, 30))) for i in range(12)]
    frame = spark.createDataFrame([(i, text(rnd.randint(0, 60))) for i in range(40)] + [(1, "b " * 40)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert hits_of(frame, bench) == brute_of(frame, items)
    for r in rows_of(decontaminate.contamination(frame, bench)):
        assert sum(s["length"] for s in r["spans"]) == r["n_hit"]


def test_decontamination_of_empty_tables(docs, spark):
    extra = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert decontaminate.contamination(docs.limit(0), extra).count() == 0
    assert not any(r["contaminated"] for r in rows_of(decontaminate.contamination(docs.limit(5), extra.limit(0))))


def test_winnowing_thins_and_keeps_every_shared_span(spark):
    import random

    rnd = random.Random(9)
    body = [f"w{rnd.randrange(10**6)}" for _ in range(3000)]
    rows = [(0, " ".join(body))] + [(i, " ".join([f"p{i}", *body[i * 7 : i * 7 + 10], f"q{i}"])) for i in range(1, 100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.explode(F.array(decontaminate.words(F.col("text")))).alias("w"))
    kept = {r["doc_id"]: {m["h"] for m in r["m"]} for r in frame.select("doc_id", decontaminate.fingerprints(F.col("w")).alias("m")).collect()}
    assert len(kept[0]) < 3000 * 0.35 and all(kept[0] & kept[i] for i in range(1, 100))


# simhash ---------------------------------------------------------------------------------------


def brute_fingerprint(text):
    import xxhash

    w = re.split(r"(?:[^\w]|_)+", text.lower())
    votes, total = [0] * 128, 0
    for i in range(len(w)):
        term = w[i : i + 3]
        weight = 1 + sum(len(t.encode()) > 3 for t in term)
        total += weight
        for s in (0, 1):
            h = xxhash.xxh64_intdigest(s.to_bytes(4, "little"), 42)
            for t in term:
                h = xxhash.xxh64_intdigest(t.encode(), h)
            for b in range(64):
                votes[s * 64 + b] += weight * (h >> b & 1)
    return "".join(f"{sum(1 << b for b in range(64) if 2 * votes[s * 64 + b] > total):016x}" for s in (0, 1))


def test_simhash_equals_brute_force(docs, odd):
    for frame in (docs.limit(30), odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        text = {r["doc_id"]: r["text"] or "" for r in frame.collect()}
        ids = sorted(text, reverse=True)
        follow = dict(zip(ids, ids[1:] + ids[:1], strict=True))
        got = rows_of(simhash.op5(frame))
        assert sorted(r["doc_id"] for r in got) == sorted(ids)
        near = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
        for r in got:
            t, nxt = text[r["doc_id"]], text[follow[r["doc_id"]]]
            half = len(t) // 2
            edited = t[: len(t) - half] + nxt[:half]
            assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert r["fingerprint"] == brute_fingerprint(t) and r["edited_fingerprint"] == brute_fingerprint(edited)
            assert r["near_edited"] == near(r["fingerprint"], r["edited_fingerprint"])
            assert r["near_next"] == near(r["fingerprint"], brute_fingerprint(nxt))


def test_simhash_odd_rows(odd, none, docs):
    assert len(rows_of(simhash.op5(odd))) == odd.count()
    assert simhash.op5(none).count() == 0
    got = rows_of(simhash.op5(docs))
    assert sum(r["near_edited"] > r["near_next"] for r in got) / len(got) > 0.95


def test_simhash_of_repeated_ids(spark):
    """Texts of one id stay rows of their own, those divisible by 50 too, and follow each other across ranges."""
    rows = [(50, f"text number {i} of one id and some words more") for i in range(3)] + [(50, "text number 0 of one id and some words more")] + [(i, f"document {i} says this and that") for i in range(1, 30)] + [(None, "no id"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(simhash.op5(frame))
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((i, len(t or "")) for i, t in rows)
    assert sum(r["n_close"] is not None for r in got) == 4 and {r["n_close"] >= 1 for r in got if r["doc_id"] == 50 and r["fingerprint"] == brute_fingerprint(rows[0][1])} == {True}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    for ranges in (1, 3, 1000):
        follow = Counter((r["doc_id"], r["text"], r["next_text"]) for r in simhash.with_next(frame, ranges).where("ghost = 0").collect())
        by_id = [(i, t) for i, t in order if i is not None and i != 50]
        assert all((i, t, n) in follow for (i, t), (_, n) in zip(by_id, by_id[1:], strict=False))


def test_radius_search_equals_brute_force(spark):
    import random

    rnd, rows = random.Random(5), []
    for i in range(40):
        x = rnd.getrandbits(128)
        for bits in range(6):
            y = x
            for b in rnd.sample(range(128), bits):
                y ^= 1 << b
            rows.append((y >> 64, y & (2**64 - 1)))
    signed = [tuple(v - 2**64 if v >= 2**63 else v for v in r) for r in rows] + [(0, 0), (0, 0)]
    frame = spark.createDataFrame(signed, "fp_hi long, fp_lo long")
    whole = lambda r: (r[0] % 2**64) << 64 | r[1] % 2**64
    for radius in (0, 3):
        want = {(a, b) for a in set(signed) for b in set(signed) if (whole(a) ^ whole(b)).bit_count() <= radius}
        got = rows_of(simhash.within_radius(frame, frame, radius))
        assert {((r["q_hi"], r["q_lo"]), (r["fp_hi"], r["fp_lo"])) for r in got} == want
        assert next(r for r in got if r["fp_hi"] == r["fp_lo"] == r["q_hi"] == 0)["copies"] == 2


# urls ------------------------------------------------------------------------------------------


def test_url_rules_equal_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    urls = [None, "", "no scheme", "HTTP://WWW.Example.NET/en/x?y", "http://net", "http://net/", "http://notexample.com/de/", "http://a.example.com/de/1", "a://org/fr/", "x://b.org/en/fr/?http://net/", "http://example.com?q=/de/", "a://u:p@example.com:80/de/"]
    frame = pages.union(spark.createDataFrame(list(enumerate(urls, 10**6)), "page_id long, url string")).withColumn("tokens", F.lit(1)).withColumn("host", F.lit(2))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["page_id"]: r for r in rows_of(url_rules.filter_urls(frame, labels))}
    for r in frame.collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r["url"] or "")
        host, path = (m[1].translate({i: i + 32 for i in range(65, 91)}), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        g = got[r["page_id"]]
        assert (g["host"], g["path"]) == (host, path)
        assert g["rule"] == (max(fits)[1] if fits else None)
        if fits:
            assert g["verdict"] == max(fits)[2]
    assert url_rules.filter_urls(frame.limit(0), labels).count() == 0
    assert all(r["confidence"] is None for r in rows_of(url_rules.filter_urls(frame, labels.limit(0))))


def test_association_rules_equal_brute_force(spark):
    from itertools import combinations

    rows = [(["a", "b"], True)] * 30 + [(["a", "c"], False)] * 40 + [(["b", "c"], True)] * 5 + [(["b", "c"], False)] * 5 + [(["d"], False)] * 20 + [(["a", "b", "d"], False)] * 2
    rows += [(["e", "f"], True)] * 10 + [(["e", "f", "g"], True)] * 8 + [(["e", "g"], True)] * 2 + [(["e"], False)] * 6
    found = rows_of(url_rules.mine_rules(spark.createDataFrame(rows, "items array<string>, blocked boolean"), 0.03, 0.6))
    want = {}
    for size in (1, 2, 3):
        for t in combinations("abcdefg", size):
            on = [b for items, b in rows if set(t) <= set(items)]
            if on and sum(on) / len(rows) >= 0.03 and sum(on) / len(on) >= 0.6:
                want[t] = sum(on) / len(on)
    shortest = {t: round(c, 9) for t, c in want.items() if not any(set(o) < set(t) and d >= c for o, d in want.items())}
    assert {tuple(r["items"]): round(r["confidence"], 9) for r in found} == shortest and ("e", "f") in want and ("e", "f") not in shortest
    sets = spark.createDataFrame([(["a", "b", "d"],), (["a"],), (["b", "c"],), (["e", "f", "x"],)], "items array<string>")
    matched = {tuple(r["items"]): round(r["confidence"], 9) for r in rows_of(url_rules.match_rules(sets, url_rules.mine_rules(spark.createDataFrame(rows, "items array<string>, blocked boolean"), 0.03, 0.6)))}
    brute = {s: max((round(c, 9) for t, c in want.items() if set(t) <= set(s)), default=None) for s in (("a", "b", "d"), ("a",), ("b", "c"), ("e", "f", "x"))}
    assert matched == {s: c for s, c in brute.items() if c is not None}


def test_rules_need_enough_urls_and_no_subsets(spark):
    """A URL with 25 query keys that is labelled once gives no rule, labelled ten times one item and one rule; ties and odd labels do no harm."""
    long_url = "http://bad.example/p/{}?" + "&".join(f"k{c}=1" for c in "abcdefghijklmnopqrstuvwxy")
    pages = [(i, long_url.format(i)) for i in range(12)] + [(100 + i, f"http://fine.example/q/{100 + i}") for i in range(40)] + [(200, "http://other.example/p/200?kc=7"), (201, None)]
    frame = spark.createDataFrame(pages, "page_id long, url string").withColumn("items", F.lit(1)).withColumn("url_no", F.lit(1))
    labels = lambda n: spark.createDataFrame([(i, 0) for i in range(n)] + [(100 + i, 1) for i in range(40)] + [(None, 0), (100, None)], "doc_id long, quality int")
    once = {r["page_id"]: r["verdict"] for r in rows_of(url_rules.filter_urls(frame, labels(1)))}
    assert set(once.values()) == {"allow"}
    labelled = url_rules.labelled_urls(frame, labels(10)).withColumn("url_no", F.monotonically_increasing_id())
    classes = {r["token"]: r["item"] for r in rows_of(url_rules.token_classes(labelled))}
    assert len({classes[f"query:k{c}"] for c in "abcxy"}) == 1
    ten = {r["page_id"]: (r["verdict"], r["confidence"]) for r in rows_of(url_rules.filter_urls(frame, labels(10)))}
    assert all(ten[i] == ("block", 1.0) for i in [*range(12), 200]) and all(ten[100 + i] == ("allow", None) for i in range(40)) and ten[201] == ("allow", None)


# mixing ----------------------------------------------------------------------------------------


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("group_rows", [2048, 8])
def test_mix_meets_its_targets(docs, group_rows):
    frame = docs.withColumn("source", F.when(F.col("doc_id") % 11 != 0, F.col("source")))
    got = rows_of(mixing.mix_sources(frame, group_rows=group_rows))
    text = {r["doc_id"]: (r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in frame.collect()}
    sizes = Counter()
    for s, n in text.values():
        sizes[s] += n
    target = brute_targets(sizes)
    taken = Counter()
    for r in got:
        source, n = text[r["doc_id"]]
        assert (r["source"], r["size"], r["source_size"]) == (source, n, sizes[source])
        assert abs(r["target"] - target[source]) < 1e-6 * max(1, target[source])
        assert r["taken"] == r["copies"] * n <= 2 * n
        taken[source] += r["taken"]
    assert len(got) == len(text)
    for s, n in taken.items():
        assert abs(n - target[s]) <= max(t[1] for t in text.values() if t[0] == s)
    again = rows_of(mixing.mix_sources(frame.repartition(3), group_rows=group_rows))
    key = lambda r: r["doc_id"]
    assert sorted(again, key=key) == sorted(got, key=key)


def test_pivotal_rounding_keeps_the_sum_and_the_chances():
    import random

    rnd = random.Random(1)
    fracs = [rnd.random() for _ in range(9)]
    hits = [0.0] * 9
    for run in range(3000):
        add, left = mixing.pivotal_round(list(enumerate(fracs)), f"s{run}")
        assert abs(sum(add) + sum(left) - sum(fracs)) < 1e-6 and sum(x > 1e-9 for x in left) <= 1
        hits = [h + a + x for h, a, x in zip(hits, add, left, strict=True)]
    assert all(abs(h / 3000 - f) < 0.04 for h, f in zip(hits, fracs, strict=True))


def test_mix_of_many_equal_rows(spark, monkeypatch):
    """Equal rows are shared out among themselves, whatever the type of their ids, and meet in no group."""
    monkeypatch.setattr(mixing, "RUN_ROWS", 7)
    rows = [(5, "a b c", "s")] * 100 + [(None, "a b", "s")] * 41 + [(i, "w " * i, "t") for i in range(1, 40)] + [(99, "only one document here", None)]
    want = brute_targets({"s": 382, "t": 780, None: 4})
    for kind in ("int", "string", "long"):
        frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("n_rows", F.lit(1))
        got = rows_of(mixing.mix_sources(frame, group_rows=8))
        assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((r[0], r[2]) for r in rows)
        taken = Counter()
        for r in got:
            assert r["copies"] in (0, 1, 2)
            taken[r["source"]] += r["taken"]
        assert abs(taken["s"] - want["s"]) <= 5 and abs(taken["t"] - want["t"]) <= 40 and taken[None] in (4, 8)
        hundred = [r["copies"] for r in got if r["doc_id"] == 5 and r["source"] == "s"]
        assert max(hundred) - min(hundred) <= 1


def test_mix_odd_rows(odd, none):
    got = rows_of(mixing.mix_sources(odd))
    assert len(got) == odd.count() and all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.mix_sources(none).count() == 0


# pipeline --------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, sf):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "near_duplicates":
            assert set(after) == {i for i, (c, _) in brute_classes(before.items()).items() if i == c}
        if name == "repeated_units":
            want = {i: t for (i, _), t in brute_units([(i, 0, t) for i, t in before.items()]).items()}
            assert after == {i: t for i, t in want.items() if t.strip() or t == before[i]}
        if name == "benchmark":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert set(after) == {i for i, t in before.items() if not brute_hits(t, items)[1]}
        before = after
    mixed = rows_of(pipeline.STAGES[-1][1](spark, docs, sf))
    assert {r["doc_id"] for r in mixed} == set(before)
    assert sorted(r["doc_id"] for r in rows_of(pipeline.run(spark, sf))) == sorted(before)


def test_queries_are_registered():
    names = [re.match(r"op(\d+)_", k)[1] for k in queries.QUERIES]
    assert sorted(map(int, names)) == list(range(1, 14)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
