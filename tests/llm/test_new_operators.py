"""Conversation repair, toxicity and token alignment against brute force, held-out labels and whole-text tokenizers."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from groundshift.llm import queries, token_alignment, toxicity, turn_repair

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TURNS = "conv_id long, turn long, role string, text string, n_rows int"


# conversations ----------------------------------------------------------------------------------


def brute_repair(rows):
    """Least (cost, audit) over all edits and insertions of a few rows, by trying every one."""
    seen, judged = set(), []
    for role, text in rows:
        fault = "blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen else "truncated" if not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else None
        seen.add((role, text))
        judged.append((role[:1], fault))
    best = None
    choices = [["D"] if f in ("blank", "duplicate") else ["K", "Ru", "Ra", "D"] for _, f in judged]
    for edits in itertools.product(*choices):
        kept = [(e[0], i if e == "K" else e[1:]) for e, (i, _) in zip(edits, judged, strict=True) if e != "D"]
        base = sum({"K": 0, "R": 3, "D": 4}[e[0]] + (3 if f == "truncated" and e != "D" else 0) for e, (_, f) in zip(edits, judged, strict=True))
        for gaps in itertools.product(("", "u", "a", "ua", "au"), repeat=len(kept) + 1):
            word = "".join(g + k[1] for g, k in zip(gaps, kept, strict=False)) + gaps[-1]
            if not re.fullmatch(r"(s?(ua)+)?", word):
                continue
            cost, g, audit = base + 3 * sum(map(len, gaps)), 0, ""
            for e in edits:  # inserted turns come after deleted ones at the same place: D is less than I
                if e != "D":
                    audit += "I" * len(gaps[g])
                    g += 1
                audit += e[0]
            audit += "I" * len(gaps[-1])
            best = min(best or (cost, audit), (cost, audit))
    return best


def test_parsing_equals_trying_everything():
    rnd = random.Random(3)
    chart = turn_repair.Chart()
    for _ in range(400):
        rows = [(rnd.choice(["system", "user", "assistant", "tool"]), rnd.choice(["Yes.", "No.", "cut", " ", "Well then!", "again"])) for _ in range(rnd.randint(0, 4))]
        seen, kinds = set(), ""
        for role, text in rows:
            fault = 1 if not text.strip() else 2 if (role, text) in seen else 3 if text[-1] not in ".!?" else 0
            seen.add((role, text))
            kinds += chr(65 + 4 * {"s": 0, "u": 1, "a": 2}.get(role[0], 3) + fault)
        assert turn_repair.accepted(chart.piece(kinds)) == brute_repair(rows), rows


def test_any_split_gives_the_same_cell():
    rnd = random.Random(5)
    chart = turn_repair.Chart()
    kinds = "".join(rnd.choice("ABCDEFGHIJKLMNOP") for _ in range(21))
    cells = [chart.span(k) for k in kinds]
    one = cells[0]
    for c in cells[1:]:
        one = turn_repair._combine(one, c)
    assert one == chart.piece(kinds) == turn_repair.together(cells)
    for k in (3, 10, 20):
        assert turn_repair._combine(chart.piece(kinds[:k]), chart.piece(kinds[k:])) == one


def repaired_by_hand(audit, rows):
    total = len(audit) - audit.count("D")
    out, rows = [], iter(rows)
    for e in audit:
        role, text = next(rows) if e != "I" else ("", "")
        if e != "D":
            out.append((role if e == "K" else ("user", "assistant")[(len(out) - total % 2) % 2], text))
    return out


def test_long_and_odd_conversations(spark, monkeypatch):
    """One conversation in many pieces and partitions, equal rows, nulls, rows that are only listed, and clashing columns."""
    rnd = random.Random(9)
    long = [(1, t, rnd.choice(["user", "assistant"]), rnd.choice(["Fine.", "cut off", f"Turn {t}.", ""]), 1) for t in range(700)]
    odd = [(2, None, None, None, 1), (2, 3, "tool", "What?", 2), (2, 3, "tool", "What?", 1), (3, 0, "user", "Gone.", 0), (None, 1, "user", "No id.", 1), (None, None, "assistant", "Reply.", 1), (4, 5, "system", "S.", 1)]
    frame = spark.createDataFrame(long + odd, TURNS)
    for c in ("at", "same", "seg", "kinds", "gaps", "cost", "of_conv", "is_row", "salt", "fault"):
        frame = frame.withColumn(c, F.lit("clash"))
    monkeypatch.setattr(turn_repair, "PIECE_ROWS", 16)
    monkeypatch.setattr(turn_repair, "FAN_IN", 3)
    got = {r.conv_id: r.asDict() for r in turn_repair.repair(frame).collect()}
    assert set(got) == {1, 2, 3, None, 4}
    chart, seen, kinds = turn_repair.Chart(), set(), ""
    for _, _, role, text, _ in long:
        kinds += chr(65 + 4 * (1 if role == "user" else 2) + (1 if not text else 2 if (role, text) in seen else 0 if text[-1] in ".!?" else 3))
        seen.add((role, text))
    cost, audit = turn_repair.accepted(chart.piece(kinds))
    assert (got[1]["cost"], got[1]["audit"]) == (cost, audit)
    text = "\n".join(f"{r}:{t}" for r, t in repaired_by_hand(audit, [(r, t) for _, _, r, t, _ in long]))
    assert got[1]["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert got[1]["illegal"] == sum(a[2] == b[2] for a, b in zip(long, long[1:], strict=False))
    empty = hashlib.sha256(b"").hexdigest()
    assert {k: got[3][k] for k in ("gaps", "blank", "cost", "audit", "repaired_sha256")} == {"gaps": 0, "blank": 0, "cost": 0, "audit": "", "repaired_sha256": empty}
    assert (got[2]["blank"], got[2]["duplicate"], got[2]["illegal"], got[2]["gaps"], got[2]["audit"]) == (1, 2, 3, 0, "DDDD")
    assert got[None]["audit"] == "IKKI" and got[None]["gaps"] == 0 and got[4]["audit"] == "D"
    turns = [(r.place, r.role, r.text) for r in turn_repair.repaired_turns(frame).where("conv_id = 1").orderBy("place").collect()]
    assert turns == [(i, *t) for i, t in enumerate(repaired_by_hand(audit, [(r, t) for _, _, r, t, _ in long]), 1)]
    assert turn_repair.repair(frame.limit(0)).count() == 0


def test_a_conversation_of_equal_rows(spark):
    frame = spark.range(20_000).select(F.lit(5).cast("long").alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("Hello.").alias("text"), F.lit(1).alias("n_rows"))
    r = turn_repair.repair(frame).collect()[0]
    assert (r.duplicate, r.illegal, r.cost, r.gaps) == (19_999, 19_999, 3 + 4 * 19_999, 0) and r.audit == "K" + "D" * 19_999 + "I"


# toxicity ---------------------------------------------------------------------------------------


def plain_marks(symbols):
    """Kinds of matched patterns, by looking at each clause as a whole."""
    out, quote = [], False
    clauses, line = [], []
    for i, s in enumerate(symbols):
        line.append(i)
        if s in (toxicity.CLAUSE, toxicity.LINE) or i == len(symbols) - 1:
            clauses.append(line)
            line = []
    for c in clauses:
        report = False
        for k, i in enumerate(c):
            s = symbols[i]
            if s == toxicity.QUOTE:
                quote, report = not quote, False if quote else report
            elif s == toxicity.REPORT:
                report = report or not quote
            elif s == toxicity.LINE:
                quote = False
            elif s in (toxicity.INSULT, toxicity.THREAT):
                negated = any(symbols[j] == toxicity.NEGATION for j in c[max(0, k - toxicity.NEGATION_REACH) : k])
                aimed = any(symbols[j] == toxicity.TARGET for j in c[:k])
                name = "negated" if negated else "reported" if quote or report else ("targeted" if aimed else "plain") if s == toxicity.INSULT else ("threat" if aimed else "loose")
                out.append((i, name))
    return out


def test_composed_transducers_equal_looking_at_clauses():
    after, kind = toxicity.grammar()
    rnd = random.Random(6)
    for _ in range(3000):
        symbols = [rnd.choice([0, 0, 1, 1, 2, 3, 4, 5, 7, 8]) for _ in range(rnd.randint(1, 14))]
        state, got = 0, []
        for i, s in enumerate(symbols):
            if kind[state][s] >= 0 and toxicity.KINDS[kind[state][s]] != "late":
                got.append((i, toxicity.KINDS[kind[state][s]]))
            state = after[state][s]
        assert got == plain_marks(symbols), symbols
    quoted = [6, 1, 7, 1, 6, 1, 7]  # "insult. insult" insult.
    state, got = 0, []
    for s in quoted:
        if kind[state][s] >= 0:
            got.append(toxicity.KINDS[kind[state][s]])
        state = after[state][s]
    assert got == ["reported", "reported", "plain"]


def test_toxicity_on_held_out_labels(spark, sf):
    base = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    found, wrong = n.get((1, 1), 0), n.get((0, 1), 0)
    assert found / (found + n.get((1, 0), 0)) > 0.8 and found / (found + wrong) > 0.85, n


def test_clauses_not_words_are_scored(spark):
    model = toxicity.Model({"idiot": 4.0}, {"pathet": 3.0}, toxicity.PRIOR.copy())
    texts = ["You are an idiot, pathetic.", 'He said: "an idiot". Fine.', "She is not an idiot.", "I will kill you, I will kill you!", "Nobody here.", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, tuple(r.kinds)): r.clause for r in toxicity.matched_clauses(rows, model).collect()}
    assert found == {(0, ("targeted",)): "You are an idiot", (0, ("plain",)): "pathetic", (1, ("reported",)): '"an idiot"', (2, ("negated",)): "She is not an idiot", (3, ("loose", "late")): "I will kill you"}
    score = {r.doc_id: r.score for r in toxicity.score_documents(rows, None, model).collect()}
    assert score[0] > score[2] and score[0] > score[1] and score[3] > score[4] == score[5] == score[6]


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(None, "x", 1), (1, None, 1), (2, "", 1), (3, "same words here", 1), (3, "same words here", 1), (4, "İ " * 50_000, 1)], "doc_id long, text string, toxic int").withColumn("h", F.lit("clash")).withColumn("of_id", F.lit(1))
    labels = spark.createDataFrame([(3, 1, 1), (3, 1, 1), (4, 0, 0), (None, 1, 1), (9, 1, None)], "doc_id long, toxic int, quality int")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    none = toxicity.score_documents(docs, labels.limit(0)).collect()
    assert len(none) == 6 and max(r.score for r in none) < 0.5
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


# alignment --------------------------------------------------------------------------------------


def brute_alignment(texts):
    """What the two libraries and a walk over byte offsets give."""
    a_lib, b_lib = Tokenizer.from_file(A_FILE), sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    a_lib.encode_special_tokens = True
    spell = {c: b for b, c in token_alignment._byte_symbols().items()}
    a_bytes = {i: bytes(spell[c] for c in t) for t, i in a_lib.get_vocab().items() if t != "<|endoftext|>"}

    def piece(i):
        p = b_lib.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    found = []
    for t in texts:
        a = a_lib.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_lib.encode(t) if t else []
        whole = (" " + t).encode() if t else b""
        if not t or b"".join(a_bytes[i] for i in a) != whole or b"".join(piece(i) for i in b) != whole:
            found.append(None)
            continue
        a_end, b_end = list(itertools.accumulate(len(a_bytes[i]) for i in a)), list(itertools.accumulate(len(piece(i)) for i in b))
        links, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            step = a_end[i] - b_end[j]
            i, j = i + (step <= 0), j + (step >= 0)
        groups, i, j = [], 0, 0
        for c in sorted(set(a_end) & set(b_end)):
            i2, j2 = a_end.index(c) + 1, b_end.index(c) + 1
            groups.append((a[i:i2], b[j:j2]))
            i, j = i2, j2
        found.append((a, b, groups, links))
    count = Counter(x for f in found if f for x in f[3])
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    rows = []
    for f in found:
        if f is None:
            rows.append((0, 0, 0, 0, 0, 0, "", 0))
            continue
        a, b, groups, links = f
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(a), len(b), len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest(), sum(len(x) * len(y) for x, y in groups)))
    return rows


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links")
TEXTS = ["", " ", "  two  spaces ", "tab\tand\nline", "Ünïcödé 漢字 😀 café ﬁ", "▁ block", "<|endoftext|> <s> </s> <0x41>", "x" * 3000, "word " * 2000, "a b\x1cc\x85d", "it's they'll 12 345 !?", "कि 漢 字", " lead", "trail ", "漢" * 2000, None]


@pytest.mark.parametrize("broadcast", [1 << 20, 40, 0])
def test_alignment_equals_the_libraries(spark, sf, broadcast, monkeypatch):
    monkeypatch.setattr(token_alignment, "CACHE_UNITS", 500)
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    for c in ("pair", "n", "row", "codes", "rest", "b", "best", "z"):
        frame = frame.withColumn(c, F.lit("clash"))
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in token_alignment.align_documents(frame, A_FILE, B_FILE, broadcast).collect()}
    assert [got[i] for i in range(len(texts))] == brute_alignment([t or "" for t in texts])


def test_unit_cuts_keep_tokens_whole():
    both, rnd = token_alignment.Tokenizers(A_FILE, B_FILE), random.Random(1)
    pool = [" "] * 10 + list("abcAB019.,!'\n\t") + ["  ", "'s", "é", "漢", "▁", " ", "\x85", "\x1c", "😀", "́", "<s>", "ﬁ", "٣", "​"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(1, 40))) for _ in range(3000)]
    split, known = both.split(texts)
    whole = both.align(texts)
    for k, units in enumerate(split):
        good = all(known[u][0] for u in units)
        assert good == whole.good[k]
        if good:
            groups = [g.split("|") for u in units for g in known[u][5].split(";")]
            assert [int(i) for x, _ in groups for i in x.split(",")] == whole.a[whole.a_text == k].tolist()
            assert [int(i) for _, y in groups for i in y.split(",")] == whole.b[whole.b_text == k].tolist()


def test_products_equal_dense_ones():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(40):
        n, m, k = rng.integers(1, 9, 3)
        a, b = rng.random((n, k)) < 0.4, rng.random((k, m)) < 0.4
        csr = lambda x: token_alignment.Csr(np.concatenate(([0], np.cumsum(x.sum(axis=1)))), np.nonzero(x)[1], x.shape[1])
        rows, columns, values = csr(a).times(csr(b))
        dense = np.zeros((n, m), int)
        dense[rows, columns] = values
        assert (dense == a.astype(int) @ b.astype(int)).all()
        t = csr(a).transposed()
        assert all(sorted(t.columns[t.starts[i] : t.starts[i + 1]]) == np.flatnonzero(a[:, i]).tolist() for i in range(k))


def test_links_are_given_with_their_bytes(spark):
    frame = spark.createDataFrame([(1, "tokenizers differ"), (2, None), (3, "ab")], "doc_id long, text string")
    rows = token_alignment.token_links(frame, A_FILE, B_FILE).collect()
    for doc, text in ((1, "tokenizers differ"), (3, "ab")):
        assert sum(r.n_bytes for r in rows if r.doc_id == doc) == len(text) + 1
    shared = token_alignment.token_links(frame, A_FILE, B_FILE, shared_groups=True).collect()
    assert {(r.doc_id, r.a, r.b) for r in rows} <= {(r.doc_id, r.a, r.b) for r in shared} and all(r.n_bytes >= 0 for r in shared)


def test_queries_are_registered():
    assert {"op11_turn_repair", "op12_toxicity", "op13_token_alignment"} <= set(queries.QUERIES) and "op11_turn_repair" in queries.ORACLE_SQL
