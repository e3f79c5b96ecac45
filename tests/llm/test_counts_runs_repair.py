"""Token counts, periodic runs and conversation repair against the library and brute force."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stopwise.llm import packing, periodic, repair, tokencounts

TEXTS = [None, "", "   ", "two words", "two words", "Hello  World's 123 <|endoftext|> x<|StartofText|>y <|startoftext|>", "İstanbul straße don't WE'LL ½²",
         "ab\x1fc\x85d\xa0e", "日本語 テスト 한국어 Σίσυφος ǅ", "é combined á", "🎉🎉 ok!?", "word " * 30_000, "<|endoftext|>", "x" * 5000]


def documents(spark, texts, extra=True):
    rows = [(i if i % 5 else None, t, "en", "s", 1, 2, 3) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, kind string, block string, word int, spot int, pieces int")
    return frame if extra else frame.select("doc_id", "text")


# --- 13


def library_counts(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path(tokencounts.TOKENIZER))
    return [len(whole.encode(t or "", add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("block_chars", [1, 40_000, 8_000_000])
def test_token_counts_are_those_of_the_library(spark, block_chars):
    rng = random.Random(4)
    alphabet = "abcXYZ'stremdlv 12\t\x85\xa0\x1f.,-<|>éŉſßÀ日ß̈" + "".join(map(chr, range(0x100, 0x250)))
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(60)]
    docs = documents(spark, texts).repartition(5)
    found = tokencounts.token_counts(docs, packing.tokenizer_path(tokencounts.TOKENIZER), block_chars)
    ids = [i if i % 5 else None for i in range(len(texts))]
    wanted = Counter(zip(ids, (len((t or "").encode()) for t in texts), library_counts(texts)))
    assert Counter(map(tuple, found.collect())) == wanted
    assert found.columns == ["doc_id", "n_bytes", "n_tokens"]


def test_token_counts_of_the_table_and_of_none(spark, folder):
    found = {r.doc_id: r for r in tokencounts.op13_pretoken_counts(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(found) == len(docs)
    for doc, tokens in zip(docs, library_counts([d.text for d in docs])):
        row = found[doc.doc_id]
        assert (row.n_tokens, row.n_bytes, row.over_limit) == (tokens, len((doc.text or "").encode()), tokens > 2048)
    none = documents(spark, []).select("doc_id", "text")
    assert tokencounts.token_counts(none, packing.tokenizer_path(tokencounts.TOKENIZER)).count() == 0


def test_a_pre_token_is_one_row_per_block(spark):
    docs = spark.createDataFrame([(i, "the same words again") for i in range(2000)], "doc_id bigint, text string").coalesce(2)
    made = tokencounts.blocks(docs, packing.tokenizer_path(tokencounts.TOKENIZER))
    assert made.filter("kind = 'word'").groupBy("word", "block").count().agg(F.max("count")).first()[0] == 1


# --- 12


def brute_runs(words, shortest=periodic.SHORTEST, repeats=periodic.REPEATS):
    n, found = len(words), set()
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            smaller = any(all(words[x] == words[x + r] for x in range(i, i + length - r)) for r in range(1, q))
            if j > i and length >= max(shortest, repeats * q) and not smaller:
                found.add((i, length, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    n, letters = rng.randrange(0, 60), rng.choice([1, 2, 3, 9])
    words = [b"w%d" % rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n:
            a, p = rng.randrange(n), rng.randrange(1, 7)
            words[a:] = [words[a + x % min(p, n - a)] for x in range(min(5 * p, n - a))] + words[a + 5 * p:]
    return words


def test_runs_are_those_of_brute_force():
    rng = random.Random(2)
    for shortest, repeats in ((6, 4), (2, 2), (3, 3)):
        texts = [periodic_words(rng) for _ in range(400)]
        assert periodic.runs_of_all(texts, shortest, repeats) == [brute_runs(t, shortest, repeats) for t in texts]


def test_suffix_tree_has_the_suffix_order_and_extensions():
    rng = random.Random(3)
    for _ in range(60):
        s = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 40))]
        tree = periodic.SuffixTree(s)
        order, shallow = tree.leaves()
        assert order == sorted(range(len(s) + 1), key=lambda i: s[i:] + [0])
        assert tree.leaves(turned=True)[0] == sorted(range(len(s) + 1), key=lambda i: [-x for x in s[i:]] + [-9])
        pairs = [(i, j) for i in range(len(s)) for j in range(len(s)) if i != j]
        if pairs:
            import numpy as np

            found = periodic.Extensions(order, shallow).of(*map(np.array, zip(*pairs)))
            for (i, j), k in zip(pairs, found):
                assert s[i:i + k] == s[j:j + k] and (max(i, j) + k == len(s) or s[i + k] != s[j + k])


def expected_row(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_documents(spark, tmp_path):
    rng = random.Random(6)
    texts = [None, "", " \t\n ", "a a a a a a", "a b a b a b a b c", "x\x0by\x0cz\rx y", "é é é é é é é", "naïve  b"] + [b" ".join(periodic_words(rng)).decode() for _ in range(120)]
    rows = [(i if i != 9 else None, t) for i, t in enumerate(texts)] * 2
    frame = spark.createDataFrame([(*r, 1, "r") for r in rows], "doc_id bigint, text string, n_runs int, runs string").repartition(3)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = Counter(map(tuple, periodic.op12_lyndon_lce_runs(spark, str(tmp_path)).collect()))
    assert found == Counter(expected_row(*r) for r in rows)
    assert sum(n for r, n in found.items() if r[1]) > 60
    assert periodic.periodic_runs(frame.limit(0)).count() == 0


def test_runs_of_the_table(spark, folder):
    docs = [d for d in spark.read.parquet(f"{folder}/documents.parquet").collect() if len(d.text or "") < 900]
    found = {r.doc_id: tuple(r) for r in periodic.op12_lyndon_lce_runs(spark, folder).collect()}
    assert len(docs) > 40 and all(found[d.doc_id] == expected_row(d.doc_id, d.text) for d in docs)


def test_a_long_period_and_a_long_run():
    words = [b"%d" % (i % 3000) for i in range(15_000)]
    assert periodic.runs(words) == [(0, 15_000, 3000)]
    assert periodic.runs([b"a"] * 20_000) == [(0, 20_000, 1)]
    assert len(periodic.collapsed(words, periodic.runs(words))) == 3000


# --- 11


def best_edits(rows):
    """Cheapest edits of (role, fault) rows by trying all, ties by the letters."""
    best = (2 * len(rows), "D" * len(rows))

    def go(i, output, cost, letters):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows) and output in repair.ENDS:
            best = min(best, (cost, letters))
        for to in repair.STEPS[output]:
            if to != "s":
                go(i, to, cost + 5, letters + "I")
        if i < len(rows):
            role, fault = rows[i]
            go(i + 1, output, cost + 2, letters + "D")
            stay = 5 if fault == "truncated" else 0
            if fault not in repair.MUST_GO:
                for to in repair.STEPS[output]:
                    if role[:1] == to:
                        go(i + 1, to, cost + stay, letters + "K")
                    if to != "s":
                        go(i + 1, to, cost + stay + 1, letters + "R")

    go(0, "", 0, "")
    return best


def test_edits_are_the_cheapest_and_first():
    rng = random.Random(3)
    for _ in range(500):
        roles = ["user", "assistant", "system", "tool", "", "sys"][:rng.choice([2, 3, 6])]
        rows = [(rng.choice(roles), rng.choice([None, None, None, "blank", "duplicate", "truncated"])) for _ in range(rng.randrange(0, 7))]
        search, out = repair.Repair(), []
        for number, (role, fault) in enumerate(rows):
            out += search.feed((number,), role, fault)
        cost, rest = search.finish()
        out += rest
        assert (cost, "".join(e for e, _ in out)) == best_edits(rows)
        assert [row[0] for edit, row in out if edit != "I"] == list(range(len(rows)))


def test_open_edits_stay_few_on_a_long_conversation():
    rng = random.Random(5)
    search, most = repair.Repair(), 0
    for number in range(20_000):
        search.feed((number,), rng.choice(["user", "assistant"]), rng.choice([None, None, None, "blank", "truncated"]))
        most = max(most, len(search.pending))
    assert most < 1000
    alike = repair.Repair()
    for number in range(3000):
        alike.feed((number,), "tool", None)
    assert max(len(repair.branch(node)) for _, node in alike.best.values()) < 10  # equal edits share a node


def conversation_report(conv_id, rows):
    """The contract for one conversation: (turn, role, text) rows, in plain loops."""
    after = []
    for turn, role, text in sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        after += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    faults, seen = [], set()
    for _, role, text in after:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    cost, audit = best_edits([(role, fault) for (_, role, _), fault in zip(after, faults)])
    lines, output, left = [], "", iter(after)
    for edit in audit:
        _, role, text = next(left) if edit != "I" else (None, None, "")
        if edit != "D":
            start = role[0] if edit == "K" else next(r for r in repair.STEPS[output] if r != "s")
            output = start
            lines.append(f"{role if edit == 'K' else repair.NAMES[start]}:{text}")
    turns = {t for t, _, _ in after if t is not None}
    roles = [r[:1] for _, r, _ in after]
    return (conv_id, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in repair.FAULTS),
            sum(a + b not in repair.LEGAL for a, b in zip(roles, roles[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_reports_of_conversations(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for conv_id in [None, *range(60)]:
        for _ in range(rng.randrange(1, 7)):
            turn = rng.choice([None, 0, 1, 2, 3, 4, 9, 2**60])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv_id, turn, role, rng.choice([None, "", " \t", "Yes.", "Yes.", "no end", "Why? ", "A!\nB", "ü。"])))
    rows += rows[:40]
    frame = spark.createDataFrame([(*r, "x", False) for r in rows], "conv_id bigint, turn bigint, role string, text string, fault string, gone boolean")
    frame.repartition(6).write.parquet(f"{tmp_path}/conversations.parquet")
    found = sorted((tuple(r) for r in repair.op11_survivor_coalescence(spark, str(tmp_path)).collect()), key=str)
    of = {}
    for conv_id, *row in rows:
        of.setdefault(conv_id, []).append(tuple(row))
    short = {c: r for c, r in of.items() if len(r) < 9}
    wanted = {c: conversation_report(c, r) for c, r in short.items()}
    assert len(found) == len(of) and len(short) > 40
    assert all(r == wanted[r[0]] for r in found if r[0] in wanted)
    assert repair.reported(repair.edited(repair.classified(repair.damaged(frame.limit(0))))).count() == 0


def test_reports_of_the_table(spark, folder):
    of = {}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        of.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    found = {r.conv_id: tuple(r) for r in repair.op11_survivor_coalescence(spark, folder).collect()}
    assert found == {c: conversation_report(c, rows) for c, rows in of.items()}


def test_a_conversation_without_rows_left(spark, tmp_path):
    dropped = [c for c in range(500) if zlib.crc32(f"{c}:1".encode()) % 20 == 0][:3]
    spark.createDataFrame([(c, 1, "user", "Hi.") for c in dropped], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = [tuple(r) for r in repair.op11_survivor_coalescence(spark, str(tmp_path)).collect()]
    assert sorted(found) == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in dropped]


def test_repaired_rows_have_the_legal_form(spark):
    rows = [(1, 0, "system", "Be short."), (1, 1, "assistant", "Hello."), (1, 2, "user", "What?"), (1, 3, "user", "What?"), (1, 4, "assistant", "That."), (2, 0, "user", "x" * 300_000 + ".")]
    made = repair.repaired(repair.repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()
    assert [(r.role, r.text) for r in made if r.conv_id == 1] == [("user", "Be short."), ("assistant", "Hello."), ("user", "What?"), ("assistant", "That.")]
    assert [r.role for r in made if r.conv_id == 2] in ([], ["user", "assistant"])


# --- 2, against the untouched tokenizer


@pytest.mark.parametrize("text", ["x <|endoftext|> y", "<|endoftext|><|endoftext|>", "no special <|end", "日本 <|endoftext|>", "a<|endoftext|>b" * 400])
def test_ids_are_those_of_the_untouched_tokenizer(spark, text):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    wanted = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert packing.encoder(path).encode(text) == wanted
    pieces = packing.tokenized_pieces(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), path).orderBy("start").collect()
    assert b"".join(bytes(p.ids) for p in pieces) == b"".join(int(i).to_bytes(4, "little") for i in [*wanted, packing.SEPARATOR])
