"""Operators 11, 12 and 13 against plain loops over the ``tokenizers`` and ``sentencepiece`` forms of the vocabularies."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.llm import alignment, balance, importance, packing, tokens
from candela.llm.tokens import vocabulary

ODD = [" x", "a  b", "x \n y ", "▁a", "<|endoftext|> hi <s> </s>", "\x00a b", "ﬁ Å ½ z", "tab\tx\r\n", "é ​", "   ", "\n", "a", "nbsp\xa0x", "word" * 400]


@pytest.fixture(scope="module")
def rows(texts):
    """Odd texts, repeated rows and a null id besides the common ones."""
    out = [(i * 3 + 1, t) for i, t in enumerate([*texts, *ODD])]
    return [*out, out[0], out[0], (None, texts[2]), (None, None)]


@pytest.fixture(scope="module")
def clashing(spark, rows):
    """More columns, with names that operators use inside."""
    return spark.createDataFrame([(d, t, "r", 1, None) for d, t in rows], "doc_id long, text string, row string, ids int, `key.n` string").repartition(3)


def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    return tok, sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))


def byte_letters():
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute_align(rows):
    tok, sp = encoders()
    tok.encode_special_tokens = True
    letters = byte_letters()
    of_a = lambda i: bytes(letters[c] for c in tok.id_to_token(i))
    of_b = lambda i: bytes([int(sp.IdToPiece(i)[3:5], 16)]) if sp.IsByte(i) else sp.IdToPiece(i).replace("▁", " ").encode()
    made, count = [], Counter()
    for d, t in rows:
        made.append((d, None))
        if not t:
            continue
        a, b, want = tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t), (" " + t).encode()
        if b"".join(map(of_a, a)) != want or b"".join(map(of_b, b)) != want:
            continue
        of_byte = [[k for k, i in enumerate(ids) for _ in f(i)] for ids, f in ((a, of_a), (b, of_b))]
        links = sorted(set(zip(*of_byte)))
        ends = [{sum(len(f(i)) for i in ids[: k + 1]): k for k in range(len(ids))} for ids, f in ((a, of_a), (b, of_b))] if len(want) < 3000 else None
        if ends is None:
            ends = [dict(zip(np.cumsum([len(f(i)) for i in ids]).tolist(), range(len(ids)))) for ids, f in ((a, of_a), (b, of_b))]
        groups, i, j = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            ni, nj = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(map(str, a[i:ni])) + "|" + ",".join(map(str, b[j:nj])))
            i, j = ni, nj
        pairs = [(a[x], b[y]) for x, y in links]
        count.update(set(pairs))
        made[-1] = (d, (len(a), len(b), groups, pairs))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return sorted(((d, 0, 0, 0, 0, 0, 0, "") if m is None else (d, m[0], m[1], len(m[2]), len(m[3]), sum(count[p] == best[p[0]] for p in m[3]), sum(count[p] for p in m[3]), hashlib.sha256(";".join(m[2]).encode()).hexdigest()) for d, m in made), key=str)


@pytest.mark.parametrize("piece, head", [(alignment.PIECE, alignment.HEAD), (40, 50), (1, 0)])
def test_alignment(spark, rows, clashing, piece, head):
    """The same rows whatever the length of the pieces and however few pairs are held."""
    got = alignment.align(clashing, piece=piece, head=head).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute_align(rows)


def test_diagonals_cut_equal_work():
    r = np.random.default_rng(3)
    for na, nb in ((0, 0), (5, 0), (0, 7), (1, 1), (300, 200), (10, 900)):
        a, b = (np.sort(r.choice(1000, n, replace=False)) for n in (na, nb))
        for every in (1, 3, 64):
            cut = alignment.diagonals(a, b, every)
            assert cut[:, 0].tolist() == [0, 0] and cut[:, -1].tolist() == [na, nb]
            for (i, j), (x, y) in zip(cut.T, cut.T[1:]):
                assert 0 < x - i + y - j <= every + 1
                before, after = [*a[:x], *b[:y]], [*a[x:], *b[y:]]
                assert not before or not after or max(before) < min(after)  # sorted, and no shared end is cut in two


def test_empty_tables(spark, no_docs):
    assert alignment.align(no_docs).count() == balance.pack_balanced(no_docs).count() == importance.resample(no_docs, no_docs).count() == 0


@pytest.mark.parametrize("capacity, block", [(1024, 1024), (1024, 5), (16, 7)])
def test_balanced_packing(spark, rows, clashing, capacity, block):
    """Ids as the ``tokenizers`` form gives them, each in one part; sequences gapless, within capacity, without padding."""
    tok, _ = encoders()
    want = Counter()
    for d, t in rows:
        want.update([(d, tuple(tok.encode(t or "", add_special_tokens=False).ids + [balance.END]))])
    got = balance.pack_balanced(clashing, capacity, block=block).collect()
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
        assert {r.sequence_cost for r in own} == {sum(balance.LINEAR * r.length + balance.QUADRATIC * r.length**2 for r in own)}
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    for d, own in by_doc.items():
        copies = {ids: n for (x, ids), n in want.items() if x == d}
        assert sum(len(i) * n for i, n in copies.items()) == sum(r.length for r in own)
        at = Counter((r.doc_tokens, p) for r in own for p in range(r.start, r.start + r.length))
        assert at == Counter({(len(i), p): n for i, n in copies.items() for p in range(len(i))} if len({len(i) for i in copies}) == len(copies) else at)
        assert all(any(len(i) == r.doc_tokens and crc(i[r.start : r.start + r.length]) == r.ids_crc32 for i in copies) for r in own)
    assert set(by_doc) == {d for d, _ in want}


def test_costs_are_balanced():
    """Where documents fit whole, the dearest sequence is near the mean; each goes to the cheapest one with room."""
    r = np.random.default_rng(5)
    lengths = r.integers(1, 300, 600).tolist()
    parts, cost = balance.assign(lengths, 1024)
    full = cost[: sum(lengths) // 1024]
    assert full.max() < 1.05 * full.mean()
    assert sum(p[2] for p in parts) == sum(lengths) and len(parts) < 1.3 * len(lengths)
    room, spent = np.array(balance.sizes_of(sum(lengths), 1024)), np.zeros(len(cost), int)
    for k, at, n, s, _ in parts:
        left = lengths[k] - at
        fits = np.flatnonzero(room >= left)
        assert (spent[s] == spent[fits].min() and n == left) if len(fits) else room[s] == room.max()
        room[s] -= n
        spent[s] += balance.LINEAR * n + n * n


def brute_resample(rows, target, percent, sizes=2):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = {c: c + 32 for c in range(65, 91)}

    def of(text):
        w = word.findall((text or "").translate(low))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in range(1, sizes + 1) for i in range(len(w) - n + 1)]

    docs = [(d, *of(t)) for d, t in rows]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for x in target for b in of(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + 10_000) / ((s[b] + 1) * (nt + 10_000)))) for b in {*s, *t}}
    out = []
    for d, n, f in docs:
        w = sum(gain[b] for b in f) // len(f) if f else 0
        h = None if d is None else int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), w, None if h is None else w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    drawn = sorted((r for r in out if r[5] >= 20 and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("percent, limit", [(25, importance.LIMIT), (100, 64), (0, 1)])
def test_importance(spark, rows, clashing, monkeypatch, percent, limit):
    """Also with texts read in small blocks, each led by the last word before it."""
    monkeypatch.setattr(importance.runs, "__defaults__", (limit, 1))
    target = [t for _, t in rows[:9]] + [None, ""]
    got = importance.resample(clashing, spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int"), percent)
    assert sorted(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == brute_resample(rows, target, percent)


def test_longer_grams_in_blocks():
    texts = [t.encode() for t in ("One two three ONE two\nthree four", "", "x", "éé a1 b2 c3 " * 9)]
    whole = importance.features(texts, sizes=3)
    bits = [(lo, *importance.features(own, carried, sizes=3)) for lo, own, carried in importance.runs(texts, 10, carry=2)]
    assert sorted(zip(*map(list, whole[:2]))) == sorted((lo + d, b) for lo, docs, found, _ in bits for d, b in zip(docs, found))
    assert Counter(whole[2].tolist()) == Counter(lo + d for lo, _, _, words in bits for d in words.tolist())


def test_target_like_documents_are_drawn(spark):
    """Documents in the target's words come before others, whatever the noise of most."""
    docs = [(i, " ".join(f"{'goal' if i % 4 == 0 else 'other'}{(i * 7 + k) % 30}" for k in range(40))) for i in range(400)]
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(" ".join(f"goal{k}" for k in range(30)),)] * 100, "text string"))
    assert got.where(F.col("rank").isNotNull() & (F.col("doc_id") % 4 == 0)).count() > 85


def test_pieces_come_from_whole_texts(monkeypatch):
    """op7's pieces hold the ids of the ``tokenizers`` file, and no text is looked up word by word, which costs twice as much where most words are rare."""
    import pyarrow as pa

    class Captured:
        selectExpr = lambda self, *_: self
        mapInArrow = lambda self, f, _: f

    def refuse(*_):
        raise AssertionError("word by word")

    monkeypatch.setattr(tokens._Cache, "__missing__", refuse)
    texts = [*ODD, None, "", "<|endoftext|>", "a<|endoftext|><|endoftext|>b c", " ".join(f"w{i * 7919}" for i in range(3000))]
    run = packing.token_pieces(Captured(), with_ids=True)
    got = defaultdict(list)
    for batch in run(iter([pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})])):
        for r in batch.to_pylist():
            assert r["start"] == len(got[r["doc_id"]]) and r["length"] == len(r["ids"]) <= 1024
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            got[r["doc_id"]] += r["ids"]
    tok, _ = encoders()
    assert got == {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
